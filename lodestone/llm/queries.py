"""The queries of this subpackage and their SQL; each covers its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import alignment, decontaminate, line_dedup, mixing, packing, quality_gbt, quality_rules, secret_scan, simhash, spelling, toxicity_cnn, url_filters, warc_fixity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text that stays, and the number of bytes removed."""
    docs = line_dedup.dedup_lines(_table(spark, sf_dir, "documents"))
    return docs.select("doc_id", "text", docs["_removed"].alias("removed"))


def op3_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Damage found in a replica of the pages that has known faults."""
    return warc_fixity.audit(*warc_fixity.replicas(_table(spark, sf_dir, "pages")))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_gbt.score(docs, quality_gbt.train(docs, _table(spark, sf_dir, "labels")))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model, limits = toxicity_cnn.train(docs, _table(spark, sf_dir, "labels"))
    return toxicity_cnn.judge(toxicity_cnn.score(docs, model, limits))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(_table(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(_table(spark, sf_dir, "documents"))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.judge(_table(spark, sf_dir, "pages"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("h")


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, _ = alignment.align(_table(spark, sf_dir, "documents"), digest=True)
    return documents.withColumnRenamed("groups", "groups_sha256")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_line_dedup, op3_warc_fixity, op4_quality_classifier, op5_toxicity, op6_secret_scan, op7_simhash, op8_quality_rules, op9_url_filters, op10_decontaminate, op11_best_fit_packing, op12_tokenizer_alignment, op13_spelling_variants)}
ORACLES = {"op1_mix_sources": mixing.ORACLE, "op3_warc_fixity": warc_fixity.ORACLE, "op9_url_filters": url_filters.ORACLE, "op10_decontaminate": decontaminate.ORACLE}
