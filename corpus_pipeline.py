"""From raw documents to a training mix: each stage's decisions take effect before the next one.

Columns of documents pass through unchanged; the last stage adds mix_copy, the number of the
emission. No oracle: the first stage is a trained model; tests compare each stage with a brute-force version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestone.llm import decontaminate, line_dedup, mixing, simhash, toxicity_cnn
from lodestone.llm.common import columns, cut


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Trained on the labelled rows among docs."""
    model, limits = toxicity_cnn.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity_cnn.without_toxic(docs, model, limits)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated chunks go from the texts; a document of which no word is left goes too, as all its text stands elsewhere."""
    return line_dedup.dedup_lines(docs).where("not _emptied").select(*columns(docs))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return simhash.keep_one(docs)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by benchmark items go."""
    return decontaminate.without_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight says."""
    return mixing.mix(docs)


STAGES = [("toxicity", toxicity), ("line_dedup", lines), ("simhash_near_dedup", near_copies), ("decontamination", benchmarks), ("mixing", mix)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
