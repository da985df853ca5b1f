"""Admission, exact dedup, publishing and per-document totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.vocabulary import CONVERTIBLE, DEFAULT_ORDINAL, DIRECT, LEVELS, MAX_UPLOAD_BYTES, ROLES, TAGS
from lodestone.sources import attempts


def suffix(filename: Column) -> Column:
    """The lower-cased last suffix without its dot; empty if there is none."""
    return F.lower(F.regexp_extract(filename, "[^/]\\.([^./]+)$", 1))


def route_by_format(files: DataFrame) -> DataFrame:
    """files with suffix and route: direct, convert or unsupported."""
    s = suffix(F.col("filename"))
    return files.withColumn("suffix", s).withColumn("route", F.when(s.isin(*DIRECT), "direct").when(s.isin(*CONVERTIBLE), "convert").otherwise("unsupported"))


def ordinal(level: Column) -> Column:
    """The level's ordinal; unknown levels have the default."""
    out = None
    for name, n in LEVELS.items():
        out = F.when(level == name, n) if out is None else out.when(level == name, n)
    return out.otherwise(DEFAULT_ORDINAL)


def admission_hash() -> Column:
    """SHA-256 of an upload's text, null counting as empty."""
    return F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)


def admission_fault() -> Column:
    """Why an upload is rejected whatever else is there (null: it isn't)."""
    text, tags = F.coalesce("text", F.lit("")), F.coalesce("acl_tags", F.array().cast("array<string>"))
    size = F.octet_length(text)
    return F.when(size > MAX_UPLOAD_BYTES, "too_large").when(size == 0, "empty").when(F.size(tags) == 0, "no_tags").when(F.size(F.array_except(tags, F.array(*map(F.lit, TAGS)))) > 0, "unknown_tag").when(~F.coalesce(F.col("sensitivity_level").isin(*LEVELS), F.lit(False)), "bad_level")


def admission_gate(uploads: DataFrame, stored_hashes: DataFrame | None = None) -> DataFrame:
    """uploads with content_hash and reason (null: accepted), the first that holds.

    Null text counts as empty, null tags as none. Of equal contents that are valid otherwise the
    smallest doc_id is accepted; a rejected upload blocks no later one.
    """
    u = uploads.withColumn("content_hash", admission_hash()).withColumn("_bad", admission_fault())
    first = u.where("_bad is null").groupBy("content_hash").agg(F.min("doc_id").alias("_first"))
    u = u.join(first, "content_hash", "left")
    duplicate = F.col("doc_id") > F.col("_first")
    if stored_hashes is not None:
        u = u.join(stored_hashes.select("content_hash").distinct().withColumn("_stored", F.lit(True)), "content_hash", "left")
        duplicate = duplicate | F.coalesce("_stored", F.lit(False))
    return u.withColumn("reason", F.coalesce("_bad", F.when(duplicate, "duplicate"))).select(*uploads.columns, "content_hash", "reason")


def content_hash_dedup(docs: DataFrame, order: str = "doc_id", stored: DataFrame | None = None) -> DataFrame:
    """doc_id, content_hash of the first document of each content by order, then doc_id; null texts never collide.

    stored: content_hash of the documents that are held already, whatever became of them; their contents are left out.
    """
    h = docs.select("doc_id", F.col(order).alias("_order"), F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"))
    known = h.where("content_hash is not null").groupBy("content_hash").agg(F.min(F.struct("_order", "doc_id")).alias("_first"))
    if stored is not None:
        known = known.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
    return known.select("_first.doc_id", "content_hash").unionByName(h.where("content_hash is null").drop("_order"))


def upload_name_dedup(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """Files of the batch whose name wasn't selected before."""
    return batch.join(existing.select("filename").distinct(), "filename", "left_anti").select(*batch.columns)


def ingest_rows(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """Chunk rows with the tags and ordinal of their document, and its source if they have none."""
    source = ["source"] if "source" in docs.columns and "source" not in chunks.columns else []
    d = docs.select("doc_id", "acl_tags", ordinal(F.col("sensitivity_level")).alias("sensitivity_ordinal"), *source)
    return chunks.drop("acl_tags", "sensitivity_ordinal").join(d, "doc_id")


def publish(rows: DataFrame, documents: DataFrame, path: str, batch: int) -> None:
    """Adds chunk rows and the documents (doc_id, status, ...) that they belong to as a batch.

    Both are written as an attempt (see sources.attempts), which its row in `attempts` makes visible: published() shows
    chunks of documents that are there and done, so both appear together. A batch that is run again replaces its
    rows by another such row, never by touching files that a reader may hold; retire() lists what is left behind.
    """
    attempt = attempts.new_attempt()
    rows.write.partitionBy("sensitivity_ordinal").parquet(attempts.folder(f"{path}/chunks", batch, attempt))
    documents.write.parquet(attempts.folder(f"{path}/documents", batch, attempt))
    attempts.finish(rows.sparkSession, f"{path}/attempts", batch, attempt)


def published(spark: SparkSession, path: str) -> DataFrame:
    """The chunk rows whose documents are done, of the attempt that each batch finished last."""
    valid = attempts.valid(spark, f"{path}/attempts")
    read = lambda name: spark.read.parquet(f"{path}/{name}").join(valid, ["batch", "attempt"], "left_semi")
    done = read("documents").where("status = 'done'").select(F.col("doc_id").alias("_doc"), F.col("batch").alias("_batch"))
    rows = read("chunks")
    return rows.join(done, (rows["document_id"] == done["_doc"]) & (rows["batch"] == done["_batch"]), "left_semi").drop("batch", "attempt")


def retire(spark: SparkSession, path: str) -> DataFrame:
    """batch, attempt, folder of what published() no longer or never showed (see attempts.stale)."""
    return attempts.stale(spark, [f"{path}/chunks", f"{path}/documents"], f"{path}/attempts")


def chunk_key_audit(chunks: DataFrame) -> DataFrame:
    """document_id, chunk_index, n of keys that occur more than once."""
    return chunks.groupBy("document_id", "chunk_index").agg(F.count("*").alias("n")).where("n > 1")


def check_audit(messages: DataFrame, documents: DataFrame) -> DataFrame:
    """table, id, column, value of the rows that a CHECK forbids: roles other than user and assistant, levels outside the vocabulary. Null passes, as in SQL."""
    bad = lambda df, name, id_, column, allowed: df.where(~F.col(column).isin(*allowed)).select(F.lit(name).alias("table"), F.col(id_).alias("id"), F.lit(column).alias("column"), F.col(column).alias("value"))
    return bad(messages, "messages", "message_id", "role", ROLES).unionByName(bad(documents, "documents", "doc_id", "sensitivity_level", LEVELS))


def finalize_documents(docs: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, total_chunks, processed_chunks, total_pages, file_type, status and stage (null: nothing is going on) of finished documents."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    p = pages.groupBy("doc_id").agg(F.max("page_number").alias("total_pages"))
    s = suffix(F.col("filename"))
    total = F.coalesce("n", F.lit(0))
    return docs.select("doc_id", F.when(s == "", "unknown").otherwise(s).alias("file_type")).join(n, "doc_id", "left").join(p, "doc_id", "left").select("doc_id", total.alias("total_chunks"), total.alias("processed_chunks"), "total_pages", "file_type", F.lit("done").alias("status"), F.lit(None).cast("string").alias("stage"))


def ingest_failures(docs: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, error of documents without pages, or with pages but no chunks."""
    has_page, has_chunk = pages.select("doc_id").distinct().withColumn("_p", F.lit(1)), chunks.select("doc_id").distinct().withColumn("_c", F.lit(1))
    error = F.when(F.col("_p").isNull(), "parse empty").when(F.col("_c").isNull(), "chunk empty")
    return docs.select("doc_id").join(has_page, "doc_id", "left").join(has_chunk, "doc_id", "left").select("doc_id", F.substring(error, 1, 1000).alias("error")).where("error is not null")


def _batch_size(n: Column, cap: int) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(cap), F.ceil(n / 10).cast("int")))


def embed_batch_plan(chunk_counts: DataFrame, cap: int = 32) -> DataFrame:
    """doc_id, n, batch_size, n_batches: about ten batches a document, at most cap chunks each. See embed_batches."""
    size = _batch_size(F.col("n"), cap)
    return chunk_counts.select("doc_id", "n", size.alias("batch_size"), F.ceil(F.col("n") / size).cast("int").alias("n_batches"))


def embed_batches(chunks: DataFrame, cap: int = 32) -> DataFrame:
    """chunks (doc_id, chunk_index) with batch_no from 0: the batch of its document in which a chunk is embedded."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("_n"))
    return chunks.join(n, "doc_id").withColumn("batch_no", F.floor(F.col("chunk_index") / _batch_size(F.col("_n"), cap)).cast("int")).drop("_n")


def embedding_qc(vectors: DataFrame, dim: int, limit: float = 3.0) -> DataFrame:
    """vec_id and flags of missing, wrong_dim, all_zero and out_of_range (first 20 components)."""
    v = F.col("embedding")
    return vectors.select("vec_id", v.isNull().alias("missing"), F.coalesce(F.size(v) != dim, F.lit(False)).alias("wrong_dim"), F.coalesce(F.forall(v, lambda x: x == 0), F.lit(False)).alias("all_zero"), F.coalesce(F.exists(F.slice(v, 1, 20), lambda x: F.abs(x) >= limit), F.lit(False)).alias("out_of_range"))
