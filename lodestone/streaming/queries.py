"""Streaming queries over the whole tables: each runs until the given files are read and returns what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.shared import shared_folder
from lodestone.sources.views import view
from lodestone.streaming import answers, ingest
from lodestone.streaming.tables import newest, read_table, table_stream, to_table


def _ran(stream: DataFrame, name: str, mode: str) -> DataFrame:
    spark = stream.sparkSession
    path = shared_folder(spark, name)
    to_table(stream, f"{path}/rows", f"{path}/checkpoint", mode).awaitTermination()
    return read_table(spark, f"{path}/rows", ", ".join(f"`{n}` {t}" for n, t in stream.dtypes))


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All uploads as plain texts, whatever their names end in."""
    path = shared_folder(spark, "stream_ingest")
    uploads = view(spark, sf_dir, "uploads", table_stream).drop("filename")
    ingest.stream_ingest(uploads, path, 120, 50, 20).awaitTermination()
    chunks = ingest.published(spark, path).groupBy("doc_id").agg(F.sum("tok").alias("tokens"), F.min("sensitivity_ordinal").alias("sensitivity_ordinal"))
    return ingest.documents(spark, path).drop("batch").join(chunks, "doc_id", "left")


def progress_latest_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "progress", table_stream)
    return newest(_ran(answers.latest_stream(events), "progress_latest", "update"), "doc_id")


def progress_throttle_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = view(spark, sf_dir, "progress", table_stream)
    return _ran(answers.throttle_stream(events), "progress_throttle", "append").drop("batch")


def answer_assembly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = view(spark, sf_dir, "messages", table_stream)
    kind = F.when(F.col("role") == "assistant", "token").when(F.col("role") == "user", "citation").otherwise("error")
    events = messages.select(F.col("session_id").alias("key"), F.col("message_id").alias("seq"), kind.alias("type"), F.col("content").alias("data"))
    return newest(_ran(answers.assemble_stream(events), "answer_assembly", "update"), "key")


QUERIES = {f.__name__: f for f in (stream_ingest, progress_latest_stream, progress_throttle_stream, answer_assembly_stream)}
#: Queries whose rows equal those of a query over the tables at rest.
SAME = {"progress_latest_stream": "progress_latest", "progress_throttle_stream": "progress_throttle", "answer_assembly_stream": "answer_assembly"}
