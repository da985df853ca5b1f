"""Streams over the given tables, and tables that streams write."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.sources import attempts


def table_stream(spark: SparkSession, sf_dir: str, name: str, files_per_batch: int = 100) -> DataFrame:
    """The table as a stream of its files."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    # As a pattern, a path may be one file or a folder of files.
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{sf_dir}/{name}.parque[t]")


def _manifest(path: str, manifest: str | None) -> str:
    return manifest or f"{path}-attempts"


def put_batch(rows: DataFrame, path: str, batch: int) -> None:
    """The rows of one micro-batch; a batch that is run again replaces its own rows, by another attempt (see sources.attempts)."""
    attempt = attempts.new_attempt()
    rows.write.parquet(attempts.folder(path, batch, attempt))
    attempts.finish(rows.sparkSession, _manifest(path, None), batch, attempt)


def create(spark: SparkSession, path: str, schema: str, manifest: str | None = None) -> None:
    """An empty table and manifest, unless they are there. Tables of one manifest change together."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(attempts.folder(path, -1, "a"))
    # A manifest without rows is a folder that others add to.
    spark.createDataFrame([], attempts.MANIFEST).write.mode("ignore").parquet(_manifest(path, manifest))


def read_table(spark: SparkSession, path: str, schema: str, manifest: str | None = None) -> DataFrame:
    """All batches, with the column batch."""
    rows = spark.read.schema(f"{schema}, batch long, attempt string").parquet(path)
    return rows.join(attempts.valid(spark, _manifest(path, manifest)), ["batch", "attempt"], "left_semi").drop("attempt")


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", available_now: bool = True) -> StreamingQuery:
    """Starts a query that writes each micro-batch to the table at path, which read_table reads."""
    create(stream.sparkSession, path, ", ".join(f"`{n}` {t}" for n, t in stream.dtypes))
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(lambda rows, n: put_batch(rows, path, n))
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def newest(rows: DataFrame, key: str) -> DataFrame:
    """The row of each key from its last batch: an update-mode table has at most one in each batch."""
    rest = [c for c in rows.columns if c not in (key, "batch")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_last")).select(key, "_last.*")
