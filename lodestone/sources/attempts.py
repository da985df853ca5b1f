"""Tables whose batches are written anew without touching what a reader holds.

Each attempt at a batch has folders of its own, batch=N/attempt=A. What makes it valid is a row of the manifest, written
last as one file; of several rows for a batch the last one counts. So tables that share a manifest change together.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "batch long, attempt string, finished_at timestamp"


def new_attempt() -> str:
    # The letter in front keeps the name a string when folders are read.
    return f"a{uuid.uuid4().hex}"


def folder(table: str, batch: int, attempt: str) -> str:
    return f"{table}/batch={batch}/attempt={attempt}"


def finish(spark: SparkSession, manifest: str, batch: int, attempt: str) -> None:
    """Makes the attempt the one that readers see."""
    row = spark.range(1).select(F.lit(batch).cast("long").alias("batch"), F.lit(attempt).alias("attempt"), F.current_timestamp().alias("finished_at"))
    row.coalesce(1).write.mode("append").parquet(manifest)


def valid(spark: SparkSession, manifest: str) -> DataFrame:
    """batch, attempt: the attempt of each batch that finished last."""
    rows = spark.read.schema(MANIFEST).parquet(manifest)
    return rows.groupBy("batch").agg(F.max(F.struct("finished_at", "attempt"))["attempt"].alias("attempt"))


def stale(spark: SparkSession, tables: list[str], manifest: str) -> DataFrame:
    """batch, attempt, folder of the attempts that others replaced or that never finished, to be deleted once no reader holds them."""
    path = lambda t: F.concat(F.lit(f"{t}/batch="), F.col("batch").cast("string"), F.lit("/attempt="), F.col("attempt")).alias("folder")
    found = None
    for t in tables:
        own = spark.read.parquet(t).select("batch", "attempt", path(t)).distinct()
        found = own if found is None else found.unionByName(own)
    return found.join(valid(spark, manifest), ["batch", "attempt"], "left_anti")
