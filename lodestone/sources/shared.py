"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path under spark.checkpoint.dir; under a folder of this process where that is unset and the master local, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-lodestone-"))
        top = _own[0]
    return f"{top}/lodestone/{name}-{uuid.uuid4().hex}"


def at_rest(df: DataFrame, name: str) -> DataFrame:
    """df written to a new table of the shared folder and read back, so that it is computed once and a lost executor costs its readers only."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
