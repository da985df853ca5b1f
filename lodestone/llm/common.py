"""Shared-folder tables and fixed-size bitmaps used by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: One folder per test process where the cluster names none.
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where that is unset and the master local."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"set spark.checkpoint.dir to a folder that the driver and all executors of {master} share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="spark-lodestone-"))
    return _own[0]


#: Tables written in the scratch blocks that are open, by thread.
_open = threading.local()


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Writes df to a new table in the shared folder and returns it read back.

    Lineage ends there: a lost executor costs only the tasks that read the table. Inside a scratch
    block the table lasts until the block ends, else as long as the folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/lodestone/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    blocks = getattr(_open, "blocks", None)
    if blocks:
        blocks[-1].append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._table = path
    return out


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """A block whose tables (see cut) are deleted at its end, but for those given to the function it yields.

    What the block returns may read these only.
    """
    blocks = _open.__dict__.setdefault("blocks", [])
    made: list[str] = []
    kept: set[str] = set()
    blocks.append(made)

    def keep(table: DataFrame) -> DataFrame:
        kept.add(table._table)
        return table

    try:
        yield keep
    finally:
        blocks.pop()
        for path in made:
            if path in kept:
                if blocks:
                    blocks[-1].append(path)
                continue
            folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def names(taken: Iterable[str], *wanted: str) -> list[str]:
    """The wanted column names, each with as many underscores before it as it takes to be new (in either case)."""
    held, out = {t.lower() for t in taken}, []
    for n in wanted:
        while n.lower() in held:
            n = f"_{n}"
        held.add(n.lower())
        out.append(n)
    return out


def quoted(name: str) -> str:
    """The name as an expression reads it, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def column(name: str) -> Column:
    return F.col(quoted(name))


def columns(df: DataFrame, *without: str) -> list[Column]:
    """All columns of df but those named, in either case."""
    left_out = {n.lower() for n in without}
    return [column(c) for c in df.columns if c.lower() not in left_out]


def map_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list[pa.Array]]], fields: list[T.StructField]) -> DataFrame:
    """mapInArrow by position: run gives the arrays of fields for each batch. Columns may have any names."""
    short = [f"c{i}" for i in range(len(fields))]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for arrays in run(batches):
            yield pa.RecordBatch.from_arrays(arrays, short)

    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return plain.mapInArrow(named, T.StructType([T.StructField(s, f.dataType) for s, f in zip(short, fields)])).toDF(*[f.name for f in fields])


#: Sides of at most so many keys are broadcast whole; of larger ones only the keys of more than one row in HOT_ONE_IN, of which there are fewer than that.
BROADCAST_KEYS, HOT_ONE_IN = 10_000, 256


def join_keyed(rows: DataFrame, side: DataFrame, key: str, keys: int, total: int) -> DataFrame:
    """Inner join of rows and side on key (one column, never null in side). _n of side is the number of rows with its key.

    keys and total are the numbers of side's keys and of rows. A key that holds a large part of the rows
    is never one task's: its side is broadcast, and the other keys meet by a shuffle.
    """
    if keys <= BROADCAST_KEYS:
        return rows.join(F.broadcast(side.drop("_n")), key)
    hot = side.where(F.col("_n") * HOT_ONE_IN > total).drop("_n")
    cold = side.where(F.col("_n") * HOT_ONE_IN <= total).drop("_n")
    rest = rows.join(F.broadcast(hot.select(key).distinct()), key, "left_anti")
    return rows.join(F.broadcast(hot), key).unionByName(rest.join(cold, key))


def id_remainder(doc_id: Column, n: int = 4) -> Column:
    """crc32 of the id as text, mod n: the split of labelled rows. A null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def bitmap(hashes: DataFrame, column: str, log2_bits: int = 24) -> np.ndarray:
    """Bloom bitmap of 2**log2_bits bits over a long column, two probes a value.

    Executors or the bits together by 64-bit word, so the driver gets at most 2**(log2_bits - 6)
    words however many hashes there are. A full bitmap only stops saving work: what it lets through
    goes to an exact join, and nothing else is decided by it.
    """
    mask = (1 << log2_bits) - 1
    bits = hashes.select(F.explode(F.array(F.col(column).bitwiseAND(F.lit(mask)), F.shiftrightunsigned(column, 64 - log2_bits).cast("long"))).alias("b"))
    words = bits.groupBy(F.shiftright("b", 6).alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b & 63 as int)))").alias("v")).toArrow()
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    out[words["w"].to_numpy()] = words["v"].to_numpy().view(np.uint64)
    return out


def in_bitmap(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Boolean array: the hashes (uint64) that may be in the bitmap."""
    log2_bits = int(len(bits)).bit_length() + 5
    low, high = hashes & np.uint64((1 << log2_bits) - 1), hashes >> np.uint64(64 - log2_bits)
    one, six, rest = np.uint64(1), np.uint64(6), np.uint64(63)
    found = (bits[low >> six] >> (low & rest)) & one
    return (found & (bits[high >> six] >> (high & rest)) & one).astype(bool)
