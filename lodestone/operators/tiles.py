"""Rows of two tables that meet by a key, tile by tile, so that a task's work is a tile whatever the key holds."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows in a tile, and tiles of the left table under one join key.
TILE, PER_KEY = 512, 16


def _packed(rows: DataFrame, key: str, id_column: str, fields: list[str], name: str) -> DataFrame:
    n = rows.groupBy(F.col(key).alias("_key")).agg(F.ceil(F.count("*") / TILE).alias("_packs"))
    dealt = rows.join(n, rows[key] == n["_key"]).withColumn("_pack", F.pmod(F.xxhash64(id_column), F.col("_packs")))
    return dealt.groupBy(key, "_pack", "_packs").agg(F.collect_list(F.struct(*fields)).alias(name))


def meet(left: DataFrame, right: DataFrame, key: str, ids: tuple[str, str], fields: tuple[list[str], list[str]], kernel: Callable, schema: str) -> DataFrame:
    """kernel(left tile, right tile) for the tiles of equal key; a tile is a struct array of the fields, the result a record batch of schema."""
    a, b = _packed(left, key, ids[0], fields[0], "_left"), _packed(right, key, ids[1], fields[1], "_right").drop("_pack", "_packs")
    salts = F.ceil(F.col("_packs") / PER_KEY)
    a = a.withColumn("_salt", F.pmod("_pack", salts))
    number = a.groupBy(key).agg(F.max(salts).alias("_salts"))
    b = b.join(number, key).withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_salts") - 1)))
    pairs = a.join(b, [key, "_salt"]).select("_left", "_right")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                yield kernel(batch.column(0)[row].values, batch.column(1)[row].values)

    return pairs.mapInArrow(run, schema)


def unit_vectors(x: pa.Array) -> np.ndarray:
    """Rows of a list array as unit vectors."""
    m = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True)
