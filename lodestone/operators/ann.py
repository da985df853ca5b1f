"""Approximate nearest neighbours: vectors in cells around k-means centres, of which a query visits a few.

Only the centres and the number of visits are fitted on a sample (at most SAMPLE rows, in hash order);
every row is indexed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.vocabulary import TOP_K
from lodestone.operators.access import tag_mask
from lodestone.operators.retrieval import principals

SAMPLE, ROWS_PER_CELL, MAX_CELLS = 20_000, 40, 500
RECALL, PROBED, SPARE = 0.95, 256, 4
#: Vectors in a tile and in a block of queries; tiles under one join key.
TILE, QUERY_BLOCK, TILES_PER_KEY = 512, 128, 32


def _matrix(x: pa.Array) -> np.ndarray:
    """Rows of a list array as unit vectors; a zero vector stays zero."""
    m = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    return m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)


def fit_index(vectors: DataFrame, column: str, id_column: str, k: int = TOP_K, recall: float = RECALL, sample: int = SAMPLE, seed: int = 42) -> tuple[np.ndarray, int]:
    """Unit centres, one for every ROWS_PER_CELL sampled vectors and at most MAX_CELLS; and the cells to probe.

    The number of probes is the smallest at which PROBED sampled vectors find that share of their
    SPARE * k nearest ones in the sample: nearest ones of all rows are nearer, and the spare ones stand
    for those that permissions hide. Without vectors: one cell.
    """
    usable = vectors.where(F.exists(column, lambda x: x != 0)).select(id_column, column).orderBy(F.xxhash64(F.col(id_column)), id_column).limit(sample)
    usable = usable.select(F.col(column).cast("array<double>").alias("_v"), array_to_vector(F.col(column).cast("array<double>")).alias("features")).cache()
    try:
        # At most `sample` vectors.
        held = usable.select("_v").toArrow().column(0).combine_chunks()
        if len(held) == 0:
            return np.zeros((1, 1)), 1
        unit = _matrix(held)
        cells = max(1, min(MAX_CELLS, len(held) // ROWS_PER_CELL))
        if cells == 1:
            return unit[:1], 1
        centres = np.array(KMeans(k=cells, seed=seed, maxIter=15, distanceMeasure="cosine").fit(usable).clusterCenters())
        centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    finally:
        usable.unpersist()
    cell = np.argmax(unit @ centres.T, axis=1)
    asked = unit[:PROBED]
    near = np.argsort(-(asked @ unit.T), axis=1, kind="stable")[:, : SPARE * k]
    # Place of each nearest vector's cell in the order in which its query visits cells.
    place = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    visits = np.sort(np.take_along_axis(place, cell[near], 1).ravel())
    return centres, int(visits[int(np.ceil(recall * len(visits))) - 1]) + 1


def with_cells(rows: DataFrame, column: str, centres: np.ndarray, n: int = 1) -> DataFrame:
    """rows, once for each of the n nearest cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            # One cell holds all, whatever its centre (there may be no vector to know the dimension by).
            near = np.zeros((b.num_rows, 1), np.int64) if len(centres) == 1 else np.argsort(-(_matrix(b.column(column)) @ centres.T), axis=1, kind="stable")[:, :n]
            at = pa.array(np.repeat(np.arange(b.num_rows), near.shape[1]))
            yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(near.ravel().astype(np.int32))], [*b.schema.names, "cell"])

    return rows.mapInArrow(run, rows.withColumn("cell", F.lit(0)).schema)


def _packs(rows: DataFrame, id_column: str, size: int, key: str, fields: list[str]) -> DataFrame:
    """cell, pack number and the fields as arrays: a cell's rows dealt by hash to packs of about size rows."""
    counts = rows.groupBy("cell").agg(F.ceil(F.count("*") / size).alias("packs"))
    # One row a cell: at most MAX_CELLS.
    dealt = rows.join(F.broadcast(counts), "cell").withColumn(key, F.pmod(F.xxhash64(id_column), F.col("packs")))
    # One list of structs keeps the fields of a row together.
    packed = dealt.groupBy("cell", key, "packs").agg(F.collect_list(F.struct(*fields)).alias("_rows"))
    return packed.select("cell", key, "packs", *[F.col("_rows")[f].alias(f) for f in fields])


def vector_topk_ann(queries: DataFrame, chunks: DataFrame, centres: np.ndarray, n_probe: int, k: int = TOP_K) -> DataFrame:
    """query_id, chunk_id, dist, rank of the k nearest permitted chunks among the n_probe cells nearest each query.

    queries: query_id, query_vector, mask, clearance_level. Null vectors and chunks without tags are
    never found; equal distances go by chunk_id. Queries and chunks meet as packs of a cell, and what
    leaves a task is k rows a query and pack. Cells of many chunks are split over several join keys.
    """
    guarded = chunks.select("chunk_id", tag_mask(F.col("acl_tags")).alias("mask"), F.col("sensitivity_ordinal").cast("int").alias("ordinal"), F.col("dense_embedding").alias("vector")).where("mask <> 0 and vector is not null")
    tiles = _packs(with_cells(guarded, "vector", centres), "chunk_id", TILE, "tile", ["chunk_id", "mask", "ordinal", "vector"])
    asked = queries.where("query_vector is not null").select("query_id", "query_vector", F.col("mask").alias("q_mask"), F.col("clearance_level").cast("int").alias("clearance"))
    blocks = _packs(with_cells(asked, "query_vector", centres, n_probe), "query_id", QUERY_BLOCK, "block", ["query_id", "query_vector", "q_mask", "clearance"]).drop("packs")
    salts = F.ceil(F.col("packs") / TILES_PER_KEY)
    # One row a cell again.
    per_cell = tiles.groupBy("cell").agg(F.max(salts).alias("salts"))
    left = tiles.withColumn("salt", F.pmod("tile", salts)).drop("packs", "tile")
    right = blocks.join(F.broadcast(per_cell), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts", "block")
    pairs = left.join(right, ["cell", "salt"]).select("query_id", "query_vector", "q_mask", "clearance", "chunk_id", "mask", "ordinal", "vector")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in range(b.num_rows):
                q, qv, qm, qc, c, cm, co, cv = (b.column(i)[r].values for i in range(8))
                d = np.round(1 - _matrix(qv) @ _matrix(cv).T, 9)
                ids = c.to_numpy()
                allowed = (qm.to_numpy()[:, None] & cm.to_numpy()[None]) != 0
                d[~allowed | (co.to_numpy()[None] > qc.to_numpy()[:, None])] = np.inf
                order = np.lexsort((np.broadcast_to(ids, d.shape), d), axis=1)[:, :k]
                best = np.take_along_axis(d, order, 1)
                i, j = np.nonzero(np.isfinite(best))
                yield pa.RecordBatch.from_arrays([pa.array(q.to_numpy()[i]), pa.array(ids[order[i, j]]), pa.array(best[i, j])], ["query_id", "chunk_id", "dist"])

    found = pairs.mapInArrow(run, "query_id long, chunk_id long, dist double")
    w = Window.partitionBy("query_id").orderBy("dist", "chunk_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def neighbours_ann(queries: DataFrame, users: DataFrame, chunks: DataFrame, k: int = TOP_K) -> DataFrame:
    """vector_topk_ann with an index fitted on the chunks and the permissions of the queries' users."""
    centres, n_probe = fit_index(chunks.select("chunk_id", "dense_embedding"), "dense_embedding", "chunk_id", k)
    return vector_topk_ann(principals(queries, users), chunks, centres, n_probe, k)
