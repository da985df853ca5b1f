"""SimHash near-duplicates by tiled exact comparison.

A fingerprint holds, for each of 64 bits, whether more than half of the document's shingle hashes
have it set. Fingerprints within 2 bits are linked. Two such fingerprints agree on at least two
of four 16-bit blocks, so all links are found among the fingerprints that share a pair of blocks;
each such bucket is sorted by population count and compared tile by tile with numpy exclusive-or
and bit counts, skipping tile pairs whose population counts differ beyond the radius. Buckets
above TILE rows are dealt out as pairs of hashed parts, so that no task holds a whole bucket.
Only spanning edges leave a comparison, so results stay linear in the number of fingerprints.

Cases: null, empty and blank texts have fingerprint zero and are linked like others; fewer than
three words give one shingle; a repeated word or row changes nothing; rows with null ids get a
component by their fingerprint, null only if no row of the component has an id; ids of any type with an order; an empty table gives an empty
result; other columns are ignored, or pass untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import columns, cut, join_keyed, names, scratch
from lodestone.llm.components import components
from lodestone.llm.text import binary

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Rows of a hashed part of a bucket, and of a numpy tile.
TILE = 1024
BLOCK = 256


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint, unsigned, of one UTF-8 text."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - SHINGLE + 1
    if n < 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    starts = (ends - lengths)[:n].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, (ends[SHINGLE - 1 :] - 1).tolist())), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 14):
        counts += np.unpackbits(h[at : at + (1 << 14)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp) of every document: h hashes the text, fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.fromiter((fingerprint(t.as_py()) for t in binary(batch.column("text"))), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(fp.view(np.int64))], ["doc_id", "h", "fp"])

    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, h long, fp long")


def tile_links(fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within radius among unsigned fingerprints sorted by population count."""
    ones = np.bitwise_count(fp)
    left, right = [], []
    for i in range(0, len(fp), BLOCK):
        a = fp[i : i + BLOCK]
        highest = int(ones[i + len(a) - 1])
        for j in range(i, len(fp), BLOCK):
            if int(ones[j]) - highest > radius:
                break  # sorted: every later tile differs beyond the radius too
            x, y = np.nonzero(np.bitwise_count(a[:, None] ^ fp[None, j : j + BLOCK]) <= radius)
            keep = x + i < y + j
            left.append(x[keep] + i)
            right.append(y[keep] + j)
    empty = np.zeros(0, np.int64)
    return np.concatenate(left or [empty]), np.concatenate(right or [empty])


def spanning(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The least index reachable from each of n indexes."""
    root = np.arange(n)
    while True:
        a, b = root[left], root[right]
        low = np.minimum(a, b)
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            return root
        root = new


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(fp) distinct fingerprints to (a, b) spanning edges of the links within radius (2 at most)."""
    if radius > 2:
        raise ValueError("four blocks find links within two bits")
    keys = [F.shiftleft(F.lit(code).cast("long"), 32).bitwiseOR(F.shiftleft(block(i), 16)).bitwiseOR(block(j)) for code, (i, j) in enumerate([(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)])]
    member = cut(nodes.select("fp", F.explode(F.array(*keys)).alias("key")), "blocks")
    shared = member.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    dealt = member.join(shared, "key").withColumn("parts", F.ceil(F.col("n") / TILE).cast("int"))
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    dealt = dealt.select("key", F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), F.bit_count("fp").alias("ones"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def compare(rows: np.ndarray) -> pa.RecordBatch:
            out_a, out_b = [], []
            seams = np.flatnonzero((rows[1:, :3] != rows[:-1, :3]).any(axis=1)) + 1
            for lo, hi in zip([0, *seams.tolist()], [*seams.tolist(), len(rows)]):
                if hi - lo > 1:
                    fp = rows[lo:hi, 4]
                    root = spanning(hi - lo, *tile_links(fp.view(np.uint64), radius))
                    moved = np.flatnonzero(root != np.arange(hi - lo))
                    out_a.append(fp[moved])
                    out_b.append(fp[root[moved]])
            join = lambda x: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64))
            return pa.RecordBatch.from_arrays([join(out_a), join(out_b)], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.column_stack([batch.column(c).cast(pa.int64()).to_numpy() for c in ("key", "p", "q", "ones", "fp")])
            # The last group may go on in the next batch; a group has at most some 2 * TILE rows.
            last = np.flatnonzero((rows[:, :3] != rows[-1, :3]).any(axis=1))
            at = int(last[-1]) + 1 if len(last) else 0
            if at:
                yield compare(np.concatenate([*held, rows[:at]]))
                held = []
            held.append(rows[at:].copy())
        if held:
            yield compare(np.concatenate(held))

    return dealt.repartition("key", "p", "q").sortWithinPartitions("key", "p", "q", "ones").mapInArrow(run, "a long, b long")


def block(i: int):
    """16-bit block i of fp."""
    return F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """doc_id, h, fingerprint (16 hex digits), component_id and stays of every document.

    stays marks the row of its component with the smallest id (null last), then the smallest h;
    repeated rows share that mark.
    """
    with scratch(docs.sparkSession) as keep:
        prints = keep(cut(fingerprints(docs), "fingerprints"))
        nodes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("least_id"), F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")).alias("first"), F.count("*").alias("_n")), "nodes")
        roots = cut(components(links(nodes, radius)), "roots")
        rooted = cut(nodes.join(roots, nodes.fp == roots.node, "left").select("fp", "least_id", "first", "_n", F.coalesce("root", "fp").alias("root")), "rooted")
        best = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"), F.min("first").alias("first"))
        label = keep(cut(rooted.drop("least_id", "first").join(best, "root").select("fp", "component_id", "first", "_n"), "labels"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("h") == F.col("first.h"))
    # Many rows may share a fingerprint: all empty texts do.
    labelled = join_keyed(prints, label, "fp", label.count(), prints.count())
    return labelled.select("doc_id", "h", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", stays.alias("stays"))


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents without near copies: of each component one row stays, with all its columns.

    Rows with the same id and text are one document: one of them stays, all columns from one row.
    """
    judged = cut(near_duplicates(docs.select("doc_id", "text"), radius), "judged")
    h, g_id, g_h, row = names(docs.columns, "h", "of_id", "of_h", "row")
    mark = lambda rows: rows.select(F.col("doc_id").alias(g_id), F.col("h").alias(g_h))
    gone = mark(judged.where("not stays")).distinct()
    keyed = docs.withColumn(h, F.xxhash64("text"))
    same = lambda a, b: a["doc_id"].eqNullSafe(b[g_id]) & (a[h] == b[g_h])
    left = keyed.join(gone, same(keyed, gone), "left_anti")
    repeated = cut(mark(judged.where("stays").groupBy("doc_id", "h").agg(F.count("*").alias("n")).where("n > 1")), "repeated")
    if repeated.isEmpty():
        return left.select(*columns(docs))
    one = left.join(repeated, same(left, repeated), "left_semi").groupBy("doc_id", h).agg(F.first(F.struct(*columns(docs))).alias(row)).select(f"{row}.*")
    return left.join(repeated, same(left, repeated), "left_anti").select(*columns(docs)).unionByName(one)
