"""Alignment of two tokenizers over a corpus by lockstep vectorised merging.

A text is encoded by both tokenizers; byte offsets where tokens of both end cut it into groups, and
tokens of which the byte ranges overlap are linked. One numpy state vector holds a pointer into the A
tokens and one into the B tokens for every document of a batch. Each step emits the link under the
pointers, advances the side whose token ends first (both where they end together, which is a cut) and
drops the documents that are finished. A document of more than LANE A tokens has several places in the
vector, each of which begins at an A token with the B token above the same byte, so one long
document doesn't leave the vector with a single place.

Links are counted corpus-wide by id pair: tasks sum their own before the shuffle. Pairs of more than one
link in HOT_ONE_IN, of which there are fewer than that, go to all tasks with their counts; links of the
others meet the counts in a join, where no key is hot.

Cases: null and empty texts, and texts that a tokenizer doesn't give back byte by byte, have no tokens:
zeros and an empty digest. Blank texts have tokens. Repeated rows and ids are aligned each by itself
and count each; null ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut, map_batches, scratch
from lodestone.llm.text import slices
from lodestone.llm.tokens import PairTokenizer, pair_tokenizer, public

#: A tokens of one place in the state vector.
LANE = 256
#: Bytes of text that are merged at once (a longer text comes alone).
SLICE = 1 << 21
#: Pairs of more than one link in so many are sent to all tasks: 16 bytes each, 4 MB at most.
HOT_ONE_IN = 1 << 18
#: Distinct pairs that a task holds before it hands them on.
_HELD = 1 << 21


def with_blank(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows with a blank before each."""
    rows = len(offsets) - 1
    out = np.full(len(data) + rows, 32, np.uint8)
    new = offsets + np.arange(rows + 1)
    keep = np.ones(len(out), bool)
    keep[new[:-1]] = False
    out[keep] = data
    return out, new


def lockstep(ends_a: np.ndarray, ends_b: np.ndarray, first: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, cuts_a, cuts_b): the links as token numbers, and which tokens end at a cut.

    ends are byte offsets; first[d] is the first A token of document d, offsets[d] its first byte (length documents + 1). Tokens
    of a document cover the same bytes on both sides.
    """
    counts = np.diff(first)
    lanes = -(-counts // LANE)
    inner = np.arange(int(lanes.sum())) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    a = np.repeat(first[:-1], lanes) + inner * LANE
    stop = np.minimum(a + LANE, np.repeat(first[1:], lanes))
    # Each place begins with the B token above the first byte of its A token.
    b = np.searchsorted(ends_b, np.where(inner > 0, ends_a[a - 1], np.repeat(offsets[:-1], lanes)), "right")
    # Token numbers fit in 32 bits: a slice has no more tokens than bytes.
    a, b = a.astype(np.int32), b.astype(np.int32)
    cuts_a, cuts_b = np.zeros(len(ends_a), bool), np.zeros(len(ends_b), bool)
    links_a, links_b = [a[:0]], [b[:0]]
    while len(a):
        links_a.append(a)
        links_b.append(b)
        at_a, at_b = ends_a[a], ends_b[b]
        both = at_a == at_b
        cuts_a[a[both]] = True
        cuts_b[b[both]] = True
        a = a + (at_a <= at_b)
        b = b + (at_b <= at_a)
        going = a < stop
        if not going.all():
            a, b, stop = a[going], b[going], stop[going]
    return np.concatenate(links_a), np.concatenate(links_b), cuts_a, cuts_b


def _labels(ids: int, marks: str) -> pa.Array:
    """The decimal ids with each mark behind them, mark after mark."""
    return pa.array([f"{i}{m}" for m in marks for i in range(ids)], pa.large_string()).cast(pa.large_binary())


def groups(ids_a: np.ndarray, ids_b: np.ndarray, cuts_a: np.ndarray, cuts_b: np.ndarray, first_a: np.ndarray, labels: tuple[pa.Array, pa.Array], sizes: tuple[int, int]) -> list[bytes]:
    """`a1,a2|b1;a3|b2,b3` of each document."""
    through_a, through_b = np.cumsum(cuts_a), np.cumsum(cuts_b)
    # Before an A token stand its own side's earlier tokens and the B tokens of the groups before its own.
    b_by_group = np.concatenate([[0], np.flatnonzero(cuts_b) + 1])
    a_by_group = np.concatenate([[0], np.flatnonzero(cuts_a) + 1])
    place_a = np.arange(len(ids_a)) + b_by_group[through_a - cuts_a]
    place_b = np.arange(len(ids_b)) + a_by_group[through_b - cuts_b + 1]
    label = np.empty(len(ids_a) + len(ids_b), np.int64)
    label[place_a] = ids_a + sizes[0] * cuts_a
    label[place_b] = ids_b + sizes[1] * cuts_b + len(labels[0])
    text = pc.take(pa.concat_arrays(labels), pa.array(label))
    offsets = np.frombuffer(text.buffers()[1], np.int64)[: len(text) + 1]
    data = memoryview(text.buffers()[2] or b"")
    ends = first_a + b_by_group[np.concatenate([[0], through_a])[first_a]]
    return [bytes(data[offsets[x] : offsets[y] - 1]) if y > x else b"" for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]


class _Merged:
    """One slice of documents, encoded and merged."""

    def __init__(self, tokenizer: PairTokenizer, data: np.ndarray, offsets: np.ndarray):
        data, offsets = with_blank(data, offsets)
        self.ids_a, ends_a, self.ids_b, ends_b, self.good = tokenizer(data, offsets)
        self.first_a, self.first_b = (np.searchsorted(e, offsets, "right") for e in (ends_a, ends_b))
        a, b, self.cuts_a, self.cuts_b = lockstep(ends_a, ends_b, self.first_a, offsets)
        bits_a, bits_b = (int(max(1, x.max(initial=0))).bit_length() for x in (self.ids_a, self.ids_b))
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first_a))[a]
        # Sorted by row and pair, so that equal ones stand together.
        keys = np.sort(row << (bits_a + bits_b) | self.ids_a[a] << bits_b | self.ids_b[b])
        self.starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        #: Of each row's distinct linked pairs: row, pair and number of links.
        once = keys[self.starts]
        self.times = np.diff(np.append(self.starts, len(keys)))
        self.row = once >> (bits_a + bits_b)
        self.pairs = ((once >> bits_b) & ((1 << bits_a) - 1)) << 32 | once & ((1 << bits_b) - 1)


def merged(docs: DataFrame, path_a: str, path_b: str, digest: bool) -> DataFrame:
    """doc_id, row (a number of its own), n_a, n_b, n_groups, n_links, groups, pairs, times of every row: its distinct linked pairs and their links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        from pyspark import TaskContext

        tokenizer = pair_tokenizer(path_a, path_b)
        sizes = len(tokenizer.bytes_a), len(tokenizer.bytes_b)
        labels = _labels(sizes[0], ",|"), _labels(sizes[1], ",;")
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for row, data, offsets in slices(batch.column(1), SLICE):
                m = _Merged(tokenizer, data, offsets)
                rows = len(offsets) - 1
                cuts = np.concatenate([[0], np.cumsum(m.cuts_a)])
                texts = groups(m.ids_a, m.ids_b, m.cuts_a, m.cuts_b, m.first_a, labels, sizes)
                links = np.bincount(m.row, m.times, rows).astype(np.int64)
                shown = [hashlib.sha256(t).hexdigest() if t else "" for t in texts] if digest else [t.decode() for t in texts]
                lists = pa.array(np.searchsorted(m.row, np.arange(rows + 1)).astype(np.int32))
                columns = (np.diff(m.first_a), np.diff(m.first_b), np.diff(cuts[m.first_a]), links)
                yield [batch.column(0).slice(row, rows), pa.array(number + np.arange(rows)), *[pa.array(c, pa.int64()) for c in columns], pa.array(shown, pa.string()), pa.ListArray.from_arrays(lists, pa.array(m.pairs)), pa.ListArray.from_arrays(lists, pa.array(m.times.astype(np.int32)))]
                number += rows

    long = T.LongType()
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, long) for c in ("row", "n_a", "n_b", "n_groups", "n_links")], T.StructField("groups", T.StringType()), T.StructField("pairs", T.ArrayType(long)), T.StructField("times", T.ArrayType(T.IntegerType()))]
    return map_batches(docs.select("doc_id", "text"), run, fields)


def token_links(rows: DataFrame) -> DataFrame:
    """pair (A id << 32 | B id), a_id, b_id, n, best of every linked id pair of merged rows: n links, and whether no A id has more links with this B id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        pairs, counts, held, n = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def summed(last: bool) -> Iterator[list[pa.Array]]:
            nonlocal pairs, counts, held, n
            pairs, place = np.unique(np.concatenate([pairs, *[k for k, _ in held]]), return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, *[t for _, t in held]]), len(pairs)).astype(np.int64)
            held, n = [], 0
            if last or len(pairs) > _HELD:
                yield [pa.array(pairs), pa.array(counts)]
                pairs, counts = pairs[:0], counts[:0]

        for batch in batches:
            held.append((batch.column(0).flatten().to_numpy(), batch.column(1).flatten().to_numpy()))
            n += len(held[-1][0])
            if n > _HELD:
                yield from summed(False)
        yield from summed(True)

    each = map_batches(rows.select("pairs", "times"), run, [T.StructField("pair", T.LongType()), T.StructField("k", T.LongType())])
    n = cut(each.groupBy("pair").agg(F.sum("k").alias("n")).withColumn("b_id", F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")), "counts")
    # One row for each id of the B vocabulary.
    most = n.groupBy("b_id").agg(F.max("n").alias("most"))
    joined = n.join(F.broadcast(most), "b_id")
    return joined.select("pair", F.shiftright("pair", 32).cast("int").alias("a_id"), "b_id", "n", (F.col("n") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str | None = None, path_b: str | None = None, digest: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, links). documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups of every row; links: see token_links.

    groups is the text `a1,a2|b1;a3|b2,b3`, with digest its SHA-256 in lowercase hex. n_best counts the links whose pair is
    best for its B id, count_sum sums the pairs' corpus-wide counts over the row's links.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        # Rows are numbered as they are written; repeated ids stay apart by that number.
        rows = cut(merged(docs, path_a or public("byte_bpe_50k.json"), path_b or public("piece_bpe_32k.model"), digest), "merged")
        links = keep(cut(token_links(rows), "links"))
        total = links.agg(F.sum("n")).first()[0] or 0
        hot = links.where(F.col("n") * F.lit(HOT_ONE_IN) > F.lit(total)).orderBy("pair").toArrow()
        known = spark.sparkContext.broadcast(tuple(hot[c].to_numpy() for c in ("pair", "n", "best")))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
            pairs, counts, best = known.value
            for batch in batches:
                n = batch.num_rows
                lists, times = batch.column(7), batch.column(8).flatten().to_numpy().astype(np.int64)
                flat, row = lists.flatten().to_numpy(), np.repeat(np.arange(n), pc.list_value_length(lists).to_numpy())
                at = np.minimum(np.searchsorted(pairs, flat), max(0, len(pairs) - 1))
                is_hot = pairs[at] == flat if len(pairs) else np.zeros(len(flat), bool)
                at = at[is_hot]
                k, of = times[is_hot], row[is_hot]
                sums = np.zeros(n, np.int64)
                np.add.at(sums, of, k * counts[at])
                n_best = np.bincount(of, k * best[at], n).astype(np.int64)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row[~is_hot], minlength=n))]).astype(np.int32)
                rare = pa.StructArray.from_arrays([pa.array(flat[~is_hot]), pa.array(times[~is_hot])], ["pair", "k"])
                yield [*batch.columns[:7], pa.array(n_best), pa.array(sums), pa.ListArray.from_arrays(pa.array(ends), rare)]

        long = T.LongType()
        rare = T.ArrayType(T.StructType([T.StructField("pair", long), T.StructField("k", long)]))
        counted = keep(cut(map_batches(rows, run, [*rows.schema.fields[:7], T.StructField("n_best", long), T.StructField("count_sum", long), T.StructField("rare", rare)]), "counted"))
    rest = counted.select("row", F.explode("rare").alias("r")).select("row", "r.pair", "r.k").join(links.select("pair", "n", "best"), "pair")
    more = rest.groupBy("row").agg(F.sum(F.col("k") * F.col("n")).alias("_sum"), F.sum(F.when(F.col("best"), F.col("k")).otherwise(0)).alias("_best"))
    added = lambda c, extra: (F.col(c) + F.coalesce(extra, F.lit(0))).alias(c)
    documents = counted.drop("rare").join(more, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", added("n_best", "_best"), added("count_sum", "_sum"), "groups")
    return documents, links
