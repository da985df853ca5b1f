"""Line dedup with content-defined chunks.

A text is read as lines: pieces ended by a newline, and inside a line by a sentence end before a
blank, so that a long paragraph is several lines. A rolling hash over the hashes of the last two
lines places a chunk boundary where it is zero mod DIVISOR, once the chunk has two lines, and after
MAX_LINES lines at the latest; boundaries
therefore depend on nearby lines only and come back after an insertion. Chunks of two or more
lines whose hash occurs more than once in the corpus are compared byte by byte with the first
occurrence (smallest id, then text hash, then place), which stays; the others are removed. A
removal is extended on both sides into the neighbouring chunks, repeated or not, for as long as
whole lines equal those beside the first occurrence (by length and 128-bit digest).

Every removed line equals a line at an earlier place, so of each repeated passage one copy stays.

Passages that no chunk lies in are found by words: every run of LEAST_WORDS words (with the blanks
between them) that stands in an earlier document too is removed, wherever it begins. Runs meet by
their least hash of GRAM successive words (winnowing), which equal runs share whatever stands around them,
and are then compared by 128-bit digests of their bytes. Overlapping runs are joined; a part of a
line at an end stays if it has fewer than LEAST_WORDS words and as many are left without it.
Repetition inside one document is left to the chunks.

A text is read five times: for the hashes of its chunks and runs, for the places of the repeated ones, twice for
single runs of those that differ where they begin or end (their hashes, then the places of the repeated ones; other texts are passed over), and to be cut. Bitmaps of hashes keep the rest
out of the joins and decide nothing. Hashes are counted as packed arrays, without a row for each.

Cases: null texts stay null; texts of one line or without words are unchanged but for repeated runs; rows with the same
id and text are one document and get the same text; ids of any type; a row whose id is null is ordered last; an empty table gives an empty result;
other columns pass untouched, whatever their names, n_chars (if there) is set to the new length where lines went.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import bitmap, column, columns, cut, in_bitmap, map_batches, names, scratch
from lodestone.llm.statistics import repeats
from lodestone.llm.text import SPACE, Hasher, SecondHasher, mix, row_of
from lodestone.llm.text import slices as _slices

DIVISOR = 3
MAX_LINES = 16
#: A run of so many words is found wherever it begins; it is held to others by its least hash of GRAM words.
LEAST_WORDS, GRAM = 50, 20
#: Texts are taken in slices of so many bytes, whose hash tables (8 bytes for each) stay in a core's cache.
SLICE = 1 << 18
#: Hashes that a task holds before it packs them.
PACK = 1 << 20
_U = np.uint64
_NONE = np.zeros(0, np.int64)
#: What is kept of a line beside a chunk: both hashes and the length.
_LINE = np.dtype([("h1", "<u8"), ("h2", "<u8"), ("n", "<i4")])


def slices(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    return _slices(column, SLICE)


def line_ends(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sorted end positions of all lines; every row end is one."""
    n = len(data)
    cut_after = np.zeros(n + 1, bool)
    if n:
        np.equal(data, 10, out=cut_after[1:])
        stop = np.flatnonzero((data[:-1] == 33) | (data[:-1] == 46) | (data[:-1] == 63))  # ! . ?
        after = data[stop + 1]
        stop = stop[SPACE[after] & (after != 10)]
        # A row's last stop has no blank; the blank belongs to the line it ends.
        seam = np.zeros(n + 1, bool)
        seam[offsets] = True
        cut_after[stop[~seam[stop + 1]] + 2] = True
    cut_after[offsets] = True
    cut_after[0] = False
    return np.flatnonzero(cut_after)


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words [^\\x20\\x09-\\x0D]+ and the number of the first word of each row, by comparisons and not by a table."""
    n = len(data)
    core = np.zeros(n + 2, bool)
    core[1:-1] = ((data - np.uint8(9)) > 4) & (data != 32)
    step = core[1:] != core[:-1]
    # Where two rows meet inside words, one ends and one begins.
    seams = offsets[1:-1]
    both = np.unique(seams[(seams > 0) & (seams < n)])
    both = both[core[both] & core[both + 1]]
    edges = np.flatnonzero(step)
    if len(both):
        edges = np.sort(np.concatenate([edges, both, both]))
    starts = edges[::2]
    return starts, edges[1::2], np.searchsorted(starts, offsets)


class Chunks:
    """Chunks of all rows: row, the index of the first and of the line after the last, begin, end and hash. Line n is starts[n] to ends[n]."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher | None = None, word: np.ndarray | None = None):
        self.ends = line_ends(data, offsets)
        self.starts = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)[: len(self.ends)]
        row = np.searchsorted(offsets, self.starts, "right") - 1
        hasher = hasher or Hasher(data)
        h = self.lines = hasher(self.starts, self.ends)
        rolling = mix(h + _U(3) * np.concatenate([[_U(0)], h[:-1]]).astype(_U)) if len(h) else h
        stop = np.concatenate([row[1:] != row[:-1], [True]])[: len(row)]
        last, begin = [], 0
        for n, final in zip((at := np.flatnonzero(stop | (rolling % _U(DIVISOR) == 0))).tolist(), stop[at].tolist()):
            while n - begin >= MAX_LINES:
                begin += MAX_LINES
                last.append(begin)
            if final or n > begin:
                begin = n + 1
                last.append(begin)
        self.to = np.array(last, np.int64)
        self.first = np.concatenate([[0], self.to[:-1]]).astype(np.int64)[: len(self.to)]
        self.row = row[self.first]
        self.begin, self.end = self.starts[self.first], self.ends[self.to - 1]
        self.hash = hasher(self.begin, self.end)
        # No word begins before a chunk and ends in it.
        word = words(data, offsets)[0] if word is None else word
        self.counts = (self.to - self.first > 1) & (np.searchsorted(word, self.end) > np.searchsorted(word, self.begin))

    def sides(self, at: np.ndarray, step: int, second: SecondHasher) -> pa.Array:
        """For each chunk, the lines (_LINE) of the chunk before (step -1) or after (1) in its row, nearest first, as bytes."""
        side = np.clip(at + step, 0, len(self.row) - 1)
        number = np.where((side != at) & (self.row[side] == self.row[at]), (self.to - self.first)[side], 0)
        line = _ranges(np.where(step > 0, self.first[side], self.to[side] - 1), number, step)
        out = np.empty(len(line), _LINE)
        out["h1"], out["h2"], out["n"] = self.lines[line], second(self.starts[line], self.ends[line]), self.ends[line] - self.starts[line]
        return _packed(out, np.concatenate([[0], np.cumsum(number)]))


def _packed(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The values between successive offsets as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer((offsets * values.itemsize).astype(np.int32)), pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a column of _packed."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]].view(dtype), (offsets - offsets[0]) // np.dtype(dtype).itemsize


def _ranges(first: np.ndarray, number: np.ndarray, step: int = 1) -> np.ndarray:
    """first, first + step, ... of each range, number of them, one range after the other."""
    begin = np.cumsum(number) - number
    return np.repeat(first, number) + step * (np.arange(int(number.sum())) - np.repeat(begin, number))


class Runs:
    """Successive word runs of LEAST_WORDS words that share their least gram hash, as one: anchor (of that hash), row, begin and end.

    at and number say which of them: words at, at + 1, ... begin one. single gives their places.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, hasher: Hasher | None = None, found: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None):
        self.starts, self.ends, first = found or words(data, offsets)
        n = len(self.starts) - LEAST_WORDS + 1
        if n < 1:
            self.anchor, self.row, self.begin, self.end, self.at, self.number = np.zeros(0, _U), *[_NONE] * 5
            return
        least, size, width = (hasher or Hasher(data))(self.starts[: len(self.starts) - GRAM + 1], self.ends[GRAM - 1 :]), 1, LEAST_WORDS - GRAM + 1
        while size < width:
            step = min(size, width - size)
            least = np.minimum(least[:-step], least[step:])
            size += step
        row = row_of(first)
        inside = row[:n] == row[LEAST_WORDS - 1 :]
        seam = np.ones(n + 1, bool)
        seam[1:-1] = (least[1:] != least[:-1]) | (row[1:n] != row[: n - 1])
        padded = np.concatenate([[False], inside, [False]])
        self.at = np.flatnonzero(inside & (seam[:-1] | ~padded[:-2]))
        end = np.flatnonzero(inside & (seam[1:] | ~padded[2:]))
        # Least hashes are small; scrambled they fill a bitmap evenly.
        self.anchor, self.row, self.number = mix(least[self.at]), row[self.at], end - self.at + 1
        self.begin, self.end = self.starts[self.at], self.ends[end + LEAST_WORDS - 1]

    def single(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(run, begin, end) of each LEAST_WORDS words inside the chosen runs."""
        word = _ranges(self.at[chosen], self.number[chosen])
        return np.repeat(chosen, self.number[chosen]), self.starts[word], self.ends[word + LEAST_WORDS - 1]


def _scan(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), r (of id and text) and text of the documents with a text."""
    return docs.select("doc_id", F.xxhash64("text").alias("h"), "text").where("text is not null").select("doc_id", "h", F.xxhash64("doc_id", "h").alias("r"), "text")


def _at_most_twice(h: np.ndarray) -> np.ndarray:
    """The values in order, those that occur more than twice twice."""
    h = np.sort(h)
    keep = np.ones(len(h), bool)
    keep[2:] = h[2:] != h[:-2]
    return h[keep]


def repeated(docs: DataFrame, gather: Callable[[Iterator[pa.RecordBatch]], Iterator[tuple[np.ndarray, ...]]]) -> DataFrame:
    """(kind, hash) of the hashes that gather gives more than once over all batches of docs. It gives an array for each kind, again and again.

    Hashes meet as arrays by their upper bits, of each task a value twice at most for PACK of them, so that a frequent one is no task's load.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(256, parts)

    def pack(kind: int, held: list[np.ndarray]) -> pa.RecordBatch:
        h = _at_most_twice(np.concatenate(held))
        # In order of the hashes; 32 upper bits times the number of buckets stay below 2**64.
        at = np.searchsorted(((h >> _U(32)) * _U(buckets)) >> _U(32), np.arange(buckets + 1).astype(_U))
        full = np.flatnonzero(np.diff(at))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(full), kind, np.int32)), pa.array(full.astype(np.int32)), _packed(h, at).take(pa.array(full))], ["kind", "bucket", "hashes"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        size: dict[int, int] = {}
        for arrays in gather(batches):
            for kind, h in enumerate(arrays):
                held.setdefault(kind, []).append(h)
                size[kind] = size.get(kind, 0) + len(h)
                if size[kind] >= PACK:
                    yield pack(kind, held.pop(kind))
                    size[kind] = 0
        for kind, h in held.items():
            yield pack(kind, h)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for kind in np.unique(kinds).tolist():
                held.setdefault(kind, []).append(_unpacked(batch.column("hashes").filter(pa.array(kinds == kind)), _U)[0].copy())
        for kind, h in held.items():
            h = np.sort(np.concatenate(h))
            again = h[1:] == h[:-1]
            h = h[1:][again & ~np.concatenate([[False], again[:-1]])[: len(again)]]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64))], ["kind", "hash"])

    return docs.mapInArrow(run, "kind int, bucket int, hashes binary").repartition(parts, "bucket").mapInArrow(meet, "kind int, hash long")


def _once_a_row(h: np.ndarray, row: np.ndarray) -> np.ndarray:
    """The hashes, each once for a row."""
    return h[np.unique(mix(h + row.astype(_U) * _U(0xC2B2AE3D27D4EB4F)), return_index=True)[1]]


def repeated_hashes(docs: DataFrame) -> DataFrame:
    """(kind, hash): chunks (kind 0) of two or more lines with a word that occur more than once, and anchors of word runs (kind 1) of more than one document."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for batch in batches:
            for _, data, offsets in slices(batch.column("text")):
                hasher, found = Hasher(data), words(data, offsets)
                c, r = Chunks(data, offsets, hasher, found[0]), Runs(data, offsets, hasher, found)
                yield c.hash[c.counts], _once_a_row(r.anchor, r.row)

    return repeated(docs.select("text").where("text is not null"), gather)


_FOUND = [("kind", "int"), ("hash", "long"), ("k1", "long"), ("k2", "long"), ("h", "long"), ("begin", "long"), ("end", "long"), ("place", "long"), ("again", "boolean"), ("body", "binary"), ("before", "binary"), ("after", "binary")]


def _kind(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def _place(r: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """A hash of a document and a byte of it."""
    return mix(r + begin.astype(_U) * _U(0x9FB21C651E98DF25))


def repeated_places(docs: DataFrame, chunk_bits, run_bits) -> DataFrame:
    """The places of the chunks and runs whose hash may be repeated: doc_id and the columns of _FOUND.

    A chunk has its bytes, the lines of the chunks before and after, and whether one with its hash (again)
    stands earlier in its document; if that one's bytes are equal, they aren't given again. A run has its digest (k1, k2) and a hash of its place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_chunks, of_runs = chunk_bits.value, run_bits.value
        for batch in batches:
            ids, h = batch.column("doc_id"), batch.column("h")
            doc = batch.column("r").to_numpy().view(_U)
            for first, data, offsets in slices(batch.column("text")):
                hasher, found = Hasher(data), words(data, offsets)
                c, r = Chunks(data, offsets, hasher, found[0]), Runs(data, offsets, hasher, found)
                at, to = np.flatnonzero(c.counts & in_bitmap(of_chunks, c.hash)), np.flatnonzero(in_bitmap(of_runs, r.anchor))
                n, m = len(at), len(to)
                if not n and not m:
                    continue
                second, text = SecondHasher(data, hasher), data.tobytes()
                row = np.concatenate([c.row[at], r.row[to]])
                begin, end = np.concatenate([c.begin[at], r.begin[to]]), np.concatenate([c.end[at], r.end[to]])
                zero, start = np.zeros(n, np.int64), offsets[row]
                k1, k2 = hasher(r.begin[to], r.end[to]).view(np.int64), second(r.begin[to], r.end[to]).view(np.int64)
                place = _place(doc[r.row[to] + first], (begin - start)[n:]).view(np.int64)
                again = np.concatenate([repeats(c.row[at], c.hash[at])[0], np.zeros(m, bool)])
                bodies, own_first = [], {}
                for k, a, b, x, seen in zip(c.hash[at].tolist(), begin[:n].tolist(), end[:n].tolist(), row[:n].tolist(), again[:n].tolist()):
                    body = text[a:b]
                    if not seen:
                        own_first[x, k] = body
                    bodies.append(None if seen and own_first[x, k] == body else body)
                sides = [pa.concat_arrays([x, pa.nulls(m, x.type)]) for x in (c.sides(at, -1, second), c.sides(at, 1, second))]
                own = pa.array(row + first)
                both = [np.repeat(np.array([0, 1], np.int32), [n, m]), np.concatenate([c.hash[at].view(np.int64), r.anchor[to].view(np.int64)]), np.concatenate([zero, k1]), np.concatenate([zero, k2])]
                rest = [begin - start, end - start, np.concatenate([zero, place]), again]
                yield pa.RecordBatch.from_arrays([ids.take(own), *map(pa.array, both), h.take(own), *map(pa.array, rest), pa.array(bodies + [None] * m, pa.binary()), *sides], ["doc_id", *[x[0] for x in _FOUND]])

    return _scan(docs).mapInArrow(run, f"doc_id {_kind(docs, 'doc_id')}, " + ", ".join(f"{a} {b}" for a, b in _FOUND))


def _agreeing(mine: pa.Array, theirs: pa.Array) -> np.ndarray:
    """Bytes of the lines at the begin of each pair of line lists that are equal, up to the first that differs."""
    (a, a0), (b, b0) = _unpacked(mine, _LINE), _unpacked(theirs, _LINE)
    number = np.minimum(np.diff(a0), np.diff(b0))
    i, j = _ranges(a0[:-1], number), _ranges(b0[:-1], number)
    differs = (a["h1"][i] != b["h1"][j]) | (a["h2"][i] != b["h2"][j])
    owner = np.repeat(np.arange(len(number)), number)
    # Lines count as long as no difference was seen inside the pair.
    seen = np.cumsum(differs)
    good = seen == np.concatenate([[0], seen])[np.cumsum(number) - number][owner]
    return np.bincount(owner[good], a["n"][i][good], len(number)).astype(np.int64)


def _removals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Byte comparison with the first occurrence, then extension by whole lines on both sides."""
    for batch in batches:
        # Else equal hashes, other bytes; no bytes where they equal those of an earlier place of the document.
        same = pc.fill_null(pc.equal(batch.column("body"), batch.column("first_body")), True)
        begin = batch.column("begin").to_numpy() - _agreeing(batch.column("before"), batch.column("first_before"))
        end = batch.column("end").to_numpy() + _agreeing(batch.column("after"), batch.column("first_after"))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("h"), pa.array(begin), pa.array(end)], ["doc_id", "h", "begin", "end"]).filter(same)


def _later(found: DataFrame, first: DataFrame, keys: list[str], ties: bool) -> DataFrame:
    """Rows of found in other documents than the first of their keys. first: keys and first_id, the smallest id (null if all are).

    ties: one id may have several texts (see _ties); of these the smallest text hash is first.
    """
    joined = found.join(first, keys)
    others = joined.where(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    if not ties:
        return others
    level = joined.where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    least = level.groupBy(*keys).agg(F.min("h").alias("first_h"))
    return others.unionByName(level.join(least, keys).where("h <> first_h").drop("first_h"))


def _ties(found: DataFrame) -> bool:
    """Whether some id (or no id) has several texts."""
    return not found.groupBy("doc_id").agg((F.min("h") != F.max("h")).alias("several")).where("several").isEmpty()


def duplicate_spans(chunks: DataFrame) -> DataFrame:
    """(doc_id, h, begin, end): byte spans to remove, one row per repeated chunk beyond its first occurrence. chunks: the places of kind 0."""
    least = chunks.groupBy("hash").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").drop("n")
    least = cut(least, "least")
    # The first occurrence of each chunk, from the rows of its smallest id only, so that a frequent chunk isn't one task's.
    at = chunks.where("not again").join(least, "hash").where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    first = at.groupBy("hash").agg(F.min_by(F.struct("h", "body", "before", "after"), "h").alias("f"))
    first = cut(first.select("hash", F.col("f.h").alias("first_h"), F.col("f.body").alias("first_body"), F.col("f.before").alias("first_before"), F.col("f.after").alias("first_after")).join(least, "hash"), "first")
    # Both sides come from tables, so Spark may split a frequent chunk over tasks.
    later = chunks.join(first, "hash").where(F.col("again") | ~F.col("doc_id").eqNullSafe(F.col("first_id")) | (F.col("h") != F.col("first_h")))
    return later.select("doc_id", "h", "begin", "end", "body", "before", "after", "first_body", "first_before", "first_after").mapInArrow(_removals, f"doc_id {_kind(chunks, 'doc_id')}, h long, begin long, end long")


def _chosen(batches: Iterator[pa.RecordBatch], docs: np.ndarray, places: np.ndarray) -> Iterator[tuple]:
    """Of each slice with runs whose place may be in the bitmap: batch, the batch's rows, data, offsets, hasher and runs of the texts, and the places of single.

    Texts that the bitmap of documents (r) doesn't have are not looked at.
    """
    for batch in batches:
        doc = batch.column("r").to_numpy().view(_U)
        here = np.flatnonzero(in_bitmap(docs, doc))
        for first, data, offsets in slices(batch.column("text").take(pa.array(here))):
            hasher = Hasher(data)
            r, rows = Runs(data, offsets, hasher), here[first : first + len(offsets) - 1]
            chosen = np.flatnonzero(in_bitmap(places, _place(doc[rows[r.row]], r.begin - offsets[r.row])))
            if len(chosen):
                yield batch, rows, data, offsets, hasher, r, r.single(chosen)


def _single_twice(docs: DataFrame, chosen, places) -> DataFrame:
    """k1 of each LEAST_WORDS words inside the runs whose place may be in the bitmap, where several documents have it."""

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        for _, _, _, _, hasher, r, (of, begin, end) in _chosen(batches, chosen.value, places.value):
            yield (_once_a_row(hasher(begin, end), r.row[of]),)

    return repeated(_scan(docs), gather).select(F.col("hash").alias("k1"))


def _single(docs: DataFrame, chosen, places, shared) -> DataFrame:
    """k1, k2, doc_id, h, begin and end of each LEAST_WORDS words of these runs whose k1 may be in the bitmap shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, rows, data, offsets, hasher, r, (of, begin, end) in _chosen(batches, chosen.value, places.value):
            k1 = hasher(begin, end)
            at = np.flatnonzero(in_bitmap(shared.value, k1))
            if not len(at):
                continue
            of, begin, end, k1 = of[at], begin[at], end[at], k1[at]
            own, start = pa.array(rows[r.row[of]]), offsets[r.row[of]]
            keys = [k1.view(np.int64), SecondHasher(data, hasher)(begin, end).view(np.int64)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, keys), batch.column("doc_id").take(own), batch.column("h").take(own), pa.array(begin - start), pa.array(end - start)], ["k1", "k2", "doc_id", "h", "begin", "end"])

    return _scan(docs).mapInArrow(run, f"k1 long, k2 long, doc_id {_kind(docs, 'doc_id')}, h long, begin long, end long")


def _bits(values: DataFrame, column: str):
    """Broadcast bitmap with about 16 bits for each value, 2**24 at least and 2**29 at most."""
    return values.sparkSession.sparkContext.broadcast(bitmap(values, column, min(29, max(24, (16 * values.count()).bit_length()))))


_SPAN = ["doc_id", "h", "begin", "end"]


def repeated_word_spans(docs: DataFrame, runs: DataFrame, ties: bool) -> DataFrame:
    """(doc_id, h, begin, end): byte spans of LEAST_WORDS words or more that stand in an earlier document. runs: the places of kind 1."""
    key = ["k1", "k2"]
    first = cut(runs.groupBy("hash", *key).agg(F.min("doc_id").alias("first_id")), "first_runs")
    # Where an anchor stands in different runs, these may still share some words: the first of each is taken apart.
    several = first.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    of_first = runs.join(first.drop("hash"), key).where(F.col("doc_id").eqNullSafe(F.col("first_id")))
    apart = cut(of_first.join(several, "hash", "left_semi").select("place", F.xxhash64("doc_id", "h").alias("r")), "apart")
    where = _bits(cut(apart.select("r").distinct(), "documents"), "r"), _bits(apart, "place")
    # Counted first, so that words that stand once are never written.
    single = cut(_single(docs, *where, _bits(cut(_single_twice(docs, *where), "twice"), "k1")), "single_runs")
    shared = cut(single.groupBy(*key).agg(F.min("doc_id").alias("first_id")), "shared")
    return _later(runs, first.drop("hash"), key, ties).select(*_SPAN).unionByName(_later(single, shared, key, ties).select(*_SPAN))


def whole_lines(word: list[int], lines: list[int], found: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The spans of one text joined where they overlap, and cut to whole lines where that leaves fewer than LEAST_WORDS words of each part.

    word: where its words begin. lines: 0 and where its lines end.
    """
    joined: list[list[int]] = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    number = lambda a, b: bisect_left(word, b) - bisect_left(word, a)
    out = []
    for a, b in joined:
        line, after = lines[bisect_right(lines, a) - 1], lines[bisect_left(lines, b)]
        a = line if not number(line, a) else a
        b = after if not number(b, after) else b
        nearest, last = lines[bisect_left(lines, a)], lines[bisect_right(lines, b) - 1]
        x = nearest if number(a, nearest) < LEAST_WORDS else a
        y = last if number(last, b) < LEAST_WORDS else b
        out.append((x, y) if x < y and number(x, y) >= LEAST_WORDS else (a, b))
    return out


def removals(docs: DataFrame) -> DataFrame:
    """(doc_id, h, spans) of the documents (doc_id, text) that lose something: spans are longs of begin, end and whether words found it."""
    with scratch(docs.sparkSession) as keep:
        twice = cut(repeated_hashes(docs), "repeated")
        bits = [_bits(twice.where(F.col("kind") == k), "hash") for k in (0, 1)]
        found = cut(repeated_places(docs, *bits), "found")
        by_chunks, by_words = duplicate_spans(found.where("kind = 0")), repeated_word_spans(docs, found.where("kind = 1"), _ties(found))
        code = lambda n: F.shiftleft("begin", 32).bitwiseOR(F.shiftleft("end", 1)).bitwiseOR(F.lit(n).cast("long")).alias("span")
        gone = by_chunks.select("doc_id", "h", code(0)).unionByName(by_words.select("doc_id", "h", code(1)))
        return keep(cut(gone.groupBy("doc_id", "h").agg(F.collect_set("span").alias("spans")), "spans"))


def _without(texts: pa.Array, codes: pa.Array) -> Iterator[tuple[bytes, int, bool]]:
    """Of each text, what its spans (see removals) leave, the number of bytes removed, and whether no word is left."""
    of, flat = codes.offsets.to_numpy(), codes.values.to_numpy()
    for first, data, offsets in slices(texts):
        word, _, first_word = words(data, offsets)
        ends = line_ends(data, offsets)
        first_end = np.searchsorted(ends, offsets, "right")
        for n in range(len(offsets) - 1):
            x, start, whole = flat[of[first + n] : of[first + n + 1]], offsets[n], data[offsets[n] : offsets[n + 1]].tobytes()
            found = list(zip((x >> 32).tolist(), ((x & 0xFFFFFFFF) >> 1).tolist(), (x & 1).tolist()))
            of_words = [(a, b) for a, b, by_words in found if by_words]
            if of_words:
                of_words = whole_lines((word[first_word[n] : first_word[n + 1]] - start).tolist(), [0, *(ends[first_end[n] : first_end[n + 1]] - start).tolist()], of_words)
            left, to = [], 0
            for begin, end in sorted([(a, b) for a, b, by_words in found if not by_words] + of_words):
                if begin > to:
                    left.append(whole[to:begin])
                to = max(to, end)
            text = b"".join([*left, whole[to:]])
            yield text, len(whole) - len(text), not text.strip()


def dedup_lines(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks taken out of the text, and two more columns: _removed (bytes) and _emptied (no word is left of a text that had one).

    Columns of these names that docs has are replaced.
    """
    kept = docs.select(*columns(docs, "_removed", "_emptied"))
    per = removals(docs.select("doc_id", "text"))
    h, spans_, s_id, s_h = names(kept.columns, "h", "spans", "of_id", "of_h")
    per = per.select(F.col("doc_id").alias(s_id), F.col("h").alias(s_h), F.col("spans").alias(spans_))
    keyed = kept.withColumn(h, F.xxhash64("text"))
    joined = keyed.join(per, keyed["doc_id"].eqNullSafe(per[s_id]) & (keyed[h] == per[s_h]), "left").select(*columns(kept), column(spans_))
    width = len(kept.columns)
    at = [c.lower() for c in kept.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            lists, text = batch.column(width), batch.column(at)
            hit = lists.is_valid()
            done = list(_without(text.filter(hit), lists.filter(hit)))
            arrays = list(batch.columns[:width])
            arrays[at] = pc.replace_with_mask(text, hit, pa.array([x[0] for x in done], pa.binary()).cast(text.type))
            zero, no = pa.array(np.zeros(batch.num_rows, np.int64)), pa.array(np.zeros(batch.num_rows, bool))
            yield [*arrays, pc.replace_with_mask(zero, hit, pa.array([x[1] for x in done], pa.int64())), pc.replace_with_mask(no, hit, pa.array([x[2] for x in done], pa.bool_()))]

    out = map_batches(joined, run, [*kept.schema.fields, T.StructField("_removed", T.LongType()), T.StructField("_emptied", T.BooleanType())])
    size = [c for c in kept.columns if c.lower() == "n_chars"]
    if size:
        out = out.withColumn(size[0], F.when(F.col("_removed") > 0, F.char_length("text").cast(kept.schema[size[0]].dataType)).otherwise(column(size[0])))
    return out
