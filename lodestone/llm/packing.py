"""Packing of tokenised documents into sequences of at most CAPACITY tokens by bin completion.

A task encodes its documents, ends each with the id 0, cuts those above the capacity into pieces and
numbers pieces of equal length. Only the number of pieces of each length, at most CAPACITY numbers
whatever the corpus, is packed in one place: the plan says which lengths share a sequence and how many
sequences are filled alike. Pieces then look up their sequence by their number among those of their length.

The plan comes from bin completion, branch-and-bound: a node takes the largest length left, enumerates
the undominated fillings of the room beside it, and branches on them, least waste first, for as many
sequences alike as the pieces allow, and for one. A node whose waste so far and least further waste
exceed what a better plan may waste is pruned; the best-fit-decreasing plan, and best-fit completions of
nodes, are the incumbents. The search ends when an incumbent meets the lower bound, or after NODES
nodes; then the incumbent stays, which is never worse than best fit.

Cases: null, empty and blank texts are one piece of the id 0; repeated rows and ids are packed each by
itself; null ids stay; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut, map_batches, scratch
from lodestone.llm.text import slices
from lodestone.llm.tokens import public, word_tokenizer

CAPACITY = 2048
#: Bytes of text that are encoded at once (a longer text comes alone).
SLICE = 1 << 22
#: Nodes of the search, fillings that a node branches on, and steps of their enumeration.
NODES, FILLINGS, STEPS = 400, 32, 4000
#: A filling: (length, times) by falling length; a plan: (filling, number of sequences).
Filling = tuple[tuple[int, int], ...]
Plan = list[tuple[Filling, int]]


def used(filling: Filling) -> int:
    return sum(s * k for s, k in filling)


def size(plan: Plan) -> int:
    return sum(n for _, n in plan)


def least_waste(counts: np.ndarray, capacity: int) -> int:
    """Room that no plan can fill: beside each length above half, only pieces of at most the rest fit."""
    waste = room = 0
    small = np.cumsum(np.arange(len(counts)) * counts)
    taken = 0
    for s in range(capacity, capacity // 2, -1):
        if counts[s]:
            fits = int(small[capacity - s])
            room = int(counts[s]) * (capacity - s)
            here = min(room, fits - taken)
            taken += here
            waste += room - here
    return waste


def least_sequences(counts: np.ndarray, capacity: int) -> int:
    return -(-(int((np.arange(len(counts)) * counts).sum()) + least_waste(counts, capacity)) // capacity)


def best_fit(counts: np.ndarray, capacity: int) -> Plan:
    """Best-fit decreasing, all sequences of equal contents at once."""
    open_: dict[int, list[tuple[Filling, int]]] = {}
    rooms: list[int] = []

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((filling, n))

    for s in np.flatnonzero(counts)[::-1].tolist():
        left = int(counts[s])
        while left:
            at = bisect_left(rooms, s)
            if at < len(rooms):
                room = rooms[at]
                filling, n = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
                # A sequence takes pieces as long as it stays the fullest that they fit.
                k = min(room // s, left)
                whole = min(n, left // k)
                put(room - k * s, _with(filling, s, k), whole)
                left -= whole * k
                if n > whole:
                    put(room, filling, n - whole)
            else:
                k = min(capacity // s, left)
                n = left // k
                put(capacity - k * s, ((s, k),), n)
                left -= n * k
    return [x for room in rooms for x in open_[room]]


def _with(filling: Filling, s: int, k: int) -> Filling:
    return (*filling[:-1], (s, filling[-1][1] + k)) if filling[-1][0] == s else (*filling, (s, k))


def fillings(counts: np.ndarray, room: int, waste: int, limit: int = FILLINGS) -> list[Filling]:
    """Undominated fillings of a room with at most so much waste, least waste first.

    A filling is dominated if another piece still fits, or if a piece left out is at least as long as
    some of its pieces together and fits in their place.
    """
    lengths = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    have = [min(int(counts[s]), room // s) for s in lengths]
    after = np.concatenate([np.cumsum([s * h for s, h in zip(lengths, have)][::-1])[::-1], [0]]).tolist()
    found: list[tuple[int, Filling]] = []
    steps = 0

    def walk(i: int, left: int, taken: Filling) -> None:
        nonlocal steps
        steps += 1
        if steps > STEPS or len(found) >= 4 * limit:
            return
        while i < len(lengths) and lengths[i] > left:
            i += 1
        if left - after[i] > waste:
            return
        if i == len(lengths):
            found.append((left, taken))
            return
        s = lengths[i]
        for k in range(min(have[i], left // s), -1, -1):
            walk(i + 1, left - k * s, (*taken, (s, k)) if k else taken)

    walk(0, room, ())
    out = [(w, f) for w, f in found if not _dominated(f, w, lengths, counts)]
    return [f for _, f in sorted(out, key=lambda x: (x[0], [(-s, -k) for s, k in x[1]]))[:limit]]


def _dominated(filling: Filling, waste: int, lengths: list[int], counts: np.ndarray) -> bool:
    spare = [s for s in lengths[::-1] if counts[s] > dict(filling).get(s, 0)]
    if spare and spare[0] <= waste:
        return True
    pieces = [s for s, k in filling for _ in range(min(k, 3))][:8]
    for n in (1, 2, 3):
        for some in combinations(pieces, n):
            total = sum(some)
            at = bisect_left(spare, total + (n == 1))
            if at < len(spare) and spare[at] <= total + waste:
                return True
    return False


def plan(counts: np.ndarray, capacity: int = CAPACITY, nodes: int = NODES) -> tuple[Plan, int]:
    """(plan, lower bound) of counts[s] pieces of each length s."""
    counts = counts.astype(np.int64)
    total = int((np.arange(len(counts)) * counts).sum())
    bound = least_sequences(counts, capacity)
    best = best_fit(counts, capacity)
    visited = 0

    def walk(left: np.ndarray, wasted: int, chosen: Plan) -> None:
        nonlocal best, visited
        # What a plan of fewer sequences may waste.
        allowed = (size(best) - 1) * capacity - total
        if size(best) == bound or visited >= nodes or wasted + least_waste(left, capacity) > allowed:
            return
        visited += 1
        rest = best_fit(left, capacity)
        if size(chosen) + size(rest) < size(best):
            best = chosen + rest
            allowed = (size(best) - 1) * capacity - total
        if size(best) == bound or not left.any():
            return
        largest = int(np.flatnonzero(left)[-1])
        left[largest] -= 1
        options = fillings(left, capacity - largest, allowed - wasted)
        left[largest] += 1
        for f in options:
            whole = _joined(largest, f)
            waste = capacity - used(whole)
            most = min(int(left[s]) // k for s, k in whole)
            if waste:
                most = min(most, (allowed - wasted) // waste)
            for n in dict.fromkeys((most, 1)):
                if n < 1 or n > most:
                    continue
                after = left.copy()
                for s, k in whole:
                    after[s] -= n * k
                walk(after, wasted + n * waste, [*chosen, (whole, n)])
                if size(best) == bound or visited >= nodes:
                    return

    walk(counts.copy(), 0, [])
    return best, bound


def _joined(largest: int, filling: Filling) -> Filling:
    return ((largest, filling[0][1] + 1), *filling[1:]) if filling and filling[0][0] == largest else ((largest, 1), *filling)


def slots(found: Plan) -> dict[str, np.ndarray]:
    """The plan as ranges of piece numbers by length: sorted keys (length << 44 | first number), pieces a sequence, first sequence, place of the first."""
    rows, at, sequence = [], {}, 0
    for filling, n in found:
        place = 0
        for s, k in filling:
            first = at.get(s, 0)
            rows.append((s << 44 | first, k, sequence, place))
            at[s] = first + n * k
            place += s * k
        sequence += n
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "pieces", "sequence", "place"), np.ascontiguousarray(table.T)))


def pieces(docs: DataFrame, capacity: int, path: str, with_ids: bool) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, task, number, and ids if wanted. number counts the pieces of a length in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        from pyspark import TaskContext

        tokenizer, task = word_tokenizer(path), TaskContext.get().partitionId()
        numbers = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for row, data, offsets in slices(batch.column(1), SLICE):
                ids, n = tokenizer(data, offsets)
                rows = len(n)
                # Each row's ids with 0 behind.
                ends = np.cumsum(n + 1)
                flat = np.zeros(int(ends[-1]), "<u4")
                body = np.ones(len(flat), bool)
                body[ends - 1] = False
                flat[body] = ids
                cuts = -(-(n + 1) // capacity)
                of = np.repeat(np.arange(rows), cuts)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                length = np.minimum(capacity, (n + 1)[of] - piece * capacity)
                lo = (ends - n - 1)[of] + piece * capacity
                view = memoryview(flat).cast("B")
                crc = np.fromiter((zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(lo.tolist(), (lo + length).tolist())), np.int64, len(of))
                order = np.argsort(length, kind="stable")
                ordered = length[order]
                heads = np.searchsorted(ordered, ordered)
                number = np.empty(len(of), np.int64)
                number[order] = numbers[ordered] + np.arange(len(of)) - heads
                numbers += np.bincount(length, minlength=capacity + 1)
                out = [batch.column(0).slice(row, rows).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(piece * capacity), pa.array(length), pa.array(crc), pa.array(np.full(len(of), task, np.int32)), pa.array(number)]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.append(lo, ends[-1]).astype(np.int32)), pa.array(flat.astype(np.int32))))
                yield out

    long, int_ = T.LongType(), T.IntegerType()
    fields = [T.StructField("doc_id", docs.schema["doc_id"].dataType), *[T.StructField(c, t) for c, t in (("piece", int_), ("start", long), ("length", long), ("ids_crc32", long), ("task", int_), ("number", long))]]
    return map_batches(docs.select("doc_id", "text"), run, fields + [T.StructField("ids", T.ArrayType(int_))] * with_ids)


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str | None = None, with_ids: bool = False, nodes: int = NODES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every row, and its ids if wanted (see sequences)."""
    spark = docs.sparkSession
    with scratch(spark) as keep:
        made = keep(cut(pieces(docs, capacity, path or public("word_bpe_49k.json"), with_ids), "pieces"))
        by_task = keep(cut(made.groupBy("length", "task").agg(F.count("*").alias("n")), "by_task"))
        counts = np.zeros(capacity + 1, np.int64)
        # At most one row for each length.
        for length, n in by_task.groupBy("length").agg(F.sum("n")).collect():
            counts[length] = n
    found, _ = plan(counts, capacity, nodes)
    table = spark.sparkContext.broadcast(slots(found))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = by_task.select("length", "task", before.alias("before"))
    rest = ["ids"] * with_ids
    numbered = made.join(starts, ["length", "task"]).select("doc_id", "piece", "start", "length", "ids_crc32", *rest, (F.col("number") + F.col("before")).alias("number"))
    place = len(numbered.columns) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        t = table.value
        for batch in batches:
            length, number = batch.column(3).to_numpy(), batch.column(place).to_numpy()
            at = np.searchsorted(t["key"], length << 44 | number, "right") - 1
            inner = number - (t["key"][at] & ((1 << 44) - 1))
            k = t["pieces"][at]
            yield [*batch.columns[:place], pa.array(t["sequence"][at] + inner // k), pa.array(t["place"][at] + inner % k * length)]

    return map_batches(numbered, run, [*numbered.schema.fields[:place], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids of pieces packed with ids: the training sequences. A group holds at most CAPACITY ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
