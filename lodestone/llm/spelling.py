"""Spelling variants: words one edit apart, each led to its most frequent form.

Words are maximal runs of letters. Those of at least LEAST_LENGTH code points that occur LEAST_N
times make the vocabulary. Each word's deletions and replacements are generated as hashes only, in
numpy, and probed against blocked Bloom filters of the vocabulary, one for each word length, which all
tasks hold. What the filters let through is spelled out and shuffled to an exact join with the
vocabulary, which removes false positives. An insertion into a word is a deletion from the longer one, and a
replacement is the other word's replacement back, so each pair is generated once and read both ways.

The filters have BITS bits a word, MAX_MB together at most: a larger vocabulary lets more candidates
through to the join and loses nothing. A word has fewer than 180 near words for each of its letters,
so no group of links grows with the corpus.

Cases: null, empty and letterless texts have no words; a null id counts as empty text where ids choose
what is deleted; repeated rows count each; a word of any length is handled in blocks of positions; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import cut, map_batches, scratch
from lodestone.llm.text import LOWER, mix, slices, spans
from lodestone.llm.tokens import as_bytes, distinct

LEAST_LENGTH, LEAST_N = 6, 5
#: A form is this many times as frequent as its word.
RATIO = 5
#: Of the runs whose hash it divides, one letter is deleted.
DELETE_ONE_IN = 199
#: What edits put in: a-z and U+00C0 to U+00FF.
ALPHABET = np.array([*range(0x61, 0x7B), *range(0xC0, 0x100)], np.uint32)
BITS, MAX_MB = 16, 64
#: Edits that are probed at once.
PROBES = 1 << 20
#: Words up to this many code points have a shard of their own, longer ones share shards by length mod this.
SHARDS = 64
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


# Corpus words
def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the maximal runs of A-Z, a-z and U+00C0 to U+00FF (0xC3 and one more byte)."""
    inside = _LETTER[data]
    lead = data == 0xC3
    inside |= lead
    inside[1:] |= lead[:-1]
    starts, ends, first = spans(inside.view(np.uint8), offsets, np.array([False, True] + [False] * 254))
    return starts, ends, np.repeat(np.arange(len(offsets) - 1), np.diff(first))


@functools.lru_cache(1)
def _crc_shift() -> np.ndarray:
    """[n, k, b]: what byte k (lowest first) of value b of a CRC-32 state becomes after n further bytes; a state's bytes combine by exclusive or."""
    table = np.array([_crc_byte(b) for b in range(256)], np.uint32)
    out = np.zeros((SHARDS, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(1, SHARDS):
        s = out[n - 1]
        out[n] = (s >> np.uint32(8)) ^ table[s & np.uint32(255)]
    return out


def _crc_byte(b: int) -> int:
    for _ in range(8):
        b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
    return b


def joined_crc(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two texts in a row from those of both; length, below SHARDS, is the second one's in bytes."""
    shift, out = _crc_shift(), right.copy()
    for k in range(4):
        out ^= shift[length, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    return out


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n of every word of LEAST_LENGTH or more code points, after deletions; tasks sum their batches before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            heads = [b"%s:" % (b"" if i is None else i.encode()) for i in batch.column(0).to_pylist()]
            for row, data, offsets in slices(batch.column(1), 1 << 23):
                data = LOWER[data]
                starts, ends, of = runs(data, offsets)
                codes, found = distinct(data, starts, ends)
                words = as_bytes(found)
                length = np.fromiter(map(len, words), np.int64, len(words))
                crc = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
                doc = np.fromiter((zlib.crc32(h) for h in heads[row : row + len(offsets) - 1]), np.uint32, len(offsets) - 1)
                short = length[codes] < SHARDS
                h = np.zeros(len(codes), np.uint32)
                h[short] = joined_crc(doc[of[short]], crc[codes[short]], length[codes[short]])
                for i in np.flatnonzero(~short).tolist():
                    h[i] = zlib.crc32(words[codes[i]], int(doc[of[i]]))
                hit = h % np.uint32(DELETE_ONE_IN) == 0
                n = np.bincount(codes[~hit], minlength=len(words))
                counts = {}
                for i in np.flatnonzero(hit).tolist():
                    w = words[codes[i]].decode()
                    at = int(h[i]) % len(w)
                    w = w[:at] + w[at + 1 :]
                    counts[w] = counts.get(w, 0) + 1
                # Code points: bytes less the second ones of two.
                long = np.fromiter((len(w) - w.count(b"\xc3") >= LEAST_LENGTH for w in words), bool, len(words)) & (n > 0)
                keep = np.flatnonzero(long).tolist()
                changed = [(w, k) for w, k in counts.items() if len(w) >= LEAST_LENGTH]
                yield [pa.array([words[i].decode() for i in keep] + [w for w, _ in changed], pa.string()), pa.array(n[keep].tolist() + [k for _, k in changed], pa.int64())]

    each = map_batches(docs.select(F.col("doc_id").cast("string"), "text"), run, [T.StructField("word", T.StringType()), T.StructField("k", T.LongType())])
    return each.groupBy("word").agg(F.sum("k").alias("n"))


# Hashes of words and of their edits
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = np.full(n + 1, _BASE, _U)
    up[0] = 1
    return np.cumprod(up), _U(_INVERSE)


def word_hash(codes: np.ndarray) -> np.ndarray:
    """Hash of each row of code points (words of one length), before mixing."""
    up, _ = _powers(codes.shape[1])
    return ((codes.astype(_U) + _U(1)) * up[: codes.shape[1]]).sum(axis=1)


def shard(length: int) -> int:
    return length if length < SHARDS else SHARDS + length % SHARDS


class Filters:
    """Blocked Bloom filters by word length: a key has four bits, all in one block of eight 64-bit words."""

    def __init__(self, words: dict[int, int]):
        """words: number of words of each shard."""
        total = sum(words.values())
        bits = min(BITS, max(1, MAX_MB * (1 << 23) // max(1, total)))
        self.blocks = {s: max(1, -(-n * bits // 512)) for s, n in words.items()}
        self.first, at = {}, 0
        for s in sorted(self.blocks):
            self.first[s] = at
            at += self.blocks[s]
        self.bits = np.zeros(8 * at, _U)

    def places(self, hashes: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(block, seed) of hashes in shard s."""
        h = mix(hashes)
        block = ((h >> _U(32)) * _U(self.blocks[s])) >> _U(32)
        return block.astype(np.int64) + self.first[s], h

    def cells(self, hashes: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
        """(64-bit word, mask) of the four bits of each hash."""
        block, h = self.places(hashes, s)
        words, masks = [], []
        for j in range(4):
            nine = (h >> _U(8 * j)) & _U(511) if j < 3 else (h >> _U(23)) & _U(511)
            words.append(8 * block + (nine >> _U(6)).astype(np.int64))
            masks.append(_U(1) << (nine & _U(63)))
        return np.concatenate(words), np.concatenate(masks)

    def holds(self, hashes: np.ndarray, s: int) -> np.ndarray:
        """Indexes of the hashes that may be in shard s."""
        at = np.arange(len(hashes))
        if s not in self.blocks:
            return at[:0]
        block, h = self.places(hashes, s)
        for j in range(4):
            nine = (h >> _U(8 * j)) & _U(511) if j < 3 else (h >> _U(23)) & _U(511)
            found = (self.bits[8 * block + (nine >> _U(6)).astype(np.int64)] >> (nine & _U(63))) & _U(1)
            keep = np.flatnonzero(found)
            at, block, h = at[keep], block[keep], h[keep]
        return at


def _by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(indexes, matrix of code points) of the words of each length, in blocks."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(lengths, kind="stable")
    cuts = np.flatnonzero(np.diff(lengths[order])) + 1
    for some in np.split(order, cuts):
        if len(some):
            n = int(lengths[some[0]])
            step = max(1, PROBES // max(1, n * len(ALPHABET)))
            for lo in range(0, len(some), step):
                block = some[lo : lo + step]
                yield block, np.frombuffer("".join(words[i] for i in block.tolist()).encode("utf-32-le"), np.uint32).reshape(len(block), n)


def build(vocabulary: DataFrame) -> Filters:
    """The filters of a vocabulary (word). Executors or their bits together by 64-bit word, so the driver gets MAX_MB at most."""
    by_length = {}
    for length, n in vocabulary.groupBy(F.length("word")).count().collect():
        by_length[shard(length)] = by_length.get(shard(length), 0) + n
    filters = Filters(by_length)
    plain = Filters.__new__(Filters)
    plain.blocks, plain.first = filters.blocks, filters.first

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            cells, masks = [np.zeros(0, np.int64)], [np.zeros(0, _U)]
            for _, codes in _by_length(batch.column(0).to_pylist()):
                c, m = plain.cells(word_hash(codes), shard(codes.shape[1]))
                cells.append(c)
                masks.append(m)
            yield [pa.array(np.concatenate(cells)), pa.array(np.concatenate(masks).view(np.int64))]

    each = map_batches(vocabulary.select("word"), run, [T.StructField("cell", T.LongType()), T.StructField("mask", T.LongType())])
    found = each.groupBy("cell").agg(F.expr("bit_or(mask)").alias("mask")).toArrow()
    filters.bits[found["cell"].to_numpy()] = found["mask"].to_numpy().view(_U)
    return filters


def edits(codes: np.ndarray, filters: Filters) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, place, letter) of the edits of words of one length that the filters let through; letter 0 is a deletion.

    Of a run of equal letters only the first is deleted, and letters are replaced by greater ones only.
    """
    rows, n = codes.shape
    up, down = _powers(n)
    value = (codes.astype(_U) + _U(1)) * up[:n]
    whole = value.sum(axis=1)
    if n > 1:
        before = np.cumsum(value, axis=1) - value
        less = before + (whole[:, None] - before - value) * down
        r, p = np.nonzero(np.concatenate([np.ones((rows, 1), bool), codes[:, 1:] != codes[:, :-1]], axis=1))
        at = filters.holds(less[r, p], shard(n - 1))
        yield r[at], p[at], np.zeros(len(at), np.uint32)
    if shard(n) not in filters.blocks:
        return
    step = max(1, PROBES // (rows * len(ALPHABET)))
    for lo in range(0, n, step):
        some = codes[:, lo : lo + step]
        r, p, c = np.nonzero(ALPHABET[None, None, :] > some[:, :, None])
        letter = ALPHABET[c]
        h = whole[r] + (letter.astype(_U) - some[r, p].astype(_U)) * up[lo + p]
        at = filters.holds(h, shard(n))
        yield r[at], p[at] + lo, letter[at]


def near_pairs(vocabulary: DataFrame) -> DataFrame:
    """word, n, other, other_n of each two words of a vocabulary (word, n) one edit apart, once each."""
    filters = vocabulary.sparkSession.sparkContext.broadcast(build(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for index, codes in _by_length(words):
                for row, place, letter in edits(codes, filters.value):
                    of = index[row]
                    made = []
                    for i, p, c in zip(of.tolist(), place.tolist(), letter.tolist()):
                        w = words[i]
                        made.append(w[:p] + (chr(c) if c else "") + w[p + 1 :])
                    yield [pa.array([words[i] for i in of.tolist()], pa.string()), pa.array(n[of]), pa.array(made, pa.string())]

    fields = [T.StructField("word", T.StringType()), T.StructField("n", T.LongType()), T.StructField("other", T.StringType())]
    # Generating edits is work by the word, not by the byte, so the words are dealt out.
    dealt = vocabulary.select("word", "n").repartition(int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    guesses = map_batches(dealt, run, fields)
    return guesses.join(vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n")), "other")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of the vocabulary.

    form is the near word of largest n (ties: the smallest in code-point order) if that is RATIO times the word's
    n or more, else null; root is where forms lead to.
    """
    spark = docs.sparkSession
    with scratch(spark) as keep:
        vocabulary = keep(cut(word_counts(docs).where(F.col("n") >= LEAST_N), "vocabulary"))
        pairs = cut(near_pairs(vocabulary), "pairs")
        both = pairs.select("word", "n", "other", "other_n").unionByName(pairs.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
        best = both.groupBy("word", "n").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), "other")).alias("b"))
        led = (-F.col("b.m")) >= RATIO * F.col("n")
        near = keep(cut(best.select("word", "n_near", F.when(led, F.col("b.other")).alias("form"), F.when(led, -F.col("b.m")).alias("form_n")), "near"))
        # Each step of a chain is RATIO times as frequent, so chains are short; roots double their reach in each round.
        rooted = cut(near.where("form is not null").select("word", F.col("form").alias("root")), "roots")
        while True:
            further = rooted.join(rooted.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
            rooted = cut(further.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
            if rooted.where("moved").isEmpty():
                break
            rooted = rooted.drop("moved")
        roots = keep(rooted)
    return vocabulary.join(near, "word", "left").join(roots.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
