"""Benchmark decontamination by winnowing.

Documents and test items are read as lower-cased words [0-9a-z and all of non-ASCII]. Of each
sliding window of WINDOW successive K-word hashes the smallest are kept (all ties), so any span of
K + WINDOW - 1 = 13 shared words shares at least one kept fingerprint. The kept fingerprints of
documents meet those of the items in an equi-join, with the words around them on both sides, and
each hit is extended word by word: a hit of 13 or more equal words marks these words. Items of
fewer than 13 words are one window: their whole hash is looked up at every position.

A fixed-size bitmap of the items' fingerprints keeps documents' other fingerprints out of the
join; it only saves work, since the join and the extension are exact.

Cases: null and blank texts have no words and are never hit; an item without words matches
nothing; an item with a null id marks words but isn't counted among the items; repeated items count
once; rows with the same id are judged each by its own text; an empty table on either side gives
no hits; other columns are ignored, or pass untouched whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import bitmap, columns, cut, in_bitmap, names
from lodestone.llm.text import ALNUM, LOWER, Hasher, gram_ok, grams, mix, row_of, slices, spans

SPAN = 13
K = 5
WINDOW = SPAN - K + 1
#: A document is contaminated if hit words are one in this many, or more.
ONE_IN = 20
_U = np.uint64
_SEEN = pa.list_(pa.struct([("h", pa.int64()), ("lead", pa.int32()), ("need", pa.int32()), ("context", pa.string()), ("at", pa.list_(pa.int32()))]))


def _slide(values: np.ndarray, n: int, best) -> np.ndarray:
    """best over each n successive values."""
    step, out = 1, values
    while step < n:
        shift = min(step, n - step)
        out = best(out[: len(out) - shift], out[shift:])
        step += shift
    return out


def winnow(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, kept): K-gram hashes by position, and whether one is smallest of some window inside its row."""
    h, ok = grams(words, K), gram_ok(first, K)
    kept = np.zeros(len(h), bool)
    if len(h) < WINDOW:
        return h, kept
    whole = gram_ok(first, SPAN)
    low = np.where(whole, _slide(np.where(ok, h, ~_U(0)), WINDOW, np.minimum), _U(0))
    padded = np.zeros(len(low) + 2 * (WINDOW - 1), _U)
    padded[WINDOW - 1 : WINDOW - 1 + len(low)] = low
    return h, ok & (_slide(padded, WINDOW, np.maximum) == h)


def scan(docs: DataFrame, id_column: str, bits=None, short: tuple = (), item: bool = False) -> DataFrame:
    """(id, n_words, seen) of every row; seen: fingerprints in the bitmap with the words around them.

    short: the lengths below SPAN that some item has. bits: a broadcast bitmap, None to keep all.
    item: the row's own length is its only short window, at its beginning.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if bits is None else bits.value
        for batch in batches:
            counts, seen = [], []
            for _, data, offsets in slices(batch.column("text")):
                data = LOWER[data]
                starts, ends, first = spans(data, offsets, ALNUM)
                words = Hasher(data)(starts, ends)
                number = np.diff(first)
                counts.append(number)
                found: list[dict] = [{} for _ in number]
                text = data.tobytes()
                owner = row_of(first)

                def note(positions: np.ndarray, hashes: np.ndarray, before: int, size: int, need: int) -> None:
                    for p, h in zip(positions.tolist(), hashes.view(np.int64).tolist()):
                        r = int(owner[p])
                        a, b = max(int(first[r]), p - before), min(int(first[r + 1]), p + size)
                        context = b" ".join(text[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist())).decode("utf-8", "replace")
                        found[r].setdefault((h, p - a, need, context), []).append(p - int(first[r]))

                h, kept = winnow(words, first)
                at = np.flatnonzero(kept)
                if known is not None:
                    at = at[in_bitmap(known, h[at])]
                note(at, h[at], SPAN - K, SPAN, SPAN)
                for m in range(1, SPAN) if item else short:
                    g = mix(grams(words, m) ^ _U(m))
                    at = np.flatnonzero(gram_ok(first, m))
                    if item:
                        at = at[number[owner[at]] == m]
                    if known is not None:
                        at = at[in_bitmap(known, g[at])]
                    note(at, g[at], 0, m, m)
                seen += [[{"h": k[0], "lead": k[1], "need": k[2], "context": k[3], "at": v} for k, v in f.items()] for f in found]
            n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("h"), pa.array(n, pa.int64()), pa.array(seen, _SEEN)], ["id", "h", "n_words", "seen"])

    kind = dict(docs.dtypes)[id_column]
    rows = docs.select(F.col(id_column).alias("id"), F.xxhash64("text").alias("h"), "text")
    return rows.mapInArrow(run, f"id {kind}, h long, n_words long, seen array<struct<h: long, lead: int, need: int, context: string, at: array<int>>>")


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs of contexts that agree on enough words around the fingerprint: begin and end relative to it."""
    for batch in batches:
        out = []
        d = batch.to_pydict()
        for i in range(batch.num_rows):
            mine, theirs = d["context"][i].split(" "), d["item_context"][i].split(" ")
            p, q = d["lead"][i], d["item_lead"][i]
            left = 0
            while left < min(p, q) and mine[p - left - 1] == theirs[q - left - 1]:
                left += 1
            right = 0
            while right < min(len(mine) - p, len(theirs) - q) and mine[p + right] == theirs[q + right]:
                right += 1
            if right and left + right >= d["item_need"][i]:
                out.append((i, -left, right))
        keep = pa.array([x[0] for x in out], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("row").take(keep), batch.column("item_id").take(keep), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.int32()), batch.column("at").take(keep)], ["row", "item_id", "begin", "end", "at"])


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, h (text hash), n_words, n_hit, n_items, items_sha256 and contaminated of every document."""
    items = cut(scan(benchmark, "item_id", item=True), "items")
    prints = cut(items.select(F.col("id").alias("item_id"), F.explode("seen").alias("s")).select("item_id", "s.h", F.col("s.lead").alias("item_lead"), F.col("s.need").alias("item_need"), F.col("s.context").alias("item_context")).distinct(), "prints")
    short = tuple(sorted(r[0] for r in prints.where(F.col("item_need") < SPAN).select("item_need").distinct().collect()))  # at most 12 lengths
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(prints.select("h").distinct(), "h"))
    seen = cut(scan(docs, "doc_id", bits, short).withColumn("row", F.monotonically_increasing_id()), "seen")
    pairs = seen.select("row", F.explode("seen").alias("s")).select("row", "s.*").join(prints, "h").where("need = item_need")
    hits = pairs.select("row", "item_id", "lead", "context", "at", "item_lead", "item_need", "item_context").mapInArrow(_extend, "row long, item_id " + dict(prints.dtypes)["item_id"] + ", begin int, end int, at array<int>")
    # Positions of the marked words, first within each hit, then each once for a document.
    marked = F.expr("array_distinct(flatten(transform(at, p -> sequence(p + begin, p + end - 1))))")
    words = hits.select("row", F.explode(marked).alias("p")).distinct().groupBy("row").agg(F.count("*").alias("hit"))
    names = hits.where("item_id is not null").select("row", F.col("item_id").cast("string").alias("item")).distinct().groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("names"))
    found = words.join(names, "row", "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("long")
    judged = seen.select("row", F.col("id").alias("doc_id"), F.col("h"), "n_words").join(found, "row", "left")
    return judged.select("doc_id", "h", "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("names"), F.lit(0)).cast("long").alias("n_items"), F.sha2(F.coalesce(F.array_join("names", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), ((n_hit > 0) & (ONE_IN * n_hit >= F.col("n_words"))).alias("contaminated"))


def without_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that aren't contaminated, all columns as they were."""
    h, g_id, g_h = names(docs.columns, "h", "of_id", "of_h")
    gone = cut(contamination(docs.select("doc_id", "text"), benchmark).where("contaminated").select(F.col("doc_id").alias(g_id), F.col("h").alias(g_h)).distinct(), "gone")
    keyed = docs.withColumn(h, F.xxhash64("text"))
    return keyed.join(gone, keyed["doc_id"].eqNullSafe(gone[g_id]) & (keyed[h] == gone[g_h]), "left_anti").select(*columns(docs))


ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS m, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS win FROM (SELECT *, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
ms AS (SELECT DISTINCT m FROM bw),
dw AS (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS win FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, ms WHERE len(w) >= m)),
h AS (SELECT dw.r, dw.i, dw.m, bw.item_id FROM dw JOIN bw ON dw.m = bw.m AND dw.win = bw.win),
p AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS q FROM h) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM h WHERE item_id IS NOT NULL) GROUP BY r)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(p.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items, sha256(coalesce(n.items, '')) AS items_sha256,
  coalesce(p.n_hit, 0) > 0 AND 20 * coalesce(p.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN p ON p.r = d.r LEFT JOIN n ON n.r = d.r
"""
