"""Document statistics by numpy over whole Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import NOT_SPACE, Hasher, gram_ok, grams, mix, row_of, row_sums, slices, spans

_U = np.uint64


def _set(chars: bytes) -> np.ndarray:
    x = np.zeros(256, bool)
    x[list(chars)] = True
    return x


SYMBOLS = _set(b"#*$%&|<>")
_FIRST_BYTE = (np.arange(256) & 0xC0) != 0x80
_UPPER, _LOWER, _DIGIT = (_set(bytes(range(a, b))) for a, b in ((65, 91), (97, 123), (48, 58)))


def repeats(row: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(later, shared): whether an equal hash comes earlier in the row, and whether another is equal at all."""
    later, shared = np.zeros(len(h), bool), np.zeros(len(h), bool)
    if len(h) > 1:
        key = mix(h + row.astype(_U) * _U(0xC2B2AE3D27D4EB4F))
        order = np.argsort(key, kind="stable")
        same = key[order[1:]] == key[order[:-1]]
        later[order[1:][same]] = True
        shared[order[1:][same]] = shared[order[:-1][same]] = True
    return later, shared


def base(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and the words themselves, by row."""
    starts, ends, first = spans(data, offsets, NOT_SPACE)
    hasher = Hasher(data)
    words, row = hasher(starts, ends), row_of(first)
    out = {"n_words": np.diff(first), "word_chars": row_sums((NOT_SPACE & _FIRST_BYTE)[data], offsets), "n_symbols": row_sums(SYMBOLS[data], offsets)}
    # Lines: rows cut at newlines; only those with a word count.
    line_from, line_to, line_first = spans(data, offsets, np.arange(256) != 10)
    filled = np.concatenate([[0], np.cumsum(NOT_SPACE[data])])
    some = filled[line_to] > filled[line_from]
    line_row = row_of(line_first)[some]
    later, _ = repeats(line_row, hasher(line_from[some], line_to[some]))
    n = len(offsets) - 1
    out["n_lines"] = np.bincount(line_row, minlength=n)
    out["n_dup_lines"] = np.bincount(line_row[later], minlength=n)
    # Words in any 3-word window that occurs twice or more in its row.
    ok = np.flatnonzero(gram_ok(first, 3))
    _, shared = repeats(row[ok], grams(words, 3)[ok])
    covered = np.zeros(len(words), bool)
    for j in range(3):
        covered[ok[shared] + j] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return out | {"words": words, "row": row, "starts": starts, "ends": ends, "first": first}


FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "upper", "digits", "marks", "stops", "commas", "words_per_line", "unique_words", "adjacent_equal", "longest_word", "capitals", "short_words", "non_ascii", "other_ascii", "top_word")


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(rows, FEATURES) float64; all zero for a text without words."""
    b = base(data, offsets)
    n, words = len(offsets) - 1, np.maximum(b["n_words"], 1).astype(float)
    chars = np.maximum(b["word_chars"], 1).astype(float)
    count = lambda table: row_sums(table[data], offsets)
    length, row, first = b["ends"] - b["starts"], b["row"], b["first"]
    upper, lower = count(_UPPER), count(_LOWER)
    later, _ = repeats(row, b["words"])
    adjacent = np.zeros(len(row), bool)
    adjacent[1:] = (b["words"][1:] == b["words"][:-1]) & (row[1:] == row[:-1])
    top, longest = np.zeros(n), np.zeros(n)
    if len(row):
        key = np.lexsort((b["words"], row))
        new = np.concatenate([[True], (b["words"][key][1:] != b["words"][key][:-1]) | (row[key][1:] != row[key][:-1])])
        at = np.flatnonzero(new)
        np.maximum.at(top, row[key][at], np.diff([*at, len(row)]).astype(float))
        np.maximum.at(longest, row, length.astype(float))
    x = np.zeros((n, len(FEATURES)))
    per_word = lambda mask: np.bincount(row[mask], minlength=n) / words
    columns = [np.log1p(b["n_words"]), b["word_chars"] / words, b["n_symbols"] / chars, b["n_dup_lines"] / np.maximum(b["n_lines"], 1), b["n_repeat_words"] / words, upper / np.maximum(upper + lower, 1), count(_DIGIT) / chars, count(_set(b"!?")) / chars, count(_set(b".")) / chars, count(_set(b",")) / chars, b["n_words"] / np.maximum(b["n_lines"], 1), 1 - per_word(later), per_word(adjacent), np.log1p(longest), per_word(_UPPER[data[b["starts"]]]), per_word(length <= 3), count(np.arange(256) >= 192) / chars, count(_set(bytes(range(33, 127))) & ~_UPPER & ~_LOWER & ~_DIGIT) / chars, top / words]
    for i, c in enumerate(columns):
        x[:, i] = np.where(b["n_words"] > 0, c, 0)
    return x


def per_row(docs: DataFrame, compute: Callable[[np.ndarray, np.ndarray], list[np.ndarray]], columns: str, keep: tuple = ("doc_id",)) -> DataFrame:
    """Adds the columns that compute(bytes, offsets) returns for the texts; only these and keep are returned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [compute(data, offsets) for _, data, offsets in slices(batch.column(batch.num_columns - 1))]
            if parts:
                made = [pa.array(list(np.concatenate(x)) if x[0].ndim > 1 else np.concatenate(x)) for x in zip(*parts)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names)

    kinds = dict(docs.dtypes)
    names = [*keep, *[c.strip().split()[0] for c in columns.split(",")]]
    return docs.select(*keep, F.col("text").alias("_text")).mapInArrow(run, ", ".join([*[f"`{c}` {kinds[c]}" for c in keep], columns]))


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """doc_id, text, lang and y of all labelled documents that aren't held out; with rows of at most so many, by hash order of their ids.

    At most rows ids are broadcast. A document id that is repeated in labels gives one row.
    """
    from lodestone.llm.common import id_remainder

    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (id_remainder(F.col("doc_id")) != 2))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    if rows is not None:
        known = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    return docs.select("doc_id", "text", lang).join(known, "doc_id")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """labelled_rows of at most rows documents."""
    return labelled_rows(docs, labels, label, rows)
