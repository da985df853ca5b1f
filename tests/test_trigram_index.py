"""Trigram search against sets of trigrams: extraction, tiles of like size, and pairs that are given up early."""

import random

import numpy as np
import pyarrow as pa

from lodestone.operators import retrieval

_ODD = "ab_ é ß İ字\0\n٣ǅ𝒳😀1-"


def _sides(texts, ids=None):
    sizes, codes = retrieval._trigram_codes(pa.array(texts, pa.string()))
    return np.arange(len(texts)) if ids is None else ids, None, None, sizes, codes


def test_codes_are_the_trigrams_of_each_text(monkeypatch):
    rng = random.Random(1)
    wide = "".join(chr(x) for x in range(0x3400, 0x2FF00) if chr(x).isalnum())
    texts = ["", "  ", "a", "İstanbul foo_bar", "ab ab", wide, *["".join(rng.choice(_ODD) for _ in range(rng.randrange(60))) for _ in range(300)], "word " * 300_000]
    for block in (1, 50, 1 << 17, 1 << 30):
        monkeypatch.setattr(retrieval, "BLOCK", block)
        sizes, codes = retrieval._trigram_codes(pa.array(texts))
        for text, own in zip(texts, np.split(codes, np.cumsum(sizes)[:-1]), strict=True):
            assert sorted(own.tolist()) == sorted(ord(g[0]) << 42 | ord(g[1]) << 21 | ord(g[2]) for g in retrieval.trigrams(text))
    assert [len(x) for x in retrieval._trigram_codes(pa.array([], pa.string()))] == [0, 0]


def test_pairs_given_up_are_below_the_threshold(monkeypatch):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.choice((0, 1, 3, 10, 40, 300))))
    queries, chunks = [text() for _ in range(40)], [text() for _ in range(120)]
    chunks += [" ".join(q.split()[: rng.randrange(1, 30)]) for q in queries]
    a, b = list(map(retrieval.trigrams, queries)), list(map(retrieval.trigrams, chunks))
    for width in (16, 1024):
        monkeypatch.setattr(retrieval, "WIDTH", width)
        for threshold in (0.1, 0.3, 0.5, 1.0):
            counts = []
            far = retrieval._overlap(_sides(queries), _sides(chunks), threshold, counts)
            for i, x in enumerate(a):
                for j, y in enumerate(b):
                    s = len(x & y) / len(x | y) if x | y else 0.0
                    assert np.isclose(1 - far[i, j], s) if s >= threshold else np.isinf(far[i, j])
            pairs, fitting, steps = counts[0]
            assert pairs == len(a) * len(b) and fitting < pairs and steps == sorted(steps, reverse=True)
            if width == 16 and threshold >= 0.5:
                # What reaches the last step is the rectangle of the texts that have a pair left.
                assert steps[-1] < pairs / 2


def test_tiles_of_like_size(spark, monkeypatch):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdef") for _ in range(5)) for _ in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice((1, 5, 50, 2000)))) for _ in range(200)]
    queries = [*texts[:20], " ".join(texts[20].split()[:20]), "", " ".join(words[:200])]
    monkeypatch.setattr(retrieval, "TILE", 16)
    monkeypatch.setattr(retrieval, "ITEMS", 2000)
    rows = spark.createDataFrame([(i, 1, 0, t) for i, t in enumerate(texts)], "id long, mask long, level int, value string").coalesce(1)
    tiles = retrieval._tiles(rows, retrieval._trigram_codes, "long").collect()
    assert sorted(i for t in tiles for i in t.ids) == list(range(len(texts)))
    for t in tiles:
        assert t.sizes == sorted(t.sizes) and (t.low, t.high) == (t.sizes[0], t.sizes[-1]) and (len(t.data) <= 2000 or len(t.ids) == 1) and len(t.ids) <= 16
        at = np.cumsum(t.sizes)
        for i, n, end in zip(t.ids, t.sizes, at.tolist(), strict=True):
            assert set(t.data[end - n : end]) == set(retrieval._trigram_codes(pa.array([texts[i]]))[1].tolist())
    asked = spark.createDataFrame([(i, t, 1) for i, t in enumerate(queries)], "query_id long, query_text string, user_id long")
    chunks = spark.createDataFrame([(i, ["all"], 0, t) for i, t in enumerate(texts)], "chunk_id long, acl_tags array<string>, sensitivity_ordinal int, content string")
    grams = list(map(retrieval.trigrams, texts))
    mine = list(map(retrieval.trigrams, queries))
    want = {(i, j): round(len(q & c) / len(q | c), 9) for i, q in enumerate(mine) for j, c in enumerate(grams) if q | c and len(q & c) / len(q | c) >= 0.3}
    everyone = retrieval.principals(asked, spark.createDataFrame([(1, ["all"], 2)], "user_id long, permission_tags array<string>, clearance_level int"))
    for limit in (8 << 20, 0):
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", limit)
        got = {(r.query_id, r.chunk_id): r.score for r in retrieval.trigram_similarity(everyone, chunks).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_tiles_take_bounded_slices_of_a_batch(spark, monkeypatch):
    texts = [" ".join(f"w{i}x{j}" for j in range(1 + i % 40)) for i in range(300)]
    monkeypatch.setattr(retrieval, "SLICE", 1000)
    monkeypatch.setattr(retrieval, "ITEMS", 500)

    def encode(values):
        assert len(values) == 1 or sum(map(len, values.to_pylist())) <= 1000
        return retrieval._trigram_codes(values)

    rows = spark.createDataFrame([(i, 1, 0, t) for i, t in enumerate(texts)], "id long, mask long, level int, value string").coalesce(1)
    tiles = retrieval._tiles(rows, encode, "long").collect()
    assert sorted(i for t in tiles for i in t.ids) == list(range(len(texts)))
    for t in tiles:
        assert len(t.data) <= 500 or len(t.ids) == 1
        for i, n, end in zip(t.ids, t.sizes, np.cumsum(t.sizes).tolist(), strict=True):
            assert set(t.data[end - n : end]) == set(retrieval._trigram_codes(pa.array([texts[i]]))[1].tolist())
