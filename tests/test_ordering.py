"""Places and runs in blocks, against a plain model."""

from itertools import groupby

import pytest

from lodestone.functions.ordering import numbered, runs

ROWS = [(g, i * 3 + (g is None), v) for g in ("a", "b", None) for i, v in enumerate([None, None, "x", "x", "y", "y", "x", None, "x", "x", "x", "z"])] + [("one", -5, "x")]


@pytest.mark.parametrize("parts", [1, 4, 7, None])
def test_ranges_change_nothing(spark, parts):
    df = spark.createDataFrame(ROWS, "g string, i long, v string").repartition(3)
    places = {(r.g, r.i): r.n for r in numbered(df, "g", "i", "n", parts).collect()}
    numbers = {(r.g, r.i): r.n for r in runs(df, "g", "i", "v", "n", parts).collect()}
    for g in ("a", "b", None, "one"):
        own = sorted(((i, v) for h, i, v in ROWS if h == g), key=lambda x: x[0])
        assert [places[g, i] for i, _ in own] == list(range(1, len(own) + 1))
        want = [n for n, (_, run) in enumerate(groupby(own, key=lambda x: x[1])) for _ in run]
        assert [numbers[g, i] for i, _ in own] == want
    assert len(places) == len(numbers) == len(ROWS)


def test_empty(spark):
    df = spark.createDataFrame([], "g string, i long, v string")
    assert numbered(df, "g", "i", "n").count() == runs(df, "g", "i", "v", "n").count() == 0
