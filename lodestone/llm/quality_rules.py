"""Quality rules: fixed limits, then robust multivariate outliers by language and source.

Statistic vectors are transformed (logarithms, square roots of shares), put on a grid of 1/GRID so
that all sums are exact integers, and each group of language and source gets a
minimum-covariance-determinant estimate over all its rows. Concentration steps run from STARTS
starts: the exact medians with the tolerances, and with the median deviations, as spread; the mean of
all rows, and their medians, with the covariance of all. A step gives the mean and covariance of the half of the
rows with the least Mahalanobis distance. After FIRST_STEPS steps the start of the smallest determinant goes
on until its determinant no longer falls. A step is one aggregation: moments by bins of the distance, of which the
nearest bins that hold half of the rows are summed, so a group of any size needs partial sums only, and
nothing but one row per group and start is ever gathered. Covariances get
TOLERANCE on the diagonal, so that a little spread in an otherwise even group isn't an outlier; they are small
enough for each statistic to reject alone.

Cases: null and blank texts have no words and fail the base; null language or source form groups of
their own; groups below LEAST_ROWS use the estimate of their language, languages below it the one of all rows, and all
passes when there are too few at all; ties in distance are kept together; repeated
rows count as often as they come; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, join_keyed, scratch
from lodestone.llm.statistics import base, per_row

GRID = 1024
STARTS, FIRST_STEPS, MOST_STEPS = 4, 2, 20
#: A fall of the logarithm of the determinant that is worth another step.
SETTLED = 1e-6
LEAST_ROWS = 50
#: Standard deviations that are always allowed: log words, log word length, and roots of the shares of symbols, repeated lines and repeated words.
TOLERANCE = (0.1, 0.05, 0.05, 0.1, 0.1)
#: Chi-squared (5 degrees of freedom) median, and the limit on the squared distance, at a tail of 1e-5. Each share alone can exceed it.
MEDIAN, LIMIT = 4.351, 30.86
_D = len(TOLERANCE)
_BINS = 16  # bins for each doubling of a squared distance
_Z, _M = [f"z{i}" for i in range(_D)], [f"m{i}" for i in range(_D)]
_PAIRS = [(i, j) for i in range(_D) for j in range(i, _D)]
_V, _S, _P = [f"v{i}{j}" for i, j in _PAIRS], [f"s{i}" for i in range(_D)], [f"p{i}{j}" for i, j in _PAIRS]
_ESTIMATE = "key string, start int, half int, logdet double, " + ", ".join(f"{c} double" for c in _M + _V)


def statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and the five base counts of every document."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

    def compute(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
        b = base(data, offsets)
        return [b[n].astype(np.int64) for n in names]

    return per_row(docs, compute, ", ".join(f"{n} long" for n in names), ("doc_id", "lang", "source"))


def _vector() -> list[Column]:
    share = lambda a, b: F.sqrt(F.col(a) / F.greatest(F.col(b), F.lit(1)))
    raw = [F.log1p("n_words"), F.log1p(F.col("word_chars") / F.greatest(F.col("n_words"), F.lit(1))), share("n_symbols", "word_chars"), share("n_dup_lines", "n_lines"), share("n_repeat_words", "n_words")]
    return [F.round(x * GRID).cast("long").alias(z) for x, z in zip(raw, _Z)]


def _key(level: Column, lang: Column, source: Column) -> Column:
    """The group's name in one string: level 2 is a language and source, 1 a language, 0 all rows. Null is a name of its own."""
    part = lambda c, least: F.when(level < least, "").otherwise(F.coalesce(F.concat(F.char_length(c).cast("string"), F.lit("+"), c), F.lit("-")))
    return F.concat(level.cast("string"), F.lit(":"), part(lang, 1), F.lit(":"), part(source, 2))


def _sums() -> list[Column]:
    """Count, sums and sums of products: exact integers, for up to 2e10 rows in a bin."""
    return [F.count("*").alias("n"), *[F.sum(z).alias(s) for z, s in zip(_Z, _S)], *[F.sum(F.col(_Z[i]) * F.col(_Z[j])).alias(p) for (i, j), p in zip(_PAIRS, _P)]]


def _floor() -> np.ndarray:
    return np.diag((np.array(TOLERANCE) * GRID) ** 2)


def _inverted(spread: np.ndarray) -> tuple[list[float], float]:
    """The inverse's upper triangle and the logarithm of the determinant."""
    inverse = np.linalg.inv(spread)
    return [float(inverse[i, j]) for i, j in _PAIRS], float(np.linalg.slogdet(spread)[1])


def _moments(row: dict) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance from the sums of a group."""
    mean, second = np.array([row[s] for s in _S], float) / row["n"], np.zeros((_D, _D))
    for (i, j), p in zip(_PAIRS, _P):
        second[i, j] = second[j, i] = row[p] / row["n"]
    return mean, second - np.outer(mean, mean)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["key", "start", "half", "logdet", *_M, *_V]).astype({"start": "int32", "half": "int32"})


def _estimate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The estimate of each group and start, from sums over its half."""
    for pdf in batches:
        out = []
        for row in pdf.to_dict("records"):
            mean, spread = _moments(row)
            inverse, logdet = _inverted(spread + _floor())
            out.append((row["key"], row["start"], row["half"], logdet, *mean, *inverse))
        yield _frame(out)


def _begin(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """STARTS estimates of each group, from its medians (med), median deviations (mad) and sums."""
    for pdf in batches:
        out = []
        for row in pdf.to_dict("records"):
            mean, spread = _moments(row)
            med, mad = np.array(row["med"], float), 1.4826 * np.array(row["mad"], float)
            for k, (m, s) in enumerate([(med, 0 * spread), (med, np.diag(mad**2)), (mean, spread), (med, spread)]):
                inverse, logdet = _inverted(s + _floor())
                out.append((row["key"], k, 0, logdet, *m, *inverse))
        yield _frame(out)


def _distance() -> Column:
    d = [F.col(z) - F.col(m) for z, m in zip(_Z, _M)]
    terms = [d[i] * d[j] * F.col(v) * (1.0 if i == j else 2.0) for (i, j), v in zip(_PAIRS, _V)]
    return sum(terms[1:], terms[0])


def _bin(distance: Column) -> Column:
    return F.floor(F.log2(F.greatest(distance, F.lit(1e-6))) * _BINS).cast("int")


def _step(joined: DataFrame) -> DataFrame:
    """One concentration step of rows joined with estimates: the estimates that follow. half is the bin that half of the rows reach."""
    bins = joined.select("key", "start", _bin(_distance()).alias("bin"), *_Z).groupBy("key", "start", "bin").agg(*_sums())
    group = Window.partitionBy("key", "start")
    placed = bins.withColumns({"_before": F.sum("n").over(group.orderBy("bin")) - F.col("n"), "_all": F.sum("n").over(group)})
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).cast("double").alias(c) for c in ("n", *_S, *_P)]
    return placed.where("2 * _before < _all").groupBy("key", "start").agg(F.max("bin").alias("half"), *exact).mapInPandas(_estimate, _ESTIMATE)


def estimates(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The estimate with scale of each group. rows: key and vector; groups: key and _n, the number of its rows.

    One row per key: key, the mean m*, the inverse covariance's upper triangle v*, logdet and scale.
    """
    keys, total = groups.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    meet = lambda side: join_keyed(rows, side.join(groups, "key"), "key", keys, total)
    middle = lambda x: F.percentile(x, 0.5)  # noqa: E731 - exact; a group has at most some 20,000 different values on the grid
    named = meet(groups.select("key")).drop("_n")
    med = cut(named.groupBy("key").agg(F.array(*[middle(z) for z in _Z]).alias("med")), "medians")
    around = [middle(F.abs(F.col(z) - F.element_at("med", i + 1))) for i, z in enumerate(_Z)]
    begin = meet(med).groupBy("key").agg(F.first("med").alias("med"), F.array(*around).alias("mad"), *_sums())
    now = cut(begin.mapInPandas(_begin, _ESTIMATE), "starts")
    for _ in range(FIRST_STEPS):
        now = cut(_step(meet(now)), "step")
    fields = [c.split()[0] for c in _ESTIMATE.split(", ")]
    best = cut(now.groupBy("key").agg(F.min(F.struct("logdet", "start", *[c for c in fields if c not in ("key", "logdet", "start")])).alias("b")).select("key", "b.*").select(*fields), "best")
    settled = []
    for n in range(MOST_STEPS):
        after = _step(meet(best)).select("key", F.col("half").alias("_half"), F.struct(*fields[2:]).alias("_after"))
        # The step's half belongs to the estimate it began with, which stays if the determinant no longer falls.
        falls = (F.col("_after.logdet") < F.col("logdet") - SETTLED) & F.lit(n < MOST_STEPS - 1)
        judged = cut(best.drop("half").join(after, "key").withColumn("_falls", falls), "judged")
        settled.append(judged.where("not _falls").select("key", F.col("_half").alias("half"), "logdet", *_M, *_V))
        falling = judged.where("_falls")
        if falling.isEmpty():
            break
        best = falling.select("key", "start", "_after.*").select(*fields)
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    # Make the median distance that of a chi-squared variable; never below one tolerance.
    return out.withColumn("scale", F.greatest(F.lit(1.0), F.pow(F.lit(2.0), (F.col("half") + 1) / F.lit(float(_BINS))) / F.lit(MEDIAN))).drop("half")


def judge(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, distance (squared, scaled; null without an estimate) and kept of every document."""
    with scratch(docs.sparkSession) as keep:
        failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
        rows = keep(cut(statistics(docs).select("*", *_vector(), failed.alias("base_failed")), "statistics"))
        passed = rows.where("not base_failed")
        # The level on which each group is large enough, from one row a group.
        sizes = cut(rows.groupBy("lang", "source").agg(F.count("*").alias("n_all"), F.count_if(~F.col("base_failed")).alias("n")), "sizes")
        by_lang = sizes.groupBy(F.col("lang").alias("_l")).agg(F.sum("n").alias("n_lang"))
        level = F.when(F.col("n") >= LEAST_ROWS, 2).when(F.col("n_lang") >= LEAST_ROWS, 1).otherwise(0)
        own = _key(F.lit(2), F.col("lang"), F.col("source"))
        placed = sizes.join(by_lang, sizes["lang"].eqNullSafe(by_lang["_l"])).withColumn("level", level)
        placed = cut(placed.select(own.alias("key"), _key(F.col("level"), F.col("lang"), F.col("source")).alias("of"), "lang", "n_all", "n", "n_lang", "level"), "placed")
        total = placed.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        groups = placed.where("level = 2").select("key", F.col("n").alias("_n"))
        members = [passed.select(own.alias("key"), *_Z)]
        # Languages and all rows only where a small group needs them; they are estimated over all their rows.
        langs = placed.where("level = 1").select(F.col("of").alias("key"), F.col("n_lang").alias("_n")).distinct()
        if not langs.isEmpty():
            groups = groups.unionByName(langs)
            members.append(passed.select(_key(F.lit(1), F.col("lang"), F.col("source")).alias("key"), *_Z))
        if total >= LEAST_ROWS and not placed.where("level = 0").isEmpty():
            groups = groups.unionByName(placed.sparkSession.range(1).select(_key(F.lit(0), F.lit(None).cast("string"), F.lit(None).cast("string")).alias("key"), F.lit(total).cast("long").alias("_n")))
            members.append(passed.select(_key(F.lit(0), F.col("lang"), F.col("source")).alias("key"), *_Z))
        every = members[0]
        for m in members[1:]:
            every = every.unionByName(m)
        fitted = cut(estimates(every, cut(groups, "groups")), "fitted")
        chosen = keep(cut(placed.join(fitted.withColumnRenamed("key", "of"), "of", "left").select("key", F.col("n_all").alias("_n"), "scale", *_M, *_V), "chosen"))
    keys, n_rows = chosen.agg(F.count("*"), F.coalesce(F.sum("_n"), F.lit(0))).first()
    joined = join_keyed(rows.withColumn("key", own), chosen, "key", keys, n_rows)
    distance = F.when(F.col("scale").isNotNull(), _distance() / F.col("scale"))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", distance.alias("distance"), (~F.col("base_failed") & (F.coalesce(distance, F.lit(0.0)) <= LIMIT)).alias("kept"))
