"""Mixing sources to target weights, with DataFrame functions only.

The tokens of each source give its repetition rate (target over size). Each document is emitted
floor(rate) times and once more with probability rate - floor(rate), decided by a hash of its id.

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share 150 % of all
tokens; a target stops at twice its source's size and the excess is shared again by weight until
none is above. That fixed point is min(2 * size, level * weight) for one water level, which
windows over one row per source find without a loop.

Cases: a null or blank text has size 0, is emitted like the others and takes 0 words; a null source is a source of its own;
a source without words has target 0 and rate 0; a null id takes its coin from the text; rows with
the same id share one coin; an empty table gives an empty result; other columns pass untouched, whatever their
names, but one named like the number of the copy is replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import column, columns, cut, names

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CAP = 2.0
#: The table of targets is broadcast only below these; beyond, it is joined by a shuffle.
BROADCAST_ROWS = 10_000
BROADCAST_BYTES = 1 << 20


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, size) rows to (source, source_size, target): one row per source."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    by_ratio = Window.orderBy(F.col("source_size") / F.col("weight"), "rank")
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.lit(cap) * F.coalesce(F.sum("source_size").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) / F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    levels = ranked.withColumn("place", F.row_number().over(by_ratio)).withColumn("level", level)
    free = F.col("level") * F.col("weight") < F.lit(cap) * F.col("source_size")
    water = F.min(F.when(free, F.struct("place", "level"))).over(everything)
    found = levels.withColumn("water", water)
    return found.select("source", "source_size", F.when(F.col("place") >= F.col("water.place"), F.col("water.level") * F.col("weight")).otherwise(F.lit(cap) * F.col("source_size")).alias("target"))


def coin(doc_id: Column, text: Column | None = None, seed: str = "mix") -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 of the id."""
    key = F.coalesce(doc_id.cast("string"), F.lit("") if text is None else F.md5(text.cast("binary")), F.lit(""))
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def with_targets(sized: DataFrame, source: str, targets: DataFrame, size_name: str, target_name: str) -> DataFrame:
    """Adds the source's size and target under these names. The targets are broadcast only after their size was read."""
    (of,) = names([*sized.columns, size_name, target_name], "of_source")
    t = targets.select(F.col("source").alias(of), F.col("source_size").alias(size_name), F.col("target").alias(target_name))
    n, size = targets.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("source") + 24), F.lit(0))).first()
    if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES:
        t = F.broadcast(t)
    return sized.join(t, column(source).eqNullSafe(column(of))).drop(of)


def copies(u: Column, size: Column, target: Column) -> Column:
    """Emissions of a row whose source has this size and target, for a coin u."""
    rate = F.when(size > 0, target / size).otherwise(F.lit(0.0))
    return (F.floor(rate) + (u < rate - F.floor(rate)).cast("long")).cast("long")


def mix_plan(docs: DataFrame) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (copies * size) of every document."""
    sizes = cut(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), coin(F.col("doc_id"), F.col("text")).alias("u")), "sizes")
    joined = with_targets(sizes, "source", cut(source_targets(sizes), "targets"), "source_size", "target")
    n = copies(F.col("u"), F.col("source_size"), F.col("target"))
    return joined.select("doc_id", "source", "size", "source_size", "target", n.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))


def mix(docs: DataFrame, copy_column: str = "mix_copy") -> DataFrame:
    """The mixed corpus: every column of docs, one row per emission, numbered from 1 in copy_column."""
    kept = docs.select(*columns(docs, copy_column))
    targets = cut(source_targets(kept.select("source", word_count(F.col("text")).alias("size"))), "targets")
    size, target, n = names([*kept.columns, copy_column], "size", "target", "copies")
    joined = with_targets(kept, "source", targets, size, target)
    joined = joined.withColumn(n, copies(coin(F.col("doc_id"), F.col("text")), column(size), column(target)))
    return joined.where(column(n) > 0).select(*columns(kept), F.explode(F.sequence(F.lit(1), column(n).cast("int"))).alias(copy_column))


ORACLE = """
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS rank FROM s),
w AS (SELECT *, [5, 2, 1][rank % 3 + 1] AS weight FROM r),
l AS (SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, rank) AS place,
  (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2.0::DOUBLE * coalesce(sum(source_size) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE)
   / (sum(weight) OVER (ORDER BY source_size::DOUBLE / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM w),
f AS (SELECT min(place) AS place FROM l WHERE level * weight < 2.0::DOUBLE * source_size),
t AS (SELECT source, source_size, CASE WHEN place >= (SELECT place FROM f) THEN (SELECT l2.level FROM l l2, f WHERE l2.place = f.place) * weight ELSE 2.0::DOUBLE * source_size END AS target FROM l),
j AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
  ('0x' || substr(md5('mix:' || d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE AS u FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, ((floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT * size)::BIGINT AS taken FROM j
"""
