"""Places and runs along a group of any size.

Rows are dealt to ranges of (group, order) of about equal size, whatever the values are. Ranges are handled
apart and begin where the earlier ones of their group end, so a task sorts one range, and only one row
per range is ordered within a group. The ranges are written once, since both steps must see the same ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.sources.shared import at_rest


def _blocks(rows: DataFrame, group: str, order: str, parts: int | None) -> DataFrame:
    by = [F.col(group), F.col(order)]
    dealt = rows.repartitionByRange(parts, *by) if parts else rows.repartitionByRange(*by)
    return at_rest(dealt.withColumn("_block", F.spark_partition_id()), "ranges")


def _with_block(rows: DataFrame, blocks: DataFrame, group: str) -> DataFrame:
    """Rows with the columns of their block; null groups and null places are kept."""
    b = blocks.withColumnsRenamed({group: "_group", "_block": "_of"})
    return rows.join(b, rows[group].eqNullSafe(b["_group"]) & rows["_block"].eqNullSafe(b["_of"])).drop("_group", "_of", "_block")


def _earlier(column: str, group: str):
    """The sum over the earlier blocks of the group."""
    return F.coalesce(F.sum(column).over(Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def numbered(rows: DataFrame, group: str, order: str, name: str, parts: int | None = None) -> DataFrame:
    """rows with name: their place from 1 in the group by order, a whole number without ties."""
    cut = _blocks(rows, group, order, parts)
    blocks = cut.groupBy(group, "_block").agg(F.count("*").alias("_n"))
    blocks = blocks.select(group, "_block", _earlier("_n", group).alias("_before"))
    own = F.row_number().over(Window.partitionBy(group, "_block").orderBy(order))
    return _with_block(cut.withColumn(name, own), blocks, group).withColumn(name, F.col(name) + F.col("_before")).drop("_before")


def runs(rows: DataFrame, group: str, order: str, value: str, name: str, parts: int | None = None) -> DataFrame:
    """rows with name: from 0, the number of the run of equal values (null equals null) along order, a whole number without ties."""
    cut = _blocks(rows, group, order, parts)
    w = Window.partitionBy(group, "_block").orderBy(order)
    changed = (F.row_number().over(w) > 1) & ~F.col(value).eqNullSafe(F.lag(value).over(w))
    inner = cut.withColumn("_new", changed.cast("long"))
    at = F.struct(order, value)
    blocks = inner.groupBy(group, "_block").agg(F.sum("_new").alias("_inside"), F.min(at)[value].alias("_first"), F.max(at)[value].alias("_last"))
    by = Window.partitionBy(group).orderBy("_block")
    edge = (F.row_number().over(by) > 1) & ~F.col("_first").eqNullSafe(F.lag("_last").over(by))
    blocks = blocks.withColumn("_edge", edge.cast("long")).withColumn("_total", F.col("_edge") + F.col("_inside"))
    blocks = blocks.select(group, "_block", (_earlier("_total", group) + F.col("_edge")).alias("_before"))
    counted = inner.withColumn(name, F.sum("_new").over(w)).drop("_new")
    return _with_block(counted, blocks, group).withColumn(name, F.col(name) + F.col("_before")).drop("_before")
