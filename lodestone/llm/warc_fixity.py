"""WARC fixity by Merkle trees.

Each record of an archive file is hashed; ordered offset ranges of RANGES bytes, then files, then
runs of files are hashed over their children in order, up to one root. Two replicas with equal roots are
equal. Otherwise the audit goes down level by level, and at each level looks only at the children
of nodes that differ, down to the records.

All trees are built from the bottom, one small aggregation and table a level; a node has a bounded number of
children (those in its offset range, or FAN_OUT files), so no group grows with the archive. Offsets in a
file are sums in two steps, over blocks of one id and PREFIX digits of the hash, so that an id of any number of records isn't one task's.

Cases: a replica without any record reports every record of the other as missing; an empty url or html is an empty
body, null likewise; records with null ids lie in files of their own (negative numbers);
repeated records have offsets of their own; empty replicas are equal; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import cut, scratch

#: Bytes of the offset ranges, from the smallest.
RANGES = (1 << 16, 1 << 20, 1 << 24)
FAN_OUT = 256
#: Levels above the files: runs of FAN_OUT and FAN_OUT**2 files, and the root.
FILES = (FAN_OUT, FAN_OUT**2)
PAGES_PER_FILE = 1000
PREFIX = 3


def record(page_id: Column, url: Column, body: Column) -> Column:
    """A WARC response record as text."""
    size = F.octet_length(body).cast("string")
    return F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def archive(pages: DataFrame, stored: Column | None = None) -> DataFrame:
    """page_id, file, position, length, hash of pages written as records of numbered files; position is the offset in its file.

    With stored, the body of each page as another replica holds it (null: lost), also stored_hash: the
    hash of the record that lies there at the same place.
    """
    sha = lambda body: F.sha2(record(F.col("page_id"), F.col("url"), body).cast("binary"), 256)
    file = F.when(F.col("page_id").isNull(), -1 - F.pmod(F.xxhash64("url", "html"), F.lit(1 << 20))).otherwise(F.floor(F.col("page_id") / PAGES_PER_FILE))
    body = F.coalesce("html", F.lit(""))
    other = F.lit(None).cast("string") if stored is None else F.when(stored.isNotNull(), sha(stored))
    rows = pages.select("page_id", file.cast("long").alias("file"), F.octet_length(record(F.col("page_id"), F.col("url"), body)).cast("long").alias("length"), sha(body).alias("hash"), other.alias("stored_hash"))
    # Equal records are one row with a number; only lengths and hashes go on from here.
    once = cut(rows.groupBy(*rows.columns).agg(F.count("*").alias("n")), "records").withColumn("block", F.substring("hash", 1, PREFIX))
    before = lambda w, x: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    size = F.col("n") * F.col("length")
    blocks = once.groupBy("file", "page_id", "block").agg(F.sum(size).alias("size"))
    blocks = blocks.select(F.col("file").alias("f"), F.col("page_id").alias("p"), F.col("block").alias("b"), before(Window.partitionBy("file").orderBy(F.col("page_id").asc_nulls_last(), "block"), "size").alias("base"))
    placed = once.withColumn("inner", before(Window.partitionBy("file", "page_id", "block").orderBy("hash"), size))
    placed = placed.join(blocks, (placed["file"] == blocks["f"]) & placed["page_id"].eqNullSafe(blocks["p"]) & (placed["block"] == blocks["b"]))
    copies = placed.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    position = (F.col("base") + F.col("inner") + F.col("copy") * F.col("length")).cast("long")
    return copies.select("page_id", "file", position.alias("position"), "length", "hash", *([] if stored is None else ["stored_hash"]))


def _level(children: DataFrame, name: str, keys: list[Column], order: str) -> DataFrame:
    grouped = children.select("replica", *keys, F.struct(F.col(order).alias("o"), "hash").alias("c")).groupBy("replica", "a", "b").agg(F.sort_array(F.collect_list("c")).alias("cs"))
    text = F.array_join(F.transform("cs", lambda c: F.concat(c["o"].cast("string"), F.lit(":"), c["hash"])), ",")
    return grouped.select("replica", F.lit(name).alias("level"), "a", "b", F.sha2(text.cast("binary"), 256).alias("hash"))


def trees(records: DataFrame) -> list[DataFrame]:
    """Node tables from the smallest ranges up to the root: replica, level, a, b, hash.

    records: replica, file, position, hash. a and b name a node: file and range, or run of files.
    """
    out, below, order = [], records.select("replica", F.col("file").alias("a"), F.col("position").alias("b"), "hash"), 1
    for size in RANGES:
        step = size // order
        below = _level(below, f"range {size}", [F.col("a"), F.floor(F.col("b") / step).cast("long").alias("b")], "b")
        below = cut(below, "nodes")
        order = size
        out.append(below)
    below = cut(_level(below, "file", [F.col("a"), F.lit(0).cast("long").alias("b")], "b"), "nodes")
    out.append(below)
    order = 1
    for size in FILES:
        below = cut(_level(below, f"files {size}", [F.floor(F.col("a") / (size // order)).cast("long").alias("a"), F.lit(0).cast("long").alias("b")], "a"), "nodes")
        order = size
        out.append(below)
    out.append(_level(below, "root", [F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")], "a"))
    return out


def _differing(nodes: DataFrame) -> DataFrame:
    """Nodes whose hashes differ between the replicas or that only one has."""
    return nodes.groupBy("a", "b").agg(F.count_distinct("replica").alias("r"), F.count_distinct("hash").alias("h")).where("r < 2 or h > 1").select("a", "b")


def audit(first: DataFrame, second: DataFrame) -> DataFrame:
    """page_id, file, position, length and damage (changed, missing or extra in the second) of each differing record.

    Both: page_id, file, position, length, hash, positions as the index of the archive names them.
    """
    with scratch(first.sparkSession) as keep:
        records = first.withColumn("replica", F.lit(1)).unionByName(second.withColumn("replica", F.lit(2)))
        records = keep(cut(records.select("replica", "page_id", "file", "position", "length", "hash"), "records"))
        levels = trees(records)
        steps: list[tuple[Column, Column]] = [(F.col("a"), F.floor(F.col("b") / (hi // lo)).cast("long")) for lo, hi in zip(RANGES, RANGES[1:])]
        zero = F.lit(0).cast("long")
        steps += [(F.col("a"), zero), (F.floor(F.col("a") / FAN_OUT).cast("long"), zero), (F.floor(F.col("a") / FAN_OUT).cast("long"), zero), (zero, zero)]
        bad = cut(_differing(levels[-1]), "differing")
        if bad.isEmpty():
            # Equal roots: nothing below them is read.
            return records.limit(0).select("page_id", "file", "position", "length", F.lit("").alias("damage"))
        for nodes, (up_a, up_b) in zip(levels[-2::-1], steps[::-1]):
            parent = bad.select(F.col("a").alias("pa"), F.col("b").alias("pb"))
            inside = nodes.withColumns({"pa": up_a, "pb": up_b}).join(parent, ["pa", "pb"], "left_semi")
            bad = cut(_differing(inside), "differing")
        keep(bad)
    at = bad.select(F.col("a").alias("file"), F.col("b").alias("range"))
    inside = records.withColumn("range", F.floor(F.col("position") / RANGES[0]).cast("long")).join(at, ["file", "range"], "left_semi")
    # Records at one place are compared as sets of hashes, so a repeated record shows too.
    per = inside.groupBy("file", "position").agg(*[F.sort_array(F.collect_list(F.when(F.col("replica") == r, F.col("hash")))).alias(f"h{r}") for r in (1, 2)], F.max("page_id").alias("page_id"), F.max(F.when(F.col("replica") == 1, F.col("length"))).alias("l1"), F.max(F.when(F.col("replica") == 2, F.col("length"))).alias("l2"))
    damage = F.when(F.size("h2") == 0, "missing").when(F.size("h1") == 0, "extra").otherwise("changed")
    return per.where("h1 <> h2").select("page_id", "file", "position", F.coalesce("l1", "l2").alias("length"), damage.alias("damage"))


def damaged(page_id: Column, html: Column) -> Column:
    """The body of a page in a replica with known damage: of ids mod 101, 0 has its first character changed, 1 is cut to half, 2 is lost (null)."""
    rest, body = F.coalesce(page_id % 101, F.lit(100)), F.coalesce(html, F.lit(""))
    return F.when(rest == 0, F.concat(F.lit("?"), F.substring(body, 2, 1 << 30))).when(rest == 1, F.substring(body, F.lit(1), F.floor(F.length(body) / 2).cast("int"))).when(rest > 2, body)


def replicas(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The archive of pages and a replica with known damage, every record of either hashed."""
    both = cut(archive(pages, damaged(F.col("page_id"), F.col("html"))), "archive")
    place = ["page_id", "file", "position", "length"]
    return both.select(*place, "hash"), both.where("stored_hash is not null").select(*place, F.col("stored_hash").alias("hash"))


_RECORD = "'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' || strlen({0}) || chr(13) || chr(10) || chr(13) || chr(10) || {0} || chr(13) || chr(10) || chr(13) || chr(10)"
ORACLE = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS body, page_id % 101 AS rest FROM pages),
a AS (SELECT page_id, rest, page_id // {PAGES_PER_FILE} AS file, {_RECORD.format('body')} AS mine,
  CASE rest WHEN 0 THEN {_RECORD.format("('?' || substr(body, 2))")} WHEN 1 THEN {_RECORD.format("substr(body, 1, length(body) // 2)")} END AS theirs FROM p),
w AS (SELECT *, coalesce(sum(strlen(mine)) OVER (PARTITION BY file ORDER BY page_id, sha256(mine) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS position FROM a)
SELECT page_id, file::BIGINT AS file, position, strlen(mine)::BIGINT AS length, CASE WHEN rest = 2 THEN 'missing' ELSE 'changed' END AS damage
FROM w WHERE rest = 2 OR (rest < 2 AND mine <> theirs)
"""
