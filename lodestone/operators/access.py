"""Who may see which chunk: tags overlap and the chunk's ordinal is within the clearance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.vocabulary import TAGS


def tag_mask(tags: Column) -> Column:
    """The tags as bits of a long; tags outside the vocabulary have none."""
    return sum((F.when(F.array_contains(tags, t), F.lit(1 << i)).otherwise(0) for i, t in enumerate(TAGS)), F.lit(0)).cast("long")


def visible_to(tags: Column, ordinal: Column, user_tags: list[str], clearance: int) -> Column:
    """Predicate for one principal; no tags see nothing."""
    return F.coalesce(F.arrays_overlap(tags, F.array(*map(F.lit, user_tags)).cast("array<string>")), F.lit(False)) & (ordinal <= clearance)


def _group(mask: Column, clearance: Column) -> Column:
    """The number of a group of principals: their tags as bits and their clearance."""
    return (mask * 4 + clearance).cast("int")


def acl_members(users: DataFrame) -> DataFrame:
    """user_id and acl_group: principals of equal tags and clearance see the same, so they are one group; without tags there is none."""
    mask = tag_mask(F.col("permission_tags"))
    return users.where(mask != 0).select("user_id", _group(mask, F.col("clearance_level")).alias("acl_group"))


def _classed(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", _group(tag_mask(F.col("acl_tags")), F.col("sensitivity_ordinal")).alias("acl_class"))


def acl_grants(chunks: DataFrame, users: DataFrame) -> DataFrame:
    """(acl_group, acl_class): which classes of chunks each group of acl_members may see.

    A class is the tags and the ordinal of a chunk. There are at most 2**tags times 3 of each, whatever the number of chunks and users.
    """
    groups = acl_members(users).select("acl_group").distinct()
    classes = _classed(chunks).select("acl_class").distinct()
    bits = lambda c: F.explode(F.filter(F.array(*[F.lit(1 << i) for i in range(len(TAGS))]), lambda b: F.shiftright(c, 2).bitwiseAND(b) != 0)).alias("bit")
    met = classes.select("acl_class", bits("acl_class")).join(groups.select("acl_group", bits("acl_group")), "bit")
    return met.where("(acl_class & 3) <= (acl_group & 3)").select("acl_group", "acl_class").distinct()


def acl_filter(chunks: DataFrame, users: DataFrame) -> DataFrame:
    """(chunk_id, acl_class) of every chunk that some user may see: one row for a chunk, however many groups see it. See acl_grants.

    Chunks aren't shuffled; the classes that are granted, at most 2**tags times 3, are broadcast.
    """
    granted = acl_grants(chunks, users).select("acl_class").distinct()
    return _classed(chunks).join(F.broadcast(granted), "acl_class", "left_semi").select("chunk_id", "acl_class")


def acl_links(chunks: DataFrame, users: DataFrame) -> DataFrame:
    """(acl_group, chunk_id) of all chunks that each group of acl_members may see: the pairs of acl_pairs with users of equal rights as one.

    Chunks aren't shuffled: each meets the groups of its class, which are broadcast (at most 2**tags times 3 of both).
    """
    return _classed(chunks).join(F.broadcast(acl_grants(chunks, users)), "acl_class").select("acl_group", "chunk_id")


def acl_pairs(chunks: DataFrame, users: DataFrame) -> DataFrame:
    """(user_id, chunk_id) of all permitted pairs: as many rows as users see chunks, for small tables and tests."""
    grants = acl_members(users).join(F.broadcast(acl_grants(chunks, users)), "acl_group")
    return acl_filter(chunks, users).join(grants, "acl_class").select("user_id", "chunk_id")


def visibility_matrix(chunks: DataFrame, users: DataFrame) -> DataFrame:
    """user_id, sensitivity_ordinal, n_chunks: what each principal can see at each level."""
    groups = users.select("user_id", F.array_sort(F.array_distinct("permission_tags")).alias("tags"), "clearance_level")
    wants = groups.select("tags", "clearance_level").distinct().withColumn("mask", tag_mask(F.col("tags")))
    # Chunks collapse to counts by (mask, ordinal): at most 128 * 3 rows meet the groups.
    counts = chunks.groupBy(tag_mask(F.col("acl_tags")).alias("chunk_mask"), "sensitivity_ordinal").agg(F.count("*").alias("n"))
    bits = counts.withColumn("bit", F.explode(F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(len(TAGS))]), lambda b: F.col("chunk_mask").bitwiseAND(b) != 0)))
    user_bits = wants.withColumn("bit", F.explode(F.filter(F.array(*[F.lit(1 << i).cast("long") for i in range(len(TAGS))]), lambda b: F.col("mask").bitwiseAND(b) != 0)))
    seen = bits.join(user_bits, "bit").where("sensitivity_ordinal <= clearance_level").select("tags", "clearance_level", "chunk_mask", "sensitivity_ordinal", "n").distinct()
    return seen.groupBy("tags", "clearance_level", "sensitivity_ordinal").agg(F.sum("n").alias("n_chunks")).join(groups, ["tags", "clearance_level"]).select("user_id", "sensitivity_ordinal", "n_chunks")


def resolve_principals(requests: DataFrame, users: DataFrame) -> DataFrame:
    """request_id, user_id, tags and clearance from the users table; reason unknown or inactive otherwise."""
    u = users.select("user_id", "permission_tags", "clearance_level", "is_active")
    reason = F.when(F.col("is_active").isNull(), "unknown").when(~F.col("is_active"), "inactive")
    ok = reason.isNull()
    return requests.select("request_id", "user_id").join(u, "user_id", "left").select("request_id", "user_id", reason.alias("reason"), F.when(ok, F.col("permission_tags")).alias("permission_tags"), F.when(ok, F.col("clearance_level")).alias("clearance_level"))
