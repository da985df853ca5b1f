"""Sessions, documents, users and phrases as tables; changes give new snapshots."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions.text import strip
from lodestone.functions.vocabulary import DEFAULT_ORDINAL, LEVELS, PHRASE_LENGTH, PHRASES_PER_USER, TAGS, TITLE_LENGTH
from lodestone.operators.ingest import ordinal
from lodestone.sources.shared import at_rest, shared_folder


def sessions_list(sessions: DataFrame, messages: DataFrame, limit: int = 50) -> DataFrame:
    """user_id, session_id, updated_at, n_messages, position: each user's latest sessions."""
    n = messages.groupBy("session_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("user_id").orderBy(F.col("updated_at").desc(), "session_id")
    return sessions.join(n, "session_id", "left").select("user_id", "session_id", "updated_at", F.coalesce("n", F.lit(0)).alias("n_messages"), F.row_number().over(w).alias("position")).where(F.col("position") <= limit)


def session_detail(requests: DataFrame, sessions: DataFrame, messages: DataFrame) -> DataFrame:
    """request_id, position, message_id, role of the messages of sessions that the requester owns."""
    owned = requests.join(sessions.select("session_id", "user_id"), ["session_id", "user_id"]).select("request_id", "session_id")
    w = Window.partitionBy("request_id").orderBy("created_at", "message_id")
    return owned.join(messages, "session_id").select("request_id", F.row_number().over(w).alias("position"), "message_id", "role")


def session_titles(messages: DataFrame, length: int = 30) -> DataFrame:
    """session_id, title from the first user message."""
    first = messages.where("role = 'user'").groupBy("session_id").agg(F.min_by("content", F.struct("created_at", "message_id")).alias("q"))
    return first.select("session_id", F.concat(strip(F.substring("q", 1, length)), F.when(F.length("q") > length, "…").otherwise("")).alias("title"))


def cascade_delete(parents: DataFrame, children: DataFrame, deleted: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Both tables without the deleted keys."""
    gone = deleted.select(key).distinct()
    return parents.join(gone, key, "left_anti"), children.join(gone, key, "left_anti")


def delete_users(deleted: DataFrame, tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables after these users (user_id) are gone.

    users, sessions, memories and phrases lose their rows, messages those of lost sessions; documents
    stay, with uploaded_by null. Tables that aren't given are left out.
    """
    gone = deleted.select("user_id").distinct()
    out = {name: df.join(gone, "user_id", "left_anti") for name, df in tables.items() if name not in ("messages", "documents")}
    if "messages" in tables:
        lost = tables["sessions"].join(gone, "user_id", "left_semi").select("session_id").distinct()
        out["messages"] = tables["messages"].join(lost, "session_id", "left_anti")
    if "documents" in tables:
        docs, who = tables["documents"], gone.select(F.col("user_id").alias("_gone"))
        left = docs.join(who, docs["uploaded_by"] == who["_gone"], "left").withColumn("uploaded_by", F.when(F.col("_gone").isNull(), F.col("uploaded_by"))).drop("_gone")
        out["documents"] = left.select(*docs.columns)
    return out


def page_ranges(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """docs in ranges of about equal size, newest (created_at, then the highest id) first, with the range's number _part, for documents_page.

    The ranges are written once, a folder each, so a page reads those that it lies in.
    """
    order = [F.col("created_at").desc(), F.col("doc_id").desc()]
    dealt = (docs.repartitionByRange(parts, *order) if parts else docs.repartitionByRange(*order)).withColumn("_part", F.spark_partition_id())
    path = shared_folder(docs.sparkSession, "pages")
    dealt.write.partitionBy("_part").parquet(path)
    return docs.sparkSession.read.schema(dealt.schema).parquet(path)


def documents_page(docs: DataFrame, page: int, size: int) -> DataFrame:
    """One page of documents, newest (created_at, then the highest id) first, and total, the number of all documents. A page past the end is empty.

    docs, or their ranges (see page_ranges) if several pages are wanted. Ranges are counted, one number each; only those that
    the page lies in are read and sorted, however deep it is.
    """
    ranges = docs if "_part" in docs.columns else page_ranges(docs)
    begin, end, at, total, wanted = (page - 1) * size, page * size, 0, 0, []
    for part, n in sorted(ranges.groupBy("_part").count().collect()):
        if total < end and total + n > begin:
            at = at if wanted else total
            wanted.append(part)
        total += n
    rows = ranges.where(F.col("_part").isin(wanted)) if wanted else ranges.where(F.lit(False))
    found = rows.orderBy(F.col("created_at").desc(), F.col("doc_id").desc()).offset(max(0, begin - at)).limit(size)
    return found.drop("_part").withColumn("total", F.lit(total).cast("long"))


def visible_docs(docs: DataFrame, hidden: DataFrame) -> DataFrame:
    """docs without those that a caller has hidden (doc_id); a hidden id without a document changes nothing."""
    return docs.join(hidden.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def _folded(patches: DataFrame, keys: list[str], fields: list[str], order: str = "patch_id", at: str | None = None) -> DataFrame:
    """One row for each key of many patches: _<field>, the last value that an applied patch gives it (null: none does), _applied, whether any was, _outcome, its or the last patch's, and _at, the latest time of an applied one.

    patches carry their outcome. Values are carried in aggregates by their patch number, so tasks fold their own
    patches before the shuffle and a key of any number of patches is a row from each of them.
    """
    ok = F.col("outcome") == "applied"
    last = [F.max_by(f, F.when(ok & F.col(f).isNotNull(), F.col(order))).alias(f"_{f}") for f in fields]
    times = [F.max(F.when(ok, F.col(at))).alias("_at")] if at else []
    any_ = F.coalesce(F.bool_or(ok), F.lit(False))
    return patches.groupBy(*keys).agg(*last, *times, any_.alias("_applied"), F.when(any_, F.lit("applied")).otherwise(F.max_by("outcome", order)).alias("_outcome"))


def _timed(patches: DataFrame) -> str | None:
    return "patched_at" if "patched_at" in patches.columns else None


def _touched(rows: DataFrame, fields: list[str], timed: bool) -> list:
    """The fields after the fold, and updated_at if there is one."""
    out = [F.when(F.col("_applied"), F.coalesce(f"_{f}", f)).otherwise(F.col(f)).alias(f) for f in fields]
    if timed and "updated_at" in rows.columns:
        out.append(F.when(F.col("_applied"), F.greatest("updated_at", "_at")).otherwise(F.col("updated_at")).alias("updated_at"))
    return out


def _judged_permissions(patches: DataFrame) -> DataFrame:
    tags, level = F.col("acl_tags"), F.col("sensitivity_level")
    unknown = (F.size(F.array_except(tags, F.array(*map(F.lit, TAGS)))) > 0) | ~level.isin(*LEVELS)
    return patches.withColumn("outcome", F.when(tags.isNull() & level.isNull(), "nothing").when(F.size(tags) == 0, "empty_tags").when(F.coalesce(unknown, F.lit(False)), "unknown_value").otherwise("applied"))


def permission_outcomes(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """patch_id, doc_id, outcome of each patch: applied, not_found, processing, nothing, empty_tags or unknown_value."""
    status = docs.select("doc_id", F.col("status").alias("_status"), F.lit(True).alias("_known"))
    known = _judged_permissions(patches).join(status, "doc_id", "left")
    outcome = F.when(F.col("_known").isNull(), "not_found").when(F.col("_status") == "processing", "processing").otherwise(F.col("outcome"))
    return known.select("patch_id", "doc_id", outcome.alias("outcome"))


def permission_patch(docs: DataFrame, patches: DataFrame) -> DataFrame:
    """doc_id, acl_tags, sensitivity_level, outcome, and updated_at if docs have it, of each patched document: one row whatever the number of its patches.

    patches: patch_id, doc_id, acl_tags, sensitivity_level, and patched_at if times are kept. They take effect in the order of
    patch_id, each field apart; a null leaves its field as it is, and a refused patch changes nothing. outcome is applied if any
    patch was, else why the last one wasn't (see permission_outcomes for each). See patch_chunks.
    """
    fields, at = ["acl_tags", "sensitivity_level"], _timed(patches)
    p = _folded(_judged_permissions(patches), ["doc_id"], fields, at=at)
    waiting = F.col("status") == "processing"
    joined = docs.join(p, "doc_id").withColumn("_applied", F.col("_applied") & ~F.coalesce(waiting, F.lit(False)))
    return joined.select("doc_id", *_touched(joined, fields, at is not None), F.when(waiting, "processing").otherwise(F.col("_outcome")).alias("outcome"))


def patch_chunks(chunks: DataFrame, patched: DataFrame) -> DataFrame:
    """chunks with the tags and ordinal of the documents of which a patch was applied, so that retrieval follows the documents.

    patched has one row for each document (see permission_patch), so a chunk stays one row.
    """
    p = patched.where("outcome = 'applied'").select(F.col("doc_id").alias("_doc"), F.col("acl_tags").alias("_tags"), ordinal(F.col("sensitivity_level")).alias("_ordinal"))
    joined = chunks.join(p, chunks["document_id"] == p["_doc"], "left")
    joined = joined.withColumn("acl_tags", F.coalesce("_tags", "acl_tags")).withColumn("sensitivity_ordinal", F.coalesce("_ordinal", "sensitivity_ordinal"))
    return joined.select(*chunks.columns)


def permission_consistency(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, document_id of chunks whose copied permissions differ from their document's."""
    d = docs.select(F.col("doc_id").alias("document_id"), F.col("acl_tags").alias("_t"), ordinal(F.col("sensitivity_level")).alias("_o"))
    return chunks.join(d, "document_id").where((F.array_sort("acl_tags") != F.array_sort("_t")) | (F.col("sensitivity_ordinal") != F.col("_o"))).select("chunk_id", "document_id")


def backfill_ordinals(chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """chunk_id, sensitivity_ordinal from the document's level; unknown levels and documents have the default."""
    d = docs.select(F.col("doc_id").alias("document_id"), ordinal(F.col("sensitivity_level")).alias("_o"))
    return chunks.select("chunk_id", "document_id").join(d, "document_id", "left").select("chunk_id", F.coalesce("_o", F.lit(DEFAULT_ORDINAL)).alias("sensitivity_ordinal"))


def backfill_users(users: DataFrame) -> DataFrame:
    """users with the tag all (appended last) and clearance of at least 1."""
    tags = F.when(F.array_contains("permission_tags", "all"), F.col("permission_tags")).otherwise(F.array_append("permission_tags", F.lit("all")))
    return users.withColumn("permission_tags", tags).withColumn("clearance_level", F.greatest("clearance_level", F.lit(1)))


def permission_diff(users: DataFrame, drafts: DataFrame) -> DataFrame:
    """user_id of users whose draft differs in tags (compared without order), clearance, is_admin or is_active."""
    fields = ("clearance_level", "is_admin", "is_active")
    d = drafts.select("user_id", F.array_sort("permission_tags").alias("_tags"), *[F.col(c).alias(f"_{c}") for c in fields])
    same = F.array_sort("permission_tags").eqNullSafe(F.col("_tags"))
    for c in fields:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    return users.join(d, "user_id").where(~same).select("user_id")


def _judged_users(patches: DataFrame, actor: int) -> DataFrame:
    bad = F.coalesce(F.size(F.array_except("permission_tags", F.array(*map(F.lit, TAGS)))) > 0, F.lit(False)) | F.coalesce(~F.col("clearance_level").between(0, 2), F.lit(False))
    return patches.withColumn("outcome", F.when(bad, "unknown_value").when((F.col("user_id") == actor) & F.coalesce(~F.col("is_admin"), F.lit(False)), "self_demotion").otherwise("applied"))


def user_outcomes(users: DataFrame, patches: DataFrame, actor: int) -> DataFrame:
    """patch_id, user_id, outcome of each patch: applied, not_found, unknown_value or self_demotion."""
    known = _judged_users(patches, actor).join(users.select("user_id", F.lit(True).alias("_known")), "user_id", "left")
    return known.select("patch_id", "user_id", F.when(F.col("_known").isNull(), "not_found").otherwise(F.col("outcome")).alias("outcome"))


def user_patch(users: DataFrame, patches: DataFrame, actor: int) -> DataFrame:
    """user_id, permission_tags, clearance_level, is_admin, is_active, outcome of each patched user, one row whatever the number of patches.

    Patches take effect in the order of patch_id, each field apart; null in a patch leaves a field as it is. outcome as in permission_patch.
    """
    fields = ["permission_tags", "clearance_level", "is_admin", "is_active"]
    joined = users.join(_folded(_judged_users(patches, actor), ["user_id"], fields), "user_id")
    return joined.select("user_id", *_touched(joined, fields, False), F.col("_outcome").alias("outcome"))


def register_users(requests: DataFrame, users: DataFrame) -> DataFrame:
    """username with the defaults of new users; taken names and all but the first request for a name are refused."""
    w = Window.partitionBy("username").orderBy("request_id")
    first = requests.withColumn("_n", F.row_number().over(w)).where("_n = 1")
    fresh = first.join(users.select("username").distinct(), "username", "left_anti")
    return fresh.select("request_id", "username", F.array(F.lit("all")).alias("permission_tags"), F.lit(0).alias("clearance_level"), F.lit(False).alias("is_admin"), F.lit(True).alias("is_active"))


def users_list(users: DataFrame, parts: int | None = None) -> DataFrame:
    """Newest first by position, numbered range by range: a task sorts one range, and one row for each range is ordered in one place."""
    order = [F.col("created_at").desc(), F.col("user_id")]
    few = users.select("user_id", "clearance_level", "created_at")
    dealt = few.repartitionByRange(parts, *order) if parts else few.repartitionByRange(*order)
    ranges = at_rest(dealt.withColumn("_part", F.spark_partition_id()), "users")
    rows = ranges.withColumn("_own", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row for each range.
    starts = ranges.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", before.alias("_before"))
    return rows.join(F.broadcast(starts), "_part").select("user_id", "clearance_level", (F.col("_own") + F.col("_before")).cast("int").alias("position"))


def phrases_list(phrases: DataFrame) -> DataFrame:
    """user_id, position, phrase_id by sort order, then time."""
    w = Window.partitionBy("user_id").orderBy("sort_order", "created_at", "phrase_id")
    return phrases.select("user_id", F.row_number().over(w).alias("position"), "phrase_id", "content")


def phrases_append(phrases: DataFrame, requests: DataFrame, cap: int = PHRASES_PER_USER) -> DataFrame:
    """request_id, user_id, content, sort_order of accepted phrases: stripped, 1 to 200 characters, at most cap a user."""
    n = phrases.groupBy("user_id").agg(F.count("*").alias("n"))
    r = requests.withColumn("content", strip(F.col("content"))).where(F.length("content").between(1, PHRASE_LENGTH))
    place = F.coalesce("n", F.lit(0)) + F.row_number().over(Window.partitionBy("user_id").orderBy("request_id")) - 1
    return r.join(n, "user_id", "left").withColumn("sort_order", place).where(F.col("sort_order") < cap).select("request_id", "user_id", "content", "sort_order")


def percent(stage, processed, total):
    """Progress of a document by stage."""
    part = lambda low, span, top: F.when(total == 0, low).otherwise(F.least(F.lit(top), low + F.floor(span * processed / total)))
    return F.when(stage == "done", 100).when(stage == "failed", 0).when(stage == "parsing", part(F.lit(2), 12, 14)).when(stage == "chunking", 15).when(stage == "embedding", part(F.lit(20), 70, 90)).when(stage == "storing", 93).otherwise(2).cast("int")


def progress_percent(rows: DataFrame) -> DataFrame:
    return rows.withColumn("percent", percent(F.col("stage"), F.col("processed"), F.col("total")))


def progress_latest(events: DataFrame) -> DataFrame:
    """doc_id with the stage, counts and percent of its last event."""
    last = events.groupBy("doc_id").agg(F.max_by(F.struct("stage", "processed", "total"), F.struct("ts", "event_id")).alias("s")).select("doc_id", "s.*")
    return progress_percent(last)


def stage_text(rows: DataFrame) -> DataFrame:
    """rows with a label for people."""
    counts = F.format_string("%s (%d/%d)", F.initcap("stage"), F.col("processed"), F.col("total"))
    return rows.withColumn("label", F.when(F.col("stage").isin("parsing", "embedding"), counts).otherwise(F.initcap("stage")))


def progress_throttle(events: DataFrame, step: int = 5) -> DataFrame:
    """doc_id, event_id, percent of the updates to forward: step points above the last one forwarded, or the final page.

    A fold over the events of each document in order, streamed through sorted partitions: the state is one number.
    """

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last = None, None
        for batch in batches:
            keep = []
            for i, (doc, percent, final) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("doc_id", "percent", "final")])):
                if doc != at or last is None or percent - last >= step or final:
                    at, last = doc, percent
                    keep.append(i)
            yield batch.select(["doc_id", "event_id", "percent"]).take(pa.array(keep, pa.int64()))

    rows = events.select("doc_id", "event_id", "percent", (F.col("processed") >= F.col("total")).alias("final"), "ts")
    return rows.repartition("doc_id").sortWithinPartitions("doc_id", "ts", "event_id").mapInArrow(fold, "doc_id long, event_id long, percent int")


def _judged_renames(renames: DataFrame) -> DataFrame:
    r = renames.withColumn("title", strip(F.col("new_title")))
    return r.withColumn("outcome", F.when(F.coalesce(F.length("title").between(1, TITLE_LENGTH), F.lit(False)), "applied").otherwise("bad_title"))


def rename_outcomes(sessions: DataFrame, renames: DataFrame) -> DataFrame:
    """patch_id, session_id, outcome of each rename: applied, bad_title, or not_found for sessions that don't exist or that the requester doesn't own."""
    owned = sessions.select("session_id", "user_id", F.lit(True).alias("_owned"))
    known = _judged_renames(renames).join(owned, ["session_id", "user_id"], "left")
    return known.select("patch_id", "session_id", F.when(F.col("_owned").isNull(), "not_found").otherwise(F.col("outcome")).alias("outcome"))


def session_patch(sessions: DataFrame, renames: DataFrame, messages: DataFrame) -> DataFrame:
    """session_id, title, updated_at of every session: the last valid title (1 to 200 characters, stripped) that its owner gave it, and the time of the last message or rename.

    renames: patch_id (their order), session_id, user_id (who asks), new_title, and patched_at if times are kept.
    """
    at = _timed(renames)
    r = _folded(_judged_renames(renames), ["session_id", "user_id"], ["title"], at=at)
    m = messages.groupBy("session_id").agg(F.max("created_at").alias("_message"))
    joined = sessions.join(r, ["session_id", "user_id"], "left").join(m, "session_id", "left")
    times = [F.col("updated_at"), F.col("_message"), *([F.col("_at")] if at else [])]
    return joined.select("session_id", F.coalesce("_title", "title").alias("title"), F.greatest(*times).alias("updated_at"))


def backfill_progress(docs: DataFrame) -> DataFrame:
    """docs where finished documents without progress count as wholly processed."""
    stuck = (F.col("status") == "done") & (F.col("processed_chunks") == 0) & (F.col("total_chunks") > 0)
    return docs.withColumn("processed_chunks", F.when(stuck, F.col("total_chunks")).otherwise(F.col("processed_chunks")))


def vocab_tables(spark: SparkSession) -> DataFrame:
    """vocabulary, value, ordinal: the allowed tags with their place in the list, levels and clearance labels with their ordinals."""
    rows = [("acl_tag", t, n) for n, t in enumerate(TAGS)] + [(kind, name, n) for kind in ("sensitivity_level", "clearance_level") for name, n in LEVELS.items()]
    return spark.createDataFrame(rows, "vocabulary string, value string, ordinal int")


def vocab_usage(docs: DataFrame, users: DataFrame | None = None) -> DataFrame:
    """vocabulary, value, ordinal, n: documents that carry each allowed tag or level, with users (clearance_level) those of each clearance; 0 for unused ones."""
    tags = docs.select(F.lit("acl_tag").alias("vocabulary"), F.explode(F.array_distinct("acl_tags")).alias("value"))
    levels = docs.select(F.lit("sensitivity_level").alias("vocabulary"), F.col("sensitivity_level").alias("value"))
    n = tags.unionByName(levels).groupBy("vocabulary", "value").agg(F.count("*").alias("n"))
    if users is None:
        allowed = vocab_tables(docs.sparkSession).where("vocabulary <> 'clearance_level'")
        return allowed.join(n, ["vocabulary", "value"], "left").select("vocabulary", "value", "ordinal", F.coalesce("n", F.lit(0)).alias("n"))
    clearance = F.create_map(*[x for name, o in LEVELS.items() for x in (F.lit(o), F.lit(name))])
    of_users = users.groupBy("clearance_level").agg(F.count("*").alias("n")).select(F.lit("clearance_level").alias("vocabulary"), F.element_at(clearance, F.col("clearance_level")).alias("value"), "n")
    return vocab_tables(docs.sparkSession).join(n.unionByName(of_users), ["vocabulary", "value"], "left").select("vocabulary", "value", "ordinal", F.coalesce("n", F.lit(0)).alias("n"))
