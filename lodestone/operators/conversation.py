"""Contexts, citations, histories and long-term memories."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.text import estimate_tokens_history, strip
from lodestone.functions.vocabulary import HISTORY_TOKENS, HISTORY_TURNS, MEMORY_CAP, MEMORY_K, MEMORY_LEAST, MEMORY_SIMILARITY
from lodestone.operators.tiles import meet, unit_vectors


def _joined(order: list[str], text: str, separator: str) -> Column:
    """The group's texts in order as one string."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(text).alias("_text")))), lambda x: x["_text"]), separator)


def context_assembly(ranked: DataFrame) -> DataFrame:
    """query_id, context of query_id, rank, source, page_number, section_title, content."""
    head = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] 📄 "), F.col("source"), F.lit("  第 "), F.coalesce(F.col("page_number").cast("string"), F.lit("—")), F.lit(" 页"), F.coalesce(F.concat(F.lit("  §"), F.col("section_title")), F.lit("")))
    items = ranked.withColumn("_item", F.concat(head, F.lit("\n"), strip(F.col("content"))))
    return items.groupBy("query_id").agg(_joined(["rank"], "_item", "\n\n---\n\n").alias("context"))


def extract_citations(answers: DataFrame, ranked: DataFrame, refusal: str = "no relevant content") -> DataFrame:
    """answer_id, ord, marker, chunk_id: markers [n] of one or two digits, each once, within the ranked chunks of the query."""
    numbers = F.array_distinct(F.transform(F.regexp_extract_all("answer", F.lit("\\[(\\d{1,2})\\]"), 1), lambda x: x.cast("int")))
    valid = answers.where(~F.col("answer").contains(refusal)).select("answer_id", "query_id", F.posexplode(numbers).alias("pos", "marker"))
    hit = valid.join(ranked.select("query_id", F.col("rank").alias("marker"), "chunk_id"), ["query_id", "marker"])
    return hit.withColumn("ord", F.row_number().over(Window.partitionBy("answer_id").orderBy("pos"))).select("answer_id", "ord", "marker", "chunk_id")


def citation_usage(citations: DataFrame, retrieved: DataFrame) -> DataFrame:
    """chunk_id, n_citations, n_answers, n_retrieved. retrieved: answer_id and chunk_id of the chunks that each answer was given, cited or not."""
    cited = citations.groupBy("chunk_id").agg(F.count("*").alias("n_citations"), F.count_distinct("answer_id").alias("n_answers"))
    given = retrieved.groupBy("chunk_id").agg(F.count_distinct("answer_id").alias("n_retrieved"))
    n = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return cited.join(given, "chunk_id", "full").select("chunk_id", n("n_citations"), n("n_answers"), n("n_retrieved"))


def frames_encode(events: DataFrame) -> DataFrame:
    """key, text of key, seq, type, data: frames in order."""
    e = events.withColumn("_frame", F.concat(F.lit("event: "), F.col("type"), F.lit("\ndata: "), F.col("data"), F.lit("\n\n")))
    return e.groupBy("key").agg(_joined(["seq"], "_frame", "").alias("text"))


def frames_parse(streams: DataFrame) -> DataFrame:
    """key, seq, type, data; frames without both parts and those whose data is no JSON are ignored."""
    f = streams.select("key", F.posexplode(F.split("text", "\n\n")).alias("seq", "frame"))
    f = f.select("key", "seq", F.regexp_extract("frame", "(?:^|\\n)event: ?([^\\n]+)", 1).alias("type"), F.regexp_extract("frame", "(?:^|\\n)data: ?([^\\n]+)", 1).alias("data"))
    return f.where((F.col("type") != "") & F.try_parse_json("data").isNotNull())


def answer_assembly(events: DataFrame, error_note: str = " [interrupted]") -> DataFrame:
    """key, content, citations, finish_reason: tokens in order, the last citation event, the done event's reason; empty ones go."""
    token = F.when(F.col("type") == "token", F.struct("seq", "data"))
    content = F.array_join(F.transform(F.array_sort(F.collect_list(token)), lambda x: x["data"]), "")
    failed = F.max((F.col("type") == "error").cast("int")) == 1
    out = events.groupBy("key").agg(content.alias("c"), F.max_by("data", F.when(F.col("type") == "citation", F.col("seq"))).alias("citations"), F.max(F.when(F.col("type") == "done", F.col("data"))).alias("finish_reason"), failed.alias("failed"))
    return out.select("key", F.when(F.col("failed"), F.concat("c", F.lit(error_note))).otherwise(F.col("c")).alias("content"), "citations", "finish_reason").where("content <> '' or citations is not null")


def owned(requests: DataFrame, sessions: DataFrame) -> DataFrame:
    """The requests (session_id, user_id, ...) whose user owns the session; what is read for others is nothing."""
    return requests.join(sessions.select("session_id", "user_id"), ["session_id", "user_id"]).select(*requests.columns)


def history_window(messages: DataFrame, sessions: DataFrame, requests: DataFrame, turns: int = HISTORY_TURNS, tokens: int = HISTORY_TOKENS) -> DataFrame:
    """session_id, user_id and the messages that fit: the newest 2 * turns of each requested session, back to the first that would exceed the tokens.

    requests: session_id, user_id; a user gets the messages of their own sessions only (sessions: session_id, user_id).
    """
    mine = owned(requests.select("session_id", "user_id").distinct(), sessions)
    rows = messages.join(mine, "session_id")
    if turns <= 0 or tokens <= 0:
        return rows.limit(0)
    back = Window.partitionBy("session_id").orderBy(F.col("created_at").desc(), F.col("message_id").desc())
    near = rows.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= 2 * turns)
    run = F.sum(estimate_tokens_history(F.col("content"))).over(back.rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("_sum", run).where(F.col("_sum") <= tokens).drop("_n", "_sum")


def condense_input(messages: DataFrame, queries: DataFrame, last: int = 4) -> DataFrame:
    """session_id, prompt: the last items as role lines and the question; sessions without history bypass."""
    back = Window.partitionBy("session_id").orderBy(F.col("created_at").desc(), F.col("message_id").desc())
    near = messages.withColumn("_n", F.row_number().over(back)).where(F.col("_n") <= last)
    line = near.withColumn("_line", F.concat(F.when(F.col("role") == "user", "用户: ").otherwise("助手: "), F.col("content")))
    h = line.groupBy("session_id").agg(_joined(["created_at", "message_id"], "_line", "\n").alias("history"))
    return queries.join(h, "session_id").select("session_id", F.concat("history", F.lit("\n"), F.col("query_text")).alias("prompt"))


def condense_fallback(queries: DataFrame, rewrites: DataFrame) -> DataFrame:
    """query_id, search_text: the stripped rewrite, or the query where that is blank or missing."""
    r = rewrites.select("query_id", F.nullif(strip(F.col("rewrite")), F.lit("")).alias("r"))
    return queries.join(r, "query_id", "left").select("query_id", F.coalesce("r", "query_text").alias("search_text"))


def memory_sources(messages: DataFrame, least: int = MEMORY_LEAST) -> DataFrame:
    """User messages long enough to hold a memory."""
    return messages.where((F.col("role") == "user") & (F.length(strip(F.col("content"))) >= least))


def memory_candidates(outputs: DataFrame) -> DataFrame:
    """message_id, ord, content from model output: the strings of a JSON list, code fence allowed, each stripped and cut at 100; other items and bad JSON give none."""
    fenced = F.split("output", "```")
    body = F.when(F.size(fenced) > 1, F.ltrim(F.get(fenced, 1), F.lit("json"))).otherwise(F.col("output"))
    items = F.try_variant_get(F.try_parse_json(strip(body)), "$", "array<variant>")
    texts = F.transform(F.filter(items, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.substring(strip(F.try_variant_get(v, "$", "string")), 1, 100))
    return outputs.select("message_id", F.posexplode(F.filter(texts, lambda x: x != "")).alias("ord", "content"))


def _pointing(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose vector has a direction."""
    return rows.where(F.exists(column, lambda x: x != 0))


def memory_topk(queries: DataFrame, memories: DataFrame, k: int = MEMORY_K) -> DataFrame:
    """query_id, memory_id, dist, rank of the nearest memories of the same user. Null and zero vectors find nothing and aren't found.

    A user's queries and memories meet in tiles, of which k rows a query go on.
    """

    def nearest(mine: pa.Array, asked: pa.Array) -> pa.RecordBatch:
        d = np.round(1 - unit_vectors(asked.field("query_vector")) @ unit_vectors(mine.field("embedding")).T, 9)
        ids = np.broadcast_to(mine.field("memory_id").to_numpy(), d.shape)
        order = np.lexsort((ids, d), axis=1)[:, :k]
        found = [np.repeat(asked.field("query_id").to_numpy(), order.shape[1]), np.take_along_axis(ids, order, 1).ravel(), np.take_along_axis(d, order, 1).ravel()]
        return pa.RecordBatch.from_arrays(list(map(pa.array, found)), ["query_id", "memory_id", "dist"])

    near = meet(_pointing(memories, "embedding"), _pointing(queries, "query_vector"), "user_id", ("memory_id", "query_id"), (["memory_id", "embedding"], ["query_id", "query_vector"]), nearest, "query_id long, memory_id long, dist double")
    return near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "memory_id"))).where(F.col("rank") <= k)


def memory_touch(memories: DataFrame, hits: DataFrame, now: Column) -> DataFrame:
    """memory_id, last_used_at: now where hit, else as before."""
    used = hits.select("memory_id").distinct().withColumn("_hit", F.lit(True))
    return memories.join(used, "memory_id", "left").select("memory_id", F.when(F.col("_hit"), now).otherwise(F.col("last_used_at")).alias("last_used_at"))


def memory_dedup(existing: DataFrame, candidates: DataFrame, similarity: float = MEMORY_SIMILARITY) -> DataFrame:
    """Candidates (candidate_id, user_id, embedding) without a stored memory (memory_id, user_id, embedding) of the user at the similarity or above."""
    if similarity >= 1:
        return candidates

    def close(mine: pa.Array, new: pa.Array) -> pa.RecordBatch:
        d = np.round(1 - unit_vectors(new.field("embedding")) @ unit_vectors(mine.field("embedding")).T, 9)
        return pa.RecordBatch.from_arrays([new.field("candidate_id").filter(pa.array((d <= round(1 - similarity, 9)).any(axis=1)))], ["candidate_id"])

    fields = (["memory_id", "embedding"], ["candidate_id", "embedding"])
    near = meet(_pointing(existing, "embedding"), _pointing(candidates, "embedding"), "user_id", ("memory_id", "candidate_id"), fields, close, "candidate_id long").distinct()
    return candidates.join(near, "candidate_id", "left_anti").select(*candidates.columns)


def memory_cap(memories: DataFrame, cap: int = MEMORY_CAP) -> DataFrame:
    """The newest memories of each user."""
    w = Window.partitionBy("user_id").orderBy(F.col("created_at").desc(), F.col("memory_id").desc())
    return memories.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= cap).drop("_n")


def memories_list(memories: DataFrame) -> DataFrame:
    """Per user newest first, without vectors: user_id, position, memory_id, content, total."""
    w = Window.partitionBy("user_id")
    return memories.select("user_id", F.row_number().over(w.orderBy(F.col("created_at").desc(), F.col("memory_id").desc())).alias("position"), "memory_id", "content", F.count("*").over(w).alias("total"))


def memory_section(users: DataFrame, memories: DataFrame) -> DataFrame:
    """user_id, section: a bullet list under a heading; empty for users without memories."""
    m = memories.withColumn("_line", F.concat(F.lit("- "), F.col("content")))
    lists = m.groupBy("user_id").agg(_joined(["created_at", "memory_id"], "_line", "\n").alias("lines"))
    return users.select("user_id").join(lists, "user_id", "left").select("user_id", F.coalesce(F.concat(F.lit("Known about the user:\n"), F.col("lines")), F.lit("")).alias("section"))


_BLOCKS = "array<struct<type: string, mime: string, data: string, text: string>>"


def _text_block(text: Column) -> Column:
    return F.array(F.struct(F.lit("text").alias("type"), F.lit(None).cast("string").alias("mime"), F.lit(None).cast("string").alias("data"), text.alias("text"))).cast(_BLOCKS)


def prompt_table(queries: DataFrame, context: DataFrame, history: DataFrame, sections: DataFrame, rules: str, attachments: DataFrame | None = None) -> DataFrame:
    """query_id, system, messages (role, blocks): rules with memories and context; the history of the query's session, then the query.

    history: as history_window gives it, so a query sees no session but its user's own. attachments:
    query_id, seq, data (base64) of images, which come before the text of the question with their types.
    """
    past = F.transform(F.array_sort(F.collect_list(F.struct("created_at", "message_id", "role", "content"))), lambda m: F.struct(m["role"].alias("role"), _text_block(m["content"]).alias("blocks")))
    h = history.groupBy("session_id", "user_id").agg(past.alias("past"))
    q = queries.join(sections, "user_id", "left").join(context, "query_id", "left").join(h, ["session_id", "user_id"], "left")
    system = F.concat_ws("\n\n", F.nullif(F.coalesce("section", F.lit("")), F.lit("")), F.lit(rules), F.coalesce("context", F.lit("")))
    blocks = _text_block(F.col("query_text"))
    if attachments is not None:
        image = F.struct(F.lit("image").alias("type"), image_type(F.col("data")).alias("mime"), F.col("data"), F.lit(None).cast("string").alias("text"))
        images = attachments.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("seq", image.alias("block")))).alias("_images"))
        q = q.join(images, "query_id", "left")
        blocks = F.concat(F.coalesce(F.transform("_images", lambda x: x["block"]).cast(_BLOCKS), F.array().cast(_BLOCKS)), blocks)
    now = F.array(F.struct(F.lit("user").alias("role"), blocks.alias("blocks")))
    none = F.array().cast(f"array<struct<role: string, blocks: {_BLOCKS}>>")
    return q.select("query_id", system.alias("system"), F.concat(F.coalesce("past", none), now).alias("messages"))


def flatten_messages(prompts: DataFrame) -> DataFrame:
    """query_id, seq, role, content of the messages of prompt_table: the system text first, then each message's text blocks joined by one space, other blocks dropped."""
    text = lambda m: F.array_join(F.transform(F.filter(m["blocks"], lambda b: b["type"] == "text"), lambda b: b["text"]), " ")
    first = F.array(F.struct(F.lit("system").alias("role"), F.col("system").alias("content")))
    rest = F.transform("messages", lambda m: F.struct(m["role"].alias("role"), text(m).alias("content")))
    return prompts.select("query_id", F.posexplode(F.concat(first, rest)).alias("seq", "m")).select("query_id", "seq", "m.role", "m.content")


def image_type(data: Column) -> Column:
    """The type by the first bytes of base64 data; jpeg where nothing fits or it can't be read."""
    head = F.hex(F.try_to_binary(F.substring(data, 1, 16), F.lit("base64")))
    mime = F.when(head.startswith("FFD8FF"), "image/jpeg").when(head.startswith("89504E47"), "image/png").when(head.startswith("47494638"), "image/gif")
    return mime.when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "image/webp").otherwise("image/jpeg")


def attachment_types(attachments: DataFrame) -> DataFrame:
    """attachment_id, mime."""
    return attachments.select("attachment_id", image_type(F.col("data")).alias("mime"))


def citation_json(citations: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """answer_id, citations: the cited chunks in order as JSON, scores at four decimals. With answers (answer_id), those without a citation read []."""
    item = F.struct("ord", "marker", "chunk_id", F.round("score", 4).alias("score"))
    per = citations.groupBy("answer_id").agg(F.array_sort(F.collect_list(item)).alias("items"))
    shown = per.select("answer_id", F.to_json(F.transform("items", lambda x: F.struct(x["marker"].alias("marker"), x["chunk_id"].alias("chunk_id"), x["score"].alias("score")))).alias("citations"))
    if answers is None:
        return shown
    return answers.select("answer_id").join(shown, "answer_id", "left").select("answer_id", F.coalesce("citations", F.lit("[]")).alias("citations"))


#: Rows of one user that memory_replay compares at once.
BLOCK = 256


@dataclass
class Held:
    """Memories of one user: when, id, unit vectors padded to one width, and their lengths (0: no direction)."""

    at: np.ndarray
    ids: np.ndarray
    units: np.ndarray
    sizes: np.ndarray

    @classmethod
    def none(cls) -> Held:
        return cls(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 0)), np.zeros(0, np.int64))

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Held:
        vectors = batch.column("embedding")
        sizes = pc.list_value_length(vectors).fill_null(0).to_numpy().astype(np.int64)
        units = np.zeros((len(sizes), int(sizes.max())))
        units[np.arange(units.shape[1])[None] < sizes[:, None]] = vectors.flatten().to_numpy(zero_copy_only=False)
        norms = np.linalg.norm(units, axis=1)
        points = norms > 0
        units[~points] = 0
        return cls(batch.column("at").to_numpy(), batch.column("memory_id").to_numpy(), units / np.where(points, norms, 1)[:, None], np.where(points, sizes, 0))

    @classmethod
    def joined(cls, parts: list[Held]) -> Held:
        width = max(p.units.shape[1] for p in parts)
        wide = [p.units if p.units.shape[1] == width else np.pad(p.units, ((0, 0), (0, width - p.units.shape[1]))) for p in parts]
        return cls(np.concatenate([p.at for p in parts]), np.concatenate([p.ids for p in parts]), np.concatenate(wide), np.concatenate([p.sizes for p in parts]))

    def rows(self, which: slice | np.ndarray) -> Held:
        return Held(self.at[which], self.ids[which], self.units[which], self.sizes[which])

    def in_order(self) -> np.ndarray:
        """Indexes from the oldest to the newest."""
        return np.lexsort((self.ids, self.at))

    def near(self, other: Held, limit: float) -> np.ndarray:
        """Which rows of other are within the cosine distance of each row, as bits."""
        width = min(self.units.shape[1], other.units.shape[1])
        close = np.round(1 - self.units[:, :width] @ other.units[:, :width].T, 9) <= limit
        return np.packbits(close & (self.sizes[:, None] == other.sizes[None]) & (self.sizes > 0)[:, None], axis=1, bitorder="little")


def memory_replay(existing: DataFrame, candidates: DataFrame, similarity: float = MEMORY_SIMILARITY, cap: int = MEMORY_CAP) -> DataFrame:
    """memory_id, user_id of each user's store after all messages, taken in order of (created_at, message_id).

    existing: memory_id, user_id, embedding, created_at; candidates have message_id besides. A message's
    candidates are held against the store that the earlier messages left, not against each other; if
    any is new, the store is cut to its newest cap rows. A candidate of a null or zero vector is never
    a duplicate, nor is one of another length. The order makes one user's messages serial; they stream through
    sorted partitions, and a task holds one user's store, one message's new rows and a batch. Cosines are made for a
    block of rows with the store and with each other; the fold itself then only looks at bits. So a user's work grows
    with their messages, not with the pairs among them.
    """
    limit = np.round(1 - similarity, 9)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # fresh: what the last message brought and the store doesn't hold yet.
        user, message, store, fresh, first = None, None, Held.none(), Held.none(), True

        def settled(alive: int, new: int) -> int:
            alive |= new
            while new and alive.bit_count() > max(cap, 0):
                alive &= alive - 1
            return alive

        def take(block: Held, messages: list[tuple]) -> None:
            """Bits stand for the store, fresh and the block's rows in order of time: the lowest one is the oldest."""
            nonlocal store, fresh, message
            space = Held.joined([store, fresh, block])
            order = space.in_order()
            bits = [1 << i for i in np.argsort(order).tolist()]
            space = space.rows(order)
            n, m = len(store.ids), len(store.ids) + len(fresh.ids)
            alive, new = sum(bits[:n]), sum(bits[n:m])
            near = [0] * len(messages) if similarity >= 1 else [int.from_bytes(row.tobytes(), "little") for row in block.near(space, limit)]
            for at, close, bit in zip(messages, near, bits[m:], strict=True):
                if at != message:
                    alive, new, message = settled(alive, new), 0, at
                if not close & alive:
                    new |= bit
            of = lambda x: space.rows(np.unpackbits(np.frombuffer(x.to_bytes(len(bits) // 8 + 1, "little"), np.uint8), bitorder="little")[: len(bits)].astype(bool))
            store, fresh = of(alive), of(new)

        def rows() -> pa.RecordBatch:
            end = Held.joined([store, fresh])
            ids = end.ids[end.in_order()[-cap:] if cap > 0 else slice(0)] if len(fresh.ids) else end.ids
            return pa.RecordBatch.from_arrays([pa.array(ids), pa.array([user] * len(ids), pa.int64())], ["memory_id", "user_id"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held = Held.of(batch)
            who, text_of, new = (batch.column(c) for c in ("user_id", "message_id", "_new"))
            messages = list(zip(held.at.tolist(), text_of.fill_null(-1).to_pylist(), strict=True))
            keys = np.stack([who.fill_null(0).to_numpy(), who.is_null().to_numpy(False), new.to_numpy(False)])
            starts = np.flatnonzero(np.r_[True, (keys[:, 1:] != keys[:, :-1]).any(axis=0)])
            for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), batch.num_rows], strict=True):
                mine = who[begin].as_py()
                if first or mine != user:
                    if not first:
                        yield rows()
                    user, message, store, fresh, first = mine, None, Held.none(), Held.none(), False
                if keys[2, begin]:
                    for i in range(begin, end, BLOCK):
                        which = slice(i, min(i + BLOCK, end))
                        take(held.rows(which), messages[which])
                else:
                    store = Held.joined([store, held.rows(slice(begin, end))])
        if not first:
            yield rows()

    at = F.coalesce(F.unix_micros(F.col("created_at").cast("timestamp")), F.lit(0)).alias("at")
    known = existing.select("user_id", F.lit(None).cast("long").alias("message_id"), "memory_id", at, "embedding")
    asked = candidates.select("user_id", F.coalesce("message_id", F.lit(-1)).cast("long").alias("message_id"), "memory_id", at, "embedding")
    ordered = known.unionByName(asked).withColumn("_new", F.col("message_id").isNotNull())
    return ordered.repartition("user_id").sortWithinPartitions("user_id", "_new", "at", "message_id", "memory_id").mapInArrow(fold, "memory_id long, user_id long")
