"""Operators against plain models and literal fixtures."""

import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.functions.text import clean, estimate_tokens, split_sentences
from lodestone.operators import access, catalog, chunking, cleaning, conversation, ingest, retrieval
from lodestone.plans.hybrid import hybrid_search
from lodestone.queries import QUERIES
from lodestone.sources.views import view

CHUNKS = [(1, ["finance"], 0), (2, ["finance"], 1), (3, ["finance"], 2), (4, ["hr"], 1), (5, ["all"], 0), (6, ["all"], 1), (7, [], 0)]
USERS = [(1, ["finance"], 1), (2, ["hr"], 1), (3, ["finance"], 0), (4, ["finance"], 2), (5, ["all"], 0), (6, ["all"], 1), (7, ["finance", "hr"], 1), (8, [], 2)]
VISIBLE = {1: {1, 2}, 2: {4}, 3: {1}, 4: {1, 2, 3}, 5: {5}, 6: {5, 6}, 7: {1, 2, 4}}


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame([(i, t, o, [0.01] * 8, f"text {i}") for i, t, o in CHUNKS], "chunk_id long, acl_tags array<string>, sensitivity_ordinal int, dense_embedding array<float>, content string")


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame(USERS, "user_id long, permission_tags array<string>, clearance_level int")


def test_access_matrix(spark, chunks, users):
    got = {}
    for r in access.acl_pairs(chunks, users).collect():
        got.setdefault(r.user_id, set()).add(r.chunk_id)
    assert got == VISIBLE
    seen = access.acl_filter(chunks, users).select("chunk_id").collect()
    assert sorted(r.chunk_id for r in seen) == sorted(set().union(*VISIBLE.values())) and access.acl_members(users).count() == len(VISIBLE)
    counts = {(r.user_id, r.sensitivity_ordinal): r.n_chunks for r in access.visibility_matrix(chunks, users).collect()}
    level = {i: o for i, _, o in CHUNKS}
    assert counts == {(u, o): sum(level[c] == o for c in cs) for u, cs in VISIBLE.items() for o in (0, 1, 2) if any(level[c] == o for c in cs)}


def test_access_query_gives_every_link(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}", "s") for i in range(24)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    spark.createDataFrame([(i, i % 7) for i in range(14)], "event_id long, user_id long").write.parquet(f"{tmp_path}/events.parquet")
    chunks, users = view(spark, str(tmp_path), "chunks"), view(spark, str(tmp_path), "users")
    links, members = QUERIES["acl_filter"](spark, str(tmp_path)), QUERIES["acl_members"](spark, str(tmp_path))
    got = [(r.user_id, r.chunk_id) for r in links.join(members, "acl_group").collect()]
    want = [(u.user_id, c.chunk_id) for u in users.collect() for c in chunks.collect() if set(u.permission_tags) & set(c.acl_tags) and c.sensitivity_ordinal <= u.clearance_level]
    assert want and sorted(got) == sorted(want)


def test_short_queries_search_by_vector_within_permissions(spark, chunks, users):
    queries = spark.createDataFrame([(10 + u, u, "x", [0.01] * 8) for u, _, _ in USERS], "query_id long, user_id long, query_text string, query_vector array<float>")
    got = {}
    for r in hybrid_search(queries, users, chunks, k=100).collect():
        assert r.keyword_rank is None and r.rrf_score == pytest.approx(1 / (60 + r.vector_rank))
        got.setdefault(r.query_id - 10, set()).add(r.chunk_id)
    assert got == VISIBLE


def test_rank_fusion(spark):
    leg = lambda rows: spark.createDataFrame(rows, "query_id long, chunk_id long, rank int")
    got = {r.chunk_id: r for r in retrieval.rrf_fusion(leg([(1, 1, 1), (1, 2, 2)]), leg([(1, 2, 1), (1, 3, 2)]), k=20).collect()}
    assert got[2].rank == 1 and got[2].rrf_score == pytest.approx(1 / 62 + 1 / 61, abs=1e-9)
    assert got[1].rrf_score == pytest.approx(1 / 61 + 1 / 81, abs=1e-9) and got[3].vector_rank is None


def test_tokens_sentences_and_cleaning(spark):
    rows = spark.createDataFrame([("你好ab cd",), ("One. Two! three? Four.five 你好。再见",), ("a\x00\x07b\n\n\n\nc  ",), ("é",)], "text string")
    got = rows.select(estimate_tokens(F.col("text")).alias("n"), split_sentences(F.col("text")).alias("s"), clean(F.col("text")).alias("c")).collect()
    assert got[0].n == 3
    assert got[1].s == ["One.", "Two!", "three?", "Four.five 你好。", "再见"]
    assert got[2].c == "ab\n\nc"
    assert cleaning.clean_text(rows).collect()[3].text == "é"


def test_packing_against_a_slow_model(spark):
    rng = random.Random(1)
    for _ in range(200):
        tokens = [rng.randint(1, 60) for _ in range(rng.randint(1, 40))]
        out, window = [], []
        for i, t in enumerate(tokens):
            if window and sum(tokens[j] for j in window) + t > 100:
                out.append((window[0], i))
                keep = [k for k in range(len(window) + 1) if sum(tokens[j] for j in window[k:]) <= 30]
                window = window[keep[0] :]
            window.append(i)
        out.append((window[0], len(tokens)))
        assert chunking.pack_spans(tokens, 100, 30) == out
    sections = spark.createDataFrame([(1, 0, "A b. " * 200), (1, 1, "short"), (2, 0, None), (3, 0, "")], "doc_id long, section_no int, content string")
    packed = chunking.chunk_index(chunking.chunk_pack(sections, 50, 10, 20)).collect()
    assert {r.doc_id for r in packed} == {1} and sorted(r.chunk_index for r in packed) == list(range(len(packed)))


def test_chunks_pages_metadata_and_preview_against_a_slow_model(spark):
    rng = random.Random(4)
    said = lambda n: " ".join("".join(rng.choice("abcd") for _ in range(5)) for _ in range(n)).capitalize() + "."
    pages = [(d, s, p, None if rng.random() < 0.2 else 10 * d + p, rng.choice([None, ""]) if rng.random() < 0.1 else "\n\n".join(" ".join(said(rng.randint(2, 15)) for _ in range(rng.randint(1, 8))) for _ in range(rng.randint(1, 5)))) for d in range(6) for s in range(2) for p in range(3 * s, 3 * s + 3)]
    tok = lambda t: len(t) // 4  # noqa: E731 - ASCII only
    want = []
    for d in range(6):
        index = 0
        for s in range(2):
            segs = []
            for _, _, _, number, content in sorted(x for x in pages if x[:2] == (d, s)):
                for para in (content or "").split("\n\n"):
                    parts = [para] if tok(para) <= 60 else [x + "." for x in para[:-1].split(". ")]
                    segs += [(x, number) for x in parts if x]
            window = []
            windows = []
            for x in segs:
                if window and sum(tok(t) for t, _ in window) + tok(x[0]) > 60:
                    windows.append(window)
                    keep = 0
                    while keep < len(window) and sum(tok(t) for t, _ in window[-keep - 1 :]) <= 25:
                        keep += 1
                    window = window[len(window) - keep :]
                window = [*window, x]
            for w in [*windows, window] if segs else []:
                text = "\n\n".join(t for t, _ in w)
                if tok(text) >= 20:
                    want.append((d, index, text, w[0][1], len(text), tok(text)))
                    index += 1
    frame = spark.createDataFrame(pages, "doc_id long, section_no int, page_seq int, page_number int, content string").repartition(3)
    indexed = chunking.chunk_index(chunking.chunk_pack(chunking.gather_sections(frame), 60, 25, 20))
    full = chunking.chunk_metadata(indexed)
    got = sorted((r.doc_id, r.chunk_index, r.content, r.page_number, r.metadata.char_count, r.metadata.estimated_tokens) for r in full.collect())
    assert got == want and any(w[3] is None for w in want)
    assert sorted((r.doc_id, r.chunk_index) for r in chunking.chunk_preview(indexed, 4).collect()) == [w[:2] for w in want if w[1] < 4]
    numbered = {(r.doc_id, r.section_no): 0 for r in chunking.segments(chunking.gather_sections(frame), 60).where("page_number is not null").collect()}
    assert len(numbered) == 12


def test_returning_title_is_a_new_section(spark):
    pages = spark.createDataFrame([(1, i, t) for i, t in enumerate(["a", "a", None, None, "a"])], "doc_id long, page_seq int, section_title string")
    assert [r.section_no for r in chunking.section_islands(pages).orderBy("page_seq").collect()] == [0, 0, 1, 1, 2]


def test_admission_reasons_in_order(spark):
    rows = [(1, "t", ["hr"], "public"), (2, "t", ["hr"], "public"), (3, "", [], "nope"), (4, "u", [], "nope"), (5, "v", ["typo"], "nope"), (6, "w", ["hr"], "nope")]
    got = ingest.admission_gate(spark.createDataFrame(rows, "doc_id long, text string, acl_tags array<string>, sensitivity_level string"))
    assert {r.doc_id: r.reason for r in got.collect()} == {1: None, 2: "duplicate", 3: "empty", 4: "no_tags", 5: "unknown_tag", 6: "bad_level"}


def test_citations(spark):
    answers = spark.createDataFrame([(1, 9, "x [2] [1] [2] [0] [123] [01] [7]"), (2, 9, "no relevant content [1]")], "answer_id long, query_id long, answer string")
    ranked = spark.createDataFrame([(9, 1, 100), (9, 2, 200)], "query_id long, rank int, chunk_id long")
    assert [(r.ord, r.marker, r.chunk_id) for r in conversation.extract_citations(answers, ranked).orderBy("ord").collect()] == [(1, 2, 200), (2, 1, 100)]


def test_progress(spark):
    rows = [("done", 0, 0, 100), ("failed", 5, 10, 0), (None, 0, 0, 2), ("parsing", 5, 10, 8), ("parsing", 0, 0, 2), ("chunking", 1, 1, 15), ("embedding", 10, 10, 90), ("embedding", 1, 3, 43), ("storing", 0, 0, 93)]
    df = spark.createDataFrame(rows, "stage string, processed int, total int, want int")
    assert all(r.percent == r.want for r in catalog.progress_percent(df).collect())


def test_acl_mask_is_below_the_top_k(spark, chunks, users):
    """Chunks that the principal may not see never take a place among the k."""
    near = chunks.withColumn("dense_embedding", F.when(F.col("chunk_id") == 4, F.array(*[F.lit(1.0).cast("float")] * 8)).otherwise(F.array(F.lit(1.0).cast("float"), *[F.lit(0.0).cast("float")] * 7)))
    q = spark.createDataFrame([(1, 1, [1.0] * 8, "x")], "query_id long, user_id long, query_vector array<float>, query_text string")
    assert [r.chunk_id for r in retrieval.vector_topk(retrieval.principals(q, users), near, 1).collect()] == [1]


def test_throttle(spark):
    rng = random.Random(2)
    rows = [(d, d * 1000 + i, rng.randint(0, 100), rng.randint(0, 10), 10, i) for d in range(5) for i in range(60)]
    want = set()
    for d in range(5):
        last = None
        for r in rows[d * 60 : d * 60 + 60]:
            if last is None or r[2] - last >= 5 or r[3] >= r[4]:
                last = r[2]
                want.add((d, r[1], last))
    events = spark.createDataFrame(rows, "doc_id long, event_id long, percent int, processed int, total int, ts int")
    assert {tuple(r) for r in catalog.progress_throttle(events).collect()} == want


def test_embedding_is_deterministic_and_keeps_order(spark):
    from lodestone.operators.embedding import embed_chunks

    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "hello world"), (4, "")], "chunk_id long, content string")
    got = {r.chunk_id: list(r.dense_embedding) for r in embed_chunks(df, batch=2).collect()}
    assert got[1] == got[3] and abs(sum(x * x for x in got[1]) - 1) < 1e-5 and not any(got[2]) and not any(got[4])
    assert embed_chunks(df.limit(0)).count() == 0


def test_users_see_their_own_sessions_only(spark):
    start = "2024-01-01 00:00:"
    messages = spark.createDataFrame([(s, 10 * s + i, f"{start}{i:02d}", "user", f"m{i}") for s in (1, 2) for i in range(3)], "session_id long, message_id long, created_at string, role string, content string")
    sessions = spark.createDataFrame([(1, 7), (2, 8)], "session_id long, user_id long")
    asked = spark.createDataFrame([(1, 7), (1, 8), (2, 9), (3, 7)], "session_id long, user_id long")
    assert sorted((r.session_id, r.user_id, r.message_id) for r in conversation.history_window(messages, sessions, asked).collect()) == [(1, 7, 10), (1, 7, 11), (1, 7, 12)]
    assert conversation.history_window(messages, sessions, asked, turns=0).count() == 0
    queries = spark.createDataFrame([(100, 1, 7, "q"), (101, 1, 8, "q"), (102, None, None, None)], "query_id long, session_id long, user_id long, query_text string")
    empty = spark.createDataFrame([], "user_id long, section string"), spark.createDataFrame([], "query_id long, context string")
    images = spark.createDataFrame([(101, 1, "iVBORw0KGgo="), (101, 0, "???")], "query_id long, seq int, data string")
    table = conversation.prompt_table(queries, empty[1], conversation.history_window(messages, sessions, asked), empty[0], "rules", images)
    got = {r.query_id: r.messages for r in table.collect()}
    assert [m.blocks[-1].text for m in got[100]] == ["m0", "m1", "m2", "q"] and [m.blocks[-1].text for m in got[101]] == ["q"] and len(got[102]) == 1
    assert [(b.type, b.mime) for b in got[101][0].blocks] == [("image", "image/jpeg"), ("image", "image/png"), ("text", None)]
    flat = [(r.seq, r.role, r.content) for r in conversation.flatten_messages(table).where("query_id = 101").orderBy("seq").collect()]
    assert flat == [(0, "system", "rules\n\n"), (1, "user", "q")]


def test_frames_and_candidates_of_any_kind(spark):
    streams = spark.createDataFrame([("k", 'event: token\ndata: {"a": 1}\n\nevent: token\ndata: {bad\n\nevent: x\n\ndata: 1\n\nevent: done\ndata: "s"\n\n')], "key string, text string")
    assert [(r.seq, r.data) for r in conversation.frames_parse(streams).orderBy("seq").collect()] == [(0, '{"a": 1}'), (4, '"s"')]
    outputs = [(1, '[" a ", 1, null, {"x": 2}, ["b"], true, "", "c"]'), (2, "```json\n[\"d\"]\n```"), (3, '{"x": "y"}'), (4, "[1"), (5, None), (6, '"text"'), (7, '["' + "e" * 150 + '"]')]
    got = sorted((r.message_id, r.ord, r.content) for r in conversation.memory_candidates(spark.createDataFrame(outputs, "message_id long, output string")).collect())
    assert got == [(1, 0, "a"), (1, 1, "c"), (2, 0, "d"), (7, 0, "e" * 100)]


def test_retrieval_follows_a_permission_patch(spark, chunks, users):
    docs = chunks.select(F.col("chunk_id").alias("doc_id"), "acl_tags", F.lit("public").alias("sensitivity_level"), F.lit("done").alias("status"))
    patches = spark.createDataFrame([(1, 4, ["legal"], None), (2, 4, ["finance"], "public"), (3, 4, ["nobody"], "internal"), (4, 5, None, "confidential"), (5, 6, [], None), (6, 7, ["x"], None)], "patch_id long, doc_id long, acl_tags array<string>, sensitivity_level string")
    patched = catalog.permission_patch(docs, patches)
    assert {r.doc_id: r.outcome for r in patched.collect()} == {4: "applied", 5: "applied", 6: "empty_tags", 7: "unknown_value"}
    after = catalog.patch_chunks(chunks.withColumn("document_id", F.col("chunk_id")), patched)
    queries = spark.createDataFrame([(u, u, [0.01] * 8) for u, _, _ in USERS], "query_id long, user_id long, query_vector array<float>")
    assert after.count() == chunks.count()
    assert {r.patch_id: r.outcome for r in catalog.permission_outcomes(docs, patches).collect()} == {1: "applied", 2: "applied", 3: "unknown_value", 4: "applied", 5: "empty_tags", 6: "unknown_value"}
    seen = {}
    for r in retrieval.vector_topk(retrieval.principals(queries, users), after).collect():
        seen.setdefault(r.query_id, set()).add(r.chunk_id)
    assert seen == {1: {1, 2, 4}, 3: {1, 4}, 4: {1, 2, 3, 4}, 6: {6}, 7: {1, 2, 4}}


def test_retrieval_in_tiles_against_brute_force(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    words = ["".join(rng.choice(list("abcde"), 4)) for _ in range(60)]
    text = lambda: " ".join(rng.choice(words, 6))
    tags = [["hr"], ["legal"], ["hr", "all"], []]
    chunks = [(i, tags[i % 4], i % 3, rng.normal(size=6).round(1).tolist() if i % 9 else None, text() if i % 11 else None) for i in range(700)]
    users = [(0, ["hr"], 1), (1, ["legal", "all"], 2), (2, [], 2)]
    queries = [(i, i % 3, rng.normal(size=6).round(1).tolist(), text()) for i in range(60)]
    frame = spark.createDataFrame(chunks, "chunk_id long, acl_tags array<string>, sensitivity_ordinal int, dense_embedding array<double>, content string").repartition(3)
    asked = retrieval.principals(spark.createDataFrame(queries, "query_id long, user_id long, query_vector array<double>, query_text string"), spark.createDataFrame(users, "user_id long, permission_tags array<string>, clearance_level int"))
    near, alike = {}, {}
    for q, u, v, t in queries:
        mine = [c for c in chunks if set(c[1]) & set(users[u][1]) and c[2] <= users[u][2]]
        cos = lambda a, b: round(1 - float(np.dot(a, b) / (np.linalg.norm(a) * np.linalg.norm(b))), 9)
        near |= {(q, c): n + 1 for n, (_, c) in enumerate(sorted((cos(v, c[3]), c[0]) for c in mine if c[3])[:5])}
        grams = retrieval.trigrams
        for c in mine:
            if c[4] and len(grams(t) & grams(c[4])) / len(grams(t) | grams(c[4])) >= 0.3:
                alike[q, c[0]] = round(len(grams(t) & grams(c[4])) / len(grams(t) | grams(c[4])), 9)
    for limit in (retrieval.BROADCAST_BYTES, 0):  # by broadcast, and by salts
        monkeypatch.setattr(retrieval, "BROADCAST_BYTES", limit)
        monkeypatch.setattr(retrieval, "TILE", 64)
        monkeypatch.setattr(retrieval, "HELD", 1)
        assert {(r.query_id, r.chunk_id): r["rank"] for r in retrieval.vector_topk(asked, frame, 5).collect()} == near
        assert {(r.query_id, r.chunk_id): pytest.approx(r.score) for r in retrieval.trigram_similarity(asked, frame).collect()} == alike and alike
        top = {(r.query_id, r.chunk_id) for r in retrieval.keyword_topk(asked, frame, 3).collect()}
        assert top == {(q, c) for q in range(60) for _, c in sorted((-s, c) for (p, c), s in alike.items() if p == q)[:3]}
    assert retrieval.vector_topk(asked.limit(0), frame).count() == retrieval.trigram_similarity(asked, frame.limit(0)).count() == 0


def test_token_match(spark):
    chunks = spark.createDataFrame([(1, "The quick fox"), (2, "the fox"), (3, None), (4, "")], "chunk_id long, content string")
    queries = spark.createDataFrame([(1, "fox the"), (2, "QUICK the"), (3, "quick bear"), (4, None), (5, "..."), (6, "the the")], "query_id long, query_text string")
    assert sorted(map(tuple, retrieval.token_match(queries, chunks).collect())) == [(1, 1), (1, 2), (2, 1), (6, 1), (6, 2)]


def test_a_scorer_of_ones_own(spark):
    rows = spark.createDataFrame([(1, i, i, "q", "x" * i) for i in range(5)], "query_id long, chunk_id long, rank int, query_text string, content string")

    def longest(batches):
        for queries, contents in batches:
            yield [float(len(c)) for c in contents]

    assert [r.chunk_id for r in retrieval.ranked_topk(retrieval.rerank(rows, longest), 2).orderBy("final_rank").collect()] == [4, 3]
    assert {r.rerank_score for r in retrieval.rerank(rows).collect()} == {1.0}


def test_users_and_documents(spark):
    users = spark.createDataFrame([(i, ["all"], 1, False, True, i // 3) for i in range(20)], "user_id long, permission_tags array<string>, clearance_level int, is_admin boolean, is_active boolean, created_at int")
    for parts in (1, 4, None):
        assert [r.user_id for r in catalog.users_list(users, parts).orderBy("position").collect()] == sorted(range(20), key=lambda i: (-(i // 3), i))
    patches = spark.createDataFrame([(0, 1, None, None, None, False), (1, 2, ["x"], None, None, False), (2, 3, None, None, False, False), (3, 4, None, 5, None, None)], "patch_id long, user_id long, permission_tags array<string>, clearance_level int, is_admin boolean, is_active boolean")
    got = {r.user_id: (r.is_active, r.outcome) for r in catalog.user_patch(users, patches, 3).collect()}
    assert got == {1: (False, "applied"), 2: (True, "unknown_value"), 3: (True, "self_demotion"), 4: (True, "unknown_value")}
    drafts = users.withColumn("is_admin", F.col("user_id") == 2).withColumn("is_active", F.when(F.col("user_id") != 5, True))
    assert {r.user_id for r in catalog.permission_diff(users, drafts).collect()} == {2, 5}
    docs = spark.createDataFrame([(i, 1) for i in range(5)], "doc_id long, created_at int")
    assert [(r.doc_id, r.total) for r in catalog.documents_page(docs, 2, 2).collect()] == [(2, 5), (1, 5)] and catalog.documents_page(docs, 9, 2).count() == 0


def test_chunks_appear_with_their_documents(spark, tmp_path):
    rows = spark.createDataFrame([(1, 10, ["hr"], 0), (2, 11, ["hr"], 1)], "chunk_id long, document_id long, acl_tags array<string>, sensitivity_ordinal int")
    docs = spark.createDataFrame([(10, "done"), (11, "failed")], "doc_id long, status string")
    path = str(tmp_path)
    ingest.publish(rows, docs, path, 0)
    held = ingest.published(spark, path).select("chunk_id")
    assert [r.chunk_id for r in held.collect()] == [1] and ingest.retire(spark, path).count() == 0
    # A batch that runs again replaces its rows, while a reader of the first attempt keeps reading what it saw.
    ingest.publish(rows.withColumn("chunk_id", F.col("chunk_id") + 100), docs, path, 0)
    assert [r.chunk_id for r in held.collect()] == [1]
    assert [r.chunk_id for r in ingest.published(spark, path).collect()] == [101]
    # An attempt that stopped before its last step shows nothing, whether the batch is new or not.
    for batch in (0, 1):
        rows.withColumn("chunk_id", F.lit(7).cast("long")).write.partitionBy("sensitivity_ordinal").parquet(f"{path}/chunks/batch={batch}/attempt=a0")
        docs.write.parquet(f"{path}/documents/batch={batch}/attempt=a0")
    assert [r.chunk_id for r in ingest.published(spark, path).collect()] == [101]
    left = ingest.retire(spark, path).collect()
    assert len(left) == 6 and all(os.path.isdir(r.folder) for r in left) and {r.batch for r in left if r.attempt == "a0"} == {0, 1}


def test_stored_contents_are_left_out(spark):
    docs = spark.createDataFrame([(1, "a", 9), (2, "a", 3), (3, "b", 1), (4, None, 1), (5, None, 1)], "doc_id long, text string, at int")
    stored = spark.createDataFrame([("b",), (None,)], "text string").select(F.sha2("text", 256).alias("content_hash"))
    assert sorted(r.doc_id for r in ingest.content_hash_dedup(docs, "at", stored).collect()) == [2, 4, 5]


def test_many_patches_of_one_key(spark):
    """10,000 patches of one document, and a few of others, in any order: a fold by patch number."""
    import random

    rng = random.Random(2)
    docs = [(i, ["all"], "public", "processing" if i == 3 else "done", 0) for i in range(5)]
    patches = []
    for p in range(12_000):
        tags = rng.choice([None, None, [], ["hr"], ["legal", "hr"], ["x"], ["all", "x"]])
        patches.append((p, 1 if p % 6 else rng.choice([2, 3, 4, 99]), tags, rng.choice([None, "public", "internal", "confidential", "top"]) if p % 5 else None, p))
    rng.shuffle(patches)
    state, last, outcomes = {d[0]: list(d[1:3]) + [d[4]] for d in docs}, {}, {}
    for p, doc, tags, level, at in sorted(patches):
        if doc == 99:
            out = "not_found"
        elif doc == 3:
            out = "processing"
        elif tags is None and level is None:
            out = "nothing"
        elif tags == []:
            out = "empty_tags"
        elif "x" in (tags or []) or level == "top":
            out = "unknown_value"
        else:
            out = "applied"
            state[doc] = [tags or state[doc][0], level or state[doc][1], at]
        outcomes[p] = out
        last[doc] = "applied" if last.get(doc) == "applied" else out
    d = spark.createDataFrame(docs, "doc_id long, acl_tags array<string>, sensitivity_level string, status string, updated_at long")
    f = spark.createDataFrame(patches, "patch_id long, doc_id long, acl_tags array<string>, sensitivity_level string, patched_at long").repartition(7)
    got = catalog.permission_patch(d, f).collect()
    assert sorted((r.doc_id, r.acl_tags, r.sensitivity_level, r.updated_at, r.outcome) for r in got) == sorted((i, *state[i], last[i]) for i in last if i != 99)
    assert {r.patch_id: r.outcome for r in catalog.permission_outcomes(d, f).collect()} == outcomes
    chunks = spark.createDataFrame([(c, c % 5, ["all"], 0) for c in range(40)], "chunk_id long, document_id long, acl_tags array<string>, sensitivity_ordinal int")
    after = catalog.patch_chunks(chunks, catalog.permission_patch(d, f)).collect()
    assert sorted(r.chunk_id for r in after) == list(range(40)) and all(r.acl_tags == state[r.document_id][0] for r in after)


def test_renames_by_owners_only(spark):
    sessions = spark.createDataFrame([(1, 10, "a", 5), (2, 20, "b", 5), (3, 30, "c", 5)], "session_id long, user_id long, title string, updated_at long")
    renames = [(1, 1, 10, " first ", 6), (2, 1, 10, "second", 7), (3, 1, 20, "theirs", 9), (4, 1, 10, "x" * 201, 9), (5, 2, 20, " \x1c ", 9), (6, 9, 10, "none", 9), (7, 3, None, "nobody", 9)]
    r = spark.createDataFrame(renames, "patch_id long, session_id long, user_id long, new_title string, patched_at long")
    messages = spark.createDataFrame([(3, 8), (1, 2)], "session_id long, created_at long")
    assert sorted(map(tuple, catalog.session_patch(sessions, r, messages).collect())) == [(1, "second", 7), (2, "b", 5), (3, "c", 8)]
    assert {x.patch_id: x.outcome for x in catalog.rename_outcomes(sessions, r).collect()} == {1: "applied", 2: "applied", 3: "not_found", 4: "bad_title", 5: "bad_title", 6: "not_found", 7: "not_found"}
    users = spark.createDataFrame([(1, ["all"], 0, False, True)], "user_id long, permission_tags array<string>, clearance_level int, is_admin boolean, is_active boolean")
    patches = spark.createDataFrame([(2, 1, ["hr"], None, None, None), (1, 1, ["legal"], 2, True, None), (3, 1, ["x"], 0, None, False), (4, 7, None, 0, None, None)], "patch_id long, user_id long, permission_tags array<string>, clearance_level int, is_admin boolean, is_active boolean")
    assert [tuple(x) for x in catalog.user_patch(users, patches, 5).collect()] == [(1, ["hr"], 2, True, True, "applied")]
    assert {x.patch_id: x.outcome for x in catalog.user_outcomes(users, patches, 5).collect()} == {1: "applied", 2: "applied", 3: "unknown_value", 4: "not_found"}


def test_small_rules(spark):
    retrieved = spark.createDataFrame([(1, 11, 1), (1, 12, 2), (1, 13, 3)], "query_id long, chunk_id long, rank int")
    results = spark.createDataFrame([(1, 2, 0.9), (1, 7, 0.8), (1, 0, 0.7), (1, 1, 0.1)], "query_id long, index int, rerank_score double")
    assert sorted((r.final_rank, r.chunk_id) for r in retrieval.ranked_by_index(retrieved, results, 3).collect()) == [(1, 13), (3, 11)]
    cited = spark.createDataFrame([(1, 1, 2, 7, 0.123456)], "answer_id long, ord int, marker int, chunk_id long, score double")
    answers = spark.createDataFrame([(1,), (2,)], "answer_id long")
    assert {r.answer_id: r.citations for r in conversation.citation_json(cited, answers).collect()} == {1: '[{"marker":2,"chunk_id":7,"score":0.1235}]', 2: "[]"}
    chunks = spark.createDataFrame([(1, i) for i in range(45)] + [(2, 0)], "doc_id long, chunk_index int")
    assert {(r.doc_id, r.chunk_index): r.batch_no for r in ingest.embed_batches(chunks).collect()} == {**{(1, i): i // 5 for i in range(45)}, (2, 0): 0}
    bare = spark.createDataFrame([(1, 0, "a", None), (1, 1, "b", (1, 9))], "doc_id long, chunk_index int, content string, metadata struct<char_count: int, estimated_tokens: int>")
    assert sorted((r.chunk_index, r.estimated_tokens) for r in chunking.chunk_preview(bare).collect()) == [(0, 0), (1, 9)]


def test_vectors_of_another_length(spark):
    chunks = spark.createDataFrame([(1, [1.0, 0.0], ["all"], 0), (2, [1.0, 0.0, 0.0], ["all"], 0), (3, [0.0, 1.0], ["all"], 0), (4, [], ["all"], 0)], "chunk_id long, dense_embedding array<float>, acl_tags array<string>, sensitivity_ordinal int")
    users = spark.createDataFrame([(1, ["all"], 1)], "user_id long, permission_tags array<string>, clearance_level int")
    queries = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 1, [0.0, 0.0, 1.0]), (3, 1, [1.0])], "query_id long, user_id long, query_vector array<float>")
    got = retrieval.vector_topk(retrieval.principals(queries, users), chunks).collect()
    assert sorted((r.query_id, r.chunk_id, r.dist, r.rank) for r in got) == [(1, 1, 0.0, 1), (1, 3, 1.0, 2), (2, 2, 1.0, 1)]


def test_a_deep_page_reads_its_ranges_only(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.timestamp_seconds(F.col("id") % 977).alias("created_at"))
    want = sorted(((i % 977, i) for i in range(20_000)), reverse=True)
    ranges = catalog.page_ranges(docs, 40)
    for page, size in ((1, 7), (1_500, 10), (20, 1_000), (2_001, 10), (3, 7_000)):
        found = catalog.documents_page(ranges, page, size)
        assert [r.doc_id for r in found.collect()] == [i for _, i in want[(page - 1) * size : page * size]] and {r.total for r in found.collect()} <= {20_000}
    assert len(catalog.documents_page(ranges, 1_500, 10).select("doc_id").inputFiles()) <= len(ranges.inputFiles())
    read = catalog.documents_page(ranges, 1_500, 10)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_part" in read or "PartitionFilters: [_part" in read


def test_packing_sends_no_text_to_python(spark):
    sections = spark.createDataFrame([(1, 0, "a b. " * 300), (2, 0, None), (3, 0, "")], "doc_id long, section_no int, content string")
    chunks = chunking.chunk_pack(sections, 120, 50, 20)
    plan = chunks._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and plan.count("ArrowEvalPython") == 1
    assert {r.doc_id for r in chunks.collect()} == {1}


def test_normalising_and_encoding_take_slices_of_a_batch(spark):
    from lodestone.operators import embedding

    def make():
        return lambda texts: [[float(len(t))] for t in texts]

    rows = spark.createDataFrame([(i, None if i % 9 == 0 else f"e\u0301{i}") for i in range(3 * embedding.ROWS)], "id long, content string").coalesce(1)
    got = {r.id: r for r in embedding.with_embeddings(cleaning.clean_text(rows, "content"), make).collect()}
    assert len(got) == 3 * embedding.ROWS and all(r.content == (None if i % 9 == 0 else f"\xe9{i}") and r.dense_embedding == [float(len(r.content or ""))] for i, r in got.items())
