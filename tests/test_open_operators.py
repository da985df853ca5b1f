"""Approximate search, memory replay, styled sections and admission."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import ann, catalog, cleaning, conversation, ingest, retrieval

VECTORS = "chunk_id long, acl_tags array<string>, sensitivity_ordinal int, dense_embedding array<float>"


def test_ann_recall_against_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [["hr"], ["hr", "all"], [], ["legal"]][i % 4], i % 3, rng.normal(size=16).tolist()) for i in range(3000)]
    rows += [(3000 + i, ["hr"], 0, [0.5] * 16) for i in range(600)] + [(4000, ["hr"], 0, None), (4001, ["hr"], 0, [0.0] * 16)]
    chunks = spark.createDataFrame(rows, VECTORS)
    users = spark.createDataFrame([(0, ["hr"], 1), (1, ["legal"], 2), (2, [], 2)], "user_id long, permission_tags array<string>, clearance_level int")
    queries = chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), (F.col("chunk_id") % 3).alias("user_id"), F.col("dense_embedding").alias("query_vector"))
    exact = {(r.query_id, r.chunk_id): r.dist for r in retrieval.vector_topk(retrieval.principals(queries, users), chunks, 10).collect()}
    found = {(r.query_id, r.chunk_id): r.dist for r in ann.neighbours_ann(queries, users, chunks, 10).collect()}
    assert len(exact.keys() & found.keys()) / len(exact) >= 0.9
    assert all(abs(found[p] - exact[p]) < 1e-9 for p in exact.keys() & found.keys())
    permitted = {i for i, t, o, v in rows if v and (("hr" in t and o <= 1) or "legal" in t)}
    assert {c for _, c in found} <= permitted and not any(q % 3 == 2 for q, _ in found)


def test_every_cell_probed_is_exact(spark):
    rng = np.random.default_rng(4)
    chunks = spark.createDataFrame([(i, ["all"], 0, rng.normal(size=8).tolist()) for i in range(700)], VECTORS)
    users = spark.createDataFrame([(0, ["all"], 0)], "user_id long, permission_tags array<string>, clearance_level int")
    queries = retrieval.principals(chunks.where("chunk_id % 20 = 0").select(F.col("chunk_id").alias("query_id"), F.lit(0).alias("user_id"), F.col("dense_embedding").alias("query_vector")), users)
    centres, _ = ann.fit_index(chunks, "dense_embedding", "chunk_id")
    got = ann.vector_topk_ann(queries, chunks, centres, len(centres), 5).select("query_id", "chunk_id", "rank").collect()
    assert sorted(got) == sorted(retrieval.vector_topk(queries, chunks, 5).select("query_id", "chunk_id", "rank").collect())


def test_ann_of_empty_tables(spark):
    users = spark.createDataFrame([(0, ["all"], 0)], "user_id long, permission_tags array<string>, clearance_level int")
    queries = spark.createDataFrame([(1, 0, [1.0, 0.0])], "query_id long, user_id long, query_vector array<float>")
    assert ann.neighbours_ann(queries, users, spark.createDataFrame([], VECTORS)).count() == 0


@pytest.mark.parametrize("similarity", [0.6, 1.0])
def test_memory_replay_against_a_slow_model(spark, similarity):
    rng = random.Random(5)
    start = dt.datetime(2024, 1, 1)
    vec = lambda: [rng.gauss(0, 1) for _ in range(3)]
    existing = [(i, u, vec(), start + dt.timedelta(minutes=i)) for i, u in enumerate(u for u in range(4) for _ in range(rng.randint(0, 6)))]
    candidates, n = [], 1000
    for m in range(60):
        u, at = rng.randrange(5), start + dt.timedelta(days=1, minutes=m // 2)
        for _ in range(rng.randint(1, 3)):
            candidates.append((n, u, vec() if rng.random() > 0.1 else [0.0] * 3, at, m))
            n += 1
    cos = lambda a, b: 1 - round(1 - sum(x * y for x, y in zip(a, b)) / ((sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5 or 1), 9)
    want = set()
    for u in range(5):
        store = [(at, i, v) for i, w, v, at in existing if w == u]
        for m in range(60):
            new = [(at, i, v) for i, w, v, at, k in candidates if w == u and k == m and (similarity >= 1 or not any(cos(v, x[2]) >= similarity - 1e-9 for x in store))]
            if new:
                store = sorted(store + new, reverse=True)[:5]
        want |= {(i, u) for _, i, _ in store}
    got = conversation.memory_replay(spark.createDataFrame(existing, "memory_id long, user_id long, embedding array<double>, created_at timestamp"), spark.createDataFrame(candidates, "memory_id long, user_id long, embedding array<double>, created_at timestamp, message_id long"), similarity, 5)
    assert {tuple(r) for r in got.collect()} == want


def test_memory_replay_of_one_large_user(spark):
    """20,000 memories of one user, in messages of one to six, with vectors of another length and null ones among them."""
    rng = np.random.default_rng(6)
    n, cap = 20_000, 20
    message = np.repeat(np.arange(n), rng.integers(1, 7, n))[:n]
    vectors = [None if i % 97 == 0 else v[: 3 + (i % 89 == 0)].tolist() for i, v in enumerate(rng.normal(size=(n, 4)))]
    start = dt.datetime(2024, 1, 1)
    rows = [(i, 1, v, start + dt.timedelta(minutes=int(m)), int(m)) for i, (v, m) in enumerate(zip(vectors, message, strict=True))]
    store: list = []
    for m in range(int(message.max()) + 1):
        new = []
        for i in np.flatnonzero(message == m).tolist():
            v = None if vectors[i] is None else np.array(vectors[i]) / np.linalg.norm(vectors[i])
            if v is None or not any(w is not None and len(w) == len(v) and v @ w >= 0.9 for _, w in store):
                new.append((i, v))
        store = (store + new)[-cap:] if new else store
    candidates = spark.createDataFrame(rows, "memory_id long, user_id long, embedding array<double>, created_at timestamp, message_id long")
    got = conversation.memory_replay(candidates.drop("message_id").limit(0), candidates, 0.9, cap)
    assert sorted(r.memory_id for r in got.collect()) == [i for i, _ in store]


def test_styled_sections(spark):
    p = spark.createDataFrame([(1, 0, None, " intro "), (1, 1, "Heading 1", "One"), (1, 2, "Heading 2", "Two"), (1, 3, "Normal", "a"), (1, 4, "Normal", "  "), (1, 5, "Normal", None), (2, 0, "Heading 1", "only a title")], "doc_id long, seq int, style string, text string")
    t = spark.createDataFrame([(1, 0, "| x |"), (3, 0, "| y |")], "doc_id long, table_no int, text string")
    got = sorted(map(tuple, cleaning.styled_sections(p, t).collect()), key=lambda r: r[:2])
    assert got == [(1, 1, None, "intro"), (1, 2, "Two", "a\n| x |"), (3, 1, None, "| y |")]


def test_rejected_uploads_block_nothing(spark):
    rows = [(1, "t", ["typo"], "public"), (2, "t", ["hr"], "public"), (3, "t", ["hr"], "public"), (4, "u", None, "public"), (5, "u", ["hr"], None), (6, None, ["hr"], "public"), (7, "v", ["hr"], "public")]
    uploads = spark.createDataFrame(rows, "doc_id long, text string, acl_tags array<string>, sensitivity_level string")
    stored = spark.createDataFrame([("v",)], "text string").select(F.sha2("text", 256).alias("content_hash"))
    assert {r.doc_id: r.reason for r in ingest.admission_gate(uploads, stored).collect()} == {1: "unknown_tag", 2: None, 3: "duplicate", 4: "no_tags", 5: "bad_level", 6: "empty", 7: "duplicate"}


def test_vocabulary(spark):
    docs = spark.createDataFrame([(1, ["hr", "hr"], "public"), (2, None, None)], "doc_id long, acl_tags array<string>, sensitivity_level string")
    n = {(r.vocabulary, r.value): r.n for r in catalog.vocab_usage(docs).collect()}
    assert n[("acl_tag", "hr")] == 1 and n[("sensitivity_level", "public")] == 1 and sum(n.values()) == 2 and len(n) == 10
    assert catalog.vocab_tables(spark).count() == 13


@pytest.mark.parametrize("buckets", [1, 7, 4096])
def test_noisy_lines_are_those_that_a_full_count_finds(spark, monkeypatch, buckets):
    rng = random.Random(7)
    lines = ["Page header", "  Confidential ", "x" * 90, "ab", ""] + [f"line {i}" for i in range(40)]
    pages = [(f"s{s}" if s else None, "\n".join(rng.choices(lines, weights=[20, 12, 5, 5, 5] + [1] * 40, k=rng.randint(1, 12)))) for s in range(40) for _ in range(rng.randint(1, 9))]
    pages += [("big", "Running title\n" + "\n".join(f"text {i} {j}" for j in range(8))) for i in range(3000)]
    n, total = {}, {}
    for s, content in pages:
        total[s] = total.get(s, 0) + 1
        parts = content.split("\n")
        for line in parts[:3] + parts[-3:]:
            if s is not None and 2 < len(line.strip()) < 80:
                n[s, line.strip()] = n.get((s, line.strip()), 0) + 1
    want = {(s, line, c) for (s, line), c in n.items() if total[s] >= 3 and c / total[s] >= 0.6}
    df = spark.createDataFrame(pages, "source string, content string")
    assert {tuple(r) for r in cleaning.noisy_lines(df, buckets=buckets).collect()} == want and ("big", "Running title", 3000) in want
    monkeypatch.setattr(cleaning, "MAX_HOT", 3)
    assert {tuple(r) for r in cleaning.noisy_lines(df, buckets=buckets).collect()} == want
    assert cleaning.noisy_lines(df.limit(0)).count() == 0
