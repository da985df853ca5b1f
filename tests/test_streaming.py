"""Streams give what the same operator gives at rest, over several micro-batches and a restart."""

import random

from pyspark.sql import functions as F

from lodestone.operators import catalog, conversation
from lodestone.sources import attempts
from lodestone.streaming import answers, ingest
from lodestone.streaming.tables import create, newest, put_batch, read_table, to_table


def _files(df, folder, parts):
    """One file for each value of the column part."""
    for n in parts:
        df.where(F.col("part") == n).drop("part").coalesce(1).write.mode("append").parquet(folder)


def _stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _both_halves(spark, df, make, tmp_path, mode):
    """The stream over two files, stopped, and over two more from its checkpoint."""
    schema = df.drop("part").schema
    for parts in ((0, 1), (2, 3)):
        _files(df, f"{tmp_path}/in", parts)
        out = make(_stream(spark, f"{tmp_path}/in", schema))
        to_table(out, f"{tmp_path}/rows", f"{tmp_path}/checkpoint", mode).awaitTermination()
    return read_table(spark, f"{tmp_path}/rows", ", ".join(f"`{n}` {t}" for n, t in out.dtypes))


def _progress(spark):
    rng = random.Random(7)
    rows = [(i, rng.randrange(8), rng.choice(["parsing", "embedding", "storing", None, "done"]), rng.randint(0, 10), 10, i, i // 100) for i in range(400)]
    return spark.createDataFrame(rows, "event_id long, doc_id long, stage string, processed int, total int, ts long, part int")


def test_progress_streams(spark, tmp_path):
    events = _progress(spark)
    latest = newest(_both_halves(spark, events, answers.latest_stream, tmp_path / "a", "update"), "doc_id")
    assert set(latest.collect()) == set(catalog.progress_latest(events).select(latest.columns).collect())
    forwarded = _both_halves(spark, events, answers.throttle_stream, tmp_path / "b", "append").drop("batch")
    assert set(forwarded.collect()) == set(catalog.progress_throttle(catalog.progress_percent(events)).collect())


def test_answer_stream(spark, tmp_path):
    rng = random.Random(8)
    rows = [(f"k{rng.randrange(6)}", i, rng.choice(["token", "token", "token", "citation"]), rng.choice(["a", "b ", "é", None]), i // 50) for i in range(200)]
    rows += [("k1", 300, "error", None, 3), ("k2", 301, "done", "stop", 3), ("empty", 302, "token", "", 2)]
    events = spark.createDataFrame(rows, "key string, seq long, type string, data string, part int")
    got = newest(_both_halves(spark, events, answers.assemble_stream, tmp_path, "update"), "key")
    want = conversation.answer_assembly(events.drop("part"))
    assert {tuple(r[c] for c in want.columns) for r in got.collect()} == set(map(tuple, want.collect()))


def test_ingest_stream(spark, tmp_path):
    body = "Some words in a sentence. " * 40
    rows = [(1, body + "one", ["hr"], "public", 0), (2, body + "two", ["typo"], "public", 0), (3, "short", ["hr"], "internal", 0)]
    rows += [(4, body + "two", ["all"], "confidential", 1), (5, body + "one", ["hr"], "public", 1), (6, None, ["hr"], "public", 1)]
    rows += [(7, "short", ["hr"], "public", 2), (8, body + "three", ["legal"], "public", 2), (9, body + "three", ["legal"], "public", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, acl_tags array<string>, sensitivity_level string, part int")
    for parts in ((0, 1), (2, 3)):
        _files(df, f"{tmp_path}/in", parts)
        ingest.stream_ingest(_stream(spark, f"{tmp_path}/in", df.drop("part").schema), f"{tmp_path}/out", 60, 10, 20).awaitTermination()
    docs = {r.doc_id: (r.status, r.reason) for r in ingest.documents(spark, f"{tmp_path}/out").collect()}
    done, duplicate = ("done", None), ("rejected", "duplicate")
    assert docs == {1: done, 2: ("rejected", "unknown_tag"), 3: ("failed", "chunk empty"), 4: done, 5: duplicate, 6: ("rejected", "empty"), 7: duplicate, 8: done, 9: duplicate}
    chunks = ingest.published(spark, f"{tmp_path}/out").collect()
    assert {c.doc_id for c in chunks} == {1, 4, 8} and len({c.chunk_id for c in chunks}) == len(chunks)
    assert {(c.sensitivity_ordinal, *c.acl_tags) for c in chunks if c.doc_id == 4} == {(2, "all")} and all(any(c.dense_embedding) for c in chunks)


def test_streamed_chunks_can_be_cited(spark, tmp_path):
    body = "Some words in a sentence. " * 12
    page = lambda i: f"ACME report\n{body}{i}\nconfidential"
    rows = [(1, "# Intro\n" + body + "one\n```\n# code\n```\n## More\n" + body + "two", "a.md", "web"), (2, "\f".join(page(i) for i in range(4)), "b.pdf", "mail"), (3, "# no heading here\n" + body + "three", "c.txt", None), (4, "\f \f" + body + "four\f", "d.pdf", "web")]
    df = spark.createDataFrame([(i, t, ["hr"], "public", n, s, 0) for i, t, n, s in rows], "doc_id long, text string, acl_tags array<string>, sensitivity_level string, filename string, source string, part int")
    _files(df, f"{tmp_path}/in", (0,))
    ingest.stream_ingest(_stream(spark, f"{tmp_path}/in", df.drop("part").schema), f"{tmp_path}/out", 60, 10, 20).awaitTermination()
    chunks = ingest.published(spark, f"{tmp_path}/out").collect()
    assert {(c.doc_id, c.section_title, c.source) for c in chunks} == {(1, "Intro", "web"), (1, "More", "web"), (2, None, "mail"), (3, None, None), (4, None, "web")}
    assert {c.page_number for c in chunks if c.doc_id == 2} == {1, 2, 3, 4} and {c.page_number for c in chunks if c.doc_id in (1, 3)} == {None} and {c.page_number for c in chunks if c.doc_id == 4} == {3}
    assert not any("ACME" in c.content or "confidential" in c.content or "code" in c.content for c in chunks) and any("# no heading" in c.content for c in chunks)
    assert all(sorted(c.chunk_index for c in chunks if c.doc_id == d) == list(range(sum(c.doc_id == d for c in chunks))) for d in (1, 2, 3, 4))


def test_contents_that_came_before_are_found_in_state(spark, tmp_path):
    """Eight micro-batches and a restart: each content is taken once, by rows of state alone; rejected uploads hold nothing back."""
    rng = random.Random(9)
    rows = [(100 * n + i, f"content {rng.randrange(40)}" if rng.random() < 0.9 else None, ["hr"] if rng.random() < 0.8 else ["typo"], "public", n) for n in range(8) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string, acl_tags array<string>, sensitivity_level string, part int")
    for parts in (range(4), range(4, 8)):
        _files(df, f"{tmp_path}/in", parts)
        out = ingest.seen_before(_stream(spark, f"{tmp_path}/in", df.drop("part").schema))
        to_table(out, f"{tmp_path}/rows", f"{tmp_path}/checkpoint").awaitTermination()
    marks = [r.content_hash for r in read_table(spark, f"{tmp_path}/rows", "content_hash string").collect()]
    # Each content is marked in every micro-batch that has it but the first.
    valid = [(r[1], r[4]) for r in rows if r[1] is not None and r[2] == ["hr"]]
    assert len(marks) == len(set(valid)) - len({t for t, _ in valid})
    first = df.where("part < 3").drop("part")
    first.coalesce(1).write.parquet(f"{tmp_path}/other")
    held = spark.createDataFrame([(1,)], "i int").selectExpr("sha2(cast('content 5' as binary), 256) AS content_hash")
    ingest.stream_ingest(_stream(spark, f"{tmp_path}/other", first.schema), f"{tmp_path}/out", 60, 10, 20, stored=held).awaitTermination()
    out = {r.doc_id: r.reason for r in ingest.documents(spark, f"{tmp_path}/out").collect()}
    want, seen = {}, {"content 5"}
    for i, text, tags, _, _ in sorted(r for r in rows if r[4] < 3):
        want[i] = "empty" if text is None else "unknown_tag" if tags == ["typo"] else "duplicate" if text in seen else "chunk empty"
        if want[i] == "chunk empty":
            seen.add(text)
    assert out == want


def test_answer_stream_in_any_order(spark, tmp_path):
    """Events fall into micro-batches at random, so tokens come after later ones, after the citations and after done."""
    rng = random.Random(10)
    rows = [(f"k{rng.randrange(5)}", i, rng.choice(["token", "token", "token", "citation"]), rng.choice(["a", "b ", "é", None]), rng.randrange(4)) for i in range(160)]
    rows += [("k1", 300, "error", None, 0), ("k2", 301, "done", "stop", 0), ("k2", 302, "done", None, 3), ("k3", 303, "done", "stop", 1), ("k3", 304, "citation", None, 0), ("k4", None, "token", "first ", 3), ("empty", 305, "token", "", 2)]
    events = spark.createDataFrame(rows, "key string, seq long, type string, data string, part int")
    got = newest(_both_halves(spark, events, answers.assemble_stream, tmp_path, "update"), "key")
    want = conversation.answer_assembly(events.drop("part"))
    assert {tuple(r[c] for c in want.columns) for r in got.collect()} == set(map(tuple, want.collect()))


def test_throttle_stream_with_late_events(spark, tmp_path):
    """Events come up to 100 seconds late in other micro-batches; those of the last seconds wait for a later one."""
    rng = random.Random(11)
    rows = [(i, rng.randrange(5), rng.randint(0, 10), 10, 1_700_000_000 + i // 2, min(3, max(0, (i + rng.randrange(-30, 30)) // 60))) for i in range(240)]
    rows += [(1000, 99, 5, 10, 1_700_010_000, 3)]
    events = spark.createDataFrame(rows, "event_id long, doc_id long, processed int, total int, s long, part int").selectExpr("event_id", "doc_id", "'parsing' AS stage", "processed", "total", "timestamp_seconds(s) AS ts", "part")
    got = _both_halves(spark, events, lambda e: answers.throttle_stream(e, 20, lateness="100 seconds"), tmp_path, "append").drop("batch")
    want = catalog.progress_throttle(catalog.progress_percent(events.where("doc_id <> 99").drop("part")), 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(got.columns).collect()))


def test_a_batch_that_runs_again_leaves_readers_their_files(spark, tmp_path):
    path = f"{tmp_path}/rows"
    create(spark, path, "v long")
    assert read_table(spark, path, "v long").count() == 0
    rows = lambda *v: spark.createDataFrame([(x,) for x in v], "v long")
    put_batch(rows(1, 2), path, 0)
    put_batch(rows(5), path, 1)
    held = read_table(spark, path, "v long")
    held.count()
    put_batch(rows(3), path, 0)
    rows(9).write.parquet(attempts.folder(path, 1, "a0"))  # an attempt that didn't finish
    assert sorted((r.batch, r.v) for r in held.collect()) == [(0, 1), (0, 2), (1, 5)]
    assert sorted((r.batch, r.v) for r in read_table(spark, path, "v long").collect()) == [(0, 3), (1, 5)]
    assert {r.batch for r in attempts.stale(spark, [path], f"{path}-attempts").collect() if r.batch >= 0} == {0, 1}
