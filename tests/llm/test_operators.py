"""Each training-data operator against a brute-force version, on rows with every awkward case."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import Row

from lodestone.llm import common, decontaminate, line_dedup, mixing, quality_gbt, quality_rules, secret_scan, simhash, toxicity_cnn, url_filters, warc_fixity
from lodestone.llm.components import components

#: Columns whose names clash with those that the operators make for themselves.
CLASHES = ("size", "h", "score", "row", "_h", "_target", "target", "copies", "_copies", "spans", "of_id", "OF_H", "_lang", "_score", "rejected", "_rejected", "lang_of", "key", "_n", "a.b")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` long" for c in CLASHES)
rng = random.Random(5)
WORDS = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]


def sentence(n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def text(lines):
    return "\n".join(" ".join(sentence(rng.randint(4, 12)) for _ in range(3)) for _ in range(lines))


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, lang, source, None if t is None else len(t), *range(len(CLASHES))) for i, t, lang, source in rows], SCHEMA)


@pytest.fixture(scope="module")
def rows():
    shared = text(6)
    out = [(i, text(rng.randint(1, 12)), "en", f"src{i % 4}") for i in range(60)]
    out += [(100 + i, text(3) + "\n" + shared + "\n" + text(3), "de", "src0") for i in range(6)]
    out += [(200 + i, out[0][1], "en", "src0") for i in range(4)]
    out += [(300, None, None, None), (301, "", "en", "src1"), (302, " \n\t ", None, "src1"), (303, "word", "en", None), (None, text(2), "en", "src2"), (None, None, "en", "src2"), (304, "A b\x00c É " * 3000, "fr", "src3")]
    return [*out, out[3], out[3]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return frame(spark, [])


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_mixing(spark, docs, rows, empty):
    plan = mixing.mix_plan(docs).collect()
    assert len(plan) == len(rows)
    size = {}
    for _, t, _, s in rows:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(size.values())
    while free:  # share by weight, stop those above, share the rest again
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= 2 * size[s]}
        if not over:
            target |= {s: weight[s] * level for s in free}
            break
        target |= {s: 2.0 * size[s] for s in over}
        left -= sum(2 * size[s] for s in over)
        free -= over
    for r in plan:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert r.taken in (r.copies * r.size,) and r.copies <= 2
        rate = target[r.source] / size[r.source]
        assert r.copies in (int(rate), int(rate) + 1) if rate % 1 else r.copies == rate
    mixed = mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "mix_copy"]
    assert mixed.count() == sum(r.copies for r in plan)
    assert all(tuple(r)[5:-1] == tuple(range(len(CLASHES))) for r in mixed.collect())
    again = mixing.mix(mixed.withColumnRenamed("mix_copy", "MIX_copy"))
    assert again.columns == mixed.columns and again.count() > 0
    assert sorted(map(str, mixing.mix_plan(docs).collect())) == sorted(map(str, plan))
    assert mixing.mix_plan(empty).count() == mixing.mix(empty).count() == 0


def test_simhash(spark, docs, rows, empty):
    def slow(t):
        w = [x.encode() for x in words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]
        if not w:
            return 0
        h = [xxhash.xxh64(b" ".join(w[i : i + 3]), 42).intdigest() for i in range(max(1, len(w) - 2))]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    got = simhash.near_duplicates(docs).collect()
    prints = [slow(r[1]) for r in rows]
    group = list(range(len(rows)))
    for _ in rows:
        for i in range(len(rows)):
            for j in range(len(rows)):
                if (prints[i] ^ prints[j]).bit_count() <= 2:
                    group[i] = group[j] = min(group[i], group[j])
    least = {}
    for g, r in zip(group, rows):
        if r[0] is not None:
            least[g] = min(least.get(g, r[0]), r[0])
    want = sorted(map(str, [(r[0], f"{p:016x}", least.get(g)) for r, p, g in zip(rows, prints, group)]))
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in got) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(group))
    assert all(tuple(r)[5:] == tuple(range(len(CLASHES))) for r in kept.collect())
    named = docs.withColumn("doc_id", docs["doc_id"].cast("string"))
    want = {str(i) for i in {min((x for x in ids if x is not None), default=None) for ids in [[r[0] for r, g in zip(rows, group) if g == k] for k in set(group)]}}
    assert {r.component_id for r in simhash.near_duplicates(named).where("component_id is not null").collect()} <= {str(r[0]) for r in rows} and len(want) == len(set(group))
    assert simhash.near_duplicates(empty).count() == simhash.keep_one(empty).count() == 0


def test_simhash_links_are_exact_in_large_buckets(spark):
    r = np.random.default_rng(3)
    centre = r.integers(0, 1 << 62, 4, dtype=np.uint64)
    flips = [np.bitwise_or.reduce(np.uint64(1) << r.integers(0, 64, 3).astype(np.uint64)) for _ in range(4000)]
    fp = np.unique(np.array([centre[i % 4] ^ f for i, f in enumerate(flips)], np.uint64))
    left, right = [], []
    for i in range(len(fp)):
        j = np.flatnonzero(np.bitwise_count(fp[i + 1 :] ^ fp[i]) <= 2) + i + 1
        left += [i] * len(j)
        right += j.tolist()
    root = simhash.spanning(len(fp), np.array(left), np.array(right))
    nodes = spark.createDataFrame([(int(x),) for x in fp.view(np.int64)], "fp long")
    found = {x.node: x.root for x in components(simhash.links(nodes)).collect()}
    signed = fp.view(np.int64)
    groups = {}
    for i, g in enumerate(root):
        groups.setdefault(int(g), set()).add(int(signed[i]))
    got = {}
    for x in signed.tolist():
        got.setdefault(found.get(x, x), set()).add(x)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, groups.values()))


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components(edges).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


def slow_hits(t, items):
    low = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), x or ""))
    w, hit, found = low(t), set(), set()
    for name, item in items:
        v = low(item)
        m = min(13, len(v))
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1 if m else 0):
            if tuple(w[i : i + m]) in windows:
                hit.update(range(i, i + m))
                if name is not None:
                    found.add(str(name))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()


def test_decontamination(spark, docs, rows, empty):
    source = re.sub(r"\s+", " ", rows[5][1]).split(" ")
    items = [(1, " ".join(source[4:40])), (2, " ".join(source[10:22])), (3, WORDS[0]), (4, ""), (5, None), (6, "no such words here " * 9), (1, " ".join(source[4:40])), (None, rows[7][1]), (7, "b c é " * 40), (8, text(2))]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, h string")
    want = sorted(str((r[0], *slow_hits(r[1], items))) for r in rows)
    got = decontaminate.contamination(docs, benchmark)
    assert sorted(str((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256)) for r in got.collect()) == want
    for r in got.collect():
        assert r.contaminated == (r.n_hit > 0 and 20 * r.n_hit >= r.n_words)
    clean = decontaminate.without_contaminated(docs, benchmark)
    assert clean.columns == docs.columns and clean.count() == got.where("not contaminated").count()
    assert decontaminate.contamination(empty, benchmark).count() == 0
    assert decontaminate.contamination(docs, benchmark.limit(0)).where("n_hit > 0 or contaminated").count() == 0


def test_line_dedup(spark, docs, rows, empty):
    out = line_dedup.dedup_lines(docs)
    assert out.columns == [*docs.columns, "_removed", "_emptied"] and out.count() == len(rows)
    got = {}
    for r in out.collect():
        got.setdefault((r.doc_id, r.h), []).append(r)
    before = sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0])
    after = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    # Copies are emptied, the first stays as it was.
    assert after[0].text == rows[0][1]
    assert all(after[200 + i].text == "" and after[200 + i]._emptied for i in range(4))
    # Of the shared passage one copy stays whole; the others keep at most a chunk at each end.
    shared = rows[60][1].split("\n")[3:9]
    assert all(line in after[100].text for line in shared)
    for i in range(1, 6):
        own = rows[60 + i][1].split("\n")
        assert all(line in after[100 + i].text for line in (own[0], own[-1]))
        assert sum(len(x) for x in shared if x in after[100 + i].text) < 0.3 * sum(map(len, shared))
    # Nothing that occurs once goes: each removed sentence stands in an earlier document.
    everything = "\n".join(after[r[0]].text for r in before)
    for r in before:
        for s in re.split(r"(?<=[.!?])\s+", r[1]):
            assert s in everything
    assert after[300].text is None and after[303].text == "word" and after[301].text == ""
    assert line_dedup.dedup_lines(empty).count() == 0
    assert all(tuple(r)[5:-2] == tuple(range(len(CLASHES))) for r in out.collect())
    again = line_dedup.dedup_lines(out)
    assert again.columns == out.columns and again.where("_removed > 0").count() == 0
    named = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs.withColumn("doc_id", docs["doc_id"].cast("string"))).collect()}
    assert named["0"] == rows[0][1] and named["303"] == "word" and sum(len(named[str(i)] or "") for i in range(100, 106)) == sum(len(after[i].text) for i in range(100, 106))


def test_line_dedup_finds_every_passage_of_fifty_words(spark):
    r = random.Random(11)
    said = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    rows, passages = [], []
    for case in range(48):
        n, parts = 50 + case % 11, 1 + case % 8
        sizes = [n // parts + (k < n % parts) for k in range(parts)]
        # Sentences on lines of their own or in a paragraph; every sixth passage begins and ends inside a line.
        passage = (" ", "\n")[case // 8 % 2].join(said(k) + "." for k in sizes)
        inside = case % 6 == 5
        passage = passage[:-1] if inside else passage
        passages.append(passage)
        for d in (0, 1):
            before, after = said(30 + d) + (" " if inside else ". "), (" " if inside else "\n") + said(30 + 5 * d) + "."
            rows.append((1000 * d + case, before + passage + after, "en", "s"))
    rows += [(5000, said(40) + ". " + said(49) + ".", "en", "s")]
    rows += [(5001, said(40) + ". " + rows[-1][1].split(". ")[1], "en", "s")]  # 49 words stay
    got = {x.doc_id: x.text for x in line_dedup.dedup_lines(frame(spark, rows)).collect()}
    for i, t, _, _ in rows:
        left = t.replace(passages[i % 1000], "") if 1000 <= i < 5000 else t
        assert got[i].split() == left.split(), i


def test_line_dedup_does_not_depend_on_bitmap_or_copies(spark, monkeypatch):
    r = random.Random(4)
    said = lambda n: "".join(" ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(2)) + ".\n" for _ in range(n))
    # Twenty lines of two words: too few words in a row for runs of 50, so that chunks and their sides decide.
    rows = []
    for case in range(12):
        passage, first = said(20), said(8)
        rows += [(case, first + passage + said(8), "en", "s"), (500 + case, said(7) + passage + said(7), "en", "s")]
    removed = lambda rows: {x.doc_id: x._removed for x in line_dedup.dedup_lines(frame(spark, rows)).collect() if 500 <= x.doc_id < 900}
    alone = removed(rows)
    assert all(alone.values())
    assert removed(rows + [(900 + i, *x) for i, *x in rows if i < 500]) == alone
    monkeypatch.setattr(line_dedup, "bitmap", lambda hashes, column, log2_bits=24: np.full(1 << 18, ~np.uint64(0)))
    assert removed(rows) == alone


def test_line_dedup_sends_hashes_packed(spark):
    r = random.Random(6)
    said = lambda n: "".join(" ".join("".join(r.choice("abcdefgh") for _ in range(6)) for _ in range(8)) + ".\n" for _ in range(n))
    rows = [(i, said(60), "en", "s") for i in range(300)]
    data, offsets = np.frombuffer("".join(t for _, t, _, _ in rows).encode(), np.uint8), np.cumsum([0, *(len(t) for _, t, _, _ in rows)])
    hashes = int(line_dedup.Chunks(data, offsets).counts.sum()) + len(line_dedup.Runs(data, offsets).anchor)
    docs = frame(spark, rows).repartition(2).localCheckpoint()

    def stages():
        spark._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        none = spark._jvm.java.util.ArrayList()
        known = spark._jsc.sc().statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), none)
        return {x.stageId(): x.shuffleWriteRecords() for x in map(known.apply, range(known.size()))}

    before = stages()
    assert line_dedup.dedup_lines(docs).where("_removed > 0").count() == 0
    sent = sum(n for k, n in stages().items() if k not in before)
    # Nothing is repeated: one row for each task and 1/256 of the hashes of a kind, and the documents.
    assert hashes > 10_000 and sent < hashes / 2


def test_repeated_hashes_are_those_that_occur_twice(spark, monkeypatch):
    r = random.Random(8)
    monkeypatch.setattr(line_dedup, "PACK", 50)
    some = [0, 1, 2**32 - 1, 2**32, 2**63, 2**64 - 1, *(r.randrange(2**64) for _ in range(300))]
    values = [[r.choice(some) for _ in range(400)] + [7] * 500 + [r.randrange(2**64) for _ in range(100)] for _ in range(2)]
    rows = [(k, x - (x >> 63 << 64)) for k, column in enumerate(values) for x in column] + [(2, x) for x in range(100)]
    r.shuffle(rows)

    def gather(batches):
        for batch in batches:
            kinds, x = batch.column("k").to_numpy(), batch.column("x").to_numpy().view(np.uint64)
            for a in range(0, len(x), 30):
                yield tuple(x[a : a + 30][kinds[a : a + 30] == k] for k in range(3))

    got = line_dedup.repeated(spark.createDataFrame(rows, "k int, x long").repartition(5), gather).collect()
    assert sorted((x.kind, x.hash) for x in got) == sorted(k for k, n in collections.Counter(rows).items() if n > 1)


def test_chunk_boundaries_resist_shifts():
    a = text(40).encode()
    b = (sentence(5) + "\n").encode() + a
    cut = lambda x: {x[i:j] for i, j in zip(*[getattr(line_dedup.Chunks(np.frombuffer(x, np.uint8), np.array([0, len(x)])), n) for n in ("begin", "end")])}
    assert len(cut(a) & cut(b)) > 0.8 * len(cut(a))
    assert b"".join(sorted(cut(a), key=a.index)) == a


def test_secrets(spark, empty):
    key = "AKIA" + "Q7ZC4M1X9B2N8V5L"
    dense = "a1B2c3D4e5F6g7H8i9J0kLmNoPqRsTuVwXyZ"
    texts = ['é token = "abcdef1234" and PASSWORD:xy', f"{key} {'a1' * 12} {key}", f"id {dense} end", "123e4567-e89b-12d3-a456-426614174000 sha256: " + "0f" * 16, "", None, "a" * 5000, "ſecret = abcdefgh"]
    got = {r.doc_id: r for r in secret_scan.scan(frame(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got[0].spans == "assign:2:21" and got[0].base_sha256 == hashlib.sha256(b"assign:2:21").hexdigest()
    assert got[1].spans == "access:0:20,hex:21:45,access:46:66" and (got[1].n_access, got[1].n_hex) == (2, 1)
    assert got[2].n_entropy >= 1 and got[2].spans.startswith("entropy:3:") and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert got[3].n_entropy == 0 and got[3].spans == "hex:45:77"
    assert all(got[i].spans == "" for i in (4, 5, 7))
    assert got[6].spans == "hex:0:5000"
    assert secret_scan.scan(empty).count() == 0


def test_entropy_counts_are_incremental():
    alphabets = ("ABCdef0123456789xyz", "0123456789abcdefA", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", "aB3/_-=x9Kq")
    for n, letters in [(n, a) for n in (20, 21, 60, 300) for a in alphabets]:
        run = "".join(rng.choice(letters) for _ in range(n))
        want = set()
        for i in range(n - 19):
            w = run[i : i + 20]
            kind = "hex" if re.fullmatch("[0-9a-fA-F]+", w) else "alnum" if w.isalnum() else "base64"
            p = np.array([w.count(c) for c in set(w)]) / 20
            digit, upper, lower = (sum(map(f, w)) for f in (str.isdigit, str.isupper, str.islower))
            mixed = digit and upper and lower if kind == "base64" else digit and (upper or lower) or min(upper, lower) >= secret_scan.LEAST_CASES
            if -(p * np.log2(p)).sum() >= secret_scan.LEAST_ENTROPY[kind] - 1e-9 and mixed:
                want.update(range(i, i + 20))
        assert {k for a, b in secret_scan.entropy_windows(run) for k in range(a, b)} == want


def test_secrets_are_found_whatever_they_are_joined_to():
    r = random.Random(9)
    for joint in ("sig=", "key_", "id-", "a/b/", " "):
        for letters in ("0123456789ABCDEF", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"):
            secret = "".join(r.choice(letters) for _ in range(40))
            spans = secret_scan.scan_text(f"x {joint}{secret} y")[1]
            assert sum(b - a for a, _, b in spans) >= 20, (joint, secret)
    assert not secret_scan.scan_text("a-long-name-of-some-page-2024-05-17 /usr/local/share/some/file getUserAccountDetailsByName")[1]


def test_many_secrets_in_one_text():
    import time

    text = " ".join(f"secret: {i:08d}abcdEFGH id {'aB3dE5gH7jK9mN1pQ2rS'} " for i in range(20_000))
    began = time.process_time()
    base, spans = secret_scan.scan_text(text)
    assert len(base) == 20_000 and len(spans) == 40_000 and time.process_time() - began < 20
    assert all(any(s <= a and b <= e for s, _, e in base[i : i + 1]) for i, (a, _, b) in enumerate(base))


def test_quality_rules(spark, docs, rows, empty):
    got = quality_rules.judge(docs).collect()
    want = []
    for i, t, _, _ in rows:
        w, seen, dup = words(t), set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                dup += line in seen
                seen.add(line)
        windows = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        hit = {k + j for k, x in enumerate(windows) if windows.count(x) > 1 for j in range(3)} if len(w) < 3000 else set(range(len(w)))
        want.append(str((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(hit), len(w) < 50 or 100 * len(hit) > 50 * len(w))))
    assert sorted(str(tuple(r)[:7]) for r in got) == sorted(want)
    assert all(r.kept == (not r.base_failed and (r.distance or 0) <= quality_rules.LIMIT) for r in got)
    assert quality_rules.judge(empty).count() == 0


def test_quality_rules_reject_outliers(spark):
    good = [(i, " ".join(rng.choice(WORDS) for _ in range(150)), "en", "a") for i in range(200)]
    bad = [(1000 + i, " ".join(rng.choice(WORDS) + "###***$$$%%%&&&" for _ in range(150)), "en", "a") for i in range(5)]
    got = {r.doc_id: r.kept for r in quality_rules.judge(frame(spark, good + bad)).collect()}
    assert all(got[i] for i in range(200)) and not any(got[1000 + i] for i in range(5))


def test_quality_rules_reject_repeated_lines_alone(spark):
    r = random.Random(3)
    new = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    page = lambda line: "\n".join(f"{new()} {new()} {new()}\n{line or new()}" for _ in range(40))
    rows = [(i, page(None), "en", "a") for i in range(200)] + [(1000 + i, page("abcdef"), "en", "a") for i in range(5)]
    got = {x.doc_id: x for x in quality_rules.judge(frame(spark, rows)).collect()}
    assert all(got[1000 + i].n_dup_lines == 39 and not got[1000 + i].n_repeat_words and not got[1000 + i].base_failed for i in range(5))
    assert all(got[i].kept for i in range(200)) and not any(got[1000 + i].kept for i in range(5))


def labelled(spark, toxic=("blorg", "vexating")):
    d, labels = [], []
    for i in range(400):
        t, y = text(4), i % 4 == 0
        if y:
            t = t.replace(" ", f" {toxic[i % 2]} ", 3).replace(".", "!!! ### ***")
        d.append((i, t, "en" if i % 2 else "de", "s"))
        labels.append((i, int(not y), int(y)))
    return frame(spark, d), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_classifiers(spark, docs, rows, empty):
    d, labels = labelled(spark)
    truth = {r.doc_id: r for r in labels.collect()}
    q = quality_gbt.score(d, quality_gbt.train(d, labels)).where("held_out").collect()
    assert 60 < len(q) < 140 and np.mean([r.predicted == truth[r.doc_id].quality for r in q]) > 0.95
    model, limits = toxicity_cnn.train(d, labels)
    scored = toxicity_cnn.judge(toxicity_cnn.score(d, model, limits))
    t = scored.where("held_out").collect()
    assert np.mean([r.predicted == truth[r.doc_id].toxic for r in t]) > 0.95
    # Held-out labels are never seen: changing them changes no score.
    from lodestone.llm.common import id_remainder
    from pyspark.sql import functions as F

    other = labels.withColumn("toxic", F.when(id_remainder(F.col("doc_id")) == 2, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = toxicity_cnn.train(d, other)
    assert sorted(toxicity_cnn.judge(toxicity_cnn.score(d, *again)).collect()) == sorted(scored.collect())
    for x in (docs, empty):
        assert quality_gbt.score(x, quality_gbt.train(x, labels)).where("score between 0 and 1").count() == x.count()
        assert toxicity_cnn.score(x, model, limits).where("_score between 0 and 1").count() == x.count()
        assert toxicity_cnn.without_toxic(x, model, limits).columns == x.columns
    none = labels.limit(0)
    assert quality_gbt.score(docs, quality_gbt.train(docs, none)).count() == len(rows)
    assert toxicity_cnn.score(docs, *toxicity_cnn.train(docs, none)).count() == len(rows)


def test_url_filters(spark):
    link = lambda *hs: "".join(f'<a href="http://{h}/x">y</a>' for h in hs)
    pages = [(1, "http://A.com/x?q#f", link("good.org")), (2, "http://b.example.com/en/1", ""), (3, "https://www.example.com/en/", None), (4, "http://x.net/es/1", link("z.net")), (5, "http://spam.org/p", link("x.net", "x.net")), (6, "http://good.org", ""), (7, None, ""), (8, "no scheme", ""), (9, "http://com", ""), (10, "http://notcom/en/", ""), (11, "http://a.com?x=/y", "")]
    got = {r.page_id: r for r in url_filters.judge(spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, rank string")).collect()}
    rules = {i: r.rule for i, r in got.items()}
    assert rules == {1: "com/", 2: "example.com/en/", 3: "www.example.com/en/", 4: "net/es/", 5: None, 6: None, 7: None, 8: None, 9: None, 10: None, 11: None}
    assert (got[1].host, got[1].path, got[7].host, got[8].path, got[11].path) == ("a.com", "/x", "", "", "")
    assert {i: r.verdict for i, r in got.items()} == {1: "allow", 2: "block", 3: "allow", 4: "block", 5: "block", 6: "allow", 7: "allow", 8: "allow", 9: "allow", 10: "allow", 11: "allow"}
    assert url_filters.judge(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_url_verdicts_do_not_depend_on_the_number_of_seeds(spark):
    from pyspark.sql import functions as F

    verdicts = []
    for n in (1_000, 200_000):
        own = spark.createDataFrame([(1, "http://spam.org/p", '<a href="http://s1.net/x">y</a>'), (2, "http://far.org/", '<a href="http://spam.org/">y</a>'), (3, "http://clean.org/", ""), (4, "http://b.deep.s2.net/de/", "")], "page_id long, url string, html string")
        seeds = spark.range(n).select((F.col("id") + 10).alias("page_id"), F.concat(F.lit("http://s"), F.col("id").cast("string"), F.lit(".net/es/")).alias("url"), F.lit("").alias("html"))
        verdicts.append({r.page_id: (r.verdict, r.trust, r.distrust) for r in url_filters.judge(own.unionByName(seeds)).where("page_id < 10").collect()})
    assert verdicts[0] == verdicts[1] and {i: v[0] for i, v in verdicts[0].items()} == {1: "block", 2: "block", 3: "allow", 4: "block"}


def test_url_ranks_against_a_slow_pagerank(spark):
    r = random.Random(3)
    hosts = ["a.com", "b.a.com", "c.b.a.com", "x.net", "y.x.net", "one.org", "two.org", "z.one.org", "10.0.0.1", "h.de:80"]
    pages = [(i, f"https://{r.choice(hosts)}/{r.choice(['en', 'es', 'fr'])}/{i}", "".join(f'<a href="//{h}/">' for h in r.sample(hosts, 2)) + r.choice(["", "&copy; two.org"])) for i in range(80)]
    got = {x.host: (x.trust, x.distrust) for x in url_filters.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    links, seeds, number = {}, {"trust": {}, "distrust": {}}, {}
    add = lambda a, b: links.update({(a, b): links.get((a, b), 0) + 1}) if a != b else None
    known = set()
    for _, url, html in pages:
        h, p = url[8:].split("/", 1)
        known.add(h)
        for d in re.findall("//([^/]+)/", html) + re.findall("&copy; ([a-z.]+)", html):
            add(h, d)
            known.add(d)
        number[h] = number.get(h, 0) + 1
        kind = "trust" if h.endswith(".com") else "distrust" if h.endswith(".net") and p[:3] in ("es/", "fr/") else None
        if kind:
            seeds[kind][h] = seeds[kind].get(h, 0) + 1
    pairs = set()
    for h in known:
        while re.search("[a-z]", h) and h.count(".") > 1:
            up = h.split(":")[0].split(".", 1)[1]
            pairs |= {(h, up), (up, h)}
            h = up
    for p in pairs:
        links[p] = links.get(p, 0) + 1
    for n, kind in enumerate(("trust", "distrust")):
        edges = {(a, b) if not n else (b, a): v for (a, b), v in links.items()}
        into = {}
        for (_, b), v in edges.items():
            into[b] = into.get(b, 0) + v
        mass = {h: v / number[h] for h, v in seeds[kind].items()}
        total = dict(mass)
        for _ in range(url_filters.ROUNDS):
            moved = {}
            for (a, b), v in edges.items():
                moved[b] = moved.get(b, 0) + url_filters.DAMPING * mass.get(a, 0) * v / into[b]
            mass = moved
            for h, v in mass.items():
                total[h] = total.get(h, 0) + v
        for h, ranks in got.items():
            assert ranks[n] == pytest.approx((1 - url_filters.DAMPING) * total.get(h, 0), abs=2e-6), (h, kind)


@pytest.mark.parametrize("linkers", [1, 50, 5_000])
def test_url_verdicts_do_not_depend_on_the_number_of_linkers(spark, linkers):
    from pyspark.sql import functions as F

    name = lambda c: F.concat(F.lit("http://l"), c.cast("string"), F.lit(".org/"))
    own = spark.createDataFrame([(1, "http://bad.net/es/1", ""), (2, "http://half.org/", '<a href="http://bad.net/"><a href="http://clean.org/">'), (3, "http://clean.org/", ""), (4, "http://friend.org/", '<a href="http://l10.org/">')], "page_id long, url string, html string")
    pages = spark.range(10, 10 + linkers).select(F.col("id").alias("page_id"), name(F.col("id")).alias("url"), F.lit('<a href="http://bad.net/x">').alias("html"))
    got = {r.page_id: r for r in url_filters.judge(own.unionByName(pages)).collect()}
    assert {got[i].verdict for i in range(10, 10 + linkers)} == {"block"} and {got[i].distrust for i in range(10, 10 + linkers)} == {0.21}
    assert (got[2].distrust, got[4].distrust) == (0.105, 0.147)
    assert got[3].verdict == "allow" and got[4].verdict == "block"


def test_warc_fixity(spark):
    from pyspark.sql import functions as F

    rows = [(i, f"http://h/{i}", "x" * (i * 37 % 5000)) for i in range(2500)] + [(None, "u", "b"), (None, None, None), (9, "http://h/9", "x" * 333)]
    rows += [(7, "http://h/7", "y" * (k % 300)) for k in range(1500)] + [(101, "http://h/101", "same")] * 400
    pages = spark.createDataFrame([(*r, 1, "x") for r in rows], "page_id long, url string, html string, file long, hash string")
    records, other = (x.cache() for x in warc_fixity.replicas(pages))
    plain = [tuple(r) for r in warc_fixity.archive(pages).collect()]
    assert sorted(map(str, plain)) == sorted(str(tuple(r)) for r in records.collect()) and len(plain) == len(rows)
    # Offsets follow each other without gaps in the order of id and hash.
    for f in {x[1] for x in plain}:
        at = 0
        for _, _, position, length, _ in sorted((x for x in plain if x[1] == f), key=lambda x: (x[0] is None, x[0] or 0, x[4], x[2])):
            assert position == at
            at += length
    # Every record is hashed as it is stored.
    sha = lambda i, u, b: hashlib.sha256(f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{'' if i is None else i}>\r\nWARC-Target-URI: {u or ''}\r\nContent-Length: {len(b or '')}\r\n\r\n{b or ''}\r\n\r\n".encode()).hexdigest()
    assert sorted(x[4] for x in plain) == sorted(sha(*r) for r in rows)
    spoilt = lambda i, b: b if i is None or i % 101 > 2 else None if i % 101 == 2 else "?" + b[1:] if i % 101 == 0 else b[: len(b) // 2]
    assert sorted(r.hash for r in other.collect()) == sorted(sha(i, u, spoilt(i, b or "")) for i, u, b in rows if spoilt(i, b or "") is not None)
    assert warc_fixity.audit(records, records).count() == 0
    key = lambda df: {(r.file, r.position): (r.page_id, r.hash) for r in df.collect()}
    a, b = key(records), key(other)
    want = {(a[k][0], *k, "missing" if k not in b else "changed") for k in a if k not in b or a[k][1] != b[k][1]}
    got = warc_fixity.audit(records, other).collect()
    assert {(r.page_id, r.file, r.position, r.damage) for r in got} == want and len(got) == len(want) > 50
    assert {r.damage for r in warc_fixity.audit(other, records).collect()} == {"changed", "extra"}
    assert warc_fixity.audit(records, records.limit(0)).count() == len(rows)
    assert warc_fixity.audit(records.limit(0), records.limit(0)).count() == 0
    assert warc_fixity.audit(*warc_fixity.replicas(pages.limit(0))).columns == ["page_id", "file", "position", "length", "damage"]
    assert {r.damage for r in warc_fixity.audit(records, other.where(F.col("file") != 1)).collect()} == {"changed", "missing"}


def test_pipeline_stages_pass_documents_on(spark, tmp_path):
    import corpus_pipeline

    d, labels = labelled(spark)
    d = d.select("doc_id", "text", "lang", "source", "n_chars")
    copies = d.where("doc_id < 20").withColumn("doc_id", d["doc_id"] + 1000)
    d.unionByName(copies).write.parquet(str(tmp_path / "documents.parquet"))
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    leak = d.where("doc_id = 33").select(d["doc_id"].alias("item_id"), "text")
    leak.write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns[: len(d.columns)] == d.columns
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        ids.append({r.doc_id for r in docs.select("doc_id").collect()})
    toxic = {r.doc_id for r in labels.where("toxic = 1").collect()}
    assert len(ids[0] & toxic) < 0.05 * len(toxic) and len(ids[0] - toxic) >= 300
    assert not any(i >= 1000 for i in ids[1]) and 33 in ids[2] and 33 not in ids[3]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_toxicity_sample_is_bounded_in_bytes(spark, monkeypatch):
    """Long texts don't pass through the driver: of the sample in hash order as many documents as fit."""
    docs = spark.createDataFrame([(i, ("bad worse " if i % 2 else "good fine ") * (200_000 if i == 5 else 30), "en") for i in range(40)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = []
    fit = toxicity_cnn.fit
    monkeypatch.setattr(toxicity_cnn, "fit", lambda arrays, y: seen.append(sum(a.nbytes for a in arrays)) or fit(arrays, y))
    for limit in (64 << 20, 10_000, 0):
        monkeypatch.setattr(toxicity_cnn, "FIT_BYTES", limit)
        model, limits = toxicity_cnn.train(docs, labels)
        assert toxicity_cnn.score(docs, model, limits).count() == 40
        assert seen[-1] <= limit


def test_toxicity_learns_from_all_labelled_rows(spark):
    """The start is fitted on 40 rows; labels of the others count as well, in the model and in the thresholds."""
    from lodestone.llm.common import id_remainder
    from pyspark.sql import functions as F

    d, labels = labelled(spark)
    known = labels.where(id_remainder(F.col("doc_id")) != 2)
    first = [r.doc_id for r in known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(40).collect()]
    model, limits = toxicity_cnn.train(d, labels, rows=40)
    again, same = toxicity_cnn.train(d, labels, rows=40)
    other, _ = toxicity_cnn.train(d, labels.withColumn("toxic", F.when(F.col("doc_id").isin(first), F.col("toxic")).otherwise(F.col("doc_id").cast("int") % 3 % 2)), rows=40)
    scores = lambda m: {r.doc_id: r._score for r in toxicity_cnn.score(d, m, limits).collect()}
    got = scores(model)
    assert got == pytest.approx(scores(again), abs=1e-5) and limits == same and max(abs(got[i] - x) for i, x in scores(other).items()) > 0.3
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [r.doc_id for r in labels.where(id_remainder(F.col("doc_id")) == 2).collect()]
    assert np.mean([(got[i] >= 0.3) == (truth[i] > 0) for i in held]) > 0.95


def test_toxicity_thresholds_by_counts(spark):
    d, labels = labelled(spark)
    model, _ = toxicity_cnn.train(d, labels)
    rows = d.join(labels, "doc_id").selectExpr("text", "lang", "case when doc_id % 7 = 0 then 1 - toxic else toxic end as y")
    got = rows.collect()
    s = np.array([toxicity_cnn.forward(model, *toxicity_cnn.tokens(np.frombuffer(r.text.encode(), np.uint8), np.array([0, len(r.text.encode())])))[0] for r in got])
    want = toxicity_cnn.thresholds(s, np.array([r.y for r in got], float), np.array([r.lang for r in got], object))
    assert toxicity_cnn.thresholds_all(rows, model) == want and len(want) == 3


def test_simhash_labels_of_a_hot_fingerprint(spark, monkeypatch):
    """Empty texts share one fingerprint; beyond the keys that are broadcast whole, it alone is broadcast."""
    texts = [""] * 400 + [None] * 100 + [f"word{i} some other words that follow number {i}" for i in range(60)] * 2
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id", "stays").collect()))
    monkeypatch.setattr(common, "BROADCAST_KEYS", 1)
    assert sorted(map(tuple, simhash.near_duplicates(docs).select("doc_id", "fingerprint", "component_id", "stays").collect())) == want
    assert len(want) == 620 and {r[2] for r in want[:500]} == {0} and sum(r[3] for r in want[:500]) == 1
