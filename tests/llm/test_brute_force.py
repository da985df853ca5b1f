"""Operators that SQL can't express, held against plain versions without numpy, and every stage of the pipeline against them."""

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import line_dedup, mixing, quality_gbt, quality_rules, secret_scan, toxicity_cnn
from lodestone.llm.text import Hasher, SecondHasher, spans

MASK = (1 << 64) - 1
BASE = 0x9E3779B97F4A7C15


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def mix(h):
    h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & MASK
    h = (h ^ h >> 27) * 0x94D049BB133111EB & MASK
    return h ^ h >> 31


def slow_hash(b):
    return mix((sum((c + 1) * pow(BASE, i, 1 << 64) for i, c in enumerate(b)) + len(b) * 0xD6E8FEB86659FD93) & MASK)


def test_hashes_depend_on_the_span_alone():
    r = random.Random(1)
    data = bytes(r.randrange(256) for _ in range(400))
    x = np.frombuffer(data * 2, np.uint8)
    one, two = Hasher(x), SecondHasher(x, Hasher(x))
    a = np.array([r.randrange(300) for _ in range(200)])
    b = a + np.array([r.randrange(100) for _ in range(200)])
    assert one(a, b).tolist() == [slow_hash(data[i:j]) for i, j in zip(a, b)]
    assert (one(a, b) == one(a + 400, b + 400)).all() and (two(a, b) == two(a + 400, b + 400)).all()
    short = np.frombuffer(b"abc", np.uint8)
    assert len(SecondHasher(short, Hasher(short))(np.array([0]), np.array([3]))) == 1


def test_long_texts_leave_no_large_tables():
    from lodestone.llm import decontaminate, simhash, statistics, text

    body = "Some words of a line. And more, of another one.\n" * 110_000  # 5 MB
    data, offsets = np.frombuffer(body.encode(), np.uint8), np.array([0, len(body)])
    assert len(data) > text._KEPT
    hasher = Hasher(data)
    ends = np.array([48, 96, len(data)])
    assert len(set(hasher(ends - 48, ends).tolist())) == 1 and hasher(np.array([0]), np.array([48]))[0] == slow_hash(body[:48].encode())
    assert len(text._powers.get("up", ())) <= text._KEPT
    assert statistics.base(data, offsets)["n_words"][0] == 1_100_000
    assert simhash.fingerprint(body.encode()) == simhash.fingerprint(body.encode().upper())
    chunks = line_dedup.Chunks(data, offsets)
    assert chunks.begin[0] == 0 and chunks.end[-1] == len(data) and (chunks.begin[1:] == chunks.end[:-1]).all()
    runs = line_dedup.Runs(data, offsets)
    assert runs.begin[0] == 0 and runs.end[-1] == len(data) - 1 and int(runs.number.sum()) == 1_100_000 - 49
    assert decontaminate.winnow(hasher(*spans(data, offsets, text.NOT_SPACE)[:2]), np.array([0, 1_100_000]))[1].any()


# Line dedup


def slow_lines(t):
    out, at = [], 0
    for m in re.finditer(rb"\n|(?<=[.!?])[\x20\x09\x0b-\x0d]", t):
        out.append((at, m.end()))
        at = m.end()
    return out + ([(at, len(t))] if at < len(t) else [])


def slow_chunks(t):
    """Lists of lines (begin, end)."""
    out, now, before = [], [], 0
    lines = slow_lines(t)
    for n, (a, b) in enumerate(lines):
        h = slow_hash(t[a:b])
        now.append((a, b))
        if n == len(lines) - 1 or (mix((h + 3 * before) & MASK) % line_dedup.DIVISOR == 0 and len(now) > 1) or len(now) == line_dedup.MAX_LINES:
            out.append(now)
            now = []
        before = h
    return out


def slow_word_spans(t, found):
    """Spans of words joined, and cut to whole lines where few words are left of a line."""
    ends = [b for _, b in slow_lines(t)]
    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
    count = lambda a, b: sum(a <= s < b for s in starts)
    joined = []
    for a, b in sorted(found):
        if joined and a <= joined[-1][1]:
            joined[-1][1] = max(b, joined[-1][1])
        else:
            joined.append([a, b])
    out, edges = [], [0, *ends]
    for a, b in joined:
        line, after = max(e for e in edges if e <= a), min(e for e in edges if e >= b)
        a, b = a if count(line, a) else line, b if count(b, after) else after
        nearest, last = min(e for e in edges if e >= a), max(e for e in edges if e <= b)
        x, y = nearest if count(a, nearest) < 50 else a, last if count(last, b) < 50 else b
        out.append((x, y) if x < y and count(x, y) >= 50 else (a, b))
    return out


def slow_dedup(rows):
    """rows: (id, text) to what is left of each text."""
    order = lambda d: (d[0] is None, d[0] or 0, int.from_bytes(xxhash.xxh64(d[1].encode(), 42).digest(), "big", signed=True))
    docs = sorted({d for d in rows if d[1] is not None}, key=order)
    number = {d: sum(e == d for e in rows) for d in docs}
    chunks, runs = {}, {}
    for d in docs:
        t = d[1].encode()
        cs = slow_chunks(t)
        for n, c in enumerate(cs):
            body = t[c[0][0] : c[-1][1]]
            if len(c) > 1 and body.split():
                side = lambda k, own=cs, text=t: [text[a:b] for a, b in own[k]] if 0 <= k < len(own) else []
                chunks.setdefault(body, []).append((d, c[0][0], side(n - 1)[::-1], side(n + 1)))
        w = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t)]
        for i in range(len(w) - 49):
            runs.setdefault(t[w[i][0] : w[i + 49][1]], []).append((d, w[i][0], w[i + 49][1]))
    gone = {d: [] for d in docs}
    for body, places in chunks.items():
        if len(places) > 1 or number[places[0][0]] > 1:
            _, _, before, after = places[0]
            for d, at, mine, theirs in places[1:]:
                a, b = at, at + len(body)
                for x, y in zip(mine, before):
                    if x != y:
                        break
                    a -= len(x)
                for x, y in zip(theirs, after):
                    if x != y:
                        break
                    b += len(x)
                gone[d].append((a, b))
    by_words = {d: [] for d in docs}
    for places in runs.values():
        for d, a, b in places:
            if d != places[0][0]:
                by_words[d].append((a, b))
    left = {}
    for d in docs:
        t = d[1].encode()
        out = set()
        for a, b in gone[d] + slow_word_spans(t, by_words[d]):
            out.update(range(a, b))
        left[d] = bytes(c for i, c in enumerate(t) if i not in out).decode()
    return [None if d[1] is None else left[d] for d in rows]


def corpus(seed, n=60):
    """Documents with copies, shared passages of many lengths, repeated lines and awkward rows."""
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefé") for _ in range(r.randint(2, 6))) for _ in range(400)]
    said = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    page = lambda k: "".join(said(r.randint(2, 14)) + r.choice([". ", ".\n", "! ", "\n", ".\n\n"]) for _ in range(k))
    shared = [page(r.randint(2, 14)) for _ in range(8)] + [said(k) for k in (49, 50, 55, 70, 120)]
    rows = []
    for i in range(n):
        parts = [page(r.randint(0, 6)), *r.sample(shared, r.choice([0, 1, 1, 2])), page(r.randint(0, 5))]
        r.shuffle(parts)
        rows.append((i, "".join(parts)))
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200 + k, rows[k][1].replace("a", "á", 1)) for k in range(5)]
    rows += [(7, rows[9][1] + shared[0]), rows[3], rows[3], (None, rows[4][1]), (None, shared[2] + shared[3]), (None, None), (300, None), (301, ""), (302, " \n\n "), (303, "word"), (304, ("x y. " * 40 + "\n") * 3)]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed):
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = sorted(str((r.doc_id, r.text)) for r in line_dedup.dedup_lines(docs).collect())
    assert got == sorted(str((i, t)) for (i, _), t in zip(rows, slow_dedup(rows)))


# Classifiers


def test_trees_are_walked_like_one_by_one():
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 5))
    model = quality_gbt.fit(x, ((x[:, 0] > 0) ^ (x[:, 1] + 0.3 * x[:, 2] > 0)).astype(float))
    got = quality_gbt.predict(model, x)
    for row, p in zip(x, got):
        margin = float(model["base"])
        for feature, cut, value in zip(model["feature"], model["cut"], model["value"]):
            node = 0
            while node < len(cut):
                node = 2 * node + (2 if row[feature[node]] > cut[node] else 1)
            margin += value[node - len(cut)]
        assert p == pytest.approx(1 / (1 + np.exp(-margin)))
    assert ((got > 0.5) == ((x[:, 0] > 0) ^ (x[:, 1] + 0.3 * x[:, 2] > 0))).mean() > 0.9


def slow_score(model, t):
    """Convolution and pooling by loops over the words of one text."""
    low = re.sub("[A-Z]", lambda m: m.group().lower(), t or "").encode()
    found = re.findall(rb"[0-9a-z\x80-\xff]+", low)
    emb = []
    for w in found:
        e = np.zeros(toxicity_cnn.DIM)
        for table, n in zip(model["table"], toxicity_cnn.STEMS):
            e = e + table[slow_hash(w[:n]) % toxicity_cnn.BUCKETS]
        emb.append(e)
    z, at = model["last"], 0
    for width, filters, bias in zip(toxicity_cnn.WIDTHS, model["filters"], model["bias"]):
        for top in range(toxicity_cnn.TOP):
            for f in range(toxicity_cnn.FILTERS):
                out = {round(float(sum(emb[i + j] @ filters[j][:, f] for j in range(width)) + bias[f]), 4) for i in range(len(emb) - width + 1)}
                best = sorted((v for v in out if v > 0), reverse=True)
                z += model["dense"][at] * (best[top] if top < len(best) else 0.0)
                at += 1
    return 1 / (1 + np.exp(-z))


def toxic_docs(seed=4, n=300):
    r = random.Random(seed)
    vocabulary = ["".join(r.choice("abcdefg") for _ in range(6)) for _ in range(300)]
    rows = []
    for i in range(n):
        t = [r.choice(vocabulary) for _ in range(r.randint(30, 60))]
        if i % 4 == 0:
            for w in ("blorg", "vexating"):
                t[r.randrange(len(t))] = w
        rows.append((i, " ".join(t), "en", f"s{i % 3}", sum(map(len, t)) + len(t) - 1))
    return rows


def test_convolution_and_pooling(spark):
    rows = toxic_docs() + [(900, None, "en", "s", 0), (901, "", None, "s", 0), (902, "One", "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(r[0], int(r[0] % 4 == 0)) for r in rows[:300]], "doc_id long, toxic int")
    model, limits = toxicity_cnn.train(docs, labels)
    got = {r.doc_id: r._score for r in toxicity_cnn.score(docs, model, limits).collect()}
    for row in rows[::5] + rows[-3:]:
        assert got[row[0]] == pytest.approx(slow_score(model, row[1]), abs=2e-3)


# Secrets


def slow_base(t):
    """The fixed patterns character by character."""
    out, value = [], set("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-")
    low = "".join(c.lower() if c.isascii() else c for c in t)

    def assign(i):
        for word in ("password", "passwd", "secret", "token", "api_key", "apikey"):
            j = i + len(word)
            if not low.startswith(word, i):
                continue
            j += t[j : j + 1] in ("'", '"') and j < len(t)
            while t[j : j + 1] == " ":
                j += 1
            if t[j : j + 1] not in (":", "="):
                continue
            j += 1
            while t[j : j + 1] == " ":
                j += 1
            j += t[j : j + 1] in ("'", '"') and j < len(t)
            k = j
            while k < len(t) and t[k] in value:
                k += 1
            if k > j:
                return k, k - j >= 6
        return None

    def run(i, allowed, least, head=""):
        j = i + len(head)
        if not t.startswith(head, i):
            return None
        while j < len(t) and t[j] in allowed:
            j += 1
        return (j, j - i >= least) if j > i + len(head) else None

    upper = set("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
    for kind, match in enumerate((assign, lambda i: run(i, upper, 20, "AKIA"), lambda i: run(i, set("0123456789abcdef"), 24))):
        i = 0
        while i < len(t):
            hit = match(i)
            if hit is None:
                i += 1
                continue
            if hit[1]:
                out.append((i, kind, hit[0]))
            i = hit[0]
    return sorted(out)


def test_base_spans(spark):
    r = random.Random(6)
    parts = ["password", "PassWD", "secret", "ſecret", "token", "api_key", "APIKEY", "'", '"', " ", "  ", ":", "=", "abc", "abcdef", "AKIA", "Q7ZC4M1X9B2N8V5L", "a1" * 12, "0f" * 11, "é", "\n", ".", "-"]
    texts = ["".join(r.choice(parts) for _ in range(r.randint(0, 30))) for _ in range(3000)]
    want = [slow_base(t) for t in texts]
    assert [secret_scan.scan_text(t)[0] for t in texts] == want and {k for w in want for _, k, _ in w} == {0, 1, 2}
    got = {x.doc_id: x for x in secret_scan.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, w in enumerate(want):
        names = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in w)
        assert got[i].base_sha256 == hashlib.sha256(names.encode()).hexdigest() and set(names.split(",")) <= {*got[i].spans.split(","), ""}
        assert (got[i].n_assign, got[i].n_access, got[i].n_hex) == tuple(sum(k == j for _, k, _ in w) for j in range(3))


# Quality rules


def slow_distances(vectors):
    """Squared scaled distances by a minimum-covariance-determinant estimate of one group."""
    x = np.array(vectors, float)
    d = x.shape[1]
    floor = np.diag((np.array(quality_rules.TOLERANCE) * quality_rules.GRID) ** 2)

    def step(mean, spread):
        """The next mean and covariance, and the bin that half of the rows reach."""
        e = x - mean
        bins = [int(np.floor(np.log2(max(v @ np.linalg.inv(spread) @ v, 1e-6)) * 16)) for v in e]
        half = min(b for b in set(bins) if 2 * sum(c <= b for c in bins) >= len(bins))
        own = x[[b <= half for b in bins]]
        return own.mean(0), np.cov(own.T, bias=True).reshape(d, d) + floor, half

    med = np.median(x, axis=0)
    every = np.cov(x.T, bias=True).reshape(d, d)
    mad = 1.4826 * np.median(np.abs(x - med), axis=0)
    found = []
    for mean, spread in ((med, floor), (med, np.diag(mad**2) + floor), (x.mean(0), every + floor), (med, every + floor)):
        for _ in range(quality_rules.FIRST_STEPS):
            mean, spread, _ = step(mean, spread)
        found.append((np.linalg.slogdet(spread)[1], mean, spread))
    det, mean, spread = min(found, key=lambda f: f[0])
    for _ in range(quality_rules.MOST_STEPS):
        m, s, half = step(mean, spread)
        if np.linalg.slogdet(s)[1] >= det - quality_rules.SETTLED:
            break
        det, mean, spread = np.linalg.slogdet(s)[1], m, s
    scale = max(1.0, 2 ** ((half + 1) / 16) / quality_rules.MEDIAN)
    return det, [float((v - mean) @ np.linalg.inv(spread) @ (v - mean)) / scale for v in x]


def test_outliers_against_plain_estimates(spark):
    r = random.Random(8)
    vocabulary = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 9))) for _ in range(3000)]
    rows = []
    for i in range(420):
        w = [r.choice(vocabulary) for _ in range(r.randint(60, 300))]
        if i % 9 == 0:
            w = [x + "#" for x in w]
        if i % 7 == 0:
            w[10:40] = w[:10] * 3
        lines = [" ".join(w[k : k + 9]) for k in range(0, len(w), 9)]
        rows.append((i, "\n".join(lines + lines[: i % 4]), ("en", "de", None)[i % 3], ("a", "b", None)[i // 3 % 3] if i < 360 else f"small{i % 5}"))
    rows += [(1000 + i, rows[0][1], "fr", "same") for i in range(60)] + [(2000 + i, rows[1][1], "xx", "few") for i in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {x.doc_id: x for x in quality_rules.judge(docs).collect()}
    vector = {}
    for i, t, lang, source in rows:
        w = words(t)
        lines = [x for x in t.split("\n") if words(x)]
        g = got[i]
        raw = [np.log1p(len(w)), np.log1p(g.word_chars / len(w)), (g.n_symbols / g.word_chars) ** 0.5, (g.n_dup_lines / len(lines)) ** 0.5, (g.n_repeat_words / len(w)) ** 0.5]
        vector[i] = [int(np.floor(v * 1024 + 0.5)) for v in raw]
    passed = [x for x in rows if not got[x[0]].base_failed]
    size = lambda key: sum(key(x) for x in passed)
    checked = set()
    for lang, source in {(x[2], x[3]) for x in passed}:
        level = 2 if size(lambda x: x[2:] == (lang, source)) >= 50 else 1 if size(lambda x: x[2] == lang) >= 50 else 0
        members = [x[0] for x in passed if level == 0 or (x[2] == lang and (level == 1 or x[3] == source))]
        want = dict(zip(members, slow_distances([vector[i] for i in members])[1]))
        for x in passed:
            if x[2:] == (lang, source):
                assert got[x[0]].distance == pytest.approx(want[x[0]], rel=1e-6, abs=1e-9), (level, lang, source)
                assert got[x[0]].kept == (want[x[0]] <= quality_rules.LIMIT)
                checked.add(level)
    assert checked == {0, 1, 2} and all(not g.kept for g in got.values() if g.base_failed)


# Pipeline


def slow_groups(rows):
    def fingerprint(t):
        w = [x.encode() for x in words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))]
        h = [xxhash.xxh64(b" ".join(w[i : i + 3]), 42).intdigest() for i in range(max(1, len(w) - 2))] if w else []
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))

    prints = [fingerprint(r[1]) for r in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2 and group[i] != group[j]:
                old, new = max(group[i], group[j]), min(group[i], group[j])
                group = [new if g == old else g for g in group]
    return group


def test_every_stage_of_the_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    r = random.Random(5)
    rows = toxic_docs(n=240)
    passage = ". ".join(" ".join(r.choice(rows)[1].split()[:9]) for _ in range(9)) + "."
    item = " ".join(f"quiz{k}" for k in range(30))
    for n, i in enumerate((1, 2, 3, 5, 6)):
        rows[i] = (i, rows[i][1] + ". " + passage + " Then " + rows[i + 40][1], *rows[i][2:])
        if n < 2:
            rows[i + 100] = (i + 100, rows[i + 100][1] + ". " + item, *rows[i + 100][2:])
    rows += [(500 + i, rows[i][1], *rows[i][2:]) for i in range(9, 15)] + [(600, None, None, None, None), (601, "", "en", "s1", 0)]
    frames = {"documents": (rows, "doc_id long, text string, lang string, source string, n_chars long"), "labels": ([(x[0], 1, int(x[0] % 4 == 0)) for x in rows[:240]], "doc_id long, quality int, toxic int"), "benchmark": ([(1, item), (2, None)], "item_id long, text string")}
    for name, (data, schema) in frames.items():
        spark.createDataFrame(data, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{n}.parquet") for n in ("documents", "labels"))
    model, limits = toxicity_cnn.train(docs, labels)

    def toxicity(now):
        return [x for x in now if slow_score(model, x[1]) < limits.get(x[2], limits[None])]

    def lines(now):
        out = [(x[0], t, *x[2:4], x[4] if t == x[1] else len(t)) for x, t in zip(now, slow_dedup([y[:2] for y in now]))]
        return [x for x, old in zip(out, now) if x[1] == old[1] or words(x[1])]

    def near(now):
        group, best = slow_groups(now), {}
        for g, x in zip(group, now):
            if g not in best or (x[0] is None, x[0]) < (best[g][0] is None, best[g][0]):
                best[g] = x
        return list(best.values())

    def benchmarks(now):
        out = []
        for x in now:
            w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (x[1] or "").lower())
            windows = {tuple(item.split()[k : k + 13]) for k in range(18)}
            hit = {k + j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(13)}
            if not hit or 20 * len(hit) < len(w):
                out.append(x)
        return out

    def mixed(now):
        size = {}
        for x in now:
            size[x[3]] = size.get(x[3], 0) + len(words(x[1]))
        weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
        low, high = 0.0, 10.0 * sum(size.values())
        for _ in range(200):  # the water level at which the targets use up their share
            level = (low + high) / 2
            low, high = (level, high) if sum(min(2 * size[s], level * weight[s]) for s in size) < 1.5 * sum(size.values()) else (low, level)
        out = []
        for x in now:
            rate = min(2 * size[x[3]], high * weight[x[3]]) / size[x[3]] if size[x[3]] else 0.0
            coin = int(hashlib.md5(f"mix:{x[0]}".encode()).hexdigest()[:13], 16) / 2**52
            out += [(*x, k + 1) for k in range(int(rate + 1e-9) + (coin < rate % 1 and rate % 1 < 1 - 1e-9))]
        return out

    now = rows
    for (name, stage), slow in zip(pipeline.STAGES, (toxicity, lines, near, benchmarks, mixed)):
        frame = spark.createDataFrame(now, docs.schema)
        got, want = sorted(map(str, map(tuple, stage(spark, frame, str(tmp_path)).collect()))), sorted(map(str, slow(now)))
        # The first stage is trained on the documents it gets, the same as here.
        assert got == want, name
        assert len(want) != len(now), name
        now = slow(now)
