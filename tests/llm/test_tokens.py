"""Packing, alignment and spelling variants against plain versions."""

import hashlib
import random
import struct
import zlib
from collections import Counter, defaultdict
from itertools import product

import numpy as np
import pyarrow as pa
import pytest
import regex

from lodestone.llm import alignment, packing, spelling
from lodestone.llm.text import slices
from lodestone.llm.tokens import pair_tokenizer, public, word_tokenizer

CLASHES = ("row", "n", "pair", "length", "number", "task", "word", "form", "rare", "k", "ids", "a.b")
SCHEMA = "doc_id long, text string, lang string, " + ", ".join(f"`{c}` long" for c in CLASHES)
rng = random.Random(11)
ODD = ["a  b ", " ", "  ", "\n\n x", "don't 'sun ['s \"'ll", "IT'S", "<|endoftext|> x", "a<|startoftext|>b", "<s> </s> <unk> <0x41>", "x\x00y\x1cz\x7f", "▁a ▁", "é è ÀÉ ß", "é x ́", "日本語 テスト", "😀 👩‍👩‍👧", " a b　 c\u0085d", "İstanbul ΣΑΣ", "1234 5a6 ٣٤", "tab\tand\r\nlines \n  end  ", "a" * 3000, "!" * 700 + " " * 300 + "z", "ab " * 2500, "﻿x", "ﬁ ½ Å", "x'Re y'VE"]
CHARS = "aab cdé É'1 2\n\t.,!<|>日▁ ́ "


def texts():
    made = ["".join(rng.choice(CHARS) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    prose = ["the", "then", "running", "Ändern", "über", "12", "and,", "(or)", "don't", "façade"]
    return ODD + made + [" ".join(rng.choice(prose) for _ in range(rng.randint(1, 400))) for _ in range(60)]


@pytest.fixture(scope="module")
def rows():
    out = list(enumerate(texts()))
    return [*out, (9000, None), (9001, ""), (None, "the null id"), (None, None), out[3], out[30], (5, "another text of id five"), *[(9100 + i, "copy of a copy") for i in range(30)]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", *range(len(CLASHES))) for i, t in rows], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def byte_rows(some):
    _, data, offsets = next(iter(slices(pa.array(some, pa.string()), 1 << 30)))
    return data, offsets


def test_word_tokenizer_by_units():
    own, all_texts = word_tokenizer(public("word_bpe_49k.json")), texts()
    ids, n = own(*byte_rows(all_texts))
    ends = np.cumsum(n)
    for text, a, b in zip(all_texts, ends - n, ends):
        assert ids[a:b].tolist() == own.whole.encode(text, add_special_tokens=False).ids, text


def whole_pair(text):
    """Tokens of both tokenizers as (id, bytes), from whole texts; None where bytes don't come back."""
    own = pair_tokenizer(public("byte_bpe_50k.json"), public("piece_bpe_32k.model"))
    if not text:
        return None
    a, b = own.whole.encode(" " + text, add_special_tokens=False).ids, own.piece.encode(text)
    out = [(i, own.bytes_a[i]) for i in a], [(i, own.bytes_b[i]) for i in b]
    return out if all(b"".join(x for _, x in side) == (" " + text).encode() for side in out) else None


def plain_alignment(pair):
    """(groups text, links) by walking over every byte."""
    owners, cuts = [], []
    for side in pair:
        owners.append([k for k, (_, x) in enumerate(side) for _ in x])
        cuts.append(set(np.cumsum([len(x) for _, x in side]).tolist()))
    links = sorted(set(zip(*owners)))
    both, out = cuts[0] & cuts[1], []
    for side in pair:
        parts, at = [[]], 0
        for i, x in side:
            parts[-1].append(str(i))
            at += len(x)
            if at in both:
                parts.append([])
        out.append(parts[:-1])
    return ";".join(",".join(a) + "|" + ",".join(b) for a, b in zip(*out)), [(pair[0][a][0], pair[1][b][0]) for a, b in links]


@pytest.mark.parametrize("hot", [1 << 18, 3])
def test_alignment(spark, docs, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(alignment, "HOT_ONE_IN", hot)
    plain = [(i, p and plain_alignment(p)) for i, p in ((i, whole_pair(t)) for i, t in rows)]
    counts = Counter(x for _, p in plain if p for x in p[1])
    best = defaultdict(int)
    for (_, b), n in counts.items():
        best[b] = max(best[b], n)
    want = Counter()
    for (i, p), (_, t) in zip(plain, rows):
        if not p:
            want[(i, 0, 0, 0, 0, 0, 0, "")] += 1
            continue
        pair = whole_pair(t)
        want[(i, len(pair[0]), len(pair[1]), p[0].count("|"), len(p[1]), sum(counts[x] == best[x[1]] for x in p[1]), sum(counts[x] for x in p[1]), p[0])] += 1
    documents, links = alignment.align(docs)
    assert Counter(map(tuple, documents.collect())) == want
    assert {((r.a_id, r.b_id), r.n, r.best) for r in links.collect()} == {(x, n, n == best[x[1]]) for x, n in counts.items()}
    digests, _ = alignment.align(docs, digest=True)
    assert Counter((r.doc_id, r.groups) for r in digests.collect()) == Counter({(k[0], k[7] and hashlib.sha256(k[7].encode()).hexdigest()): n for k, n in want.items()})
    assert alignment.align(empty)[0].count() == 0


def test_lanes_of_a_long_text():
    own = pair_tokenizer(public("byte_bpe_50k.json"), public("piece_bpe_32k.model"))
    text = " ".join(rng.choice(["the", "Äpfel", "unbelievable", "x" * 40, "日本語"]) for _ in range(20_000)) + " " * 5000 + "é" * 20_000
    data, offsets = byte_rows([text])
    m = alignment._Merged(own, *byte_rows([text, "short"]))
    pair = whole_pair(text)
    groups, links = plain_alignment(pair)
    assert m.first_a[1] == len(pair[0]) and int(m.times[m.row == 0].sum()) == len(links)
    assert dict(zip(m.pairs[m.row == 0].tolist(), m.times[m.row == 0].tolist())) == Counter(a << 32 | b for a, b in links)
    assert m.cuts_a[: m.first_a[1]].sum() == groups.count("|")


def lengths(rows, path):
    own = word_tokenizer(path)
    return [(i, own.whole.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows]


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(docs, rows, empty, capacity):
    packed = packing.pack(docs, capacity, with_ids=True).cache()
    want = Counter()
    for i, ids in lengths(rows, public("word_bpe_49k.json")):
        for p in range(0, len(ids), capacity):
            part = ids[p : p + capacity]
            want[(i, p // capacity, p, len(part), zlib.crc32(struct.pack(f"<{len(part)}I", *part)))] += 1
    got = packed.collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length, r.ids))
    for parts in by_sequence.values():
        parts.sort()
        assert [o for o, _, _ in parts] == [0, *np.cumsum([n for _, n, _ in parts])[:-1].tolist()]
        assert sum(n for _, n, _ in parts) <= capacity
    counts = np.bincount([k[3] for k, n in want.items() for _ in range(n)], minlength=capacity + 1)
    assert len(by_sequence) <= packing.size(packing.best_fit(counts, capacity))
    assert {r.sequence_id: r.ids for r in packing.sequences(packed).collect()} == {s: [i for _, _, ids in parts for i in ids] for s, parts in by_sequence.items()}
    assert packing.pack(empty).count() == 0


def plain_best_fit(items, capacity):
    rooms = []
    for s in sorted(items, reverse=True):
        fit = [r for r in rooms if r >= s]
        room = min(fit) if fit else capacity
        if fit:
            rooms.remove(room)
        rooms.append(room - s)
    return len(rooms)


def optimum(items, capacity):
    """Fewest sequences, by trying all."""
    items, best = sorted(items, reverse=True), [len(items)]

    def walk(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(items):
            best[0] = len(rooms)
            return
        for r in set(rooms):
            if r >= items[i]:
                rest = list(rooms)
                rest.remove(r)
                walk(i + 1, [*rest, r - items[i]])
        walk(i + 1, [*rooms, capacity - items[i]])

    walk(0, [])
    return best[0]


def test_bin_completion_against_all_plans():
    better = 0
    draw = random.Random(3)
    for _ in range(300):
        capacity = draw.choice([10, 20, 50, 100])
        items = [draw.randint(1, capacity) if draw.random() < 0.3 else draw.randint(capacity // 5, capacity // 2) for _ in range(draw.randint(0, 11))]
        counts = np.bincount(items, minlength=capacity + 1) if items else np.zeros(capacity + 1, np.int64)
        found, bound = packing.plan(counts, capacity, 100_000)
        placed = Counter()
        for filling, n in found:
            assert packing.used(filling) <= capacity and n > 0
            for s, k in filling:
                placed[s] += k * n
        assert placed == Counter(items)
        assert plain_best_fit(items, capacity) == packing.size(packing.best_fit(counts, capacity))
        assert bound <= packing.size(found) == optimum(items, capacity)
        better += packing.size(found) < plain_best_fit(items, capacity)
    assert better


def test_plan_of_many_pieces():
    """Best fit isn't optimal here; the search finds the perfect plan of any multiple."""
    for many in (1, 1000, 10**9):
        counts = np.zeros(101, np.int64)
        for s in (44, 24, 24, 22, 21, 17, 8, 8, 6, 6, 45, 35, 20):
            counts[s] += many
        found, bound = packing.plan(counts, 100)
        assert bound <= packing.size(found) <= packing.size(packing.best_fit(counts, 100))
        assert sum(packing.used(f) * n for f, n in found) == int((np.arange(101) * counts).sum())


def plain_variants(rows):
    counts = Counter()
    for i, t in rows:
        for w in regex.findall(r"[A-Za-zÀ-ÿ]+", t or ""):
            w = regex.sub("[A-Z]", lambda m: m[0].lower(), w)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            counts[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 199 == 0 else w] += 1
    v = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    forms, out = {}, {}
    for w, n in v.items():
        close = [x for x in v if x != w and near(w, x)]
        top = min(close, key=lambda x: (-v[x], x)) if close else None
        forms[w] = top if top and v[top] >= 5 * n else None
        out[w] = [n, len(close)]
    for w, x in out.items():
        root = w
        while forms[root]:
            root = forms[root]
        x += [forms[w], root, v[forms[w]] if forms[w] else None]
    return {w: tuple(x) for w, x in out.items()}


def test_spelling_variants(spark, empty):
    draw = random.Random(4)
    base = ["".join(draw.choice("abcéÉs") for _ in range(draw.randint(6, 9))) for _ in range(25)] + ["committee", "b" * 70, "ab" * 400]
    out = []
    for w in base:
        out += [w] * draw.choice([5, 40, 700])
        for _ in range(6):
            p = draw.randrange(len(w))
            v = draw.choice([w[:p] + w[p + 1 :], w[:p] + draw.choice("abcéÿzÀ") + w[p:], w[:p] + draw.choice("abcxé×") + w[p + 1 :]])
            out += [v] * draw.choice([1, 4, 5, 30, 150])
            q = draw.randrange(len(v))
            out += [v[:q] + "z" + v[q + 1 :]] * draw.choice([5, 6])
    draw.shuffle(out)
    rows = [(i, " ".join(x.upper() if draw.random() < 0.1 else x for x in out[k : k + 60]) + draw.choice(["", ". 12,", "\n日本"])) for i, k in enumerate(range(0, len(out), 60))]
    rows += [(None, "committee comittee " * 9), (7000, None), (7001, ""), (7002, "12 , 日本"), rows[0], rows[1]]
    docs = spark.createDataFrame([(i, t, "en", *range(len(CLASHES))) for i, t in rows], SCHEMA).repartition(4)
    want = plain_variants(rows)
    got = {r.word: (r.n, r.n_near, r.form, r.root, r.form_n) for r in spelling.variants(docs).collect()}
    assert got == want
    assert sum(1 for x in want.values() if x[2] and x[3] != x[2]) > 0 and any(x[1] == 0 for x in want.values())
    assert spelling.variants(empty).count() == 0
    spelling_full = spelling.MAX_MB
    try:
        spelling.MAX_MB = 0
        assert {r.word: (r.n, r.n_near, r.form, r.root, r.form_n) for r in spelling.variants(docs).collect()} == want
    finally:
        spelling.MAX_MB = spelling_full


def test_joined_crc():
    for n in (0, 1, 5, 63):
        a, b = bytes(rng.randrange(256) for _ in range(9)), bytes(rng.randrange(256) for _ in range(n))
        got = spelling.joined_crc(np.array([zlib.crc32(a)], np.uint32), np.array([zlib.crc32(b)], np.uint32), np.array([n]))
        assert int(got[0]) == zlib.crc32(a + b)
