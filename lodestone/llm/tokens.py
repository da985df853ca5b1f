"""Token ids of whole Arrow columns by the public tokenizers, each distinct unit of a batch encoded once.

All three tokenizers work unit by unit: the word tokenizer on runs of one kind of character, the
byte tokenizer and the piece tokenizer on a blank with the word behind it (no piece has a blank behind
another character). So the ids of a text are those of its units in a row, which tests hold against
the tokenizers on whole texts.
"""

from __future__ import annotations

import functools
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from lodestone.llm.text import LOWER, SPACE

#: Units longer than this are left to the tokenizers library where tiktoken would do.
_LONG = 500
#: Units that a worker remembers with their ids; all are forgotten when there are more.
_KNOWN = 200_000
#: Bytes that the word tokenizer splits by their kind alone: printable ASCII but the apostrophe (and letters of two bytes, see _latin).
_PLAIN = np.zeros(256, bool)
_PLAIN[0x21:0x7F] = True
_PLAIN[ord("'")] = False
#: 1 letters, 2 digits, 3 others; digits stand alone.
_KIND = np.full(256, 3, np.uint8)
_KIND[48:58] = 2
_KIND[65:91] = _KIND[97:123] = 1
_VISIBLE = np.zeros(256, bool)
_VISIBLE[0x21:0x7F] = True
#: The characters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on in their order.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_CHARS = {b: chr(b) for b in _PRINTABLE} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}


def _latin(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(both bytes of U+00C0 to U+00FF, second bytes of its letters)."""
    second = np.zeros(len(data), bool)
    second[1:] = data[:-1] == 0xC3
    both = second | (data == 0xC3)
    return both, second & (data != 0x97) & (data != 0xB7)


def public(name: str) -> str:
    """The place of a public tokenizer's file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, pa.LargeBinaryArray]:
    """(code of each span, the distinct spans by code). Spans are disjoint and in order."""
    lengths = ends - starts
    edge = np.bincount(starts, minlength=len(data) + 1) - np.bincount(ends, minlength=len(data) + 1)
    inside = np.cumsum(edge[:-1]).astype(bool)
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    flat = np.ascontiguousarray(data[inside])
    coded = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat)]).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def content(values: pa.LargeBinaryArray) -> memoryview:
    """All bytes of an array without offset or nulls, in a row."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1] if len(values) else np.zeros(1, np.int64)
    return memoryview(values.buffers()[2] or b"").cast("B")[offsets[0] : offsets[-1]]


def as_bytes(values: pa.LargeBinaryArray) -> list[bytes]:
    """The array as a list (much faster than its own conversion)."""
    if not len(values):
        return []
    data, offsets = bytes(content(values)), np.frombuffer(values.buffers()[1], np.int64)[: len(values) + 1]
    offsets = (offsets - offsets[0]).tolist()
    return [data[a:b] for a, b in zip(offsets, offsets[1:])]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of the runs [start, start + length), one run after another."""
    before = np.cumsum(lengths) - lengths
    return np.repeat(starts - before, lengths) + np.arange(int(lengths.sum()))


class Pool:
    """Ids of units: those of a code are ids[starts[code] : starts[code] + lengths[code]]."""

    def __init__(self, ids: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        self.ids, self.starts, self.lengths = ids, starts, lengths

    @staticmethod
    def of(runs: list[list[int]]) -> Pool:
        lengths = np.fromiter(map(len, runs), np.int64, len(runs))
        return Pool(np.fromiter(chain.from_iterable(runs), np.int64, int(lengths.sum())), np.cumsum(lengths) - lengths, lengths)

    def joined(self, other: Pool, mine: np.ndarray) -> Pool:
        """The units of both by code: mine[code] tells whose the code is, each pool's in order."""
        out = Pool(np.concatenate([self.ids, other.ids]), np.empty(len(mine), np.int64), np.empty(len(mine), np.int64))
        out.starts[mine], out.lengths[mine] = self.starts, self.lengths
        out.starts[~mine], out.lengths[~mine] = other.starts + len(self.ids), other.lengths
        return out

    def __call__(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the units in a row, number of ids of each)."""
        n = self.lengths[codes]
        return self.ids[ragged(self.starts[codes], n)], n


def _remember(known: dict, units: list[bytes], runs: list, new: list[int], codes: np.ndarray) -> None:
    """Remembers the new units that occur more than once."""
    again = (np.bincount(codes, minlength=len(units)) > 1).tolist()
    some = [i for i in new if again[i] and len(units[i]) <= _LONG][:_KNOWN]
    if len(known) + len(some) > _KNOWN:
        known.clear()
    for i in some:
        known[units[i]] = runs[i]


class WordTokenizer:
    """Ids of texts by the lower-casing word tokenizer, as encode(text, add_special_tokens=False) gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        self.whole = Tokenizer.from_file(path)
        # Plain units need neither normalising nor splitting, and are remembered here.
        with open(path) as f:
            model = json.load(f)["model"]
        self.bare = Tokenizer(BPE(vocab=model["vocab"], merges=[tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]], end_of_word_suffix=model["end_of_word_suffix"], cache_capacity=0))
        self.closes = np.zeros(max(model["vocab"].values()) + 1, bool)
        self.closes[[i for t, i in model["vocab"].items() if t.endswith(model["end_of_word_suffix"])]] = True
        self.special = [t.content.encode() for t in self.whole.get_added_tokens_decoder().values() if t.special]
        self.known: dict[bytes, list[int]] = {}

    def _units(self, units: list[bytes], plain: np.ndarray, codes: np.ndarray) -> Pool:
        runs = list(map(self.known.get, units))
        new = [i for i, r in enumerate(runs) if r is None]
        at = [i for i in new if plain[i]]
        for lo in range(0, len(at), 1000):
            some = at[lo : lo + 1000]
            ids = self.bare.encode_batch_fast([[units[i].decode("latin-1").translate(_CHARS) for i in some]], is_pretokenized=True, add_special_tokens=False)[0].ids
            # A unit's last id, and no other, carries the mark of a word's end.
            end = (np.flatnonzero(self.closes[ids]) + 1).tolist()
            for i, a, b in zip(some, [0, *end], end):
                runs[i] = ids[a:b]
        at = [i for i in new if not plain[i]]
        for i, coded in zip(at, self.whole.encode_batch_fast([units[i].decode() for i in at], add_special_tokens=False)):
            runs[i] = coded.ids
        _remember(self.known, units, runs, new, codes)
        return Pool.of(runs)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows in a row, number of ids of each row) of UTF-8 rows."""
        rows = len(offsets) - 1
        text = data.tobytes()
        both, letter = _latin(data)
        data = LOWER[data]
        # Capitals U+00C0 to U+00DE end in bytes up to 0x9E, their small letters 0x20 higher.
        data[letter & (data <= 0x9E)] += 32
        low = data.tobytes()
        odd = {r for r in range(rows) if any(low.find(s, offsets[r], offsets[r + 1]) >= 0 for s in self.special)} if any(s in low for s in self.special) else ()
        inside = ~SPACE[data]
        first = np.zeros(len(data) + 1, bool)
        first[offsets[:-1]] = True
        opens = inside & (np.concatenate([[True], ~inside[:-1]]) if len(data) else inside)
        opens |= inside & first[:-1]
        word = np.cumsum(opens) - 1
        hard = np.zeros(int(opens.sum()) + 1, bool)
        letter[:-1] |= letter[1:]
        hard[word[inside & ~_PLAIN[data] & ~letter]] = True
        kind = _KIND[data]
        kind[letter] = 1
        changes = np.zeros(len(data), bool)
        if len(data):
            changes[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        begin = opens | (inside & changes & ~hard[word])
        starts = np.flatnonzero(begin)
        # A unit ends where the next one or a blank begins.
        stops = np.flatnonzero(np.concatenate([~inside | begin, [True]]) | first)
        ends = stops[np.searchsorted(stops, starts, "right")]
        codes, spans_ = distinct(data, starts, ends)
        units = as_bytes(spans_)
        plain = np.zeros(len(units), bool)
        plain[codes] = ~hard[word[starts]]
        ids, n = self._units(units, plain, codes)(codes)
        unit_row = np.searchsorted(offsets, starts, "right") - 1
        sizes = np.bincount(unit_row, n, rows).astype(np.int64) if len(starts) else np.zeros(rows, np.int64)
        if not odd:
            return ids, sizes
        parts, end = [], np.cumsum(sizes)
        for r in range(rows):
            part = ids[end[r] - sizes[r] : end[r]]
            if r in odd:
                part = np.array(self.whole.encode(text[offsets[r] : offsets[r + 1]].decode(), add_special_tokens=False).ids, np.int64)
            parts.append(part)
        return np.concatenate(parts), np.fromiter(map(len, parts), np.int64, rows)


class PairTokenizer:
    """Ids of a blank and a text by the byte tokenizer (A) and of the text by the piece tokenizer (B), with the bytes of each id."""

    def __init__(self, path_a: str, path_b: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path_a)
        self.whole.encode_special_tokens = True
        byte = {c: b for b, c in _CHARS.items()}
        special = {t.content for t in self.whole.get_added_tokens_decoder().values()}
        vocabulary = {i: bytes(byte[c] for c in t) for t, i in self.whole.get_vocab().items() if t not in special}
        with open(path_a) as f:
            bare = json.load(f)["model"]["vocab"]
        ranks = {vocabulary[i]: i for t, i in bare.items() if t not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("a", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.bytes_a = [vocabulary.get(i, b"") for i in range(max(vocabulary) + 1)]
        self.piece = sentencepiece.SentencePieceProcessor(model_file=path_b)
        n = self.piece.get_piece_size()
        self.bytes_b = [bytes([int(self.piece.id_to_piece(i)[3:5], 16)]) if self.piece.is_byte(i) else self.piece.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.size_a, self.size_b = (np.fromiter(map(len, x), np.int64, len(x)) for x in (self.bytes_a, self.bytes_b))

        self.table_a, self.table_b = (pa.array(x, pa.large_binary()) for x in (self.bytes_a, self.bytes_b))

    def _a(self, unit: str) -> list[int]:
        return self.fast.encode_ordinary(unit) if len(unit) <= _LONG else self.whole.encode(unit, add_special_tokens=False).ids

    def _encoded(self, units: pa.LargeBinaryArray, simple: np.ndarray) -> tuple[Pool, Pool]:
        """Ids of each unit by both tokenizers. Simple units are a blank and visible characters: the byte tokenizer begins anew at each, so they are encoded as one text."""
        some = units.take(pa.array(np.flatnonzero(simple)))
        text = bytes(content(some)).decode()
        ids = np.array(self.fast.encode_ordinary(text), np.int64)
        unit_ends = np.cumsum(pc.binary_length(some).to_numpy(zero_copy_only=False).astype(np.int64))
        ends = np.searchsorted(np.cumsum(self.size_a[ids]), unit_ends, "left") + 1
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)[: len(ends)]
        a = Pool(ids, starts, ends - starts)
        b = Pool.of(self.piece.encode(text.split(" ")[1:], num_threads=1))
        if simple.all():
            return a, b
        others = [u.decode() for u in as_bytes(units.take(pa.array(np.flatnonzero(~simple))))]
        return a.joined(Pool.of([self._a(u) for u in others]), simple), b.joined(Pool.of(self.piece.encode([u[1:] for u in others], num_threads=1)), simple)

    def _same(self, units: pa.LargeBinaryArray, a: Pool, b: Pool) -> np.ndarray:
        """Whether the ids of each unit give its bytes back on both sides."""
        out = np.ones(len(units), bool)
        sizes = pc.binary_length(units).to_numpy(zero_copy_only=False)
        for pool, table, size in ((a, self.table_a, self.size_a), (b, self.table_b, self.size_b)):
            ids = pool(np.arange(len(units)))[0]
            sums = np.concatenate([[0], np.cumsum(size[ids])])
            ends = np.cumsum(pool.lengths)
            back = content(pc.take(table, pa.array(ids)))
            if (sums[ends] - sums[ends - pool.lengths] == sizes).all() and np.array_equal(np.frombuffer(back, np.uint8), np.frombuffer(content(units), np.uint8)):
                continue
            values = table.to_pylist()
            out &= np.fromiter((b"".join(values[i] for i in ids[e - n : e].tolist()) == u for e, n, u in zip(ends.tolist(), pool.lengths.tolist(), as_bytes(units))), bool, len(units))
        return out

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(starts, ends) of the units of rows that begin with a blank: cut before each blank between a whole visible character and another one."""
        begin = np.zeros(len(data), bool)
        begin[offsets[:-1][np.diff(offsets) > 0]] = True
        if len(data) > 2:
            visible = _VISIBLE[data]
            ends = visible | _latin(data)[0]
            begin[1:-1] |= (data[1:-1] == 32) & ends[:-2] & (visible | (data >= 0xC3))[2:]
            # The next row's blank is behind this row's last byte, which is no unit's middle.
        starts = np.flatnonzero(begin)
        return starts, np.append(starts[1:], len(data)) if len(starts) else starts

    def __call__(self, data: np.ndarray, offsets: np.ndarray):
        """(ids_a, ends_a, ids_b, ends_b, good rows) of rows that begin with a blank; ends are byte offsets in data.

        A row whose tokens don't give its bytes back is not good and has no tokens here.
        """
        rows = len(offsets) - 1
        starts, ends = self.units(data, offsets)
        codes, units = distinct(data, starts, ends)
        # Units with nothing but visible characters behind their blank.
        other = np.concatenate([[0], np.cumsum(~(_VISIBLE[data] | _latin(data)[0]))])
        simple = np.zeros(len(units), bool)
        simple[codes] = (ends - starts > 1) & (other[ends] - other[starts] == 1)
        a, b = self._encoded(units, simple)
        same = self._same(units, a, b)
        row = np.searchsorted(offsets, starts, "right") - 1
        good = np.diff(offsets) > 1
        good[row[~same[codes]]] = False
        use = good[row]
        out = []
        for pool, size in ((a, self.size_a), (b, self.size_b)):
            ids, n = pool(codes[use])
            sizes = size[ids]
            # Inside a unit, ends count from its start.
            total = np.cumsum(sizes)
            before = np.cumsum(n) - n
            out += [ids, total + np.repeat(starts[use] - (total - sizes)[before], n) if len(ids) else ids]
        return *out, good


@functools.lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


@functools.lru_cache(2)
def pair_tokenizer(path_a: str, path_b: str) -> PairTokenizer:
    return PairTokenizer(path_a, path_b)
