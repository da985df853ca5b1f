"""Vectorised numpy text helpers over the UTF-8 bytes of Arrow string columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
#: Bytes [\x20\x09-\x0D]; everything else belongs to a word.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_SPACE = ~SPACE
#: Bytes of letters and digits after lower-casing: 0-9, a-z and all of non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
#: Power tables are kept for the life of a worker up to this many entries (64 MB for both); longer texts make their own and drop them.
_KEPT = 1 << 22
_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse mod 2**64, up to n."""
    if len(_powers.get("up", ())) > n:
        return _powers["up"], _powers["down"]
    size = n + 1 if n >= _KEPT else min(_KEPT, max(1 << 20, 1 << int(n + 1).bit_length()))
    made = {}
    for name, base in (("up", _BASE), ("down", _INVERSE)):
        x = np.full(size, base, _U)
        x[0] = 1
        made[name] = np.cumprod(x)
    if size <= _KEPT:
        _powers.update(made)
    return made["up"], made["down"]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective scrambling of uint64 values (the splitmix64 finaliser)."""
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def binary(column: pa.Array) -> pa.Array:
    """The column as large binary, null as empty."""
    return pc.fill_null(column.cast(pa.large_string()), "").cast(pa.large_binary())


def slices(column: pa.Array, limit: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) over runs of whole rows with at most limit bytes; a longer row comes alone."""
    column = binary(column)
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        end = min(end, n, row + 4096)
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


class Hasher:
    """64-bit hashes of any spans of one byte array, from prefix sums."""

    def __init__(self, data: np.ndarray):
        self.up, self.down = _power_tables(len(data))
        self.sums = np.zeros(len(data) + 1, _U)
        np.cumsum((data.astype(_U) + _U(1)) * self.up[: len(data)], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        h = (self.sums[ends] - self.sums[starts]) * self.down[starts]
        return mix(h + (ends - starts).astype(_U) * _U(0xD6E8FEB86659FD93))


class SecondHasher:
    """Other 64-bit hashes of the same spans, from sums over their scrambled runs of eight bytes (a shorter span: its length only).

    Together with Hasher they are a digest of 128 bits that no linear relation between bytes gets past.
    """

    def __init__(self, data: np.ndarray, first: Hasher):
        n = max(0, len(data) - 7)
        self.down = first.down
        self.sums = np.zeros(n + 1, _U)
        if n:
            eight = np.ndarray((n,), "<u8", np.ascontiguousarray(data), 0, (1,))
            np.cumsum(mix(eight + _U(0xA0761D6478BD642F)) * first.up[:n], out=self.sums[1:])

    def __call__(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        a = np.minimum(starts, len(self.sums) - 1)
        b = np.maximum(np.minimum(ends - 7, len(self.sums) - 1), a)
        return mix((self.sums[b] - self.sums[a]) * self.down[a] + (ends - starts).astype(_U) * _U(0xE7037ED1A0B428DB))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes whose entry of inside is true, never across rows.

    Returns starts, ends and first: run first[r] is the first run of row r (length rows + 1).
    """
    m = np.zeros(len(data) + 2, bool)
    m[1:-1] = inside[data]
    core = m[1:-1]
    begin, end = core & ~m[:-2], core & ~m[2:]
    seams = offsets[1:-1]
    seams = seams[(seams > 0) & (seams < len(data))]
    begin[seams] = core[seams]
    end[seams - 1] = core[seams - 1]
    starts = np.flatnonzero(begin)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offsets)


def row_of(first: np.ndarray) -> np.ndarray:
    """The row of each run, given where each row's runs begin."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def grams(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of the k successive word hashes from each position (across rows too; see gram_ok)."""
    n = max(0, len(words) - k + 1)
    h = np.full(n, k, _U)
    for j in range(k):
        h = mix(h * _U(0x9FB21C651E98DF25) + words[j : j + n])
    return h


def gram_ok(first: np.ndarray, k: int) -> np.ndarray:
    """Boolean array: whether the k-gram from each position stays inside its row."""
    last = np.repeat(first[1:], np.diff(first))
    n = max(0, len(last) - k + 1)
    return np.arange(n) + k <= last[:n]


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values between successive offsets, zero for empty rows."""
    sums = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return sums[offsets[1:]] - sums[offsets[:-1]]
