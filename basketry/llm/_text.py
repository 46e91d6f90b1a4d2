"""Words and their hashes, for whole Arrow batches at a time.

Texts are handled as UTF-8 bytes: the separators of every word class used here are
ASCII, so splitting bytes and splitting characters agree. Work goes in slices of whole
documents of about SLICE bytes. A document that is longer than that makes a slice of its
own, and its words are found part by part, so that besides the document itself only
numbers for each of its words are held.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 20
U = np.uint64

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_BASE = U(0x9E3779B97F4A7C15 | 1)
_BASE_INVERSE = U(pow(int(_BASE), -1, 2**64))
_STEP = _rng.integers(1, 2**63, 64, dtype=np.uint64) | U(1)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

AS_IS = np.arange(256, dtype=np.uint8)
#: All but the space.
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[32] = False
#: Word characters of the near-duplicate contract: everything but space and \t to \r.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[32, 9, 10, 11, 12, 13]] = False
#: Word characters of the decontamination contract, after lower-casing: 0-9, a-z and non-ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[65:91] = ALNUM[128:] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the splitmix finaliser)."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, at least n of each."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, _BASE_INVERSE)):
            a = np.full(max(n, SLICE + 1), base, np.uint64)
            a[0] = 1
            _powers[i] = np.cumprod(a, dtype=np.uint64)
    return _powers[0], _powers[1]


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), off


def slices(off: np.ndarray, limit: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts have about `limit` bytes together; every row in exactly one."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, hi
        lo = hi


def _parts(seg: np.ndarray, is_word: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a text's bytes, of about SLICE each, that cut no word."""
    lo, n = 0, len(seg)
    while lo < n:
        hi = min(lo + SLICE, n)
        while hi < n:
            gap = np.flatnonzero(~is_word[seg[hi : hi + SLICE]])
            hi += int(gap[0]) if len(gap) else min(SLICE, n - hi)
            if len(gap):
                break
        yield lo, hi
        lo = hi


def words(data: np.ndarray, off: np.ndarray, lo: int, hi: int, is_word: np.ndarray, fold: np.ndarray = _LOWER, prefixes: tuple[int, ...] = ()) -> tuple:
    """Of rows lo to hi: the hashes of their words with A-Z lower-cased (or bytes folded by another table), where each row's words begin (hi - lo + 1 numbers), and the words' first and end bytes, counted from the slice's start. With prefixes: also, for each of those numbers of characters, the words that are longer and the hashes of their beginnings."""
    if hi - lo > 1 or off[hi] - off[lo] <= 2 * SLICE:
        return _words(data, off, lo, hi, is_word, fold, prefixes)
    found: list[list] = [[] for _ in range(3 + 2 * len(prefixes))]
    count, base = 0, int(off[lo])
    for a, b in _parts(data[base : off[hi]], is_word):
        h, _, first, end, *more = _words(data, np.array([base + a, base + b]), 0, 1, is_word, fold, prefixes)
        for column, x in zip(found, (h, first + a, end + a, *(y for which, hashes in more for y in (which + count, hashes)))):
            column.append(x)
        count += len(h)
    h, first, end, *more = (np.concatenate(x) for x in found)
    return h, np.array([0, len(h)]), first, end, *zip(more[::2], more[1::2])


def _words(data: np.ndarray, off: np.ndarray, lo: int, hi: int, is_word: np.ndarray, fold: np.ndarray, prefixes: tuple[int, ...]) -> tuple:
    """words() for a slice that is taken at once."""
    base = off[lo]
    seg, starts = data[base : off[hi]], off[lo : hi + 1] - base
    n = len(seg)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), np.zeros(hi - lo + 1, np.int64), none, none, *((none, np.zeros(0, np.uint64)) for _ in prefixes)
    m = is_word[seg]
    before = np.empty(n, bool)
    before[0], before[1:] = False, m[:-1]
    before[starts[starts < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, m[1:]
    after[starts[(starts > 0) & (starts < n)] - 1] = False
    first, end = np.flatnonzero(m & ~before), np.flatnonzero(m & ~after) + 1
    up, down = powers(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[fold][seg] * up[:n], out=sums[1:])
    h = mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))
    more = []
    if prefixes:
        whole = (seg & 0xC0) != 0x80
        begin = np.flatnonzero(whole)
        count = np.cumsum(whole)
        char, chars = count[first] - 1, count[end - 1] - count[first] + 1
    for k in prefixes:
        long = np.flatnonzero(chars > k)
        more.append((long, mix((sums[begin[char[long] + k]] - sums[first[long]]) * down[first[long]] + U(1 << 32 | k))))
    return h, np.searchsorted(first, starts), first, end, *more


def hashes(seg: np.ndarray, first: np.ndarray, end: np.ndarray, fold: np.ndarray = _LOWER) -> np.ndarray:
    """Hashes of the given ranges of bytes, with A-Z lower-cased (or bytes folded by another table); of words, the same as words() gives."""
    up, down = powers(len(seg) + 1)
    sums = np.zeros(len(seg) + 1, np.uint64)
    np.cumsum(_BYTE[fold][seg] * up[: len(seg)], out=sums[1:])
    return mix((sums[end] - sums[first]) * down[first] + (end - first).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of every k consecutive word hashes, across rows too: callers keep those within a row."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    g = h[:n] * _STEP[0]
    for i in range(1, k):
        g = g + h[i : i + n] * _STEP[i % 64] + U(i)
    return mix(g)
