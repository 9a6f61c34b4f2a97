"""Words and rolling hashes of texts, for the Python side of the operators.

A word is a run of bytes other than 0x20 and 0x09-0x0D, which is what bytes.split() cuts out.
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    return x ^ (x >> np.uint64(31))


def words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def tokens(strings: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words of strings in a row: the distinct ones, each word's place among them, and where each string's begin (one more entry at the end)."""
    trimmed = pc.ascii_trim_whitespace(strings)
    full = pc.greater(pc.binary_length(trimmed), 0)
    sizes = np.zeros(len(trimmed), np.int64)
    filled = full.to_numpy(zero_copy_only=False)
    cut = pc.ascii_split_whitespace(trimmed if filled.all() else trimmed.filter(full))
    sizes[filled] = np.diff(np.asarray(cut.offsets))
    found = cut.flatten().dictionary_encode()
    return found.dictionary, found.indices.to_numpy(), np.r_[0, np.cumsum(sizes)]


def _terms(byte: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mix((place.astype(np.uint64) << np.uint64(8)) + byte.astype(np.uint64) + _BASE)


_SHORT = 64
#: Terms of all bytes at the first places of a word.
_TABLE = _terms(np.tile(np.arange(256), _SHORT), np.repeat(np.arange(_SHORT), 256))


def hashed(distinct: pa.Array) -> np.ndarray:
    """A 64-bit hash of each string: the sum of a fixed random number for each byte at its place, and the length."""
    size = len(distinct)
    if not size:
        return np.zeros(0, np.uint64)
    own = distinct.cast(pa.large_string())
    at = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + size + 1]
    raw = np.frombuffer(own.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    at = at - at[0]
    lengths = np.diff(at)
    place = np.arange(len(raw)) - np.repeat(at[:-1], lengths)
    terms = _TABLE[(np.minimum(place, _SHORT - 1) << 8) + raw]
    far = np.flatnonzero(place >= _SHORT)
    terms[far] = _terms(raw[far], place[far])
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(terms, out=sums[1:])
    return mix(sums[at[1:]] - sums[at[:-1]] + lengths.astype(np.uint64) * _MIX1)


_BLANK = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_DIGIT = np.isin(np.arange(256), np.arange(48, 58))
#: Words that are hashed at once.
_AT_ONCE = 1 << 13


def raw_bytes(own: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of strings in a row, and where each string's begin (one more entry at the end)."""
    at = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
    raw = np.frombuffer(own.buffers()[2], np.uint8)[at[0] : at[-1]] if at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_places(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last but one byte of each word of strings in a row; no word reaches over the end of its string."""
    blank = _BLANK[raw]
    edge = at[:-1][at[:-1] < at[1:]]
    before = np.r_[True, blank][:-1] if len(raw) else blank
    before[edge] = True
    first = np.flatnonzero(before & ~blank)
    after = np.r_[blank[1:], True] if len(raw) else blank.copy()
    after[edge[1:] - 1] = True
    return first, np.flatnonzero(after & ~blank) + 1


def hashed_in_place(raw: np.ndarray, first: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What hashed() gives for each of the words at these places, and whether it has a digit; bytes between words cancel out."""
    names, digit = np.zeros(len(first), np.uint64), np.zeros(len(first), bool)
    for s in range(0, len(first), _AT_ONCE):
        a, b = first[s : s + _AT_ONCE], end[s : s + _AT_ONCE]
        own = raw[a[0] : b[-1]]
        a, b = a - a[0], b - a[0]
        gaps = np.diff(a, append=len(own))
        place = np.arange(len(own), dtype=np.int32) - np.repeat(a.astype(np.int32), gaps)
        if gaps.max() <= _SHORT:
            terms = _TABLE[(place << 8) + own]
        else:
            terms = _TABLE[(np.minimum(place, _SHORT - 1) << 8) + own]
            far = np.flatnonzero(place >= _SHORT)
            terms[far] = _terms(own[far], place[far])
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(terms, out=sums[1:])
        names[s : s + len(a)] = mix(sums[b] - sums[a] + (b - a).astype(np.uint64) * _MIX1)
        digit[s : s + len(a)] = np.logical_or.reduceat(_DIGIT[own], a)
    return names, digit


def strings(texts) -> pa.Array:
    """Texts as an Arrow array, nulls as empty ones."""
    return pc.fill_null(pa.array(texts, pa.large_string(), from_pandas=True), "")


def word_hashes(texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and where each text begins (one more entry at the end)."""
    own = strings(texts)
    distinct, places, at = tokens(pc.ascii_lower(own) if lower else own)
    return hashed(distinct)[places], at


def _inverse(odd: int) -> int:
    return pow(odd, -1, 1 << 64)


def rolling(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n consecutive entries, by prefix sums of a polynomial modulo 2**64."""
    size = len(hashes)
    if size < n:
        return np.zeros(0, np.uint64)
    up = np.full(size, _BASE, np.uint64)
    up[0] = 1
    np.cumprod(up, out=up)
    down = np.full(size - n + 1, np.uint64(_inverse(int(_BASE))), np.uint64)
    down[0] = 1
    np.cumprod(down, out=down)
    sums = np.zeros(size + 1, np.uint64)
    np.cumsum(hashes * up, out=sums[1:])
    return mix((sums[n:] - sums[:-n]) * down + np.uint64(n))


def starts_within(offsets: np.ndarray, n: int) -> np.ndarray:
    """For rolling(): true where a window lies in one text."""
    size = int(offsets[-1])
    if size < n:
        return np.zeros(0, bool)
    inside = np.zeros(size + 1, np.int32)
    lengths = np.diff(offsets)
    keep = lengths >= n
    np.add.at(inside, offsets[:-1][keep], 1)
    np.add.at(inside, offsets[1:][keep] - n + 1, -1)
    return np.cumsum(inside)[: size - n + 1] > 0


def covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of size places lie in a window of n places that begins at one of starts."""
    step = np.zeros(size + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + n, size), -1)
    return np.cumsum(step[:size]) > 0


def tidy() -> None:
    """Gives memory that a worker has freed back to the system; workers live on after a task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another libc
        pass
