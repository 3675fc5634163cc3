"""Vectorised 64-bit hashes of the words and word shingles of Arrow text columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 500_000
BLANKS = b" \t\n\v\f\r"
PUNCTUATION = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15


def _mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
        return h ^ (h >> np.uint64(32))


def pair_key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """One key for an ordered pair of hashes."""
    with np.errstate(over="ignore"):
        return _mix(left * np.uint64(_BASE) + (right ^ (right >> np.uint64(31))))


#: A random code for each byte; capital ASCII letters share that of the small ones.
_CODES = _mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(_BASE))
_CODES[65:91] = _CODES[97:123]


class _Powers:
    """Powers of the base and of its inverse modulo 2**64, as far as needed."""

    up = np.ones(1, dtype=np.uint64)
    down = np.ones(1, dtype=np.uint64)

    @classmethod
    def upto(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            while len(cls.up) < n:
                k = len(cls.up)
                cls.up = np.concatenate([cls.up, cls.up * np.uint64(pow(_BASE, k, 1 << 64))])
                cls.down = np.concatenate([cls.down, cls.down * np.uint64(pow(inverse, k, 1 << 64))])
        return cls.up[:n], cls.down


def text_chunks(texts: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, row bounds) for runs of rows of about CHUNK_BYTES; null counts as empty."""
    for part in texts.chunks if isinstance(texts, pa.ChunkedArray) else [texts]:
        part = part.cast(pa.large_string()).fill_null("")
        _, offsets, data = part.buffers()
        bounds = np.frombuffer(offsets, dtype=np.int64)[part.offset : part.offset + len(part) + 1] if len(part) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
        row = 0
        while row < len(part):
            end = max(row + 1, int(np.searchsorted(bounds, bounds[row] + CHUNK_BYTES, side="right")) - 1)
            yield row, raw[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
            row = end


def hash_words(raw: np.ndarray, bounds: np.ndarray, separators: bytes = BLANKS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in the rows, and the bounds of each row in them."""
    (words,), rows = hash_prefixes(raw, bounds, (None,), separators)
    return words, rows


def hash_prefixes(raw: np.ndarray, bounds: np.ndarray, lengths: tuple[int | None, ...], separators: bytes = BLANKS, apart: bytes = b"") -> tuple[list[np.ndarray], np.ndarray]:
    """As hash_words, for each of ``lengths`` the hashes of the words' first bytes (None: whole words).

    Runs of the bytes ``apart`` are words of their own.
    """
    n = len(raw)
    if not n:
        return [np.zeros(0, np.uint64) for _ in lengths], np.zeros(len(bounds), np.int64)
    is_sep = np.zeros(256, dtype=bool)
    is_sep[list(separators)] = True
    inside = ~is_sep[raw]
    breaks = np.zeros(n + 1, dtype=bool)
    breaks[bounds] = True
    if apart:
        is_apart = np.zeros(256, dtype=bool)
        is_apart[list(apart)] = True
        kind = is_apart[raw]
        breaks[1:n] |= kind[1:] != kind[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1] | breaks[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | breaks[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    with np.errstate(over="ignore"):
        up, down = _Powers.upto(n)
        total = np.empty(n + 1, dtype=np.uint64)
        total[0] = 0
        np.cumsum(_CODES[raw] * up, out=total[1:])
        found = [_mix((total[ends if k is None else np.minimum(ends, starts + k)] - total[starts]) * down[starts]) for k in lengths]
    return found, np.searchsorted(starts, bounds).astype(np.int64)


def count_words(texts: pa.Array, separators: bytes = BLANKS) -> np.ndarray:
    """The number of words in each row."""
    out = np.zeros(len(texts), dtype=np.int64)
    is_word = np.ones(256, dtype=bool)
    is_word[list(separators)] = False
    for row, raw, bounds in text_chunks(texts):
        inside = is_word[raw]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        starts = bounds[:-1][bounds[:-1] < bounds[1:]]
        first[starts] = inside[starts]
        out[row : row + len(bounds) - 1] = np.diff(np.concatenate([[0], np.cumsum(first)])[bounds])
    return out


def shingles(words: np.ndarray, rows: np.ndarray, size: int) -> Iterator[np.ndarray]:
    """For each row, the sorted distinct hashes of its ``size``-word shingles; a shorter row is one shingle."""
    joined = words.copy()
    for i in range(1, size):
        if len(joined) > 1:
            joined = pair_key(joined[:-1], words[i : i + len(joined) - 1])
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= size:
            yield np.unique(joined[a : b - size + 1])
        elif b > a:
            key = words[a : a + 1]
            for w in range(a + 1, b):
                key = pair_key(key, words[w : w + 1])
            yield _mix(key + np.uint64(b - a))
        else:
            yield np.zeros(0, np.uint64)
