"""Word hashes of byte strings, computed with array operations.

A word's hash is a polynomial in its bytes modulo 2**64, mixed with a finaliser, so that hashes of all
words in a slice of text come from one running sum. Work goes in slices of about ``SLICE`` bytes that end
between words; memory does not grow with the text. A word longer than a slice is hashed by XXH64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SLICE = 1 << 19
_BASE = 0x9E3779B97F4A7C15 | 1
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)

#: Lower-cases A-Z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: White space only.
SPACES = np.zeros(256, dtype=bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: All but ASCII letters, digits and bytes of other scripts.
PUNCTUATION = np.ones(256, dtype=bool)
PUNCTUATION[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False

_powers: tuple[np.ndarray, np.ndarray] | None = None


def _tables() -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None:
        up = np.full(SLICE + 1, _BASE, dtype=np.uint64)
        down = np.full(SLICE + 1, pow(_BASE, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        _powers = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit values that spreads every bit."""
    h = (h ^ (h >> np.uint64(30))) * _M1
    h = (h ^ (h >> np.uint64(27))) * _M2
    return h ^ (h >> np.uint64(31))


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Hash of the sequence (a, b)."""
    return mix(a * np.uint64(0xD6E8FEB86659FD93) + mix(b + np.uint64(0x632BE59BD9B4E019)))


def polynomial(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Hashes of data[first:last] for each pair of bounds."""
    if len(data) > SLICE:  # words longer than a slice are rare; sums start again at a word in each slice
        cuts, at = [0], 0
        while at < len(first):
            at = max(at + 1, int(np.searchsorted(last, first[at] + SLICE, side="right")))
            cuts.append(at)
        return np.concatenate([_hashed(data[first[a] : last[z - 1]], first[a:z] - first[a], last[a:z] - first[a]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)])
    return _hashed(data, first, last)


def _hashed(data: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    if len(data) > SLICE:
        return np.array([xxhash.xxh64_intdigest(data[s:e].tobytes()) for s, e in zip(first, last, strict=True)], dtype=np.uint64)
    up, down = _tables()
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
    return mix((total[last] - total[first]) * down[first] + (last - first).astype(np.uint64))


def _slices(data: np.ndarray, separator: np.ndarray) -> Iterator[tuple[int, int]]:
    """Cuts between words; each slice but those that are one long word has at most SLICE bytes."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + SLICE)
        if end < n and not separator[data[end]]:
            gaps = np.flatnonzero(separator[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:
                while end < n and not separator[data[end]]:
                    more = np.flatnonzero(separator[data[end : end + SLICE]])
                    end = end + int(more[0]) if len(more) else min(n, end + SLICE)
        yield at, end
        at = end


def words(text: bytes | None, separator: np.ndarray = SPACES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of the words of one text; none for a null or empty one."""
    data = np.frombuffer(text or b"", dtype=np.uint8)
    found = []
    for a, z in _slices(data, separator):
        part = LOWER[data[a:z]]
        inner = np.concatenate(([False], ~separator[part], [False]))
        edges = np.flatnonzero(inner[1:] != inner[:-1])
        first, last = edges[::2], edges[1::2]
        found.append((_hashed(part, first, last), first + a, last + a))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def texts(column: pa.Array) -> Iterator[bytes]:
    """The byte strings of a binary column, nulls as empty ones."""
    for x in column:
        yield x.as_buffer().to_pybytes() if x.is_valid else b""
