"""Vectorised word hashing for tasks that see whole texts as Arrow or pandas batches.

A batch of texts is laid out as one UTF-8 byte array; word boundaries, 64-bit word hashes and
shingle hashes are then computed with whole-array numpy operations, so no Python loop runs per
word. Word separators are ASCII, so byte-wise splitting of UTF-8 is exact.

Edge cases: null and empty texts give no words; a text of any length is one array slice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np

#: Bytes of text laid out at once; a longer single text forms a block of its own.
BLOCK_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser, so that near-equal hashes spread over all bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    if n:
        out[0] = 1
        out[1:] = np.uint64(base & 0xFFFFFFFFFFFFFFFF)
        np.multiply.accumulate(out, out=out)
    return out


_INVERSE = pow(_BASE, -1, 1 << 64)
_CACHE: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = max(BLOCK_BYTES + 65536, n)
    if size > max(_CACHE, default=0):
        _CACHE.clear()
        _CACHE[size] = _powers(_BASE, size), _powers(_INVERSE, size)
    up, down = next(iter(_CACHE.values()))
    return up[:n], down[:n]


def utf8(text: str) -> bytes:
    return text.encode("utf-8", "surrogatepass")


def blocks(texts: Sequence[str | None], limit: int = BLOCK_BYTES, encode: Callable[[str], bytes] = utf8) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
    """Yields (first row, end row, bytes, row starts) for runs of rows of about ``limit`` bytes.

    Each text is followed by one space, so words never cross rows; ``row starts`` has one more
    entry than there are rows."""
    parts: list[bytes] = []
    first = total = 0
    for i, t in enumerate(texts):
        b = encode(t) if isinstance(t, str) else b""
        if parts and total + len(b) > limit:
            yield first, i, b" ".join(parts) + b" ", _starts(parts)
            parts, first, total = [], i, 0
        parts.append(b)
        total += len(b) + 1
    if parts:
        yield first, first + len(parts), b" ".join(parts) + b" ", _starts(parts)


def _starts(parts: list[bytes]) -> np.ndarray:
    return np.concatenate([[0], np.cumsum([len(p) + 1 for p in parts])]).astype(np.int64)


def words(data: bytes, starts: np.ndarray, separator: np.ndarray = _SPACE, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte) of every word, and the first word of each row (rows + 1 entries).

    ``lower`` folds A-Z only. ``separator`` is a 256-entry table of the bytes between words."""
    raw = np.frombuffer(data, np.uint8)
    inside = ~separator[raw]
    edge = np.diff(inside.view(np.int8), prepend=0, append=0)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _tables(len(raw) + 1)
    folded = _LOWER[raw] if lower else raw
    total = np.empty(len(raw) + 1, np.uint64)
    total[0] = 0
    np.cumsum((folded.astype(np.uint64) + np.uint64(1)) * up[: len(raw)], out=total[1:])
    value = mix((total[end] - total[begin]) * down[begin] + (end - begin).astype(np.uint64))
    return value, begin, end, np.searchsorted(begin, starts).astype(np.int64)


def shingles(value: np.ndarray, n: int) -> np.ndarray:
    """Hash of the ``n`` consecutive words that start at each word (the last ``n - 1`` are omitted)."""
    if len(value) < n:
        return np.zeros(0, np.uint64)
    m = len(value) - n + 1
    out = np.zeros(m, np.uint64)
    for k in range(n):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + value[k : k + m])
    return out


def shingle_sets(texts: Sequence[str | None], n: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Per row: (row, sorted distinct shingle hashes, word hashes).

    A text with fewer than ``n`` words (but one at least) has its whole word sequence as its one
    shingle; a null, empty or blank text has none."""
    for first, end, data, starts in blocks(texts):
        value, _, _, row = words(data, starts)
        all_shingles = shingles(value, n)
        for i in range(end - first):
            own = value[row[i] : row[i + 1]]
            if len(own) >= n:
                yield first + i, np.unique(all_shingles[row[i] : row[i + 1] - n + 1]), own
            elif len(own):
                whole = np.uint64(len(own))
                for h in own:
                    whole = _fold(whole, h)
                yield first + i, np.array([whole], np.uint64), own
            else:
                yield first + i, np.zeros(0, np.uint64), own


def _fold(a: np.uint64, b: np.uint64) -> np.uint64:
    return mix(np.array([a], np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.array([b], np.uint64))[0]
