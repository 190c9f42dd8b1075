"""Word and shingle hashes of texts, in numpy.

Words are runs of bytes other than space and \\t to \\r, with A-Z lowered.  Hashes have 64 bits and serve as identities.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np

GOLD = np.uint64(0x9E3779B97F4A7C15)
STEP = np.uint64(0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """A random value for each byte, the same for both cases of a letter, and which bytes separate words."""
    low = np.arange(256, dtype=np.uint64)
    low[65:91] += np.uint64(32)
    gap = np.zeros(256, bool)
    gap[[32, 9, 10, 11, 12, 13]] = True
    return mix((low + np.uint64(1)) * GOLD), gap


BACK = np.uint64(pow(int(STEP), -1, 1 << 64))
BLOCK = 1 << 20
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int, back: bool = False) -> np.ndarray:
    """The first n powers of STEP, or of its inverse; kept, as far as BLOCK."""
    have = _powers[back]
    if len(have) < n:
        size = max(n, min(BLOCK, 2 * len(have)))
        have = np.cumprod(np.concatenate([[np.uint64(1)], np.full(size - 1, BACK if back else STEP)]))
        if size <= BLOCK:
            _powers[back] = have
    return have[:n]


def words(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of each word.  A long text is hashed in blocks that end between words."""
    if len(data) <= BLOCK:
        return _words(np.frombuffer(data, np.uint8))
    _, gap = _bytes()
    raw, at, parts = np.frombuffer(data, np.uint8), 0, []
    while at < len(raw):
        stop = min(at + BLOCK, len(raw))
        while stop < len(raw) and not gap[raw[at:stop]].any():
            stop = min(stop + BLOCK, len(raw))
        if stop < len(raw):
            stop = at + int(np.flatnonzero(gap[raw[at:stop]])[-1]) + 1
        hashes, starts = _words(raw[at:stop])
        parts.append((hashes, starts + at))
        at = stop
    return np.concatenate([h for h, _ in parts]), np.concatenate([s for _, s in parts])


def _words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A word's hash is a difference of running sums, moved back to the word's own place."""
    value, gap = _bytes()
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~gap[raw]
    edge = np.diff(inside)
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(value[raw] * powers(len(raw)), out=sums[1:])
    own = (sums[stops] - sums[starts]) * powers(len(raw) + 1, back=True)[starts]
    return mix(own + (stops - starts).astype(np.uint64) * GOLD), starts


def shingle_set(text: str | None, k: int = 5) -> np.ndarray:
    """Sorted distinct hashes of runs of k words; of a shorter text, the whole as one; of no words, nothing."""
    w = words(text.encode("utf-8", "replace"))[0] if text else np.empty(0, np.uint64)
    n = len(w)
    if n == 0:
        return w
    length = min(k, n)
    scale = powers(length) * GOLD
    total = np.zeros(n - length + 1, np.uint64)
    for i in range(length):
        total += mix(w[i : n - length + 1 + i] + np.uint64(i)) * scale[i]
    return np.unique(mix(total + np.uint64(length)))


def grouped(texts: Iterable[str | None], size: int = BLOCK) -> Iterator[list[bytes]]:
    """The texts in UTF-8, in lists of about ``size`` bytes; a null is empty."""
    out, total = [], 0
    for text in texts:
        out.append((text or "").encode("utf-8", "replace"))
        total += len(out[-1])
        if total >= size:
            yield out
            out, total = [], 0
    if out:
        yield out


def shingle_sets(texts: Iterable[str | None], k: int = 5) -> Iterator[tuple[np.ndarray, bytes]]:
    """``shingle_set`` and the UTF-8 bytes of each text; texts are hashed together, which is faster for short ones."""
    for group in grouped(texts):
        w, at = words(b"\n".join(group))
        ends = np.cumsum([len(data) + 1 for data in group])
        last = np.searchsorted(at, ends)
        total = np.zeros(max(0, len(w) - k + 1), np.uint64)
        scale = powers(k) * GOLD
        for i in range(k):
            total += mix(w[i : len(total) + i] + np.uint64(i)) * scale[i]
        total = mix(total + np.uint64(k))
        for data, start, stop in zip(group, [0, *last[:-1].tolist()], last.tolist(), strict=True):
            n = stop - start
            if n >= k:
                found = total[start : stop - k + 1].copy()
                found.sort()
                fresh = np.empty(len(found), bool)
                fresh[0] = True
                np.not_equal(found[1:], found[:-1], out=fresh[1:])
                yield found[fresh], data
            else:
                yield shingle_set(data.decode(), k), data


def set_id(hashes: np.ndarray) -> int:
    """One signed 64-bit number for a set."""
    size = np.array([len(hashes)], np.uint64) * STEP
    return int(mix(mix(hashes ^ GOLD).sum(dtype=np.uint64, keepdims=True) + size).view(np.int64)[0])
