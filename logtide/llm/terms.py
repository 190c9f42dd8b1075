"""Hashes of terms, runs of letters, digits and characters beyond ASCII with A-Z lowered, in numpy.

A term's 64-bit hash serves as its identity.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

from .shingles import BLOCK, words

_KEPT = set(range(0x30, 0x3A)) | set(range(0x41, 0x5B)) | set(range(0x61, 0x7B)) | set(range(0x80, 0x100))
SPACED = bytes(b if b in _KEPT else 0x20 for b in range(256))
"""Every byte that no term holds becomes a space, so that terms are words."""
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
"""The same as a regular expression, for SQL."""


def pieces(texts: Sequence[str | None], size: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, stop, hashes, ends) of about ``size`` bytes of texts at a time: the hashes of texts first .. stop, and where each text's end.

    A null text has no term.
    """
    first, group, total = 0, [], 0
    for i, text in enumerate(texts):
        group.append((text or "").encode("utf-8", "replace").translate(SPACED))
        total += len(group[-1])
        if total >= size or i == len(texts) - 1:
            hashes, at = words(b" ".join(group))
            yield first, i + 1, hashes, np.searchsorted(at, np.cumsum([len(g) + 1 for g in group]))
            first, group, total = i + 1, [], 0


def sizes(texts: Sequence[str | None]) -> np.ndarray:
    """Terms of each text, repeats counted."""
    found = [np.diff(ends, prepend=0) for _, _, _, ends in pieces(texts)]
    return np.concatenate(found) if found else np.empty(0, np.int64)
