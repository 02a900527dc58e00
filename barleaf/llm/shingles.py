"""Distinct word shingles of many texts at once, as 64-bit hashes.

Words are runs without ASCII white space, A-Z lower-cased. A text's set holds
its distinct shingles of ``WORDS`` words; a text with fewer words has its whole
sequence as one shingle, a text without words has none.
"""

from __future__ import annotations

import numpy as np

from barleaf.llm.tokenstore import mix

WORDS = 5
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
BASE = 0x9DDFEA08EB382D69
POWERS = np.cumprod(np.full(1 << 14, BASE, "u8"))


def odd(i: int) -> np.uint64:
    return mix(np.array([i], "u8"), 7)[0] | np.uint64(1)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word and where it starts."""
    letters = np.frombuffer(data, "u1")
    inside = ~SPACE[letters]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], inside, [False]]).view("i1")))
    starts, lengths = edge[::2], edge[1::2] - edge[::2]
    if not len(starts):
        return np.zeros(0, "u8"), starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(lengths.sum()) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        part = (letters[inside].astype("u8") + np.uint64(1)) * POWERS[place & (len(POWERS) - 1)]
        part ^= (place >> 14).astype("u8") * np.uint64(BASE)
        return mix(np.add.reduceat(part, first) + lengths.astype("u8") * odd(0)), starts


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Per text its sorted distinct shingle hashes."""
    raw = [(t or "").encode().lower() for t in texts]
    words, starts = word_hashes(b"\n".join(raw))
    limits = np.searchsorted(starts, np.cumsum([0, *(len(r) + 1 for r in raw)]))
    with np.errstate(over="ignore"):
        parts = [words * odd(1 + i) for i in range(WORDS)]
        n = max(0, len(words) - WORDS + 1)
        rolled = mix(sum((parts[i][i : i + n] for i in range(WORDS)), np.zeros(n, "u8")))
        out = []
        for a, b in zip(limits[:-1], limits[1:], strict=True):
            if b - a >= WORDS:
                out.append(np.unique(rolled[a : b - WORDS + 1]))
            elif b > a:
                out.append(mix(sum((parts[i][a + i : a + i + 1] for i in range(b - a)), np.full(1, b - a, "u8")), 3))
            else:
                out.append(np.zeros(0, "u8"))
    return out
