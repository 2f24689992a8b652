"""Words and word shingles as 64-bit hashes, vectorised over the bytes of a text."""

from __future__ import annotations

import re

import numpy as np

#: Shingles of five words, compared at a similarity of three quarters.
WORDS = 5
_R = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Powers of a base and of its inverse, as many as a strip of text needs.
_SERIES: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes whose words are hashed at a time; a longer word is a strip of its own.
STRIP = 1 << 18
_GAP = re.compile(rb"[\x20\x09-\x0D]")


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _series(r: int, size: int) -> np.ndarray:
    out = np.full(size, r, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base ** 0..n-1 and their inverses, modulo 2 ** 64; base is odd. Kept up to a strip's length."""
    held = _SERIES.get(base)
    if held is None or len(held[0]) < n:
        held = _series(base, n), _series(pow(base, -1, 1 << 64), n)
        if n <= 2 * STRIP:
            _SERIES[base] = held
    return held[0][:n], held[1][:n]


def word_hashes(data: bytes) -> np.ndarray:
    """A hash of each word `[^\\x20\\x09-\\x0D]+` of data, A-Z as a-z, in order; in strips that end at white space, so that
    memory beyond the hashes themselves doesn't follow the text."""
    out, at = [], 0
    while at < len(data):
        gap = _GAP.search(data, at + STRIP)
        end = gap.start() if gap else len(data)
        out.append(_word_hashes(data[at:end]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _word_hashes(data: bytes) -> np.ndarray:
    text = np.frombuffer(data.lower(), np.uint8)
    inside = ~_SPACE[text]
    edges = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = powers(_R, max(len(text) + 1, STRIP))
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text + np.uint64(1)) * power[: len(text)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts])


def shingle_set(data: bytes, k: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of data's k-word shingles; with fewer words the whole sequence is one, without words there is none."""
    words = word_hashes(data)
    n = len(words)
    if not n:
        return words
    k_own = min(k, n)
    total = np.full(n - k_own + 1, k_own, np.uint64)
    for i in range(k_own):
        total = total * np.uint64(0xD6E8FEB86659FD93) + words[i : n - k_own + 1 + i]
    return np.unique(mix(total))
