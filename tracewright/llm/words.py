"""Words, word hashes and word shingles of whole texts, in numpy."""

from __future__ import annotations

import numpy as np

#: A byte is part of a word unless it is in one of these ASCII ranges.
_IS_WORD = np.ones(256, bool)
for _a, _b in ((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)):
    _IS_WORD[_a : _b + 1] = False
_BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_BYTE = np.random.default_rng(8).integers(1, 2**63, 256, dtype=np.uint64)


def is_word(raw: np.ndarray) -> np.ndarray:
    """For each byte whether it is part of a word."""
    return _IS_WORD[raw]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers after which all bits look random."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(base: np.uint64, n: int) -> np.ndarray:
    return np.cumprod(np.concatenate(([np.uint64(1)], np.full(max(n - 1, 0), base))), dtype=np.uint64)


#: Bytes of a text that are hashed at a time; only a longer word makes it more.
SEGMENT = 1 << 16
_BACK = np.uint64(pow(int(_BASE), -1, 2**64))
_up, _down = powers(_BASE, SEGMENT + 1), powers(_BACK, SEGMENT + 1)


def _hashed(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, starts and ends: a word's hash is a polynomial over its own bytes, from sums over the segment's."""
    global _up, _down
    n = len(raw)
    if n > len(_up):
        _up, _down = powers(_BASE, n), powers(_BACK, n)
    word = _IS_WORD[raw]
    edge = np.flatnonzero(word[1:] != word[:-1]) + 1
    edge = np.concatenate(([0] if n and word[0] else [], edge, [n] if n and word[-1] else [])).astype(np.int64)
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[raw] * _up[:n], out=sums[1:])
    return mixed((sums[end] - sums[start]) * _down[start] + (end - start).astype(np.uint64)), start, end


def words_of(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
    """A text's words: 64-bit hashes, first bytes, ends; and its UTF-8 bytes with A-Z lower-cased."""
    low = text.encode("utf-8", "surrogatepass").lower()
    raw = np.frombuffer(low, np.uint8)
    if len(raw) <= SEGMENT:
        return *_hashed(raw), low
    parts, a = [], 0
    while a < len(raw):
        b = min(a + SEGMENT, len(raw))
        while b < len(raw) and _IS_WORD[raw[b - 1]] and _IS_WORD[raw[b]]:  # a segment ends where a word does
            b += 1
        h, start, end = _hashed(raw[a:b])
        parts.append((h, start + a, end + a))
        a = b
    return *(np.concatenate(x) for x in zip(*parts, strict=True)), low


def split_words(text: str) -> list[bytes]:
    _, start, end, low = words_of(text)
    return [low[a:b] for a, b in zip(start, end, strict=True)]


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of runs of ``size`` words; of all words, if there are fewer; of none, if there is none."""
    if text is None:
        return np.zeros(0, np.uint64)
    h = words_of(text)[0]
    if not len(h):
        return h
    size = min(size, len(h))
    out = np.zeros(len(h) - size + 1, np.uint64)
    for k in range(size):
        out = out * STEP + h[k : len(h) - size + 1 + k]
    return np.unique(mixed(out))
