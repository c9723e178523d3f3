"""Word shingles of UTF-8 texts as 64-bit hashes, computed for many texts at once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_BASE = 0x9E3779B97F4A7C15
#: The longest text whose powers a worker keeps: 16 MB for both.
_KEPT = 1 << 20
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """At least n powers of the base and of its inverse; a worker keeps one pair of tables, whose heads serve all shorter texts."""
    if n > _KEPT:
        return _make(n)
    if not _POWERS or len(_POWERS[0][0]) < n:
        _POWERS[:] = [_make(1 << max(16, (n - 1).bit_length()))]
    return _POWERS[0]


def _make(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    return out[0], out[1]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of the texts, A-Z lower-cased, and the number of words of each text."""
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    edge = np.diff(np.concatenate([[True], _SPACE[data]]).astype(np.int8))
    begin, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = _powers(len(data))
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((_LOWER[data] + np.uint64(1)) * up[: len(data)], dtype=np.uint64)])
    words = mix((total[end] - total[begin]) * down[begin])
    ends = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(begin, ends), prepend=0)


def shingle_sets(texts: list[bytes | None], width: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text; with fewer words than width, all words as one; else none."""
    some = [t or b"" for t in texts]
    words, counts = word_hashes(some)
    one, base = np.uint64(1), np.uint64(0xD6E8FEB86659FD93)
    whole = np.zeros(max(0, len(words) - width + 1), np.uint64)
    for k in range(width):
        whole = whole * base + words[k : len(words) - width + 1 + k] if len(whole) else whole
    whole = mix(whole)
    at = 0
    for m in counts.tolist():
        if m >= width:
            yield np.unique(whole[at : at + m - width + 1])
        elif m:
            h = np.uint64(m)
            with np.errstate(over="ignore"):
                for w in words[at : at + m]:
                    h = h * base + w
            yield mix(np.array([h ^ one << np.uint64(63)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        at += m


def chunks(texts: list[bytes | None], most: int = 1 << 19) -> Iterator[tuple[int, int]]:
    """Ranges of texts of at most about `most` bytes together; a longer text is alone."""
    a = size = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > a and size + n > most:
            yield a, i
            a, size = i, 0
        size += n
    if len(texts) > a:
        yield a, len(texts)
