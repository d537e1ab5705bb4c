"""Hashes of words and of runs of words, vectorised over a text's bytes."""

from __future__ import annotations

import numpy as np

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_IS_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])
_random = np.random.default_rng(20)
_BYTE = _random.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _random.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FAR = _random.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SLOT = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SECOND = _random.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: str, lower: bool = True) -> np.ndarray:
    """64-bit hash of each word, A-Z lower-cased or not."""
    own = text.encode("utf-8")
    raw = np.frombuffer(own.translate(_LOWER) if lower else own, np.uint8)
    if not len(raw):
        return np.zeros(0, np.uint64)
    space = _IS_SPACE[raw]
    edge = np.diff(space.astype(np.int8), prepend=1, append=1)
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return np.zeros(0, np.uint64)
    inside = np.flatnonzero(~space)
    sizes = ends - starts
    offset = np.cumsum(sizes) - sizes
    place = np.arange(len(inside)) - np.repeat(offset, sizes)
    value = _BYTE[raw[inside]] * _PLACE[place & 4095]
    if len(raw) > 4096 and (far := place >> 12).any():
        value = value * _FAR[far & 4095]
    return mix(np.add.reduceat(value, offset) + sizes.astype(np.uint64))


def run_hashes(words: np.ndarray, size: int, starts: np.ndarray | None = None, second: bool = False) -> np.ndarray:
    """Hash of each run of ``size`` words, or of those at ``starts``; ``second`` gives an unrelated one."""
    slots = _SECOND if second else _SLOT
    n = len(words) - size + 1 if starts is None else len(starts)
    h = np.full(n, np.uint64(size))
    for i in range(size):
        h = h + (words[i : i + n] if starts is None else words[starts + i]) * slots[i % 64]
        if i % 64 == 63:
            h = mix(h)
    return mix(h)
