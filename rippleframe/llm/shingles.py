"""Sets of word shingles as 64-bit hashes, for many texts at once in numpy.

Words are runs of characters other than [\\x20\\x09-\\x0D], A-Z lower-cased; a text with fewer words than a
shingle has its whole word sequence as its only one; a text without words has none.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

WIDTH = 5
#: Bytes of text that are hashed at once; a longer text is hashed alone.
CHUNK = 1 << 20
_P = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    byte = np.arange(256, dtype=np.uint64)
    lower = byte.copy()
    lower[65:91] += np.uint64(32)
    space = np.zeros(256, bool)
    space[[32, 9, 10, 11, 12, 13]] = True
    up = np.full(CHUNK * 2, _P)
    up[0] = 1
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    down = np.full(CHUNK * 2, inverse)
    down[0] = 1
    with np.errstate(over="ignore"):
        return mix(lower + np.uint64(1) * _P), space, np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, up, down = _tables()
    if n <= len(up):
        return up[:n], down[:n]
    one = np.full(n, _P)
    one[0] = 1
    back = np.full(n, np.uint64(pow(int(_P), -1, 1 << 64)))
    back[0] = 1
    return np.cumprod(one, dtype=np.uint64), np.cumprod(back, dtype=np.uint64)


def _chunk(raw: list[bytes]) -> list[np.ndarray]:
    table, space, *_ = _tables()
    lengths = np.fromiter(map(len, raw), np.int64, len(raw)) + 1
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    blank = space[data]
    word = ~blank
    edge = np.diff(word.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    up, down = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(table[data] * up[: len(data)], out=total[1:])
    words = mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))
    bound = np.searchsorted(start, np.concatenate([[0], np.cumsum(lengths)]))
    weight = mix(np.arange(1, WIDTH + 1, dtype=np.uint64) * _P) | np.uint64(1)
    if len(words) >= WIDTH:
        rolled = mix(sum((words[i : len(words) - WIDTH + 1 + i] * weight[i] for i in range(1, WIDTH)), words[: len(words) - WIDTH + 1] * weight[0]))
    out = []
    for a, b in zip(bound[:-1].tolist(), bound[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            x = rolled[a : b - WIDTH + 1].copy()
            x.sort()
            out.append(x[np.concatenate([[True], x[1:] != x[:-1]])])
        elif b > a:
            out.append(mix((words[a:b] * weight[: b - a]).sum(keepdims=True) + np.uint64(b - a)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def shingle_sets(texts: list[str]) -> list[np.ndarray]:
    """The sorted distinct shingles of each text."""
    out: list[np.ndarray] = []
    part: list[bytes] = []
    held = 0
    with np.errstate(over="ignore"):
        for t in texts:
            raw = t.encode("utf-8", "replace")
            if part and held + len(raw) > CHUNK:
                out += _chunk(part)
                part, held = [], 0
            part.append(raw)
            held += len(raw) + 1
        if part:
            out += _chunk(part)
    return out


def signature(shingles: np.ndarray) -> int:
    """A signed 64-bit name of a set."""
    with np.errstate(over="ignore"):
        x = mix((mix(shingles ^ np.uint64(0xA0761D6478BD642F)).sum(keepdims=True) + np.uint64(len(shingles)) * _P))
    return int(x.astype(np.int64)[0])
