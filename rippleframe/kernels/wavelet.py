"""Lifting of whole arrays in numpy, for any origin: 5/3 on integers, 9/7 on floats."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

from ..operators.lifting import ALPHA, BETA, DELTA, GAMMA, K
from .markers import REVERSIBLE


def _lift(x: np.ndarray, odd: int, origin: int, change) -> None:
    """Changes the samples at odd or even places of the last axis by the sum of their neighbours, mirrored at the ends."""
    n, first = x.shape[-1], (odd - origin) % 2
    if first >= n:
        return
    here = x[..., first::2]
    k = here.shape[-1]
    left = x[..., first - 1 :: 2][..., :k] if first else np.concatenate([x[..., 1:2], x[..., 1::2]], -1)[..., :k]
    right = x[..., first + 1 :: 2]
    if right.shape[-1] < k:
        right = np.concatenate([right, left[..., -1:]], -1)
    here += change(left + right[..., :k])


_STEPS97 = ((1, ALPHA), (0, BETA), (1, GAMMA), (0, DELTA))


def analyse(x: np.ndarray, origin: int, wavelet: int) -> np.ndarray:
    """Low samples first, then high ones, along the last axis."""
    x = x.copy()
    n, first = x.shape[-1], origin % 2
    if n == 1:
        return x * 2 if first and wavelet == REVERSIBLE else x
    if wavelet == REVERSIBLE:
        _lift(x, 1, origin, lambda s: -(s >> 1))
        _lift(x, 0, origin, lambda s: s + 2 >> 2)
        return np.concatenate([x[..., first::2], x[..., 1 - first :: 2]], -1)
    for odd, factor in _STEPS97:
        _lift(x, odd, origin, lambda s, f=factor: s * f)
    return np.concatenate([x[..., first::2] / K, x[..., 1 - first :: 2] * (K / 2)], -1)


def synthesise(x: np.ndarray, origin: int, wavelet: int) -> np.ndarray:
    n, first = x.shape[-1], origin % 2
    if n == 1:
        return x >> 1 if first and wavelet == REVERSIBLE else x.copy()
    low = (n + 1 - first) // 2
    out = np.empty_like(x)
    if wavelet == REVERSIBLE:
        out[..., first::2], out[..., 1 - first :: 2] = x[..., :low], x[..., low:]
        _lift(out, 0, origin, lambda s: -(s + 2 >> 2))
        _lift(out, 1, origin, lambda s: s >> 1)
        return out
    out[..., first::2], out[..., 1 - first :: 2] = x[..., :low] * K, x[..., low:] * (2 / K)
    for odd, factor in reversed(_STEPS97):
        _lift(out, odd, origin, lambda s, f=factor: -s * f)
    return out


def turned(f, x: np.ndarray, origin: int, wavelet: int) -> np.ndarray:
    return f(x.swapaxes(0, 1), origin, wavelet).swapaxes(0, 1)


def analyse2d(x: np.ndarray, x0: int, y0: int, levels: int, wavelet: int) -> np.ndarray:
    """All levels, columns then rows; a level's bands lie in the quadrants of the level before."""
    out = x.astype(np.int64 if wavelet == REVERSIBLE else np.float64)
    h, w = x.shape
    for _ in range(levels):
        if h and w:
            out[:h, :w] = analyse(turned(analyse, out[:h, :w], y0, wavelet), x0, wavelet)
        h, w = -(-(y0 + h) // 2) - -(-y0 // 2), -(-(x0 + w) // 2) - -(-x0 // 2)
        x0, y0 = -(-x0 // 2), -(-y0 // 2)
    return out


def synthesise2d(x: np.ndarray, bounds: list[tuple[int, int, int, int]], wavelet: int) -> np.ndarray:
    """x as analyse2d gives it; bounds of the resolutions from the coarsest on: x0, y0, x1, y1. Rows then columns."""
    out = x.astype(np.int64 if wavelet == REVERSIBLE else np.float64)
    for x0, y0, x1, y1 in bounds[1:]:
        h, w = y1 - y0, x1 - x0
        if h and w:
            out[:h, :w] = turned(synthesise, synthesise(out[:h, :w], x0, wavelet), y0, wavelet)
    return out


@lru_cache(None)
def norm(wavelet: int, level: int, kind: int) -> float:
    """Root of the energy of a coefficient's image: level from 1, kind 0 LL, 1 HL, 2 LH, 3 HH."""

    def one(high: bool) -> float:
        n = 16 << level
        x = np.zeros(n)
        x[(n >> level) // 2 + (high * (n >> level))] = 1.0
        for k in range(level, 0, -1):
            m = n >> k - 1
            # The reversible filter without its rounding.
            if wavelet == REVERSIBLE:
                y = np.empty(m)
                y[::2], y[1::2] = x[: m // 2], x[m // 2 : m]
                _lift(y, 0, 0, lambda s: -s / 4)
                _lift(y, 1, 0, lambda s: s / 2)
                x[:m] = y
            else:
                x[:m] = synthesise(x[:m].copy(), 0, 0)
        return float(np.sqrt((x * x).sum()))

    return one(bool(kind & 1)) * one(kind > 1)
