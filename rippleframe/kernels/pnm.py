"""Portable grey and pixel maps (P2, P3, P5, P6) as planes; for comparing with other decoders' output."""

from __future__ import annotations

import re

import numpy as np

_FIELD = re.compile(rb"(?:\s|#[^\n]*\n)*(\d+)")


def read(data: bytes) -> tuple[list[np.ndarray], int]:
    """Planes and the largest value."""
    kind, at, fields = data[:2], 2, []
    if kind not in (b"P2", b"P3", b"P5", b"P6"):
        raise ValueError("not a grey or pixel map")
    while len(fields) < 3:
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("the header is cut short")
        fields.append(int(m[1]))
        at = m.end()
    width, height, top = fields
    n = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P2", b"P3"):
        values = np.array([int(v) for v in re.sub(rb"#[^\n]*", b"", data[at:]).split()], np.int64)
    else:
        values = np.frombuffer(data[at + 1 :], ">u2" if top > 255 else "u1").astype(np.int64)
    if len(values) < width * height * n:
        raise ValueError("samples are missing")
    cube = values[: width * height * n].reshape(height, width, n)
    return [cube[..., c] for c in range(n)], top


def write(planes: list[np.ndarray], top: int = 255) -> bytes:
    high, wide = planes[0].shape
    head = f"P{6 if len(planes) == 3 else 5}\n{wide} {high}\n{top}\n".encode()
    return head + np.stack(planes, -1).astype(">u2" if top > 255 else "u1").tobytes()
