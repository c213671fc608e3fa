"""Per-sample colour expressions: level shift, reversible and irreversible transforms, 8-bit output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def level_shift(v: Column, depth: int = 8) -> Column:
    return v - (1 << (depth - 1))


def rct(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return F.shiftright(r + g * 2 + b, 2), b - g, r - g


def rct_inverse(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    g = y - F.shiftright(cb + cr, 2)
    return cr + g, g, cb + g


def ict(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    return (
        r * F.lit(0.299) + g * F.lit(0.587) + b * F.lit(0.114),
        r * F.lit(-0.16875) + g * F.lit(-0.33126) + b * F.lit(0.5),
        r * F.lit(0.5) + g * F.lit(-0.41869) + b * F.lit(-0.08131),
    )


def ict_inverse(y: Column, cb: Column, cr: Column) -> tuple[Column, Column, Column]:
    return y + cr * F.lit(1.402), y - cb * F.lit(0.344136) - cr * F.lit(0.714136), y + cb * F.lit(1.772)


def clamp8(v: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), v))


def clamp8_float(v: Column) -> Column:
    return clamp8(F.floor(v + F.lit(0.5))).cast("int")


def rescale8(v: Column, depth: int) -> Column:
    """A sample of 0 .. 2^depth - 1 as 0 .. 255, rounded half up."""
    top = (1 << depth) - 1
    return F.call_function("div", v * 255 + top // 2, F.lit(top)).cast("int")


def rgba8(channels: list[Column], depths: list[int], wide: list[Column] | None = None) -> list[Column]:
    """Red, green, blue and alpha of samples that still lack their offset 2^(depth - 1), signed ones too.

    One or two channels give grey of the first, more give the first three; alpha is always 255.
    """
    levels = []
    for v, depth in zip(channels, depths, strict=True):
        v = v + (1 << depth - 1)
        levels.append(clamp8(v if depth == 8 else rescale8(v, depth)).cast("int"))
    return [*(levels[:3] if len(levels) > 2 else [levels[0]] * 3), F.lit(255)]


def rgba8_float(y: Column, cb: Column, cr: Column, depth: int = 8) -> list[Column]:
    """The same through the irreversible transform: the offset joins Y, then the scale, then rounding."""
    scale = 255 / ((1 << depth) - 1)
    return [*(clamp8_float(c * F.lit(scale)) for c in ict_inverse(y + (1 << depth - 1), cb, cr)), F.lit(255)]


def ict_rounded(r: Column, g: Column, b: Column) -> tuple[Column, ...]:
    """The forward transform as integers, halves away from zero."""
    return tuple(F.round(c).cast("int") for c in ict(r, g, b))


#: Enumerated colour spaces.
YCC, GRAY, RGB = (3, 4, 5, 18, 24, 9, 22, 23), (17, 1, 15), (16, 20)


def is_ycc(method: Column, space: Column) -> Column:
    return (method == 1) & space.isin(*YCC)


def is_gray(method: Column, space: Column) -> Column:
    return (method == 1) & space.isin(*GRAY)


def is_rgb(method: Column, space: Column) -> Column:
    return (method == 1) & space.isin(*RGB)


def needs_transform(mct: Column, ycc: Column, comps: Column) -> Column:
    return mct | (ycc & (comps >= 3))


def uses_ict(mct: Column, ycc: Column, comps: Column, reversible: Column) -> Column:
    """The irreversible transform: for 9/7, and for a container's own colours where the stream has no transform."""
    return needs_transform(mct, ycc, comps) & (~reversible | (~mct & ycc))
