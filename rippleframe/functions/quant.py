"""Quantisation expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def deadzone(v: Column, step: Column) -> Column:
    step = F.when(step > 0, step).otherwise(F.lit(1.0))
    return (F.signum(v) * F.floor(F.abs(v) / step)).cast("int")


def midpoint(q: Column, step: Column) -> Column:
    return F.when(q == 0, F.lit(0.0)).otherwise(F.signum(q) * (F.abs(q) + F.lit(0.5)) * step)


def halved(v: Column) -> Column:
    """Towards zero."""
    return F.call_function("div", v, F.lit(2)).cast("int")


def dequantised(v: Column, step: Column) -> Column:
    """v holds twice a coefficient with its middle."""
    return v * step / 2


def dequantised_whole(v: Column, step: Column) -> Column:
    """The same as an integer, halves to even."""
    return F.rint(dequantised(v, step)).cast("int")


def default_step(quality: Column, level: Column, kind: Column, levels: int, bits: int = 8) -> Column:
    """Step of a band: kind 0 LL, 1 HL, 2 LH, 3 HH; levels are counted from the finest, 1."""
    base = F.pow(F.lit(10.0), -4 * quality) * float(1 << bits)
    part = F.when(kind == 0, 1.0 / (1 << max(levels - 1, 0))).otherwise(F.when(kind == 3, 4.0).otherwise(2.0) / F.pow(F.lit(2.0), level - 1))
    return base * part


def derived(exponent: Column, res: Column) -> Column:
    """Exponent of a band from the only one that is told, which is the coarsest's."""
    return exponent - F.greatest(res - 1, F.lit(0))


def gain53(kind: Column) -> Column:
    """Bits that a band's range grows by: LL, HL, LH, HH."""
    return F.element_at(F.lit([0, 1, 1, 2]), kind.cast("int") + 1)


def step_of(exponent: Column, mantissa: Column, bits: int) -> Column:
    return (F.lit(1.0) + mantissa / F.lit(2048.0)) * F.pow(F.lit(2.0), F.lit(bits) - exponent)


def exponent_mantissa(step: Column, bits: int) -> tuple[Column, Column]:
    power = F.floor(F.log2(step))
    exponent = F.greatest(F.lit(0), F.least(F.lit(31), F.lit(bits) - power)).cast("int")
    mantissa = F.round((step / F.pow(F.lit(2.0), F.lit(bits) - exponent) - 1) * 2048)
    return exponent, F.greatest(F.lit(0), F.least(F.lit(2047), mantissa)).cast("int")


def roi_deshift(v: Column, shift: Column) -> Column:
    magnitude = F.abs(v)
    moved = F.call_function("shiftright", magnitude, shift.cast("int"))
    return F.when((shift > 0) & (moved > 0), F.signum(v).cast("int") * moved).otherwise(v)
