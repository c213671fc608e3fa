"""Wavelet lifting over long tables, one window per lifting step.

All windows of a pass have the same partitioning and order. Repartitioning by the image alone first serves
the column passes and the row passes of all levels, so a 2-D transform costs one exchange and one scan.
A signal (1-D) or an image's tile (2-D) fits one task. Samples of a level's finer bands pass through its windows
unchanged, in partitions of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import ceil_div, floor_div

#: Fixed values of the 9/7 filter.
ALPHA, BETA, GAMMA, DELTA, K = -1.586134342059924, -0.052980118572961, 0.882911075530934, 0.443506852043971, 1.230174104914001
STEPS97 = ((True, ALPHA), (False, BETA), (True, GAMMA), (False, DELTA))


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def _near(v: Column, w: W) -> tuple[Column, Column]:
    """Neighbours before and after, mirrored at the ends; null for both in a signal of one sample."""
    before, after = F.lag(v).over(w), F.lead(v).over(w)
    return F.coalesce(before, after), F.coalesce(after, before)


class _Axis:
    """One axis of a transform: its windows, the parity of its origin and which samples take part."""

    def __init__(self, keys: list[str], axis: str, value: str, origin=0, only: Column | None = None):
        self.keys, self.axis, self.value = keys, axis, value
        self.parity = F.pmod(_col(origin), F.lit(2))
        self.only = F.lit(True) if only is None else only
        self.w = W.partitionBy(*keys).orderBy("_p")
        self.n = F.max("_p").over(W.partitionBy(*keys)) + 1

    def high(self) -> Column:
        return F.pmod(F.col("_p") + self.parity, F.lit(2)) == 1

    def lift(self, df: DataFrame, odd: bool, change) -> DataFrame:
        v = F.col(self.value)
        before, after = _near(v, self.w)
        here = self.only & (self.high() if odd else ~self.high()) & before.isNotNull()
        return df.withColumn(self.value, F.when(here, change(v, before, after)).otherwise(v))

    def scale(self, df: DataFrame, low: Column, high: Column) -> DataFrame:
        v = F.col(self.value)
        many = self.only & (self.n > 1)
        return df.withColumn(self.value, F.when(many & self.high(), high).when(many, low).otherwise(v))

    def alone(self, df: DataFrame, change) -> DataFrame:
        """A signal of one sample at an odd place."""
        v = F.col(self.value)
        return df.withColumn(self.value, F.when(self.only & (self.n == 1) & (self.parity == 1), change(v)).otherwise(v))

    def lows(self) -> Column:
        return floor_div(self.n + 1 - self.parity, 2)

    def split(self, df: DataFrame) -> DataFrame:
        """Places of low samples first, then of high ones."""
        half = floor_div(F.col("_p"), 2)
        to = F.when(self.high(), self.lows() + half).otherwise(half)
        return df.withColumn(self.axis, F.when(self.only & (self.n > 1), to).otherwise(F.col("_p")).cast("int"))

    def join(self, df: DataFrame) -> DataFrame:
        """_p: where samples stand before the split."""
        n = F.max(self.axis).over(W.partitionBy(*self.keys)) + 1
        low = floor_div(n + 1 - self.parity, 2)
        at = F.col(self.axis)
        to = F.when(at < low, at * 2 + self.parity).otherwise((at - low) * 2 + 1 - self.parity)
        return df.withColumn("_p", F.when(self.only & (n > 1), to).otherwise(at).cast("int"))


def analyse53(df: DataFrame, keys: list[str], axis: str, value: str = "v", origin=0, only: Column | None = None) -> DataFrame:
    a = _Axis(keys, axis, value, origin, only)
    df = a.alone(df.withColumn("_p", F.col(axis)), lambda v: v * 2)
    df = a.lift(df, True, lambda v, x, y: v - F.shiftright(x + y, 1))
    df = a.lift(df, False, lambda v, x, y: v + F.shiftright(x + y + 2, 2))
    return a.split(df).drop("_p")


def synthesise53(df: DataFrame, keys: list[str], axis: str, value: str = "v", origin=0, only: Column | None = None) -> DataFrame:
    a = _Axis(keys, axis, value, origin, only)
    df = a.alone(a.join(df), lambda v: F.shiftright(v, 1))
    df = a.lift(df, False, lambda v, x, y: v - F.shiftright(x + y + 2, 2))
    df = a.lift(df, True, lambda v, x, y: v + F.shiftright(x + y, 1))
    return df.withColumn(axis, F.col("_p")).drop("_p")


def analyse97(df: DataFrame, keys: list[str], axis: str, value: str = "v", origin=0, only: Column | None = None) -> DataFrame:
    a = _Axis(keys, axis, value, origin, only)
    df = df.withColumn("_p", F.col(axis))
    for odd, factor in STEPS97:
        df = a.lift(df, odd, lambda v, x, y, f=factor: v + (x + y) * F.lit(f))
    df = a.scale(df, F.col(value) / F.lit(K), F.col(value) * F.lit(K / 2))
    return a.split(df).drop("_p")


def synthesise97(df: DataFrame, keys: list[str], axis: str, value: str = "v", origin=0, only: Column | None = None) -> DataFrame:
    a = _Axis(keys, axis, value, origin, only)
    df = a.scale(a.join(df), F.col(value) * F.lit(K), F.col(value) * F.lit(2 / K))
    for odd, factor in reversed(STEPS97):
        df = a.lift(df, odd, lambda v, x, y, f=factor: v - (x + y) * F.lit(f))
    return df.withColumn(axis, F.col("_p")).drop("_p")


ANALYSE, SYNTHESISE = {"53": analyse53, "97": analyse97}, {"53": synthesise53, "97": synthesise97}


def _level(df: DataFrame, level: int, width, height, x0, y0) -> tuple[DataFrame, Column, Column]:
    """Marks the samples that are still low after these levels; the origin there."""
    side = lambda o, n: ceil_div(_col(o) + _col(n), 1 << level) - ceil_div(_col(o), 1 << level)
    df = df.withColumn("_in", (F.col("x") < side(x0, width)) & (F.col("y") < side(y0, height)))
    return df, ceil_div(_col(x0), 1 << level), ceil_div(_col(y0), 1 << level)


def analyse_2d(df: DataFrame, image: str, levels: int, width, height, x0=0, y0=0, wavelet: str = "53", value: str = "v") -> DataFrame:
    """Columns then rows of what is still low, level by level. Sizes and origins are numbers or columns of df."""
    df, run = df.repartition(image), ANALYSE[wavelet]
    for level in range(levels):
        df, ox, oy = _level(df, level, width, height, x0, y0)
        df = run(df, [image, "_in", "x"], "y", value, oy, F.col("_in"))
        df = run(df, [image, "_in", "y"], "x", value, ox, F.col("_in"))
    return df.drop("_in")


def synthesise_2d(df: DataFrame, image: str, levels: int, width, height, x0=0, y0=0, wavelet: str = "53", value: str = "v", least: int = 0) -> DataFrame:
    """The inverse, rows then columns, from the coarsest level down to level least."""
    df, run = df.repartition(image), SYNTHESISE[wavelet]
    for level in range(levels - 1, least - 1, -1):
        df, ox, oy = _level(df, level, width, height, x0, y0)
        df = run(df, [image, "_in", "y"], "x", value, ox, F.col("_in"))
        df = run(df, [image, "_in", "x"], "y", value, oy, F.col("_in"))
    return df.drop("_in")


def analyse53_2d(df: DataFrame, image: str = "vec_id", levels: int = 1, size: int = 8) -> DataFrame:
    """Square images with an even origin."""
    return analyse_2d(df, image, levels, size, size)


def band(x: Column, y: Column, half: int) -> Column:
    return F.when((x < half) & (y < half), "LL").when(y < half, "HL").when(x < half, "LH").otherwise("HH")
