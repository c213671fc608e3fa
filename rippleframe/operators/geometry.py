"""Geometry of images: components, tiles, resolutions, precincts; integer arithmetic only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _whole(b) -> Column:
    return b if isinstance(b, Column) else F.lit(b)


def floor_div(a: Column, b) -> Column:
    """Towards minus infinity, in integers."""
    return F.call_function("div", a - F.pmod(a, _whole(b)), _whole(b)).cast("int")


def ceil_div(a: Column, b) -> Column:
    return F.call_function("div", a + F.pmod(-a, _whole(b)), _whole(b)).cast("int")


def power(exponent: Column) -> Column:
    """Two to this, in integers."""
    return F.call_function("shiftleft", F.lit(1), exponent.cast("int"))


def floor_power(a: Column, exponent: Column) -> Column:
    """a by two to this, towards minus infinity: an arithmetic shift."""
    return F.call_function("shiftright", a.cast("int"), exponent.cast("int"))


def ceil_power(a: Column, exponent: Column) -> Column:
    return -floor_power(-a, exponent)


def ilog2(n: Column) -> Column:
    """The largest power of two that n holds; 0 up to 1."""
    return F.when(n <= 1, 0).otherwise(F.length(F.bin(n)) - 1)


def component_dims(df: DataFrame) -> DataFrame:
    side = lambda size, off, d: ceil_div(F.col(size), F.col(d)) - ceil_div(F.col(off), F.col(d))
    return df.select("image_id", side("w", "xo", "dx").alias("width"), side("h", "yo", "dy").alias("height"))


def tiles(df: DataFrame) -> DataFrame:
    """tile, x0, y0, x1, y1 of every tile that the image (0,0 is the tile origin) reaches."""
    df = df.withColumns({"tx": ceil_div(F.col("w"), F.col("tw")), "ty": ceil_div(F.col("h"), F.col("th"))})
    df = df.select("*", F.explode(F.sequence(F.lit(0), F.col("tx") * F.col("ty") - 1)).alias("tile"))
    p, q = F.pmod("tile", "tx"), floor_div(F.col("tile"), F.col("tx"))
    return df.select(
        "image_id", "tile", "levels", "ppx", "ppy",
        F.greatest(p * F.col("tw"), F.col("xo")).cast("int").alias("x0"), F.greatest(q * F.col("th"), F.col("yo")).cast("int").alias("y0"),
        F.least((p + 1) * F.col("tw"), F.col("w")).cast("int").alias("x1"), F.least((q + 1) * F.col("th"), F.col("h")).cast("int").alias("y1"),
    )


def resolutions(df: DataFrame) -> DataFrame:
    df = df.select("*", F.explode(F.sequence(F.lit(0), "levels")).alias("res"))
    scale = power(F.col("levels") - F.col("res"))
    return df.select("image_id", "tile", "x0", "y0", "x1", "y1", "res", "levels", "ppx", "ppy", *[ceil_div(F.col(c), scale).alias(f"tr{c}") for c in ("x0", "y0", "x1", "y1")])


def precincts(df: DataFrame) -> DataFrame:
    def count(low: str, high: str, exp: str) -> Column:
        size = power(F.col(exp))
        return F.when(F.col(high) > F.col(low), ceil_div(F.col(high), size) - floor_div(F.col(low), size)).otherwise(0).cast("int")

    return df.withColumns({"nx": count("trx0", "trx1", "ppx"), "ny": count("try0", "try1", "ppy")})


def bands(df: DataFrame) -> DataFrame:
    """Resolutions to bands: kind 0 LL, 1 HL, 2 LH, 3 HH, and bx0 .. by1 in the band's own coordinates."""
    df = df.select("*", F.explode(F.when(F.col("res") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("band"))
    depth = F.col("levels") - F.col("res") + F.when(F.col("res") > 0, 1).otherwise(0)
    half = F.shiftright(power(depth), 1)

    def edge(c: str, shifted: Column) -> Column:
        return ceil_power(F.col(c) - half * shifted, depth)

    right, low = F.col("band").bitwiseAND(1), F.shiftright("band", 1)
    return df.withColumns({"bx0": edge("x0", right), "by0": edge("y0", low), "bx1": edge("x1", right), "by1": edge("y1", low)})


def block_sizes(df: DataFrame, block: int = 4) -> DataFrame:
    """cw, ch: exponents of a band's block sizes; no larger than its precincts. less: 1 above the coarsest resolution."""
    less = F.when(F.col("res") > 0, 1).otherwise(0)
    return df.withColumns({"less": less, "cw": F.least(F.lit(block), F.col("ppx") - less), "ch": F.least(F.lit(block), F.col("ppy") - less)})


def code_blocks(df: DataFrame, block: int = 4) -> DataFrame:
    """Bands to blocks: cbx, cby on a grid from 0, and their rectangle within the band."""
    df = block_sizes(df, block).where("bx1 > bx0 and by1 > by0")
    firsts = {"cbx": floor_power(F.col("bx0"), F.col("cw")), "cby": floor_power(F.col("by0"), F.col("ch"))}
    lasts = {"cbx1": floor_power(F.col("bx1") - 1, F.col("cw")), "cby1": floor_power(F.col("by1") - 1, F.col("ch"))}
    df = df.withColumns(firsts | lasts)
    # One list of both: a second list within the first makes a loop that the JVM doesn't compile.
    wide = F.col("cbx1") - F.col("cbx") + 1
    df = df.withColumn("at", F.explode(F.sequence(F.lit(0), wide * (F.col("cby1") - F.col("cby") + 1) - 1)))
    df = df.withColumns({"cbx": F.col("cbx") + F.pmod("at", wide), "cby": F.col("cby") + F.call_function("div", F.col("at"), wide).cast("int")}).drop("at", "cbx1", "cby1")
    left, top, wide, high = F.col("cbx") * power(F.col("cw")), F.col("cby") * power(F.col("ch")), power(F.col("cw")), power(F.col("ch"))
    return df.withColumns({"cx0": F.greatest("bx0", left), "cy0": F.greatest("by0", top), "cx1": F.least("bx1", left + wide), "cy1": F.least("by1", top + high)})


def precinct_blocks(df: DataFrame, block: int = 4) -> DataFrame:
    """Bands to precincts (px, py from 0) with the range of blocks [kx0, kx1) x [ky0, ky1) that each holds."""
    df = block_sizes(df, block).where("trx1 > trx0 and try1 > try0")
    out = df
    for p, low, high, exp, b0, b1, c, k in (("px", "trx0", "trx1", "ppx", "bx0", "bx1", "cw", "kx"), ("py", "try0", "try1", "ppy", "by0", "by1", "ch", "ky")):
        size = power(F.col(exp))
        first = floor_div(F.col(low), size)
        out = out.withColumn(p, F.explode(F.sequence(F.lit(0), ceil_div(F.col(high), size) - first - 1)))
        within = power(F.col(exp) - F.col("less"))
        left, right = F.greatest(F.col(b0), (first + F.col(p)) * within), F.least(F.col(b1), (first + F.col(p) + 1) * within)
        out = out.withColumns({f"{k}0": floor_div(left, power(F.col(c))), f"{k}1": F.when(right > left, ceil_div(right, power(F.col(c)))).otherwise(floor_div(left, power(F.col(c))))})
    return out


def rectangle(a: tuple[Column, ...], b: tuple[Column, ...]) -> tuple[Column, ...]:
    """What two rectangles (x0, y0, x1, y1) share; empty ones have no width or height."""
    x0, y0 = F.greatest(a[0], b[0]), F.greatest(a[1], b[1])
    return x0, y0, F.greatest(x0, F.least(a[2], b[2])), F.greatest(y0, F.least(a[3], b[3]))
