"""Statistics of code-blocks: bit planes, significant neighbours, coding contexts, tag-tree roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def bit_length(m: Column) -> Column:
    return F.when(m == 0, 0).otherwise(F.length(F.bin(m)))


def block_planes(df: DataFrame, block: list[str], planes: int = 9) -> DataFrame:
    n = bit_length(F.max(F.abs("v")))
    out = df.groupBy(*block).agg(n.cast("int").alias("planes"))
    return out.withColumns({"zbp": F.greatest(F.lit(planes) - F.col("planes"), F.lit(0)), "passes": F.greatest(F.col("planes") * 3 - 2, F.lit(0))})


def neighbours(df: DataFrame, block: str, value: str) -> DataFrame:
    """h, v, d: how much of value stands beside, above and below, and diagonally. Other columns stay.

    Two windows over one exchange by block: along rows, then along columns, where a row's sideways sum
    gives its neighbours' diagonals. Samples may be missing; a block's fit one task.
    """
    rows, columns = W.partitionBy(block, "y").orderBy("x"), W.partitionBy(block, "x").orderBy("y")

    def beside(c: str, at: str, w) -> Column:
        before = F.when(F.lag(at).over(w) == F.col(at) - 1, F.lag(c).over(w)).otherwise(0)
        return before + F.when(F.lead(at).over(w) == F.col(at) + 1, F.lead(c).over(w)).otherwise(0)

    df = df.repartition(block).withColumn("h", beside(value, "x", rows))
    # Without the corner's own sample the column is missing too, so diagonals are only those of dense rows.
    return df.withColumns({"v": beside(value, "y", columns).cast("int"), "d": beside("h", "y", columns).cast("int"), "h": F.col("h").cast("int")})


def zero_context(h: Column, v: Column, d: Column, kind: Column) -> Column:
    """0..8 by the significant neighbours and the band (0 LL, 1 HL, 2 LH, 3 HH)."""
    a, b = F.when(kind == 1, v).otherwise(h), F.when(kind == 1, h).otherwise(v)
    plain = F.when(a == 2, 8).when(a == 1, F.when(b >= 1, 7).when(d >= 1, 6).otherwise(5)).when(b == 2, 4).when(b == 1, 3).otherwise(F.least(d, F.lit(2)))
    hv = h + v
    cross = F.when(d >= 3, 8).when(d == 2, F.when(hv >= 1, 7).otherwise(6)).when(d == 1, F.when(hv >= 2, 5).when(hv == 1, 4).otherwise(3)).otherwise(F.least(hv, F.lit(2)))
    return F.when(kind == 3, cross).otherwise(plain).cast("int")


def sign_context(h: Column, v: Column) -> tuple[Column, Column]:
    """Context 9..13 and the flip bit, by the clipped sums of the neighbours' signs."""
    h, v = (F.greatest(F.lit(-1), F.least(F.lit(1), c)) for c in (h, v))
    flip = F.when((h < 0) | ((h == 0) & (v < 0)), 1).otherwise(0)
    a, b = F.when(flip == 1, -h).otherwise(h), F.when(flip == 1, -v).otherwise(v)
    return F.when(a == 1, b + 12).otherwise(b + 9).cast("int"), flip


def magnitude_context(first: Column, near: Column) -> Column:
    return F.when(~first, 16).when(near > 0, 15).otherwise(14)


def tag_tree(df: DataFrame, value: str, levels: int) -> DataFrame:
    """level, x, y, least: the minima of a quadtree, all levels from one scan and one aggregation."""
    at = df.select("x", "y", value, F.explode(F.sequence(F.lit(0), F.lit(levels))).alias("level"))
    shifted = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
    return at.groupBy("level", shifted("x").alias("x"), shifted("y").alias("y")).agg(F.min(value).alias("least"))


def pass_count_code(n: Column) -> Column:
    bits = lambda v, width: F.lpad(F.bin(v), width, "0")
    return (
        F.when(n == 1, "0").when(n == 2, "10").when(n <= 5, F.concat(F.lit("11"), bits(n - 3, 2)))
        .when(n <= 36, F.concat(F.lit("1111"), bits(n - 6, 5))).otherwise(F.concat(F.lit("111111111"), bits(n - 37, 7)))
    )


def segment_of(index: Column, terminate: Column) -> tuple[Column, Column]:
    """Codeword and rawness of pass index (from 0) in the bypass style: 10 passes, then 2 raw and 1 coded in turn."""
    late = index - 10
    third = F.call_function("div", late, F.lit(3)).cast("int")
    raw = (late >= 0) & (F.pmod(late, F.lit(3)) < 2)
    joint = F.when(late < 0, 0).otherwise(1 + 2 * third + F.when(F.pmod(late, F.lit(3)) == 2, 1).otherwise(0))
    return F.when(terminate, index).otherwise(joint).cast("int"), raw


def length_bits(df: DataFrame, block: str, order: str, size: str, passes: Column) -> DataFrame:
    """lblock after each contribution of a block, told (bits of the unary step) and bits of its length field."""
    need = bit_length(F.col(size)) - (bit_length(passes) - 1)
    w = W.partitionBy(block).orderBy(order)
    now = F.greatest(F.lit(3), F.max(need).over(w.rowsBetween(W.unboundedPreceding, 0)))
    df = df.withColumn("lblock", now.cast("int"))
    before = F.coalesce(F.lag("lblock").over(w), F.lit(3))
    return df.withColumns({"told": (F.col("lblock") - before + 1).cast("int"), "bits": (F.col("lblock") + bit_length(passes) - 1).cast("int")})


#: Bits of the code-block style.
STYLES = (("bypass", 1), ("reset", 2), ("terminate", 4), ("causal", 8), ("predictable", 16), ("segment", 32))


def style_flags(style: Column) -> dict[str, Column]:
    return {name: style.bitwiseAND(bit) != 0 for name, bit in STYLES}


def raw_mode(style: Column, kind: Column, plane: Column, planes: Column) -> Column:
    """Whether a pass (kind 2: cleanup) bypasses the coder."""
    return (style.bitwiseAND(1) != 0) & (kind != 2) & (plane <= planes - 5)


def sound(passes: Column, length: Column, steps: Column, zero_planes: Column) -> Column:
    """Whether a packet's numbers are possible; rows that aren't go to quarantine."""
    return passes.between(1, 50) & (length <= 100_000) & (steps <= 16) & (zero_planes <= 32)
