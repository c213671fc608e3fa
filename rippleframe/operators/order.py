"""Progression orders of packets, by arithmetic on precincts.

In each of the five orders a packet's number is base + layer * per_layer + comp * per_comp with values of its
precinct, so only precincts are ranked, never packets. All components have the same precincts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import floor_div, power

#: What the packets of a tile are sorted by, in the five orders.
KEYS = {
    "lrcp": ("layer", "res", "comp", "py", "px"),
    "rlcp": ("res", "layer", "comp", "py", "px"),
    "rpcl": ("res", "ref_y", "ref_x", "comp", "layer"),
    "pcrl": ("ref_y", "ref_x", "comp", "res", "layer"),
    "cprl": ("comp", "ref_y", "ref_x", "res", "layer"),
}
TILE = ("image_id", "tile")


def precinct_rows(precincts: DataFrame) -> DataFrame:
    """A row per precinct (px, py from 0) with its place on the reference grid, n in its resolution and before: those of lower ones."""
    n = F.col("nx") * F.col("ny")
    lower = W.partitionBy(*TILE).orderBy("res")
    out = precincts.withColumns({"n": n, "before": F.sum(n).over(lower) - n, "every": F.sum(n).over(W.partitionBy(*TILE))})
    out = out.where("n > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    out = out.withColumns({"px": F.pmod("k", "nx"), "py": floor_div(F.col("k"), F.col("nx"))})
    scale = power(F.col("levels") - F.col("res"))

    def place(low: str, first: str, exp: str, at: str):
        size = power(F.col(exp))
        return F.greatest((floor_div(F.col(low), size) + F.col(at)) * size * scale, F.col(first)).cast("int")

    return out.withColumns({"ref_x": place("trx0", "x0", "ppx", "px"), "ref_y": place("try0", "y0", "ppy", "py")})


def strides(kind: str, layers: Column, comps: Column) -> tuple[Column, Column, Column]:
    """base, per_layer, per_comp of a precinct's packets."""
    n, before, every, k = (F.col(c) for c in ("n", "before", "every", "k"))
    if kind == "lrcp":
        return comps * before + k, comps * every, n
    if kind == "rlcp":
        return layers * comps * before + k, comps * n, n
    if kind == "rpcl":  # places rise with rows, then columns
        return layers * comps * (before + k), F.lit(1), layers
    place = W.partitionBy(*TILE).orderBy("ref_y", "ref_x")
    if kind == "cprl":
        nth = F.row_number().over(W.partitionBy(*TILE).orderBy("ref_y", "ref_x", "res")) - 1
        return layers * nth, F.lit(1), layers * every
    here = W.partitionBy(*TILE, "ref_y", "ref_x")
    nth = F.row_number().over(here.orderBy("res")) - 1
    return layers * (comps * (F.rank().over(place) - 1) + nth), F.lit(1), layers * F.count(F.lit(1)).over(here)


def packets(precincts: DataFrame, layers: int, comps: int, kind: str = "lrcp") -> DataFrame:
    """A row per packet with its number in the tile."""
    base, per_layer, per_comp = strides(kind, F.lit(layers), F.lit(comps))
    out = precinct_rows(precincts).withColumns({"base": base, "per_layer": per_layer, "per_comp": per_comp})
    out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(layers - 1))).alias("layer")).select("*", F.explode(F.sequence(F.lit(0), F.lit(comps - 1))).alias("comp"))
    return out.withColumn("seq", (F.col("base") + F.col("layer") * F.col("per_layer") + F.col("comp") * F.col("per_comp")).cast("long"))


def owners(rows: DataFrame, ranges: list[tuple[Column, Column]]) -> DataFrame:
    """Packets of several progression ranges, (condition, number in it) in turn: owner, the first range that holds a packet."""
    owner = F.lit(None).cast("int")
    for i in range(len(ranges) - 1, -1, -1):
        owner = F.when(ranges[i][0], i).otherwise(owner)
    number = F.lit(None).cast("long")
    for i in range(len(ranges)):
        number = F.when(owner == i, ranges[i][1]).otherwise(number)
    return rows.withColumns({"owner": owner, "number": number}).where("owner is not null")
