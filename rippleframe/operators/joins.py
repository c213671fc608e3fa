"""Look-ups of samples: palettes, channel order, overrides, upsampling, tile places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .geometry import floor_div


def palette(samples: DataFrame, mapping: DataFrame, entries: DataFrame, depth: int = 8, entry_count: int | None = None) -> DataFrame:
    """Samples (comp, v, ...) to channels (channel, v, ...) by mapping (channel, comp, kind, col) and entries (entry, col, value).

    v still lacks its offset, as the results do. Kinds other than 1 pass through. A palette has at most 1,024
    entries and a mapping a row per channel: both are broadcast.
    """
    n = entries.agg((F.max("entry") + 1).alias("entry_count")) if entry_count is None else None
    rows = samples.join(F.broadcast(mapping), "comp")
    rows = rows.join(F.broadcast(n)) if n is not None else rows.withColumn("entry_count", F.lit(entry_count))
    dc = 1 << depth - 1
    rows = rows.withColumn("entry", F.greatest(F.lit(0), F.least(F.col("entry_count") - 1, F.col("v") + dc)))
    rows = rows.join(F.broadcast(entries), ["entry", "col"], "left")
    return rows.withColumn("v", F.when(F.col("kind") == 1, F.col("value") - dc).otherwise(F.col("v"))).drop("entry", "col", "value", "kind", "comp", "entry_count")


def channel_order(definitions: DataFrame, comps: int) -> DataFrame:
    """place, channel by definitions (channel, kind, association): identity without any; else as many as the largest association."""
    named = definitions.where("kind = 0 and association between 1 and 65534").groupBy((F.col("association") - 1).alias("place")).agg(F.max("channel").alias("channel"))
    top = named.agg(F.coalesce(F.max("place") + 1, F.lit(comps)).alias("n"))
    places = top.select(F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1)).alias("place"))
    return places.join(named, "place", "left").select("place", F.coalesce("channel", "place").cast("int").alias("channel"))


def reorder(samples: DataFrame, definitions: DataFrame, comps: int) -> DataFrame:
    """Samples (channel, ...) to their places; channels without one are left out."""
    return samples.join(F.broadcast(channel_order(definitions, comps)), "channel").drop("channel")


def needs_reorder(definitions: DataFrame) -> DataFrame:
    """One row, reorder: whether any colour stands elsewhere than its channel."""
    off = (F.col("kind") == 0) & F.col("association").between(1, 65534) & (F.col("channel") != F.col("association") - 1)
    return definitions.agg(F.coalesce(F.bool_or(off), F.lit(False)).alias("reorder"))


def overridden(base: DataFrame, key: list[str], layers: list[DataFrame], value: str) -> DataFrame:
    """base with value replaced by that of the first of layers (key, value) that has one: tile and component before main."""
    out = base
    names = []
    for i, layer in enumerate(layers):
        out = out.join(layer.select(*key, F.col(value).alias(f"_{i}")), key, "left")
        names.append(f"_{i}")
    return out.withColumn(value, F.coalesce(*names, value)).drop(*names)


def upsample(samples: DataFrame, width: Column, height: Column, out_width: Column, out_height: Column, dx: Column, dy: Column) -> DataFrame:
    """Nearest neighbours: each sample fills the places of the whole grid that lie nearest, the last ones up to its edge."""
    def spread(df: DataFrame, axis: str, n: Column, out: Column, d: Column) -> DataFrame:
        begin = F.col(axis) * d
        end = F.when(F.col(axis) == n - 1, out - 1).otherwise(F.least(begin + d, out) - 1)
        return df.where(begin < out).withColumn(axis, F.explode(F.sequence(begin, F.greatest(begin, end))))

    return spread(spread(samples, "x", width, out_width, dx), "y", height, out_height, dy)


def compose(samples: DataFrame, x0: Column, y0: Column, width: Column, height: Column) -> DataFrame:
    """Samples of tile-components (x, y on the component's grid) to places in the image; those outside are clipped."""
    moved = samples.withColumns({"x": F.col("x") - x0, "y": F.col("y") - y0})
    return moved.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < width) & (F.col("y") < height))


def chain(rows: DataFrame, group: list[str], order: list[str], size: Column) -> DataFrame:
    """offset of rows that lie one after another, and nth, their number; by group, so no window sees all rows."""
    w = W.partitionBy(*group).orderBy(*order)
    upto = F.sum(size).over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumns({"offset": (upto - size).cast("long"), "nth": (F.row_number().over(w) - 1).cast("long")})


def in_precinct(x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    """The grid cell (anchored at 0) of a block: the range join by arithmetic."""
    return floor_div(x, width), floor_div(y, height)
