"""Rate control as windows: slopes, prefixes, budgets, layers.

Passes are rows (block, pass, bytes, distortion), distortion being what the pass takes away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Ranges that the global order of slopes is cut into.
BUCKETS = 256


def _upto() -> W:
    return W.partitionBy("block").orderBy("pass").rowsBetween(W.unboundedPreceding, 0)


def slopes(passes: DataFrame) -> DataFrame:
    """Distortion gained per byte of each pass, what passes without bytes gained going to the next with some. Null without bytes."""
    gained = F.sum("distortion").over(_upto())
    out = passes.withColumn("total", gained)
    last = F.last(F.when(F.col("bytes") > 0, F.col("total")), ignorenulls=True).over(W.partitionBy("block").orderBy("pass").rowsBetween(W.unboundedPreceding, -1))
    return out.withColumn("slope", F.when(F.col("bytes") > 0, (F.col("total") - F.coalesce(last, F.lit(0.0))) / F.col("bytes"))).drop("total")


def simple_slopes(passes: DataFrame) -> DataFrame:
    """Each pass by itself; null without bytes."""
    return passes.withColumn("slope", F.when(F.col("bytes") > 0, F.col("distortion") / F.col("bytes")))


def prefixes(passes: DataFrame, threshold: Column) -> DataFrame:
    """block, passes: the number of the last pass of the longest prefix whose slopes all reach the threshold.

    Passes without bytes neither stop a prefix nor end it; every block has a row, 0 where none holds.
    """
    ok = F.min(F.when(F.col("slope").isNotNull(), (F.col("slope") >= threshold).cast("int"))).over(_upto())
    end = F.max(F.when((F.col("ok") == 1) & (F.col("bytes") > 0), F.col("pass")))
    return passes.withColumn("ok", ok).groupBy("block").agg(F.coalesce(end, F.lit(0)).cast("int").alias("passes"))


def uniform(passes: DataFrame, part: float) -> DataFrame:
    """block, passes: the last pass within this part of the block's bytes."""
    total = F.sum("bytes").over(W.partitionBy("block"))
    ok = F.sum("bytes").over(_upto()) <= F.floor(total * F.lit(part))
    return passes.select("block", F.when(ok, F.col("pass")).alias("at")).groupBy("block").agg(F.coalesce(F.max("at"), F.lit(0)).cast("int").alias("passes"))


def falling(passes: DataFrame) -> DataFrame:
    """least: the smallest slope up to each pass, the threshold at which the pass still belongs to its prefix."""
    return passes.withColumn("least", F.min("slope").over(_upto()))


def thresholds(passes: DataFrame, parts: list[float]) -> DataFrame:
    """layer, threshold: for each part of all bytes the smallest slope whose prefixes fit into it; null where none does.

    The global order of slopes is cut into ranges by approximate quantiles; ranges are summed, and rows
    are ordered within a range only, so no task sees all passes. Equal slopes go together.
    """
    rows = falling(passes).where("bytes > 0").groupBy("least").agg(F.sum("bytes").alias("bytes"))
    cuts = rows.agg(F.percentile_approx("least", [i / BUCKETS for i in range(1, BUCKETS)], 10_000).alias("cuts"))
    rows = rows.join(F.broadcast(cuts)).withColumn("bucket", F.size(F.filter("cuts", lambda c: c < F.col("least")))).drop("cuts")
    sums = rows.groupBy("bucket").agg(F.sum("bytes").alias("inside"))
    every = W.orderBy(F.desc("bucket"))  # at most BUCKETS rows
    sums = sums.withColumns({"above": F.sum("inside").over(every) - F.col("inside"), "whole": F.sum("inside").over(W.partitionBy())})
    inside = F.sum("bytes").over(W.partitionBy("bucket").orderBy(F.desc("least")))
    rows = rows.join(F.broadcast(sums), "bucket").withColumn("held", F.col("above") + inside)
    layers = F.array(*[F.struct(F.lit(i).alias("layer"), F.lit(p).alias("part")) for i, p in enumerate(parts)])
    rows = rows.select("least", "held", "whole", F.explode(layers).alias("l"))
    return rows.groupBy(F.col("l.layer").alias("layer")).agg(F.min(F.when(F.col("held") <= F.floor(F.col("whole") * F.col("l.part")), F.col("least"))).alias("threshold"))


def layered(passes: DataFrame, parts: list[float]) -> DataFrame:
    """block, layer, passes, fresh: passes by the end of each layer and those that the layer adds. parts rise."""
    cuts = F.broadcast(thresholds(passes, parts))
    rows = falling(passes).join(cuts)  # a row for each layer
    ok = (F.col("bytes") > 0) & (F.col("least") >= F.col("threshold"))
    out = rows.groupBy("block", "layer").agg(F.coalesce(F.max(F.when(ok, F.col("pass"))), F.lit(0)).cast("int").alias("passes"))
    before = F.coalesce(F.lag("passes").over(W.partitionBy("block").orderBy("layer")), F.lit(0))
    return out.withColumn("fresh", F.col("passes") - before)


def first_layers(layers: DataFrame) -> DataFrame:
    """block, first: the layer that first holds a pass of the block; null where none does."""
    return layers.groupBy("block").agg(F.min(F.when(F.col("passes") > 0, F.col("layer"))).alias("first"))


def summary(passes: DataFrame) -> DataFrame:
    """Over all blocks: total bytes, smallest and largest slope, whether distortions are known."""
    s = simple_slopes(passes)
    return s.agg(F.sum("bytes").alias("bytes"), F.min("slope").alias("low"), F.max("slope").alias("high"), F.bool_or(F.col("distortion") != 0).alias("known"))
