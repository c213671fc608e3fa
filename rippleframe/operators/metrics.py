"""How far two sets of samples lie apart."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def psnr(pairs: DataFrame, a: str, b: str, top: int = 255) -> DataFrame:
    """One row, psnr in dB over all rows of all channels: infinity where all are equal, null without rows."""
    mse = F.avg(F.pow(F.col(a) - F.col(b), F.lit(2)))
    out = pairs.agg(mse.alias("mse"))
    value = F.when(F.col("mse") == 0, F.lit(float("inf"))).when(F.col("mse") > 0, 10 * F.log10(F.lit(float(top * top)) / F.col("mse")))
    return out.select(F.when(F.col("mse") == 0, value).otherwise(F.round(value, 6)).alias("psnr"))


def conformance(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """One row: n, differ (samples off by more than 1), most, percent, verdict (fail above 10 or 5 %, close above 0.1 %)."""
    off = F.abs(F.col(a) - F.col(b))
    out = pairs.agg(F.count(F.lit(1)).alias("n"), F.count_if(off > 1).alias("differ"), F.max(off).alias("most"))
    share = F.when(F.col("n") > 0, F.col("differ") * 100.0 / F.col("n"))
    verdict = F.when((F.col("most") > 10) | (share > 5), "fail").when(share > 0.1, "close").otherwise("pass")
    return out.select("n", "differ", "most", F.round(share, 6).alias("percent"), verdict.alias("verdict"))


def mismatches(pairs: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """key, mismatches: rows whose values differ; a null differs from any value."""
    return pairs.groupBy(key).agg(F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("mismatches"))
