"""Helpers shared by the text operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a local one only where the setting is absent and all runs on one machine, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not re.match(r"local($|\[)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not hasattr(spark, "_rippleframe_dir"):
        spark._rippleframe_dir = "file://" + tempfile.mkdtemp(prefix="rippleframe-")
    return spark._rippleframe_dir


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has gone; the folder's owner clears it
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: the lineage ends here,
    and any executor can read the result after another is lost. Removed when the driver exits."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/rippleframe-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out._rippleframe_path = path
    return out


def discard(df: DataFrame) -> None:
    """Removes a table made by cut() that no later plan reads."""
    if path := getattr(df, "_rippleframe_path", None):
        _remove(df.sparkSession, path)


#: Most bits of a membership filter (64 MB when broadcast).
FILTER_BITS = 1 << 29
_PAGE = 1 << 15


class Members:
    """A filter for the values of a long column (hashes): one page of 32,768 bits per row, broadcast.

    It has some eight bits per value up to FILTER_BITS, so its size is bounded; beyond that it lets more
    values through. It never stops a value that is there.
    """

    def __init__(self, values: DataFrame, column: str):
        n = values.count()
        self.bits = min(FILTER_BITS, max(1 << 20, 1 << (8 * n - 1).bit_length() if n else 0))
        at = self._place(F.col(column))
        rows = values.select(F.floor(at / _PAGE).alias("_page"), (at % _PAGE).alias("_at")).repartition("_page")
        self.pages = rows.groupBy("_page").agg(F.bitmap_construct_agg("_at").alias("_map"))

    def _place(self, value):
        return F.pmod(value, F.lit(self.bits).cast("long"))

    def keep(self, rows: DataFrame, column: str) -> DataFrame:
        """Rows whose value may be there: all that are, and few others."""
        at = self._place(F.col(column))
        both = rows.withColumn("_page", F.floor(at / _PAGE)).join(F.broadcast(self.pages), "_page")
        place = at % _PAGE
        byte = F.conv(F.hex(F.substring("_map", F.floor(place / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        bit = F.pmod(F.floor(byte / F.element_at(F.lit([1, 2, 4, 8, 16, 32, 64, 128]), (place % 8).cast("int") + 1)), F.lit(2))
        return both.where(bit == 1).drop("_page", "_map")


def salted_join(rows: DataFrame, side: DataFrame, key: str, how: str = "left") -> DataFrame:
    """rows joined with side (a row per key); the rows of a key with many of them are dealt over several salts.

    At most four keys a partition can have more rows than a share, so the table of salts is small.
    """
    counts = rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    share = F.greatest(F.lit(1), F.call_function("div", F.sum("_n"), F.lit(4 * partitions(rows.sparkSession))))
    hot = counts.join(F.broadcast(counts.agg(share.alias("_share")))).where("_n > _share").select(key, F.ceil(F.col("_n") / F.col("_share")).cast("int").alias("_salts"))
    left = rows.join(F.broadcast(hot), key, "left")
    left = left.withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), "_salts").cast("int"), F.lit(0))).drop("_salts")
    right = side.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")
    return left.join(right, [key, "_salt"], how).drop("_salt")


def text_of(column: str = "text"):
    return F.coalesce(F.col(column), F.lit(""))
