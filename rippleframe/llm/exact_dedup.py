"""Exact dedup by content sort, in DataFrame operations only.

The normalised bytes are range-partitioned by sampled splitters and sorted externally, so that
equal texts become neighbours; the window over (prefix, hash, salt, text) compares whole
neighbouring texts. The splitters are a 48-character prefix, a hash and a salt, so what the sampler
sends to the driver is bounded by the number of partitions and not by the length of texts.
A text with more copies than a quarter of a partition's share is salted: its copies are sorted in
several partitions and only one row per salt meets the others.

Null texts count as empty. Rows are never merged: repeated rows (same doc_id, same text) count as
copies, of which one is kept. A null doc_id loses to any other at equal length. Columns other than
the id and the text are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, partitions, table, text_of

#: The characters that don't count (fixed values).
WHITE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal normalised texts the longest original (code points), then the smallest id, stays.
    An empty table gives an empty result.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), text_of(text_col).alias("text"))
    rows = rows.select("doc_id", (-F.char_length("text")).alias("neg"), normalised(F.col("text")).alias("norm"))
    rows = rows.withColumn("h", F.xxhash64("norm"))

    p = partitions(spark)
    total = rows.count()
    share = max(1, -(-total // (4 * p)))
    # At most 4p texts can have more than share copies each.
    hot = rows.groupBy("h").count().where(F.col("count") > share)
    hot = [(r["h"], -(-r["count"] // share)) for r in hot.collect()] if total else []
    if hot:
        salts = F.broadcast(spark.createDataFrame(hot, "h long, salts long"))
        rows = rows.join(salts, "h", "left")
    else:
        rows = rows.withColumn("salts", F.lit(None).cast("long"))
    rows = rows.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), "salts"), F.lit(0)).cast("long"))

    # The window's keys begin with the splitters' own, so it needs no exchange beyond theirs. A salt that
    # is 0 throughout would fold into a constant and hide that.
    keys = ["prefix", "h", *["salt"] * bool(hot)]
    rows = rows.withColumn("prefix", F.substring("norm", 1, 48)).repartitionByRange(p, *keys)
    same = W.partitionBy(*keys, "norm")
    best = same.orderBy("neg", F.col("doc_id").isNull(), "doc_id")
    out = rows.select(
        "doc_id", "neg", "salts", "salt", F.sha2("norm", 256).alias("text_sha256"),
        F.row_number().over(best).alias("nth"),
        F.first("doc_id").over(best).alias("head"),
        F.count(F.lit(1)).over(same).alias("n"),
    )
    if not hot:
        return out.select("doc_id", F.col("head").alias("keep_id"), F.col("n").alias("group_size"), (F.col("nth") == 1).alias("kept"), "text_sha256")

    out = cut(out, "exact")
    parts = out.where("salts is not null and nth = 1").groupBy("text_sha256").agg(
        F.sum("n").alias("all_n"),
        F.min(F.struct("neg", F.col("doc_id").isNull().alias("no_id"), "doc_id", "salt")).alias("top"),
    )
    out = out.join(F.broadcast(parts), "text_sha256", "left")  # at most 4p rows
    return out.select(
        "doc_id",
        F.when(F.col("top").isNull(), F.col("head")).otherwise(F.col("top.doc_id")).alias("keep_id"),
        F.coalesce("all_n", "n").alias("group_size"),
        ((F.col("nth") == 1) & (F.col("top").isNull() | (F.col("top.salt") == F.col("salt")))).alias("kept"),
        "text_sha256",
    )


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


#: One row per document; the same rules in SQL.
GROUPS_SQL = r"""
select doc_id,
       first_value(doc_id) over w as keep_id,
       count(*) over (partition by norm) as group_size,
       row_number() over w = 1 as kept,
       sha256(norm) as text_sha256
from (select doc_id, length(coalesce(text, '')) as n,
             regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') as norm
      from documents)
window w as (partition by norm order by n desc, doc_id)
"""
