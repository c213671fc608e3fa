"""The corpus pipeline: toxicity, exact dedup, n-gram Jaccard join, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last
return the columns of documents; run() writes each stage as Parquet in the shared folder and rereads it.
Rows are judged one by one: the first stages name them by a key of their own, as ids may be null or repeated.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rippleframe.llm import exact_dedup, jaccard_join, packing, secrets, toxicity
from rippleframe.llm.common import cut, discard, table


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a key for each row that all readers see alike, and the key's name, which no column begins with.

    Rows that are read straight from Parquet files are named by file and place; others are written once.
    """
    name = "row"
    while any(c.lower().startswith(name) for c in docs.columns):
        name = f"_{name}"
    placed = _placed(docs, name)
    return (cut(docs.withColumn(name, F.monotonically_increasing_id()), "rows") if placed is None else placed), name


#: Bits of a key that number the rows of a file.
PLACE = 40


def _placed(docs: DataFrame, name: str) -> DataFrame | None:
    """docs with the key 2^PLACE * file + place; None if docs isn't just a table of Parquet files."""
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() != "LogicalRelation" or "_metadata" in map(str.lower, docs.columns):
        return None
    file, place = f"{name}_file", f"{name}_place"
    try:
        rows = docs.select(*[F.col(f"`{c}`") for c in docs.columns], F.col("_metadata.file_path").alias(file), F.col("_metadata.row_index").alias(place))
    except AnalysisException:  # a format without places
        return None
    paths = sorted(r[0] for r in rows.select(file).distinct().collect())  # a row for each file
    files = docs.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, paths)).cast("array<string>")).alias(name, file))
    key = F.shiftleft(F.col(name).cast("long"), PLACE) + F.col(place)
    return rows.join(F.broadcast(files), file).withColumn(name, key).drop(file, place)


def narrow(rows: DataFrame, row: str) -> DataFrame:
    """What the operators read of rows: row (the key), doc_id and text, so that no other column's name matters."""
    return rows.select(F.col(row).alias("row"), "doc_id", "text")


def kept(docs: DataFrame, rows: DataFrame, row: str, keys: DataFrame, how: str) -> DataFrame:
    """The rows whose key is (left_semi) or isn't (left_anti) among keys (row)."""
    return rows.join(keys.select(F.col("row").alias(row)), row, how).select(docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a score of 0.5 or more go. Labels are those of the corpus' labels table."""
    rows, row = keyed(docs)
    scores = toxicity.score(narrow(rows, row), toxicity.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels")), "row")
    return kept(docs, rows, row, scores.where("predicted = 1").select(F.col("doc_id").alias("row")), "left_anti")


def keep_one_copy(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays: the longest, then the smallest doc_id; a null one comes last."""
    rows, row = keyed(docs)
    groups = exact_dedup.exact_groups(narrow(rows, row).select(_order().alias("key"), "text"), "key")
    return kept(docs, rows, row, groups.where("kept").select("doc_id.row"), "left_semi")


def keep_one_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that links join, the one with the smallest doc_id stays; a null one comes last."""
    rows, row = keyed(docs)
    some = narrow(rows, row)
    groups = cut(jaccard_join.jaccard_components(some.select("row", "text"), "row").select(F.col("doc_id").alias("row"), "component_id"), "near")
    first = groups.join(some.select("row", "doc_id"), "row").groupBy("component_id").agg(F.min(_order()).alias("first"))
    return kept(docs, rows, row, first.select("first.row"), "left_semi")


def _order() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each span that the scan found becomes [secret]; overlapping spans become one. All documents stay.

    The stage has a ledger of its own, as its texts are those that the stages before kept.
    """
    rows, row = keyed(docs)
    found = secrets.findings(narrow(rows, row), secrets.ledger_of(spark, f"pipeline over {sf_dir}"), "row").where("spans <> ''")
    found = found.select(F.col("doc_id").alias(row), F.col("spans").alias(f"{row}_spans"))
    rows = rows.select(row, *[c for c in docs.columns]).join(found, row, "left")
    return rows.withColumn("text", secrets.masked(F.col("text"), F.col(f"{row}_spans"))).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of packed windows."""
    return packing.pack_documents(docs.select("doc_id", "text"), packing.vocabulary())


STAGES = [("toxicity", drop_toxic), ("exact_dedup", keep_one_copy), ("ngram_jaccard", keep_one_near), ("secret_scans", mask_secrets), ("packing", pack)]

#: The first stage is a trained classifier and the last a tokenizer's ids, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(before)  # the stage's table is whole; its input is read no more
    return STAGES[-1][1](spark, docs, sf_dir)
