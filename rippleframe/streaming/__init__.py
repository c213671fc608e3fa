"""Coded images that arrive as files: the decoder has no state, so a stream of files is decoded like a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import images

FILES = "path string, modificationTime timestamp, length long, content binary"


def arriving(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """image_id, content of new files below a path."""
    source = spark.readStream.format("binaryFile").schema(FILES).option("maxFilesPerTrigger", files_per_batch).load(path)
    return source.select(F.col("path").alias("image_id"), "content")


def headers(spark: SparkSession, path: str) -> DataFrame:
    return images.headers(arriving(spark, path))


def samples(spark: SparkSession, path: str, max_layers: int = 0, reduce: int = 0) -> DataFrame:
    return images.samples(images.planes(arriving(spark, path), max_layers, reduce))
