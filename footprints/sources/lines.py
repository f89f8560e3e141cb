"""Text lines with their place in the file, without reading a file in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F


def read_lines(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """(file, block, idx, value): ``block`` is the start of the line's input split, ``idx`` its place within the split.

    ``by`` names partition folders whose values are wanted too, as text.
    """
    schema = ", ".join(["value string", *[f"`{b}` string" for b in by]])
    raw = spark.read.schema(schema).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("_id"), *by, "value"
    )
    first = raw.groupBy("file", "block").agg(F.min("_id").alias("_first"))
    return raw.join(first, ["file", "block"]).select("file", "block", (F.col("_id") - F.col("_first")).alias("idx"), *by, "value")


def _numbered(lines: DataFrame, group: Column, order: Sequence[Column], by: Sequence[str]) -> DataFrame:
    """Adds ``line``, counted from 0 within ``group``; only the splits' sizes, one row each, are summed up."""
    sizes = lines.groupBy("file", "block").agg((F.max("idx") + 1).alias("_n"))
    before = Window.partitionBy(group).orderBy(*order, "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("file", "block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return lines.join(starts, ["file", "block"]).select("file", *by, (F.col("_start") + F.col("idx")).alias("line"), "value")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value) with line numbers from 0 in each file."""
    return _numbered(read_lines(spark, path), F.col("file"), [], ())


def numbered_folder(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """(file, ``by``, line, value) with line numbers from 0 over all files of a folder, in the order of their part numbers, then names."""
    folder = F.regexp_replace("file", "/[^/]*$", "")
    part = F.regexp_extract("file", r"/part-(\d+)[^/]*$", 1).try_cast("bigint")
    return _numbered(read_lines(spark, path, by), folder, [part, F.col("file")], by)


def up_to(lines: DataFrame, marker: str) -> DataFrame:
    """Lines of each file ahead of the first one that starts with the marker."""
    stop = lines.where(F.col("value").startswith(marker)).groupBy("file").agg(F.min("line").alias("_stop"))
    return lines.join(stop, "file", "left").where(F.col("_stop").isNull() | (F.col("line") < F.col("_stop"))).drop("_stop")
