"""Stores of counts and their exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


# ---- position counts ------------------------------------------------------------------------------


def write_positions(counts: DataFrame, path: str) -> None:
    """(sample, gene, read_end, key, pos, n) as Parquet by sample and key; files sorted by gene and position.

    Rows are dealt out by sample and key, and Spark splits a folder that is larger than a task should be.
    """
    dealt = counts.hint("rebalance", F.col("sample"), F.col("key"))
    dealt.sortWithinPartitions("sample", "key", "gene", "pos").write.mode("overwrite").partitionBy("sample", "key").parquet(path)


def read_positions(spark: SparkSession, path: str, keys: list[str] | None = None) -> DataFrame:
    """Position counts; with ``keys`` only their folders are read."""
    spark_df = spark.read.option("inferSchema", "false").parquet(path).withColumn("key", F.col("key").cast("string"))
    return spark_df if keys is None else spark_df.where(F.col("key").isin(keys))


# ---- histograms -----------------------------------------------------------------------------------


def upsert(table: DataFrame, path: str, by: list[str]) -> None:
    """Replaces exactly the partitions that the table has rows for."""
    table.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def catalogue(spark: SparkSession, path: str, partition: str = "sample") -> DataFrame:
    """The samples of a partitioned store, from its folders."""
    return spark.read.parquet(path).select(partition).distinct()


# ---- text exports ---------------------------------------------------------------------------------


def codon_count_lines(codons: DataFrame, count: str = "relaxed") -> DataFrame:
    """One line per gene: its name and its counts in codon order, tab-separated. ``exports`` writes them sorted by name."""
    ordered = codons.groupBy("sample", "gene").agg(F.array_sort(F.collect_list(F.struct("codon_idx", F.col(count).alias("n")))).alias("c"))
    text = F.array_join(F.transform("c", lambda x: x["n"].cast("string")), "\t")
    return ordered.select("sample", F.concat_ws("\t", "gene", text).alias("value"))


def parse_codon_count_lines(lines: DataFrame, *keep: str) -> DataFrame:
    """(sample, ``keep``, gene, codon_idx, n) with indices from 0."""
    f = F.split("value", "\t")
    numbers = F.transform(F.slice(f, F.lit(2), F.size(f)), lambda x: x.cast("bigint"))
    return lines.select("sample", *keep, F.get(f, F.lit(0)).alias("gene"), F.posexplode(numbers).alias("codon_idx", "n"))


def expression_lines(read_counts: DataFrame) -> DataFrame:
    """Two-line records: name and length, then the counts of both strands."""
    return read_counts.select("sample", F.concat_ws("\t", "gene", "cds_length").alias("info"), F.concat(F.col("n").cast("string"), F.lit(" 0")).alias("counts")).select(
        "sample", F.concat_ws("\n", "info", "counts").alias("value")
    )


def parse_expression_records(records: DataFrame, *keep: str) -> DataFrame:
    """(sample, ``keep``, gene, cds_length, counts) of two-line records."""
    parts = F.split("value", "\n")
    info = F.split(F.get(parts, F.lit(0)), r"\s+")
    counts = F.transform(F.split(F.trim(F.get(parts, F.lit(1))), " +"), lambda x: x.cast("bigint"))
    return records.select("sample", *keep, F.get(info, F.lit(0)).alias("gene"), F.get(info, F.lit(1)).cast("int").alias("cds_length"), counts.alias("counts"))


def rpkm_lines(rpkms: DataFrame) -> DataFrame:
    """Name and RPKM with two decimals."""
    return rpkms.select("sample", F.concat_ws("\t", "gene", F.format_string("%.2f", "rpkm")).alias("value"))


def parse_rpkm_lines(lines: DataFrame, *keep: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    return lines.select("sample", *keep, F.get(f, F.lit(0)).alias("gene"), F.get(f, F.lit(1)).cast("double").alias("rpkm"))


def boundary_line() -> Column:
    return F.concat_ws("\t", "gene", "seqname", "strand", "five_pos", "three_pos")


def parse_boundary_lines(lines: DataFrame, *keep: str) -> DataFrame:
    f = F.split(F.trim("value"), r"\s+")
    at = lambda i: F.get(f, F.lit(i))
    return lines.select(*keep, at(0).alias("gene"), at(1).alias("seqname"), at(2).alias("strand"), at(3).cast("bigint").alias("five_pos"), at(4).cast("bigint").alias("three_pos"))
