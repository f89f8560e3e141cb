"""Merging, arithmetic and selections on count tables; sample catalogues and matrices."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def merge_sums(parts: Sequence[DataFrame], keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Partial tables added up by key."""
    return reduce(DataFrame.unionByName, parts).groupBy(*keys).agg(*[F.sum(v).alias(v) for v in values])


def merge_disjoint(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Partial tables put together; a key in more than one row is an error."""
    whole = reduce(DataFrame.unionByName, parts)
    rest = [c for c in whole.columns if c not in keys]
    grouped = whole.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in rest])
    clash = F.raise_error(F.concat_ws(" ", F.lit("key in more than one part:"), *keys)).cast("boolean")
    return grouped.where(F.when(F.col("_n") > 1, clash).otherwise(F.lit(True))).drop("_n")


def merge_same_keys(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Two tables added up that must have the same keys."""
    a, b = first.select(*keys, F.col(value).alias("_a")), second.select(*keys, F.col(value).alias("_b"))
    both = a.join(b, list(keys), "full_outer")
    missing = F.raise_error(F.concat_ws(" ", F.lit("key in one part only:"), *keys)).cast("bigint")
    return both.select(*keys, F.when(F.col("_a").isNull() | F.col("_b").isNull(), missing).otherwise(F.col("_a") + F.col("_b")).alias(value))


def combine(first: DataFrame, second: DataFrame, keys: Sequence[str], value: str, operation: str) -> DataFrame:
    """Elementwise +, - or / of two sparse position tables; what is missing counts as 0 and x / 0 is null."""
    a, b = first.select(*keys, F.col(value).alias("_a")), second.select(*keys, F.col(value).alias("_b"))
    joined = a.join(b, list(keys), "full_outer").na.fill(0, ["_a", "_b"])
    result: dict[str, Column] = {
        "+": F.col("_a") + F.col("_b"), "-": F.col("_a") - F.col("_b"), "/": F.try_divide(F.col("_a").cast("double"), F.col("_b")),
    }
    if operation not in result:
        raise ValueError(f"unknown operation: {operation}")
    return joined.select(*keys, result[operation].alias(value))


def check_landmarks(first: DataFrame, second: DataFrame, landmarks: Sequence[str]) -> DataFrame:
    """Genes whose landmarks differ between two tables; combining their counts is an error."""
    a, b = first.select("gene", *landmarks), second.select("gene", *[F.col(c).alias(f"_{c}") for c in landmarks])
    differs = reduce(lambda x, y: x | y, [~F.col(c).eqNullSafe(F.col(f"_{c}")) for c in landmarks])
    return a.join(b, "gene", "full_outer").where(differs).select("gene")


def landmark_slice(counts: DataFrame, genes: DataFrame, landmark: str, start: int, stop: int, step: int = 1, to_landmark: str | None = None) -> DataFrame:
    """Positions relative to a landmark from ``start`` to before ``stop`` (relative to ``to_landmark`` if given) by ``step``.

    Counts have ``pos`` in transcript coordinates; the landmark is a column of ``genes``.
    """
    end = to_landmark or landmark
    marks = genes.select("gene", F.col(landmark).alias("_from"), F.col(end).alias("_to"))
    placed = counts.join(marks, "gene").withColumn("rel", F.col("pos") - F.col("_from"))
    inside = (F.col("rel") >= start) & (F.col("pos") < F.col("_to") + stop) & (F.pmod(F.col("rel") - start, F.lit(step)) == 0)
    return placed.where(inside).drop("_from", "_to")


def landmark_positions(counts: DataFrame, genes: DataFrame, landmark: str, positions: Sequence[int]) -> DataFrame:
    """Counts at listed positions relative to a landmark."""
    marks = genes.select("gene", F.col(landmark).alias("_from"))
    return counts.join(marks, "gene").withColumn("rel", F.col("pos") - F.col("_from")).where(F.col("rel").isin(list(positions))).drop("_from")


def count_matrix(read_counts: DataFrame, samples: Sequence[str]) -> DataFrame:
    """Genes x samples with the CDS length; the samples are named, so no pass is spent on finding them."""
    return read_counts.groupBy("gene", "cds_length").pivot("sample", list(samples)).agg(F.first("n"))


def from_matrix(matrix: DataFrame) -> DataFrame:
    samples = [c for c in matrix.columns if c not in ("gene", "cds_length")]
    return matrix.unpivot(["gene", "cds_length"], samples, "sample", "n")


def genes_above(read_counts: DataFrame, more_than: int) -> DataFrame:
    """Genes counted more than ``more_than`` times in every sample."""
    return read_counts.groupBy("gene").agg(F.min("n").alias("_m")).where(F.col("_m") > more_than).select("gene")


def concentration(name: Column) -> Column:
    """Drug concentration in a sample name such as a_noCHX, a_1xCHX_2, a_1_8xCHX: (num, denom, rep, value)."""
    rest = F.regexp_extract(name, r"^[^_]*_(.*)$", 1)
    amount = F.regexp_extract(rest, r"^(.*?)CHX", 1)
    rep = F.regexp_replace(F.regexp_extract(rest, r"CHX(.*)$", 1), "^_+", "")
    bare = F.regexp_replace(F.regexp_replace(amount, "^[_x]+", ""), "[_x]+$", "")
    none = amount == "no"
    num = F.when(none, 0).otherwise(F.regexp_extract(bare, r"^(\d+)", 1).try_cast("int"))
    denom = F.when(none, 1).otherwise(F.coalesce(F.regexp_extract(bare, r"_(\d+)$", 1).try_cast("int"), F.lit(1)))
    return F.struct(num.alias("num"), denom.alias("denom"), rep.alias("rep"), F.try_divide(num.cast("double"), denom).alias("value"))


def by_concentration(samples: DataFrame, name: str = "sample", series: str | None = None) -> DataFrame:
    named = samples if series is None else samples.where(F.col(name).contains(series))
    c = named.withColumn("_c", concentration(F.col(name)))
    return c.select(*samples.columns, "_c.num", "_c.denom", "_c.rep", F.col("_c.value").alias("concentration")).orderBy("concentration", "rep", name)


def clean_name(name: Column) -> Column:
    """Sample names without spaces, slashes, commas and brackets (underscores), parentheses (dropped) and deltas (spelled out)."""
    spelled = F.replace(F.replace(name, F.lit("Δ"), F.lit("delta_")), F.lit("∆"), F.lit("delta_"))
    return F.translate(F.translate(spelled, "()", ""), " /,[]", "_____")


def cohort(samples: DataFrame, rules: Sequence[tuple[str, str, str]], label: str) -> DataFrame:
    """(cohort, family, sample, title): samples whose name matches their family's pattern; rules are (family, pattern, title)."""
    table = samples.sparkSession.createDataFrame([tuple(r) for r in rules], "family string, _pattern string, title string")
    joined = samples.join(F.broadcast(table), "family").where(F.regexp_like("sample", F.col("_pattern")))
    return joined.select(F.lit(label).alias("cohort"), "family", "sample", F.concat_ws(" ", "title", F.substring("sample", 1, 25)).alias("title"))
