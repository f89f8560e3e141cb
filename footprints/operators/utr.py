"""Transcript boundaries from end counts: calls, peaks, internal ends and A-rich windows.

Counts: (sample, gene, pos, n), ``pos`` relative to the start codon. Models come from ``coords.transcript_models``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footprints.functions import sequence as S
from footprints.operators import coords, windows


def _cds(models: DataFrame) -> DataFrame:
    return models.select("gene", (F.col("stop_codon_t") - F.col("start_codon_t")).cast("bigint").alias("_cds"))


def five_prime_window(counts: DataFrame, models: DataFrame, reach: int = 500) -> DataFrame:
    """Counts from ``reach`` before the start codon to the stop codon; ``rel`` is relative to the start codon."""
    return counts.join(_cds(models), "gene").withColumn("rel", F.col("pos")).where((F.col("rel") >= -reach) & (F.col("rel") < F.col("_cds"))).drop("_cds")


def three_prime_window(counts: DataFrame, models: DataFrame, reach: int = 500) -> DataFrame:
    """Counts from the start codon to ``reach`` behind the stop codon; ``rel`` is relative to the stop codon."""
    placed = counts.join(_cds(models), "gene").withColumn("rel", F.col("pos") - F.col("_cds"))
    return placed.where((F.col("rel") >= -F.col("_cds")) & (F.col("rel") < reach)).drop("_cds")


def call_boundaries(models: DataFrame, five: DataFrame, three: DataFrame, reach: int = 500) -> DataFrame:
    """(gene, seqname, strand, five_pos, three_pos): genomic positions with most 5' and 3' ends.

    Without any end the start codon and the last base of the stop codon's first codon position + 3 are taken.
    """
    a = windows.argmax(five_prime_window(five, models, reach), ["gene"], "rel", "n").select("gene", F.col("argmax").alias("_five"))
    b = windows.argmax(three_prime_window(three, models, reach), ["gene"], "rel", "n").select("gene", F.col("argmax").alias("_three"))
    joined = models.join(a, "gene", "left").join(b, "gene", "left")
    return joined.select(
        "gene", "seqname", "strand",
        coords.to_genomic(F.col("start_codon_t") + F.coalesce("_five", F.lit(0))).alias("five_pos"),
        coords.to_genomic(F.col("stop_codon_t") + F.coalesce("_three", F.lit(3))).alias("three_pos"),
    )


def boundary_diagnostics(placed: DataFrame, main: str, top: int = 10) -> DataFrame:
    """(gene, rank, rel, sample, n, share): the main sample's largest positions and what every sample has there.

    ``placed`` holds the window's counts (sample, gene, rel, n).
    """
    best = windows.n_largest(placed.where(F.col("sample") == main), ["gene"], "rel", "n", top).select("gene", "rank", "rel")
    totals = placed.groupBy("sample", "gene").agg(F.sum("n").alias("_t"))
    grid = best.join(totals, "gene")
    return grid.join(placed.select("sample", "gene", "rel", "n"), ["sample", "gene", "rel"], "left").select(
        "gene", "rank", "rel", "sample", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("_t")).alias("share")
    )


def peaks(placed: DataFrame, lo: int, hi: int, more_than: int = 9) -> DataFrame:
    """(sample, gene, peak, total, fraction): the largest position within lo .. hi - 1 and, for enough counts, its share."""
    inside = placed.where((F.col("rel") >= lo) & (F.col("rel") < hi))
    totals = inside.groupBy("sample", "gene").agg(F.sum("n").alias("total"))
    return windows.argmax(inside, ["sample", "gene"], "rel", "n").join(totals, ["sample", "gene"]).select(
        "sample", "gene", F.col("argmax").alias("peak"), "total", F.when(F.col("total") > more_than, F.col("largest") / F.col("total")).alias("fraction")
    )


def peaks_by_sample(found: DataFrame, samples: list[str]) -> DataFrame:
    return found.groupBy("gene").pivot("sample", samples).agg(F.first("peak"))


def internal_ends(three: DataFrame, models: DataFrame, more_than: int = 50) -> DataFrame:
    """(sample, gene, n) of genes with many 3' ends inside the CDS."""
    inside = three_prime_window(three, models, 0)
    return inside.groupBy("sample", "gene").agg(F.sum("n").alias("n")).where(F.col("n") > more_than)


def around_landmark(counts: DataFrame, models: DataFrame, landmark: Column, reach: int = 100) -> DataFrame:
    """(sample, gene, before, after): counts from ``reach`` before the landmark up to it, and as far behind it."""
    marks = models.select("gene", (landmark - F.col("start_codon_t")).alias("_at"))
    placed = counts.join(marks, "gene").withColumn("_r", F.col("pos") - F.col("_at"))
    side = lambda lo, hi: F.sum(F.when(F.col("_r").between(lo, hi), F.col("n")).otherwise(0))
    return placed.groupBy("sample", "gene").agg(side(-reach, 0).alias("before"), side(1, reach + 1).alias("after"))


def a_rich_windows(models: DataFrame, sequences: DataFrame, sizes: list[int], left: int, right: int) -> DataFrame:
    """(gene, window, pos, n): A's in the bases from each transcript position on. Sequences start ``left`` before it."""
    cds = F.col("stop_codon_t") - F.col("start_codon_t")
    joined = models.join(sequences, "gene").select("gene", "sequence", cds.alias("_cds"))
    out = None
    for size in sizes:
        at = joined.select("gene", "_cds", F.posexplode(S.windows_of(F.col("sequence"), size)).alias("k", "piece")).where(F.col("k") < F.col("_cds") + left + right - size)
        n = F.lit(size) - F.length(F.replace("piece", F.lit("A"), F.lit("")))
        part = at.select("gene", F.lit(size).alias("window"), (F.col("k") - left).cast("bigint").alias("pos"), n.alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


def a_rich_profile(a_windows: DataFrame, models: DataFrame, counts: DataFrame, size: int = 10, more_than: int = 9, behind: int = 200) -> DataFrame:
    """(sample, rel, n): counts (``pos`` in transcript coordinates) around each transcript's richest window.

    Looked for between position 100 and 200 before the end of transcripts of at least 301 bases.
    """
    long = models.where("transcript_length >= 301").select("gene", "transcript_length")
    inner = a_windows.where(F.col("window") == size).join(long, "gene").where((F.col("pos") >= 100) & (F.col("pos") < F.col("transcript_length") - 200))
    best = windows.argmax(inner, ["gene"], "pos", "n").where(F.col("largest") > more_than).select("gene", F.col("argmax").alias("_at"))
    placed = counts.join(best, "gene").where((F.col("pos") >= 0) & (F.col("pos") < F.col("_at") + behind))
    return placed.groupBy("sample", (F.col("pos") - F.col("_at")).alias("rel")).agg(F.sum("n").alias("n"))


def end_profiles(placed: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``share``: counts relative to the window's total of the same keys."""
    totals = placed.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return placed.join(totals, keys).withColumn("share", F.try_divide(F.col("n"), F.col("_t"))).drop("_t")


def boundary_order(boundaries: DataFrame) -> DataFrame:
    return boundaries.orderBy("seqname", F.least("five_pos", "three_pos"), F.greatest("five_pos", "three_pos"), "strand")
