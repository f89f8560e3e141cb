"""Histograms, compositions and summaries of reads and mappings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footprints import constants as C
from footprints.functions import sequence as S
from footprints.session import cut_lineage


def length_histogram(reads: DataFrame, category: str = "category", length: str = "length") -> DataFrame:
    return reads.groupBy("sample", category, length).agg(F.count(F.lit(1)).alias("n"))


def zero_padded(histogram: DataFrame, max_length: DataFrame) -> DataFrame:
    """Every length from 0 to the sample's ``max_length``, with 0 where no read has it.

    The histogram is needed twice, so its few rows are written first.
    """
    histogram = cut_lineage(histogram)
    keys = histogram.select("sample", "category").distinct()
    grid = keys.join(max_length, "sample").select("sample", "category", F.explode(F.sequence(F.lit(0), F.col("max_length"))).alias("length"))
    return grid.join(histogram, ["sample", "category", "length"], "left").na.fill(0, ["n"])


def sum_categories(histogram: DataFrame, parts: list[str], name: str) -> DataFrame:
    """A category that is the sum of others, e.g. ``merged`` = ``clean_trimmed`` + ``remapped``."""
    return histogram.where(F.col("category").isin(parts)).groupBy("sample", "length").agg(F.sum("n").alias("n")).withColumn("category", F.lit(name))


def folded_fractions(histogram: DataFrame, cap: int) -> DataFrame:
    """Lengths above ``cap`` counted at it, and each length's share of its category."""
    folded = histogram.groupBy("sample", "category", F.least("length", F.lit(cap)).alias("length")).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("sample", "category"))
    return folded.withColumn("fraction", F.try_divide(F.col("n"), total))


def base_composition(reads: DataFrame, perfect: Column | None = None) -> DataFrame:
    """(sample, length, cycle, base, n, n_perfect) of ``seq``."""
    flagged = reads.select("sample", "seq", (F.lit(True) if perfect is None else perfect).alias("_perfect"))
    # Equal sequences are combined first: footprint libraries repeat them.
    shapes = flagged.groupBy("sample", "seq").agg(F.count(F.lit(1)).alias("n"), F.count_if("_perfect").alias("p"))
    return (
        shapes.select("sample", F.length("seq").alias("length"), "n", "p", F.posexplode(S.bases_of(F.col("seq"))).alias("cycle", "base"))
        .groupBy("sample", "length", "cycle", "base")
        .agg(F.sum("n").alias("n"), F.sum("p").alias("n_perfect"))
    )


def mapped_composition(alignments: DataFrame) -> DataFrame:
    """Composition of mapped primary reads in sequencing direction; perfect ones are unique without mismatch."""
    used = alignments.where("not is_unmapped and not is_secondary").withColumn(
        "seq", F.when(F.col("strand") == "-", S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))
    )
    return base_composition(used, (F.col("nm") == 0) & (F.col("mapq") == C.UNIQUE_MAPQ))


def composition_fractions(composition: DataFrame) -> DataFrame:
    """(sample, view, length, position, base, fraction): per length, over all lengths, and aligned from the right."""
    one = composition.select("sample", F.lit("length").alias("view"), "length", F.col("cycle").alias("position"), "base", "n")
    every = composition.select("sample", F.lit("all").alias("view"), F.lit(None).cast("int").alias("length"), F.col("cycle").alias("position"), "base", "n")
    right = composition.select(
        "sample", F.lit("all_from_right").alias("view"), F.lit(None).cast("int").alias("length"),
        (F.col("cycle") - F.col("length") + 1).alias("position"), "base", "n",
    )
    sums = one.unionByName(every).unionByName(right).groupBy("sample", "view", "length", "position", "base").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("sample", "view", "length", "position"))
    return sums.select("sample", "view", "length", "position", "base", (F.col("n") / F.greatest(F.lit(1), total)).alias("fraction"))


def quality_by_cycle(reads: DataFrame) -> DataFrame:
    """(sample, cycle, quality, n) with Sanger-decoded qualities."""
    return (
        reads.select("sample", F.posexplode(S.bases_of(F.col("qual"))).alias("cycle", "symbol"))
        .groupBy("sample", "cycle", "symbol")
        .agg(F.count(F.lit(1)).alias("n"))
        .select("sample", "cycle", (F.ascii("symbol") - 33).alias("quality"), "n")
    )


def miscall_fractions(mismatches: DataFrame, min_quality: int = 30) -> DataFrame:
    """(sample, length, position, base, fraction): calls of a base where the reference has another, of all good calls."""
    good = mismatches.where(F.col("quality") >= min_quality)
    calls = good.groupBy("sample", "length", "position").agg(F.sum("n").alias("calls"))
    wrong = good.groupBy("sample", "length", "position", F.col("read_base").alias("base")).agg(
        F.sum(F.when(F.col("read_base") != F.col("ref_base"), F.col("n")).otherwise(0)).alias("wrong")
    )
    return wrong.join(calls, ["sample", "length", "position"]).select(
        "sample", "length", "position", "base", (F.col("wrong") / F.col("calls")).alias("fraction")
    )


def common_sequences(reads: DataFrame, tail: str = "tail_seq", top: int = 100) -> DataFrame:
    """The most common unmapped sequences, apart for reads whose tail is predominantly A."""
    kind = F.when(S.predominantly_a(F.col(tail)), "long_polyA").otherwise("other")
    counts = reads.groupBy("sample", kind.alias("kind"), "seq").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("sample", "kind").orderBy(F.desc("n"), "seq")
    return counts.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def yield_report(histogram: DataFrame, dominant: DataFrame | None = None) -> DataFrame:
    """(sample, category, n, fraction): category totals and their share of all reads (trimmed + too short)."""
    sums = histogram.groupBy("sample", "category").agg(F.sum("n").alias("n"))
    if dominant is not None:
        d = dominant.select("sample", F.col("reads").alias("_d"))
        rrna = sums.where("category = 'rRNA'").join(d, "sample", "left").withColumn("_d", F.coalesce("_d", F.lit(0)))
        split = rrna.select(
            "sample",
            F.explode(F.array(
                F.struct(F.lit("rRNA_dominant").alias("category"), F.col("_d").alias("n")),
                F.struct(F.lit("rRNA_other").alias("category"), (F.col("n") - F.col("_d")).alias("n")),
            )).alias("x"),
        ).select("sample", "x.*")
        sums = sums.unionByName(split)
    total = F.sum(F.when(F.col("category").isin("trimmed", "too_short"), F.col("n")).otherwise(0)).over(Window.partitionBy("sample"))
    return sums.withColumn("fraction", F.try_divide(F.col("n"), total))


def collapse_duplicates(alignments: DataFrame) -> DataFrame:
    """One row per fragment (position, cigar, strand, barcode) of unique mappings with its copies and its position's.

    Counted in two steps, fragment then position, so that a position that holds most mappings is combined map-side.
    """
    position = ["sample", "seqname", "pos", "cigar", "strand"]
    fragments = (
        alignments.where(F.col("mapq") == C.UNIQUE_MAPQ)
        .groupBy(*position, "barcode")
        .agg(F.count(F.lit(1)).alias("fragment_count"), F.min("qname").alias("qname"))
    )
    totals = fragments.groupBy(*position).agg(F.sum("fragment_count").alias("position_count"))
    return fragments.join(totals, position)


def amplification_counts(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("sample", "position_count", "fragment_count").agg(F.count(F.lit(1)).alias("n"))


def collisions(fragments: DataFrame, more_than: int = 100) -> DataFrame:
    """Per crowded position how many fragments have each number of copies."""
    return (
        fragments.where(F.col("position_count") > more_than)
        .groupBy("sample", "seqname", "pos", "cigar", "strand", "position_count", "fragment_count")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def consensus_tail(tails: DataFrame, column: str = "tail") -> DataFrame:
    """(sample, position, base, fraction, n): the most common base of the unaligned tails at each position."""
    counts = (
        tails.where(F.length(column) > 0)
        .select("sample", F.posexplode(S.bases_of(F.col(column))).alias("position", "base"))
        .groupBy("sample", "position", "base")
        .agg(F.count(F.lit(1)).alias("c"))
    )
    # Largest count first; ties go to the alphabetically first base.
    key = F.struct(F.col("c"), (-F.ascii("base")).alias("k"))
    return counts.groupBy("sample", "position").agg(
        F.max_by("base", key).alias("base"), (F.max("c") / F.sum("c")).alias("fraction"), F.sum("c").alias("n")
    )


def counter(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy("sample", *columns).agg(F.count(F.lit(1)).alias("n"))


def max_read_lengths(reads: DataFrame) -> DataFrame:
    return reads.groupBy("sample").agg(F.max(F.length("seq")).alias("max_length"))


def length_distribution(max_lengths: DataFrame) -> DataFrame:
    return max_lengths.groupBy("max_length").agg(F.count(F.lit(1)).alias("n"))
