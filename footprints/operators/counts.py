"""From alignments to counts per transcript position, codon and gene."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from footprints import constants as C
from footprints.functions import cigar as G
from footprints.operators import coords, dimensions, intervals


def five_prime(strand: Column, pos: Column, aend: Column) -> Column:
    return F.when(strand == "+", pos).otherwise(aend - 1)


def three_prime(strand: Column, pos: Column, aend: Column) -> Column:
    return F.when(strand == "+", aend - 1).otherwise(pos)


def is_unique(mapq: Column) -> Column:
    return mapq == C.UNIQUE_MAPQ


def collapse_alignments(alignments: DataFrame) -> DataFrame:
    """Distinct alignment shapes with their number.

    Position counting depends only on these columns. Footprint libraries repeat the same shapes, so combining them
    map-side before any join removes hot positions as well as most of the rows.
    """
    shape = [
        "sample", "seqname", "strand", "pos", "aend", "cigar", "qlen", "nongenomic_length", "is_secondary",
        is_unique(F.col("mapq")).alias("unique"),
    ]
    return alignments.groupBy(*shape).agg(F.count(F.lit(1)).alias("n"))


def spliced_out(blocks: Column, start: Column, end: Column, exons: Column) -> Column:
    """Whether an aligned base lies strictly between the transcript's ends but in none of its exons."""

    def outside(b: Column) -> Column:
        lo, hi = F.greatest(b["start"], start + 1), F.least(b["end"] - 1, end - 1)
        covered = F.aggregate(
            exons,
            F.lit(0).cast("bigint"),
            lambda acc, e: acc + F.greatest(F.lit(0), F.least(hi, e["end"]) - F.greatest(lo, e["start"]) + 1).cast("bigint"),
        )
        return (hi >= lo) & (covered < hi - lo + 1)

    return F.exists(blocks, outside)


def transcript_hits(
    alignments: DataFrame, models: DataFrame, left: int = C.BUFFER, right: int = C.BUFFER
) -> DataFrame:
    """Every (alignment shape, transcript) candidate with the transcript coordinates of both ends.

    Candidates overlap ``[max(0, start - left), end + right)``. Columns: sample, gene, same_strand, unique,
    is_secondary, qlen, nongenomic_length, n, spliced_out, five_t, three_t and the gene's codon coordinates.
    """
    shapes = collapse_alignments(alignments).select(
        "sample", "seqname", F.col("strand").alias("read_strand"), "pos", F.col("aend"),
        (F.col("aend") - 1).alias("last"), G.aligned_blocks(F.col("pos"), F.col("cigar")).alias("blocks"), "qlen", "nongenomic_length", "is_secondary", "unique", "n",
    )
    genes = models.withColumn("_lo", F.greatest(F.lit(0), F.col("start") - left)).withColumn("_hi", F.col("end") + right - 1)
    places = alignments.select("seqname", "pos", (F.col("aend") - 1).alias("last"))
    pairs = intervals.overlap_join(shapes, genes, ["seqname"], ("pos", "last"), ("_lo", "_hi"), crowd=places)
    # Most candidates lie in a buffer or in one exon; only the others need their blocks compared with the exons.
    reaches_in = (F.col("last") > F.col("start")) & (F.col("pos") < F.col("end"))
    dropped = F.when(reaches_in, spliced_out(F.col("blocks"), F.col("start"), F.col("end"), F.col("exons"))).otherwise(F.lit(False))
    five = five_prime(F.col("read_strand"), F.col("pos"), F.col("aend"))
    three = three_prime(F.col("read_strand"), F.col("pos"), F.col("aend"))
    return pairs.select(
        "sample", "gene", (F.col("read_strand") == F.col("strand")).alias("same_strand"), "unique", "is_secondary",
        "qlen", "nongenomic_length", "n", "start_codon_t", "stop_codon_t",
        dropped.alias("spliced_out"),
        coords.to_transcript(five, left, right).alias("five_t"),
        coords.to_transcript(three, left, right).alias("three_t"),
    )


def hit_summary(hits: DataFrame) -> DataFrame:
    """Per sample and gene the candidates dropped as alternatively spliced and, of the rest, those not unique.

    Both are counted over candidates of either strand.
    """
    return hits.groupBy("sample", "gene").agg(
        F.sum(F.when(~F.col("spliced_out") & ~F.col("unique"), F.col("n")).otherwise(0)).alias("nonunique"),
        F.sum(F.when(F.col("spliced_out"), F.col("n")).otherwise(0)).alias("alternatively_spliced"),
    )


def position_counts(hits: DataFrame, relevant_lengths: list[int]) -> DataFrame:
    """(sample, gene, read_end, key, pos, n); ``pos`` is relative to the start codon.

    Keys of the 5' end: ``all``, each relevant length, ``all_nonunique`` (primary hits only). Keys of the 3' end:
    ``all``, each nongenomic length up to the maximum, ``all_nonunique``.
    """
    used = hits.where(~F.col("spliced_out") & F.col("same_strand"))
    nothing = F.array().cast("array<string>")

    def keys(extra: Column) -> Column:
        return F.when(F.col("unique"), F.concat(F.array(F.lit("all")), extra)).when(
            ~F.col("is_secondary"), F.array(F.lit("all_nonunique"))
        ).otherwise(nothing)

    by_length = F.when(F.col("qlen").isin(relevant_lengths), F.array(F.col("qlen").cast("string"))).otherwise(nothing)
    by_tail = F.when(
        F.col("nongenomic_length") <= C.MAX_NONGENOMIC_LENGTH, F.array(F.col("nongenomic_length").cast("string"))
    ).otherwise(nothing)
    entry = lambda end, t, ks: F.transform(
        ks, lambda k: F.struct(F.lit(end).alias("read_end"), k.alias("key"), (t - F.col("start_codon_t")).alias("pos"))
    )
    entries = F.concat(entry("five", F.col("five_t"), keys(by_length)), entry("three", F.col("three_t"), keys(by_tail)))
    return (
        used.select("sample", "gene", "n", F.explode(entries).alias("e"))
        .where(F.col("e.pos").isNotNull())
        .groupBy("sample", "gene", F.col("e.read_end").alias("read_end"), F.col("e.key").alias("key"), F.col("e.pos").alias("pos"))
        .agg(F.sum("n").alias("n"))
    )


def joint_counts(hits: DataFrame) -> DataFrame:
    """(sample, gene, five_pos, three_pos, n): 5' end from the transcript start, 3' end relative to the stop codon."""
    used = hits.where("same_strand and `unique` and not spliced_out and five_t is not null and three_t is not null")
    return used.groupBy(
        "sample", "gene", F.col("five_t").alias("five_pos"), (F.col("three_t") - F.col("stop_codon_t")).alias("three_pos")
    ).agg(F.sum("n").alias("n"))


def extent_counts(alignments: DataFrame, extents: DataFrame, relevant_lengths: list[int], left: int = 0, right: int = 0) -> DataFrame:
    """(sample, gene, key, pos, n) of unique 5' ends along unspliced extents; keys ``all`` and each relevant length."""
    unique = alignments.where(is_unique(F.col("mapq")))
    five = five_prime(F.col("strand"), F.col("pos"), F.col("aend")).alias("five")
    shapes = collapse_alignments(unique).select(
        "sample", "seqname", "strand", "qlen", "n", F.col("pos").alias("_rp"), (F.col("aend") - 1).alias("_re"), five
    )
    # The candidate window ends one base before the last buffer position of the forward coordinate.
    plus = F.col("strand") == "+"
    spans = extents.withColumn("_lo", F.col("start") - F.when(plus, left).otherwise(right)).withColumn(
        "_hi", F.col("end") + F.when(plus, right).otherwise(left)
    )
    candidates = (F.col("_rp") < F.col("_hi") + right) & (F.col("_re") >= F.greatest(F.lit(0), F.col("_lo") - left))
    places = unique.select("seqname", "strand", five)
    hits = intervals.point_join(shapes, spans, ["seqname", "strand"], "five", ("_lo", "_hi"), crowd=places).where(candidates)
    t = coords.to_transcript(F.col("five"), left, right)
    keys = F.when(F.col("qlen").isin(relevant_lengths), F.array(F.lit("all"), F.col("qlen").cast("string"))).otherwise(F.array(F.lit("all")))
    return (
        hits.select("sample", "gene", F.explode(keys).alias("key"), t.alias("pos"), "n")
        .groupBy("sample", "gene", "key", "pos")
        .agg(F.sum("n").alias("n"))
    )


def split_three_prime(counts: DataFrame) -> DataFrame:
    """3' counts as genomic (no untemplated A) and nongenomic (all others)."""
    genomic = F.sum(F.when(F.col("key") == "0", F.col("n")).otherwise(0))
    every = F.sum(F.when(F.col("key") == "all", F.col("n")).otherwise(0))
    return (
        counts.where("read_end = 'three' and key in ('all', '0')")
        .groupBy("sample", "gene", "pos")
        .agg(genomic.alias("genomic"), (every - genomic).alias("nongenomic"))
    )


def offsets_table(spark: SparkSession) -> DataFrame:
    """The fixed A-site offsets as (offset_type, length, offset)."""
    rows = [(kind, length, offset) for kind, by_length in C.A_SITE_OFFSETS.items() for length, offset in by_length.items()]
    return spark.createDataFrame(rows, "offset_type string, length int, offset int")


def codon_counts(counts: DataFrame, genes: DataFrame, offsets: DataFrame, codon_buffer: int = C.CODON_BUFFER) -> DataFrame:
    """(sample, gene, offset_type, codon_idx, n): reads whose A site lies in a codon or its buffer.

    Position 3i - offset and its two neighbours belong to codon i.
    """
    frames = genes.select(
        "gene",
        F.assert_true((F.col("stop_codon_t") - F.col("start_codon_t")) % 3 == 0, F.lit("CDS length not divisible by 3")).isNull().alias("_ok"),
        ((F.col("stop_codon_t") - F.col("start_codon_t")) / 3).cast("int").alias("num_codons"),
    ).where("_ok")
    by_length = offsets.select("offset_type", F.col("length").cast("string").alias("key"), "offset")
    placed = counts.where("read_end = 'five'").join(F.broadcast(by_length), "key").select(
        "sample", "gene", "offset_type", F.floor((F.col("pos") + F.col("offset") + 1) / 3).alias("codon_idx"), "n"
    )
    sums = placed.groupBy("sample", "gene", "offset_type", "codon_idx").agg(F.sum("n").alias("n"))
    inside = (F.col("codon_idx") >= -codon_buffer) & (F.col("codon_idx") < F.col("num_codons") + codon_buffer)
    return sums.join(frames, "gene").where(inside).select("sample", "gene", "offset_type", "codon_idx", "n")


def codon_table(counts: DataFrame, identities: DataFrame, samples: DataFrame, relaxed: str, stringent: str, anisomycin: str) -> DataFrame:
    """Dense (sample, gene, codon_idx, num_codons, codon, relaxed, stringent, anisomycin); zeros where no read fell."""
    wide = counts.groupBy("sample", "gene", "codon_idx").agg(
        *[
            F.sum(F.when(F.col("offset_type") == kind, F.col("n")).otherwise(0)).alias(name)
            for name, kind in [("relaxed", relaxed), ("stringent", stringent), ("anisomycin", anisomycin)]
        ]
    )
    grid = dimensions.for_each(identities, samples)
    return grid.join(wide, ["sample", "gene", "codon_idx"], "left").na.fill(0, ["relaxed", "stringent", "anisomycin"])


def read_counts(
    counts: DataFrame, genes: DataFrame, samples: DataFrame, exclude_start: int = 0, exclude_end: int = 0
) -> DataFrame:
    """(sample, gene, cds_length, n): 5' ends whose A site (offset 15) lies in the CDS without its excluded edges.

    Every gene is listed for every row of the ``samples`` dimension, with 0 where no read fell.
    """
    lengths = genes.select("gene", (F.col("stop_codon_t") - F.col("start_codon_t")).cast("int").alias("_cds"))
    inside = (F.col("pos") >= -15 + exclude_start) & (F.col("pos") < F.col("_cds") - 15 + 3 - exclude_end)
    hits = counts.where("read_end = 'five' and key = 'all'").join(lengths, "gene").where(inside)
    sums = hits.groupBy("sample", "gene").agg(F.sum("n").alias("n"))
    return (
        dimensions.for_each(lengths, samples.select("sample"))
        .join(sums, ["sample", "gene"], "left")
        .select(
            "sample", "gene", (F.col("_cds") - exclude_start - exclude_end).alias("cds_length"),
            F.coalesce("n", F.lit(0)).alias("n"),
        )
    )


def rpkm(read_counts_: DataFrame, exclude_start: int = 0, exclude_end: int = 0, compat_double_edge: bool = False) -> DataFrame:
    """(sample, gene, rpkm). ``compat_double_edge`` takes the excluded edges off the length a second time."""
    length = F.col("cds_length") - (exclude_start + exclude_end if compat_double_edge else 0)
    totals = read_counts_.groupBy("sample").agg(F.sum("n").alias("total"))
    return read_counts_.join(totals, "sample").select(
        "sample", "gene", F.try_divide(F.lit(1e9) * F.col("n") / length, F.col("total")).alias("rpkm")
    )


def all_codon_counts(codons: DataFrame, count: str = "relaxed") -> DataFrame:
    """Counts of every CDS codon from the third on, gene by gene."""
    return codons.where("codon_idx >= 2 and codon_idx < num_codons").select("sample", "gene", "codon_idx", F.col(count).alias("n"))


def coverage(alignments: DataFrame) -> DataFrame:
    """(sample, seqname, qlen, pos, n): mappings over each position by read length."""
    shapes = alignments.groupBy("sample", "seqname", "qlen", "pos", "cigar").agg(F.count(F.lit(1)).alias("w"))
    blocks = shapes.select(
        "sample", "seqname", "qlen", "w", F.explode(G.aligned_blocks(F.col("pos"), F.col("cigar"))).alias("b")
    ).select("sample", "seqname", "qlen", "w", F.col("b.start").alias("s"), F.col("b.end").alias("e"))
    keys = ["sample", "seqname", "qlen"]
    return intervals.per_base(intervals.depth_runs(blocks, keys, "s", "e", "w"), keys)


def dominant_stretches(alignments: DataFrame, totals: DataFrame, threshold: float = C.DOMINANT_THRESHOLD) -> DataFrame:
    """(sample, seqname, start, end): maximal half-open runs whose coverage is at least ``threshold`` of the reads.

    A position passes only if it holds that share of a sample's reads, so at most read length / threshold positions
    per sample reach the last window.
    """
    shapes = alignments.groupBy("sample", "seqname", "pos", "cigar").agg(F.count(F.lit(1)).alias("w"))
    blocks = shapes.select("sample", "seqname", "w", F.explode(G.aligned_blocks(F.col("pos"), F.col("cigar"))).alias("b")).select(
        "sample", "seqname", "w", F.col("b.start").alias("s"), F.col("b.end").alias("e")
    )
    runs = intervals.depth_runs(blocks, ["sample", "seqname"], "s", "e", "w").join(totals, "sample")
    high = runs.where(F.col("depth") / F.col("total") >= threshold)
    w = Window.partitionBy("sample", "seqname").orderBy("start")
    starts = F.when(F.lag("end").over(w) == F.col("start"), 0).otherwise(1)
    island = F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))
    return (
        high.withColumn("_new", starts)
        .withColumn("_island", island)
        .groupBy("sample", "seqname", "_island")
        .agg(F.min("start").alias("start"), F.max("end").alias("end"))
        .drop("_island")
    )


def stretch_reads(alignments: DataFrame, stretches: DataFrame) -> DataFrame:
    """(sample, seqname, start, end, qname, qlen) of the mappings whose span meets a stretch."""
    reads = alignments.select("sample", "seqname", "qname", "qlen", F.col("pos").alias("_s"), (F.col("aend") - 1).alias("_e"))
    spans = stretches.withColumn("_last", F.col("end") - 1)
    return intervals.overlap_join(reads, spans, ["sample", "seqname"], ("_s", "_e"), ("start", "_last")).drop("_s", "_e", "_last")
