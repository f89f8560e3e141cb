"""Profiles over many genes: around landmarks, per codon, per frame, and edge effects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footprints import constants as C
from footprints.functions import sequence as S, stats
from footprints.operators import coords, intervals


def isolated_genes(models: DataFrame, left: int = C.BUFFER, right: int = C.BUFFER, min_distance: int = 100) -> DataFrame:
    """Genes without overlaps whose downstream neighbour, if within the buffer, starts at least 100 nt behind the stop codon."""
    downstream = F.when(F.col("strand") == "+", F.col("closest_right")).otherwise(F.col("closest_left"))
    distance = coords.to_transcript(downstream, left, right) - F.col("stop_codon_t")
    close = F.coalesce(distance < min_distance, F.lit(False))
    return models.where((F.col("overlapping") == 0) & ~close)


def _landmarks(left: int, right: int) -> Column:
    """Per gene the four landmarks: origin relative to the start codon, actual window, uniform window (half-open)."""
    cds = F.col("stop_codon_t") - F.col("start_codon_t")
    row = lambda name, origin, lo, hi, ulo, uhi: F.struct(
        F.lit(name).alias("landmark"),
        *[F.lit(v).cast("bigint").alias(k) if isinstance(v, int) else v.cast("bigint").alias(k)
          for k, v in (("origin", origin), ("lo", lo), ("hi", hi), ("ulo", ulo), ("uhi", uhi))],
    )
    return F.array(
        row("start", -F.col("start_codon_t"), -left, cds, 0, cds),
        row("start_codon", 0, -left, cds, -left, cds),
        row("stop_codon", cds, -cds, right, -cds, right),
        row("end", F.col("transcript_length") - F.col("start_codon_t"), -cds, right, -cds, 0),
    )


def _placed(counts: DataFrame, genes: DataFrame, left: int, right: int) -> DataFrame:
    marked = genes.select("gene", F.explode(_landmarks(left, right)).alias("m")).select("gene", "m.*")
    return counts.join(marked, "gene").withColumn("rel", F.col("pos") - F.col("origin"))


def _gene_densities(placed: DataFrame) -> DataFrame:
    inside = (F.col("rel") >= F.col("ulo")) & (F.col("rel") < F.col("uhi"))
    sums = placed.where(inside).groupBy("sample", "key", "landmark", "gene", "ulo", "uhi").agg(F.sum("n").alias("total"))
    return sums.withColumn("density", F.col("total") / (F.col("uhi") - F.col("ulo"))).where("density > 0")


def metagene(counts: DataFrame, genes: DataFrame, left: int = C.BUFFER, right: int = C.BUFFER) -> DataFrame:
    """(sample, key, landmark, rel, actual, uniform, sum_of_enrichments, num_eligible) over the given genes.

    The uniform expectation and the number of eligible genes come from two edge events per gene, not from a row per gene
    and position. Positions where everything is 0 are left out.
    """
    placed = _placed(counts, genes, left, right)
    keys = ["sample", "key", "landmark"]
    densities = _gene_densities(placed)
    inside = (F.col("rel") >= F.col("lo")) & (F.col("rel") < F.col("hi"))
    uniform_inside = (F.col("rel") >= F.col("ulo")) & (F.col("rel") < F.col("uhi"))
    joined = placed.join(densities.select(*keys, "gene", "density"), [*keys, "gene"], "left")
    actual = joined.groupBy(*keys, "rel").agg(
        F.sum(F.when(inside, F.col("n")).otherwise(0)).alias("actual"),
        F.sum(F.when(uniform_inside, F.col("n") / F.col("density")).otherwise(0.0)).alias("sum_of_enrichments"),
    ).where("actual > 0 or sum_of_enrichments > 0")
    runs = intervals.stacked_runs(densities, keys, "ulo", "uhi", {"uniform": "density"})
    expected = runs.select(
        *keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("rel"), "uniform", F.col("layers").alias("num_eligible")
    )
    both = actual.join(expected, [*keys, "rel"], "full_outer")
    return both.na.fill(0, ["actual", "num_eligible"]).na.fill(0.0, ["sum_of_enrichments", "uniform"])


def metagene_by_base(counts: DataFrame, genes: DataFrame, sequences: DataFrame, left: int = C.BUFFER, right: int = C.BUFFER) -> DataFrame:
    """(sample, key, landmark, base, rel, actual, uniform): the same, apart by the base at each position.

    ``sequences`` start ``left`` bases before the transcript.
    """
    placed = _placed(counts, genes, left, right)
    keys = ["sample", "key", "landmark"]
    base_at = lambda rel: F.get(F.col("bases"), (rel + F.col("origin") + F.col("start_codon_t") + left).cast("int"))
    texts = sequences.join(genes.select("gene", "start_codon_t"), "gene").select("gene", S.bases_of(F.col("sequence")).alias("bases"), "start_codon_t")
    inside = (F.col("rel") >= F.col("lo")) & (F.col("rel") < F.col("hi"))
    actual = placed.where(inside).join(texts, "gene").groupBy(*keys, base_at(F.col("rel")).alias("base"), "rel").agg(F.sum("n").alias("actual"))
    origin = genes.select("gene", F.explode(_landmarks(left, right)).alias("m")).select("gene", "m.landmark", "m.origin")
    dense = _gene_densities(placed).join(origin, ["gene", "landmark"]).join(texts, "gene").select(
        *keys, "density", "bases", "origin", "start_codon_t", F.explode(F.sequence(F.col("ulo"), F.col("uhi") - 1)).alias("rel")
    )
    uniform = dense.groupBy(*keys, base_at(F.col("rel")).alias("base"), "rel").agg(F.sum("density").alias("uniform"))
    both = actual.join(uniform, [*keys, "base", "rel"], "full_outer").where(F.col("base").isin(list(C.BASES)))
    return both.na.fill(0, ["actual"]).na.fill(0.0, ["uniform"])


def nucleotide_densities(profile: DataFrame) -> DataFrame:
    """Mean relative density: sum of enrichments over eligible genes, 0 of which count as 1."""
    return profile.select(
        "sample", "key", "landmark", "rel", (F.col("sum_of_enrichments") / F.greatest("num_eligible", F.lit(1))).alias("density")
    )


def averaged_codon_densities(codons: DataFrame, count: str = "relaxed", min_counts: int = 64, skip: DataFrame | None = None) -> DataFrame:
    """(sample, side, rel, density): relative counts averaged over the genes long enough, from the start and to the end.

    Genes with fewer than ``min_counts`` counts, buffers included, and those named in ``skip`` are left out.
    """
    used = codons if skip is None else codons.join(skip.select("gene"), "gene", "left_anti")
    totals = used.groupBy("sample", "gene").agg(
        F.sum(count).alias("total"), F.min("codon_idx").alias("lo"), (F.max("codon_idx") + 1).alias("hi"), F.first("num_codons").alias("length")
    ).where(F.col("total") >= min_counts)
    scaled = used.select("sample", "gene", "codon_idx", F.col(count).alias("n")).join(totals, ["sample", "gene"]).withColumn(
        "value", F.col("n") / (F.col("total") / F.col("length"))
    )
    sides = lambda at: F.explode(F.array(
        F.struct(F.lit("from_start").alias("side"), at.alias("rel")), F.struct(F.lit("from_end").alias("side"), (at - F.col("length")).alias("rel"))
    ))
    sums = scaled.select("sample", "value", sides(F.col("codon_idx")).alias("s")).groupBy("sample", "s.side", "s.rel").agg(F.sum("value").alias("value"))
    spans = totals.select("sample", "lo", "hi", "length", sides(F.col("lo")).alias("s")).select(
        "sample", "s.side", F.col("s.rel").cast("bigint").alias("a"), (F.col("s.rel") + F.col("hi") - F.col("lo")).cast("bigint").alias("b")
    )
    runs = intervals.stacked_runs(spans, ["sample", "side"], "a", "b", {})
    eligible = runs.select("sample", "side", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("rel"), "layers")
    return eligible.join(sums, ["sample", "side", "rel"], "left").select(
        "sample", "side", "rel", (F.coalesce("value", F.lit(0.0)) / F.greatest("layers", F.lit(1))).alias("density")
    )


def first_codon_densities(codons: DataFrame, count: str = "relaxed", first: int = 10) -> DataFrame:
    """(sample, gene, codon_idx, density) of each gene's first codons relative to its CDS mean; genes without counts are left out."""
    inside = (F.col("codon_idx") >= 0) & (F.col("codon_idx") < F.col("num_codons"))
    means = codons.where(inside).groupBy("sample", "gene").agg((F.sum(count) / F.first("num_codons")).alias("mean")).where("mean <> 0")
    heads = codons.where((F.col("codon_idx") >= 0) & (F.col("codon_idx") < first))
    return heads.join(means, ["sample", "gene"]).select("sample", "gene", "codon_idx", (F.col(count) / F.col("mean")).alias("density"))


def metacodon(codons: DataFrame, count: str = "relaxed", window: int = 30) -> DataFrame:
    """(sample, codon, offset, actual, uniform, sum_of_enrichments, num_eligible, enrichment) around every codon, stop codon
    included, that is ``window`` away from both ends; offsets -window .. window - 1."""
    cds = codons.where("codon_idx >= 0 and codon_idx <= num_codons").select("sample", "gene", "codon_idx", "num_codons", "codon", F.col(count).alias("n"))
    means = cds.groupBy("sample", "gene").agg(F.avg("n").alias("mean"))
    size = F.col("num_codons") + 1
    sites = cds.where((F.col("codon_idx") >= window) & (F.col("codon_idx") <= size - window)).select("sample", "gene", "codon", F.col("codon_idx").alias("p")).join(
        means, ["sample", "gene"]
    )
    values = cds.select("sample", "gene", F.col("codon_idx").alias("j"), "n")
    pairs = stats.window_join(sites, values, ["sample", "gene"], "p", "j", window, window - 1)
    some = F.col("mean") > 0
    out = pairs.groupBy("sample", "codon", "offset").agg(
        F.sum("n").alias("actual"),
        F.sum("mean").alias("uniform"),
        F.coalesce(F.sum(F.when(some, F.col("n") / F.col("mean"))), F.lit(0.0)).alias("sum_of_enrichments"),
        F.count_if(some).alias("num_eligible"),
    )
    return out.withColumn("enrichment", F.try_divide(F.col("actual"), F.col("uniform")))


def metanucleotide(counts: DataFrame, codon_starts: DataFrame, around: int = 50) -> DataFrame:
    """(sample, key, codon, offset, n): position counts around the first base of every codon (gene, codon, p, cds_size).

    Codons closer than ``around`` to either end of the coding sequence with its stop codon are left out.
    """
    sites = codon_starts.where((F.col("p") >= around) & (F.col("p") <= F.col("cds_size") - around)).select("gene", "codon", "p")
    pairs = stats.window_join(sites, counts, ["gene"], "p", "pos", around, around - 1)
    return pairs.groupBy("sample", "key", "codon", "offset").agg(F.sum("n").alias("n"))


# ---- edges ---------------------------------------------------------------------------------------


def edge_profile(counts: DataFrame, genes: DataFrame, min_length: int, max_length: int, edge: int, from_end: bool = False) -> DataFrame:
    """(sample, rel, actual, expected) over genes of a length band, against counts spread evenly over CDS and edge buffer.

    ``counts``: sample, gene, rel, n with ``rel`` relative to the landmark. Genes: gene, cds_length.
    """
    lo, hi = (-F.col("cds_length"), F.lit(edge)) if from_end else (F.lit(-edge), F.col("cds_length"))
    banded = genes.where(F.col("cds_length").between(min_length, max_length)).select("gene", lo.cast("bigint").alias("lo"), hi.cast("bigint").alias("hi"))
    used = counts.join(banded, "gene").where((F.col("rel") >= F.col("lo")) & (F.col("rel") < F.col("hi")))
    actual = used.groupBy("sample", "rel").agg(F.sum("n").alias("actual"))
    each = used.groupBy("sample", "gene", "lo", "hi").agg(F.sum("n").alias("total")).withColumn("density", F.col("total") / (F.col("hi") - F.col("lo")))
    runs = intervals.stacked_runs(each, ["sample"], "lo", "hi", {"expected": "density"})
    expected = runs.select("sample", F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("rel"), "expected")
    return expected.join(actual, ["sample", "rel"], "left").na.fill(0, ["actual"])


def most_unexpected(counts: DataFrame, genes: DataFrame, min_length: int, max_length: int, edge: int, top: int = 10) -> DataFrame:
    """Per sample the genes with most counts in the buffer before the landmark."""
    banded = genes.where(F.col("cds_length").between(min_length, max_length)).select("gene")
    sums = counts.where((F.col("rel") >= -edge) & (F.col("rel") < 0)).join(banded, "gene").groupBy("sample", "gene").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("n"), "gene"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= top)


def end_excess(counts: DataFrame, genes: DataFrame, min_length: int, first: int = 200) -> DataFrame:
    """(sample, gene, excess): counts in the first positions beyond an even spread over the gene's length."""
    used = counts.join(genes.where(F.col("cds_length") >= min_length), "gene").where((F.col("rel") >= 0) & (F.col("rel") < F.col("cds_length")))
    sums = used.groupBy("sample", "gene", "cds_length").agg(
        F.sum("n").alias("total"), F.sum(F.when(F.col("rel") < first, F.col("n")).otherwise(0)).alias("head")
    )
    share = F.least(F.lit(first), F.col("cds_length")) * F.col("total") / F.col("cds_length")
    return sums.select("sample", "gene", (F.col("head") - share).alias("excess"))


def _totals_by_length(counts: DataFrame, genes: DataFrame, min_length: int) -> tuple[DataFrame, DataFrame]:
    inside = counts.join(genes.where(F.col("cds_length") >= min_length), "gene").where((F.col("rel") >= 0) & (F.col("rel") < F.col("cds_length")))
    return inside, inside.groupBy("sample", "cds_length").agg(F.sum("n").alias("r"))


def truncation_profile(counts: DataFrame, genes: DataFrame, grid: DataFrame, min_length: int) -> DataFrame:
    """(p, sample, x, expected, actual): counts by distance from the 3' end under geometric truncation with parameter p.

    Expected: P(x) = sum over l >= x of L(l) / l with L geometric up to the gene's length, scaled by the gene's counts.
    As the terms below a gene's own length are shared by all genes, everything follows from prefix sums over lengths, one
    row per length; the work is genes + longest gene, not genes x positions.
    """
    inside, by_length = _totals_by_length(counts, genes, min_length)
    actual = inside.groupBy("sample", (F.col("cds_length") - F.col("rel")).alias("x")).agg(F.sum("n").alias("actual"))
    longest = by_length.groupBy("sample").agg(F.max("cds_length").alias("top"))
    axis = longest.select("sample", F.explode(F.sequence(F.lit(1), F.col("top"))).alias("x")).crossJoin(F.broadcast(grid.select("p")))
    q = 1 - F.col("p")
    at_x = axis.join(by_length.withColumnRenamed("cds_length", "x"), ["sample", "x"], "left").na.fill(0, ["r"])
    term = F.col("p") * F.pow(q, F.col("x")) / F.col("x")
    up = Window.partitionBy("sample", "p").orderBy("x")
    s = at_x.withColumn("before", F.coalesce(F.sum(term).over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    down = Window.partitionBy("sample", "p").orderBy(F.desc("x")).rowsBetween(Window.unboundedPreceding, 0)
    weight = F.col("r") * (F.col("before") + F.pow(q, F.col("x")) / F.col("x"))
    done = s.withColumn("a", F.sum(weight).over(down)).withColumn("rest", F.sum("r").over(down))
    expected = done.select("p", "sample", "x", ((F.col("a") - F.col("before") * F.col("rest")) / q).alias("expected"))
    return expected.join(actual, ["sample", "x"], "left").na.fill(0, ["actual"])


def truncation_fit(profile: DataFrame) -> DataFrame:
    """(sample, p, residual): the grid value with the smallest sum of squared residuals."""
    sums = profile.groupBy("sample", "p").agg(F.sum(F.pow(F.col("actual") - F.col("expected"), 2)).alias("residual"))
    return sums.groupBy("sample").agg(F.min_by("p", F.struct("residual", "p")).alias("p"), F.min("residual").alias("residual"))


# ---- frames --------------------------------------------------------------------------------------


def frame_fractions(counts: DataFrame, genes: DataFrame) -> DataFrame:
    """(sample, key, frame, n, fraction) of 5' ends from -15 up to the stop codon's A site."""
    cds = genes.select("gene", (F.col("stop_codon_t") - F.col("start_codon_t")).alias("_cds"))
    used = counts.join(cds, "gene").where((F.col("pos") >= -15) & (F.col("pos") < F.col("_cds") - 15 + 3))
    sums = used.groupBy("sample", "key", F.pmod("pos", F.lit(3)).alias("frame")).agg(F.sum("n").alias("n"))
    return sums.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy("sample", "key")))


def frame_track(counts: DataFrame, extents: DataFrame, offsets: DataFrame, codon_buffer: int = 0) -> DataFrame:
    """(sample, gene, key, codon_idx, frame, n, so_far, remaining) along unspliced extents.

    ``so_far`` and ``remaining`` are the frame's share of all counts up to and from the codon; counts of no read give 0.
    """
    by_length = offsets.select(F.col("length").cast("string").alias("key"), "offset")
    moved = counts.join(F.broadcast(by_length), "key").withColumn("at", F.col("pos") + F.col("offset"))
    size = extents.select("gene", F.floor(F.col("transcript_length") / 3).alias("_n"))
    placed = moved.join(size, "gene").withColumn("codon_idx", F.floor(F.col("at") / 3)).where(
        (F.col("codon_idx") >= -codon_buffer) & (F.col("codon_idx") < F.col("_n") + codon_buffer)
    )
    frames = [f"f{i}" for i in range(3)]
    wide = placed.groupBy("sample", "gene", "key", "codon_idx").agg(
        *[F.sum(F.when(F.pmod("at", F.lit(3)) == i, F.col("n")).otherwise(0)).alias(f) for i, f in enumerate(frames)]
    )
    keys = ["sample", "gene", "key"]
    running = stats.running_sum(wide, keys, "codon_idx", {f"c{i}": f for i, f in enumerate(frames)})
    totals = wide.groupBy(*keys).agg(*[F.sum(f).alias(f"t{i}") for i, f in enumerate(frames)])
    joined = running.join(totals, keys)
    upto = F.greatest(F.lit(1), sum((F.col(f"c{i}") for i in range(3)), F.lit(0)))
    left = lambda i: F.col(f"t{i}") - F.col(f"c{i}") + F.col(f"f{i}")
    beyond = F.greatest(F.lit(1), sum((left(i) for i in range(3)), F.lit(0)))
    rows = F.array(*[
        F.struct(F.lit(i).alias("frame"), F.col(f"f{i}").alias("n"), (F.col(f"c{i}") / upto).alias("so_far"), (left(i) / beyond).alias("remaining"))
        for i in range(3)
    ])
    return joined.select(*keys, "codon_idx", F.explode(rows).alias("r")).select(*keys, "codon_idx", "r.*")


def frame_codons(sequences: DataFrame, wanted: list[str]) -> DataFrame:
    """(gene, frame, codon_idx, codon): where the wanted codons (start, stop) stand in each frame of an extent."""
    at = sequences.select("gene", F.posexplode(S.windows_of(F.col("sequence"), 3)).alias("i", "codon"))
    return at.where(F.col("codon").isin(wanted)).select("gene", (F.col("i") % 3).alias("frame"), F.floor(F.col("i") / 3).alias("codon_idx"), "codon")


def shift_to_three_prime(counts: DataFrame, length: Column, hi: Column) -> DataFrame:
    """Counts of 5' ends moved to the fragments' 3' ends; those pushed off the window (``pos`` >= hi) are lost.

    A fragment of length 1 has both ends at the same place.
    """
    return counts.withColumn("pos", F.col("pos") + length - 1).where(F.col("pos") < hi)


def scaled_to_max(profile: DataFrame, lengths: list[int], lo: int, hi: int) -> DataFrame:
    """Adds ``scaled``: counts relative to the sample's largest one among the allowed lengths and positions."""
    allowed = F.col("length").isin(lengths) & F.col("rel").between(lo, hi)
    top = F.max(F.when(allowed, F.col("n"))).over(Window.partitionBy("sample"))
    return profile.withColumn("scaled", F.try_divide(F.col("n"), top))


def asymptotic_scaled(densities: DataFrame, lo: int = 490, hi: int = 510) -> DataFrame:
    """Densities from the start divided by their mean over codons ``lo`` to ``hi``, exclusive."""
    mean = densities.where((F.col("rel") >= lo) & (F.col("rel") < hi)).groupBy("sample", "side").agg(F.avg("density").alias("_m"))
    return densities.join(mean, ["sample", "side"]).select("sample", "side", "rel", F.try_divide(F.col("density"), F.col("_m")).alias("density"))


def local_enrichment(codons: DataFrame, count: str = "relaxed", utr_codons: int = 0) -> DataFrame:
    """(sample, gene, codon_idx, codon, enrichment) over CDS, stop codon and the shown UTR codons, relative to their mean."""
    shown = codons.where((F.col("codon_idx") >= -utr_codons) & (F.col("codon_idx") < F.col("num_codons") + 1 + utr_codons))
    means = shown.groupBy("sample", "gene").agg(F.avg(count).alias("mean"))
    return shown.join(means, ["sample", "gene"]).select("sample", "gene", "codon_idx", "codon", F.try_divide(F.col(count), F.col("mean")).alias("enrichment"))


# ---- recurring amino acids ---------------------------------------------------------------------


def amino_acid_steps(codons: DataFrame, codon_dim: DataFrame, count: str = "relaxed") -> DataFrame:
    """(sample, gene, amino_acid, first_idx, second_idx, first_codon, second_codon, first_n, second_n, ratio) of consecutive
    codons for the same amino acid within a gene."""
    cds = codons.where("codon_idx >= 0 and codon_idx < num_codons").join(F.broadcast(codon_dim.select("codon", "amino_acid")), "codon")
    w = Window.partitionBy("sample", "gene", "amino_acid").orderBy("codon_idx")
    steps = cds.select(
        "sample", "gene", "amino_acid", F.col("codon_idx").alias("first_idx"), F.lead("codon_idx").over(w).alias("second_idx"),
        F.col("codon").alias("first_codon"), F.lead("codon").over(w).alias("second_codon"),
        F.col(count).alias("first_n"), F.lead(count).over(w).alias("second_n"),
    )
    return steps.where("second_idx is not null").withColumn("ratio", F.try_divide(F.col("first_n").cast("double"), F.col("second_n")))
