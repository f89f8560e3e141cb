"""Pause statistics on dense codon counts (sample, gene, codon_idx, num_codons, codon, counts ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from footprints import constants as C
from footprints.functions import stats
from footprints.operators import dimensions, surroundings


def cds_codons(codons: DataFrame, count: str = "relaxed") -> DataFrame:
    """(sample, gene, i, codon, n, length): codons from the third to the one before the stop codon; ``i`` starts at 0."""
    return codons.where("codon_idx >= 2 and codon_idx < num_codons").select(
        "sample", "gene", (F.col("codon_idx") - 2).cast("bigint").alias("i"), "codon", F.col(count).alias("n"), (F.col("num_codons") - 2).alias("length")
    )


def mean_of_rest(values: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """Adds ``rest``, the mean of all other values of the group."""
    sums = values.groupBy(*keys).agg(F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_c"))
    return values.join(sums, list(keys)).withColumn("rest", F.try_divide(F.col("_s") - F.col(value), F.col("_c") - 1)).drop("_s", "_c")


def group_medians(values: DataFrame, keys: Sequence[str], value: str = "n") -> DataFrame:
    """Exact medians; equal values are combined first, so a group's state is its distinct counts."""
    freq = values.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_f"))
    return freq.groupBy(*keys).agg(F.percentile(F.col(value), F.lit(0.5), F.col("_f")).alias("median"))


def _in_every_sample(values: DataFrame, per_gene: DataFrame, condition: Column) -> DataFrame:
    """Genes for which the condition holds in each of the samples that occur."""
    n = values.agg(F.count_distinct("sample").alias("_n"))
    good = per_gene.groupBy("gene").agg(F.count_if(condition).alias("_ok"))
    return good.crossJoin(F.broadcast(n)).where("_ok = _n").select("gene")


def pause_scores(codons: DataFrame, special: DataFrame | None = None, min_median: float = 2, count: str = "relaxed") -> DataFrame:
    """(sample, set, gene, i, codon, n, ratio): counts relative to the mean of the rest of the CDS, by codon set.

    ``special`` is the small parameter table (set, codon); codons in none are ``not_special``. Only genes whose median is at
    least ``min_median`` in every sample count.
    """
    cds = cds_codons(codons, count)
    medians = group_medians(cds, ["sample", "gene"])
    genes = _in_every_sample(cds, medians, F.col("median") >= min_median)
    scored = mean_of_rest(cds.join(genes, "gene", "left_semi"), ["sample", "gene"])
    scored = scored.withColumn("ratio", F.try_divide(F.col("n").cast("double"), F.col("rest")))
    if special is None:
        named = scored.withColumn("set", F.lit("not_special"))
    else:
        named = scored.join(F.broadcast(special), "codon", "left").withColumn("set", F.coalesce("set", F.lit("not_special")))
    return named.select("sample", "set", "gene", "i", "codon", "n", "ratio")


def inner_stats(cds: DataFrame, before: int, after: int) -> DataFrame:
    """(sample, gene, mean, median, long_enough) over the CDS without its edges."""
    inner = (F.col("i") >= before) & (F.col("i") < F.col("length") - after)
    used = cds.where((F.col("length") >= before + after + 1) & inner)
    means = used.groupBy("sample", "gene").agg(F.avg("n").alias("mean"))
    return means.join(group_medians(used, ["sample", "gene"]), ["sample", "gene"])


def highly_expressed(codons: DataFrame, min_mean: float = 1, min_median: float = 0, count: str = "relaxed", before: int = 90, after: int = 90) -> DataFrame:
    """Genes long enough whose edge-trimmed mean exceeds ``min_mean`` and median reaches ``min_median`` in every sample."""
    cds = cds_codons(codons, count)
    return _in_every_sample(cds, inner_stats(cds, before, after), (F.col("mean") > min_mean) & (F.col("median") >= min_median))


def pause_sites(
    codons: DataFrame, genes: DataFrame, relevant: DataFrame, forbidden: DataFrame | None = None, count: str = "relaxed", before: int = 90, after: int = 90
) -> DataFrame:
    """(sample, gene, i, n, ratio) of positions with a relevant codon and no forbidden codon at its offset.

    ``relevant`` (codon) and ``forbidden`` (offset, codon) are small parameter tables. Ratios are to the mean without edges;
    a gene without counts there is an error.
    """
    cds = cds_codons(codons, count).join(genes.select("gene"), "gene", "left_semi")
    inner = (F.col("i") >= before) & (F.col("i") < F.col("length") - after)
    means = cds.where(inner).groupBy("sample", "gene").agg(F.avg("n").alias("mean"))
    sites = cds.where(inner).join(F.broadcast(relevant.select("codon").distinct()), "codon", "left_semi")
    if forbidden is not None:
        bad = cds.join(F.broadcast(forbidden), "codon").select("sample", "gene", (F.col("i") - F.col("offset")).alias("i")).distinct()
        sites = sites.join(bad, ["sample", "gene", "i"], "left_anti")
    ratio = F.when(F.col("mean") == 0, F.raise_error(F.concat(F.lit("no counts in gene "), F.col("gene").cast("string"))).cast("double")).otherwise(F.col("n") / F.col("mean"))
    return sites.join(means, ["sample", "gene"]).select("sample", "gene", "i", "n", ratio.alias("ratio"), "mean")


def site_contexts(sites: DataFrame, codons: DataFrame, te: DataFrame | None = None, count: str = "relaxed", before: int = 90, after: int = 90) -> DataFrame:
    """(sample, gene, i, site_ratio, te, offset, codon, n, ratio): what stands around every pause site."""
    cds = cds_codons(codons, count).select("sample", "gene", F.col("i").alias("j"), "codon", "n")
    marked = sites.select("sample", "gene", "i", F.col("ratio").alias("site_ratio"), "mean")
    pairs = stats.window_join(marked, cds, ["sample", "gene"], "i", "j", before, after).withColumn("ratio", F.col("n") / F.col("mean")).drop("j", "mean")
    if te is None:
        return pairs.withColumn("te", F.lit(0.0))
    return pairs.join(te.select("gene", "te"), "gene", "left").na.fill(0.0, ["te"])


def ratios_at(sites: DataFrame, codons: DataFrame, offset: int, count: str = "relaxed") -> DataFrame:
    """(sample, gene, i, ratio): the relative count at one offset from every site, by an equi-join on the codon."""
    at = cds_codons(codons, count).select("sample", "gene", (F.col("i") - offset).alias("i"), F.col("n").alias("_n"))
    return sites.select("sample", "gene", "i", "mean").join(at, ["sample", "gene", "i"]).select("sample", "gene", "i", (F.col("_n") / F.col("mean")).alias("ratio"))


def context_sums(
    sites: DataFrame, codons: DataFrame, te: DataFrame | None = None, label: Column | None = None, count: str = "relaxed", before: int = 90, after: int = 90, pairs: bool = False
) -> DataFrame:
    """(sample, label, offset, codon, sites, site_ratio, n, ratio, te, weighted): sums over the contexts of all sites of a label.

    ``n`` and ``ratio`` are those at the offset, ``site_ratio`` and ``te`` those of the site, ``weighted`` is their product.
    ``label`` is a string column of the sites, all of one by default; sites without one are left out. The sums equal those over
    ``site_contexts``, without a row per site and offset.
    """
    marked = sites.withColumn("label", F.lit("") if label is None else label)
    marked = marked.withColumn("te", F.lit(0.0)) if te is None else marked.join(te.select("gene", "te"), "gene", "left").na.fill(0.0, ["te"])
    marked = marked.select(
        "sample", "gene", "i", "label", F.col("ratio").alias("site_ratio"), "te", (F.col("ratio") * F.col("te")).alias("weighted"), F.lit(1.0).alias("count"), (1 / F.col("mean")).alias("per_mean")
    )
    rows = cds_codons(codons, count).select("sample", "gene", "i", "codon", "n").join(marked, ["sample", "gene", "i"], "left")
    sums = surroundings.sums_around(rows, ["site_ratio", "te", "weighted", "count", "per_mean"], before, after, ["count", "per_mean"], pairs)
    return sums.withColumnsRenamed({"count": "n", "per_mean": "ratio"}).withColumn("n", F.col("n").cast("bigint"))


def nucleotides(sums: DataFrame) -> DataFrame:
    """Sums or contexts by base: ``offset`` in nucleotides (3 * codon offset + 0 .. 2) and ``base``."""
    letters = F.array(*[F.substring("codon", k + 1, 1) for k in range(3)])
    rest = [c for c in sums.columns if c not in ("offset", "codon")]
    return sums.select(*rest, F.col("offset").alias("_o"), F.posexplode(letters).alias("_k", "base")).select(
        *rest, (F.col("_o") * 3 + F.col("_k")).alias("offset"), "base"
    )


# ---- bins of pause sites -------------------------------------------------------------------------


def quantile_grid(spark: SparkSession, parts: int) -> DataFrame:
    return spark.createDataFrame([(q, q / parts) for q in range(parts + 1)], "q int, p double")


def bin_edges(sites: DataFrame, value: str, parts: int, collapse_zeros: bool) -> DataFrame:
    """(bin, lo, hi) between exact quantiles; with ``collapse_zeros`` only the last of the leading zero quantiles stays."""
    q = stats.mquantiles(sites, [], value, quantile_grid(sites.sparkSession, parts))
    # parts + 1 rows.
    by_rank = Window.orderBy("q")
    zeros = F.sum(F.when(F.col("quantile") == 0, 1).otherwise(0)).over(Window.partitionBy())
    kept = q.withColumn("_z", zeros) if collapse_zeros else q.withColumn("_z", F.lit(0))
    kept = kept.where(F.col("q") >= F.greatest(F.col("_z") - 1, F.lit(0)))
    return kept.select((F.row_number().over(by_rank) - 1).alias("bin"), F.col("quantile").alias("lo"), F.lead("quantile").over(by_rank).alias("hi")).where("hi is not null")


def assign_bins(sites: DataFrame, edges: DataFrame, value: str, include_max: bool = False) -> DataFrame:
    """Sites with ``bin`` (string): [lo, hi), so the largest value is in no bin unless asked for; all sites again as ``all``."""
    below = (F.col(value) <= F.col("hi")) if include_max else (F.col(value) < F.col("hi"))
    numbered = sites.join(F.broadcast(edges), (F.col(value) >= F.col("lo")) & below).withColumn("bin", F.col("bin").cast("string")).drop("lo", "hi")
    return numbered.unionByName(sites.withColumn("bin", F.lit("all")))


def bin_labels(sites: DataFrame, edges: DataFrame, value: str, include_max: bool = False) -> DataFrame:
    """Sites with ``label``, their bin as a string; ``none`` where the value is in no bin. One row per site."""
    below = (F.col(value) <= F.col("hi")) if include_max else (F.col(value) < F.col("hi"))
    found = sites.join(F.broadcast(edges), (F.col(value) >= F.col("lo")) & below, "left")
    return found.withColumn("label", F.coalesce(F.col("bin").cast("string"), F.lit("none"))).drop("bin", "lo", "hi")


def binned_base_composition(sums: DataFrame, relative: bool = False) -> DataFrame:
    """(bin, offset, base, fraction) of nucleotides around the sites of each label, from ``context_sums``; all sites again as
    ``all``. With ``relative``, divided by the fractions of ``all``, which count at least 0.1."""
    n = nucleotides(sums).select(F.explode(F.array("label", F.lit("all"))).alias("bin"), "offset", "base", "sites").where("bin <> 'none'")
    counts = n.groupBy("bin", "offset", "base").agg(F.sum("sites").alias("c"))
    total = F.sum("c").over(Window.partitionBy("bin", "offset"))
    fractions = counts.select("bin", "offset", "base", (F.col("c") / total).alias("fraction"))
    if not relative:
        return fractions
    every = fractions.where("bin = 'all'").select("offset", "base", F.greatest(F.lit(0.1), "fraction").alias("_all"))
    return fractions.where("bin <> 'all'").join(every, ["offset", "base"]).select("bin", "offset", "base", (F.col("fraction") / F.col("_all")).alias("fraction"))


def binned_means(sums: DataFrame, reach: int = 40) -> DataFrame:
    """(bin, offset, ratio, te): mean ratio at each offset and mean TE of the sites of each label, from ``context_sums``."""
    near = sums.where(F.col("offset").between(-reach, reach) & (F.col("label") != "none"))
    return near.groupBy(F.col("label").alias("bin"), "offset").agg((F.sum("ratio") / F.sum("sites")).alias("ratio"), (F.sum("te") / F.sum("sites")).alias("te"))


def split_profiles(sums: DataFrame) -> DataFrame:
    """(above, offset, ratio): mean profiles of the sites with a ratio above 1 and of the others; labels are ``above_one``."""
    return sums.groupBy((F.col("label") == "above").alias("above"), "offset").agg((F.sum("ratio") / F.sum("sites")).alias("ratio"))


def above_one(ratio: Column) -> Column:
    return F.when(ratio > 1, F.lit("above")).otherwise(F.lit("below"))


# ---- mean ratio by what stands around the site ---------------------------------------------------


def _mean_ratio() -> Column:
    return (F.sum("site_ratio") / F.sum("sites")).alias("ratio")


def mean_by_base(sums: DataFrame) -> DataFrame:
    """(offset, base, ratio) over single nucleotide offsets, from ``context_sums``; 0 where the base never occurs."""
    found = nucleotides(sums).groupBy("offset", "base").agg(_mean_ratio())
    grid = found.select("offset").distinct().crossJoin(F.broadcast(dimensions.bases(sums.sparkSession).select("base")))
    return grid.join(found, ["offset", "base"], "left").na.fill(0.0, ["ratio"])


def mean_by_base_pair(contexts: DataFrame, first: int = -16, last: int = 12) -> DataFrame:
    """(first_offset, second_offset, first_base, second_base, ratio) over pairs of nucleotide offsets in the fixed span."""
    lo, hi = first // 3, last // 3
    span = contexts.where(F.col("offset").between(lo, hi)).groupBy("sample", "gene", "i", "site_ratio").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("offset", "codon"))), lambda x: x["codon"]), "").alias("text"), F.min("offset").alias("lo")
    )
    offsets = [(a, b) for a in range(first, last + 1) for b in range(a + 1, last + 1)]
    at = lambda o: F.substr(F.col("text"), (o - 3 * F.col("lo") + 1).cast("int"), F.lit(1))
    # The span is 29 offsets wide, so each site gives the same 406 pairs; equal ones are combined before the shuffle.
    pairs = F.array(*[F.struct(F.lit(a).alias("first_offset"), F.lit(b).alias("second_offset")) for a, b in offsets])
    rows = span.select("site_ratio", "text", "lo", F.explode(pairs).alias("p")).select("site_ratio", "text", "lo", "p.*")
    return rows.groupBy(
        "first_offset", "second_offset", at(F.col("first_offset")).alias("first_base"), at(F.col("second_offset")).alias("second_base")
    ).agg(F.avg("site_ratio").alias("ratio")).where("first_base <> '' and second_base <> ''")


def mean_by_codon(sums: DataFrame) -> DataFrame:
    """(offset, codon, ratio) over codon offsets, from ``context_sums``; 0 where the codon never occurs."""
    found = sums.groupBy("offset", "codon").agg(_mean_ratio())
    sense = dimensions.codon_dimension(sums.sparkSession).where("amino_acid <> '*'").select("codon")
    return found.select("offset").distinct().crossJoin(F.broadcast(sense)).join(found, ["offset", "codon"], "left").na.fill(0.0, ["ratio"])


def mean_by_codon_pair(sums: DataFrame) -> DataFrame:
    """(offset, p_codon, a_codon, ratio) of adjacent codons, from ``context_sums`` with ``pairs``; ``offset`` is the first one's.
    Pairs that never occur are left out."""
    pairs = sums.where("codon_before is not null")
    return pairs.groupBy((F.col("offset") - 1).alias("offset"), F.col("codon_before").alias("p_codon"), F.col("codon").alias("a_codon")).agg(_mean_ratio())


def overall_mean(sites: DataFrame) -> DataFrame:
    return sites.agg(F.avg("ratio").alias("baseline"))


def base_pair_effects(pairs: DataFrame, singles: DataFrame, baseline: DataFrame) -> DataFrame:
    """Expected ratio of a base pair if offsets act independently, and the actual one, both over the baseline."""
    s = lambda which: singles.select(F.col("offset").alias(f"{which}_offset"), F.col("base").alias(f"{which}_base"), F.col("ratio").alias(f"_{which}"))
    joined = pairs.join(F.broadcast(s("first")), ["first_offset", "first_base"]).join(F.broadcast(s("second")), ["second_offset", "second_base"]).crossJoin(F.broadcast(baseline))
    return joined.select(
        "first_offset", "second_offset", "first_base", "second_base",
        F.try_divide(F.col("_first") * F.col("_second"), F.pow("baseline", F.lit(2))).alias("expected"),
        F.try_divide(F.col("ratio"), F.col("baseline")).alias("actual"),
    )


def codon_effects(codons: DataFrame, singles: DataFrame, baseline: DataFrame) -> DataFrame:
    """The same for codons and their three bases."""
    joined = codons
    for k in range(3):
        s = singles.select(F.col("offset").alias(f"_o{k}"), F.col("base").alias(f"_b{k}"), F.col("ratio").alias(f"_r{k}"))
        joined = joined.join(F.broadcast(s), (F.col("offset") * 3 + k == F.col(f"_o{k}")) & (F.substring("codon", k + 1, 1) == F.col(f"_b{k}")))
    return joined.crossJoin(F.broadcast(baseline)).select(
        "offset", "codon",
        F.try_divide(F.col("_r0") * F.col("_r1") * F.col("_r2"), F.pow("baseline", F.lit(3))).alias("expected"),
        F.try_divide(F.col("ratio"), F.col("baseline")).alias("actual"),
    )


def codon_pair_effects(enrichments: DataFrame, offset: int = 0) -> DataFrame:
    """(sample, p_codon, a_codon, expected, actual, occurrences) from enrichments of one condition with dicodons."""
    codon = enrichments.where("feature = 'codon'")
    p = codon.where(F.col("offset") == offset - 1).select("sample", F.col("label").alias("p_codon"), F.col("enrichment").alias("_p"))
    a = codon.where(F.col("offset") == offset).select("sample", F.col("label").alias("a_codon"), F.col("enrichment").alias("_a"))
    d = enrichments.where((F.col("feature") == "dicodon") & (F.col("offset") == offset)).select(
        "sample", F.substring("label", 1, 3).alias("p_codon"), F.substring("label", 4, 3).alias("a_codon"), F.col("enrichment").alias("actual"), "occurrences"
    )
    return d.join(p, ["sample", "p_codon"]).join(a, ["sample", "a_codon"]).select(
        "sample", "p_codon", "a_codon", (F.col("_p") * F.col("_a")).alias("expected"), "actual", "occurrences"
    )


def outliers(effects: DataFrame, min_difference: float, log: bool = True) -> DataFrame:
    """Effects whose (log2) actual value differs from the expected one by more than the threshold."""
    scale = (lambda c: F.log2(F.when(F.col(c) > 0, F.col(c)))) if log else F.col
    return effects.where(F.abs(scale("expected") - scale("actual")) > min_difference)


# ---- stratified mean enrichments -----------------------------------------------------------------


def density_breakpoints(codons: DataFrame, edges: Sequence[tuple[int, int]], min_means: Sequence[float], count: str = "relaxed") -> DataFrame:
    """(sample, gene, excl_start, excl_end, min_mean, mean) of the genes above each threshold.

    The mean runs over codons 2 + excl_start to excl_end before the stop codon; genes too short for it have mean -1.
    """
    cds = cds_codons(codons, count)
    spark = codons.sparkSession
    params = spark.createDataFrame([(a, b) for a, b in edges], "excl_start int, excl_end int")
    thresholds = spark.createDataFrame([(float(m),) for m in min_means], "min_mean double")
    inside = (F.col("i") >= F.col("excl_start")) & (F.col("i") < F.col("length") - F.col("excl_end"))
    wide = cds.groupBy("sample", "gene", "length").agg(
        *[F.avg(F.when((F.col("i") >= a) & (F.col("i") < F.col("length") - b), F.col("n"))).alias(f"m{k}") for k, (a, b) in enumerate(edges)]
    )
    rows = F.array(*[F.struct(F.lit(a).alias("excl_start"), F.lit(b).alias("excl_end"), F.col(f"m{k}").alias("mean")) for k, (a, b) in enumerate(edges)])
    long = wide.select("sample", "gene", "length", F.explode(rows).alias("x")).select("sample", "gene", "length", "x.*")
    mean = F.when(F.col("length") <= F.col("excl_start") + F.col("excl_end"), F.lit(-1.0)).otherwise(F.col("mean"))
    return long.withColumn("mean", mean).crossJoin(F.broadcast(thresholds)).where("mean > min_mean").select(
        "sample", "gene", "excl_start", "excl_end", "min_mean", "mean"
    )


def stratified_enrichments(
    codons: DataFrame, edges: Sequence[tuple[int, int]], min_means: Sequence[float], around: int = 100, count: str = "relaxed",
    dicodons: bool = False, dense: bool = True,
) -> DataFrame:
    """(sample, min_mean, excl_start, excl_end, feature, offset, label, occurrences, enrichment).

    Mean relative count of the positions that have a label at an offset, by codon, nucleotide and optionally dicodon
    (which ends at the offset). Surroundings are summed up once for all conditions on arrays of pieces of genes; nucleotides are
    sums of the codon result. ``dense`` adds the labels that never occur, as 0.
    """
    cds = cds_codons(codons, count)
    conditions = [(float(m), a, b) for a, b in edges for m in min_means]
    means = cds.groupBy("sample", "gene").agg(
        *[F.avg(F.when((F.col("i") >= a) & (F.col("i") < F.col("length") - b), F.col("n"))).alias(f"m{k}") for k, (_, a, b) in enumerate(conditions)]
    )
    ratio = lambda k, m, a, b: F.when(
        (F.col("i") >= a) & (F.col("i") < F.col("length") - b) & (F.col(f"m{k}") > m) & (F.col(f"m{k}") > 0), F.col("n") / F.col(f"m{k}")
    ).alias(f"r{k}")
    sites = cds.join(means, ["sample", "gene"]).select("sample", "gene", "i", "codon", "n", *[ratio(k, *c) for k, c in enumerate(conditions)])
    any_of = F.coalesce(*[F.col(f"r{k}") for k in range(len(conditions))]).isNotNull()
    sites = sites.withColumn("label", F.when(any_of, F.lit("")))
    counted = [F.when(F.col(f"r{k}").isNotNull(), 1.0).alias(f"c{k}") for k in range(len(conditions))]
    sums = surroundings.sums_around(sites.select("*", *counted), [f"{x}{k}" for x in "rc" for k in range(len(conditions))], around, around, pairs=dicodons)
    sums = sums.select(
        "sample", "offset", "codon", *([F.col("codon_before").alias("before")] if dicodons else []),
        *[F.col(f"c{k}").cast("bigint").alias(f"c{k}") for k in range(len(conditions))], *[F.col(f"r{k}").alias(f"s{k}") for k in range(len(conditions))],
    )
    per = F.array(*[
        F.struct(F.lit(m).alias("min_mean"), F.lit(a).alias("excl_start"), F.lit(b).alias("excl_end"), F.col(f"c{k}").alias("c"),
                 F.coalesce(F.col(f"s{k}"), F.lit(0.0)).alias("s")) for k, (m, a, b) in enumerate(conditions)
    ])
    feature = lambda name, offset, label: F.struct(F.lit(name).alias("feature"), offset.cast("int").alias("offset"), label.alias("label"))
    entries = [feature("codon", F.col("offset"), F.col("codon"))] + [
        feature("nucleotide", F.col("offset") * 3 + k, F.substring("codon", k + 1, 1)) for k in range(3)
    ]
    if dicodons:
        entries.append(F.when(F.col("before").isNotNull(), feature("dicodon", F.col("offset"), F.concat("before", "codon"))))
    # From here on rows number offsets times labels, whatever the data's size.
    long = sums.select("sample", F.explode(per).alias("x"), F.array(*entries).alias("e")).select("sample", "x.*", F.explode("e").alias("f")).where(
        "f is not null"
    )
    condition = ["sample", "min_mean", "excl_start", "excl_end"]
    result = long.groupBy(*condition, "f.feature", "f.offset", "f.label").agg(F.sum("c").alias("occurrences"), F.sum("s").alias("total"))
    out = result.select(
        *condition, "feature", "offset", "label", "occurrences", (F.col("total") / F.greatest(F.lit(1), F.col("occurrences"))).alias("enrichment")
    )
    if not dense:
        return out.where("occurrences > 0")
    spark = codons.sparkSession
    grid_codon = dimensions.codon_dimension(spark).select(F.lit("codon").alias("feature"), F.explode(F.sequence(F.lit(-around), F.lit(around))).alias("offset"), F.col("codon").alias("label"))
    grid_base = dimensions.bases(spark).select(
        F.lit("nucleotide").alias("feature"), F.explode(F.sequence(F.lit(-3 * around), F.lit(3 * around + 2))).alias("offset"), F.col("base").alias("label")
    )
    grid = grid_codon.unionByName(grid_base)
    params = spark.createDataFrame(conditions, "min_mean double, excl_start int, excl_end int")
    cells = codons.select("sample").distinct().crossJoin(F.broadcast(params)).crossJoin(F.broadcast(grid))
    full = cells.join(out.where("feature <> 'dicodon'"), [*condition, "feature", "offset", "label"], "left").na.fill(0, ["occurrences"]).na.fill(0.0, ["enrichment"])
    return full.unionByName(out.where("feature = 'dicodon' and occurrences > 0")) if dicodons else full


def relevant_counts(codons: DataFrame, edges: Sequence[tuple[int, int]], min_means: Sequence[float], count: str = "relaxed") -> DataFrame:
    """(sample, excl_start, excl_end, min_mean, n): counts that enter each condition."""
    genes = density_breakpoints(codons, edges, min_means, count)
    cds = cds_codons(codons, count)
    inside = (F.col("i") >= F.col("excl_start")) & (F.col("i") < F.col("length") - F.col("excl_end"))
    return genes.join(cds, ["sample", "gene"]).where(inside).groupBy("sample", "excl_start", "excl_end", "min_mean").agg(F.sum("n").alias("n"))


def enrichment_slice(
    enrichments: DataFrame, feature: str, start: int, stop: int, labels: Sequence[str], condition: tuple[float, int, int] = (0.10, 90, 90), step: int = 1
) -> DataFrame:
    """Enrichments of one condition at offsets start, start + step, ... before stop, for the given labels."""
    m, a, b = condition
    at = F.col("offset").isin(list(range(start, stop, step)))
    return enrichments.where((F.col("min_mean") == float(m)) & (F.col("excl_start") == a) & (F.col("excl_end") == b) & (F.col("feature") == feature)).where(
        at & F.col("label").isin(list(labels))
    )


def survival(scores: DataFrame, keys: Sequence[str] = ("sample", "set"), value: str = "ratio") -> DataFrame:
    """(keys, value, n, above): share of values greater than each distinct value, without sorting a group in one task."""
    counts = stats.value_counts(scores.where(F.col(value).isNotNull()), keys, value)
    totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
    return counts.join(totals, list(keys)).select(*keys, value, "n", (1 - F.col("cum") / F.col("total")).alias("above"))


def floored_log2(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``log2``: values below the group's smallest positive one count as it."""
    smallest = values.groupBy(*keys).agg(F.min(F.when(F.col(value) > 0, F.col(value))).alias("_s"))
    return values.join(smallest, list(keys)).withColumn("log2", F.log2(F.greatest(F.col("_s"), F.col(value)))).drop("_s")


def fixed_floor_log2(value: Column, floor: float = 2.0**-8) -> Column:
    return F.log2(F.greatest(F.lit(floor), value))
