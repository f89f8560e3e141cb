"""Comparisons of enrichments and expression between samples.

Enrichment tables here hold one condition and one feature: (sample, offset, label, enrichment), at most offsets x labels rows
per sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from footprints.functions import stats
from footprints.operators import windows


def _weights(enrichments: DataFrame, slices: Sequence[range]) -> DataFrame:
    times = Counter(o for s in slices for o in s)
    return enrichments.sparkSession.createDataFrame(sorted(times.items()), "offset int, times int")


def areas(enrichments: DataFrame, slices: Sequence[range], reference: str | None = None) -> DataFrame:
    """(sample, label, area): sum of enrichment - 1 over the offsets of the slices, less the reference sample's area."""
    used = enrichments.join(F.broadcast(_weights(enrichments, slices)), "offset")
    sums = used.groupBy("sample", "label").agg(F.sum((F.col("enrichment") - 1) * F.col("times")).alias("area"))
    if reference is None:
        return sums
    base = sums.where(F.col("sample") == reference).select("label", F.col("area").alias("_base"))
    return sums.join(base, "label").select("sample", "label", (F.col("area") - F.col("_base")).alias("area"))


def area_changes(
    enrichments: DataFrame, untreated: str, treated: str, active: range, wave: range, area_between: bool = True, change: bool = True, flip_wave: bool = False
) -> DataFrame:
    """(label, change, wave): change of the active sites against the area of the wave.

    Without ``change`` the untreated sample's area below 1 is taken; without ``area_between`` the treated wave above 1.
    ``flip_wave`` mirrors the wave's offsets.
    """
    mirrored = range(-wave.start, -wave.stop, -wave.step) if flip_wave else wave
    a, w = areas(enrichments, [active]), areas(enrichments, [mirrored])
    of = lambda df, sample, name: df.where(F.col("sample") == sample).select("label", F.col("area").alias(name))
    joined = of(a, untreated, "_a0").join(of(a, treated, "_a1"), "label").join(of(w, untreated, "_w0"), "label").join(of(w, treated, "_w1"), "label")
    return joined.select(
        "label", (F.col("_a1") - F.col("_a0") if change else -F.col("_a0")).alias("change"), (F.col("_w1") - F.col("_w0") if area_between else F.col("_w1")).alias("wave")
    )


def fit(points: DataFrame, x: str, y: str) -> DataFrame:
    return points.agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.count(F.lit(1)).alias("n"))


def area_differences(enrichments: DataFrame, first: str, second: str, slices: Sequence[range]) -> DataFrame:
    """(label, difference) of the second sample's area over the first's."""
    a = areas(enrichments, slices)
    of = lambda sample, name: a.where(F.col("sample") == sample).select("label", F.col("area").alias(name))
    return of(first, "_a").join(of(second, "_b"), "label").select("label", (F.col("_b") - F.col("_a")).alias("difference"))


def difference_histogram(differences: DataFrame, lo: float = -1.5, hi: float = 1.5, bins: int = 60) -> DataFrame:
    """(bin, n): equal bins between the limits, which are widened by 0.1 beyond a value outside; the last bin is closed."""
    ends = differences.agg(F.min("difference").alias("_lo"), F.max("difference").alias("_hi")).select(
        F.when(F.col("_lo") < lo, F.col("_lo") - 0.1).otherwise(F.lit(lo)).alias("_lo"), F.when(F.col("_hi") > hi, F.col("_hi") + 0.1).otherwise(F.lit(hi)).alias("_hi")
    )
    at = F.floor((F.col("difference") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * bins)
    return differences.crossJoin(F.broadcast(ends)).groupBy(F.least(at, F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def extreme_labels(differences: DataFrame) -> DataFrame:
    """The labels with the largest gain and loss."""
    return differences.agg(
        F.max_by("label", F.struct("difference", "label")).alias("gain"), F.max("difference").alias("gain_by"),
        F.min_by("label", F.struct("difference", "label")).alias("loss"), F.min("difference").alias("loss_by"),
    )


def rank_correlations(enrichments: DataFrame, weights: DataFrame, offset: int = 0) -> DataFrame:
    """(sample, rho, n): Spearman correlation of the enrichments at an offset with the decoding weights."""
    at = enrichments.where(F.col("offset") == offset).join(F.broadcast(weights.select(F.col("codon").alias("label"), "weight")), "label")
    return stats.spearman(at, ["sample"], "enrichment", "weight")


def rank_correlations_by_offset(enrichments: DataFrame, weights: DataFrame, window: int, lo: int, hi: int) -> DataFrame:
    """(sample, offset, rho, n) of the smoothed enrichments at offsets lo to hi."""
    near = enrichments.where(F.col("offset").between(lo, hi))
    waves = windows.smooth(near, ["sample", "label"], "offset", "enrichment", window)
    joined = waves.join(F.broadcast(weights.select(F.col("codon").alias("label"), "weight")), "label")
    return stats.spearman(joined, ["sample", "offset"], "smoothed", "weight")


def best_offset(correlations: DataFrame, value: str = "rho", keys: Sequence[str] = ("sample",)) -> DataFrame:
    """(keys, offset, value) at the largest correlation, the first of equals."""
    return correlations.groupBy(*keys).agg(F.max_by("offset", F.struct(F.col(value), -F.col("offset"))).alias("offset"), F.max(value).alias(value))


def change_correlations(enrichments: DataFrame, untreated: str, window: int, lo: int, hi: int, squared: bool = False) -> DataFrame:
    """(sample, sites, offset, r): Pearson correlation between a treated sample's smoothed wave at each offset and its loss at
    the active sites (A; A + P; A + P + E)."""
    sites = [("A", [0]), ("A+P", [0, -1]), ("A+P+E", [0, -1, -2])]
    near = enrichments.where((F.col("sample") != untreated) & (F.col("offset") >= lo) & (F.col("offset") < hi))
    waves = windows.smooth(near, ["sample", "label"], "offset", "enrichment", window)
    active = enrichments.where(F.col("offset").between(-2, 0)).groupBy("sample", "label").agg(
        *[F.sum(F.when(F.col("offset").isin(o), F.col("enrichment"))).alias(n) for n, o in sites]
    )
    base = active.where(F.col("sample") == untreated).select("label", *[F.col(f"`{n}`").alias(f"_{k}") for k, (n, _) in enumerate(sites)])
    rows = F.array(*[F.struct(F.lit(n).alias("sites"), (F.col(f"_{k}") - F.col(f"`{n}`")).alias("loss")) for k, (n, _) in enumerate(sites)])
    losses = active.where(F.col("sample") != untreated).join(base, "label").select("sample", "label", F.explode(rows).alias("x")).select("sample", "label", "x.*")
    r = F.corr("smoothed", "loss")
    return waves.join(losses, ["sample", "label"]).groupBy("sample", "sites", "offset").agg((r * r if squared else r).alias("r"))


def correlation_matrix(enrichments: DataFrame, offset: int = 0) -> DataFrame:
    """(first, second, r): Pearson correlations of all samples at an offset."""
    at = enrichments.where(F.col("offset") == offset)
    a = at.select(F.col("sample").alias("first"), "label", F.col("enrichment").alias("x"))
    b = at.select(F.col("sample").alias("second"), "label", F.col("enrichment").alias("y"))
    return a.join(b, "label").groupBy("first", "second").agg(F.corr("x", "y").alias("r"))


def weight_recovery(enrichments: DataFrame, weights: DataFrame, wave: range, big_wave: range) -> DataFrame:
    """(sample, measure, rho, n): Spearman with the weights of the active sites alone and with each wave's area added."""
    active = range(-2, 1)
    parts = [("active", [active]), ("active+wave", [active, wave]), ("active+big_wave", [active, big_wave])]
    out = None
    for name, slices in parts:
        summed = areas(enrichments, slices).join(F.broadcast(weights.select(F.col("codon").alias("label"), "weight")), "label")
        rho = stats.spearman(summed, ["sample"], "area", "weight").withColumn("measure", F.lit(name))
        out = rho if out is None else out.unionByName(rho)
    return out


def area_scan(enrichments: DataFrame, weights: DataFrame, first_stop: int = -8, last_stop: int = -99) -> DataFrame:
    """(sample, side, stop, rho, n): Spearman with the weights of active sites plus the area from -6 down to each stop
    (exclusive), and from 7 up to its mirror image."""
    active = areas(enrichments, [range(-2, 1)]).withColumnRenamed("area", "_active")
    along = Window.partitionBy("sample", "label").rowsBetween(Window.unboundedPreceding, 0)
    down = enrichments.where((F.col("offset") <= -6) & (F.col("offset") > last_stop)).select(
        "sample", "label", (F.col("offset") - 1).alias("stop"), F.sum(F.col("enrichment") - 1).over(along.orderBy(F.desc("offset"))).alias("area"), F.lit("downstream").alias("side")
    )
    up = enrichments.where((F.col("offset") >= 7) & (F.col("offset") < -last_stop)).select(
        "sample", "label", (-F.col("offset") - 1).alias("stop"), F.sum(F.col("enrichment") - 1).over(along.orderBy("offset")).alias("area"), F.lit("upstream").alias("side")
    )
    both = down.unionByName(up).where((F.col("stop") <= first_stop) & (F.col("stop") >= last_stop))
    joined = both.join(active, ["sample", "label"]).join(F.broadcast(weights.select(F.col("codon").alias("label"), "weight")), "label")
    return stats.spearman(joined.withColumn("total", F.col("area") + F.col("_active")), ["sample", "side", "stop"], "total", "weight")


def wobble_groups(codon_dim: DataFrame) -> DataFrame:
    """(third_base, first_base, codon): codons by the RNA pair of third codon base and first anticodon base."""
    rna = lambda c: F.translate(c, "T", "U")
    return codon_dim.where("anticodon is not null").select(
        rna(F.substring("codon", 3, 1)).alias("third_base"), rna(F.substring("anticodon", 1, 1)).alias("first_base"), "codon"
    )


def wobble_tracks(enrichments: DataFrame, codon_dim: DataFrame, offset: int = 0) -> DataFrame:
    """(third_base, first_base, codon, sample, enrichment) at an offset."""
    groups = wobble_groups(codon_dim).withColumnRenamed("codon", "label")
    return enrichments.where(F.col("offset") == offset).join(F.broadcast(groups), "label").select(
        "third_base", "first_base", F.col("label").alias("codon"), "sample", "enrichment"
    )


# ---- expression ----------------------------------------------------------------------------------


def translational_efficiency(footprint: DataFrame, mrna: DataFrame, floor: float = 0.1) -> DataFrame:
    """(gene, te): ratio of the two RPKMs (gene, cds_length, n), each at least ``floor``."""

    def rpkm(counts: DataFrame, name: str) -> DataFrame:
        total = counts.agg(F.sum("n").alias("_t"))
        return counts.crossJoin(F.broadcast(total)).select("gene", F.greatest(F.lit(floor), F.lit(1e9) / F.col("_t") * F.col("n") / F.col("cds_length")).alias(name))

    return rpkm(footprint, "_f").join(rpkm(mrna, "_m"), "gene").select("gene", (F.col("_f") / F.col("_m")).alias("te"))


def log_te(counts: DataFrame, pairs: DataFrame, min_count: int = 10, floor: float = 0.1) -> DataFrame:
    """(name, gene, log_te): log2 of depth-normalised footprint over mRNA counts, for genes above ``min_count`` everywhere.

    ``counts``: sample, gene, n. ``pairs``: name, footprint, mrna (sample names). Counts of 0 count as ``floor``.
    """
    floored = counts.select("sample", "gene", F.greatest(F.col("n").cast("double"), F.lit(floor)).alias("v"))
    total = floored.groupBy("sample").agg(F.sum("v").alias("t"))
    share = floored.join(total, "sample").select("sample", "gene", "v", F.log2(F.col("v") / F.col("t")).alias("log"))
    wanted = pairs.select(F.explode(F.array("footprint", "mrna")).alias("sample")).distinct()
    enough = share.join(wanted, "sample").groupBy("gene").agg(F.min("v").alias("m")).where(F.col("m") > min_count).select("gene")
    kept = share.join(enough, "gene", "left_semi")
    f = kept.select(F.col("sample").alias("footprint"), "gene", F.col("log").alias("_f"))
    m = kept.select(F.col("sample").alias("mrna"), "gene", F.col("log").alias("_m"))
    return pairs.join(f, "footprint").join(m, ["mrna", "gene"]).select("name", "gene", (F.col("_f") - F.col("_m")).alias("log_te"))


def centred(values: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    means = values.groupBy(*keys).agg(F.avg(value).alias("_m"))
    return values.join(means, list(keys)).withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def histogram(values: DataFrame, keys: Sequence[str], value: str, lo: float, hi: float, bins: int = 100) -> DataFrame:
    """(keys, bin, n) of the values within the limits; the last bin is closed."""
    inside = values.where(F.col(value).between(lo, hi))
    at = F.least(F.floor((F.col(value) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("int")
    return inside.groupBy(*keys, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def _correlation(x: str, y: str):
    """Pearson's coefficient of two columns without nulls; NaN where one of them does not vary, as in one row, which corr takes for null or an error."""
    return F.coalesce(F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y))), F.lit(float("nan")))


def pairwise(values: DataFrame, sample: str, key: str, value: str) -> DataFrame:
    """(first, second, pearson, spearman, n) for every pair of samples, each pair once, a sample with itself included.

    Average ranks come from distinct values and their cumulative numbers, not from one sorted task per sample.
    """
    plain = values.select(key, F.col(sample).alias("_s"), F.col(value).alias("_v"))
    counted = stats.value_counts(plain, ["_s"], "_v").select("_s", "_v", (F.col("cum") - (F.col("n") - 1) / 2.0).alias("_rank"))
    ranked = plain.join(counted, ["_s", "_v"])
    a = ranked.select(key, F.col("_s").alias("first"), F.col("_v").alias("x"), F.col("_rank").alias("rx"))
    b = ranked.select(key, F.col("_s").alias("second"), F.col("_v").alias("y"), F.col("_rank").alias("ry"))
    return a.join(b, key).where("first <= second").groupBy("first", "second").agg(
        _correlation("x", "y").alias("pearson"), _correlation("rx", "ry").alias("spearman"), F.count(F.lit(1)).alias("n")
    )
