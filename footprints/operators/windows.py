"""Moving averages, running densities and top positions along dense positions.

Frames of fixed width run over position chunks with a halo and running sums are carried from chunk to chunk, so a key that
holds a third of all rows is still spread over many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from footprints.functions import stats


def _framed(df: DataFrame, keys: Sequence[str], pos: str, before: int, after: int, columns: dict) -> DataFrame:
    part = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    spread = stats.halo(df, pos, before, after)
    framed = spread.select("*", *[make(part).alias(name) for name, make in columns.items()])
    return framed.where("_core").drop("_chunk", "_core")


def smooth(df: DataFrame, keys: Sequence[str], pos: str, value: str, window: int) -> DataFrame:
    """Adds ``smoothed``: the centred mean of 2 * window + 1 values; values nearer to the edges stay as they are."""
    frame = lambda part: part.rangeBetween(-window, window)
    out = _framed(df, keys, pos, window, window, {
        "_a": lambda part: F.avg(value).over(frame(part)), "_c": lambda part: F.count(F.lit(1)).over(frame(part)),
    })
    return out.withColumn("smoothed", F.when(F.col("_c") == 2 * window + 1, F.col("_a")).otherwise(F.col(value).cast("double"))).drop("_a", "_c")


def smooth_outside(df: DataFrame, keys: Sequence[str], pos: str, value: str, window: int, inner: int = 10) -> DataFrame:
    """As ``smooth``, but values at \\|pos\\| < inner stay as they are."""
    out = smooth(df, keys, pos, value, window)
    return out.withColumn("smoothed", F.when(F.abs(pos) < inner, F.col(value).cast("double")).otherwise(F.col("smoothed")))


def smooth_edges(df: DataFrame, keys: Sequence[str], pos: str, value: str, window: int, lengths: DataFrame) -> DataFrame:
    """Adds ``smoothed``: the centred mean; at the first ``window`` positions the mean of all up to there, at the last ones of
    all from there. Positions run from 0 to ``length`` - 1 of ``lengths`` (keys, length)."""
    out = _framed(df, keys, pos, window, window, {
        "_m": lambda part: F.avg(value).over(part.rangeBetween(-window, window)),
        "_l": lambda part: F.avg(value).over(part.rangeBetween(-window, 0)),
        "_r": lambda part: F.avg(value).over(part.rangeBetween(0, window)),
    })
    last = F.col(pos) >= F.col("length") - window
    return out.join(lengths, list(keys)).withColumn(
        "smoothed", F.when(last, F.col("_r")).when(F.col(pos) < window, F.col("_l")).otherwise(F.col("_m"))
    ).drop("_m", "_l", "_r", "length")


def running_densities(df: DataFrame, keys: Sequence[str], pos: str, value: str, previous: int = 10) -> DataFrame:
    """Adds ``so_far``, ``remaining`` (mean up to and from the position) and ``over_previous`` (sum of the values just before,
    divided by their number)."""
    summed = stats.running_sum(df.withColumn("_one", F.lit(1)), keys, pos, {"_cs": value, "_cn": "_one"})
    totals = df.groupBy(*keys).agg(F.sum(value).alias("_ts"), F.count(F.lit(1)).alias("_tn"))
    joined = summed.join(totals, list(keys))
    so_far = F.col("_cs") / F.col("_cn")
    remaining = (F.col("_ts") - F.col("_cs") + F.col(value)) / (F.col("_tn") - F.col("_cn") + 1)
    near = _framed(
        joined.withColumn("so_far", so_far).withColumn("remaining", remaining), keys, pos, previous, 0,
        {"_p": lambda part: F.sum(value).over(part.rangeBetween(-previous, -1))},
    )
    return near.withColumn("over_previous", F.coalesce("_p", F.lit(0)) / float(previous)).drop("_one", "_cs", "_cn", "_ts", "_tn", "_p")


def argmax(df: DataFrame, keys: Sequence[str], pos: str, value: str) -> DataFrame:
    """Position of the largest value per key; the first of equals."""
    return df.groupBy(*keys).agg(F.max_by(pos, F.struct(F.col(value), -F.col(pos))).alias("argmax"), F.max(value).alias("largest"))


def n_largest(df: DataFrame, keys: Sequence[str], pos: str, value: str, n: int) -> DataFrame:
    """The n largest values per key, ranked; equals by position. Spark limits each group before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value), pos)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def ranks(df: DataFrame, keys: Sequence[str], label: str, value: str) -> DataFrame:
    """Adds ``rank`` from 0 by value within small label groups (codons, dicodons); equals by label."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(value, label)) - 1)


def rank_changes(ranked: DataFrame, order: DataFrame, label: str, value: str, floor: float = 2.0**-8) -> DataFrame:
    """(label, rank_change, log_change, raw_change) from the first to the last sample of ``order`` (sample, place)."""
    placed = ranked.join(order, "sample")
    g = placed.groupBy(label).agg(
        F.min_by("rank", "place").alias("_r0"), F.max_by("rank", "place").alias("_r1"),
        F.min_by(value, "place").alias("_v0"), F.max_by(value, "place").alias("_v1"),
    )
    log = lambda c: F.log2(F.greatest(F.lit(floor), F.col(c)))
    return g.select(label, (F.col("_r0") - F.col("_r1")).alias("rank_change"), (log("_v0") - log("_v1")).alias("log_change"), (F.col("_v0") - F.col("_v1")).alias("raw_change"))


def largest_changes(changes: DataFrame, label: str, column: str, n: int, absolute: bool = True) -> DataFrame:
    key = F.abs(column) if absolute else F.col(column)
    return changes.orderBy(F.desc(key), label).limit(n)
