"""Distributed order statistics, running sums and halos that never put a whole hot group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

CHUNK = 4096


def running_sum(
    df: DataFrame, keys: Sequence[str], order: str, sums: dict[str, str], chunk: Column | None = None
) -> DataFrame:
    """Running sums of ``sums`` (new column -> value column) along ``order`` within ``keys``, current row included.

    Rows are windowed per chunk of the order column; the chunk totals, one row per chunk, carry the offsets.
    ``(keys, order)`` must be unique: callers aggregate to it first, so a chunk is never longer than its width.
    """
    chunk = F.floor(F.col(order) / CHUNK) if chunk is None else chunk
    parts = df.withColumn("_chunk", chunk)
    totals = parts.groupBy(*keys, "_chunk").agg(*[F.sum(v).alias(f"_t_{k}") for k, v in sums.items()])
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys, "_chunk", *[F.coalesce(F.sum(f"_t_{k}").over(before), F.lit(0)).alias(f"_o_{k}") for k in sums]
    )
    inside = Window.partitionBy(*keys, "_chunk").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.select("*", *[F.sum(v).over(inside).alias(f"_l_{k}") for k, v in sums.items()])
    joined = local.join(offsets, [*keys, "_chunk"])
    for k in sums:
        joined = joined.withColumn(k, F.col(f"_l_{k}") + F.col(f"_o_{k}"))
    return joined.drop("_chunk", *[f"_l_{k}" for k in sums], *[f"_o_{k}" for k in sums])


# Chunks of a key's values (a power of two), and parts in which its rows meet the bounds of the chunks.
VALUE_CHUNKS = 256
SALTS = 16


def _cuts_below(value: Column, cuts: Column) -> Column:
    """How many of the ascending ``cuts`` (fewer than VALUE_CHUNKS) are below the value, by bisection."""
    halves = F.array(*[F.lit(1 << i) for i in reversed(range(VALUE_CHUNKS.bit_length() - 1))])
    below = lambda at, half: F.coalesce(F.get(cuts, at + half - 1) < value, F.lit(False))
    return F.aggregate(halves, F.lit(0), lambda at, half: F.when(below(at, half), at + half).otherwise(at))


def value_chunks(counts: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Adds ``_part``, the place of the value among approximate quantiles of its key's distinct values, so that parts are of like
    size wherever the values lie. The quantiles are for balance only; any cuts give the same sums."""
    steps = [i / VALUE_CHUNKS for i in range(1, VALUE_CHUNKS)]
    cuts = counts.groupBy(*keys).agg(F.percentile_approx(value, steps).alias("_cuts"))
    salted = counts.withColumn("_salt", F.pmod(F.xxhash64(value), F.lit(SALTS)).cast("int"))
    copies = cuts.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, [*keys, "_salt"]).withColumn("_part", _cuts_below(F.col(value), F.col("_cuts"))).drop("_salt", "_cuts")


def value_counts(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Distinct values with their number and, as ``cum``, the number of rows not larger. Nulls do not count."""
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    return running_sum(value_chunks(counts, keys, value), keys, value, {"cum": "n"}, F.col("_part")).drop("_part")


def order_statistics(counts: DataFrame, keys: Sequence[str], value: str, ranks: DataFrame, rank: str) -> DataFrame:
    """The value at each 1-based rank of ``ranks`` (keys + rank), from ``value_counts``; ranks must lie in 1..count."""
    spans = counts.select(
        *keys, F.col(value).alias("x"), (F.col("cum") - F.col("n")).alias("_lo"), F.col("cum").alias("_hi")
    )
    # Wanted ranks are few (a handful per key); each meets the value whose rank span holds it.
    wanted = ranks.select(*keys, rank).distinct()
    if not keys:
        wanted = F.broadcast(wanted)
    on = (F.col(f"w.{rank}") > F.col("s._lo")) & (F.col(f"w.{rank}") <= F.col("s._hi"))
    for k in keys:
        on = on & F.col(f"s.{k}").eqNullSafe(F.col(f"w.{k}"))
    return (
        spans.alias("s")
        .join(wanted.alias("w"), on)
        .select(*[F.col(f"w.{k}") for k in keys], F.col(f"w.{rank}"), F.col("s.x"))
    )


def mquantiles(df: DataFrame, keys: Sequence[str], value: str, probs: DataFrame) -> DataFrame:
    """Quantiles with plotting positions alpha = beta = 0.4, one row per key and row of ``probs`` (q, p)."""
    counts = value_counts(df, keys, value)
    n = counts.groupBy(*keys).agg(F.sum("n").alias("n")).where("n > 0").crossJoin(F.broadcast(probs))
    a = F.col("n") * F.col("p") + 0.4 + 0.2 * F.col("p")
    k = F.floor(F.greatest(F.lit(1.0), F.least(a, F.col("n") - 1.0)))
    at = n.select(
        *keys, "q", "p", "n", F.greatest(k, F.lit(1)).cast("bigint").alias("k"),
        F.greatest(F.lit(0.0), F.least(a - k, F.lit(1.0))).alias("gamma"),
    )
    ranks = at.select(
        *keys, "q", "n", "k", "gamma",
        F.explode(F.array_distinct(F.array("k", F.least(F.col("k") + 1, F.col("n"))))).alias("rank"),
    )
    found = order_statistics(counts, keys, value, ranks, "rank")
    joined = ranks.join(found, [*keys, "rank"])
    return joined.groupBy(*keys, "q").agg(
        F.sum(
            F.when(F.col("rank") > F.col("k"), F.col("x") * F.col("gamma"))
            .when(F.col("k") == F.col("n"), F.col("x"))
            .otherwise(F.col("x") * (1 - F.col("gamma")))
        ).alias("quantile")
    )


def halo(df: DataFrame, pos: str, before: int, after: int, width: int | None = None) -> DataFrame:
    """Copies rows into every chunk whose core they can reach.

    Adds ``_chunk`` and ``_core``: windows partitioned by the keys and ``_chunk`` see ``before`` rows to the left and
    ``after`` rows to the right of every core row, and only core rows are kept by the caller.
    """
    width = width or max(512, 4 * (before + after))
    own = F.floor(F.col(pos) / width)
    lowest = F.floor((F.col(pos) - after) / width)
    highest = F.floor((F.col(pos) + before) / width)
    spread = df.withColumn("_chunk", F.explode(F.sequence(lowest, highest)))
    return spread.withColumn("_core", F.col("_chunk") == own)


def average_rank(value: str, *keys: str) -> Column:
    """Average rank of ties, 1-based, for label groups of fixed small size such as the codons."""
    part = Window.partitionBy(*keys)
    low = F.rank().over(part.orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return low + (ties - 1) / 2.0


def spearman(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """Rank correlation of small label groups. Values are compared to nine digits, so that the order in which a sum was
    formed cannot break a tie."""
    exact = df.withColumn("_x", F.round(x, 9)).withColumn("_y", F.round(y, 9))
    ranked = exact.withColumn("_rx", average_rank("_x", *keys)).withColumn("_ry", average_rank("_y", *keys))
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("rho"), F.count(F.lit(1)).alias("n"))


def t_statistic(r: Column, n: Column) -> Column:
    """t of a correlation with n - 2 degrees of freedom; null where it is perfect."""
    return r * F.sqrt(F.try_divide((n - 2).cast("double"), 1 - r * r))


def first_of_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], flag: str, salts: int = 16) -> DataFrame:
    """Adds ``flag``: true on exactly one row per key, the first by ``order``.

    Ranked within salted parts of a key first, so that only one row per part meets in the last window.
    """
    plain = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("string", "int", "bigint", "double", "boolean")]
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*plain), F.lit(salts)))
    local = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*keys, "_salt").orderBy(*order)))
    firsts = local.where("_r = 1").withColumn(flag, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) == 1)
    rest = local.where("_r > 1").withColumn(flag, F.lit(False))
    return firsts.unionByName(rest).drop("_salt", "_r")


def window_join(
    sites: DataFrame, values: DataFrame, keys: Sequence[str], site_pos: str, value_pos: str, before: int, after: int
) -> DataFrame:
    """Pairs of a site and a value of the same keys with ``value_pos - site_pos`` in ``-before .. after``, as ``offset``.

    An equi-join on keys and position chunk: values are copied into the one or two chunks whose sites can reach them, so
    a long gene is spread over its chunks and no pair outside the window leaves the join.
    """
    width = before + after + 1
    left = sites.withColumn("_chunk", F.floor(F.col(site_pos) / width))
    lowest = F.floor((F.col(value_pos) - after) / width)
    highest = F.floor((F.col(value_pos) + before) / width)
    right = values.withColumn("_chunk", F.explode(F.sequence(lowest, highest)))
    offset = F.col(value_pos) - F.col(site_pos)
    return left.join(right, [*keys, "_chunk"]).withColumn("offset", offset.cast("int")).where(F.col("offset").between(-before, after)).drop("_chunk")
