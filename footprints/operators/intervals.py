"""Interval joins, nearest neighbours and depth along a sequence.

Intervals are inclusive ``[start, end]`` unless a name says otherwise. Joins are equi-joins on a position bin and, where a
bin holds more than its share of the rows, on a part of it; Catalyst and AQE choose the kind of join from real sizes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from footprints.session import cut_lineage, not_collected

BIN = 2048


def _bins(start: Column, end: Column, width: int) -> Column:
    return F.explode(F.sequence(F.floor(start / width), F.floor(end / width)))


# Rows of a bin beyond 1 / (SHARES * shuffle partitions) of all rows are dealt out to several parts.
SHARES = 2


def _dealt(left: DataFrame, right: DataFrame, keys: list[str], crowd: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Both sides with ``_part``: left rows of a crowded bin are dealt out by their hash, and right rows copied into its parts.

    A locus may be a single base, so finer bins would not split it. Fewer than SHARES * shuffle partitions bins can be crowded,
    which bounds what is broadcast. Rows equal in all columns go together: collapse them first where there are many.
    The sizes of bins, counted in ``crowd`` or in the left rows, are written first: they are needed twice, and the plans of
    what lies behind them differ by the filters pushed down, so that shuffles would not be shared.
    """
    tasks = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sizes = cut_lineage((left if crowd is None else crowd).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
    fair = sizes.agg(F.ceil(F.sum("_n") / (SHARES * tasks)).alias("_fair"))
    crowded = sizes.crossJoin(F.broadcast(fair)).where("_n > _fair").select(*keys, F.ceil(F.col("_n") / F.col("_fair")).cast("int").alias("_parts"))
    crowded = F.broadcast(crowded)
    hashed = F.xxhash64(*[F.col(f.name) for f in left.schema.fields if "map<" not in f.dataType.simpleString()])
    parts = F.coalesce("_parts", F.lit(1))
    l = left.join(crowded, keys, "left").withColumn("_part", F.pmod(hashed, parts).cast("int")).drop("_parts")
    r = right.join(crowded, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return l, r


def overlap_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], left_span: tuple[str, str], right_span: tuple[str, str], width: int = BIN,
    crowd: DataFrame | None = None,
) -> DataFrame:
    """All pairs whose spans share a position; column names of the sides must differ except ``on``.

    Both sides are copied into the bins they touch and a pair is emitted only in the bin of the larger start, so no
    ``distinct`` is needed. The left side's crowded bins are split; the right side should be the one with fewer rows a place.
    ``crowd``, the rows that a costly left side was made from (the same columns ``on`` and span), tells the crowded bins cheaply.
    """
    (ls, le), (rs, re) = left_span, right_span
    keys = [*on, "_bin"]
    binned = lambda df: df.withColumn("_bin", _bins(F.col(ls), F.col(le), width))
    l, r = _dealt(binned(left), right.withColumn("_bin", _bins(F.col(rs), F.col(re), width)), keys, None if crowd is None else binned(crowd))
    hit = (
        (F.col(ls) <= F.col(re))
        & (F.col(rs) <= F.col(le))
        & (F.col("_bin") == F.floor(F.greatest(F.col(ls), F.col(rs)) / width))
    )
    return l.join(r, [*keys, "_part"]).where(hit).drop("_bin", "_part")


def point_join(
    points: DataFrame, intervals: DataFrame, on: Sequence[str], point: str, span: tuple[str, str], width: int = BIN, crowd: DataFrame | None = None
) -> DataFrame:
    """Pairs of a point and an interval that contains it; only the intervals are copied, and crowded bins of points are split.
    ``crowd`` as in ``overlap_join``."""
    keys = [*on, "_bin"]
    binned = lambda df: df.withColumn("_bin", F.floor(F.col(point) / width))
    p, i = _dealt(binned(points), intervals.withColumn("_bin", _bins(F.col(span[0]), F.col(span[1]), width)), keys, None if crowd is None else binned(crowd))
    return p.join(i, [*keys, "_part"]).where(F.col(point).between(F.col(span[0]), F.col(span[1]))).drop("_bin", "_part")


def _strand_classes(strand: Column) -> Column:
    return F.when(strand == ".", F.array(F.lit("+"), F.lit("-"), F.lit("."))).otherwise(F.array(strand))


def _reach(queries: DataFrame, points: DataFrame, on: str, q: str, p: str, before: bool, width: int) -> DataFrame:
    """Per distinct query the largest point < q (or the smallest > q) of a strand class.

    Points and queries are first made distinct. Windows run per position chunk; what lies outside the chunk comes from
    one row per chunk, so a sequence that holds most of the features is still split.
    """
    sign = 1 if before else -1
    pts = points.select(on, "cls", (F.col(p) * sign).alias("x")).distinct().withColumn("_c", F.floor(F.col("x") / width))
    qs = queries.select(on, "cls", (F.col(q) * sign).alias("x")).distinct().withColumn("_c", F.floor(F.col("x") / width))
    both = pts.withColumn("pt", F.col("x")).unionByName(qs.withColumn("pt", F.lit(None).cast("bigint")))
    inside = Window.partitionBy(on, "cls", "_c").orderBy("x").rangeBetween(Window.unboundedPreceding, -1)
    local = both.withColumn("near", F.max("pt").over(inside)).where("pt is null")
    tops = pts.groupBy(on, "cls", "_c").agg(F.max("x").alias("top"))
    marks = tops.unionByName(qs.select(on, "cls", "_c", F.lit(None).cast("bigint").alias("top")).distinct())
    per_chunk = marks.groupBy(on, "cls", "_c").agg(F.max("top").alias("top"))
    earlier = Window.partitionBy(on, "cls").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = per_chunk.withColumn("carried", F.max("top").over(earlier)).drop("top")
    near = local.join(not_collected(carried), [on, "cls", "_c"])
    return near.select(
        on, "cls", (F.col("x") * sign).alias(q), (F.coalesce("near", "carried") * sign).alias("near")
    )


def nearest(
    queries: DataFrame, features: DataFrame, lengths: DataFrame, seqname: str = "seqname", width: int = 1 << 16
) -> DataFrame:
    """Adds ``closest_left`` (largest end before ``start``) and ``closest_right`` (smallest start after ``end``).

    A feature counts if its strand is the query's or ``.``. Without one the sequence edges -1 and length are given.
    """
    pts = features.select(
        seqname, F.explode(_strand_classes(F.col("strand"))).alias("cls"), F.col("start").cast("bigint"), F.col("end").cast("bigint")
    )
    q = queries.withColumn("cls", F.col("strand")).withColumn("start", F.col("start").cast("bigint")).withColumn("end", F.col("end").cast("bigint"))
    left = _reach(q, pts, seqname, "start", "end", True, width).withColumnRenamed("near", "closest_left")
    right = _reach(q, pts, seqname, "end", "start", False, width).withColumnRenamed("near", "closest_right")
    return (
        q.join(not_collected(left), [seqname, "cls", "start"], "left")
        .join(not_collected(right), [seqname, "cls", "end"], "left")
        .join(lengths, seqname, "left")
        .withColumn("closest_left", F.coalesce("closest_left", F.lit(-1).cast("bigint")))
        .withColumn("closest_right", F.coalesce("closest_right", F.col("length")))
        .select(*queries.columns, "closest_left", "closest_right")
    )


def stacked_runs(
    spans: DataFrame, keys: Sequence[str], start: str, end: str, weights: dict[str, str], width: int = 1 << 14
) -> DataFrame:
    """Half-open runs on which the same half-open spans lie: keys, start, end, layers and the sum of each weight.

    Spans are cut at chunk borders and reduced to two weighted edge events each before the shuffle; a chunk's window
    holds at most its distinct positions. Sums over a run of no span are not given.
    """
    first, last = F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width)
    cut = spans.where(F.col(end) > F.col(start)).withColumn("_c", F.explode(F.sequence(first, last)))
    s = F.greatest(F.col(start), F.col("_c") * width)
    e = F.least(F.col(end), (F.col("_c") + 1) * width)
    edge = lambda at, sign: F.struct(at.alias("at"), F.lit(sign).alias("layers"), *[(F.col(v) * sign).alias(k) for k, v in weights.items()])
    names = ["layers", *weights]
    edges = (
        cut.select(*keys, "_c", F.explode(F.array(edge(s, 1), edge(e, -1))).alias("x"))
        .groupBy(*keys, "_c", F.col("x.at").alias("at"))
        .agg(*[F.sum(f"x.{n}").alias(n) for n in names])
    )
    w = Window.partitionBy(*keys, "_c").orderBy("at")
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = edges.select(
        *keys, F.col("at").alias("start"), F.lead("at").over(w).alias("end"), *[F.sum(n).over(running).alias(n) for n in names]
    )
    return runs.where("layers > 0 and end is not null")


def depth_runs(blocks: DataFrame, keys: Sequence[str], start: str, end: str, weight: str, width: int = 1 << 14) -> DataFrame:
    """Half-open runs of constant depth > 0 of half-open weighted blocks: keys, start, end, depth."""
    return stacked_runs(blocks, keys, start, end, {"depth": weight}, width).drop("layers")


def per_base(runs: DataFrame, keys: Sequence[str], value: str = "depth") -> DataFrame:
    return runs.select(*keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos"), F.col(value).alias("n"))
