"""Length buckets with the least padding, and batches of a token budget inside each bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from footprints.llm.storage import fresh, prepared, written
from footprints.llm.text import PIECE_BYTES, Words, pieces

BUCKETS = 16
BATCH_TOKENS = 65_536
# About so many documents of one length are numbered in one task.
RUN_ROWS = 100_000


def token_counts(docs: DataFrame, name: str = "n_tokens") -> DataFrame:
    """The documents with the number of words of each text, a null one having none."""
    prepared(docs.sparkSession)
    names = docs.columns
    out = docs.select("*", F.lit(0).cast("bigint").alias(name)).schema

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(Words(piece.column("text")).counts.astype(np.int64))], names=[*names, name])

    return docs.mapInArrow(run, out)


def optimal_bounds(lengths: list[int], counts: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most ``buckets`` buckets, the last being the greatest length, with the least sum of bound - length.

    lengths ascend. best[j], the least padding of the first j lengths with b buckets, is the minimum over i of best'[i] with
    b - 1 buckets + length[j-1] * (C[j] - C[i]) - (T[j] - T[i]), C and T summing counts and tokens: lines in length[j-1] whose
    slopes fall with i, so each layer walks their lower envelope once. Of equal choices the fewest buckets and the smallest i win.
    """
    n = len(lengths)
    if n == 0:
        return []
    c, t = [0], [0]
    for length, count in zip(lengths, counts):
        c.append(c[-1] + count)
        t.append(t[-1] + length * count)
    best = [0] + [lengths[j - 1] * c[j] - t[j] for j in range(1, n + 1)]
    back = [[0] * (n + 1)]
    for b in range(2, min(buckets, n) + 1):
        layer, source = best[:], [-1] * (n + 1)
        hull: list[int] = []
        at = 0
        value = lambda i, x: best[i] + t[i] - x * c[i]
        for j in range(1, n + 1):
            i = j - 1
            if i >= b - 1:
                while len(hull) >= 2:
                    p, q = hull[-2], hull[-1]
                    # q is of no use if line i passes below it no later than q passes below p.
                    if (best[i] + t[i] - best[q] - t[q]) * (c[q] - c[p]) <= (best[q] + t[q] - best[p] - t[p]) * (c[i] - c[q]):
                        hull.pop()
                    else:
                        break
                hull.append(i)
            at = min(at, max(0, len(hull) - 1))
            if not hull:
                continue
            x = lengths[j - 1]
            while at + 1 < len(hull) and value(hull[at + 1], x) < value(hull[at], x):
                at += 1
            made = value(hull[at], x) + x * c[j] - t[j]
            if made < best[j]:
                layer[j], source[j] = made, hull[at]
        back.append(source)
        best = layer
    bounds, j, b = [], n, len(back)
    while j > 0:
        while b > 1 and back[b - 1][j] == -1:
            b -= 1
        bounds.append(lengths[j - 1])
        j = back[b - 1][j] if b > 1 else 0
        b -= 1
    return bounds[::-1]


def packed(docs: DataFrame, n_tokens: str, buckets: int = BUCKETS, batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """The documents with bucket, bound, padding, batch and slot.

    Buckets are numbered from 0 by rising bound; a batch is numbered within its bucket and holds as many documents as fit into
    ``batch_tokens`` at the bucket's bound, one at least. Documents longer than a batch are buckets of their own, one for each
    such length, without padding, and have a batch each. In a bucket documents come by length, then by a hash of doc_id and text
    (or text_hash); repeated rows follow each other. Documents without tokens are bucket -1: batch and slot are null, nothing is padded.
    Any length up to ``batch_tokens`` can occur in the histogram, and no other, so the driver gets that many rows at most.
    Columns of the same names are replaced.
    """
    docs = docs.drop("bucket", "bound", "padding", "batch", "slot")
    n, mix, run, place = (fresh(docs, c) for c in ("_n", "_mix", "_run", "_place"))
    same = [c for c in ("doc_id", "text", "text_hash") if c in docs.columns]
    # Needed three times, and counting tokens is dear.
    known = written(docs.withColumn(n, F.col(n_tokens)).withColumn(mix, F.xxhash64(*same)), "lengths")
    histogram = known.where((F.col(n) > 0) & (F.col(n) <= batch_tokens)).groupBy(n).agg(F.count("*").alias("count")).toPandas().sort_values(n)
    lengths, counts = histogram[n].tolist(), histogram["count"].tolist()
    bounds = optimal_bounds(lengths, counts, buckets)
    which = np.searchsorted(bounds, lengths) if bounds else []
    # Documents of one length are cut into runs by hash, so that a length that a third of all documents share is no single task.
    spark = docs.sparkSession
    plan = spark.createDataFrame(
        pa.table({
            "_len": pa.array(lengths, pa.int64()), "bucket": pa.array(list(map(int, which)), pa.int32()),
            "bound": pa.array([int(bounds[i]) for i in which], pa.int64()), "_runs": pa.array([1 + c // RUN_ROWS for c in counts], pa.int64()),
        })
    )
    # At most batch_tokens rows of four numbers.
    known = known.join(F.broadcast(plan), F.col(n) == F.col("_len"), "left")
    long = F.col(n) > batch_tokens
    known = known.withColumn(run, F.pmod(F.col(mix), F.coalesce("_runs", F.lit(1))))
    inside = known.where("bound is not null").withColumn(place, F.row_number().over(Window.partitionBy("bucket", n, run).orderBy(mix, "doc_id")))
    sizes = known.where("bound is not null").groupBy("bucket", n, run).agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy("bucket").orderBy(n, run).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(F.col("bucket").alias("_b"), F.col(n).alias("_n2"), F.col(run).alias("_r"), before.alias("_start"))
    number = F.col("_start") + F.col(place) - 1
    fits = F.greatest(F.lit(1), F.floor(F.lit(batch_tokens) / F.col("bound"))).cast("bigint")
    own = [F.col(c) for c in docs.columns]
    numbered = inside.join(starts, (F.col("bucket") == F.col("_b")) & (F.col(n) == F.col("_n2")) & (F.col(run) == F.col("_r"))).select(
        *own, "bucket", "bound", (F.col("bound") - F.col(n)).alias("padding"), F.floor(number / fits).alias("batch"), (number % fits).alias("slot")
    )
    rest = known.where("bound is null").select(
        *own,
        F.when(long, len(bounds)).otherwise(-1).cast("int").alias("bucket"),
        F.when(long, F.col(n)).otherwise(0).cast("bigint").alias("bound"),
        F.lit(0).cast("bigint").alias("padding"),
        F.when(long, F.col(mix)).alias("batch"),
        F.when(long, F.lit(0).cast("bigint")).alias("slot"),
    )
    return numbered.unionByName(rest)
