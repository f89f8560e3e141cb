"""Trimming, payloads and classification of reads and read pairs."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from footprints import constants as C
from footprints.functions import sequence as S

Finder = Callable[[Column], Column]


def _at(position: int) -> Finder:
    return lambda seq: F.lit(position)


def _adapter(adapter: str) -> Finder:
    return lambda seq: S.find_adapter(seq, adapter)


# Adapter type -> (start finder, end finder). Add an entry to trim by a new protocol.
FINDERS: dict[str, tuple[Finder, Finder]] = {
    "truseq": (_at(0), _adapter(C.TRUSEQ_R2_RC)),
    "linker": (_at(0), _adapter(C.SMRNA_LINKER)),
    "linker_15": (_at(0), _adapter(C.SMRNA_15_LINKER)),
    "polyA": (_at(0), S.poly_a_start),
    "weinberg": (_at(C.WEINBERG_BARCODE_LENGTH), _adapter(C.BARTEL_LINKER)),
    "nothing": (_at(0), F.length),
    "jeff": (S.anchor_start, _adapter(C.SMRNA_LINKER)),
}


def _cut(reads: DataFrame, prefix: str) -> DataFrame:
    """Cuts ``seq`` and ``qual`` at ``_start`` and ``_end``; an end before the start leaves nothing."""
    start, end = F.col("_start"), F.col("_end")
    return reads.select(
        *[c for c in reads.columns if c not in ("seq", "qual", "_start", "_end")],
        F.substr(F.col("seq"), F.lit(1), start).alias(f"{prefix}left_seq"),
        F.substr(F.col("qual"), F.lit(1), start).alias(f"{prefix}left_qual"),
        F.substr(F.col("seq"), start + 1, F.greatest(end - start, F.lit(0))).alias("seq"),
        F.substr(F.col("qual"), start + 1, F.greatest(end - start, F.lit(0))).alias("qual"),
        F.substr(F.col("seq"), end + 1, F.length("seq")).alias(f"{prefix}right_seq"),
        F.substr(F.col("qual"), end + 1, F.length("seq")).alias(f"{prefix}right_qual"),
    )


def trim(reads: DataFrame, find_start: Finder | None = None, find_end: Finder | None = None, second_time: bool = False) -> DataFrame:
    """Trims reads and keeps what was cut off as payload columns; a second pass uses the ``retrimmed_`` columns."""
    start = find_start(F.col("seq")) if find_start else F.lit(0)
    end = find_end(F.col("seq")) if find_end else F.length("seq")
    named = reads if second_time else reads.withColumn("original_name", F.col("read_id"))
    return _cut(named.withColumn("_start", start.cast("int")).withColumn("_end", end.cast("int")), "retrimmed_" if second_time else "")


def trim_by_type(reads: DataFrame, adapters: DataFrame) -> DataFrame:
    """Trims each read as its sample's ``adapter_type`` says; ``adapters`` is the (sample, adapter_type) dimension."""
    typed = reads.join(adapters.select("sample", "adapter_type"), "sample")
    seq, kind = F.col("seq"), F.col("adapter_type")
    start = end = None
    for name, (find_start, find_end) in FINDERS.items():
        s, e = find_start(seq).cast("int"), find_end(seq).cast("int")
        start = F.when(kind == name, s) if start is None else start.when(kind == name, s)
        end = F.when(kind == name, e) if end is None else end.when(kind == name, e)
    unknown = F.raise_error(F.concat(F.lit("unknown adapter type: "), kind)).cast("int")
    named = typed.withColumn("original_name", F.col("read_id"))
    return _cut(named.withColumn("_start", start.otherwise(unknown)).withColumn("_end", end.otherwise(unknown)), "")


def untrim(reads: DataFrame, second_time: bool = False) -> DataFrame:
    """Puts the payload back around the read."""
    prefix = "retrimmed_" if second_time else ""
    whole = lambda what: F.concat(f"{prefix}left_{what}", what, f"{prefix}right_{what}")
    payload = [f"{prefix}{side}_{what}" for side in ("left", "right") for what in ("seq", "qual")]
    return reads.withColumn("_q", whole("qual")).withColumn("seq", whole("seq")).withColumn("qual", F.col("_q")).drop("_q", *payload)


def length_status(reads: DataFrame, minimum: int = C.MIN_TRIMMED_LENGTH) -> DataFrame:
    """Adds ``length`` and ``category`` (``trimmed`` or ``too_short``); filter on the latter to go on."""
    return reads.withColumn("length", F.length("seq")).withColumn(
        "category", F.when(F.length("seq") < minimum, "too_short").otherwise("trimmed")
    )


def strip_barcodes(pairs: DataFrame, length: int = C.PAIR_BARCODE_LENGTH) -> DataFrame:
    """Drops the fixed-length barcode from both reads of a pair."""
    for column in ("r1_seq", "r1_qual", "r2_seq", "r2_qual"):
        pairs = pairs.withColumn(column, F.substr(F.col(column), F.lit(length + 1), F.length(column)))
    return pairs


def pair_up(first: DataFrame, second: DataFrame) -> DataFrame:
    """Joins R1 and R2 reads on sample and pair name (the read id without its mate suffix). A read without its mate is an error;
    ``unpaired`` lists those."""
    name = F.regexp_replace("read_id", r"[/ ][12].*$", "")
    side = lambda df, r: df.select("sample", name.alias("pair_id"), F.col("seq").alias(f"{r}_seq"), F.col("qual").alias(f"{r}_qual"), F.lit(True).alias(f"_{r}"))
    both = side(first, "r1").join(side(second, "r2"), ["sample", "pair_id"], "full")
    whole = F.col("_r1").isNotNull() & F.col("_r2").isNotNull()
    return both.withColumn("_ok", F.assert_true(whole, F.concat(F.lit("no mate for "), F.col("pair_id"))).isNull()).where("_ok").drop("_ok", "_r1", "_r2")


def unpaired(first: DataFrame, second: DataFrame) -> DataFrame:
    """Reads of either file whose mate is missing."""
    name = F.regexp_replace("read_id", r"[/ ][12].*$", "")
    side = lambda df, r: df.select("sample", name.alias("pair_id"), F.lit(r).alias("mate"))
    a, b = side(first, 1), side(second, 2)
    return a.join(b, ["sample", "pair_id"], "left_anti").unionByName(b.join(a, ["sample", "pair_id"], "left_anti"))


def trim_fill_pairs(pairs: DataFrame, adapter: str, barcode_length: int, max_distance: int = 3) -> DataFrame:
    """Trims pairs where only R1 can run into the adapter; R2 loses its barcode and keeps R1's length.

    Adds ``barcode`` and ``position``; pairs with ``position`` < 12 are too short and left to the caller to drop.
    """
    placed = pairs.withColumn("position", S.find_adapter_within(F.col("r1_seq"), adapter, max_distance))
    position = F.col("position")
    return placed.select(
        "sample", "pair_id", F.substr(F.col("r2_seq"), F.lit(1), F.lit(barcode_length)).alias("barcode"), "position",
        *[F.substr(F.col(c), F.lit(1), position).alias(c) for c in ("r1_seq", "r1_qual")],
        *[F.substr(F.col(c), F.lit(barcode_length + 1), position).alias(c) for c in ("r2_seq", "r2_qual")],
    )


def consistent_position(r1: pd.Series, r2: pd.Series, adapter_1: str, adapter_2: str, barcode_length: int, compare: int = 19, max_distance: int = 3) -> pd.Series:
    """Smallest offset at which both mates show their adapter; the dimer rule first. -1 where there is none."""
    m1, l1 = S._as_matrix(r1)
    m2, l2 = S._as_matrix(r2)
    result = np.full(len(l1), -1, dtype=np.int32)

    def distance(matrix: np.ndarray, lengths: np.ndarray, adapter: str, start: int) -> np.ndarray:
        target = np.frombuffer(adapter.encode(), dtype=np.uint8)
        window = matrix[:, start : start + len(target)]
        if window.shape[1] < len(target):
            window = np.pad(window, ((0, 0), (0, len(target) - window.shape[1])))
        whole = start + len(target) <= lengths
        return np.where(whole, (window != target).sum(axis=1), len(target))

    dimer = (distance(m1, l1, adapter_1[1:], barcode_length) <= max_distance) & (distance(m2, l2, adapter_2[1:], barcode_length) <= max_distance)
    result[dimer] = barcode_length
    for start in range(max(m1.shape[1], m2.shape[1])):
        both = (distance(m1, l1, adapter_1[:compare], start) <= max_distance) & (distance(m2, l2, adapter_2[:compare], start) <= max_distance)
        result[both & (result < 0)] = start
    return pd.Series(result)


def trim_consistent_pairs(pairs: DataFrame, adapter_1: str, adapter_2: str, barcode_length: int) -> DataFrame:
    """Trims pairs at the adapter place that both mates agree on; whole reads without one.

    ``position`` is null without an adapter. ``kept`` is false for payloads shorter than 12.
    """

    @F.pandas_udf("int")
    def search(r1: pd.Series, r2: pd.Series) -> pd.Series:
        return consistent_position(r1, r2, adapter_1, adapter_2, barcode_length)

    placed = pairs.withColumn("_p", search("r1_seq", "r2_seq"))
    position = F.when(F.col("_p") >= 0, F.col("_p"))
    end = F.coalesce(position, F.length("r1_seq"))
    size = F.greatest(end - barcode_length, F.lit(0))
    return placed.select(
        "sample", "pair_id", F.substr(F.col("r2_seq"), F.lit(1), F.lit(barcode_length)).alias("barcode"), position.alias("position"),
        F.coalesce(position - barcode_length >= C.MIN_PAYLOAD, F.lit(True)).alias("kept"),
        *[F.substr(F.col(c), F.lit(barcode_length + 1), size).alias(c) for c in ("r1_seq", "r1_qual", "r2_seq", "r2_qual")],
    )


def _junction_places(seqs: pd.Series) -> pd.DataFrame:
    """Per read: number of whole matches of the junction (at most one mismatch), the first of them, and the lengths of
    its longest prefix at the read's end and longest suffix at the read's start."""
    junction = C.COMMON_RIGHT_REVERSE
    size = len(junction)
    matrix, lengths = S._as_matrix(seqs)
    count = np.zeros(len(lengths), dtype=np.int32)
    first = np.full(len(lengths), -1, dtype=np.int32)
    target = np.frombuffer(junction.encode(), dtype=np.uint8)
    for start in range(max(matrix.shape[1] - size + 1, 0)):
        hit = ((matrix[:, start : start + size] != target).sum(axis=1) <= 1) & (start + size <= lengths)
        first = np.where(hit & (count == 0), start, first)
        count += hit
    text = seqs.fillna("")
    tails, heads = text.str[-size:], text.str[:size].str[::-1]
    at_end = tails.str.len().to_numpy() - S.first_match(tails, junction, 1).to_numpy()
    at_start = heads.str.len().to_numpy() - S.first_match(heads, junction[::-1], 1).to_numpy()
    return pd.DataFrame({"n": count, "at": first.astype(np.int32), "prefix": at_end.astype(np.int32), "suffix": at_start.astype(np.int32)})


def circular_boundaries(pairs: DataFrame) -> DataFrame:
    """Decomposes pairs from circularised fragments into 5' and 3' payloads.

    The junction is looked for in both reads; the read that holds it is the reverse one. Only the search itself runs in
    Arrow batches. ``status`` tells why a pair is dropped: ``ambiguous``, ``no_junction``, ``short_tail`` or ``ok``.
    """

    @F.pandas_udf("n int, at int, prefix int, suffix int")
    def _junction(seqs: pd.Series) -> pd.DataFrame:
        return _junction_places(seqs)

    size = len(C.COMMON_RIGHT_REVERSE)
    found = pairs.withColumn("j1", _junction("r1_seq")).withColumn("j2", _junction("r2_seq"))
    whole = F.col("j1.n") + F.col("j2.n")
    option = lambda length, kind: F.struct(length.alias("length"), F.lit(kind).alias("kind"))
    best = F.greatest(
        option(F.col("j1.prefix"), "R1_prefix"), option(F.col("j2.prefix"), "R2_prefix"),
        option(F.col("j1.suffix"), "R1_suffix"), option(F.col("j2.suffix"), "R2_suffix"),
    )
    picked = found.withColumn("best", best)
    reverse_mate = F.when(F.col("j1.n") == 1, "R1").when(F.col("j2.n") == 1, "R2").otherwise(F.substring("best.kind", 1, 2))
    picked = picked.withColumn(
        "found", F.when(whole > 1, "ambiguous").when((whole == 0) & (F.col("best.length") <= 5), "no_junction").otherwise("found")
    ).withColumn("mate", reverse_mate)
    first = F.col("mate") == "R1"
    both = lambda what: (F.when(first, F.col(f"r1_{what}")).otherwise(F.col(f"r2_{what}")), F.when(first, F.col(f"r2_{what}")).otherwise(F.col(f"r1_{what}")))
    (rev, fwd), (rev_q, fwd_q) = both("seq"), both("qual")
    sided = picked.select("sample", "pair_id", "found", "mate", "best", "j1", "j2", rev.alias("rev"), fwd.alias("fwd"), rev_q.alias("rev_q"), fwd_q.alias("fwd_q"))
    start = (
        F.when(F.col("j1.n") + F.col("j2.n") == 1, F.when(first, F.col("j1.at")).otherwise(F.col("j2.at")))
        .when(F.col("best.kind").endswith("prefix"), F.length("rev") - F.col("best.length"))
        .otherwise(-F.col("best.length"))
    )
    placed = sided.withColumn("start", start).withColumn("tail", S.poly_a_run(F.col("fwd"), C.MIN_POLY_A))
    after = F.col("start") + size
    right_seq = F.substr(F.col("rev"), after + 1, F.lit(4))
    right_seen = after < F.length("rev") - 4
    right_id = F.when(~right_seen, "*")
    for key, text in C.AFTER_RIGHT.items():
        right_id = right_id.when(right_seq == text[:4], key)
    placed = placed.withColumn("right_id", right_id.otherwise("X")).withColumn("right_id_seq", F.when(right_seen, right_seq))
    skip = F.lit(0)
    for key, text in C.AFTER_RIGHT.items():
        skip = F.when(F.col("right_id") == key, F.lit(len(text))).otherwise(skip)
    left_at = after + skip
    left_seq = F.substr(F.col("rev"), left_at + 1, F.lit(4))
    left_seen = F.col("right_id").isin(list(C.AFTER_RIGHT)) & (left_at < F.length("rev") - 4)
    left_id = F.when(~left_seen, "*")
    for key, text in C.AFTER_LEFT.items():
        left_id = left_id.when(left_seq == text, key)
    placed = placed.withColumn("left_id", left_id.otherwise("X")).withColumn("left_id_seq", F.when(left_seen, left_seq))
    five = F.greatest(F.col("start"), F.lit(0))
    ok = F.col("found") == "found"
    cut = lambda c: F.when(ok, c)
    return placed.select(
        "sample",
        "pair_id",
        F.when(~ok, F.col("found")).when(F.col("tail.length") < C.MIN_POLY_A_KEPT, "short_tail").otherwise("ok").alias("status"),
        cut(F.col("mate")).alias("reverse_mate"),
        cut(F.concat_ws("-", "left_id", "right_id")).alias("control_ids"),
        cut(F.col("left_id_seq")).alias("left_id_seq"),
        cut(F.col("right_id_seq")).alias("right_id_seq"),
        cut(five).alias("five_length"),
        cut(F.col("tail.start")).alias("three_length"),
        cut(F.col("tail.length")).alias("tail_length"),
        cut(S.reverse_complement(F.substr(F.col("rev"), F.lit(1), five))).alias("five_seq"),
        cut(F.reverse(F.substr(F.col("rev_q"), F.lit(1), five))).alias("five_qual"),
        cut(F.substr(F.col("fwd"), F.lit(1), F.col("tail.start"))).alias("three_seq"),
        cut(F.substr(F.col("fwd_q"), F.lit(1), F.col("tail.start"))).alias("three_qual"),
        cut(F.substr(F.col("fwd"), F.col("tail.start") + 1, F.col("tail.length"))).alias("tail_seq"),
        cut(F.substr(F.col("fwd_q"), F.col("tail.start") + 1, F.col("tail.length"))).alias("tail_qual"),
    )


def boundary_counters(boundaries: DataFrame) -> DataFrame:
    """(sample, counter, key, n) of the decomposition: positions, tail lengths, joint lengths, ids."""
    used = boundaries.where("status in ('ok', 'short_tail')")
    other = F.when(F.col("reverse_mate") == "R1", F.lit("R2_forward")).otherwise(F.lit("R1_forward"))
    entry = lambda name, key: F.struct(name.alias("counter"), key.cast("string").alias("key"))
    entries = F.array(
        entry(F.concat("reverse_mate", F.lit("_reverse_positions")), F.col("five_length")),
        entry(F.concat(other, F.lit("_positions")), F.col("three_length")),
        entry(F.lit("joint_lengths"), F.concat_ws(",", "five_length", "three_length")),
        entry(F.lit("polyA_lengths"), F.col("tail_length")),
        entry(F.lit("control_ids"), F.col("control_ids")),
        entry(F.lit("left_ids"), F.col("left_id_seq")),
        entry(F.lit("right_ids"), F.col("right_id_seq")),
    )
    return used.select("sample", F.explode(entries).alias("e")).where("e.key is not null").groupBy("sample", "e.counter", "e.key").agg(
        F.count(F.lit(1)).alias("n")
    )


def synthetic_hits(reads: DataFrame, markers: list[str]) -> Column:
    """Whether a read is a prefix or suffix of one of the marker sequences (a short fixed list)."""
    hit = F.lit(False)
    for marker in markers:
        hit = hit | F.lit(marker).startswith(F.col("seq")) | F.lit(marker).endswith(F.col("seq"))
    return hit


def best_diagonal(seqs: pd.Series, marker: str) -> np.ndarray:
    """Longest gapless overlap of each read with the marker whose mismatches cost at most 7 of a score of 2 per base
    (3 per mismatch); 0 without one."""
    matrix, lengths = S._as_matrix(seqs)
    target = np.frombuffer(marker.encode(), dtype=np.uint8)
    width = matrix.shape[1]
    best = np.zeros(len(lengths), dtype=np.int32)
    for shift in range(-width + 1, len(target)):
        # Read base i lies on marker base i + shift.
        lo, hi = max(0, -shift), min(width, len(target) - shift)
        if hi <= lo:
            continue
        used = np.maximum(np.minimum(lengths, hi) - lo, 0)
        columns = np.arange(lo, hi)
        differs = (matrix[:, lo:hi] != target[lo + shift : hi + shift]) & (columns < lengths[:, None])
        mismatches = differs.sum(axis=1)
        fits = 3 * mismatches <= 7
        best = np.where(fits & (used > best), used, best).astype(np.int32)
    return best


def synthetic_overlaps(reads: DataFrame, markers: list[str], longer_than: int = 10) -> DataFrame:
    """Adds ``synthetic``: a gapless overlap longer than 10 with few mismatches (a declared re-aim of a gapped score)."""

    @F.pandas_udf("int")
    def overlap(seqs: pd.Series) -> pd.Series:
        return pd.Series(np.max([best_diagonal(seqs, m) for m in markers], axis=0))

    return reads.withColumn("synthetic", overlap("seq") > longer_than)


def triplets_at(reads: DataFrame, contexts: list[tuple[str, str, str]], min_overlap: int = 20, max_mismatches: int = 6, margin: int = 3) -> DataFrame:
    """(sample, locus, triplet, n): what reads show in the gap between each locus' two flanks.

    ``contexts`` are the few (locus, left flank, right flank) asked for. The best gapless diagonal must overlap by at
    least ``min_overlap`` with at most ``max_mismatches``, the triplet being free and ``margin`` bases from both ends.
    """

    def triplet(seqs: pd.Series, left: str, right: str) -> pd.Series:
        matrix, lengths = S._as_matrix(seqs)
        target = np.frombuffer((left + "NNN" + right).encode(), dtype=np.uint8)
        free = np.arange(len(left), len(left) + 3)
        width = matrix.shape[1]
        score = np.full(len(lengths), -1, dtype=np.int64)
        where = np.zeros(len(lengths), dtype=np.int64)
        for shift in range(-width + 1, len(target)):
            lo, hi = max(0, -shift), min(width, len(target) - shift)
            if hi <= lo:
                continue
            columns = np.arange(lo, hi)
            used = columns < lengths[:, None]
            masked = np.isin(columns + shift, free)
            mismatches = ((matrix[:, lo:hi] != target[lo + shift : hi + shift]) & used & ~masked).sum(axis=1)
            overlap = used.sum(axis=1)
            fits = (overlap >= min_overlap) & (mismatches <= max_mismatches)
            value = np.where(fits, 2 * overlap - 3 * mismatches, -1)
            better = value > score
            score, where = np.where(better, value, score), np.where(better, shift, where)
        at = len(left) - where
        good = (score >= 0) & (at >= margin) & (lengths - 1 - (at + 2) >= margin)
        text = seqs.fillna("").tolist()
        return pd.Series([s[a : a + 3] if g else None for s, a, g in zip(text, at, good)])

    @F.pandas_udf("array<struct<locus string, triplet string>>")
    def search(seqs: pd.Series) -> pd.Series:
        found = [(locus, triplet(seqs, left, right)) for locus, left, right in contexts]
        return pd.Series([[{"locus": l, "triplet": t[i]} for l, t in found if t[i] is not None] for i in range(len(seqs))])

    return (
        reads.select("sample", F.explode(search("seq")).alias("h"))
        .groupBy("sample", F.col("h.locus").alias("locus"), F.col("h.triplet").alias("triplet"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
