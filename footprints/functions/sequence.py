"""Column expressions on nucleotide strings. All but ``find_adapter_within`` stay in the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

from footprints import constants as C


def complement(seq: Column) -> Column:
    return F.translate(seq, "ACGTN", "TGCAN")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def dna_to_rna(seq: Column) -> Column:
    return F.translate(seq, "T", "U")


def rna_to_dna(seq: Column) -> Column:
    return F.translate(seq, "U", "T")


def poly_a_start(seq: Column) -> Column:
    """Index of the first base of the closing run of A or N; the length where there is none."""
    return F.length(F.rtrim(seq, F.lit("AN")))


def poly_t_end(seq: Column) -> Column:
    """Index of the last base of the opening run of T or N; -1 where there is none."""
    return F.length(seq) - F.length(F.ltrim(seq, F.lit("TN"))) - 1


def opening_run(seq: Column, base: str) -> Column:
    """Length of the run of a base at the start."""
    return F.length(seq) - F.length(F.ltrim(seq, F.lit(base)))


def closing_run(seq: Column, base: str) -> Column:
    return F.length(seq) - F.length(F.rtrim(seq, F.lit(base)))


def anchor_start(seq: Column) -> Column:
    """Position behind the anchor if its first occurrence is at an allowed place, else 0."""
    at = F.instr(seq, C.ANCHOR) - 1
    return F.when(at.isin(C.ANCHOR_STARTS), at + len(C.ANCHOR)).otherwise(F.lit(0))


def poly_a_run(seq: Column, min_length: int) -> Column:
    """First run of at least ``min_length`` A's, else the first of the longest runs: (start, length)."""
    pattern = "A{%d,}" % min_length
    first = F.regexp_extract(seq, pattern, 0)
    longest = F.coalesce(
        F.array_max(F.transform(F.regexp_extract_all(seq, F.lit("(A+)"), F.lit(1)), F.length)), F.lit(0)
    )
    run = F.when(F.length(first) > 0, F.length(first)).otherwise(longest)
    start = (
        F.when(F.length(first) > 0, F.regexp_instr(seq, F.lit(pattern)) - 1)
        .when(longest > 0, F.position(F.repeat(F.lit("A"), longest), seq) - 1)
        .otherwise(F.lit(0))
    )
    return F.struct(start.cast("int").alias("start"), run.cast("int").alias("length"))


def predominantly_a(seq: Column) -> Column:
    """At least 19 A's in the first 20 bases; only A's where the read is shorter than 20."""
    head = F.substring(seq, 1, 20)
    others = F.length(F.replace(head, F.lit("A"), F.lit("")))
    return F.when(F.length(head) < 20, others == 0).otherwise(others <= 1)


def adapter_pattern(adapter: str) -> str:
    """Regular expression for the adapter with at most one mismatch, or a whole prefix of it at the read's end.

    Nested so that a place is given up at its second mismatch: ``aE`` goes on without one, ``[^a]rest`` has used it up.
    """
    nested = ""
    for i in range(len(adapter) - 1, -1, -1):
        base, rest = adapter[i], adapter[i + 1 :]
        at_end = r"\z|" if i > 0 else ""
        nested = f"(?:{at_end}{base}{nested}|[^{base}]{rest})"
    return nested


def find_adapter(seq: Column, adapter: str, prefix_length: int = C.ADAPTER_PREFIX_LENGTH) -> Column:
    """Leftmost place of the adapter prefix (at most one mismatch); read length where there is none."""
    at = F.regexp_instr(seq, F.lit(adapter_pattern(adapter[:prefix_length])))
    return F.when(at > 0, at - 1).otherwise(F.length(seq)).cast("int")


def _as_matrix(seqs: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    raw = seqs.fillna("").str.encode("ascii", "replace")
    lengths = raw.str.len().to_numpy(dtype=np.int64)
    width = int(lengths.max()) if len(lengths) else 0
    matrix = np.zeros((len(raw), max(width, 1)), dtype=np.uint8)
    if width:
        padded = np.array(raw.tolist(), dtype=f"S{width}")
        matrix = padded.view(np.uint8).reshape(len(raw), width)
    return matrix, lengths


def first_match(seqs: pd.Series, adapter: str, max_distance: int) -> pd.Series:
    """Leftmost offset with at most ``max_distance`` mismatches; overlaps cut by the read's end must be exact."""
    matrix, lengths = _as_matrix(seqs)
    result = lengths.copy()
    found = np.zeros(len(lengths), dtype=bool)
    target = np.frombuffer(adapter.encode(), dtype=np.uint8)
    for start in range(matrix.shape[1]):
        whole = start + len(adapter) <= lengths
        window = matrix[:, start : start + len(adapter)]
        equal = window == target[: window.shape[1]]
        used = np.minimum(len(adapter), np.maximum(lengths - start, 0))
        columns = np.arange(window.shape[1])
        distance = (~equal & (columns < used[:, None])).sum(axis=1)
        hit = np.where(whole, distance <= max_distance, (distance == 0) & (start < lengths))
        new = hit & ~found
        result[new] = start
        found |= new
    return pd.Series(result.astype(np.int32))


def find_adapter_within(seq: Column, adapter: str, max_distance: int) -> Column:
    """As ``find_adapter`` for larger distances: an Arrow-batched comparison of every offset at once per batch."""

    @F.pandas_udf("int")
    def search(seqs: pd.Series) -> pd.Series:
        return first_match(seqs, adapter, max_distance)

    return search(seq)


def codons_of(seq: Column) -> Column:
    """The sequence cut into codons in one pass; a last incomplete one is kept."""
    return F.regexp_extract_all(seq, F.lit("(.{1,3})"), F.lit(1))


def windows_of(seq: Column, size: int) -> Column:
    """All substrings of a size, by start, in one pass."""
    return F.regexp_extract_all(seq, F.lit("(?=(.{%d}))" % size), F.lit(1))


def bases_of(seq: Column) -> Column:
    return F.split(seq, "")
