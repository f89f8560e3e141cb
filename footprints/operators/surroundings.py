"""Sums over what stands around marked codons, at every offset of a wide window.

A window of 201 offsets would turn each marked codon into 201 rows. Here the codons of a piece of a gene, with a margin as wide
as the window, become one row of arrays; the sums over all its marked codons are taken offset by offset on array slices, and
only one number per offset, codon and sum leaves a task for each sample and label. Pieces have a fixed width, so long genes are
spread over many rows and a row's size is bounded.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footprints import constants as C
from footprints.functions import stats
from footprints.session import ship_package

# Codons of a piece without its margins.
WIDTH = 1024
# Sums held by a task at a time; more are handed on and summed up after the shuffle.
_CELLS = 1 << 23
_ROWS = 64


def _cells(marked: DataFrame, values: Sequence[str], before: int, after: int) -> DataFrame:
    """One row per piece of a gene: sample, _chunk and its codons with their margins."""
    numbers = F.map_from_arrays(F.array(*[F.lit(c) for c in C.ALL_CODONS]), F.array(*[F.lit(i) for i in range(len(C.ALL_CODONS))]))
    # Codons with other letters are none of the 64; they are counted nowhere.
    codon = F.coalesce(F.try_element_at(numbers, F.col("codon")), F.lit(-1)).cast("int")
    spread = stats.halo(marked.select("sample", "gene", F.col("i").cast("bigint").alias("i"), codon.alias("code"), F.col("n").cast("double").alias("n"), "label", *values), "i", before, after, WIDTH)
    own = lambda c: F.when(F.col("_core"), F.col(c)).alias(c)
    cell = F.struct("i", "code", "n", own("label"), *[own(v) for v in values])
    pieces = spread.groupBy("sample", "gene", "_chunk").agg(F.collect_list(cell).alias("cells"))
    return pieces.select(F.col("sample").cast("string").alias("sample"), "_chunk", "cells").sortWithinPartitions("sample")


def sums_around(marked: DataFrame, values: Sequence[str], before: int, after: int, by_count: Sequence[str] = (), pairs: bool = False) -> DataFrame:
    """(sample, label, offset, codon, [codon_before,] sites and one sum per value) over all codons with a label.

    ``marked``: sample, gene, i, codon, n, label and the value columns; one row per codon, and codons without a label only stand
    around others. A value is added up over the labelled codons i whose neighbour at i + offset exists, null as 0; those in
    ``by_count`` are multiplied with the neighbour's n first. ``sites`` counts the labelled codons. With ``pairs`` sums are
    also by the codon ahead of the neighbour; that one must lie within the window and exist, else it is null.
    """
    ship_package(marked.sparkSession)
    values = list(values)
    names = ["sites", *values]
    n_codons, n_offsets, margin = len(C.ALL_CODONS), before + after + 1, before + after
    width = n_codons * (n_codons + 1) if pairs else n_codons
    weighted = [v in by_count for v in values]

    def emitted(groups, acc):
        kept = np.nonzero(acc[0, :, : len(groups)])
        if not len(kept[0]):
            return None
        offset, group, cell = kept
        sample, label = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(group)) for k in (0, 1))
        columns = [sample, label, pa.array((offset - before).astype(np.int32)), pa.array((cell % n_codons).astype(np.int32)), pa.array((cell // n_codons - 1).astype(np.int32))]
        columns += [pa.array(acc[k][kept]) for k in range(len(names))]
        return pa.RecordBatch.from_arrays(columns, names=["sample", "label", "offset", "code", "code_before", *names])

    def run(batches):
        room = max(1, _CELLS // (len(names) * n_offsets * width))
        groups: dict[tuple[str, str], int] = {}
        acc = np.zeros((len(names), n_offsets, room, width))
        for batch in batches:
            for start in range(0, batch.num_rows, _ROWS):
                piece = batch.slice(start, _ROWS)
                cells = piece.column("cells")
                sizes = cells.value_lengths().to_numpy()
                flat = cells.flatten()
                row = np.repeat(np.arange(len(sizes)), sizes)
                i, code = flat.field("i").to_numpy(), flat.field("code").to_numpy()
                length = WIDTH + margin
                at = row * length + i - (np.repeat(piece.column("_chunk").to_numpy(), sizes) * WIDTH - before)
                if len(np.unique(at)) < len(at):
                    raise ValueError("a codon of a gene has several rows")
                codes, counts = np.full(len(sizes) * length, -1, np.int64), np.zeros(len(sizes) * length)
                codes[at], counts[at] = code, flat.field("n").to_numpy()
                labels = flat.field("label")
                site = np.flatnonzero(labels.is_valid().to_numpy(zero_copy_only=False))
                if not len(site):
                    continue
                picked = labels.take(pa.array(site)).dictionary_encode()
                sample = piece.column("sample").dictionary_encode()
                both = sample.indices.to_numpy()[row[site]] * len(picked.dictionary) + picked.indices.to_numpy()
                own = [np.nan_to_num(flat.field(v).take(pa.array(site)).cast(pa.float64()).fill_null(0).to_numpy(zero_copy_only=False)) for v in values]
                places = at[site]
                # Usually one sample and a few labels a piece.
                for key in np.unique(both):
                    name = (sample.dictionary[int(key) // len(picked.dictionary)].as_py(), picked.dictionary[int(key) % len(picked.dictionary)].as_py())
                    if name not in groups and len(groups) == room:
                        made = emitted(list(groups), acc)
                        if made is not None:
                            yield made
                        groups.clear()
                        acc[:] = 0
                    g = groups.setdefault(name, len(groups))
                    of = np.flatnonzero(both == key)
                    for o in range(n_offsets):
                        there = places[of] + (o - before)
                        c = codes[there]
                        ok = c >= 0
                        c = c[ok]
                        if pairs:
                            ahead = codes[there[ok] - 1] if o > 0 else np.full(len(c), -1)
                            c = c + (ahead + 1) * n_codons
                        acc[0, o, g] += np.bincount(c, minlength=width)
                        for k, v in enumerate(own):
                            w = v[of][ok]
                            acc[k + 1, o, g] += np.bincount(c, w * counts[there[ok]] if weighted[k] else w, minlength=width)
        made = emitted(list(groups), acc)
        if made is not None:
            yield made

    schema = "sample string, label string, offset int, code int, code_before int, " + ", ".join(f"`{n}` double" for n in names)
    partial = _cells(marked, values, before, after).mapInArrow(run, schema)
    keys = ["sample", "label", "offset", "code", *(["code_before"] if pairs else [])]
    summed = partial.groupBy(*keys).agg(F.sum("sites").cast("bigint").alias("sites"), *[F.sum(v).alias(v) for v in values])
    codons = F.array(*[F.lit(c) for c in C.ALL_CODONS])
    shown = [F.get(codons, F.col("code")).alias("codon")]
    if pairs:
        shown.append(F.when(F.col("code_before") >= 0, F.get(codons, F.col("code_before"))).alias("codon_before"))
    return summed.select("sample", "label", "offset", *shown, "sites", *values)
