"""Coordinate lift and reconciliation of annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footprints.operators import intervals

COORDINATES = ["cds_from", "cds_to", "tx_from", "tx_to"]


def lift(annotations: DataFrame, chain_blocks: DataFrame) -> DataFrame:
    """Moves the 1-based coordinate columns through chain blocks (chain, seqname, b_start, b_end, delta).

    One row per chain and gene; a gene of which a coordinate lies in no block of a chain is dropped. Empty coordinates
    stay empty. The larger CDS coordinate is then made exclusive: ``cds_to`` on the plus strand, ``cds_from`` on the minus.
    """
    long = annotations.select(
        "gene", "seqname",
        F.explode(F.array(*[F.struct(F.lit(c).alias("name"), (F.col(c) - 1).alias("at")) for c in COORDINATES])).alias("x"),
    ).select("gene", "seqname", "x.name", "x.at").where("at is not null")
    moved = intervals.point_join(long, chain_blocks, ["seqname"], "at", ("b_start", "b_end")).select(
        "chain", "gene", "name", (F.col("at") + F.col("delta")).alias("new")
    )
    wide = moved.groupBy("chain", "gene").agg(
        F.count(F.lit(1)).alias("_found"),
        *[F.max(F.when(F.col("name") == c, F.col("new"))).alias(f"_{c}") for c in COORDINATES],
    )
    wanted = sum((F.col(c).isNotNull().cast("int") for c in COORDINATES), F.lit(0))
    joined = annotations.join(wide, "gene").where(F.col("_found") == wanted)
    forward = F.col("_cds_from") < F.col("_cds_to")
    return joined.select(
        "chain", *[c for c in annotations.columns if c not in COORDINATES],
        F.when(F.col("_cds_from") > F.col("_cds_to"), F.col("_cds_from") + 1).otherwise(F.col("_cds_from")).alias("cds_from"),
        F.when(forward, F.col("_cds_to") + 1).otherwise(F.col("_cds_to")).alias("cds_to"),
        F.col("_tx_from").alias("tx_from"), F.col("_tx_to").alias("tx_to"),
    )


def disagreeing(annotations: DataFrame, transcripts: DataFrame, first: Column, last: Column) -> DataFrame:
    """Genes that are missing from the transcripts or whose bounds differ from them.

    ``first`` and ``last`` are the annotation's 0-based inclusive bounds; ``problem`` is missing or differs.
    """
    known = transcripts.select("gene", F.col("start").alias("_t_start"), F.col("end").alias("_t_end"))
    lo, hi = F.least(first, last), F.greatest(first, last)
    joined = annotations.withColumn("_lo", lo).withColumn("_hi", hi).join(known, "gene", "left")
    problem = F.when(F.col("_t_start").isNull(), "missing").when(
        (F.col("_lo") != F.col("_t_start")) | (F.col("_hi") != F.col("_t_end")), "differs"
    )
    return joined.withColumn("problem", problem).where("problem is not null").withColumnRenamed("_lo", "bound").drop("_hi", "_t_start", "_t_end")


def first_discrepancy(problems: DataFrame) -> DataFrame:
    """Per sequence the smallest bound that differs."""
    return problems.where("problem = 'differs'").groupBy("seqname").agg(F.min("bound").alias("first_at"), F.count(F.lit(1)).alias("n"))


def discrepancies_by_chain(problems: DataFrame) -> DataFrame:
    return problems.where("problem = 'differs'").groupBy("chain", "seqname").agg(F.count(F.lit(1)).alias("n"))


def utr_lengths(annotations: DataFrame) -> DataFrame:
    """(gene, five_utr, three_utr) from tx_start, cds_start, cds_end, tx_end by strand."""
    before, after = F.col("cds_start") - F.col("tx_start"), F.col("tx_end") - F.col("cds_end")
    plus = F.col("strand") == "+"
    return annotations.select("gene", F.when(plus, before).otherwise(after).alias("five_utr"), F.when(plus, after).otherwise(before).alias("three_utr"))


def compare_utr_lengths(first: DataFrame, second: DataFrame) -> DataFrame:
    """5' and 3' UTR lengths of the genes of both tables; 0 where the second has none."""
    b = second.select("gene", F.coalesce("five_utr", F.lit(0)).alias("other_five_utr"), F.coalesce("three_utr", F.lit(0)).alias("other_three_utr"))
    return first.join(b, "gene")


def longest_utrs(lengths: DataFrame, top: int = 20) -> DataFrame:
    return lengths.orderBy(F.desc("five_utr"), "gene").limit(top)


def agreed_names(first: DataFrame, second: DataFrame, changed: DataFrame) -> DataFrame:
    """Names in ``first`` and in ``second`` without the changed ones."""
    return first.select("gene").intersect(second.select("gene").subtract(changed.select("gene")))


def transcript_list(translated: DataFrame, nonoverlapping: DataFrame, extra: DataFrame) -> DataFrame:
    """Names that are translated and do not overlap, together with an extra list."""
    return translated.select("gene").intersect(nonoverlapping.select("gene")).union(extra.select("gene")).distinct()
