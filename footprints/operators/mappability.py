"""Which transcript positions reads of a given length can be told to come from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from footprints import constants as C
from footprints.functions import sequence as S
from footprints.operators import coords, intervals


def tile_fragments(models: DataFrame, sequences: DataFrame, left: int, fragment: int, read_length: int, adapter: str, buffer: int) -> DataFrame:
    """(gene, pos, fragment, seq): the fragment at every position from ``buffer`` before the start codon to ``buffer`` behind the
    stop codon, and the read it would give. Sequences start ``left`` bases before the transcript; fragments running off the
    reference are left out."""
    cds = F.col("stop_codon_t") - F.col("start_codon_t")
    first = F.col("start_codon_t") - buffer + left + 1
    text = F.substr(F.col("sequence"), first.cast("int"), (cds + 2 * buffer + fragment - 1).cast("int"))
    rows = models.join(sequences, "gene").select("gene", F.posexplode(S.windows_of(text, fragment)).alias("k", "fragment"))
    tiles = rows.where(~F.col("fragment").contains("-")).select("gene", (F.col("k") - buffer).cast("bigint").alias("pos"), "fragment")
    return tiles.withColumn("seq", F.substring(F.concat("fragment", F.lit(adapter)), 1, read_length))


def exact_uniqueness(tiles: DataFrame) -> DataFrame:
    """(gene, pos, code): 2 where the same fragment occurs anywhere else, 1 otherwise. Fragments are counted, then joined, so a
    repeat that holds most positions never meets in one window."""
    seen = tiles.groupBy("fragment").agg(F.count(F.lit(1)).alias("_n"))
    return tiles.join(seen, "fragment").select("gene", "pos", F.when(F.col("_n") > 1, 2).otherwise(1).alias("code"))


def mapped_uniqueness(hits: DataFrame, models: DataFrame, buffer: int) -> DataFrame:
    """(gene, pos, code) from mapped artificial reads (true_gene, true_pos, seqname, strand, pos, aend, mapq).

    A read that does not map uniquely marks its origin and every transcript position at the place it maps to with 2; a unique
    one marks its origin with 1. Positions no read speaks about are 0 and left out.
    """
    marks = hits.select(F.col("true_gene").alias("gene"), F.col("true_pos").cast("bigint").alias("pos"), F.when(F.col("mapq") < C.UNIQUE_MAPQ, 2).otherwise(1).alias("code"))
    loose = hits.where(F.col("mapq") < C.UNIQUE_MAPQ).select(
        "seqname", "strand", F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("aend") - 1).alias("five")
    ).distinct()
    spans = models.withColumn("_lo", F.col("start") - buffer).withColumn("_hi", F.col("end") + buffer)
    placed = intervals.point_join(loose, spans, ["seqname", "strand"], "five", ("_lo", "_hi"))
    t = coords.to_transcript(F.col("five"), buffer, buffer)
    others = placed.select("gene", (t - F.col("start_codon_t")).alias("pos"), F.lit(2).alias("code")).where("pos is not null")
    return marks.unionByName(others).groupBy("gene", "pos").agg(F.max("code").alias("code"))


def wrong_unique(hits: DataFrame, models: DataFrame, buffer: int) -> DataFrame:
    """Uniquely mapped artificial reads that lie elsewhere than where they came from; there must be none."""
    used = hits.where(F.col("mapq") == C.UNIQUE_MAPQ).join(
        models.select(F.col("gene").alias("true_gene"), F.col("seqname").alias("t_seqname"), F.col("strand").alias("t_strand"), "start", "end", "exons",
                      "transcript_length", "start_codon_t"), "true_gene"
    )
    five = F.when(F.col("strand") == "+", F.col("pos")).otherwise(F.col("aend") - 1)
    moved = used.withColumn("five", five).withColumnRenamed("strand", "_s").withColumnRenamed("t_strand", "strand")
    origin = coords.to_genomic(F.col("start_codon_t") + F.col("true_pos"))
    return moved.where((F.col("seqname") != F.col("t_seqname")) | (F.col("_s") != F.col("strand")) | (F.col("five") != origin)).select("true_gene", "true_pos")
