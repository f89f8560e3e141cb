"""Small fixed dimension tables: codons, anticodons, tRNA weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footprints import constants as C


def codon_dimension(spark: SparkSession) -> DataFrame:
    """64 rows: codon, index, amino_acid (``*`` for stop), its degeneracy and, for sense codons, the anticodon."""
    readers = {codon.replace("U", "T"): anti.replace("U", "T") for anti, codons in C.ANTICODONS.items() for codon in codons}
    rows = [
        (codon, i, aa, C.AMINO_ACIDS.count(aa), readers.get(codon))
        for i, (codon, aa) in enumerate(C.CODON_TO_AMINO_ACID.items())
    ]
    return spark.createDataFrame(rows, "codon string, codon_index int, amino_acid string, degeneracy int, anticodon string")


def for_each(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Every row with every row of a dimension, such as the catalogue of samples.

    The dimension travels as one array, whose size is that of a catalogue: experiments are listed by hand. So the plan has no
    product of two tables, and nothing is collected while it is made.
    """
    every = dimension.agg(F.collect_list(F.struct(*dimension.columns)).alias("_every"))
    return rows.crossJoin(F.broadcast(every)).withColumn("_one", F.explode("_every")).select(*rows.columns, "_one.*")


def bases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(b, i) for i, b in enumerate(C.BASES)], "base string, base_index int")


def trna_weights(raw: DataFrame, kind: str = "copy number") -> DataFrame:
    """(codon, weight) as expected decoding time from copy number, copy number times wobble, or tAI."""
    value: dict[str, Column] = {
        "copy number": F.col("copy_number").cast("double"),
        "wobble": F.col("copy_number").cast("double") * F.col("wobble"),
        "tAI": F.col("tai").cast("double"),
        "premal tAI": F.col("tai").cast("double"),
    }
    if kind not in value:
        raise ValueError(f"unknown kind of tRNA weight: {kind}")
    return raw.select("codon", F.try_divide(F.lit(1.0), value[kind]).alias("weight"))
