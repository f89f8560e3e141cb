"""SAM text, Parquet alignments and their coordinate-sorted sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from footprints.functions import cigar as G


def parse_sam(lines: DataFrame, value: str = "value") -> DataFrame:
    """Alignments from SAM lines; header lines are dropped. Other columns of ``lines`` (e.g. sample) are kept.

    pos is 0-based, aend exclusive, tags a map from name to value; ``nongenomic_length`` is tag ZN, 0 without it.
    """
    f = F.split(F.col(value), "\t")
    flag = F.get(f, F.lit(1)).cast("int")
    bit = lambda b: flag.bitwiseAND(F.lit(b)) != 0
    body = lines.where(~F.col(value).startswith("@") & (F.length(value) > 0))
    keep = [c for c in lines.columns if c != value]
    tags = F.map_from_entries(
        F.transform(F.slice(f, F.lit(12), F.greatest(F.size(f) - 11, F.lit(0))), lambda x: F.struct(F.substr(x, F.lit(1), F.lit(2)), F.substr(x, F.lit(6), F.length(x))))
    )
    cigar_text = F.get(f, F.lit(5))
    cigar = F.when(cigar_text == "*", F.array().cast("array<struct<op:int,len:int>>")).otherwise(G.parse(cigar_text))
    out = body.select(
        *keep,
        F.get(f, F.lit(0)).alias("qname"),
        F.get(f, F.lit(2)).alias("seqname"),
        (F.get(f, F.lit(3)).cast("bigint") - 1).alias("pos"),
        F.when(bit(16), "-").otherwise("+").alias("strand"),
        F.get(f, F.lit(4)).cast("int").alias("mapq"),
        bit(256).alias("is_secondary"),
        bit(4).alias("is_unmapped"),
        cigar.alias("cigar"),
        F.get(f, F.lit(9)).alias("seq"),
        F.get(f, F.lit(10)).alias("qual"),
        tags.alias("tags"),
    )
    return (
        out.withColumn("aend", G.reference_end(F.col("pos"), F.col("cigar")))
        .withColumn("qlen", G.aligned_length(F.col("cigar")) + F.aggregate("cigar", F.lit(0), lambda a, c: a + F.when(c["op"] == 1, c["len"]).otherwise(0)))
        .withColumn("nongenomic_length", F.coalesce(F.col("tags")["ZN"].cast("int"), F.lit(0)))
        .withColumn("nm", F.col("tags")["NM"].cast("int"))
    )


def to_sam(alignments: DataFrame) -> DataFrame:
    """SAM lines (``value``) of alignments, with the ZN and NM tags."""
    flag = (
        F.when(F.col("is_unmapped"), 4).otherwise(0) + F.when(F.col("strand") == "-", 16).otherwise(0) + F.when(F.col("is_secondary"), 256).otherwise(0)
    )
    cigar = F.when(F.size("cigar") == 0, "*").otherwise(G.unparse(F.col("cigar")))
    fields = [
        "qname", flag, "seqname", F.col("pos") + 1, "mapq", cigar, F.lit("*"), F.lit(0), F.lit(0), "seq", "qual",
        F.concat(F.lit("NM:i:"), "nm"), F.concat(F.lit("ZN:i:"), "nongenomic_length"),
    ]
    return alignments.withColumn("value", F.concat_ws("\t", *fields))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    """SAM text files; ``sample`` comes from a ``sample=`` folder if there is one."""
    return parse_sam(spark.read.text(path))


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _spread(alignments: DataFrame, keys: list[str], partitions: int | None) -> DataFrame:
    """Range-partitioned and sorted by the keys. Rows with equal keys are spread by a hash of their name, so that a start site
    that holds a third of all rows is cut into several ranges."""
    last = [F.xxhash64("qname").alias("_tie")] if "qname" in alignments.columns else []
    cut = [*[F.col(k) for k in keys], *last]
    ranged = alignments.repartitionByRange(partitions, *cut) if partitions else alignments.repartitionByRange(*cut)
    return ranged.sortWithinPartitions(*keys)


def coordinate_sorted(alignments: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-partitioned and sorted by sequence and position, so that Parquet row groups can be skipped by region."""
    return _spread(alignments, ["seqname", "pos", "strand", "aend"], partitions)


# Spans of up to FINEST bases are of level 0; each further level holds spans eight times as long, the last all the rest.
FINEST = 1 << 12
LEVELS = 10


def span_level(pos, aend):
    """The level of an alignment by its span; 0 where there is none."""
    span = F.coalesce(F.col(aend) - F.col(pos), F.lit(0))
    return sum((F.when(span > FINEST * 8**k, 1).otherwise(0) for k in range(LEVELS - 1)), F.lit(0)).cast("int")


def write_sorted(alignments: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet sorted by sequence, level of span and position; ``span_level`` is stored for ``read_region``."""
    levelled = alignments.withColumn("span_level", span_level("pos", "aend"))
    _spread(levelled, ["seqname", "span_level", "pos", "strand", "aend"], partitions).write.mode("overwrite").parquet(path)


def region_filter(start: int, end: int):
    """Overlap with [start, end), with bounds on where an alignment of each level begins that reach the scan.

    One long alignment is in a level of its own, so it does not widen what is read of the short ones.
    """
    level, pos = F.col("span_level"), F.col("pos")
    begins = level == LEVELS - 1
    for k in range(LEVELS - 1):
        begins = begins | ((level == k) & (pos > start - FINEST * 8**k))
    return begins & (pos < end) & (F.col("aend") > start)


def read_region(spark: SparkSession, path: str, seqname, start: int, end: int) -> DataFrame:
    """Alignments of a store of ``write_sorted`` that overlap [start, end)."""
    return spark.read.parquet(path).where((F.col("seqname") == seqname) & region_filter(start, end)).drop("span_level")


def merge_pathways(*pathways: DataFrame) -> DataFrame:
    """Mappings of several pathways together, coordinate sorted."""
    whole = pathways[0]
    for other in pathways[1:]:
        whole = whole.unionByName(other)
    return coordinate_sorted(whole)


def grouped_by_position(alignments: DataFrame) -> DataFrame:
    """Mappings with equal position in the same partition, sorted so that equal ones follow each other.

    For exports that need whole groups; collapsing duplicates does not, as it counts map-side first.
    """
    keys = ["sample", "seqname", "pos", "strand"]
    return alignments.repartition(*keys).sortWithinPartitions(*keys)
