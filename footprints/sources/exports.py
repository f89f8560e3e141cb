"""Text exports in a global order: range partitions by the format's sort key, files whose names sort like their lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footprints.sources import alignments as A, annotation as N, lines as L, tables as T


def write_ordered(lines: DataFrame, path: str, order: Sequence[Column], by: Sequence[str] = (), header: str | None = None) -> None:
    """Writes ``value`` as text files whose order by name is the order of ``order``; equal keys are ordered by the line.

    With ``by`` each value of those columns has a folder of its own, ordered in itself. The header is the first line of
    the first file (of each folder) and of no other. Range partitions are cut by Spark from a sample of the keys, the line
    among them, so that equal keys do not meet in one task unless their lines are equal too.
    """
    # Names of folders are never null, else the writer would sort once more by them alone.
    named = [F.coalesce(F.col(b).cast("string"), F.lit("")).alias(b) for b in by]
    keys = [f"_k{i}" for i in range(len(order))]
    body = lines.select(*named, F.lit(1).alias("_head"), *[o.alias(k) for o, k in zip(order, keys)], "value")
    if header is not None:
        folders = body.select(*by).distinct() if by else lines.sparkSession.range(1)
        top = folders.select(*by, F.lit(0).alias("_head"), F.lit(header).alias("value"))
        body = body.unionByName(top, allowMissingColumns=True)
    placed = body.orderBy(*by, "_head", *keys, "value").select(*by, "value").write.mode("overwrite")
    (placed.partitionBy(*by) if by else placed).text(path)


def read_ordered(spark: SparkSession, path: str, by: Sequence[str] = ()) -> DataFrame:
    """(``by``, line, value) of what ``write_ordered`` wrote; lines are counted from 0 over the files of a folder."""
    return L.numbered_folder(spark, path, by).select(*by, "line", "value")


# ---- features and alignments ----------------------------------------------------------------------


def write_gff(features: DataFrame, path: str) -> None:
    """GFF3, ordered by sequence, start, end, feature and strand, with its version line."""
    keyed = N.to_gff_lines(features, keep=("seqname", "start", "end", "feature", "strand"))
    write_ordered(keyed, path, [F.col(c) for c in ("seqname", "start", "end", "feature", "strand")], header="##gff-version 3")


def write_sam(alignments: DataFrame, path: str) -> None:
    """SAM text in one folder a sample, coordinate sorted, behind a line that says so."""
    text = A.to_sam(alignments)
    write_ordered(text, path, [F.col(c) for c in ("seqname", "pos", "strand", "aend")], ["sample"], "@HD\tVN:1.6\tSO:coordinate")


# ---- tables of genes ------------------------------------------------------------------------------


def _by_name() -> list[Column]:
    return [F.substring_index("value", "\t", 1)]


def write_boundaries(boundaries: DataFrame, path: str) -> None:
    """Boundaries ordered by sequence, smaller and larger end, and strand."""
    lines = boundaries.select("seqname", "strand", F.least("five_pos", "three_pos").alias("lo"), F.greatest("five_pos", "three_pos").alias("hi"), T.boundary_line().alias("value"))
    write_ordered(lines, path, [F.col("seqname").cast("string"), F.col("lo"), F.col("hi"), F.col("strand")])


def read_boundaries(spark: SparkSession, path: str) -> DataFrame:
    return T.parse_boundary_lines(read_ordered(spark, path), "line")


def write_codon_counts(codons: DataFrame, path: str, count: str = "relaxed") -> None:
    """One line a gene, ordered by name, in one folder a sample."""
    write_ordered(T.codon_count_lines(codons, count), path, _by_name(), ["sample"])


def read_codon_counts(spark: SparkSession, path: str) -> DataFrame:
    return T.parse_codon_count_lines(read_ordered(spark, path, ["sample"]), "line")


def write_rpkms(rpkms: DataFrame, path: str) -> None:
    """Name and RPKM with two decimals, ordered by name, in one folder a sample."""
    write_ordered(T.rpkm_lines(rpkms), path, _by_name(), ["sample"])


def read_rpkms(spark: SparkSession, path: str) -> DataFrame:
    return T.parse_rpkm_lines(read_ordered(spark, path, ["sample"]), "line")


def write_expression(read_counts: DataFrame, path: str) -> None:
    """Two-line records ordered by name, in one folder a sample."""
    write_ordered(T.expression_lines(read_counts), path, _by_name(), ["sample"])


def read_expression(spark: SparkSession, path: str) -> DataFrame:
    """(sample, record, gene, cds_length, counts) of two-line records, whatever split or file their lines fall into.

    Lines belong together by their number in the folder. A record without its second line is an error.
    """
    lines = read_ordered(spark, path, ["sample"])
    first = F.col("line") % 2 == 0
    record = lines.groupBy("sample", F.floor(F.col("line") / 2).alias("record")).agg(
        F.max(F.when(first, F.col("value"))).alias("info"), F.max(F.when(~first, F.col("value"))).alias("counts")
    )
    broken = F.raise_error(F.concat(F.lit("a record without its line of counts: "), F.col("info")))
    whole = record.withColumn("value", F.concat("info", F.lit("\n"), F.when(F.col("counts").isNull(), broken.cast("string")).otherwise(F.col("counts"))))
    return T.parse_expression_records(whole, "record")


def write_matrix(matrix: DataFrame, path: str) -> None:
    """Tab-separated cells ordered by the first column, the names of the columns once ahead of them; null is an empty cell."""
    cells = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in matrix.columns]
    write_ordered(matrix.select(F.concat_ws("\t", *cells).alias("value")), path, _by_name(), header="\t".join(matrix.columns))


def read_matrix(spark: SparkSession, path: str, samples: Sequence[str]) -> DataFrame:
    """(line, gene, cds_length, samples) below the line of names, whose order counts; a sample it lacks is an error."""
    lines = read_ordered(spark, path)
    names = lines.where("line = 0").first()
    at = {c: i for i, c in enumerate(names.value.split("\t"))} if names else {}
    missing = [s for s in ("gene", "cds_length", *samples) if s not in at]
    if missing:
        raise ValueError(f"no column {', '.join(missing)} in {path}")
    f = F.split("value", "\t", -1)
    cell = lambda c, kind: F.get(f, F.lit(at[c])).try_cast(kind).alias(c)
    return lines.where("line > 0").select("line", cell("gene", "string"), cell("cds_length", "int"), *[cell(s, "bigint") for s in samples])


# ---- descriptions of experiments ------------------------------------------------------------------


def read_descriptions(spark: SparkSession, root: str, files: str = "description.txt") -> DataFrame:
    """(family, name, fields): every experiment below ``root`` whose folder ``family/name`` (or ``family=../name=..``, both
    with or without a ``job`` folder) holds a description, with its ``key value`` or ``key: value`` lines as a map.

    Lines that start with # and empty ones do not count. Two descriptions of an experiment and a key given twice are errors.
    """
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", files).text(root)
    place = F.regexp_replace(F.col("_metadata.file_path"), "(/job)?/[^/]*$", "")
    # Paths come quoted, and names of partition folders are quoted once more.
    plain = lambda name: F.coalesce(F.try_url_decode(F.replace(name, F.lit("+"), F.lit("%2B"))), name)

    def part(i: int, label: str) -> Column:
        name = plain(F.element_at(F.split(place, "/"), i))
        return F.when(name.startswith(f"{label}="), plain(F.substr(name, F.lit(len(label) + 2)))).otherwise(name)

    text = F.trim("value")
    lines = raw.where(~text.startswith("#") & (F.length(text) > 0)).select(
        part(-2, "family").alias("family"), part(-1, "name").alias("name"), F.col("_metadata.file_path").alias("file"),
        F.regexp_extract(text, r"^([^\s:]+)", 1).alias("key"), F.regexp_extract(text, r"^[^\s:]+\s*:?\s*(.*)$", 1).alias("field"),
    )
    found = lines.groupBy("family", "name").agg(F.collect_list(F.struct("key", "field")).alias("entries"), F.min("file").alias("a"), F.max("file").alias("b"))
    who = F.concat_ws("/", "family", "name")
    keys = F.transform("entries", lambda e: e["key"])
    fault = F.when(F.col("a") != F.col("b"), F.concat(F.lit("two descriptions of "), who)).when(
        F.size(F.array_distinct(keys)) < F.size(keys), F.concat(F.lit("a key twice in the description of "), who)
    )
    return found.select("family", "name", F.when(fault.isNotNull(), F.raise_error(fault).cast("map<string,string>")).otherwise(F.map_from_entries("entries")).alias("fields"))
