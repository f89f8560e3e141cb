"""GFF3 and GTF lines, FASTA, and the small annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from footprints.functions import stats
from footprints.operators import intervals
from footprints.sources import lines as L


def _last_of_each(entries: Column) -> Column:
    """Entries whose key does not come again: as in a dictionary, the last one counts."""
    return F.filter(
        entries, lambda x, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries) - i - 1, F.lit(0))), lambda y: y["key"] == x["key"])
    )


def gff_attributes(text: Column) -> Column:
    """Map of ``k=v;`` attributes, values URL-decoded and without surrounding quotes."""
    fields = F.filter(F.split(text, ";"), lambda f: f.contains("="))
    # The decoder would take a plus for a blank.
    value = lambda f: F.url_decode(F.replace(F.substring_index(f, "=", -1), F.lit("+"), F.lit("%2B")))
    entries = F.transform(fields, lambda f: F.struct(F.substring_index(f, "=", 1).alias("key"), F.regexp_replace(value(f), '^"+|"+$', "").alias("value")))
    empty = F.create_map().cast("map<string,string>")
    return F.when(text == ".", empty).otherwise(F.map_from_entries(_last_of_each(entries)))


def gtf_attributes(text: Column) -> Column:
    """Map of ``name "value"; `` attributes."""
    pattern = r'([^\s;]+) +"?([^";]*)"?'
    keys, values = (F.regexp_extract_all(text, F.lit(pattern), F.lit(i)) for i in (1, 2))
    entries = F.zip_with(keys, values, lambda k, v: F.struct(k.alias("key"), v.alias("value")))
    empty = F.create_map().cast("map<string,string>")
    return F.when(text == ".", empty).otherwise(F.map_from_entries(_last_of_each(entries)))


def _quoted(text: Column) -> Column:
    """Percent-encoding of everything but letters, digits and ``_.-``."""
    return F.replace(F.replace(F.url_encode(text), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def unparse_attributes(attributes: Column) -> Column:
    """``k=v`` entries sorted by key and joined by ``;``."""
    entries = F.array_sort(F.map_entries(attributes))
    return F.array_join(F.transform(entries, lambda e: F.concat(_quoted(e["key"]), F.lit("="), _quoted(e["value"]))), ";")


def parse_features(lines: DataFrame, attributes=gff_attributes) -> DataFrame:
    """Features of annotation lines (``value``): 0-based inclusive coordinates, frame null where it is ``.``."""
    f = F.split(F.regexp_replace("value", r"\s+$", ""), "\t")
    at = lambda i: F.get(f, F.lit(i))
    return lines.where(~F.col("value").startswith("#") & (F.length(F.trim("value")) > 0)).select(
        at(0).alias("seqname"), at(1).alias("source"), at(2).alias("feature"), (at(3).cast("bigint") - 1).alias("start"), (at(4).cast("bigint") - 1).alias("end"),
        at(5).alias("score"), at(6).alias("strand"), at(7).try_cast("int").alias("frame"), attributes(at(8)).alias("attributes"),
    )


def with_family(features: DataFrame) -> DataFrame:
    """Adds id, parent_id and orf_classification; a feature without an ID gets one from its place."""
    a = F.col("attributes")
    place = F.concat_ws(":", F.coalesce(a["Parent"], F.lit("top")), "feature", "seqname", "start", "end", "strand")
    return features.withColumn("id", F.coalesce(a["ID"], place)).withColumn("parent_id", a["Parent"]).withColumn("orf_classification", a["orf_classification"])


def read_gff(spark: SparkSession, path: str) -> DataFrame:
    """Features of GFF3 files up to their ##FASTA section."""
    return with_family(parse_features(L.up_to(L.numbered_lines(spark, path), "##FASTA")))


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    return parse_features(spark.read.text(path), gtf_attributes)


def to_gff_lines(features: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Lines (``value``) of features, 1-based, attributes sorted and quoted; the columns ``keep`` stay beside them."""
    frame = F.coalesce(F.col("frame").cast("string"), F.lit("."))
    return features.select(
        *keep,
        F.concat_ws("\t", "seqname", "source", "feature", F.col("start") + 1, F.col("end") + 1, "score", "strand", frame, unparse_attributes(F.col("attributes"))).alias("value"),
    )


def read_fasta(spark: SparkSession, path: str, chunk_width: int = 1 << 14) -> DataFrame:
    """(seqname, chunk, seq): FASTA files cut into chunks of equal width, whatever their line width.

    Bases are counted per input split and carried over one row per split, so long sequences are read by many tasks.
    """
    lines = L.read_lines(spark, path).withColumn("header", F.col("value").startswith(">"))
    size = F.when(F.col("header"), 0).otherwise(F.length(F.trim("value")))
    sized = lines.withColumn("size", size.cast("bigint")).withColumn("at", F.struct("block", "idx"))
    placed = stats.running_sum(sized, ["file"], "at", {"upto": "size"}, F.col("block"))
    heads = placed.where("header").select("file", F.regexp_extract("value", r"^>\s*(\S*)", 1).alias("seqname"), F.col("upto").alias("seq_from"))
    from pyspark.sql import Window

    nexts = F.lead("seq_from").over(Window.partitionBy("file").orderBy("seq_from", "seqname"))
    spans = heads.select("file", "seqname", "seq_from", (F.coalesce(nexts, F.lit(1 << 60)) - 1).alias("seq_to")).where("seq_to >= seq_from")
    # Sequences are joined by the bases ahead of a line; an open end is closed by the file's total.
    totals = placed.groupBy("file").agg(F.max("upto").alias("_total"))
    spans = spans.join(totals, "file").select("file", "seqname", "seq_from", F.least("seq_to", F.col("_total")).alias("seq_to"))
    body = placed.where(~F.col("header") & (F.col("size") > 0)).select("file", (F.col("upto") - F.col("size")).alias("from"), F.trim("value").alias("text"), "size")
    joined = intervals.point_join(body, spans, ["file"], "from", ("seq_from", "seq_to"), 1 << 20).withColumn("p", F.col("from") - F.col("seq_from"))
    cut = joined.withColumn("chunk", F.explode(F.sequence(F.floor(F.col("p") / chunk_width), F.floor((F.col("p") + F.col("size") - 1) / chunk_width))))
    lo = F.greatest(F.col("p"), F.col("chunk") * chunk_width)
    hi = F.least(F.col("p") + F.col("size"), (F.col("chunk") + 1) * chunk_width)
    piece = F.substr(F.col("text"), (lo - F.col("p") + 1).cast("int"), (hi - lo).cast("int"))
    parts = cut.select("seqname", "chunk", F.struct(lo.alias("lo"), piece.alias("piece")).alias("x"))
    return parts.groupBy("seqname", "chunk").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["piece"]), "").alias("seq"))


def read_names(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("gene")).where("gene <> ''")


def read_trna(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The blank-separated weight files: codon, amino acid, copy number, wobble; codon, anticodon, tAI; or six columns."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    at = lambda i: F.get(f, F.lit(i))
    if kind in ("copy number", "wobble"):
        return rows.select(at(0).alias("codon"), at(2).cast("int").alias("copy_number"), at(3).cast("double").alias("wobble"))
    return rows.select(at(0).alias("codon"), at(2 if kind == "tAI" else 5).cast("double").alias("tai"))


def parse_table(lines: DataFrame, columns: list[str]) -> DataFrame:
    """Tab-separated cells of (value) as strings under the given names."""
    f = F.split("value", "\t", -1)
    return lines.select(*[F.get(f, F.lit(i)).alias(c) for i, c in enumerate(columns)])


def maybe_int(cell: Column) -> Column:
    return cell.try_cast("bigint")


def read_table(spark: SparkSession, path: str, skip: int, columns: list[str]) -> DataFrame:
    """A tab-separated table behind ``skip`` header lines (title lines and labels)."""
    return parse_table(L.numbered_lines(spark, path).where(F.col("line") >= skip), columns)
