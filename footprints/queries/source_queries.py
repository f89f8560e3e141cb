"""Queries on sources and sinks (S1-S18). Those that write use a new folder in the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from footprints.functions import cigar as G
from footprints.operators import algebra, coords, counts, dimensions, reads as R
from footprints.queries import boundary_queries, compare_queries, counting, inputs, read_queries
from footprints.queries.registry import query
from footprints.session import cut_lineage, shared_folder
from footprints.sources import alignments as A, annotation as N, exports as X, fastq as Q, tables as T


def folder(t, name):
    return f"{shared_folder(t.spark)}/{name}-{uuid.uuid4().hex}"


@query("S1_fastq_scan", "SELECT split_part(read_id, ':', 1) AS document, count(*) AS n, CAST(sum(length(seq)) AS BIGINT) AS bases, min(qual) AS first_qual FROM reads GROUP BY ALL")
def _(t):
    path = folder(t, "reads")
    Q.write_fastq(t.reads, path)
    reads = Q.read_fastq(t.spark, path, 1 << 22)
    return reads.groupBy(F.split("read_id", ":")[0].alias("document")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.length("seq")).alias("bases"), F.min("qual").alias("first_qual")
    )


@query("S2_paired_fastq_scan", "SELECT sample, pair_id, r1_seq, r2_seq FROM read_pairs")
def _(t):
    pairs = read_queries.read_pairs(t)
    path = folder(t, "pairs")
    for mate in (1, 2):
        named = pairs.select(F.concat("sample", F.lit("|"), "pair_id", F.lit(f"/{mate}")).alias("read_id"), F.col(f"r{mate}_seq").alias("seq"), F.col(f"r{mate}_qual").alias("qual"))
        Q.write_fastq(named, f"{path}/R{mate}")
    # Both mates of one file pair; the sample is part of the read names here.
    first, second = (
        reads.select(F.split("read_id", r"\|")[0].alias("sample"), F.split("read_id", r"\|")[1].alias("read_id"), "seq", "qual") for reads in Q.read_mates(t.spark, path, 1 << 22)
    )
    return R.pair_up(first, second).select("sample", "pair_id", "r1_seq", "r2_seq")


def feature_table(t):
    a = F.map_from_entries(F.filter(F.array(
        F.struct(F.lit("ID").alias("key"), F.col("id").alias("value")),
        F.when(F.col("parent_id").isNotNull(), F.struct(F.lit("Parent").alias("key"), F.col("parent_id").alias("value"))),
        F.struct(F.lit("Note").alias("key"), F.concat(F.lit("a b;c=+*"), F.col("start").cast("string")).alias("value")),
    ), lambda x: x.isNotNull()))
    return t.features.select(
        F.col("seqname").cast("string").alias("seqname"), F.lit("SGD").alias("source"), "feature", "start", "end", F.lit(".").alias("score"), "strand",
        F.when(F.col("feature") == "CDS", 0).alias("frame"), a.alias("attributes"),
    )


@query(
    "S3_S5_gff_round_trip",
    """
SELECT CAST(seqname AS VARCHAR) AS seqname, feature, "start", "end", strand, CASE WHEN feature = 'CDS' THEN 0 END AS frame, id, parent_id, 'a b;c=+*' || "start" AS note FROM features""",
)
def _(t):
    path = folder(t, "features")
    X.write_gff(feature_table(t), path)
    back = N.read_gff(t.spark, path)
    return back.select("seqname", "feature", "start", "end", "strand", "frame", "id", "parent_id", F.col("attributes")["Note"].alias("note"))


@query(
    "S5_gff_lines",
    """
SELECT seqname || chr(9) || 'SGD' || chr(9) || feature || chr(9) || ("start" + 1) || chr(9) || ("end" + 1) || chr(9) || '.' || chr(9) || strand || chr(9) ||
  CASE WHEN feature = 'CDS' THEN '0' ELSE '.' END || chr(9) || 'ID=' || id || ';Note=a%20b%3Bc%3D%2B%2A' || "start" || COALESCE(';Parent=' || parent_id, '') AS value FROM features""",
)
def _(t):
    return N.to_gff_lines(feature_table(t))


@query(
    "S4_gtf_scan",
    """SELECT 's' || seqname AS seqname, feature, "start", "end", id AS transcript_id, 'x y' AS note, count(*) OVER () AS n FROM features""",
)
def _(t):
    text = F.concat(F.lit('transcript_id "'), "id", F.lit('"; gene_note "x y"; tag "a"; tag "b";'))
    lines = t.features.select(
        F.concat_ws("\t", F.concat(F.lit("s"), "seqname"), F.lit("src"), "feature", F.col("start") + 1, F.col("end") + 1, F.lit("."), "strand", F.lit("."), text).alias("value")
    )
    path = folder(t, "gtf")
    lines.write.text(path)
    f = N.read_gtf(t.spark, path)
    total = f.agg(F.count(F.lit(1)).alias("n"))
    return f.select("seqname", "feature", "start", "end", F.col("attributes")["transcript_id"].alias("transcript_id"), F.col("attributes")["gene_note"].alias("note")).crossJoin(F.broadcast(total))


@query(
    "S6_sam_round_trip",
    """
SELECT sample, qname, CAST(seqname AS VARCHAR) AS seqname, pos, aend, strand, mapq, is_secondary, is_unmapped, qlen, nongenomic_length, nm,
  CASE WHEN split THEN '10M30N' || (qlen - 10) || 'M' ELSE qlen || 'M' END AS cigar FROM alignments""",
)
def _(t):
    text = t.alignments.withColumn("seq", F.lit("*")).withColumn("qual", F.lit("*"))
    path = folder(t, "sam")
    X.write_sam(text, path)
    back = A.read_sam(t.spark, path)
    return back.select("sample", "qname", "seqname", "pos", "aend", "strand", "mapq", "is_secondary", "is_unmapped", "qlen", "nongenomic_length", "nm", G.unparse(F.col("cigar")).alias("cigar"))


@query(
    "S7_sorted_region_read",
    """
SELECT * FROM (SELECT sample, qname, pos, aend + CASE WHEN barcode = 3 THEN 4000 ELSE 0 END AS aend, strand FROM mapped WHERE seqname = 2) WHERE pos < 20000 AND aend > 9000""",
)
def _(t):
    path = folder(t, "sorted")
    # Some alignments span thousands of bases.
    A.write_sorted(t.mapped.drop("_order").withColumn("aend", F.col("aend") + F.when(F.col("barcode") == 3, 4000).otherwise(0)), path)
    return A.read_region(t.spark, path, 2, 9000, 20000).select("sample", "qname", "pos", "aend", "strand")


@query(
    "O2_grouped_by_position",
    "SELECT sample, seqname, pos, strand, count(*) AS n, 1 AS partitions FROM mapped GROUP BY ALL",
)
def _(t):
    placed = A.grouped_by_position(t.mapped).withColumn("part", F.spark_partition_id())
    return placed.groupBy("sample", "seqname", "pos", "strand").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("part").alias("partitions"))


@query(
    "S8_region_fetch",
    """
SELECT a.seqname, a.a, a.b, string_agg(COALESCE(base, '-'), '' ORDER BY a.p) AS seq FROM (SELECT *, unnest(range(a, b + 1)) AS p FROM (SELECT DISTINCT seqname, aend AS a, aend + nongenomic_length AS b FROM mapped)) a
LEFT JOIN genome_bases g ON g.seqname = a.seqname AND g.p = a.p GROUP BY a.seqname, a.a, a.b""",
)
def _(t):
    regions = t.mapped.select("seqname", F.col("aend").alias("a"), (F.col("aend") + F.col("nongenomic_length")).alias("b")).distinct()
    return coords.fetch_regions(regions, t.genome, inputs.GENOME_CHUNK)


@query(
    "S8_fasta_scan",
    """SELECT 's' || seqname AS seqname, p // 1000 AS chunk, string_agg(base, '' ORDER BY p) AS seq FROM genome_bases GROUP BY ALL""",
)
def _(t):
    path = folder(t, "genome")
    chunks = t.genome.select(
        "seqname", "chunk",
        F.concat(F.when(F.col("chunk") == 0, F.concat(F.lit(">s"), "seqname", F.lit(" text\n"))).otherwise(F.lit("")), F.substring("seq", 1, 251), F.lit("\n"), F.substring("seq", 252, 600)).alias("value"),
    )
    chunks.repartition("seqname").sortWithinPartitions("seqname", "chunk").select("value").write.text(path)
    return N.read_fasta(t.spark, path, 1000)


@query(
    "S10_trna_weights",
    """
SELECT kind, codon, round(weight, 6) AS weight FROM (SELECT 'copy number' AS kind, codon, 1.0 / n AS weight FROM (SELECT codon, count(*) AS n FROM codon_counts GROUP BY codon)
  UNION ALL SELECT 'wobble', codon, 1.0 / (n * 0.5) FROM (SELECT codon, count(*) AS n FROM codon_counts GROUP BY codon)
  UNION ALL SELECT 'tAI', codon, 1.0 / (n / 10.0) FROM (SELECT codon, count(*) AS n FROM codon_counts GROUP BY codon))""",
)
def _(t):
    raw = t.codon_counts.groupBy("codon").agg(F.count(F.lit(1)).alias("copy_number")).withColumn("wobble", F.lit(0.5)).withColumn("tai", F.col("copy_number") / 10.0)
    out = None
    for kind in ("copy number", "wobble", "tAI"):
        w = dimensions.trna_weights(raw, kind).select(F.lit(kind).alias("kind"), "codon", F.round("weight", 6).alias("weight"))
        out = w if out is None else out.unionByName(w)
    return out


@query(
    "S11_annotation_table",
    """SELECT 'g' || gene AS gene, strand, "start" AS tx_start, CASE WHEN gene % 3 = 0 THEN NULL ELSE "end" END AS tx_end FROM genes""",
)
def _(t):
    lines = t.genes.select(F.concat_ws("\t", F.concat(F.lit("g"), "gene"), "strand", "start", F.when(F.col("gene") % 3 == 0, "").otherwise(F.col("end").cast("string"))).alias("value"))
    path = folder(t, "annotation")
    lines.write.text(path)
    cells = N.read_table(t.spark, path, 0, ["gene", "strand", "tx_start", "tx_end"])
    return cells.select("gene", "strand", N.maybe_int(F.col("tx_start")).alias("tx_start"), N.maybe_int(F.col("tx_end")).alias("tx_end"))


@query(
    "S12_boundary_lines",
    boundary_queries._BOUNDARIES
    + """SELECT row_number() OVER (ORDER BY CAST(seqname AS VARCHAR), least(five_pos, three_pos), greatest(five_pos, three_pos), strand, CAST(gene AS VARCHAR)) - 1 AS line,
  CAST(gene AS VARCHAR) AS gene, CAST(seqname AS VARCHAR) AS seqname, strand, five_pos, three_pos FROM b""",
)
def _(t):
    path = folder(t, "boundaries")
    X.write_boundaries(boundary_queries.boundaries(t), path)
    return X.read_boundaries(t.spark, path)


_BY_NAME = "OVER (PARTITION BY sample ORDER BY CAST(gene AS VARCHAR)) - 1"


@query(
    "S13_codon_count_lines",
    f"SELECT sample, dense_rank() {_BY_NAME} AS line, CAST(gene AS VARCHAR) AS gene, CAST(codon_idx + 5 AS INTEGER) AS codon_idx, relaxed AS n FROM codon_counts",
)
def _(t):
    path = folder(t, "codons")
    X.write_codon_counts(t.codon_counts, path)
    return X.read_codon_counts(t.spark, path)


@query(
    "S14_expression_records",
    f"SELECT sample, row_number() {_BY_NAME} AS record, CAST(gene AS VARCHAR) AS gene, cds_length, n AS sense, 0 AS antisense FROM gene_counts",
)
def _(t):
    path = folder(t, "expression")
    X.write_expression(compare_queries.gene_counts(t), path)
    back = X.read_expression(t.spark, path)
    return back.select("sample", "record", "gene", "cds_length", F.col("counts")[0].alias("sense"), F.col("counts")[1].alias("antisense"))


@query(
    "S15_rpkm_lines",
    f"SELECT sample, row_number() {_BY_NAME} AS line, CAST(gene AS VARCHAR) AS gene, round(1e9 * n / cds_length / sum(n) OVER (PARTITION BY sample), 2) AS rpkm FROM gene_counts",
)
def _(t):
    path = folder(t, "rpkm")
    X.write_rpkms(counts.rpkm(compare_queries.gene_counts(t)), path)
    return X.read_rpkms(t.spark, path)


@query("S19_matrix_file", """SELECT row_number() OVER (ORDER BY CAST(gene AS VARCHAR)) AS line, CAST(gene AS VARCHAR) AS gene, * EXCLUDE (gene) FROM matrix""")
def _(t):
    path = folder(t, "matrix")
    samples = ["S0", "S1", "S2"]
    X.write_matrix(algebra.count_matrix(compare_queries.gene_counts(t), samples), path)
    return X.read_matrix(t.spark, path, samples)


@query("S16_position_store", "SELECT sample, gene, read_end, key, pos, n FROM position_counts WHERE key IN ('all', '28')")
def _(t):
    path = folder(t, "positions")
    T.write_positions(counting.position_counts(t), path)
    return T.read_positions(t.spark, path, ["all", "28"]).select("sample", "gene", "read_end", "key", "pos", "n")


@query(
    "S17_upsert_histogram",
    "SELECT sample, category, length, CASE WHEN category = 'trimmed' THEN n * 2 ELSE n END AS n FROM histogram",
)
def _(t):
    path = folder(t, "lengths")
    h = read_queries.histogram(t)
    T.upsert(h, path, ["category"])
    # What is read from the store is checkpointed before its partition is replaced.
    doubled = t.spark.read.parquet(path).where("category = 'trimmed'").withColumn("n", F.col("n") * 2)
    T.upsert(cut_lineage(doubled), path, ["category"])
    return t.spark.read.parquet(path).select("sample", "category", "length", "n")


@query("S18_sample_catalogue", "SELECT DISTINCT sample FROM histogram")
def _(t):
    path = folder(t, "catalogue")
    T.upsert(read_queries.histogram(t), path, ["sample"])
    return T.catalogue(t.spark, path)


@query(
    "S18_family_catalogue",
    """
SELECT source AS family, lang AS name, CAST(count(*) AS VARCHAR) AS documents, CAST(sum(n_chars) AS VARCHAR) AS characters, 'all of ' || lang AS note
FROM documents WHERE source IS NOT NULL AND lang IS NOT NULL GROUP BY ALL""",
)
def _(t):
    # One experiment for each source and language, described by a file in its folder.
    path = folder(t, "experiments")
    found = t.table("documents").where("source is not null and lang is not null").groupBy(F.col("source").alias("family"), F.col("lang").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("size")
    )
    text = F.concat(F.lit("# described here\ndocuments: "), "n", F.lit("\ncharacters "), "size", F.lit("\nnote: all of "), "name")
    found.select("family", "name", text.alias("value")).write.partitionBy("family", "name").text(path)
    back = X.read_descriptions(t.spark, path, "part-*")
    return back.select("family", "name", *[F.col("fields")[k].alias(k) for k in ("documents", "characters", "note")])
