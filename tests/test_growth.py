"""Large tables: what is never sent to the driver, and keys far from zero."""

import re

from pyspark.sql import functions as F

from footprints import constants as C
from footprints.operators import coords, counts, features as X, qc, reads as R
from footprints.queries import registry
from footprints.queries.inputs import Inputs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def parts(spark, folder, keys):
    spark.createDataFrame([(k, 10) for k in keys], "p_partkey bigint, p_size int").write.mode("overwrite").parquet(f"{folder}/part.parquet")
    return Inputs(spark, str(folder))


def stored(df, folder, name):
    """From files, whose small size Spark knows."""
    df.write.mode("overwrite").parquet(f"{folder}/{name}")
    return df.sparkSession.read.parquet(f"{folder}/{name}")


def small_genome(spark, folder):
    return stored(spark.createDataFrame([("c", k, "ACGTTGCA" * 10) for k in range(6)], "seqname string, chunk bigint, seq string"), folder, "genome")


def test_genome_is_not_sent_to_the_driver(spark, tmp_path):
    genes = spark.createDataFrame([("g", "c", "+", 100, 159, 5, 35, 60)], "gene string, seqname string, strand string, start bigint, end bigint, start_codon_t int, stop_codon_t int, transcript_length int")
    exons = spark.createDataFrame([("g", 100, 159)], "gene string, start bigint, end bigint")
    models = coords.transcript_models(stored(genes, tmp_path, "genes"), stored(exons, tmp_path, "exons"))
    found = coords.transcript_sequences(models, small_genome(spark, tmp_path), 80, 10, 10)
    assert "BroadcastExchange" not in plan(found)
    assert [r.sequence for r in found.collect()] == [("ACGTTGCA" * 60)[90:170]]


def test_bases_under_reads_are_not_sent_to_the_driver(spark, tmp_path):
    rows = spark.createDataFrame([("c", 78, 83), ("c", 475, 482)], "seqname string, a bigint, b bigint")
    found = coords.bases_at(rows, small_genome(spark, tmp_path), 80, F.array(F.struct("a", "b")), "x")
    assert "BroadcastExchange" not in plan(found)
    assert {r.a: r.x for r in found.collect()} == {78: "CAACGT", 475: "TTGCA---"}


def test_genome_of_far_positions(spark, tmp_path):
    keys = [0, 9, 5_000_003, 7_200_000_004]
    got = {(r.seqname, r.chunk): r.seq for r in parts(spark, tmp_path, keys).genome.collect()}
    base = lambda p, s: C.BASES[(p * p * 31 + p * 2654435 + s * 97) % 1009 % 4]
    assert got == {(k % 5, k // 5): "".join(base(k // 5 * 600 + i, k % 5) for i in range(600)) for k in keys}


def test_genome_is_made_by_many_tasks(spark, tmp_path):
    genome = parts(spark, tmp_path, range(100)).genome
    assert re.search(r"Exchange hashpartitioning\(p_partkey#\d+L, 4\), REPARTITION_BY_NUM", plan(genome))


def test_rows_of_fragments_do_not_carry_the_document(spark, tmp_path):
    rows = [(1, "a", "Hello, " * 40), (2, "b", ""), (3, None, None), (4, "b", "x"), (None, "c", "lost")]
    spark.createDataFrame(rows, "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    t = Inputs(spark, str(tmp_path))
    marked = R.synthetic_overlaps(t.reads, ["A" * 50])
    waiting = re.search(r"ArrowEvalPython.*\n(?:.*\n)*?.*Generate posexplode.*?, \[(.*?)\], false, \[i#\d+, frag#\d+\]", plan(marked))
    assert waiting and "base" not in waiting[1]
    got = {(r.doc_id, r.i): (r.source, r.frag) for r in t.fragments.collect()}
    base = ("HELLO" * 40).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "TCAGTCAGTCAGTCAGTCAGTCAGTC"))
    assert got == {(1, k): ("a", base[9 * k : 9 * k + 9]) for k in range(23)} | {(4, 0): ("b", "G")}


def test_families_are_not_sent_to_the_driver(spark, tmp_path):
    columns = "seqname string, feature string, id string, parent_id string, start bigint, end bigint, strand string, orf_classification string"
    rows = [("c", "gene", "g", None, 1, 9, "+", None), ("c", "mRNA", "m", "g", 1, 9, "+", None), ("c", "exon", "e", "m", 1, 9, "+", None), ("c", "gene", "h", None, 20, 30, "+", None)]
    features = stored(spark.createDataFrame(rows, columns), tmp_path, "features")
    found = X.gene_features(features)
    assert "BroadcastExchange" not in plan(found)
    assert [(r.id, r.has_cds) for r in found.collect()] == [("g", False)]


def test_bins_of_shapes_are_sized_once_from_the_reads(spark, tmp_path):
    # Hits hold one shuffle of shapes: the sizes of bins come from the reads, and were written.
    spark.range(3).select(
        F.lit("c").alias("seqname"), F.col("id").alias("pos"), (F.col("id") + 10).alias("aend"), F.lit("s").alias("sample"), F.lit("+").alias("strand"), F.lit(50).alias("mapq"),
        F.lit(False).alias("is_secondary"), F.lit(10).alias("qlen"), F.lit(0).alias("nongenomic_length"), F.array(F.struct(F.lit(0).alias("op"), F.lit(10).alias("len"))).alias("cigar"),
    ).write.parquet(f"{tmp_path}/reads")
    models = spark.createDataFrame([("g", "c", "+", 5, 59, 0, 30, 55, [(5, 59, 0)])], "gene string, seqname string, strand string, start bigint, end bigint, start_codon_t int, stop_codon_t int, transcript_length int, exons array<struct<start bigint, end bigint, t0 bigint>>")
    hits = counts.transcript_hits(spark.read.parquet(f"{tmp_path}/reads"), models, 5, 5)
    assert plan(hits).count("FileScan parquet") == 1
    assert sorted(r.five_t for r in hits.collect()) == [-5, -4, -3]


def test_large_tables_are_not_dealt_out(spark, tmp_path, monkeypatch):
    t = parts(spark, tmp_path, range(10))
    assert "REPARTITION_BY_COL" in plan(t.dealt("part", ["p_partkey"], "p_partkey"))
    monkeypatch.setattr(registry, "MANY_ROW_GROUPS", 1)
    kept = t.dealt("part", ["p_partkey"], "p_partkey")
    assert "Exchange" not in plan(kept) and sorted(r.p_partkey for r in kept.collect()) == list(range(10))


def test_zero_padded_reads_its_histogram_once(spark, tmp_path):
    h = stored(spark.createDataFrame([("s", "trimmed", 1, 5)], "sample string, category string, length int, n bigint"), tmp_path, "histogram")
    most = spark.createDataFrame([("s", 2)], "sample string, max_length int")
    padded = qc.zero_padded(h, most)
    assert "FileScan" not in plan(padded)
    assert sorted((r.length, r.n) for r in padded.collect()) == [(0, 0), (1, 5), (2, 0)]
