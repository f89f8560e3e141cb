import gzip

import pytest
from pyspark.sql import functions as F

from footprints.operators import reads as R
from footprints.sources import alignments as A, annotation as N, fastq as Q, lines as L, tables as T


def fastq_text(n):
    # Qualities start with @ and + now and then, which must not be taken for headers.
    return "".join(f"@r{i} extra\n{'ACGT' * (1 + i % 5)}\n+\n{('@+I' [i % 3]) + 'I' * (4 * (1 + i % 5) - 1)}\n" for i in range(n))


def test_fastq_records_survive_any_split(spark, tmp_path):
    (tmp_path / "a_1.fastq").write_text(fastq_text(50))
    (tmp_path / "b_1.fq").write_text(fastq_text(7).rstrip("\n"))
    with gzip.open(tmp_path / "c_1.fastq.gz", "wt") as f:
        f.write(fastq_text(9))
    for size in (1, 17, 64, 1000, 1 << 20):
        reads = Q.read_fastq(spark, str(tmp_path), size)
        per_file = {r.file.rsplit("/", 1)[1]: r.n for r in Q.reads_per_file(reads).collect()}
        assert per_file == {"a_1.fastq": 50, "b_1.fq": 7, "c_1.fastq.gz": 9}
        ok = reads.where((F.length("seq") == F.length("qual")) & F.col("read_id").rlike("^r[0-9]+$"))
        assert ok.count() == 66
    assert reads.select(Q.mate_number().alias("m")).distinct().first().m == "1"


def test_pairs_and_orphans(spark):
    schema = "sample string, read_id string, seq string, qual string"
    first = spark.createDataFrame([("s", "x/1", "A", "I"), ("s", "y/1", "C", "I")], schema)
    second = spark.createDataFrame([("s", "x/2", "G", "I"), ("s", "z/2", "T", "I")], schema)
    same = spark.createDataFrame([("s", "x/2", "G", "I"), ("s", "y/2", "T", "I")], schema)
    assert sorted((r.pair_id, r.r1_seq, r.r2_seq) for r in R.pair_up(first, same).collect()) == [("x", "A", "G"), ("y", "C", "T")]
    with pytest.raises(Exception, match="no mate for"):
        R.pair_up(first, second).collect()
    assert sorted((r.pair_id, r.mate) for r in R.unpaired(first, second).collect()) == [("y", 1), ("z", 2)]


def test_malformed_fastq_raises(spark, tmp_path):
    whole = fastq_text(6)
    bad = {
        "no quality": whole + "@r\nACGT\n+\n", "no plus": whole + "@r\nACGT\n", "short quality": whole + "@r\nACGT\n+\nII\n",
        "no header": "r\nACGT\n+\nIIII\n" + whole, "not FASTQ": "ACGT\n" * 40,
    }
    for i, text in enumerate(bad.values()):
        for name in (f"bad{i}.fastq", f"bad{i}.fastq.gz"):
            folder = tmp_path / name.replace(".", "_")
            folder.mkdir()
            with (gzip.open if name.endswith("gz") else open)(folder / name, "wt") as f:
                f.write(text)
            for size in (50, 1 << 20):
                with pytest.raises(Exception, match="no whole FASTQ record"):
                    Q.read_fastq(spark, str(folder), size).collect()


def test_mate_files(spark, tmp_path):
    for name in ("a_1.fastq", "a_2.fastq", "b1.fq"):
        (tmp_path / name).write_text(fastq_text(3))
    with pytest.raises(ValueError, match="without a mate: b"):
        Q.read_mates(spark, str(tmp_path))
    (tmp_path / "b2.fq").write_text(fastq_text(3))
    first, second = Q.read_mates(spark, str(tmp_path))
    assert sorted((r.sample, r.pair_id) for r in R.pair_up(first, second).collect()) == [(s, f"r{i}") for s in ("a_", "b") for i in range(3)]


def test_mates_are_found_within_their_folder(spark, tmp_path):
    for name, n in (("A/R1.fastq", 2), ("A/R2.fastq", 2), ("B/R1.fastq", 3), ("B/deep/x_1.fq", 1), ("B/deep/x_2.fq", 1)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(fastq_text(n))
    # The second file of B is missing; that of A is no stand-in.
    with pytest.raises(ValueError, match="without a mate: B/R$"):
        Q.read_mates(spark, str(tmp_path))
    (tmp_path / "B/R2.fastq").write_text(fastq_text(3))
    for root in (str(tmp_path), f"{tmp_path}/", f"file://{tmp_path}"):
        first, second = Q.read_mates(spark, root)
        pairs = sorted((r.sample, r.pair_id) for r in R.pair_up(first, second).collect())
        assert pairs == [("A/R", "r0"), ("A/R", "r1"), ("B/R", "r0"), ("B/R", "r1"), ("B/R", "r2"), ("B/deep/x_", "r0")]


def test_long_alignments_are_found_in_their_region(spark, tmp_path):
    df = spark.createDataFrame([("c", 100, 10100), ("c", 5500, 5600), ("c", 7000, 7100), ("d", 0, 90000)], "seqname string, pos long, aend long").withColumn("strand", F.lit("+"))
    A.write_sorted(df, str(tmp_path / "sorted"))
    assert sorted(r.pos for r in A.read_region(spark, str(tmp_path / "sorted"), "c", 5000, 6000).collect()) == [100, 5500]


def test_quality_offsets(spark):
    df = spark.createDataFrame([("a", "r", "AC", "hB"), ("b", "r", "AC", "I#"), ("good", "r", "AC", "II"), ("good", "s", "AC", ";J")], "file string, read_id string, seq string, qual string")
    fixed = sorted((r.file, r.qual) for r in Q.to_sanger(df, Q.quality_offsets(df)).collect())
    # A file of good qualities only stays as it is.
    assert fixed == [("a", "I#"), ("b", "I#"), ("good", ";J"), ("good", "II")]


GFF = """##gff-version 3
chrI\tSGD\tgene\t11\t40\t.\t+\t.\tID=G1;Note=a%20%22b%22+c;orf_classification=Verified
# a comment
chrI\tSGD\tmRNA\t11\t40\t.\t+\t.\tID=M1;Parent=G1
chrI\tSGD\tCDS\t14\t40\t.\t+\t0\tParent=M1;Name="n"
##FASTA
>chrI
ACGT
"""


def test_gff_file(spark, tmp_path):
    path = tmp_path / "x.gff"
    path.write_text(GFF)
    rows = {r.feature: r for r in N.read_gff(spark, str(path)).collect()}
    assert set(rows) == {"gene", "mRNA", "CDS"}
    assert (rows["gene"].start, rows["gene"].end) == (10, 39) and rows["gene"].attributes["Note"] == 'a "b"+c'
    assert rows["CDS"].frame == 0 and rows["CDS"].attributes["Name"] == "n" and rows["CDS"].id == "M1:CDS:chrI:13:39:+"
    assert rows["gene"].frame is None and rows["mRNA"].parent_id == "G1" and rows["gene"].orf_classification == "Verified"


def test_line_numbers_over_several_splits(spark, tmp_path):
    path = tmp_path / "n.txt"
    path.write_text("".join(f"line{i}\n" for i in range(500)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "512")
    try:
        got = L.numbered_lines(spark, str(path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert sorted((r.line, r.value) for r in got) == [(i, f"line{i}") for i in range(500)]


def test_fasta_over_several_splits(spark, tmp_path):
    one, two = "ACGTTGCA" * 40, "GGCC" * 9
    path = tmp_path / "g.fa"
    path.write_text(">one text\n" + "".join(one[i : i + 7] + "\n" for i in range(0, len(one), 7)) + ">two\n" + two + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
    try:
        got = N.read_fasta(spark, str(path), 50).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    for name, text in (("one", one), ("two", two)):
        chunks = sorted((r.chunk, r.seq) for r in got if r.seqname == name)
        assert "".join(s for _, s in chunks) == text and all(len(s) == 50 for _, s in chunks[:-1])


def test_sam_fields(spark):
    lines = spark.createDataFrame([("@SQ\tSN:c\tLN:9",), ("q\t272\tc\t11\t3\t5M2N4M1S\t*\t0\t0\tACGTACGTAC\tIIIIIIIIII\tNM:i:1\tZN:i:4",), ("u\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII",)], "value string")
    rows = {r.qname: r for r in A.parse_sam(lines).collect()}
    q = rows["q"]
    assert (q.pos, q.aend, q.strand, q.is_secondary, q.qlen, q.nongenomic_length, q.nm) == (10, 21, "-", True, 9, 4, 1)
    assert rows["u"].is_unmapped and rows["u"].nongenomic_length == 0 and rows["u"].qlen == 0


def test_small_tables(spark, tmp_path):
    (tmp_path / "names.txt").write_text("a\n b \n\n")
    assert sorted(r.gene for r in N.read_names(spark, str(tmp_path / "names.txt")).collect()) == ["a", "b"]
    (tmp_path / "trna.txt").write_text("AAA K 4 0.5\nCCC P 2 1\n")
    from footprints.operators import dimensions

    weights = dimensions.trna_weights(N.read_trna(spark, str(tmp_path / "trna.txt"), "wobble"), "wobble")
    assert {r.codon: r.weight for r in weights.collect()} == {"AAA": 0.5, "CCC": 0.5}
    (tmp_path / "t.tsv").write_text("title\nmore\nname\tstart\ng1\t5\ng2\t\n")
    table = N.read_table(spark, str(tmp_path / "t.tsv"), 3, ["gene", "start"]).withColumn("start", N.maybe_int(F.col("start")))
    assert {r.gene: r.start for r in table.collect()} == {"g1": 5, "g2": None}


def test_position_store_prunes_keys(spark, tmp_path):
    df = spark.createDataFrame([("s", "g", "five", "all", 1, 2), ("s", "g", "five", "28", 1, 1)], "sample string, gene string, read_end string, key string, pos bigint, n bigint")
    T.write_positions(df, str(tmp_path / "p"))
    some = T.read_positions(spark, str(tmp_path / "p"), ["28"])
    assert [(r.key, r.n) for r in some.collect()] == [("28", 1)]
    assert "PartitionFilters" in some._jdf.queryExecution().executedPlan().toString()


def test_upsert_replaces_only_its_category(spark, tmp_path):
    path = str(tmp_path / "h")
    df = spark.createDataFrame([("s", "a", 1, 5), ("s", "b", 1, 6)], "sample string, category string, length int, n bigint")
    T.upsert(df, path, ["category"])
    T.upsert(spark.createDataFrame([("s", "b", 2, 9)], df.schema), path, ["category"])
    assert sorted((r.category, r.length, r.n) for r in spark.read.parquet(path).collect()) == [("a", 1, 5), ("b", 2, 9)]
