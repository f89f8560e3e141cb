"""Ordered text exports, two-line records, descriptions of experiments, levels of span and value chunks."""

import glob
import os

import pytest
from pyspark.sql import functions as F

from footprints.functions import stats
from footprints.sources import alignments as A, annotation as N, exports as X


def text_of(folder):
    """The lines of a folder's files in the order of their names."""
    return [line for path in sorted(glob.glob(f"{folder}/part-*")) for line in open(path).read().splitlines()]


@pytest.fixture
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "256")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


@pytest.fixture
def uncoalesced(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_files_are_in_order_with_one_header(spark, tmp_path, small_splits, uncoalesced):
    n = 400
    lines = spark.range(n).repartition(7).select((F.col("id") * 37 % n).alias("k"), F.concat(F.lit("v"), F.col("id") * 37 % n).alias("value"))
    X.write_ordered(lines, str(tmp_path / "o"), [F.col("k")], header="# head")
    assert len(glob.glob(str(tmp_path / "o/part-*"))) > 1
    assert text_of(tmp_path / "o") == ["# head"] + [f"v{i}" for i in range(n)]
    back = {r.line: r.value for r in X.read_ordered(spark, str(tmp_path / "o")).collect()}
    assert back == dict(enumerate(["# head"] + [f"v{i}" for i in range(n)]))


def test_folders_are_ordered_each_in_itself(spark, tmp_path, small_splits, uncoalesced):
    # A sample holds most of the lines; names that look like numbers stay text, a null name is a folder too.
    rows = [("01" if i % 5 else ("b" if i % 2 else None), f"g{i:03}") for i in range(300)]
    df = spark.createDataFrame(rows, "sample string, value string").repartition(5)
    X.write_ordered(df, str(tmp_path / "o"), [F.col("value")], ["sample"], "head")
    want = {}
    for sample, value in sorted(rows, key=lambda r: r[1]):
        want.setdefault(sample, ["head"]).append(value)
    assert text_of(tmp_path / "o/sample=01") == want["01"]
    got = {}
    for r in sorted(X.read_ordered(spark, str(tmp_path / "o"), ["sample"]).collect(), key=lambda r: r.line):
        got.setdefault(r.sample, []).append(r.value)
    assert got == want


def test_empty_export(spark, tmp_path):
    X.write_ordered(spark.createDataFrame([], "value string"), str(tmp_path / "o"), [F.col("value")], header="h")
    assert [(r.line, r.value) for r in X.read_ordered(spark, str(tmp_path / "o")).collect()] == [(0, "h")]


def test_expression_records_over_splits(spark, tmp_path, small_splits, uncoalesced):
    df = spark.createDataFrame([(s, f"gene{i}", 100 + i, i * 3) for s in ("a", "b") for i in range(60)], "sample string, gene string, cds_length int, n bigint")
    X.write_expression(df, str(tmp_path / "e"))
    back = X.read_expression(spark, str(tmp_path / "e")).collect()
    assert sorted((r.sample, r.gene, r.cds_length, r.counts) for r in back) == sorted((s, f"gene{i}", 100 + i, [i * 3, 0]) for s in ("a", "b") for i in range(60))
    names = sorted(f"gene{i}" for i in range(60))
    assert all(names[r.record] == r.gene for r in back)
    os.makedirs(tmp_path / "broken/sample=a")
    (tmp_path / "broken/sample=a/part-0.txt").write_text("g\t5\n1 2\nh\t6\n")
    with pytest.raises(Exception, match="without its line of counts: h"):
        X.read_expression(spark, str(tmp_path / "broken")).collect()


def test_matrix_columns_are_found_by_name(spark, tmp_path):
    df = spark.createDataFrame([("b", 9, 1, None), ("a", 8, None, 4)], "gene string, cds_length int, s1 bigint, s2 bigint")
    X.write_matrix(df, str(tmp_path / "m"))
    assert text_of(tmp_path / "m") == ["gene\tcds_length\ts1\ts2", "a\t8\t\t4", "b\t9\t1\t"]
    back = X.read_matrix(spark, str(tmp_path / "m"), ["s2", "s1"])
    assert sorted((r.line, r.gene, r.cds_length, r.s1, r.s2) for r in back.collect()) == [(1, "a", 8, None, 4), (2, "b", 9, 1, None)]
    with pytest.raises(ValueError, match="no column s3"):
        X.read_matrix(spark, str(tmp_path / "m"), ["s3"])


def test_gff_and_sam_files(spark, tmp_path):
    features = spark.createDataFrame([("c", "x", "gene", 50, 90, ".", "+", None, {"ID": "b"}), ("c", "x", "gene", 5, 9, ".", "-", None, {"ID": "a"})], "seqname string, source string, feature string, start long, end long, score string, strand string, frame int, attributes map<string,string>")
    X.write_gff(features, str(tmp_path / "g"))
    assert [line.split("\t")[-1] for line in text_of(tmp_path / "g")] == ["##gff-version 3", "ID=a", "ID=b"]
    assert sorted((r.id, r.start, r.end) for r in N.read_gff(spark, str(tmp_path / "g")).collect()) == [("a", 5, 9), ("b", 50, 90)]
    sam = spark.createDataFrame([("q\t0\tc\t11\t3\t5M\t*\t0\t0\tACGTA\tIIIII\tNM:i:1\tZN:i:4", "s"), ("p\t0\tc\t7\t3\t5M\t*\t0\t0\tACGTA\tIIIII\tNM:i:1\tZN:i:4", "s")], "value string, sample string")
    X.write_sam(A.parse_sam(sam), str(tmp_path / "s"))
    assert [line.split("\t")[0] for line in text_of(tmp_path / "s/sample=s")] == ["@HD", "p", "q"]
    assert sorted((r.sample, r.qname, r.pos) for r in A.read_sam(spark, str(tmp_path / "s")).collect()) == [("s", "p", 6), ("s", "q", 10)]


def test_descriptions(spark, tmp_path):
    files = {"one/x/job": "a: 1\n# no\n\nb  two words\n", "one/y": "a 2\n", "family=two/name=x%20y/job": "a:3\n"}
    for folder, text in files.items():
        os.makedirs(tmp_path / "r" / folder)
        (tmp_path / "r" / folder / "description.txt").write_text(text)
    (tmp_path / "r/one/other.txt").write_text("a 9\n")
    got = {(r.family, r.name): r.fields for r in X.read_descriptions(spark, str(tmp_path / "r")).collect()}
    assert got == {("one", "x"): {"a": "1", "b": "two words"}, ("one", "y"): {"a": "2"}, ("two", "x y"): {"a": "3"}}
    (tmp_path / "r/one/x/description.txt").write_text("a 1\n")
    with pytest.raises(Exception, match="two descriptions of one/x"):
        X.read_descriptions(spark, str(tmp_path / "r")).collect()
    (tmp_path / "q/f/n").mkdir(parents=True)
    (tmp_path / "q/f/n/description.txt").write_text("a 1\na 2\n")
    with pytest.raises(Exception, match="a key twice in the description of f/n"):
        X.read_descriptions(spark, str(tmp_path / "q")).collect()


def test_a_long_span_does_not_widen_the_scan(spark, tmp_path):
    import pyarrow.parquet as pq

    short = spark.range(4000).select(F.lit("c").alias("seqname"), (F.col("id") * 500).alias("pos"), (F.col("id") * 500 + 30).alias("aend"), F.lit("+").alias("strand"), F.col("id").cast("string").alias("qname"))
    long = spark.createDataFrame([("c", 0, 1_000_000, "+", "long"), ("c", 0, 1 << 60, "+", "longest"), ("c", 7, None, "+", "none")], "seqname string, pos long, aend long, strand string, qname string")

    def touched(path):
        """Files whose bounds of level and position could hold what the filter asks for; pyarrow reads the same footers."""
        n = 0
        for name in glob.glob(f"{path}/*.parquet"):
            meta = pq.read_metadata(name)
            for g in range(meta.num_row_groups):
                stats_of = {meta.row_group(g).column(i).path_in_schema: meta.row_group(g).column(i).statistics for i in range(meta.num_columns)}
                level, pos = stats_of["span_level"], stats_of["pos"]
                n += level.min == 0 and pos.max > 1_000_000 - A.FINEST and pos.min < 1_001_000
        return n

    for name, df in (("plain", short), ("mixed", short.unionByName(long))):
        A.write_sorted(df, str(tmp_path / name), 8)
    region = A.read_region(spark, str(tmp_path / "mixed"), "c", 999_000, 1_001_000)
    assert sorted(r.qname for r in region.collect()) == sorted(["long", "longest"] + [str(i) for i in range(1998, 2002)])
    assert "span_level" not in region.columns
    plan = region._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in plan and "span_level" in plan.split("PushedFilters")[1]
    assert touched(tmp_path / "mixed") == touched(tmp_path / "plain") <= 2


def test_value_chunks_are_even_wherever_values_lie(spark):
    # All values between 1.00 and 1.01 but a few; a fixed grid had them in three chunks.
    df = spark.range(40000).select(F.lit("k").alias("k"), (1 + (F.col("id") * 7919 % 40000) / 4e6).alias("v")).unionByName(
        spark.createDataFrame([("k", -5.0), ("k", 1e9), ("k", None), ("e", None), ("e", 2.0)], "k string, v double")
    )
    counts = df.groupBy("k", "v").agg(F.count(F.lit(1)).alias("n"))
    sizes = [r["count"] for r in stats.value_chunks(counts.where("k = 'k' and v is not null"), ["k"], "v").groupBy("_part").count().collect()]
    assert max(sizes) <= 4 * sum(sizes) / len(sizes) and len(sizes) > stats.VALUE_CHUNKS // 2
    rows = sorted((r.v, r.cum) for r in stats.value_counts(df, ["k"], "v").where("k = 'k'").collect())
    assert [c for _, c in rows] == list(range(1, 40003))
    assert [(r.v, r.cum) for r in stats.value_counts(df, ["k"], "v").where("k = 'e'").collect()] == [(2.0, 1)]
