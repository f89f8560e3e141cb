import math

import numpy as np
import pandas as pd
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from footprints import constants as C
from footprints.functions import cigar as G, pvalues, sequence as S, stats


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], list(values))
    return df.select(column.alias("x")).first()["x"]


def test_poly_runs(spark):
    rows = [("GGAA", 2, 3 - 4), ("AAAA", 0, -1), ("GCAN", 2, -1), ("TTNG", 4, 2), ("TTTT", 4, 3), ("", 0, -1)]
    df = spark.createDataFrame([(s,) for s, _, _ in rows], "s string")
    got = df.select("s", S.poly_a_start(F.col("s")).alias("a"), S.poly_t_end(F.col("s")).alias("t")).collect()
    assert [(r.s, r.a, r.t) for r in got] == [(s, a, t) for s, a, t in rows]


def test_poly_a_run_takes_first_long_run_else_longest(spark):
    rows = [("GAAAGAAAAG", (1, 3)), ("GAAGAAG", (1, 2)), ("GAGAAG", (3, 2)), ("GGG", (0, 0)), ("", (0, 0)), ("AAAA", (0, 4))]
    df = spark.createDataFrame([(s,) for s, _ in rows], "s string")
    got = [tuple(r.x) for r in df.select(S.poly_a_run(F.col("s"), 3).alias("x")).collect()]
    assert got == [want for _, want in rows]


def test_predominantly_a(spark):
    rows = [("A" * 19 + "C" + "C" * 9, True), ("A" * 18 + "CC", False), ("AAA", True), ("AAC", False)]
    df = spark.createDataFrame([(s,) for s, _ in rows], "s string")
    assert [r.x for r in df.select(S.predominantly_a(F.col("s")).alias("x")).collect()] == [w for _, w in rows]


def test_anchor_start(spark):
    rows = [("G" * 11 + "CAGTA" + "GG", 16), ("CAGTA" + "G" * 7 + "CAGTA", 0), ("GGGG", 0)]
    df = spark.createDataFrame([(s,) for s, _ in rows], "s string")
    assert [r.x for r in df.select(S.anchor_start(F.col("s")).alias("x")).collect()] == [w for _, w in rows]


def brute_find(seq, adapter, distance):
    for i in range(len(seq)):
        window = seq[i : i + len(adapter)]
        wrong = sum(a != b for a, b in zip(window, adapter))
        if wrong <= (distance if len(window) == len(adapter) else 0):
            return i
    return len(seq)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ACGT", max_size=14), min_size=1, max_size=20), st.integers(0, 3))
def test_first_match_against_brute_force(seqs, distance):
    got = S.first_match(pd.Series(seqs), "CTGTA", distance)
    assert list(got) == [brute_find(s, "CTGTA", distance) for s in seqs]


def test_adapter_pattern_against_brute_force(spark):
    rng = np.random.default_rng(1)
    adapter = C.SMRNA_LINKER[:15]
    seqs = []
    for _ in range(400):
        seq = "".join(rng.choice(list("ACGT"), 30))
        at = int(rng.integers(0, 30))
        seqs.append((seq[:at] + adapter + seq)[:30])
    for i in range(0, 400, 3):
        k = int(rng.integers(0, 30))
        seqs[i] = seqs[i][:k] + "G" + seqs[i][k + 1 :]
    df = spark.createDataFrame([(s,) for s in seqs], "s string")
    got = [r.x for r in df.select(S.find_adapter(F.col("s"), C.SMRNA_LINKER).alias("x")).collect()]
    assert got == [brute_find(s, adapter, 1) for s in seqs]


def test_codons_and_windows(spark):
    df = spark.createDataFrame([("ATGCCCG",), ("",)], "s string")
    got = df.select(S.codons_of(F.col("s")).alias("c"), S.windows_of(F.col("s"), 3).alias("w")).collect()
    assert got[0].c == ["ATG", "CCC", "G"] and got[0].w == ["ATG", "TGC", "GCC", "CCC", "CCG"]
    assert got[1].c == [] and got[1].w == []


def test_cigar(spark):
    df = spark.createDataFrame([(100, "2S10M5N3M1D4M"), (0, "20M")], "pos bigint, c string").withColumn("cigar", G.parse(F.col("c")))
    got = df.select(
        G.unparse(F.col("cigar")).alias("text"), G.reference_end(F.col("pos"), F.col("cigar")).alias("end"), G.aligned_blocks(F.col("pos"), F.col("cigar")).alias("blocks"),
        G.unparse(G.keep_read_bases(F.col("cigar"), F.lit(4), F.lit(14))).alias("kept"),
    ).collect()
    assert got[0].text == "2S10M5N3M1D4M" and got[0].end == 123
    assert [tuple(b) for b in got[0].blocks] == [(100, 110), (115, 118), (119, 123)]
    assert got[0].kept == "8M5N2M" and got[1].kept == "10M"


def test_running_sum_crosses_chunks(spark):
    df = spark.range(1000).select(F.lit("k").alias("k"), F.col("id").alias("p"), (F.col("id") % 7).alias("v"))
    got = stats.running_sum(df, ["k"], "p", {"s": "v"}, F.floor(F.col("p") / 64)).orderBy("p").collect()
    assert [r.s for r in got] == list(np.cumsum(np.arange(1000) % 7))


def mquantiles(x, probs):
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n == 1:
        return [x[0]] * len(probs)
    p = np.asarray(probs)
    a = n * p + 0.4 + p * 0.2
    k = np.floor(a.clip(1, n - 1)).astype(int)
    g = (a - k).clip(0, 1)
    return list((1 - g) * x[k - 1] + g * x[k])


def test_mquantiles(spark):
    rng = np.random.default_rng(2)
    for values in (rng.exponential(5, 300).round(2), np.zeros(10), np.array([3.0]), np.array([1.0, 2.0])):
        df = spark.createDataFrame([(float(v),) for v in values], "x double")
        probs = spark.createDataFrame([(i, i / 4) for i in range(5)], "q int, p double")
        got = [r["quantile"] for r in stats.mquantiles(df, [], "x", probs).orderBy("q").collect()]
        assert np.allclose(got, mquantiles(values, [i / 4 for i in range(5)]))


def test_window_join_against_brute_force(spark):
    # One key holds nearly all rows.
    rows = [("hot", i) for i in range(400)] + [("cold", i) for i in range(3)]
    df = spark.createDataFrame(rows, "k string, p bigint")
    got = stats.window_join(df, df.select("k", F.col("p").alias("q")), ["k"], "p", "q", 5, 3)
    want = {(a, p, q) for a, p in rows for b, q in rows if a == b and -5 <= q - p <= 3}
    found = [(r.k, r.p, r.q) for r in got.collect()]
    assert len(found) == len(want) and set(found) == want


def test_first_of_group_flags_exactly_one_even_among_equals(spark):
    rows = [("a", 1, "x")] * 5 + [("a", 2, "y")] * 50 + [("b", 3, "z")]
    df = spark.createDataFrame(rows, "k string, v int, w string")
    got = stats.first_of_group(df, ["k"], [F.col("v"), F.col("w")], "first")
    assert got.count() == len(rows)
    flagged = [(r.k, r.v) for r in got.where("first").collect()]
    assert sorted(flagged) == [("a", 1), ("b", 3)]


def student_two_sided(r, n):
    """Student's two-sided p-value by its finite sums for whole degrees of freedom."""
    v, s, c = n - 2, abs(r), math.sqrt(1 - r * r)
    if v % 2 == 0:
        term, total = 1.0, 0.0
        for k in range(v // 2):
            total += term
            term *= (2 * k + 1) / (2 * k + 2) * c * c
        return 1 - s * total
    term, total = c, 0.0
    for k in range((v - 1) // 2):
        total += term
        term *= (2 * k + 2) / (2 * k + 3) * c * c
    return 1 - 2 / math.pi * (math.asin(s) + s * total)


def test_correlation_p_values(spark):
    cases = [(r, n) for n in (3, 4, 5, 6, 17, 61, 62, 1000, 4001) for r in (-0.999, -0.9, -0.31, 0.0, 1e-9, 0.02, 0.2, 0.5, 0.99)]
    df = spark.createDataFrame(cases, "r double, n bigint")
    for x in df.select("r", "n", pvalues.correlation_p_value(F.col("r"), F.col("n")).alias("p")).collect():
        assert math.isclose(x.p, student_two_sided(x.r, x.n), rel_tol=1e-8, abs_tol=1e-10), x


def test_p_values_at_the_edges(spark):
    rows = [(1.0, 9), (-1.0, 9), (0.0, 9), (0.5, 2), (None, 9), (0.5, None), (float("nan"), 9), (1.0, None)]
    df = spark.createDataFrame(rows, "r double, n bigint")
    got = [x.p for x in df.select(pvalues.correlation_p_value(F.col("r"), F.col("n")).alias("p")).collect()]
    assert got == [0.0, 0.0, 1.0, None, None, None, None, None]
    assert df.limit(0).select(pvalues.correlation_p_value(F.col("r"), F.col("n")).alias("p")).count() == 0
