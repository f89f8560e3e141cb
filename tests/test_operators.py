import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from footprints import constants as C
from footprints.functions import cigar as G
from footprints.operators import alignments as A, algebra, annotation, compare, coords, counts, features as X, intervals, mappability, metagene, pausing, qc, reads as R, surroundings, utr, windows


def models(spark):
    genes = spark.createDataFrame(
        [("p", "c", "+", 100, 169, 5, 35, 50), ("m", "c", "-", 300, 369, 5, 35, 50)],
        "gene string, seqname string, strand string, start bigint, end bigint, start_codon_t int, stop_codon_t int, transcript_length int",
    )
    exons = spark.createDataFrame([("p", 100, 119), ("p", 140, 169), ("m", 300, 319), ("m", 340, 369)], "gene string, start bigint, end bigint")
    return coords.transcript_models(genes, exons)


def alignment_rows(spark, rows):
    df = spark.createDataFrame(
        rows, "sample string, qname string, seqname string, pos bigint, text string, strand string, mapq int, is_secondary boolean, nongenomic_length int"
    ).withColumn("cigar", G.parse(F.col("text"))).withColumn("is_unmapped", F.lit(False))
    return df.withColumn("aend", G.reference_end(F.col("pos"), F.col("cigar"))).withColumn("qlen", G.query_length(F.col("cigar")))


def test_coordinates_invert_each_other(spark):
    dense = models(spark).withColumn("p", F.explode(F.sequence(F.col("start") - 10, F.col("end") + 10)))
    t = dense.withColumn("t", coords.to_transcript(F.col("p"), 10, 10)).withColumn("back", coords.to_genomic(F.col("t")))
    rows = {(r.gene, r.p): (r.t, r.back) for r in t.collect()}
    assert rows["p", 100] == (0, 100) and rows["p", 119][0] == 19 and rows["p", 140][0] == 20 and rows["p", 169][0] == 49
    assert rows["p", 120][0] is None and rows["p", 99][0] == -1 and rows["p", 170][0] == 50 and rows["p", 90][0] == -10
    assert rows["m", 369][0] == 0 and rows["m", 340][0] == 29 and rows["m", 319][0] == 30 and rows["m", 300][0] == 49
    assert rows["m", 370][0] == -1 and rows["m", 299][0] == 50
    assert all(back == p for (g, p), (tt, back) in rows.items() if tt is not None)


def test_hits_spliced_reads_and_counts(spark):
    a = alignment_rows(spark, [
        ("s", "1", "c", 110, "10M20N5M", "+", 50, False, 0),   # spliced as annotated
        ("s", "2", "c", 110, "15M", "+", 50, False, 0),        # runs into the intron
        ("s", "3", "c", 141, "10M", "+", 3, False, 2),         # not unique, primary
        ("s", "4", "c", 141, "10M", "+", 3, True, 2),          # not unique, secondary
        ("s", "5", "c", 141, "10M", "-", 50, False, 0),        # other strand
        ("s", "6", "c", 341, "10M", "-", 50, False, 9),        # minus strand gene
    ])
    hits = counts.transcript_hits(a, models(spark), 20, 20)
    summary = {r.gene: (r.nonunique, r.alternatively_spliced) for r in counts.hit_summary(hits).collect()}
    assert summary == {"p": (2, 1), "m": (0, 0)}
    got = {(r.gene, r.read_end, r.key, r.pos): r.n for r in counts.position_counts(hits, [15]).collect()}
    assert got == {
        ("p", "five", "all", 5): 1, ("p", "five", "15", 5): 1, ("p", "three", "all", 19): 1, ("p", "three", "0", 19): 1,
        ("p", "five", "all_nonunique", 16): 1, ("p", "three", "all_nonunique", 25): 1,
        ("m", "five", "all", 14): 1, ("m", "three", "all", 23): 1,
    }
    assert [(r.five_pos, r.three_pos) for r in counts.joint_counts(hits).where("gene = 'p'").collect()] == [(10, 24 - 35)]


def test_codon_counts_cover_reads_of_known_length(spark):
    genes = spark.createDataFrame([("g", 10, 40)], "gene string, start_codon_t int, stop_codon_t int")
    c = spark.createDataFrame([("s", "g", "five", "28", p, 1) for p in range(-20, 40)], "sample string, gene string, read_end string, key string, pos bigint, n bigint")
    offsets = counts.offsets_table(spark).where("offset_type = 'yeast'")
    got = {r.codon_idx: r.n for r in counts.codon_counts(c, genes, offsets, 2).collect()}
    assert got == {i: sum(1 for p in range(-20, 40) if (p + 15 + 1) // 3 == i) for i in range(-2, 12)}


def test_codon_counts_reject_partial_codons(spark):
    genes = spark.createDataFrame([("g", 10, 41)], "gene string, start_codon_t int, stop_codon_t int")
    c = spark.createDataFrame([("s", "g", "five", "28", 0, 1)], "sample string, gene string, read_end string, key string, pos bigint, n bigint")
    with pytest.raises(Exception, match="not divisible"):
        counts.codon_counts(c, genes, counts.offsets_table(spark)).collect()


def test_coding_sequences_validity(spark):
    m = spark.createDataFrame([("ok", 1, 7), ("inner", 1, 10), ("nostart", 1, 7)], "gene string, start_codon_t int, stop_codon_t int")
    s = spark.createDataFrame([("ok", "GATGCCCTAAG"), ("inner", "GATGTAACCCTAG"), ("nostart", "GCCCCCCTAAG")], "gene string, sequence string")
    assert {r.gene: r.coding_sequence for r in coords.coding_sequences(m, s).collect()} == {"ok": "ATGCCCTAA", "inner": None, "nostart": None}


def test_region_fetch_pads_off_the_sequence(spark):
    genome = spark.createDataFrame([("c", 0, "ACGTA"), ("c", 1, "CCGG")], "seqname string, chunk bigint, seq string")
    regions = spark.createDataFrame([("c", -2, 1), ("c", 3, 6), ("c", 7, 11)], "seqname string, a bigint, b bigint")
    assert {r.a: r.seq for r in coords.fetch_regions(regions, genome, 5).collect()} == {-2: "--AC", 3: "TACC", 7: "GG---"}


def test_overlap_join_against_brute_force(spark):
    rnd = random.Random(3)
    # A third of the left rows share one place.
    left = [(i, "c", 500, 520) if i % 3 == 0 else (i, "c", s := rnd.randrange(3000), s + rnd.randrange(60)) for i in range(150)]
    right = [(i, "c", s := rnd.randrange(3000), s + rnd.randrange(900)) for i in range(40)]
    l = spark.createDataFrame(left, "i int, seqname string, ls bigint, le bigint")
    r = spark.createDataFrame(right, "j int, seqname string, rs bigint, re bigint")
    got = [(x.i, x.j) for x in intervals.overlap_join(l, r, ["seqname"], ("ls", "le"), ("rs", "re"), 64).collect()]
    want = [(a[0], b[0]) for a in left for b in right if a[2] <= b[3] and b[2] <= a[3]]
    assert sorted(got) == sorted(want)
    points = [(x.i, x.j) for x in intervals.point_join(l, r, ["seqname"], "ls", ("rs", "re"), 64).collect()]
    assert sorted(points) == sorted((a[0], b[0]) for a in left for b in right if b[2] <= a[2] <= b[3])
    assert intervals.overlap_join(l.limit(0), r, ["seqname"], ("ls", "le"), ("rs", "re")).count() == 0


def test_a_locus_with_most_rows_is_dealt_out(spark):
    # Nine tenths of the reads begin at one base; the others are spread out.
    l = spark.range(20_000).selectExpr("id as i", "'c' as seqname", "if(id % 10 > 0, 700, id * 37) as ls", "if(id % 10 > 0, 700, id * 37) + 30 as le")
    r = spark.createDataFrame([(k, "c", k * 50, k * 50 + 200) for k in range(100)], "j int, seqname string, rs bigint, re bigint")
    keys = ["seqname", "_bin"]
    bins = lambda a, b: intervals._bins(F.col(a), F.col(b), intervals.BIN)
    dealt, _ = intervals._dealt(l.withColumn("_bin", bins("ls", "le")), r.withColumn("_bin", bins("rs", "re")), keys)
    sizes = sorted(x["n"] for x in dealt.groupBy(*keys, "_part").agg(F.count("*").alias("n")).collect())
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Fair shares, but for the luck of the hash.
    assert sizes[-1] <= 1.3 * 20_100 / (intervals.SHARES * tasks)
    joined = intervals.overlap_join(l, r, ["seqname"], ("ls", "le"), ("rs", "re"))
    near = sum(k * 50 <= 730 and k * 50 + 200 >= 700 for k in range(100))
    assert joined.where("i % 10 > 0").groupBy("i").count().agg(F.min("count"), F.max("count"), F.count("*")).first()[:] == (near, near, 18_000)


def test_bases_under_reads_over_chunks_and_edges(spark):
    rnd = random.Random(5)
    text = "".join(rnd.choice("ACGT") for _ in range(95))
    genome = spark.createDataFrame([("c", k, text[k * 20 : k * 20 + 20]) for k in range(5)], "seqname string, chunk bigint, seq string")
    rows = [(i, "c", p := rnd.randrange(-15, 100), [(p, p + rnd.randrange(0, 6)), (p + 8, p + 8 + rnd.randrange(0, 12))][: 1 + i % 2]) for i in range(300)]
    # Half of all reads at one place, one without a span, one off the known sequences.
    rows += [(1000 + i, "c", 18, [(18, 25)]) for i in range(300)] + [(2000, "c", 5, []), (2001, "x", 5, [(5, 8)]), (2002, "c", None, None)]
    reads = spark.createDataFrame(rows, "i int, seqname string, p bigint, s array<struct<a:bigint,b:bigint>>")
    base = lambda name, k: text[k] if name == "c" and 0 <= k < len(text) else "-"
    want = {i: "".join(base(name, k) for a, b in s for k in range(a, b + 1)) if s else None for i, name, _, s in rows}
    found = coords.bases_at(reads, genome, 20, F.col("s"), "bases")
    assert {r.i: r.bases for r in found.collect()} == want and found.columns == ["i", "seqname", "p", "s", "bases"]
    # Wider than a chunk is possible if asked for, and an error if not.
    wide = spark.createDataFrame([(1, "c", 3, [(3, 60)])], reads.schema)
    assert coords.bases_at(wide, genome, 20, F.col("s"), "bases", 58).first()["bases"] == text[3:61]
    with pytest.raises(Exception, match="spans more than the longest allowed"):
        coords.bases_at(wide, genome, 20, F.col("s"), "bases").collect()


def test_reads_and_genome_meet_in_one_join(spark):
    genome = spark.createDataFrame([("c", 0, "ACGTACGTACGTACGTACGT")], "seqname string, chunk bigint, seq string")
    a = alignment_rows(spark, [("s", "1", "c", 2, "6M", "+", 50, False, 0)]).withColumn("seq", F.lit("CCACGT")).withColumn("qual", F.lit("IIIIII"))
    plan = A.with_reference(a, genome, 20)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 2 and plan.count("Join") == 1


def test_sums_around_against_brute_force(spark):
    rnd = random.Random(9)
    rows = []
    for sample, gene, size in [("a", 1, 2500), ("a", 2, 9), ("b", 1, 1030)]:
        for i in range(size):
            if rnd.random() < 0.02:
                continue  # a codon without a row
            label = rnd.choice([None, None, "x", "y"])
            rows.append((sample, gene, i, rnd.choice(["AAA", "CCG", "TGA", "NNN"]), float(rnd.randrange(9)), label, rnd.choice([None, 0.5, 2.0]), 3.0))
    marked = spark.createDataFrame(rows, "sample string, gene int, i bigint, codon string, n double, label string, v double, u double")
    got = {(r.sample, r.label, r.offset, r.codon, r.codon_before): (r.sites, r.v, r.u) for r in surroundings.sums_around(marked, ["v", "u"], 3, 5, ["u"], pairs=True).collect()}
    at = {r[:3]: (r[3], r[4]) for r in rows}
    want = {}
    for sample, gene, i, _, _, label, v, u in rows:
        for o in range(-3, 6):
            codon, n = at.get((sample, gene, i + o), ("NNN", 0))
            if label is None or codon == "NNN":
                continue
            before = at.get((sample, gene, i + o - 1), ("NNN", 0))[0] if o > -3 else "NNN"
            key = (sample, label, o, codon, None if before == "NNN" else before)
            s = want.get(key, (0, 0.0, 0.0))
            want[key] = (s[0] + 1, s[1] + (v or 0), s[2] + u * n)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    with pytest.raises(Exception, match="several rows"):
        surroundings.sums_around(marked.unionByName(marked), ["v"], 1, 1).collect()
    assert surroundings.sums_around(marked.limit(0), ["v"], 1, 1).count() == 0


def test_consistent_position_prefers_the_dimer_rule():
    one, two = "TACGTACGTACGTACGTACGT"[:20], "TGGATCGGATCGGATCGGATC"[:20]
    dimer = ("BBB" + one[1:] + "CCCC", "BBB" + two[1:] + "CCCC")
    later = ("BBBACGTA" + one + "CC", "BBBTTTTT" + two + "CC")
    alone = ("BBBACGTA" + one + "CC", "B" * 30)
    r1, r2 = zip(dimer, later, alone)
    assert list(R.consistent_position(pd.Series(r1), pd.Series(r2), one, two, 3)) == [3, 8, -1]


def test_leading_mismatches_on_both_strands(spark):
    genome = spark.createDataFrame([("c", 0, "ACGTACGTACGTACGTACGT")], "seqname string, chunk bigint, seq string")
    a = alignment_rows(spark, [("s", "1", "c", 2, "6M", "+", 50, False, 0), ("s", "2", "c", 2, "6M", "-", 50, False, 0)])
    seqs = spark.createDataFrame([("1", "CCACGT", "IIIIII"), ("2", "GTACTA", "IIIII#")], "qname string, seq string, qual string")
    done = {r.qname: r for r in A.trim_leading_mismatches(A.with_reference(a.join(seqs, "qname"), genome, 20)).collect()}
    assert (done["1"].trimmed, done["1"].pos, done["1"].seq) == (2, 4, "ACGT")
    # The last base of the minus-strand read is a mismatch of low quality: nothing is cut.
    assert (done["2"].trimmed, done["2"].pos, done["2"].aend) == (0, 2, 8)


def test_merge_disjoint_rejects_a_shared_key(spark):
    a = spark.createDataFrame([("g", 1)], "gene string, n int")
    assert algebra.merge_disjoint([a, spark.createDataFrame([("h", 2)], "gene string, n int")], ["gene"]).count() == 2
    with pytest.raises(Exception, match="more than one part"):
        algebra.merge_disjoint([a, a], ["gene"]).collect()


def test_split_and_merge_equals_direct_counting(spark):
    rnd = random.Random(8)
    rows = [("s", str(i), "c", rnd.randrange(80, 380), "12M", rnd.choice("+-"), 50, False, 0) for i in range(300)]
    a = alignment_rows(spark, rows)
    m = models(spark)
    keys = ["sample", "gene", "read_end", "key", "pos"]
    run = lambda df: counts.position_counts(counts.transcript_hits(df, m, 20, 20), [12]).select(*keys, "n")
    parts = algebra.merge_sums([run(a.where("cast(qname as int) < 100")), run(a.where("cast(qname as int) >= 100"))], keys, ["n"])
    assert sorted(map(tuple, parts.collect())) == sorted(map(tuple, run(a).collect()))


def test_mixed_strands_are_an_error(spark):
    rows = [("c", "gene", "g", None, 0, 50, "+", None), ("c", "exon", "e1", "g", 0, 20, "+", None), ("c", "exon", "e2", "g", 30, 50, "-", None)]
    f = spark.createDataFrame(rows, "seqname string, feature string, id string, parent_id string, start bigint, end bigint, strand string, orf_classification string")
    with pytest.raises(Exception, match="mixed strand"):
        X.transcripts_of(X.gene_features(f), f).collect()


def test_empty_and_short_genes(spark):
    rows = [("s", "short", i, 6, "AAA", 4) for i in range(0, 6)] + [("s", "zero", i, 30, "CCC", 0) for i in range(0, 30)] + [("s", "one", i, 30, "GGG", i % 3) for i in range(0, 30)]
    c = spark.createDataFrame(rows, "sample string, gene string, codon_idx int, num_codons int, codon string, relaxed bigint")
    found = pausing.density_breakpoints(c, [(5, 5)], [0.1]).collect()
    assert [r.gene for r in found] == ["one"]
    e = pausing.stratified_enrichments(c, [(5, 5)], [0.1], 3)
    assert {r.label for r in e.where("feature = 'codon' and occurrences > 0").select("label").distinct().collect()} == {"GGG"}
    assert e.where("feature = 'codon'").count() == 7 * 64 and e.where("feature = 'nucleotide'").count() == 21 * 4
    assert metagene.first_codon_densities(c).where("gene = 'zero'").count() == 0


def test_stratified_enrichments_against_brute_force(spark):
    rnd = random.Random(9)
    genes = {f"g{k}": [(rnd.choice(["AAA", "CAT", "GGC", "TTT"]), rnd.randrange(9)) for _ in range(rnd.randrange(12, 60))] for k in range(4)}
    rows = [("s", g, i, len(v), codon, n) for g, v in genes.items() for i, (codon, n) in enumerate(v)]
    c = spark.createDataFrame(rows, "sample string, gene string, codon_idx int, num_codons int, codon string, relaxed bigint")
    around, es, ee, low = 4, 2, 3, 1.0
    occ, tot = {}, {}
    for v in genes.values():
        cds = v[2:]
        if len(cds) <= es + ee:
            continue
        mean = np.mean([n for _, n in cds[es : len(cds) - ee]])
        if mean <= low:
            continue
        for i in range(es, len(cds) - ee):
            for o in range(max(-i, -around), min(len(cds) - i, around + 1)):
                key = (o, cds[i + o][0])
                occ[key] = occ.get(key, 0) + 1
                tot[key] = tot.get(key, 0) + cds[i][1] / mean
    got = pausing.stratified_enrichments(c, [(es, ee)], [low], around, dense=False).where("feature = 'codon'").collect()
    assert {(r.offset, r.label): r.occurrences for r in got} == occ
    assert all(abs(r.enrichment - tot[r.offset, r.label] / occ[r.offset, r.label]) < 1e-9 for r in got)


def test_argmax_takes_the_first_of_equals(spark):
    df = spark.createDataFrame([("g", 5, 3), ("g", 2, 3), ("g", 9, 1)], "gene string, pos bigint, n bigint")
    assert windows.argmax(df, ["gene"], "pos", "n").first().argmax == 2


def test_mapped_uniqueness(spark):
    hits = spark.createDataFrame([("p", 3, "c", "+", 108, 118, 50), ("p", 4, "c", "-", 351, 361, 3)],
                                 "true_gene string, true_pos int, seqname string, strand string, pos bigint, aend bigint, mapq int")
    got = {(r.gene, r.pos): r.code for r in mappability.mapped_uniqueness(hits, models(spark), 10).collect()}
    assert got == {("p", 3): 1, ("p", 4): 2, ("m", 9 - 5): 2}
    assert [tuple(r) for r in mappability.wrong_unique(hits, models(spark), 10).collect()] == []


def test_boundary_defaults(spark):
    none = spark.createDataFrame([], "sample string, gene string, pos bigint, n bigint")
    got = {r.gene: (r.five_pos, r.three_pos) for r in utr.call_boundaries(models(spark), none, none).collect()}
    assert got["p"] == (105, 140 + 35 + 3 - 20) and got["m"] == (364, 319 - (38 - 30))


def test_landmark_check(spark):
    a = spark.createDataFrame([("g", 1, 2), ("h", 1, 2)], "gene string, start int, stop int")
    b = spark.createDataFrame([("g", 1, 2), ("h", 1, 3)], "gene string, start int, stop int")
    assert [r.gene for r in algebra.check_landmarks(a, b, ["start", "stop"]).collect()] == ["h"]


def test_families_of_any_depth(spark):
    chain = [(f"f{i}", f"f{i - 1}" if i else None) for i in range(9)] + [("g", None)]
    df = spark.createDataFrame(chain, "id string, parent_id string")
    below = {(r.top_id, r.id): r.depth for r in X.descendants(df).collect()}
    assert below == {(f"f{i}", f"f{j}"): j - i for i in range(9) for j in range(i + 1, 9)}
    assert {r.id: r.root_id for r in X.with_root(df).collect()} == {f"f{i}": "f0" for i in range(9)} | {"g": "g"}
    loop = spark.createDataFrame([("a", "c"), ("b", "a"), ("c", "b"), ("d", "a")], "id string, parent_id string")
    for closure in (X.descendants, X.with_root):
        with pytest.raises(ValueError, match="its own ancestor"):
            closure(loop).collect()


def test_samples_are_broadcast_and_not_multiplied(spark):
    genes = spark.createDataFrame([("g", 10, 40)], "gene string, start_codon_t int, stop_codon_t int")
    hits = spark.createDataFrame([("s", "g", "five", "all", 0, 3)], "sample string, gene string, read_end string, key string, pos bigint, n bigint")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table = counts.read_counts(hits, genes, hits.select("sample").distinct())
        assert "CartesianProduct" not in table._jdf.queryExecution().executedPlan().toString()
        assert [(r.gene, r.n) for r in table.collect()] == [("g", 3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_pairwise_of_samples_that_do_not_vary(spark):
    rows = [("a", "g", 1), ("a", "h", 2), ("a", "i", 4), ("b", "g", 5), ("b", "h", 5), ("b", "i", 5), ("c", "g", 7)]
    values = spark.createDataFrame(rows, "sample string, gene string, n bigint")
    got = {(r.first, r.second): (r.pearson, r.spearman, r.n) for r in compare.pairwise(values, "sample", "gene", "n").collect()}
    assert got.pop(("a", "a")) == (1.0, 1.0, 3)
    assert {k: n for k, (_, _, n) in got.items()} == {("a", "b"): 3, ("a", "c"): 1, ("b", "b"): 3, ("b", "c"): 1, ("c", "c"): 1}
    assert all(np.isnan(x) for r in got.values() for x in r[:2])
