"""Queries on transcript boundaries (A47-A53) and mappability."""

from __future__ import annotations

from pyspark.sql import functions as F

from footprints import constants as C
from footprints.operators import mappability as M, utr as U
from footprints.queries import counting
from footprints.queries.pause_queries import rounded
from footprints.queries.registry import VIEWS, query

VIEWS.update(
    {
        "ends": "SELECT p.sample, p.gene, p.read_end, p.key, p.pos, p.n, g.stop_codon_t - g.start_codon_t AS cds FROM position_counts p JOIN genes g USING (gene)",
        "five_window": "SELECT sample, gene, pos AS rel, n FROM ends WHERE read_end = 'five' AND key = 'all' AND pos >= -500 AND pos < cds",
        "three_window": "SELECT sample, gene, pos - cds AS rel, n FROM ends WHERE read_end = 'three' AND key = 'all' AND pos >= 0 AND pos - cds < 500",
    }
)


def ends(t, read_end, key="all"):
    c = counting.position_counts(t)
    return c.where((F.col("read_end") == read_end) & (F.col("key") == key)).select("sample", "gene", "pos", "n")


def boundaries(t):
    five, three = ends(t, "five").where("sample = 'A'"), ends(t, "three").where("sample = 'R'")
    return U.call_boundaries(counting.models(t), five, three)


def _genomic(t: str) -> str:
    """The position of transcript coordinate t on two exons, 150 bases and the rest, with 30 bases between them."""
    return f"""CASE WHEN strand = '+' THEN "start" + {t} + CASE WHEN {t} >= 150 THEN 30 ELSE 0 END ELSE "end" - {t} - CASE WHEN {t} >= "end" - "start" - 179 THEN 30 ELSE 0 END END"""


_BOUNDARIES = f"""
WITH f AS (SELECT gene, min(rel) AS rel FROM (SELECT *, max(n) OVER (PARTITION BY gene) AS top FROM five_window WHERE sample = 'A') WHERE n = top GROUP BY gene),
h AS (SELECT gene, min(rel) AS rel FROM (SELECT *, max(n) OVER (PARTITION BY gene) AS top FROM three_window WHERE sample = 'R') WHERE n = top GROUP BY gene),
t AS (SELECT g.*, start_codon_t + COALESCE(f.rel, 0) AS t5, stop_codon_t + COALESCE(h.rel, 3) AS t3 FROM genes g LEFT JOIN f ON f.gene = g.gene LEFT JOIN h ON h.gene = g.gene),
b AS (SELECT gene, seqname, strand, {_genomic("t5")} AS five_pos, {_genomic("t3")} AS three_pos FROM t) """


@query("A47_call_boundaries", _BOUNDARIES + "SELECT * FROM b")
def _(t):
    return boundaries(t)


@query(
    "S12_boundary_table_order",
    _BOUNDARIES + "SELECT gene, row_number() OVER (PARTITION BY seqname ORDER BY least(five_pos, three_pos), greatest(five_pos, three_pos), strand, gene) AS place FROM b",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("seqname").orderBy(F.least("five_pos", "three_pos"), F.greatest("five_pos", "three_pos"), "strand", "gene")
    return U.boundary_order(boundaries(t)).select("gene", F.row_number().over(w).alias("place"))


@query(
    "A48_boundary_diagnostics",
    """
WITH b AS (SELECT * FROM (SELECT gene, rel, row_number() OVER (PARTITION BY gene ORDER BY n DESC, rel) AS rank FROM five_window WHERE sample = 'A') WHERE rank <= 10),
s AS (SELECT sample, gene, sum(n) AS total FROM five_window GROUP BY ALL)
SELECT b.gene, b.rank, b.rel, s.sample, COALESCE(w.n, 0) AS n, round(COALESCE(w.n, 0) / total, 6) AS share FROM b JOIN s ON s.gene = b.gene
LEFT JOIN five_window w ON w.sample = s.sample AND w.gene = b.gene AND w.rel = b.rel""",
)
def _(t):
    return rounded(U.boundary_diagnostics(U.five_prime_window(ends(t, "five"), counting.models(t)), "A"), "share")


_PEAKS = """
WITH p AS (SELECT * FROM three_window WHERE rel >= 0 AND rel < 400),
k AS (SELECT sample, gene, min(rel) FILTER (n = top) AS peak, any_value(total) AS total, max(n) AS largest FROM (
  SELECT *, max(n) OVER (PARTITION BY sample, gene) AS top, CAST(sum(n) OVER (PARTITION BY sample, gene) AS BIGINT) AS total FROM p) GROUP BY ALL) """


@query("A49_three_prime_peaks", _PEAKS + "SELECT sample, gene, peak, total, round(CASE WHEN total > 9 THEN largest / total END, 6) AS fraction FROM k")
def _(t):
    return rounded(U.peaks(U.three_prime_window(ends(t, "three"), counting.models(t)), 0, 400), "fraction")


@query(
    "A49_peaks_by_sample",
    _PEAKS + """SELECT gene, max(peak) FILTER (sample = 'A') AS "A", max(peak) FILTER (sample = 'N') AS "N", max(peak) FILTER (sample = 'R') AS "R" FROM k GROUP BY gene""",
)
def _(t):
    return U.peaks_by_sample(U.peaks(U.three_prime_window(ends(t, "three"), counting.models(t)), 0, 400), ["A", "N", "R"])


@query(
    "A49_five_prime_peaks",
    """
SELECT sample, gene, min(rel) FILTER (n = top) AS peak, any_value(total) AS total, round(CASE WHEN any_value(total) > 4 THEN max(n) / any_value(total) END, 6) AS fraction FROM (
  SELECT *, max(n) OVER (PARTITION BY sample, gene) AS top, CAST(sum(n) OVER (PARTITION BY sample, gene) AS BIGINT) AS total FROM five_window WHERE rel >= -300 AND rel < 0) GROUP BY ALL""",
)
def _(t):
    return rounded(U.peaks(U.five_prime_window(ends(t, "five"), counting.models(t)), -300, 0, 4), "fraction")


@query(
    "A50_internal_ends",
    "SELECT sample, gene, CAST(sum(n) AS BIGINT) AS n FROM three_window WHERE rel < 0 GROUP BY ALL HAVING sum(n) > 3",
)
def _(t):
    return U.internal_ends(ends(t, "three"), counting.models(t), 3)


@query(
    "A51_around_landmark",
    """
SELECT sample, gene, CAST(sum(CASE WHEN r BETWEEN -100 AND 0 THEN n ELSE 0 END) AS BIGINT) AS before, CAST(sum(CASE WHEN r BETWEEN 1 AND 101 THEN n ELSE 0 END) AS BIGINT) AS after
FROM (SELECT p.sample, p.gene, p.n, p.pos - (g.transcript_length - g.start_codon_t) AS r FROM position_counts p JOIN genes g USING (gene) WHERE p.read_end = 'three' AND p.key = '0') GROUP BY ALL""",
)
def _(t):
    return U.around_landmark(ends(t, "three", "0"), counting.models(t), F.col("transcript_length"))


VIEWS["a_rich"] = """
SELECT gene, w AS "window", p AS pos, len(list_filter(range(0, w), lambda i: substr(sequence, CAST(p + 331 + i AS BIGINT), 1) = 'A')) AS n FROM (
  SELECT gene, sequence, w, unnest(range(-330, stop_codon_t - start_codon_t + 330 - w)) AS p FROM transcript_text JOIN genes USING (gene), (VALUES (5), (10), (20)) v(w))"""


def a_rich(t):
    return U.a_rich_windows(counting.models(t), counting.sequences(t), [5, 10, 20], C.BUFFER, C.BUFFER)


@query("A52_a_rich_windows", 'SELECT gene, "window", n, count(*) AS windows, CAST(sum(pos) AS BIGINT) AS pos_sum FROM a_rich GROUP BY ALL')
def _(t):
    return a_rich(t).groupBy("gene", "window", "n").agg(F.count(F.lit(1)).alias("windows"), F.sum("pos").alias("pos_sum"))


@query(
    "A52_a_rich_profile",
    """
WITH i AS (SELECT a.gene, a.pos, a.n, max(a.n) OVER (PARTITION BY a.gene) AS top FROM a_rich a JOIN genes g USING (gene) WHERE "window" = 10 AND transcript_length >= 301 AND a.pos >= 100 AND a.pos < transcript_length - 200),
b AS (SELECT gene, min(pos) AS spot FROM i WHERE n = top AND top > 3 GROUP BY gene)
SELECT sample, pos + start_codon_t - spot AS rel, CAST(sum(n) AS BIGINT) AS n FROM position_counts JOIN b USING (gene) JOIN genes USING (gene)
WHERE read_end = 'three' AND key = 'all' AND pos + start_codon_t >= 0 AND pos + start_codon_t < spot + 200 GROUP BY ALL""",
)
def _(t):
    starts = t.genes.select("gene", "start_codon_t")
    c = ends(t, "three").join(starts, "gene").withColumn("pos", F.col("pos") + F.col("start_codon_t")).drop("start_codon_t")
    return U.a_rich_profile(a_rich(t), counting.models(t), c, 10, 3)


@query("A53_end_profiles", "SELECT sample, gene, rel, n, round(n / sum(n) OVER (PARTITION BY sample, gene), 6) AS share FROM three_window WHERE rel < 400")
def _(t):
    placed = U.three_prime_window(ends(t, "three"), counting.models(t), 400).select("sample", "gene", "rel", "n")
    return rounded(U.end_profiles(placed, ["sample", "gene"]), "share")


_TILES = """
WITH tiles AS (SELECT gene, p, substr(sequence, CAST(p + start_codon_t + 331 AS BIGINT), 12) AS frag FROM (
   SELECT *, unnest(range(-20, stop_codon_t - start_codon_t + 20)) AS p FROM transcript_text JOIN genes USING (gene)) WHERE contains(substr(sequence, CAST(p + start_codon_t + 331 AS BIGINT), 12), '-') = FALSE) """


@query(
    "J20_tiled_fragments",
    _TILES + f"SELECT gene, count(*) AS n, count(DISTINCT frag) AS distinct_fragments, count(DISTINCT substr(frag || '{C.SMRNA_LINKER}', 1, 20)) AS reads FROM tiles GROUP BY gene",
)
def _(t):
    tiles = M.tile_fragments(counting.models(t), counting.sequences(t), C.BUFFER, 12, 20, C.SMRNA_LINKER, 20)
    return tiles.groupBy("gene").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fragment").alias("distinct_fragments"), F.count_distinct("seq").alias("reads"))


@query(
    "J20_exact_uniqueness",
    _TILES + """SELECT gene, code, count(*) AS n, CAST(sum(p) AS BIGINT) AS p_sum FROM (
  SELECT gene, p, CASE WHEN count(*) OVER (PARTITION BY frag) > 1 THEN 2 ELSE 1 END AS code FROM tiles) GROUP BY ALL""",
)
def _(t):
    tiles = M.tile_fragments(counting.models(t), counting.sequences(t), C.BUFFER, 12, 20, C.SMRNA_LINKER, 20)
    return M.exact_uniqueness(tiles).groupBy("gene", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("p_sum"))


@query(
    "J20_mapped_uniqueness",
    """
WITH hit AS (SELECT a.seqname, a.strand, CASE WHEN a.strand = '+' THEN a.pos ELSE a.aend - 1 END AS five, a.mapq, g.gene AS true_gene, g.start_codon_t FROM mapped a
   JOIN lineitem_key k ON k.qname = a.qname JOIN genes g ON g.gene = k.gene),
lists AS (SELECT true_gene AS gene, 7 AS pos, CASE WHEN mapq < 50 THEN 2 ELSE 1 END AS code FROM hit
  UNION ALL SELECT m.gene, m.t - g.start_codon_t, 2 FROM hit h JOIN coordinate_map m ON m.seqname = h.seqname AND m.strand = h.strand AND m.p = h.five JOIN genes g ON g.gene = m.gene
  WHERE h.mapq < 50 AND m.t >= -20 AND m.t < g.transcript_length + 20)
SELECT gene, pos, max(code) AS code FROM lists GROUP BY ALL""",
)
def _(t):
    keys = t.table("lineitem").groupBy(F.col("l_orderkey").cast("string").alias("qname")).agg(F.min("l_partkey").alias("true_gene"))
    hits = t.mapped.join(keys, "qname").join(t.genes.select(F.col("gene").alias("true_gene")), "true_gene").withColumn("true_pos", F.lit(7))
    return M.mapped_uniqueness(hits, counting.models(t), 20)


VIEWS["lineitem_key"] = "SELECT CAST(l_orderkey AS VARCHAR) AS qname, min(l_partkey) AS gene FROM lineitem GROUP BY l_orderkey"
