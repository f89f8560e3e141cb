"""Queries that compare samples, smooth and rank."""

from __future__ import annotations

from pyspark.sql import functions as F

from footprints import constants as C
from footprints.functions import sequence as S
from footprints.functions.pvalues import correlation_p_value
from footprints.functions.stats import t_statistic
from footprints.operators import algebra as L, compare as K, counts, dimensions, pausing as P, windows as W
from footprints.queries import counting
from footprints.queries.pause_queries import AROUND, rounded
from footprints.queries.registry import VIEWS, query


def _spearman(source: str, keys: str, x: str, y: str) -> str:
    """Spearman by average ranks."""
    rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY round({c}, 9)) + (count(*) OVER (PARTITION BY {keys}, round({c}, 9)) - 1) / 2.0"
    return f"SELECT {keys}, corr(rx, ry) AS rho, count(*) AS n FROM (SELECT {keys}, {rank(x)} AS rx, {rank(y)} AS ry FROM {source}) GROUP BY {keys}"


VIEWS.update(
    {
        "enr": """
SELECT sample, "offset", label, enrichment FROM enrichments WHERE min_mean = 0.1 AND excl_start = 90 AND feature = 'codon' AND label NOT IN ('TAA', 'TAG', 'TGA')""",
        "enr_weighted": 'SELECT e.*, weight FROM enr e JOIN trna t ON t.codon = e.label',
        "wave_smooth": """
SELECT sample, label, "offset", CASE WHEN count(*) OVER w = 5 THEN avg(enrichment) OVER w ELSE enrichment END AS smoothed FROM enr WHERE "offset" BETWEEN -15 AND 15
WINDOW w AS (PARTITION BY sample, label ORDER BY "offset" ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""",
        "gene_counts": """
SELECT sample, gene, CAST(sum(relaxed) AS BIGINT) AS n, any_value(num_codons) * 3 AS cds_length FROM codon_counts GROUP BY sample, gene""",
    }
)
WAVE = range(-6, -18, -1)
ACTIVE = range(-2, 1)


def enr(t):
    table = P.stratified_enrichments(t.codon_counts, [(90, 90)], [0.1], AROUND)
    return table.where(F.col("feature") == "codon").where(~F.col("label").isin(C.STOP_CODONS)).select("sample", "offset", "label", "enrichment")


def gene_counts(t):
    return t.codon_counts.groupBy("sample", "gene").agg(F.sum("relaxed").alias("n"), (F.first("num_codons") * 3).alias("cds_length"))


def _area(where: str) -> str:
    return f'SELECT sample, label, sum(enrichment - 1) AS area FROM enr WHERE {where} GROUP BY sample, label'


@query(
    "A36_net_areas",
    f"""
WITH a AS ({_area('"offset" BETWEEN -17 AND -6 OR "offset" BETWEEN -2 AND 0')})
SELECT a.sample, a.label, round(a.area, 5) AS area, round(a.area - b.area, 5) AS against_first FROM a JOIN a b ON b.label = a.label AND b.sample = 'S0'""",
)
def _(t):
    e = enr(t)
    plain = K.areas(e, [WAVE, ACTIVE])
    versus = K.areas(e, [WAVE, ACTIVE], "S0").withColumnRenamed("area", "against_first")
    return rounded(plain.join(versus, ["sample", "label"]), "area", "against_first", digits=5)


_CHANGES = f"""
WITH a AS ({_area('"offset" BETWEEN -2 AND 0')}), w AS ({_area('"offset" BETWEEN -17 AND -6')}),
p AS (SELECT a0.label, a1.area - a0.area AS change, w1.area - w0.area AS wave FROM a a0 JOIN a a1 ON a1.label = a0.label AND a1.sample = 'S1'
  JOIN w w0 ON w0.label = a0.label AND w0.sample = 'S0' JOIN w w1 ON w1.label = a0.label AND w1.sample = 'S1' WHERE a0.sample = 'S0') """


@query("A37_change_scatter", _CHANGES + "SELECT label, round(change, 5) AS change, round(wave, 5) AS wave FROM p")
def _(t):
    return rounded(K.area_changes(enr(t), "S0", "S1", ACTIVE, WAVE), "change", "wave", digits=5)


@query("A37_change_fit", _CHANGES + "SELECT round(corr(change, wave), 5) AS r, round(regr_slope(wave, change), 5) AS slope, count(*) AS n FROM p")
def _(t):
    return rounded(K.fit(K.area_changes(enr(t), "S0", "S1", ACTIVE, WAVE), "change", "wave"), "r", "slope", digits=5)


@query(
    "A37_flipped_scatter",
    f"""
WITH a AS ({_area('"offset" BETWEEN -2 AND 0')}), w AS ({_area('"offset" BETWEEN 6 AND 17')})
SELECT a.label, round(-a.area, 5) AS change, round(w.area, 5) AS wave FROM a JOIN w ON w.label = a.label AND w.sample = 'S1' WHERE a.sample = 'S0'""",
)
def _(t):
    moved = K.area_changes(enr(t), "S0", "S1", ACTIVE, WAVE, area_between=False, change=False, flip_wave=True)
    return rounded(moved, "change", "wave", digits=5)


@query(
    "A38_difference_histogram",
    f"""
WITH a AS ({_area('"offset" BETWEEN -17 AND -6')}), d AS (SELECT b.area - a.area AS d FROM a JOIN a b ON b.label = a.label AND b.sample = 'S2' WHERE a.sample = 'S0'),
l AS (SELECT CASE WHEN min(d) < -1.5 THEN min(d) - 0.1 ELSE -1.5 END AS lo, CASE WHEN max(d) > 1.5 THEN max(d) + 0.1 ELSE 1.5 END AS hi FROM d)
SELECT CAST(least(59, floor((d - lo) / (hi - lo) * 60)) AS INTEGER) AS bin, count(*) AS n FROM d, l GROUP BY ALL""",
)
def _(t):
    return K.difference_histogram(K.area_differences(enr(t), "S0", "S2", [WAVE]))


@query(
    "A38_extreme_labels",
    f"""
WITH a AS ({_area('"offset" BETWEEN -17 AND -6')}), d AS (SELECT a.label, round(b.area - a.area, 6) AS d FROM a JOIN a b ON b.label = a.label AND b.sample = 'S2' WHERE a.sample = 'S0')
SELECT (SELECT label FROM d ORDER BY d DESC, label DESC LIMIT 1) AS gain, max(d) AS gain_by, (SELECT label FROM d ORDER BY d, label LIMIT 1) AS loss, min(d) AS loss_by FROM d""",
)
def _(t):
    return K.extreme_labels(rounded(K.area_differences(enr(t), "S0", "S2", [WAVE]), "difference"))


def _p_sql(r: str, n: str) -> str:
    """Student's two-sided p-value by its finite sums for whole degrees of freedom n - 2, even and odd."""
    even = f"abs({r}) * list_sum([exp(lgamma(k + 0.5) - lgamma(k + 1)) / sqrt(pi()) * pow(1 - {r} * {r}, k) FOR k IN range(({n} - 2) // 2)])"
    odd = f"2 / pi() * (asin(abs({r})) + abs({r}) * coalesce(list_sum([sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(1 - {r} * {r}, k + 0.5) FOR k IN range(({n} - 3) // 2)]), 0))"
    return f"1 - CASE WHEN {n} % 2 = 0 THEN {even} ELSE {odd} END"


@query(
    "A39_rank_correlations",
    f"SELECT sample, round(rho, 6) AS rho, n, round(rho * sqrt((n - 2) / (1 - rho * rho)), 5) AS t, round({_p_sql('rho', 'n')}, 9) AS p FROM (" + _spearman('(SELECT * FROM enr_weighted WHERE "offset" = 0)', "sample", "enrichment", "weight") + ")",
)
def _(t):
    c = K.rank_correlations(enr(t), t.trna).withColumn("t", t_statistic(F.col("rho"), F.col("n"))).withColumn("p", correlation_p_value(F.col("rho"), F.col("n")))
    return rounded(rounded(rounded(c, "rho"), "t", digits=5), "p", digits=9)


_BY_OFFSET = _spearman("(SELECT w.*, t.weight FROM wave_smooth w JOIN trna t ON t.codon = w.label)", 'sample, "offset"', "smoothed", "weight")


@query("A39_rank_correlations_by_offset", f'SELECT sample, "offset", round(rho, 6) AS rho, n, round({_p_sql("rho", "n")}, 9) AS p FROM ({_BY_OFFSET})')
def _(t):
    c = K.rank_correlations_by_offset(enr(t), t.trna, 2, -15, 15).withColumn("p", correlation_p_value(F.col("rho"), F.col("n")))
    return rounded(rounded(c, "rho"), "p", digits=9)


_CHANGE_R = """
WITH act AS (SELECT sample, label, sum(enrichment) FILTER ("offset" = 0) AS a, sum(enrichment) FILTER ("offset" >= -1 AND "offset" <= 0) AS ap,
   sum(enrichment) FILTER ("offset" BETWEEN -2 AND 0) AS ape FROM enr GROUP BY ALL),
l AS (SELECT b.sample, b.label, unnest([{'s': 'A', 'd': z.a - b.a}, {'s': 'A+P', 'd': z.ap - b.ap}, {'s': 'A+P+E', 'd': z.ape - b.ape}]) AS x
      FROM act b JOIN act z ON z.label = b.label AND z.sample = 'S0' WHERE b.sample <> 'S0'),
c AS (SELECT w.sample, x.s AS sites, "offset", round(corr(smoothed, x.d), 5) AS r FROM wave_smooth w JOIN l ON l.sample = w.sample AND l.label = w.label GROUP BY ALL) """


@query("A40_change_correlations", _CHANGE_R + "SELECT * FROM c")
def _(t):
    return rounded(K.change_correlations(enr(t), "S0", 2, -15, 16), "r", digits=5)


@query("A40_best_offsets", _CHANGE_R + """SELECT sample, sites, arg_max("offset", r * 1000 - "offset" / 1000.0) AS "offset", max(r) AS r FROM c GROUP BY sample, sites""")
def _(t):
    c = rounded(K.change_correlations(enr(t), "S0", 2, -15, 16), "r", digits=5)
    return K.best_offset(c, "r", ["sample", "sites"])


@query(
    "A41_correlation_matrix",
    """
SELECT a.sample AS first, b.sample AS second, round(corr(a.enrichment, b.enrichment), 5) AS r FROM enr a JOIN enr b ON b.label = a.label AND b."offset" = 0
WHERE a."offset" = 0 GROUP BY ALL""",
)
def _(t):
    return rounded(K.correlation_matrix(enr(t)), "r", digits=5)


def _area_with(where: str) -> str:
    return f'(SELECT a.sample, a.label, round(a.area, 9) AS area, weight FROM ({_area(where)}) a JOIN trna t ON t.codon = a.label)'


@query(
    "A42_weight_recovery",
    "SELECT sample, measure, round(rho, 5) AS rho, n FROM ("
    + " UNION ALL ".join(
        f"SELECT *, '{name}' AS measure FROM ({_spearman(_area_with(where), 'sample', 'area', 'weight')})"
        for name, where in [
            ("active", '"offset" BETWEEN -2 AND 0'), ("active+wave", '"offset" BETWEEN -2 AND 0 OR "offset" BETWEEN -17 AND -6'),
            ("active+big_wave", '"offset" BETWEEN -2 AND 0 OR "offset" BETWEEN -99 AND -7'),
        ]
    )
    + ")",
)
def _(t):
    return rounded(K.weight_recovery(enr(t), t.trna, WAVE, range(-7, -100, -1)), "rho", digits=5)


@query(
    "A72_area_scan",
    "SELECT sample, side, stop, round(rho, 4) AS rho, n FROM ("
    + _spearman(
        """(SELECT s.sample, side, stop, round(s.area + a.area, 9) AS total, weight FROM (
  SELECT sample, label, 'downstream' AS side, "offset" - 1 AS stop, sum(enrichment - 1) OVER (PARTITION BY sample, label ORDER BY "offset" DESC) AS area FROM enr WHERE "offset" BETWEEN -98 AND -6
  UNION ALL SELECT sample, label, 'upstream', -"offset" - 1, sum(enrichment - 1) OVER (PARTITION BY sample, label ORDER BY "offset") FROM enr WHERE "offset" BETWEEN 7 AND 98) s
  JOIN (SELECT sample, label, sum(enrichment - 1) AS area FROM enr WHERE "offset" BETWEEN -2 AND 0 GROUP BY ALL) a USING (sample, label) JOIN trna t ON t.codon = label WHERE stop BETWEEN -99 AND -8)""",
        "sample, side, stop", "total", "weight",
    )
    + ")",
)
def _(t):
    return rounded(K.area_scan(enr(t), t.trna), "rho", digits=4)


_WOBBLE = " UNION ALL ".join(
    f"SELECT '{codon[2]}' AS third_base, '{anti[0]}' AS first_base, '{codon.replace('U', 'T')}' AS codon" for anti, codons in C.ANTICODONS.items() for codon in codons
)


@query(
    "A73_wobble_tracks",
    f'SELECT third_base, first_base, codon, sample, round(enrichment, 6) AS enrichment FROM enr JOIN ({_WOBBLE}) w ON w.codon = label WHERE "offset" = 0',
)
def _(t):
    return rounded(K.wobble_tracks(enr(t), dimensions.codon_dimension(t.spark)), "enrichment")


# ---- expression ----------------------------------------------------------------------------------


@query(
    "J19_translational_efficiency",
    """
WITH r AS (SELECT sample, gene, greatest(0.1, 1e9 / sum(n) OVER (PARTITION BY sample) * n / cds_length) AS rpkm FROM gene_counts)
SELECT f.gene, round(f.rpkm / m.rpkm, 6) AS te FROM r f JOIN r m ON m.gene = f.gene AND m.sample = 'S1' WHERE f.sample = 'S0'""",
)
def _(t):
    g = gene_counts(t)
    return rounded(K.translational_efficiency(g.where("sample = 'S0'"), g.where("sample = 'S1'")), "te")


VIEWS["te_values"] = """
WITH f AS (SELECT sample, gene, greatest(n, 0.1) AS v FROM gene_counts), s AS (SELECT sample, gene, v, log2(v / sum(v) OVER (PARTITION BY sample)) AS l FROM f),
g AS (SELECT gene FROM s GROUP BY gene HAVING min(v) > 50000)
SELECT p.name, a.gene, a.l - b.l AS log_te FROM (VALUES ('one', 'S0', 'S1'), ('two', 'S2', 'S1')) p(name, f, m) JOIN s a ON a.sample = p.f JOIN s b ON b.sample = p.m AND b.gene = a.gene
WHERE a.gene IN (SELECT gene FROM g)"""


def log_te(t):
    pairs = t.spark.createDataFrame([("one", "S0", "S1"), ("two", "S2", "S1")], "name string, footprint string, mrna string")
    return K.log_te(gene_counts(t).select("sample", "gene", "n"), pairs, 50000)


@query(
    "A59_log_te",
    "SELECT name, gene, round(log_te, 6) AS log_te, round(log_te - avg(log_te) OVER (PARTITION BY name), 6) AS centred FROM te_values",
)
def _(t):
    te = log_te(t)
    mid = K.centred(te, ["name"], "log_te").withColumnRenamed("log_te", "centred")
    return rounded(te.join(mid, ["name", "gene"]), "log_te", "centred")


@query(
    "A59_te_histogram",
    """
SELECT name, CAST(least(99, floor((c + 0.5) * 100)) AS INTEGER) AS bin, count(*) AS n FROM (SELECT name, round(log_te - avg(log_te) OVER (PARTITION BY name), 6) AS c FROM te_values)
WHERE c BETWEEN -0.5 AND 0.5 GROUP BY ALL""",
)
def _(t):
    return K.histogram(rounded(K.centred(log_te(t), ["name"], "log_te"), "log_te"), ["name"], "log_te", -0.5, 0.5)


@query(
    "A59_te_against_length",
    """
SELECT name, round(corr(log_te, log10(cds_length)), 5) AS r, count(*) AS n FROM te_values JOIN (SELECT DISTINCT gene, cds_length FROM gene_counts) USING (gene) GROUP BY name""",
)
def _(t):
    lengths = gene_counts(t).select("gene", "cds_length").distinct()
    j = log_te(t).join(lengths, "gene").withColumn("log_length", F.log10("cds_length"))
    return rounded(j.groupBy("name").agg(F.corr("log_te", "log_length").alias("r"), F.count(F.lit(1)).alias("n")), "r", digits=5)


@query(
    "O9_pairwise_samples",
    """
WITH r AS (SELECT sample, gene, n, rank() OVER (PARTITION BY sample ORDER BY n) + (count(*) OVER (PARTITION BY sample, n) - 1) / 2.0 AS k FROM gene_counts)
SELECT a.sample AS first, b.sample AS second, round(corr(a.n, b.n), 5) AS pearson, round(corr(a.k, b.k), 5) AS spearman, count(*) AS n
FROM r a JOIN r b ON b.gene = a.gene AND a.sample <= b.sample GROUP BY ALL""",
)
def _(t):
    return rounded(K.pairwise(gene_counts(t), "sample", "gene", "n"), "pearson", "spearman", digits=5)


@query("F28_genes_above", "SELECT gene FROM gene_counts GROUP BY gene HAVING min(n) > 52000")
def _(t):
    return L.genes_above(gene_counts(t), 52000)


VIEWS["matrix"] = """
SELECT gene, cds_length, any_value(n) FILTER (sample = 'S0') AS "S0", any_value(n) FILTER (sample = 'S1') AS "S1", any_value(n) FILTER (sample = 'S2') AS "S2" FROM gene_counts GROUP BY gene, cds_length"""


@query("S19_count_matrix", "SELECT * FROM matrix")
def _(t):
    return L.count_matrix(gene_counts(t), ["S0", "S1", "S2"])


@query("S19_from_matrix", "SELECT gene, cds_length, sample, n FROM gene_counts")
def _(t):
    return L.from_matrix(L.count_matrix(gene_counts(t), ["S0", "S1", "S2"]))


_NAMES = """
SELECT 'unstressed_' || CASE user_id % 4 WHEN 0 THEN 'no' WHEN 1 THEN '1x' WHEN 2 THEN '1_8x' ELSE '100x' END || 'CHX' || CASE WHEN user_id % 3 = 0 THEN '' ELSE '_' || user_id % 3 END AS sample,
  event_type, CASE user_id % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 100 END AS num, CASE WHEN user_id % 4 = 2 THEN 8 ELSE 1 END AS denom, CASE WHEN user_id % 3 = 0 THEN '' ELSE CAST(user_id % 3 AS VARCHAR) END AS rep FROM events"""


def named_samples(t):
    amount = F.element_at(F.array(*[F.lit(x) for x in ("no", "1x", "1_8x", "100x")]), (F.col("user_id") % 4 + 1).cast("int"))
    rep = F.when(F.col("user_id") % 3 == 0, "").otherwise(F.concat(F.lit("_"), F.col("user_id") % 3))
    return t.table("events").select(F.concat(F.lit("unstressed_"), amount, F.lit("CHX"), rep).alias("sample"), F.col("event_type").alias("family"))


@query(
    "F29_concentrations",
    f"SELECT sample, num, denom, rep, num / denom AS concentration, count(*) AS n FROM ({_NAMES}) GROUP BY ALL",
)
def _(t):
    n = named_samples(t).groupBy("sample").agg(F.count(F.lit(1)).alias("n"))
    return L.by_concentration(n, series="unstressed")


@query(
    "F33_clean_names",
    """
SELECT translate(translate(replace(l_returnflag || ' a/b,[' || l_linestatus || '](' || l_linenumber || ') Δx', 'Δ', 'delta_'), '()', ''), ' /,[]', '_____') AS name, count(*) AS n
FROM lineitem GROUP BY ALL""",
)
def _(t):
    raw = F.concat("l_returnflag", F.lit(" a/b,["), "l_linestatus", F.lit("]("), "l_linenumber", F.lit(") Δx"))
    return t.table("lineitem").groupBy(L.clean_name(raw).alias("name")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F34_cohorts",
    f"""
WITH s AS (SELECT DISTINCT event_type AS family, sample FROM ({_NAMES}))
SELECT cohort, family, sample, title || ' ' || left(sample, 25) AS title FROM (
  SELECT 'untreated' AS cohort, family, sample, family AS title FROM s WHERE family IN ('view', 'click') AND sample LIKE '%noCHX%'
  UNION ALL SELECT 'treated', family, sample, family FROM s WHERE family IN ('view', 'error') AND sample NOT LIKE '%noCHX%')""",
)
def _(t):
    s = named_samples(t).distinct()
    no = L.cohort(s, [("view", "noCHX", "view"), ("click", "noCHX", "click")], "untreated")
    yes = L.cohort(s, [("view", "^(?!.*noCHX)", "view"), ("error", "^(?!.*noCHX)", "error")], "treated")
    return no.unionByName(yes)


# ---- windows -------------------------------------------------------------------------------------


def _frame(w: int) -> str:
    return f"(PARTITION BY sample, gene ORDER BY pos ROWS BETWEEN {w} PRECEDING AND {w} FOLLOWING)"


@query(
    "W1_smooth",
    f"SELECT sample, gene, pos, round(CASE WHEN count(*) OVER w = 7 THEN avg(n) OVER w ELSE n END, 6) AS smoothed FROM positions WINDOW w AS {_frame(3)}",
)
def _(t):
    return rounded(W.smooth(t.positions, ["sample", "gene"], "pos", "n", 3), "smoothed").select("sample", "gene", "pos", "smoothed")


@query(
    "W2_smooth_with_edges",
    f"""
SELECT sample, gene, pos, round(CASE WHEN pos >= length - 4 THEN avg(n) OVER r WHEN pos < 4 THEN avg(n) OVER l ELSE avg(n) OVER w END, 6) AS smoothed
FROM (SELECT *, count(*) OVER (PARTITION BY sample, gene) AS length FROM positions)
WINDOW w AS {_frame(4)}, l AS (PARTITION BY sample, gene ORDER BY pos), r AS (PARTITION BY sample, gene ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def _(t):
    lengths = t.positions.groupBy("sample", "gene").agg(F.count(F.lit(1)).alias("length"))
    return rounded(W.smooth_edges(t.positions, ["sample", "gene"], "pos", "n", 4, lengths), "smoothed").select("sample", "gene", "pos", "smoothed")


@query(
    "W3_smooth_outside",
    f"""
SELECT sample, gene, pos - 30 AS pos, round(CASE WHEN count(*) OVER w = 5 AND abs(pos - 30) >= 10 THEN avg(n) OVER w ELSE n END, 6) AS smoothed FROM positions WINDOW w AS {_frame(2)}""",
)
def _(t):
    moved = t.positions.withColumn("pos", F.col("pos") - 30)
    return rounded(W.smooth_outside(moved, ["sample", "gene"], "pos", "n", 2), "smoothed").select("sample", "gene", "pos", "smoothed")


@query(
    "W4_running_densities",
    """
SELECT sample, gene, pos, round(avg(n) OVER (PARTITION BY sample, gene ORDER BY pos), 6) AS so_far,
  round(avg(n) OVER (PARTITION BY sample, gene ORDER BY pos DESC), 6) AS remaining,
  round(COALESCE(sum(n) OVER (PARTITION BY sample, gene ORDER BY pos ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), 0) / 10.0, 6) AS over_previous FROM positions""",
)
def _(t):
    d = W.running_densities(t.positions, ["sample", "gene"], "pos", "n")
    return rounded(d, "so_far", "remaining", "over_previous").select("sample", "gene", "pos", "so_far", "remaining", "over_previous")


@query(
    "W5_codon_ranks",
    f"""
WITH a AS (SELECT sample, label, round(area, 6) AS area FROM ({_area('"offset" BETWEEN -2 AND 0')}))
SELECT sample, label, area, row_number() OVER (PARTITION BY sample ORDER BY area, label) - 1 AS rank FROM a""",
)
def _(t):
    return W.ranks(rounded(K.areas(enr(t), [ACTIVE]), "area"), ["sample"], "label", "area")


_RANK_CHANGES = f"""
WITH a AS (SELECT sample, label, round(area, 6) AS area FROM ({_area('"offset" BETWEEN -2 AND 0')})),
r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY area, label) - 1 AS rank FROM a),
d AS (SELECT x.label, x.rank - y.rank AS rank_change, round(log2(greatest(0.00390625, x.area)) - log2(greatest(0.00390625, y.area)), 6) AS log_change, round(x.area - y.area, 6) AS raw_change
FROM r x JOIN r y ON y.label = x.label AND y.sample = 'S2' WHERE x.sample = 'S0') """


def rank_changes(t):
    order = t.spark.createDataFrame([("S0", 0), ("S1", 1), ("S2", 2)], "sample string, place int")
    ranked = W.ranks(rounded(K.areas(enr(t), [ACTIVE]), "area"), ["sample"], "label", "area")
    return rounded(W.rank_changes(ranked, order, "label", "area"), "log_change", "raw_change")


@query("W5_rank_changes", _RANK_CHANGES + "SELECT * FROM d")
def _(t):
    return rank_changes(t)


@query("O3_largest_changes", _RANK_CHANGES + "SELECT * FROM d ORDER BY abs(raw_change) DESC, label LIMIT 10")
def _(t):
    return W.largest_changes(rank_changes(t), "label", "raw_change", 10)


@query(
    "W5_dicodon_ranks",
    """
SELECT sample, label, enrichment, row_number() OVER (PARTITION BY sample ORDER BY enrichment, label) - 1 AS rank FROM (
  SELECT sample, p_codon || a_codon AS label, round(enrichment, 6) AS enrichment FROM dicodon_enrichments WHERE min_mean = 0.1 AND excl_start = 90 AND "offset" = 0)""",
)
def _(t):
    d = P.stratified_enrichments(t.codon_counts, [(90, 90)], [0.1], AROUND, dicodons=True, dense=False).where("feature = 'dicodon' and offset = 0")
    return W.ranks(rounded(d, "enrichment").select("sample", "label", "enrichment"), ["sample"], "label", "enrichment")


@query(
    "W6_exon_numbers",
    'SELECT gene, "start", row_number() OVER (PARTITION BY gene ORDER BY "start") AS exon_no FROM exons',
)
def _(t):
    from pyspark.sql import Window

    return t.exons.select("gene", "start", F.row_number().over(Window.partitionBy("gene").orderBy("start")).alias("exon_no"))


@query(
    "W7_argmax",
    """
SELECT sample, gene, min(pos) AS argmax, max(n) AS largest FROM (SELECT *, max(n) OVER (PARTITION BY sample, gene) AS top FROM positions) WHERE n = top GROUP BY ALL""",
)
def _(t):
    return W.argmax(t.positions, ["sample", "gene"], "pos", "n")


@query(
    "W7_n_largest",
    "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY sample, gene ORDER BY n DESC, pos) AS rank FROM positions) WHERE rank <= 5",
)
def _(t):
    return W.n_largest(t.positions, ["sample", "gene"], "pos", "n", 5)


# ---- merging and arithmetic ------------------------------------------------------------------------


@query(
    "O4_merge_pathways",
    "SELECT sample, seqname, pos, aend, strand, 'first' AS pathway FROM mapped UNION ALL SELECT sample, seqname, pos + nongenomic_length, aend, strand, 'second' FROM mapped",
)
def _(t):
    from footprints.sources import alignments as io

    first = t.mapped.withColumn("pathway", F.lit("first"))
    second = t.mapped.withColumn("pos", F.col("pos") + F.col("nongenomic_length")).withColumn("pathway", F.lit("second"))
    return io.merge_pathways(first, second).select("sample", "seqname", "pos", "aend", "strand", "pathway")


@query("O6_merge_sums", "SELECT gene, pos, CAST(sum(n) AS BIGINT) AS n FROM positions GROUP BY ALL")
def _(t):
    parts = [t.positions.where(F.col("sample") == s).select("gene", "pos", "n") for s in ("x", "y")]
    return L.merge_sums(parts, ["gene", "pos"], ["n"])


@query("O6_merge_same_keys", "SELECT gene, pos, CAST(sum(n) AS BIGINT) AS n FROM positions GROUP BY ALL")
def _(t):
    x, y = [t.positions.where(F.col("sample") == s).select("gene", "pos", "n") for s in ("x", "y")]
    return L.merge_same_keys(x, y, ["gene", "pos"], "n")


@query("O7_merge_disjoint", "SELECT sample, gene, n, cds_length FROM gene_counts")
def _(t):
    g = gene_counts(t)
    return L.merge_disjoint([g.where("sample <= 'S0'"), g.where("sample > 'S0'")], ["sample", "gene"])


@query(
    "O8_position_arithmetic",
    """
SELECT a.gene, a.pos, a.n + b.n AS added, a.n - b.n AS subtracted, round(CASE WHEN b.n <> 0 THEN a.n / b.n END, 6) AS divided
FROM positions a JOIN positions b ON b.gene = a.gene AND b.pos = a.pos AND b.sample = 'y' WHERE a.sample = 'x'""",
)
def _(t):
    x, y = [t.positions.where(F.col("sample") == s).select("gene", "pos", "n") for s in ("x", "y")]
    keys = ["gene", "pos"]
    out = L.combine(x, y, keys, "n", "+").withColumnRenamed("n", "added").join(L.combine(x, y, keys, "n", "-").withColumnRenamed("n", "subtracted"), keys)
    return rounded(out.join(L.combine(x, y, keys, "n", "/").withColumnRenamed("n", "divided"), keys), "divided")


@query(
    "O8_landmark_slices",
    """
SELECT sample, p.gene, 'slice' AS kind, pos - s AS rel, n FROM positions p JOIN (SELECT gene, 10 + gene % 5 AS s, max(pos) - 8 AS e FROM positions GROUP BY gene) g ON g.gene = p.gene
WHERE pos - s >= -6 AND pos < e + 3 AND (pos - s + 6) % 3 = 0
UNION ALL SELECT sample, p.gene, 'list', pos - s, n FROM positions p JOIN (SELECT gene, 10 + gene % 5 AS s FROM positions GROUP BY gene) g ON g.gene = p.gene WHERE pos - s IN (-4, 0, 7)""",
)
def _(t):
    g = t.positions.groupBy("gene").agg((F.max("pos") - 8).alias("stop_codon")).withColumn("start_codon", 10 + F.col("gene") % 5)
    sliced = L.landmark_slice(t.positions, g, "start_codon", -6, 3, 3, "stop_codon").withColumn("kind", F.lit("slice"))
    listed = L.landmark_positions(t.positions, g, "start_codon", [-4, 0, 7]).withColumn("kind", F.lit("list"))
    return sliced.unionByName(listed).select("sample", "gene", "kind", "rel", "n")
