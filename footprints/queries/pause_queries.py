"""Queries on pause statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from footprints import constants as C
from footprints.operators import pausing as P
from footprints.queries.registry import VIEWS, query

EDGES = [(90, 90), (200, 200), (200, 0), (300, 0), (0, 0)]
MIN_MEANS = [0.1, 50.0]
AROUND = 100
BEFORE = AFTER = 90
_EDGES = ", ".join(map(str, EDGES))
_MEANS = ", ".join(f"({m}::DOUBLE)" for m in MIN_MEANS)
_CONDITIONS = [(m, a, b) for a, b in EDGES for m in MIN_MEANS]

VIEWS.update(
    {
        "cds": """
SELECT sample, gene, codon_idx - 2 AS i, codon, relaxed AS n, num_codons - 2 AS length FROM codon_counts WHERE codon_idx >= 2 AND codon_idx < num_codons""",
        "scores": """
WITH m AS (SELECT sample, gene, median(n) AS med FROM cds GROUP BY ALL),
q AS (SELECT gene FROM m GROUP BY gene HAVING count(*) FILTER (med >= 36) = (SELECT count(DISTINCT sample) FROM cds)),
s AS (SELECT sample, gene, sum(n) AS s, count(*) AS c FROM cds GROUP BY ALL)
SELECT d.sample, COALESCE(v.name, 'not_special') AS set, d.gene, i, d.codon, n, n / ((s.s - n) / (s.c - 1)) AS ratio
FROM cds d JOIN q ON q.gene = d.gene JOIN s ON s.sample = d.sample AND s.gene = d.gene
LEFT JOIN (VALUES ('proline', 'CCA'), ('proline', 'CCG'), ('proline', 'CCT'), ('his', 'CAT'), ('his', 'CAC'), ('mix', 'CAT')) v(name, codon) ON v.codon = d.codon""",
        "high_genes": f"""
WITH u AS (SELECT * FROM cds WHERE length >= {BEFORE + AFTER + 1} AND i >= {BEFORE} AND i < length - {AFTER}),
g AS (SELECT sample, gene, avg(n) AS mean, median(n) AS med FROM u GROUP BY ALL)
SELECT gene FROM g GROUP BY gene HAVING count(*) FILTER (mean > 50 AND med >= 30) = (SELECT count(DISTINCT sample) FROM cds)""",
        "sites": f"""
WITH c AS (SELECT * FROM cds WHERE gene IN (SELECT gene FROM high_genes)),
m AS (SELECT sample, gene, avg(n) AS mean FROM c WHERE i >= {BEFORE} AND i < length - {AFTER} GROUP BY ALL)
SELECT c.sample, c.gene, c.i, c.n, c.n / mean AS ratio, mean FROM c JOIN m ON m.sample = c.sample AND m.gene = c.gene
WHERE i >= {BEFORE} AND i < length - {AFTER} AND left(codon, 1) IN ('C', 'G')
  AND NOT EXISTS (SELECT 1 FROM c b WHERE b.sample = c.sample AND b.gene = c.gene AND ((b.i = c.i + 1 AND b.codon IN ('CCA', 'CCG')) OR (b.i = c.i - 2 AND b.codon = 'AAA')))""",
        "contexts": f"""
SELECT s.sample, s.gene, s.i, s.ratio AS site_ratio, CAST(d.i - s.i AS INTEGER) AS "offset", d.codon, d.n, d.n / s.mean AS ratio, (s.gene % 7) / 2.0 AS te
FROM sites s JOIN cds d ON d.sample = s.sample AND d.gene = s.gene AND d.i - s.i BETWEEN -{BEFORE} AND {AFTER}""",
        "context_bases": """
SELECT sample, gene, i, site_ratio, ratio, "offset" * 3 + k AS o, substr(codon, CAST(k + 1 AS BIGINT), 1) AS base FROM contexts, range(0, 3) r(k)""",
        "single_means": """
SELECT o AS "offset", base, COALESCE(r, 0) AS ratio FROM (SELECT DISTINCT o FROM context_bases) CROSS JOIN (VALUES ('T'), ('C'), ('A'), ('G')) v(base)
LEFT JOIN (SELECT o, base, avg(site_ratio) AS r FROM context_bases GROUP BY ALL) USING (o, base)""",
        "pair_means": """
WITH t AS (SELECT sample, gene, i, o, base, site_ratio FROM context_bases WHERE o BETWEEN -16 AND 12)
SELECT a.o AS first_offset, b.o AS second_offset, a.base AS first_base, b.base AS second_base, avg(a.site_ratio) AS ratio
FROM t a JOIN t b ON a.sample = b.sample AND a.gene = b.gene AND a.i = b.i AND a.o < b.o GROUP BY ALL""",
        "sense_codons": f"SELECT substr('{''.join(C.NON_STOP_CODONS)}', CAST(3 * i + 1 AS BIGINT), 3) AS codon FROM range(0, 61) r(i)",
        "codon_means": """
SELECT "offset", codon, COALESCE(r, 0) AS ratio FROM (SELECT DISTINCT "offset" FROM contexts) CROSS JOIN sense_codons
LEFT JOIN (SELECT "offset", codon, avg(site_ratio) AS r FROM contexts GROUP BY ALL) USING ("offset", codon)""",
        "breakpoints": f"""
SELECT sample, gene, excl_start, excl_end, min_mean, mean FROM (
  SELECT sample, gene, a AS excl_start, b AS excl_end, CASE WHEN any_value(length) <= a + b THEN -1 ELSE avg(n) FILTER (i >= a AND i < length - b) END AS mean
  FROM cds, (VALUES {_EDGES}) v(a, b) GROUP BY sample, gene, a, b), (VALUES {_MEANS}) m(min_mean) WHERE mean > min_mean""",
        "cond_means": f"""
SELECT sample, gene, {", ".join(f"avg(n) FILTER (i >= {a} AND i < length - {b}) AS m{k}" for k, (m, a, b) in enumerate(_CONDITIONS))} FROM cds GROUP BY sample, gene""",
        "cond_sites": f"""
SELECT c.sample, c.gene, c.i, {", ".join(f"CASE WHEN i >= {a} AND i < length - {b} AND m{k} > {m} AND m{k} > 0 THEN n / m{k} END AS r{k}" for k, (m, a, b) in enumerate(_CONDITIONS))}
FROM cds c JOIN cond_means m ON m.sample = c.sample AND m.gene = c.gene""",
        "cond_sums": f"""
SELECT sample, o, codon, before, x.min_mean AS min_mean, x.excl_start AS excl_start, x.excl_end AS excl_end, x.c AS c, x.s AS s FROM (
  SELECT sample, o, codon, before, unnest([{", ".join(
      f"{{'min_mean': {m}::DOUBLE, 'excl_start': {a}, 'excl_end': {b}, 'c': c{k}, 's': s{k}}}" for k, (m, a, b) in enumerate(_CONDITIONS))}]) AS x FROM (
    SELECT c.sample, CAST(d.i - c.i AS INTEGER) AS o, d.codon, d.before, {", ".join(f"count(r{k}) AS c{k}, sum(r{k}) AS s{k}" for k in range(len(_CONDITIONS)))}
    FROM cond_sites c JOIN (SELECT sample, gene, i, codon, lag(codon) OVER (PARTITION BY sample, gene ORDER BY i) AS before FROM cds) d
      ON d.sample = c.sample AND d.gene = c.gene AND d.i BETWEEN c.i - {AROUND} AND c.i + {AROUND} GROUP BY ALL)) WHERE x.c > 0""",
        "conditions": f"SELECT * FROM (VALUES {_EDGES}) v(excl_start, excl_end), (VALUES {_MEANS}) m(min_mean)",
        "all_codon_labels": f"SELECT substr('{''.join(C.ALL_CODONS)}', CAST(3 * i + 1 AS BIGINT), 3) AS label FROM range(0, 64) r(i)",
        "enrichment_grid": f"""
SELECT sample, min_mean, excl_start, excl_end, feature, CAST(o AS INTEGER) AS "offset", label FROM (SELECT DISTINCT sample FROM codon_counts), conditions, (
  SELECT 'codon' AS feature, o, label FROM all_codon_labels, range(-{AROUND}, {AROUND + 1}) r(o)
  UNION ALL SELECT 'nucleotide', o, label FROM (VALUES ('T'), ('C'), ('A'), ('G')) b(label), range({-3 * AROUND}, {3 * AROUND + 3}) r(o))""",
        "codon_sums": "SELECT sample, min_mean, excl_start, excl_end, o, codon, sum(c) AS c, sum(s) AS s FROM cond_sums GROUP BY ALL",
        "enrichments": """
SELECT g.*, COALESCE(c, 0) AS occurrences, COALESCE(s / c, 0) AS enrichment FROM enrichment_grid g LEFT JOIN (
  SELECT sample, min_mean, excl_start, excl_end, 'codon' AS feature, o AS "offset", codon AS label, CAST(c AS BIGINT) AS c, s FROM codon_sums
  UNION ALL SELECT sample, min_mean, excl_start, excl_end, 'nucleotide', o * 3 + k, substr(codon, CAST(k + 1 AS BIGINT), 1), CAST(sum(c) AS BIGINT), sum(s)
  FROM codon_sums, range(0, 3) r(k) GROUP BY ALL)
USING (sample, min_mean, excl_start, excl_end, feature, "offset", label)""",
    }
)


def special_sets(t):
    rows = [("proline", "CCA"), ("proline", "CCG"), ("proline", "CCT"), ("his", "CAT"), ("his", "CAC"), ("mix", "CAT")]
    return t.spark.createDataFrame(rows, "set string, codon string")


def scores(t):
    return P.pause_scores(t.codon_counts, special_sets(t), 36)


def high_genes(t):
    return P.highly_expressed(t.codon_counts, 50, 30, before=BEFORE, after=AFTER)


def sites(t):
    relevant = t.spark.createDataFrame([(c,) for c in C.NON_STOP_CODONS if c[0] in "CG"], "codon string")
    forbidden = t.spark.createDataFrame([(1, "CCA"), (1, "CCG"), (-2, "AAA")], "offset int, codon string")
    return P.pause_sites(t.codon_counts, high_genes(t), relevant, forbidden, before=BEFORE, after=AFTER)


def te(t):
    return t.codon_counts.select("gene").distinct().withColumn("te", (F.col("gene") % 7) / 2.0)


def sums(t, label=None, pairs=False, of=None):
    return P.context_sums(sites(t) if of is None else of, t.codon_counts, te(t), label, before=BEFORE, after=AFTER, pairs=pairs)


def base_pairs(t):
    # Nucleotides -16 to 12 lie in codons -6 to 4.
    return P.mean_by_base_pair(P.site_contexts(sites(t), t.codon_counts, before=6, after=4))


def enrichments(t, dicodons=False):
    return P.stratified_enrichments(t.codon_counts, EDGES, MIN_MEANS, AROUND, dicodons=dicodons)


def rounded(df, *columns, digits=6):
    for c in columns:
        df = df.withColumn(c, F.round(c, digits))
    return df


@query(
    "A23_mean_of_rest",
    """
SELECT sample, gene, i, n, round((sum(n) OVER w - n) / (count(*) OVER w - 1), 6) AS rest FROM cds WINDOW w AS (PARTITION BY sample, gene)""",
)
def _(t):
    return rounded(P.mean_of_rest(P.cds_codons(t.codon_counts), ["sample", "gene"]), "rest").select("sample", "gene", "i", "n", "rest")


@query("A24_pause_scores", "SELECT sample, set, gene, i, codon, n, round(ratio, 6) AS ratio FROM scores")
def _(t):
    return rounded(scores(t), "ratio")


@query("A25_highly_expressed_genes", "SELECT gene FROM high_genes")
def _(t):
    return high_genes(t)


@query("A26_pause_sites", "SELECT sample, gene, i, n, round(ratio, 6) AS ratio FROM sites")
def _(t):
    return rounded(sites(t), "ratio").drop("mean")


@query(
    "A26_site_contexts",
    """
SELECT sample, "offset", codon, count(*) AS n_sites, CAST(sum(n) AS BIGINT) AS n, round(sum(ratio), 5) AS ratio, round(sum(site_ratio * te), 5) AS weighted FROM contexts GROUP BY ALL""",
)
def _(t):
    g = sums(t).select("sample", "offset", "codon", F.col("sites").alias("n_sites"), "n", "ratio", "weighted")
    return rounded(g, "ratio", "weighted", digits=5)


@query(
    "A26_contexts_of_strong_sites",
    'SELECT sample, gene, i, round(site_ratio, 6) AS site_ratio, te, "offset", codon, n, round(ratio, 6) AS ratio FROM contexts WHERE site_ratio > 1.9',
)
def _(t):
    strong = sites(t).where("ratio > 1.9")
    return rounded(P.site_contexts(strong, t.codon_counts, te(t), before=BEFORE, after=AFTER), "site_ratio", "ratio")


def _quantiles(value, table, parts):
    return f"""
SELECT q, CASE WHEN k >= n THEN xs[n] ELSE (1 - g) * xs[k] + g * xs[k + 1] END AS quantile FROM (
  SELECT q, xs, n, CAST(greatest(1, floor(greatest(1, least(a, n - 1)))) AS BIGINT) AS k,
         least(1, greatest(0, a - floor(greatest(1, least(a, n - 1))))) AS g
  FROM (SELECT q, xs, n, n * q / {parts}.0 + 0.4 + 0.2 * q / {parts}.0 AS a FROM (SELECT list({value} ORDER BY {value}) AS xs, count(*) AS n FROM {table}), range(0, {parts + 1}) r(q)))"""


VIEWS.update(
    {
        "ratio_quantiles": _quantiles("ratio", "contexts WHERE \"offset\" = -2", 5),
        "te_quantiles": _quantiles("te", "contexts WHERE \"offset\" = 0", 4),
        "ratio_edges": """
SELECT CAST(row_number() OVER (ORDER BY q) - 1 AS INTEGER) AS bin, quantile AS lo, lead(quantile) OVER (ORDER BY q) AS hi
FROM (SELECT *, sum(CASE WHEN quantile = 0 THEN 1 ELSE 0 END) OVER () AS z FROM ratio_quantiles) WHERE q >= greatest(z - 1, 0) QUALIFY lead(quantile) OVER (ORDER BY q) IS NOT NULL""",
        "te_edges": """
SELECT CAST(q AS INTEGER) AS bin, quantile AS lo, lead(quantile) OVER (ORDER BY q) AS hi FROM te_quantiles QUALIFY lead(quantile) OVER (ORDER BY q) IS NOT NULL""",
        "ratio_bins": """
SELECT sample, gene, i, CAST(bin AS VARCHAR) AS bin FROM contexts JOIN ratio_edges ON ratio >= lo AND ratio < hi WHERE "offset" = -2
UNION ALL SELECT sample, gene, i, 'all' FROM contexts WHERE "offset" = -2""",
        "te_bins": """
SELECT sample, gene, i, CAST(bin AS VARCHAR) AS bin FROM contexts JOIN te_edges ON te >= lo AND te < hi WHERE "offset" = 0
UNION ALL SELECT sample, gene, i, 'all' FROM contexts WHERE "offset" = 0""",
    }
)


def ratio_edges(t):
    return P.bin_edges(P.ratios_at(sites(t), t.codon_counts, -2), "ratio", 5, True)


def labelled(t):
    """Sites with the bin of the ratio two codons ahead of them as label."""
    s = sites(t)
    at = P.ratios_at(s, t.codon_counts, -2).withColumnRenamed("ratio", "_at")
    joined = s.join(at, ["sample", "gene", "i"])
    return P.bin_labels(joined, P.bin_edges(at, "_at", 5, True), "_at")


def ratio_bins(t):
    at = P.ratios_at(sites(t), t.codon_counts, -2)
    return P.assign_bins(at, P.bin_edges(at, "ratio", 5, True), "ratio")


def te_bins(t):
    at = sites(t).join(te(t), "gene").select("sample", "gene", "i", "te")
    return P.assign_bins(at, P.bin_edges(at, "te", 4, False), "te")


@query("A28_quantile_edges", "SELECT bin, round(lo, 6) AS lo, round(hi, 6) AS hi FROM ratio_edges")
def _(t):
    return rounded(ratio_edges(t), "lo", "hi")


@query("A28_quantile_bins", "SELECT sample, bin, count(*) AS n, CAST(sum(i) AS BIGINT) AS i_sum FROM ratio_bins GROUP BY ALL")
def _(t):
    return ratio_bins(t).groupBy("sample", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("i_sum"))


@query("A28_te_bins", "SELECT sample, bin, count(*) AS n, CAST(sum(i) AS BIGINT) AS i_sum FROM te_bins GROUP BY ALL")
def _(t):
    return te_bins(t).groupBy("sample", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("i").alias("i_sum"))


_COMPOSITION = """
WITH c AS (SELECT bin, o, base, count(*) AS c FROM context_bases JOIN ratio_bins USING (sample, gene, i) GROUP BY ALL),
f AS (SELECT bin, o, base, c / sum(c) OVER (PARTITION BY bin, o) AS fraction FROM c) """


@query("A27_binned_base_composition", _COMPOSITION + 'SELECT bin, o AS "offset", base, round(fraction, 6) AS fraction FROM f')
def _(t):
    return rounded(P.binned_base_composition(sums(t, F.col("label"), of=labelled(t))), "fraction")


@query(
    "A27_relative_base_composition",
    _COMPOSITION
    + """SELECT f.bin, f.o AS "offset", f.base, round(f.fraction / greatest(0.1, a.fraction), 6) AS fraction FROM f JOIN f a ON a.bin = 'all' AND a.o = f.o AND a.base = f.base
WHERE f.bin <> 'all'""",
)
def _(t):
    return rounded(P.binned_base_composition(sums(t, F.col("label"), of=labelled(t)), relative=True), "fraction")


@query(
    "A29_binned_means",
    """
SELECT bin, "offset", round(avg(ratio), 6) AS ratio, round(avg(te), 6) AS te FROM contexts JOIN ratio_bins USING (sample, gene, i)
WHERE bin <> 'all' AND "offset" BETWEEN -40 AND 40 GROUP BY ALL""",
)
def _(t):
    return rounded(P.binned_means(sums(t, F.col("label"), of=labelled(t))), "ratio", "te")


@query("A71_profiles_by_centre", 'SELECT site_ratio > 1 AS above, "offset", round(avg(ratio), 6) AS ratio FROM contexts GROUP BY ALL')
def _(t):
    return rounded(P.split_profiles(sums(t, P.above_one(F.col("ratio")))), "ratio")


@query("A30_mean_by_base", 'SELECT "offset", base, round(ratio, 6) AS ratio FROM single_means')
def _(t):
    return rounded(P.mean_by_base(sums(t)), "ratio")


@query("A30_mean_by_base_pair", "SELECT first_offset, second_offset, first_base, second_base, round(ratio, 6) AS ratio FROM pair_means")
def _(t):
    return rounded(base_pairs(t), "ratio")


@query("A30_mean_by_codon", 'SELECT "offset", codon, round(ratio, 6) AS ratio FROM codon_means')
def _(t):
    return rounded(P.mean_by_codon(sums(t)), "ratio")


@query(
    "A30_mean_by_codon_pair",
    """
SELECT a."offset", a.codon AS p_codon, b.codon AS a_codon, round(avg(a.site_ratio), 6) AS ratio FROM contexts a
JOIN contexts b ON a.sample = b.sample AND a.gene = b.gene AND a.i = b.i AND b."offset" = a."offset" + 1 GROUP BY ALL""",
)
def _(t):
    return rounded(P.mean_by_codon_pair(sums(t, pairs=True)), "ratio")


@query("A30_overall_mean", "SELECT round(avg(ratio), 6) AS baseline FROM sites")
def _(t):
    return rounded(P.overall_mean(sites(t)), "baseline")


VIEWS["codon_effects"] = """
SELECT c."offset", c.codon, a.ratio * b.ratio * d.ratio / pow(z, 3) AS expected, c.ratio / z AS actual FROM codon_means c
JOIN single_means a ON a."offset" = c."offset" * 3 AND a.base = substr(c.codon, 1, 1) JOIN single_means b ON b."offset" = c."offset" * 3 + 1 AND b.base = substr(c.codon, 2, 1)
JOIN single_means d ON d."offset" = c."offset" * 3 + 2 AND d.base = substr(c.codon, 3, 1), (SELECT avg(ratio) AS z FROM sites)"""


@query(
    "A35_base_pair_effects",
    """
SELECT p.first_offset, p.second_offset, p.first_base, p.second_base, round(a.ratio * b.ratio / pow(z, 2), 6) AS expected, round(p.ratio / z, 6) AS actual
FROM pair_means p JOIN single_means a ON a."offset" = p.first_offset AND a.base = p.first_base
JOIN single_means b ON b."offset" = p.second_offset AND b.base = p.second_base, (SELECT avg(ratio) AS z FROM sites)""",
)
def _(t):
    return rounded(P.base_pair_effects(base_pairs(t), P.mean_by_base(sums(t)), P.overall_mean(sites(t))), "expected", "actual")


@query("A35_codon_effects", 'SELECT "offset", codon, round(expected, 6) AS expected, round(actual, 6) AS actual FROM codon_effects')
def _(t):
    c, s = sums(t), sites(t)
    return rounded(P.codon_effects(P.mean_by_codon(c), P.mean_by_base(c), P.overall_mean(s)), "expected", "actual")


@query(
    "A35_codon_outliers",
    'SELECT "offset", codon, round(expected, 6) AS expected, round(actual, 6) AS actual FROM codon_effects WHERE expected > 0 AND actual > 0 AND abs(log2(expected) - log2(actual)) > 0.3',
)
def _(t):
    c, s = sums(t), sites(t)
    return rounded(P.outliers(P.codon_effects(P.mean_by_codon(c), P.mean_by_base(c), P.overall_mean(s)), 0.3), "expected", "actual")


VIEWS["dicodon_enrichments"] = f"""
SELECT sample, min_mean, excl_start, excl_end, o AS "offset", before AS p_codon, codon AS a_codon, CAST(sum(c) AS BIGINT) AS occurrences, sum(s) / sum(c) AS enrichment
FROM cond_sums WHERE before IS NOT NULL AND o > -{AROUND} GROUP BY ALL"""


@query(
    "A35_codon_pair_effects",
    """
SELECT d.sample, p_codon, a_codon, round(p.enrichment * a.enrichment, 6) AS expected, round(d.enrichment, 6) AS actual, d.occurrences FROM dicodon_enrichments d
JOIN enrichments p ON p.sample = d.sample AND p.min_mean = 0.1 AND p.excl_start = 90 AND p.feature = 'codon' AND p."offset" = -1 AND p.label = p_codon
JOIN enrichments a ON a.sample = d.sample AND a.min_mean = 0.1 AND a.excl_start = 90 AND a.feature = 'codon' AND a."offset" = 0 AND a.label = a_codon
WHERE d.min_mean = 0.1 AND d.excl_start = 90 AND d."offset" = 0""",
)
def _(t):
    one = enrichments(t, dicodons=True).where("min_mean = 0.1D and excl_start = 90")
    return rounded(P.codon_pair_effects(one), "expected", "actual")


@query(
    "A31_density_breakpoints",
    "SELECT sample, gene, excl_start, excl_end, min_mean, round(mean, 6) AS mean FROM breakpoints",
)
def _(t):
    return rounded(P.density_breakpoints(t.codon_counts, EDGES, MIN_MEANS), "mean")


@query(
    "A32_stratified_enrichments",
    'SELECT sample, min_mean, excl_start, excl_end, feature, "offset", label, occurrences, round(enrichment, 6) AS enrichment FROM enrichments',
)
def _(t):
    return rounded(enrichments(t), "enrichment")


@query(
    "A32_dicodon_enrichments",
    """
SELECT sample, min_mean, excl_start, excl_end, "offset", p_codon || a_codon AS label, occurrences, round(enrichment, 6) AS enrichment FROM dicodon_enrichments""",
)
def _(t):
    both = P.stratified_enrichments(t.codon_counts, EDGES, MIN_MEANS, AROUND, dicodons=True, dense=False)
    return rounded(both.where("feature = 'dicodon'").drop("feature"), "enrichment")


@query(
    "A32_relevant_counts",
    """
SELECT p.sample, excl_start, excl_end, min_mean, CAST(sum(n) AS BIGINT) AS n FROM breakpoints p JOIN cds c ON c.sample = p.sample AND c.gene = p.gene
WHERE i >= excl_start AND i < length - excl_end GROUP BY ALL""",
)
def _(t):
    return P.relevant_counts(t.codon_counts, EDGES, MIN_MEANS)


@query(
    "A33_enrichment_slice",
    """
SELECT sample, "offset", label, round(enrichment, 6) AS enrichment FROM enrichments
WHERE min_mean = 0.1 AND excl_start = 90 AND feature = 'codon' AND "offset" BETWEEN -100 AND 99 AND label IN ('CCA', 'CCG', 'AAA')""",
)
def _(t):
    part = P.enrichment_slice(enrichments(t), "codon", -AROUND, AROUND, ["CCA", "CCG", "AAA"])
    return rounded(part, "enrichment").select("sample", "offset", "label", "enrichment")


@query(
    "A34_survival",
    """
SELECT sample, set, round(ratio, 9) AS ratio, n, round(1 - cum / sum(n) OVER (PARTITION BY sample, set), 6) AS above FROM (
  SELECT sample, set, ratio, n, sum(n) OVER (PARTITION BY sample, set ORDER BY ratio) AS cum FROM (SELECT sample, set, round(ratio, 9) AS ratio, count(*) AS n FROM scores GROUP BY ALL))""",
)
def _(t):
    return rounded(P.survival(rounded(scores(t), "ratio", digits=9)), "above")


@query(
    "F32_floored_log2",
    """
SELECT sample, set, gene, i, round(log2(greatest(ratio, min(CASE WHEN ratio > 0 THEN ratio END) OVER (PARTITION BY sample, set))), 6) AS log2,
       round(log2(greatest(0.00390625, ratio)), 6) AS fixed FROM scores""",
)
def _(t):
    s = P.floored_log2(scores(t), ["sample", "set"], "ratio").withColumn("fixed", P.fixed_floor_log2(F.col("ratio")))
    return rounded(s, "log2", "fixed").select("sample", "set", "gene", "i", "log2", "fixed")
