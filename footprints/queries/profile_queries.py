"""Queries on profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from footprints import constants as C
from footprints.operators import coords, counts, dimensions, metagene as M
from footprints.queries import counting, inputs
from footprints.queries.registry import VIEWS, query

VIEWS.update(
    {
        "lonely": """
SELECT *, stop_codon_t - start_codon_t AS cds FROM genes
WHERE gene % 9 <> 0 AND (1 + (gene * 7) % 400 > 330 OR transcript_length + (gene * 7) % 400 - stop_codon_t >= 100)""",
        "marked": """
SELECT gene, start_codon_t, m.* FROM (SELECT gene, start_codon_t, unnest([
  {'landmark': 'start', 'origin': -start_codon_t, 'lo': -330, 'hi': cds, 'ulo': 0, 'uhi': cds},
  {'landmark': 'start_codon', 'origin': 0, 'lo': -330, 'hi': cds, 'ulo': -330, 'uhi': cds},
  {'landmark': 'stop_codon', 'origin': cds, 'lo': -cds, 'hi': 330, 'ulo': -cds, 'uhi': 330},
  {'landmark': 'end', 'origin': transcript_length - start_codon_t, 'lo': -cds, 'hi': 330, 'ulo': -cds, 'uhi': 0}]) AS m FROM lonely)""",
        "landmark_counts": """
SELECT p.sample, p.key, p.n, p.pos - m.origin AS rel, m.* FROM position_counts p JOIN marked m ON m.gene = p.gene
WHERE p.read_end = 'five'""",
        "gene_densities": """
SELECT sample, key, landmark, gene, ulo, uhi, sum(n) / (uhi - ulo) AS density FROM landmark_counts WHERE rel >= ulo AND rel < uhi GROUP BY sample, key, landmark, gene, ulo, uhi""",
        "metagene_raw": """
SELECT sample, key, landmark, rel, CAST(sum(actual) AS BIGINT) AS actual, sum(uniform) AS uniform,
       sum(enr) AS sum_of_enrichments, CAST(sum(elig) AS BIGINT) AS num_eligible FROM (
  SELECT l.sample, l.key, l.landmark, rel, CASE WHEN rel >= lo AND rel < hi THEN n ELSE 0 END AS actual, 0.0::DOUBLE AS uniform,
         CASE WHEN rel >= l.ulo AND rel < l.uhi THEN n / density ELSE 0 END AS enr, 0 AS elig
  FROM landmark_counts l LEFT JOIN gene_densities d ON d.sample = l.sample AND d.key = l.key AND d.landmark = l.landmark AND d.gene = l.gene
  UNION ALL SELECT sample, key, landmark, unnest(range(ulo, uhi)), 0, density, 0, 1 FROM gene_densities)
GROUP BY ALL HAVING sum(actual) > 0 OR sum(enr) > 0 OR sum(elig) > 0""",
        "extent_counts": "SELECT sample, gene, 'x' AS key, pos AS rel, n FROM positions",
        "long_extents": "SELECT 'x' AS sample, gene, rn AS rel, v AS n FROM long_genes",
        "long_rel_genes": "SELECT DISTINCT gene, CAST(n_rows - 5 AS INTEGER) AS cds_length FROM long_genes",
        "rel_genes": "SELECT gene, CAST(max(pos) + 1 - 5 AS INTEGER) AS cds_length FROM positions GROUP BY gene",
    }
)


def isolated(t):
    plus = F.col("strand") == "+"
    d = 1 + (F.col("gene") * 7) % 400
    models = counting.models(t).withColumn("overlapping", F.when(F.col("gene") % 9 == 0, 1).otherwise(0)).withColumn(
        "closest_left", F.when(plus, F.lit(-1)).otherwise(F.col("start") - d)
    ).withColumn("closest_right", F.when(plus, F.col("end") + d).otherwise(F.lit(1 << 40)))
    return M.isolated_genes(models).select("gene", "start_codon_t", "stop_codon_t", "transcript_length")


def five_prime_counts(t):
    return counting.position_counts(t).where("read_end = 'five'").drop("read_end")


def metagene(t):
    return M.metagene(five_prime_counts(t), isolated(t))


@query("A15_metagene", "SELECT sample, key, landmark, rel, actual, round(uniform, 6) AS uniform, round(sum_of_enrichments, 6) AS sum_of_enrichments, num_eligible FROM metagene_raw")
def _(t):
    return metagene(t).withColumn("uniform", F.round("uniform", 6)).withColumn("sum_of_enrichments", F.round("sum_of_enrichments", 6))


@query(
    "A15_metagene_by_base",
    """
SELECT sample, key, landmark, base, rel, CAST(sum(actual) AS BIGINT) AS actual, round(sum(uniform), 6) AS uniform FROM (
  SELECT l.sample, l.key, l.landmark, b.base, rel, n AS actual, 0.0::DOUBLE AS uniform FROM landmark_counts l
  JOIN transcript_bases b ON b.gene = l.gene AND b.t = rel + origin + start_codon_t WHERE rel >= lo AND rel < hi
  UNION ALL SELECT d.sample, d.key, d.landmark, b.base, b.t - m.origin - m.start_codon_t, 0, density FROM gene_densities d
  JOIN marked m ON m.gene = d.gene AND m.landmark = d.landmark JOIN transcript_bases b ON b.gene = d.gene
  WHERE b.t - m.origin - m.start_codon_t >= d.ulo AND b.t - m.origin - m.start_codon_t < d.uhi)
WHERE base <> '-' GROUP BY ALL""",
)
def _(t):
    return M.metagene_by_base(five_prime_counts(t), isolated(t), counting.sequences(t)).withColumn("uniform", F.round("uniform", 6))


@query(
    "A63_nucleotide_densities",
    "SELECT sample, key, landmark, rel, round(sum_of_enrichments / greatest(1, num_eligible), 6) AS density FROM metagene_raw",
)
def _(t):
    return M.nucleotide_densities(metagene(t)).withColumn("density", F.round("density", 6))


VIEWS["density_table"] = """
WITH g AS (SELECT sample, gene, sum(relaxed) AS total, min(codon_idx) AS lo, max(codon_idx) + 1 AS hi, any_value(num_codons) AS len
           FROM codon_counts GROUP BY ALL HAVING sum(relaxed) >= 50000),
v AS (SELECT c.sample, codon_idx, len, relaxed / (total / len) AS value FROM codon_counts c JOIN g ON g.sample = c.sample AND g.gene = c.gene)
SELECT sample, side, rel, sum(value) / count(*) AS density FROM (
  SELECT sample, 'from_start' AS side, codon_idx AS rel, value FROM v UNION ALL SELECT sample, 'from_end', codon_idx - len, value FROM v) GROUP BY ALL"""


@query("A16_averaged_codon_densities", "SELECT sample, side, rel, round(density, 6) AS density FROM density_table")
def _(t):
    return M.averaged_codon_densities(t.codon_counts, min_counts=50000).withColumn("density", F.round("density", 6))


@query(
    "A64_asymptotic_scaling",
    """
SELECT d.sample, d.side, rel, round(density / m, 6) AS density FROM density_table d
JOIN (SELECT sample, side, avg(density) AS m FROM density_table WHERE rel >= 490 AND rel < 510 GROUP BY ALL) a ON a.sample = d.sample AND a.side = d.side""",
)
def _(t):
    return M.asymptotic_scaled(M.averaged_codon_densities(t.codon_counts, min_counts=50000)).withColumn("density", F.round("density", 6))


@query(
    "A17_first_codon_densities",
    """
SELECT c.sample, c.gene, codon_idx, round(relaxed / m, 6) AS density FROM codon_counts c JOIN (SELECT sample, gene, sum(relaxed) / any_value(num_codons) AS m
  FROM codon_counts WHERE codon_idx >= 0 AND codon_idx < num_codons GROUP BY ALL) g ON g.sample = c.sample AND g.gene = c.gene
WHERE codon_idx BETWEEN 0 AND 9 AND m <> 0""",
)
def _(t):
    return M.first_codon_densities(t.codon_counts).withColumn("density", F.round("density", 6))


@query(
    "A18_metacodon",
    """
WITH c AS (SELECT * FROM codon_counts WHERE codon_idx >= 0 AND codon_idx <= num_codons),
g AS (SELECT sample, gene, avg(relaxed) AS mean FROM c GROUP BY ALL)
SELECT a.sample, a.codon, CAST(b.codon_idx - a.codon_idx AS INTEGER) AS "offset", CAST(sum(b.relaxed) AS BIGINT) AS actual, round(sum(mean), 6) AS uniform,
       round(COALESCE(sum(CASE WHEN mean > 0 THEN b.relaxed / mean END), 0), 6) AS sum_of_enrichments, count(CASE WHEN mean > 0 THEN 1 END) AS num_eligible,
       round(sum(b.relaxed) / sum(mean), 6) AS enrichment
FROM c a JOIN c b ON b.sample = a.sample AND b.gene = a.gene AND b.codon_idx - a.codon_idx BETWEEN -30 AND 29
JOIN g ON g.sample = a.sample AND g.gene = a.gene
WHERE a.codon_idx >= 30 AND a.codon_idx <= a.num_codons + 1 - 30 GROUP BY ALL""",
)
def _(t):
    m = M.metacodon(t.codon_counts)
    for c in ("uniform", "sum_of_enrichments", "enrichment"):
        m = m.withColumn(c, F.round(c, 6))
    return m


@query(
    "A19_metanucleotide",
    """
SELECT p.sample, p.key, i.codon, CAST(p.pos - 3 * i.codon_idx AS INTEGER) AS "offset", CAST(sum(p.n) AS BIGINT) AS n
FROM identities i JOIN position_counts p ON p.gene = i.gene AND p.read_end = 'five' AND p.pos - 3 * i.codon_idx BETWEEN -50 AND 49
WHERE i.codon_idx >= 0 AND i.codon_idx <= num_codons AND 3 * i.codon_idx >= 50 AND 3 * i.codon_idx <= 3 * num_codons + 3 - 50 GROUP BY ALL""",
)
def _(t):
    starts = counting.identities(t).where("codon_idx >= 0 and codon_idx <= num_codons").select(
        "gene", "codon", (F.col("codon_idx") * 3).cast("bigint").alias("p"), (F.col("num_codons") * 3 + 3).alias("cds_size")
    )
    return M.metanucleotide(five_prime_counts(t), starts)


def rel_counts(t):
    return t.positions.withColumnRenamed("pos", "rel")


def rel_genes(t):
    return t.positions.groupBy("gene").agg((F.max("pos") + 1 - 5).cast("int").alias("cds_length"))


_BAND = "JOIN rel_genes g ON g.gene = c.gene AND g.cds_length BETWEEN 50 AND 75"


@query(
    "A55_edge_profile",
    f"""
WITH u AS (SELECT c.sample, c.gene, rel - 5 AS rel, n, cds_length FROM extent_counts c {_BAND} WHERE rel - 5 >= -5 AND rel - 5 < cds_length),
e AS (SELECT sample, gene, sum(n) / (cds_length + 5) AS density, cds_length FROM u GROUP BY sample, gene, cds_length)
SELECT sample, rel, CAST(sum(actual) AS BIGINT) AS actual, round(sum(expected), 6) AS expected FROM (
  SELECT sample, rel, n AS actual, 0.0::DOUBLE AS expected FROM u UNION ALL SELECT sample, unnest(range(-5, cds_length)), 0, density FROM e) GROUP BY ALL""",
)
def _(t):
    moved = rel_counts(t).withColumn("rel", F.col("rel") - 5)
    return M.edge_profile(moved, rel_genes(t), 50, 75, 5).withColumn("expected", F.round("expected", 6))


@query(
    "A55_most_unexpected",
    f"""
SELECT * FROM (SELECT sample, gene, n, row_number() OVER (PARTITION BY sample ORDER BY n DESC, gene) AS rank FROM (
  SELECT c.sample, c.gene, CAST(sum(n) AS BIGINT) AS n FROM extent_counts c {_BAND} WHERE rel < 5 GROUP BY ALL)) WHERE rank <= 10""",
)
def _(t):
    moved = rel_counts(t).withColumn("rel", F.col("rel") - 5)
    return M.most_unexpected(moved, rel_genes(t), 50, 75, 5)


@query(
    "A56_end_excess",
    """
SELECT sample, c.gene, round(sum(CASE WHEN rel < 200 THEN n ELSE 0 END) - least(200, cds_length) * sum(n) / cds_length, 6) AS excess
FROM long_extents c JOIN long_rel_genes g ON g.gene = c.gene AND cds_length >= 50 WHERE rel < cds_length GROUP BY sample, c.gene, cds_length""",
)
def _(t):
    counts = t.long_genes.select(F.lit("x").alias("sample"), "gene", F.col("rn").alias("rel"), F.col("v").alias("n"))
    genes = t.long_genes.select("gene", (F.col("n_rows") - 5).cast("int").alias("cds_length")).distinct()
    return M.end_excess(counts, genes, 50).withColumn("excess", F.round("excess", 6))


VIEWS["truncation"] = """
WITH u AS (SELECT c.sample, c.gene, rel, n, cds_length FROM extent_counts c JOIN rel_genes g ON g.gene = c.gene AND cds_length >= 50 WHERE rel < cds_length),
r AS (SELECT sample, gene, cds_length, sum(n) AS r FROM u GROUP BY ALL),
grid AS (SELECT CAST(p AS DOUBLE) AS p FROM (VALUES (0.001), (0.01), (0.05)) v(p)),
l AS (SELECT sample, gene, r, p, cds_length, unnest(range(1, cds_length + 1)) AS l FROM r, grid),
w AS (SELECT *, CASE WHEN l = cds_length THEN pow(1 - p, l) ELSE pow(1 - p, l) * p END / (1 - p) / l AS term FROM l),
e AS (SELECT p, sample, l AS x, r * sum(term) OVER (PARTITION BY p, sample, gene ORDER BY l DESC) AS expected FROM w),
a AS (SELECT sample, cds_length - rel AS x, sum(n) AS actual FROM u GROUP BY ALL)
SELECT e.p, e.sample, e.x, sum(expected) AS expected, CAST(any_value(COALESCE(actual, 0)) AS BIGINT) AS actual
FROM e LEFT JOIN a ON a.sample = e.sample AND a.x = e.x GROUP BY e.p, e.sample, e.x"""


def truncation(t):
    grid = t.spark.createDataFrame([(0.001,), (0.01,), (0.05,)], "p double")
    return M.truncation_profile(rel_counts(t), rel_genes(t), grid, 50)


@query("A57_truncation_profile", "SELECT p, sample, x, round(expected, 5) AS expected, actual FROM truncation")
def _(t):
    return truncation(t).withColumn("expected", F.round("expected", 5))


@query(
    "A58_truncation_fit",
    """
SELECT sample, arg_min(p, residual) AS p, round(min(residual), 2) AS residual FROM (
  SELECT sample, p, sum(pow(actual - expected, 2)) AS residual FROM truncation GROUP BY ALL) GROUP BY sample""",
)
def _(t):
    return M.truncation_fit(truncation(t)).withColumn("residual", F.round("residual", 2))


@query(
    "A60_frame_fractions",
    """
SELECT sample, key, frame, n, round(n / sum(n) OVER (PARTITION BY sample, key), 6) AS fraction FROM (
  SELECT p.sample, p.key, ((p.pos % 3) + 3) % 3 AS frame, CAST(sum(p.n) AS BIGINT) AS n FROM position_counts p JOIN genes g ON g.gene = p.gene
  WHERE p.read_end = 'five' AND p.pos >= -15 AND p.pos < g.stop_codon_t - g.start_codon_t - 12 GROUP BY ALL)""",
)
def _(t):
    c = counting.position_counts(t).where("read_end = 'five'")
    return M.frame_fractions(c, t.genes).withColumn("fraction", F.round("fraction", 6))


def offsets(t):
    return counts.offsets_table(t.spark).where("offset_type = 'yeast'")


@query(
    "A61_frame_track",
    """
WITH m AS (SELECT sample, gene, key, pos + 15 + CASE WHEN key IN ('30', '31') THEN 1 ELSE 0 END AS place, n, sz FROM (
    SELECT sample, gene, CASE WHEN rn < 20 THEN '28' WHEN rn < 40 THEN '30' ELSE '31' END AS key, rn AS pos, n, n_rows + 5 AS sz
    FROM (SELECT 'x' AS sample, gene, rn, v AS n, n_rows FROM numbered_events))),
c AS (SELECT sample, gene, key, place // 3 AS codon_idx, place % 3 AS frame, n FROM m WHERE place // 3 < sz // 3),
grid AS (SELECT DISTINCT sample, gene, key, codon_idx, f AS frame FROM c, range(0, 3) r(f)),
d AS (SELECT g.*, CAST(COALESCE(sum(c.n), 0) AS BIGINT) AS n FROM grid g LEFT JOIN c USING (sample, gene, key, codon_idx, frame) GROUP BY ALL),
e AS (SELECT *, sum(n) OVER (PARTITION BY sample, gene, key, frame ORDER BY codon_idx) AS a,
   sum(n) OVER (PARTITION BY sample, gene, key, frame ORDER BY codon_idx DESC) AS b FROM d)
SELECT sample, gene, key, codon_idx, CAST(frame AS INTEGER) AS frame, n,
   round(a / greatest(1, sum(a) OVER (PARTITION BY sample, gene, key, codon_idx)), 6) AS so_far,
   round(b / greatest(1, sum(b) OVER (PARTITION BY sample, gene, key, codon_idx)), 6) AS remaining FROM e""",
)
def _(t):
    key = F.when(F.col("rn") < 20, "28").when(F.col("rn") < 40, "30").otherwise("31")
    c = t.numbered_events.select(F.lit("x").alias("sample"), "gene", key.alias("key"), F.col("rn").alias("pos"), F.col("v").alias("n"))
    extents = t.numbered_events.select("gene", (F.col("n_rows") + 5).alias("transcript_length")).distinct()
    track = M.frame_track(c, extents, offsets(t))
    return track.withColumn("so_far", F.round("so_far", 6)).withColumn("remaining", F.round("remaining", 6))


@query(
    "A61_frame_codons",
    """
SELECT gene, i % 3 AS frame, i // 3 AS codon_idx, substr(sequence, i + 1, 3) AS codon FROM (
  SELECT gene, sequence, unnest(range(0, length(sequence) - 2)) AS i FROM (SELECT gene, substr(sequence, 331 + start_codon_t, stop_codon_t - start_codon_t) AS sequence
  FROM transcript_text JOIN genes USING (gene))) WHERE substr(sequence, i + 1, 3) IN ('ATG', 'TAA', 'TAG', 'TGA')""",
)
def _(t):
    cds = F.substr(F.col("sequence"), (F.col("start_codon_t") + C.BUFFER + 1).cast("int"), (F.col("stop_codon_t") - F.col("start_codon_t")).cast("int"))
    texts = counting.sequences(t).join(t.genes, "gene").select("gene", cds.alias("sequence"))
    return M.frame_codons(texts, ["ATG", *C.STOP_CODONS])


@query(
    "A62_three_prime_heatmap",
    """
WITH h AS (SELECT sample, CAST(key AS INTEGER) AS length, pos + CAST(key AS INTEGER) - 1 AS rel, CAST(sum(n) AS BIGINT) AS n FROM position_counts
  WHERE read_end = 'five' AND key NOT IN ('all', 'all_nonunique') AND pos + CAST(key AS INTEGER) - 1 < 60 GROUP BY ALL)
SELECT *, round(n / (max(CASE WHEN length BETWEEN 28 AND 30 AND rel BETWEEN -20 AND 20 THEN n END) OVER (PARTITION BY sample)), 6) AS scaled FROM h""",
)
def _(t):
    c = counting.position_counts(t).where("read_end = 'five' and key not in ('all', 'all_nonunique')").withColumn("length", F.col("key").cast("int"))
    moved = M.shift_to_three_prime(c, F.col("length"), F.lit(60))
    sums = moved.groupBy("sample", "length", F.col("pos").alias("rel")).agg(F.sum("n").alias("n"))
    return M.scaled_to_max(sums, [28, 29, 30], -20, 20).withColumn("scaled", F.round("scaled", 6))


@query(
    "A65_amino_acid_recycling",
    f"""
WITH aa AS (SELECT substr('{inputs.ALL_CODONS_TEXT}', CAST(3 * i + 1 AS BIGINT), 3) AS codon, substr('{C.AMINO_ACIDS}', CAST(i + 1 AS BIGINT), 1) AS amino_acid FROM range(0, 64) r(i)),
s AS (SELECT sample, gene, amino_acid, codon AS first_codon, codon_idx AS first_idx, relaxed AS first_n, lead(codon) OVER w AS second_codon,
   lead(codon_idx) OVER w AS second_idx, lead(relaxed) OVER w AS second_n FROM codon_counts JOIN aa USING (codon)
   WHERE codon_idx >= 0 AND codon_idx < num_codons WINDOW w AS (PARTITION BY sample, gene, amino_acid ORDER BY codon_idx))
SELECT *, round(CASE WHEN second_n <> 0 THEN first_n / second_n END, 6) AS ratio FROM s WHERE second_idx IS NOT NULL""",
)
def _(t):
    steps = M.amino_acid_steps(t.codon_counts, dimensions.codon_dimension(t.spark))
    return steps.withColumn("ratio", F.round("ratio", 6))


@query(
    "A70_local_enrichment",
    """
SELECT sample, gene, codon_idx, codon, round(relaxed / NULLIF(avg(relaxed) OVER (PARTITION BY sample, gene), 0), 6) AS enrichment
FROM codon_counts WHERE codon_idx >= -3 AND codon_idx < num_codons + 4""",
)
def _(t):
    return M.local_enrichment(t.codon_counts, utr_codons=3).withColumn("enrichment", F.round("enrichment", 6))
