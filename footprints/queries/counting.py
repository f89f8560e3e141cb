"""Queries for coordinates and counts."""

from __future__ import annotations

from pyspark.sql import functions as F

from footprints import constants as C
from footprints.operators import coords, counts, intervals
from footprints.queries import inputs
from footprints.queries.registry import VIEWS, query

LENGTHS = [20, 21, 22, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 33, 34, 35]

VIEWS.update(
    {
        "exon_t": """
SELECT e.gene, g.seqname, g.strand, e."start" AS s, e."end" AS e,
       CASE WHEN g.strand = '+' THEN COALESCE(sum(e."end" - e."start" + 1) OVER (PARTITION BY e.gene ORDER BY e."start"
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
            ELSE COALESCE(sum(e."end" - e."start" + 1) OVER (PARTITION BY e.gene ORDER BY e."start" DESC
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) END AS t0
FROM exons e JOIN genes g USING (gene)""",
        "coordinate_map": """
SELECT gene, seqname, strand, p, CAST(CASE WHEN strand = '+' THEN t0 + p - s ELSE t0 + e - p END AS BIGINT) AS t
FROM (SELECT *, unnest(range(s, e + 1)) AS p FROM exon_t)
UNION ALL SELECT gene, seqname, strand, CASE WHEN strand = '+' THEN "start" - d ELSE "end" + d END, -d
FROM genes, range(1, 331) r(d)
UNION ALL SELECT gene, seqname, strand, CASE WHEN strand = '+' THEN "end" + d ELSE "start" - d END, transcript_length + d - 1
FROM genes, range(1, 331) r(d)""",
        "hits": """
SELECT a.sample, g.gene, a.strand = g.strand AS same_strand, a.mapq = 50 AS is_uniq, a.is_secondary, a.qlen,
       a.nongenomic_length, g.start_codon_t, g.stop_codon_t,
       CASE WHEN a.split THEN (a.pos <= g."start" + 179 AND a.pos + 9 >= g."start" + 150)
                 OR (a.pos + 40 <= g."start" + 179 AND a.aend - 1 >= g."start" + 150)
            ELSE a.pos <= g."start" + 179 AND a.aend - 1 >= g."start" + 150 END AS spliced_out,
       CASE WHEN a.strand = '+' THEN a.pos ELSE a.aend - 1 END AS five,
       CASE WHEN a.strand = '+' THEN a.aend - 1 ELSE a.pos END AS three
FROM mapped a JOIN genes g ON a.seqname = g.seqname AND a.pos < g."end" + 330 AND a.aend > greatest(0, g."start" - 330)""",
        "hits_t": """
SELECT h.*, m5.t AS five_t, m3.t AS three_t
FROM hits h LEFT JOIN coordinate_map m5 ON m5.gene = h.gene AND m5.p = h.five
     LEFT JOIN coordinate_map m3 ON m3.gene = h.gene AND m3.p = h.three""",
        "position_counts": """
SELECT sample, gene, read_end, key, pos, count(*) AS n FROM (
  SELECT sample, gene, 'five' AS read_end, five_t - start_codon_t AS pos, unnest(CASE
         WHEN is_uniq THEN ['all', CAST(qlen AS VARCHAR)] WHEN NOT is_secondary THEN ['all_nonunique'] ELSE [] END) AS key
  FROM hits_t WHERE same_strand AND NOT spliced_out AND five_t IS NOT NULL
  UNION ALL
  SELECT sample, gene, 'three', three_t - start_codon_t, unnest(CASE
         WHEN is_uniq AND nongenomic_length <= 5 THEN ['all', CAST(nongenomic_length AS VARCHAR)] WHEN is_uniq THEN ['all']
         WHEN NOT is_secondary THEN ['all_nonunique'] ELSE [] END)
  FROM hits_t WHERE same_strand AND NOT spliced_out AND three_t IS NOT NULL)
GROUP BY ALL""",
        "offsets": "SELECT * FROM (VALUES "
        + ", ".join(f"('{k}', {l}, {o})" for k, d in C.A_SITE_OFFSETS.items() for l, o in d.items())
        + ") t(offset_type, length, off)",
        "a_site_counts": """
SELECT sample, gene, offset_type, codon_idx, n FROM (
  SELECT p.sample, p.gene, o.offset_type, CAST(floor((p.pos + o.off + 1) / 3.0) AS BIGINT) AS codon_idx,
         CAST(sum(p.n) AS BIGINT) AS n
  FROM position_counts p JOIN offsets o ON p.key = CAST(o.length AS VARCHAR) WHERE p.read_end = 'five' GROUP BY ALL)
JOIN genes USING (gene) WHERE codon_idx >= -100 AND codon_idx < (stop_codon_t - start_codon_t) // 3 + 100""",
        "transcript_bases": """
SELECT m.gene, m.t, CASE WHEN m.strand = '-' THEN translate(COALESCE(b.base, '-'), 'ACGT', 'TGCA')
       ELSE COALESCE(b.base, '-') END AS base
FROM coordinate_map m LEFT JOIN genome_bases b ON b.seqname = m.seqname AND b.p = m.p""",
        "transcript_text": "SELECT gene, string_agg(base, '' ORDER BY t) AS sequence FROM transcript_bases GROUP BY gene",
        "identities": """
SELECT gene, (stop_codon_t - start_codon_t) // 3 AS num_codons, i AS codon_idx,
       substr(sequence, CAST(start_codon_t + 3 * i + 330 + 1 AS BIGINT), 3) AS codon
FROM (SELECT *, unnest(range(-100, (stop_codon_t - start_codon_t) // 3 + 100)) AS i FROM transcript_text JOIN genes USING (gene))""",
        "gene_reads": """
SELECT s.sample, g.gene, g.stop_codon_t - g.start_codon_t AS cds_length, CAST(COALESCE(sum(p.n), 0) AS BIGINT) AS n
FROM genes g CROSS JOIN (SELECT DISTINCT sample FROM mapped) s
LEFT JOIN position_counts p ON p.gene = g.gene AND p.sample = s.sample AND p.read_end = 'five' AND p.key = 'all'
     AND p.pos >= -15 AND p.pos < g.stop_codon_t - g.start_codon_t - 15 + 3
GROUP BY ALL""",
        "gene_rpkm": """
SELECT sample, gene, 1e9 * n / cds_length / NULLIF(sum(n) OVER (PARTITION BY sample), 0) AS rpkm FROM gene_reads""",
        "rrna": """
SELECT sample, qname, qlen, CASE WHEN barcode <= 4 THEN 'rRNA_1' ELSE 'rRNA_2' END AS seqname, split,
       pos % 600 AS pos, pos % 600 + aend - pos AS aend, is_secondary FROM mapped""",
        "rrna_bases": """
SELECT sample, seqname, qlen, qname, unnest(CASE WHEN split THEN list_concat(range(pos, pos + 10), range(pos + 40, aend))
       ELSE range(pos, aend) END) AS p FROM rrna""",
        "block_bases": """
SELECT sample, seqname, qlen, qname, unnest(CASE WHEN split THEN list_concat(range(pos, pos + 10), range(pos + 40, aend))
       ELSE range(pos, aend) END) AS p FROM mapped""",
    }
)


def models(t):
    return coords.transcript_models(t.genes, t.exons)


def hits(t):
    return counts.transcript_hits(t.mapped, models(t))


def position_counts(t):
    return counts.position_counts(hits(t), LENGTHS)


def sequences(t, buffer=C.BUFFER):
    return coords.transcript_sequences(models(t), t.genome, inputs.GENOME_CHUNK, buffer, buffer)


def identities(t):
    return coords.codon_identities(models(t), sequences(t), C.BUFFER)


def gene_reads(t):
    return counts.read_counts(position_counts(t), t.genes, t.samples)


@query("A21_rpkm", "SELECT sample, gene, round(rpkm, 4) AS rpkm FROM gene_rpkm")
def _(t):
    return counts.rpkm(gene_reads(t)).select("sample", "gene", F.round("rpkm", 4).alias("rpkm"))


@query(
    "A21_rpkm_edges_excluded",
    """
WITH edged AS (SELECT s.sample, g.gene, g.stop_codon_t - g.start_codon_t - 34 AS cds_length, COALESCE(sum(p.n), 0) AS n
  FROM genes g CROSS JOIN (SELECT DISTINCT sample FROM mapped) s
  LEFT JOIN position_counts p ON p.gene = g.gene AND p.sample = s.sample AND p.read_end = 'five' AND p.key = 'all'
       AND p.pos >= 15 AND p.pos < g.stop_codon_t - g.start_codon_t - 16
  GROUP BY ALL)
SELECT sample, gene, round(1e9 * n / cds_length / sum(n) OVER (PARTITION BY sample), 4) AS rpkm,
       round(1e9 * n / (cds_length - 34) / sum(n) OVER (PARTITION BY sample), 4) AS rpkm_double_edge FROM edged""",
)
def _(t):
    c = counts.read_counts(position_counts(t), t.genes, t.samples, 30, 4)
    once = counts.rpkm(c).select("sample", "gene", F.round("rpkm", 4).alias("rpkm"))
    twice = counts.rpkm(c, 30, 4, compat_double_edge=True).select("sample", "gene", F.round("rpkm", 4).alias("rpkm_double_edge"))
    return once.join(twice, ["sample", "gene"])


@query("A20_gene_read_counts", "SELECT sample, gene, cds_length, n FROM gene_reads")
def _(t):
    return gene_reads(t)


@query(
    "J1_transcript_hit_summary",
    """
SELECT sample, gene, count(CASE WHEN NOT spliced_out AND NOT is_uniq THEN 1 END) AS nonunique,
       count(CASE WHEN spliced_out THEN 1 END) AS alternatively_spliced FROM hits GROUP BY sample, gene""",
)
def _(t):
    return counts.hit_summary(hits(t))


@query(
    "J2_coordinate_map",
    """
SELECT gene, t // 10 AS tens, count(*) AS n, CAST(sum(p) AS BIGINT) AS p_sum, CAST(sum(p * (t + 1)) AS BIGINT) AS weighted, CAST(sum(p) AS BIGINT) AS back_sum
FROM (SELECT gene, p, t + 330 AS t FROM coordinate_map) GROUP BY ALL""",
)
def _(t):
    m = models(t).withColumn("p", F.explode(F.sequence(F.col("start") - C.BUFFER, F.col("end") + C.BUFFER)))
    mapped = m.withColumn("t", coords.to_transcript(F.col("p"), C.BUFFER, C.BUFFER)).where("t is not null")
    back = mapped.withColumn("back", coords.to_genomic(F.col("t"))).withColumn("t", F.col("t") + C.BUFFER)
    return back.groupBy("gene", F.floor(F.col("t") / 10).alias("tens")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p").alias("p_sum"), F.sum(F.col("p") * (F.col("t") + 1)).alias("weighted"), F.sum("back").alias("back_sum")
    )


@query(
    "F15_end_positions",
    """
SELECT sample, seqname, strand, CASE WHEN strand = '+' THEN pos ELSE aend - 1 END AS five,
       CASE WHEN strand = '+' THEN aend - 1 ELSE pos END AS three, count(*) AS n FROM mapped GROUP BY ALL""",
)
def _(t):
    five = counts.five_prime(F.col("strand"), F.col("pos"), F.col("aend"))
    three = counts.three_prime(F.col("strand"), F.col("pos"), F.col("aend"))
    return t.mapped.groupBy("sample", "seqname", "strand", five.alias("five"), three.alias("three")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F17_spliced_out",
    "SELECT sample, gene, spliced_out, count(*) AS n FROM hits GROUP BY ALL",
)
def _(t):
    return hits(t).groupBy("sample", "gene", "spliced_out").agg(F.sum("n").alias("n"))


@query("A10_position_counts", "SELECT * FROM position_counts")
def _(t):
    return position_counts(t)


@query(
    "A11_three_prime_genomic_nongenomic",
    """
SELECT sample, gene, pos, CAST(COALESCE(sum(n) FILTER (key = '0'), 0) AS BIGINT) AS genomic,
       CAST(COALESCE(sum(n) FILTER (key = 'all'), 0) - COALESCE(sum(n) FILTER (key = '0'), 0) AS BIGINT) AS nongenomic
FROM position_counts WHERE read_end = 'three' AND key IN ('all', '0') GROUP BY ALL""",
)
def _(t):
    return counts.split_three_prime(position_counts(t))


@query(
    "A12_joint_position_counts",
    """
SELECT sample, gene, five_t AS five_pos, three_t - stop_codon_t AS three_pos, count(*) AS n FROM hits_t
WHERE same_strand AND is_uniq AND NOT spliced_out AND five_t IS NOT NULL AND three_t IS NOT NULL GROUP BY ALL""",
)
def _(t):
    return counts.joint_counts(hits(t))


@query(
    "J3_extent_position_counts",
    """
WITH ext AS (SELECT g.gene, g.seqname, g.strand, a.p AS first, b.p AS stop FROM genes g
             JOIN coordinate_map a ON a.gene = g.gene AND a.t = g.start_codon_t
             JOIN coordinate_map b ON b.gene = g.gene AND b.t = g.stop_codon_t),
placed AS (SELECT m.sample, e.gene, m.qlen, CASE WHEN m.strand = '+' THEN m.pos - first ELSE first - (m.aend - 1) END AS pos,
                  m.pos AS rp, m.aend AS ra, abs(stop - first) AS len,
                  CASE WHEN m.strand = '+' THEN first - 30 ELSE stop + 1 - 30 END AS lo,
                  CASE WHEN m.strand = '+' THEN stop - 1 + 30 ELSE first + 30 END AS hi
           FROM mapped m JOIN ext e ON e.seqname = m.seqname AND e.strand = m.strand WHERE m.mapq = 50)
SELECT sample, gene, key, pos, count(*) AS n FROM (
  SELECT sample, gene, pos, unnest(['all', CAST(qlen AS VARCHAR)]) AS key FROM placed
  WHERE pos >= -30 AND pos < len + 30 AND rp < hi + 30 AND ra > greatest(0, lo - 30))
GROUP BY ALL""",
)
def _(t):
    return counts.extent_counts(t.mapped, coords.extent_models(t.genes, t.exons), LENGTHS, 30, 30)


@query("J4_transcript_sequences", "SELECT gene, sequence FROM transcript_text")
def _(t):
    return sequences(t)


@query(
    "J4_extent_sequences",
    """
WITH e AS MATERIALIZED (SELECT gene, strand, seqname, unnest(range(least(first, stop + 1), greatest(first, stop - 1) + 1)) AS p
  FROM (SELECT g.gene, g.seqname, g.strand, a.p AS first, b.p AS stop FROM genes g
        JOIN coordinate_map a ON a.gene = g.gene AND a.t = g.start_codon_t
        JOIN coordinate_map b ON b.gene = g.gene AND b.t = g.stop_codon_t))
SELECT gene, string_agg(CASE WHEN strand = '-' THEN translate(base, 'ACGT', 'TGCA') ELSE base END, ''
                        ORDER BY CASE WHEN strand = '+' THEN e.p ELSE -e.p END) AS sequence
FROM e JOIN genome_bases b ON b.seqname = e.seqname AND b.p = e.p GROUP BY gene""",
)
def _(t):
    extents = coords.extent_models(t.genes, t.exons)
    return coords.transcript_sequences(extents, t.genome, inputs.GENOME_CHUNK)


@query(
    "J4_coding_sequences",
    """
WITH c AS (SELECT gene, substr(sequence, start_codon_t + 330 + 1, stop_codon_t + 3 - start_codon_t) AS cds
           FROM transcript_text JOIN genes USING (gene))
SELECT gene, cds, CASE WHEN length(cds) % 3 = 0 AND substr(cds, 1, 3) IN ('TTG', 'CTG', 'ATG')
     AND right(cds, 3) IN ('TAA', 'TAG', 'TGA')
     AND len(list_filter(range(0, length(cds) // 3 - 1), lambda i: substr(cds, 3 * i + 1, 3) IN ('TAA', 'TAG', 'TGA'))) = 0
     THEN cds END AS coding_sequence FROM c""",
)
def _(t):
    return coords.coding_sequences(models(t), sequences(t), C.BUFFER)


@query("A14_codon_identities", "SELECT * FROM identities")
def _(t):
    return identities(t)


@query("A13_codon_counts", "SELECT * FROM a_site_counts")
def _(t):
    return counts.codon_counts(position_counts(t), t.genes, counts.offsets_table(t.spark))


@query(
    "A13_codon_table",
    """
SELECT sample, gene, codon, count(*) AS sites, CAST(sum(relaxed) AS BIGINT) AS relaxed, CAST(sum(stringent) AS BIGINT) AS stringent,
       CAST(sum(anisomycin) AS BIGINT) AS anisomycin, CAST(sum(relaxed * (codon_idx + 101)) AS BIGINT) AS weighted FROM (
SELECT s.sample, i.gene, i.codon_idx, i.num_codons, i.codon,
       CAST(COALESCE(sum(n) FILTER (offset_type = 'yeast'), 0) AS BIGINT) AS relaxed,
       CAST(COALESCE(sum(n) FILTER (offset_type = 'yeast_stringent'), 0) AS BIGINT) AS stringent,
       CAST(COALESCE(sum(n) FILTER (offset_type = 'yeast_anisomycin'), 0) AS BIGINT) AS anisomycin
FROM identities i CROSS JOIN (SELECT DISTINCT sample FROM mapped) s
LEFT JOIN a_site_counts a ON a.sample = s.sample AND a.gene = i.gene AND a.codon_idx = i.codon_idx
GROUP BY ALL) GROUP BY sample, gene, codon""",
)
def _(t):
    sites = counts.codon_counts(position_counts(t), t.genes, counts.offsets_table(t.spark))
    table = counts.codon_table(sites, identities(t), t.samples.select("sample"), "yeast", "yeast_stringent", "yeast_anisomycin")
    return table.groupBy("sample", "gene", "codon").agg(
        F.count(F.lit(1)).alias("sites"), *[F.sum(c).alias(c) for c in ("relaxed", "stringent", "anisomycin")],
        F.sum(F.col("relaxed") * (F.col("codon_idx") + 101)).alias("weighted"),
    )


@query(
    "A22_all_codon_counts",
    "SELECT sample, gene, codon_idx, relaxed AS n FROM codon_counts WHERE codon_idx >= 2 AND codon_idx < num_codons",
)
def _(t):
    return counts.all_codon_counts(t.codon_counts).orderBy("sample", "gene", "codon_idx")


@query(
    "A8_coverage",
    """
SELECT sample, seqname, qlen, p // 100 AS stretch, count(*) AS positions, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n * p) AS BIGINT) AS weighted
FROM (SELECT sample, seqname, qlen, p, count(*) AS n FROM block_bases GROUP BY ALL) GROUP BY ALL""",
)
def _(t):
    return counts.coverage(t.mapped).groupBy("sample", "seqname", "qlen", F.floor(F.col("pos") / 100).alias("stretch")).agg(
        F.count(F.lit(1)).alias("positions"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("pos")).alias("weighted")
    )


@query("A8_rrna_coverage", "SELECT sample, seqname, qlen, p AS pos, count(*) AS n FROM rrna_bases GROUP BY ALL")
def _(t):
    return counts.coverage(t.rrna)


VIEWS["dominant"] = """
SELECT sample, seqname, min(p) AS "start", max(p) + 1 AS "end" FROM (
  SELECT *, p - row_number() OVER (PARTITION BY sample, seqname ORDER BY p) AS island FROM (
    SELECT b.sample, b.seqname, b.p, count(*) AS n FROM rrna_bases b GROUP BY ALL)
  JOIN (SELECT sample, count(*) AS total FROM mapped GROUP BY sample) USING (sample) WHERE n / total >= 0.02)
GROUP BY sample, seqname, island"""


def dominant(t):
    return counts.dominant_stretches(t.rrna, t.samples)


@query("A9_dominant_stretches", "SELECT * FROM dominant")
def _(t):
    return dominant(t)


@query(
    "A9_dominant_stretch_reads",
    """
SELECT d.sample, d.seqname, d."start", d."end", a.qlen, count(*) AS mappings, count(DISTINCT qname) AS reads
FROM dominant d JOIN rrna a ON a.sample = d.sample AND a.seqname = d.seqname AND a.pos < d."end" AND a.aend > d."start"
GROUP BY ALL""",
)
def _(t):
    reads = counts.stretch_reads(t.rrna, dominant(t))
    return reads.groupBy("sample", "seqname", "start", "end", "qlen").agg(
        F.count(F.lit(1)).alias("mappings"), F.count_distinct("qname").alias("reads")
    )


@query(
    "A9_dominant_read_total",
    """
SELECT a.sample, count(DISTINCT qname) AS reads FROM dominant d
JOIN rrna a ON a.sample = d.sample AND a.seqname = d.seqname AND a.pos < d."end" AND a.aend > d."start" GROUP BY a.sample""",
)
def _(t):
    return counts.stretch_reads(t.rrna, dominant(t)).groupBy("sample").agg(F.count_distinct("qname").alias("reads"))


@query(
    "J5_overlapping_alignments",
    """
SELECT g.gene, a.sample, count(*) AS n FROM genes g JOIN mapped a
  ON a.seqname = g.seqname AND a.pos <= g."end" AND g."start" <= a.aend - 1 GROUP BY ALL""",
)
def _(t):
    reads = t.mapped.groupBy("sample", "seqname", F.col("pos").alias("_s"), (F.col("aend") - 1).alias("_e")).agg(F.count(F.lit(1)).alias("n"))
    pairs = intervals.overlap_join(reads, t.genes, ["seqname"], ("_s", "_e"), ("start", "end"))
    return pairs.groupBy("gene", "sample").agg(F.sum("n").alias("n"))


@query(
    "J5_genes_containing_point",
    """
SELECT g.gene, a.sample, CASE WHEN a.strand = '+' THEN a.pos ELSE a.aend - 1 END AS five, count(*) AS n
FROM genes g JOIN mapped a ON a.seqname = g.seqname
  AND CASE WHEN a.strand = '+' THEN a.pos ELSE a.aend - 1 END BETWEEN g."start" AND g."end" GROUP BY ALL""",
)
def _(t):
    points = t.mapped.groupBy("sample", "seqname", counts.five_prime(F.col("strand"), F.col("pos"), F.col("aend")).alias("five")).agg(
        F.count(F.lit(1)).alias("n")
    )
    pairs = intervals.point_join(points, t.genes, ["seqname"], "five", ("start", "end"))
    return pairs.select("gene", "sample", "five", "n")
