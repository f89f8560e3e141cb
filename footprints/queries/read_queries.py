"""Queries on reads."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from footprints import constants as C
from footprints.functions import sequence as S
from footprints.operators import qc, reads as R
from footprints.queries.registry import VIEWS, query

BARCODE = "AGCGCTT"
ADAPTER_1 = "AAGCGCTAGATCGGAAGAGC"
ADAPTER_2 = "AAGCGCTCTGAACCGCTCTT"
TYPES = list(R.FINDERS)


def _sql_find(seq: str, adapter: str) -> str:
    """Leftmost place by explicit Hamming distances, as an independent form of the search."""
    k = C.ADAPTER_PREFIX_LENGTH
    a = adapter[:k]
    return (
        f"COALESCE(list_min(list_filter(range(0, length({seq})), lambda i: CASE WHEN i + {k} <= length({seq}) "
        f"THEN hamming(substr({seq}, i + 1, {k}), '{a}') <= 1 "
        f"ELSE substr({seq}, i + 1) = left('{a}', length({seq}) - i) END)), length({seq}))"
    )


def _sql_poly_a(seq: str) -> str:
    return f"length(regexp_replace({seq}, '[AN]+$', ''))"


VIEWS.update(
    {
        "adapter_types": """
SELECT sample, ['truseq', 'linker', 'linker_15', 'polyA', 'weinberg', 'nothing', 'jeff'][CAST(substr(sample, 4) AS BIGINT) % 7 + 1] AS adapter_type
FROM (SELECT DISTINCT sample FROM reads)""",
        "linker_places": f"""
SELECT *, CAST({_sql_find('seq', C.SMRNA_LINKER)} AS BIGINT) AS cut FROM reads""",
        "linker_trimmed": "SELECT sample, read_id, substr(seq, 1, cut) AS seq, substr(qual, 1, cut) AS qual, cut AS length FROM linker_places",
        "histogram": """
SELECT sample, CASE WHEN length < 12 THEN 'too_short' ELSE 'trimmed' END AS category, length, count(*) AS n
FROM linker_trimmed GROUP BY ALL""",
        "read_pairs": f"""
SELECT source AS sample, doc_id || ':' || i AS pair_id,
       substr('{BARCODE}' || frag || '{ADAPTER_1}' || repeat('C', 60), 1, 60) AS r1_seq,
       substr('{BARCODE}' || reverse(translate(frag, 'ACGT', 'TGCA')) ||
              CASE WHEN i % 5 = 0 THEN 'T' || substr('{ADAPTER_2}', 2) ELSE '{ADAPTER_2}' END || repeat('G', 60), 1, 60) AS r2_seq
FROM fragments""",
        "composition": """
SELECT sample, length(seq) AS length, i AS cycle, substr(seq, i + 1, 1) AS base, CAST(sum(n) AS BIGINT) AS n
FROM (SELECT sample, seq, count(*) AS n, unnest(range(0, length(seq))) AS i FROM reads GROUP BY sample, seq) GROUP BY ALL""",
    }
)


def linker_trimmed(t):
    return R.trim(t.reads, find_end=lambda s: S.find_adapter(s, C.SMRNA_LINKER))


def histogram(t):
    return qc.length_histogram(R.length_status(linker_trimmed(t)))


def read_pairs(t):
    frag = F.col("frag")
    second = F.when(F.col("i") % 5 == 0, F.lit("T" + ADAPTER_2[1:])).otherwise(F.lit(ADAPTER_2))
    r1 = F.substring(F.concat(F.lit(BARCODE), frag, F.lit(ADAPTER_1), F.repeat(F.lit("C"), 60)), 1, 60)
    r2 = F.substring(F.concat(F.lit(BARCODE), S.reverse_complement(frag), second, F.repeat(F.lit("G"), 60)), 1, 60)
    return t.fragments.select(
        F.col("source").alias("sample"), F.concat_ws(":", "doc_id", "i").alias("pair_id"),
        r1.alias("r1_seq"), F.translate(r1, "TCAG", "I?5F").alias("r1_qual"),
        r2.alias("r2_seq"), F.translate(r2, "TCAG", "I?5F").alias("r2_qual"),
    )


def adapter_types(t):
    kind = F.element_at(F.array(*[F.lit(x) for x in TYPES]), (F.substring("sample", 4, 9).cast("int") % 7 + 1))
    return t.reads.select("sample").distinct().withColumn("adapter_type", kind)


@query(
    "F1_trim_with_payload",
    """
SELECT sample, read_id, substr(seq, 1, cut) AS seq, substr(qual, 1, cut) AS qual, '' AS left_seq, '' AS left_qual,
       substr(seq, cut + 1) AS right_seq, substr(qual, cut + 1) AS right_qual, read_id AS original_name FROM linker_places""",
)
def _(t):
    return linker_trimmed(t)


@query(
    "F1_trim_twice",
    f"""
SELECT sample, read_id, read_id AS original_name, '' AS left_seq, '' AS left_qual, substr(seq, cut + 1) AS right_seq,
       substr(qual, cut + 1) AS right_qual, '' AS retrimmed_left_seq, '' AS retrimmed_left_qual,
       substr(seq, 1, second) AS seq, substr(qual, 1, second) AS qual,
       substr(left(seq, cut), second + 1) AS retrimmed_right_seq, substr(left(qual, cut), second + 1) AS retrimmed_right_qual
FROM (SELECT *, {_sql_poly_a('left(seq, cut)')} AS second FROM linker_places)""",
)
def _(t):
    return R.trim(linker_trimmed(t), find_end=S.poly_a_start, second_time=True)


@query("F2_find_adapter", "SELECT sample, cut, count(*) AS n FROM linker_places GROUP BY ALL")
def _(t):
    cut = S.find_adapter(F.col("seq"), C.SMRNA_LINKER)
    return t.reads.groupBy("sample", cut.alias("cut")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F3_trim_by_adapter_type",
    f"""
WITH placed AS (SELECT sample, adapter_type, seq,
       CASE adapter_type WHEN 'weinberg' THEN 8
            WHEN 'jeff' THEN CASE WHEN instr(seq, 'CAGTA') - 1 IN (11, 12, 13) THEN instr(seq, 'CAGTA') + 4 ELSE 0 END
            ELSE 0 END AS s,
       CASE adapter_type WHEN 'truseq' THEN {_sql_find('seq', C.TRUSEQ_R2_RC)}
            WHEN 'linker' THEN {_sql_find('seq', C.SMRNA_LINKER)} WHEN 'jeff' THEN {_sql_find('seq', C.SMRNA_LINKER)}
            WHEN 'linker_15' THEN {_sql_find('seq', C.SMRNA_15_LINKER)}
            WHEN 'weinberg' THEN {_sql_find('seq', C.BARTEL_LINKER)}
            WHEN 'polyA' THEN {_sql_poly_a('seq')} ELSE length(seq) END AS e
  FROM reads JOIN adapter_types USING (sample))
SELECT adapter_type, CAST(greatest(e - s, 0) AS BIGINT) AS length, substr(seq, 1, s) AS left_seq, count(*) AS n FROM placed GROUP BY ALL""",
)
def _(t):
    trimmed = R.trim_by_type(t.reads, adapter_types(t))
    return trimmed.groupBy("adapter_type", F.length("seq").alias("length"), "left_seq").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F4_F5_F6_sequence_finders",
    f"""
SELECT sample, {_sql_poly_a('seq')} AS poly_a_start, length(regexp_extract(seq, '^[TN]*')) - 1 AS poly_t_end,
       CASE WHEN instr(seq, 'CAGTA') IN (12, 13, 14) THEN instr(seq, 'CAGTA') + 4 ELSE 0 END AS anchor_start, count(*) AS n
FROM reads GROUP BY ALL""",
)
def _(t):
    s = F.col("seq")
    return t.reads.groupBy(
        "sample", S.poly_a_start(s).alias("poly_a_start"), S.poly_t_end(s).alias("poly_t_end"), S.anchor_start(s).alias("anchor_start")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F7_F8_poly_a_runs",
    """
WITH runs AS (SELECT sample, seq, list_sort(list_filter([{'s': i, 'n': length(regexp_extract(substr(seq, i + 1), '^A*'))}
        for i in range(0, length(seq))], lambda r: r.n > 0 AND (r.s = 0 OR substr(seq, r.s, 1) <> 'A'))) AS rs FROM reads),
best AS (SELECT sample, seq, rs, list_filter(rs, lambda r: r.n >= 15) AS long_runs,
        list_max([r.n for r in rs]) AS longest FROM runs)
SELECT sample, CAST(CASE WHEN len(long_runs) > 0 THEN long_runs[1].s WHEN len(rs) = 0 THEN 0
            ELSE list_filter(rs, lambda r: r.n = longest)[1].s END AS INTEGER) AS run_start,
       CAST(CASE WHEN len(long_runs) > 0 THEN long_runs[1].n ELSE COALESCE(longest, 0) END AS INTEGER) AS run_length,
       CASE WHEN length(seq) < 20 THEN length(replace(seq, 'A', '')) = 0
            ELSE length(replace(left(seq, 20), 'A', '')) <= 1 END AS mostly_a, count(*) AS n
FROM best GROUP BY ALL""",
)
def _(t):
    runs = t.reads.select("sample", S.poly_a_run(F.col("seq"), 15).alias("r"), S.predominantly_a(F.col("seq")).alias("mostly_a"))
    return runs.groupBy("sample", F.col("r.start").alias("run_start"), F.col("r.length").alias("run_length"), "mostly_a").agg(
        F.count(F.lit(1)).alias("n")
    )


@query("F9_A1_length_histogram", "SELECT * FROM histogram")
def _(t):
    return histogram(t)


@query(
    "A1_zero_padded_histogram",
    """
SELECT c.sample, c.category, CAST(l AS INTEGER) AS length, COALESCE(h.n, 0) AS n
FROM (SELECT DISTINCT h.sample, h.category, m.top, unnest(range(0, m.top + 1)) AS l FROM histogram h
      JOIN (SELECT sample, max(length(seq)) AS top FROM reads GROUP BY sample) m USING (sample)) c
LEFT JOIN histogram h ON h.sample = c.sample AND h.category = c.category AND h.length = c.l""",
)
def _(t):
    return qc.zero_padded(histogram(t), qc.max_read_lengths(t.reads))


@query(
    "A1_merged_category",
    "SELECT sample, 'merged' AS category, length, CAST(sum(n) AS BIGINT) AS n FROM histogram GROUP BY ALL",
)
def _(t):
    return qc.sum_categories(histogram(t), ["trimmed", "too_short"], "merged")


@query(
    "A2_folded_length_fractions",
    """
SELECT sample, category, length, n, round(n / sum(n) OVER (PARTITION BY sample, category), 6) AS fraction
FROM (SELECT sample, category, least(length, 30) AS length, CAST(sum(n) AS BIGINT) AS n FROM histogram GROUP BY ALL)""",
)
def _(t):
    return qc.folded_fractions(histogram(t), 30).withColumn("fraction", F.round("fraction", 6))


@query("F10_untrim", "SELECT sample, read_id, seq, qual, read_id AS original_name FROM reads")
def _(t):
    return R.untrim(linker_trimmed(t))


@query("F11_strip_barcodes", "SELECT sample, pair_id, substr(r1_seq, 8) AS r1_seq, substr(r2_seq, 8) AS r2_seq FROM read_pairs")
def _(t):
    return R.strip_barcodes(read_pairs(t)).select("sample", "pair_id", "r1_seq", "r2_seq")


@query(
    "F12_trim_fill_pairs",
    f"""
WITH placed AS (SELECT *, COALESCE(list_min(list_filter(range(0, length(r1_seq)), lambda i: CASE WHEN i + 19 <= length(r1_seq)
      THEN hamming(substr(r1_seq, i + 1, 19), '{ADAPTER_1[:19]}') <= 3
      ELSE substr(r1_seq, i + 1) = left('{ADAPTER_1[:19]}', length(r1_seq) - i) END)), length(r1_seq)) AS position FROM read_pairs)
SELECT sample, left(r2_seq, 7) AS barcode, position, length(substr(r1_seq, 1, position)) AS r1_length,
       length(substr(r2_seq, 8, position)) AS r2_length, count(*) AS n FROM placed GROUP BY ALL""",
)
def _(t):
    trimmed = R.trim_fill_pairs(read_pairs(t), ADAPTER_1[:19], 7)
    return trimmed.groupBy(
        "sample", "barcode", "position", F.length("r1_seq").alias("r1_length"), F.length("r2_seq").alias("r2_length")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(
    "F13_trim_consistent_pairs",
    f"""
WITH placed AS (SELECT *, CASE WHEN hamming(substr(r1_seq, 8, 19), '{ADAPTER_1[1:]}') <= 3
        AND hamming(substr(r2_seq, 8, 19), '{ADAPTER_2[1:]}') <= 3 THEN 7
      ELSE list_min(list_filter(range(0, 42), lambda i: hamming(substr(r1_seq, i + 1, 19), '{ADAPTER_1[:19]}') <= 3
        AND hamming(substr(r2_seq, i + 1, 19), '{ADAPTER_2[:19]}') <= 3)) END AS position FROM read_pairs)
SELECT sample, CAST(position AS INTEGER) AS position, COALESCE(position - 7 >= 12, TRUE) AS kept,
       length(substr(r1_seq, 8, greatest(COALESCE(position, 60) - 7, 0))) AS r1_length, count(*) AS n FROM placed GROUP BY ALL""",
)
def _(t):
    trimmed = R.trim_consistent_pairs(read_pairs(t), ADAPTER_1, ADAPTER_2, 7)
    return trimmed.groupBy("sample", "position", "kept", F.length("r1_seq").alias("r1_length")).agg(F.count(F.lit(1)).alias("n"))


def circular_pairs(t):
    """Fragments as circularised constructs: tail, marker and junction between the two payloads."""
    ids = F.when(F.col("i") % 2 == 0, F.lit("A")).otherwise(F.lit("B"))
    right = F.when(ids == "A", C.AFTER_RIGHT["A"]).otherwise(C.AFTER_RIGHT["B"])
    left = F.when(ids == "A", C.AFTER_LEFT["A"]).otherwise(C.AFTER_LEFT["B"])
    tail = F.repeat(F.lit("A"), 12 + F.col("i") % 8)
    forward = F.concat("frag", tail, F.lit("CT"), F.repeat(F.lit("C"), 40))
    reverse = F.concat("frag", F.lit(C.COMMON_RIGHT_REVERSE), right, left, F.repeat(F.lit("T"), 40))
    r1, r2 = F.substring(forward, 1, 75), F.substring(reverse, 1, 75)
    swap = F.col("doc_id") % 2 == 0
    a, b = F.when(swap, r2).otherwise(r1), F.when(swap, r1).otherwise(r2)
    return t.fragments.select(
        F.col("source").alias("sample"), F.concat_ws(":", "doc_id", "i").alias("pair_id"), a.alias("r1_seq"),
        F.translate(a, "TCAG", "I?5F").alias("r1_qual"), b.alias("r2_seq"), F.translate(b, "TCAG", "I?5F").alias("r2_qual"),
    )


@query("F14_circular_boundaries")
def _(t):
    return R.circular_boundaries(circular_pairs(t))


@query("F14_boundary_counters")
def _(t):
    return R.boundary_counters(R.circular_boundaries(circular_pairs(t)))


@query(
    "F26_codons_of_reads",
    f"""
WITH c AS (SELECT sample, unnest([substr(seq, 3 * i + 1, 3) for i in range(0, (length(seq) + 2) // 3)]) AS codon FROM reads),
table1 AS (SELECT substr('{"".join(C.ALL_CODONS)}', 3 * i + 1, 3) AS codon, substr('{C.AMINO_ACIDS}', i + 1, 1) AS amino_acid FROM range(0, 64) t(i)),
deg AS (SELECT amino_acid, count(*) AS degeneracy FROM table1 GROUP BY amino_acid)
SELECT sample, c.codon, translate(c.codon, 'T', 'U') AS rna, amino_acid, degeneracy, count(*) AS n
FROM c LEFT JOIN table1 USING (codon) LEFT JOIN deg USING (amino_acid) GROUP BY ALL""",
)
def _(t):
    from footprints.operators.dimensions import codon_dimension

    dim = codon_dimension(t.spark).select("codon", "amino_acid", "degeneracy")
    counts = t.reads.select("sample", F.explode(S.codons_of(F.col("seq"))).alias("codon")).groupBy("sample", "codon").agg(F.count(F.lit(1)).alias("n"))
    return counts.join(F.broadcast(dim), "codon", "left").withColumn("rna", S.dna_to_rna(F.col("codon")))


@query(
    "F27_reverse_complement",
    """
SELECT sample, reverse(translate(seq, 'ACGTN', 'TGCAN')) AS reverse_complement, translate(seq, 'ACGTN', 'TGCAN') AS complement, count(*) AS n FROM reads GROUP BY ALL""",
)
def _(t):
    s = F.col("seq")
    return t.reads.groupBy("sample", S.reverse_complement(s).alias("reverse_complement"), S.complement(s).alias("complement")).agg(F.count(F.lit(1)).alias("n"))


MARKERS = ["TCAGTTCAGGATCAAGTCATTGACCAGTCATG", C.SMRNA_LINKER, "A" * 50]


@query(
    "F30_synthetic_reads",
    f"""
SELECT sample, {" OR ".join(f"starts_with('{m}', seq) OR suffix('{m}', seq)" for m in MARKERS)} AS synthetic, length, count(*) AS n
FROM linker_trimmed GROUP BY ALL""",
)
def _(t):
    trimmed = R.length_status(linker_trimmed(t))
    return trimmed.groupBy("sample", R.synthetic_hits(trimmed, MARKERS).alias("synthetic"), "length").agg(F.count(F.lit(1)).alias("n"))


@query(
    "F31_synthetic_overlaps",
    f"""
WITH s AS (SELECT DISTINCT seq FROM reads), m AS (SELECT unnest([{", ".join(f"'{m}'" for m in MARKERS)}]) AS marker),
x AS (SELECT seq, marker, k, greatest(0, -k) AS lo, least(length(seq), length(marker) - k) AS hi FROM s, m, range(-49, 50) r(k)),
y AS (SELECT seq, bool_or(CASE WHEN hi - lo > 10 THEN hamming(substr(seq, lo + 1, hi - lo), substr(marker, lo + k + 1, hi - lo)) <= 2 END) AS hit FROM x WHERE hi - lo > 10 GROUP BY seq)
SELECT sample, COALESCE(hit, false) AS synthetic, count(*) AS n FROM reads LEFT JOIN y ON y.seq = reads.seq GROUP BY ALL""",
)
def _(t):
    return R.synthetic_overlaps(t.reads, MARKERS).groupBy("sample", "synthetic").agg(F.count(F.lit(1)).alias("n"))


@query(
    "A3_base_composition",
    "SELECT sample, length, CAST(cycle AS INTEGER) AS cycle, base, n, n AS n_perfect FROM composition",
)
def _(t):
    return qc.base_composition(t.reads)


@query(
    "A4_composition_fractions",
    """
WITH v AS (SELECT sample, 'length' AS view, length, cycle AS position, base, n FROM composition
  UNION ALL SELECT sample, 'all', NULL, cycle, base, n FROM composition
  UNION ALL SELECT sample, 'all_from_right', NULL, cycle - length + 1, base, n FROM composition)
SELECT sample, view, length, position, base, round(sum(n) / sum(sum(n)) OVER (PARTITION BY sample, view, length, position), 6) AS fraction
FROM v GROUP BY sample, view, length, position, base""",
)
def _(t):
    return qc.composition_fractions(qc.base_composition(t.reads)).withColumn("fraction", F.round("fraction", 6))


@query(
    "A5_quality_by_cycle",
    """
SELECT sample, i AS cycle, ascii(substr(qual, i + 1, 1)) - 33 AS quality, count(*) AS n
FROM (SELECT sample, qual, unnest(range(0, length(qual))) AS i FROM reads) GROUP BY ALL""",
)
def _(t):
    return qc.quality_by_cycle(t.reads)


@query(
    "A43_common_sequences",
    """
SELECT * FROM (SELECT sample, kind, seq, n, row_number() OVER (PARTITION BY sample, kind ORDER BY n DESC, seq) AS rank FROM (
  SELECT sample, CASE WHEN CASE WHEN length(seq) - cut < 20 THEN length(replace(substr(seq, cut + 1), 'A', '')) = 0
         ELSE length(replace(substr(seq, cut + 1, 20), 'A', '')) <= 1 END THEN 'long_polyA' ELSE 'other' END AS kind,
         left(seq, cut) AS seq, count(*) AS n
  FROM (SELECT *, length(regexp_replace(seq, '[AN]+$', '')) AS cut FROM reads) GROUP BY ALL)) WHERE rank <= 100""",
)
def _(t):
    trimmed = R.trim(t.reads, find_end=S.poly_a_start)
    return qc.common_sequences(trimmed, "right_seq")


@query(
    "A44_yield_report",
    """
WITH h AS (SELECT o_orderstatus AS sample, category, n FROM (
  SELECT o_orderstatus, CASE o_orderpriority WHEN '1-URGENT' THEN 'too_short' WHEN '2-HIGH' THEN 'rRNA' WHEN '3-MEDIUM' THEN 'trimmed'
         WHEN '4-NOT SPECIFIED' THEN 'tRNA' ELSE 'clean' END AS category, count(*) AS n FROM orders GROUP BY ALL)),
d AS (SELECT o_orderstatus AS sample, count(*) AS reads FROM orders WHERE o_orderpriority = '2-HIGH' AND o_totalprice > 50000 GROUP BY ALL),
s AS (SELECT sample, category, n FROM h UNION ALL SELECT sample, 'rRNA_dominant', reads FROM d
      UNION ALL SELECT h.sample, 'rRNA_other', n - reads FROM h JOIN d USING (sample) WHERE category = 'rRNA')
SELECT sample, category, n, round(n / sum(CASE WHEN category IN ('trimmed', 'too_short') THEN n END) OVER (PARTITION BY sample), 6) AS fraction FROM s""",
)
def _(t):
    names = {"1-URGENT": "too_short", "2-HIGH": "rRNA", "3-MEDIUM": "trimmed", "4-NOT SPECIFIED": "tRNA"}
    orders = t.table("orders")
    category = reduce(lambda c, kv: c.when(F.col("o_orderpriority") == kv[0], kv[1]), names.items(), F.when(F.lit(False), ""))
    h = orders.groupBy(
        F.col("o_orderstatus").alias("sample"), category.otherwise("clean").alias("category"), (F.col("o_custkey") % 50).alias("length")
    ).agg(F.count(F.lit(1)).alias("n"))
    d = orders.where("o_orderpriority = '2-HIGH' and o_totalprice > 50000").groupBy(F.col("o_orderstatus").alias("sample")).agg(
        F.count(F.lit(1)).alias("reads")
    )
    return qc.yield_report(h, d).withColumn("fraction", F.round("fraction", 6))


LOCI = [("locus_1", "TCAGGTCAATCGGACTTGACCATGACTT", "GATCAGTTACGGATCATTGACCAGTCAA"), ("locus_2", "A" * 28, "T" * 28)]


@query(
    "A45_triplets_at_codon",
    f"""
WITH s AS (SELECT DISTINCT seq FROM reads), c AS (SELECT * FROM (VALUES {", ".join(f"('{name}', '{left}NNN{right}')" for name, left, right in LOCI)}) v(locus, target)),
x AS (SELECT seq, locus, target, k, greatest(0, -k) AS lo, least(length(seq), length(target) - k) AS hi FROM s, c, range(-49, 59) r(k)),
y AS (SELECT *, hi - lo AS overlap, CASE WHEN hi - lo >= 20 THEN hamming(substr(seq, lo + 1, hi - lo), substr(target, lo + k + 1, hi - lo)) END - greatest(0, least(hi + k, 31) - greatest(lo + k, 28)) AS miss
      FROM x WHERE hi - lo >= 20),
z AS (SELECT seq, locus, 28 - arg_max(k, (2 * overlap - 3 * miss) * 1000 - k) AS place FROM y WHERE miss <= 14 AND 2 * overlap >= 3 * miss GROUP BY seq, locus)
SELECT sample, locus, substr(reads.seq, CAST(place + 1 AS BIGINT), 3) AS triplet, count(*) AS n FROM reads JOIN z ON z.seq = reads.seq
WHERE place >= 3 AND length(reads.seq) - 1 - (place + 2) >= 3 GROUP BY ALL""",
)
def _(t):
    return R.triplets_at(t.reads, LOCI, 20, 14)


@query(
    "A66_consensus_tail",
    """
WITH c AS (SELECT sample, i AS position, substr(tail, i + 1, 1) AS base, count(*) AS c
  FROM (SELECT sample, tail, unnest(range(0, length(tail))) AS i FROM (SELECT sample, substr(seq, cut + 1) AS tail FROM linker_places)) GROUP BY ALL)
SELECT sample, position, arg_max(base, c * 1000 - ascii(base)) AS base, round(max(c) / sum(c), 6) AS fraction, CAST(sum(c) AS BIGINT) AS n
FROM c GROUP BY sample, position""",
)
def _(t):
    tails = linker_trimmed(t).withColumnRenamed("right_seq", "tail")
    return qc.consensus_tail(tails).withColumn("fraction", F.round("fraction", 6))


@query(
    "A67_run_summary",
    """
SELECT o_orderstatus AS sample, o_orderpriority AS status, count(*) AS n, count(*) FILTER (o_totalprice >= 12000) AS long_enough
FROM orders GROUP BY ALL""",
)
def _(t):
    o = t.table("orders").withColumnRenamed("o_orderstatus", "sample").withColumnRenamed("o_orderpriority", "status")
    return o.groupBy("sample", "status").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_totalprice") >= 12000).alias("long_enough"))


@query(
    "A68_A69_max_read_lengths",
    "SELECT max_length, count(*) AS n FROM (SELECT sample, max(length) AS max_length FROM linker_trimmed GROUP BY sample) GROUP BY ALL",
)
def _(t):
    return qc.length_distribution(qc.max_read_lengths(linker_trimmed(t)))


@query("A69_max_gene_length", "SELECT seqname, max(stop_codon_t - start_codon_t) AS max_cds_length FROM genes GROUP BY seqname")
def _(t):
    return t.genes.groupBy("seqname").agg(F.max(F.col("stop_codon_t") - F.col("start_codon_t")).alias("max_cds_length"))
