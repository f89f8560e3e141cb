"""Queries on alignments and annotation."""

from __future__ import annotations

from pyspark.sql import functions as F

from footprints import constants as C
from footprints.functions import cigar as G, sequence as S
from footprints.operators import alignments as A, annotation as N, counts, features as X, qc
from footprints.queries import inputs
from footprints.queries.registry import VIEWS, query

W = inputs.GENOME_CHUNK

VIEWS.update(
    {
        "numbered_reads": "SELECT row_number() OVER () AS rid, * FROM alignments",
        "read_bases": """
SELECT b.*, COALESCE(g.base, '-') AS g, CASE
    WHEN strand = '+' AND k >= qlen - nongenomic_length % 4 THEN 'A' WHEN strand = '-' AND k < nongenomic_length % 4 THEN 'T'
    ELSE substr('TCAG', CAST(1 + (((q * q * 31 + q * 2654435 + b.seqname * 97) % 1009) % 4 + CASE WHEN (pos + 3 * k + barcode) % 7 = 0 THEN 1 ELSE 0 END) % 4 AS BIGINT), 1) END AS r,
    25 + (pos + k) % 15 AS quality
FROM (SELECT *, pos + k + CASE WHEN split AND k >= 10 THEN 30 ELSE 0 END AS q
      FROM (SELECT *, unnest(range(0, qlen)) AS k FROM numbered_reads)) b
LEFT JOIN genome_bases g ON g.seqname = b.seqname AND g.p = b.q""",
        "genome_lengths": "SELECT seqname, max(p) + 1 AS length FROM genome_bases GROUP BY seqname",
        "mates": """
SELECT sample, qname || '-' || barcode AS name, seqname, pos, aend, strand, mapq, is_unmapped, qlen, split, nongenomic_length,
       CASE WHEN qlen = 27 THEN seqname + 1 ELSE seqname END AS seqname2,
       greatest(0, pos + ((CAST(pos AS BIGINT) + qlen) % 5 - 1) * 60 + CASE WHEN qlen = 31 THEN 20000 ELSE 0 END) AS pos2,
       CASE WHEN nm = 2 AND qlen = 25 THEN CASE strand WHEN '+' THEN '-' ELSE '+' END ELSE strand END AS strand2,
       nongenomic_length = 4 AS unmapped2, CASE WHEN nongenomic_length = 7 THEN 3 ELSE mapq END AS mapq2
FROM alignments""",
        "mate_groups": """
SELECT sample, name, count(*) AS size, bool_or(is_unmapped) AS u1, bool_or(unmapped2) AS u2, min(mapq) AS q1, min(mapq2) AS q2,
       max(seqname) AS seqname, max(seqname2) AS seqname2, max(pos) AS pos, max(pos2) AS pos2, max(aend) AS aend,
       max(pos2 + qlen) AS aend2, max(strand) AS strand, max(strand2) AS strand2, bool_or(split) AS split, max(qlen) AS qlen
FROM mates GROUP BY sample, name""",
        "noncoding_genes": """
SELECT id AS gene, seqname, strand, "start", "end", feature AS cls, CASE feature WHEN 'rRNA' THEN 0 WHEN 'tRNA' THEN 1 ELSE 2 END AS class_rank,
       CASE feature WHEN 'snoRNA' THEN 'other_ncRNA' ELSE feature END AS class
FROM features WHERE parent_id IS NULL AND feature IN ('rRNA', 'tRNA', 'snoRNA')""",
        "nc_hits": """
SELECT a.*, t.gene, t.class, t.class_rank, t."start" AS t_start, t."end" AS t_end FROM mapped a JOIN noncoding_genes t ON a.seqname = t.seqname
AND CASE WHEN a.split THEN (a.pos <= t."end" AND a.pos + 9 >= t."start") OR (a.pos + 40 <= t."end" AND a.aend - 1 >= t."start")
         ELSE a.pos <= t."end" AND a.aend - 1 >= t."start" END""",
        "top_features": """
SELECT t.*, (SELECT count(*) FROM features o WHERE o.parent_id IS NULL AND o.feature NOT IN ('chromosome', 'landmark', 'ARS', 'region')
             AND COALESCE(o.orf_classification, '') <> 'Dubious' AND o.seqname = t.seqname AND o.id <> t.id
             AND o."start" <= t."end" AND t."start" <= o."end" AND (o.strand = '.' OR t.strand = '.' OR o.strand = t.strand)) AS overlapping,
  COALESCE((SELECT max(o."end") FROM features o WHERE o.parent_id IS NULL AND o.feature NOT IN ('chromosome', 'landmark', 'ARS', 'region')
             AND COALESCE(o.orf_classification, '') <> 'Dubious' AND o.seqname = t.seqname AND o."end" < t."start"
             AND (o.strand = '.' OR o.strand = t.strand)), -1) AS closest_left,
  COALESCE((SELECT min(o."start") FROM features o WHERE o.parent_id IS NULL AND o.feature NOT IN ('chromosome', 'landmark', 'ARS', 'region')
             AND COALESCE(o.orf_classification, '') <> 'Dubious' AND o.seqname = t.seqname AND o."start" > t."end"
             AND (o.strand = '.' OR o.strand = t.strand)), (SELECT l.length FROM genome_lengths l WHERE l.seqname = t.seqname)) AS closest_right
FROM features t WHERE t.parent_id IS NULL""",
    }
)


def genome_lengths(t):
    return t.genome.groupBy("seqname").agg(((F.max("chunk") + 1) * W).alias("length"))


def aligned_reads(t):
    """Alignments with sequences: the genome's bases with some changed, the 3' end partly A."""
    ks = F.sequence(F.lit(0), F.col("qlen") - 1)
    # Places are made first, so that a base takes a place from a variable and does not work it out twice.
    places = F.transform(ks, lambda k: (F.col("pos") + k + F.when((k >= 10) & (F.size("cigar") > 1), 30).otherwise(0)) % inputs.MODULUS)
    shift = lambda k: F.when((F.col("pos") + 3 * k + F.col("barcode")) % 7 == 0, 1).otherwise(0)
    letters = F.array(*[F.lit(b) for b in C.BASES])
    genomic = F.array_join(F.transform(places, lambda q, k: F.get(letters, (inputs.base_number(q, F.col("seqname")) + shift(k)) % 4)), "")
    plus, tail = F.col("strand") == "+", F.col("nongenomic_length") % 4
    seq = (
        F.when(plus & (tail > 0), F.concat(F.substr("_genomic", F.lit(1), F.col("qlen") - tail), F.repeat(F.lit("A"), tail)))
        .when(~plus & (tail > 0), F.concat(F.repeat(F.lit("T"), tail), F.substr("_genomic", tail + 1, F.col("qlen"))))
        .otherwise(F.col("_genomic"))
    )
    return (
        t.alignments.withColumn("_genomic", genomic).withColumn("seq", seq).drop("_genomic")
        .withColumn("qual", F.array_join(F.transform(ks, lambda k: F.char(F.lit(33 + 25) + (F.col("pos") + k) % 15)), ""))
    )


def referenced(t):
    return A.with_reference(aligned_reads(t), t.genome, W)


def mates(t):
    a = t.alignments.withColumn("name", F.concat_ws("-", "qname", "barcode")).withColumn("seq", F.repeat(F.lit("C"), F.col("qlen"))).withColumn(
        "qual", F.repeat(F.lit("I"), F.col("qlen"))
    )
    flip = F.when(F.col("strand") == "+", "-").otherwise("+")
    pos2 = F.greatest(F.lit(0), F.col("pos") + ((F.col("pos") + F.col("qlen")) % 5 - 1) * 60 + F.when(F.col("qlen") == 31, 20000).otherwise(0))
    b = a.select(
        "sample", "name", F.when(F.col("qlen") == 27, F.col("seqname") + 1).otherwise(F.col("seqname")).alias("seqname"),
        pos2.alias("pos"), (pos2 + F.col("qlen")).alias("aend"),
        F.when((F.col("nm") == 2) & (F.col("qlen") == 25), flip).otherwise(F.col("strand")).alias("strand"),
        F.when(F.col("nongenomic_length") == 7, 3).otherwise(F.col("mapq")).alias("mapq"),
        F.array(F.struct(F.lit(0).alias("op"), F.col("qlen").alias("len"))).alias("cigar"), "seq", "qual", F.concat(F.col("name"), F.lit("_3")).alias("qname"),
        (F.col("nongenomic_length") == 4).alias("is_unmapped"),
    )
    return a, b


def noncoding_transcripts(t):
    genes = X.noncoding(t.features)
    return X.transcripts_of(genes, t.features).join(genes.select(F.col("id").alias("gene"), "class", "class_rank"), "gene")


def contaminant_hits(t):
    return A.contaminant_hits(t.mapped, noncoding_transcripts(t))


@query(
    "F16_unique_nonunique",
    """
WITH g AS (SELECT sample, qname, count(*) AS size, min(mapq) AS q, count(*) FILTER (mapq = 50) AS uniq FROM mapped GROUP BY ALL)
SELECT sample, size > 1 OR q < 40 AS nonunique, count(*) AS groups, CAST(sum(uniq) AS BIGINT) AS unique_mappings FROM g GROUP BY ALL""",
)
def _(t):
    g = t.mapped.groupBy("sample", "qname").agg(
        F.count(F.lit(1)).alias("size"), F.min("mapq").alias("q"), F.count_if(counts.is_unique(F.col("mapq"))).alias("uniq")
    )
    return g.groupBy("sample", A.nonunique(F.col("size"), F.col("q")).alias("nonunique")).agg(
        F.count(F.lit(1)).alias("groups"), F.sum("uniq").alias("unique_mappings")
    )


_PLAIN = "CASE WHEN split THEN '10M30N' || (qlen - 10) || 'M' ELSE qlen || 'M' END"


@query(
    "F18_trim_leading_mismatches",
    f"""
WITH lead AS (SELECT rid, any_value(sample) AS sample, any_value(qname) AS qname, any_value(seqname) AS seqname, any_value(pos) AS pos,
    any_value(aend) AS aend, any_value(strand) AS strand, any_value(qlen) AS qlen, bool_or(split) AS split, bool_or(is_unmapped) AS is_unmapped,
    string_agg(r, '' ORDER BY k) AS seq,
    CASE WHEN any_value(strand) = '+' THEN min(k) FILTER (r = g OR quality < 30)
         ELSE any_value(qlen) - 1 - max(k) FILTER (r = g OR quality < 30) END AS run FROM read_bases GROUP BY rid),
cut AS (SELECT *, CASE WHEN is_unmapped THEN 0 ELSE run END AS trimmed FROM lead)
SELECT sample, qname, seqname, strand, CAST(trimmed AS INTEGER) AS trimmed,
  CASE WHEN strand = '+' THEN substr(seq, trimmed + 1) ELSE left(seq, qlen - trimmed) END AS seq,
  CASE WHEN strand = '+' THEN pos + trimmed + CASE WHEN split AND trimmed >= 10 THEN 30 ELSE 0 END ELSE pos END AS pos,
  CASE WHEN strand = '+' OR trimmed = 0 THEN aend ELSE CASE WHEN split AND qlen - trimmed > 10 THEN aend - trimmed ELSE pos + qlen - trimmed END END AS aend,
  CASE WHEN NOT split THEN (qlen - trimmed) || 'M'
       WHEN strand = '+' THEN CASE WHEN trimmed < 10 THEN (10 - trimmed) || 'M30N' || (qlen - 10) || 'M' ELSE (qlen - trimmed) || 'M' END
       ELSE CASE WHEN qlen - trimmed > 10 THEN '10M30N' || (qlen - trimmed - 10) || 'M' ELSE (qlen - trimmed) || 'M' END END AS cigar
FROM cut""",
)
def _(t):
    done = A.trim_leading_mismatches(referenced(t))
    return done.select("sample", "qname", "seqname", "strand", "trimmed", "seq", "pos", "aend", G.unparse(F.col("cigar")).alias("cigar"))


VIEWS["mismatch_table"] = """
SELECT sample, is_secondary, qlen AS length, CASE WHEN strand = '-' THEN qlen - 1 - k ELSE k END AS position, quality,
  CASE WHEN strand = '-' THEN translate(g, 'ACGT', 'TGCA') ELSE g END AS ref_base,
  CASE WHEN strand = '-' THEN translate(r, 'ACGT', 'TGCA') ELSE r END AS read_base, count(*) AS n
FROM read_bases WHERE NOT is_unmapped GROUP BY ALL"""


@query("A6_mismatch_counts", "SELECT * FROM mismatch_table")
def _(t):
    return A.mismatch_counts(referenced(t))


@query(
    "A7_miscall_fractions",
    """
SELECT sample, length, position, base, round(wrong / sum(calls) OVER (PARTITION BY sample, length, position), 6) AS fraction
FROM (SELECT sample, length, position, read_base AS base, sum(n) AS calls, sum(n) FILTER (read_base <> ref_base) AS w,
             COALESCE(sum(n) FILTER (read_base <> ref_base), 0) AS wrong
      FROM mismatch_table WHERE quality >= 30 AND NOT is_secondary GROUP BY ALL)""",
)
def _(t):
    primary = A.mismatch_counts(referenced(t)).where("not is_secondary")
    return qc.miscall_fractions(primary).withColumn("fraction", F.round("fraction", 6))


@query(
    "F19_clip_nongenomic_tail",
    """
WITH runs AS (SELECT rid, any_value(strand) AS strand, any_value(qlen) AS qlen,
    COALESCE(max(k) FILTER (r NOT IN ('A', 'N')) + 1, 0) AS tail_start, COALESCE(min(k) FILTER (r NOT IN ('T', 'N')) - 1, any_value(qlen) - 1) AS head_end
    FROM read_bases GROUP BY rid),
c AS (SELECT b.rid, any_value(sample) AS sample, any_value(qname) AS qname, any_value(seqname) AS seqname, any_value(b.pos) AS pos,
    any_value(aend) AS aend, any_value(b.strand) AS strand, any_value(b.qlen) AS qlen, bool_or(split) AS split,
    bool_or(is_unmapped) AS is_unmapped, any_value(nongenomic_length) AS old,
    CASE WHEN any_value(b.strand) = '+' THEN any_value(b.qlen) - COALESCE(min(k) FILTER (k >= tail_start AND g <> 'A'), any_value(b.qlen))
         ELSE COALESCE(max(k) FILTER (k <= head_end AND g <> 'T') + 1, 0) END AS n
    FROM read_bases b JOIN runs r ON r.rid = b.rid GROUP BY b.rid),
d AS (SELECT *, CASE WHEN is_unmapped THEN 0 ELSE n END AS clipped FROM c)
SELECT sample, qname, seqname, strand, CAST(clipped AS INTEGER) AS clipped, CAST(CASE WHEN is_unmapped THEN old ELSE clipped END AS INTEGER) AS nongenomic_length,
  CASE WHEN strand = '-' THEN pos + clipped + CASE WHEN split AND clipped >= 10 THEN 30 ELSE 0 END ELSE pos END AS pos,
  CASE WHEN strand = '-' OR clipped = 0 THEN aend ELSE CASE WHEN split AND qlen - clipped > 10 THEN aend - clipped ELSE pos + qlen - clipped END END AS aend,
  CASE WHEN clipped = 0 THEN CASE WHEN split THEN '10M30N' || (qlen - 10) || 'M' ELSE qlen || 'M' END
       WHEN strand = '+' THEN CASE WHEN split AND qlen - clipped > 10 THEN '10M30N' || (qlen - clipped - 10) || 'M' ELSE (qlen - clipped) || 'M' END || clipped || 'S'
       ELSE clipped || 'S' || CASE WHEN split AND clipped < 10 THEN (10 - clipped) || 'M30N' || (qlen - 10) || 'M' ELSE (qlen - clipped) || 'M' END END AS cigar
FROM d""",
)
def _(t):
    done = A.clip_nongenomic_tail(referenced(t))
    return done.select("sample", "qname", "seqname", "strand", "clipped", "nongenomic_length", "pos", "aend", G.unparse(F.col("cigar")).alias("cigar"))


@query(
    "F20_extend_tails",
    """
WITH a AS (SELECT row_number() OVER () AS rid, * FROM mapped),
e AS (SELECT a.rid, any_value(a.sample) AS sample, any_value(a.qname) AS qname, any_value(a.seqname) AS seqname, any_value(a.pos) AS pos,
    any_value(a.aend) AS aend, any_value(a.strand) AS strand, any_value(a.qlen) AS qlen, bool_or(a.split) AS split, any_value(a.nongenomic_length) AS n,
    COALESCE(min(d) FILTER (d < nongenomic_length AND COALESCE(base, '-') <> CASE WHEN strand = '+' THEN 'A' ELSE 'T' END), any_value(nongenomic_length)) AS extended
  FROM (SELECT *, unnest(range(0, nongenomic_length + 1)) AS d FROM a) a
  LEFT JOIN genome_bases g ON g.seqname = a.seqname AND g.p = CASE WHEN a.strand = '+' THEN a.aend + d ELSE a.pos - 1 - d END
  GROUP BY a.rid)
SELECT sample, qname, seqname, strand, CAST(extended AS INTEGER) AS extended, CAST(n - extended AS INTEGER) AS nongenomic_length,
  CASE WHEN strand = '-' THEN pos - extended ELSE pos END AS pos, CASE WHEN strand = '+' THEN aend + extended ELSE aend END AS aend, qlen + n AS seq_length,
  CASE WHEN strand = '+' THEN CASE WHEN split THEN '10M30N' || (qlen - 10 + extended) || 'M' ELSE (qlen + extended) || 'M' END || CASE WHEN n > extended THEN (n - extended) || 'S' ELSE '' END
       ELSE CASE WHEN n > extended THEN (n - extended) || 'S' ELSE '' END || CASE WHEN split THEN (10 + extended) || 'M30N' || (qlen - 10) || 'M' ELSE (qlen + extended) || 'M' END END AS cigar
FROM e""",
)
def _(t):
    tails = aligned_reads(t).where("not is_unmapped").withColumn("tail_seq", F.repeat(F.lit("A"), F.col("nongenomic_length"))).withColumn(
        "tail_qual", F.repeat(F.lit("I"), F.col("nongenomic_length"))
    )
    done = A.extend_tails(tails, t.genome, W)
    return done.select(
        "sample", "qname", "seqname", "strand", "extended", "nongenomic_length", "pos", "aend", F.length("seq").alias("seq_length"),
        G.unparse(F.col("cigar")).alias("cigar"),
    )


@query(
    "F21_unambiguous_ends",
    """
WITH e AS MATERIALIZED (SELECT sample, qname, seqname, pos, aend, strand, CASE WHEN strand = '+' THEN aend - 1 ELSE pos END AS p1,
                               CASE WHEN strand = '+' THEN aend ELSE pos - 1 END AS p2 FROM mapped),
x AS MATERIALIZED (SELECT e.*, g.base AS b1 FROM e JOIN genome_bases g ON g.seqname = e.seqname AND g.p = e.p1)
SELECT sample, qname, x.seqname, pos, aend, strand FROM x JOIN genome_bases g ON g.seqname = x.seqname AND g.p = x.p2
WHERE b1 <> CASE WHEN strand = '+' THEN 'A' ELSE 'T' END AND g.base <> CASE WHEN strand = '+' THEN 'A' ELSE 'T' END""",
)
def _(t):
    return A.unambiguous_ends(t.mapped, t.genome, genome_lengths(t), W).select("sample", "qname", "seqname", "pos", "aend", "strand")


@query(
    "F22_position_ambiguity",
    """
SELECT gene, length, CASE WHEN substr(sequence, s + length, 1) = 'A' THEN 0 WHEN substr(sequence, s + length + 1, 1) = 'A' THEN 1 ELSE 2 END AS code,
       count(*) AS n, CAST(sum(s) AS BIGINT) AS start_sum
FROM (SELECT gene, sequence, length, unnest(range(0, length(sequence) - length)) AS s FROM transcript_text, (VALUES (28), (29), (30)) v(length)) GROUP BY ALL""",
)
def _(t):
    from footprints.queries.counting import sequences

    codes = A.position_ambiguity(sequences(t), [28, 29, 30])
    return codes.groupBy("gene", "length", "code").agg(F.count(F.lit(1)).alias("n"), F.sum("start").alias("start_sum"))


@query(
    "F23_gene_features",
    """
SELECT id, feature, seqname, "start", "end" FROM features WHERE parent_id IS NULL AND COALESCE(orf_classification, '') <> 'Dubious'""",
)
def _(t):
    return X.gene_features(t.features).select("id", "feature", "seqname", "start", "end")


@query(
    "F23_nontrivial_features",
    """
SELECT feature, count(*) AS n FROM features WHERE parent_id IS NULL AND feature NOT IN ('chromosome', 'landmark', 'ARS', 'region')
AND COALESCE(orf_classification, '') <> 'Dubious' GROUP BY feature""",
)
def _(t):
    return X.nontrivial(X.top_level(t.features)).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))


@query("F24_noncoding_transcripts", "SELECT gene, class, class_rank FROM noncoding_genes")
def _(t):
    return X.noncoding(t.features).select(F.col("id").alias("gene"), "class", "class_rank")


@query(
    "F24_noncoding_by_exon_source",
    """
SELECT p_partkey // 2 AS transcript_id, CASE WHEN bool_or(p_size % 5 = 0) THEN 'rRNA' WHEN bool_or(p_size % 5 = 1) THEN 'tRNA' ELSE 'other_ncRNA' END AS class
FROM part GROUP BY p_partkey // 2 HAVING bool_or(p_size % 5 <= 2)""",
)
def _(t):
    source = F.element_at(F.array(*[F.lit(s) for s in ("rRNA", "tRNA", "snRNA", "protein_coding", "pseudogene")]), (F.col("p_size") % 5 + 1))
    exons = t.table("part").select(F.expr("p_partkey div 2").alias("transcript_id"), source.alias("source"))
    return X.noncoding_by_source(exons)


@query(
    "F25_translated_genes",
    "SELECT id FROM features WHERE feature = 'gene' AND orf_classification <> 'Dubious'",
)
def _(t):
    return X.translated(t.features).select("id")


@query(
    "J7_mark_nearby",
    "SELECT id, overlapping, closest_left, closest_right FROM top_features",
)
def _(t):
    return X.mark_nearby(t.features, genome_lengths(t)).select("id", "overlapping", "closest_left", "closest_right")


@query("J6_nearest_features", "SELECT id, closest_left, closest_right FROM top_features")
def _(t):
    from footprints.operators import intervals

    tops = X.top_level(t.features)
    return intervals.nearest(tops.select("id", "seqname", "strand", "start", "end"), X.nontrivial(tops), genome_lengths(t)).select(
        "id", "closest_left", "closest_right"
    )


@query(
    "J8_feature_descendants",
    """
WITH RECURSIVE d AS (SELECT parent_id AS top_id, id, 1 AS depth FROM features WHERE parent_id IS NOT NULL
  UNION ALL SELECT d.top_id, f.id, d.depth + 1 FROM d JOIN features f ON f.parent_id = d.id)
SELECT * FROM d""",
)
def _(t):
    return X.descendants(t.features)


@query(
    "J9_transcripts_of_genes",
    """
WITH g AS (SELECT id AS gene, seqname, strand, "start", "end" FROM features WHERE feature = 'gene' AND orf_classification <> 'Dubious')
SELECT gene, seqname, strand, "start", "end", CASE WHEN strand = '+' THEN "start" + 30 ELSE "end" - 57 END AS first_start_codon_position,
  CASE WHEN strand = '+' THEN "end" - 59 ELSE "start" + 32 END AS first_stop_codon_position, "end" - "start" + 1 - 30 AS transcript_length,
  CASE WHEN strand = '+' THEN 30 ELSE 57 END AS start_codon_t,
  CASE WHEN strand = '+' THEN "end" - "start" - 30 - 59 ELSE "end" - "start" - 30 - 32 END AS stop_codon_t
FROM g""",
)
def _(t):
    return X.transcripts_of(X.translated(t.features), t.features).drop("exons")


def sgd_features(t):
    """The first shape of the annotation: CDS below mRNA without exons; some genes with an intron in the 5' UTR."""
    mrna = F.concat(F.regexp_extract("id", "^g[0-9]+", 0), F.lit("_mRNA"))
    f = t.features.where("feature in ('gene', 'mRNA', 'CDS')").select(
        "seqname", "feature", "id", F.when(F.col("feature") == "CDS", mrna).otherwise(F.col("parent_id")).alias("parent_id"), "start", "end", "strand"
    )
    introns = f.where("feature = 'mRNA' and (start div 600) % 3 = 0").select(
        "seqname", F.lit("five_prime_UTR_intron").alias("feature"), F.concat("id", F.lit("_i")).alias("id"), F.col("id").alias("parent_id"),
        F.when(F.col("strand") == "+", F.col("start") + 10).otherwise(F.col("end") - 20).alias("start"),
        F.when(F.col("strand") == "+", F.col("start") + 20).otherwise(F.col("end") - 10).alias("end"), "strand",
    )
    return f.unionByName(introns)


@query(
    "J10_add_exons",
    """
WITH f AS (SELECT seqname, feature, id, CASE WHEN feature = 'CDS' THEN regexp_extract(id, '^g[0-9]+') || '_mRNA' ELSE parent_id END AS parent_id, "start" AS s, "end" AS e, strand, regexp_extract(id, '^g[0-9]+') AS gene_id
           FROM features WHERE feature IN ('gene', 'mRNA', 'CDS')),
i AS (SELECT seqname, 'intron' AS feature, id || '_i' AS id, id AS parent_id, CASE WHEN strand = '+' THEN s + 10 ELSE e - 20 END AS s,
        CASE WHEN strand = '+' THEN s + 20 ELSE e - 10 END AS e, strand, gene_id FROM f WHERE feature = 'mRNA' AND (s // 600) % 3 = 0),
c AS (SELECT *, row_number() OVER (PARTITION BY gene_id ORDER BY s) AS k, count(*) OVER (PARTITION BY gene_id) AS m FROM f WHERE feature = 'CDS'),
u AS (SELECT gene_id, s AS i_s, e AS i_e, CASE WHEN strand = '+' THEN s - 50 ELSE e + 1 END AS u_s, CASE WHEN strand = '+' THEN s - 1 ELSE e + 50 END AS u_e FROM i)
SELECT seqname, feature, id, parent_id, s AS "start", e AS "end", strand, gene_id FROM i
UNION ALL SELECT seqname, feature, id, parent_id, CASE WHEN strand = '+' AND u_s IS NOT NULL THEN u_s ELSE s END,
   CASE WHEN strand = '-' AND u_e IS NOT NULL THEN u_e ELSE e END, strand, f.gene_id FROM f LEFT JOIN u USING (gene_id) WHERE feature <> 'CDS'
UNION ALL SELECT seqname, feature, id, gene_id || '_exon_' || k, s, e, strand, gene_id FROM c
UNION ALL SELECT seqname, 'exon', gene_id || '_exon_' || k, parent_id,
   CASE WHEN strand = '+' AND k = 1 AND i_e IS NOT NULL THEN i_e + 1 ELSE s END,
   CASE WHEN strand = '-' AND k = 1 AND i_s IS NOT NULL THEN i_s - 1 ELSE e END, strand, c.gene_id FROM c LEFT JOIN u USING (gene_id)
UNION ALL SELECT i.seqname, 'exon', i.gene_id || '_exon_3', i.parent_id, u_s, u_e, strand, i.gene_id FROM i JOIN u USING (gene_id)""",
)
def _(t):
    return X.add_exons(sgd_features(t))


@query(
    "J10_standard_seqnames",
    "SELECT CASE WHEN l_returnflag = 'A' THEN 'Mito' ELSE 'chr' || l_returnflag END AS seqname, count(*) AS n FROM lineitem GROUP BY ALL",
)
def _(t):
    raw = F.when(F.col("l_returnflag") == "A", "chrmt").otherwise(F.concat(F.lit("chrchr"), "l_returnflag"))
    return t.table("lineitem").groupBy(X.standard_seqname(raw).alias("seqname")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "J11_extend_utrs",
    """
WITH f AS (SELECT *, regexp_extract(id, '^g[0-9]+') AS gene FROM features),
g AS (SELECT id AS gene, CASE WHEN strand = '+' THEN "start" - 40 ELSE "end" + 40 END AS five, CASE WHEN strand = '+' THEN "end" + 25 ELSE "start" - 25 END AS three
      FROM features WHERE feature = 'gene' AND orf_classification <> 'Dubious')
SELECT f.id, f.feature, CASE WHEN five IS NOT NULL AND (f.feature IN ('gene', 'mRNA') OR f.id = f.gene || '_e1') THEN least(five, three) ELSE "start" END AS "start",
       CASE WHEN five IS NOT NULL AND (f.feature IN ('gene', 'mRNA') OR f.id = f.gene || '_e2') THEN greatest(five, three) ELSE "end" END AS "end"
FROM f LEFT JOIN g ON g.gene = f.gene""",
)
def _(t):
    plus = F.col("strand") == "+"
    bounds = X.translated(t.features).select(
        F.col("id").alias("gene"), F.when(plus, F.col("start") - 40).otherwise(F.col("end") + 40).alias("five_pos"),
        F.when(plus, F.col("end") + 25).otherwise(F.col("start") - 25).alias("three_pos"),
    )
    return X.extend_utrs(t.features, bounds).select("id", "feature", "start", "end")


@query(
    "J12_contaminant_hits",
    """
SELECT sample, class, count(*) AS n, count(DISTINCT qname) AS reads, CAST(sum(first) AS BIGINT) AS primaries FROM (
  SELECT *, CASE WHEN row_number() OVER (PARTITION BY sample, qname
         ORDER BY class_rank, seqname, t_start, t_end, gene, pos, aend, strand, mapq, barcode) = 1 THEN 1 ELSE 0 END AS first FROM nc_hits)
GROUP BY sample, class""",
)
def _(t):
    return contaminant_hits(t).groupBy("sample", "class").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("qname").alias("reads"), F.sum(F.col("is_primary").cast("bigint")).alias("primaries")
    )


@query(
    "J12_clean_alignments",
    """
SELECT sample, qname, seqname, pos, aend, strand FROM mapped m
WHERE NOT EXISTS (SELECT 1 FROM nc_hits h WHERE h.sample = m.sample AND h.qname = m.qname)""",
)
def _(t):
    return A.clean_alignments(t.mapped, contaminant_hits(t)).select("sample", "qname", "seqname", "pos", "aend", "strand")


@query(
    "J13_drop_contaminant_reads",
    """
WITH often AS (SELECT seq FROM reads GROUP BY seq HAVING count(*) > 3)
SELECT sample, CASE WHEN seq IN (SELECT seq FROM often) THEN 'rRNA' ELSE 'kept' END AS category, length(seq) AS length, count(*) AS n FROM reads GROUP BY ALL""",
)
def _(t):
    often = t.reads.groupBy("seq").agg(F.count(F.lit(1)).alias("c")).where("c > 3").select("seq")
    hits = t.reads.join(often, "seq").select("sample", "read_id")
    kept = A.drop_hit_reads(t.reads, hits, "read_id").groupBy("sample", F.lit("kept").alias("category"), F.length("seq").alias("length")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return kept.unionByName(A.hit_lengths(t.reads, hits, "read_id", F.length("seq"), "rRNA"))


VIEWS["end_pairs"] = """
SELECT *, CASE WHEN u1 OR u2 THEN 'unmapped' WHEN size > 1 OR q1 < 40 OR q2 < 40 THEN 'nonunique'
  WHEN seqname <> seqname2 OR strand <> strand2 OR greatest(aend, aend2) - least(pos, pos2) > 10000 THEN 'discordant'
  WHEN CASE WHEN strand = '+' THEN pos2 - aend ELSE pos - aend2 END < 0 THEN 'discordant' ELSE 'concordant' END AS status FROM mate_groups"""


@query(
    "J14_combine_ends",
    """
SELECT sample, name, status, CASE WHEN status = 'concordant' THEN least(pos, pos2) END AS pos, CASE WHEN status = 'concordant' THEN greatest(aend, aend2) END AS aend,
  CASE WHEN status = 'concordant' THEN name || '_3' END AS qname,
  CASE WHEN status = 'concordant' THEN CASE WHEN strand = '+' THEN CASE WHEN split THEN '10M30N' || (qlen - 10) || 'M' ELSE qlen || 'M' END || (pos2 - aend) || 'N' || qlen || 'M'
    ELSE qlen || 'M' || (pos - aend2) || 'N' || CASE WHEN split THEN '10M30N' || (qlen - 10) || 'M' ELSE qlen || 'M' END END END AS cigar
FROM end_pairs""",
)
def _(t):
    return A.combine_ends(*mates(t)).select("sample", "name", "status", "pos", "aend", "qname", G.unparse(F.col("cigar")).alias("cigar"))


@query(
    "A54_total_eligible_reads",
    "SELECT sample, count(*) AS total FROM end_pairs WHERE status IN ('nonunique', 'concordant') GROUP BY sample",
)
def _(t):
    return A.total_eligible(qc.counter(A.combine_ends(*mates(t)), "status"))


@query(
    "J15_combine_antisense_mates",
    """
SELECT sample, status, strand3 AS strand, tlen, count(*) AS n FROM (SELECT sample, status, CASE WHEN status = 'concordant' THEN CASE strand WHEN '-' THEN '+' ELSE '-' END END AS strand3,
   CASE WHEN status = 'concordant' THEN tlen END AS tlen FROM (
  SELECT *, greatest(aend, aend2) - least(pos, pos2) AS tlen, CASE WHEN u1 OR u2 THEN 'unmapped' WHEN size > 1 OR q1 < 40 OR q2 < 40 THEN 'nonunique'
    WHEN seqname <> seqname2 OR strand = f2 OR greatest(aend, aend2) - least(pos, pos2) > 10000 THEN 'discordant'
    WHEN CASE WHEN strand = '-' THEN pos < pos2 ELSE pos2 < pos END THEN 'disoriented' ELSE 'concordant' END AS status
  FROM (SELECT *, CASE strand2 WHEN '+' THEN '-' ELSE '+' END AS f2 FROM mate_groups))) GROUP BY ALL""",
)
def _(t):
    a, b = mates(t)
    flipped = b.withColumn("strand", F.when(F.col("strand") == "+", "-").otherwise("+"))
    return qc.counter(A.combine_antisense_mates(a, flipped), "status", "strand", "tlen")


@query(
    "J16_single_end_groups",
    """
WITH g AS (SELECT sample, qname, CASE WHEN bool_or(is_unmapped) THEN 'unmapped' WHEN count(*) > 1 OR min(mapq) < 40 THEN 'nonunique' ELSE 'unique' END AS status
           FROM alignments GROUP BY ALL)
SELECT a.sample, status, a.qname, a.seqname, a.pos FROM alignments a JOIN g ON g.sample = a.sample AND g.qname = a.qname WHERE status <> 'unmapped'""",
)
def _(t):
    return A.mapped_groups(t.alignments).select("sample", "status", "qname", "seqname", "pos")


@query(
    "J17_tail_filter",
    """
SELECT sample, min_nongenomic, status, count(*) AS n FROM (SELECT sample, qname, min(nongenomic_length) AS min_nongenomic,
  CASE WHEN min(nongenomic_length) = 0 THEN 'entirely_genomic' WHEN count(*) > 1 OR min(mapq) < 40 THEN 'nonunique' ELSE 'unique' END AS status
  FROM mapped GROUP BY ALL) GROUP BY ALL""",
)
def _(t):
    return qc.counter(A.tail_status(t.mapped), "min_nongenomic", "status")


@query(
    "J17_tail_filtered_mappings",
    """
SELECT sample, qname, pos, strand FROM mapped JOIN (SELECT sample, qname FROM mapped GROUP BY ALL
  HAVING min(nongenomic_length) > 0 AND count(*) = 1 AND min(mapq) >= 40) USING (sample, qname)""",
)
def _(t):
    return A.tail_filtered(t.mapped).select("sample", "qname", "pos", "strand")


@query(
    "J18_oligo_hit_lengths",
    """
SELECT sample, oligo, qlen, count(*) AS n FROM rrna r JOIN (SELECT 'o' || s_suppkey AS oligo, CASE WHEN s_suppkey % 2 = 0 THEN 'rRNA_1' ELSE 'rRNA_2' END AS seqname,
   (s_suppkey * 37) % 560 AS o_start, (s_suppkey * 37) % 560 + 29 AS o_end FROM supplier) o
  ON o.seqname = r.seqname AND r.pos < o.o_end AND r.aend > o.o_start WHERE NOT is_secondary GROUP BY ALL""",
)
def _(t):
    oligos = t.table("supplier").select(
        F.concat(F.lit("o"), "s_suppkey").alias("qname"), F.when(F.col("s_suppkey") % 2 == 0, "rRNA_1").otherwise("rRNA_2").alias("seqname"),
        ((F.col("s_suppkey") * 37) % 560).alias("pos"), ((F.col("s_suppkey") * 37) % 560 + 30).alias("aend"),
    )
    return A.oligo_hit_lengths(t.rrna, A.oligo_extents(oligos))


@query(
    "A46_collapse_duplicates",
    """
WITH f AS (SELECT sample, seqname, pos % 600 AS pos, strand, split, qlen, barcode, count(*) AS fragment_count FROM mapped WHERE mapq = 50 GROUP BY ALL),
p AS (SELECT *, CAST(sum(fragment_count) OVER (PARTITION BY sample, seqname, pos, strand, split, qlen) AS BIGINT) AS position_count FROM f)
SELECT sample, position_count, fragment_count, count(*) AS n FROM p GROUP BY ALL""",
)
def _(t):
    folded = t.mapped.withColumn("pos", F.col("pos") % 600)
    return qc.amplification_counts(qc.collapse_duplicates(folded))


@query(
    "A46_collisions",
    """
WITH f AS (SELECT sample, seqname, pos % 2 AS pos, strand, split, qlen, barcode, count(*) AS fragment_count FROM mapped WHERE mapq = 50 GROUP BY ALL),
p AS (SELECT *, CAST(sum(fragment_count) OVER (PARTITION BY sample, seqname, pos, strand, split, qlen) AS BIGINT) AS position_count FROM f)
SELECT sample, seqname, pos, CASE WHEN split THEN '10M30N' || (qlen - 10) || 'M' ELSE qlen || 'M' END AS cigar, strand, position_count, fragment_count, count(*) AS n
FROM p WHERE position_count > 5 GROUP BY ALL""",
)
def _(t):
    folded = t.mapped.withColumn("pos", F.col("pos") % 2).withColumn("cigar", G.unparse(F.col("cigar")))
    return qc.collisions(qc.collapse_duplicates(folded), 5)


@query(
    "A3_mapped_composition",
    """
SELECT sample, qlen AS length, CASE WHEN strand = '-' THEN qlen - 1 - k ELSE k END AS cycle,
   CASE WHEN strand = '-' THEN translate(r, 'ACGT', 'TGCA') ELSE r END AS base, count(*) AS n, count(*) FILTER (nm = 0 AND mapq = 50) AS n_perfect
FROM read_bases WHERE NOT is_unmapped AND NOT is_secondary GROUP BY ALL""",
)
def _(t):
    return qc.mapped_composition(aligned_reads(t))


# ---- annotation tables ----------------------------------------------------------------------

VIEWS.update(
    {
        "old_annotation": """
SELECT gene, seqname, strand, CASE WHEN strand = '+' THEN "start" + 31 ELSE "end" - 29 END AS cds_from,
   CASE WHEN strand = '+' THEN "end" - 29 ELSE "start" + 31 END AS cds_to,
   CASE WHEN gene % 7 = 0 THEN NULL WHEN strand = '+' THEN "start" + 1 ELSE "end" + 1 END AS tx_from,
   CASE WHEN strand = '+' THEN "end" + 1 ELSE "start" + 1 END AS tx_to FROM genes""",
        "chain_blocks": """
SELECT 'v' || c AS chain, seqname, "start" // 600 * 600 AS b_start, "start" // 600 * 600 + 599 - (gene // 5 * 41) % 300 AS b_end, c * 10 AS delta
FROM genes, (VALUES (0), (1)) v(c)""",
        "lifted": """
SELECT a.*, b.chain, a.cds_from - 1 + delta AS cf, a.cds_to - 1 + delta AS ct, a.tx_from - 1 + delta AS tf, a.tx_to - 1 + delta AS tt
FROM old_annotation a JOIN chain_blocks b ON b.seqname = a.seqname AND a.cds_from - 1 BETWEEN b_start AND b_end AND a.cds_to - 1 BETWEEN b_start AND b_end
 AND (a.tx_from IS NULL OR a.tx_from - 1 BETWEEN b_start AND b_end) AND a.tx_to - 1 BETWEEN b_start AND b_end""",
        "lifted_fixed": """
SELECT chain, gene, seqname, strand, CASE WHEN cf > ct THEN cf + 1 ELSE cf END AS cds_from, CASE WHEN cf < ct THEN ct + 1 ELSE ct END AS cds_to,
  tf AS tx_from, tt AS tx_to FROM lifted""",
        "annotation_problems": """
SELECT l.*, least(cds_from, cds_to) AS bound, CASE WHEN g.gene IS NULL THEN 'missing' ELSE 'differs' END AS problem
FROM lifted_fixed l LEFT JOIN (SELECT gene, "start" + 30 AS s, "end" - 30 AS e FROM genes WHERE strand = '+' OR "end" % 4 <> 0) g ON g.gene = l.gene
WHERE g.gene IS NULL OR least(cds_from, cds_to) <> s OR greatest(cds_from, cds_to) - 1 <> e""",
    }
)


def old_annotation(t):
    plus = F.col("strand") == "+"
    pick = lambda a, b: F.when(plus, a).otherwise(b)
    s, e = F.col("start"), F.col("end")
    return t.genes.select(
        "gene", "seqname", "strand", pick(s + 31, e - 29).alias("cds_from"), pick(e - 29, s + 31).alias("cds_to"),
        F.when(F.col("gene") % 7 != 0, pick(s + 1, e + 1)).alias("tx_from"), pick(e + 1, s + 1).alias("tx_to"),
    )


def chain_blocks(t):
    b = F.expr("start div 600") * 600
    return t.genes.select(
        F.explode(F.sequence(F.lit(0), F.lit(1))).alias("c"), "seqname", b.alias("b_start"), (b + 599 - (F.expr("gene div 5") * 41) % 300).alias("b_end")
    ).select(F.concat(F.lit("v"), "c").alias("chain"), "seqname", "b_start", "b_end", (F.col("c") * 10).alias("delta"))


def lifted(t):
    return N.lift(old_annotation(t), chain_blocks(t))


def annotation_problems(t):
    known = t.genes.where("strand = '+' or end % 4 <> 0").select("gene", (F.col("start") + 30).alias("start"), (F.col("end") - 30).alias("end"))
    hi = F.greatest("cds_from", "cds_to") - 1
    return N.disagreeing(lifted(t), known, F.least("cds_from", "cds_to"), hi)


@query("J21_lift_annotation", "SELECT * FROM lifted_fixed")
def _(t):
    return lifted(t)


@query(
    "J22_annotation_problems",
    "SELECT chain, gene, problem, bound FROM annotation_problems",
)
def _(t):
    return annotation_problems(t).select("chain", "gene", "problem", "bound")


@query(
    "J22_first_discrepancy",
    "SELECT seqname, min(bound) AS first_at, count(*) AS n FROM annotation_problems WHERE problem = 'differs' GROUP BY seqname",
)
def _(t):
    return N.first_discrepancy(annotation_problems(t))


@query(
    "J22_discrepancies_by_chain",
    "SELECT chain, seqname, count(*) AS n FROM annotation_problems WHERE problem = 'differs' GROUP BY ALL",
)
def _(t):
    return N.discrepancies_by_chain(annotation_problems(t))


VIEWS["utrs"] = """
SELECT a.gene, a.five_utr, a.three_utr, COALESCE(b.five_utr, 0) AS other_five_utr, COALESCE(b.three_utr, 0) AS other_three_utr
FROM (SELECT gene, CASE WHEN strand = '+' THEN 30 + gene % 50 ELSE 27 END AS five_utr, CASE WHEN strand = '+' THEN 27 ELSE 30 + gene % 50 END AS three_utr FROM genes) a
JOIN (SELECT gene, CASE WHEN gene % 5 > 0 THEN 20 + gene % 11 END AS five_utr, 40 AS three_utr FROM genes WHERE "end" % 3 > 0) b USING (gene)"""


def utr_lengths(t):
    first = t.genes.select(
        "gene", "strand", F.col("start").alias("tx_start"), (F.col("start") + 30 + F.col("gene") % 50).alias("cds_start"),
        (F.col("end") - 27).alias("cds_end"), F.col("end").alias("tx_end"),
    )
    second = t.genes.where("end % 3 > 0").select("gene", F.when(F.col("gene") % 5 > 0, 20 + F.col("gene") % 11).alias("five_utr"), F.lit(40).alias("three_utr"))
    return N.compare_utr_lengths(N.utr_lengths(first), second)


@query("J23_utr_lengths", "SELECT * FROM utrs")
def _(t):
    return utr_lengths(t)


@query("J23_longest_utrs", "SELECT * FROM utrs ORDER BY five_utr DESC, gene LIMIT 20")
def _(t):
    return N.longest_utrs(utr_lengths(t))


@query(
    "J24_starts_in_region",
    """
SELECT f.id, r.gene AS region_id FROM features f JOIN genes r ON r.seqname = f.seqname AND r.strand = f.strand
 AND CASE WHEN f.strand = '-' THEN f."end" ELSE f."start" END BETWEEN r."end" - 100 AND r."end" + 300""",
)
def _(t):
    regions = t.genes.select(F.col("gene").alias("region_id"), "seqname", "strand", (F.col("end") - 100).alias("r_start"), (F.col("end") + 300).alias("r_end"))
    return X.starts_in_region(t.features, regions).select("id", "region_id")


@query(
    "J25_S9_name_lists",
    """
SELECT g.gene, g.seqname FROM genes g WHERE g.gene IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 48)
  AND g.gene NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 2)""",
)
def _(t):
    li = t.table("lineitem")
    whitelist = li.where("l_quantity > 48").select(F.col("l_partkey").alias("gene")).distinct()
    skip = li.where("l_quantity < 2").select(F.col("l_partkey").alias("gene")).distinct()
    return X.whitelisted(t.genes, whitelist).join(skip, "gene", "left_anti").select("gene", "seqname")


@query(
    "O1_feature_order",
    """
SELECT id, row_number() OVER (PARTITION BY seqname ORDER BY "start", "end", feature, strand, id) AS place FROM features""",
)
def _(t):
    from pyspark.sql import Window

    w = Window.partitionBy("seqname").orderBy("start", "end", "feature", "strand", "id")
    return X.feature_order(t.features).select("id", F.row_number().over(w).alias("place"))


@query(
    "O5_name_set_algebra",
    """
(SELECT gene FROM genes WHERE strand = '+' INTERSECT SELECT gene FROM genes WHERE transcript_length > 300)
UNION SELECT gene FROM genes WHERE seqname = 2""",
)
def _(t):
    g = t.genes
    return N.transcript_list(g.where("strand = '+'"), g.where("transcript_length > 300"), g.where("seqname = 2"))


@query(
    "O5_agreed_names",
    """
SELECT gene FROM genes WHERE strand = '+' AND gene IN (SELECT gene FROM genes WHERE transcript_length > 300 EXCEPT SELECT gene FROM genes WHERE seqname = 2)""",
)
def _(t):
    g = t.genes
    return N.agreed_names(g.where("strand = '+'"), g.where("transcript_length > 300"), g.where("seqname = 2"))
