"""Reads, alignments, annotation and counts derived from the given tables, in Spark and in SQL.

Every view covers its whole source table. The SQL text of each view stands beside the Spark form.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window, functions as F

from footprints import constants as C
from footprints.queries.registry import VIEWS, Tables

GENOME_CHUNK = 600
SEQUENCES = 5
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_AS_BASES = "TCAGTCAGTCAGTCAGTCAGTCAGTC"
NON_STOP_TEXT = "".join(C.NON_STOP_CODONS)
ALL_CODONS_TEXT = "".join(C.ALL_CODONS)


MODULUS = 1009


def base_number(p: Column, seqname: Column) -> Column:
    """Number of the base at a position, or at its remainder by the modulus, of a sequence."""
    return ((p * (p * 31 + 2654435) + seqname * 97) % MODULUS % 4).cast("int")


class Inputs(Tables):
    # ---- reads: every document's letters as bases, cut into consecutive fragments -------------
    @cached_property
    def fragments(self) -> DataFrame:
        # The given tables have one row group each; rows are dealt out before the costly expressions.
        docs = self.dealt("documents", ["doc_id", "source", "text"], "doc_id").select(
            "doc_id",
            "source",
            F.translate(F.upper(F.regexp_replace("text", "[^A-Za-z]", "")), _LETTERS, _AS_BASES).alias("base"),
        )
        # One pass over a document. A fragment's row must not carry the whole document, which rows that wait for Python would repeat.
        size = F.lit(8) + F.col("doc_id") % 34
        pieces = F.regexp_extract_all("base", F.concat(F.lit("(.{1,"), size.cast("string"), F.lit("})")), F.lit(1))
        return docs.select("doc_id", "source", F.posexplode(pieces).alias("i", "frag")).select("doc_id", "i", "source", "frag")

    @cached_property
    def reads(self) -> DataFrame:
        kind = (F.col("doc_id") + F.col("i")) % 3
        tail = (
            F.when(kind == 0, F.repeat(F.lit("A"), 50))
            .when(kind == 1, F.concat(F.lit(C.SMRNA_LINKER), F.repeat(F.lit("T"), 40)))
            .otherwise(F.lit(""))
        )
        seq = F.substring(F.concat("frag", tail), 1, 50)
        return self.fragments.select(
            F.col("source").alias("sample"),
            F.concat_ws(":", "doc_id", "i").alias("read_id"),
            seq.alias("seq"),
            F.translate(seq, "TCAG", "I?5F").alias("qual"),
        )

    # ---- alignments: one per line item ---------------------------------------------------------
    @cached_property
    def alignments(self) -> DataFrame:
        qlen = (F.lit(20) + F.col("l_quantity").cast("bigint") % 16).cast("int")
        cents = F.round(F.col("l_discount") * 100).cast("bigint")
        split = F.col("l_linenumber") == 7
        pos = F.expr("(l_partkey div 5) * 600 + (l_suppkey * 7 + l_orderkey) % 600")
        whole = F.array(F.struct(F.lit(0).alias("op"), qlen.alias("len")))
        gapped = F.array(
            F.struct(F.lit(0).alias("op"), F.lit(10).alias("len")),
            F.struct(F.lit(3).alias("op"), F.lit(30).alias("len")),
            F.struct(F.lit(0).alias("op"), (qlen - 10).alias("len")),
        )
        used = ["l_returnflag", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus", "l_quantity", "l_discount", "l_tax", "l_extendedprice"]
        return self.dealt("lineitem", used, "l_orderkey").select(
            F.col("l_returnflag").alias("sample"),
            F.col("l_orderkey").cast("string").alias("qname"),
            (F.col("l_partkey") % SEQUENCES).alias("seqname"),
            pos.alias("pos"),
            (pos + qlen + F.when(split, 30).otherwise(0)).alias("aend"),
            F.when(F.col("l_linestatus") == "O", "+").otherwise("-").alias("strand"),
            F.when(cents == 0, 3).when(cents == 10, 40).otherwise(50).alias("mapq"),
            (F.col("l_linenumber") >= 6).alias("is_secondary"),
            (cents == 5).alias("is_unmapped"),
            qlen.alias("qlen"),
            F.when(split, gapped).otherwise(whole).alias("cigar"),
            F.round(F.col("l_tax") * 100).cast("int").alias("nongenomic_length"),
            (F.round(F.col("l_tax") * 100).cast("int") % 3).alias("nm"),
            F.col("l_linenumber").alias("barcode"),
            F.col("l_extendedprice").alias("_order"),
        )

    @cached_property
    def mapped(self) -> DataFrame:
        return self.alignments.where("not is_unmapped")

    @cached_property
    def rrna(self) -> DataFrame:
        """The mapped reads folded onto two short references that every read competes for."""
        return self.mapped.select(
            "sample", "qname", "qlen", "cigar", "is_secondary",
            F.when(F.col("barcode") <= 4, "rRNA_1").otherwise("rRNA_2").alias("seqname"),
            (F.col("pos") % 600).alias("pos"), (F.col("pos") % 600 + F.col("aend") - F.col("pos")).alias("aend"),
        )

    @cached_property
    def samples(self) -> DataFrame:
        """The catalogue of samples with the totals of their mapped reads."""
        return self.mapped.groupBy("sample").agg(F.count(F.lit(1)).alias("total"))

    # ---- annotation: one gene per part ----------------------------------------------------------
    @cached_property
    def genes(self) -> DataFrame:
        b = F.expr("(p_partkey div 5) * 600")
        return self.table("part").select(
            F.col("p_partkey").alias("gene"),
            (F.col("p_partkey") % SEQUENCES).alias("seqname"),
            F.when(F.col("p_size") % 2 == 0, "+").otherwise("-").alias("strand"),
            (b + 60).alias("start"),
            (b + 329 + 3 * F.col("p_size")).alias("end"),
            F.lit(30).alias("start_codon_t"),
            (F.lit(180) + 3 * F.col("p_size")).alias("stop_codon_t"),
            (F.lit(240) + 3 * F.col("p_size")).alias("transcript_length"),
        )

    @cached_property
    def exons(self) -> DataFrame:
        g = self.genes
        first = g.select("gene", F.col("start").alias("start"), (F.col("start") + 149).alias("end"))
        second = g.select("gene", (F.col("start") + 180).alias("start"), F.col("end").alias("end"))
        return first.unionByName(second)

    @cached_property
    def features(self) -> DataFrame:
        """Genes with mRNA, exon and CDS descendants, one CDS six levels deep; a shifted second set of ncRNA genes gives overlaps."""
        b = F.expr("(p_partkey div 5) * 600")
        part = self.table("part").withColumn("b", b)
        strand = F.when(F.col("p_size") % 2 == 0, "+").otherwise("-")
        gene_id = F.concat(F.lit("g"), F.col("p_partkey"))
        nc_id = F.concat(F.lit("n"), F.col("p_partkey"))
        shift = F.col("b") + (F.col("p_partkey") * 97) % 500
        nc_type = F.element_at(
            F.array(*[F.lit(x) for x in ["rRNA", "tRNA", "snoRNA", "ARS"]]), (F.col("p_partkey") % 4 + 1).cast("int")
        )
        nc_strand = F.element_at(F.array(F.lit("+"), F.lit("-"), F.lit(".")), (F.col("p_size") % 3 + 1).cast("int"))
        status = F.when(F.col("p_size") % 5 == 0, "Dubious").otherwise("Verified")

        def row(feature, ident, parent, start, end, strand_, status_=F.lit(None).cast("string")):
            return F.struct(
                feature.alias("feature"), ident.alias("id"), parent.alias("parent_id"), start.alias("start"),
                end.alias("end"), strand_.alias("strand"), status_.alias("orf_classification"),
            )

        none = F.lit(None).cast("string")
        mrna_id = F.concat(gene_id, F.lit("_mRNA"))
        last = F.col("b") + 329 + 3 * F.col("p_size")
        rows = F.array(
            row(F.lit("gene"), gene_id, none, F.col("b") + 60, last, strand, status),
            row(F.lit("mRNA"), mrna_id, gene_id, F.col("b") + 60, last, strand),
            row(F.lit("exon"), F.concat(gene_id, F.lit("_e1")), mrna_id, F.col("b") + 60, F.col("b") + 209, strand),
            row(F.lit("exon"), F.concat(gene_id, F.lit("_e2")), mrna_id, F.col("b") + 240, last, strand),
            row(F.lit("CDS"), F.concat(gene_id, F.lit("_c1")), mrna_id, F.col("b") + 90, F.col("b") + 209, strand),
            row(F.lit("segment"), F.concat(gene_id, F.lit("_s1")), mrna_id, F.col("b") + 240, last - 50, strand),
            row(F.lit("segment"), F.concat(gene_id, F.lit("_s2")), F.concat(gene_id, F.lit("_s1")), F.col("b") + 240, last - 52, strand),
            row(F.lit("segment"), F.concat(gene_id, F.lit("_s3")), F.concat(gene_id, F.lit("_s2")), F.col("b") + 240, last - 54, strand),
            row(F.lit("CDS"), F.concat(gene_id, F.lit("_c2")), F.concat(gene_id, F.lit("_s3")), F.col("b") + 240, last - 57, strand),
            row(nc_type, nc_id, none, shift, shift + 40 + F.col("p_size"), nc_strand),
            row(F.lit("noncoding_exon"), F.concat(nc_id, F.lit("_e1")), nc_id, shift, shift + 40 + F.col("p_size"), nc_strand),
        )
        return part.select((F.col("p_partkey") % SEQUENCES).alias("seqname"), F.explode(rows).alias("r")).select("seqname", "r.*")

    @cached_property
    def genome(self) -> DataFrame:
        """One chunk of the sequence per part; the base at a position follows from the position."""
        chunk = F.expr("p_partkey div 5")
        # Only the remainder of a position counts, which the square of a far position would run over.
        first = chunk * GENOME_CHUNK % MODULUS
        number = lambda x: base_number(x, F.col("p_partkey") % SEQUENCES)
        bases = F.array(*[F.lit(b) for b in C.BASES])
        seq = F.array_join(F.transform(F.sequence(first, first + GENOME_CHUNK - 1), lambda x: F.get(bases, number(x))), "")
        # Few bytes a row become hundreds, so the number of tasks is given.
        tasks = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        dealt = self.table("part").select("p_partkey").repartition(tasks, "p_partkey")
        return dealt.select((F.col("p_partkey") % SEQUENCES).alias("seqname"), chunk.alias("chunk"), F.coalesce(seq, F.lit("")).alias("seq"))

    # ---- dense counts per codon and per position, from events ------------------------------------
    @cached_property
    def numbered_events(self) -> DataFrame:
        w = Window.partitionBy("user_id").orderBy("event_id")
        n = F.count(F.lit(1)).over(Window.partitionBy("user_id"))
        return self.table("events").select(
            F.col("user_id").alias("gene"),
            (F.row_number().over(w) - 1).alias("rn"),
            n.alias("n_rows"),
            F.floor("value").cast("bigint").alias("v"),
            "event_type",
            "event_id",
        )

    @cached_property
    def long_genes(self) -> DataFrame:
        """The same with the events of sixteen users in a row as one gene."""
        gene = F.expr("user_id div 16")
        w = Window.partitionBy(gene).orderBy("event_id")
        n = F.count(F.lit(1)).over(Window.partitionBy(gene))
        return self.table("events").select(
            gene.alias("gene"), (F.row_number().over(w) - 1).alias("rn"), n.alias("n_rows"), F.floor("value").cast("bigint").alias("v"), "event_type", "event_id"
        )

    @cached_property
    def codon_counts(self) -> DataFrame:
        """Three samples; five buffer codons before the start and after the stop codon of every gene, about a thousand between."""
        x = (F.col("gene") * 31 + F.col("rn") * 17) % 61
        base = self.long_genes.select(
            "gene",
            (F.col("rn") - 5).alias("codon_idx"),
            (F.col("n_rows") - 10).cast("int").alias("num_codons"),
            F.substr(F.lit(NON_STOP_TEXT), (x * 3 + 1).cast("int"), F.lit(3)).alias("codon"),
            "v",
            "rn",
            F.explode(F.sequence(F.lit(0), F.lit(2))).alias("s"),
        )
        relaxed = F.expr("(v * (s + 2) + (rn * 13 + s * 5) % 7) div 2")
        return base.select(
            F.concat(F.lit("S"), F.col("s")).alias("sample"), "gene", "codon_idx", "num_codons", "codon",
            relaxed.alias("relaxed"), F.floor(relaxed / 2).alias("stringent"), F.floor(relaxed / 3).alias("anisomycin"),
        )

    @cached_property
    def positions(self) -> DataFrame:
        """Dense long position table of unsplit genes: (sample, gene, pos, n)."""
        return self.numbered_events.select(
            F.explode(F.array(F.lit("x"), F.lit("y"))).alias("sample"), "gene", "rn", "v"
        ).select(
            "sample", "gene", F.col("rn").alias("pos"),
            F.when(F.col("sample") == "x", F.col("v")).otherwise((F.col("v") * 3 + F.col("rn")) % 50).alias("n"),
        )

    @cached_property
    def trna(self) -> DataFrame:
        """Weight per codon, scaled by how often the codon labels an event."""
        c = self.codon_counts.where("sample = 'S0'").groupBy("codon").agg(F.count(F.lit(1)).alias("n"))
        return c.select("codon", F.round(F.lit(1.0) / (1 + (F.col("n") * 7 + F.ascii("codon")) % 13), 9).alias("weight"))


_B = "(p_partkey // 5) * 600"
VIEWS.update(
    {
        "fragments": f"""
SELECT doc_id, i, source, substr(base, CAST(i * size + 1 AS BIGINT), size) AS frag
FROM (SELECT doc_id, source, base, size, unnest(range(0, CAST(ceil(length(base) / size) AS BIGINT))) AS i
      FROM (SELECT doc_id, source, 8 + doc_id % 34 AS size,
                   translate(upper(regexp_replace(text, '[^A-Za-z]', '', 'g')), '{_LETTERS}', '{_AS_BASES}') AS base
            FROM documents)
      WHERE length(base) > 0)""",
        "reads": f"""
SELECT source AS sample, doc_id || ':' || i AS read_id, seq, translate(seq, 'TCAG', 'I?5F') AS qual
FROM (SELECT doc_id, i, source, substr(frag || CASE (doc_id + i) % 3 WHEN 0 THEN repeat('A', 50)
             WHEN 1 THEN '{C.SMRNA_LINKER}' || repeat('T', 40) ELSE '' END, 1, 50) AS seq FROM fragments)""",
        "alignments": """
SELECT sample, qname, seqname, pos, pos + qlen + CASE WHEN split THEN 30 ELSE 0 END AS aend, strand, mapq,
       is_secondary, is_unmapped, qlen, split, nongenomic_length, nongenomic_length % 3 AS nm, barcode, price
FROM (SELECT l_returnflag AS sample, CAST(l_orderkey AS VARCHAR) AS qname, l_partkey % 5 AS seqname,
             (l_partkey // 5) * 600 + (l_suppkey * 7 + l_orderkey) % 600 AS pos,
             CASE WHEN l_linestatus = 'O' THEN '+' ELSE '-' END AS strand,
             CASE CAST(round(l_discount * 100) AS BIGINT) WHEN 0 THEN 3 WHEN 10 THEN 40 ELSE 50 END AS mapq,
             l_linenumber >= 6 AS is_secondary, CAST(round(l_discount * 100) AS BIGINT) = 5 AS is_unmapped,
             CAST(20 + CAST(l_quantity AS BIGINT) % 16 AS INTEGER) AS qlen, l_linenumber = 7 AS split,
             CAST(round(l_tax * 100) AS INTEGER) AS nongenomic_length, l_linenumber AS barcode,
             l_extendedprice AS price
      FROM lineitem)""",
        "mapped": "SELECT * FROM alignments WHERE NOT is_unmapped",
        "genes": f"""
SELECT p_partkey AS gene, p_partkey % 5 AS seqname, CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
       {_B} + 60 AS "start", {_B} + 329 + 3 * p_size AS "end", 30 AS start_codon_t,
       180 + 3 * p_size AS stop_codon_t, 240 + 3 * p_size AS transcript_length
FROM part""",
        "exons": """
SELECT gene, "start", "start" + 149 AS "end" FROM genes
UNION ALL SELECT gene, "start" + 180, "end" FROM genes""",
        "features": f"""
SELECT seqname, r.feature AS feature, r.id AS id, r.parent_id AS parent_id, r.s AS "start", r.e AS "end",
       r.strand AS strand, r.cls AS orf_classification
FROM (SELECT seqname, unnest([
  {{'feature': 'gene', 'id': gid, 'parent_id': NULL, 's': b + 60, 'e': last, 'strand': strand, 'cls': cls}},
  {{'feature': 'mRNA', 'id': gid || '_mRNA', 'parent_id': gid, 's': b + 60, 'e': last, 'strand': strand, 'cls': NULL}},
  {{'feature': 'exon', 'id': gid || '_e1', 'parent_id': gid || '_mRNA', 's': b + 60, 'e': b + 209, 'strand': strand, 'cls': NULL}},
  {{'feature': 'exon', 'id': gid || '_e2', 'parent_id': gid || '_mRNA', 's': b + 240, 'e': last, 'strand': strand, 'cls': NULL}},
  {{'feature': 'CDS', 'id': gid || '_c1', 'parent_id': gid || '_mRNA', 's': b + 90, 'e': b + 209, 'strand': strand, 'cls': NULL}},
  {{'feature': 'segment', 'id': gid || '_s1', 'parent_id': gid || '_mRNA', 's': b + 240, 'e': last - 50, 'strand': strand, 'cls': NULL}},
  {{'feature': 'segment', 'id': gid || '_s2', 'parent_id': gid || '_s1', 's': b + 240, 'e': last - 52, 'strand': strand, 'cls': NULL}},
  {{'feature': 'segment', 'id': gid || '_s3', 'parent_id': gid || '_s2', 's': b + 240, 'e': last - 54, 'strand': strand, 'cls': NULL}},
  {{'feature': 'CDS', 'id': gid || '_c2', 'parent_id': gid || '_s3', 's': b + 240, 'e': last - 57, 'strand': strand, 'cls': NULL}},
  {{'feature': nct, 'id': nid, 'parent_id': NULL, 's': sh, 'e': she, 'strand': ncs, 'cls': NULL}},
  {{'feature': 'noncoding_exon', 'id': nid || '_e1', 'parent_id': nid, 's': sh, 'e': she, 'strand': ncs, 'cls': NULL}}]) AS r
FROM (SELECT p_partkey % 5 AS seqname, {_B} AS b, {_B} + 329 + 3 * p_size AS last,
             'g' || p_partkey AS gid, 'n' || p_partkey AS nid,
             CASE WHEN p_size % 2 = 0 THEN '+' ELSE '-' END AS strand,
             CASE WHEN p_size % 5 = 0 THEN 'Dubious' ELSE 'Verified' END AS cls,
             ['rRNA', 'tRNA', 'snoRNA', 'ARS'][p_partkey % 4 + 1] AS nct, ['+', '-', '.'][p_size % 3 + 1] AS ncs,
             {_B} + (p_partkey * 97) % 500 AS sh, {_B} + (p_partkey * 97) % 500 + 40 + p_size AS she
      FROM part))""",
        "genome_bases": """
SELECT seqname, p, substr('TCAG', CAST(1 + ((p * p * 31 + p * 2654435 + seqname * 97) % 1009) % 4 AS BIGINT), 1) AS base
FROM (SELECT p_partkey % 5 AS seqname, (p_partkey // 5) * 600 + unnest(range(0, 600)) AS p FROM part)""",
        "numbered_events": """
SELECT user_id AS gene, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS rn,
       count(*) OVER (PARTITION BY user_id) AS n_rows, CAST(floor(value) AS BIGINT) AS v, event_type, event_id
FROM events""",
        "long_genes": """
SELECT user_id // 16 AS gene, row_number() OVER (PARTITION BY user_id // 16 ORDER BY event_id) - 1 AS rn,
       count(*) OVER (PARTITION BY user_id // 16) AS n_rows, CAST(floor(value) AS BIGINT) AS v, event_type, event_id
FROM events""",
        "codon_counts": f"""
SELECT sample, gene, codon_idx, num_codons, codon, relaxed, relaxed // 2 AS stringent, relaxed // 3 AS anisomycin
FROM (SELECT 'S' || s AS sample, gene, rn - 5 AS codon_idx, CAST(n_rows - 10 AS INTEGER) AS num_codons,
             substr('{NON_STOP_TEXT}', CAST(((gene * 31 + rn * 17) % 61) * 3 + 1 AS BIGINT), 3) AS codon,
             (v * (s + 2) + (rn * 13 + s * 5) % 7) // 2 AS relaxed
      FROM long_genes, range(0, 3) t(s))""",
        "positions": """
SELECT sample, gene, rn AS pos, CASE WHEN sample = 'x' THEN v ELSE (v * 3 + rn) % 50 END AS n
FROM numbered_events, (VALUES ('x'), ('y')) t(sample)""",
        "trna": """
SELECT codon, round(1.0 / (1 + (n * 7 + ascii(codon)) % 13), 9) AS weight
FROM (SELECT codon, count(*) AS n FROM codon_counts WHERE sample = 'S0' GROUP BY codon)""",
    }
)
