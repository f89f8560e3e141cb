"""Filtering, combining and rewriting alignments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from footprints import constants as C
from footprints.functions import cigar as G, sequence as S, stats
from footprints.operators import coords, counts, intervals


# ---- groups of one read name ------------------------------------------------------------------


def group_status(alignments: DataFrame, name: str = "qname") -> DataFrame:
    """One row per read name: size, any_unmapped, min_mapq, min_nongenomic. Combined map-side."""
    return alignments.groupBy("sample", name).agg(
        F.count(F.lit(1)).alias("size"),
        F.bool_or("is_unmapped").alias("any_unmapped"),
        F.min("mapq").alias("min_mapq"),
        F.min("nongenomic_length").alias("min_nongenomic"),
    )


def nonunique(size: Column, min_mapq: Column) -> Column:
    return (size > 1) | (min_mapq < C.NONUNIQUE_BELOW_MAPQ)


def single_end_status(alignments: DataFrame) -> DataFrame:
    """(sample, qname, status): unmapped, nonunique or unique."""
    g = group_status(alignments)
    status = F.when(F.col("any_unmapped"), "unmapped").when(nonunique(F.col("size"), F.col("min_mapq")), "nonunique").otherwise("unique")
    return g.select("sample", "qname", status.alias("status"))


def mapped_groups(alignments: DataFrame) -> DataFrame:
    """All mappings of the groups without an unmapped record, with their group's status."""
    return alignments.join(single_end_status(alignments).where("status <> 'unmapped'"), ["sample", "qname"])


def tail_status(alignments: DataFrame) -> DataFrame:
    """(sample, qname, min_nongenomic, status) by the smallest nongenomic length of the group:
    entirely_genomic, nonunique or unique."""
    g = group_status(alignments)
    status = (
        F.when(F.col("min_nongenomic") == 0, "entirely_genomic")
        .when(nonunique(F.col("size"), F.col("min_mapq")), "nonunique")
        .otherwise("unique")
    )
    return g.select("sample", "qname", "min_nongenomic", status.alias("status"))


def tail_filtered(alignments: DataFrame) -> DataFrame:
    return alignments.join(tail_status(alignments).where("status = 'unique'"), ["sample", "qname"], "left_semi")


# ---- mates -----------------------------------------------------------------------------------


def _mate(alignments: DataFrame, tag: str) -> DataFrame:
    """One row per read name of one mate; the mapping itself where there is only one."""
    one = F.struct("seqname", "pos", "aend", "strand", "mapq", "cigar", "seq", "qual", "qname")
    return alignments.groupBy("sample", "name").agg(
        F.count(F.lit(1)).alias(f"{tag}_size"),
        F.bool_or("is_unmapped").alias(f"{tag}_unmapped"),
        F.min("mapq").alias(f"{tag}_mapq"),
        F.max(one).alias(tag),
    )


def _pairs(first: DataFrame, second: DataFrame, same_strand_is_concordant: bool) -> DataFrame:
    j = _mate(first, "a").join(_mate(second, "b"), ["sample", "name"])
    tlen = F.greatest("a.aend", "b.aend") - F.least("a.pos", "b.pos")
    wrong_strand = (F.col("a.strand") != F.col("b.strand")) if same_strand_is_concordant else (F.col("a.strand") == F.col("b.strand"))
    discordant = (F.col("a.seqname") != F.col("b.seqname")) | wrong_strand | (tlen > C.MAX_TEMPLATE_LENGTH)
    unmapped = F.col("a_unmapped") | F.col("b_unmapped")
    many = nonunique(F.col("a_size"), F.col("a_mapq")) | nonunique(F.col("b_size"), F.col("b_mapq"))
    return j.withColumn("tlen", tlen).withColumn(
        "status", F.when(unmapped, "unmapped").when(many, "nonunique").when(discordant, "discordant")
    )


def combine_ends(five: DataFrame, three: DataFrame) -> DataFrame:
    """5' and 3' mates of a fragment joined by ``name``.

    ``status`` is unmapped, nonunique, discordant (other sequence or strand, template too long, overlapping ends) or
    concordant; concordant pairs carry the joined alignment with the gap between the ends as a skip.
    """
    p = _pairs(five, three, same_strand_is_concordant=True)
    plus = F.col("a.strand") == "+"
    pick = lambda c: (F.when(plus, F.col(f"a.{c}")).otherwise(F.col(f"b.{c}")), F.when(plus, F.col(f"b.{c}")).otherwise(F.col(f"a.{c}")))
    (pos, pos2), (aend, aend2), (cig, cig2), (seq, seq2), (qual, qual2) = (pick(c) for c in ("pos", "aend", "cigar", "seq", "qual"))
    gap = pos2 - aend
    status = F.coalesce("status", F.when(gap < 0, "discordant").otherwise("concordant"))
    skip = F.array(F.struct(F.lit(G.SKIP).alias("op"), gap.cast("int").alias("len")))
    ok = F.col("status") == "concordant"
    joined = p.withColumn("gap", gap).withColumn("status", status)
    return joined.select(
        "sample", "name", "status", "a_unmapped", "b_unmapped",
        F.when(ok, F.col("b.qname")).alias("qname"),
        F.when(ok, F.col("a.seqname")).alias("seqname"),
        F.when(ok, pos).alias("pos"),
        F.when(ok, aend2).alias("aend"),
        F.when(ok, F.col("a.strand")).alias("strand"),
        F.when(ok, F.least("a.mapq", "b.mapq")).alias("mapq"),
        F.when(ok, F.concat(cig, skip, cig2)).alias("cigar"),
        F.when(ok, F.concat(seq, seq2)).alias("seq"),
        F.when(ok, F.concat(qual, qual2)).alias("qual"),
    )


def combine_antisense_mates(r1: DataFrame, r2: DataFrame) -> DataFrame:
    """R1 and R2 of an antisense protocol joined by ``name``.

    ``status`` adds disoriented (the mates point away from each other). The concordant span runs from the smaller start
    to the larger end, on the strand opposite to R1.
    """
    p = _pairs(r1, r2, same_strand_is_concordant=False)
    away = F.when(F.col("a.strand") == "-", F.col("a.pos") < F.col("b.pos")).otherwise(F.col("b.pos") < F.col("a.pos"))
    joined = p.withColumn("status", F.coalesce("status", F.when(away, "disoriented").otherwise("concordant")))
    ok = F.col("status") == "concordant"
    return joined.select(
        "sample", "name", "status", "a_unmapped", "b_unmapped",
        F.when(ok, F.col("a.seqname")).alias("seqname"),
        F.when(ok, F.least("a.pos", "b.pos")).alias("pos"),
        F.when(ok, F.greatest("a.aend", "b.aend")).alias("aend"),
        F.when(ok, F.when(F.col("a.strand") == "-", "+").otherwise("-")).alias("strand"),
        F.when(ok, F.least("a.mapq", "b.mapq")).alias("mapq"),
        F.when(ok, F.lit(0)).alias("nongenomic_length"),
        F.when(F.col("status") == "concordant", F.col("tlen")).alias("tlen"),
    )


def total_eligible(status_counts: DataFrame) -> DataFrame:
    """(sample, total): nonunique plus concordant or unique ones."""
    return status_counts.where(F.col("status").isin("nonunique", "concordant", "unique")).groupBy("sample").agg(F.sum("n").alias("total"))


# ---- contaminants ----------------------------------------------------------------------------


def contaminant_hits(alignments: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Mappings with at least one base in a noncoding transcript, once per transcript hit.

    ``transcripts``: gene, class, class_rank, seqname, start, end, exons. Exactly one hit of a read is primary: the first
    by class precedence, then by transcript and mapping position.
    """
    spans = transcripts.select(
        "gene", "class", "class_rank", "seqname", F.col("start").alias("t_start"), F.col("end").alias("t_end"), "exons"
    )
    reads = alignments.withColumn("_last", F.col("aend") - 1)
    pairs = intervals.overlap_join(reads, spans, ["seqname"], ("pos", "_last"), ("t_start", "t_end"))
    blocks = G.aligned_blocks(F.col("pos"), F.col("cigar"))
    # The spans overlap; one base decides for mappings without a gap and transcripts of one exon.
    touches = ((F.size("cigar") == 1) & (F.size("exons") == 1)) | F.exists(blocks, lambda b: F.exists(F.col("exons"), lambda e: (b["start"] <= e["end"]) & (e["start"] < b["end"])))
    hits = pairs.where(touches).drop("_last", "exons", "is_secondary")
    order = [F.col(c) for c in ("class_rank", "seqname", "t_start", "t_end", "gene", "pos", "aend", "strand", "mapq", "barcode")]
    return stats.first_of_group(hits, ["sample", "qname"], order, "is_primary")


def clean_alignments(alignments: DataFrame, hits: DataFrame) -> DataFrame:
    """Mappings of reads without any contaminant hit."""
    return alignments.join(hits.select("sample", "qname").distinct(), ["sample", "qname"], "left_anti")


def drop_hit_reads(reads: DataFrame, hits: DataFrame, name: str) -> DataFrame:
    """Reads (or pairs) whose name is not in the hit table of an aligner run against a contaminant index."""
    return reads.join(hits.select("sample", name).distinct(), ["sample", name], "left_anti")


def hit_lengths(reads: DataFrame, hits: DataFrame, name: str, length: Column, category: str) -> DataFrame:
    removed = reads.join(hits.select("sample", name).distinct(), ["sample", name], "left_semi")
    return removed.groupBy("sample", F.lit(category).alias("category"), length.alias("length")).agg(F.count(F.lit(1)).alias("n"))


def oligo_extents(oligo_alignments: DataFrame) -> DataFrame:
    """(oligo, seqname, o_start, o_end): first and last aligned base of every oligo mapping."""
    return oligo_alignments.select(F.col("qname").alias("oligo"), "seqname", F.col("pos").alias("o_start"), (F.col("aend") - 1).alias("o_end"))


def oligo_hit_lengths(alignments: DataFrame, extents: DataFrame) -> DataFrame:
    """(sample, oligo, qlen, n): primary mappings that meet the half-open window [o_start, o_end) of an oligo."""
    shapes = alignments.where("not is_secondary").groupBy("sample", "seqname", "qlen", "pos", (F.col("aend") - 1).alias("_last")).agg(
        F.count(F.lit(1)).alias("n")
    )
    spans = extents.withColumn("_o_last", F.col("o_end") - 1).where("_o_last >= o_start")
    pairs = intervals.overlap_join(shapes, spans, ["seqname"], ("pos", "_last"), ("o_start", "_o_last"))
    return pairs.groupBy("sample", "oligo", "qlen").agg(F.sum("n").alias("n"))


# ---- comparison with the genome ----------------------------------------------------------------


def with_reference(alignments: DataFrame, genome: DataFrame, chunk_width: int, longest: int | None = None) -> DataFrame:
    """Adds ``ref``, the genome's bases under the aligned read bases, by one join with the chunk of the first one.

    ``longest`` is the largest span of an alignment on the genome, which the aligner's largest intron bounds; a chunk's width
    by default. A longer one is an error.
    """
    blocks = F.transform(G.aligned_blocks(F.col("pos"), F.col("cigar")), lambda b: F.struct(b["start"].alias("a"), (b["end"] - 1).alias("b")))
    return coords.bases_at(alignments, genome, chunk_width, blocks, "ref", longest)


def has_indel(cigar: Column) -> Column:
    return F.exists(cigar, lambda c: c["op"].isin(G.INDELS))


def _oriented(values: Column) -> Column:
    """An array over read bases, in sequencing direction."""
    return F.when(F.col("strand") == "-", F.reverse(values)).otherwise(values)


def _quality_array(qual: Column) -> Column:
    return F.transform(S.bases_of(qual), lambda q: F.ascii(q) - 33)


def _leading_mismatches() -> Column:
    """Number of mismatches of quality 30 or more at the read's 5' end."""
    pairs = F.zip_with(S.bases_of(F.col("seq")), S.bases_of(F.col("ref")), lambda r, g: r != g)
    bad = F.zip_with(pairs, _quality_array(F.col("qual")), lambda m, q: m & (q >= 30))
    run = F.array_position(_oriented(bad), F.lit(False)) - 1
    return F.when(run < 0, F.raise_error(F.lit("every base of the read is a mismatch")).cast("int")).otherwise(run.cast("int"))


def _position_of(index: Column) -> Column:
    """Reference position of an aligned read base."""
    spread = F.flatten(F.transform(G.aligned_blocks(F.col("pos"), F.col("cigar")), lambda b: F.sequence(b["start"], b["end"] - 1)))
    return F.get(spread, index)


def trim_leading_mismatches(referenced: DataFrame) -> DataFrame:
    """Drops untemplated bases: the run of good mismatches at the 5' end. Input from ``with_reference``.

    Alignments with an indel and unmapped ones stay whole. Adds ``trimmed``, the number of bases dropped.
    """
    skip = has_indel(F.col("cigar")) | F.col("is_unmapped")
    cut = referenced.withColumn("trimmed", F.when(skip, F.lit(0)).otherwise(_leading_mismatches()))
    k, n, plus = F.col("trimmed"), F.length("seq"), F.col("strand") == "+"
    first = F.when(plus, k).otherwise(F.lit(0))
    last = F.when(plus, n).otherwise(n - k)
    keep = lambda c: F.substr(F.col(c), first + 1, last - first)
    new = {
        "pos": F.when(plus & (k > 0), _position_of(k)).otherwise(F.col("pos")),
        "cigar": F.when(k > 0, G.keep_read_bases(F.col("cigar"), first, last)).otherwise(F.col("cigar")),
        "seq": keep("seq"),
        "qual": keep("qual"),
        "ref": keep("ref"),
    }
    moved = cut.select(*[c for c in cut.columns if c not in (*new, "aend")], *[v.alias(c) for c, v in new.items()])
    return moved.withColumn("aend", G.reference_end(F.col("pos"), F.col("cigar"))).withColumn("qlen", F.length("seq"))


def mismatch_counts(referenced: DataFrame) -> DataFrame:
    """(sample, is_secondary, length, position, quality, ref_base, read_base, n) over all aligned bases of mapped reads
    without indels, in sequencing direction and with the bases of the sequenced strand."""
    used = referenced.where(~F.col("is_unmapped") & ~has_indel(F.col("cigar")))
    strand_base = lambda c: F.when(F.col("strand") == "-", S.reverse_complement(F.col(c))).otherwise(F.col(c))
    turned = used.select(
        "sample", "is_secondary", strand_base("seq").alias("r"), strand_base("ref").alias("g"),
        F.when(F.col("strand") == "-", F.reverse("qual")).otherwise(F.col("qual")).alias("q"),
    )
    each = turned.select(
        "sample", "is_secondary", F.length("r").alias("length"),
        F.posexplode(F.arrays_zip(S.bases_of(F.col("r")).alias("r"), S.bases_of(F.col("g")).alias("g"), S.bases_of(F.col("q")).alias("q"))).alias("position", "x"),
    )
    return (
        each.groupBy("sample", "is_secondary", "length", "position", F.col("x.q").alias("q"), F.col("x.g").alias("ref_base"), F.col("x.r").alias("read_base"))
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("quality", F.ascii("q") - 33)
        .drop("q")
    )


def clip_nongenomic_tail(referenced: DataFrame) -> DataFrame:
    """Soft-clips from the first base of a closing poly-A run that the genome does not have. Input from
    ``with_reference``; alignments with indels and unmapped ones stay as they are."""
    plus = F.col("strand") == "+"
    n = F.length("seq")
    tail_start = S.poly_a_start(F.col("seq"))
    matching = S.opening_run(F.substr(F.col("ref"), tail_start + 1, n), "A")
    from_end = n - tail_start - matching
    head = F.substr(F.col("ref"), F.lit(1), S.poly_t_end(F.col("seq")) + 1)
    from_start = F.length(F.rtrim(head, F.lit("T")))
    skip = has_indel(F.col("cigar")) | F.col("is_unmapped")
    cut = referenced.withColumn("clipped", F.when(skip, 0).when(plus, from_end).otherwise(from_start).cast("int"))
    k = F.col("clipped")
    block = F.array(F.struct(F.lit(G.SOFT_CLIP).alias("op"), k.alias("len")))
    kept = G.keep_read_bases(F.col("cigar"), F.when(plus, F.lit(0)).otherwise(k), F.when(plus, n - k).otherwise(n))
    cigar = F.when(k == 0, F.col("cigar")).when(plus, F.concat(kept, block)).otherwise(F.concat(block, kept))
    pos = F.when((k > 0) & ~plus, _position_of(k)).otherwise(F.col("pos"))
    nongenomic = F.when(skip, F.col("nongenomic_length")).otherwise(k)
    moved = cut.select(
        *[c for c in cut.columns if c not in ("pos", "cigar", "aend", "nongenomic_length")],
        pos.alias("pos"), cigar.alias("cigar"), nongenomic.alias("nongenomic_length"),
    )
    return moved.withColumn("aend", G.reference_end(F.col("pos"), F.col("cigar")))


def extend_tails(alignments: DataFrame, genome: DataFrame, chunk_width: int) -> DataFrame:
    """Extends the 3' end over the genome's A's behind it, as far as the trimmed-off tail reaches; soft-clips the rest.

    Needs ``tail_seq`` and ``tail_qual``, what trimming cut off behind the read. Sets ``nongenomic_length``.
    """
    plus = F.col("strand") == "+"
    size = F.length("tail_seq")
    a, b = F.when(plus, F.col("aend")).otherwise(F.col("pos") - size), F.when(plus, F.col("aend") + size - 1).otherwise(F.col("pos") - 1)
    behind = F.when((b >= a) & ~F.col("is_unmapped"), F.array(F.struct(a.alias("a"), b.alias("b"))))
    joined = coords.bases_at(alignments, genome, chunk_width, behind, "_after")
    # Off the sequence there are no bases to match.
    after = F.when(plus, F.col("_after")).otherwise(S.reverse_complement(F.col("_after")))
    extra = F.coalesce(S.opening_run(after, "A"), F.lit(0))
    e = joined.withColumn("extended", extra.cast("int"))
    k, rest, mapped = F.col("extended"), (size - F.col("extended")).cast("int"), ~F.col("is_unmapped")
    clip = F.array(F.struct(F.lit(G.SOFT_CLIP).alias("op"), rest.alias("len")))
    nothing = F.array().cast("array<struct<op:int,len:int>>")
    edge = F.when(plus, F.element_at("cigar", -1)).otherwise(F.element_at("cigar", 1))
    grown = F.when(edge["op"] != 0, F.raise_error(F.lit("the alignment does not end in a match")).cast("struct<op:int,len:int>")).otherwise(
        F.struct(edge["op"].alias("op"), (edge["len"] + k).cast("int").alias("len"))
    )
    others = F.when(plus, F.slice("cigar", F.lit(1), F.size("cigar") - 1)).otherwise(F.slice("cigar", F.lit(2), F.size("cigar")))
    cigar = F.when(plus, F.concat(others, F.array(grown), F.when(rest > 0, clip).otherwise(nothing))).otherwise(
        F.concat(F.when(rest > 0, clip).otherwise(nothing), F.array(grown), others)
    )
    new = {
        "pos": F.when(mapped & ~plus, F.col("pos") - k).otherwise(F.col("pos")),
        "aend": F.when(mapped & plus, F.col("aend") + k).otherwise(F.col("aend")),
        "cigar": F.when(mapped, cigar).otherwise(F.col("cigar")),
        "seq": F.when(~mapped, F.col("seq")).when(plus, F.concat("seq", "tail_seq")).otherwise(F.concat(S.reverse_complement(F.col("tail_seq")), "seq")),
        "qual": F.when(~mapped, F.col("qual")).when(plus, F.concat("qual", "tail_qual")).otherwise(F.concat(F.reverse("tail_qual"), "qual")),
        "nongenomic_length": F.when(mapped, rest).otherwise(F.col("nongenomic_length")),
    }
    return e.select(*[c for c in alignments.columns if c not in new], "extended", *[v.alias(c) for c, v in new.items()])


def unambiguous_ends(alignments: DataFrame, genome: DataFrame, lengths: DataFrame, chunk_width: int) -> DataFrame:
    """Mappings whose last aligned base and the base behind it are both not A in reading direction."""
    plus = F.col("strand") == "+"
    a, b = F.when(plus, F.col("aend") - 1).otherwise(F.col("pos") - 1), F.when(plus, F.col("aend")).otherwise(F.col("pos"))
    # One row per sequence.
    inside = alignments.join(lengths, "seqname").where((a >= 0) & (b < F.col("length")))
    placed = coords.bases_at(inside, genome, chunk_width, F.array(F.struct(a.alias("a"), b.alias("b"))), "_two")
    other = F.when(plus, "A").otherwise("T")
    return placed.where(~F.upper("_two").contains(other)).select(*alignments.columns)


def position_ambiguity(sequences: DataFrame, lengths: list[int]) -> DataFrame:
    """(gene, length, start, code) for fragments on a gene's buffered sequence: 0 ends in A, 1 is followed by A, 2 neither."""
    longest = F.length("sequence")
    pairs = sequences.select("gene", longest.alias("size"), F.posexplode(S.windows_of(F.upper("sequence"), 2)).alias("last", "two"))
    code = F.when(F.col("two").startswith("A"), 0).when(F.col("two").endswith("A"), 1).otherwise(2)
    rows = pairs.select("gene", "size", "last", code.alias("code"), F.explode(F.array(*[F.lit(n) for n in lengths])).alias("length"))
    start = F.col("last") - F.col("length") + 1
    return rows.select("gene", "length", start.alias("start"), "code").where("start >= 0")
