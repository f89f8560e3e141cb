"""Annotation: feature families, transcripts, neighbours, exon synthesis and UTR extension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footprints import constants as C
from footprints.functions import stats
from footprints.operators import intervals
from footprints.session import cut_lineage, not_collected


def descendants(features: DataFrame) -> DataFrame:
    """(top_id, id, depth): every feature below each feature that has an id, however deep.

    One join per level of the deepest family, each level written to the shared folder. A family that leads back to itself is an
    error.
    """
    edges = cut_lineage(features.where("parent_id is not null and id is not null").select("parent_id", "id").distinct())
    most = edges.select("id").distinct().count()
    step = edges.select(F.col("parent_id").alias("id"), F.col("id").alias("child"))
    level = edges.select(F.col("parent_id").alias("top_id"), "id", F.lit(1).alias("depth"))
    closure, depth = level, 1
    while True:
        depth += 1
        level = cut_lineage(level.join(not_collected(step), "id").select("top_id", F.col("child").alias("id"), F.lit(depth).alias("depth")).distinct())
        if level.isEmpty():
            break
        if depth > most:
            raise ValueError("a feature is its own ancestor")
        closure = closure.unionByName(level)
    return closure.groupBy("top_id", "id").agg(F.min("depth").alias("depth"))


def _tops(features: DataFrame) -> DataFrame:
    """(id, top): the feature on top of each feature that has a parent.

    Each round doubles the number of levels climbed. Of several parents of one id the smallest counts.
    """
    parents = features.where("parent_id is not null and id is not null").groupBy("id").agg(F.min("parent_id").alias("top"))
    climbed = cut_lineage(parents)
    rounds = max(1, climbed.count()).bit_length() + 1
    for _ in range(rounds):
        above = climbed.select(F.col("id").alias("_id"), F.col("top").alias("_top"))
        climbed = cut_lineage(climbed.join(not_collected(above), F.col("top") == F.col("_id"), "left").select("id", F.coalesce("_top", "top").alias("top"), F.col("_top").isNotNull().alias("_moved")))
        moved = climbed.where("_moved").select("id", "top")
        if not moved.where("id = top").isEmpty():
            raise ValueError("a feature is its own ancestor")
        climbed = climbed.drop("_moved")
        if moved.isEmpty():
            return climbed
    raise ValueError("a feature is its own ancestor")


def with_root(features: DataFrame) -> DataFrame:
    """Adds ``root_id``, the top-level feature above each feature; a top-level one is its own."""
    tops = _tops(features).select(F.col("id").alias("_id"), F.col("top").alias("_top"))
    climbed = features.join(not_collected(tops), F.col("parent_id") == F.col("_id"), "left")
    return climbed.withColumn("root_id", F.coalesce("_top", "parent_id", "id")).drop("_id", "_top")


def roots(features: DataFrame) -> DataFrame:
    """(id, root_id) of every feature with an id."""
    return with_root(features).select("id", "root_id").distinct()


def unknown_parents(features: DataFrame) -> DataFrame:
    """Features whose parent is missing; loading them is an error."""
    ids = features.select(F.col("id").alias("parent_id")).distinct()
    return features.where("parent_id is not null").join(ids, "parent_id", "left_anti")


def top_level(features: DataFrame) -> DataFrame:
    return features.where("parent_id is null")


def nontrivial(features: DataFrame) -> DataFrame:
    dubious = F.coalesce(F.col("orf_classification") == "Dubious", F.lit(False))
    return features.where(~F.col("feature").isin(C.TRIVIAL_FEATURES) & ~dubious)


def gene_features(features: DataFrame) -> DataFrame:
    """Top-level features with an exon below them that are not dubious, with ``has_cds``."""
    families = with_root(features).groupBy("root_id").agg(
        F.bool_or(F.col("feature").contains("exon") & F.col("parent_id").isNotNull()).alias("_exon"),
        F.bool_or((F.col("feature") == "CDS") & F.col("parent_id").isNotNull()).alias("has_cds"),
    ).where("_exon").select(F.col("root_id").alias("id"), "has_cds")
    dubious = F.coalesce(F.col("orf_classification") == "Dubious", F.lit(False))
    return top_level(features).where(~dubious).join(not_collected(families), "id")


def translated(features: DataFrame) -> DataFrame:
    """Gene features with a CDS."""
    return gene_features(features).where("has_cds")


def _noncoding(kind: Column) -> tuple[Column, Column]:
    name = F.when(kind == "rRNA", "rRNA").when(kind == "tRNA", "tRNA").when(kind.contains("RNA"), "other_ncRNA")
    rank = F.when(kind == "rRNA", 0).when(kind == "tRNA", 1).when(kind.contains("RNA"), 2)
    return name, rank


def noncoding(features: DataFrame) -> DataFrame:
    """Noncoding gene features with class and precedence, by the type of the top-level feature."""
    name, rank = _noncoding(F.col("feature"))
    return gene_features(features).withColumn("class", name).withColumn("class_rank", rank).where("class is not null")


def noncoding_by_source(exons: DataFrame) -> DataFrame:
    """(transcript_id, class): the GTF form, by the source of any of a transcript's exons."""
    any_of = lambda cond: F.bool_or(cond)
    g = exons.groupBy("transcript_id").agg(
        any_of(F.col("source") == "rRNA").alias("r"), any_of(F.col("source") == "tRNA").alias("t"), any_of(F.col("source").contains("RNA")).alias("o")
    )
    name = F.when(F.col("r"), "rRNA").when(F.col("t"), "tRNA").when(F.col("o"), "other_ncRNA")
    return g.select("transcript_id", name.alias("class")).where("class is not null")


def transcripts_of(genes: DataFrame, features: DataFrame) -> DataFrame:
    """One row per gene feature: coordinates of first start and stop codon base (null without CDS), exons with ``t0``,
    transcript_length, start_codon_t, stop_codon_t. Raises where a gene mixes strands or sequences."""
    members = with_root(features).where("parent_id is not null").withColumnRenamed("root_id", "gene")
    exon, cds = F.col("feature").contains("exon"), F.col("feature") == "CDS"
    parts = members.groupBy("gene").agg(
        F.count_distinct("strand").alias("strands"),
        F.count_distinct("seqname").alias("seqnames"),
        F.min(F.when(cds, F.col("start"))).alias("cds_start"),
        F.max(F.when(cds, F.col("end"))).alias("cds_end"),
        F.array_sort(F.collect_set(F.when(exon, F.struct("start", "end")))).alias("blocks"),
    )
    single = (F.col("strands") == 1) & (F.col("seqnames") == 1)
    parts = parts.join(not_collected(genes.select(F.col("id").alias("gene"))), "gene", "left_semi")
    checked = parts.withColumn("_ok", F.assert_true(single, F.concat(F.lit("mixed strand or sequence in "), F.col("gene"))).isNull())
    g = genes.select(F.col("id").alias("gene"), "seqname", "strand", "start", "end").join(not_collected(checked.where("_ok")), "gene")
    plus = F.col("strand") == "+"
    size = lambda b: b["end"] - b["start"] + 1
    before = lambda i: F.aggregate(F.slice("blocks", F.lit(1), i), F.lit(0).cast("bigint"), lambda acc, b: acc + size(b))
    total = F.aggregate("blocks", F.lit(0).cast("bigint"), lambda acc, b: acc + size(b))
    placed = F.transform(
        "blocks",
        lambda b, i: F.struct(
            b["start"].alias("start"), b["end"].alias("end"),
            F.when(plus, before(i)).otherwise(total - before(i) - size(b)).alias("t0"),
        ),
    )
    from footprints.operators.coords import to_transcript

    t = g.withColumn("transcript_length", total).withColumn("exons", placed)
    first = F.when(plus, F.col("cds_start")).otherwise(F.col("cds_end"))
    stop = F.when(plus, F.col("cds_end") - 2).otherwise(F.col("cds_start") + 2)
    return t.select(
        "gene", "seqname", "strand", "start", "end", "exons", "transcript_length",
        first.alias("first_start_codon_position"), stop.alias("first_stop_codon_position"),
        to_transcript(first).alias("start_codon_t"), to_transcript(stop).alias("stop_codon_t"),
    )


def cds_outside_exons(features: DataFrame) -> DataFrame:
    """CDS features that lie in no exon of their gene; assembling such a gene is an error."""
    rooted = with_root(features)
    cds = rooted.where("feature = 'CDS'").select("id", "root_id", "seqname", F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    exon = rooted.where(F.col("feature").contains("exon")).select("root_id", "seqname", F.col("start").alias("e_start"), F.col("end").alias("e_end"))
    inside = (F.col("c.seqname") == F.col("e.seqname")) & (F.col("c_start") >= F.col("e_start")) & (F.col("c_end") <= F.col("e_end"))
    return cds.alias("c").join(exon.alias("e"), (F.col("c.root_id") == F.col("e.root_id")) & inside, "left_anti")


def mark_nearby(features: DataFrame, lengths: DataFrame) -> DataFrame:
    """Top-level features with ``overlapping``, ``closest_left`` and ``closest_right``, against the nontrivial ones."""
    tops = top_level(features)
    others = nontrivial(tops)
    spans = others.select("seqname", F.col("id").alias("o_id"), F.col("strand").alias("o_strand"), F.col("start").alias("o_start"), F.col("end").alias("o_end"))
    pairs = intervals.overlap_join(tops.select("id", "seqname", "strand", "start", "end"), spans, ["seqname"], ("start", "end"), ("o_start", "o_end"))
    relevant = (F.col("id") != F.col("o_id")) & ((F.col("strand") == ".") | (F.col("o_strand") == ".") | (F.col("strand") == F.col("o_strand")))
    n = pairs.where(relevant).groupBy("id").agg(F.count(F.lit(1)).alias("overlapping"))
    near = intervals.nearest(tops.select("id", "seqname", "strand", "start", "end"), others, lengths).select("id", "closest_left", "closest_right")
    return tops.join(not_collected(n), "id", "left").na.fill(0, ["overlapping"]).join(not_collected(near), "id")


def standard_seqname(name: Column) -> Column:
    """Without the ``chr`` prefix; the mitochondrion as Mito."""
    short = F.substr(name, F.lit(4), F.length(name))
    return F.when(short == "mt", "Mito").otherwise(short)


def add_exons(features: DataFrame) -> DataFrame:
    """Wraps every CDS in an exon and adds a 50-base exon upstream of each 5' UTR intron, extending mRNA and gene.

    The exon of the mRNA nearest to its start edge is extended to the intron. Exons are numbered per gene in feature
    order, those upstream of introns last.
    """
    order = [F.col(c) for c in ("seqname", "start", "end", "feature", "strand", "id")]
    rooted = with_root(features).withColumnRenamed("root_id", "gene_id")
    cds = rooted.where("feature = 'CDS'")
    numbered = cds.withColumn("k", F.row_number().over(Window.partitionBy("gene_id").orderBy(*order)))
    exon_id = F.concat("gene_id", F.lit("_exon_"), F.col("k"))
    exons = numbered.select("seqname", F.lit("exon").alias("feature"), exon_id.alias("id"), "parent_id", "start", "end", "strand", "gene_id")
    wrapped = numbered.select("seqname", "feature", "id", exon_id.alias("parent_id"), "start", "end", "strand", "gene_id")
    introns = rooted.where("feature = 'five_prime_UTR_intron'")
    n_exons = numbered.groupBy("gene_id").agg(F.max("k").alias("n"))
    j = introns.join(n_exons, "gene_id", "left").withColumn(
        "k", F.coalesce("n", F.lit(0)) + F.row_number().over(Window.partitionBy("gene_id").orderBy(*order))
    )
    plus = F.col("strand") == "+"
    new_start = F.when(plus, F.col("start") - 50).otherwise(F.col("end") + 1)
    new_end = F.when(plus, F.col("start") - 1).otherwise(F.col("end") + 50)
    upstream = j.select("seqname", F.lit("exon").alias("feature"), F.concat("gene_id", F.lit("_exon_"), "k").alias("id"), "parent_id",
                        new_start.alias("start"), new_end.alias("end"), "strand", "gene_id")
    # The last intron in feature order decides where a gene and an exon end up, as each one overwrites the one before.
    last = j.groupBy("parent_id", "gene_id", "strand").agg(
        F.max_by(F.struct(new_start.alias("s"), new_end.alias("e"), F.col("start").alias("i_start"), F.col("end").alias("i_end")), "k").alias("u")
    )
    closest = exons.join(last.select("parent_id", "u"), "parent_id").groupBy("parent_id").agg(
        F.min_by("id", F.struct(F.when(plus, F.col("start")).otherwise(F.col("end")), "id")).alias("id"), F.any_value("u").alias("u")
    ).select("id", F.col("u.i_start").alias("i_start"), F.col("u.i_end").alias("i_end"))
    stretched = exons.join(closest, "id", "left").select(
        "seqname", "feature", "id", "parent_id",
        F.when(plus & F.col("i_end").isNotNull(), F.col("i_end") + 1).otherwise(F.col("start")).alias("start"),
        F.when(~plus & F.col("i_start").isNotNull(), F.col("i_start") - 1).otherwise(F.col("end")).alias("end"),
        "strand", "gene_id",
    )
    bounds = last.select(F.col("parent_id").alias("id"), "u").unionByName(
        last.groupBy("gene_id").agg(F.max("u").alias("u")).select(F.col("gene_id").alias("id"), "u")
    )
    moved = rooted.where("feature <> 'CDS'").join(bounds, "id", "left").select(
        "seqname", F.when(F.col("feature") == "five_prime_UTR_intron", "intron").otherwise(F.col("feature")).alias("feature"), "id", "parent_id",
        F.when(plus & F.col("u").isNotNull(), F.col("u.s")).otherwise(F.col("start")).alias("start"),
        F.when(~plus & F.col("u").isNotNull(), F.col("u.e")).otherwise(F.col("end")).alias("end"),
        "strand", "gene_id",
    )
    return moved.unionByName(wrapped).unionByName(stretched).unionByName(upstream)


def extend_utrs(features: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Moves the terminal exons, mRNA and gene bounds to the called 5' and 3' positions of each gene.

    ``boundaries``: gene, five_pos, three_pos. A gene with other than one mRNA is an error.
    """
    joined = with_root(features).withColumnRenamed("root_id", "gene").join(not_collected(boundaries.select("gene", "five_pos", "three_pos")), "gene", "left")
    exon = F.col("feature").contains("exon")
    per_gene = joined.where("five_pos is not null").groupBy("gene").agg(
        F.count_if(F.col("feature") == "mRNA").alias("mrnas"),
        F.min_by("id", F.when(exon, F.struct("start", "end", "id"))).alias("leftmost"),
        F.max_by("id", F.when(exon, F.struct("end", "start", "id"))).alias("rightmost"),
    )
    checked = per_gene.withColumn("_ok", F.assert_true(F.col("mrnas") == 1, F.concat(F.lit("not exactly one mRNA in "), F.col("gene"))).isNull()).where("_ok")
    full = joined.join(not_collected(checked.select("gene", "leftmost", "rightmost")), "gene", "left")
    plus = F.col("strand") == "+"
    whole = (F.col("feature") == "mRNA") | (F.col("id") == F.col("gene"))
    known = F.col("five_pos").isNotNull()
    start = F.when(known & (whole | (F.col("id") == F.col("leftmost"))), F.when(plus, F.col("five_pos")).otherwise(F.col("three_pos"))).otherwise(F.col("start"))
    end = F.when(known & (whole | (F.col("id") == F.col("rightmost"))), F.when(plus, F.col("three_pos")).otherwise(F.col("five_pos"))).otherwise(F.col("end"))
    return full.select(*[c for c in features.columns if c not in ("start", "end")], start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))


def starts_in_region(features: DataFrame, regions: DataFrame) -> DataFrame:
    """Pairs of a feature and a region (region_id, seqname, strand, r_start, r_end) of the same strand in which the
    feature's transcription begins: its start on the plus strand, its end on the minus strand."""
    begins = features.withColumn("_b", F.when(F.col("strand") == "-", F.col("end")).otherwise(F.col("start")))
    return intervals.point_join(begins, regions, ["seqname", "strand"], "_b", ("r_start", "r_end")).drop("_b")


def feature_order(features: DataFrame) -> DataFrame:
    return features.orderBy("seqname", "start", "end", "feature", "strand")


def transcript_order(transcripts: DataFrame) -> DataFrame:
    return transcripts.orderBy("seqname", "start", "end", "strand")


def whitelisted(genes: DataFrame, names: DataFrame) -> DataFrame:
    return genes.join(names, "gene", "left_semi")
