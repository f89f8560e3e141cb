"""Genomic and transcript coordinates, by arithmetic on a transcript's exons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from footprints import constants as C
from footprints.functions import sequence as S
from footprints.session import cut_lineage, not_collected


def transcript_models(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """Genes with ``exons array<struct<start, end, t0>>``; ``t0`` is the coordinate of an exon's first transcribed base."""
    length = F.col("end") - F.col("start") + 1
    by_gene = Window.partitionBy("gene")
    up = F.sum(length).over(by_gene.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)) - length
    total = F.sum(length).over(by_gene)
    strand = genes.select("gene", "strand")
    placed = exons.select("gene", "start", "end", up.alias("up"), (total - up - length).alias("down")).join(not_collected(strand), "gene")
    lists = placed.groupBy("gene").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("start").cast("bigint").alias("start"),
                    F.col("end").cast("bigint").alias("end"),
                    F.when(F.col("strand") == "+", F.col("up")).otherwise(F.col("down")).cast("bigint").alias("t0"),
                )
            )
        ).alias("exons")
    )
    return genes.join(not_collected(lists), "gene")


def to_transcript(p: Column, left: int = 0, right: int = 0, model: str = "") -> Column:
    """Transcript coordinate of genomic position ``p``, buffers outside the ends included; null elsewhere."""
    m = lambda c: F.col(f"{model}{c}")
    plus = m("strand") == "+"
    hit = F.filter(m("exons"), lambda e: (e["start"] <= p) & (p <= e["end"]))
    # One pass over the exons: the expression is not repeated for the parts of the exon found.
    inside = F.get(F.transform(hit, lambda e: e["t0"] + F.when(plus, p - e["start"]).otherwise(e["end"] - p)), F.lit(0))
    ahead = F.when(plus, p - m("start")).otherwise(m("end") - p)
    behind = F.when(plus, p - m("end") - 1).otherwise(m("start") - 1 - p)
    in_buffers = F.when((ahead < 0) & (ahead >= -left), ahead).when((behind >= 0) & (behind < right), m("transcript_length") + behind)
    within = (p >= m("start")) & (p <= m("end"))
    return F.when(within, inside).otherwise(in_buffers).cast("bigint")


def to_genomic(t: Column, model: str = "") -> Column:
    """Genomic position of transcript coordinate ``t``; coordinates outside run on beyond the ends."""
    m = lambda c: F.col(f"{model}{c}")
    plus = m("strand") == "+"
    hit = F.filter(m("exons"), lambda e: (e["t0"] <= t) & (t <= e["t0"] + e["end"] - e["start"]))
    place = lambda e: F.when(plus, e["start"] + t - e["t0"]).otherwise(e["end"] - (t - e["t0"]))
    inside = F.get(F.transform(hit, place), F.lit(0))
    over = t - m("transcript_length")
    return (
        F.when(t < 0, F.when(plus, m("start") + t).otherwise(m("end") - t))
        .when(over >= 0, F.when(plus, m("end") + 1 + over).otherwise(m("start") - 1 - over))
        .otherwise(inside)
        .cast("bigint")
    )


def extent_models(genes: DataFrame, exons: DataFrame) -> DataFrame:
    """One unspliced model per gene from its start codon up to its stop codon, introns included."""
    t = transcript_models(genes, exons)
    first, stop = to_genomic(F.col("start_codon_t")), to_genomic(F.col("stop_codon_t"))
    plus = F.col("strand") == "+"
    return t.select(
        "gene",
        "seqname",
        "strand",
        F.when(plus, first).otherwise(stop + 1).alias("start"),
        F.when(plus, stop - 1).otherwise(first).alias("end"),
        F.abs(stop - first).alias("transcript_length"),
    ).withColumn(
        "exons", F.array(F.struct(F.col("start"), F.col("end"), F.lit(0).cast("bigint").alias("t0")))
    )


def _segments(models: DataFrame, left: int, right: int) -> DataFrame:
    """Genomic pieces of the transcript and its buffers."""
    plus = F.col("strand") == "+"
    low, high = (F.when(plus, left).otherwise(right)), (F.when(plus, right).otherwise(left))
    piece = lambda a, b: F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b"))
    parts = F.concat(
        F.transform("exons", lambda e: piece(e["start"], e["end"])),
        F.array(piece(F.col("start") - low, F.col("start") - 1), piece(F.col("end") + 1, F.col("end") + high)),
    )
    return models.select("gene", "seqname", "strand", F.explode(parts).alias("s")).select(
        "gene", "seqname", "strand", "s.a", "s.b"
    ).where("b >= a")


def _chunk_pieces(regions: DataFrame, genome: DataFrame, chunk_width: int) -> DataFrame:
    """Regions (a, b inclusive) by genome chunk: all columns, ``lo`` and the bases of the chunk; ``-`` off the sequence."""
    pieces = regions.withColumn(
        "chunk", F.explode(F.sequence(F.floor(F.col("a") / chunk_width), F.floor(F.col("b") / chunk_width)))
    )
    lo = F.greatest(F.col("a"), F.col("chunk") * chunk_width)
    hi = F.least(F.col("b"), (F.col("chunk") + 1) * chunk_width - 1)
    size = (hi - lo + 1).cast("int")
    joined = pieces.join(not_collected(genome.withColumnRenamed("seq", "_text")), ["seqname", "chunk"], "left")
    found = F.substr(F.coalesce(F.col("_text"), F.lit("")), (lo - F.col("chunk") * chunk_width + 1).cast("int"), size)
    return joined.select(*regions.columns, lo.alias("lo"), F.rpad(found, size, F.lit("-")).alias("piece"))


def _joined_text(pieces: DataFrame, keys: list[str]) -> DataFrame:
    parts = pieces.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("lo", "piece"))).alias("p"))
    return parts.select(*keys, F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("seq"))


def fetch_regions(regions: DataFrame, genome: DataFrame, chunk_width: int) -> DataFrame:
    """Bases ``a..b`` of every distinct region (all columns kept) as ``seq``; bases off the sequence become ``-``."""
    return _joined_text(_chunk_pieces(regions, genome, chunk_width), regions.columns)


def halo_chunks(genome: DataFrame, chunk_width: int, halo: int) -> DataFrame:
    """(seqname, chunk, text): every chunk with the ``halo`` bases behind it; bases off the sequence are ``-``.

    Chunks just ahead of a sequence's first are there too, so that a region may begin before the sequence does.
    """
    widths = [chunk_width] + [min(chunk_width, halo - k * chunk_width) for k in range(-(-halo // chunk_width))]
    copies = genome.select("seqname", "chunk", "seq", F.explode(F.sequence(F.lit(0), F.lit(len(widths) - 1))).alias("k"))
    kept = F.substr(F.col("seq"), F.lit(1), F.element_at(F.array(*[F.lit(w) for w in widths]), F.col("k") + 1))
    placed = copies.select("seqname", (F.col("chunk") - F.col("k")).cast("bigint").alias("chunk"), "k", kept.alias("piece"))
    spread = placed.groupBy("seqname", "chunk").agg(*[F.max(F.when(F.col("k") == k, F.col("piece"))).alias(f"_{k}") for k in range(len(widths))])
    parts = [F.rpad(F.coalesce(F.col(f"_{k}"), F.lit("")), w, "-") for k, w in enumerate(widths)]
    return spread.select("seqname", "chunk", F.concat(*parts).alias("text"))


def bases_at(rows: DataFrame, genome: DataFrame, chunk_width: int, spans: Column, name: str, longest: int | None = None) -> DataFrame:
    """Adds ``name``: the bases of all ``spans`` (array of a, b, inclusive and ascending), joined; null where there is no span.

    One equi-join with chunks that reach ``longest`` bases (a chunk's width by default) into the next ones; a row whose last
    span ends further from its first base is an error. The chunks are written first, so both sides come straight from their
    shuffles and AQE can split a place that holds most rows.
    """
    halo = longest or chunk_width
    chunks = cut_lineage(halo_chunks(genome, chunk_width, halo)).select("seqname", F.col("chunk").alias("_chunk"), F.col("text").alias("_text"))
    keyed = rows.withColumn("_spans", spans).withColumn("_chunk", F.floor(F.get("_spans", F.lit(0))["a"] / chunk_width))
    joined = keyed.join(not_collected(chunks), ["seqname", "_chunk"], "left")
    text, begin = F.coalesce("_text", F.lit("-" * (chunk_width + halo))), F.col("_chunk") * chunk_width
    part = lambda s: F.substr(text, (s["a"] - begin + 1).cast("int"), F.greatest(s["b"] - s["a"] + 1, F.lit(0)).cast("int"))
    found = F.when(F.size("_spans") == 1, part(F.get("_spans", F.lit(0)))).otherwise(F.array_join(F.transform("_spans", part), ""))
    reach = F.element_at("_spans", -1)["b"] - F.get("_spans", F.lit(0))["a"] + 1
    checked = F.when(F.size("_spans") == 0, F.lit(None)).when(reach > halo, F.raise_error(F.concat(F.lit("a row spans more than the longest allowed: "), reach.cast("string"))).cast("string")).otherwise(found)
    return joined.withColumn(name, checked).drop("_spans", "_chunk", "_text").select(*rows.columns, name)


def transcript_sequences(
    models: DataFrame, genome: DataFrame, chunk_width: int, left: int = 0, right: int = 0
) -> DataFrame:
    """(gene, sequence) in reading direction from ``-left`` to ``transcript_length + right``."""
    pieces = _chunk_pieces(_segments(models, left, right), genome, chunk_width)
    parts = _joined_text(pieces.select("gene", "strand", "lo", "piece"), ["gene", "strand"])
    text = F.upper("seq")
    return parts.select(
        "gene", F.when(F.col("strand") == "-", S.reverse_complement(text)).otherwise(text).alias("sequence")
    )


def coding_sequences(models: DataFrame, sequences: DataFrame, left: int = 0) -> DataFrame:
    """(gene, coding_sequence): start codon to stop codon included; null unless it is a well-formed reading frame."""
    size = F.col("stop_codon_t") + 3 - F.col("start_codon_t")
    cds = F.substr(F.col("sequence"), (F.col("start_codon_t") + left + 1).cast("int"), size.cast("int"))
    codons = S.codons_of(F.col("cds"))
    inner = F.slice(codons, 1, F.greatest(F.size(codons) - 1, F.lit(0)))
    valid = (
        (F.length("cds") % 3 == 0)
        & F.substr(F.col("cds"), F.lit(1), F.lit(3)).isin(C.START_CODONS)
        & F.substr(F.col("cds"), F.length("cds") - 2, F.lit(3)).isin(C.STOP_CODONS)
        & ~F.exists(inner, lambda c: c.isin(C.STOP_CODONS))
    )
    return models.join(sequences, "gene").withColumn("cds", cds).select(
        "gene", "cds", F.when(valid, F.col("cds")).alias("coding_sequence")
    )


def codon_identities(models: DataFrame, sequences: DataFrame, left: int, codon_buffer: int = C.CODON_BUFFER) -> DataFrame:
    """(gene, num_codons, codon_idx, codon) from ``-codon_buffer`` to ``num_codons + codon_buffer``."""
    n = ((F.col("stop_codon_t") - F.col("start_codon_t")) / 3).cast("int")
    first = F.col("start_codon_t") - 3 * codon_buffer + left + 1
    text = F.substr(F.col("sequence"), first.cast("int"), (3 * (n + 2 * codon_buffer)).cast("int"))
    rows = models.join(sequences, "gene").select("gene", n.alias("num_codons"), F.posexplode(S.codons_of(text)).alias("k", "codon"))
    return rows.select("gene", "num_codons", (F.col("k") - codon_buffer).alias("codon_idx"), "codon")
