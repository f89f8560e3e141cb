"""Line dedup within an edit bound of one word: a deletion-neighbourhood join.

Two lines are one edit apart when they become equal by replacing, inserting or deleting one word. A line's variants are the line
itself and the line without its i-th word, each as a hash. Lines that differ by a replacement share the variant (hash, i); a
line that has one word more than another has the other line among its variants. So the earliest line of each variant is a
minimum, and no two lines of a variant need ever be paired: a line goes if it is within the bound of an earlier one.

Lines of n words have n variants, so only lines that can match make any: for an edit in one half, the other half is equal,
and halves that no other line has are found first from four hashes a line.

In scripts written without blanks a line is one word or a few, however long. So in lines with too few words for the bound, each
character of such a script counts as a word. These lines have keys of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from footprints.llm.storage import fresh, prepared, row_key, small_or_not, with_text, written
from footprints.llm.text import PIECE_BYTES, UNSPACED, Words, line_breaks, mix, pieces, raw, unspaced

# Lines without a word stay.
MIN_WORDS = 1
# Shorter lines are compared for equality only.
MIN_NEAR_WORDS = 8
_BY_CHARACTER = np.uint64(0x2545F4914F6CDD1D)
_Q = 0xC2B2AE3D27D4EB4F


class _Ranges:
    """Hashes of any run of words, from sums over all words of a batch; equal runs have equal hashes wherever they stand."""

    def __init__(self, words: np.ndarray):
        n = len(words) + 2
        inverse = pow(_Q, -1, 1 << 64)
        up, down = np.full(n, _Q, np.uint64), np.full(n, inverse, np.uint64)
        up[0] = down[0] = 1
        up = np.cumprod(up)
        self.down = np.cumprod(down)
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * up[: len(words)], out=self.sums[1:])

    def of(self, start, end):
        return (self.sums[end] - self.sums[start]) * self.down[start]

    def without(self, start, end, place):
        """The run with the word at ``place`` left out."""
        return self.of(start, place) + (self.sums[end] - self.sums[place + 1]) * self.down[start + 1]


def _salted(words: np.ndarray) -> np.ndarray:
    return mix(words ^ np.uint64(0x8CB92BA72F3D8DD7))


def _identity(words: Words, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    size = (end - start).astype(np.uint64)
    return tuple(mix(_Ranges(h).of(start, end) + size).view(np.int64) for h in (words.hash, _salted(words.hash)))


def _near_words(texts: pa.Array, words: Words) -> tuple[Words, np.ndarray]:
    """The words that near lines are compared by, and which lines have characters cut apart for it; ``words`` holds their lines."""
    few = words.counts < MIN_NEAR_WORDS
    begin, end = unspaced(words.data)
    chosen = few[np.searchsorted(words.at, begin, "right") - 1] if len(begin) else np.zeros(0, bool)
    if not chosen.any():
        return words, np.zeros(len(few), bool)
    return Words(texts, breaks=words.at, cuts=np.concatenate([begin[chosen], end[chosen]])), few


def lines_of(docs: DataFrame) -> DataFrame:
    """(doc_id, row, line, n, hi, lo, halves) of every line with words enough: its number, words, 128-bit hash and half keys."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                data, at = raw(piece.column("text"))
                breaks, of = line_breaks(data, at)
                words = Words(piece.column("text"), breaks=breaks)
                number = np.arange(len(of)) - np.searchsorted(of, of)
                count = words.counts
                chosen = np.flatnonzero(count >= MIN_WORDS)
                start, end = words.begin[chosen], words.begin[chosen + 1]
                hi, lo = _identity(words, start, end)
                n = end - start
                parts, apart = _near_words(piece.column("text"), words)
                start, end = parts.begin[chosen], parts.begin[chosen + 1]
                own = np.where(apart[chosen], _BY_CHARACTER, np.uint64(0))
                ranges = _Ranges(parts.hash)
                halves = []
                for size in (end - start, end - start - 1):
                    cut = size // 2
                    for side, run_hash in ((0, ranges.of(start, start + cut)), (1, ranges.of(end - (size - cut), end))):
                        halves.append((mix(mix(run_hash + np.uint64(side)) + size.astype(np.uint64)) ^ own).view(np.int64))
                near = end - start >= MIN_NEAR_WORDS
                offsets = np.concatenate([[0], np.cumsum(np.where(near, 4, 0))]).astype(np.int32)
                keys = np.stack(halves, axis=1)[near].ravel()
                take = pa.array(of[chosen])
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id").take(take), piece.column("row").take(take), pa.array(number[chosen].astype(np.int32)),
                        pa.array(n.astype(np.int32)), pa.array(hi), pa.array(lo), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys)),
                    ],
                    names=["doc_id", "row", "line", "n", "hi", "lo", "halves"],
                )

    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), "text")
    return keyed.mapInArrow(run, "doc_id long, row long, line int, n int, hi long, lo long, halves array<long>")


def _candidates(docs: DataFrame, places: DataFrame) -> DataFrame:
    """The texts of chosen lines (doc_id, row, line, hi, lo, left, right)."""
    by_doc = places.groupBy("row", "doc_id").agg(F.collect_list(F.struct("line", "hi", "lo", "left", "right")).alias("chosen"))
    # A document's chosen lines are fewer than its lines; their number decides how the documents are joined.
    small = places.count() <= 200_000
    other = by_doc.select(F.col("row").alias("_row"), F.col("doc_id").alias("_id"), "chosen")
    keyed = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), "text").dropDuplicates(["row", "doc_id"]) if not small else docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), row_key().alias("row"), "text"
    )
    joined = keyed.join(F.broadcast(other) if small else other, (F.col("row") == F.col("_row")) & F.col("doc_id").eqNullSafe(F.col("_id")))

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                out = []
                for doc_id, row, text, chosen in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "row", "text", "chosen"))):
                    lines = text.split("\n")
                    out += [{"doc_id": doc_id, "row": row, **c, "text": lines[c["line"]]} for c in chosen]
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    schema = pa.schema([
        ("doc_id", pa.int64()), ("row", pa.int64()), ("line", pa.int32()), ("hi", pa.int64()), ("lo", pa.int64()),
        ("left", pa.bool_()), ("right", pa.bool_()), ("text", pa.string()),
    ])
    return joined.select("doc_id", "row", "text", "chosen").mapInArrow(
        run, "doc_id long, row long, line int, hi long, lo long, left boolean, right boolean, text string"
    )


def variants(candidates: DataFrame) -> DataFrame:
    """(key, place, doc_id, row, line, hi, lo): every candidate itself, place -1, and without its word at ``place``."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                words, apart = _near_words(piece.column("text"), Words(piece.column("text")))
                start, end = words.begin[:-1], words.begin[1:]
                n = end - start
                salt = np.where(apart, _BY_CHARACTER, np.uint64(0))
                ranges = _Ranges(words.hash)
                left = piece.column("left").to_numpy(zero_copy_only=False)
                right = piece.column("right").to_numpy(zero_copy_only=False)
                of = np.repeat(np.arange(len(n)), n)
                place = np.arange(len(of)) - np.repeat(np.concatenate([[0], np.cumsum(n)[:-1]]), n)
                wanted = left[of] & (place < (n // 2)[of]) | right[of] & (place >= ((n - 1) // 2)[of])
                of, place = of[wanted], place[wanted]
                key = mix(ranges.without(start[of], end[of], start[of] + place) + (n[of] - 1).astype(np.uint64)) ^ salt[of]
                own = mix(ranges.of(start, end) + n.astype(np.uint64)) ^ salt
                key = np.concatenate([own, key]).view(np.int64)
                take = pa.array(np.concatenate([np.arange(len(n)), of]))
                place = np.concatenate([np.full(len(n), -1), place]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key), pa.array(place), *(piece.column(c).take(take) for c in ("doc_id", "row", "line", "hi", "lo"))],
                    names=["key", "place", "doc_id", "row", "line", "hi", "lo"],
                )

    return candidates.mapInArrow(run, "key long, place int, doc_id long, row long, line int, hi long, lo long")


def _position():
    """Earlier is the smaller doc_id, null last, then the document's hash, then the line."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row", "line")


def _one_edit():
    """Whether the lower-cased words of texts a and b are one edit apart."""
    def replaced(x, y):
        return F.size(F.filter(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), lambda same: ~same)) <= 1

    def deleted(long, short):
        # The first word that differs is the one too many; the shorter line's end counts as a difference.
        off = F.array_position(F.zip_with(long, short, lambda p, q: p.eqNullSafe(q)), False).cast("int")
        return F.slice(long, off + 1, F.size(long)) == F.slice(short, off, F.size(long))

    x, y = F.col("words_a"), F.col("words_b")
    return (
        F.when(F.size(x) == F.size(y), replaced(x, y))
        .when(F.size(x) == F.size(y) + 1, deleted(x, y))
        .when(F.size(y) == F.size(x) + 1, deleted(y, x))
        .otherwise(False)
    )


def _words(text):
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    def split(x):
        return F.filter(F.split(x, r"[\x20\x09-\x0D]+"), lambda w: w != "")

    words = split(lowered)
    return F.when((F.size(words) < MIN_NEAR_WORDS) & lowered.rlike(UNSPACED), split(F.regexp_replace(lowered, f"({UNSPACED})", " $1 "))).otherwise(words)


def near_lines(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """(hi, lo) of the distinct lines that are one edit from an earlier one. ``firsts`` holds their first places and halves."""
    long = firsts.where(F.size("halves") > 0)
    exploded = long.select("hi", "lo", F.posexplode("halves").alias("half", "key"))
    shared = exploded.groupBy("key").agg(F.min("lo").alias("_p"), F.max("lo").alias("_q")).where("_p <> _q").select("key")
    # An equal left half leaves the edit to the right half.
    sides = exploded.join(shared, "key").groupBy("hi", "lo").agg(F.bool_or(F.col("half") % 2 == 1).alias("left"), F.bool_or(F.col("half") % 2 == 0).alias("right"))
    places = written(long.drop("halves").join(sides, ["hi", "lo"]).select("doc_id", "row", "line", "hi", "lo", "left", "right"), "places")
    lines = written(_candidates(docs, places), "candidates")
    made = variants(lines)
    found = made.groupBy("key").agg(F.min("lo").alias("_p"), F.max("lo").alias("_q")).where("_p <> _q").select("key")
    hits = written(made.join(found, "key").select("key", "place", "hi", "lo", _position().alias("at")), "variants")
    least = hits.groupBy("key", "place").agg(F.min(F.struct("at", "hi", "lo")).alias("first"))
    whole = least.where("place = -1").select("key", F.col("first").alias("other"))
    cut = least.where("place >= 0").groupBy("key").agg(F.min("first").alias("other"))
    pairs = hits.where("place >= 0").join(least.withColumnRenamed("first", "other"), ["key", "place"])
    pairs = pairs.unionByName(hits.where("place >= 0").join(whole, "key").select(*pairs.columns))
    pairs = pairs.unionByName(hits.where("place = -1").join(cut, "key").select(*pairs.columns))
    pairs = pairs.where("other.at < at").select("hi", "lo", F.col("other.hi").alias("hi_b"), F.col("other.lo").alias("lo_b")).distinct()
    words = lines.select("hi", "lo", _words(F.col("text")).alias("words"))
    checked = pairs.join(words.withColumnRenamed("words", "words_a"), ["hi", "lo"])
    checked = checked.join(words.select(F.col("hi").alias("hi_b"), F.col("lo").alias("lo_b"), F.col("words").alias("words_b")), ["hi_b", "lo_b"])
    return checked.where(_one_edit()).select("hi", "lo").distinct()


def removed_lines(docs: DataFrame) -> DataFrame:
    """(row, doc_id, gone, near): the numbers of the lines that go from each document that loses any, and of those the near ones."""
    docs = docs.select("doc_id", "text")
    lines = written(lines_of(docs), "lines")
    place = _position().alias("at")
    firsts = lines.groupBy("hi", "lo").agg(F.min(F.struct(place, "halves")).alias("first"), F.count("*").alias("copies"))
    firsts = written(firsts.select("hi", "lo", "copies", "first.at", "first.at.doc_id", "first.at.row", "first.at.line", "first.halves"), "firsts")
    near = written(near_lines(docs, firsts), "near")
    copied = firsts.where("copies > 1").select("hi", "lo", F.col("at").alias("first"))
    base = lines.select("doc_id", "row", "line", "hi", "lo")
    exact = base.join(copied, ["hi", "lo"]).where(_position() > F.col("first")).select("doc_id", "row", "line", F.lit(0).alias("near"))
    close = base.join(near, ["hi", "lo"]).select("doc_id", "row", "line", F.lit(1).alias("near"))
    gone = exact.unionByName(close).groupBy("doc_id", "row", "line").agg(F.max("near").alias("near"))
    return gone.groupBy("row", "doc_id").agg(F.collect_list("line").alias("gone"), F.collect_list(F.when(F.col("near") == 1, F.col("line"))).alias("near"))


def line_dedup(docs: DataFrame) -> DataFrame:
    """The documents without the lines that an earlier line repeats, with n_lines, n_removed and n_near after their columns.

    Lines are \\n-split; their words lie between white space, and A-Z counts as a-z. A line with a word goes if an earlier
    line has the same words; one of eight or more also if an earlier one of eight or more is one word edit away, itself removed or
    not. In lines of fewer words, each character of a script without blanks is a word for the latter. Earlier is the smaller doc_id (null last), then the document's hash, then the place in the text. Other lines,
    blank ones among them, stay. Rows that agree in doc_id and text are one document and lose the same lines, so a repeated row
    keeps its lines. A null text stays null and has no lines. Columns called n_lines, n_removed or n_near are replaced.
    """
    prepared(docs.sparkSession)
    docs = docs.drop("n_lines", "n_removed", "n_near")
    key, other, gone, near = (fresh(docs, c) for c in ("_row", "_row_b", "_gone", "_near"))
    removed = removed_lines(docs)
    removed = removed.select(F.col("row").alias(other), F.col("doc_id").alias(f"{other}_id"), F.col("gone").alias(gone), F.col("near").alias(near))
    keyed = docs.withColumn(key, row_key())
    joined = keyed.join(removed, (F.col(key) == F.col(other)) & F.col("doc_id").cast("bigint").eqNullSafe(F.col(f"{other}_id")), "left").drop(other, f"{other}_id", key)
    schema = T.StructType([*docs.schema.fields, *(T.StructField(c, T.LongType()) for c in ("n_lines", "n_removed", "n_near"))])
    names = docs.columns

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                texts, counts = [], ([], [], [])
                for text, lost, close in zip(*(piece.column(c).to_pylist() for c in ("text", gone, near))):
                    n = 0 if text is None else text.count("\n") + 1
                    if lost:
                        drop = set(lost)
                        text = "\n".join(line for i, line in enumerate(text.split("\n")) if i not in drop)
                    texts.append(text)
                    for column, value in zip(counts, (n, len(lost or ()), len(close or ()))):
                        column.append(value)
                columns = [pa.array(texts, piece.schema.field("text").type) if c == "text" else piece.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, pa.int64()) for c in counts)], names=[*names, "n_lines", "n_removed", "n_near"])

    return joined.mapInArrow(run, schema)


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """The documents' own columns; a document that lost lines and has no word left goes."""
    kept = line_dedup(docs).where((F.col("n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    shorter = F.col("n_removed") > 0
    columns = [
        F.when(shorter, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c)
        for c in docs.columns if c not in ("n_lines", "n_removed", "n_near")
    ]
    return kept.select(*columns)
