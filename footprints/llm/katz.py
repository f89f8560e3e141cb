"""Katz backoff bigram model: Good-Turing discounted counts, exactly normalised backoff weights.

Words are lower-cased runs between white space; a text ends with one end token, and its first word's context is the start. Every
training word is a word of the model, whatever their number; words not seen in training are one unknown word, with the mass that
Good-Turing takes from the seen ones. A caller may cap the vocabulary; all words left out are the unknown word then, with their count.

P(w|v) = d(r) r / c(v) where the bigram was seen r times, else alpha(v) P(w); P(w) = d(c) c / N. alpha(v) is the mass that the
discounts free after v, over the probability of all words not seen after v, so that P(.|v) sums to 1. If no word after v was seen
seldom enough to free any, its counts give 1 / (c(v) + 1) of their mass.

Bigram counts lie in tables cut into buckets by the bigram's hash, as sorted numbers in compressed blocks. Scoring deals a text's
bigrams out to the buckets and adds the answers up by text. Bigrams so frequent that a bucket would get them from most texts are
few by definition (HOT_SHARE) and are answered from memory instead, as are the IN_MEMORY most frequent words.

Bigrams with a word that is not in memory, called far, are keyed by a hash of both words' hashes. A text's score is first added up
as if none of its far bigrams had been seen, which takes one number for each word, alpha(w) P(w); those that were seen are put
right by a number for each bigram, so that no bigram has to be asked for twice.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, functions as F

from footprints.llm.storage import prepared, written
from footprints.llm.text import PIECE_BYTES, Words, mix, pieces

# Words whose counts the driver and every task hold; those of all others lie in tables.
IN_MEMORY = 1 << 18
# A bigram with this share of all training tokens is hot; there cannot be more than its inverse.
HOT_SHARE = 1 / (1 << 20)
# Counts up to this are discounted.
SELDOM = 5
CHUNK_TOKENS = 1_000_000
BUCKET_TOKENS = 1_500_000
_NO_ID = np.iinfo(np.int64).min
_CONTEXTS = np.int64(1 << 20)
TABLE, RARE, FAR_TABLE, QUERY, RARE_QUERY, FAR_QUERY, DIRECT, FAR = range(8)
HELD_ROWS = 200_000
# What goes back to Spark at once, one block at least, or rows of a few numbers: each batch is held whole outside the heap.
OUT_BYTES, OUT_ROWS = 1 << 20, 50_000
_START, _END = np.uint64(0x5851F42D4C957F2D), np.uint64(0x14057B7EF767814F)


def held_out(doc_id: Column, parts: int = 5, rest: int = 1) -> Column:
    """Whether the checksum of the id as text leaves ``rest``; an id that is null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == rest


# ---- blocks of numbers ------------------------------------------------------------------------
def _pack(values: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, compressed; numbers in rising order as differences, as those of others would be longer."""
    values = values.astype(np.int64)
    rising = bool((values[1:] >= values[:-1]).all())
    step = np.diff(values, prepend=0) if rising else values
    return bytes([rising]) + zlib.compress(step.view(np.uint8).reshape(-1, 8).T.tobytes(), 1)


def _unpack(block: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(memoryview(block)[1:]), np.uint8).reshape(8, -1)
    step = np.ascontiguousarray(planes.T).view(np.int64).ravel()
    return np.cumsum(step) if block[0] else step


def _merged(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(counts, first) if len(first) else counts


def _merged_pairs(v: np.ndarray, w: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((w, v))
    v, w, counts = v[order], w[order], counts[order]
    if not len(v):
        return v, w, counts
    first = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (w[1:] != w[:-1])]))
    return v[first], w[first], np.add.reduceat(counts, first)


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """One number for the hashes of two words."""
    return mix(v.view(np.uint64) * np.uint64(0xD1342543DE82EF95) + mix(w.view(np.uint64))).view(np.int64)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each key stands, and whether it is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


_BLOCK_SCHEMA = "bucket int, kind int, a binary, b binary, c binary, d binary"
_BLOCK_ARROW = pa.schema([("bucket", pa.int32()), ("kind", pa.int32()), *((c, pa.binary()) for c in "abcd")])


def _block(bucket: int, kind: int, *columns: np.ndarray) -> dict:
    return {"bucket": int(bucket), "kind": kind, **dict(zip("abcd", map(_pack, columns)))}


def _batches(rows):
    """Blocks as record batches of about OUT_BYTES, packed as they are asked for."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(x) for x in row.values() if isinstance(x, bytes))
        if size >= OUT_BYTES:
            yield pa.RecordBatch.from_pylist(held, schema=_BLOCK_ARROW)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema=_BLOCK_ARROW)


def _cut(names: list[str], *columns: np.ndarray):
    """Columns as record batches of up to OUT_ROWS rows."""
    for i in range(0, len(columns[0]), OUT_ROWS):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + OUT_ROWS]) for c in columns], names=names)


def _by_bucket(keys: np.ndarray, buckets: int):
    """(bucket, rows of it), rows sorted by key."""
    bucket = (mix(keys.view(np.uint64)) >> np.uint64(20)).astype(np.int64) % buckets
    order = np.lexsort((keys, bucket))
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if cuts[b] < cuts[b + 1]:
            yield b, order[cuts[b] : cuts[b + 1]]


def _dealt(batches, buckets: int, kind: int, integers: int):
    """Blocks of rows whose first column is the key, the last one numbers with fractions."""
    held, rows = [], 0

    def flush():
        columns = [np.concatenate(c) for c in zip(*held)]
        for b, at in _by_bucket(columns[0], buckets):
            yield _block(b, kind, *(c[at] for c in columns[:integers])) | {"d": columns[-1][at].tobytes()}

    for columns in batches:
        held.append(columns)
        rows += len(columns[0])
        if rows > HELD_ROWS:
            yield from _batches(flush())
            held, rows = [], 0
    if rows:
        yield from _batches(flush())


def _rows(batch):
    """One row at a time, as blocks are large."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _numpy(batch, *names: str) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


# ---- discounts --------------------------------------------------------------------------------
def _good_turing(n: list[float], k: int) -> np.ndarray | None:
    """Good-Turing in Katz's form for counts up to k, or nothing if any ratio is outside 0 to 1 or none is below 1."""
    d = np.ones(SELDOM + 1)
    if min(n[1 : k + 2]) <= 0:
        return None
    a = (k + 1) * n[k + 1] / n[1]
    if a >= 1:
        return None
    for r in range(1, k + 1):
        d[r] = ((r + 1) * n[r + 1] / n[r] / r - a) / (1 - a)
    return d if ((0 < d[1:]) & (d[1:] <= 1)).all() and (d[1:] < 1).any() else None


def _fitted(n: list[int]) -> list[float] | None:
    """Counts of counts on the line through log n[r] over log r, as Simple Good-Turing has it, if it falls steeply enough."""
    some = [r for r in range(1, SELDOM + 2) if n[r] > 0]
    if len(some) < 2:
        return None
    # A count whose neighbours are missing stands for them too.
    gaps = [(after - before) / 2 for before, r, after in zip([0, *some], some, [*some[1:], 2 * some[-1] - some[-2]])]
    slope, level = np.polyfit(np.log(some), np.log([n[r] / gap for r, gap in zip(some, gaps)]), 1)
    return [0.0, *(float(np.exp(level + slope * np.log(r))) for r in range(1, SELDOM + 2))] if slope < -1 else None


def discounts(n: list[int]) -> np.ndarray:
    """d(0..SELDOM) from n[r], the number of events seen r times, r = 1..SELDOM + 1: Good-Turing in Katz's form.

    Katz's k is SELDOM, or the largest below it whose ratios are all valid; counts above k are not discounted then. If there is
    none, the counts of counts are smoothed first. Only where they are too few for a line or do not fall, as in a handful of
    texts, a constant is taken from each seldom count instead (Ney's estimate).
    """
    for k in range(SELDOM, 1, -1):
        if (d := _good_turing(n, k)) is not None:
            return d
    if (smooth := _fitted(n)) and (d := _good_turing(smooth, SELDOM)) is not None:
        return d
    d = np.ones(SELDOM + 1)
    less = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d[1:] = [(r - max(min(less, 0.9), 0.1)) / r for r in range(1, SELDOM + 1)]
    return d


@dataclass
class Unigrams:
    """What every task holds: the words in memory by rising hash, their counts and probabilities. Ids: places, then unknown, end, start.

    If ``open``, words out of memory are words of their own, which lie in tables; else they are the unknown word.
    """

    words: np.ndarray
    counts: np.ndarray
    tokens: int
    types: int
    texts: int
    log_p: np.ndarray  # of the ids up to end
    open: bool = True
    d_word: np.ndarray | None = None  # what p_of needs
    shrink: float = 1.0
    hot: np.ndarray | None = None
    hot_counts: np.ndarray | None = None
    d: np.ndarray | None = None
    log_context: np.ndarray | None = None  # log10 c(v), 0 for contexts not seen
    log_alpha: np.ndarray | None = None
    log_scale: np.ndarray | None = None  # of the seen words after v

    @property
    def unknown(self) -> int:
        return len(self.words)

    def p_of(self, c: Column) -> Column:
        """The probability of a word out of memory by its count."""
        seldom = F.element_at(F.array(*[F.lit(float(x)) for x in self.d_word[1:]]), F.least(c, F.lit(SELDOM)).cast("int"))
        return c * F.when(c <= SELDOM, seldom).otherwise(1.0) * (self.shrink / max(self.tokens, 1))

    def is_far(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return (v == self.unknown) | (w == self.unknown) if self.open else np.zeros(len(v), bool)

    def ids_of(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of words, start and end by their hashes; -1 for words out of memory."""
        hashes = hashes.view(np.uint64)
        at, known = _find(self.words, hashes)
        return np.where(known, at, np.where(hashes == _END, self.unknown + 1, np.where(hashes == _START, self.unknown + 2, -1)))

    def log_seen(self, r: np.ndarray, v: np.ndarray) -> np.ndarray:
        return np.log10(r * self.d[np.where(r > SELDOM, 0, r)]) - self.log_context[v] + self.log_scale[v]

    def log_unseen(self, v: np.ndarray, w: np.ndarray) -> np.ndarray:
        return self.log_alpha[v] + self.log_p[w]

    def ids(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(v, w, text, place of the word or -1 for the end) of all tokens of all texts."""
        at, known = _find(self.words, words.hash)
        word = np.where(known, at, self.unknown)
        texts = len(words.begin) - 1
        doc = np.concatenate([words.doc, np.arange(texts)])
        place = np.concatenate([np.arange(len(word)), np.full(texts, -1)])
        v, w = _neighbours(words, word, self.unknown + 1, self.unknown + 2)
        return v, w, doc, place


def _neighbours(words: Words, word: np.ndarray, end, start) -> tuple[np.ndarray, np.ndarray]:
    """What stands before each token, and the token: of all words of all texts, then of each text's end."""
    counts = words.counts
    before = np.empty(len(word), word.dtype)
    if len(word):
        before[1:] = word[:-1]
        before[words.begin[:-1][counts > 0]] = start
    last = np.where(counts > 0, word[np.maximum(words.begin[1:] - 1, 0)], start) if len(word) else np.full(len(counts), start, word.dtype)
    return np.concatenate([before, last]), np.concatenate([word, np.full(len(counts), end, word.dtype)])


# ---- training ---------------------------------------------------------------------------------
def _unigram_table(train: DataFrame) -> DataFrame:
    """(w, c): hash and count of every training word."""

    def run(batches):
        keys, counts, held = [], [], 0

        def flush():
            k, c = _merged(np.concatenate(keys), np.concatenate(counts))
            return k, c

        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                k, c = np.unique(Words(piece.column("text")).hash, return_counts=True)
                keys.append(k)
                counts.append(c)
                held += len(k)
                if held > 1_000_000:
                    k, c = flush()
                    keys, counts, held = [k], [c], len(k)
                    if held > 500_000:
                        yield from _cut(["w", "c"], k.view(np.int64), c)
                        keys, counts, held = [], [], 0
        if held:
            k, c = flush()
            yield from _cut(["w", "c"], k.view(np.int64), c)

    return train.select("text").mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))


def _unigrams(table: DataFrame, texts: int, vocabulary: int | None, in_memory: int) -> tuple[Unigrams, int]:
    """The model's single words, and the least count of a word in memory."""
    # Counts in bins of a twelfth of a power of two: some hundred rows whatever the corpus. Counts up to SELDOM + 1 have bins of their own.
    size = F.floor(F.log2("c") * 12)
    bins = table.groupBy(size.alias("bin")).agg(F.count("*").alias("n"), F.sum("c").alias("c"), F.min("c").alias("least"), F.max("c").alias("most")).collect()
    types, tokens = sum(b["n"] for b in bins), sum(b["c"] for b in bins)
    room, least = in_memory if vocabulary is None else vocabulary, 1
    if types > room:
        least = max(b["most"] for b in bins) + 1
        for b in sorted(bins, key=lambda b: -b["bin"]):
            if b["n"] > room:
                break
            room -= b["n"]
            least = b["least"]
    chosen = table.where(F.col("c") >= least).toPandas()  # at most as many rows as there was room for
    words = chosen["w"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(words)
    words, counts = words[order], chosen["c"].to_numpy(np.int64)[order]
    total = tokens + texts
    events = np.concatenate([counts, [total - texts - counts.sum(), texts]]).astype(float)
    d, shrink = None, 1.0
    if vocabulary is None or events[-2] == 0:
        small = {b["least"]: b["n"] for b in bins}
        n = [0] + [small.get(r, 0) + (texts == r) for r in range(1, SELDOM + 2)]
        d = discounts(n)
        left = sum(n[r] * r * (1 - d[r]) for r in range(1, SELDOM + 1)) / max(total, 1)
        if left <= 1e-15:
            shrink, left = total / (total + 1), 1 / (total + 1)
        p = events * np.where(events > SELDOM, 1.0, d[np.where(events > SELDOM, 0, events).astype(int)]) * shrink / max(total, 1)
        p[-2] = left
    else:
        p = events / total
    with np.errstate(divide="ignore"):
        log_p = np.log10(p)
    return Unigrams(words, counts, total, types + (texts > 0), texts, log_p, vocabulary is None or least == 1, d, shrink), least


def _accumulated(batches, needed: list[str]):
    """Lists of pieces with about CHUNK_TOKENS tokens together."""
    held, tokens = [], 0
    for batch in batches:
        for piece in pieces(batch, limit=PIECE_BYTES):
            words = Words(piece.column("text"))
            words.data = words.start = words.end = None
            held.append((words, [piece.column(c) for c in needed]))
            tokens += len(words.hash) + piece.num_rows
            words = None
            if tokens >= CHUNK_TOKENS:
                yield held
                held, tokens = [], 0
    if held:
        yield held


def _bigram_table(train: DataFrame, shared: Broadcast, buckets: int) -> DataFrame:
    """(bucket, kind TABLE, bigrams, counts), the bigrams sorted, and (bucket, kind FAR, v, w, counts): one block of each a bucket."""

    def count(batches):
        model = shared.value
        for chunk in _accumulated(batches, []):
            keys, counts, pairs = [], [], []
            while chunk:
                words, _ = chunk.pop(0)
                v, w, _, _ = model.ids(words)
                far = model.is_far(v, w)
                k, c = np.unique((v * _CONTEXTS + w)[~far], return_counts=True)
                keys.append(k)
                counts.append(c)
                before, word = _neighbours(words, words.hash, _END, _START)
                pairs.append((before[far].view(np.int64), word[far].view(np.int64)))
            k, c = _merged(np.concatenate(keys), np.concatenate(counts))
            keys = counts = None
            yield from _batches(_block(b, TABLE, k[rows], c[rows]) for b, rows in _by_bucket(k, buckets))
            k = None
            v, w = (np.concatenate(x) for x in zip(*pairs))
            pairs = None
            v, w, c = _merged_pairs(v, w, np.ones(len(v), np.int64))
            by_bucket = ((b, np.sort(rows)) for b, rows in _by_bucket(_pair_key(v, w), buckets))
            yield from _batches(_block(b, FAR, v[rows], w[rows], c[rows]) for b, rows in by_bucket)
            v = w = c = None

    def merge(batches):
        def out(bucket, near, far):
            if near:
                yield _block(bucket, TABLE, *_merged(*(np.concatenate(x) for x in zip(*near))))
            if far:
                yield _block(bucket, FAR, *_merged_pairs(*(np.concatenate(x) for x in zip(*far))))

        bucket, near, far = None, [], []
        for batch in batches:
            for row in _rows(batch):
                if bucket is not None and row["bucket"] != bucket:
                    yield from _batches(out(bucket, near, far))
                    near, far = [], []
                bucket = row["bucket"]
                if row["kind"] == TABLE:
                    near.append((_unpack(row["a"]), _unpack(row["b"])))
                else:
                    far.append((_unpack(row["a"]), _unpack(row["b"]), _unpack(row["c"])))
        if near or far:
            yield from _batches(out(bucket, near, far))

    blocks = train.select("text").mapInArrow(count, _BLOCK_SCHEMA)
    return blocks.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(merge, _BLOCK_SCHEMA)


_SUMS = ["total", *(f"n{r}" for r in range(1, SELDOM + 1)), "seen"]


def _far_bigrams(bigrams: DataFrame, rare: DataFrame, shared: Broadcast) -> DataFrame:
    """(v, w, r, vi, wi, pw) of every far bigram: the words' hashes, the count, their ids or -1, and P(w). ``rare``: (_w, _p) of words out of memory.

    A word in memory is told by its id alone; its hash is 0 here.
    """

    def run(batches):
        model = shared.value
        for batch in batches:
            for row in _rows(batch):
                v, w, r = (_unpack(row[c]) for c in "abc")
                vi, wi = model.ids_of(v), model.ids_of(w)
                p = np.where(wi < 0, 0.0, 10 ** model.log_p[np.minimum(wi, model.unknown + 1)])
                v, w = np.where(vi < 0, v, 0), np.where(wi < 0, w, 0)
                yield from _cut(["v", "w", "r", "vi", "wi", "p"], v, w, r, vi, wi, p)

    far = bigrams.where(F.col("kind") == FAR).mapInArrow(run, "v long, w long, r long, vi long, wi long, p double")
    # Only words out of memory are looked up, of which none is frequent; the other rows stay where they are.
    found = far.where("wi < 0").select("v", "w", "r", "vi", "wi").join(rare, F.col("w") == F.col("_w"), "left").select("v", "w", "r", "vi", "wi", F.col("_p").alias("pw"))
    return found.unionByName(far.where("wi >= 0").select("v", "w", "r", "vi", "wi", F.col("p").alias("pw")))


def _weights(sums: list[np.ndarray], d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """log10 of c(v), alpha(v) and the scale of the seen words after v, from _SUMS; 0 for contexts not seen."""
    total, seen = sums[0], sums[-1]
    known = total > 0
    freed = sum(sums[r] * (1 - d[r]) * r for r in range(1, SELDOM + 1))
    scale = np.where(freed > 0, 1.0, total / (total + 1))
    mass = np.where(freed > 0, freed / np.maximum(total, 1), 1 / (total + 1))
    # Nothing unseen is left if every event followed v; then there is nothing to back off to either.
    unseen = np.maximum(1 - seen, 0)
    some = known & (unseen > 1e-12)
    with np.errstate(divide="ignore"):
        return (
            np.where(known, np.log10(np.maximum(total, 1)), 0.0), np.where(some, np.log10(mass / np.maximum(unseen, 1e-12)), 0.0),
            np.where(some, np.log10(scale), 0.0),
        )


def _rare_contexts(contexts: DataFrame, shared: Broadcast) -> DataFrame:
    """(_v, log_context, log_alpha, log_scale) of the contexts out of memory."""

    def run(batches):
        for batch in batches:
            weights = _weights(_numpy(batch, *_SUMS), shared.value.d)
            yield pa.RecordBatch.from_arrays([batch.column("v"), *map(pa.array, weights)], names=["_v", "log_context", "log_alpha", "log_scale"])

    return contexts.where("vi < 0").select("v", *_SUMS).mapInArrow(run, "_v long, log_context double, log_alpha double, log_scale double")


def _far_table(far: DataFrame, contexts: DataFrame, shared: Broadcast, buckets: int) -> DataFrame:
    """Blocks of the far bigrams' keys and what each has to be put right by: log10 P(w|v) - alpha(v) P(w)."""

    def run(batches):
        model = shared.value
        hashes = np.concatenate([model.words, np.array([0, _END, _START], np.uint64)]).view(np.int64)

        def rows():
            for batch in batches:
                v, w, r, vi, wi, pw, context, alpha, scale = _numpy(batch, "v", "w", "r", "vi", "wi", "pw", "log_context", "log_alpha", "log_scale")
                v, w = np.where(vi < 0, v, hashes[vi]), np.where(wi < 0, w, hashes[wi])
                near = vi >= 0
                context, alpha, scale = (np.where(near, mine[vi], x) for mine, x in ((model.log_context, context), (model.log_alpha, alpha), (model.log_scale, scale)))
                yield _pair_key(v, w), np.log10(r * model.d[np.where(r > SELDOM, 0, r)]) - context + scale - alpha - np.log10(pw)

        yield from _dealt(rows(), buckets, FAR_TABLE, 1)

    names = ["log_context", "log_alpha", "log_scale"]
    # Contexts in memory need no join.
    joined = far.where("vi < 0").join(contexts, F.col("v") == F.col("_v"), "left").select("v", "w", "r", "vi", "wi", "pw", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in names])
    joined = joined.unionByName(far.where("vi >= 0").select("v", "w", "r", "vi", "wi", "pw", *[F.lit(0.0).alias(c) for c in names]))
    return joined.mapInArrow(run, _BLOCK_SCHEMA)


def _context_sums(table: DataFrame, shared: Broadcast) -> DataFrame:
    """(v, total, n1..n5, seen): by context, the tokens, the bigrams seen 1 to 5 times and the probability of all words seen."""
    names = ["v", *_SUMS]

    def run(batches):
        model = shared.value
        size = model.unknown + 3
        sums = np.zeros((SELDOM + 2, size))
        for batch in batches:
            for row in _rows(batch):
                key, r = _unpack(row["a"]), _unpack(row["b"])
                v, w = key // _CONTEXTS, key % _CONTEXTS
                sums[0] += np.bincount(v, r, size)
                for i in range(1, SELDOM + 1):
                    sums[i] += np.bincount(v[r == i], minlength=size)
                sums[-1] += np.bincount(v, 10 ** model.log_p[w], size)
        some = np.flatnonzero(sums[0])
        yield pa.RecordBatch.from_arrays([pa.array(some), *(pa.array(s[some]) for s in sums)], names=names)

    schema = "v long, " + ", ".join(f"{n} double" for n in names[1:])
    return table.mapInArrow(run, schema).groupBy("v").agg(*[F.sum(n).alias(n) for n in names[1:]])


def _hot(table: DataFrame, least: int) -> DataFrame:
    """(key, r) of the bigrams seen ``least`` times or more."""

    def run(batches):
        for batch in batches:
            for row in _rows(batch):
                key, r = _unpack(row["a"]), _unpack(row["b"])
                yield pa.RecordBatch.from_arrays([pa.array(key[r >= least]), pa.array(r[r >= least])], names=["key", "r"])

    return table.mapInArrow(run, "key long, r long")


def _counts_of_counts(table: DataFrame) -> list[int]:
    def run(batches):
        n = np.zeros(SELDOM + 2, np.int64)
        for batch in batches:
            for row in _rows(batch):
                r = _unpack(row["b"])
                n += np.bincount(np.minimum(r, SELDOM + 2), minlength=SELDOM + 3)[: SELDOM + 2]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(SELDOM + 2)), pa.array(n)], names=["r", "n"])

    found = {row["r"]: row["n"] for row in table.mapInArrow(run, "r long, n long").groupBy("r").agg(F.sum("n").alias("n")).collect()}
    return [found.get(r, 0) for r in range(SELDOM + 2)]


@dataclass
class Model:
    near: DataFrame  # blocks of the bigrams of words in memory
    far: DataFrame | None  # blocks of the others, if there are any
    rare: DataFrame  # (w, c, value): words out of memory, their counts and log10 of alpha(w) P(w)
    buckets: int
    local: Unigrams


def train(docs: DataFrame, vocabulary: int | None = None, in_memory: int = IN_MEMORY) -> Model:
    """Learns from every text of ``docs``, a null one being empty. The tables are written to the shared folder.

    The driver and each task hold the ``in_memory`` most frequent words, their context sums and the hot bigrams: at most IN_MEMORY
    and 1,048,576 rows of a few numbers (some 35 MB), whatever the corpus; what they hold changes no score. ``vocabulary`` caps the
    words of the model instead, all of which are held. Without documents, the unknown word and the end share all probability.
    """
    spark = prepared(docs.sparkSession)
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    texts = docs.count()
    unigrams = written(_unigram_table(docs), "unigrams")
    local, least = _unigrams(unigrams, texts, vocabulary, in_memory)
    if texts == 0:
        local.log_p = np.log10(np.array([0.5, 0.5]))
    buckets = max(1, math.ceil(local.tokens / BUCKET_TOKENS))
    shared = spark.sparkContext.broadcast(local)
    bigrams = written(_bigram_table(docs, shared, buckets), "bigrams")
    near = bigrams.where(F.col("kind") == TABLE).select("bucket", "kind", "a", "b", "c", "d")
    n = _counts_of_counts(near)
    size = local.unknown + 3
    sums = np.zeros((len(_SUMS), size))
    got = _context_sums(near, shared).toPandas()
    rare = unigrams.where(F.col("c") < least)
    some_far = local.open and least > 1
    if some_far:
        far = written(_far_bigrams(bigrams, rare.select(F.col("w").alias("_w"), local.p_of(F.col("c")).alias("_p")), shared), "far")
        by_count = far.where(F.col("r") <= SELDOM + 1).groupBy("r").agg(F.count("*").alias("n")).collect()
        for row in by_count:
            n[row["r"]] += row["n"]
        counts = [F.sum(F.when(F.col("r") == r, 1.0).otherwise(0.0)).alias(f"n{r}") for r in range(1, SELDOM + 1)]
        contexts = written(far.groupBy("v", "vi").agg(F.sum("r").cast("double").alias("total"), *counts, F.sum("pw").alias("seen")), "contexts")
        more = contexts.where("vi >= 0").toPandas()  # contexts in memory
        for i, name in enumerate(_SUMS):
            sums[i, more["vi"].to_numpy(np.int64)] = more[name]
    for i, name in enumerate(_SUMS):
        sums[i, got["v"].to_numpy(np.int64)] += got[name]
    local.d = discounts(n)
    local.d[0] = 1.0
    local.log_context, local.log_alpha, local.log_scale = _weights(list(sums), local.d)
    far_table, value = None, F.lit(0.0)
    if some_far:
        shared = spark.sparkContext.broadcast(local)
        outer = _rare_contexts(contexts, shared)
        far_table = written(_far_table(far, outer, shared, buckets), "far_table")
        rare = rare.join(outer, F.col("w") == F.col("_v"), "left")
        value = F.log10(local.p_of(F.col("c"))) + F.coalesce("log_alpha", F.lit(0.0))
    rare = rare.select("w", "c", value.alias("value"))
    hot_least = max(2, math.ceil(local.tokens * HOT_SHARE))
    hot = _hot(near, hot_least).toPandas()
    order = np.argsort(hot["key"].to_numpy(np.int64))
    local.hot, local.hot_counts = hot["key"].to_numpy(np.int64)[order], hot["r"].to_numpy(np.int64)[order]
    return Model(near, far_table, rare, buckets, local)


# ---- scoring ----------------------------------------------------------------------------------
def _base(counts: np.ndarray, model: Unigrams) -> np.ndarray:
    return np.log10((counts + 0.5) / (model.tokens + 0.5 * (model.types + 1)))


def _queries(docs: DataFrame, shared: Broadcast, buckets: int) -> DataFrame:
    """Blocks of what the buckets have to answer, and of what each text has by itself."""

    def asked(kind, parts, rids):
        key, doc = (np.concatenate(x) for x in zip(*parts))
        parts.clear()
        order = np.lexsort((doc, key))
        key, doc = key[order], doc[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        begin = np.flatnonzero(new)
        key, doc, n = key[begin], doc[begin], np.diff(np.append(begin, len(order)))
        order = new = begin = None
        for b, rows in _by_bucket(key, buckets):
            texts, local = np.unique(doc[rows], return_inverse=True)
            yield _block(b, kind, key[rows], local, n[rows], rids[texts])

    def run(batches):
        model = shared.value
        for number, chunk in enumerate(_accumulated(batches, ["rid", "doc_id"])):
            rids = np.concatenate([columns[0].to_numpy(zero_copy_only=False) for _, columns in chunk])
            ids = np.concatenate([columns[1].fill_null(_NO_ID).to_numpy(zero_copy_only=False) for _, columns in chunk])
            size = len(rids)
            known, base, score, tokens = np.zeros(size, np.int64), np.zeros(size), np.zeros(size), np.zeros(size, np.int64)
            bigrams, rare, pairs, first = [], [], [], 0
            while chunk:
                words, _ = chunk.pop(0)
                v, w, doc, place = model.ids(words)
                doc = doc + first
                first += len(words.begin) - 1
                tokens += np.bincount(doc, minlength=size)
                mine = w != model.unknown
                c = np.append(model.counts, [0, model.texts])[w[mine]]
                base += np.bincount(doc[mine], _base(c, model), size)
                known += np.bincount(doc[mine][c > 0], minlength=size)
                rare.append((words.hash[place[~mine]].view(np.int64), doc[~mine]))
                key = v * _CONTEXTS + w
                far = model.is_far(v, w)
                at, hot = _find(model.hot, key)
                hot &= ~far
                score += np.bincount(doc[hot], model.log_seen(model.hot_counts[at[hot]], v[hot]) if hot.any() else None, size)
                bigrams.append((key[~hot & ~far], doc[~hot & ~far]))
                # As if unseen; what belongs to a word out of memory comes with that word.
                v, w, doc = v[far], w[far], doc[far]
                score += np.bincount(doc, np.where(v == model.unknown, 0.0, model.log_alpha[v]) + np.where(w == model.unknown, 0.0, model.log_p[w]), size)
                before, word = _neighbours(words, words.hash, _END, _START)
                pairs.append((_pair_key(before[far], word[far]), doc))
            yield from _batches([_block(number % buckets, DIRECT, rids, tokens, known) | {"d": ids.tobytes() + base.tobytes() + score.tobytes()}])
            for kind, parts in ((QUERY, bigrams), (RARE_QUERY, rare), (FAR_QUERY, pairs)):
                yield from _batches(asked(kind, parts, rids))

    return docs.mapInArrow(run, _BLOCK_SCHEMA)


def _rare_table(rare: DataFrame, buckets: int) -> DataFrame:
    def run(batches):
        yield from _dealt((_numpy(batch, "w", "c", "value") for batch in batches), buckets, RARE, 2)

    return rare.mapInArrow(run, _BLOCK_SCHEMA)


def _sorted_parts(parts: list[tuple]) -> list[np.ndarray]:
    """The columns of all parts, by the first."""
    if not parts:
        return [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    columns = [np.concatenate(c) for c in zip(*parts)]
    order = np.argsort(columns[0], kind="stable")
    return [c[order] for c in columns]


_SUMS_SCHEMA = "part long, a binary, b binary"


class _Sums:
    """Sums by text: n_tokens, n_known, base and score, and the doc_id where it is known. As blocks, rows of neighbouring texts."""

    def __init__(self):
        self.held: list[list[np.ndarray]] = []
        self.rows = 0

    def add(self, *columns: np.ndarray) -> None:
        self.held.append(list(columns))
        self.rows += len(columns[0])

    def merge(self) -> list[np.ndarray]:
        rid = np.concatenate([h[0] for h in self.held])
        order = np.argsort(rid, kind="stable")
        rid = rid[order]
        first = np.flatnonzero(np.concatenate([[True], rid[1:] != rid[:-1]]))
        rest = [np.concatenate([h[i] for h in self.held])[order] for i in range(1, 6)]
        merged = [rid[first], np.maximum.reduceat(rest[0], first), *(np.add.reduceat(x, first) for x in rest[1:])]
        self.held, self.rows = [merged], len(first)
        return merged

    def blocks(self) -> pa.RecordBatch:
        """A row for each run of up to 16,384 neighbouring texts."""
        columns = self.merge()
        part = columns[0] >> 14
        cuts = np.append(np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])), len(part))
        rows = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            numbers = b"".join(len(x).to_bytes(4, "big") + x for x in (_pack(c[i:j]) for c in columns[:4]))
            rows.append({"part": int(part[i]), "a": numbers, "b": columns[4][i:j].tobytes() + columns[5][i:j].tobytes()})
        self.held, self.rows = [], 0
        return pa.RecordBatch.from_pylist(rows, schema=pa.schema([("part", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]))

    def read(self, row: dict) -> None:
        columns, rest = [], row["a"]
        while rest:
            size = int.from_bytes(rest[:4], "big")
            columns.append(_unpack(rest[4 : 4 + size]))
            rest = rest[4 + size :]
        half = len(columns[0]) * 8
        self.add(*columns, np.frombuffer(row["b"][:half]), np.frombuffer(row["b"][half:]))


def _answers(blocks: DataFrame, shared: Broadcast) -> DataFrame:
    """Blocks of parts of each text's sums. What goes in comes sorted by bucket, tables first."""

    def run(batches):
        model = shared.value
        bucket, tables, read = None, {}, None
        table_of = {QUERY: TABLE, RARE_QUERY: RARE, FAR_QUERY: FAR_TABLE}
        # Unless the vocabulary is open, words out of memory are the unknown word, which is in memory.
        log_new = model.log_p[model.unknown] if model.open else 0.0
        sums = _Sums()
        for batch in batches:
            for row in _rows(batch):
                if row["bucket"] != bucket:
                    bucket, tables, read = row["bucket"], {TABLE: [], RARE: [], FAR_TABLE: []}, set()
                kind = row["kind"]
                if kind == TABLE:
                    tables[kind].append((_unpack(row["a"]), _unpack(row["b"])))
                elif kind == RARE:
                    tables[kind].append((_unpack(row["a"]), _unpack(row["b"]), np.frombuffer(row["d"])))
                elif kind == FAR_TABLE:
                    tables[kind].append((_unpack(row["a"]), np.frombuffer(row["d"])))
                elif kind == DIRECT:
                    rid, tokens, known = (_unpack(row[c]) for c in "abc")
                    size = len(rid) * 8
                    ids, base, score = np.frombuffer(row["d"][:size], np.int64), np.frombuffer(row["d"][size : 2 * size]), np.frombuffer(row["d"][2 * size :])
                    sums.add(rid, ids, tokens, known, base, score)
                else:
                    if table_of[kind] not in read:
                        tables[table_of[kind]] = _sorted_parts(tables[table_of[kind]])
                        read.add(table_of[kind])
                    key, doc, n, rid = (_unpack(row[c]) for c in "abcd")
                    keys, *values = tables[table_of[kind]]
                    at, seen = _find(keys, key)
                    at = at[seen]
                    zero, size = np.zeros(len(rid)), len(rid)
                    none, no_id = np.zeros(size, np.int64), np.full(size, _NO_ID)
                    if kind == QUERY:
                        v, w = key // _CONTEXTS, key % _CONTEXTS
                        value = np.empty(len(key))
                        value[seen] = model.log_seen(values[0][at], v[seen])
                        value[~seen] = model.log_unseen(v[~seen], w[~seen])
                        sums.add(rid, no_id, none, none, zero, np.bincount(doc, value * n, size))
                    elif kind == FAR_QUERY:
                        sums.add(rid, no_id, none, none, zero, np.bincount(doc[seen], values[0][at] * n[seen], size))
                    else:
                        r, value = np.zeros(len(key), np.int64), np.full(len(key), log_new)
                        r[seen], value[seen] = values[0][at], values[1][at]
                        known = np.bincount(doc[seen], n[seen], size).astype(np.int64)
                        sums.add(rid, no_id, none, known, np.bincount(doc, _base(r, model) * n, size), np.bincount(doc, value * n, size))
                if sums.rows > 600_000:
                    sums.merge()
                    if sums.rows > 500_000:
                        yield sums.blocks()
        if sums.rows:
            yield sums.blocks()

    return blocks.mapInArrow(run, _SUMS_SCHEMA)


def _added_up(blocks: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, n_known, base, score) of each text from its parts, which come sorted."""

    def out(sums: _Sums) -> pa.RecordBatch:
        _, ids, tokens, known, base, score = sums.merge()
        columns = [pa.array(ids, mask=ids == _NO_ID), pa.array(tokens), pa.array(known), pa.array(base), pa.array(score)]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "n_known", "base", "score"])

    def run(batches):
        part, sums = None, _Sums()
        for batch in batches:
            for row in _rows(batch):
                if row["part"] != part:
                    if sums.rows:
                        yield out(sums)
                    part, sums = row["part"], _Sums()
                sums.read(row)
                if sums.rows > 300_000:
                    sums.merge()
        if sums.rows:
            yield out(sums)

    return blocks.repartition("part").sortWithinPartitions("part").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base double, score double")


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) per row of ``docs``.

    score is the text's log10 probability, its end included; n_known counts tokens seen in training, and base_score is the
    smoothed log10 probability of its single tokens by their exact counts. An empty or null text is its end alone. Repeated rows
    and equal ids are scored each by itself.
    """
    spark = prepared(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model.local)
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks = _queries(rows, shared, model.buckets)
    blocks = blocks.unionByName(model.near).unionByName(_rare_table(model.rare, model.buckets))
    if model.far is not None:
        blocks = blocks.unionByName(model.far)
    # Fewer parts than buckets: every part answers for each text once.
    parts = max(spark.sparkContext.defaultParallelism, math.ceil(model.buckets / 2))
    dealt = blocks.repartition(parts, "bucket").sortWithinPartitions("bucket", "kind")
    return _added_up(_answers(dealt, shared)).select(
        "doc_id", "n_tokens", "n_known", F.lit(model.local.tokens).cast("bigint").alias("train_tokens"), F.col("base").alias("base_score"), "score"
    )
