"""Exact similarity join of documents on their word n-grams: PartEnum signatures.

Sets whose Jaccard similarity reaches num/den differ in at most (|a|+|b|)(den-num)/(den+num) elements. Sizes are cut into bands
that grow by half; for each band, elements are dealt into n1 groups of n2 parts by hash, n1*(n2-t+1) being more than the greatest
difference k between two sets of the band. Then some group has at most n2-t differing parts, and one of its t-part subsets is
equal in both sets; the hash of that subset's elements is a signature that both sets share. A set near the top of its band also
gets the next band's signatures. ``spare`` more groups than needed make that many more groups fit, so a set may leave out the
signatures of subsets with hardly an element, which unlike sets share by chance, as long as no more than ``spare`` groups have
one; else it keeps them all. No link is lost.
"""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from footprints.llm import graph
from footprints.llm.storage import BROADCAST_ROWS, fresh, prepared, small_or_not, written
from footprints.llm.text import PIECE_BYTES, Words, grams, mix, pieces

GROWTH = 1.5
# Groups of up to this many sets are compared pair by pair, larger ones with one member at a time.
PAIRWISE = 8
# Groups of a family's members with more members than this get references of their own; the others are filtered pair by pair,
# so that a member meets at most so many others in each of its groups. Each round takes four times as many: it has fewer members,
# and one more round costs the same whatever it has.
REGROUPED = 200
# After so many rounds of regrouping, all pairs that are left are compared.
DEPTH = 6
BUFFER_ROWS = 200_000
# Rows of a few numbers that go back to Spark at once, as each batch is held whole outside the heap.
OUT_ROWS = 50_000
# Bins of a set's sketch: a byte each, so that a sketch is far smaller than most texts.
SKETCH = 256
# A set's parity: 2048 bits, 64 in a number. Sets of a few thousand elements still differ in more bits than a link allows.
PARITY = [f"p{i}" for i in range(32)]


@lru_cache(None)
def band(i: int) -> tuple[int, int]:
    """The sizes of band i."""
    low = 1 if i == 0 else band(i - 1)[1] + 1
    return low, max(low, int(low * GROWTH))


def band_of(size: int) -> int:
    i = 0
    while band(i)[1] < size:
        i += 1
    return i


@lru_cache(None)
def scheme(i: int, num: int, den: int) -> tuple[int, int, int, int, int]:
    """(n1, n2, t, spare, least) of a band; least is the number of elements below which a subset may be left out.

    Two of three parts are a signature where that holds about five elements or more. Where the sets may differ by so much that it
    does not, one group is, which takes a third fewer signatures; small sets take the fullest subsets.
    """
    low, high = band(i)
    k = 2 * high * (den - num) // (den + num)
    if k == 0:
        return 1, 1, 1, 0, 0
    if k <= 3:
        options = [(math.ceil((k + 1) / (k2 + 1)), k2 + t, t) for k2 in range(k + 1) for t in (1, 2, 3) if k2 or t == 1]
        cheap = [o for o in options if o[0] * math.comb(o[1], o[2]) <= 6 * (k + 1)]
        n1, n2, t = max(cheap, key=lambda o: (o[2] / o[1] / o[0], -o[0] * math.comb(o[1], o[2])))
        return n1, n2, t, 0, 0
    n1, n2, t, least = math.ceil((k + 1) / 2), 3, 2, 2
    if low / n1 * t / n2 < 5:
        n1, n2, t, least = k + 1, 1, 1, 1
    mean = low / n1 * t / n2
    thin = n1 * math.comb(n2, t) * math.exp(-mean) * (1 + mean * (least - 1))
    spare = math.ceil(thin + 3 * math.sqrt(thin) + 1)
    return n1 + spare, n2, t, spare, least


def shingle_sets(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash), sorted: the distinct n-word shingles of every text; a shorter text's words are its one shingle."""
    runs = grams(words.hash, n)
    inside = words.doc[: len(runs)] == words.doc[n - 1 :] if len(runs) else np.zeros(0, bool)
    doc, value = words.doc[: len(runs)][inside], runs[inside]
    counts = words.counts
    for m in range(1, n):
        short = np.flatnonzero(counts == m)
        if len(short):
            whole = np.zeros(len(short), np.uint64)
            for j in range(m):
                whole = mix(whole + words.hash[words.begin[short] + j] + np.uint64(j + 1))
            doc, value = np.concatenate([doc, short]), np.concatenate([value, mix(whole + np.uint64(m))])
    order = np.lexsort((value, doc))
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (value[1:] != value[:-1])
    return doc[new], value[new]


def _signatures(doc: np.ndarray, value: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of all texts' sets."""
    out_doc, out_sig = [], []
    begin = np.concatenate([[0], np.cumsum(sizes)])
    for i in range(band_of(int(sizes.max())) + 2 if len(sizes) and sizes.max() else 0):
        low, high = band(i)
        own = (sizes >= low) & (sizes <= high)
        reach = (sizes < low) & (sizes * den // num >= low) & (sizes > 0)
        chosen = np.flatnonzero(own | reach)
        if not len(chosen):
            continue
        n1, n2, t, spare, least = scheme(i, num, den)
        width = n1 * n2
        step = max(1, 4_000_000 // width)
        for part in (chosen[j : j + step] for j in range(0, len(chosen), step)):
            at = np.repeat(np.arange(len(part)), sizes[part])
            rows = np.repeat(begin[part] - np.concatenate([[0], np.cumsum(sizes[part])[:-1]]), sizes[part]) + np.arange(len(at))
            x = value[rows]
            place = mix(x + np.uint64(0x5851F42D4C957F2D * (i + 1) % (1 << 64)))
            slot = ((place >> np.uint64(32)) * np.uint64(n1) >> np.uint64(32)) * np.uint64(n2) + ((place & np.uint64(0xFFFFFFFF)) * np.uint64(n2) >> np.uint64(32))
            slot = at * width + slot.astype(np.int64)
            total = np.zeros(len(part) * width, np.uint64)
            np.add.at(total, slot, mix(x ^ np.uint64(0x2545F4914F6CDD1D)))
            filled = np.bincount(slot, minlength=len(part) * width)
            total, filled = total.reshape(-1, n1, n2), filled.reshape(-1, n1, n2)
            subsets = list(itertools.combinations(range(n2), t))
            sig = np.zeros((len(part), n1, len(subsets)), np.uint64)
            held = np.zeros(sig.shape, np.int64)
            for s, members in enumerate(subsets):
                for m in members:
                    sig[:, :, s] = mix(sig[:, :, s] + total[:, :, m] + np.uint64(m + 1))
                    held[:, :, s] += filled[:, :, m]
            names = (np.uint64(i) << np.uint64(40)) + (np.arange(n1, dtype=np.uint64)[:, None] << np.uint64(8)) + np.arange(len(subsets), dtype=np.uint64)
            sig = mix(sig ^ mix(names + np.uint64(1))[None])
            thin = held < least
            keep = ~thin | (thin.any(axis=2).sum(axis=1) > spare)[:, None, None]
            which = np.nonzero(keep)
            out_doc.append(part[which[0]])
            out_sig.append(sig[which])
    if not out_doc:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(out_doc), np.concatenate(out_sig)


def _identity(doc: np.ndarray, value: np.ndarray, sizes: np.ndarray) -> list[pa.Array]:
    """The 128-bit hash of every text's set, as two numbers."""
    identity = []
    for salt in (0x9FB21C651E98DF25, 0xA0761D6478BD642F):
        total = np.zeros(len(sizes), np.uint64)
        np.add.at(total, doc, mix(value ^ np.uint64(salt)))
        identity.append(pa.array(mix(total + sizes.astype(np.uint64)).view(np.int64)))
    return identity


def _parity(doc: np.ndarray, value: np.ndarray, rows: int) -> list[pa.Array]:
    """Whether the elements of every text's set in each of 2048 bins are odd in number. Each element that only one of two sets has changes one bit."""
    bits = 64 * len(PARITY)
    key, times = np.unique(doc * bits + (value >> np.uint64(32)).astype(np.int64) % bits, return_counts=True)
    key = key[times % 2 == 1]
    numbers = np.zeros(rows * len(PARITY), np.uint64)
    np.bitwise_or.at(numbers, key >> 6, np.uint64(1) << (key & 63).astype(np.uint64))
    numbers = numbers.view(np.int64).reshape(rows, len(PARITY))
    return [pa.array(numbers[:, i]) for i in range(len(PARITY))]


def _sketches(doc: np.ndarray, value: np.ndarray, rows: int) -> pa.Array:
    """How many elements of every text's set fall into each of SKETCH bins, modulo 256."""
    counts = np.bincount(doc * SKETCH + (value >> np.uint64(56)).astype(np.int64), minlength=rows * SKETCH).astype(np.uint8)
    return pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer(np.arange(rows + 1, dtype=np.int32) * SKETCH), pa.py_buffer(counts)])


def document_sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, sketch) per row: the set's size, its 128-bit hash and its sketch."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                doc, value = shingle_sets(Words(piece.column("text")), n)
                sizes = np.bincount(doc, minlength=piece.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(sizes.astype(np.int64)), *_identity(doc, value, sizes), _sketches(doc, value, piece.num_rows)],
                    names=["doc_id", "n_shingles", "hi", "lo", "sketch"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, sketch binary")


def _signed(piece: pa.RecordBatch, n: int, num: int, den: int) -> tuple[np.ndarray, list[pa.Array], np.ndarray, np.ndarray]:
    """The sizes and hashes of the sets of a piece's texts, and (text, signature) of all of them."""
    doc, value = shingle_sets(Words(piece.column("text")), n)
    sizes = np.bincount(doc, minlength=piece.num_rows)
    return sizes, _identity(doc, value, sizes), *_signatures(doc, value, sizes, num, den)


def document_signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(doc_id, n_shingles, hi, lo, sigs) per row: the set's size, its 128-bit hash and its signatures."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                sizes, identity, of, sig = _signed(piece, n, num, den)
                order = np.argsort(of, kind="stable")
                offsets = np.concatenate([[0], np.cumsum(np.bincount(of, minlength=piece.num_rows))]).astype(np.int32)
                sigs = pa.ListArray.from_arrays(pa.array(offsets), pa.array(sig[order].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [piece.column("doc_id"), pa.array(sizes.astype(np.int64)), *identity, sigs],
                    names=["doc_id", "n_shingles", "hi", "lo", "sigs"],
                )

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(run, "doc_id long, n_shingles long, hi long, lo long, sigs array<long>")


def _grouped(kind: np.ndarray, sig: np.ndarray, member: np.ndarray, last: bool):
    """Groups of equal signatures: rows (kind, sig, a, b).

    Going in, kind 2 is a member and kind 3 one that stands for a large group of its task. Coming out, kind 0 is a pair of a
    small group and kind 1 a member of a large one; ahead of the shuffle, small groups stay kind 2, and the first member of a
    large one goes on as kind 3.
    """
    order = np.lexsort((-kind, member, sig))
    kind, sig, member = kind[order], sig[order], member[order]
    new = np.ones(len(sig), bool)
    new[1:] = (sig[1:] != sig[:-1]) | (member[1:] != member[:-1])
    kind, sig, member = kind[new], sig[new], member[new]
    starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]])) if len(sig) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(starts, len(sig)))
    size, first = np.repeat(sizes, sizes), np.repeat(starts, sizes)
    place = np.arange(len(sig)) - first
    large = size > PAIRWISE
    if last and len(starts):
        large |= np.repeat(np.maximum.reduceat(kind, starts) == 3, sizes)
    out = [(1, np.flatnonzero(large), None)]
    if last:
        for gap in range(1, PAIRWISE):
            at = np.flatnonzero(~large & (place >= gap))
            out.append((0, at, at - gap))
    else:
        out.append((2, np.flatnonzero(~large), None))
        out.append((3, np.flatnonzero(large & (place == 0)), None))
    for kind_out, at, other in out:
        if len(at):
            yield kind_out, sig[at], member[at], None if other is None else member[other]


_GROUP_SCHEMA = "kind int, sig long, a long, b long"


def _grouping(last: bool):
    """Takes batches (kind, sig, a, b), of which rows of kind 2 and 3 are grouped and the others pass. Behind the shuffle they come sorted."""

    def emit(kind, sig, a, b):
        for i in range(0, len(sig), OUT_ROWS):
            n = min(OUT_ROWS, len(sig) - i)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, kind, np.int32)), pa.array(sig[i : i + n]), pa.array(a[i : i + n]), pa.nulls(n, pa.int64()) if b is None else pa.array(b[i : i + n])],
                names=["kind", "sig", "a", "b"],
            )

    def run(batches):
        held: list[tuple] = []
        count = 0

        def flush(whole: bool):
            nonlocal held, count
            if not count:
                return
            kind, sig, member = (np.concatenate(x) for x in zip(*held))
            cut = len(sig)
            if last and not whole:
                # Sorted by signature: the last one may go on in the next batch. A long group is let go but for one that stands for it.
                cut = int(np.searchsorted(sig, sig[-1]))
            rest = kind[cut:], sig[cut:], member[cut:]
            if len(rest[0]) > BUFFER_ROWS // 2:
                yield from emit(1, rest[1], rest[2], None)
                rest = np.array([3], np.int32), rest[1][:1], rest[2][:1]
            for part in _grouped(kind[:cut], sig[:cut], member[:cut], last):
                yield from emit(*part)
            held, count = ([rest], len(rest[0])) if len(rest[0]) else ([], 0)

        for batch in batches:
            kind = batch.column(0).to_numpy(zero_copy_only=False)
            mine = kind >= 2
            if not mine.all():
                yield batch.filter(pa.array(~mine))
            if mine.any():
                held.append((kind[mine], *(batch.column(i).to_numpy(zero_copy_only=False)[mine] for i in (1, 2))))
                count += len(held[-1][0])
            if count >= BUFFER_ROWS:
                yield from flush(False)
        yield from flush(True)

    return run


def _groups(texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Rows (kind, sig, a, b) of the signatures of all texts (doc_id, text, hi, lo) whose sets have that hash, grouped within each task.

    One function does both, as each that is chained in a stage takes a Python worker of its own.
    """
    grouped = _grouping(last=False)

    def signed(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                sizes, identity, of, sig = _signed(piece, n, num, den)
                mine = sizes > 0
                for found, wanted in zip(identity, ("hi", "lo")):
                    mine &= found.to_numpy() == piece.column(wanted).to_numpy()
                of, sig = of[mine[of]], sig[mine[of]].view(np.int64)
                member = piece.column("doc_id").to_numpy()[of]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(of), 2, np.int32)), pa.array(sig), pa.array(member), pa.nulls(len(of), pa.int64())], names=["kind", "sig", "a", "b"])

    return texts.select("doc_id", "text", "hi", "lo").mapInArrow(lambda batches: grouped(signed(batches)), _GROUP_SCHEMA)


def _possible(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that may be linked, by the sizes and sketches of all rows of ``document_sets``.

    Linked sets differ by at most (den-num)/(den+num) of their sizes' sum. Each element that only one of them has changes one bin
    by one, so that the distances of the bins, also modulo 256, add up to no more than that. No link is lost.
    """

    def run(batches):
        for batch in batches:
            a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, SKETCH) for c in ("sketch_a", "sketch_b"))
            differ = np.minimum(a - b, b - a).sum(axis=1, dtype=np.int64)
            sizes = batch.column("size_a").to_numpy() + batch.column("size_b").to_numpy()
            yield batch.select(["a", "b"]).filter(pa.array((den + num) * differ <= (den - num) * sizes))

    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "doc_id")
    sketches = written(rows.join(small_or_not(wanted), "doc_id", "left_semi").select("doc_id", "n_shingles", "sketch"), "sketches")
    both = pairs
    for side in "ab":
        both = both.join(sketches.select(F.col("doc_id").alias(side), F.col("n_shingles").alias(f"size_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    return both.select("a", "b", "size_a", "size_b", "sketch_a", "sketch_b").mapInArrow(run, "a long, b long").distinct()


def _with_texts(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs with the texts of a and b."""
    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().withColumnRenamed("a", "doc_id")
    texts = written(docs.join(small_or_not(wanted), "doc_id", "left_semi").select("doc_id", "text"), "texts")
    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    return both.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")


def _sets_of(piece: pa.RecordBatch, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, hash, from b, first of two equal ones): the elements of both sets of every row, sorted by row and hash."""
    doc_a, a = shingle_sets(Words(piece.column("text_a")), n)
    doc_b, b = shingle_sets(Words(piece.column("text_b")), n)
    doc, value = np.concatenate([doc_a, doc_b]), np.concatenate([a, b])
    of_b = np.repeat([False, True], [len(a), len(b)])
    order = np.lexsort((value, doc))
    doc, value, of_b = doc[order], value[order], of_b[order]
    twice = np.zeros(len(doc), bool)
    twice[:-1] = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1])
    return doc, value, of_b, twice


def _compared(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, b, linked) of the pairs by their whole texts."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, "text_a", PIECE_BYTES):
                doc, _, _, twice = _sets_of(piece, n)
                shared = np.bincount(doc[twice], minlength=piece.num_rows)
                union = np.bincount(doc, minlength=piece.num_rows) - shared
                linked = (union > 0) & (den * shared >= num * union)
                yield pa.RecordBatch.from_arrays([piece.column("a"), piece.column("b"), pa.array(linked)], names=["a", "b", "linked"])

    return _with_texts(pairs, docs).select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long, linked boolean")


CORE, APART, APART_LONG = range(3)


def _references(hubs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """(ref, elements): what at least two of a group's up to three hubs (ref, a) have in common; of fewer hubs, the first one's set."""
    three = small_or_not(hubs).join(texts.select(F.col("doc_id").alias("a"), "text"), "a").groupBy("ref").agg(F.collect_list("text").alias("hubs"))

    def run(batches):
        for batch in batches:
            for ref, hub_texts in zip(batch.column("ref").to_pylist(), batch.column("hubs").to_pylist()):
                hub_texts = sorted(hub_texts)[:3]
                _, value = shingle_sets(Words(pa.array(hub_texts, pa.large_string())), n)
                found, times = np.unique(value, return_counts=True)
                if len(hub_texts) < 3:
                    _, found = shingle_sets(Words(pa.array(hub_texts[:1], pa.large_string())), n)
                else:
                    found = found[times >= 2]
                yield pa.RecordBatch.from_pylist([{"ref": ref, "elements": found.view(np.int64).tolist()}], schema=pa.schema([("ref", pa.int64()), ("elements", pa.list_(pa.int64()))]))

    return three.mapInArrow(run, "ref long, elements array<long>")


def _edits(members: DataFrame, references: DataFrame, texts: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """(a, ref, size, count, edits, p0, ...): each member's size, the number of elements that only it or its reference has, the first of those, and its parity.

    What the member has and the reference lacks comes first, as others seldom have it too; else by hash. As many are given as any
    comparison needs: (den-num)/num of the size, and one.
    """
    numbers = references.agg(F.sum(F.size("elements") + 1)).first()[0] or 0
    if numbers <= BROADCAST_ROWS:
        references = F.broadcast(references)
    rows = small_or_not(members).join(texts.select(F.col("doc_id").alias("a"), "text"), "a").join(references, "ref")

    def run(batches):
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                doc, value = shingle_sets(Words(piece.column("text")), n)
                size, parity = np.bincount(doc, minlength=piece.num_rows), _parity(doc, value, piece.num_rows)
                lists = piece.column("elements")
                lengths = np.asarray(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
                ref_doc, ref_value = np.repeat(np.arange(len(lengths)), lengths), lists.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                doc, value = np.concatenate([doc, ref_doc]), np.concatenate([value, ref_value])
                of_ref = np.repeat([False, True], [len(doc) - len(ref_doc), len(ref_doc)])
                order = np.lexsort((value, doc))
                doc, value, of_ref = doc[order], value[order], of_ref[order]
                same = (doc[1:] == doc[:-1]) & (value[1:] == value[:-1])
                once = np.ones(len(doc), bool)
                once[1:] &= ~same
                once[:-1] &= ~same
                doc, value, of_ref = doc[once], value[once], of_ref[once]
                count = np.bincount(doc, minlength=piece.num_rows)
                order = np.lexsort((value, of_ref, doc))
                doc, value = doc[order], value[order]
                place = np.arange(len(doc)) - np.concatenate([[0], np.cumsum(count)[:-1]])[doc]
                first = place <= ((den - num) * size // num)[doc]
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[first], minlength=piece.num_rows))]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [piece.column("a"), piece.column("ref"), pa.array(size), pa.array(count), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value[first].view(np.int64))), *parity],
                    names=["a", "ref", "size", "count", "edits", *PARITY],
                )

    return rows.select("a", "ref", "text", "elements").mapInArrow(run, "a long, ref long, size long, count long, edits array<long>, " + ", ".join(f"{p} long" for p in PARITY))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _pairs_within(groups: DataFrame, condition: str) -> DataFrame:
    """Pairs of members x and y of the same group (sig, a, ...) under a condition on their columns, a > b; once for each group."""
    # Both sides are the same plan, which Spark deals out once.
    return groups.alias("x").join(groups.alias("y"), F.expr(f"x.sig = y.sig and x.a > y.a and {condition}")).select("x.a", F.col("y.a").alias("b"))


def _links_of_large(members: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """Links and pairs still to be compared (a, b), which join all members (sig, a) of large groups that are linked, directly or by way of others.

    Each group gets a reference set R, here what most of three members that are in many groups have in common; any set would be
    right. Let e(x) be the elements that only one of x and R has, q = (den-num)/(den+num), and x's slack q|x| - |e(x)|. Two sets
    are linked when they differ by at most q(|x|+|y|) elements, and they differ by |e(x)| + |e(y)| - 2t, where t is what e(x) and
    e(y) share. So members whose slacks add up to 0 or more are linked; then each of them is linked with the member h of the
    greatest slack, too. Linking h with all of its kind (the core) thus joins all of those. Of other pairs one at least is not
    core, and they are linked only if t is at least -(slack + slack) / 2 > 0. So in any common order some element is among the
    first |e|-t+1 of both, which gives new, much smaller groups. Bounds of t for all partners of a member: t exceeds
    (slack(h) - slack(x)) / 2 for a core x, and for an apart x with an apart partner; with a core partner it is at least
    -(slack(x) + slack(h)) / 2; and as the partner's e has t elements, it is at least |e(x)| - (den-num)/num |x| in any case.

    Members that share such an element still mostly differ by too much. The bits in which their parities differ are no more than the
    elements in which they do, so a pair with more such bits than a link allows is left out within the join.
    """
    links, unsure, texts = [], [], None
    total = den + num
    for depth in range(DEPTH + 1):
        if members.isEmpty():
            break
        if depth == DEPTH:
            unsure.append(_pairs_within(members, "true"))
            break
        # A member is in no more groups than its set has signatures or elements.
        counted = members.withColumn("degree", F.count("*").over(Window.partitionBy("a")))
        best = counted.groupBy("sig").agg(F.max(F.struct("degree", (-F.col("a")).alias("minus"))).alias("best"))
        best = small_or_not(written(best.select("sig", (-F.col("best.minus")).alias("ref"), F.col("best.degree").alias("top")), "best"))
        if depth == 0:
            # Groups that overlap are of one family, which needs one reference: that of a group in which their own one is, if it
            # is in more groups. (Later groups are parts of families, which need references of their own.)
            for _ in range(2):
                higher = members.join(best, "sig").groupBy("a").agg(F.max(F.struct("top", (-F.col("ref")).alias("minus"))).alias("higher"))
                higher = higher.select(F.col("a").alias("ref"), F.col("higher.top").alias("_top"), (-F.col("higher.minus")).alias("_ref"))
                best = small_or_not(written(higher.join(best, "ref").select("sig", F.col("_ref").alias("ref"), F.col("_top").alias("top")), "best"))
        stars = written(members.join(best, "sig").groupBy("a", "ref").agg(F.count("*").alias("shared")), "stars")
        ranked = stars.withColumn("_rank", F.row_number().over(Window.partitionBy("ref").orderBy(F.desc("shared"), "a"))).where("_rank <= 3")
        if texts is None:
            # Later rounds have some of the first one's members.
            wanted = stars.select(F.col("a").alias("doc_id"))
            texts = written(docs.join(small_or_not(wanted), "doc_id", "left_semi").select("doc_id", "text").dropDuplicates(["doc_id"]), "texts")
        references = written(_references(written(ranked.select("ref", "a"), "hubs"), texts, n), "references")
        edits = written(_edits(stars.select("a", "ref"), references, texts, n, num, den), "edits")
        slack = F.expr(f"{den - num} * size - {total} * count")
        hubs = edits.groupBy("ref").agg(F.max(F.struct(slack.alias("slack"), (-F.col("a")).alias("minus"))).alias("hub"), F.min(slack).alias("least"))
        hubs = small_or_not(written(hubs.select("ref", F.col("hub.slack").alias("top"), (-F.col("hub.minus")).alias("h"), "least"), "hubs"))
        judged = edits.join(hubs, "ref").withColumn("slack", slack)
        links.append(judged.where("slack + top >= 0 and a <> h").select("a", F.col("h").alias("b")))
        apart = F.col("slack") + F.col("top") < 0
        least_t = F.expr(f"count - ({den - num} * size) div {num}")
        t_short = F.greatest(F.lit(1), F.floor((F.col("top") - F.col("slack")) / (2 * total)) + 1, F.when(apart, least_t).otherwise(1))
        t_long = F.greatest(F.lit(1), F.ceil((-F.col("slack") - F.col("top")) / (2 * total)), least_t)
        judged = judged.where("least + top < 0").withColumn("short", F.col("count") - t_short + 1).withColumn("long", F.when(apart, F.col("count") - t_long + 1).otherwise(0))
        first = judged.withColumn("edits", F.slice("edits", F.lit(1), F.greatest(F.lit(0), F.col("short"), F.col("long")).cast("int")))
        signs = first.select("a", "ref", apart.alias("apart"), "short", "count", "size", "slack", F.posexplode("edits").alias("place", "element"))
        role = F.when(~F.col("apart"), CORE).when(F.col("place") < F.col("short"), APART).otherwise(APART_LONG)
        rest = F.col("count") - F.col("place")
        signs = signs.select(F.xxhash64("ref", "element").alias("sig"), "a", "ref", role.alias("role"), rest.alias("rest"), "size", "slack")
        groups = signs.groupBy("sig").agg(F.count("*").alias("members"), F.max("role").alias("_role")).where(f"members > 1 and _role > {CORE}").drop("_role")
        groups = written(signs.join(groups, "sig"), "groups")
        # The first element that two members share is followed by t - 1 more in both.
        could = f"(x.role = {APART} and y.role = {APART} or (x.role = {CORE}) <> (y.role = {CORE})) and {2 * total} * least(x.rest, y.rest) >= -(x.slack + y.slack)"
        differ = " + ".join(f"bit_count(x.{p} ^ y.{p})" for p in PARITY)
        most = REGROUPED * 4**depth
        # Most elements are in no group, so that parities join only what is left.
        parities = small_or_not(edits.select("a", "ref", *PARITY), BROADCAST_ROWS // len(PARITY))
        unsure.append(_pairs_within(groups.where(F.col("members") <= most).join(parities, ["a", "ref"]), f"{could} and {total} * ({differ}) <= {den - num} * (x.size + y.size)"))
        members = groups.where(F.col("members") > most).select("sig", "a")
    return links, unsure


def linked(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: documents joined by chains of similar texts.

    Two texts are linked when ``den`` times the size of the intersection of their sets of n-word shingles (lower-cased, words
    between white space; fewer words are one shingle) is at least ``num`` times that of the union. A text without words is
    linked with nothing. Rows that share a doc_id are one document, linked with whatever any of them is; a row without
    doc_id gets its n_shingles and no component. Equal texts, ties and repeated rows change nothing else; other columns are ignored.

    Equal sets become one before any pair is formed. Signatures are not stored: they are made of the texts as they are dealt out.
    Only pairs whose sketches allow a link are compared by their texts. Groups of up to eight sets that share a signature are compared pair by pair,
    larger ones by way of a reference set (``_links_of_large``). Ahead of the shuffle each task lets the members of its own large groups
    go past the grouping, but for one that stands for them; so no task ever has to take in a whole large group.
    """
    spark = prepared(docs.sparkSession)
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    rows = written(document_sets(texts, n), "sets")
    full = rows.where("doc_id is not null and n_shingles > 0")
    firsts = written(full.groupBy("hi", "lo").agg(F.min("doc_id").alias("a")), "firsts")
    own = texts.where("doc_id is not null").join(small_or_not(firsts.withColumnRenamed("a", "doc_id")), "doc_id")
    salt = F.when(F.col("kind") >= 2, F.lit(0)).otherwise(F.pmod(F.xxhash64("a"), F.lit(64)))
    dealt = _groups(own, n, num, den).repartition("sig", salt).sortWithinPartitions("sig", "a")
    groups = written(dealt.mapInArrow(_grouping(last=True), _GROUP_SCHEMA), "groups")
    same = full.select("doc_id", "hi", "lo").join(firsts, ["hi", "lo"]).select("doc_id", F.col("a").alias("b")).withColumnRenamed("doc_id", "a")
    pairs = groups.where("kind = 0").select("a", "b")
    large = written(groups.where("kind = 1").select("sig", "a").distinct(), "large")
    links, unsure = _links_of_large(large, texts, n, num, den)
    for more in unsure:
        pairs = pairs.unionByName(more)
    possible = written(_possible(written(_ordered(pairs), "pairs"), rows, num, den), "possible")
    whole = _compared(possible, texts, n, num, den).where("linked").select("a", "b")
    for more in [same.where("a <> b"), *links]:
        whole = whole.unionByName(more)
    labels = graph.components(whole).select(F.col("id").alias("doc_id"), "component")
    return rows.select("doc_id", "n_shingles").join(labels, "doc_id", "left").select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int = 5, num: int = 8, den: int = 10) -> DataFrame:
    """Of each group of linked documents the one with the smallest id, in one row; rows without an id stay."""
    found = linked(docs, n, num, den)
    kept = written(found.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("rows")), "kept")
    key = fresh(docs, "_kept")
    chosen = docs.join(small_or_not(kept.select(F.col("doc_id").alias(key))), F.col("doc_id").cast("bigint") == F.col(key), "left_semi")
    if not kept.where("rows > 1").isEmpty():
        chosen = chosen.dropDuplicates(["doc_id"])
    return chosen.unionByName(docs.where(F.col("doc_id").cast("bigint").isNull()))
