"""Toxicity of restored text: words and beginnings of words that labels single out, weighed and calibrated.

Texts first go through the noisy channel (``channel.py``). A word's features are itself and its first 3 to 7 letters, hashed. A
feature's weight is the lower confidence bound of its log odds between toxic and clean texts; a word counts with its best
feature, so that inflected and compound forms are recognised by their stem. A beginning is a stem only if several words bear it
out: the most frequent of them is left out of its toxic texts. A document's evidence are its three heaviest words
and how many weigh anything; a logistic regression turns that into a probability. The regression is fitted on texts weighed by
the other half of the sample, so that it does not trust what a half has by chance.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from footprints.llm import channel
from footprints.llm.storage import prepared, written
from footprints.llm.text import mix, pieces, powers

# The classifier is fitted on about so many different texts of each label.
TRAIN_TEXTS = 6_000
# Weights that are kept: 16 bytes each.
FEATURES = 50_000
PREFIXES = (3, 4, 5, 6, 7)
_Z = 1.64
_LEAST = 1.0
TOP = 3
_EVIDENCE = TOP + 2


@dataclass
class Model:
    letters: channel.Letters
    feature: np.ndarray  # sorted hashes
    weight: np.ndarray
    coefficients: np.ndarray  # of 1 and the evidence
    prior: float | None = None  # the score of every text where labels do not tell anything apart


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all runs of letters: the text and the number of its word; of all different words: the features, and which features there are.

    A word's features are one row: its own hash, then those of its beginnings that are shorter than it or as long.
    """
    points, at = channel.codes(texts)
    start, end = channel.runs(channel.is_letter(points), at)
    text = np.searchsorted(at, start, "right") - 1
    up, down = powers(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[: len(points)], out=sums[1:])

    def hashed(begin, stop, salt):
        return mix((sums[stop] - sums[begin]) * down[begin] + (stop - begin).astype(np.uint64) * np.uint64(2) + np.uint64(salt)).view(np.int64)

    word, index, place = np.unique(hashed(start, end, 1), return_index=True, return_inverse=True)
    begin, size = start[index], end[index] - start[index]
    features = np.zeros((len(word), 1 + len(PREFIXES)), np.int64)
    features[:, 0] = word
    there = np.ones(features.shape, bool)
    for i, p in enumerate(PREFIXES):
        there[:, i + 1] = size >= p
        of = np.flatnonzero(size >= p)
        features[of, i + 1] = hashed(begin[of], begin[of] + p, 0)
    return text, place, features, there


def _evidence(texts: list[str], feature: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """By text: the weights of its three heaviest different words, and the logarithms of 1 + the number and 1 + the per mille of words with a weight."""
    out = np.zeros((len(texts), _EVIDENCE))
    text, place, hashes, there = _words(texts)
    if not len(text) or not len(feature):
        return out
    at = np.minimum(np.searchsorted(feature, hashes), len(feature) - 1)
    heaviest = np.where(there & (feature[at] == hashes), weight[at], 0.0).max(axis=1)
    heavy = heaviest[place] > 0
    n = np.bincount(text[heavy], minlength=len(texts))
    words = np.bincount(text, minlength=len(texts))
    out[:, TOP], out[:, TOP + 1] = np.log1p(n), np.log1p(1000.0 * n / np.maximum(words, 1))
    pair = np.unique(text[heavy].astype(np.int64) << 32 | place[heavy])
    t, w = pair >> 32, heaviest[pair & 0xFFFFFFFF]
    order = np.lexsort((-w, t))
    t, w = t[order], w[order]
    rank = np.arange(len(t)) - np.searchsorted(t, t)
    top = rank < TOP
    out[t[top], rank[top]] = w[top]
    return out


def _sample(docs: DataFrame, labels: DataFrame, train_texts: int) -> DataFrame:
    """(text, toxic, half) of about ``train_texts`` different texts of each label, chosen by hash; a text with both labels is toxic."""
    marked = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    hashed = docs.where("text is not null and text <> ''").select("doc_id", F.xxhash64("text").alias("h"))
    # Copies of a text are one: only numbers are grouped, the texts are fetched afterwards.
    distinct = written(hashed.join(marked, "doc_id").groupBy("h").agg(F.max("toxic").alias("toxic"), F.min("doc_id").alias("doc_id")), "labelled")
    sizes = {r["toxic"]: r["n"] for r in distinct.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = F.when(F.col("toxic") == 1, train_texts / sizes.get(1, 1)).otherwise(train_texts / sizes.get(0, 1))
    chosen = distinct.where(F.pmod(F.xxhash64("h"), F.lit(1 << 30)) < share * (1 << 30))
    half = F.pmod(F.col("h"), F.lit(2)).cast("int").alias("half")
    # About 2 * train_texts rows of three numbers.
    chosen = F.broadcast(chosen.select("doc_id", "h", "toxic", half))
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(chosen, ["doc_id", "h"])
    return written(texts.select("text", "toxic", "half"), "sample")


def _weights(counts: DataFrame, totals: dict[tuple[int, int], int], halves: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted features and weights, from the texts of these halves."""
    n = {y: sum(totals.get((h, y), 0) for h in halves) for y in (0, 1)}
    own = {y: sum((F.col(f"n{h}{y}") for h in halves), F.lit(0)) for y in (0, 1)}
    words = counts.select("f", own[0].alias("clean"), own[1].alias("toxic"), "prefixes")
    stems = words.select(F.explode("prefixes").alias("f"), "clean", "toxic").groupBy("f").agg(F.sum("clean").alias("clean"), (F.sum("toxic") - F.max("toxic")).alias("toxic"))
    both = words.select("f", "clean", "toxic").unionByName(stems)
    k = {y: F.least(F.col(name), F.lit(n[y])) + 0.5 for y, name in enumerate(("clean", "toxic"))}
    odds = F.log(k[1] / (n[1] + 1.0)) - F.log(k[0] / (n[0] + 1.0)) - _Z * F.sqrt(1.0 / k[1] + 1.0 / k[0])
    found = both.select("f", odds.alias("w")).where(F.col("w") > _LEAST).orderBy(F.desc("w"), "f").limit(FEATURES).toPandas().sort_values("f")
    return found["f"].to_numpy(np.int64), found["w"].to_numpy(float)


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Coefficients by Newton's method; columns as they are, with a constant first that is not shrunk."""
    x = np.column_stack([np.ones(len(x)), x])
    b = np.zeros(x.shape[1])
    penalty = np.diag([1e-3] + [ridge] * (x.shape[1] - 1))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ b)
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    return b


def train(docs: DataFrame, labels: DataFrame, corpus: DataFrame, train_texts: int = TRAIN_TEXTS) -> Model:
    """Learns labels from ``docs`` joined with ``labels`` (doc_id, toxic), and characters from all texts of ``corpus``, without labels.

    The driver gets the letters' pairs, FEATURES weights three times and the evidence of about 2 * train_texts texts. Null labels
    count as none, a document with several labels is toxic if one says so. With texts of one label only, every score is that
    label; without any, 0.
    """
    prepared(docs.sparkSession)
    letters = channel.learn(corpus)
    sample = _sample(docs, labels, train_texts)
    totals = {(r["half"], r["toxic"]): r["n"] for r in sample.groupBy("half", "toxic").agg(F.count("*").alias("n")).collect()}
    seen = {y for _, y in totals}
    nothing = np.zeros(0, np.int64), np.zeros(0)
    if seen != {0, 1}:
        return Model(letters, *nothing, np.zeros(_EVIDENCE + 1), float(1 in seen))

    def clean(batches):
        for batch in batches:
            for piece in pieces(batch):
                texts = channel.restored(piece.column("text").to_pylist(), letters)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()), piece.column("toxic"), piece.column("half")], names=["text", "toxic", "half"])

    plain = written(sample.mapInArrow(clean, "text string, toxic int, half int"), "restored")

    def count(batches):
        for batch in batches:
            for piece in pieces(batch):
                text, place, features, there = _words(piece.column("text").to_pylist())
                kind = piece.column("half").to_numpy() * 2 + piece.column("toxic").to_numpy()
                once = np.unique(place.astype(np.int64) << 32 | text)
                table = np.bincount((once >> 32) * 4 + kind[once & 0xFFFFFFFF], minlength=4 * len(features)).reshape(-1, 4).astype(np.int64)
                offsets = np.concatenate([[0], np.cumsum(there[:, 1:].sum(axis=1))]).astype(np.int32)
                prefixes = pa.ListArray.from_arrays(pa.array(offsets), pa.array(features[:, 1:][there[:, 1:]]))
                yield pa.RecordBatch.from_arrays([pa.array(features[:, 0]), prefixes, *(pa.array(table[:, i]) for i in range(4))], names=["f", "prefixes", *names])

    names = ["n00", "n01", "n10", "n11"]
    counts = plain.mapInArrow(count, "f long, prefixes array<long>, " + ", ".join(f"{n} long" for n in names))
    counts = written(counts.groupBy("f", "prefixes").agg(*[F.sum(n).alias(n) for n in names]), "words")
    tables = [_weights(counts, totals, (1,)), _weights(counts, totals, (0,))]

    def weigh(batches):
        for batch in batches:
            for piece in pieces(batch):
                texts, half = piece.column("text").to_pylist(), piece.column("half").to_numpy()
                found = np.where((half == 0)[:, None], _evidence(texts, *tables[0]), _evidence(texts, *tables[1]))
                yield pa.RecordBatch.from_arrays([piece.column("toxic"), *(pa.array(found[:, i]) for i in range(_EVIDENCE))], names=["toxic", *(f"e{i}" for i in range(_EVIDENCE))])

    weighed = plain.mapInArrow(weigh, "toxic int, " + ", ".join(f"e{i} double" for i in range(_EVIDENCE))).toPandas()
    fitted = _logistic(weighed.drop(columns="toxic").to_numpy(float), weighed["toxic"].to_numpy(float))
    return Model(letters, *_weights(counts, totals, (0, 1)), fitted)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with score and predicted (1 from 0.5 on), in the place of such columns of theirs.

    Only the text decides, all of it; equal texts get equal scores. Null and empty texts, and those without letters, have the
    score of a text without evidence.
    """
    spark = prepared(docs.sparkSession)
    docs = docs.drop("score", "predicted")
    shared = spark.sparkContext.broadcast(model)
    names = docs.columns

    def run(batches):
        model = shared.value
        for batch in batches:
            for piece in pieces(batch):
                texts = [t or "" for t in piece.column("text").to_pylist()]
                found = _evidence(channel.restored(texts, model.letters), model.feature, model.weight)
                p = 1 / (1 + np.exp(-np.clip(model.coefficients[0] + found @ model.coefficients[1:], -30, 30)))
                if model.prior is not None:
                    p = np.full(len(texts), model.prior)
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in names), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=[*names, "score", "predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    return docs.mapInArrow(run, schema)
