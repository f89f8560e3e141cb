"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from footprints.llm.storage import fresh, prepared, small_or_not, written
from footprints.llm.text import pieces

ORDERS = (1, 2, 3)
# Log probabilities of all languages together: 16 MB at most.
MODEL_CELLS = 1 << 22
BITS = 16
# About so many different texts of each language are learned from.
TRAIN_TEXTS = 5_000
SMOOTHING = 0.5
# N-grams of three orders take some 150 bytes a character while they are counted, which a Python worker keeps for the steps behind.
PIECE_BYTES = 1 << 17
UNKNOWN = "und"
_LETTER = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])


def _features(texts: list[str | None], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashed n-gram, text) of all texts, by text: lower case, each run of other characters than letters one blank."""
    lowered = [t.lower() if t else "" for t in texts]
    chars = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(lowered)), [len(t) for t in lowered])
    chars = np.where(_LETTER[chars], chars, np.uint32(32))
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32) | (doc[1:] != doc[:-1])
    chars, doc = chars[keep], doc[keep]
    grams, owners = [], []
    for n in ORDERS:
        size = max(0, len(chars) - n + 1)
        value = np.full(size, (0x9E3779B9 * n) % (1 << 32), np.uint32)
        for i in range(n):
            value = (value ^ chars[i : i + size]) * np.uint32(0x85EBCA6B)
            value ^= value >> np.uint32(13)
        inside = doc[:size] == doc[n - 1 : n - 1 + size]
        grams.append(((value * np.uint32(0xC2B2AE35)) >> np.uint32(32 - bits))[inside])
        owners.append(doc[:size][inside])
    doc = np.concatenate(owners)
    order = np.argsort(doc, kind="stable")
    return np.concatenate(grams)[order].astype(np.int64), doc[order]


@dataclass
class Model:
    languages: list[str]
    bits: int
    log_prior: np.ndarray
    log_prob: np.ndarray  # (2^bits, languages)

    def score(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The best language's number and its posterior probability, for each text."""
        gram, doc = _features(texts, self.bits)
        total = np.tile(self.log_prior, (len(texts), 1))
        if len(gram):
            # A text's n-grams as sparse counts: each different one is looked up once.
            pair, count = np.unique((doc << self.bits) | gram, return_counts=True)
            owner = pair >> self.bits
            first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            rows = self.log_prob[pair & ((1 << self.bits) - 1)] * count[:, None]
            total[owner[first]] += np.add.reduceat(rows, first, axis=0)
        best = total.argmax(axis=1)
        top = total[np.arange(len(texts)), best]
        return best, 1.0 / np.exp(total - top[:, None]).sum(axis=1)


def train(docs: DataFrame, train_texts: int = TRAIN_TEXTS) -> Model:
    """Learns from texts with a language: about ``train_texts`` different ones of each, chosen by the text's hash.

    N-grams are counted in the tasks and summed by language and n-gram before they reach the driver, which gets at most
    MODEL_CELLS numbers.
    """
    prepared(docs.sparkSession)
    key = F.col("doc_id") if "doc_id" in docs.columns else F.lit(0)
    labelled = docs.where("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"), key.alias("key"))
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], BITS, np.zeros(0), np.zeros((1 << BITS, 0)))
    bits = min(BITS, int(math.log2(MODEL_CELLS / len(languages))))
    if bits < 8:
        raise ValueError(f"{len(languages)} languages are too many for one model")
    number = {lang: i for i, lang in enumerate(languages)}
    share = F.element_at(F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, train_texts / n)))]), F.col("lang"))
    # One row of each text and language, found by numbers alone; only its text is fetched. What repeats a row exactly goes last.
    firsts = labelled.where(F.pmod("h", F.lit(1 << 30)) < share * (1 << 30)).groupBy("lang", "h").agg(F.min("key").alias("_key"))
    chosen = labelled.join(small_or_not(written(firsts, "chosen")), ["lang", "h"]).where(F.col("key").eqNullSafe(F.col("_key"))).dropDuplicates(["lang", "h"])

    def run(batches):
        counts = np.zeros((len(languages), 1 << bits), np.int64)
        texts_seen = np.zeros(len(languages), np.int64)
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                of = np.array([number[lang] for lang in piece.column("lang").to_pylist()], np.int64)
                gram, doc = _features(piece.column("text").to_pylist(), bits)
                counts += np.bincount((of[doc] << bits) | gram, minlength=counts.size).reshape(counts.shape)
                texts_seen += np.bincount(of, minlength=len(languages))
        lang, gram = np.nonzero(counts)
        # n-gram -1 stands for the number of texts.
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(lang, np.arange(len(languages)))), pa.array(np.append(gram, np.full(len(languages), -1))), pa.array(np.append(counts[lang, gram], texts_seen))],
            names=["lang", "gram", "n"],
        )

    summed = chosen.select("text", "lang").mapInArrow(run, "lang long, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((1 << bits, len(languages)))
    of_text = summed["gram"] < 0
    counts[summed["gram"][~of_text], summed["lang"][~of_text]] = summed["n"][~of_text]
    seen = np.zeros(len(languages))
    seen[summed["lang"][of_text]] = summed["n"][of_text]
    log_prob = np.log((counts + SMOOTHING) / (counts.sum(axis=0) + SMOOTHING * (1 << bits)))
    return Model(languages, bits, np.log((seen + 1) / (seen.sum() + len(seen))), log_prob)


def identify(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """The documents with lang_pred and score, the posterior probability of that language; such columns of theirs are replaced.

    A text without any letter, an empty or a null one is ``und`` with score 0, as is every text if nothing was learned. Only
    the text decides; repeated rows get the same answer. Of equally likely languages the first by name is taken.
    """
    spark = prepared(docs.sparkSession)
    docs = docs.drop(*names)
    shared = spark.sparkContext.broadcast(model)
    own = docs.columns

    def run(batches):
        model = shared.value
        for batch in batches:
            for piece in pieces(batch, limit=PIECE_BYTES):
                texts = piece.column("text").to_pylist()
                lettered = np.array([t is not None and any(map(str.isalpha, t)) for t in texts], bool) & bool(model.languages)
                lang, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
                if lettered.any():
                    best, p = model.score([t for t, ok in zip(texts, lettered) if ok])
                    lang[lettered], score[lettered] = np.array(model.languages, object)[best], p
                yield pa.RecordBatch.from_arrays([*(piece.column(c) for c in own), pa.array(lang, pa.string()), pa.array(score)], names=[*own, *names])
        pa.default_memory_pool().release_unused()

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def in_language(docs: DataFrame, min_score: float = 0.5) -> DataFrame:
    """The documents whose language is recognised with a score of ``min_score`` at least, with their own columns."""
    known, score = fresh(docs, "_lang_pred"), fresh(docs, "_score")
    found = identify(docs, train(docs), (known, score))
    return found.where((F.col(known) != UNKNOWN) & (F.col(score) >= min_score)).select(*docs.columns)
