"""Risk-controlled quality rules: cutoffs that are known to reject few good documents.

For every stratum (language) and rule, cutoffs are tried from the mildest to the strictest. A cutoff is accepted while an exact
binomial test on all labelled good documents rules out, at its level, that it rejects more than the rule's share of good ones.
Trying in a fixed order and stopping at the first failure needs no correction within a rule; across strata and rules the level
is divided by their number (Bonferroni), and the allowed false rejections are divided among the rules. So with probability
1 - delta, in no stratum more than alpha of the good documents are rejected by all rules together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footprints.llm.storage import prepared, written
from footprints.llm.text import Words, grams, line_breaks, pieces

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
ALPHA = 0.05
DELTA = 0.05
# Each rule rejects values above the cutoff; cutoffs from the mildest to the strictest.
RULES = {
    "symbol_ratio": [2.0, 1.5, 1.0, 0.8, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1, 0.05],
    "dup_line_ratio": [0.9, 0.8, 0.7, 0.6, 0.5, 0.4, 0.3, 0.2, 0.15, 0.1],
    "repeat_ratio": [0.28, 0.25, 0.22, 0.2, 0.18, 0.15, 0.12, 0.1, 0.08, 0.05],
    "word_chars_high": [40.0, 30.0, 25.0, 20.0, 16.0, 14.0, 12.0, 11.0, 10.0, 9.0],
    "word_chars_low": [-1.5, -2.0, -2.5, -3.0, -3.5, -4.0],
}
# Strata are languages; more labelled ones than this mean that the column is no language.
MAX_STRATA = 1_000
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words) of every row's whole text; a null text has none of them."""

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                texts = piece.column("text")
                rows = piece.num_rows
                words = Words(texts, lower=False)
                data, at = words.data, words.at
                of_byte = lambda mask: np.add.reduceat(np.append(mask, False).astype(np.int64), at[:-1]) * (np.diff(at) > 0) if rows else np.zeros(0, np.int64)
                lead = (data & 0xC0) != 0x80  # first bytes of characters
                blank = np.zeros(256, bool)
                blank[[9, 10, 11, 12, 13, 32]] = True
                runs = grams(words.hash, WINDOW)
                inside = words.doc[: len(runs)] == words.doc[WINDOW - 1 :] if len(runs) else np.zeros(0, bool)
                begin = np.flatnonzero(inside)
                doc, value = words.doc[begin], runs[begin]
                order = np.lexsort((value, doc))
                same = np.zeros(len(order), bool)
                equal = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
                same[1:] |= equal
                same[:-1] |= equal
                twice = begin[order][same]
                cover = np.bincount(twice, minlength=len(words.hash) + 1) - np.bincount(twice + WINDOW, minlength=len(words.hash) + 1)[: len(words.hash) + 1]
                covered = np.cumsum(cover)[: len(words.hash)] > 0
                breaks, of = line_breaks(data, at)
                lines = Words(texts, lower=False, breaks=breaks)
                # The whole line counts, white space included: its hash goes over all bytes but the \n that ends it.
                line_hash = _line_hashes(data, breaks, of)
                with_word = np.flatnonzero(lines.counts > 0)
                owner, text = of[with_word], line_hash[with_word]
                order = np.lexsort((text[:, 1], text[:, 0], owner))
                again = (owner[order][1:] == owner[order][:-1]) & (text[order][1:] == text[order][:-1]).all(axis=1)
                yield pa.RecordBatch.from_arrays(
                    [
                        piece.column("doc_id"), piece.column("lang"), pa.array(words.counts.astype(np.int64)), pa.array(of_byte(lead & ~blank[data])),
                        pa.array(of_byte(_SYMBOL[data])), pa.array(np.bincount(owner, minlength=rows).astype(np.int64)),
                        pa.array(np.bincount(owner[order][1:][again], minlength=rows).astype(np.int64)),
                        pa.array(np.bincount(words.doc[covered], minlength=rows).astype(np.int64)),
                    ],
                    names=["doc_id", "lang", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"],
                )

    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), lang.alias("lang"), "text")
    return chosen.mapInArrow(run, "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_lines long, n_dup_lines long, n_repeat_words long")


def _line_hashes(data: np.ndarray, breaks: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Two hashes of every line's bytes, without the \\n at its end."""
    from footprints.llm.text import _BYTE, mix, powers

    up, down = powers(len(data) + 1)
    begin, end = breaks[:-1], breaks[1:].copy()
    ends_line = (end > begin) & (data[np.maximum(end - 1, 0)] == 10) if len(data) else np.zeros(len(begin), bool)
    end = end - ends_line
    out = []
    for table in (_BYTE, mix(_BYTE)):
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(table[data] * up[: len(data)], out=sums[1:])
        out.append(mix((sums[end] - sums[begin]) * down[begin] + (end - begin).astype(np.uint64)))
    return np.stack(out, axis=1)


def with_rules(found: DataFrame) -> DataFrame:
    """Adds base_failed and the values that the rules look at; without words they are 0."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return (
        found.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
        .withColumn("symbol_ratio", F.col("n_symbols") / words)
        .withColumn("dup_line_ratio", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))
        .withColumn("repeat_ratio", F.col("n_repeat_words") / words)
        .withColumn("word_chars_high", F.col("word_chars") / words)
        .withColumn("word_chars_low", -F.col("word_chars") / words)
    )


def binomial_tail(k: int, n: int, p: float) -> float:
    """P(X <= k) for X of n trials with probability p, summed from the largest term downwards; exact to rounding."""
    if k >= n:
        return 1.0
    # For k over the mean the answer is near 1/2 or more: no test passes there.
    log_term = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    total, term = 0.0, 1.0
    for i in range(k, -1, -1):
        total += term
        if term < 1e-17 * total:
            break
        term *= i / (n - i + 1) * (1 - p) / p
    return min(1.0, math.exp(log_term) * total)


def choose(table: dict[tuple[str, str], tuple[int, list[int]]], alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """Cutoffs by (stratum, rule) from (good documents, those rejected at each cutoff); a rule without an accepted one is missing."""
    level, share = delta / max(1, len(table)), alpha / len(RULES)
    chosen = {}
    for (stratum, rule), (n, rejected) in table.items():
        for cutoff, k in zip(RULES[rule], rejected):
            if n == 0 or k > n * share or binomial_tail(k, n, share) > level:
                break
            chosen[stratum, rule] = cutoff
    return chosen


def calibrated(found: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[tuple[str, str], float]:
    """Cutoffs from all good labelled documents that pass the base rules; one row a stratum reaches the driver.

    A document with several labels is good if all of them say so.
    """
    good = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.min("quality").alias("quality")).where("quality = 1").select("doc_id")
    held = found.where("not base_failed").join(good, "doc_id")
    rejected = [F.sum((F.col(rule) > cutoff).cast("bigint")).alias(f"{rule}_{i}") for rule, cutoffs in RULES.items() for i, cutoff in enumerate(cutoffs)]
    rows = held.groupBy(F.coalesce("lang", F.lit("")).alias("lang")).agg(F.count("*").alias("n"), *rejected).limit(MAX_STRATA + 1).collect()
    if len(rows) > MAX_STRATA:
        raise ValueError("too many strata")
    table = {(r["lang"], rule): (r["n"], [r[f"{rule}_{i}"] for i in range(len(cutoffs))]) for r in rows for rule, cutoffs in RULES.items()}
    return choose(table, alpha, delta)


def judged(docs: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The counts of every row with base_failed, rejected_by (the rules that reject it) and kept.

    Strata are the values of ``lang``, null being one of its own; one without labels has no cutoffs and rejects nothing beyond
    the base rules. Null and empty texts have no words and fail the base. Equal rows get equal verdicts. Without labels at all,
    only the base rules decide.
    """
    spark = prepared(docs.sparkSession)
    found = written(with_rules(counts(docs)), "quality")
    cutoffs = calibrated(found, labels, alpha, delta)
    stratum = F.coalesce("lang", F.lit(""))
    hits = []
    for rule in RULES:
        pairs = [x for (lang, name), cutoff in cutoffs.items() if name == rule for x in (F.lit(lang), F.lit(cutoff))]
        if pairs:
            hits.append(F.when(F.col(rule) > F.try_element_at(F.create_map(*pairs), stratum), F.lit(rule)))
    rejected = F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")
    return found.withColumn("rejected_by", rejected).withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))
