"""Noisy channel for obfuscated words: character lattices decoded by Viterbi under a character language model.

A written sign may stand for a letter (``1d10t``), separate the letters of one word (``i d i o t``, ``i.d.i.o.t``) or repeat
the letter before it (``idiooot``). Only words with such a sign get a lattice; all others have one reading, themselves. Words
of about equal length advance together: the score of every last symbol is one row of a matrix, and the best predecessor of
each is kept for the way back.
"""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from footprints.llm.storage import prepared, written
from footprints.llm.text import pieces

# What signs may be read as.
READINGS = {
    "0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "*": "aeiou",
}
# Signs that may stand between the letters of one word; a blank only between single letters.
SEPARATORS = ".-_~/"
# Signs that are most often punctuation: not a letter at the end of a word.
_CLOSING = "!|(*+"
# Log probabilities of the channel.
READ, KEPT, SEPARATED, DROPPED_REPEAT, KEPT_REPEAT = -1.5, -0.5, -2.0, -0.1, -2.5
JOINED, APART = -0.5, -2.5  # single characters with blanks between them: one word, or several
LETTERS = 62
BOUNDARY, OTHER = 0, 1
_SYMBOLS = LETTERS + 2
_NEVER = np.float32(-1e9)
_CELLS = 1 << 19  # characters of a batch of lattices
_IS_LETTER = np.array([chr(c).isalpha() for c in range(sys.maxunicode + 1)])
_IS_BLANK = np.zeros(sys.maxunicode + 1, bool)
_IS_BLANK[[9, 10, 11, 12, 13, 32]] = True


def _set(chars: str) -> np.ndarray:
    found = np.zeros(sys.maxunicode + 1, bool)
    found[[ord(c) for c in chars]] = True
    return found


_IS_SIGN, _IS_SEPARATOR, _IS_CLOSING = _set("".join(READINGS)), _set(SEPARATORS), _set(_CLOSING)


def codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The code points of all texts, and where each text begins, with the end of the last."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate([[0], np.cumsum([len(t) for t in texts], dtype=np.int64)]).astype(np.int64)


@dataclass
class Letters:
    """The letters of the language model, most frequent first, and log P(symbol | symbol before)."""

    letters: str
    log_p: np.ndarray  # (symbols, symbols): before, then

    def __post_init__(self):
        self.number = {c: i + 2 for i, c in enumerate(self.letters)}
        signs = [*READINGS, *(c for c in SEPARATORS if c not in READINGS)]
        # A class of characters: its readings (symbols), their log probabilities, and that of being no symbol at all.
        self._class = {c: i for i, c in enumerate([None, " ", *signs, *self.letters])}
        width = 1 + max(map(len, READINGS.values()))
        n = len(self._class) + 1
        self.symbol, self.cost, self.drop = np.zeros((n, width), np.int64), np.full((n, width), _NEVER, np.float32), np.full(n, _NEVER, np.float32)
        self.drop[0] = 0  # padding
        self.unknown = n - 1
        for c, i in self._class.items():
            if c is None:
                continue
            if c == " ":
                self.symbol[i, 0], self.cost[i, 0], self.drop[i] = BOUNDARY, APART, JOINED
            elif c in READINGS or c in SEPARATORS:
                self.symbol[i, 0], self.cost[i, 0] = OTHER, KEPT
                for k, letter in enumerate(x for x in READINGS.get(c, "") if x in self.number):
                    self.symbol[i, k + 1], self.cost[i, k + 1] = self.number[letter], READ
                if c in SEPARATORS:
                    self.drop[i] = SEPARATED
            else:
                self.symbol[i, 0], self.cost[i, 0] = self.number[c], 0
        self.symbol[n - 1, 0], self.cost[n - 1, 0] = OTHER, 0

    def _lattice(self, words: list[str], length: int) -> tuple[np.ndarray, np.ndarray]:
        """Classes of characters, padded to one length, and which characters go on a run of three or more equal letters."""
        classes = np.zeros((len(words), length), np.int64)
        for i, w in enumerate(words):
            classes[i, : len(w)] = [self._class.get(c, self.unknown) for c in w]
        points = np.zeros((len(words), length + 4), np.uint32)
        for i, w in enumerate(words):
            points[i, 2 : 2 + len(w)] = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        equal = (points[:, 1:] == points[:, :-1]) & _IS_LETTER[points[:, 1:]]  # at j: character j-1 equals the one before
        own, before, after = equal[:, 1 : length + 1], equal[:, :length], equal[:, 2 : length + 2]
        return classes, own & (before | after)

    def _decoded(self, words: list[str]) -> list[str]:
        length = max(map(len, words))
        classes, repeat = self._lattice(words, length)
        n = len(words)
        rows = np.arange(n)
        score = np.full((n, _SYMBOLS), _NEVER, np.float32)
        score[:, BOUNDARY] = 0
        back = np.full((length, n, _SYMBOLS), -1, np.int8)
        into = np.ascontiguousarray(self.log_p.T)  # by symbol: from each before
        for j in range(length):
            c = classes[:, j]
            new = score + np.maximum(self.drop[c], np.where(repeat[:, j], np.float32(DROPPED_REPEAT), _NEVER))[:, None]
            extra = np.where(repeat[:, j], np.float32(KEPT_REPEAT), np.float32(0))
            for k in range(self.symbol.shape[1]):
                of = rows[self.cost[c, k] > _NEVER]
                if not len(of):
                    continue
                y = self.symbol[c[of], k]
                paths = score[of] + into[y]
                x = paths.argmax(axis=1)
                value = paths[np.arange(len(of)), x] + self.cost[c[of], k] + extra[of]
                better = value > new[of, y]
                new[of[better], y[better]] = value[better]
                back[j, of[better], y[better]] = x[better]
            score = np.maximum(new, _NEVER)
        state = (score + self.log_p[:, BOUNDARY]).argmax(axis=1)
        out: list[list[str]] = [[] for _ in words]
        for j in range(length - 1, -1, -1):
            x = back[j, rows, state]
            for i in np.flatnonzero((x >= 0) & (classes[:, j] > 0)):
                s = state[i]
                out[i].append(" " if s == BOUNDARY else words[i][j] if s == OTHER else self.letters[s - 2])
            state = np.where(x >= 0, x, state)
        return ["".join(reversed(o)) for o in out]

    def decode(self, words: list[str]) -> dict[str, str]:
        """The best reading of each different word (lower case, blanks only between single characters)."""
        distinct = sorted(set(words), key=lambda w: (len(w), w))
        found, start = {}, 0
        while start < len(distinct):
            # Words up to a quarter longer than the shortest share a batch.
            limit, stop = max(len(distinct[start]) * 5 // 4, 8), start
            while stop < len(distinct) and len(distinct[stop]) <= limit and (stop - start) * limit < _CELLS:
                stop += 1
            batch = distinct[start : max(stop, start + 1)]
            found.update(zip(batch, self._decoded(batch)))
            start += len(batch)
        return found


def is_letter(points: np.ndarray) -> np.ndarray:
    return _IS_LETTER[points]


def runs(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of marked characters begin and end; none goes from one text into the next."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[at] = True
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last[:-1] &= ~inside[1:] | edge[1:n]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def noisy(points: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the parts of the texts that get a lattice begin and end: words with signs or repeats, runs of single characters."""
    n = len(points)
    start, end = runs(~_IS_BLANK[points], at)
    if not len(start):
        return start, end
    first, last = np.zeros(n, bool), np.zeros(n, bool)
    first[start], last[end - 1] = True, True
    letter, sign, separator = _IS_LETTER[points], _IS_SIGN[points], _IS_SEPARATOR[points]
    # Neighbours within the word.
    left = np.zeros(n, bool)
    left[1:] = letter[:-1]
    left[first] = False
    right = np.zeros(n, bool)
    right[:-1] = letter[1:]
    right[last] = False
    odd = sign & (right | left & ~_IS_CLOSING[points])
    # letter, separator, letter, separator, letter
    between = separator & left & right
    odd[2:] |= between[2:] & between[:-2]
    same = np.zeros(n, bool)
    same[1:] = letter[1:] & (points[1:] == points[:-1]) & ~first[1:]
    odd[1:] |= same[1:] & same[:-1]
    chosen = np.add.reduceat(odd.astype(np.int32), start) > 0
    # Three single characters in a row or more, letters or signs, in one text.
    single = (end - start == 1) & (letter[start] | sign[start])
    text = np.searchsorted(at, start, "right")
    joined = np.zeros(len(start), bool)
    joined[1:] = single[1:] & single[:-1] & (text[1:] == text[:-1])
    head = ~joined
    run = np.cumsum(head) - 1
    size = np.bincount(run)
    begins = np.flatnonzero(head)
    ends = np.concatenate([begins[1:], [len(start)]]) - 1
    long = (size >= 3) & (np.add.reduceat(letter[start].astype(np.int32), begins) > 0)
    keep = np.where(size == 1, chosen[begins], long)
    return start[begins[keep]], end[ends[keep]]


def restored(texts: list[str], model: Letters) -> list[str]:
    """The lower-cased texts with every noisy part in its best reading."""
    lowered = [t.lower() for t in texts]
    points, at = codes(lowered)
    start, end = noisy(points, at)
    if not len(start):
        return lowered
    text = np.searchsorted(at, start, "right") - 1
    spans = [(int(t), int(s - at[t]), int(e - at[t])) for t, s, e in zip(text, start, end)]
    parts = [" ".join(lowered[t][s:e].split()) for t, s, e in spans]
    readings = model.decode(parts)
    cut: dict[int, list] = {}
    for (t, s, e), part in zip(spans, parts):
        cut.setdefault(t, []).append((s, e, readings[part]))
    for t, found in cut.items():
        made, done = [], 0
        for s, e, reading in found:
            made += [lowered[t][done:s], reading]
            done = e
        lowered[t] = "".join([*made, lowered[t][done:]])
    return lowered


def learn(docs: DataFrame) -> Letters:
    """The language model of all texts: pairs of neighbouring characters of lower-cased words, an end of word being one.

    Pairs are counted in the tasks, summed by Spark and reduced to the LETTERS most frequent letters (other characters are one
    symbol) before they reach the driver, which gets (LETTERS + 2) squared numbers at most. Without any text all pairs are alike.
    """
    prepared(docs.sparkSession)

    def run(batches):
        for batch in batches:
            for piece in pieces(batch):
                points, at = codes([t.lower() for t in piece.column("text").to_pylist() if t])
                kind = np.where(_IS_LETTER[points], points.astype(np.int64), OTHER)
                kind[_IS_BLANK[points]] = BOUNDARY
                kind = np.insert(kind, at, BOUNDARY)
                pair, count = np.unique(kind[:-1] << 32 | kind[1:], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pair >> 32), pa.array(pair & 0xFFFFFFFF), pa.array(count)], names=["a", "b", "n"])

    pairs = docs.select("text").where("text is not null and text <> ''").mapInArrow(run, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    pairs = written(pairs.where("a <> 0 or b <> 0"), "pairs")
    chosen = [r["b"] for r in pairs.where(f"b > {OTHER}").groupBy("b").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "b").limit(LETTERS).collect()]
    known = F.array(*[F.lit(c) for c in [BOUNDARY, *chosen]]).cast("array<bigint>")
    classes = [F.when(F.array_contains(known, F.col(x)), F.col(x)).otherwise(F.lit(OTHER)).alias(x) for x in ("a", "b")]
    rows = pairs.select(*classes, "n").groupBy("a", "b").agg(F.sum("n").alias("n")).collect()
    number = {BOUNDARY: BOUNDARY, OTHER: OTHER} | {c: i + 2 for i, c in enumerate(chosen)}
    counts = np.full((_SYMBOLS, _SYMBOLS), 0.5)
    for r in rows:
        counts[number[r["a"]], number[r["b"]]] += r["n"]
    counts[:, 2 + len(chosen) :] = 1e-9
    return Letters("".join(map(chr, chosen)), np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))
