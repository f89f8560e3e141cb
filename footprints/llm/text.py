"""Words of many texts at once: whole Arrow batches as byte arrays, without a Python loop over texts or words.

A word is a run of bytes other than blank and 0x09-0x0D; bytes of longer UTF-8 characters never equal those, so words of
bytes are words of characters. Hashes are sums over a word's bytes times odd powers modulo 2^64, mixed at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 2 << 20
# Some sixty bytes of memory a byte of text are taken at once. A Python worker keeps much of the most that it ever took, and those of all
# steps before stay beside the running ones, so steps that are chained in one session work on smaller pieces.
PIECE_BYTES = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER = _BYTE.copy()
_LOWER[65:91] = _BYTE[97:123]
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^0..B^(n-1) and their inverses modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = next((s + 1 for s in (PIECE_BYTES, CHUNK_BYTES) if s >= n - 1), n)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        made = []
        for base in (_BASE, inverse):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            made.append(np.cumprod(p))
        _powers[:] = made
    return _powers[0], _powers[1]


def pieces(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; one row at least."""
    if batch.num_rows == 0:
        return
    sizes = np.nan_to_num(np.asarray(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False), dtype=float)).astype(np.int64)
    ends = np.cumsum(sizes)
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts and where each begins, with the end of the last; a null is empty."""
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


class Words:
    """start, end: byte places; doc: the text's number; hash: 64 bits; begin: each text's first word, with the end of the last."""

    def __init__(self, texts: pa.Array, lower: bool = True, breaks: np.ndarray | None = None, cuts: np.ndarray | None = None):
        """breaks: byte places of texts cut further, such as into lines; by default each text is one piece. cuts: places within words where a new one begins."""
        self.data, at = raw(texts)
        self._of(self.data, at if breaks is None else breaks, lower, cuts)

    def _of(self, data: np.ndarray, at: np.ndarray, lower: bool, cuts: np.ndarray | None) -> None:
        n = len(data)
        self.at = at
        word = ~SPACE[data]
        edge = np.zeros(n + 1, bool)
        edge[at] = True
        if cuts is not None:
            edge[cuts] = True
        first = word.copy()
        first[1:] &= ~word[:-1] | edge[1:n]
        last = word.copy()
        last[:-1] &= ~word[1:] | edge[1:n]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        self.doc = np.searchsorted(at, self.start, "right") - 1
        up, down = powers(n + 1)
        sums = np.zeros(n + 1, np.uint64)
        terms = (_LOWER if lower else _BYTE)[data]
        terms *= up[:n]
        np.cumsum(terms, out=sums[1:])
        self.hash = mix((sums[self.end] - sums[self.start]) * down[self.start] + (self.end - self.start).astype(np.uint64))
        self.begin = np.searchsorted(self.doc, np.arange(len(at)))

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.begin)


# Scripts written without blanks: Thai, Lao, Burmese, Khmer, kana and Chinese characters.
UNSPACED = r"[\x{0E00}-\x{0EFF}\x{1000}-\x{107F}\x{1780}-\x{17FF}\x{3000}-\x{9FFF}\x{20000}-\x{2FFFF}]"


def unspaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each character of UNSPACED begins in UTF-8, and where it ends."""
    start = np.flatnonzero(data >= 0xE0)
    lead = data[start]
    second = data[np.minimum(start + 1, len(data) - 1)]
    southern = (lead == 0xE0) & (second >= 0xB8) & (second <= 0xBB) | (lead == 0xE1) & ((second <= 0x81) | (second >= 0x9E) & (second <= 0x9F))
    four = (lead == 0xF0) & (second >= 0xA0) & (second <= 0xAF)
    chosen = southern | (lead >= 0xE3) & (lead <= 0xE9) | four
    return start[chosen], start[chosen] + np.where(four[chosen], 4, 3)


def line_breaks(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the \\n-split lines of all texts begin, with the end of the last, and each line's text.

    The \\n belongs to the line that it ends, which changes no word. Every text has one line at least.
    """
    newline = np.flatnonzero(data == 10) + 1
    # A text that ends with \n has an empty last line, which begins where the next text does; it is the one of smaller number.
    begins = np.concatenate([at[:-1], newline])
    of = np.concatenate([np.arange(len(at) - 1), np.searchsorted(at, newline - 1, "right") - 1])
    order = np.lexsort((begins, of))
    return np.append(begins[order], at[-1]), of[order]


def grams(words: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hashes of all runs of n words; runs across texts are for the caller to leave out."""
    size = max(0, len(words) - n + 1)
    total = np.full(size, np.uint64(salt * 2 + 1), np.uint64)
    for i in range(n):
        total += words[i : i + size] * np.uint64((0xD1342543DE82EF95 * (2 * i + 3)) % (1 << 64) | 1)
        total = mix(total) if i == n - 1 else total * np.uint64(0xAF251AF3B0F025B5)
    return total
