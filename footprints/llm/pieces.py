"""SentencePiece encoding and decoding: the best segmentation by the sum of its pieces' scores, found by Viterbi over whole batches.

A text is normalised as the model's file asks (here only: a blank becomes U+2581 and one goes ahead of the text) and cut into
units, a run of U+2581 with what follows up to the next one or up to a character that no longer piece holds; no piece reaches
over such a border. Each different unit of a batch is encoded once. Units of equal length advance together: at every place, the
hashes of all substrings that end there are looked up in the sorted piece keys, and the best predecessor is a maximum over the
substring's length. A character that no piece covers is its UTF-8 bytes as byte pieces; like the library, it scores ten below
the worst piece.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from footprints.llm.storage import prepared
from footprints.llm.text import mix
from footprints.llm.text import pieces as parts_of

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN_PENALTY = 10.0
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
_K = np.uint64(0x9E3779B97F4A7C15)
_SIEVE_BITS = 20
# Different units that a task remembers.
_KNOWN_UNITS = 500_000


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        else:
            size = varint() if wire == 2 else {1: 8, 5: 4}[wire]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Pieces:
    """The pieces of a model file, as arrays."""

    names: list[str]
    kinds: np.ndarray
    keys: np.ndarray  # sorted hashes of the pieces that texts can hold
    key_ids: np.ndarray
    key_scores: np.ndarray
    sieve: np.ndarray  # by a hash's first bits: whether any key has them
    byte_ids: np.ndarray
    unknown: int
    unknown_score: float
    longest: int
    units_of: re.Pattern
    add_prefix: bool
    coded: list[bytes]

    @classmethod
    def load(cls, data: bytes) -> "Pieces":
        names, scores, kinds, add_prefix = [], [], [], True
        for field, value in _fields(data):
            if field == 1:
                parts = dict(_fields(value))
                names.append(parts[1].decode())
                scores.append(float(np.frombuffer(parts.get(2, b"\0\0\0\0"), "<f4")[0]))
                kinds.append(parts.get(3, NORMAL))
            elif field == 3:
                spec = dict(_fields(value))
                add_prefix = bool(spec.get(3, 1))
                if spec.get(2) or spec.get(4, 1):
                    raise ValueError("models with character maps or that drop blanks are not supported")
        kinds = np.array(kinds)
        if (kinds == USER).any():
            raise ValueError("models with user-defined pieces are not supported")
        usable = [i for i, k in enumerate(kinds) if k == NORMAL]
        keys = np.array([int(_hash_one(names[i])) for i in usable], np.uint64)
        order = np.argsort(keys)
        sieve = np.zeros(1 << _SIEVE_BITS, bool)
        sieve[(keys >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)] = True
        byte_ids = np.full(256, -1)
        for i in np.flatnonzero(kinds == BYTE):
            byte_ids[int(names[i][3:5], 16)] = i
        long = "".join(names[i] for i in usable if len(names[i]) > 1)
        if any(MARK in names[i].lstrip(MARK) for i in usable):
            raise ValueError("pieces that reach over a blank are not supported")
        apart = "".join(c for c in "\n\t\r" if c not in long)
        units_of = re.compile(f"{MARK}+[^{MARK}{apart}]*|[^{MARK}{apart}]+" + (f"|[{apart}]+" if apart else ""))
        coded = [b"" if k == CONTROL else " ⁇ ".encode() if k == UNKNOWN else bytes([int(n[3:5], 16)]) if k == BYTE else n.encode() for n, k in zip(names, kinds)]
        return cls(
            names, kinds, keys[order], np.array(usable)[order], np.array([scores[i] for i in usable])[order], sieve, byte_ids,
            int(np.flatnonzero(kinds == UNKNOWN)[0]), min(scores[i] for i in usable) - UNKNOWN_PENALTY, max(len(names[i]) for i in usable), units_of, add_prefix, coded,
        )

    def units(self, text: str) -> list[str]:
        text = text.replace(" ", MARK)
        if self.add_prefix and text:
            text = MARK + text
        return self.units_of.findall(text)

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The ids of each unit, as 32-bit integers, units of equal length together."""
        out: list = [None] * len(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        for size in np.unique(sizes).tolist():
            rows = np.flatnonzero(sizes == size)
            step = max(1, 400_000 // size)
            for part in (rows[i : i + step].tolist() for i in range(0, len(rows), step)):
                for row, ids in zip(part, self._equal([units[i] for i in part], size)):
                    out[row] = ids
        return out

    def _equal(self, units: list[str], size: int) -> list[bytes]:
        n = len(units)
        chars = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, size).T.astype(np.uint64)
        # hashes[b] is of the substring that begins at b and ends at the current place.
        best = np.full((size + 1, n), -np.inf)
        best[0] = 0.0
        came, piece = np.zeros((size + 1, n), np.int32), np.zeros((size + 1, n), np.int32)
        hashes = np.zeros((size, n), np.uint64)
        columns = np.arange(n)
        for end in range(1, size + 1):
            low = max(0, end - self.longest)
            hashes[end - 1] = 0
            hashes[low:end] = (hashes[low:end] + chars[end - 1] + np.uint64(1)) * _K
            score, ids = self._looked_up(mix(hashes[low:end]))
            score[-1] = np.where(ids[-1] >= 0, score[-1], self.unknown_score)
            total = best[low:end] + score
            # The longest of equally good last pieces is the first row.
            pick = total.argmax(axis=0)
            best[end] = total[pick, columns]
            came[end] = low + pick
            piece[end] = ids[pick, columns]
        # The best pieces, each in the column of the place where it ends.
        chosen, used = np.zeros((n, size), np.int32), np.zeros((n, size), bool)
        live, ends = columns, np.full(n, size)
        while len(live):
            ids, begins = piece[ends, live], came[ends, live]
            chosen[live, ends - 1] = np.where(ids >= 0, ids, -2 - begins)
            used[live, ends - 1] = True
            live, ends = live[begins > 0], begins[begins > 0]
        flat = chosen[used].astype("<i4").tobytes()
        cuts = [0, *(np.cumsum(used.sum(axis=1)) * 4).tolist()]
        out = [flat[i:j] for i, j in zip(cuts, cuts[1:])]
        for i in np.flatnonzero((chosen < 0).any(axis=1)).tolist():
            out[i] = np.array(self._bytes(units[i], chosen[i][used[i]].tolist()), "<i4").tobytes()
        return out

    def _looked_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of substrings by their hashes; -inf and -1 for those that are no pieces, as most are: a sieve tells."""
        flat = hashes.ravel()
        some = np.flatnonzero(self.sieve[(flat >> np.uint64(64 - _SIEVE_BITS)).astype(np.int64)])
        at, found = _find(self.keys, flat[some])
        score, ids = np.full(len(flat), -np.inf), np.full(len(flat), -1, np.int32)
        some, at = some[found], at[found]
        score[some], ids[some] = self.key_scores[at], self.key_ids[at]
        return score.reshape(hashes.shape), ids.reshape(hashes.shape)

    def _bytes(self, unit: str, ids: list[int]) -> list[int]:
        """A unit's ids with the bytes of each character that no piece covers, which stands there as its place below -1."""
        made: list[int] = []
        for i in ids:
            if i >= 0:
                made.append(i)
            else:
                coded = [int(self.byte_ids[b]) for b in unit[-2 - i].encode("utf-8", "surrogatepass")]
                made += coded if min(coded) >= 0 else [self.unknown]
        return made

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that form no character are U+FFFD, and control pieces are nothing."""
        text = b"".join(map(self.coded.__getitem__, ids)).decode("utf-8", "replace").replace(MARK, " ")
        return text[1:] if self.add_prefix and text.startswith(" ") else text


def _hash_one(name: str) -> np.uint64:
    value = 0
    for c in name:
        value = (value + ord(c) + 1) * int(_K) % (1 << 64)
    return mix(np.array([value], np.uint64))[0]


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def load(spark: SparkSession, path: str = MODEL) -> Pieces:
    """Reads a model file, a megabyte at most, on the driver."""
    return Pieces.load(open(path, "rb").read())


def encode(docs: DataFrame, model: Pieces) -> DataFrame:
    """The documents with ``piece_ids``, the ids of each text's pieces; a null text has null, an empty one none.

    U+2581 in a text is taken for a blank, as the library does. A column of that name is replaced.
    """
    spark = prepared(docs.sparkSession)
    docs = docs.drop("piece_ids")
    names, shared = docs.columns, spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        known: dict[str, bytes] = {}
        for batch in batches:
            for part in parts_of(batch, limit=8 << 20):
                texts = [model.units(t) if t is not None else None for t in part.column("text").to_pylist()]
                if len(known) > _KNOWN_UNITS:
                    known.clear()
                new = list(set().union(*filter(None, texts)) - known.keys())
                known.update(zip(new, model.encode_units(new)))
                coded = [b"".join(map(known.__getitem__, t)) if t else b"" for t in texts]
                values = np.frombuffer(b"".join(coded), "<i4")
                sizes = [len(c) // 4 for c in coded]
                offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.ListArray.from_arrays(offsets, pa.array(values))], names=[*names, "piece_ids"])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("piece_ids", T.ArrayType(T.IntegerType()))]))


def decode(encoded: DataFrame, model: Pieces, column: str = "piece_ids") -> DataFrame:
    """The rows with ``decoded``, the text of each row's ids; null stays null."""
    spark = prepared(encoded.sparkSession)
    encoded = encoded.drop("decoded")
    names, shared = encoded.columns, spark.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for batch in batches:
            texts = [None if ids is None else model.decode(ids) for ids in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(texts, pa.string())], names=[*names, "decoded"])

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField("decoded", T.StringType())]))
