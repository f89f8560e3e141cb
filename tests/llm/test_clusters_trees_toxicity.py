"""Pivot clustering, Merkle manifest and toxicity against plain Python."""

import hashlib
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from footprints.llm import channel, katz, laesa, merkle, queries, toxicity
from tests.llm.plain import LOWER, odd_rows, table

VECTORS = "vec_id long, embedding array<float>, label int"


# ---- clustering -----------------------------------------------------------------------------
def plain_clusters(rows, k=16, rounds=3, width=64):
    kept = []
    for i, e, *_ in rows:
        if e is not None and len(e) == width and all(x is not None and math.isfinite(x) for x in e):
            kept.append((i, [math.floor(64 * float(np.float32(x))) for x in e]))
    digest = lambda i: (i is None, hashlib.sha256(f"1:{i}".encode()).hexdigest() if i is not None else "")
    centres = [v for _, v in sorted(kept, key=lambda r: (digest(r[0]), r[1]))[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centres))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        centres = [[sum(x) // len(groups[n]) for x in zip(*groups[n])] if n in groups else c for n, c in enumerate(centres)]
    found = [(i, *reversed(nearest(v))) for i, v in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    return sorted(
        ((i, c, d, inertia[c], sum(inertia.values()), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for i, c, d in found), key=repr
    )


def clustered(spark, rows):
    found = laesa.described(laesa.cluster(spark.createDataFrame(rows, VECTORS)))
    return sorted((tuple(r)[:6] for r in found.collect()), key=repr), [r["tested"] for r in found.collect()]


def test_clusters_equal_plain_python(spark):
    rng = random.Random(3)
    middles = [[rng.uniform(-2, 2) for _ in range(64)] for _ in range(12)]
    rows = [(i, [x + rng.gauss(0, 0.05) for x in rng.choice(middles)], 1) for i in range(400)]
    rows += [(5, None, 1), (6, [], 1), (7, [1.0] * 63, 1), (8, [1.0] * 65, 1), (9, [float("nan")] + [0.0] * 63, 1), (10, [float("inf")] + [0.0] * 63, None), (11, [None] + [0.0] * 63, 1)]
    rows += [(None, [0.5] * 64, 1), (12, rows[0][1], 1), (12, rows[0][1], 1), (13, [1e-30, -1e-30] * 32, 1)]
    got, tested = clustered(spark, rows)
    assert got == plain_clusters(rows)
    # Bounds spare most of the distances.
    assert sum(tested) < 8 * len(tested)


def test_clusters_of_equal_few_and_no_vectors(spark):
    same = [(i, [0.25] * 64, 1) for i in range(100)]
    assert clustered(spark, same)[0] == plain_clusters(same)
    few = [(i, [float(i)] * 64, 1) for i in range(3)]
    assert clustered(spark, few)[0] == plain_clusters(few)
    assert clustered(spark, [(1, None, 1)])[0] == [] and clustered(spark, [])[0] == []
    # Other columns play no part, whatever their names.
    more = spark.createDataFrame(few, VECTORS).selectExpr("*", "1 as cluster", "'x' as v", "2 as p", "3 as distance")
    assert sorted((tuple(r)[:6] for r in laesa.described(laesa.cluster(more)).collect()), key=repr) == plain_clusters(few)
    with pytest.raises(Exception, match="134217728 or more"):
        clustered(spark, [(1, [3e30] * 64, 1)])


def test_bounds_never_lose_the_nearest():
    rng = np.random.default_rng(4)
    for scale in (3, 1000, 1 << 26):
        v, centres, pivots = (rng.integers(-scale, scale, (n, 64)) for n in (500, 16, 12))
        v[:16] = centres
        p = np.sqrt(((v[:, None, :] - pivots[None]).astype(float) ** 2).sum(axis=2))
        cluster, best, _ = laesa.nearest(v, p, centres, pivots)
        exact = ((v[:, None, :] - centres[None]) ** 2).sum(axis=2)
        assert (cluster == exact.argmin(axis=1)).all() and (best == exact.min(axis=1)).all()


# ---- manifest -------------------------------------------------------------------------------
def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, text):
    shown = [None if v is None else str(v) for v in (row["doc_id"], row["source"], row["lang"], row["n_chars"], text)]
    return sha(*["-" if v is None else f"{len(v.encode())}:{v}" for v in shown])


def plain_tree(hashes):
    """The root, and each leaf's way up: (siblings before, siblings after)."""
    ways, members = [[] for _ in hashes], [[i] for i in range(len(hashes))]
    while len(hashes) > 1:
        runs = [range(i, min(i + 8, len(hashes))) for i in range(0, len(hashes), 8)]
        for run in runs:
            for j in run:
                for i in members[j]:
                    ways[i].append((hashes[run[0] : j], hashes[j + 1 : run[-1] + 1]))
        members = [[i for j in run for i in members[j]] for run in runs]
        hashes = [sha(*hashes[run[0] : run[-1] + 1]) for run in runs]
    return hashes[0], ways


def plain_manifest(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r["lang"], []).append((r["doc_id"], plain_leaf(r, r["text"]), r))
    order = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in order:
        by_lang[lang].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[lang] = plain_tree([h for _, h, _ in by_lang[lang]])
    root, up = plain_tree([trees[lang][0] for lang in order])
    out = []
    for place, lang in enumerate(order):
        subroot, ways = trees[lang]
        for (i, h, r), way in zip(by_lang[lang], ways):
            way = way + up[place]
            changed = i is not None and zlib.crc32(str(i).encode()) % 3 == 0 and r["text"] is not None
            f = plain_leaf(r, r["text"].translate(LOWER)) if changed else h
            for before, after in way:
                f = sha(*before, f, *after)
            out.append((i, h, subroot, root, sha(*[x for before, after in way for x in [*before, *after]]), f, f == root))
    return sorted(out, key=repr)


def manifest_of(docs):
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return sorted((tuple(r) for r in merkle.manifest(docs, tampered, merkle.lowered()).drop("lang", "path").collect()), key=repr)


@pytest.mark.parametrize("sizes", [[1], [8], [9, 1], [64, 3, 1], [65, 513], [2] * 11])
def test_manifest_equals_plain_python(spark, sizes):
    rows = [(i * 7 + j * 1000, f"Text {i} Of {j}", f"l{j}") for j, n in enumerate(sizes) for i in range(n)]
    docs = table(spark, rows)
    assert manifest_of(docs) == plain_manifest(docs.collect())


def test_manifest_of_odd_rows(spark):
    odd = [(*r, lang) for r, lang in zip(odd_rows(), itertools.cycle(["en", None, "é", "z", ""]))]
    docs = table(spark, odd + odd[:3] + [(99, "Repeated Row", "en")] * 20)
    found = manifest_of(docs.selectExpr("*", "'x' as leaf", "1 as root", "2 as at", "3 as tree"))
    assert found == plain_manifest(docs.collect()) and len(found) == docs.count()
    assert manifest_of(docs.limit(0)) == []


def test_a_changed_row_changes_its_root_only(spark):
    rows = [(i, f"Text {i}", "en") for i in range(70)]
    docs = table(spark, rows)
    found = merkle.manifest(docs, F.col("doc_id") == 12, merkle.lowered()).collect()
    assert [r["doc_id"] for r in found if not r["verified"]] == [12] and len({r["root"] for r in found}) == 1


# ---- toxicity -------------------------------------------------------------------------------
def plain_best(word, model):
    """The best score over all readings of a short word, by trying every one of them."""
    symbols = range(channel._SYMBOLS)
    classes, repeat = model._lattice([word], len(word))
    options = []
    for j, c in enumerate(classes[0]):
        here = [(int(y), float(p) + (channel.KEPT_REPEAT if repeat[0, j] else 0)) for y, p in zip(model.symbol[c], model.cost[c]) if p > channel._NEVER]
        drop = max(float(model.drop[c]), channel.DROPPED_REPEAT if repeat[0, j] else -1e9)
        options.append(here + ([(None, drop)] if drop > -1e8 else []))
    best = -1e18, None
    for path in itertools.product(*options):
        kept = [(y, j) for j, (y, _) in enumerate(path) if y is not None]
        chain = [0, *(y for y, _ in kept), 0]
        value = sum(p for _, p in path) + sum(float(model.log_p[a, b]) for a, b in zip(chain, chain[1:]))
        text = "".join(" " if y == 0 else word[j] if y == 1 else model.letters[y - 2] for y, j in kept)
        best = max(best, (value, text))
    assert symbols
    return best


@pytest.fixture(scope="module")
def letters(spark):
    return channel.learn(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_decoding_is_the_best_of_all_readings(letters):
    rng = random.Random(6)
    words = ["1d10t", "i d i o t", "m0r0n", "l0seeer", "t.r.a.s.h", "$c*m", "a", "+", "3@sy", "ß4ß", "漢字0"]
    words += ["".join(rng.choice("abeiot013$.*") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    found = letters.decode(words)

    def value(word, text):
        """The best score of a reading with this text."""
        return plain_best(word, letters)[0] if plain_best(word, letters)[1] == text else None

    for w in words:
        assert value(w, found[w]) is not None, (w, found[w], plain_best(w, letters))


def test_clean_words_stay(letters):
    clean = "The house, which is well-known (and small) was sold in 1995!\nBook-keeping: see e.g. page 12."
    assert channel.restored([clean, "", "x" * 5], letters)[:2] == [clean.lower(), ""]
    assert channel.restored(["you 1d10t, i d i o t"], letters) == ["you idiot, idiot"]


def test_pairs_of_letters_are_those_of_plain_python(spark):
    texts = ["Ab ba!", "aB\n", None, "", "é a1"]
    model = channel.learn(table(spark, list(enumerate(texts))))
    pairs = {}
    kind = lambda c: c if c.isalpha() else "#"
    for t in texts:
        for word in (t or "").lower().split():
            chain = ["^", *map(kind, word), "^"]
            for p in zip(chain, chain[1:]):
                pairs[p] = pairs.get(p, 0) + 1
    number = {"^": 0, "#": 1} | {c: i + 2 for i, c in enumerate(model.letters)}
    assert set(model.letters) == {"a", "b", "é"} and model.letters[0] in "ab"
    for a in number:
        total = sum(pairs.get((a, b), 0) for b in number)
        for b in number:
            want = (pairs.get((a, b), 0) + 0.5) / (total + 0.5 * len(number))
            assert abs(math.exp(model.log_p[number[a], number[b]]) - want) < 1e-5, (a, b)


def test_held_out_documents_are_told_apart(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    held = katz.held_out(F.col("doc_id"), 5, 0)
    model = toxicity.train(docs.where(~held), labels, docs)
    rows = toxicity.score(docs.where(held), model).join(labels, "doc_id").select("toxic", "predicted", "score").collect()
    toxic, clean = [r for r in rows if r["toxic"] == 1], [r for r in rows if r["toxic"] == 0]
    assert len(toxic) > 50 and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    assert sum(r["predicted"] for r in toxic) >= 0.85 * len(toxic) and sum(r["predicted"] for r in clean) <= 0.01 * len(clean)
    # Obfuscated words are found as the plain ones are.
    calm = "the and of to in is that for it with as on be at by this from or have an they which one you were all her she there would their we him been has when who will no more if out so up "
    hidden = ["you 1d10t and l0ser, a m0r0n", "an i d i o t and t.r.a.s.h and sc*m", "iiidddiot paaathetic clooown", "$tupid id!ot tr@sh cl0wn"]
    rows = table(spark, [(i, calm * 3 + x) for i, x in enumerate([*hidden, "nothing of the kind here in 1995, b2b or e.g. mp3"])])
    assert [r["predicted"] for r in toxicity.score(rows, model).orderBy("doc_id").collect()] == [1] * len(hidden) + [0]


def test_toxicity_of_odd_rows(spark):
    docs = table(spark, odd_rows()).selectExpr("*", "1 as score", "'x' as predicted", "2 as toxic")
    labels = spark.createDataFrame([(4, 1), (8, 0), (5, 1), (5, 0), (None, 1), (1, 1), (2, None)], "doc_id long, toxic int")
    for marked in (labels, labels.where("toxic = 1"), labels.limit(0)):
        found = toxicity.score(docs, toxicity.train(docs, marked, docs)).collect()
        assert len(found) == len(odd_rows()) and all(0 <= r["score"] <= 1 for r in found)
        assert len({r["score"] for r in found if not r["text"]}) == 1
    assert {r["score"] for r in found} == {0.0}
    empty = docs.limit(0)
    assert toxicity.score(empty, toxicity.train(empty, labels, empty)).count() == 0


def test_operators_are_registered():
    assert [name.split("_")[0] for name in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]
