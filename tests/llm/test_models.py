"""Katz model, language identification, quality rules."""

import collections
import math
import random
import zlib

import pytest
from pyspark.sql import functions as F

from footprints.llm import katz, langid, quality
from tests.llm.plain import SCHEMA, odd_rows, table, words


class PlainKatz:
    """The model by its formulas, with dictionaries."""

    def __init__(self, texts, vocabulary):
        lists = [words(t) for t in texts]
        self.c = collections.Counter(w for ws in lists for w in ws)
        self.texts, self.n = len(texts), sum(map(len, lists)) + len(texts)
        ranked = sorted(self.c.items(), key=lambda kv: -kv[1])
        self.known = {w for w, _ in ranked} if len(ranked) <= vocabulary else None
        if self.known is None:
            bins = collections.Counter(math.floor(math.log2(c) * 12) for c in self.c.values())
            room, lowest = vocabulary, None
            for b in sorted(bins, reverse=True):
                if bins[b] > room:
                    break
                room, lowest = room - bins[b], b
            self.known = {w for w, c in self.c.items() if lowest is not None and math.floor(math.log2(c) * 12) >= lowest}
        events = {w: self.c[w] for w in self.known} | {"</s>": self.texts}
        left = self.n - sum(events.values())
        if left:
            self.p = {e: c / self.n for e, c in events.items()} | {"<unk>": left / self.n}
        else:
            d = katz.discounts([0] + [sum(c == r for c in events.values()) for r in range(1, 7)])
            self.p = {e: c * (d[c] if c <= 5 else 1) / self.n for e, c in events.items()}
            rest = 1 - sum(self.p.values())
            if rest <= 1e-15:
                self.p, rest = {e: p * self.n / (self.n + 1) for e, p in self.p.items()}, 1 / (self.n + 1)
            self.p["<unk>"] = rest
        self.b = collections.Counter(pair for ws in lists for pair in self.pairs(ws))
        self.d = katz.discounts([0] + [sum(c == r for c in self.b.values()) for r in range(1, 7)])
        self.followers = collections.defaultdict(dict)
        for (v, w), r in self.b.items():
            self.followers[v][w] = r

    def pairs(self, ws):
        ws = [w if w in self.known else "<unk>" for w in ws]
        return list(zip(["<s>", *ws], [*ws, "</s>"]))

    def prob(self, v, w):
        seen = self.followers.get(v)
        if not seen:
            return self.p[w]
        total = sum(seen.values())
        freed = sum((1 - self.d[r]) * r for r in seen.values() if r <= 5)
        scale, mass = (1, freed / total) if freed > 0 else (total / (total + 1), 1 / (total + 1))
        if w in seen:
            r = seen[w]
            return scale * r * (self.d[r] if r <= 5 else 1) / total
        return mass / (1 - sum(self.p[x] for x in seen)) * self.p[w]

    def score(self, text):
        return sum(math.log10(self.prob(v, w)) for v, w in self.pairs(words(text)))

    def base(self, text):
        v = len(self.c) + 1
        counts = [self.c[w] for w in words(text)] + [self.texts]
        return sum(math.log10((c + 0.5) / (self.n + 0.5 * (v + 1))) for c in counts), sum(c > 0 for c in counts)


@pytest.mark.parametrize("vocabulary", [10_000, 40])
def test_katz_equals_plain_python(spark, vocabulary):
    rng = random.Random(1)
    zipf = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(zipf[i * 20 : i * 20 + rng.randint(0, 20)])) for i in range(200)] + [(500, None), (501, ""), (502, "W1 w2 new")]
    docs = table(spark, rows)
    held = katz.held_out(F.col("doc_id"))
    model = katz.train(docs.where(~held), vocabulary=vocabulary)
    got = {r.doc_id: r for r in katz.score(docs, model).collect()}
    plain = PlainKatz([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], vocabulary)
    assert len(plain.known) < len(plain.c) or vocabulary > 40
    for v in [*list(plain.followers)[:50], "<s>", "never"]:
        assert sum(plain.prob(v, w) for w in plain.p) == pytest.approx(1)
    assert len(got) == len(rows)
    for i, text in rows:
        r = got[i]
        base, known = plain.base(text)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words(text)) + 1, known, plain.n)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(plain.score(text))


@pytest.mark.parametrize("in_memory", [0, 40])
def test_katz_knows_every_training_word(spark, in_memory):
    rng = random.Random(2)
    zipf = [f"w{int(rng.paretovariate(0.7))}" for _ in range(4000)]
    rows = [(i, " ".join(zipf[i * 20 : i * 20 + rng.randint(0, 20)])) for i in range(200)] + [(500, None), (501, ""), (502, "W1 w2 new"), (503, "new new w1")]
    docs = table(spark, rows)
    model = katz.train(docs.where(~katz.held_out(F.col("doc_id"))), in_memory=in_memory)
    plain = PlainKatz([t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1], 10**9)
    assert len(model.local.words) <= in_memory < len(plain.c) / 2 and len(plain.known) == len(plain.c)
    got = {r.doc_id: r for r in katz.score(docs, model).collect()}
    for i, text in rows:
        base, known = plain.base(text)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(words(text)) + 1, known, plain.n)
        assert got[i].base_score == pytest.approx(base) and got[i].score == pytest.approx(plain.score(text))


def test_blocks_of_numbers_in_no_order_are_short():
    import numpy as np

    rng = np.random.default_rng(1)
    texts, any_, edges = rng.integers(0, 2930, 17_000), rng.integers(-(1 << 63), (1 << 63) - 1, 1000), np.array([-(1 << 63), (1 << 63) - 1, 0])
    for values in (texts, any_, np.sort(any_), edges, edges[:2], edges[:0]):
        assert (katz._unpack(katz._pack(values)) == values).all()
    assert len(katz._pack(texts)) < 2 * len(texts)


def test_blocks_go_back_in_small_batches():
    import numpy as np

    rng = np.random.default_rng(2)
    values = [rng.integers(-(1 << 63), (1 << 63) - 1, n) for n in [40_000] * 12 + [400_000, 0, 1]]
    made = []
    blocks = (made.append(i) or katz._block(i, katz.TABLE, v) for i, v in enumerate(values))
    got = []
    for batch in katz._batches(blocks):
        assert batch.num_rows == 1 or batch.nbytes < 2 * katz.OUT_BYTES
        got += batch.to_pylist()
        assert len(made) == len(got)  # no block is packed ahead of its batch
    assert [row["bucket"] for row in got] == list(range(len(values))) and all((katz._unpack(row["a"]) == v).all() for row, v in zip(got, values))
    cut = list(katz._cut(["a", "b"], values[-3], values[-3]))
    assert max(b.num_rows for b in cut) <= katz.OUT_ROWS and (np.concatenate([b.column("b").to_numpy() for b in cut]) == values[-3]).all()


def test_katz_of_odd_rows(spark):
    docs = table(spark, odd_rows()).selectExpr("*", "1 as rid", "2 as bucket")
    got = katz.score(docs, katz.train(docs)).collect()
    assert len(got) == len(odd_rows()) and all(r.score < 0 for r in got)
    empty = katz.train(docs.limit(0))
    assert all(math.isfinite(r.score) and r.train_tokens == 0 for r in katz.score(docs, empty).collect())
    assert katz.score(docs.limit(0), empty).count() == 0


def test_discounts():
    n = [0, 1000, 400, 220, 140, 100, 75]
    d = katz.discounts(n)
    assert all(0 < x < 1 for x in d[1:])
    # What Katz's discounts take from seldom events is the number of those seen once.
    assert sum(n[r] * (1 - d[r]) * r for r in range(1, 6)) == pytest.approx(n[1])
    assert all(0 < x < 1 for x in katz.discounts([0] * 7)[1:])


def test_discounts_stay_good_turing_where_counts_are_uneven():
    # Counts of counts of a corpus with copies; with k = 5 the ratio for 4 is above 1.
    n = [0, 1166653, 243736, 52614, 22744, 19087, 8198]
    d = katz.discounts(n)
    assert all(0 < x <= 1 for x in d[1:]) and list(d[4:]) == [1, 1]
    assert sum(n[r] * (1 - d[r]) * r for r in range(1, 6)) == pytest.approx(n[1])
    # No k is valid for these; on a fitted line n[r + 1] / n[r] is a power of (r + 1) / r, so the ratios rise.
    d = katz.discounts([0, 1000, 200, 150, 30, 28, 5])
    assert all(0 < x < y < 1 for x, y in zip(d[1:], d[2:])) and 5 * (1 - d[5]) - 4 * (1 - d[4]) != pytest.approx(0)
    # Missing counts are smoothed over.
    assert all(0 < x < 1 for x in katz.discounts([0, 1000, 200, 0, 30, 0, 5])[1:])


def test_language_of_held_out_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = katz.held_out(F.col("doc_id"), 3)
    got = langid.identify(docs.where(held), langid.train(docs.where(~held))).select("lang", "lang_pred", "score").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.99 and all(0 <= r.score <= 1 for r in got)


def test_language_scores_equal_plain_bayes(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr"), ("La maison est là", "fr"), ("A house is there!", "en")] * 3)]
    docs = table(spark, rows)
    model = langid.train(docs)
    assert model.languages == ["en", "fr"]
    text = "the house est là"
    grams, _ = langid._features([text], model.bits)
    total = model.log_prior + sum(model.log_prob[g] for g in grams)
    p = 1 / sum(math.exp(x - max(total)) for x in total)
    r = langid.identify(table(spark, [(1, text)]), model).first()
    assert (r.lang_pred, r.score) == (model.languages[int(total.argmax())], pytest.approx(p))
    assert sum(math.exp(x) for x in model.log_prob[:, 0]) == pytest.approx(1)


def test_language_of_odd_rows(spark):
    docs = table(spark, odd_rows()).selectExpr("*", "1.5 as score", "'x' as _doc")
    model = langid.train(docs)
    got = langid.identify(docs, model).collect()
    assert len(got) == len(odd_rows()) and {r.lang_pred for r in got if r.doc_id in (1, 2, 3)} == {"und"}
    assert {r.lang_pred for r in langid.identify(docs, langid.train(docs.limit(0))).collect()} == {"und"}
    kept = langid.in_language(docs)
    assert kept.columns == docs.columns and kept.where("doc_id in (1, 2, 3)").count() == 0 and kept.where("doc_id = 5").count() == 2
    assert langid.in_language(docs.limit(0)).count() == 0


def plain_counts(text):
    w = words(text, lower=False)
    grams = collections.defaultdict(list)
    for i in range(len(w) - 7):
        grams[tuple(w[i : i + 8])].append(i)
    covered = {i + k for places in grams.values() if len(places) > 1 for i in places for k in range(8)}
    seen, again = set(), 0
    for line in (text or "").split("\n"):
        if words(line):
            again += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), again, len(covered)


def test_counts_equal_plain_python(spark):
    rng = random.Random(2)
    rows = [r for r in odd_rows() if r[0] is not None and r[0] not in (5, 8)]
    rows += [(100 + i, "".join(rng.choice(["a ", "b ", "é$ ", "x|y ", "\n", "a b c d e f g h i "]) for _ in range(rng.randint(0, 60)))) for i in range(60)]
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.counts(table(spark, rows)).collect()}
    assert got == {i: plain_counts(t) for i, t in rows}


def test_binomial_tail():
    for n, p in ((10, 0.3), (200, 0.01), (1000, 0.02)):
        for k in (0, 1, 5, n):
            exact = math.fsum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality.binomial_tail(k, n, p) == pytest.approx(exact, rel=1e-9)


def test_cutoffs_are_the_strictest_in_a_row_that_pass():
    share = quality.ALPHA / len(quality.RULES)
    rule = "symbol_ratio"
    rejected = [0, 0, 3, 60, 0] + [500] * (len(quality.RULES[rule]) - 5)
    assert quality.choose({("en", rule): (5000, rejected)}) == {("en", rule): quality.RULES[rule][2]}
    # Too few labels certify nothing, however few are rejected.
    assert quality.choose({("en", rule): (int(1 / share), [0] * len(rejected))}) == {}


def test_verdicts_per_stratum(spark):
    good = "one two three four five six seven eight nine ten " + " ".join(f"word{i}" for i in range(20))
    junk = " ".join(f"w{i}***" for i in range(30))
    rows = [(i, f"{good} n{i}", "en") for i in range(700)] + [(1000 + i, f"{junk} n{i}", "en") for i in range(5)] + [(2000, junk, "xx"), (2001, "short", "en")]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(700)] + [(1000, 0, 1), (0, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.judged(table(spark, rows), labels).collect()}
    assert all(got[i].kept for i in range(700)) and not any(got[1000 + i].kept for i in range(5))
    assert got[2000].kept and got[2000].rejected_by == [] and got[2001].base_failed and not got[2001].kept
    none = quality.judged(table(spark, odd_rows()), labels.limit(0)).collect()
    assert len(none) == len(odd_rows()) and all(r.kept != r.base_failed for r in none)
    assert quality.judged(spark.createDataFrame([], SCHEMA), labels).count() == 0
