"""Line dedup and the n-gram join against plain Python."""

import random
import tracemalloc

import pyarrow as pa
import pytest

from footprints.llm import graph, line_dedup, ngram_join, text
from footprints.llm.storage import prepared
from tests.llm.plain import components, odd_rows, table, words


def plain_line_dedup(rows):
    """{(doc_id, text): (n_removed, n_near, kept lines)}; ids are not null."""
    docs = sorted({r[:2] for r in rows if r[1] is not None})
    lines = [(d, i, tuple(words(line))) for d, text in docs for i, line in enumerate(text.split("\n"))]
    first = {}
    for d, i, w in lines:
        first.setdefault(w, (d, i))
    close = set()
    for a, p in first.items():
        if len(a) >= line_dedup.MIN_NEAR_WORDS:
            for b, q in first.items():
                if q < p and len(b) >= line_dedup.MIN_NEAR_WORDS and edit(a, b):
                    close.add(a)
    out = {}
    for d, text in docs:
        kept, removed, near = [], 0, 0
        for i, line in enumerate(text.split("\n")):
            w = tuple(words(line))
            gone = len(w) >= line_dedup.MIN_WORDS and (first[w] < (d, i) or w in close)
            removed, near = removed + gone, near + (w in close)
            if not gone:
                kept.append(line)
        out[d, text] = removed, near, "\n".join(kept)
    return out


def edit(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def test_line_dedup_equals_plain_python(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(30)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(6, 14))] for _ in range(12)]
    rows = []
    for doc in range(60):
        lines = []
        for _ in range(rng.randint(1, 5)):
            line = list(rng.choice(base))
            for _ in range(rng.choice([0, 0, 1, 1, 2])):
                place = rng.randrange(len(line))
                kind = rng.randrange(3)
                if kind == 0:
                    line[place] = rng.choice(vocabulary).upper()
                elif kind == 1:
                    del line[place]
                else:
                    line.insert(place, rng.choice(vocabulary))
            lines.append(("  " if rng.random() < 0.2 else " ").join(line))
        if rng.random() < 0.3:
            lines.insert(0, rng.choice(["", "Yes", "Two words"]))
        rows.append((doc, "\n".join(lines)))
    got = {(r.doc_id, rows[r.doc_id][1]): (r.n_removed, r.n_near, r.text) for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got == plain_line_dedup(rows)


def test_lines_without_blanks(spark):
    han, thai = "今日は天気がいいから散歩しましょう", "วันนี้อากาศดีมากเราไปเดินเล่น"
    rows = [
        (1, f"{han}\nles.\nhttps://example.com/a/page\n{thai}\nA\n𠀀𠀁𠀂𠀃𠀄𠀅𠀆𠀇"),
        (2, f"les.\nLes.\n{han}\nhttps://example.com/a/page\nhttps://example.com/a/pagf\n"),
        (3, f"{han[:5]}雨{han[6:]}\n{thai[:-1]}\n{han[:4]}{han[5:]}\n{han}。\n𠀀𠀁𠀂𠀃x𠀅𠀆𠀇\n𠀀𠀁𠀂𠀃x𠀅𠀆y"),
        # Two edits, too short, and an edit of a whole word in a line of words enough.
        (4, f"雨雨{han[2:]}\n一二三四五六七\n一二三四五六八\na b c d e f g {han}\na b c d e f g {thai}"),
        (5, "今日は天気が いいから散歩しまし\nshort 漢"),
    ]
    got = {r.doc_id: (r.n_removed, r.n_near, r.text.split("\n")) for r in line_dedup.line_dedup(table(spark, rows)).collect()}
    assert got[1][:2] == (0, 0)
    assert got[2] == (4, 0, ["https://example.com/a/pagf", ""])
    assert got[3] == (6, 6, [""])
    assert got[4] == (1, 1, [f"雨雨{han[2:]}", "一二三四五六七", "一二三四五六八", f"a b c d e f g {han}"])
    assert got[5][:2] == (0, 0)


def test_line_dedup_of_odd_rows(spark):
    rows = odd_rows()
    docs = table(spark, rows).selectExpr("*", "1 as n_lines", "2 as row", "3 as line", "'x' as gone")
    got = line_dedup.line_dedup(docs).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, (r.text or "")[:12]): r for r in got}
    assert by[1, ""].n_lines == 0 and by[1, ""].text is None and by[2, ""].n_lines == 1
    assert by[4, "alpha beta g"].n_removed == 2999 and by[4, "alpha beta g"].gone == "x"
    # Repeated rows keep their lines; the row without id comes last and loses its line.
    assert [r.n_removed for r in got if r.doc_id == 5] == [0, 0]
    assert [r.n_removed for r in got if r.doc_id is None and r.text is not None] == [1]
    assert line_dedup.without_repeated_lines(docs.limit(0)).count() == 0
    kept = line_dedup.without_repeated_lines(table(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.where("doc_id is null").count() == 1


def shingles(text, n):
    w = words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_links(rows, n, num, den):
    sets = [(d, shingles(t, n)) for d, t in rows]
    pairs = []
    for i, (a, s) in enumerate(sets):
        for b, t in sets[:i]:
            shared = len(s & t)
            if s and t and den * shared >= num * (len(s) + len(t) - shared):
                pairs.append((a, b))
    return components([d for d, _ in rows], pairs)


def family(rng, base, size, most, vocabulary):
    for _ in range(size):
        copy = list(base)
        for _ in range(rng.randint(0, most)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        yield copy


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 8, 10)])
def test_links_equal_plain_python(spark, n, num, den):
    """Families of near copies of more members than are compared pair by pair, with links on both sides of the threshold."""
    rng = random.Random(n)
    vocabulary = [f"w{i}" for i in range(400)]
    texts = []
    for size, length, most in ((60, 120, 9), (40, 60, 4), (30, 25, 2), (12, 300, 20), (20, 11, 1), (9, 4, 1)):
        base = [rng.choice(vocabulary) for _ in range(length)]
        texts += list(family(rng, base, size, most, vocabulary))
        # Part of the family goes on from a copy that is itself edited.
        texts += list(family(rng, texts[-1], size // 2, most, vocabulary))
    texts += [[rng.choice(vocabulary) for _ in range(rng.randint(1, 80))] for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)] + [(1000, texts[0][0]), (1001, texts[0][0].upper()), (1002, "")]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.linked(table(spark, rows), n, num, den).collect()}
    want = plain_links(rows, n, num, den)
    assert len(set(want.values())) < len(rows) - 50
    assert got == {d: (len(shingles(t, n)), want[d]) for d, t in rows}


def test_every_linked_pair_shares_a_signature():
    import numpy as np

    rng = np.random.default_rng(3)
    for num, den in ((90, 100), (8, 10)):
        for size in (1, 5, 9, 10, 19, 40, 133, 700):
            for _ in range(20):
                a = rng.integers(0, 1 << 63, size, dtype=np.uint64)
                # As different as a link allows: elements replaced, dropped or added.
                b = a.copy()
                while True:
                    changed = b.copy() if rng.random() < 0.5 else b[1:] if rng.random() < 0.5 else np.append(b, rng.integers(0, 1 << 63, 1, dtype=np.uint64))
                    if len(changed) == len(b) and len(b):
                        changed[rng.integers(len(b))] = rng.integers(0, 1 << 63, dtype=np.uint64)
                    shared = len(np.intersect1d(a, changed))
                    if den * shared < num * (len(a) + len(changed) - shared) or not len(changed):
                        break
                    b = changed
                    if rng.random() < 0.02:
                        break
                sigs = []
                for s in (np.sort(a), np.sort(b)):
                    _, sig = ngram_join._signatures(np.zeros(len(s), np.int64), s, np.array([len(s)]), num, den)
                    sigs.append(set(sig.tolist()))
                assert sigs[0] & sigs[1]


def test_unlike_pairs_are_not_compared_by_their_texts(spark, monkeypatch):
    """Texts that have two thirds in common share signatures; their sketches tell them apart. No signatures are stored."""
    rng = random.Random(8)
    common = [f"c{rng.randrange(10**6)}" for _ in range(120)]
    texts = [" ".join(common + [f"o{rng.randrange(10**6)}" for _ in range(60)]) for _ in range(20)]
    rows = list(enumerate([*texts, texts[0] + " more", texts[3].replace("o", "O", 1) + " other words"]))
    compared, stored = [], []
    compare, write = ngram_join._compared, ngram_join.written
    monkeypatch.setattr(ngram_join, "_compared", lambda pairs, *rest: compared.append(pairs.count()) or compare(pairs, *rest))
    monkeypatch.setattr(ngram_join, "written", lambda df, name: stored.extend(df.columns) or write(df, name))
    got = {r.doc_id: r.component_id for r in ngram_join.linked(table(spark, rows), 5, 8, 10).collect()}
    assert got == {i: 0 if i == 20 else 3 if i == 21 else i for i in range(22)} == plain_links(rows, 5, 8, 10)
    assert 2 <= compared[0] <= 10 and "sigs" not in stored


def blocks_family(rng, members):
    """Texts of a common part and two of twelve blocks, of which most pairs have one in common and too little for a link."""
    common = [f"c{rng.randrange(10**6)}" for _ in range(200)]
    blocks = [[f"b{rng.randrange(10**6)}" for _ in range(60)] for _ in range(12)]
    return [" ".join(common + blocks[i] + blocks[j]) for i, j in (sorted(rng.sample(range(12), 2)) for _ in range(members))]


def test_unlike_members_of_a_large_group_are_not_paired(spark, monkeypatch):
    rng = random.Random(11)
    texts = list(dict.fromkeys(blocks_family(rng, 90)))
    rows = list(enumerate([*texts, texts[0].replace("c", "x", 2), texts[5] + " more", texts[7] + " other words"]))
    paired = []
    within = ngram_join._pairs_within
    monkeypatch.setattr(ngram_join, "_pairs_within", lambda groups, condition: paired.append(within(groups, condition).distinct().count()) or within(groups, condition))
    got = {r.doc_id: r.component_id for r in ngram_join.linked(table(spark, rows), 3, 90, 100).collect()}
    want = plain_links(rows, 3, 90, 100)
    assert got == want and len(set(want.values())) == len(texts)
    # Three pairs are linked.
    assert 1 <= sum(paired) <= 6


def test_a_round_of_regrouping_takes_few_shuffles(spark, monkeypatch):
    rows = list(enumerate(dict.fromkeys(blocks_family(random.Random(12), 40))))
    shuffles = []
    for module in (ngram_join, graph):

        def written(df, name, stored=module.written):
            shuffles.append((name, df._jdf.queryExecution().executedPlan().toString().count("- Exchange ")))
            return stored(df, name)

        monkeypatch.setattr(module, "written", written)
    got = {r.doc_id: r.component_id for r in ngram_join.linked(table(spark, rows), 3, 90, 100).collect()}
    assert got == plain_links(rows, 3, 90, 100)
    assert "edits" in dict(shuffles)
    assert sum(n for _, n in shuffles) <= 25, shuffles


def test_components_of_chains_stars_and_loops(spark):
    links = [(i, i + 1) for i in range(10, 30)] + [(50, 40), (50, 41), (42, 41), (60, 60), (70, 71), (71, 70), (71, 70), (80, 82), (81, 82)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == components(sorted({x for link in links for x in link}), links)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_no_stage_has_two_python_workers_a_task(spark, monkeypatch):
    plans = []

    def written(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return stored(df, name)

    stored = ngram_join.written
    monkeypatch.setattr(ngram_join, "written", written)
    rows = [(1, "one two three four five six seven"), (2, "one two three four five six seven"), (2, "else"), (3, "one two three four five six"), (None, "x"), (4, None)]
    got = {r.doc_id: r.component_id for r in ngram_join.linked(table(spark, rows)).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, None: None}
    # What stands between two exchanges is a stage; each function of a chain there would have a worker of its own.
    counts = [stage.count("MapInArrow") for plan in plans for stage in plan.split("Exchange")]
    assert max(counts) == 1 and sum(counts) > 3


def test_sketches_differ_by_no_more_than_their_sets():
    import numpy as np

    rng = np.random.default_rng(4)
    for size in (1, 30, 2000, 100_000):
        a = rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2)
        b = np.concatenate([a[size // 10 :], rng.integers(0, 1 << 63, size // 5, dtype=np.uint64)])
        one, other = (np.frombuffer(x, np.uint8) for x in ngram_join._sketches(np.repeat([0, 1], [len(a), len(b)]), np.concatenate([a, b]), 2).to_pylist())
        assert len(one) == ngram_join.SKETCH and np.minimum(one - other, other - one).sum(dtype=int) <= len(np.setxor1d(a, b))


def test_join_of_odd_rows(spark):
    rows = odd_rows()
    docs = table(spark, rows).selectExpr("*", "1 as component_id", "2 as hi", "'x' as sig")
    got = ngram_join.linked(docs).collect()
    assert len(got) == len(rows)
    assert all(r.component_id is None for r in got if r.doc_id is None) and {r.component_id for r in got if r.doc_id == 8} == {8}
    assert ngram_join.linked(docs.limit(0)).count() == 0
    kept = ngram_join.one_of_each(docs)
    assert kept.columns == docs.columns
    # One row of each id; rows without an id stay.
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 7, 8, 9]


class _Function:
    """Stands for a table, and gives the function that its batches would go through."""

    def select(self, *columns):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("made", [line_dedup.lines_of, lambda docs: ngram_join.document_sets(docs, 5), lambda docs: ngram_join.document_signatures(docs, 5, 8, 10)])
def test_a_batch_of_texts_takes_little_memory(spark, made):
    rng = random.Random(5)
    texts = ["\n".join(" ".join(rng.choices(["alpha", "beta", "gamma", "delta", "e"], k=10)) for _ in range(40)) for _ in range(2000)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(2000)), "row": list(range(2000)), "text": texts})
    assert batch.nbytes > 3 << 20
    run = made(_Function())
    text._powers.clear()
    tracemalloc.start()
    rows = sum(out.num_rows for out in run([batch]))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows in (2000, 80_000) and most < 64 << 20


def test_batches_are_bounded_by_bytes(spark):
    prepared(spark)
    docs = spark.range(0, 600, 1, 1).selectExpr("repeat('abcdefgh ', 2000) as text")
    sizes = docs.mapInArrow(lambda batches: (pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]}) for b in batches), "n long, size long").collect()
    assert sum(r.n for r in sizes) == 600 and max(r.size for r in sizes) < (2 << 20) + 40_000
