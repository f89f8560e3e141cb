import pyarrow as pa

from footprints.llm.storage import prepared
from footprints.llm.text import Words, line_breaks, pieces, raw
from tests.llm.plain import odd_rows, words


def test_words_of_a_batch():
    texts = [r[1] for r in odd_rows()] + ["Ab aB\nab", "ab", " ab "]
    found = Words(pa.array(texts))
    assert found.counts.tolist() == [len(words(t)) for t in texts]
    flat = [w for t in texts for w in words(t)]
    by = {}
    for h, w in zip(found.hash.tolist(), flat, strict=True):
        assert by.setdefault(w, h) == h
    assert len(set(by.values())) == len(by)


def test_lines_of_a_batch():
    texts = ["a\n\nb", "", "\n", None, "x\n", "y"]
    data, at = raw(pa.array(texts))
    breaks, of = line_breaks(data, at)
    got = [bytes(data[a:b]).decode().removesuffix("\n") for a, b in zip(breaks[:-1], breaks[1:])]
    assert got == [line for t in texts for line in (t or "").split("\n")]
    assert of.tolist() == [0, 0, 0, 1, 2, 2, 3, 4, 4, 5]


def test_pieces_keep_all_rows():
    batch = pa.RecordBatch.from_pydict({"text": ["a" * 10, None, "", "b" * 100, "c"]})
    assert [p.num_rows for p in pieces(batch, limit=20)] == [3, 1, 1]
    assert list(pieces(batch.slice(0, 0))) == []


def test_workers_give_memory_back(spark):
    def run(batches):
        import re

        import numpy as np

        def own():
            return int(re.search(r"Pss_Anon:\s+(\d+)", open("/proc/self/smaps_rollup").read())[1]) >> 10

        for _ in batches:
            np.ones(1 << 20)  # from the first array on that is freed, the allocator would keep others of its size
        before = own()
        held = [(np.ones(3 << 16), bytes(1000 + i)) for i in range(100)]
        most = own()
        held = [small for _, small in held]
        yield pa.RecordBatch.from_pylist([{"most": most - before, "left": own() - before, "pool": pa.default_memory_pool().backend_name}])

    got = prepared(spark).range(1).repartition(1).mapInArrow(run, "most long, left long, pool string").collect()
    assert all(r.most > 140 and r.left < 30 and r.pool == "system" for r in got)
