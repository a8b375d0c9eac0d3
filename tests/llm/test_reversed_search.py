"""Ranked search by a broadcast index of the items, against plain Python over all pairs."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from labelpool.llm import reversed_search as rs

DOCS = "doc_id bigint, text string, item_id string, rank string, score string, part string"
ITEMS = "item_id bigint, text string, doc_id int, term string, n string"


def plain(docs, items, k=10):
    """Every item against every document."""
    terms = [(i, rs.terms_of(t)) for i, t in docs]
    some = [(i, Counter(ts), len(ts)) for i, ts in terms if ts]
    n_docs, total = len(some), sum(n for *_, n in some)
    df = Counter(t for _, c, _ in some for t in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, []).extend(rs.terms_of(t))
    out = []
    for item, ts in wanted.items():
        scored = []
        for doc, c, n in some:
            m = 100 - 75 + ((75 * n * n_docs) // total)
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m))
                for t in ts
            )
            if score > 0:
                scored.append((-score, doc is None, doc or 0))
        for rank, (s, null, doc) in enumerate(sorted(scored)[:k], 1):
            out.append((item, rank, None if null else doc, -s))
    return sorted(out, key=str)


def run(spark, docs, items, parts=5, **more):
    d = spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in docs], DOCS).repartition(parts)
    q = spark.createDataFrame([(i, t, 1, "x", "y") for i, t in items], ITEMS)
    return sorted((tuple(r) for r in rs.reversed_search(d, q, **more).collect()), key=str)


def text(rng, n, vocabulary=60):
    words = ["Émile", "naïve", "x1", "ÀB", "\U00030000z", "don't", "A_b", "straße"]
    return " ".join(
        rng.choice(words) if rng.random() < 0.2 else "W%d" % (rng.randrange(vocabulary) ** 2 // 20)
        for _ in range(n)
    )


@pytest.mark.parametrize("seed", range(3))
def test_agrees_with_all_pairs(spark, seed):
    rng = random.Random(seed)
    docs = [(i, text(rng, rng.choice([0, 1, 5, 40, 200]))) for i in range(150)]
    docs += [(7, docs[3][1]), (None, docs[4][1]), (None, docs[4][1]), (500, None), (501, " .,-\x7f")]
    items = [(i, text(rng, rng.choice([1, 4, 30]))) for i in range(12)]
    items += [(3, "w0 w1 w1"), (None, "émile x1"), (None, "w4"), (90, None), (91, "--"), (92, "unheardof")]
    want = plain(docs, items)
    assert run(spark, docs, items) == want
    # Blocks of a few items, and chunks of a few documents, give the same.
    assert run(spark, docs, items, postings=40) == want


def test_ties_go_to_the_smaller_id(spark):
    docs = [(i, "alpha beta") for i in range(40, 0, -1)] + [(100 + i, "gamma") for i in range(50)]
    got = run(spark, docs, [(1, "ALPHA")], parts=7)
    assert [r[2] for r in got] == sorted(range(1, 11), key=lambda i: str((1, i)))
    assert got == plain(docs, [(1, "alpha")])


def test_long_texts_and_chunks(spark, monkeypatch):
    rng = random.Random(9)
    docs = [(1, text(rng, 120_000)), (2, "w0" * 3000), (3, text(rng, 50))]
    items = [(1, text(rng, 20)), (2, "w0" * 3000)]
    assert run(spark, docs, items) == plain(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == []
    assert run(spark, [(1, "a")], []) == []
    assert run(spark, [(1, None)], [(1, "a")]) == []


def test_heaps_keep_the_best_of_every_item():
    import numpy as np

    rng = np.random.default_rng(4)
    heaps, rows = rs.Heaps(5, 3), []
    for _ in range(200):
        item, score, doc = rng.integers(0, 5, 40), rng.integers(1, 50, 40), rng.integers(0, 900, 40)
        keep = score >= heaps.least[item]
        heaps.add(item[keep], score[keep], np.zeros(keep.sum(), np.int64), doc[keep])
        heaps.best()
        rows += list(zip(item.tolist(), (-score).tolist(), doc.tolist()))
    want = [r for i in range(5) for r in sorted(x for x in rows if x[0] == i)[:3]]
    assert [(a, -b, d) for a, b, _, d in heaps.best().tolist()] == want


def test_colliding_words_are_compared_by_bytes():
    import numpy as np
    import pyarrow as pa

    index = rs.ItemIndex(pa.array([5]), np.array([0]), ["abc"], np.array([1]))
    data = np.frombuffer(b"ABC abd abc", np.uint8)
    index.hashes = np.array([rs.words(data, np.array([0, 11]), rs.GAPS)[0][1]])
    assert len(index.counts(data, np.array([0, 11]))[0]) == 0


def test_whole_batches_by_partition_merge(spark, monkeypatch):
    monkeypatch.setattr(rs, "MERGE", 2)
    rng = random.Random(2)
    docs = [(i, text(rng, 12)) for i in range(120)]
    assert run(spark, docs, [(1, "w0 w1 émile")], parts=9) == plain(docs, [(1, "w0 w1 émile")])
