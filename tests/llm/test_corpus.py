"""Operators over the whole corpus: deduplication, search, packing, quotations, the pipeline."""

import hashlib
import random
import re
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelpool.llm import best_fit_packing, exact_dedup, exact_topk, near_dedup, quotation_links
from labelpool.llm.components import components
from labelpool.llm.spread import join_by_part, with_ids, without_ids

DOC = "doc_id bigint, text string, lang string, source string, id int, n int, kept string, recipe string"


def docs_of(spark, rows, source="s"):
    return spark.createDataFrame([(i, t, "en", source, 1, 2, "x", "y") for i, t in rows], DOC)


def words(rng, n, vocabulary=400):
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(n))


# --- helpers --------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(3)
    edges = {
        "chain": [(i, i + 1) for i in range(40)],
        "star": [(0, i) for i in range(1, 60)],
        "random": [(rng.randrange(80), rng.randrange(80)) for _ in range(60)],
        "none": [],
    }[shape]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    got = {r.id: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {a: find(a) for a in parent if any(find(a) == find(b) for b in parent if b != a)}


def test_id_joins(spark):
    rows = spark.createDataFrame([(i % 50 if i % 7 else None, str(i)) for i in range(200)], "k bigint, t string")
    ids = spark.range(0, 50, 3).withColumnRenamed("id", "_id")
    keys = lambda df: sorted(df.collect(), key=str)
    kept = with_ids(rows, ids, "k")
    assert keys(kept) == keys(rows.where("k % 3 = 0"))
    assert keys(without_ids(rows, ids, "k")) == keys(rows.where("k IS NULL OR k % 3 <> 0"))
    assert without_ids(rows, ids.limit(0), "k").count() == 200
    named = spark.createDataFrame([(1, "a")], "k bigint, v string")
    assert join_by_part(rows, named, ["k"], "t").where("v = 'a'").count() == rows.where("k = 1").count()


# --- exact deduplication --------------------------------------------------------------------


@pytest.mark.parametrize("bits", [64, 5, 0])
def test_exact_dedup(spark, bits):
    rng = random.Random(1)
    long = words(rng, 9000)
    texts = {i: words(rng, rng.randrange(0, 4)) for i in range(60)}
    texts |= {100: None, 101: "", 102: long, 103: long, 104: long + " ", 105: long[1:], 106: " ",
              107: long[:20000] + "X" + long[20001:], 108: "é" * 9000, 109: "é" * 9000}
    rows = list(texts.items()) + [(102, long), (None, long), (None, "alone"), (103, long)]
    out = exact_dedup.exact_dedup(docs_of(spark, rows), hash_bits=bits).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    want = sorted(
        (
            (i, max((x for x in groups[t or ""] if x is not None), default=None), len(groups[t or ""]),
             i == max((x for x in groups[t or ""] if x is not None), default=None),
             hashlib.sha256((t or "").encode()).hexdigest())
            for i, t in rows
        ),
        key=str,
    )
    assert sorted((tuple(r) for r in out), key=str) == want


def test_chunks_depend_on_content_only():
    rng = np.random.default_rng(5)
    body = rng.integers(32, 127, 60_000).astype(np.uint8)
    for shift in (0, 1, 777):
        data = np.concatenate([rng.integers(32, 127, shift).astype(np.uint8), body])
        ends, counts = exact_dedup.cut_points(data, np.array([0, len(data)]))
        assert counts[0] == len(ends) and ends[-1] == len(data)
        tail = {int(e) - shift for e in ends if e - shift > 30_000}
        if shift == 0:
            first = tail
        assert len(tail & first) >= 0.8 * len(first)
    assert exact_dedup.exact_dedup is not None


def test_exact_dedup_of_nothing(spark):
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0


# --- near-duplicates ------------------------------------------------------------------------


def brute_components(rows, size, percent):
    sets = {}
    for i, t in rows:
        if i is None:
            continue
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        s = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
        sets.setdefault(i, []).append(s)
    root = {i: i for i in sets}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in combinations(sorted(sets), 2):
        if any(
            x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]
        ):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: find(i) for i in sets}


@pytest.mark.parametrize("blocks", [(1024, 512, 1 << 19), (7, 3, 1 << 19), (7, 50, 900)])
def test_near_dedup(spark, monkeypatch, blocks):
    """Whole result against all pairs, also with tiny blocks; copies, near copies, shared passages."""
    for name, value in zip(("BUCKET_BLOCK", "SET_BLOCK", "SET_WEIGHT"), blocks):
        monkeypatch.setattr(near_dedup, name, value)
    rng = random.Random(sum(blocks))
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one"), (4, "ONE"), (5, "one two three"), (6, "one  two\tthree"),
            (7, "one three two"), (None, "one"), (8, "one two three four five")]
    base = words(rng, 120).split()
    passage = words(rng, 40)
    for i in range(10, 90):
        w = list(base)
        for _ in range(rng.randrange(0, 9)):
            w[rng.randrange(len(w))] = "x%d" % rng.randrange(10**6)
        rows.append((i, " ".join(w)))
    rows += [(100 + i, words(rng, 80) + " " + passage) for i in range(30)]
    rows += [(200 + i, rows[60][1]) for i in range(10)] + [(60, rows[60][1]), (15, rows[-60][1])]
    out = near_dedup.near_dedup(docs_of(spark, rows), shingle=4, percent=80).collect()
    want = brute_components(rows, 4, 80)
    assert len(out) == len(rows)
    for r in out:
        assert r.component_id == want.get(r.doc_id), r
        assert r.kept == (r.doc_id == r.component_id)


def test_pigeonhole_keys_find_every_pair_under_the_distance():
    """Signatures that differ in fewer slots than vouched for always share a key."""
    rng = np.random.default_rng(3)
    vouched = near_dedup.CHUNKS * (near_dedup.ERRORS + 1) - 1
    for _ in range(500):
        a = rng.integers(0, 1 << 16, near_dedup.SLOTS)
        b = a.copy()
        off = rng.choice(near_dedup.SLOTS, vouched, replace=False)
        b[off] ^= 1
        assert any(all(a[s] == b[s] for s in slots) for slots in near_dedup.KEYS)


def test_near_dedup_of_long_texts_and_nothing(spark):
    rng = random.Random(9)
    long = words(rng, 60_000, 5000)
    rows = [(1, long), (2, long + " tail of a few more words"), (3, words(rng, 60_000, 5000))]
    out = {r.doc_id: r.component_id for r in near_dedup.near_dedup(docs_of(spark, rows)).collect()}
    assert out == {1: 1, 2: 1, 3: 3}
    assert near_dedup.near_dedup(docs_of(spark, [])).count() == 0


# --- top-k ----------------------------------------------------------------------------------


def brute_top(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.setdefault(i, []).append([int(np.floor(1024 * np.float64(x))) for x in v])
    out = set()
    for q in good:
        if q % 10:
            continue
        scored = {
            (-sum(a * b for a, b in zip(x, y)), c, j)
            for x in good[q][:1] for c in good if c != q for j, y in enumerate(good[c])
        }
        out |= {(q, r + 1, c, -s) for r, (s, c, _) in enumerate(sorted(scored)[:k])}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_top_k(spark, monkeypatch, small):
    if small:
        for name, value in (("SHARD_BYTES", 8 * 8 * 24), ("BLOCK", 8), ("SUMMARIES", 2), ("CHUNKS", 2)):
            monkeypatch.setattr(exact_topk, name, value)
    rng = np.random.default_rng(4)
    vec = lambda: [float(np.float32(x)) for x in rng.normal(size=8)]
    hot = vec()
    rows = [(i, vec()) for i in range(120)] + [(200 + i, hot) for i in range(80)]
    rows += [(300, None), (310, [1.0, None]), (320, [float("nan")] * 8), (330, [float("inf")] * 8), (340, []),
             (350, [1.0, -1.0]), (None, vec()), (401, rows[3][1])]
    df = spark.createDataFrame([(i, v, 0, 0) for i, v in rows], "vec_id bigint, embedding array<float>, score int, id int")
    out = exact_topk.top_k(df, F.col("vec_id") % 10 == 0, k=10).collect()
    assert {tuple(r) for r in out} == brute_top(rows, 10)


def test_top_k_with_few_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = spark.createDataFrame([(0, [1.0]), (1, [2.0])], schema)
    assert [tuple(r) for r in exact_topk.top_k(few, F.col("vec_id") == 0).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert exact_topk.top_k(few.limit(0), F.col("vec_id") == 0).count() == 0
    assert exact_topk.top_k(few, F.lit(False)).count() == 0


def test_blocks_are_skipped():
    """A far block is not scored once its bound is below the k-th score."""
    data = np.repeat(np.array([[100, 0], [1, 0]]), exact_topk.BLOCK, axis=0)
    ids = np.arange(len(data))
    starts = np.array([0, exact_topk.BLOCK, len(data)])
    shard = {"ids": ids, "data": data, "starts": starts, "first_id": ids[starts[:-1]]}
    bound = exact_topk.bounds(np.array([[5, 0]]), np.array([[100, 0], [1, 0]]), np.array([[100, 0], [1, 0]]))
    best = exact_topk.Best(10)
    assert exact_topk.search_shard(-1, np.array([5, 0]), bound[0], shard, best) == 1
    assert best.id.tolist() == list(range(10))


# --- packing --------------------------------------------------------------------------------


def brute_fit(items, capacity):
    bins = []
    out = []
    for length, source, cluster in items:
        fits = [
            (b["rest"], i) for i, b in enumerate(bins)
            if b["rest"] >= length and (source is None or source not in b["s"])
            and (cluster is None or cluster not in b["c"])
        ]
        if fits:
            i = min(fits)[1]
        else:
            i = len(bins)
            bins.append({"rest": capacity, "s": set(), "c": set()})
        out.append((i, capacity - bins[i]["rest"]))
        bins[i]["rest"] -= length
        bins[i]["s"].add(source)
        bins[i]["c"].add(cluster)
    return out


def test_best_fit_is_the_tightest_compatible_bin():
    rng = random.Random(6)
    for _ in range(200):
        items = sorted(
            ((rng.randrange(0, 60), rng.choice([None, 0, 1, 2, 3]), rng.choice([None, 0, 1, 2, 3, 4, 5]))
             for _ in range(80)),
            key=lambda x: -x[0],
        )
        assert best_fit_packing.best_fit(items, 60) == brute_fit(items, 60)


def test_equal_rows_are_dealt_round_the_shards(spark, monkeypatch):
    monkeypatch.setattr(best_fit_packing, "COPIES", 300)
    docs = spark.range(20_000).select(
        F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("string").alias("text"), F.lit("s").alias("source")
    )
    copies = spark.range(500).select(F.lit(7).cast("bigint").alias("doc_id"), F.lit("a b").alias("text"), F.lit(None).alias("source"))
    out = best_fit_packing.pack(docs.union(copies), shard_rows=1000)
    sizes = {(r.doc_id, r.shard): r.n for r in out.groupBy("doc_id", "shard").agg(F.count("*").alias("n")).collect()}
    # 20,500 rows make 21 shards; no kind of row has more than its even share in one.
    assert sum(n for (i, _), n in sizes.items() if i is None) == 20_000
    assert sum(n for (i, _), n in sizes.items() if i == 7) == 500
    assert max(n for (i, _), n in sizes.items() if i is None) == -(-20_000 // 21)
    assert max(n for (i, _), n in sizes.items() if i == 7) == -(-500 // 21)
    # Copies share no bin.
    held = out.where("doc_id = 7").groupBy("shard", "bin").count()
    assert held.where("count > 1").count() == 0


def test_pack(spark):
    rng = random.Random(7)
    rows = [(i, words(rng, rng.randrange(0, 300)), "s%d" % (i % 3 and i % 40)) for i in range(600)]
    rows += [(1000, None, "s1"), (1001, "", None), (1002, words(rng, 1000), "s2"), (1003, rows[5][1], "s9"),
             (5, rows[5][1], "s5"), (5, rows[5][1], "s5"), (None, "a b", None)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id bigint, text string, source string, bin int, shard int")
    out = best_fit_packing.pack(df, capacity=256, shard_rows=100).toPandas()
    lengths = {}
    for i, t, _ in rows:
        lengths.setdefault(i, []).append(len((t or "").split()))
    got = out.groupby("doc_id", dropna=False).n_words.sum()
    for i, n in lengths.items():
        assert (got[i] if i is not None else got[got.index.isna()].iloc[0]) == sum(n)
    source = {r[0]: r[2] for r in rows}
    text = {r[0]: r[1] for r in rows}
    for _, b in out.groupby(["shard", "bin"]):
        assert b.n_words.sum() <= 256
        b = b.sort_values(["bin_offset", "n_words"])
        assert (b.bin_offset.to_numpy()[1:] == (b.bin_offset + b.n_words).to_numpy()[:-1]).all()
        ids = [None if np.isnan(x) else int(x) for x in b.doc_id]
        own = [source[i] for i in ids if source[i] is not None]
        assert len(own) == len(set(own))
        texts = [text[i] for i in ids if text[i] is not None]
        assert len(texts) == len(set(texts))
    assert best_fit_packing.pack(df.limit(0)).count() == 0


# --- quotations -----------------------------------------------------------------------------


def test_parse_levels():
    text = "Hello\nOn Monday, Ann wrote:\n> > deep  Line\n>> deeper\n> near\n>\nBye"
    clean, own, quoted = quotation_links.parse(text)
    assert clean == "Hello\nBye" and own == ["hello", "bye"]
    assert quoted == [(2, "deep line"), (2, "deeper"), (1, "near")]
    assert quotation_links.parse(None) == quotation_links.parse("") == ("", [], [])


def test_links_and_order(spark):
    rows = [
        (1, 0, "a", "first thing"), (1, 1, "b", "second thing"), (1, 2, "c", "> first thing\nreply to first"),
        (1, 3, "d", "> second thing\nreply to second"), (1, 4, "e", "> reply to first\n>> first thing\nagain"),
        (1, 5, "f", "> never said\nfresh"), (1, 6, "g", "> later\nx"), (1, 7, "h", "later"),
        (2, 0, "a", "> first thing\nother conversation"), (None, 0, "n", "> first thing"), (1, None, "m", "> first thing"),
        (3, 0, "a", None), (3, 0, "a", None), (3, 1, "b", ""),
    ]
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, thread string")
    out = quotation_links.link_quotations(df)
    got = {(r.conv_id, r.role): (r.reply_to, r.thread, r.n_linked, r.n_quoted) for r in out.collect()}
    assert len(out.collect()) == len(rows)
    assert got[1, "c"] == (0, 0, 1, 1) and got[1, "d"] == (1, 1, 1, 1) and got[1, "e"] == (2, 0, 2, 2)
    assert got[1, "f"] == (None, 5, 0, 1) and got[1, "g"] == (None, 6, 0, 1) and got[2, "a"] == (None, 0, 0, 1)
    assert got[None, "n"][0] is None and got[1, "m"][0] is None
    order = [r.role for r in out.where("conv_id = 1").orderBy("position").collect()]
    assert order == ["m", "a", "c", "e", "b", "d", "f", "g", "h"]
    for c, n in ((1, 9), (2, 1), (3, 3)):
        assert sorted(r.position for r in out.where(f"conv_id = {c}").collect()) == list(range(n))
    chat = quotation_links.chat_records(out).where("conv_id = 1").first().chat
    assert ">" not in chat and chat.index("reply to first") < chat.index("second thing")
    assert quotation_links.link_quotations(df.limit(0)).count() == 0


def test_a_long_chain_of_replies(spark):
    rows = [(1, 0, "u", "line 0 here")] + [
        (1, i, "u", f"> line {i - 1} here\nline {i} here") for i in range(1, 70)
    ]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = quotation_links.link_quotations(df).collect()
    assert {r.thread for r in out} == {0}
    assert sorted((r.turn, r.position) for r in out) == [(i, i) for i in range(70)]
