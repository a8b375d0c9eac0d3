"""Near-duplicate vectors against all pairs, and the recall of the filters alone."""

import numpy as np
import pytest

from labelpool.llm import cap_filters as cf

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, key string, size int, x string"


def plain(rows, threshold=0.95):
    """(vec_id, n_links, component_id, kept) by comparing all pairs."""
    width = max([len(v) for _, v in rows if v] or [1])
    use, dense = [], []
    for k, (_, v) in enumerate(rows):
        if v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            use.append(k)
            dense.append(np.pad(np.array(v, np.float32).astype(float), (0, width - len(v))))
    parent = list(range(len(rows)))

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    links = [0] * len(rows)
    if use:
        d = np.array(dense)
        d = d / np.abs(d).max(axis=1, keepdims=True)
        u = d / np.linalg.norm(d, axis=1, keepdims=True)
        near = u @ u.T >= threshold
        np.fill_diagonal(near, False)
        for a, b in zip(*np.nonzero(near)):
            links[use[a]] += 1
            x, y = sorted((find(use[a]), find(use[b])))
            parent[y] = x
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(least.get(find(k), i), i)
    return [(i, links[k], least.get(find(k)), i is not None and i == least.get(find(k))) for k, (i, _) in enumerate(rows)]


def near_to(rng, u, cosine):
    w = rng.normal(size=u.shape)
    w -= (w @ u) * u
    return cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w)


def unit(rng, n, width=64):
    v = rng.normal(size=(n, width))
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def run(spark, rows, parts=6):
    frame = spark.createDataFrame([(i, v, 1, "a", "b", 2, "c") for i, v in rows], SCHEMA)
    return [tuple(r) for r in cf.cap_near_dedup(frame.repartition(parts)).collect()]


def same(got, want):
    order = lambda r: tuple((x is None, x) for x in r)
    return sorted(got, key=order) == sorted(want, key=order)


@pytest.mark.parametrize("rows", [500, 20_000, 1_000_000])
def test_filters_find_pairs_at_the_threshold(rows):
    rng = np.random.default_rng(rows)
    u = unit(rng, 400)
    codes = cf.Codes(rows, 64)
    for cosine, least in ((0.951, 0.985), (0.98, 0.995)):
        v = np.array([near_to(rng, x, cosine) for x in u])
        found, passed = np.zeros(len(u), bool), 0
        for c in range(cf.CODES):
            pairs = [set(zip(*(x.tolist() for x in codes.decode(y, c)))) for y in (u, v)]
            passed += len(pairs[0])
            found[[r for r, _ in pairs[0] & pairs[1]]] = True
        assert found.mean() >= least
        assert cf.CODES <= passed / len(u) <= 20


def test_list_decoding_finds_every_direction():
    rng = np.random.default_rng(3)
    codes, u = cf.Codes(3000, 20), unit(rng, 50, 20)
    turned = codes.turned(u, 2)
    assert np.allclose(turned @ turned.T, u @ u.T)
    half = codes.width // 2
    first, second = turned[:, :half] @ codes.books[2, 0], turned[:, half:] @ codes.books[2, 1]
    every = (first[:, :, None] + second[:, None, :]).reshape(50, -1)
    want = (every >= codes.height) | (every >= every.max(axis=1, keepdims=True) - 1e-12)
    row, name = codes.decode(u, 2)
    assert set(zip(row.tolist(), (name - 2 * codes.words**2).tolist())) == set(zip(*(x.tolist() for x in np.nonzero(want))))
    assert len(row) == len(set(zip(row.tolist(), name.tolist())))


def test_agrees_with_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = unit(rng, 700)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, near_to(rng, base[i % 90], c).tolist()) for i, c in enumerate(rng.uniform(0.93, 0.999, 260))]
    rows += [(2000 + i, (base[i] * 7).tolist()) for i in range(40)]
    rows += [(3000 + i, base[5].tolist()) for i in range(300)]
    centre = unit(rng, 1)[0]
    rows += [(4000 + i, near_to(rng, centre, 0.985).tolist()) for i in range(900)]
    got, want = run(spark, rows), plain([(i, np.float32(v).tolist()) for i, v in rows])
    links = sum(n for _, n, *_ in want)
    assert sum(n for _, n, *_ in got) <= links
    assert sum(n for _, n, *_ in got) >= 0.99 * links
    assert sum(a == b for a, b in zip(sorted(got), sorted(want))) >= 0.99 * len(rows)


def test_defined_cases(spark):
    v = unit(np.random.default_rng(2), 3)
    a, b, c = (x.tolist() for x in v.astype(np.float32))
    nan, inf = float("nan"), float("inf")
    rows = [(9, a), (4, a), (None, a), (4, b), (4, b), (None, c), (None, None), (7, None), (8, []), (10, [0.0] * 64),
            (11, [-0.0] * 64), (12, [nan] + a[1:]), (13, [inf] + a[1:]), (14, [None] + a[1:]), (15, [1.0]),
            (16, [2.0, 0.0]), (17, [1.0, -0.0]), (18, [-1.0]), (19, [1e-38, 0.0]), (20, [3e38, 0.0, 0.0]), (8, [])]
    assert same(run(spark, rows), plain(rows))


def test_empty_and_single(spark):
    assert run(spark, []) == []
    assert run(spark, [(3, [1.0, 2.0])]) == [(3, 0, 3, True)]
    assert run(spark, [(3, None)]) == [(3, 0, 3, True)]


def test_components_of_a_tile():
    rng = np.random.default_rng(6)
    for n in (1, 2, 30):
        near = rng.random((n, n)) < 1.2 / n
        near |= near.T
        label = cf.connected(near)
        reach = np.linalg.matrix_power((near | np.eye(n, dtype=bool)).astype(float), n) > 0
        assert label.tolist() == [int(np.flatnonzero(r)[0]) for r in reach]
