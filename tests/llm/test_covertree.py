"""Hard negatives against brute force, and what a cover tree promises."""

import math
import random

import numpy as np
import pytest

from expogrid.llm import covertree, queries

SCHEMA = "vec_id long, embedding array<float>, label int, rank string, id int"


def slow(rows, asks, positives=5, negatives=5):
    known = [(i, [math.floor(256 * float(x)) for x in v], l) for i, v, l in rows if i is not None and l is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, label in known:
        if not asks(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, l) for i, w, l in known if i != a)
        for p, i, _ in [s for s in scored if s[2] == label][:positives]:
            found = [(n, j) for n, j, l in scored if l != label and 80 * -p <= 100 * -n <= 100 * -p][:negatives]
            out += [(a, i, rank, j, -p, -n) for rank, (n, j) in enumerate(found, 1)]
    return sorted(out)


def got(spark, rows, asks, **settings):
    df = spark.createDataFrame([(i, v, l, "x", 1) for i, v, l in rows], SCHEMA)
    return sorted(tuple(r) for r in covertree.hard_negatives(df, asks, **settings).collect())


def vectors(seed, n, width):
    r = random.Random(seed)
    centers = [[r.gauss(0, 0.5) for _ in range(width)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = r.choice(centers)
        v = [float(np.float32(x + r.gauss(0, r.choice([0.0, 0.02, 0.4])))) for x in c]
        rows.append((i, v, r.randrange(3)))
    return rows


@pytest.mark.parametrize("width,tree_rows,block", [(8, 10_000, 10_000), (3, 70, 7), (40, 150, 20)])
def test_equal_to_brute_force(spark, width, tree_rows, block):
    rows = vectors(width, 500, width)
    rows += [(600, None, 1), (700, rows[0][1], None), (800, [1.0] * (width - 1) + [float("nan")], 1), (900, [float("inf")] * width, 1), (1000, [None] * width, 2), (None, rows[1][1], 1)]
    rows += [(2000 + i, rows[5][1], i % 2) for i in range(40)] + [(3000, [0.0] * width, 0), (4000, [-0.5] * width, 1), (5000, [0.3], 1), (6000, [], 0), (7000, [300.0] * width, 2)]
    assert got(spark, rows, covertree.F.col("vec_id") % 10 == 0, tree_rows=tree_rows, block=block) == slow(rows, lambda i: i % 10 == 0)


def test_few_rows(spark):
    everything = covertree.F.lit(True)
    assert got(spark, [], everything) == [] and got(spark, [(1, [1.0], 0)], everything) == []
    rows = [(1, [1.0, 0.0], 0), (2, [1.0, 0.0], 0), (3, [0.9, 0.0], 1), (4, [0.79, 0.0], 1)]
    assert got(spark, rows, everything) == slow(rows, lambda i: True)
    assert got(spark, rows, covertree.F.lit(False)) == []


def test_numbers_too_large_for_floats():
    a = np.floor(np.array([[3e9, 1.0], [2e9, -7.0]]) * 256)
    assert covertree.exact(a, a).tolist() == [[min(2**63 - 1, sum(int(x) * int(y) for x, y in zip(p, q))) for q in a.tolist()] for p in a.tolist()]


@pytest.mark.parametrize("width", [2, 5, 30])
def test_tree_keeps_its_promises(width):
    points = covertree.whole_numbers([v for _, v, _ in vectors(width, 700, width)])
    tree = covertree.CoverTree(points, leaf=8)
    assert sorted(tree.order.tolist()) == list(range(len(points)))
    norms = (tree.points**2).sum(axis=1)
    full = np.column_stack((tree.points, np.sqrt(tree.norm**2 - norms)))
    assert np.allclose(np.sqrt((full**2).sum(axis=1)), tree.norm)
    rows = lambda n: np.arange(tree.start[n], tree.start[n] + tree.size[n])
    for n in range(len(tree.start)):
        assert np.sqrt(((full[rows(n)] - full[tree.start[n]]) ** 2).sum(axis=1)).max() <= tree.radius[n] + 1e-3
        kids = np.arange(tree.first[n], tree.first[n] + tree.count[n])
        if len(kids):
            reach = covertree.BASE ** (tree.level[n] - 1)
            assert tree.start[kids[0]] == tree.start[n] and tree.size[kids].sum() == tree.size[n]
            assert (tree.radius[kids] <= reach + 1e-6).all()
            centers = full[tree.start[kids]]
            apart = np.sqrt(((centers[:, None] - centers) ** 2).sum(axis=2))[np.triu_indices(len(kids), 1)]
            assert not len(apart) or apart.min() > reach - 1e-3
    query = points[17] * 0.7
    low, high = tree.bounds(query, np.arange(len(tree.start)))
    for n in range(len(tree.start)):
        score = tree.points[rows(n)] @ query
        assert low[n] <= score.min() and score.max() <= high[n]


def test_search_skips_nodes():
    """On clustered vectors a search verifies few of them."""
    r = np.random.default_rng(1)
    points = np.floor(256 * (np.repeat(r.normal(size=(60, 16)), 100, axis=0) + 0.01 * r.normal(size=(6000, 16))))
    tree = covertree.CoverTree(points)
    ids, labels = tree.order, np.zeros(len(points), int)
    seen = []

    class Counted(covertree.Best):
        def verify(self, rows):
            seen.append(len(rows))
            super().verify(rows)

    best = Counted(tree, ids, labels, {"id": -1, "label": 0, "windows": None}, points[3], 5)
    tree.search(points[3], best)
    scores = (points @ points[3]).astype(int)
    want = sorted((-s, i) for i, s in enumerate(scores.tolist()))[:5]
    assert best.lists[0] == want and sum(seen) < 1500


def test_query_equals_brute_force(spark):
    folder = "/root/testdata/sf0.01"
    rows = [(r.vec_id, r.embedding, None if r.label is None else (r.label + 1) % 10 if r.vec_id % 7 == 0 else r.label) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    found = sorted(tuple(r) for r in queries.op13_cover_tree_negatives(spark, folder).collect())
    assert found == slow(rows, lambda i: i % 100 == 0) and found
