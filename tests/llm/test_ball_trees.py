"""Rounds over ball trees against rounds over all pairs."""

import hashlib
import math
import random

import numpy as np
import pytest

from lorecraft.llm import ball_trees
from lorecraft.llm.ball_trees import BallTree, added, cluster, huge, parted
from lorecraft.llm.queries import op13_clusters


def wanted(rows, width, scale=1024, k=8, rounds=10, seed=3):
    """id -> list of (cluster, distance, cluster inertia, inertia, centroid), in exact integers."""
    kept = [(i, huge(v, scale)) for i, v in rows if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in first]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for j in range(len(centroids)):
            members = [v for (_, v), o in zip(kept, own) if o == j]
            if members:
                centroids[j] = [sum(x) // len(members) for x in zip(*members)]
    last = [nearest(v) for _, v in kept]
    inertia = {j: sum(d for d, o in last if o == j) for j in range(len(centroids))}
    long = lambda x: x if x < 2**63 else None
    return sorted((str(i), j, str(long(d)), str(long(inertia[j])), str(long(sum(inertia.values()))), ",".join(map(str, centroids[j]))) for (i, _), (d, j) in zip(kept, last))


def found(df, **options):
    return sorted((str(r[0]), r[1], *(str(x) for x in r[2:5]), r[5]) for r in cluster(df, **options).collect())


def blobs(r, n, width):
    centres = [[r.uniform(-1, 1) for _ in range(width)] for _ in range(6)]
    return [(i, [x + r.gauss(0, 0.05 if i % 2 else 0.6) for x in r.choice(centres)]) for i in range(n)]


@pytest.fixture()
def small(monkeypatch):
    monkeypatch.setattr(ball_trees, "TREE", 100)
    monkeypatch.setattr(ball_trees, "LEAF", 4)


def test_tree_sums_and_whole_balls():
    r = np.random.default_rng(1)
    points = np.floor(np.concatenate([r.normal(c * 1000, 30, (500, 5)) for c in range(4)]))
    tree, order = BallTree.build(points)
    assert sorted(order.tolist()) == list(range(len(points))) and (tree.points == points[order]).all()
    for a, b, centre, radius, total in zip(tree.lo, tree.hi, tree.centre, tree.radius, tree.sums):
        assert (tree.points[a:b].sum(0) == total).all()
        assert np.sqrt(((tree.points[a:b] - centre) ** 2).sum(1)).max() <= radius * (1 + 1e-12)
    centroids = np.array([[c * 1000.0] * 5 for c in range(4)] + [[500.0] * 5])
    got, counts, sums = tree.assign(centroids)
    want = ((tree.points[:, None] - centroids[None]) ** 2).sum(2).argmin(1)
    assert (got == want).all() and (counts == np.bincount(want, minlength=5)).all()
    assert all((sums[j] == tree.points[want == j].sum(0)).all() for j in range(5))


def test_blobs(spark, small):
    rows = blobs(random.Random(1), 700, 6)
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster string").repartition(3)
    assert found(df, width=6) == wanted(rows, 6)


def test_ties_copies_and_few_vectors(spark, small):
    r = random.Random(2)
    grid = [(i, [float(r.randint(-2, 2)), float(r.randint(-2, 2))]) for i in range(300)]
    rows = grid + [(7, [0.0, 0.0]), (7, [1.0, 0.0]), (None, [2.0, 2.0])] + [(500 + i, [1.0, 1.0]) for i in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert found(df, width=2, scale=1) == wanted(rows, 2, scale=1)
    assert found(df.where("vec_id IN (3, 7)"), width=2) == wanted([x for x in rows if x[0] in (3, 7)], 2)
    assert found(df.limit(0), width=2) == []


def test_odd_vectors(spark, small):
    inf, nan = float("inf"), float("nan")
    rows = blobs(random.Random(3), 150, 3) + [(1000, None), (1001, []), (1002, [1.0, 2.0]), (1003, [1.0, None, 2.0]), (1004, [inf, 0.0, 0.0]), (1005, [nan, 0.0, 0.0]), (1006, [0.0, 0.0, 0.0]), (1007, [-0.0, 1e-300, -1e-300])]
    large = [(2000, [1e300, -1e300, 1.5]), (2001, [1e9, 1e9, -1e9]), (2002, [1e9 + 1, 1e9, -1e9]), (2003, [-1.7e308, 3.0, 4.0])]
    for own in (rows, rows + large):
        df = spark.createDataFrame(own, "vec_id long, embedding array<double>").repartition(2)
        assert found(df, width=3, k=5, rounds=4) == wanted(own, 3, k=5, rounds=4)


def test_parts_of_sums():
    r = random.Random(4)
    totals = {j: [r.randint(-(10**k), 10**k) for k in (0, 3, 12, 13, 40, 320)] for j in range(20)}
    rows = parted(totals).to_pylist() + parted(totals).to_pylist()
    assert added([tuple(x.values()) for x in rows], 6) == {j: [2 * x for x in t] for j, t in totals.items() if any(t)}


def test_query(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, [float(np.float32(x)) for x in v]) for i, v in blobs(r, 300, 64)] + [(900, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op13_clusters(spark, str(tmp_path))
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    want = [(*w[:5], hashlib.sha256(w[5].encode()).hexdigest()) for w in wanted(rows, 64)]
    assert sorted((str(x[0]), x[1], *(str(y) for y in x[2:5]), x[5]) for x in got.collect()) == want
