import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorecraft.llm import near_dups as N
from tests.llm.conftest import ODD, SCHEMA, prose


def weighted(a: np.ndarray, b: np.ndarray) -> float:
    x, y = Counter(a.tolist()), Counter(b.tolist())
    return sum((x & y).values()) / max(1, sum((x | y).values()))


def brute(rows: list[tuple[int, str | None]], threshold: float = 0.8) -> dict[int, int]:
    runs = {i: next(iter(N.runs_of([t or ""]))) for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, _ in rows:
        for j, _ in rows:
            if i < j and len(runs[i]) and weighted(runs[i], runs[j]) >= threshold:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: find(i) for i, _ in rows}


def test_signatures_estimate_weighted_jaccard():
    r = np.random.default_rng(2)
    errors = []
    for _ in range(40):
        base = r.integers(0, 2**63, 60).astype(np.uint64)
        x, y = r.integers(0, 9, 60), r.integers(0, 9, 60)
        a, b = (base[x > 0], x[x > 0]), (base[y > 0], y[y > 0])
        s = N.signatures([a, b], 256)
        errors.append((s[0] == s[1]).mean() - np.minimum(x, y).sum() / np.maximum(x, y).sum())
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.06


def test_signatures_do_not_depend_on_neighbours():
    bags = [(np.array([1, 2, 3], np.uint64), np.array([1, 5, 130])), (np.zeros(0, np.uint64), np.zeros(0, int)), (np.array([2], np.uint64), np.array([1]))]
    together = N.signatures(bags)
    for bag, row in zip(bags, together):
        assert (N.signatures([bag])[0] == row).all()
    assert np.isinf(together[1]).all() and np.isfinite(together[[0, 2]]).all()


def test_elements_count_occurrences():
    e = N.elements_of(np.array([7, 7, 9], np.uint64))
    assert len(set(e.tolist())) == 3 and len(set(e.tolist()) & set(N.elements_of(np.array([7, 8], np.uint64)).tolist())) == 1


def edited(r: random.Random, text: str, edits: int) -> str:
    w = text.split()
    for _ in range(edits):
        w[r.randrange(len(w))] = f"edit{r.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("small", [64, 3])
def test_against_brute_force(spark, monkeypatch, small):
    monkeypatch.setattr(N, "SMALL", small)  # 3: the way of large buckets
    r = random.Random(6)
    base = prose(r, 150)
    rows = [(i, t) for i, t in enumerate(ODD)]
    rows += [(100 + i, edited(r, base, r.choice([0, 1, 1, 2, 3, 4, 6]))) for i in range(60)]
    shared = edited(r, base, 5)
    rows += [(200 + i, edited(r, shared, r.choice([0, 1, 2]))) for i in range(20)]  # copies of a copy
    rows += [(300 + i, prose(r, 80)) for i in range(20)]
    rows += [(400 + i, rows[13][1]) for i in range(6)]
    rows += [(500, rows[13][1].upper()), (501, " ".join(["again"] * 40)), (502, " ".join(["again"] * 44))]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("class_id", F.lit("clash")).repartition(5)
    got = {x["doc_id"]: x for x in N.near_duplicates(df).collect()}
    want = brute(rows)
    assert {i: x["class_id"] for i, x in got.items()} == want
    assert all(x["kept"] == (x["class_id"] == i) for i, x in got.items())


def test_repeated_ids_of_different_texts(spark, rng):
    a, b, c = (prose(rng, 60) for _ in range(3))
    rows = [(100, a), (100, b), (200, a + " more"), (300, b + " more"), (400, c), (100, a), (None, c), (500, "")]
    got = sorted((x["doc_id"], x["class_id"], x["kept"]) for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect() if x["doc_id"])
    assert got == [(100, 100, True)] * 3 + [(200, 100, False), (300, 100, False), (400, 400, True), (500, 500, True)]
    left = N.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(str(x["doc_id"]) for x in left) == ["100", "400", "500", "None"]


def test_group_below_the_threshold(spark, monkeypatch):
    """Hundreds of texts that share bands but mostly aren't links: classes are those of all pairs."""
    monkeypatch.setattr(N, "PART", 50)
    r = random.Random(8)
    base = prose(r, 100)
    rows = [(i, edited(r, base, r.choice([1, 2, 3, 3, 4, 4, 5]))) for i in range(300)]
    got = {x["doc_id"]: x["class_id"] for x in N.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert got == want and 20 < len(set(want.values())) < 290


def test_odd_rows(spark, docs, empty):
    got = N.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert all(x["kept"] and x["class_id"] is None for x in got if x["doc_id"] is None)
    left = N.drop_near_duplicates(docs)
    assert left.columns == docs.columns
    ids = [x["doc_id"] for x in left.collect()]
    assert len(ids) == len(set(ids)) and None in ids  # a repeated row stays once
    assert N.near_duplicates(empty).count() == 0 and N.drop_near_duplicates(empty).count() == 0
    nulls = spark.createDataFrame([(1, None, None, None, None)], SCHEMA)
    assert N.near_duplicates(nulls).first()["kept"]
