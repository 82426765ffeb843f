import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from lorecraft.llm.mixing import mix, plan_mix, source_targets
from lorecraft.llm.sharding import external_shuffle
from tests.llm.conftest import SCHEMA


def targets(sizes: dict) -> dict:
    """Rounds of sharing by weight, with the excess shared anew."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    out, rest, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return out | share
        out |= {s: 3.0 * sizes[s] for s in over}
        rest -= sum(3 * sizes[s] for s in over)
        free -= over
    return out


@pytest.mark.parametrize("sizes", [{"a": 10, "b": 10, "c": 10}, {"a": 1, "b": 1000, None: 3, "é": 40}, {"a": 0, "b": 5}, {None: 0}, {f"s{i}": i * i for i in range(20)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == {s: pytest.approx(t) for s, t in targets(sizes).items()}


def test_mix_keeps_to_targets(spark, rng):
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), "en", rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = plan_mix(df).collect()
    assert len(got) == 3000
    taken, want, size = defaultdict(int), {}, defaultdict(int)
    for r in got:
        assert r["taken"] == r["copies"] * r["size"] <= 3 * r["size"]
        rate = r["target"] / r["source_size"]
        assert int(rate) <= r["copies"] <= int(rate) + 1
        taken[r["source"]] += r["taken"]
        want[r["source"]] = r["target"]
        size[r["source"]] += r["size"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in want)
    assert want == {s: pytest.approx(t) for s, t in targets(size).items()}
    key = lambda rows: sorted((r["doc_id"], r["copies"]) for r in rows)
    assert key(plan_mix(df.repartition(7)).collect()) == key(got)
    assert key(plan_mix(df, seed=99).collect()) != key(got)


def test_probabilities_are_kept(spark):
    df = spark.createDataFrame([(i, "w " * (1 + i % 7), "en", "ab"[i % 2], 0) for i in range(60)], SCHEMA)
    total, rate = defaultdict(int), {}
    for seed in range(12):
        for r in plan_mix(df, seed=seed).collect():
            total[r["source"], r["size"]] += r["copies"]
            rate[r["source"]] = r["target"] / r["source_size"]
    rows = defaultdict(int)
    for r in plan_mix(df).collect():
        rows[r["source"], r["size"]] += 12
    for k, n in total.items():
        assert abs(n / rows[k] - rate[k[0]]) < 0.25


def test_mix_of_odd_rows(docs, empty):
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    got = plan_mix(docs).collect()
    assert len(got) == docs.count()
    sizes = sorted((r["doc_id"] or -1, r["size"]) for r in got)
    assert sizes == sorted((r["doc_id"] or -1, words(r["text"])) for r in docs.collect())
    assert plan_mix(empty).count() == 0 and mix(empty).count() == 0


def test_mixed_rows_repeat(docs):
    clash = docs.withColumn("size", F.lit("clash")).withColumn("copies", F.lit(1))
    out = mix(clash)
    assert out.columns == clash.columns
    plan = defaultdict(int)
    for r in plan_mix(clash).collect():
        plan[r["doc_id"], r["source"]] += r["copies"]
    rows = defaultdict(int)
    for r in out.collect():
        rows[r["doc_id"], r["source"]] += 1
    assert dict(rows) == {k: n for k, n in plan.items() if n}


def test_a_hot_row_is_mixed(spark, monkeypatch):
    """A row that is a third of the table, and rows that differ from it in other columns only."""
    from lorecraft.llm import mixing

    monkeypatch.setattr(mixing, "CHUNK", 50)
    hot = spark.range(700).select(F.lit(7).cast("long").alias("doc_id"), F.lit("five words are in here").alias("text"), (F.col("id") % 4 == 3).cast("int").cast("string").alias("lang"), F.lit("a").alias("source"), F.lit(1).cast("long").alias("n_chars"))
    rest = spark.createDataFrame([(1000 + i, "w " * (i % 9 + 1), "en", "abc"[i % 3], i) for i in range(900)], SCHEMA)
    df = hot.unionByName(rest).repartition(4)
    plan = plan_mix(df).collect()
    assert len(plan) == df.count()
    want, taken = defaultdict(int), defaultdict(int)
    for r in plan:
        want[r["source"]] = r["target"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 9 for s in want)
    mixed = mix(df)
    counts = defaultdict(int)
    for r in mixed.groupBy("doc_id", "source").count().collect():
        counts[r["doc_id"], r["source"]] = r["count"]
    copies = defaultdict(int)
    for r in plan:
        copies[r["doc_id"], r["source"]] += r["copies"]
    assert dict(counts) == {k: n for k, n in copies.items() if n}
    kinds = {r["lang"]: r["count"] for r in mixed.where("doc_id = 7").groupBy("lang").count().collect()}
    base = counts[7, "a"] // 700
    assert base * 525 <= kinds["0"] <= (base + 1) * 525 and base * 175 <= kinds["1"] <= (base + 1) * 175
    key = lambda x: sorted(map(tuple, x.collect()))
    assert key(mix(df.repartition(9))) == key(mixed)


def test_many_sources(spark):
    rows = [(i, "w " * (i % 50 + 1), "en", f"host{i % 400}", 0) for i in range(2000)]
    got = {r["source"]: (r["source_size"], r["target"]) for r in plan_mix(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {s: t for s, (_, t) in got.items()} == {s: pytest.approx(t) for s, t in targets({s: n for s, (n, _) in got.items()}).items()}


def shards(df, **options):
    return [tuple(r) for r in external_shuffle(df, **options).select("doc_id", "shard", "slot").collect()]


def test_shards(spark):
    df = spark.range(10_003).select(F.col("id").alias("doc_id"), (F.col("id") % 50).alias("size"), F.lit("clash").alias("shard"))
    got = shards(df, shards=8, bucket_bytes=20_000)
    assert sorted(i for i, _, _ in got) == list(range(10_003))
    by = defaultdict(list)
    for _, s, slot in got:
        by[s].append(slot)
    assert set(by) == set(range(8)) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in by.values())
    assert sorted(shards(df.repartition(5), shards=8, bucket_bytes=20_000)) == sorted(got)  # whatever the input's splits
    assert sorted(shards(df, shards=8, bucket_bytes=20_000, seed=1)) != sorted(got)


def test_order_is_shuffled(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit(10).alias("size"))
    place = {i: slot * 8 + s for i, s, slot in shards(df, bucket_bytes=4000)}
    n = 4000
    mean = sum((i - n / 2) * (p - n / 2) for i, p in place.items()) / n
    assert abs(mean) < 0.06 * (n * n / 12)  # no correlation of place and id
    moved = sum(abs(place[i + 1] - place[i]) for i in range(n - 1)) / (n - 1)
    assert abs(moved - n / 3) < n * 0.03


def test_odd_rows_are_sharded(spark, docs, empty):
    rows = docs.select("doc_id", (F.octet_length(F.coalesce("text", F.lit(""))) + 1).alias("size"))
    hot = spark.range(1000).select(F.lit(7).cast("long").alias("doc_id"), F.lit(5).alias("size"))  # one row, a thousand times
    both = rows.unionByName(hot)
    got = shards(both, bucket_bytes=500)
    assert len(got) == both.count() and len({(s, slot) for _, s, slot in got}) == len(got)
    assert shards(empty.select("doc_id", F.lit(1).alias("size"))) == []


def test_texts_reach_the_shards(spark, docs, tmp_path):
    long = spark.createDataFrame([(900, "long " * 400_000, "en", "s9", 9)], SCHEMA)
    hot = spark.range(500).select(F.lit(901).cast("long").alias("doc_id"), F.lit("hot text").alias("text"), F.lit("en").alias("lang"), F.lit("s9").alias("source"), F.lit(8).cast("long").alias("n_chars"))
    rows = docs.unionByName(long).unionByName(hot).withColumn("size", F.octet_length(F.coalesce("text", F.lit(""))) + 1)
    out = external_shuffle(rows, bucket_bytes=100_000, path=f"{tmp_path}/out")
    key = lambda df: sorted(repr(tuple(r)) for r in df.select(rows.columns).collect())
    assert key(out) == key(rows)
    stored = [len(spark.read.parquet(f"{tmp_path}/out/shard={k}").select("text").collect()) for k in range(8)]
    assert sum(stored) == rows.count() and max(stored) - min(stored) <= 1
    places = sorted(r["slot"] for r in out.where("doc_id = 901").collect())
    assert places[0] < out.count() / 8 / 4 and places[-1] > out.count() / 8 * 3 / 4  # copies spread over the order


def test_record_bytes_count_all_columns(spark):
    from lorecraft.llm.sharding import record_bytes

    df = spark.createDataFrame([(None, None, None, 1), ("", "é" * 10, ["ab", None], 2)], "a string, b string, c array<string>, d int")
    assert [r[0] for r in df.select(record_bytes(df)).collect()] == [80, 64 + 20 + 32 + 2 + 16]


def test_small_sources_come_near(spark):
    """Ten documents a source, one of them long: the last one goes the way that leaves less."""
    import random

    from pyspark.sql import functions as F

    from lorecraft.llm.mixing import plan_mix

    r = random.Random(12)
    rows = [(100 * s + i, f"s{s}", " ".join(["w"] * (r.randint(20, 300) if i else 3000))) for s in range(12) for i in range(10)]
    plan = plan_mix(spark.createDataFrame(rows, "doc_id long, source string, text string"))
    for x in plan.groupBy("source").agg(F.max("target").alias("t"), F.max("source_size").alias("n"), F.sum("taken").alias("k"), F.collect_list("size").alias("sizes")).collect():
        base = int(x["t"] // x["n"])
        best = min(abs(base * x["n"] + sum(z for b, z in enumerate(x["sizes"]) if m >> b & 1) - x["t"]) for m in range(1 << 10))
        assert abs(x["k"] - x["t"]) <= best + 150  # nearly what the best choice of all leaves
