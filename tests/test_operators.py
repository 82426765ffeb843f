import itertools
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecraft.functions.models import EchoModel, HashEmbedding, complete, embed, gleaned
from lorecraft.operators import graph as G
from lorecraft.operators import instruct as I
from lorecraft.operators import mentions as M
from lorecraft.operators import metrics as E
from lorecraft.operators import reason as Z
from lorecraft.operators import retrieve as S
from lorecraft.operators.components import connected_components


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_match_modes(spark):
    s = spark.createDataFrame([(0, i, w) for i, w in enumerate(["an article", "is smart", "the art.", "some arts"])], "doc long, pos int, sentence string")
    n = spark.createDataFrame([("art",)], "name string")
    assert [p for _, p, _ in rows(M.link_names(s, n), "doc", "pos", "name")] == [2, 3]
    assert [p for _, p, _ in rows(M.link_names(s, n, match="prefix"), "doc", "pos", "name")] == [0, 2, 3]
    upper = spark.createDataFrame([("ART",)], "name string")
    assert rows(M.link_names(s, upper), "pos") == []
    assert len(rows(M.link_names(s, upper, ignore_case=True), "pos")) == 2


def test_names_of_words_and_marks(spark):
    lines = ["We met in New York with Müller and Anna.", "New  York is not it, nor Newest York.", "Two New Yorks: O'Brien's and a C++ one.", "C+ and ÑC++11, über-Müllers", "x, y (z", "a(b) and (b)"]
    s = spark.createDataFrame([(0, i, w) for i, w in enumerate(lines)], "doc long, pos int, sentence string")
    n = spark.createDataFrame([(w,) for w in ["New York", "Müller", "Anna", "O'Brien", "C++", "Über", "(b", "nowhere York", " ", "", None]], "name string")
    assert rows(M.link_names(s, n), "name", "pos") == [("(b", 5), ("Anna", 0), ("C++", 2), ("Müller", 0), ("Müller", 3), ("New York", 0), ("New York", 2), ("O'Brien", 2)]
    folded = rows(M.link_names(s, n, ignore_case=True), "name", "pos")
    assert ("Über", 3) in folded and len(folded) == 9


def test_only_runs_that_can_be_names_move(spark):
    """Names that share a frequent word don't meet each sentence with that word; long ones are found whole."""
    lines = [f"The w{i} of the old House" for i in range(300)] + ["one two, three four five six", "one two, three four five Sixes"]
    s = spark.createDataFrame([(0, i, w) for i, w in enumerate(lines)], "doc long, pos int, sentence string")
    n = spark.createDataFrame([(f"The w{i}",) for i in range(0, 300, 3)] + [("one two, three four five six",), ("two, three four five Six",)], "name string")
    keys = n.where("name LIKE 'The%'").selectExpr("replace(name, ' ', '\u0001 \u0001') AS key")
    for prefix in (False, True):
        moved = M._runs(s, keys, {3: [2, 3, 4]}, prefix, lambda c: c)
        assert 100 <= moved.count() <= (200 if not prefix else 500)  # all pairs under The: 30,000
    word, prefix = (rows(M.link_names(s, n, match=m), "name", "pos") for m in ("word", "prefix"))
    assert [x for x in word if x[1] >= 300] == [("one two, three four five six", 300)] and len(word) == 101
    assert [x for x in prefix if x[1] >= 300] == [("one two, three four five six", 300), ("two, three four five Six", 301)] and len(prefix) == 2 + sum(str(i).startswith(str(j)) for i in range(300) for j in range(0, 300, 3))


PIECES_ = st.text(alphabet="abs +.(é_ ", max_size=9)


@settings(max_examples=3, deadline=None)
@given(st.lists(PIECES_, min_size=30, max_size=60), st.lists(st.text(alphabet="abs +(é", min_size=1, max_size=4), min_size=20, max_size=40))
def test_links_against_all_pairs(spark, sentences, names):
    """Prefixes are what a search for a word border and the name finds; words end there too."""
    s = spark.createDataFrame([(0, i, w) for i, w in enumerate(sentences)], "doc long, pos int, sentence string").coalesce(1)
    n = spark.createDataFrame([(w,) for w in names], "name string").coalesce(1)

    def word(name, text):
        left = r"(?<!\w)" if re.match(r"\w", name) else ""
        return re.search(left + re.escape(name) + (r"s?(?!\w)" if re.search(r"\w$", name) else ""), text)

    for match, holds in (("word", word), ("prefix", lambda name, text: re.search(r"\b" + re.escape(name), text))):
        want = sorted({(name, i) for name in names if name.strip() for i, text in enumerate(sentences) if holds(name, text)})
        assert rows(M.link_names(s, n, match=match), "name", "pos") == want


def test_intervals_in_order(spark):
    r = random.Random(3)
    given_ = [(d, (l := r.randint(0, 60)), l + r.randint(0, 9)) for d in (1, 2, 3) for _ in range(80)]
    df = spark.createDataFrame(given_, "doc long, l int, r int")
    for ratio in (0.9, 0.4, None):
        both = df.groupBy("doc").agg(M.reduce_intervals(F.collect_list(F.struct("l", "r")), ratio).alias("x")).select("doc", F.explode("x").alias("x")).select("doc", "x.l", "x.r")
        assert rows(M.reduced(df, ratio), "doc", "l", "r") == rows(both, "doc", "l", "r")
    assert M.reduced(df.limit(0), 0.9).count() == 0


def test_fill_and_islands(spark):
    s = spark.createDataFrame([(0, i, "") for i in range(5)], "doc long, pos int, sentence string")
    links = spark.createDataFrame([(0, 0, "A"), (0, 3, "B")], "doc long, pos int, name string")
    filled = M.fill_blanks(s, links)
    assert [r["names"] for r in filled.orderBy("pos").collect()] == [["A"], ["A", "B"], ["A", "B"], ["B"], ["B"]]
    hits = spark.createDataFrame([(0, i, "A") for i in (0, 2, 3, 7)], "doc long, pos int, name string")
    last = spark.createDataFrame([(0, 9)], "doc long, last int")
    assert rows(M.islands(hits, last), "l", "r") == [(0, 4), (6, 8)]
    one = M.text_units(s, links).collect()
    assert [(u["l"], u["r"], u["names"]) for u in one] == [(0, 4, ["A", "B"])]
    assert M.text_units(s, links.limit(0)).count() == 0


@pytest.mark.parametrize(
    "given_, ratio, want",
    [
        ([(0, 3), (1, 2), (3, 5)], 0.9, [(0, 3), (3, 5)]),
        ([(0, 4), (1, 5)], 0.9, [(0, 4), (1, 5)]),
        ([(0, 4), (1, 5)], 0.8, [(0, 5)]),
        ([(0, 9), (1, 2), (8, 12)], 0.4, [(0, 12)]),
        ([(3, 4), (0, 1)], None, [(0, 1), (3, 4)]),
        ([], 0.9, []),
    ],
)
def test_intervals(spark, given_, ratio, want):
    df = spark.createDataFrame([(given_,)], "x array<struct<l:int,r:int>>")
    assert [tuple(r) for r in df.select(M.reduce_intervals(F.col("x"), ratio).alias("y")).first()["y"]] == want


def test_components_and_aliases(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (4, 5), (5, 5), (None, 3)], "src long, dst long")
    c = connected_components(e)
    assert rows(c, "id", "component") == [(0, 0), (1, 0), (2, 0), (4, 4), (5, 4)]
    a = G.aliases(c.select(F.col("component").alias("group"), "id"))
    assert {r["id"]: r["alias"] for r in a.collect()}[1] == [0, 2]
    assert rows(G.expand_aliases(spark.createDataFrame([(1,), (9,)], "id long"), a), "id") == [(0,), (1,), (2,), (9,)]
    assert connected_components(e.limit(0)).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), min_size=1, max_size=14))
def test_components_against_union_find(spark, edges):
    root = {v: v for v in itertools.chain(*edges)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    want = sorted((v, find(v)) for v in root if any(v in e and e[0] != e[1] for e in edges))
    assert rows(connected_components(spark.createDataFrame(edges, "src long, dst long")), "id", "component") == want


def test_long_paths_converge(spark):
    e = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert connected_components(e).where("component <> 0").count() == 0


def test_estimates_dont_grow_with_rounds(spark):
    """Of a path of 60 edges the size was estimated at a number of thousands of digits, which the driver multiplied in each round."""
    bits = lambda df: df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().bit_length()
    e = spark.range(60).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    c = connected_components(e)
    assert bits(c) < 64 and c.count() == 61
    again = connected_components(c.join(e, c["id"] == e["src"]).select("src", "dst"))
    assert bits(again) < 64 and again.where("component = 0").count() == 61


def test_hops(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "source long, target long")
    start = spark.createDataFrame([(1,), (9,)], "root long")
    assert rows(G.hops(e, start, 1), "root", "id", "hop") == [(1, 0, 1), (1, 1, 0), (1, 2, 1)]
    assert rows(G.induced(e, spark.createDataFrame([(0,), (1,), (3,)], "id long")), "source", "target") == [(0, 1)]
    weighted = spark.createDataFrame([(0, 1, 0.9), (1, 3, 0.8), (0, 3, 0.2)], "source long, target long, weight double")
    level, inner = G.best_average_path(weighted, 0, 3)
    assert 0.7 <= level <= 0.8 and inner == [1]
    assert G.shortest_path(weighted, 0, 3) == [0, 3] and G.shortest_path(weighted, 0, 7) == []
    chain = spark.createDataFrame([(i, i + 1, 0.5) for i in range(80)], "source long, target long, weight double")
    assert G.best_average_path(chain, 0, 80)[1] == list(range(1, 80))  # however long
    some = spark.createDataFrame([(0,), (1,), (5,)], "id long")
    parts = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.8), (2, 5, 0.8), (1, 9, 0.1)], "source long, target long, weight double")
    assert sorted(r["id"] for r in G.bridged(parts, some).collect()) == [0, 1, 2, 5]
    assert G.best_average_path(weighted, 0, 7)[0] == -1.0


def test_widest_path_is_found_once(spark, monkeypatch):
    """The level comes from one pass over the edges and not from components at each level."""
    import lorecraft.operators.components as C

    monkeypatch.setattr(C, "connected_components", None)
    e = spark.createDataFrame([(0, 1, 0.9), (1, 2, 0.4), (0, 3, 0.6), (3, 4, 0.7), (4, 2, 0.65), (2, 2, 1.0), (7, 8, 0.9)], "source long, target long, weight double").coalesce(1)
    assert G.widest_path(e, 0, 2) == 0.6 and G.widest_path(e, 0, 8) is None
    assert G.best_average_path(e, 0, 2) == (0.5625, [3, 4])
    assert G.best_average_path(e, 0, 0) == G.best_average_path(e, 0, 8) == (-1.0, [])


def test_merging(spark):
    e = spark.createDataFrame([("X", "PERSON", "d1", 0, 0), ("X", "ORG", "d2", 0, 1), ("X", "", None, 1, 0), ("X", "ORG", "d1", 2, 0), ("Y", "", "", 0, 5)], "name string, type string, description string, doc long, pos int")
    m = {r["name"]: r for r in G.merge_entities(e).collect()}
    assert m["X"]["type"] == "ORG" and m["X"]["descriptions"] == ["d1", "d2", "d1"]
    assert m["Y"]["type"] == "" and m["Y"]["descriptions"] == []
    assert {r["name"]: r["descriptions"] for r in G.merge_entities(e, as_set=True).collect()}["X"] == ["d1", "d2"]
    r = spark.createDataFrame([("a", "b", "one", 0, 0), ("b", "a", "two", 0, 1)], "source string, target string, description string, doc long, pos int")
    assert [(x["source"], x["descriptions"]) for x in G.merge_relations(r).collect()] == [("a", ["one", "two"])]
    whole = G.with_endpoints(G.merge_entities(e), r)
    assert rows(whole.where("name IN ('a', 'b')"), "name", "type") == [("a", ""), ("b", "")]
    d = spark.createDataFrame([([],), (["d"],), (["d1", "d2"],)], "d array<string>")
    assert [x[0] for x in d.select(G.consolidate(F.col("d"), F.upper)).collect()] == [None, "d", "D1\n\nD2"]
    parallel = spark.createDataFrame([(0, 1, 2), (1, 2, 1), (2, 5, 6)], "id long, source long, target long")
    assert rows(G.last_edges(parallel), "id") == [(1,), (2,)]


def test_dense_ids(spark):
    got = G.dense_ids(spark.range(1000).select((F.col("id") * 7919 % 1009).alias("k")), "k").orderBy("k").collect()
    assert [r["id"] for r in got] == list(range(1000))


def test_bm25(spark):
    docs = spark.createDataFrame([(0, "a b"), (1, "a c"), (2, "d"), (3, None)], "id long, text string").where("id < 3")
    q = spark.createDataFrame([(0, "b")], "qid long, q string")
    got = S.bm25(docs, q, id="id", text="text", query_id="qid", query="q").collect()
    assert [(r["id"], r["score"]) for r in got] == [(0, pytest.approx(0.468647, abs=1e-6))]


def test_bm25_scores_few_documents_and_finds_the_same(spark):
    """Against scores of all pairs, with ties, words that nothing has, and corpora whose words are all frequent."""
    r = random.Random(6)
    common, rare = [f"c{i}" for i in range(12)], [f"r{i}" for i in range(150)]
    texts = [(i, " ".join(r.choices(common, k=r.randint(1, 30)) + r.choices(rare, k=r.randint(0, 3)))) for i in range(300)]
    asked = [(j, " ".join(r.sample(common, 6) + r.sample(rare, j % 4) + ["nowhere"])) for j in range(12)] + [(50, "c0 c1"), (51, "none"), (52, None)]
    docs, q = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(asked, "qid long, q string")
    for own in (docs, docs.where("id < 4")):
        held, words = S.postings(own, q, id="id", text="text", query_id="qid", query="q")
        score = F.round(F.sum(F.col("times") * F.col("impact")), 6)
        every = words.join(held, "word").groupBy("query", "id").agg(score.alias("score"))
        best = every.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "id"))).where("rank <= 3")
        assert rows(S.bm25(own, q, id="id", text="text", query_id="qid", query="q", k=3), "query", "id", "score", "rank") == rows(best, "query", "id", "score", "rank")


def test_bounds_leave_out_frequent_words(spark):
    r = random.Random(7)
    texts = [(i, " ".join(r.choices(["the", "of", "and", "to"], k=20) + [f"w{i % 100}", f"v{i % 70}"])) for i in range(400)]
    q = spark.createDataFrame([(j, f"the of and w{j} v{j}") for j in range(10)], "qid long, q string")
    held, words = S.postings(spark.createDataFrame(texts, "id long, text string"), q, id="id", text="text", query_id="qid", query="q")
    split = S.bounded(words, held, 3).checkpoint()
    assert split.where("essential").join(held, "word").count() * 5 < words.join(held, "word").count()


def test_names_anywhere_in_texts(spark):
    r = random.Random(9)
    names = [(i, "".join(r.choices("aBé .", k=r.randint(0, 6)))) for i in range(60)] + [(60, "Ab"), (61, "b"), (62, None)]
    texts = [(j, "".join(r.choices("abÉ .x", k=r.randint(0, 40)))) for j in range(25)] + [(25, None), (26, "ab" * 30_000)]
    got = M.names_in_queries(spark.createDataFrame(texts, "q long, t string"), spark.createDataFrame(names, "id long, name string"), id="q", text="t", width=4)
    want = []
    for q, t in texts:
        hits = [(e, n.lower()) for e, n in names if n and n.lower() in (t or "").lower()]
        want += [(q, e, n, rank + 1) for rank, (e, n) in enumerate(sorted(hits)[:4])]
    assert rows(got, "query", "entity", "name", "rank") == sorted(want)
    assert M.names_in_queries(spark.createDataFrame(texts, "q long, t string"), spark.createDataFrame([], "id long, name string"), id="q", text="t").count() == 0


def test_seeds_and_fallback(spark):
    u = spark.createDataFrame([([1, 2],), ([1],), ([1, 3],)], "names array<long>")
    assert rows(S.frequent_seeds(u), "name", "n") == [(1, 3)]
    names, known = spark.createDataFrame([("A",), ("B",)], "name string"), spark.createDataFrame([(7, "A")], "id long, name string")
    near = spark.createDataFrame([("A", 1), ("B", 2)], "name string, id long")
    assert rows(S.exact_or_nearest(names, known, near), "name", "id") == [("A", 7), ("B", 2)]
    first = spark.createDataFrame([(0, "fine"), (1, "I CANNOT ANSWER this"), (2, None)], "query long, answer string")
    second = spark.createDataFrame([(i, "graph") for i in range(3)], "query long, answer string")
    assert rows(S.answer_in_two_steps(first, second), "query", "answer", "step") == [(0, "fine", 1), (1, "graph", 2), (2, "graph", 2)]


def test_context(spark):
    e = spark.createDataFrame([(1, "n", "d")], "key long, name string, description string")
    r = spark.createDataFrame([(1, 4, 5, "rel")], "key long, source long, target long, description string")
    s = spark.createDataFrame([(1, "text")], "key long, content string")
    assert S.context(e, r, s).first()["context"] == "=====Entities=====\nn: d\n=====Relationships=====\n4 -> 5: rel\n=====Sources=====\ntext"


def test_combinations(spark):
    ranked = spark.createDataFrame([(0, 1, 1, "x"), (0, 2, 2, "y"), (0, 3, 3, "z"), (1, 1, 2, "y"), (1, 2, 1, "x")], "query long, rank int, id long, content string")
    assert rows(I.combinations(ranked, 2), "query", "combo", "ids") == [(0, 0, [1, 2]), (0, 1, [1, 3]), (0, 2, [2, 3])]
    assert len(rows(I.combinations(ranked, 2, cap=2), "combo")) == 2
    equal = spark.createDataFrame([(0, 1, 1, "x"), (0, 2, 2, "x")], "query long, rank int, id long, content string")
    assert I.combinations(equal, 2, cap=5).count() == 0
    assert len(rows(I.combinations(ranked.where("query = 0"), 3), "ids")) == 1


def test_judged(spark):
    f = spark.createDataFrame(
        [("f1", "Confidence (a): 80% Confidence (b): 90% **Relevance** Yes"), ("f2", "Confidence (a): 100% **Relevance** No"), ("f3", "Confidence (a): 60% Confidence (b): 95%"), ("f4", "**Relevance** Yes")],
        "file_name string, body string",
    )
    ranked = I.judged(f).where("rank IS NOT NULL")
    assert [(r["file_name"], r["total"]) for r in ranked.orderBy("rank").collect()] == [("f1", 170), ("f3", 155)]
    assert [r[0] for r in rows(I.judged(f, keep=1), "file_name")] == ["f1", "f4"]
    assert tuple(I.relevance_counts(f).first()) == (2, 1, 1)


def test_datasets(spark):
    d = spark.createDataFrame([(0, "a"), (1, "b"), (2, "a"), (3, None)], "id long, text string")
    assert [r[0] for r in rows(I.first_of_equal(d, id="id", text="text"), "id")] == [0, 1, 3]
    pairs = I.entity_pairs(spark.createDataFrame([(0, ["x", "y", "z"])], "doc long, names array<string>"))
    assert rows(pairs, "a", "b") == [("x", "y"), ("x", "z"), ("y", "z")]
    a, b = spark.createDataFrame([("q", "a"), ("q", None)], "question string, answer string"), spark.createDataFrame([("q2", "o")], "question string, output string")
    same = {"question": "question", "answer": "answer"}
    assert rows(I.union_renamed([(a, same), (b, {"question": "question", "output": "answer"})]), "question", "answer") == [("q", "a"), ("q2", "o")]
    t = I.split(spark.range(2000), "id", 10)
    assert 120 < t.where("is_test").count() < 280
    assert rows(t, "id", "is_test") == rows(I.split(spark.range(2000).repartition(7), "id", 10), "id", "is_test")
    assert rows(I.remaining(d.select("id"), d.where("id > 1"), "id"), "id") == [(0,), (1,)]
    shards = I.numbered_shards(spark.range(25), "id", size=10).groupBy("shard").count()
    assert rows(shards, "shard", "count") == [(0, 10), (1, 10), (2, 5)]
    tries = spark.createDataFrame([("t", "bad", 0.2), ("t", "good", 0.9)], "k string, v string, s double")
    assert tuple(I.best_attempt(tries, "k", "v", "s").first()) == ("t", "good", 0.9)
    e = spark.createDataFrame([("T", "d"), ("UNKNOWN", "d"), ("T", None), ("", "d")], "type string, description string")
    assert I.completeness(e).first()[0] == 0.25
    fixed = e.limit(1).select(I.repaired(F.lit("odd"), F.lit(None).cast("string"), F.lit("N"), ["T"]).alias("r")).first()["r"]
    assert tuple(fixed) == ("UNKNOWN", "An entity named N.")


def test_metrics(spark, one):
    r = spark.createDataFrame([("Paris", "in Paris now"), ("Rome", "no idea"), ("x", "X!")], "t string, g string")
    got = E.containment(r, F.col("t"), F.col("g")).first()
    assert got["accuracy"] == pytest.approx(2 / 3) and got["macro_f1"] == pytest.approx(0.4)
    s = one(E.squad(F.lit("The cat sat, sat"), F.lit("cat sat on a mat")))
    assert s["exact"] == 0 and s["f1"] == pytest.approx(2 * 2 / 7)
    assert one(E.squad(F.lit("the"), F.lit("a")))["f1"] == 1.0
    q = E.rouge_l(spark.createDataFrame([("the cats walked", "cat walks"), (None, "x")], "t string, p string"), "t", "p").collect()
    assert q[0]["rouge_l"] == pytest.approx(0.8) and q[1]["rouge_l"] == 0
    samples = spark.createDataFrame([("a", i < 3) for i in range(6)], "task_id string, passed boolean")
    assert [(r["k"], r["pass_at_k"]) for r in E.pass_at_k(samples, [1, 10]).collect()] == [(1, pytest.approx(0.5))]


def test_reasoning(spark):
    edges = spark.createDataFrame([("a", "b", "r1", 3.0), ("a", "c", "r2", 2.0), ("b", "d", "r1", 1.0)], "source string, target string, relation string, weight double")
    seeds = spark.createDataFrame([("q", "a"), ("none", "zz")], "query string, entity string")
    steps = Z.reason(seeds, edges, depth=2, width=2)
    assert rows(steps, "depth", "entity", "next") == [(1, "a", "b"), (1, "a", "c"), (2, "b", "a"), (2, "c", "a")]
    assert [r[0] for r in rows(Z.triplets(steps.where("depth = 1")), "line")] == ["(a, r1, b)", "(a, r1, c)", "(a, r2, b)", "(a, r2, c)"]
    early = Z.reason(seeds, edges, depth=3, enough=lambda s: s.select("query").distinct())
    assert early.agg(F.max("depth")).first()[0] == 1
    c = spark.createDataFrame([(["UnName_Entity"],), (["UnName_Entity", "x"],)], "n array<string>")
    assert [r[0] for r in c.select(Z.known_candidates(F.col("n"))).collect()] == [["UnName_Entity"], ["x"]]


def test_models(spark):
    class Failing:
        def complete(self, prompts):
            raise RuntimeError("down")

    d = spark.createDataFrame([(0, "say\none two"), (1, None)], "id long, prompt string")
    out = {r["id"]: r["reply"] for r in complete(d, "prompt", "reply", EchoModel).collect()}
    assert out == {0: "one two", 1: None}
    failed = complete(d, "prompt", "reply", Failing, tries=2, wait=0.0).collect()
    assert failed[0]["reply"] is None and "down" in failed[0]["reply_error"] and failed[1]["reply_error"] is None
    v = embed(d, "prompt", "v", HashEmbedding).where("id = 0").first()["v"]
    assert sum(x * x for x in v) == pytest.approx(1)
    assert gleaned(d, "prompt", "reply", EchoModel, rounds=2).where("id = 0").first()["reply"].startswith("one two")


def test_blanks_of_a_long_text_are_filled_without_looking_ahead(spark):
    sentences = spark.createDataFrame([(1, k, "s") for k in range(6)], "doc long, pos int, sentence string")
    links = spark.createDataFrame([(1, 1, "A"), (1, 4, "B")], "doc long, pos int, name string")
    filled = M.fill_blanks(sentences, links)
    assert [r["names"] for r in filled.orderBy("pos").collect()] == [["A"], ["A"], ["A", "B"], ["A", "B"], ["B"], ["B"]]
    assert "unboundedfollowing" not in filled._jdf.queryExecution().toString().lower()  # a frame that is read anew for each row


@pytest.mark.parametrize("match", ["word", "prefix"])
def test_names_of_one_word_meet_only_words_that_are_long_enough(spark, match):
    lines = ["The Bridges of Anna, Bridge", "an xBridge or Bri-dge", "ABridge's Annals"]
    sentences = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc long, pos int, sentence string")
    links = M.link_names(sentences, spark.createDataFrame([("Bridge",), ("Anna",)], "name string"), match=match)
    found = sorted((r["pos"], r["name"]) for r in links.collect())
    assert found == [(0, "Anna"), (0, "Bridge")] + [(2, "Anna")] * (match == "prefix")
    assert "{4,}" in links._jdf.queryExecution().toString()  # shorter words and marks aren't rows


def test_aliases_of_one_large_group_are_many_tasks(spark):
    groups = spark.range(1000, numPartitions=1).select(F.lit(7).alias("group"), "id")
    found = G.aliases(groups, lambda x: x.cast("string")).select("*", F.spark_partition_id().alias("task")).collect()
    assert len({r["task"] for r in found}) > 1
    assert {r["id"]: r["alias"] for r in found} == {i: [str(j) for j in range(1000) if j != i] for i in range(1000)}


def test_postings_keep_only_words_that_are_asked_for(spark):
    texts = [(1, "b a b  c b"), (2, ""), (3, None), (4, "a"), (5, "d d\te")]
    q = spark.createDataFrame([(0, "B a zz"), (1, "a")], "qid long, q string")
    held, asked = S.postings(spark.createDataFrame(texts, "id long, text string"), q, id="id", text="text", query_id="qid", query="q", b=0.0, k1=1.0)
    assert rows(held, "word", "id") == [("a", 1), ("a", 4), ("b", 1)]
    assert rows(asked, "query", "word", "times", "df") == [(0, "a", 1, 2), (0, "b", 1, 1), (1, "a", 1, 2)]
    brings = {(r["word"], r["id"]): r["impact"] for r in held.collect()}
    idf = math.log(4.5) - math.log(1.5)  # one of five texts
    assert brings["b", 1] == pytest.approx(idf * 3 * 2 / (3 + 1)) and brings["a", 1] == pytest.approx((math.log(3.5) - math.log(2.5)) * 2 / 2)
    assert all("parquet" in t._jdf.queryExecution().sparkPlan().toString() for t in (held, asked))  # of the size of their files


def test_prefixes_are_found_once_without_moving_links(spark):
    lines = ["Old Town, old towns and an OLD TOWN", "cold Town old  Town", "Old Town", "the Old, Town of old to", "Town old Town old Townhall", "", None]
    sentences = spark.createDataFrame([(1, min(k, 4), x) for k, x in enumerate([*lines, "Old Town again"])], "doc long, pos int, sentence string")
    names = spark.createDataFrame([("Old Town",), ("old to",), ("Town",), ("Old, Town",)], "name string")
    links = M.link_names(sentences, names, match="prefix", ignore_case=True, apart=True)
    want = [(0, "Old Town"), (0, "Town"), (0, "old to"), (1, "Town"), (2, "Old Town"), (2, "Town"), (2, "old to"), (3, "Old, Town"), (3, "Town"), (3, "old to")]
    want += 2 * [(4, "Old Town"), (4, "Town"), (4, "old to")]  # two sentences at one place
    assert rows(links, "pos", "name") == sorted(want)
    assert rows(M.link_names(sentences, names, match="prefix", ignore_case=True), "pos", "name") == sorted(set(want))
    assert "hashpartitioning(doc" not in links._jdf.queryExecution().executedPlan().toString()
    marked = M.link_names(sentences, spark.createDataFrame([(", old",), ("Old Town",)], "name string"), match="prefix", ignore_case=True, apart=True)
    assert (0, ", old") in rows(marked, "pos", "name")


def test_lists_of_aliases_are_not_sent_through_the_driver(spark):
    found = G.aliases(spark.range(300).select((F.col("id") % 2).alias("group"), "id"))
    assert {r["id"]: r["alias"] for r in found.collect()} == {i: [j for j in range(i % 2, 300, 2) if j != i] for i in range(300)}
    meets = [x for x in found._jdf.queryExecution().sparkPlan().toString().splitlines() if "Join" in x and ("key#" in x.split("Inner")[0] or "part#" in x.split("Inner")[0])]
    assert meets and not any("Broadcast" in x for x in meets)


def test_units_take_their_sentences_from_lists_that_move_once(spark):
    own = {(1, k): ["ABC"[k % 3]] for k in range(0, 30, 2)} | {(2, 1): ["A"], (2, 6): ["B"]}
    texts = {(1, k): [f"s{k}."] for k in range(30)} | {(2, 1): ["one", "two"], (2, 2): ["three"], (2, 6): ["six"]}  # the second has gaps and a place twice
    sentences = spark.createDataFrame([(d, p, s) for (d, p), some in texts.items() for s in some], "doc long, pos int, sentence string")
    links = spark.createDataFrame([(d, p, n) for (d, p), some in own.items() for n in some], "doc long, pos int, name string")
    units = M.text_units(sentences, links, ratio=None)
    got = units.collect()
    assert len(got) > 5 and {u["doc"] for u in got} == {1, 2}
    for u in got:
        inside = [p for d, p in sorted(texts) if d == u["doc"] and u["l"] <= p <= u["r"]]
        assert u["content"] == " ".join(s for p in inside for s in sorted(texts[u["doc"], p]))
        assert u["names"] == sorted({n for p in inside for n in own.get((u["doc"], p), [])})
    assert "sequence(l" not in units._jdf.queryExecution().toString()  # no row for each sentence of each unit
