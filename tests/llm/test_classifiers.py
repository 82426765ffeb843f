import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorecraft.llm import language_id, quality, toxicity
from lorecraft.llm.samples import binary_labels, labelled_sample
from tests.llm.conftest import ODD, SCHEMA, prose

WORDS = {
    "en": "the and of that with this from they have which there would about when people water",
    "de": "der und die nicht mit sich auf eine auch werden nach über wurde können schon müssen",
    "fr": "les des une dans pour qui avec sur pas être mais comme plus tout cette où été",
}


def corpus(n: int, seed: int = 1) -> list[tuple]:
    r = random.Random(seed)
    langs = [r.choice(list(WORDS)) for _ in range(n)]
    return [(i, prose(r, r.randint(8, 120), WORDS[lang]), lang, "s", 1) for i, lang in enumerate(langs)]


def test_languages(spark):
    rows = corpus(400)
    df = spark.createDataFrame(rows + [(900 + i, t, "en", "s", 1) for i, t in enumerate(ODD)] + [(990, "null language", None, None, None)], SCHEMA).withColumn("score", F.lit("clash"))
    held = language_id.split_of("doc_id", 5) == 0
    model = language_id.train(df.where(~held), per_language=60)
    got = {r["doc_id"]: r for r in language_id.identify(df, model).collect()}
    out = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert len(out) > 40 and np.mean([got[r[0]]["lang_pred"] == r[2] for r in out]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values())
    for i, t in enumerate(ODD):
        if not any(c.isalpha() for c in t or ""):
            assert got[900 + i]["lang_pred"] == "und" and got[900 + i]["score"] == 0


def test_languages_without_rows(spark, empty):
    model = language_id.train(empty)
    df = spark.createDataFrame([(0, "text", "en", "s", 1)], SCHEMA)
    assert language_id.identify(df, model).first()["lang_pred"] == "und"
    assert language_id.identify(empty, model).count() == 0
    single = language_id.train(spark.createDataFrame([(0, "some text", "en", "s", 1)], SCHEMA))
    assert language_id.identify(df, single).first()["lang_pred"] in ("en", "und")


def test_language_is_not_read_from_other_columns(spark):
    rows = corpus(200)
    model = language_id.train(spark.createDataFrame(rows, SCHEMA))
    lied = [(i + 7000, t, "xx", "other", 0) for i, t, *_ in rows]
    a = [r["lang_pred"] for r in language_id.identify(spark.createDataFrame(rows, SCHEMA), model).orderBy("doc_id").collect()]
    b = [r["lang_pred"] for r in language_id.identify(spark.createDataFrame(lied, SCHEMA), model).orderBy("doc_id").collect()]
    assert a == b


def junk(r: random.Random, text: str) -> str:
    kind = r.randrange(3)
    words = text.split()
    if kind == 0:
        return " ".join(w.upper() + "!!" for w in words)
    if kind == 1:
        return " ".join(w + r.choice(["###", "&&&", "%%%"]) for w in words)
    return " | ".join(words)


def test_quality(spark):
    r = random.Random(4)
    rows, labels = [], []
    for i, t, *_ in corpus(500, 9):
        bad = r.random() < 0.2
        rows.append((i, junk(r, t) if bad else t.capitalize() + ".", "en", "s", 1))
        labels.append((i, int(not bad)))
    rows += [(900 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("predicted", F.lit("clash"))
    held = language_id.split_of("doc_id", 5) == 0
    marks = spark.createDataFrame(labels + [(901, None), (902, 7)], "doc_id long, quality int")
    model = quality.train(df.where(~held), marks, per_class=200)
    got = {x["doc_id"]: x for x in quality.score(df, model).collect()}
    out = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["predicted"] == y for i, y in out]) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.3) for x in got.values())
    assert got[900]["score"] == got[901]["score"]  # null and empty


def test_quality_without_both_classes(spark, empty):
    none = spark.createDataFrame([], "doc_id long, quality int")
    df = spark.createDataFrame([(0, "a b", "en", "s", 1)], SCHEMA)
    assert quality.score(df, quality.train(df, none)).first()["predicted"] == 1
    good = quality.train(df, spark.createDataFrame([(0, 1)], "doc_id long, quality int"))
    assert quality.score(df, good).first()["score"] > 0.9
    assert quality.score(empty, good).count() == 0


def test_indicators_do_not_depend_on_neighbours():
    texts = [t or "" for t in ODD] + ["same same same", "A b. C!"]
    together = list(quality.indicators(texts))
    for t, f in zip(texts, together):
        assert (next(iter(quality.indicators([t]))) == f).all()


def test_dual_descent_separates():
    rows = [(np.array([k]), np.array([1.0])) for k in (0, 1)] * 4
    y = np.array([1.0, -1.0] * 4)
    w, b = quality.dual_descent(rows, y, np.full(8, 1.0), 2, 50, 0)
    assert w[0] + b > 0.9 and w[1] + b < -0.9


def test_toxicity(spark):
    r = random.Random(8)
    insults = "idiot moron scum worthless".split()
    rows, labels = [], []
    for i, t, *_ in corpus(700, 21):
        words, bad = t.split(), r.random() < 0.25
        for _ in range(r.randint(2, 5) if bad else 0):
            words.insert(r.randrange(len(words) + 1), r.choice(insults))
        rows.append((i, " ".join(words), "en", "s", 1))
        labels.append((i, int(bad)))
    rows += [(900 + i, t, "en", "s", 1) for i, t in enumerate(ODD)]
    rows += [(950, prose(r, 60, WORDS["en"]) + " idiots morons worthles idiott " * 2, "en", "s", 1)]  # spellings it hasn't seen
    df = spark.createDataFrame(rows, SCHEMA).withColumn("score", F.lit("clash"))
    held = language_id.split_of("doc_id", 3) == 1
    model = toxicity.train(df.where(~held), spark.createDataFrame(labels, "doc_id long, toxic int"), per_class=300)
    got = {x["doc_id"]: x for x in toxicity.score(df, model).collect()}
    out = [(i, y) for i, y in labels if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([got[i]["predicted"] == y for i, y in out]) > 0.95
    assert got[950]["predicted"] == 1
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in got.values())
    assert got[900]["score"] == got[901]["score"] == got[902]["score"]


def test_toxicity_without_both_classes(spark, empty):
    df = spark.createDataFrame([(0, "a b", "en", "s", 1)], SCHEMA)
    none = toxicity.train(df, spark.createDataFrame([], "doc_id long, toxic int"))
    assert toxicity.score(df, none).first()["predicted"] == 0
    assert toxicity.score(empty, none).count() == 0


def test_windows_do_not_depend_on_neighbours():
    texts = [t or "" for t in ODD] + ["one two", "one, two. one one"]
    _, _, _, _, bounds = toxicity.words_and_grams(texts)
    for k, t in enumerate(texts):
        alone = toxicity.words_and_grams([t])
        assert len(alone[3]) == bounds[k + 1] - bounds[k]


def edited(r: random.Random, word: str) -> str:
    """One letter in the middle changed, left out, put in or swapped."""
    p, x, kind = r.randrange(1, len(word) - 1), r.choice("abcdefghijklmnopqrstuvwxyz"), r.randrange(4)
    if kind == 3 and p + 2 < len(word):
        return word[:p] + word[p + 1] + word[p] + word[p + 2 :]
    return word[:p] + ["", x, x + word[p]][kind % 3] + word[p + 1 :]


def test_misspelt_words_are_found():
    r = random.Random(12)
    insults = "idiot moron scum worthless disgusting pathetic loser clown stupid trash".split()
    texts, marks = [], []
    for k in range(1200):
        words, bad = prose(r, r.randint(30, 200)).split(), k % 6 == 0
        for _ in range(r.randint(2, 6) if bad else 0):
            words.insert(r.randrange(len(words) + 1), r.choice(insults))
        texts.append(" ".join(words)), marks.append(int(bad))
    model = toxicity.fit(texts, marks, 1 / 6)
    clean = [prose(r, r.randint(30, 200)) for _ in range(150)]
    misspelt = [" ".join([t, *(edited(r, r.choice(insults)) for _ in range(4))]) for t in clean]
    assert (model.scores(misspelt) >= 0.7).mean() >= 0.9
    assert (model.scores(clean) >= 0.7).mean() <= 0.02


def test_places_of_grams():
    numbers, owners, places, hashes, _ = toxicity.words_and_grams(["abcd xy"])
    found = sorted((int(o), int(p) // toxicity.KINDS, int(p) % toxicity.KINDS) for o, p in zip(owners, places))
    assert found == sorted([(0, a, 0) for a in range(4)] + [(0, a, 1) for a in range(3)] + [(0, a, 2) for a in range(2)] + [(0, a, 3) for a in range(2)] + [(1, 0, 0), (1, 1, 0), (1, 0, 1)])


def test_sample_counts_and_bounds(spark):
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.lit("t" * 10).alias("text"))
    labels = spark.range(600).select(F.col("id").alias("doc_id"), (F.col("id") % 4 == 0).cast("int").alias("y")).unionByName(spark.createDataFrame([(700, 5), (701, None)], "doc_id long, y int"))
    take = lambda **more: labelled_sample(docs, binary_labels(docs, labels, "doc_id", "y"), key="doc_id", text="text", label="y", per_class=50, **more)
    texts, marks, rows = take()
    assert rows == {0: 450, 1: 150} and len(texts) == 100 and sum(marks) == 50
    assert len(take(chars=95)[0]) == 20 and len(take(chars=1)[0]) == 2  # whole texts, one of each class at least


def test_sample_of_a_hot_text_and_a_hot_key(spark):
    rows = [(i, "the same text", "en") for i in range(3000)] + [(5000 + i, f"texte {i}", "fr") for i in range(30)] + [(9999, "hot row", "de")] * 500
    docs = spark.createDataFrame(rows, "key long, text string, lang string")
    texts, names, counts = labelled_sample(docs, docs.select("key", "lang"), key="key", text="text", label="lang", per_class=40)
    assert counts == {"en": 3000, "fr": 30, "de": 500}
    assert sorted((n, names.count(n)) for n in set(names)) == [("de", 1), ("en", 40), ("fr", 30)]
    assert labelled_sample(docs.limit(0), docs.limit(0).select("key", "lang"), key="key", text="text", label="lang", per_class=4) == ([], [], {})


def test_every_language_is_learned(spark):
    r = random.Random(2)
    stems = {f"l{k}": " ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(12)) for k in range(230)}
    rows = [(i, prose(r, 12, stems[f"l{i % 230}"]), f"l{i % 230}", "s", 1) for i in range(230 * 4)]
    model = language_id.train(spark.createDataFrame(rows, SCHEMA))
    assert model.languages == sorted(stems)
    names, _ = model.predict([r[1] for r in rows])
    assert np.mean([n == r[2] for n, r in zip(names, rows)]) > 0.9


def test_counts_of_quality_cover_all_rows(spark, monkeypatch):
    taken = {}
    monkeypatch.setattr(quality, "fit", lambda texts, marks, seen, prior: taken.update(texts=texts, seen=seen, prior=prior))
    rows = [(i, f"word{i % 7} text", "en", "s", 1) for i in range(300)]
    labels = spark.createDataFrame([(i, i % 3 // 2) for i in range(0, 300, 2)], "doc_id long, quality int")
    quality.train(spark.createDataFrame(rows, SCHEMA), labels, per_class=10)
    want = np.zeros((2, quality.TOTAL))
    for i in range(0, 300, 2):
        want[i % 3 // 2, next(iter(quality.indicators([rows[i][1]])))] += 1
    assert len(taken["texts"]) == 20 and (taken["seen"] == want).all() and abs(taken["prior"] - 50 / 150) < 1e-9


@pytest.mark.parametrize("text", ["", "a", "ab cd"])
def test_language_counts_of_short_texts(text):
    at, n = next(iter(language_id.counts([text])))
    assert (n > 0).all() and (len(at) > 0) == any(c.isalpha() for c in text)
