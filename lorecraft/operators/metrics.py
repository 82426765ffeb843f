"""Evaluation measures."""

from __future__ import annotations

import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecraft.session import ship_package


def classification(rows: DataFrame, label: str, predicted: str) -> DataFrame:
    """(accuracy, macro_f1) over the classes that occur among labels or predictions."""
    counts = rows.groupBy(F.col(label).alias("y"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    right = counts.select(F.col("y").alias("c"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("as_p"), F.col("n").alias("as_y"))
    guessed = counts.select(F.col("p").alias("c"), F.lit(0).alias("tp"), F.col("n").alias("as_p"), F.lit(0).alias("as_y"))
    per = right.unionByName(guessed).groupBy("c").agg(*[F.sum(x).alias(x) for x in ("tp", "as_p", "as_y")])
    f1 = F.col("tp") * 2 / (F.col("as_p") + F.col("as_y"))
    return per.agg((F.sum("tp") / F.sum("as_y")).alias("accuracy"), F.avg(f1).alias("macro_f1"))


def containment(rows: DataFrame, truth: Column, generated: Column) -> DataFrame:
    """(accuracy, macro_f1) of whether the truth occurs in what was generated; all references are 1."""
    hit = F.contains(F.lower(generated), F.lower(F.trim(truth))).cast("int")
    return classification(rows.select(hit.alias("p"), F.lit(1).alias("y")), "y", "p")


def normal_words(text: Column) -> Column:
    """Lower-cased words without punctuation and articles."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(text), "[!-/:-@\\[-`{-~]", ""), r"(^|[ \t\n\r])(a|an|the)([ \t\n\r]+(a|an|the))*($|[ \t\n\r])", " ")
    t = F.trim(F.regexp_replace(bare, r"[ \t\n\r]+", " "))
    return F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, " "))


def overlap(a: Column, b: Column) -> Column:
    """Words that two arrays share, with repeats."""
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda s, w: s + F.least(F.size(F.filter(a, lambda x: x == w)), F.size(F.filter(b, lambda x: x == w))))


def squad(truth: Column, predicted: Column) -> Column:
    """(exact, f1) of one answer, on normalised words."""
    def measured(x: Column) -> Column:
        t, p = x["t"], x["p"]
        same = overlap(t, p)
        f1 = F.when((F.size(t) == 0) | (F.size(p) == 0), (F.size(t) == F.size(p)).cast("double")).when(same == 0, 0.0).otherwise(2.0 * same / (F.size(t) + F.size(p)))
        return F.struct((F.array_join(t, " ") == F.array_join(p, " ")).cast("int").alias("exact"), f1.alias("f1"))

    words = F.struct(normal_words(truth).alias("t"), normal_words(predicted).alias("p"))
    return F.transform(F.array(words), measured)[0]  # words once, not for each of them


#: Endings of Porter's algorithm (1980) and what takes their place.
STEP_2 = {"ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble"}
STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP_4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ion", "ism", "ate", "iti", "ous", "ive", "ize", "al", "er", "ic", "ou")


def _kinds(word: str) -> str:
    """A letter for each of the word's: v for a vowel, c for a consonant; y is a vowel after a consonant."""
    out = ""
    for x in word:
        out += "v" if x in "aeiou" or (x == "y" and out[-1:] == "c") else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _kinds(word)))


def _short(word: str) -> bool:
    """Ends in consonant, vowel, consonant, the last of which is none of w, x, y."""
    return _kinds(word)[-3:] == "cvc" and word[-1] not in "wxy"


def stem(word: str) -> str:
    """Porter's stem of a lower-cased word; words of up to three letters stay."""
    if len(word) <= 3:
        return word
    w = word
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) else w
    else:
        for end in ("ed", "ing"):
            if w.endswith(end) and "v" in _kinds(w[: -len(end)]):
                w = w[: -len(end)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif len(w) > 1 and w[-1] == w[-2] and _kinds(w)[-1] == "c" and w[-1] not in "lsz":
                    w = w[:-1]
                elif _measure(w) == 1 and _short(w):
                    w += "e"
                break
    if w.endswith("y") and "v" in _kinds(w[:-1]):
        w = w[:-1] + "i"
    for endings in (STEP_2, STEP_3):
        for end in sorted(endings, key=len, reverse=True):
            if w.endswith(end):
                w = w[: -len(end)] + endings[end] if _measure(w[: -len(end)]) else w
                break
    for end in STEP_4:
        if w.endswith(end):
            head = w[: -len(end)]
            w = head if _measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))) else w
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def longest_common(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence: a bit for each word of ``a``, a word of ``b`` at a time."""
    places: dict[str, int] = {}
    for i, x in enumerate(a):
        places[x] = places.get(x, 0) | 1 << i
    every = (1 << len(a)) - 1
    open_ = every
    for y in b:
        hit = open_ & places.get(y, 0)
        open_ = ((open_ + hit) | (open_ - hit)) & every
    return len(a) - open_.bit_count()


def rouge_l(rows: DataFrame, truth: str, predicted: str, name: str = "rouge_l", *, stemmed: bool = True) -> DataFrame:
    """``rows`` with the F-measure of the longest common subsequence of (stemmed) words."""
    ship_package(rows.sparkSession)

    @F.pandas_udf("double")
    def measure(t: pd.Series, p: pd.Series) -> pd.Series:
        known = lru_cache(100_000)(stem) if stemmed else str

        def one(a: list[str], b: list[str]) -> float:
            n = longest_common([known(w) for w in a], [known(w) for w in b])
            return 2 * n / (len(a) + len(b)) if n else 0.0

        return pd.Series([one(list(a), list(b)) for a, b in zip(t, p)])

    words = lambda c: F.regexp_extract_all(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit("([a-z0-9]+)"), 1)
    return rows.withColumn(name, measure(words(truth), words(predicted)))


def pass_at(n: Column, c: Column, k: int) -> Column:
    """Chance that one of ``k`` of ``n`` samples passes, if ``c`` do."""
    miss = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda s, i: s * (1 - F.lit(float(k)) / i))
    return F.when(n - c < k, 1.0).when(c == 0, 0.0).otherwise(1 - miss)


def pass_at_k(samples: DataFrame, ks: list[int], *, task: str = "task_id", passed: str = "passed") -> DataFrame:
    """(k, pass_at_k): means over tasks, for each k that no task has fewer samples than."""
    per = samples.groupBy(task).agg(F.count(F.lit(1)).cast("int").alias("n"), F.count_if(F.col(passed)).cast("int").alias("c"))
    each = per.select("n", F.explode(F.array(*[F.struct(F.lit(k).alias("k"), pass_at(F.col("n"), F.col("c"), k).alias("p")) for k in ks])).alias("x")).select("n", "x.*")
    return each.groupBy("k").agg(F.min("n").alias("least"), F.avg("p").alias("pass_at_k")).where("least >= k").select("k", "pass_at_k")
