import random

import pytest

ODD = [None, "", " ", "\n\t", "a", "a\x00b", "é日本🙂", "x" * 50_000, "word " * 20_000, "<|endoftext|> mid <|endoftext|>", "<s> </s> <0x41> ▁ ▁▁", "　wide space﻿", "՘ odd \U0001fae9"]


def prose(rng: random.Random, words: int, stems: str = "the and of to in that it was for on are with as his they at be this from have or by one had not but what all were when we there can an your which their said if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know") -> str:
    pool = stems.split()
    return " ".join(rng.choice(pool) for _ in range(words))


@pytest.fixture()
def rng():
    return random.Random(11)


@pytest.fixture(scope="session")
def documents():
    """Rows (doc_id, text, lang, source, n_chars) with odd texts, copies and a null in each column."""
    r = random.Random(5)
    rows = [(i, t, "en", "s0", 1) for i, t in enumerate(ODD)]
    rows += [(100 + i, prose(r, r.randint(20, 200)), "en", f"s{i % 3}", 2) for i in range(60)]
    rows += [(200 + i, rows[20][1], "en", "s1", 3) for i in range(5)]
    rows += [(300, prose(r, 30), None, None, None), (None, prose(r, 30), "en", "s2", 4), (100, rows[13][1], "en", "s0", 2)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs(spark, documents):
    return spark.createDataFrame(documents, SCHEMA).repartition(3)


@pytest.fixture()
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
