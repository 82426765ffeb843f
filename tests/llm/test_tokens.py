import base64
import hashlib
import random
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorecraft.llm.pieces import PieceModel, Pieces, encode_decode
from lorecraft.llm.queries import vocabulary
from lorecraft.llm import token_counts
from lorecraft.llm.token_counts import PRE_TOKEN, STRANGE, PieceCounter, count_tokens, sums
from tests.llm.conftest import ODD

PIECES, BYTES = vocabulary("piece_bpe_32k.model"), vocabulary("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def model():
    return PieceModel.load(PIECES)


@pytest.fixture(scope="module")
def counter():
    with open(BYTES, encoding="utf-8") as f:
        return PieceCounter(f.read())


def encoded(model, texts, chars=2_000_000):
    out = []
    for flat, count in model.encode(texts, chars):
        start = 0
        for n in count.tolist():
            out.append(flat[start : start + n].tolist())
            start += n
    return out


def test_odd_texts(model, library):
    want = [library.encode(t or "") for t in ODD]
    assert encoded(model, ODD) == want
    assert encoded(model, ODD, chars=3) == want  # whatever the groups
    assert [model.decode(i) for i in want] == [library.decode(i) for i in want]


def test_very_long_words(model, library):
    r = random.Random(3)
    words = "the of and in information there question international x".split()
    texts = [
        "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(300_000)),
        base64.b64encode(r.randbytes(200_000)).decode(),
        "".join(chr(r.randrange(0x4E00, 0x9FA5)) for _ in range(100_000)),
        "".join(r.choice(words) for _ in range(50_000)),
        "".join(r.choice(["a", "aa", "\u00e9", "...", "00", "th", "\u65e5"]) for _ in range(50_000)),
        "ab" * 100_000,
        "-" * 3_001 + " " * 2_001 + "=" * 999,
    ]
    began = time.perf_counter()
    got = encoded(model, texts)
    assert time.perf_counter() - began < 30  # in proportion to the length
    assert got == [library.encode(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["the", "th", "he", "an", "x", "xx", "ss", "...", "\u00e9", "\u65e5", " ", "0", "12", "oo", "ooo"]), min_size=200, max_size=900))
def test_words_by_rank(model, library, parts):
    text = "".join(parts)
    assert encoded(model, [text]) == [library.encode(text)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=8))
def test_any_text(model, library, texts):
    want = [library.encode(t) for t in texts]
    assert encoded(model, texts) == want
    assert [model.decode(i) for i in want] == [library.decode(i) for i in want]


def test_words_of_few_letters(model, library):
    r = random.Random(3)
    texts = ["".join(r.choice("aabbcinestro  ▁") for _ in range(r.randint(1, 80))) for _ in range(3000)]
    assert encoded(model, texts) == [library.encode(t) for t in texts]


def test_broken_bytes_decode_as_in_the_library(model, library):
    r = random.Random(1)
    for _ in range(200):
        ids = [r.choice([*range(3, 259), 260, 300, 5000]) for _ in range(r.randint(1, 8))]
        assert model.decode(ids) == library.decode(ids)


def test_query_columns(spark, docs, empty, library):
    done = encode_decode(docs.withColumn("ids", F.lit("clash")), PIECES).collect()
    for r in done:
        assert list(r["ids"]) == library.encode(r["text"] or "") and r["decoded"] == library.decode(list(r["ids"]))
    assert encode_decode(empty, PIECES).count() == 0
    for r in docs.select("text", Pieces(spark, PIECES).digest("text").alias("d")).collect():
        ids = library.encode(r["text"] or "")
        assert r["d"]["n_tokens"] == len(ids) and r["d"]["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def counts(counter, texts):
    words, at, n, ends, extra = counter.block(texts)
    assert len(set(words)) == len(words)
    return (sums(np.array([*counter.pieces(words), 0]), at, n, ends) + extra).tolist()


def test_counts(counter):
    want = [len(e) for e in counter.tokenizer.encode_batch([t or "" for t in ODD], add_special_tokens=False)]
    assert counts(counter, ODD) == want and [counts(counter, [t])[0] for t in ODD] == want


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=60), max_size=8))
def test_counts_of_any_text(counter, texts):
    assert counts(counter, texts) == [len(e) for e in counter.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_plain_characters_split_alike(counter):
    split = counter.tokenizer.pre_tokenizer.pre_tokenize_str
    for c in (*range(0x530), *range(0x2000, 0x2070), *range(0x2190, 0x27C0, 7), *range(0x3000, 0x9FA6, 97), *range(0xAC00, 0xD7A4, 997)):
        s = f"a{chr(c)} 1{chr(c)}!{chr(c)}"
        if not STRANGE.search(s):
            assert PRE_TOKEN.findall(s) == [s[a:b] for _, (a, b) in split(s)], hex(c)


@pytest.mark.parametrize("chars", [4_000_000, 50])
def test_count_columns(docs, empty, counter, monkeypatch, chars):
    monkeypatch.setattr(token_counts, "BLOCK_CHARS", chars)
    odd = docs.withColumn("n_tokens", F.lit("clash")).withColumn("at", F.array(F.struct("lang"))).withColumn("block", F.col("text"))
    got = count_tokens(odd, BYTES, limit=100)
    assert got.columns == ["doc_id", "lang", "source", "n_chars", "at", "block", "n_bytes", "n_tokens", "over_limit"]
    rows = got.collect()
    assert len(rows) == docs.count()
    for r in rows:
        assert r["n_bytes"] == len((r["block"] or "").encode()) and r["at"][0]["lang"] == r["lang"]
        assert r["n_tokens"] == len(counter.tokenizer.encode(r["block"] or "", add_special_tokens=False)) and r["over_limit"] == (r["n_tokens"] > 100)
    assert count_tokens(empty, BYTES).count() == 0
    assert count_tokens(docs.select("text"), BYTES).columns == ["n_bytes", "n_tokens", "over_limit"]
