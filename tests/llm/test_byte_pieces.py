"""Byte-level BPE by a shuffle of distinct words, against the library."""

import base64
import hashlib
import random
import unicodedata

import numpy as np
import pytest

from lorecraft.llm import byte_pieces
from lorecraft.llm.byte_pieces import ByteVocabulary, encode_decode, pack, split, stand_in, unpack
from lorecraft.llm.queries import op11_byte_pieces, vocabulary
from lorecraft.llm.token_counts import PRE_TOKEN, STRANGE
from tests.llm.conftest import ODD

RANKS, MANY = vocabulary("byte_bpe_50k.tiktoken"), vocabulary("byte_bpe_multi_50k.tiktoken")


def library_of(path):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PRE_TOKEN.pattern, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def library():
    return library_of(RANKS)


def test_the_pattern_is_the_vocabularies():
    import public_tokenizers

    assert PRE_TOKEN.pattern == public_tokenizers.PATTERN


def test_plain_characters_have_the_librarys_classes(library):
    """Outside of STRANGE, this pattern and the library's agree on every character."""
    probe = byte_pieces._probe().encode_ordinary
    for code in range(128, 0x20000):
        c = chr(code)
        if unicodedata.category(c) == "Cs" or STRANGE.search(c):
            continue
        joined = [max(probe(lead + c)) > 255 for lead in "a1\n"]
        assert joined == [len(PRE_TOKEN.findall(lead + c)) == 1 for lead in "a1\n"], hex(code)


def test_strange_characters():
    assert [stand_in(c) for c in ("Ա", "०", "՚")] == ["é", "1", "!"]
    text = "abԱc ०१x'աs  ՚!"
    assert "".join(split(text)) == text and split("aԱ") == ["aԱ"]


@pytest.mark.parametrize("path", [RANKS, MANY])
def test_words(path):
    library = library_of(path)
    with open(path) as f:
        own = ByteVocabulary(f.read())
    r = random.Random(7)
    letters = "etaoin shrdlu ETAOIN 0123 .,!?'\n\t éüß日本語🙂Ա"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(1, 60))) for _ in range(3000)]
    texts += [t for t in ODD if t] + ["".join(r.choice("abcdefgh") for _ in range(200_000)), "a" * 100_000, "日" * 20_000]
    words = [w for t in texts for w in split(t)]
    ids, sizes = own.encode(words)
    assert int(sizes.sum()) == len(ids)
    got = np.split(ids, np.cumsum(sizes)[:-1])
    assert [g.tolist() for g in got] == [library.encode_ordinary(w) for w in words]
    assert b"".join(own.decode(g) for g in got) == "".join(words).encode()


def test_packing():
    for x in (np.zeros(0, np.int64), np.array([5]), np.arange(100_000) * 37 % 2**32):
        assert unpack(pack(x)).tolist() == x.tolist()


def wanted(library, text):
    ids = library.encode_ordinary(text or "")
    return len(ids), np.array(ids, "<u4").tobytes(), (text or "").encode()


@pytest.mark.parametrize("small", [False, True])
def test_texts(docs, documents, library, monkeypatch, small):
    if small:  # many blocks and dictionaries, and words that meet across batches
        monkeypatch.setattr(byte_pieces, "BLOCK_CHARS", 2_000)
        monkeypatch.setattr(byte_pieces, "DICTIONARY_CHARS", 5_000)
        monkeypatch.setattr(byte_pieces, "PACKED", 50)
    got = encode_decode(docs.withColumnRenamed("source", "ids"), RANKS, keep=["doc_id", "lang", "ids"]).collect()
    assert encode_decode(docs, RANKS).columns == ["doc_id", "lang", "source", "n_chars", "n_tokens", "ids", "decoded"]
    rows = sorted((str(r["doc_id"]), r["n_tokens"], bytes(r["ids"]), bytes(r["decoded"])) for r in got)
    assert rows == sorted((str(d), *wanted(library, t)) for d, t, *_ in documents)


def test_no_rows_no_columns_and_no_words(spark, empty, library):
    assert encode_decode(empty, RANKS).count() == 0
    only = spark.createDataFrame([("",), (None,), ("a b",)], "text string").coalesce(1)
    assert sorted(r["n_tokens"] for r in encode_decode(only, RANKS).collect()) == [0, 0, 2]
    assert [bytes(r["decoded"]) for r in encode_decode(only.where("text IS NULL"), RANKS).collect()] == [b""]


def test_query(spark, documents, library, tmp_path):
    spark.createDataFrame(documents, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = op11_byte_pieces(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for d, t, *_ in documents:
        n, ids, raw = wanted(library, t)
        want.append((str(d), n, hashlib.sha256(ids).hexdigest(), hashlib.sha256(raw).hexdigest()))
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == sorted(want)
