"""Token counts: pieces once per distinct pre-token, joined to pre-token frequencies.

A byte-level BPE never merges across pre-tokens, so the count of a text is the
sum, over its distinct pre-tokens, of frequency times the pieces of that
pre-token. Texts are read once, in blocks of about ``BLOCK_CHARS`` characters: a block is its
distinct pre-tokens, and for each of its texts which of them it has and how often. The
pre-tokens of all blocks meet by hash and in order, so every distinct one goes to the
tokenizer once; its pieces are joined back to the blocks' frequencies, and each block sums
pieces times frequency for its texts. Rows (document, pre-token) would be some five
times as many as rows (block, pre-token); a pre-token that every text has is one row a
block, and ids are never kept.

Nulls and empty texts count 0 bytes and 0 tokens. Rows, ties and repeats are
kept as they come; input columns named like a result are replaced.
"""

from __future__ import annotations

import json
import os
import uuid
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from lorecraft.session import ensure_checkpoint_dir, ship_package

#: Fixed value: the split of byte-level BPE vocabularies of this family.
PRE_TOKEN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
#: Blocks whose characters have the same class here as in the tokenizer's own splitter, whatever
#: the Unicode version of either; a text with any other character is split by the tokenizer.
STRANGE = regex.compile(
    "[^\u0000-ԯḀ-῿ -⁯₠-₿←-➿　-ヿ一-龥가-힣＀-￯\U0001f300-\U0001f64f]"
)
#: Characters of a block of whole texts, about; a longer text is a block of its own.
BLOCK_CHARS = 16_000_000
#: Rows (block, pre-token) whose pieces are packed together.
PACKED = 2_000_000
RESULTS = ("n_bytes", "n_tokens", "over_limit")

_counters: dict[str, "PieceCounter"] = {}


class PieceCounter:
    """Counts pieces of texts; built from the JSON of a byte-level BPE tokenizer."""

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        parts = json.loads(spec)
        plain = (parts.get("pre_tokenizer") or {}).items() >= {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}.items()
        if not plain or parts.get("normalizer") or parts["model"].get("type") != "BPE":
            raise ValueError("not a byte-level BPE with the usual split and without a normalizer")
        added = parts.get("added_tokens", [])
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in added):
            raise ValueError("added tokens with strip or word rules are not supported")
        words = sorted((t["content"] for t in added), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, words))) if words else None

    def split(self, text: str) -> list[str]:
        if STRANGE.search(text):
            return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        return PRE_TOKEN.findall(text)

    def pieces(self, words: list[str]) -> list[int]:
        """Pieces of each pre-token; the ids of at most 20,000 of them are held at a time."""
        out: list[int] = []
        for at in range(0, len(words), 20_000):
            out += map(len, self.tokenizer.encode_batch_fast(words[at : at + 20_000], add_special_tokens=False))
        return out

    def block(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, list[int]]:
        """Distinct pre-tokens of ``texts``; for each text which ones it has and how often.

        The latter as flat arrays of numbers and frequencies, with the place where each
        text ends, and the number of added tokens in each text.
        """
        known: defaultdict[str, int] = defaultdict()
        known.default_factory = known.__len__  # a new pre-token gets the next number
        codes, lengths, extra = [np.zeros(0, np.int64)], [], []
        for text in texts:
            parts = [text or ""] if self.added is None or not text or not self.added.search(text) else self.added.split(text)
            found = [w for part in parts for w in self.split(part)] if len(parts) > 1 else self.split(parts[0])
            codes.append(np.fromiter(map(known.__getitem__, found), np.int64, len(found)))
            lengths.append(len(found))
            extra.append(len(parts) - 1)
        size = max(len(known), 1)
        code = np.concatenate(codes)
        order = np.argsort(-np.bincount(code, minlength=len(known)), kind="stable")  # frequent ones get small numbers, which pack well
        number = np.empty(len(known), np.int64)
        number[order] = np.arange(len(known))
        keys, n = np.unique(np.repeat(np.arange(len(lengths)), lengths) * size + number[code], return_counts=True)
        words = list(known)
        return [words[k] for k in order.tolist()], keys % size, n, np.searchsorted(keys, np.arange(1, len(lengths) + 1) * size), extra


def sums(pieces: np.ndarray, at: np.ndarray, n: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The tokens of each text: pieces times frequency, summed up to each end."""
    total = np.r_[0, np.cumsum(pieces[at] * n)]
    return np.diff(total[np.r_[0, ends]])


def pack(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32 as the four bytes of their steps, all first bytes before all second ones, deflated."""
    steps = np.diff(x.astype(np.uint32), prepend=np.uint32(0))
    return zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel(), dtype=np.uint32).astype(np.int64)


def _counter(spec: str) -> PieceCounter:
    if spec not in _counters:
        _counters.clear()
        _counters[spec] = PieceCounter(spec)
    return _counters[spec]


def count_tokens(df: DataFrame, tokenizer: str, *, text: str = "text", limit: int = 1024, keep: list[str] | None = None) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` (``n_tokens > limit``) beside the columns ``keep``.

    ``keep`` defaults to all columns but the text, so that texts aren't carried along.
    ``tokenizer`` is the path of a byte-level BPE JSON file on the driver; its
    content (of fixed size) is broadcast, so executors need no copy.
    """
    spark = df.sparkSession
    ship_package(spark)
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kept = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c not in RESULTS]
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = df.select(*kept, F.octet_length(value).cast("bigint").alias("n_bytes"), value.alias("__text"))
    row = StructType(rows.schema.fields[:-1])
    numbers = [StructField(c, BinaryType()) for c in ("at", "n", "ends", "extra")]
    schema = StructType([StructField("block", LongType()), StructField("rows", ArrayType(row)), StructField("words", ArrayType(StringType())), *numbers])

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        number = TaskContext.get().partitionId() << 32
        texts: list[str] = []
        held: list[pa.Array] = []
        chars = 0

        def close() -> pa.RecordBatch:
            nonlocal number, chars
            words, *arrays = counter.block(texts)
            own = pa.concat_arrays(held)
            whole = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
            out = [pa.array([number], pa.int64()), whole, pa.array([words], pa.list_(pa.string())), *(pa.array([pack(np.array(x, np.int64))], pa.binary()) for x in arrays)]
            number, chars = number + 1, 0
            texts.clear(), held.clear()
            return pa.record_batch(out, names=schema.names)

        for batch in batches:
            own = pa.StructArray.from_arrays(batch.columns[:-1], fields=list(batch.schema)[:-1])
            done = 0
            for k, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                texts.append(text)
                chars += len(text)
                if chars >= BLOCK_CHARS:
                    held.append(own.slice(0, k + 1 - done))
                    own, done = own.slice(k + 1 - done), k + 1
                    yield close()
            held.append(own)
        if texts:
            yield close()

    folder = f"{ensure_checkpoint_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    rows.mapInArrow(blocks, schema).write.option("compression", "zstd").parquet(folder)
    stored = spark.read.schema(schema)
    table = stored.parquet(folder)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(spec.value)
        last, last_pieces = None, 0
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def close() -> pa.RecordBatch:
            """A row for each block."""
            nonlocal held
            block, i, pieces = (np.concatenate(x) for x in zip(*parts))
            order = np.lexsort((i, block))
            block, i, pieces = block[order], i[order], pieces[order]
            first = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
            packed = [pa.array([pack(x) for x in np.split(values, first[1:])], pa.binary()) for values in (i, pieces)]
            parts.clear()
            held = 0
            return pa.record_batch([pa.array(block[first]), *packed], names=["block", "i", "pieces"])

        for batch in batches:  # equal pre-tokens come one after the other
            if not batch.num_rows:
                continue
            words = batch.column(2).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            known = [last_pieces] if distinct[0] == last else []
            found = np.array(known + counter.pieces(distinct[len(known) :]), np.int64)
            last, last_pieces = distinct[-1], int(found[-1])
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), found[words.indices.to_numpy()]))
            held += batch.num_rows
            if held >= PACKED:
                yield close()
        if held:
            yield close()

    words = table.select("block", F.posexplode("words").alias("i", "word")).repartition("word").sortWithinPartitions("word")
    of_block = words.mapInArrow(counted, "block bigint, i binary, pieces binary")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        i, pieces = (np.concatenate([np.zeros(0, np.int64), *map(unpack, left.column(c).to_pylist())]) for c in ("i", "pieces"))
        held = np.zeros(max(len(i), 1), np.int64)
        held[i] = pieces
        at, n, ends, extra = (unpack(right.column(c)[0].as_py()) for c in ("at", "n", "ends", "extra"))
        own = right.column("rows").combine_chunks().flatten()
        return pa.Table.from_arrays([*own.flatten(), pa.array(sums(held, at, n, ends) + extra, pa.int64())], names=[*row.names, "n_tokens"])

    result = StructType([*table.schema["rows"].dataType.elementType.fields, StructField("n_tokens", LongType())])
    joined = of_block.groupBy("block").cogroup(stored.parquet(folder).select("block", "rows", "at", "n", "ends", "extra").groupBy("block"))
    return joined.applyInArrow(summed, result).withColumn("over_limit", F.col("n_tokens") > limit)
