"""Byte-level BPE, encoding and decoding, by a shuffle of distinct words.

A byte-level BPE never merges across the matches of its split pattern, so each distinct match
(a word here) needs encoding once, wherever it stands:

1. Texts are read once. A dictionary holds the distinct words of about ``DICTIONARY_CHARS`` characters;
   its texts become places: the number of the word at each position, in blocks of about ``BLOCK_CHARS``.
   Both go to a table that is bucketed by dictionary.
2. The words of all dictionaries are exploded and meet by value, in order: a distinct word is encoded
   once, by vectorised merge rounds, and its ids go back to each dictionary that has it.
3. Dictionaries with ids join their blocks (the places stay where they are, in their buckets); a block
   puts ids in the order of its places and decodes them through the table of each token's bytes.

A word is one row a dictionary, so the most frequent word of a corpus has as many rows as there are
dictionaries, and a text that holds a third of all words is places of its own block.

Nulls are empty texts: no ids, no bytes. Very long texts are a block of their own, very long words take
linear time. Repeated rows and ties are kept as they come, an empty table gives an empty one, and input columns
named like a result are replaced.
"""

from __future__ import annotations

import base64
import uuid
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from lorecraft.llm.pieces import PairTable, PieceModel
from lorecraft.llm.token_counts import PRE_TOKEN, STRANGE
from lorecraft.session import ensure_checkpoint_dir, ship_package

#: Characters whose distinct words are held together, and of a block of whole texts; about.
DICTIONARY_CHARS, BLOCK_CHARS = 32_000_000, 4_000_000
#: Rows (dictionary, word) whose ids are packed together.
PACKED = 1_000_000
RESULTS = ("n_tokens", "ids", "decoded")
ZSTD = pa.Codec("zstd", compression_level=3)


@lru_cache(maxsize=4096)
def stand_in(char: str) -> str:
    """A character of a well-known block that the split of the rank library treats like ``char``.

    Libraries differ in the version of Unicode that they know, so the library itself is asked: with a vocabulary
    of bytes and of ``a``, ``1``, ``!`` or a line feed before the first byte of others, these pairs merge only inside a match.
    """
    encoded = _probe().encode_ordinary
    return next((to for lead, to in (("a", "é"), ("1", "1"), ("\n", "\n")) if max(encoded(lead + char)) > 255), "!")


@lru_cache(maxsize=1)
def _probe():
    import tiktoken

    pairs = [bytes([lead, b]) for lead in b"a1\n" for b in range(128, 256)]
    ranks = {t: i for i, t in enumerate([bytes([b]) for b in range(256)] + pairs)}
    return tiktoken.Encoding("probe", pat_str=PRE_TOKEN.pattern, mergeable_ranks=ranks, special_tokens={})


def split(text: str) -> list[str]:
    """The matches of the split pattern, as the rank library finds them."""
    if not STRANGE.search(text):
        return PRE_TOKEN.findall(text)
    alike = text.translate({ord(c): stand_in(c) for c in set(STRANGE.findall(text))})
    return [text[m.start() : m.end()] for m in PRE_TOKEN.finditer(alike)]


class ByteVocabulary:
    """Encodes words by ranks of byte strings, and decodes ids."""

    def __init__(self, lines: str):
        """``lines``: a base64 token and its rank on each line; a token's rank is its id."""
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in lines.splitlines() if line.strip())}
        if not all(bytes([b]) in ranks for b in range(256)):
            raise ValueError("the vocabulary lacks single bytes")
        size = max(ranks.values()) + 1
        #: The table of each token's bytes.
        self.bytes_of = np.full(size, b"", object)
        for t, r in ranks.items():
            self.bytes_of[r] = t
        self.whole = known = {t.decode("latin-1"): r for t, r in ranks.items()}  # a character for each byte
        cuts = [(known[t[:k]], known[t[k:]], r) for t, r in known.items() for k in range(1, len(t)) if t[:k] in known and t[k:] in known]
        left, right, merged = np.array(cuts, np.int64).reshape(-1, 3).T
        unsafe = np.zeros(size, bool)
        for side in (left, right):
            unsafe[side[merged <= side]] = True
        symbol = np.full(0x110000, -1, np.int32)
        symbol[:256] = [known[chr(b)] for b in range(256)]
        beside = np.array(sorted({int(symbol[ord(a)]) << 32 | int(symbol[ord(b)]) for t in known for a, b in zip(t, t[1:])}), np.int64)
        self.model = PieceModel(
            pieces=[], first_space=np.zeros(0, bool), rank=np.arange(size, dtype=np.int32), unsafe=unsafe, symbol=symbol,
            table=PairTable(left << 32 | right, merged.astype(np.int32)), beside=PairTable(beside, np.zeros(len(beside), np.int32)),
            byte_id=symbol[:256], size=size,
        )

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and how many each has. A word that is a token is that token, whatever merges lead to."""
        letters = [w.encode().decode("latin-1") for w in words]
        token = np.array([self.whole.get(w, -1) for w in letters], np.int32)
        merged, start = self.model.encode_words([w for w, t in zip(letters, token.tolist()) if t < 0])
        sizes = np.ones(len(words), np.int64)
        sizes[token < 0] = np.diff(start)
        ids = np.repeat(token, sizes)
        ids[ids < 0] = merged
        return ids, sizes

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.bytes_of[ids].tolist())


_known: dict[str, ByteVocabulary] = {}


def _vocabulary(lines: str) -> ByteVocabulary:
    if lines not in _known:
        _known.clear()
        _known[lines] = ByteVocabulary(lines)
    return _known[lines]


def pack(x: np.ndarray) -> bytes:
    """Whole numbers below 2**32, all first bytes before all second ones, compressed; the count in front."""
    planes = x.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()
    return len(x).to_bytes(8, "little") + ZSTD.compress(planes, asbytes=True)


def unpack(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(ZSTD.decompress(raw[8:], 4 * n, asbytes=True), np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def encode_decode(df: DataFrame, ranks: str, *, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``n_tokens``, ``ids`` and ``decoded`` of each text, beside the columns ``keep`` (all but the text by default).

    ``ids`` are little-endian unsigned 32-bit integers, ``decoded`` the bytes that they stand for. ``ranks`` is the path
    of a vocabulary file on the driver; its content (of fixed size) is broadcast, so executors need no copy.
    """
    spark = df.sparkSession
    ship_package(spark)
    with open(ranks, encoding="ascii") as f:
        lines = spark.sparkContext.broadcast(f.read())
    kept = [c for c in (keep if keep is not None else [c for c in df.columns if c != text]) if c not in RESULTS]
    rows = df.select(*kept, F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text"))
    row = StructType(rows.schema.fields[:-1] or [StructField("__none", LongType())])
    schema = StructType([
        StructField("dictionary", LongType()), StructField("words", ArrayType(StringType())),
        StructField("rows", ArrayType(row)), StructField("places", BinaryType()), StructField("sizes", BinaryType()),
    ])

    def dictionaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of a block each (rows, places, sizes), and after its blocks the row of a dictionary (words)."""
        number = TaskContext.get().partitionId() << 32
        known: defaultdict[str, int] = defaultdict()
        known.default_factory = known.__len__  # a new word gets the next number
        own: list[pa.Array] = []
        codes: list[np.ndarray] = []
        held = chars = 0

        def block() -> pa.RecordBatch:
            nonlocal held
            whole = pa.concat_arrays(own)
            lists = pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole)
            packed = [pack(np.concatenate([np.zeros(0, np.int64), *codes])), pack(np.array([len(c) for c in codes], np.int64))]
            out = [pa.array([number], pa.int64()), pa.array([None], pa.list_(pa.string())), lists, *(pa.array([p], pa.binary()) for p in packed)]
            own.clear(), codes.clear()
            held = 0
            return pa.record_batch(out, names=schema.names)

        def dictionary(kind: pa.DataType) -> pa.RecordBatch:
            nonlocal number, chars
            out = [pa.array([number], pa.int64()), pa.array([list(known)], pa.list_(pa.string())), pa.nulls(1, kind), pa.nulls(1, pa.binary()), pa.nulls(1, pa.binary())]
            number, chars = number + 1, 0
            known.clear()
            return pa.record_batch(out, names=schema.names)

        kind = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns, fields = (batch.columns[:-1], list(batch.schema)[:-1]) if batch.num_columns > 1 else ([pa.nulls(batch.num_rows, pa.int64())], [pa.field("__none", pa.int64())])
            structs = pa.StructArray.from_arrays(columns, fields=fields)
            kind, done = pa.list_(structs.type), 0
            for k, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                found = split(value)
                codes.append(np.fromiter(map(known.__getitem__, found), np.uint32, len(found)))
                held, chars = held + len(value), chars + len(value)
                if held >= BLOCK_CHARS:
                    own.append(structs.slice(done, k + 1 - done))
                    done = k + 1
                    yield block()
                    if chars >= DICTIONARY_CHARS:
                        yield dictionary(kind)
            if done < len(structs):
                own.append(structs.slice(done))
        if codes:
            yield block()
        if chars or known:
            yield dictionary(kind)

    folder = f"{ensure_checkpoint_dir(spark)}/byte-pieces-{uuid.uuid4().hex}"
    table = f"byte_pieces_{uuid.uuid4().hex}"
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows.mapInArrow(dictionaries, schema).write.format("parquet").option("compression", "zstd").option("path", folder).bucketBy(buckets, "dictionary").saveAsTable(table)
    stored = spark.table(table)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Equal words come one after the other; a row for each dictionary among some ``PACKED`` rows."""
        vocabulary = _vocabulary(lines.value)
        last, last_ids = None, np.zeros(0, np.int32)
        parts: list[tuple[np.ndarray, ...]] = []
        held = 0

        def close() -> pa.RecordBatch:
            nonlocal held
            number, at, size = (np.concatenate([p[k] for p in parts]) for k in range(3))
            ids = np.concatenate([p[3] for p in parts])
            begin = np.cumsum(size) - size
            order = np.lexsort((at, number))
            number, at, size, begin = number[order], at[order], size[order], begin[order]
            ids = ids[gathered(begin, size)]
            first = np.flatnonzero(np.r_[True, number[1:] != number[:-1]])
            cuts = (np.cumsum(size) - size)[first[1:]]
            steps = np.diff(at, prepend=0)
            steps[first] = at[first]
            columns = [[pack(x) for x in np.split(values, where)] for values, where in ((steps, first[1:]), (size, first[1:]), (ids, cuts))]
            parts.clear()
            held = 0
            return pa.record_batch([pa.array(number[first], pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], names=["dictionary", "at", "size", "ids"])

        for batch in batches:
            if not batch.num_rows:
                continue
            words = batch.column(2).dictionary_encode()
            distinct = words.dictionary.to_pylist()
            repeated = distinct[0] == last
            ids, size = vocabulary.encode(distinct[repeated:])
            if repeated:
                ids, size = np.r_[last_ids, ids], np.r_[len(last_ids), size]
            begin = np.cumsum(size) - size
            last, last_ids = distinct[-1], ids[begin[-1] :]
            which = words.indices.to_numpy()
            parts.append((batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64), size[which], ids[gathered(begin[which], size[which])]))
            held += batch.num_rows
            if held >= PACKED:
                yield close()
        if held:
            yield close()

    words = stored.where("words IS NOT NULL").select("dictionary", F.posexplode("words").alias("at", "word")).repartition("word").sortWithinPartitions("word")
    of_dictionary = words.mapInArrow(encoded, "dictionary bigint, at binary, size binary, ids binary").groupBy(F.col("dictionary").alias("d")).agg(F.collect_list(F.struct("at", "size", "ids")).alias("parts"))
    blocks = stored.where("rows IS NOT NULL").select("dictionary", "rows", "places", "sizes")
    # blocks without a word have no dictionary
    joined = blocks.join(of_dictionary, F.col("dictionary") == F.col("d"), "left").select("dictionary", "parts", "rows", "places", "sizes")
    result = StructType([*stored.schema["rows"].dataType.elementType.fields, StructField("n_tokens", LongType()), StructField("ids", BinaryType()), StructField("decoded", BinaryType())])

    def assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(lines.value)
        last, ids, begin, size = None, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for k in range(batch.num_rows):
                number = batch.column(0)[k].as_py()
                if number != last:
                    last, (ids, begin, size) = number, _of_words(batch.column(1)[k].as_py() or [])
                places, counts = unpack(batch.column(3)[k].as_py()), unpack(batch.column(4)[k].as_py())
                tokens, raw, decoded, at = [], [], [], 0
                for n in counts.tolist():
                    own = places[at : at + n]
                    at += n
                    found = ids[gathered(begin[own], size[own])]
                    tokens.append(len(found))
                    raw.append(found.astype("<u4").tobytes())
                    decoded.append(vocabulary.decode(found))
                own = batch.column(2).slice(k, 1).flatten()
                yield pa.record_batch([*own.flatten(), pa.array(tokens, pa.int64()), pa.array(raw, pa.binary()), pa.array(decoded, pa.binary())], names=result.names)

    out = joined.mapInArrow(assembled, result)
    return out.drop("__none") if not kept else out


def gathered(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places ``begin[k] ... begin[k] + size[k] - 1`` of all k, one after the other."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(begin - (ends - size), size)


def _of_words(parts: list[dict[str, bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words of a dictionary, and by a word's number where its own begin and how many there are."""
    at = [np.cumsum(unpack(p["at"])) for p in parts]
    n = max((int(a[-1]) for a in at), default=-1) + 1
    begin, size = np.zeros(n, np.int64), np.zeros(n, np.int64)
    ids, before = [np.zeros(0, np.int64)], 0
    for a, p in zip(at, parts):
        s = unpack(p["size"])
        begin[a], size[a] = before + np.cumsum(s) - s, s
        ids.append(unpack(p["ids"]))
        before += len(ids[-1])
    return np.concatenate(ids), begin, size
