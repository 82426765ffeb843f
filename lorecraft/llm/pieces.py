"""SentencePiece BPE, encoding and decoding, as vectorised merge rounds.

A batch of texts becomes its distinct words (a run of spaces and what follows,
which no piece crosses), and all words one flat array of symbols. A round looks
up the rank of every adjacent pair, takes the smallest rank of each word, merges
all leftmost, not overlapping pairs of that rank at once and compacts the
arrays; words without a pair left drop out. Where a new symbol could start a
better-ranked pair than the one just merged, only the leftmost pair of that word
is merged in the round, which keeps the result that of one merge at a time.

Words of more than ``LONG`` symbols are first cut where no piece holds both neighbours,
which no merge can cross. What is still long takes rounds in order of rank over
linked symbols: a round touches only the pairs of its rank and their neighbours, so
the work grows with the length of a word, not with its square.

Characters without a piece become UTF-8 byte pieces. A null text is an empty
one: no ids, and the empty text back.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecraft.session import ship_package

SPACE = "▁"
WORD = re.compile(r" *[^ ]+| +")
NONE = np.iinfo(np.int32).max
#: Symbols of a word that is worked on by rank, pair by pair.
LONG = 256


def _mix(keys: np.ndarray, level: int, bits: int) -> np.ndarray:
    """Slots of ``keys`` in a table of ``2**bits``; another function for each level."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15 + 2 * level * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF)
    return ((x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - bits)).astype(np.int64)


class PairTable:
    """Pair of symbols -> merged piece, by hashing into a few levels without collisions."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.levels = []
        bits = max(8, int(np.ceil(np.log2(len(keys) * 2 + 2))))
        while len(keys):
            slots = _mix(keys, len(self.levels), bits)
            _, first = np.unique(slots, return_index=True)
            table, ids = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
            table[slots[first]], ids[slots[first]] = keys[first], values[first]
            self.levels.append((bits, table, ids))
            left = np.ones(len(keys), bool)
            left[first] = False
            keys, values, bits = keys[left], values[left], max(8, bits - 2)

    def find(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int32)
        rest, at = keys, None
        for level, (bits, table, ids) in enumerate(self.levels):
            slots = _mix(rest, level, bits)
            held = table[slots]
            hit = held == rest
            if at is None:
                out[hit] = ids[slots[hit]]
            else:
                out[at[hit]] = ids[slots[hit]]
            on = np.flatnonzero(~hit & (held >= 0))  # an empty slot ends the search
            at = on if at is None else at[on]
            rest = rest[on]
            if not len(rest):
                break
        return out


@dataclass
class PieceModel:
    """What encoding and decoding need of a SentencePiece BPE model; picklable."""

    pieces: list[bytes]  # what each id decodes to
    first_space: np.ndarray  # ids whose piece starts with a space
    rank: np.ndarray  # of each piece, the best is 0
    unsafe: np.ndarray  # pieces that can start a better pair than themselves
    symbol: np.ndarray  # code point -> symbol, -1 without one
    table: PairTable
    beside: PairTable  # characters that stand side by side in a piece
    byte_id: np.ndarray  # byte -> id
    size: int

    @staticmethod
    def load(path: str) -> "PieceModel":
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        text = [sp.id_to_piece(i) for i in range(size)]
        is_byte = [sp.is_byte(i) for i in range(size)]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) for i in range(size)]
        if sum(is_byte) != 256:
            raise ValueError("the model has no byte fallback")
        if sp.encode(" a", out_type=str) != sp.encode(SPACE + "a", out_type=str) or sp.decode(sp.encode("  a  b ")) != "  a  b ":
            raise ValueError("the model changes white space")
        normal = {t: i for i, t in enumerate(text) if not (is_byte[i] or special[i])}
        if any(SPACE in t.lstrip(SPACE) for t in normal):
            raise ValueError("the model has pieces across words")
        chars = sorted({c for t in normal for c in t} - set(normal))
        symbols = normal | {c: size + k for k, c in enumerate(chars)}
        scores = np.array([sp.get_score(i) for i in range(size)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        left, right, merged = [], [], []
        for t, i in normal.items():
            for cut in range(1, len(t)):
                if (a := symbols.get(t[:cut])) is not None and (b := symbols.get(t[cut:])) is not None:
                    left.append(a), right.append(b), merged.append(i)
        left, right, merged = (np.array(x, np.int64) for x in (left, right, merged))
        unsafe = np.zeros(size + len(chars), bool)
        for side in (left, right):
            old = side < size
            worse = rank[merged[old]] <= rank[side[old]]
            unsafe[side[old][worse]] = True
        symbol = np.full(0x110000, -1, np.int32)
        for t, i in symbols.items():
            if len(t) == 1:
                symbol[ord(t)] = i
        symbol[ord(" ")] = symbol[ord(SPACE)]
        pairs = np.array(sorted({int(symbol[ord(a)]) << 32 | int(symbol[ord(b)]) for t in normal for a, b in zip(t, t[1:])}), np.int64)
        byte_id = np.zeros(256, np.int32)
        out: list[bytes] = []
        for i, t in enumerate(text):
            if is_byte[i]:
                byte_id[int(t[3:5], 16)] = i
                out.append(bytes([int(t[3:5], 16)]))
            elif special[i]:
                out.append(" ⁇ ".encode() if sp.is_unknown(i) else b"")
            else:
                out.append(t.replace(SPACE, " ").encode())
        spaced = np.array([t.startswith(SPACE) and not special[i] for i, t in enumerate(text)])
        return PieceModel(out, spaced, rank, unsafe, symbol, PairTable(left << 32 | right, merged.astype(np.int32)), PairTable(pairs, np.zeros(len(pairs), np.int32)), byte_id, size)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the words, and where each word starts (with the end as the last)."""
        code = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        sym, pos = self.symbol[code], np.arange(len(code), dtype=np.int64)
        if not len(sym):
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        part, lasting = word, np.zeros(len(sym), bool)
        if lengths.max() > LONG:
            ends = word[1:] != word[:-1]
            inner = np.flatnonzero((lengths[word[1:]] > LONG) & ~ends)
            known = (sym[inner] >= 0) & (sym[inner + 1] >= 0)
            ends[inner] = ~known
            inner = inner[known]
            ends[inner] = self.beside.find(sym[inner].astype(np.int64) << 32 | sym[inner + 1]) < 0
            part = np.r_[0, np.cumsum(ends)].astype(np.int32)
            lasting = np.bincount(part)[part] > LONG
        ended = self._rounds(sym[~lasting], pos[~lasting], part[~lasting])
        if lasting.any():
            ended.append(self._ranked(sym[lasting], pos[lasting], part[lasting]))
        sym, pos = (np.concatenate(x) for x in zip(*ended))
        order = np.argsort(pos, kind="stable")
        pos = pos[order]
        ids, word = self._bytes(sym[order], code[pos], word[pos])
        return ids, np.r_[0, np.cumsum(np.bincount(word, minlength=len(words)))]

    def _rounds(self, sym: np.ndarray, pos: np.ndarray, word: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rounds over all words at once: each merges the smallest rank of every word."""
        ended: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            merged = np.full(len(sym), -1, np.int32)
            inside = np.flatnonzero((word[1:] == word[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0))
            merged[inside] = self.table.find(sym[inside].astype(np.int64) << 32 | sym[inside + 1])
            rank = np.where(merged >= 0, self.rank[merged], NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(sym)])
            best = np.minimum.reduceat(rank, first)
            if not (live := best != NONE).all():
                stay = np.repeat(live, count)
                ended.append((sym[~stay], pos[~stay]))
                sym, pos, word, merged, rank = sym[stay], pos[stay], word[stay], merged[stay], rank[stay]
                best, count = best[live], count[live]
                if not len(sym):
                    break
            hit = np.flatnonzero(rank == np.repeat(best, count))
            begins = np.r_[True, hit[1:] != hit[:-1] + 1]
            start = hit[begins][np.cumsum(begins) - 1]
            take = (hit - start) % 2 == 0
            if (risky := self.unsafe[merged[hit]]).any():
                take &= ~risky | np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            at = hit[take]
            sym[at] = merged[at]
            stay = np.ones(len(sym), bool)
            stay[at + 1] = False
            sym, pos, word = sym[stay], pos[stay], word[stay]
        return ended

    def _ranked(self, sym: np.ndarray, pos: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rounds by rank, smallest first, over linked symbols; place ``n`` stands for none."""
        n = len(sym)
        sym = np.r_[sym, np.int32(-1)]
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.flatnonzero(np.r_[word[1:] != word[:-1], True])
        after[ends], before[np.r_[0, ends[:-1] + 1]], after[n] = n, n, n
        merged, rank = np.full(n + 1, -1, np.int32), np.full(n + 1, NONE, np.int32)
        waiting: dict[int, list[int]] = {}
        ranks: list[int] = []

        def look(at: np.ndarray) -> None:
            """Look up the pairs that begin at these places, and queue them by rank."""
            a, b = sym[at], sym[after[at]]
            found = np.full(len(at), -1, np.int32)
            known = np.flatnonzero((a >= 0) & (b >= 0))
            found[known] = self.table.find(a[known].astype(np.int64) << 32 | b[known])
            merged[at] = found
            rank[at] = np.where(found >= 0, self.rank[found], NONE)
            some = at[found >= 0]
            for k, r in zip(some.tolist(), rank[some].tolist()):
                if r in waiting:
                    waiting[r].append(k)
                else:
                    waiting[r] = [k]
                    heappush(ranks, r)

        look(np.arange(n))
        while ranks:
            r = heappop(ranks)
            hit = np.unique(np.array(waiting.pop(r), np.int64))
            hit = hit[rank[hit] == r]
            if not len(hit):
                continue
            begins = np.r_[True, after[hit[:-1]] != hit[1:]]
            take = np.ones(len(hit), bool) if begins.all() else (np.arange(len(hit)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 0
            if (risky := self.unsafe[merged[hit]]).any():
                take &= ~risky | np.r_[True, word[hit[1:]] != word[hit[:-1]]]
            at = hit[take]
            right = after[at]
            sym[at] = merged[at]
            rank[right] = NONE
            sym[right] = -2
            after[at] = after[right]
            before[after[at]] = at
            left = before[at]
            look(np.concatenate([at, left[left < n]]))
            later = hit[~take]
            later = later[rank[later] == r].tolist()
            if later:
                if r in waiting:
                    waiting[r] += later
                else:
                    waiting[r] = later
                    heappush(ranks, r)
        stay = sym[:n] != -2
        return sym[:n][stay], pos[stay]

    def _bytes(self, sym: np.ndarray, code: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte pieces in place of symbols that are no piece."""
        odd = np.flatnonzero((sym < 0) | (sym >= self.size))
        if not len(odd):
            return sym, word
        utf8 = [chr(c).encode() for c in code[odd].tolist()]
        times = np.ones(len(sym), np.int64)
        times[odd] = [len(b) for b in utf8]
        ends = np.cumsum(times)
        ids = np.repeat(sym, times)
        spots = np.concatenate([np.arange(ends[i] - len(b), ends[i]) for i, b in zip(odd, utf8)])
        ids[spots] = self.byte_id[np.frombuffer(b"".join(utf8), np.uint8)]
        return ids, np.repeat(word, times)

    def encode(self, texts: list[str | None], chars: int = 600_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For groups of texts with about ``chars`` characters: flat ids, and the count of each text."""
        at = 0
        while at < len(texts):
            words: list[str] = []
            per_text: list[int] = []
            held = 0
            while at < len(texts) and held < chars:
                text = texts[at] or ""
                found = WORD.findall(" " + text.replace(SPACE, " ")) if text else []
                words += found
                per_text.append(len(found))
                held += len(text)
                at += 1
            if not words:
                yield np.zeros(0, np.int32), np.zeros(len(per_text), np.int64)
                continue
            distinct: defaultdict[str, int] = defaultdict()
            distinct.default_factory = distinct.__len__  # a new word gets the next number
            code = np.array([distinct[w] for w in words], np.int64)
            ids, start = self.encode_words(list(distinct))
            length = np.diff(start)[code]
            end = np.cumsum(length)
            flat = ids[np.arange(end[-1]) + np.repeat(start[code] - (end - length), length)]
            bounds = np.r_[0, end][np.r_[0, np.cumsum(per_text)]]
            yield flat, np.diff(bounds)

    def decode(self, ids: list[int]) -> str:
        """The text of ``ids``, as the library's decode gives it."""
        shown = next((i for i in ids if self.pieces[i]), None)
        drop = shown is not None and bool(self.first_space[shown])
        raw = b"".join([self.pieces[i] for i in ids])
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            text = self._repair(ids)
        return text[1:] if drop else text

    def _repair(self, ids: list[int]) -> str:
        """Each byte of a run of byte pieces that starts no whole character becomes U+FFFD."""
        out, run = [], b""
        bytes_of = {int(i): b for b, i in enumerate(self.byte_id)}

        def close() -> str:
            made, at = "", 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        made += run[at : at + n].decode()
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    made += "�"
                    at += 1
            return made

        for i in ids:
            if i in bytes_of:
                run += bytes([bytes_of[i]])
            else:
                out.append(close())
                run = b""
                out.append(self.pieces[i].decode())
        return "".join(out) + close()


class Pieces:
    """Column functions of one model: ``encode(text) -> array<int>``, ``decode(ids) -> string``.

    The model's tables have the size of its vocabulary and are broadcast.
    """

    def __init__(self, spark: SparkSession, path: str):
        ship_package(spark)
        model = spark.sparkContext.broadcast(PieceModel.load(path))

        @F.arrow_udf("array<int>")
        def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                parts, counts = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)]
                for flat, count in model.value.encode(batch.to_pylist()):
                    parts.append(flat)
                    counts.append(count)
                offsets = np.cumsum(np.concatenate(counts)).astype(np.int32)
                yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(parts)))

        @F.arrow_udf("string")
        def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                flat = batch.flatten().to_numpy(zero_copy_only=False).tolist()
                counts = pc.fill_null(pc.list_value_length(batch), 0).to_numpy(zero_copy_only=False)
                ends = np.cumsum(counts).tolist()
                out, start = [], 0
                for end in ends:
                    out.append(model.value.decode(flat[start:end]))
                    start = end
                yield pa.array(out, pa.string())

        @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
        def digest(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                sizes, of_ids, of_text = [], [], []
                for flat, count in model.value.encode(batch.to_pylist()):
                    ids, start = flat.tolist(), 0
                    for n in count.tolist():
                        own = ids[start : start + n]
                        start += n
                        sizes.append(n)
                        of_ids.append(sha256(",".join(map(str, own)).encode()).hexdigest())
                        of_text.append(sha256(model.value.decode(own).encode()).hexdigest())
                yield pa.StructArray.from_arrays([pa.array(sizes, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], names=["n_tokens", "ids_sha256", "decoded_sha256"])

        self._encode, self._decode, self._digest = encode, decode, digest

    def encode(self, text: Column | str) -> Column:
        column = F.col(text) if isinstance(text, str) else text
        return self._encode(F.coalesce(column.cast("string"), F.lit("")))

    def decode(self, ids: Column | str) -> Column:
        return self._decode(ids)

    def digest(self, text: Column | str) -> Column:
        """Of each text: how many ids, and SHA-256 of the ids and of what they decode to.

        For comparing corpora without moving ids: they stay in the Python worker.
        """
        column = F.col(text) if isinstance(text, str) else text
        return self._digest(F.coalesce(column.cast("string"), F.lit("")))


def encode_decode(df: DataFrame, model: str, *, text: str = "text", ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``df`` with the ids of each text and the text that they decode to; same-named columns are replaced."""
    pieces = Pieces(df.sparkSession, model)
    rest = [c for c in df.columns if c not in {ids, decoded}]
    return df.select(*rest, pieces.encode(text).alias(ids)).withColumn(decoded, pieces.decode(ids))
