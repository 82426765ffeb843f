"""Splitters of texts into windows: by words, by the tokens of a vocabulary file, or of your own."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecraft.functions import text as X
from lorecraft.session import ship_package

#: What a splitter makes of a text: windows with their first token, their tokens and their text.
WINDOWS = "array<struct<start:int,n_tokens:int,content:string>>"


class TextSplitter(Protocol):
    """One text to many windows, as a column."""

    def split(self, text: Column) -> Column: ...


@dataclass(frozen=True)
class WordSplitter:
    size: int = 2048
    overlap: int = 64

    def split(self, text: Column) -> Column:
        made = X.windows(X.tokens(text), self.size, self.overlap)
        return F.transform(made, lambda w: F.struct(w["start"].alias("start"), F.size(w["words"]).alias("n_tokens"), F.array_join(w["words"], " ").alias("content")))


@lru_cache(4)
def _tokenizer(spec: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_str(spec)


@dataclass(frozen=True)
class TokenSplitter:
    """Windows of the tokens of a byte-level BPE; the content is the text that they cover.

    ``path`` is a tokenizer's JSON file on the driver. A character whose tokens lie on both sides of a
    border belongs to the later window.
    """

    path: str
    size: int = 2048
    overlap: int = 64

    def split(self, text: Column) -> Column:
        with open(self.path, encoding="utf-8") as f:
            spec = f.read()
        size, step = self.size, self.size - self.overlap

        @F.arrow_udf(WINDOWS)
        def windows(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            kind = pa.list_(pa.struct([("start", pa.int32()), ("n_tokens", pa.int32()), ("content", pa.string())]))
            for batch in batches:
                out = []
                for value in batch.to_pylist():
                    raw = (value or "").encode()
                    ends = np.cumsum([0, *map(len, _tokenizer(spec).encode(value or "", add_special_tokens=False).tokens)])  # a sign a byte
                    if ends[-1] != len(raw):
                        raise ValueError("not a byte-level tokenizer")
                    flat = np.frombuffer(raw + b" ", np.uint8)
                    starts = np.maximum.accumulate(np.where(flat & 0xC0 != 0x80, np.arange(len(flat)), 0))[ends]  # of the characters
                    count = len(ends) - 1
                    cuts = [(a, min(a + size, count)) for a in range(0, count, step)]
                    out.append([{"start": a, "n_tokens": b - a, "content": raw[starts[a] : starts[b]].decode()} for a, b in cuts])
                yield pa.array(out, kind)

        return windows(text)


def split_texts(df: DataFrame, splitter: TextSplitter, *, text: str = "text") -> DataFrame:
    """``df`` without its text, a row for each window: ``start``, ``n_tokens``, ``content``."""
    ship_package(df.sparkSession)
    rest = [c for c in df.columns if c not in {text, "start", "n_tokens", "content"}]
    return df.select(*rest, F.explode(splitter.split(F.col(text))).alias("__w")).select(*rest, "__w.*")
