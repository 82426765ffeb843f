"""Calls of language and embedding models by partition, with deterministic stand-ins."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecraft.session import ensure_checkpoint_dir, ship_package


class LanguageModel(Protocol):
    """What a client must do; it is built in the Python worker."""

    def complete(self, prompts: list[str]) -> list[str]: ...


class EmbeddingModel(Protocol):
    def embed(self, texts: list[str]) -> list[list[float]]: ...


class EchoModel:
    """Replies with the first words of the prompt's last line: the same for the same prompt."""

    def __init__(self, words: int = 12):
        self.words = words

    def complete(self, prompts: list[str]) -> list[str]:
        return [" ".join(p.strip().split("\n")[-1].split()[: self.words]) for p in prompts]


class HashEmbedding:
    """Words hashed to signed dimensions, at length one."""

    def __init__(self, dimensions: int = 64):
        self.dimensions = dimensions

    def embed(self, texts: list[str]) -> list[list[float]]:
        import xxhash

        out = []
        for t in texts:
            v = np.zeros(self.dimensions)
            for w in t.lower().split():
                h = xxhash.xxh64_intdigest(w)
                v[h % self.dimensions] += 1 if h >> 63 else -1
            out.append((v / max(np.linalg.norm(v), 1e-12)).tolist())
        return out


def with_retries(call: Callable[[list[str]], list], batch: list[str], tries: int, wait: float) -> tuple[list | None, str | None]:
    """The result and no error, or no result and the last error, after waits that double."""
    error = None
    for k in range(tries):
        try:
            return call(batch), None
        except Exception as e:  # whatever a remote client raises
            error = f"{type(e).__name__}: {e}"
            if k < tries - 1:
                time.sleep(wait * 2**k)
    return None, error


def _called(df: DataFrame, column: str, out: str, kind: str, build: Callable[[], Callable[[list[str]], list]], batch: int, threads: int, tries: int, wait: float) -> DataFrame:
    """``df`` with ``out`` and ``out_error``; null inputs are not sent and give null."""
    ship_package(df.sparkSession)

    @F.pandas_udf(f"struct<value:{kind},error:string>")
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        call = build()
        with ThreadPoolExecutor(threads) as pool:
            for s in series:
                values, errors = [None] * len(s), [None] * len(s)
                sent = [i for i, t in enumerate(s) if t is not None]
                parts = [sent[a : a + batch] for a in range(0, len(sent), batch)]
                for part, (got, error) in zip(parts, pool.map(lambda p: with_retries(call, [s.iloc[i] for i in p], tries, wait), parts)):
                    for k, i in enumerate(part):
                        values[i], errors[i] = (got[k] if got is not None else None), error
                yield pd.DataFrame({"value": pd.Series(values, dtype=object), "error": pd.Series(errors, dtype=object)})

    return df.withColumn("__call", run(F.col(column))).withColumn(out, F.col("__call.value")).withColumn(f"{out}_error", F.col("__call.error")).drop("__call")


def complete(df: DataFrame, prompt: str, out: str, model: Callable[[], LanguageModel], *, batch: int = 16, threads: int = 8, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``df`` with replies to the prompts of a column; calls are stateless, batched and retried."""
    return _called(df, prompt, out, "string", lambda: model().complete, batch, threads, tries, wait)


def complete_once(df: DataFrame, prompt: str, out: str, model: Callable[[], LanguageModel], **options) -> DataFrame:
    """``df`` with replies, each distinct prompt sent once; replies are kept by the prompts' SHA-256, so they are the same wherever ``df`` is used."""
    ensure_checkpoint_dir(df.sparkSession)
    asked = df.select(F.col(prompt).alias("__asked")).where("__asked IS NOT NULL").distinct()
    # prompts may be long: replies are kept and found by the prompt's digest
    replies = complete(asked, "__asked", out, model, **options).select(F.sha2("__asked", 256).alias("__digest"), out).checkpoint()
    return df.withColumn("__digest", F.sha2(prompt, 256)).join(replies, "__digest", "left").drop("__digest")


def embed(df: DataFrame, text: str, out: str, model: Callable[[], EmbeddingModel], *, batch: int = 10, threads: int = 4, tries: int = 3, wait: float = 1.0) -> DataFrame:
    """``df`` with vectors of the texts of a column."""
    return _called(df, text, out, "array<double>", lambda: model().embed, batch, threads, tries, wait)


def gleaned(df: DataFrame, prompt: str, out: str, model: Callable[[], LanguageModel], *, rounds: int = 1, more: str = "Is anything missing? Answer YES or NO.", go_on: str = "Add what is missing.", **options) -> DataFrame:
    """Replies of up to ``rounds`` rounds, joined by line ends; a round follows while the model says YES."""
    df = complete(df, prompt, out, model, **options)
    for _ in range(rounds - 1):
        df = df.withColumn("__ask", F.concat_ws("\n", prompt, out, F.lit(more)))
        df = complete(df, "__ask", "__more", model, **options)
        wanted: Column = F.upper(F.trim("__more")) == "YES"
        df = df.withColumn("__ask", F.when(wanted, F.concat_ws("\n", prompt, out, F.lit(go_on))))
        df = complete(df, "__ask", "__next", model, **options)
        df = df.withColumn(out, F.concat_ws("\n", out, "__next")).drop("__ask", "__more", "__more_error", "__next", "__next_error")
    return df
