"""A training corpus from ``documents``: five stages, each one operator of lorecraft.llm.

Each stage takes (spark, docs, sf_dir) and returns what it keeps, with the columns of
``documents``; the last returns digests of the encoded corpus.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorecraft.llm import language_id, mixing, near_dups, pieces, quality
from lorecraft.llm.queries import vocabulary
from lorecraft.session import ensure_checkpoint_dir

#: A document whose probability of good quality is less is rejected.
LEAST_QUALITY = 0.3


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents in one of the languages that the labelled documents have: those without a letter go.

    So do null and empty texts. Repeated rows, null ids and null languages stay as they are, if only their text has a letter; texts are read whole.
    Other columns are untouched, whatever their names; an empty table gives an empty one.
    """
    model = language_id.train(docs.where(language_id.split_of("doc_id", 5) != 0))
    found = language_id.identify(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns}), model, text="_text")
    return found.where(F.col("lang_pred") != language_id.UNKNOWN).select(*[F.col(f"_{c}").alias(c) for c in docs.columns])


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that the quality classifier predicts to be good.

    Null and empty texts get the score of a text without features; a null id has no label, but is scored; copies of a row score alike and go or stay together.
    With no labels every document scores alike. Other columns are untouched; an empty table gives an empty one.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    model = quality.train(docs.where(language_id.split_of("doc_id", 5) != 0), labels)
    found = quality.score(docs.withColumnsRenamed({c: f"_{c}" for c in docs.columns}), model, text="_text", threshold=LEAST_QUALITY)
    return found.where("predicted = 1").select(*[F.col(f"_{c}").alias(c) for c in docs.columns])


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class of near duplicates.

    The smallest id of a class stays, of repeated ids one row. Texts without a word (null, empty) are near nothing and stay, as do rows with a null id.
    Very long texts are compared whole.
    Other columns are untouched; an empty table gives an empty one.
    """
    return near_dups.drop_near_duplicates(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target weight asks for; copies are rows.

    Texts without a word (null, empty) count for no target and come as often as the whole part of their source's rate. A null source is a source. Repeated rows count as many. Other columns are untouched; an empty table gives an empty one.
    """
    return mixing.mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per row: doc_id, source, n_tokens and digests of its ids and of what they decode to.

    A null text counts as empty: no tokens. Rows stay one to one, with null and repeated ids; no text is cut. An empty table gives an empty one.
    """
    digest = pieces.Pieces(spark, vocabulary("piece_bpe_32k.model")).digest("text")
    return docs.select("doc_id", "source", digest.alias("d")).select("doc_id", "source", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", languages),
    ("quality", good),
    ("near_duplicates", distinct),
    ("mixing", mixed),
    ("pieces", encoded),
]

#: SQL can't express trained classifiers, signatures, draws and merges; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is a Parquet table in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
