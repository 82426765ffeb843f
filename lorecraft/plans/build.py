"""From a corpus to an aligned entity graph with text units, a model at each step that needs one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorecraft.functions import parse as P
from lorecraft.functions import prompt_texts as W
from lorecraft.functions import text as X
from lorecraft.functions import vectors as V
from lorecraft.functions.models import EmbeddingModel, LanguageModel, complete, embed
from lorecraft.operators import graph as G
from lorecraft.operators import instruct as I
from lorecraft.operators import mentions as M
from lorecraft.operators.components import connected_components
from lorecraft.session import ensure_checkpoint_dir


@dataclass(frozen=True)
class BuildOptions:
    types: tuple[str, ...] = ("PERSON", "ORGANISATION", "PLACE", "EVENT", "THING")
    similar: float = 0.9
    expand: int = 1
    overlap: float | None = 0.9
    tries: int = 3
    batch: int = 16
    wait: float = 1.0


@dataclass(frozen=True)
class Graph:
    """Entities (id, name, type, description, embedding, alias), relations (id, source, target, description), text units."""

    entities: DataFrame
    relations: DataFrame
    units: DataFrame


def extract(docs: DataFrame, model: Callable[[], LanguageModel], options: BuildOptions = BuildOptions()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Entities and relations that a model reads in the cleaned texts, and a status for each document.

    A document is ``blank`` (too short to ask), ``failed`` (no reply), ``empty`` or ``read``.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    cleaned = docs.select("doc_id", X.clean(F.col("text")).alias("t"))
    asked = cleaned.withColumn("prompt", F.when(F.col("t") != "", W.fill(W.EXTRACT, types=F.lit(", ".join(options.types)), text=F.col("t"))))
    replied = complete(asked, "prompt", "reply", model, tries=options.tries, batch=options.batch, wait=options.wait).withColumn("g", P.graph_of(F.col("reply"))).checkpoint()
    status = F.when(F.col("prompt").isNull(), "blank").when(F.col("reply").isNull(), "failed").when(F.size("g.entities") == 0, "empty").otherwise("read")
    entities = replied.select(F.col("doc_id").alias("doc"), F.posexplode("g.entities").alias("pos", "e")).select("doc", "pos", "e.*").where("name IS NOT NULL AND name <> ''")
    relations = replied.select(F.col("doc_id").alias("doc"), F.posexplode("g.relations").alias("pos", "r")).select("doc", "pos", "r.*").where("source IS NOT NULL AND target IS NOT NULL")
    fixed = I.repaired(F.col("type"), F.col("description"), F.col("name"), list(options.types))
    entities = entities.withColumn("f", fixed).select("doc", "pos", "name", F.when(F.col("f.type") == "UNKNOWN", "").otherwise(F.col("f.type")).alias("type"), "description")
    return entities, relations, replied.select("doc_id", status.alias("status"))


def merge(entities: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per name with an id, and one per pair of ids; endpoints that no text describes are added."""
    edges = G.merge_relations(relations)
    whole = G.with_endpoints(G.merge_entities(entities), edges)
    last = F.lit(2**62)
    ordered = whole.withColumn("first_doc", F.coalesce("first_doc", last)).withColumn("first_pos", F.coalesce("first_pos", F.lit(0)))
    ids = G.dense_ids(ordered, "first_doc", "first_pos", "name").drop("first_doc", "first_pos")
    return ids, G.dense_ids(G.resolve_ids(edges, ids), "source", "target")


def described(rows: DataFrame, model: Callable[[], LanguageModel]) -> DataFrame:
    """``rows`` with one ``description`` for all ``descriptions``; the model is asked for those with several."""
    many = F.when(F.size("descriptions") > 1, W.fill(W.SUMMARISE, descriptions=F.array_join("descriptions", "\n\n")))
    asked = complete(rows.withColumn("__p", many), "__p", "__s", model)
    return asked.withColumn("description", G.consolidate(F.col("descriptions"), lambda _: F.col("__s"))).drop("descriptions", "__p", "__s", "__s_error")


def aligned(entities: DataFrame, embedding: Callable[[], EmbeddingModel], similar: float) -> DataFrame:
    """``entities`` with the embedding of their description, and aliases: near entities of the same type."""
    ensure_checkpoint_dir(entities.sparkSession)
    vectors = embed(entities, "description", "embedding", embedding).drop("embedding_error").checkpoint()
    typed = vectors.where("type <> '' AND embedding IS NOT NULL")
    pairs = V.similar_pairs(typed, id="id", vector="embedding", group="type", threshold=similar)
    alias = G.aliases(connected_components(pairs, "a", "b").select(F.col("component").alias("group"), "id"))
    return vectors.join(alias, "id", "left").withColumn("alias", F.coalesce("alias", F.array().cast("array<bigint>")))


def connect(docs: DataFrame, entities: DataFrame, options: BuildOptions = BuildOptions()) -> DataFrame:
    """Text units with the ids of the entities that they name."""
    sentences = M.sentence_table(docs)
    units = M.text_units(sentences, M.link_names(sentences, entities.select("name")), expand=options.expand, ratio=options.overlap)
    named = units.select("id", F.explode("names").alias("name")).join(entities.select("name", F.col("id").alias("entity")), "name")
    ids = named.groupBy("id").agg(F.array_sort(F.collect_set("entity")).alias("entities"))
    return units.drop("names").join(ids, "id")


def build(docs: DataFrame, model: Callable[[], LanguageModel], embedding: Callable[[], EmbeddingModel], options: BuildOptions = BuildOptions()) -> Graph:
    """All steps over documents (doc_id, text)."""
    entities, relations, _ = extract(docs, model, options)
    entities, relations = merge(entities, relations)
    entities = aligned(described(entities, model), embedding, options.similar)
    return Graph(entities, described(relations, model), embed(connect(docs, entities, options), "content", "embedding", embedding).drop("embedding_error"))


@dataclass(frozen=True)
class Pipeline:
    """Steps, each a table to a table, in a row."""

    components: tuple[Callable[[DataFrame], DataFrame], ...]

    def run(self, rows: DataFrame) -> DataFrame:
        for step in self.components:
            rows = rows.transform(step)
        return rows
