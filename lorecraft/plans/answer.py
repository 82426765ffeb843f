"""Answers from a graph in two stages: only questions that the nearest texts can't answer pay for the graph."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecraft.functions import prompt_texts as W
from lorecraft.functions import vectors as V
from lorecraft.functions.models import EmbeddingModel, LanguageModel, complete_once, embed
from lorecraft.operators import graph as G
from lorecraft.operators import retrieve as S
from lorecraft.plans.build import Graph
from lorecraft.session import ensure_checkpoint_dir

REFUSAL = "I CANNOT ANSWER"


def _with_vectors(rows: DataFrame, text: str, embedding: Callable[[], EmbeddingModel] | None) -> DataFrame:
    """``rows`` with an ``embedding``, made of ``text`` unless they have one."""
    return rows if "embedding" in rows.columns else embed(rows, text, "embedding", embedding).drop("embedding_error").checkpoint()


def _asked(contexts: DataFrame, questions: DataFrame, model: Callable[[], LanguageModel], step: int, options: dict) -> DataFrame:
    rows = questions.select("query", "question").join(contexts, "query", "left").withColumn("context", F.coalesce("context", F.lit("")))
    prompt = W.fill(W.ANSWER, question=F.col("question"), context=F.col("context"))
    return complete_once(rows.withColumn("__prompt", prompt), "__prompt", "answer", model, **options).select("query", "context", "answer", F.lit(step).alias("step"))


def answer(
    questions: DataFrame,
    graph: Graph,
    model: Callable[[], LanguageModel],
    embedding: Callable[[], EmbeddingModel] | None = None,
    *,
    first: int = 3,
    top_k: int = 5,
    similar: float = 0.65,
    with_graph: bool = True,
    refusal: str = REFUSAL,
    **options,
) -> DataFrame:
    """(query, context, answer, step) of ``questions`` (query, question).

    The first stage asks with the ``first`` nearest text units. Where the model refuses or gives no answer, the second takes the entities that at least
    the mean number of units name and the ends of relations at ``similar`` or more to the question; of the units that name these
    or their aliases the ``top_k`` nearest, and with ``with_graph`` the entities and the relations among them, are the context. Questions, units and
    relations that have an ``embedding`` keep it. Units of the frequent entities are one set for all questions, so only what is a question's own is kept by question;
    entities and relations are listed once for all questions with the same ones.
    """
    ensure_checkpoint_dir(questions.sparkSession)
    asked = _with_vectors(questions, "question", embedding)
    units = _with_vectors(graph.units, "content", embedding)
    units = G.dense_ids(units, "id", name="__unit").checkpoint()
    near = lambda q, rows, k, least=None: V.nearest(q, rows, query_id="query", query="embedding", id="__unit", vector="embedding", k=k, threshold=least)
    content = units.select("__unit", "content")

    def sources(hits: DataFrame) -> DataFrame:
        return hits.join(content, F.col("id") == F.col("__unit")).select(F.col("query").alias("key"), "rank", "content")

    texts = S.ranked_texts(sources(near(asked, units, first)), "s").select(F.col("key").alias("query"), F.concat(F.lit("=====Sources=====\n"), "s").alias("context"))
    direct = _asked(texts, asked, model, 1, options).checkpoint()
    refused = direct.where(F.col("answer").isNull() | F.contains("answer", F.lit(refusal))).select("query")
    rest = asked.join(refused, "query").checkpoint()

    relations = _with_vectors(graph.relations.where("description IS NOT NULL"), "description", embedding)
    relations = G.dense_ids(relations, "source", "target", name="__unit").checkpoint() if "id" not in relations.columns else relations.withColumn("__unit", F.col("id"))
    close = near(rest, relations, None, similar).select("query", F.col("id").alias("__unit")).join(relations.select("__unit", "source", "target"), "__unit")
    frequent = S.frequent_seeds(units, "entities").select(F.col("name").alias("id")).checkpoint()
    own = close.select("query", F.explode(F.array("source", "target")).alias("id")).distinct().join(frequent, "id", "left_anti").checkpoint()

    alias = graph.entities.select("id", F.explode("alias").alias("other"))
    names = units.select("__unit", F.explode("entities").alias("id")).distinct()
    shared_ids = frequent.unionByName(frequent.join(alias, "id").select(F.col("other").alias("id"))).distinct()
    shared = names.join(shared_ids, "id", "left_semi").select("__unit").distinct().checkpoint()
    own_ids = own.unionByName(own.join(alias, "id").select(F.col("other").alias("id"), "query")).distinct()
    pairs = names.join(shared, "__unit", "left_anti").join(own_ids, "id").select("query", "__unit").distinct()
    dot = F.aggregate(F.zip_with("q", "v", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q = rest.select("query", V.unit(F.col("embedding")).alias("q"))
    scored = pairs.join(units.select("__unit", V.unit(F.col("embedding")).alias("v")), "__unit").join(q, "query").where("q IS NOT NULL AND v IS NOT NULL").select("query", F.col("__unit").alias("id"), dot.alias("similarity"))
    found = near(rest, units.join(shared, "__unit", "left_semi"), top_k).select("query", "id", "similarity").unionByName(scored)
    best = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 9)), "id"))).where(F.col("rank") <= top_k)
    if with_graph:
        # questions with the same entities share the lines of these and of the relations among them: those are met and sorted once a set
        none = F.array().cast(f"array<{own.schema['id'].dataType.simpleString()}>")
        of_query = own.groupBy("query").agg(F.array_sort(F.collect_set("id")).alias("key"))
        sets = rest.select("query").distinct().join(of_query, "query", "left").select("query", F.coalesce("key", none).alias("key")).checkpoint()
        each = sets.select("key").distinct()
        vertices = each.crossJoin(frequent.select("id")).unionByName(each.select("key", F.explode("key").alias("id"))).checkpoint()
        known = graph.entities.select("id", "name", "description")
        inner = graph.relations.join(vertices.withColumnRenamed("id", "source"), "source").join(vertices.withColumnRenamed("id", "target"), ["key", "target"])
        heads = S.context(vertices.join(known, "id"), inner.select("key", "source", "target", "description"), each.where("false").select("key", F.lit("").alias("content")))
        of_set = sets.join(heads, "key").select("query", F.col("context").alias("head"))
        texts = S.ranked_texts(sources(best), "s").withColumnRenamed("key", "query")
        head = F.coalesce("head", F.lit("=====Entities=====\n\n=====Relationships=====\n\n=====Sources=====\n"))
        context = of_set.join(texts, "query", "full").select("query", F.concat(head, F.coalesce("s", F.lit(""))).alias("context"))
    else:
        context = S.ranked_texts(sources(best), "s").select(F.col("key").alias("query"), F.concat(F.lit("=====Sources=====\n"), "s").alias("context"))
    second = _asked(context, rest, model, 2, options)
    return direct.join(refused, "query", "left_anti").unionByName(second)
