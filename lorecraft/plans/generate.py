"""From a graph to questions with answers, and the simpler generators to compare with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecraft.functions import parse as P
from lorecraft.functions import prompts as R
from lorecraft.functions import prompt_texts as W
from lorecraft.functions import vectors as V
from lorecraft.functions.clients import Checked
from lorecraft.functions.models import LanguageModel, complete
from lorecraft.operators import graph as G
from lorecraft.operators import instruct as I
from lorecraft.plans.build import Graph


def contexts(graph: Graph, *, near: int = 3, keep: int = 5, size: int = 2, threshold: float = 0.75, cap: int | None = None) -> DataFrame:
    """(query, combo, ids, sources): combinations of text units for each entity.

    An entity's nearest units name seeds; relations close to it add their ends, aliases
    add theirs; of all units that name one of these the ``keep`` nearest are combined.
    """
    asked = graph.entities.where("embedding IS NOT NULL").select(F.col("id").alias("query"), F.col("embedding").alias("q"))
    units = G.dense_ids(graph.units.where("embedding IS NOT NULL"), "doc", "l", "r", name="unit").checkpoint()
    first = V.nearest(asked, units, query_id="query", query="q", id="unit", vector="embedding", k=near)
    named = units.select("unit", F.explode("entities").alias("entity"))
    seeds = first.join(named, first["id"] == named["unit"]).select("query", "entity").distinct()
    edges = graph.relations.select("source", "target")
    ends = seeds.join(edges, F.col("entity") == F.col("source")).select("query", F.col("target").alias("entity"))
    ends = ends.unionByName(seeds.join(edges, F.col("entity") == F.col("target")).select("query", F.col("source").alias("entity")))
    vectors = graph.entities.select(F.col("id").alias("entity"), "embedding", "alias")
    close = ends.distinct().join(vectors, "entity").join(asked, "query").where(V.cosine(F.col("embedding"), F.col("q")) >= threshold).select("query", "entity")
    wide = seeds.unionByName(close).distinct().join(vectors.select("entity", "alias"), "entity")
    wide = wide.select("query", F.explode(F.array_union(F.array("entity"), "alias")).alias("entity")).distinct()
    found = wide.join(named, "entity").select("query", "unit").distinct()
    scored = found.join(units.select("unit", "content", F.col("embedding").alias("v")), "unit").join(asked, "query")
    from pyspark.sql.window import Window

    order = Window.partitionBy("query").orderBy(F.desc(V.cosine(F.col("v"), F.col("q"))), "unit")
    ranked = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    combos = I.combinations(ranked.select("query", "rank", F.col("unit").alias("id"), "content"), size, cap)
    parts = combos.select("query", "combo", "ids", F.posexplode("ids").alias("at", "unit")).join(units.select("unit", "content"), "unit")
    texts = F.transform(F.array_sort(F.collect_list(F.struct("at", "content"))), lambda x: x["content"])
    return parts.groupBy("query", "combo", "ids").agg(texts.alias("sources"))


def mode_rules(size: Column) -> Column:
    """What a question must be like that joins so many passages; other numbers go by the rules for two."""
    by_size = F.create_map(*[F.lit(x) for pair in W.MODES.items() for x in pair])
    return F.coalesce(F.element_at(by_size, size), F.lit(W.MODES[2]))


def questions(combos: DataFrame, model: Callable[[], LanguageModel], rules: str | None = None) -> DataFrame:
    """``combos`` with a file name, the relevance of the first two sources, a prompt, and the question.

    ``rules`` are those for the number of sources unless given.
    """
    name = F.concat(F.lit("question_"), F.col("query").cast("string"), F.lit("_mode_"), F.size("sources").cast("string"), F.lit("_combo_"), F.col("combo").cast("string"), F.lit(".txt"))
    prompt = W.fill(W.QUESTION, n=F.size("sources"), rules=mode_rules(F.size("sources")) if rules is None else F.lit(rules), sources=F.array_join("sources", "\n\n"))
    judge = F.when(F.size("sources") >= 2, W.fill(W.RELEVANT, first=F.col("sources")[0], second=F.col("sources")[1]))
    rows = complete(combos.withColumn("file_name", name).withColumn("prompt", prompt).withColumn("__judge", judge), "prompt", "question", model)
    return complete(rows, "__judge", "verdict", model).withColumn("relevance", P.relevance(F.col("verdict"))).drop("__judge")


def numbered_questions(rows: DataFrame, reply: str = "question") -> DataFrame:
    """``rows`` once for each numbered question of a reply, with ``n``, ``asked`` and ``expected`` (null if the reply has no answer); rows without one go."""
    each = rows.withColumn("__b", F.explode(P.numbered_questions(F.col(reply))))
    return each.select(*[F.col(c) for c in rows.columns], F.col("__b.n").alias("n"), F.col("__b.question").alias("asked"), F.col("__b.answer").alias("expected")).where("asked <> ''")


def answers(rows: DataFrame, done: DataFrame, model: Callable[[], LanguageModel]) -> DataFrame:
    """Questions with answers: those in ``done`` (file_name, answer) are taken over, the others are asked."""
    todo = I.remaining(rows, done, "file_name").withColumn("__p", W.fill(W.ANSWER, context=F.array_join("sources", "\n\n"), question=F.col("question")))
    new = complete(todo, "__p", "answer", model).select("file_name", "question", "answer")
    old = rows.join(done.select("file_name", "answer"), "file_name").select("file_name", "question", "answer")
    return old.unionByName(new)


def pair_texts(docs: DataFrame, entities: DataFrame, model: Callable[[], LanguageModel], *, target: int, seed: int = 42, triples: bool = False) -> DataFrame:
    """(doc, a, b, c, passage): passages on sampled pairs (or triples) of each document's entities (doc, names).

    Each document gives ``max(1, target // documents)`` pairs; c is null for pairs.
    """
    n = max(1, target // max(1, docs.count()))
    if triples:
        item = lambda i, c: entities.select("doc", F.posexplode("names").alias(i, c))
        picked = item("i", "a").join(item("j", "b"), "doc").where("i < j").join(item("k", "c"), "doc").where("j < k").select("doc", "a", "b", "c")
        picked = I.sample_per_group(picked.withColumn("__k", F.concat_ws("|", "a", "b", "c")), "doc", "__k", n, seed).drop("__k")
    else:
        picked = I.entity_pairs(entities, seed=seed, per_doc=n).withColumn("c", F.lit(None).cast("string"))
    second: Column = F.concat_ws(" and ", "b", "c")
    asked = picked.join(docs.select(F.col("doc_id").alias("doc"), "text"), "doc").withColumn("__p", W.fill(W.PAIR, a=F.col("a"), b=second, text=F.col("text")))
    return complete(asked, "__p", "passage", model).select("doc", "a", "b", "c", "passage")


def self_questions(docs: DataFrame, model: Callable[[], LanguageModel], n: int = 3) -> DataFrame:
    """(hash, doc_id, question, answer): questions a model asks of each text and answers, one row per question text."""
    asked = complete(docs.withColumn("__p", W.fill(W.SELF_QUESTIONS, n=F.lit(n), text=F.col("text"))), "__p", "__r", model)
    each = asked.select("doc_id", "text", F.explode(P.question_lines(F.coalesce("__r", F.lit("")))).alias("question")).where("question <> ''")
    replied = complete(each.withColumn("__p", W.fill(W.SELF_ANSWER, text=F.col("text"), question=F.col("question"))), "__p", "__r", model)
    pairs = replied.withColumn("__qa", P.question_answer(F.col("__r"))).withColumn("answer", F.coalesce("__qa.answer", "__r"))
    keyed = pairs.withColumn("hash", P.content_hash(F.col("question")))
    return keyed.groupBy("hash").agg(F.max_by(F.struct("doc_id", "question", "answer"), "doc_id").alias("r")).select("hash", "r.*")


SUMMARY = "summary string, entities array<string>"


def entities_and_summaries(docs: DataFrame, model: Callable[[], LanguageModel], *, tries: int = 5) -> DataFrame:
    """(doc, summary, names): what a model reads in each text; a document whose replies can't be read has null for both.

    A reply without entities is asked for again, up to ``tries`` times.
    """
    asked = docs.select(F.col("doc_id").alias("doc"), W.fill(W.ENTITY_SUMMARY, text=F.col("text")).alias("__p"))

    def usable(reply: str) -> bool:
        import json

        return bool(json.loads(reply[reply.find("{") : reply.rfind("}") + 1]).get("entities"))

    replied = complete(asked, "__p", "__r", lambda: Checked(model(), usable), batch=1, tries=tries, wait=0.0)
    found = F.from_json(P.json_slice(F.col("__r")), SUMMARY)
    return replied.select("doc", found.alias("x")).select("doc", "x.summary", F.array_distinct("x.entities").alias("names"))


def training_corpus(summaries: DataFrame, passages: DataFrame, *, most: int | None = None, seed: int = 42) -> DataFrame:
    """(text): summaries and relation passages; of more than ``most`` a seeded sample with a tenth more."""
    rows = summaries.select(F.col("summary").alias("text")).unionByName(passages.select(F.col("passage").alias("text"))).where("text IS NOT NULL")
    return rows if most is None else I.capped(rows, "text", most, 1.1, seed)


def conditional_tasks(contexts: DataFrame, model: Callable[[], LanguageModel], *, code: str, context: str = "context") -> DataFrame:
    """``contexts`` with a task that a model makes of each context: ``task_input``, ``task_output``.

    ``code`` is one of ``prompts.TASKS``. Contexts whose reply holds no output are left out.
    """
    asked = contexts.withColumn("__p", R.task_input(F.lit(R.TASKS[code]), F.col(context)))
    made = complete(asked, "__p", "__r", model).withColumn("__t", R.task_output(F.col("__r")))
    made = made.withColumn("task_input", R.with_context(F.col("__t.input"), F.col(context))).withColumn("task_output", F.col("__t.output"))
    return I.filled(made.drop("__p", "__r", "__r_error", "__t"))
