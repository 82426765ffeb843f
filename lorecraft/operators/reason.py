"""Reasoning along the relations of an entity graph, a beam of steps at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecraft.functions import parse as P
from lorecraft.functions import prompt_texts as W
from lorecraft.functions.models import EmbeddingModel, LanguageModel, complete_once, embed
from lorecraft.session import ensure_checkpoint_dir

#: Rows (query, question, entity, relation), each once, to (query, entity, relation, score).
Scorer = Callable[[DataFrame], DataFrame]
#: Rows (query, question, relation, score, names), the sorted entities that a query's relation leads to, to (query, scored), arrays of (next, score).
EntityScorer = Callable[[DataFrame], DataFrame]


def explore(front: DataFrame, edges: DataFrame, score: Callable[..., Column], width: int) -> DataFrame:
    """(query, entity, relation, next, score): the best ``width`` relations of each query's frontier (query, entity).

    ``edges`` is (source, target, relation, weight), read in both directions; ties go by
    relation, entity and neighbour.
    """
    both = edges.select(F.col("source").alias("entity"), F.col("target").alias("next"), "relation", "weight").unionByName(
        edges.select(F.col("target").alias("entity"), F.col("source").alias("next"), "relation", "weight")
    )
    found = front.join(both, "entity").withColumn("score", score("query", "relation", "weight"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "relation", "entity", "next")
    return found.withColumn("n", F.row_number().over(order)).where(F.col("n") <= width).drop("n")


def triplets(steps: DataFrame) -> DataFrame:
    """(query, line): each relation of a step with each entity it led to."""
    rel = steps.select("query", "depth", "entity", "relation").distinct()
    nxt = steps.select("query", "depth", "next").distinct()
    return rel.join(nxt, ["query", "depth"]).select("query", "depth", F.concat(F.lit("("), "entity", F.lit(", "), "relation", F.lit(", "), "next", F.lit(")")).alias("line"))


def reason(
    seeds: DataFrame,
    edges: DataFrame,
    *,
    depth: int = 3,
    width: int = 3,
    score: Callable[..., Column] = lambda query, relation, weight: F.col(weight).cast("double"),
    enough: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """(query, depth, entity, relation, next, score): the steps from each query's seeds (query, entity).

    Entities that a query has visited are not gone to again. ``enough`` may return the
    queries (query) whose steps so far suffice; they stop.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    front, visited, steps = seeds.select("query", "entity"), seeds.select("query", "entity"), None
    for level in range(1, depth + 1):
        step = explore(front, edges, score, width).withColumn("depth", F.lit(level)).checkpoint()
        steps = step if steps is None else steps.unionByName(step)
        if level == depth:
            break
        reached = step.select("query", F.col("next").alias("entity")).distinct()
        front = reached.join(visited, ["query", "entity"], "left_anti")
        if enough is not None:
            front = front.join(enough(steps), "query", "left_anti")
        front = front.checkpoint()
        visited = visited.unionByName(front)
    return steps.select("query", "depth", "entity", "relation", "next", "score")


def says_yes(reply: Column) -> Column:
    """A judge's reply that the knowledge suffices."""
    return F.contains(F.lower(reply), F.lit("{yes}"))


def known_candidates(names: Column, unknown: str = "UnName_Entity") -> Column:
    """Names without the placeholder, which stays where it is the only one."""
    return F.when((F.size(names) == 1), names).otherwise(F.filter(names, lambda x: x != unknown))


def answer_prompts(questions: DataFrame, lines: DataFrame) -> DataFrame:
    """(query, prompt): a prompt with the facts that were found for a question, or for the model alone without any.

    ``questions`` is (query, question), ``lines`` (query, line) as ``triplets`` gives them.
    """
    facts = lines.groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("facts"))
    prompt = F.coalesce(F.when(F.col("facts").isNotNull(), W.fill(W.REASON_WITH, question=F.col("question"), facts=F.col("facts"))), W.fill(W.REASON_ALONE, question=F.col("question")))
    return questions.join(facts, "query", "left").select("query", prompt.alias("prompt"))


def by_model(model: Callable[[], LanguageModel], **options) -> Scorer:
    """A language model chooses among the relations of an entity and scores them; what it names beside them takes a place and leads nowhere."""

    def score(rows: DataFrame) -> DataFrame:
        listed = rows.groupBy("query", "question", "entity").agg(F.array_join(F.array_sort(F.collect_set("relation")), "; ").alias("relations"))
        prompt = W.fill(W.RELATIONS, question=F.col("question"), entity=F.col("entity"), relations=F.col("relations"))
        replied = complete_once(listed.withColumn("__prompt", prompt), "__prompt", "__reply", model, **options)
        return replied.select("query", "entity", F.explode(P.relation_scores(F.col("__reply"))).alias("r")).select("query", "entity", "r.relation", "r.score").dropDuplicates(["query", "entity", "relation"])

    return score


def _best(scored: DataFrame, width: int) -> DataFrame:
    """The best ``width`` of each entity; where all of those are zero they share 1."""
    order = Window.partitionBy("query", "entity").orderBy(F.desc("score"), "relation")
    best = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= width)
    lists = best.groupBy("query", "entity").agg(F.array_sort(F.collect_list(F.struct("n", "relation", "score"))).alias("l"))
    shared = lists.withColumn("s", P.shared_scores(F.transform("l", lambda x: x["score"])))
    return shared.select("query", "entity", F.explode(F.arrays_zip(F.transform("l", lambda x: x["relation"]).alias("relation"), F.col("s").alias("score"))).alias("r")).select("query", "entity", F.col("r.relation").alias("relation"), F.col("r.score").alias("score"))


def by_bm25(width: int = 3, *, k1: float = 1.5, b: float = 0.75, epsilon: float = 0.25) -> Scorer:
    """Okapi BM25 of the question over the relations of each entity, words between single spaces; a word that most of them have counts ``epsilon`` of the mean."""

    def score(rows: DataFrame) -> DataFrame:
        texts = rows.select("entity", "relation").distinct().withColumn("w", F.split("relation", " "))
        corpus = texts.groupBy("entity").agg(F.count(F.lit(1)).alias("docs"), F.avg(F.size("w")).alias("mean"))
        tf = texts.select("entity", "relation", F.size("w").alias("n"), F.explode("w").alias("word")).groupBy("entity", "relation", "n", "word").agg(F.count(F.lit(1)).alias("tf"))
        df = tf.groupBy("entity", "word").agg(F.count(F.lit(1)).alias("df")).join(corpus, "entity")
        df = df.withColumn("raw", F.log(F.col("docs") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = df.groupBy("entity").agg(F.avg("raw").alias("mean_idf"))
        idf = df.join(mean, "entity").select("entity", "word", "mean", F.when(F.col("raw") < 0, epsilon * F.col("mean_idf")).otherwise(F.col("raw")).alias("idf"))
        asked = rows.select("query", "question", "entity").distinct().select("query", "entity", F.explode(F.split("question", " ")).alias("word")).groupBy("query", "entity", "word").agg(F.count(F.lit(1)).alias("times"))
        part = F.col("times") * F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("n") / F.col("mean")))
        met = asked.join(tf.join(idf, ["entity", "word"]), ["entity", "word"]).groupBy("query", "entity", "relation").agg(F.sum(part).alias("score"))
        every = rows.select("query", "entity", "relation").join(met, ["query", "entity", "relation"], "left")
        return _best(every.withColumn("score", F.round(F.coalesce("score", F.lit(0.0)), 9)), width)

    return score


def by_embedding(embedding: Callable[[], EmbeddingModel], width: int = 3) -> Scorer:
    """The dot product of the question's and each relation's vector; a text is embedded once."""

    def score(rows: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(rows.sparkSession)
        texts = rows.select(F.explode(F.array("question", "relation")).alias("t")).distinct()
        known = embed(texts, "t", "v", embedding).select("t", "v").checkpoint()
        q, r = known.select(F.col("t").alias("question"), F.col("v").alias("q")), known.select(F.col("t").alias("relation"), F.col("v").alias("r"))
        dot = F.aggregate(F.zip_with("q", "r", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        return _best(rows.join(q, "question").join(r, "relation").select("query", "entity", "relation", F.round(dot, 9).alias("score")), width)

    return score


def entities_by_model(model: Callable[[], LanguageModel], **options) -> EntityScorer:
    """A model's shares of a relation's score for the entities that it leads to."""

    def score(rows: DataFrame) -> DataFrame:
        listed = rows.withColumn("names", known_candidates(F.col("names"))).checkpoint()  # read for the prompts and for the replies
        prompt = W.fill(W.ENTITIES, question=F.col("question"), relation=F.col("relation"), entities=F.array_join("names", "; "))
        several = F.size("names") > 1  # one alone has all of the score
        replied = complete_once(listed.where(several).withColumn("__prompt", prompt), "__prompt", "__reply", model, **options)
        shares = P.scores(F.coalesce("__reply", F.lit("")), F.size("names"))
        scored = lambda s: F.zip_with("names", s, lambda x, y: F.struct(x.alias("next"), F.round(F.col("score") * y, 9).alias("score"))).alias("scored")
        return replied.select("query", scored(shares)).unionByName(listed.where(~several).select("query", scored(F.array(F.lit(1.0)))))

    return score


def reason_with(
    questions: DataFrame,
    seeds: DataFrame,
    edges: DataFrame,
    scorer: Scorer,
    *,
    depth: int = 3,
    width: int = 3,
    entity_scorer: EntityScorer | None = None,
    judge: Callable[[], LanguageModel] | None = None,
    **options,
) -> DataFrame:
    """(query, depth, entity, relation, next, score): steps of queries that a model, BM25 or vectors guide; each query stops on its own.

    ``questions`` is (query, question), ``seeds`` (query, entity), ``edges`` (source, target, relation), read in both directions. In a step the
    ``scorer`` ranks the relations of a query's entities and the best ``width`` are taken; the entities that these lead to, by
    ``entity_scorer`` or in the order of their names, are the next ``width``. A query ends where nothing is found, or when the ``judge`` says
    that its facts so far suffice. Every model call of a step is one job over all queries, and each distinct prompt is sent once.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    questions = questions.checkpoint()
    forth, back = edges.select("source", "target", "relation"), edges.select(F.col("target").alias("source"), F.col("source").alias("target"), "relation")
    both = forth.unionByName(back).groupBy(F.col("source").alias("entity"), "relation")
    lists = both.agg(F.array_sort(F.collect_set("target")).alias("names")).checkpoint()  # what an entity's relation leads to moves as one list
    front, steps = seeds.select("query", "entity").distinct(), None
    for level in range(1, depth + 1):
        here = front.join(questions, "query").join(lists.select("entity", "relation"), "entity").select("query", "question", "entity", "relation")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "relation", "entity")
        chosen = scorer(here).withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= width).drop("__n").checkpoint()
        reached = chosen.join(lists, ["entity", "relation"])
        # a query's best entities are among the best of each list
        if entity_scorer is None:
            found, first = reached.select("query", F.explode(F.slice("names", 1, width)).alias("next")).distinct(), [F.col("next")]
        else:
            some = reached.groupBy("query", "relation").agg(F.max("score").alias("score"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("names")))).alias("names"))
            scored = entity_scorer(some.join(questions, "query").select("query", "question", "relation", "score", "names"))
            ranked = F.array_sort(F.transform("scored", lambda x: F.struct(F.coalesce(-x["score"], F.lit(float("inf"))).alias("n"), x["next"].alias("next"), x["score"].alias("score"))))
            pairs = scored.select("query", F.explode(F.slice(ranked, 1, width)).alias("p")).select("query", "p.next", "p.score")
            found, first = pairs.groupBy("query", "next").agg(F.max("score").alias("score")), [F.desc("score"), F.col("next")]
        best = found.withColumn("__n", F.row_number().over(Window.partitionBy("query").orderBy(*first))).where(F.col("__n") <= width).select("query", "next")
        step = chosen.join(best, "query").select("query", F.lit(level).alias("depth"), "entity", "relation", "next", "score").checkpoint()
        steps = step if steps is None else steps.unionByName(step)
        if level == depth:
            break
        front = step.select("query", F.col("next").alias("entity")).distinct()
        if judge is not None:
            facts = triplets(steps.join(front.select("query").distinct(), "query", "left_semi")).groupBy("query").agg(F.array_join(F.array_sort(F.collect_set("line")), "\n").alias("facts"))
            asked = facts.join(questions, "query").select("query", W.fill(W.ENOUGH, question=F.col("question"), facts=F.col("facts")).alias("__prompt"))
            done = complete_once(asked, "__prompt", "__reply", judge, **options).where(says_yes(F.coalesce("__reply", F.lit("")))).select("query")
            front = front.join(done, "query", "left_anti")
        front = front.checkpoint()
    return steps


def answer_by_reasoning(questions: DataFrame, steps: DataFrame, model: Callable[[], LanguageModel], **options) -> DataFrame:
    """(query, answer): answers from the facts of the steps, or from the model alone where there are none."""
    asked = answer_prompts(questions, triplets(steps).select("query", "line"))
    return complete_once(asked, "prompt", "answer", model, **options).select("query", "answer")
