"""Combinations of contexts, filters of judged questions, samples and unions of datasets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecraft.functions import parse as P


def combinations(ranked: DataFrame, size: int, cap: int | None = None) -> DataFrame:
    """(query, combo, ids): combinations of ``size`` of a query's ranked items (query, rank, id, content).

    In the order of ranks; combinations with equal contents are skipped, and a set of
    items that an earlier query or combination has is used up. ``cap`` keeps the first ones
    in the order of (query, combo).
    """
    out = ranked.select("query", F.array(F.col("rank")).alias("ranks"), F.array("id").alias("ids"), F.array("content").alias("contents"))
    for _ in range(size - 1):
        step = ranked.select("query", F.col("rank").alias("r"), F.col("id").alias("i"), F.col("content").alias("c"))
        out = out.join(step, "query").where(F.col("r") > F.element_at("ranks", -1)).select(
            "query", F.concat("ranks", F.array("r")).alias("ranks"), F.concat("ids", F.array("i")).alias("ids"), F.concat("contents", F.array("c")).alias("contents")
        )
    numbered = out.withColumn("combo", F.row_number().over(Window.partitionBy("query").orderBy("ranks")) - 1)
    distinct = numbered.where(F.size(F.array_distinct("contents")) == F.size("contents"))
    first = distinct.groupBy(F.array_sort("ids").alias("key")).agg(F.min(F.struct("query", "combo", "ids")).alias("f")).select("f.*")
    return first if cap is None else first.orderBy("query", "combo").limit(cap)


def confident(confidences: Column, threshold: int) -> Column:
    """All confidences reach the threshold; none at all is not enough."""
    return (F.size(confidences) > 0) & F.forall(confidences, lambda x: x >= threshold)


def relevant(relevance: Column, wanted: str) -> Column:
    """The relevance is the wanted one, or unknown."""
    return relevance.isNull() | (F.lower(relevance) == wanted.lower())


def judged(files: DataFrame, *, name: str = "file_name", text: str = "body", threshold: int = 0, keep: int = 3000, wanted: str = "yes") -> DataFrame:
    """(file_name, total, top, relevance, rank): the ``keep`` best files and every one rated Yes.

    Files count if all confidences reach the threshold and the relevance is as wanted or
    unknown; they are ranked by the sum of confidences, the greatest, and the name. Files
    rated Yes stay whatever their confidences, with no rank.
    """
    c = P.confidences(F.col(text))
    rows = files.select(F.col(name).alias("file_name"), c.alias("c"), P.relevance(F.col(text)).alias("relevance"))
    rows = rows.withColumn("total", F.aggregate("c", F.lit(0), lambda s, x: s + x)).withColumn("top", F.array_max("c"))
    best = rows.where(confident(F.col("c"), threshold) & relevant(F.col("relevance"), wanted)).orderBy(F.desc("total"), F.desc("top"), "file_name").limit(keep)
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total"), F.desc("top"), "file_name")))
    yes = rows.where(F.lower("relevance") == "yes").join(best.select("file_name"), "file_name", "left_anti").withColumn("rank", F.lit(None).cast("int"))
    columns = ["file_name", "total", "top", "relevance", "rank"]
    return ranked.select(*columns).unionByName(yes.select(*columns))


def relevance_counts(files: DataFrame, text: str = "body") -> DataFrame:
    r = F.lower(P.relevance(F.col(text)))
    return files.agg(F.count_if(r == "yes").alias("yes"), F.count_if(r == "no").alias("no"), F.count_if(r.isNull()).alias("unknown"))


def quality_report(records: DataFrame, fields: list[str], kind: str) -> DataFrame:
    """(measure, n): rows, rows where each field isn't empty, and rows of each kind."""
    filled = [F.struct(F.lit(f"field:{f}").alias("measure"), F.count_if(F.length(F.trim(F.col(f).cast("string"))) > 0).alias("n")) for f in fields]
    total = F.struct(F.lit("rows").alias("measure"), F.count(F.lit(1)).alias("n"))
    counts = records.agg(F.array(total, *filled).alias("m")).select(F.explode("m").alias("m")).select("m.*")
    kinds = records.groupBy(F.concat(F.lit("type:"), F.coalesce(F.col(kind), F.lit("unknown"))).alias("measure")).agg(F.count(F.lit(1)).alias("n"))
    return counts.unionByName(kinds)


def remaining(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't done yet."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def first_of_equal(docs: DataFrame, *, id: str, text: str, prefix: str = "") -> DataFrame:
    """(id, hash): the first document of each text."""
    return docs.groupBy(P.content_hash(F.col(text), prefix).alias("hash")).agg(F.min(id).alias(id)).select(id, "hash")


def entity_pairs(entities: DataFrame, *, seed: int | None = None, per_doc: int | None = None) -> DataFrame:
    """(doc, a, b): unordered pairs of a document's entities (doc, names), or a seeded sample of each document's."""
    items = entities.select("doc", F.posexplode("names").alias("i", "a"))
    other = entities.select("doc", F.posexplode("names").alias("j", "b"))
    pairs = items.join(other, "doc").where("i < j").select("doc", "a", "b")
    if per_doc is None:
        return pairs
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("doc").cast("string"), "a", "b").cast("binary"))
    return pairs.withColumn("n", F.row_number().over(Window.partitionBy("doc").orderBy(order, "a", "b"))).where(F.col("n") <= per_doc).drop("n")


def hash_order(seed: int | str, *key: Column | str) -> Column:
    """A seeded order that every engine with MD5 gives."""
    parts = [F.col(k).cast("string") if isinstance(k, str) else k.cast("string") for k in key]
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *parts).cast("binary"))


def sample_per_group(rows: DataFrame, group: str, key: str, most: int, seed: int = 42) -> DataFrame:
    """At most ``most`` rows of each group, by a seeded order."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(group).orderBy(hash_order(seed, key), key))).where(F.col("__n") <= most).drop("__n")


def split(rows: DataFrame, key: str, percent: int, seed: int = 42) -> DataFrame:
    """``rows`` with ``is_test`` for about ``percent`` of a hundred keys."""
    return rows.withColumn("is_test", F.conv(F.substring(hash_order(seed, key), 1, 6), 16, 10).cast("bigint") % 100 < percent)


def numbered_shards(rows: DataFrame, *order: str, size: int = 10_000) -> DataFrame:
    """``rows`` with the number of the shard of ``size`` rows that each falls into."""
    from lorecraft.operators.graph import dense_ids

    return dense_ids(rows, *order, name="__id").withColumn("shard", F.floor(F.col("__id") / size)).drop("__id")


def union_renamed(parts: list[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """All rows that have every wanted field; each part maps its fields to the wanted names."""
    frames = [df.select(*[F.col(a).alias(b) for a, b in names.items()]).dropna() for df, names in parts]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def best_attempt(attempts: DataFrame, key: str, value: str, score: str) -> DataFrame:
    """The value of the best-scored attempt of each key."""
    return attempts.groupBy(key).agg(F.max_by(value, score).alias(value), F.max(score).alias(score))


def completeness(entities: DataFrame) -> DataFrame:
    """(complete): the share of entities with a known type and a description."""
    whole = (F.coalesce("type", F.lit("")) != "") & (F.col("type") != "UNKNOWN") & (F.length(F.coalesce("description", F.lit(""))) > 0)
    return entities.agg(F.avg(whole.cast("double")).alias("complete"))


def repaired(type_: Column, description: Column, name: Column, allowed: list[str], ask: Callable[[Column], Column] | None = None) -> Column:
    """(type, description) with defaults: a type that isn't allowed is UNKNOWN, a missing description a stock sentence."""
    described = F.coalesce(F.nullif(description, F.lit("")), ask(name) if ask else F.concat(F.lit("An entity named "), name, F.lit(".")))
    return F.struct(F.when(type_.isin(allowed), type_).otherwise("UNKNOWN").alias("type"), described.alias("description"))


def with_templates(examples: DataFrame, dimension: DataFrame) -> DataFrame:
    """Examples with the templates of their dataset; a template without a configuration serves all of them."""
    d = dimension.select(F.col("dataset_name").alias("__d"), F.col("dataset_config_name").alias("__c"), "template_name", "task_type")
    return examples.join(d, (F.col("dataset") == F.col("__d")) & (F.col("__c").isNull() | F.col("__c").eqNullSafe(F.col("dataset_config")))).drop("__d", "__c")


def one_template(examples: DataFrame, key: str, names: list[str], seed: int = 42) -> DataFrame:
    """``examples`` with one of the template names, by a seeded hash of the key."""
    at = F.conv(F.substring(hash_order(seed, key), 1, 8), 16, 10).cast("bigint") % len(names)
    return examples.withColumn("template_name", F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int")))


def groups_of_names(replies: DataFrame, entities: DataFrame) -> DataFrame:
    """(group, id): entities of the name lists that a model grouped; unknown names drop out, of equal names the last entity counts.

    ``replies`` is (reply) of JSON lists of lists of names; what can't be read is no group.
    """
    lists = replies.select(F.monotonically_increasing_id().alias("r"), F.from_json(P.json_slice(F.col("reply")), "array<array<string>>").alias("g")).where("g IS NOT NULL")
    names = lists.select("r", F.posexplode("g").alias("k", "n")).select(F.concat_ws("-", F.col("r").cast("string"), F.col("k").cast("string")).alias("group"), F.explode("n").alias("name"))
    known = entities.groupBy("name").agg(F.max("id").alias("id"))
    return names.join(known, "name").select("group", "id").distinct()


def distinct_counts(records: DataFrame, question: str = "question", context: str = "context") -> DataFrame:
    """(questions, contexts): distinct ones; contexts count by their first hundred characters."""
    start = F.concat(F.substring(F.col(context), 1, 100), F.lit("..."))
    return records.agg(F.count_distinct(F.col(question)).alias("questions"), F.count_distinct(start).alias("contexts"))


def capped(rows: DataFrame, key: str, cap: int, factor: float = 1.0, seed: int = 42) -> DataFrame:
    """A seeded sample of at most ``cap * factor`` rows."""
    return rows.orderBy(hash_order(seed, key), key).limit(int(cap * factor))


def masked_template(text: str, context: str) -> str:
    """A template with its context expression replaced by a place to copy it to, and the target after the pipe marker."""
    from lorecraft.functions.prompts import PIPE

    if context not in text:
        raise ValueError("the template doesn't hold its context")
    return text.replace(context, "{{copy_context}}").replace("|||", PIPE)


def as_context(rows: DataFrame, column: str, name: str = "context") -> DataFrame:
    """(name): the texts of a column, stripped; blank ones are left out."""
    from lorecraft.functions.text import stripped

    return rows.select(stripped(F.col(column)).alias(name)).where(F.length(name) > 0)


def filled(rows: DataFrame, column: str = "task_output") -> DataFrame:
    """Rows whose column isn't empty."""
    return rows.where(F.length(F.col(column)) > 0)


def with_problems(samples: DataFrame, problems: DataFrame, key: str = "task_id") -> DataFrame:
    """Samples with the columns of their problem; a sample of an unknown problem is an error when it is read."""
    known = problems.withColumn("__known", F.lit(True))
    joined = samples.join(known, key, "left")
    told = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("no problem "), F.col(key).cast("string"))).cast("boolean")).otherwise(F.col("__known"))
    return joined.withColumn("__known", told).where("__known").drop("__known")


def synthetic_records(rows: DataFrame) -> DataFrame:
    """(question, answer, context) of made tasks (input, output)."""
    from lorecraft.functions.text import task_context, task_question

    text = F.coalesce("input", F.lit(""))
    return rows.select(task_question(text).alias("question"), F.coalesce("output", F.lit("")).alias("answer"), task_context(text).alias("context"))


def batches(rows: DataFrame, *order: str, size: int) -> DataFrame:
    """``rows`` with the number of the batch of ``size`` rows that each is in, in the given order."""
    return numbered_shards(rows, *order, size=size).withColumnRenamed("shard", "batch")


def head(rows: DataFrame, *order: str, start: int = 0, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` (without it) in the given order."""
    ordered = rows.orderBy(*order).limit(stop)
    if not start:
        return ordered
    return ordered.withColumn("__at", F.row_number().over(Window.orderBy(*order))).where(F.col("__at") > start).drop("__at")


def results_of_samples(samples: DataFrame, results: DataFrame, *, key: str = "task_id", order: str = "sample_id") -> DataFrame:
    """Samples with the results (key, completion_id, ...) of their task in the order in which they were given in."""
    place = F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1
    return samples.withColumn("completion_id", place.cast("bigint")).join(results, [key, "completion_id"])
