"""Records out of model replies and logs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

GRAPH = T.StructType(
    [
        T.StructField("entities", T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("name", "type", "description")]))),
        T.StructField("relations", T.ArrayType(T.StructType([T.StructField(f, T.StringType()) for f in ("source", "target", "description")]))),
    ]
)
#: Lines between the records of an interaction log.
RULE = "=" * 80

#: The heads of numbered questions and answers in a reply.
QUESTION_HEAD, ANSWER_HEAD = r"\*\*\*Question ([0-9]{1,18})\*\*\*:?", r"\*\*\*Answer [0-9]{1,18}\*\*\*:?"


def json_slice(reply: Column) -> Column:
    """The outermost object or list of a reply, without fences and trailing commas; null without one."""
    bare = F.regexp_replace(F.coalesce(reply, F.lit("")), r"```[a-zA-Z]*", "")
    cut = F.nullif(F.regexp_extract(bare, r"(?s)(\{.*\}|\[.*\])", 1), F.lit(""))
    return F.regexp_replace(cut, r",([ \t\n\r]*[}\]])", "$1")


def graph_of(reply: Column) -> Column:
    """Entities and relations of an extraction reply; empty lists where it can't be read."""
    options = {"allowComments": "true", "mode": "PERMISSIVE"}
    g = F.from_json(json_slice(reply), GRAPH, options)
    empty = lambda f: F.array().cast(GRAPH[f].dataType)
    return F.struct(F.coalesce(g["entities"], empty("entities")).alias("entities"), F.coalesce(g["relations"], empty("relations")).alias("relations"))


def relation_scores(reply: Column) -> Column:
    """Relations with scores, ``{name (Score: 0.6)}``, as (relation, score); several relations in one are none."""
    found = F.regexp_extract_all(reply, F.lit(r"(\{[^{}]*\(Score: [0-9.]+\)\})"), 1)
    rows = F.transform(
        found,
        lambda x: F.struct(F.trim(F.regexp_extract(x, r"\{([^{}]*?)\(Score:", 1)).alias("relation"), F.regexp_extract(x, r"\(Score: ([0-9.]+)\)", 1).cast("double").alias("score")),
    )
    return F.filter(rows, lambda r: ~F.contains(r["relation"], F.lit(";")))


def scores(reply: Column, candidates: Column) -> Column:
    """Decimal numbers of a reply; equal shares if there aren't as many as ``candidates``."""
    found = F.transform(F.regexp_extract_all(reply, F.lit(r"([0-9]+\.[0-9]+)"), 1), lambda x: x.cast("double"))
    return F.when(F.size(found) == candidates, found).otherwise(F.array_repeat(F.lit(1.0) / candidates, candidates))


def shared_scores(values: Column) -> Column:
    """Scores, or equal shares where all are zero."""
    return F.when(F.forall(values, lambda x: x == 0), F.array_repeat(F.lit(1.0) / F.size(values), F.size(values))).otherwise(values)


def confidences(text: Column) -> Column:
    """The whole percentages of ``Confidence (...): n%``, in order."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)confidence \([^)]*\): ([0-9]+)%"), 1), lambda x: x.cast("int"))


def relevance(text: Column) -> Column:
    """Yes or No after the relevance marker, as written; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?i)\*\*relevance\*\*[ \t\n\r]*:?[ \t\n\r]*(yes|no)", 1), F.lit(""))


def answer_yes_no(text: Column) -> Column:
    """Yes or No of a line ``Answer:``; null without one."""
    return F.nullif(F.regexp_extract(text, r"(?im)^(?:\*\*)?answer:(?:\*\*)?[ \t]*(yes|no)", 1), F.lit(""))


def question_answer(text: Column) -> Column:
    """(question, answer) of the text's first block; null fields without both labels. The question isn't trimmed."""
    block = F.split(text, "\n[ \t]*\n")[0]
    both = (F.instr(block, "Question: ") > 0) & (F.instr(block, "Answer: ") > 0)
    q = F.substring_index(F.substring_index(block, "Question: ", -1), "Answer: ", 1)
    return F.struct(F.when(both, q).alias("question"), F.when(both, F.trim(F.substring_index(block, "Answer: ", -1))).alias("answer"))


def question_lines(text: Column) -> Column:
    """What follows ``Question:`` in each line that has it, trimmed."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.contains(x, F.lit("Question:")))
    return F.transform(lines, lambda x: F.trim(F.substring_index(x, "Question:", -1)))


def numbered_questions(text: Column) -> Column:
    """(n, question, answer) of each block headed ``***Question n***:``, in order, trimmed.

    What follows ``***Answer n***:`` in a block is its answer, null without one. A null text has no blocks;
    text before the first head belongs to none.
    """
    given = F.coalesce(text, F.lit(""))
    numbers = F.regexp_extract_all(given, F.lit(QUESTION_HEAD), 1)
    bodies = F.split(given, QUESTION_HEAD)
    edges = F.lit(" \t\r\n")

    def block(n: Column, i: Column) -> Column:
        halves = F.split(F.get(bodies, i + 1), ANSWER_HEAD, 2)
        return F.struct(n.cast("bigint").alias("n"), F.btrim(halves[0], edges).alias("question"), F.btrim(F.get(halves, F.lit(1)), edges).alias("answer"))

    return F.transform(numbers, block)


def log_record(block: Column) -> Column:
    """(id, type, question, answer) of one block of an interaction log; a refusal is an empty answer."""
    field = lambda name: F.trim(F.regexp_extract(block, rf"(?m)^{name}: (.*)$", 1))
    answer = F.trim(F.regexp_extract(block, r"(?s)\nAnswer: (.*)$", 1))
    return F.struct(
        F.nullif(field("Id"), F.lit("")).alias("id"),
        field("Type").alias("type"),
        field("Question").alias("question"),
        F.when(answer.isin("None", "null", "I CANNOT ANSWER"), "").otherwise(answer).alias("answer"),
    )


def content_hash(text: Column, prefix: str = "") -> Column:
    """``prefix`` and the MD5 of the text; a null text counts as empty."""
    return F.concat(F.lit(prefix), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
