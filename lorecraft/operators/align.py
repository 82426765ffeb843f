"""Steps of ``graph.refine``: groups of entities that may mean the same thing, split by type or by a model."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorecraft.functions import parse as P
from lorecraft.functions import prompt_texts as W
from lorecraft.functions.clients import Checked
from lorecraft.functions.models import LanguageModel, complete_once
from lorecraft.operators.components import connected_components
from lorecraft.operators.graph import dense_ids
from lorecraft.session import ensure_checkpoint_dir

Step = Callable[[DataFrame], DataFrame]


def by_type(entities: DataFrame) -> Step:
    """Members (group, id) of the same type stay together; those without one leave."""

    def step(groups: DataFrame) -> DataFrame:
        typed = groups.join(entities.select("id", "type").where("type IS NOT NULL AND type <> ''"), "id")
        least = typed.groupBy("group", "type").agg(F.min("id").alias("first"))
        return typed.join(least, ["group", "type"]).select(F.col("first").alias("group"), "id")

    return step


def _lists(reply: str) -> bool:
    """Whether a reply holds a JSON list of lists."""
    try:  # commas before an end are forgiven, as ``parse.json_slice`` does
        found = json.loads(re.sub(r",(\s*\])", r"\1", reply[reply.find("[") : reply.rfind("]") + 1]))
    except ValueError:
        return False
    return isinstance(found, list) and all(isinstance(x, list) for x in found)


def by_model(entities: DataFrame, model: Callable[[], LanguageModel], *, most: int = 50, overlap: int = 10, tries: int = 5, **options) -> Step:
    """Members (group, id) that a model says mean the same thing.

    A group is listed by name, in prompts of at most ``most`` entities (id, name, description), each beginning with the last ``overlap`` of the one before. What replies
    say is united: sets that share a member are one. A reply that is no list of lists is asked for again, ``tries`` times in all; without one, and for
    names that no reply groups, members leave.
    """
    if not 0 <= overlap < most:
        raise ValueError("prompts must go on")
    pace = most - overlap

    def step(groups: DataFrame) -> DataFrame:
        ensure_checkpoint_dir(groups.sparkSession)
        named = groups.join(entities.select("id", "name", "description"), "id").select("group", "id", F.coalesce("name", F.lit("")).alias("name"), "description")
        rows = dense_ids(named, "group", "name", "id", name="__line").checkpoint()
        starts = rows.groupBy("group").agg(F.min("__line").alias("__start"))
        rows = rows.join(starts, "group").withColumn("at", F.col("__line") - F.col("__start"))
        # the prompts that a place is in: from the first that still reaches it to the last that begins before it
        last = F.floor(F.col("at") / pace)
        first = F.greatest(F.lit(0), F.ceil((F.col("at") - most + 1) / pace))
        placed = rows.withColumn("part", F.explode(F.sequence(first, last))).checkpoint()
        entry = F.concat_ws(": ", "name", "description")
        parts = placed.groupBy("group", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", entry.alias("e")))), lambda x: x["e"]), "\n").alias("names"), F.count(F.lit(1)).alias("n"), F.max("at").alias("top")).where("n > 1")
        parts = parts.where((F.col("part") == 0) | (F.col("top") >= F.col("part") * pace + overlap))  # others bring nothing new
        asked = parts.withColumn("__prompt", W.fill(W.ALIGN, names=F.col("names")))
        replied = complete_once(asked, "__prompt", "__reply", lambda: Checked(model(), _lists), batch=1, tries=tries, **options)
        sets = replied.select("group", "part", F.posexplode(F.from_json(P.json_slice(F.col("__reply")), "array<array<string>>")).alias("set", "names"))
        members = sets.select("group", "part", "set", F.explode("names").alias("name")).distinct()
        met = members.join(placed.groupBy("group", "part", "name").agg(F.min("id").alias("id")), ["group", "part", "name"])
        head = met.groupBy("group", "part", "set").agg(F.min("id").alias("a"))
        links = met.join(head, ["group", "part", "set"]).where("a < id").select("a", F.col("id").alias("b")).distinct().checkpoint()
        return connected_components(links, "a", "b").select(F.col("component").alias("group"), "id")

    return step
