"""Entity graphs as two tables: merging extractions, ids, neighbourhoods."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecraft.session import ensure_checkpoint_dir, release


def dense_ids(rows: DataFrame, *order: Column | str, name: str = "id") -> DataFrame:
    """``rows`` with ids from 0 without gaps in the given order, without a window over all rows.

    Rows are dealt by range, numbered within their range, and moved on by the rows of
    the ranges before. ``order`` must tell all rows apart.
    """
    ensure_checkpoint_dir(rows.sparkSession)
    placed = rows.repartitionByRange(*order).withColumn("__range", F.spark_partition_id()).checkpoint()
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("__range").agg(F.count(F.lit(1)).alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    return placed.withColumn("__at", within).join(starts, "__range").withColumn(name, (F.col("__start") + F.col("__at") - 1).cast("bigint")).drop("__range", "__at", "__start")


def merge_entities(entities: DataFrame, *, as_set: bool = False) -> DataFrame:
    """One row per name of (name, type, description, doc, pos): its type and all its descriptions.

    The type is the most frequent one that isn't empty, ties the first in the alphabet;
    descriptions come in the order of (doc, pos), or as a sorted set.
    """
    votes = entities.where("type IS NOT NULL AND type <> ''").groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"))
    kind = votes.groupBy("name").agg(F.min(F.struct((-F.col("n")).alias("n"), "type")).alias("t")).select("name", F.col("t.type").alias("type"))
    described = F.col("description").isNotNull() & (F.col("description") != "")
    items = F.collect_list(F.when(described, F.struct("doc", "pos", "description")))
    listed = F.array_sort(F.collect_set(F.when(described, F.col("description")))) if as_set else F.transform(F.array_sort(items), lambda x: x["description"])
    rows = entities.groupBy("name").agg(listed.alias("descriptions"), F.min(F.struct("doc", "pos")).alias("first"))
    return rows.join(kind, "name", "left").select("name", F.coalesce("type", F.lit("")).alias("type"), "descriptions", F.col("first.doc").alias("first_doc"), F.col("first.pos").alias("first_pos"))


def merge_relations(relations: DataFrame) -> DataFrame:
    """One row per undirected pair of (source, target, description, doc, pos): descriptions in order."""
    ends = relations.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("doc", "pos", "description"))), lambda x: x["description"])
    return ends.groupBy("a", "b").agg(listed.alias("descriptions"), F.count(F.lit(1)).alias("n")).select(F.col("a").alias("source"), F.col("b").alias("target"), "descriptions", "n")


def with_endpoints(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities and, with an empty type and no descriptions, endpoints of relations that are none yet."""
    ends = relations.select(F.col("source").alias("name")).unionByName(relations.select(F.col("target").alias("name"))).distinct()
    missing = ends.join(entities, "name", "left_anti")
    rest = {f.name: f.dataType for f in entities.schema if f.name != "name"}
    blank = [(F.lit("") if n == "type" else F.array().cast(t) if n == "descriptions" else F.lit(None)).cast(t).alias(n) for n, t in rest.items()]
    return entities.unionByName(missing.select("name", *blank).select(*entities.columns))


def resolve_ids(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """Relations with ids of entities in place of names; unknown names drop out."""
    ids = entities.select("id", "name")
    a = ids.select(F.col("id").alias("source_id"), F.col("name").alias("source"))
    b = ids.select(F.col("id").alias("target_id"), F.col("name").alias("target"))
    out = relations.join(a, "source").join(b, "target").drop("source", "target")
    return out.withColumnRenamed("source_id", "source").withColumnRenamed("target_id", "target")


def last_edges(relations: DataFrame) -> DataFrame:
    """Of parallel edges the one with the greatest id."""
    keyed = relations.withColumn("a", F.least("source", "target")).withColumn("b", F.greatest("source", "target"))
    return keyed.groupBy("a", "b").agg(F.max_by(F.struct(*relations.columns), "id").alias("e")).select("e.*")


def consolidate(descriptions: Column, summary: Callable[[Column], Column]) -> Column:
    """None: null; one: itself; more: ``summary`` of all, an empty line between them."""
    return F.when(F.size(descriptions) == 0, F.lit(None)).when(F.size(descriptions) == 1, descriptions[0]).otherwise(summary(F.array_join(descriptions, "\n\n")))


def neighbours(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """(a, b) in both directions, without loops and repeats."""
    e = edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a <> b")
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def hops(edges: DataFrame, start: DataFrame, n: int, *, source: str = "source", target: str = "target") -> DataFrame:
    """(root, id, hop): vertices within ``n`` hops of each root, at their least hop. ``start`` is (root).

    Roots that no edge has find nothing.
    """
    ensure_checkpoint_dir(edges.sparkSession)
    near = neighbours(edges, source, target).checkpoint()
    known = start.join(near.select(F.col("a").alias("root")).distinct(), "root", "left_semi").distinct()
    found = known.select("root", F.col("root").alias("id"), F.lit(0).alias("hop"))
    front = found
    for hop in range(1, n + 1):
        step = front.join(near, front["id"] == near["a"]).select("root", F.col("b").alias("id")).distinct()
        front = step.join(found, ["root", "id"], "left_anti").select("root", "id", F.lit(hop).alias("hop")).checkpoint()
        found = found.unionByName(front)
    return found


def induced(edges: DataFrame, vertices: DataFrame, *, source: str = "source", target: str = "target") -> DataFrame:
    """Edges with both ends among ``vertices`` (id)."""
    a, b = vertices.select(F.col("id").alias(source)), vertices.select(F.col("id").alias(target))
    return edges.join(a.distinct(), source, "left_semi").join(b.distinct(), target, "left_semi")


def with_relation_ends(seeds: DataFrame, relations: DataFrame) -> DataFrame:
    """Seeds (id) and the ends of the given relations."""
    return reduce(DataFrame.unionByName, [seeds.select("id"), relations.select(F.col("source").alias("id")), relations.select(F.col("target").alias("id"))]).distinct()


def refine(groups: DataFrame, steps: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """(group, id) through steps that split groups; only groups with more than one member go on."""
    several = lambda g: g.join(g.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("group"), "group")
    return reduce(lambda g, step: several(step(g)), steps, several(groups))


#: Members of a group, about, whose lists of aliases one key of a join makes.
PART = 256


def aliases(groups: DataFrame, shown: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """(id, alias): the other members of each member's group, sorted by id, each as ``shown``.

    The lists of a group are as long as it has members and as many, so its members are dealt to parts that each meet the list of
    the group: a group that holds most rows is many tasks. ``shown`` must keep ids apart; it is applied once a group. The lists are
    the square of what their ids' files let Spark expect, so neither side is sent whole through the driver: both are sorted by their parts.
    """
    parts = F.ceil(F.count(F.lit(1)) / PART).cast("int")
    listed = groups.groupBy("group").agg(F.transform(F.array_sort(F.collect_set("id")), shown).alias("all"), parts.alias("parts"))
    dealt = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number of its own isn't lowered to what few bytes need
    key = lambda part: F.struct("group", part.cast("int").alias("part")).alias("key")  # noqa: E731 - one column, also where all are of one group
    members = groups.join(listed.select("group", "parts"), "group").select(key(F.pmod(F.xxhash64("id"), "parts")), "id")
    lists = listed.select("group", "all", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(key(F.col("part")), "all")
    met = members.repartition(dealt, "key").join(lists.hint("merge"), "key")
    return met.select("id", F.array_remove("all", shown(F.col("id"))).alias("alias"))


def expand_aliases(ids: DataFrame, alias: DataFrame) -> DataFrame:
    """Ids and their aliases."""
    more = ids.join(alias, "id").select(F.explode("alias").alias("id"))
    return ids.select("id").unionByName(more).distinct()


def shortest_path(edges: DataFrame, start: int, goal: int) -> list[int]:
    """Vertices of a path of least total weight from ``start`` to ``goal``, both included; empty without one.

    ``edges`` is (source, target, weight), read in both directions. Distances are relaxed
    in rounds until none gets shorter; ties go to the smaller vertex before. Weights aren't negative,
    so vertices farther than the goal go no further.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.min("weight").alias("weight")).checkpoint()
    known = spark.createDataFrame([(start, 0.0, None)], "id bigint, distance double, before bigint")
    front, most = known, float("inf")
    for round_ in count(1):
        step = front.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id"), (F.col("distance") + F.col("weight")).alias("distance"), F.col("a").alias("before")).where(F.col("distance") <= most)
        least = step.groupBy("id").agg(F.min(F.struct("distance", "before")).alias("n")).select("id", "n.distance", "n.before")
        old = known.select("id", F.col("distance").alias("had"))
        front = least.join(old, "id", "left").where("had IS NULL OR distance < had").drop("had").checkpoint()
        seen = front.agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("id") == goal, F.col("distance"))).alias("distance")).first()
        if not seen["n"]:
            break
        most = most if seen["distance"] is None else seen["distance"]
        known = known.join(front.select("id"), "id", "left_anti").unionByName(front).checkpoint()
        if round_ % 3 == 0:
            release(spark)
    path: list[int] = []
    at: int | None = goal
    while at is not None:  # as many steps as the path has
        row = known.where(F.col("id") == at).first()
        if row is None:
            return []
        path.append(at)
        at = row["before"]
    return path[::-1]


def widest_path(edges: DataFrame, start: int, goal: int) -> float | None:
    """The greatest least weight on a path between two vertices; None without a path.

    ``edges`` is (source, target, weight), read in both directions. Widths are relaxed in
    rounds; vertices that can't make the goal's width greater go no further.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.col("source").alias("a"), F.col("target").alias("b"), "weight").where("a <> b")
    both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")).groupBy("a", "b").agg(F.max("weight").alias("weight")).checkpoint()
    known = front = spark.createDataFrame([(start, float("inf"))], "id bigint, width double")
    best = None
    for round_ in count(1):
        step = front.join(both, F.col("id") == F.col("a")).select(F.col("b").alias("id"), F.least("width", "weight").alias("width"))
        step = step if best is None else step.where(F.col("width") > best)
        old = known.select("id", F.col("width").alias("had"))
        front = step.groupBy("id").agg(F.max("width").alias("width")).join(old, "id", "left").where("had IS NULL OR width > had").drop("had").checkpoint()
        seen = front.agg(F.count(F.lit(1)).alias("n"), F.max(F.when(F.col("id") == goal, F.col("width"))).alias("width")).first()
        best = best if seen["width"] is None else seen["width"]
        if not seen["n"]:
            return best
        known = known.join(front.select("id"), "id", "left_anti").unionByName(front).checkpoint()
        if round_ % 3 == 0:
            release(spark)


def best_average_path(edges: DataFrame, start: int, goal: int, *, precision: float = 0.1) -> tuple[float, list[int]]:
    """A weight level and the inner vertices of a path between two vertices, over edges at or above it.

    The level is halved in on between 0 and 1, to ``precision``, as the greatest at which
    the two are connected: that is up to the width of their widest path, which is found once for all levels. (-1, none)
    where not even the least level tried connects them.
    """
    edges = edges.where("source <> target").checkpoint()
    width = None if start == goal else widest_path(edges, start, goal)
    low, high, best = 0.0, 1.0, -1.0
    while high - low > precision:
        middle = (low + high) / 2
        if width is not None and width >= middle:
            low = best = middle
        else:
            high = middle
    return best, shortest_path(edges.where(F.col("weight") >= best), start, goal)[1:-1] if best >= 0 else []


def bridged(edges: DataFrame, vertices: DataFrame, *, precision: float = 0.1) -> DataFrame:
    """``vertices`` (id) and those that connect the components they make, each pair by its best path.

    Components of the induced subgraph count as one vertex each; a path may lead through any
    other vertex. Meant for the few components of one query's subgraph.
    """
    from lorecraft.operators.components import connected_components

    ensure_checkpoint_dir(edges.sparkSession)
    ids = vertices.select("id").distinct().checkpoint()
    parts = ids.join(connected_components(induced(edges, ids), "source", "target"), "id", "left").select("id", F.coalesce("component", "id").alias("c")).checkpoint()
    of = lambda end: parts.select(F.col("id").alias(end), F.col("c").alias(f"{end}_c"))
    whole = edges.join(of("source"), "source", "left").join(of("target"), "target", "left")
    whole = whole.select(F.coalesce("source_c", "source").alias("source"), F.coalesce("target_c", "target").alias("target"), "weight").checkpoint()
    heads = sorted(r["c"] for r in parts.select("c").distinct().collect())
    between = {v for i, a in enumerate(heads) for b in heads[i + 1 :] for v in best_average_path(whole, a, b, precision=precision)[1]}
    more = edges.sparkSession.createDataFrame([(v,) for v in sorted(between - set(heads))], "id bigint")
    return ids.unionByName(more).distinct()


def unmerged(entities: DataFrame) -> DataFrame:
    """Merged entities (name, type, descriptions, first_doc, first_pos) as rows to be merged again with later ones."""
    rows = entities.select("name", "type", F.posexplode_outer("descriptions").alias("at", "description"), F.col("first_doc").alias("doc"), F.col("first_pos").alias("pos"))
    return rows.select("name", "type", "description", "doc", "pos")


def endpoint_names(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """``relations`` with the names of their ends in place of ids (``source``, ``target``)."""
    name = lambda end: entities.select(F.col("id").alias(end), F.col("name").alias(f"{end}_name"))
    rest = [c for c in relations.columns if c not in {"source", "target"}]
    return relations.join(name("source"), "source").join(name("target"), "target").select(*rest, F.col("source_name").alias("source"), F.col("target_name").alias("target"))
