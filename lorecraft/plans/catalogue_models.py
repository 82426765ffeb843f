"""Queries of what a model guides: reasoning along relations, answers in two stages, groups of names. The models are scripts, so SQL gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorecraft.functions.clients import Scripted
from lorecraft.functions.models import HashEmbedding
from lorecraft.operators import align as A
from lorecraft.operators import graph as G
from lorecraft.operators import reason as Z
from lorecraft.plans import answer as N
from lorecraft.plans import build as B
from lorecraft.plans.catalogue import BEAM, COMPONENTS, NEAR, VECTORS, _pairs, _relations, _vectors, query
from lorecraft.operators.components import connected_components


def choose(prompt: str) -> str:
    """Scores relations by their last digit and the length of the entity's name."""
    entity = prompt.rsplit("Entity: ", 1)[1].split("\n")[0]
    relations = prompt.rsplit("Relations: ", 1)[1].split("; ")
    return " ".join(f"{{{r} (Score: 0.{(int(r[-1]) * 3 + len(entity)) % 10})}}" for r in relations)


def share(prompt: str) -> str:
    """Scores entities by the length of their names."""
    names = prompt.rsplit("Entities: ", 1)[1].split("\n")[0].split("; ")
    return ", ".join(f"0.{len(n) % 7 + 1}" for n in names)


def suffices(prompt: str) -> str:
    """Five facts are enough."""
    return "{Yes}" if len(prompt.rsplit("Facts:\n", 1)[1].split("\n")) >= 5 else "{No}"


def conclude(prompt: str) -> str:
    return prompt.rsplit("Facts:\n", 1)[1].split("\n")[0] if "Facts:\n" in prompt else "unknown"


def _questions(seeds: DataFrame) -> DataFrame:
    return seeds.select("query", F.concat(F.lit("Who is "), "query", F.lit(" with with-3 ?")).alias("question")).distinct()


def _hops(n: int, relation: str, entity: str | None) -> str:
    """CTEs of ``n`` steps of three relations by the score ``relation``, and of three entities by ``entity`` or by name."""
    parts = []
    for k in range(1, n + 1):
        parts.append(f"""c{k} AS (SELECT query, entity, relation, {relation} AS score FROM (SELECT DISTINCT query, entity, relation FROM f{k} JOIN rel USING (entity))),
b{k} AS (SELECT * FROM c{k} QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, relation, entity) <= 3),
e{k} AS (SELECT DISTINCT query, relation, max(score) OVER (PARTITION BY query, relation) AS score, next FROM b{k} JOIN rel USING (entity, relation)),
w{k} AS (SELECT query, next, max(score * share) AS s FROM (SELECT *, {entity or '1.0'} AS share FROM (SELECT *, count(*) OVER (PARTITION BY query, relation) AS names FROM e{k})) GROUP BY query, next),
n{k} AS (SELECT query, next FROM w{k} QUALIFY row_number() OVER (PARTITION BY query ORDER BY {'round(s, 9) DESC, ' if entity else ''}next) <= 3),
s{k} AS (SELECT query, {k} AS depth, entity, relation, next, score FROM b{k} JOIN n{k} USING (query)),
l{k} AS (SELECT DISTINCT query, depth, '(' || r.entity || ', ' || r.relation || ', ' || t.next || ')' AS line FROM (SELECT DISTINCT query, depth, entity, relation FROM s{k}) r JOIN (SELECT DISTINCT query, depth, next FROM s{k}) t USING (query, depth)),
f{k + 1} AS (SELECT query, next AS entity FROM n{k} WHERE query NOT IN (SELECT query FROM ({' UNION '.join(f'SELECT query, line FROM l{j}' for j in range(1, k + 1))}) GROUP BY query HAVING count(*) >= 5))""")
    return ",\n".join(parts)


REASONED = f"""{BEAM}, f1 AS (SELECT * FROM seeds),
{_hops(3, "(right(relation, 1)::INTEGER * 3 + length(entity)) % 10 / 10.0::DOUBLE", "CASE WHEN names = 1 THEN 1.0 ELSE (length(next) % 7 + 1) / 10.0::DOUBLE END")}"""


def _steps(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    seeds, edges = _relations(spark, sf_dir)
    asked = _questions(seeds)
    model = lambda rule: lambda: Scripted(rule)
    return asked, Z.reason_with(asked, seeds, edges, Z.by_model(model(choose)), entity_scorer=Z.entities_by_model(model(share)), judge=model(suffices))


@query(f"WITH {REASONED} SELECT query, depth, entity, relation, next, round(score, 6) AS score FROM s1 UNION ALL SELECT query, depth, entity, relation, next, round(score, 6) FROM s2 UNION ALL SELECT query, depth, entity, relation, next, round(score, 6) FROM s3")
def model_reasoning(spark, sf_dir):
    """Three steps that a model chooses, scores and ends."""
    return _steps(spark, sf_dir)[1].withColumn("score", F.round("score", 6))


@query(f"""WITH {REASONED}, facts AS (SELECT query, line FROM l1 UNION SELECT query, line FROM l2 UNION SELECT query, line FROM l3)
SELECT query, coalesce(min(line), 'unknown') AS answer FROM seeds LEFT JOIN facts USING (query) GROUP BY query""")
def reasoned_answers(spark, sf_dir):
    """What a model answers from the facts of the steps."""
    asked, steps = _steps(spark, sf_dir)
    return Z.answer_by_reasoning(asked, steps, lambda: Scripted(conclude))


@query(f"""WITH {BEAM}, t AS (SELECT DISTINCT entity, relation FROM rel), w AS (SELECT DISTINCT entity, relation, relation AS word FROM t),
n AS (SELECT entity, count(*) AS docs FROM t GROUP BY entity), raw AS (SELECT entity, word, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM w JOIN n USING (entity) GROUP BY entity, word, docs),
idf AS (SELECT entity, word, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER (PARTITION BY entity) ELSE raw END AS idf FROM raw),
scored AS (SELECT t.entity, t.relation, round(CASE WHEN relation = 'with-3' THEN idf * 2.5 / 2.5 ELSE 0 END, 9) AS score FROM t JOIN idf ON idf.entity = t.entity AND word = relation),
best AS (SELECT *, row_number() OVER (PARTITION BY entity ORDER BY score DESC, relation) AS r FROM scored QUALIFY r <= 3),
shared AS (SELECT entity, relation, CASE WHEN count(*) FILTER (score <> 0) OVER (PARTITION BY entity) = 0 THEN 1.0 / count(*) OVER (PARTITION BY entity) ELSE score END AS score FROM best)
SELECT entity AS query, entity, relation, round(score, 6) AS score FROM shared""")
def bm25_relations(spark, sf_dir):
    """The relations of each entity that its question's words rank first."""
    seeds, edges = _relations(spark, sf_dir)
    both = edges.select(F.col("source").alias("entity"), "relation").unionByName(edges.select(F.col("target").alias("entity"), "relation")).distinct()
    rows = seeds.join(_questions(seeds), "query").join(both, "entity").select("query", "question", "entity", "relation")
    return Z.by_bm25()(rows).withColumn("score", F.round("score", 6))


@query()
def embedded_relations(spark, sf_dir):
    """The same by vectors of words."""
    seeds, edges = _relations(spark, sf_dir)
    both = edges.select(F.col("source").alias("entity"), "relation").unionByName(edges.select(F.col("target").alias("entity"), "relation")).distinct()
    rows = seeds.join(_questions(seeds), "query").join(both, "entity").select("query", "question", "entity", "relation")
    return Z.by_embedding(HashEmbedding)(rows).withColumn("score", F.round("score", 6))


def reply(prompt: str) -> str:
    """Two in four questions aren't answered from texts alone; else the first text is the answer."""
    number = int(prompt.rsplit("Question: q", 1)[1].split("\n")[0])
    if number % 40 == 0 and "=====Relationships=====" not in prompt:
        return "Sorry. I CANNOT ANSWER that."
    return prompt.split("=====Sources=====\n", 1)[1].split("\n")[0]


@query(f"""WITH {VECTORS}, q AS (SELECT vec_id AS query, v FROM vec WHERE vec_id % 20 = 0), u AS (SELECT vec_id AS id, v, 'unit ' || vec_id AS content, list_distinct([vec_id % 97, vec_id * 3 % 61]) AS es FROM vec WHERE vec_id % 20 <> 0),
ent AS (SELECT DISTINCT vec_id % 97 AS id FROM vec), alias AS (SELECT id, (id + 1) % 97 AS other FROM ent WHERE id % 5 = 0),
d AS (SELECT query, id, content, row_number() OVER (PARTITION BY query ORDER BY list_cosine_similarity(q.v, u.v) DESC, id) AS rank, list_cosine_similarity(q.v, u.v) AS s FROM q CROSS JOIN u),
one AS (SELECT query, '=====Sources=====' || chr(10) || string_agg(content, chr(10) ORDER BY rank) AS context, CASE WHEN query % 40 = 0 THEN NULL ELSE first(content ORDER BY rank) END AS answer FROM d WHERE rank <= 3 GROUP BY query),
named AS (SELECT id AS unit, unnest(es) AS id FROM u), n AS (SELECT id, count(*) AS n FROM named GROUP BY id), seeds AS (SELECT id FROM n WHERE n >= (SELECT avg(n) FROM n)),
r AS (SELECT vec_id AS rid, vec_id % 97 AS source, vec_id * 7 % 97 AS target, v, 'r' || vec_id AS description FROM vec WHERE vec_id % 9 = 0),
refused AS (SELECT * FROM q WHERE query % 40 = 0), close AS (SELECT query, source, target FROM refused JOIN r ON list_cosine_similarity(refused.v, r.v) >= {NEAR}),
vert AS (SELECT query, id FROM refused CROSS JOIN seeds UNION SELECT query, source FROM close UNION SELECT query, target FROM close),
wide AS (SELECT * FROM vert UNION SELECT query, other FROM vert JOIN alias USING (id)),
cand AS (SELECT DISTINCT query, unit FROM wide JOIN named USING (id)),
top AS (SELECT d.query, content, row_number() OVER (PARTITION BY d.query ORDER BY round(s, 9) DESC, d.id) AS rank FROM d JOIN cand ON cand.query = d.query AND cand.unit = d.id QUALIFY rank <= 5),
se AS (SELECT query, string_agg('e' || id || ': about ' || id, chr(10) ORDER BY 'e' || id || ': about ' || id) AS t FROM vert JOIN ent USING (id) GROUP BY query),
sr AS (SELECT a.query, string_agg(source || ' -> ' || target || ': ' || description, chr(10) ORDER BY source || ' -> ' || target || ': ' || description) AS t FROM r JOIN vert a ON a.id = source JOIN vert b ON b.id = target AND a.query = b.query GROUP BY a.query),
st AS (SELECT query, string_agg(content, chr(10) ORDER BY rank) AS t, first(content ORDER BY rank) AS answer FROM top GROUP BY query)
SELECT query, md5(context) AS context, answer, 1 AS step FROM one WHERE answer IS NOT NULL
UNION ALL SELECT query, md5('=====Entities=====' || chr(10) || coalesce(se.t, '') || chr(10) || '=====Relationships=====' || chr(10) || coalesce(sr.t, '') || chr(10) || '=====Sources=====' || chr(10) || st.t), st.answer, 2 FROM st LEFT JOIN se USING (query) LEFT JOIN sr USING (query)""")
def two_stage_answers(spark, sf_dir):
    """From questions and a graph to answers; the questions that the nearest texts leave open go through the graph."""
    v, i = _vectors(spark, sf_dir).select("vec_id", "embedding"), F.col("vec_id")
    s = lambda c: c.cast("string")
    asked = v.where("vec_id % 20 = 0").select(i.alias("query"), F.concat(F.lit("q"), s(i)).alias("question"), "embedding")
    units = v.where("vec_id % 20 <> 0").select(i.alias("id"), F.concat(F.lit("unit "), s(i)).alias("content"), "embedding", F.array_distinct(F.array(i % 97, i * 3 % 61)).alias("entities"))
    e = v.select((i % 97).alias("id")).distinct()
    alias = F.when(F.col("id") % 5 == 0, F.array((F.col("id") + 1) % 97)).otherwise(F.array().cast("array<bigint>"))
    entities = e.select("id", F.concat(F.lit("e"), s(F.col("id"))).alias("name"), F.concat(F.lit("about "), s(F.col("id"))).alias("description"), alias.alias("alias"))
    relations = v.where("vec_id % 9 = 0").select(i.alias("id"), (i % 97).alias("source"), (i * 7 % 97).alias("target"), F.concat(F.lit("r"), s(i)).alias("description"), "embedding")
    found = N.answer(asked, B.Graph(entities, relations, units), lambda: Scripted(reply), similar=NEAR)
    return found.select("query", F.md5(F.col("context").cast("binary")).alias("context"), "answer", "step")


def group(prompt: str) -> str:
    """Names whose descriptions are equal."""
    import json

    found: dict[str, list[str]] = {}
    for line in prompt.split("\n")[1:]:
        name, kind = line.split(": ")
        found.setdefault(kind, []).append(name)
    return f"Groups: {json.dumps(list(found.values()))}"


@query(f"""WITH RECURSIVE {COMPONENTS},
several AS (SELECT id, component FROM comps WHERE component IN (SELECT component FROM comps GROUP BY component HAVING count(*) > 1)),
typed AS (SELECT id, min(id) OVER (PARTITION BY component, id % 2) AS grp, count(*) OVER (PARTITION BY component, id % 2) AS n FROM several),
placed AS (SELECT id, grp, row_number() OVER (PARTITION BY grp ORDER BY 'n' || id, id) - 1 AS place FROM typed WHERE n > 1),
parted AS (SELECT *, unnest(range(greatest(0, ceil((place - 5) / 4.0))::BIGINT, place // 4 + 1)) AS part FROM placed),
sets AS (SELECT a.id AS a, b.id AS b FROM parted a JOIN parted b ON a.grp = b.grp AND a.part = b.part AND a.id % 3 = b.id % 3 AND a.id <> b.id),
same(id, other) AS (SELECT a, a FROM sets UNION SELECT s.id, n.b FROM same s JOIN sets n ON s.other = n.a)
SELECT id, min(other) AS "group" FROM same GROUP BY id""")
def refined_groups(spark, sf_dir):
    """Components of near entities, split by type, then by a model that sees six names at a time."""
    i = F.col("vec_id")
    entities = _vectors(spark, sf_dir).select(i.alias("id"), (i % 2).cast("string").alias("type"), F.concat(F.lit("n"), i.cast("string")).alias("name"), (i % 3).cast("string").alias("description"))
    groups = connected_components(_pairs(spark, sf_dir), "a", "b").select(F.col("component").alias("group"), "id")
    return G.refine(groups, [A.by_type(entities), A.by_model(entities, lambda: Scripted(group), most=6, overlap=2)]).select("id", "group")
