import json

import pytest
from pyspark.sql import functions as F

from lorecraft.functions import prompt_texts as W
from lorecraft.functions.models import HashEmbedding
from lorecraft.operators import instruct as I
from lorecraft.plans.build import build, extract
from lorecraft.plans.generate import answers, contexts, pair_texts, questions, self_questions
from lorecraft.sources import io


def reader():
    """A stand-in that reads capitalised words and answers the prompts of the plans."""
    import json as j
    import re

    class Reader:
        def complete(self, prompts):
            return [self.one(p) for p in prompts]

        def one(self, p):
            if p.startswith("List the entities"):
                names = list(dict.fromkeys(re.findall(r"\b[A-Z][a-z]{4,}\b", p.split("Text:\n")[1])))
                pairs = [{"source": a, "target": b, "description": f"{a} with {b}"} for a, b in zip(names, names[1:])]
                return "```json\n" + j.dumps({"entities": [{"name": n, "type": "PERSON", "description": f"about {n.lower()[:4]}"} for n in names], "relations": pairs}) + "\n```"
            if p.startswith("Several"):
                return p.split("\n", 1)[1].split("\n\n")[0]
            if p.startswith("Do the two"):
                return "**Relevance** Yes"
            if p.startswith("Write 2 questions"):
                return "1. Question: who?\n2. Question: where?"
            if p.startswith("Read the text"):
                return "Question: x Answer: there"
            return "reply " + str(len(p))

    return Reader()


TEXTS = ["Alice met Robert in town. They spoke with Maria. Nothing else happened there.", "Robert knows Maria well. Roberta knows Alice.", "tiny", None, "Maria and Alice left together. Then Robert came."]


def docs(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")


def test_build_and_generate(spark):
    graph = build(docs(spark), reader, HashEmbedding)
    entities = {r["name"]: r for r in graph.entities.collect()}
    assert set(entities) >= {"Alice", "Robert", "Maria", "Roberta"}
    assert sorted(r["id"] for r in entities.values()) == list(range(len(entities)))
    assert entities["Roberta"]["id"] in entities["Robert"]["alias"] and entities["Robert"]["id"] in entities["Roberta"]["alias"]
    ids = {r["id"] for r in entities.values()}
    assert all(r["source"] in ids and r["target"] in ids and r["description"] for r in graph.relations.collect())
    units = graph.units.collect()
    assert {u["doc"] for u in units} == {0, 1, 4} and all(u["entities"] for u in units)
    combos = contexts(graph, threshold=0.0)
    rows = questions(combos, reader)
    got = rows.collect()
    assert got and all(r["relevance"] == "Yes" and r["question"].startswith("reply") and len(r["sources"]) == 2 for r in got)
    keys = [tuple(sorted(r["ids"])) for r in got]
    assert len(keys) == len(set(keys))
    done = rows.limit(1).select("file_name", F.lit("known").alias("answer"))
    replies = {r["file_name"]: r["answer"] for r in answers(rows, done, reader).collect()}
    assert len(replies) == len(got) and list(replies.values()).count("known") == 1


def test_statuses(spark):
    def broken():
        class Broken:
            def complete(self, prompts):
                raise OSError("down")

        return Broken()

    from lorecraft.plans.build import BuildOptions

    status = lambda model: [r["status"] for r in extract(docs(spark), model, BuildOptions(tries=1))[2].orderBy("doc_id").collect()]
    assert status(reader) == ["read", "read", "blank", "blank", "read"]
    assert status(broken) == ["failed", "failed", "blank", "blank", "failed"]


def test_simpler_generators(spark):
    named = spark.createDataFrame([(0, ["Alice", "Maria", "Robert"])], "doc long, names array<string>")
    pairs = pair_texts(docs(spark), named, reader, target=10).collect()
    assert len(pairs) == 2 and all(p["passage"] and p["c"] is None for p in pairs)
    assert [(p["a"], p["b"], p["c"]) for p in pair_texts(docs(spark), named, reader, target=1, triples=True).collect()] == [("Alice", "Maria", "Robert")]
    qa = sorted((r["question"], r["answer"]) for r in self_questions(docs(spark).where("doc_id < 2"), reader, 2).collect())
    assert qa == [("where?", "there"), ("who?", "there")]


def test_prompts_keep_other_braces(one):
    assert one(W.fill("a {x} {Yes}", x=F.lit("1"))) == "a 1 {Yes}"


def test_templates_and_groups(spark, one):
    examples = spark.createDataFrame([(0, "d", "c1"), (1, "d", None), (2, "e", None)], "id long, dataset string, dataset_config string")
    dimension = spark.createDataFrame([("d", "c1", "t1", "qa"), ("d", None, "t2", "nli")], "dataset_name string, dataset_config_name string, template_name string, task_type string")
    got = sorted((r["id"], r["template_name"]) for r in I.with_templates(examples, dimension).collect())
    assert got == [(0, "t1"), (0, "t2"), (1, "t2")]
    assert {r["template_name"] for r in I.one_template(spark.range(50), "id", ["a", "b"]).collect()} == {"a", "b"}
    entities = spark.createDataFrame([(0, "A"), (1, "B"), (2, "A")], "id long, name string")
    replies = spark.createDataFrame([('[["A", "B", "Z"]]',), ("nothing",)], "reply string")
    assert sorted(r["id"] for r in I.groups_of_names(replies, entities).collect()) == [1, 2]
    rows = spark.createDataFrame([("q", "x" * 150), ("q", "x" * 160), ("p", "y")], "question string, context string")
    assert tuple(I.distinct_counts(rows).first()) == (2, 2)
    assert I.capped(spark.range(50), "id", 10, 1.2).count() == 12
    assert I.masked_template("{{text}} why ||| {{a}}", "{{text}}") == "{{copy_context}} why <|pipe|> {{a}}"


def test_array_file(spark, tmp_path):
    io.write_array(spark.range(3), str(tmp_path / "a"))
    text = "".join(p.read_text() for p in (tmp_path / "a").glob("part-*"))
    assert json.loads(text) == [{"id": 0}, {"id": 1}, {"id": 2}]


class Flaky:
    """Replies with no list at first."""

    calls = 0

    def complete(self, prompts):
        Flaky.calls += 1
        return ["no list" if Flaky.calls < 3 else 'Sure: [["a", "b", "ghost"], ["c"], ["d", "a"],]' for _ in prompts]


def test_groups_by_a_model(spark):
    from lorecraft.functions.clients import Scripted
    from lorecraft.operators import align as A
    from lorecraft.operators import graph as G

    entities = spark.createDataFrame([(i, n, t, None) for i, (n, t) in enumerate([("a", "T"), ("b", "T"), ("c", "T"), ("d", "T"), ("e", ""), ("f", None)])], "id long, name string, type string, description string")
    groups = spark.createDataFrame([(0, i) for i in range(6)], "group long, id long")
    steps = [A.by_type(entities), A.by_model(entities, Flaky, tries=5, wait=0.0)]
    assert sorted(tuple(r) for r in G.refine(groups, steps).select("group", "id").collect()) == [(0, 0), (0, 1), (0, 3)]
    never = A.by_model(entities, lambda: Scripted(lambda p: "none"), tries=2, wait=0.0)
    assert G.refine(groups, [never]).count() == 0 and G.refine(groups.limit(0), [never]).count() == 0
    with pytest.raises(ValueError):
        A.by_model(entities, Flaky, most=5, overlap=5)


def test_long_groups_are_united(spark):
    """A chain of pairs across prompts of three names is one group."""
    import json

    from lorecraft.functions.clients import Scripted
    from lorecraft.operators import align as A

    n = 20
    entities = spark.createDataFrame([(i, f"n{i:02}", "T", None) for i in range(n)], "id long, name string, type string, description string")
    groups = spark.createDataFrame([(0, i) for i in range(n)], "group long, id long")
    seen = lambda p: json.dumps([p.split("\n")[1:]])
    out = A.by_model(entities, lambda: Scripted(seen), most=3, overlap=1)(groups).collect()
    assert sorted((r["group"], r["id"]) for r in out) == [(0, i) for i in range(n)]


def test_reasoning_stops_by_query(spark):
    from lorecraft.functions.clients import Scripted
    from lorecraft.operators import reason as Z

    edges = spark.createDataFrame([("a", "b", "r1"), ("b", "c", "r2"), ("c", "d", "r3"), ("x", "y", "r1"), ("y", "z", "r2")], "source string, target string, relation string")
    asked = spark.createDataFrame([("q1", "about a"), ("q2", "stop early"), ("q3", "lost")], "query string, question string")
    seeds = spark.createDataFrame([("q1", "a"), ("q2", "x"), ("q3", "nowhere")], "query string, entity string")

    def rule(prompt):
        if "Relations: " in prompt:
            return " ".join(f"{{{r} (Score: 0.5)}}" for r in prompt.rsplit("Relations: ", 1)[1].split("; ")) + " {ghost (Score: 0.9)}"
        return "{Yes}" if "stop" in prompt else "{No}"

    steps = Z.reason_with(asked, seeds, edges, Z.by_model(lambda: Scripted(rule)), width=3, judge=lambda: Scripted(rule))
    depth = {r["query"]: r["d"] for r in steps.groupBy("query").agg(F.max("depth").alias("d")).collect()}
    assert depth == {"q1": 3, "q2": 1}
    assert [r["relation"] for r in steps.where("query = 'q2'").orderBy("relation").collect()] == ["ghost", "r1"]
    got = {r["query"]: r["answer"] for r in Z.answer_by_reasoning(asked, steps, lambda: Scripted(lambda p: "facts" if "Facts:" in p else "alone")).collect()}
    assert got == {"q1": "facts", "q2": "facts", "q3": "alone"}
    ranked = Z.by_bm25(2)(spark.createDataFrame([("q", "big cat", "e", r) for r in ("big dog", "small cat x", "a b", "c d", "e f")], "query string, question string, entity string, relation string"))
    assert [r["relation"] for r in ranked.orderBy(F.desc("score")).collect()] == ["big dog", "small cat x"]
    nothing = Z.by_bm25(2)(spark.createDataFrame([("q", "none", "e", r) for r in ("u", "v", "w")], "query string, question string, entity string, relation string"))
    assert [(r["relation"], r["score"]) for r in nothing.orderBy("relation").collect()] == [("u", 0.5), ("v", 0.5)]


def test_answers_in_two_stages_with_made_vectors(spark):
    from lorecraft.functions.clients import Scripted
    from lorecraft.functions.models import HashEmbedding
    from lorecraft.plans import answer as N
    from lorecraft.plans.build import Graph

    units = spark.createDataFrame([("u1", "red fox runs", [0]), ("u2", "blue whale swims", [1]), ("u3", "green frog jumps", [1, 2])], "id string, content string, entities array<long>")
    entities = spark.createDataFrame([(0, "fox", "an animal", []), (1, "whale", "large", [2]), (2, "frog", "small", [])], "id long, name string, description string, alias array<long>")
    relations = spark.createDataFrame([(0, 1, "fox sees whale"), (1, 2, "red fox runs")], "source long, target long, description string")
    asked = spark.createDataFrame([(1, "red fox runs"), (2, "green frog jumps")], "query long, question string")
    rule = lambda p: "I CANNOT ANSWER" if "Question: green" in p and "Relationships" not in p else "fine"
    got = {r["query"]: r for r in N.answer(asked, Graph(entities, relations, units), lambda: Scripted(rule), HashEmbedding, first=1, top_k=2, similar=0.9).collect()}
    assert (got[1]["step"], got[1]["context"]) == (1, "=====Sources=====\nred fox runs")
    assert got[2]["step"] == 2 and got[2]["context"].startswith("=====Entities=====\nwhale: large") and "green frog jumps" in got[2]["context"]
    bare = N.answer(asked, Graph(entities, relations, units), lambda: Scripted(lambda p: "ok"), HashEmbedding, with_graph=False)
    assert {r["step"] for r in bare.collect()} == {1}


def test_questions_with_the_same_entities_share_their_lines(spark, monkeypatch):
    """Every question met every relation among its entities again; what no question shares is still its own."""
    from lorecraft.functions.clients import Scripted
    from lorecraft.plans import answer as N
    from lorecraft.plans.build import Graph

    units = spark.createDataFrame([(0, "a", [0], [1.0, 0.0]), (1, "b", [0, 1], [0.0, 1.0]), (2, "c", [2], [0.6, 0.8])], "id long, content string, entities array<long>, embedding array<double>")
    entities = spark.createDataFrame([(k, f"e{k}", "x", []) for k in range(3)], "id long, name string, description string, alias array<long>")
    relations = spark.createDataFrame([(0, 0, 0, "loop", [0.0, -1.0]), (1, 0, 2, "far", [-1.0, 0.0])], "id long, source long, target long, description string, embedding array<double>")
    asked = spark.createDataFrame([(1, "p", [1.0, 0.0]), (2, "q", [1.0, 0.0]), (3, "r", [-1.0, 0.0])], "query long, question string, embedding array<double>")
    met, plain = [], N.S.context
    monkeypatch.setattr(N.S, "context", lambda e, r, s: (met.append(r.count()), plain(e, r, s))[1])
    got = {r["query"]: r["context"] for r in N.answer(asked, Graph(entities, relations, units), lambda: Scripted(lambda p: "I CANNOT ANSWER"), top_k=1, similar=0.9).collect()}
    assert met == [3]  # one of questions 1 and 2, two of question 3
    assert got[1] == got[2] == "=====Entities=====\ne0: x\n=====Relationships=====\n0 -> 0: loop\n=====Sources=====\na"
    assert got[3] == "=====Entities=====\ne0: x\ne2: x\n=====Relationships=====\n0 -> 0: loop\n0 -> 2: far\n=====Sources=====\nb"


def test_a_relation_of_many_entities_is_one_list_in_a_step(spark):
    from lorecraft.functions.clients import Scripted
    from lorecraft.operators import reason as Z

    names = [f"n{k:03d}" for k in range(200)]
    edges = spark.createDataFrame([("hub", n, "r-1") for n in names] + [("hub", "last", "r-2")], "source string, target string, relation string")
    seeds = spark.createDataFrame([("q", "hub")], "query string, entity string")
    asked = spark.createDataFrame([("q", "who?")], "query string, question string")
    seen, sent = [], spark.sparkContext.accumulator(0)

    def share(prompt):
        sent.add(1)
        return ", ".join(f"0.{k % 9 + 1}" for k in range(len(prompt.rsplit("Entities: ", 1)[1].split("\n")[0].split("; "))))

    model = Z.entities_by_model(lambda: Scripted(share))
    scorer = lambda rows: seen.append(sorted((r["relation"], len(r["names"])) for r in rows.collect())) or model(rows)
    relations = Z.by_model(lambda: Scripted(lambda p: "{r-1 (Score: 0.5)} {r-2 (Score: 0.3)}"))
    steps = Z.reason_with(asked, seeds, edges, relations, depth=1, width=3, entity_scorer=scorer).collect()
    assert seen == [[("r-1", 200), ("r-2", 1)]]  # two rows, not 201
    assert sent.value == 1  # an entity alone isn't asked about
    assert {r["next"] for r in steps} == {"n008", "n017", "n026"}  # shares of 0.9, ties by name
    plain = Z.reason_with(asked, seeds, edges, relations, depth=1, width=2).collect()
    assert {r["next"] for r in plain} == {"last", "n000"}
