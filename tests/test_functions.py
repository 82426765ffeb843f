import pytest
from pyspark.sql import functions as F

from lorecraft.functions import parse as P
from lorecraft.functions import prompts as R
from lorecraft.functions import text as X
from lorecraft.functions import vectors as V

lit = F.lit


def test_clean(one):
    assert one(X.clean(lit("123456789"))) == ""
    assert one(X.clean(lit("a\x00b   c defghij"))) == "a b c defghij"
    long = one(X.clean(lit("x" * 4001)))
    assert len(long) == 4003 and long.endswith("...")
    assert one(X.clean(lit(None).cast("string"))) == ""


def test_windows_keep_a_suffix(one):
    w = one(X.windows(X.tokens(lit(" ".join("abcdefghij"))), 4, 1))
    assert [(r["start"], len(r["words"])) for r in w] == [(0, 4), (3, 4), (6, 4), (9, 1)]
    assert one(X.windows(X.tokens(lit("")), 4, 1)) == []


def test_markers(one):
    assert one(X.before_marker(lit("abc  **Relevance** x"), "**Relevance**")) == "abc\n"
    assert one(X.before_marker(lit("abc"), "**Relevance**")) == "abc"
    assert one(X.between_markers(lit("a <s> b <e> c"), "<s>", "<e>")) == "b"
    assert one(X.between_markers(lit("a <s> b"), "<s>", "<e>")) is None


def test_prompts_are_taken_apart(one):
    p = lit("Context: the moon. Question: Is it round?\n\nAnswer: yes")
    assert one(X.question_of(p)) == "Is it round?"
    assert one(X.context_of(p)) == "the moon."


def test_sentences_and_names(one):
    assert one(X.sentences(lit("One. Two!\nThree"))) == ["One.", "Two!", "Three"]
    assert one(X.names(lit("Then Alice and Bo met Robert"))) == ["Alice", "Robert"]


def test_graph_replies(one):
    g = one(P.graph_of(lit('```json\n{"entities": [{"name": "A"},]}\n```')))
    assert [e["name"] for e in g["entities"]] == ["A"] and g["relations"] == []
    for bad in ("no json", "", None):
        g = one(P.graph_of(lit(bad).cast("string")))
        assert g["entities"] == [] and g["relations"] == []
    g = one(P.graph_of(lit('{"entities": [], "relations": [{"source": "a", "target": "b", "description": "see http://x"}]}')))
    assert g["relations"][0]["description"] == "see http://x"


def test_scores(one):
    r = one(P.relation_scores(lit("1. {born_in (Score: 0.6)}: x 2. {a; b (Score: 0.3)}")))
    assert [(x["relation"], x["score"]) for x in r] == [("born_in", 0.6)]
    assert one(P.scores(lit("0.0, 1.0, 0.5"), lit(3))) == [0.0, 1.0, 0.5]
    assert one(P.scores(lit("0.0, 1.0, 0.5"), lit(2))) == [0.5, 0.5]
    assert one(P.scores(lit("1, 0"), lit(2))) == [0.5, 0.5]
    assert one(P.shared_scores(F.array(lit(0.0), lit(0.0)))) == [0.5, 0.5]


def test_confidences(one):
    assert one(P.confidences(lit("Confidence (A): 57% … confidence (A+B): 100%"))) == [57, 100]
    assert one(P.relevance(lit("x **Relevance** yes"))) == "yes" and one(P.relevance(lit("x"))) is None
    assert one(P.answer_yes_no(lit("so\n**Answer:** No"))) == "No"


def test_question_answer(one):
    qa = one(P.question_answer(lit("Question: Q1 Answer: A1\n\nQuestion: Q2 Answer: A2")))
    assert (qa["question"], qa["answer"]) == ("Q1 ", "A1")
    qa = one(P.question_answer(lit("Question: only")))
    assert qa["question"] is None and qa["answer"] is None
    assert one(P.question_lines(lit("Question: a\nx\n2. Question: b"))) == ["a", "b"]


def test_numbered_questions(one):
    text = "Sure.\n***Question 1***:\nIs it?\nYes or no?\n***Answer 1***: Yes.\n\n***Question 3***: And then ***Answer 3***:No. ***Answer 4***: x\n***Question 12***:\n \n***Question 2*** last\n"
    assert [tuple(b) for b in one(P.numbered_questions(lit(text)))] == [(1, "Is it?\nYes or no?", "Yes."), (3, "And then", "No. ***Answer 4***: x"), (12, "", None), (2, "last", None)]
    for none in ("", "Question: a", "***Question x***: a"):
        assert one(P.numbered_questions(lit(none))) == []
    assert one(P.numbered_questions(lit(None).cast("string"))) == []


def test_hash(one):
    assert one(P.content_hash(lit(None).cast("string"), "p-")) == "p-d41d8cd98f00b204e9800998ecf8427e"


def test_cosine(one):
    a = F.array(lit(3.0), lit(4.0))
    assert one(V.cosine(a, a)) == pytest.approx(1)
    assert one(V.cosine(a, F.array(lit(0.0), lit(0.0)))) is None


def test_nearest_and_pairs(spark):
    rows = spark.createDataFrame([(0, "t", [1.0, 0.0]), (1, "t", [0.9, 0.1]), (2, "t", [0.0, 1.0]), (3, "u", [1.0, 0.0]), (4, None, [1.0, 0.0]), (5, "t", None), (6, "t", [0.0, 0.0])], "id long, g string, v array<double>")
    asked = rows.where("id = 0").select(F.col("id").alias("q"), F.col("v").alias("w"))
    found = V.nearest(asked, rows, query_id="q", query="w", id="id", vector="v", k=3, block=2).orderBy("rank").collect()
    assert [r["id"] for r in found] == [0, 3, 4]  # ties go to the smaller id
    pairs = V.similar_pairs(rows, id="id", vector="v", group="g", threshold=0.9, block=2).collect()
    assert [(r["a"], r["b"]) for r in pairs] == [(0, 1)]


def test_formats(one):
    assert one(R.instruct(lit("q"), lit("a"))) == "<|input|>\nq\n<|output|>\na"
    out = one(R.task_output(lit("in <|pipe|> out")))
    assert (out["input"], out["output"]) == ("in", "out")
    assert one(R.task_output(lit("in")))["output"] == ""
    m = F.array(F.struct(lit("system").alias("role"), lit("s").alias("text")), F.struct(lit("user").alias("role"), lit("u").alias("text")))
    assert one(R.chat(m)) == "System: s\nUser: u\nAssistant:"
    t = one(R.truncated(F.array(lit(1), lit(2)), F.array(lit(3), lit(4)), 3))
    assert t["ids"] == [1, 2, 3] and t["labels"] == [-100, -100, 3]
    assert one(R.label_index(F.array(lit("a"), lit("b")), lit("b"))) == 1 and one(R.label_index(F.array(lit("a")), lit("c"))) is None
    assert one(R.argmax(F.array(lit(0.1), lit(0.7), lit(0.2)))) == 1
    assert one(R.sequence_score(F.array(lit(-1.0), lit(-2.0)), F.array(lit(1), lit(0)))) == -1.0
    assert one(R.slug(lit("My Name"))) == "my_name"


def test_templates(one):
    book = R.TemplateRegistry()
    book.add("d", None, "t", R.verdict("p", "c", "l", ("no", "yes")))
    made = one(book.choose("d", None, "t").apply(p=lit("P"), c=lit("C"), l=lit(1)))
    assert made["output"] == "yes" and made["input"] == 'P\nClaim: "C". Does it hold? no, yes.'
    assert list(book.gather("d")) == ["t"]
    qa = R.question_answering("c", "q", "a").apply(c=lit("C"), q=lit("Q"), a=lit("A"))
    assert one(qa)["input"] == "C\n\nQuestion: Q\nAnswer:"


def test_porter_stems():
    from lorecraft.operators.metrics import longest_common, stem

    want = {
        "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat",
        "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "filing": "file", "happy": "happi", "relational": "relat", "conditional": "condit",
        "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "hopefulness": "hope", "triplicate": "triplic", "electrical": "electr", "goodness": "good", "revival": "reviv",
        "allowance": "allow", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "probate": "probat", "controller": "control", "rolling": "roll", "sky": "sky", "the": "the",
    }
    assert {w: stem(w) for w in want} == want
    a, b = "the cat sat on the mat".split(), "a cat lay on that mat the".split()
    assert longest_common(a, b) == 3 and longest_common([], b) == 0 and longest_common(a * 40, a * 40) == 240


def test_made_tasks(one):
    from pyspark.sql import functions as F

    from lorecraft.functions import text as X

    cases = {
        "Ann lives  here. Based on that information, is it true that x? Yes, no, or maybe?": ("lives here.", "Based on that information, is it true that x? Yes, no, or maybe?"),
        "Bob runs is it true that he runs? Then.": ("runs", "is it true that he runs?"),
        "One two\nthree\n\nrest true, false, or inconclusive?": ("two three", "One two\nthree\n\nrest true, false, or inconclusive?"),
        "Solo": ("Solo", ""),
        "": ("", ""),
    }
    for text, (context, question) in cases.items():
        assert one(X.task_context(F.lit(text))) == context and one(X.task_question(F.lit(text))) == question
    assert one(X.listed_pair(F.lit("**Sources** ['it\\'s', \"a \\\\ b\"] **Question**"))) == ["it's", "a \\ b"]
    assert one(X.listed_pair(F.lit("**Sources** ['one'] **Question**"))) is None
    assert one(X.listed_pair(F.concat(F.lit("**Sources** ['"), F.repeat(F.lit("x"), 300_000), F.lit("', 'b'] **Question**"))))[1] == "b"


def test_clients_over_http():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    import pytest

    from lorecraft.functions.clients import ChatClient, CompletionClient

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if "fail" in json.dumps(body):
                self.send_response(500), self.end_headers()
                return
            if "messages" in body:
                reply = {"choices": [{"message": {"content": f"{len(body['messages'])}:{body['messages'][-1]['content']}"}}]}
            else:
                reply = {"choices": [{"text": body["prompt"][::-1]}]}
            self.send_response(200), self.end_headers(), self.wfile.write(json.dumps(reply).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}/"
    chat = ChatClient(url, system="be brief", as_json=True)
    assert chat.single_turn("a") == "2:a" and chat.complete(["a", "b"]) == ["2:a", "2:b"]
    assert [chat.multi_turn("a"), chat.multi_turn("b")] == ["2:a", "4:b"]
    chat.reset()
    assert chat.multi_turn("c") == "2:c"
    with pytest.raises(OSError):
        chat.single_turn("fail")
    assert ChatClient(url, fallback="{}").single_turn("fail") == "{}"
    assert CompletionClient(url).complete(["abc", "fail"]) == ["cba", ""]
    server.shutdown()


def test_similar_pairs_against_all_pairs(spark, monkeypatch):
    import numpy as np

    from lorecraft.functions import vectors as V

    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 10))
    x = centres[r.integers(12, size=400)] + 0.25 * r.normal(size=(400, 10))
    rows = [(i, i % 3, v.tolist()) for i, v in enumerate(x)] + [(1000 + i, 0, [1.0, float(i)]) for i in range(5)] + [(2000, 0, None), (2001, None, [1.0]), (2002, 0, [0.0] * 10)]
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {(i, j) for i in range(400) for j in range(i + 1, 400) if i % 3 == j % 3 and unit[i] @ unit[j] >= 0.9}
    want |= {(1000 + i, 1000 + j) for i in range(5) for j in range(i + 1, 5) if (1 + i * j) / np.sqrt((1 + i * i) * (1 + j * j)) >= 0.9}
    for block, pivots in ((1024, 128), (8, 128), (8, 3)):
        monkeypatch.setattr(V, "PIVOTS", pivots)
        df = spark.createDataFrame(rows, "id long, g int, v array<double>")
        got = [(p["a"], p["b"]) for p in V.similar_pairs(df, id="id", vector="v", group="g", threshold=0.9, block=block).collect()]
        assert len(got) == len(set(got)) and set(got) == want
    assert V.similar_pairs(df.limit(0), id="id", vector="v", group="g", threshold=0.9).count() == 0


@pytest.mark.parametrize("scaled", [True, False])
def test_nearest_is_exact_and_meets_few_cells(spark, scaled, monkeypatch):
    import numpy as np

    monkeypatch.setattr(V, "CELL", 30)
    r = np.random.default_rng(5)
    centres = 4 * r.normal(size=(10, 12))
    x = centres[r.integers(10, size=600)] + 0.1 * r.normal(size=(600, 12))
    x[300:310] = x[0]  # ties
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(700 + i, [1.0, float(i)]) for i in range(4)]
    odd = [(800, None), (801, [0.0] * 12), (802, [float("nan")] + [1.0] * 11), (803, [float("inf")] + [1.0] * 11), (804, [None] + [1.0] * 11), (805, [])]
    df = spark.createDataFrame(rows + odd, "id long, v array<double>").withColumn("cell", F.lit("clash"))
    ask = df.where("id % 20 = 0 OR id = 301 OR id >= 700").select(F.col("id").alias("q"), F.col("v").alias("w"))
    values = {i: np.array(v) / (np.linalg.norm(v) if scaled else 1) for i, v in rows}
    if not scaled:
        values[801] = np.zeros(12)

    def want(k, threshold):
        out = set()
        for q in [i for i in values if i % 20 == 0 or i == 301 or i >= 700]:
            scored = sorted((-round(float(np.einsum("i,i->", values[q], v)), 9), i) for i, v in values.items() if len(v) == len(values[q]))
            out |= {(q, i, n + 1) for n, (s, i) in enumerate(scored[:k]) if threshold is None or -s >= threshold}
        return out

    for k, threshold, block in ((3, None, 1024), (15, None, 7), (4, 0.9, 50), (None, 0.99 if scaled else 150.0, 20)):
        got, wanted = V._nearest(ask, df, "q", "w", "id", "v", k, threshold, block, scaled)
        found = [(g["query"], g["id"], g["rank"]) for g in got.collect()]
        assert len(found) == len(set(found))
        if k == 15:  # ties of rows that are alike but for their last bits
            assert {(q, n) for q, _, n in found} == {(q, n) for q, _, n in want(k, threshold)}
        elif k is None:
            assert {f[:2] for f in found} == {w[:2] for w in want(k, threshold)}
        else:
            assert set(found) == want(k, threshold)
        if scaled and k == 3:
            blocks, pairs = wanted.agg(F.count(F.lit(1)), F.sum(F.size("open"))).first()
            assert pairs < 0.4 * blocks * 20  # blocks of queries times cells
    assert V.nearest(ask, df.limit(0), query_id="q", query="w", id="id", vector="v", k=2).count() == 0
    assert V.nearest(ask.limit(0), df, query_id="q", query="w", id="id", vector="v", k=2).count() == 0


def test_blocks_of_similar_pairs_move_as_often_as_their_group_has_parts(spark, monkeypatch):
    import numpy as np

    def moved():
        sc = spark.sparkContext
        sc._jsc.sc().listenerBus().waitUntilEmpty()
        stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the blocks were many
    r = np.random.default_rng(5)
    v = r.normal(size=(3000, 64))
    groups = [k % 20 == 0 for k in range(len(v))]
    df = spark.createDataFrame([(k, int(g), x.tolist()) for k, (g, x) in enumerate(zip(groups, v))], "id long, g int, v array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    near = u @ u.T >= 0.5
    expected = {(a, b) for a in range(len(v)) for b in range(a + 1, len(v)) if near[a, b] and groups[a] == groups[b]}
    assert expected
    try:
        for part in (V.PART, 800):
            monkeypatch.setattr(V, "PART", part)
            before = moved()
            got = [(p["a"], p["b"]) for p in V.similar_pairs(df, id="id", vector="v", group="g", threshold=0.5, block=64).collect()]
            assert len(got) == len(set(got)) and set(got) == expected
            assert sum(n for s, n in moved().items() if s not in before) < 8 * v.nbytes  # there are 23 cells
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
