import gzip
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorecraft.sources import io
from lorecraft.streaming import graphs


def test_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"input": "x\x01y"}\n\nnot json\n{"input": "z"}\n')
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('{"input": "w"}\n')
    got = io.read_corpus(spark, str(tmp_path))
    assert sorted(r["input"] for r in got.collect()) == ["w", "xy", "z"]
    assert [r["input"] for r in io.read_corpus(spark, str(tmp_path / "a.jsonl"), limit=1).collect()] == ["xy"]


def test_lines_without_values_stay(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": null}\n{}\n{"c": 1}\n{"a": "x", "b": "no number"}\n{"b": 1\n[1]\n7\nnull\n{"a": "y", "b": 2}\n')
    got = io.read_lines(spark, str(tmp_path), T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.IntegerType())]))
    assert got.columns == ["file", "line", "a", "b"]
    assert [(r["a"], r["b"]) for r in got.orderBy("line").collect()][:4] == [(None, None)] * 3 + [("x", None)]
    assert got.where("a = 'y' AND b = 2").count() == 1 and got.where("a IS NULL AND b IS NULL").count() == 3


def test_chunks_texts_shards(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps([[{"content": "a\x00b"}, {"content": " "}], [{"content": "c"}]]))
    assert [tuple(r) for r in io.read_chunks(spark, str(tmp_path / "c.json")).collect()] == [(0, 0, "ab"), (1, 0, "c")]
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "q.txt").write_text("body\nmore")
    files = io.read_texts(spark, str(tmp_path / "t"))
    assert tuple(files.first()) == ("q.txt", "body\nmore")
    assert io.with_section(files, "Answer", "file_name").first()["body"].endswith("**Answer**\nq.txt")
    (tmp_path / "s").mkdir()
    for n in (2, 10):
        (tmp_path / "s" / f"part_{n}.json").write_text(json.dumps([{"a": n}]))
    got = io.read_shards(spark, str(tmp_path / "s"), T.StructType([T.StructField("a", T.LongType())]))
    assert [r["a"] for r in got.orderBy("shard").collect()] == [2, 10]


def test_keyed_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("k", 1, "a"), ("k", 2, "b")], "key string, n long, v string")
    assert io.read_keyed(rows, "key", "n").first()["v"] == "b"
    (tmp_path / "l.json").write_text('{"a": 1}\n{"a": 2}\n')
    (tmp_path / "w.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert io.read_json_or_lines(spark, str(tmp_path / "l.json")).count() >= 1
    assert io.read_json_or_lines(spark, str(tmp_path / "w.json")).count() == 2
    (tmp_path / "d.csv").write_text("x,y\n1,\n")
    assert io.read_dimension(spark, str(tmp_path / "d.csv")).first()["y"] is None


def test_writers(spark, tmp_path):
    rows = spark.range(25)
    io.write_lines(rows, str(tmp_path / "l"), compress=True)
    io.write_lines(rows, str(tmp_path / "l"), compress=True, append=True)
    assert spark.read.json(str(tmp_path / "l")).count() == 50
    io.write_shards(rows, str(tmp_path / "s"), "id", size=10)
    assert sorted(p.name for p in (tmp_path / "s").glob("shard=*")) == ["shard=0", "shard=1", "shard=2"]
    io.write_csv(rows, str(tmp_path / "c"))
    assert io.read_dimension(spark, str(tmp_path / "c")).count() == 25
    io.write_sections(spark.createDataFrame([("f.txt", "b")], "file_name string, body string"), str(tmp_path / "f"))
    assert len(list((tmp_path / "f").glob("file_name=f.txt/*.txt"))) == 1
    e = spark.createDataFrame([(0, "a")], "id long, name string")
    r = spark.createDataFrame([(0, 0, 1, "x"), (1, 1, 0, "y")], "id long, source long, target long, description string")
    io.write_graph(e, r, str(tmp_path / "g"))
    assert [x["description"] for x in io.read_graph(spark, str(tmp_path / "g"))[1].collect()] == ["y"]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(["Alice met Robert. Alice left.", "Robert slept.", None, ""])], "doc_id long, text string")
    docs.repartition(3, "doc_id").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start resumes and finds nothing new
        graphs.stream_mentions(spark, str(tmp_path / "in"), docs.schema, str(tmp_path / "g"), str(tmp_path / "c")).awaitTermination()
    got = sorted(tuple(r) for r in graphs.latest(spark, str(tmp_path / "g")).select("name", "n", "docs").collect())
    assert got == [("Alice", 2, 1), ("Robert", 2, 2)]
    assert graphs.latest(spark, str(tmp_path / "nowhere")) is None


def test_counts_are_deltas_until_they_are_merged(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(graphs, "COMPACT", 3)
    batch = lambda n: spark.createDataFrame([("a", n, 2), ("b", n, 1)][: 1 + n % 2], "name string, doc long, n long")
    for epoch in range(7):
        graphs.upsert_mentions(spark, batch(epoch), str(tmp_path / "g"), epoch)
        graphs.upsert_mentions(spark, batch(epoch), str(tmp_path / "g"), epoch)  # a batch that runs again
    assert sorted(map(tuple, graphs.latest(spark, str(tmp_path / "g")).collect())) == [("a", 14, 7), ("b", 3, 3)]
    assert graphs.versions(spark, str(tmp_path / "g")) == [2, 5]
    assert graphs.latest(spark, str(tmp_path / "none")) is None


def test_arrow_files(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"a": [1, 2], "b": ["x", None], "c": [0.5, 1.5]})
    with pa.ipc.new_file(tmp_path / "f.arrow", t.schema) as w:
        w.write_table(t)
    with pa.ipc.new_stream(tmp_path / "s.arrow", t.schema) as w:
        w.write_table(t)
    schema = T.StructType([T.StructField("b", T.StringType()), T.StructField("a", T.LongType())])
    assert sorted(map(str, map(tuple, io.read_arrow(spark, f"{tmp_path}/*.arrow", schema).collect()))) == ["('x', 1)", "('x', 1)", "(None, 2)", "(None, 2)"]


def test_samples_need_their_problems(spark):
    import pytest

    from lorecraft.operators import instruct as I

    problems = spark.createDataFrame([("t1", "p")], "task_id string, prompt string")
    good = spark.createDataFrame([("t1", "x")], "task_id string, completion string")
    assert I.with_problems(good, problems).first()["prompt"] == "p"
    with pytest.raises(Exception, match="no problem t2"):
        I.with_problems(good.unionByName(spark.createDataFrame([("t2", "y")], good.schema)), problems).collect()
