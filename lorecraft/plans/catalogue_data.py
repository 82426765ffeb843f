"""More of the catalogue: sources and sinks by round trips, datasets, prompts and model calls, with their SQL."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorecraft.functions import models as L
from lorecraft.functions import parse as P
from lorecraft.functions import prompts as R
from lorecraft.functions import text as X
from lorecraft.functions import vectors as V
from lorecraft.functions.clients import Checked, Scripted
from lorecraft.functions.splitters import TokenSplitter, WordSplitter, split_texts
from lorecraft.operators import graph as G
from lorecraft.operators import instruct as I
from lorecraft.operators import reason as Z
from lorecraft.operators import retrieve as S
from lorecraft.plans import build as B
from lorecraft.plans import generate as Q
from lorecraft.plans.catalogue import KNN, LINKS, WORDS, _docs, _knn, _links, _vectors, query, table
from lorecraft.session import ensure_checkpoint_dir
from lorecraft.sources import io


def folder(spark: SparkSession) -> str:
    """A new folder beside the checkpoints."""
    return f"{ensure_checkpoint_dir(spark)}/catalogue-{uuid4().hex}"


def digest(c) -> F.Column:
    return F.md5(c.cast("binary"))


def fields(**kinds: str) -> T.StructType:
    names = {"string": T.StringType(), "bigint": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(k, names[v]) for k, v in kinds.items()])


DOC = fields(doc_id="bigint", text="string")

# ---- sources and sinks --------------------------------------------------------------------------


@query("""WITH r AS (SELECT o_orderkey AS id, o_custkey % 25 AS source, (o_custkey + 3) % 25 AS target, o_orderstatus AS description FROM orders),
last AS (SELECT least(source, target) AS a, greatest(source, target) AS b, max(id) AS id FROM r GROUP BY ALL)
SELECT id, s.n_name AS source, t.n_name AS target, description FROM last JOIN r USING (id) JOIN nation s ON s.n_nationkey = r.source JOIN nation t ON t.n_nationkey = r.target""")
def io_graph(spark, sf_dir):
    entities = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    relations = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 25).alias("source"), ((F.col("o_custkey") + 3) % 25).alias("target"), F.col("o_orderstatus").alias("description"))
    path = folder(spark)
    io.write_graph(entities, relations, path)
    e, r = io.read_graph(spark, path)
    return G.endpoint_names(r, e).select("id", "source", "target", "description")


@query("""WITH t AS (SELECT conv_id, string_agg(CASE role WHEN 'user' THEN '***Question ' || turn || '***:' || chr(10) || text WHEN 'assistant' THEN '***Answer ' || turn || '***: ' || text ELSE text END, chr(10) ORDER BY turn, role, text) AS t
 FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id),
b AS (SELECT conv_id, unnest(string_split_regex(t, '\\*\\*\\*Question [0-9]+\\*\\*\\*:?')[2:]) AS body, unnest(regexp_extract_all(t, '\\*\\*\\*Question ([0-9]+)\\*\\*\\*:?', 1)) AS n FROM t),
h AS (SELECT conv_id, n::BIGINT AS n, body, regexp_extract(body, '\\*\\*\\*Answer [0-9]+\\*\\*\\*:?') AS head FROM b),
p AS (SELECT conv_id, n, trim(CASE WHEN head = '' THEN body ELSE body[:strpos(body, head) - 1] END, ' ' || chr(9) || chr(10) || chr(13)) AS asked, CASE WHEN head <> '' THEN trim(body[strpos(body, head) + len(head):], ' ' || chr(9) || chr(10) || chr(13)) END AS expected FROM h)
SELECT conv_id, n, md5(asked) AS asked, md5(expected) AS expected FROM p WHERE asked <> ''""")
def numbered_questions(spark, sf_dir):
    """Conversations written as replies of numbered questions and answers, and read back as rows."""
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL AND role IS NOT NULL AND turn IS NOT NULL")
    head = lambda name: F.concat(F.lit(f"***{name} "), F.col("turn").cast("string"), F.lit("***:"))
    line = F.when(F.col("role") == "user", F.concat(head("Question"), F.lit("\n"), "text")).when(F.col("role") == "assistant", F.concat(head("Answer"), F.lit(" "), "text")).otherwise(F.col("text"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text", line.alias("line")))).alias("m"))
    replies = talks.select("conv_id", F.array_join("m.line", "\n").alias("question"))
    return Q.numbered_questions(replies).select("conv_id", "n", digest(F.col("asked")).alias("asked"), digest(F.col("expected")).alias("expected"))


@query("SELECT doc_id, md5(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS digest, n FROM documents CROSS JOIN (SELECT unnest([1, 2]) AS n)")
def io_lines(spark, sf_dir):
    """Gzipped JSON lines, written twice (the second time appended) and read by the tolerant scan."""
    path, docs = folder(spark), _docs(spark, sf_dir).withColumn("text", X.without_controls(F.col("text")))
    io.write_lines(docs.withColumn("n", F.lit(1)), path, compress=True)
    io.write_lines(docs.withColumn("n", F.lit(2)), path, compress=True, append=True)
    return io.read_lines(spark, path, fields(doc_id="bigint", text="string", n="int")).select("doc_id", digest(F.col("text")).alias("digest"), "n")


@query("SELECT md5(text) AS digest FROM conversations WHERE trim(coalesce(text, '')) <> '' AND role IS NOT NULL ORDER BY conv_id, turn, role, text LIMIT 100")
def io_corpus_head(spark, sf_dir):
    """The first lines of a file of JSON lines, blank ones between them."""
    path = folder(spark)
    rows = table(spark, sf_dir, "conversations").where("trim(coalesce(text, '')) <> '' AND role IS NOT NULL").orderBy("conv_id", "turn", "role", "text")
    lines = rows.coalesce(1).select(F.explode(F.array(F.to_json(F.struct(F.col("text").alias("input"))), F.lit("  "))).alias("value"))
    lines.write.text(path)
    return io.read_corpus(spark, path, limit=100).select(digest(F.col("input")).alias("digest"))


@query("""SELECT dense_rank() OVER (ORDER BY conv_id) - 1 AS doc, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS chunk, md5(replace(text, chr(0), '')) AS digest
FROM conversations WHERE text IS NOT NULL QUALIFY length(trim(replace(text, chr(0), ''))) > 0""")
def io_chunks(spark, sf_dir):
    path = folder(spark)
    talks = table(spark, sf_dir, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    lists = talks.orderBy("conv_id").select(F.to_json(F.transform("m", lambda x: F.struct(x["text"].alias("content")))).alias("j"))
    lists.coalesce(1).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ","), F.lit("]")).alias("value")).write.text(path)
    return io.read_chunks(spark, path).select(F.col("doc").cast("bigint").alias("doc"), F.col("chunk").cast("bigint").alias("chunk"), digest(F.col("content")).alias("digest"))


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def io_keyed(spark, sf_dir):
    return io.read_keyed(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id")


@query("SELECT item_id, md5(text) AS digest, count(*) AS n FROM benchmark CROSS JOIN (SELECT unnest([1, 2]) AS copy) GROUP BY ALL")
def io_json_or_lines(spark, sf_dir):
    """One JSON array and JSON lines, each recognised for what it is."""
    path, rows = folder(spark), table(spark, sf_dir, "benchmark")
    io.write_array(rows, f"{path}/array")
    io.write_lines(rows, f"{path}/lines")
    both = io.read_json_or_lines(spark, f"{path}/array").unionByName(spark.read.json(f"{path}/lines"))
    return both.groupBy("item_id", digest(F.col("text")).alias("digest")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT n_nationkey::VARCHAR AS key, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_name END AS name FROM nation")
def io_dimension(spark, sf_dir):
    path = folder(spark)
    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("key"), F.when(F.col("n_nationkey") % 3 != 0, F.col("n_name")).alias("name"))
    io.write_csv(rows, path)
    return io.read_dimension(spark, path)


@query("""SELECT 'question_' || conv_id || '.txt' AS file_name, md5(string_agg(coalesce(text, ''), chr(10) ORDER BY turn, role, text) || CASE WHEN conv_id % 3 = 0 THEN '' ELSE chr(10) || '**Answer**' || chr(10) || count(*) END) AS digest
FROM conversations WHERE NOT contains(coalesce(text, ''), chr(13)) GROUP BY conv_id""")
def io_sections(spark, sf_dir):
    """A text file for each conversation, with a section added to most of them."""
    rows = table(spark, sf_dir, "conversations").where(~F.contains(F.coalesce("text", F.lit("")), F.lit("\r")))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text")))).alias("m"), F.count(F.lit(1)).alias("n"))
    files = talks.select(F.concat(F.lit("question_"), F.col("conv_id").cast("string"), F.lit(".txt")).alias("file_name"), F.array_join(F.transform("m", lambda x: x["text"]), "\n").alias("body"), F.when(F.col("conv_id") % 3 != 0, F.col("n").cast("string")).alias("answer"))
    path = folder(spark)
    io.write_sections(io.with_section(files, "Answer", "answer"), path)
    return io.read_sections(spark, path).select("file_name", digest(F.col("body")).alias("digest"))


@query("SELECT (doc_id % 3) * 9 + 2 AS shard, count(*) AS n, min(doc_id) AS first_id, dense_rank() OVER (ORDER BY (doc_id % 3) * 9 + 2) AS place FROM documents GROUP BY doc_id % 3")
def io_shards(spark, sf_dir):
    """Files named by number, in the order of the numbers (2, 11, 20)."""
    from pyspark.sql.window import Window

    path = folder(spark)
    for k in range(3):
        io.write_array(table(spark, sf_dir, "documents").where(F.col("doc_id") % 3 == k).select("doc_id"), f"{path}/answers_{k * 9 + 2}.json")
    shards = io.read_shards(spark, f"{path}/*", fields(doc_id="bigint")).groupBy(F.col("shard").cast("bigint").alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"))
    return shards.withColumn("place", F.dense_rank().over(Window.orderBy("shard")).cast("bigint"))


@query("SELECT (row_number() OVER (ORDER BY doc_id) - 1) // 100 AS shard, doc_id FROM documents")
def io_numbered_shards(spark, sf_dir):
    path = folder(spark)
    io.write_shards(table(spark, sf_dir, "documents").select("doc_id"), path, "doc_id", size=100)
    return spark.read.json(path).select(F.col("shard").cast("bigint").alias("shard"), "doc_id")


@query("SELECT doc_id, md5(text) AS digest, lang FROM documents")
def io_arrow(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    path = folder(spark)
    io.to_arrow(docs).write.parquet(path)
    return io.from_arrow(spark.read.parquet(path), docs.schema).select("doc_id", digest(F.col("text")).alias("digest"), "lang")


@query("SELECT event_id, event_type FROM (SELECT event_id, event_type, row_number() OVER (ORDER BY event_id) AS n FROM events) WHERE n <= 600")
def io_intervals(spark, sf_dir):
    path, rows = folder(spark), table(spark, sf_dir, "events").select("event_id", "event_type")
    io.write_intervals(rows, path, "event_id", every=200)
    return io.read_interval(spark, path, fields(event_id="bigint", event_type="string"), 600)


@query("SELECT doc_id, upper(lang) AS lang, 2 AS version FROM documents")
def io_versions(spark, sf_dir):
    path, rows = folder(spark), table(spark, sf_dir, "documents").select("doc_id", "lang")
    io.write_version(rows, path)
    number = io.write_version(io.read_version(spark, path).withColumn("lang", F.upper("lang")), path)
    return io.read_version(spark, path).withColumn("version", F.lit(number))


@query("SELECT toxic AS y, count(*) AS n, round((SELECT avg(toxic) FROM labels), 9) AS share FROM labels GROUP BY toxic")
def io_results(spark, sf_dir):
    path, rows = folder(spark), table(spark, sf_dir, "labels").select("doc_id", "toxic")
    io.write_results(rows, rows.agg(F.avg("toxic").alias("share")), path)
    counts = io.read_dimension(spark, f"{path}/predictions").groupBy(F.col("toxic").cast("int").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(spark.read.json(f"{path}/metrics").select(F.round("share", 9).alias("share")))


@query("SELECT event_id, event_type FROM events")
def stream_json_lines(spark, sf_dir):
    path, rows = folder(spark), table(spark, sf_dir, "events").select("event_id", "event_type")
    io.write_lines(rows.repartition(3, "event_id"), f"{path}/in")
    lines = io.stream_lines(spark, f"{path}/in", fields(event_id="bigint", event_type="string"))
    lines.writeStream.format("parquet").option("checkpointLocation", f"{path}/checkpoint").option("path", f"{path}/out").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/out")


# ---- texts, prompts, datasets -------------------------------------------------------------------

MADE = """made AS (SELECT item_id, text, CASE item_id % 5 WHEN 0 THEN 'Ann ' || text || chr(10) || 'Based on that information, is it true that it holds? Yes, no, or maybe?'
 WHEN 1 THEN 'Bob ' || text || '  is it true that nothing holds? More.' WHEN 2 THEN 'Eve one' || chr(10) || ' two ' || chr(10) || chr(10) || 'Does it hold? Yes, no, or maybe?'
 WHEN 3 THEN 'Solo' WHEN 4 THEN 'x y' || chr(10) || 'based on a guess, true, false, or inconclusive?' END AS input FROM benchmark)"""


@query(rf"""WITH {MADE} SELECT item_id, item_id::VARCHAR AS answer, CASE item_id % 5 WHEN 0 THEN 'Based on that information, is it true that it holds? Yes, no, or maybe?' WHEN 1 THEN 'is it true that nothing holds?'
 WHEN 2 THEN input WHEN 3 THEN '' WHEN 4 THEN input END AS question,
 md5(CASE WHEN item_id % 5 < 2 THEN trim(regexp_replace(text, '[ \t\n\r\f]+', ' ', 'g')) WHEN item_id % 5 = 2 THEN 'one two' WHEN item_id % 5 = 3 THEN 'Solo' ELSE 'y' END) AS context FROM made""")
def task_records(spark, sf_dir):
    """Made tasks taken apart: question, answer and the passage without its first word."""
    t, k = F.col("text"), F.col("item_id") % 5
    made = (
        F.when(k == 0, F.concat(F.lit("Ann "), t, F.lit("\nBased on that information, is it true that it holds? Yes, no, or maybe?")))
        .when(k == 1, F.concat(F.lit("Bob "), t, F.lit("  is it true that nothing holds? More.")))
        .when(k == 2, "Eve one\n two \n\nDoes it hold? Yes, no, or maybe?").when(k == 3, "Solo").otherwise("x y\nbased on a guess, true, false, or inconclusive?")
    )
    rows = table(spark, sf_dir, "benchmark").select(made.alias("input"), F.col("item_id").cast("string").alias("output"))
    return I.synthetic_records(rows).select(F.col("answer").cast("bigint").alias("item_id"), "answer", "question", digest(F.col("context")).alias("context"))


@query("SELECT doc_id, md5(text) AS a, md5(coalesce(source, '')) AS b FROM documents WHERE text IS NOT NULL AND NOT contains(text, chr(1)) AND NOT contains(text, '**Question**')")
def listed_sources(spark, sf_dir):
    """Two quoted passages out of a file's list of sources."""
    quoted = lambda c: F.concat(F.lit("'"), F.replace(F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("\n"), F.lit("\\n")), F.lit("'"))
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL").where(~F.contains("text", F.lit("\x01")) & ~F.contains("text", F.lit("**Question**")))
    body = F.concat(F.lit("head\n**Sources**\n["), quoted(F.col("text")), F.lit(", "), quoted(F.coalesce("source", F.lit(""))), F.lit("]\n**Question**\nwhat?"))
    p = rows.select("doc_id", X.listed_pair(body).alias("p"))
    return p.select("doc_id", digest(F.col("p")[0]).alias("a"), digest(F.col("p")[1]).alias("b"))


@query("""SELECT event_id, replace(lower(event_type || ' Name'), ' ', '_') AS slug, CASE WHEN event_id % 3 = 0 THEN 'yes' WHEN event_id % 3 = 1 THEN 'No' END AS answer,
 list_reduce(list_transform(range(least(event_id % 5, 4)), lambda i: -100), lambda a, b: a + b, 0)::BIGINT AS masked, least(event_id % 5 + 2, 4) AS n_ids,
 (event_id % 4)::INTEGER AS best, round(-0.5 * (event_id % 4), 6) AS score, 'q' || event_id AS task_input, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS task_output FROM events""")
def training_formats(spark, sf_dir):
    """Slugs, yes and no, cut and masked ids, greatest logits, sequence scores, split targets."""
    i, s = F.col("event_id"), lambda c: c.cast("string")
    source, target = F.when(i % 5 > 0, F.sequence(F.lit(1), (i % 5).cast("int"))).otherwise(F.array().cast("array<int>")), F.array(F.lit(8), F.lit(9))
    cut = R.truncated(source, target, 4)
    logits = F.transform(F.array(*map(F.lit, range(4))), lambda k: F.when(k == i % 4, 2.0).otherwise(k.cast("double") / 10))
    log_probs, mask = F.array(*[F.lit(-0.5)] * 4), F.transform(F.array(*map(F.lit, range(4))), lambda k: F.when(k < i % 4, 1.0).otherwise(0.0))
    reply = F.concat(F.lit("well\n"), F.when(i % 3 == 0, "Answer: yes").when(i % 3 == 1, "**Answer:** No").otherwise("Answer: perhaps"))
    made = F.concat(F.lit(" q"), s(i), F.when(i % 2 == 0, F.concat(F.lit(" <|pipe|> "), "event_type")).otherwise(""))
    rows = table(spark, sf_dir, "events").select("event_id", R.slug(F.concat("event_type", F.lit(" Name"))).alias("slug"), P.answer_yes_no(reply).alias("answer"), cut.alias("c"), R.argmax(logits).alias("best"), R.sequence_score(log_probs, mask).alias("score"), R.task_output(made).alias("t"))
    masked = F.aggregate(F.filter("c.labels", lambda x: x == -100), F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select("event_id", "slug", "answer", masked.alias("masked"), F.size("c.ids").cast("bigint").alias("n_ids"), "best", F.round("score", 6).alias("score"), F.col("t.input").alias("task_input"), F.col("t.output").alias("task_output"))


@query("""WITH e AS (SELECT doc_id, CASE WHEN lang IN ('en', 'de') THEN lang ELSE 'UNKNOWN' END AS type, CASE WHEN coalesce(source, '') = '' THEN 'An entity named ' || doc_id || '.' ELSE source END AS description FROM documents)
SELECT *, round((SELECT avg(CASE WHEN type <> 'UNKNOWN' THEN 1.0 ELSE 0 END) FROM e), 9) AS complete FROM e""")
def repaired_entities(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    fixed = d.select("doc_id", I.repaired(F.col("lang"), F.col("source"), F.col("doc_id").cast("string"), ["en", "de"]).alias("f")).select("doc_id", "f.*")
    return fixed.crossJoin(I.completeness(fixed).select(F.round("complete", 9).alias("complete")))


DIMENSION = "dim AS (SELECT * FROM (VALUES ('en', 's0', 'one', 'nli'), ('en', NULL, 'all', 'qa'), ('de', NULL, 'all', 'qg')) t(lang, source, template_name, task_type))"


@query(f"""WITH {DIMENSION}, names AS (SELECT ['a', 'b', 'c'] AS n), m AS (SELECT d.doc_id, template_name, task_type FROM documents d JOIN dim t ON d.lang = t.lang AND (t.source IS NULL OR t.source = d.source))
SELECT doc_id, template_name, CASE task_type WHEN 'nli' THEN 'natural language inference' WHEN 'qa' THEN 'question answering without choices' ELSE 'question generation' END AS task, n[('0x' || substr(md5('42|' || doc_id), 1, 8))::BIGINT % 3 + 1] AS chosen FROM m CROSS JOIN names""")
def template_dimension(spark, sf_dir):
    """Examples with the templates of their dataset, and one drawn for each."""
    dim = spark.createDataFrame([("en", "s0", "one", "nli"), ("en", None, "all", "qa"), ("de", None, "all", "qg")], "dataset_name string, dataset_config_name string, template_name string, task_type string")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("dataset"), F.col("source").alias("dataset_config"))
    given = I.with_templates(rows, dim)
    chosen = I.one_template(given.select("doc_id", F.col("template_name").alias("given"), "task_type"), "doc_id", ["a", "b", "c"])
    return chosen.select("doc_id", F.col("given").alias("template_name"), R.task_name(F.col("task_type")).alias("task"), F.col("template_name").alias("chosen"))


@query("""SELECT item_id, md5(trim(text)) AS context, 'Ask about Reddit, not Amazonia' AS template, CASE WHEN item_id % 2 = 0 THEN 'first' END AS first_answer FROM benchmark WHERE item_id % 3 > 0 AND trim(coalesce(text, '')) <> ''""")
def task_contexts(spark, sf_dir):
    """Contexts stripped, words of a template replaced, first answers, empty outputs left out."""
    rows = table(spark, sf_dir, "benchmark").withColumn("task_output", F.when(F.col("item_id") % 3 > 0, "some").otherwise(""))
    rows = I.filled(rows).where("trim(coalesce(text, '')) <> ''")
    contexts = I.as_context(rows, "text").withColumn("key", digest(F.col("context"))).select("key").distinct()
    answers = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("first"), F.lit("second"))).otherwise(F.array().cast("array<string>"))
    made = rows.select("item_id", digest(X.stripped(F.col("text"))).alias("context"), R.relabelled(F.lit("Ask about Amazon, not Amazonia"), {"Amazon": "Reddit"}).alias("template"), R.first_answer(answers).alias("first_answer"))
    return made.join(contexts, F.col("context") == F.col("key"), "left_semi")


@query("""WITH t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(lang, '') AS q, doc_id % 3 AS l, CASE doc_id % 4 WHEN 0 THEN 'SUPPORTS' WHEN 1 THEN 'REFUTES' WHEN 2 THEN 'NOT ENOUGH INFO' END AS v, CASE WHEN toxic = 1 THEN 'Relevant' ELSE 'Irrelevant' END AS a FROM labels JOIN documents USING (doc_id)),
made AS (SELECT doc_id, 'contract_nli.follows' AS template, 'Contract: ' || x || chr(10) || 'Does it follow that "' || q || '"? Reply yes, no or maybe.' AS input, CASE l WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE 'Maybe' END AS output FROM t
UNION ALL SELECT doc_id, 'contract_nli.given', 'Given only ' || x || ', the sentence "' || q || '" is true, false or inconclusive:', CASE l WHEN 0 THEN 'False' WHEN 1 THEN 'True' ELSE 'Inconclusive' END FROM t
UNION ALL SELECT doc_id, 'vitaminc.read', 'Read this evidence. ' || x || chr(10) || chr(10) || 'Claim: ' || q || chr(10) || 'Does the evidence bear the claim out (yes, no, maybe)?', CASE v WHEN 'REFUTES' THEN 'No' WHEN 'SUPPORTS' THEN 'Yes' ELSE 'Maybe' END FROM t
UNION ALL SELECT doc_id, 'vitaminc.judge', x || chr(10) || chr(10) || 'Judge "' || q || '" by the evidence: true, false or inconclusive?', CASE v WHEN 'REFUTES' THEN 'False' WHEN 'SUPPORTS' THEN 'True' ELSE 'Inconclusive' END FROM t
UNION ALL SELECT doc_id, 'pubmed_qa.passage', 'Passage: ' || x || ' ' || q || chr(10) || chr(10) || 'Question: ' || q || chr(10) || 'Reply YES, NO or MAYBE.', coalesce(v, '') FROM t
UNION ALL SELECT doc_id, 'privacy_policy_qa.word', 'Policy: ' || x || chr(10) || 'Question: ' || q || chr(10) || 'Relevant or Irrelevant?', a FROM t
UNION ALL SELECT doc_id, 'privacy_policy_qa.pair', q || chr(10) || x || chr(10) || 'Do the two lines belong together?', CASE a WHEN 'Relevant' THEN 'Yes' ELSE 'No' END FROM t
UNION ALL SELECT doc_id, 'bio_qa.answer', x || chr(10) || chr(10) || 'Question: ' || q || chr(10) || 'Answer:', a FROM t
UNION ALL SELECT doc_id, 'hotpot_qa.answer', q, a FROM t)
SELECT doc_id, template, md5(regexp_replace(input, '^\\s+|\\s+$', '', 'g')) AS input, output FROM made""")
def evaluation_prompts(spark, sf_dir):
    """Templates of each evaluation set over one table."""
    book = R.evaluation_templates()
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    d, text, lang = F.col("doc_id"), F.col("text"), F.col("lang")
    verdict = F.when(d % 4 == 0, "SUPPORTS").when(d % 4 == 1, "REFUTES").when(d % 4 == 2, "NOT ENOUGH INFO")
    answer = F.when(F.col("toxic") == 1, "Relevant").otherwise("Irrelevant")
    given = {
        "contract_nli": {"premise": text, "hypothesis": lang, "label": d % 3},
        "vitaminc": {"evidence": text, "claim": lang, "label": verdict},
        "pubmed_qa": {"context": F.struct(F.array(F.coalesce(text, F.lit("")), F.coalesce(lang, F.lit(""))).alias("contexts")), "question": lang, "final_decision": verdict},
        "privacy_policy_qa": {"text": text, "question": lang, "answer": answer},
        "bio_qa": {"context": text, "question": lang, "answer": answer},
        "hotpot_qa": {"question": lang, "answer": answer},
    }
    names = ["contract_nli.follows", "contract_nli.given", "vitaminc.read", "vitaminc.judge", "pubmed_qa.passage", "privacy_policy_qa.word", "privacy_policy_qa.pair", "bio_qa.answer", "hotpot_qa.answer"]
    made = [F.struct(F.lit(n).alias("template"), book.choose((s := n.split("."))[0], None, s[1]).apply(**given[s[0]]).alias("t")) for n in names]
    return rows.select("doc_id", F.explode(F.array(*made)).alias("x")).select("doc_id", "x.template", digest(F.col("x.t.input")).alias("input"), F.col("x.t.output").alias("output"))


@query("""SELECT doc_id, md5(regexp_replace(coalesce(text, ''), '^\\s+|\\s+$', '', 'g')) AS input, md5('Contract: {{context}}' || chr(10) || 'Does it follow that "' || coalesce(lang, '') || '"? Reply yes, no or maybe.' || chr(10) || '[pipe]' || chr(10) || CASE doc_id % 3 WHEN 0 THEN 'No' WHEN 1 THEN 'Yes' ELSE 'Maybe' END) AS output FROM documents""")
def masked_templates(spark, sf_dir):
    """A template that asks for a task: the context in, the rest with the context left open out."""
    from lorecraft.functions.templates import masked

    made = masked(R.evaluation_templates().choose("contract_nli", None, "follows"), "{{ premise }}")
    d = table(spark, sf_dir, "documents")
    t = made.apply(premise=F.col("text"), hypothesis=F.col("lang"), label=F.col("doc_id") % 3, copy_context=F.lit("{{context}}"))
    return d.select("doc_id", t.alias("t")).select("doc_id", digest(F.col("t.input")).alias("input"), digest(F.col("t.output")).alias("output"))


@query(f"""WITH {LINKS}, known AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM freq), g AS (SELECT doc, name FROM links GROUP BY ALL),
doubles AS (SELECT min(name) AS keep FROM known) SELECT DISTINCT doc, id FROM g JOIN known USING (name)""")
def grouped_names(spark, sf_dir):
    """Groups of names out of replies: unknown names drop out, broken replies are no group."""
    _, names, links = _links(spark, sf_dir)
    entities = G.dense_ids(names, "name").select("id", "name")
    lists = links.groupBy("doc").agg(F.collect_set("name").alias("n"))
    reply = F.concat(F.lit("Here:\n```json\n["), F.to_json(F.concat(F.array(F.lit("Nobody Knows")), "n")), F.lit(",]\n```"))
    replies = lists.select("doc", reply.alias("reply"))
    found = I.groups_of_names(replies.select("reply").unionByName(spark.createDataFrame([("no list here",)], "reply string")), entities)
    members = found.groupBy("group").agg(F.array_sort(F.collect_list("id")).alias("ids")).select("ids").distinct()
    of_doc = links.join(entities, "name").select("doc", "id").distinct().groupBy("doc").agg(F.array_sort(F.collect_list("id")).alias("ids"))
    return of_doc.join(members, "ids", "left_semi").select("doc", F.explode("ids").alias("id"))


@query("""WITH r AS (SELECT text AS question, 'ctx ' || coalesce(text, '') AS context FROM conversations WHERE text IS NOT NULL)
SELECT count(DISTINCT question) AS questions, count(DISTINCT substr(context, 1, 100) || '...') AS contexts FROM r""")
def distinct_questions(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.col("text").alias("question"), F.concat(F.lit("ctx "), F.col("text")).alias("context"))
    return I.distinct_counts(rows)


@query("SELECT doc_id FROM documents ORDER BY md5('42|' || doc_id), doc_id LIMIT 120")
def capped_sample(spark, sf_dir):
    return I.capped(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", 100, 1.2)


@query("""SELECT event_id, user_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS batch FROM events QUALIFY row_number() OVER (ORDER BY event_id) BETWEEN 101 AND 500""")
def batched_head(spark, sf_dir):
    rows = I.batches(table(spark, sf_dir, "events").select("event_id", "user_id"), "event_id", size=64)
    return I.head(rows, "event_id", start=100, stop=500).withColumn("batch", F.col("batch").cast("bigint"))


@query("SELECT event_id, e.user_id, c_name AS problem FROM events e JOIN customer ON c_custkey = user_id % (SELECT count(*) FROM customer) + 1")
def samples_with_problems(spark, sf_dir):
    customers = table(spark, sf_dir, "customer").select((F.col("c_custkey") - 1).alias("task_id"), F.col("c_name").alias("problem"))
    n = customers.agg(F.count(F.lit(1)).alias("n"))
    samples = table(spark, sf_dir, "events").select("event_id", "user_id").crossJoin(n).withColumn("task_id", F.col("user_id") % F.col("n"))
    return I.with_problems(samples, customers).select("event_id", "user_id", "problem")


@query("""WITH p AS (SELECT doc_id, len(list_filter(['UnName_Entity', lang, source], lambda x: x IS NOT NULL)) AS n FROM documents)
SELECT doc_id, n - 1 AS kept, 1 AS alone, doc_id % 2 = 0 AS enough FROM p""")
def known_candidates(spark, sf_dir):
    """Candidates without the placeholder, which stays alone; and whether the facts suffice."""
    d = table(spark, sf_dir, "documents")
    names = F.array_compact(F.array(F.lit("UnName_Entity"), F.col("lang"), F.col("source")))
    reply = F.when(F.col("doc_id") % 2 == 0, "So: {Yes}.").otherwise("{No}, more is needed")
    rows = d.select("doc_id", F.size(Z.known_candidates(names)).alias("kept"), F.size(Z.known_candidates(F.array(F.lit("UnName_Entity")))).alias("alone"), Z.says_yes(reply).alias("enough"))
    return rows.select("doc_id", F.col("kept").cast("bigint").alias("kept"), "alone", "enough")


def _vocabulary() -> str:
    """The place of a public vocabulary file, a parameter of the deployment."""
    import os

    if place := os.environ.get("LORECRAFT_TOKENIZERS"):
        return f"{place}/byte_bpe_50k.json"
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


@query("SELECT doc_id, md5(text) AS digest FROM documents WHERE length(text) > 0")
def subword_windows(spark, sf_dir):
    """Windows of a vocabulary's tokens: what each has before the next one's beginning makes up the text."""
    size, overlap = 128, 16
    whole = split_texts(_docs(spark, sf_dir), TokenSplitter(_vocabulary(), size, overlap))
    alone = split_texts(_docs(spark, sf_dir), TokenSplitter(_vocabulary(), size - overlap, 0))
    met = alone.join(whole.select("doc_id", "start", F.col("content").alias("wide")), ["doc_id", "start"]).where(F.startswith("wide", F.col("content")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "content"))), lambda x: x["content"])
    return met.groupBy("doc_id").agg(F.array_join(parts, "").alias("t")).select("doc_id", digest(F.col("t")).alias("digest"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS words FROM documents) SELECT doc_id, count(*) AS n, sum(least(len(words) - start, 64))::BIGINT AS n_tokens FROM (SELECT doc_id, words, unnest(range(0, len(words), 56)) AS start FROM w) GROUP BY doc_id""")
def splitter_steps(spark, sf_dir):
    """A pipeline of steps, the first a splitter."""
    steps = B.Pipeline((lambda d: split_texts(d, WordSplitter(64, 8)), lambda w: w.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("n_tokens"))))
    return steps.run(_docs(spark, sf_dir))


@query("""WITH s AS (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS completion_id FROM events)
SELECT event_id, user_id, completion_id, (user_id * 7 + completion_id) % 3 = 0 AS passed FROM s""")
def results_by_completion(spark, sf_dir):
    """Results of a run joined to the samples in the order in which these were given in."""
    samples = table(spark, sf_dir, "events").select("event_id", "user_id")
    counts = samples.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"))
    results = counts.select("user_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("completion_id")).withColumn("passed", (F.col("user_id") * 7 + F.col("completion_id")) % 3 == 0)
    return I.results_of_samples(samples, results, key="user_id", order="event_id").select("event_id", "user_id", "completion_id", "passed")


FOUR = KNN + """, four AS (SELECT k.query, k.rank, k.id, d.text AS content FROM knn k JOIN documents d ON d.doc_id = k.id WHERE rank <= 4)"""


@query(f"""WITH {FOUR}, one AS (SELECT query, 1 AS size, row_number() OVER (PARTITION BY query ORDER BY rank) - 1 AS combo, [id] AS ids, true AS ok FROM four),
three AS (SELECT x.query, 3 AS size, row_number() OVER (PARTITION BY x.query ORDER BY x.rank, y.rank, z.rank) - 1 AS combo, [x.id, y.id, z.id] AS ids, x.content <> y.content AND y.content <> z.content AND x.content <> z.content AS ok
 FROM four x JOIN four y ON x.query = y.query AND x.rank < y.rank JOIN four z ON y.query = z.query AND y.rank < z.rank),
used AS (SELECT *, row_number() OVER (PARTITION BY size, list_sort(ids) ORDER BY query, combo) AS n FROM (SELECT * FROM one UNION ALL SELECT * FROM three) WHERE ok)
SELECT query, size, combo, array_to_string(ids, ',') AS ids FROM used WHERE n = 1""")
def sized_combinations(spark, sf_dir):
    """Single units, and combinations of three."""
    content = _docs(spark, sf_dir).select(F.col("doc_id").alias("d"), F.col("text").alias("content"))
    four = _knn(spark, sf_dir).where("rank <= 4").join(content, F.col("id") == F.col("d")).select("query", "rank", "id", "content").checkpoint()
    both = I.combinations(four, 1).withColumn("size", F.lit(1)).unionByName(I.combinations(four, 3).withColumn("size", F.lit(3)))
    return both.select("query", "size", F.col("combo").cast("bigint").alias("combo"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


# ---- graphs in steps, retrieval -----------------------------------------------------------------


@query("""WITH m AS (SELECT lang AS name, list_sort(list(DISTINCT source)) AS ds, min(doc_id) AS first_doc FROM documents WHERE lang IS NOT NULL AND source IS NOT NULL GROUP BY lang)
SELECT name, array_to_string(ds, '|') AS descriptions, first_doc FROM m""")
def resumed_merge(spark, sf_dir):
    """Half of the rows merged, then taken up again with the other half: as if merged at once."""
    rows = table(spark, sf_dir, "documents").where("lang IS NOT NULL AND source IS NOT NULL").select(F.col("lang").alias("name"), F.lit("T").alias("type"), F.col("source").alias("description"), F.col("doc_id").alias("doc"), F.lit(0).alias("pos"))
    path = folder(spark)
    io.write_version(G.merge_entities(rows.where("doc % 2 = 0"), as_set=True), path)
    before = G.unmerged(io.read_version(spark, path))
    whole = G.merge_entities(before.unionByName(rows.where("doc % 2 = 1")), as_set=True)
    return whole.select("name", F.array_join("descriptions", "|").alias("descriptions"), F.col("first_doc"))


@query(f"""WITH vec AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
dots AS (SELECT q.vec_id AS query, c.vec_id AS id, list_inner_product(q.v, c.v) AS s FROM vec q CROSS JOIN vec c WHERE q.vec_id % 20 = 0)
SELECT query, id, round(s, 6) AS score FROM dots QUALIFY row_number() OVER (PARTITION BY query ORDER BY s DESC, id) <= 3""")
def dense_topn(spark, sf_dir):
    """The best documents of a query by the dot product of their vectors."""
    rows = _vectors(spark, sf_dir)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    found = V.nearest(asked, rows, query_id="qid", query="q", id="vec_id", vector="embedding", k=3, scaled=False)
    return found.select("query", "id", F.round("similarity", 6).alias("score"))


@query("""WITH names AS (SELECT DISTINCT n_name AS name FROM nation UNION SELECT 'Nowhere ' || n_nationkey FROM nation WHERE n_nationkey % 5 = 0)
SELECT name, coalesce(n_nationkey, CAST(substr(name, 9) AS INTEGER) + 1)::BIGINT AS id FROM names LEFT JOIN nation ON n_name = name""")
def exact_or_nearest(spark, sf_dir):
    """Names that are entities by name, the others by what a search found for them."""
    nation = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name"))
    lost = nation.where("id % 5 = 0").select(F.concat(F.lit("Nowhere "), F.col("id").cast("string")).alias("name"), (F.col("id") + 1).alias("id"))
    extra = nation.select("name", (F.col("id") + 100).alias("id"))  # not needed for names that are known
    return S.exact_or_nearest(nation.select("name").unionByName(lost.select("name")), nation, lost.unionByName(extra))


@query("""WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), asked AS (SELECT CASE WHEN vec_id % 3 = 0 THEN 'n' || vec_id ELSE 'lost ' || vec_id END AS name, vec_id, v FROM v WHERE vec_id % 20 < 2),
known AS (SELECT 'n' || vec_id AS name, vec_id AS id, v FROM v WHERE vec_id % 20 > 1 OR vec_id % 3 = 0),
near AS (SELECT a.name, k.id, list_cosine_similarity(a.v, k.v) AS s FROM asked a CROSS JOIN known k WHERE a.name NOT IN (SELECT name FROM known) QUALIFY row_number() OVER (PARTITION BY a.name ORDER BY s DESC, k.id) = 1)
SELECT name, id FROM asked JOIN known USING (name) UNION ALL SELECT name, id FROM near WHERE s >= 0.3""")
def seed_entities(spark, sf_dir):
    """Names in a question as entities: by name, else the nearest by embedding."""
    v, k = _vectors(spark, sf_dir).select("vec_id", "embedding"), F.col("vec_id").cast("string")
    asked = v.where("vec_id % 20 < 2").select(F.when(F.col("vec_id") % 3 == 0, F.concat(F.lit("n"), k)).otherwise(F.concat(F.lit("lost "), k)).alias("name"), "embedding")
    known = v.where("vec_id % 20 > 1 OR vec_id % 3 = 0").select(F.concat(F.lit("n"), k).alias("name"), F.col("vec_id").alias("id"), "embedding")
    return S.link_seeds(asked, known, threshold=0.3)


@query("""SELECT doc_id AS query, CASE WHEN source IS NULL OR doc_id % 2 = 1 THEN 'Think step by step, then answer in one sentence.' || chr(10) || 'Question: q' || doc_id || chr(10) || 'Answer:'
 ELSE 'Answer from the facts, and from what you know where they are silent. Think step by step.' || chr(10) || 'Question: q' || doc_id || chr(10) || 'Facts:' || chr(10) || '(' || source || ', is, x)' || chr(10) || 'Answer:' END AS prompt FROM documents""")
def answer_prompts(spark, sf_dir):
    """Prompts with the facts found for a question, and without where there are none."""
    d = table(spark, sf_dir, "documents")
    lines = d.where("doc_id % 2 = 0 AND source IS NOT NULL").select(F.col("doc_id").alias("query"), F.concat(F.lit("("), "source", F.lit(", is, x)")).alias("line"))
    return Z.answer_prompts(d.select(F.col("doc_id").alias("query"), F.concat(F.lit("q"), F.col("doc_id").cast("string")).alias("question")), lines.unionByName(lines))


@query("""WITH e AS (SELECT n_regionkey AS key, string_agg(n_name || ': ' || n_nationkey, chr(10) ORDER BY n_name || ': ' || n_nationkey) AS e, string_agg(n_nationkey || ' -> ' || n_regionkey || ': ' || n_name, chr(10) ORDER BY n_nationkey || ' -> ' || n_regionkey || ': ' || n_name) AS r FROM nation GROUP BY 1)
SELECT key::BIGINT AS key, md5('=====Entities=====' || chr(10) || e || chr(10) || '=====Relationships=====' || chr(10) || r || chr(10) || '=====Sources=====' || chr(10) || CASE WHEN key % 2 = 0 THEN r_name ELSE '' END) AS context FROM e JOIN region ON r_regionkey = key""")
def graph_context(spark, sf_dir):
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("n_regionkey").cast("bigint").alias("key")
    entities = nation.select(key, F.col("n_name").alias("name"), F.col("n_nationkey").cast("string").alias("description"))
    relations = nation.select(key, F.col("n_nationkey").alias("source"), F.col("n_regionkey").alias("target"), F.col("n_name").alias("description"))
    sources = region.where("r_regionkey % 2 = 0").select(F.col("r_regionkey").cast("bigint").alias("key"), F.col("r_name").alias("content"))
    return S.context(entities, relations, sources).select("key", digest(F.col("context")).alias("context"))


@query("SELECT doc_id AS query, CASE WHEN doc_id % 3 = 0 OR source IS NULL THEN 'second ' || doc_id ELSE source END AS answer, CASE WHEN doc_id % 3 = 0 OR source IS NULL THEN 2 ELSE 1 END AS step FROM documents")
def two_step_answers(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    first = d.select(F.col("doc_id").alias("query"), F.when(F.col("doc_id") % 3 == 0, "Sorry, I CANNOT ANSWER").otherwise(F.col("source")).alias("answer"))
    second = d.select(F.col("doc_id").alias("query"), F.concat(F.lit("second "), F.col("doc_id").cast("string")).alias("answer"))
    return S.answer_in_two_steps(first, second)


@query("SELECT doc_id AS id, doc_id % 2 AS chain FROM documents WHERE doc_id >= 2 UNION ALL SELECT -1, -1")
def bridged_components(spark, sf_dir):
    """All documents on two chains, each hanging on its head; the vertex between the heads connects them."""
    d = table(spark, sf_dir, "documents").select("doc_id")
    edges = d.select(F.col("doc_id").alias("source"), (F.col("doc_id") % 2).alias("target")).withColumn("weight", F.lit(0.9))
    edges = edges.unionByName(spark.createDataFrame([(0, -1, 0.9), (-1, 1, 0.8), (0, -2, 0.2), (-2, 1, 0.2)], "source long, target long, weight double"))
    wide = G.bridged(edges, d.select(F.col("doc_id").alias("id")))
    return wide.where("id >= 2 OR id < 0").select("id", F.expr("if(id < 0, -1, id % 2)").cast("bigint").alias("chain"))


# ---- model calls, with models whose replies SQL can tell -----------------------------------------


def upper_model() -> Scripted:
    return Scripted(lambda p: p.strip().split("\n")[-1].upper())


class Measures:
    """An embedding whose vectors are lengths."""

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(len(t)), float(len(t.split(" ")))] for t in texts]


@query("SELECT conv_id, turn, role, md5(upper(text)) AS reply, CASE WHEN text IS NULL THEN NULL ELSE length(text)::DOUBLE END AS size FROM conversations WHERE text IS NULL OR regexp_full_match(text, '[ -~]+') AND text = trim(text)")
def model_calls(spark, sf_dir):
    """Replies and vectors of a column, in batches; null is not sent."""
    rows = table(spark, sf_dir, "conversations").where("text IS NULL OR text RLIKE '^[ -~]+$' AND text = trim(text)")
    asked = L.embed(L.complete(rows, "text", "reply", upper_model), "text", "vector", Measures)
    return asked.select("conv_id", "turn", "role", digest(F.col("reply")).alias("reply"), F.col("vector")[0].alias("size"))


@query("""SELECT doc_id, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE md5('About ' || doc_id) END AS summary, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'E' || doc_id || ',X' END AS names FROM documents
UNION ALL SELECT -1, 'corpus', (SELECT count(*) FROM documents WHERE doc_id % 4 <> 3)::VARCHAR""")
def entity_summaries(spark, sf_dir):
    """Entities and a summary of each text; replies without entities are asked for again, in vain."""
    def reply(prompt: str) -> str:
        n = prompt.rsplit("\n", 1)[-1]
        return f'So: {{"summary": "About {n}", "entities": ["E{n}", "X", "X"]}} done' if int(n) % 4 < 3 else '{"summary": "none", "entities": []}'

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("text"))
    found = Q.entities_and_summaries(docs, lambda: Scripted(reply), tries=2)
    corpus = Q.training_corpus(found, spark.createDataFrame([], "passage string"))
    counted = corpus.agg(F.lit(-1).cast("bigint").alias("doc_id"), F.lit("corpus").alias("summary"), F.count(F.lit(1)).cast("string").alias("names"))
    return found.select(F.col("doc").alias("doc_id"), digest(F.col("summary")).alias("summary"), F.array_join("names", ",").alias("names")).unionByName(counted)


@query("SELECT doc_id, 'Does it say ' || doc_id || '?' AS task_input, 'yes' AS task_output FROM documents WHERE doc_id % 2 = 0")
def conditional_tasks(spark, sf_dir):
    """Tasks made of contexts; replies without an output are left out."""
    def reply(prompt: str) -> str:
        made = "Does it say {{context}}?"
        return f"{made} <|pipe|> yes" if int(prompt.split("\n")[-3 if prompt.endswith("\n") else -2]) % 2 == 0 else made

    contexts = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("context"))
    return Q.conditional_tasks(contexts, lambda: Scripted(reply), code="ynqa").select("doc_id", "task_input", "task_output")


@query("""SELECT 'question_' || doc_id || '_mode_' || (doc_id % 4 + 1) || '_combo_0.txt' AS file_name, 'QUESTION:' AS question, CASE WHEN doc_id % 4 > 0 THEN 'YES' END AS relevance, CASE WHEN doc_id % 5 = 0 THEN 'old' ELSE 'ANSWER:' END AS answer FROM documents""")
def mode_questions(spark, sf_dir):
    """Questions by the rules for the number of passages, their relevance, and answers; done ones are taken over."""
    n = (F.col("doc_id") % 4 + 1).cast("int")
    combos = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("query"), F.lit(0).alias("combo"), F.array_repeat(F.lit("a passage"), n).alias("sources"))
    judge = lambda: Scripted(lambda p: "**Relevance** YES" if "**Relevance** Yes or" in p else p.strip().split("\n")[-1].upper())
    asked = Q.questions(combos, judge)
    done = asked.where("query % 5 = 0").select("file_name", F.lit("old").alias("answer"))
    return asked.select("file_name", "question", "relevance").join(Q.answers(asked, done, judge).select("file_name", "answer"), "file_name")


@query("""SELECT md5('about ' || doc_id || '?') AS hash, doc_id, 'about ' || doc_id || '?' AS question, 'it is ' || doc_id AS answer FROM documents""")
def self_questions(spark, sf_dir):
    """Questions that a model asks of a text and answers, by the hash of the question."""
    def reply(prompt: str) -> str:
        if prompt.startswith("Write"):
            return f"Question: about {prompt.rsplit(chr(10), 1)[-1]}?"
        asked = prompt.rsplit("Question: ", 1)[-1].strip()
        return f"Question: {asked} Answer: it is {asked.split(' ')[-1].rstrip('?')}"

    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("text"))
    return Q.self_questions(docs, lambda: Scripted(reply))


@query("""WITH t AS (SELECT doc_id AS doc, 'A' AS a, 'B' AS b, 'C' AS c FROM documents UNION ALL SELECT doc_id, 'A', 'B', NULL FROM documents WHERE doc_id % 2 = 0)
SELECT doc, a, b, c, md5('T' || doc) AS passage FROM t""")
def pair_passages(spark, sf_dir):
    """Passages on the three names of a document, and on the two of every other one."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("t"), F.col("doc_id").cast("string")).alias("text"))
    names = lambda rows, *n: rows.select(F.col("doc_id").alias("doc"), F.array(*map(F.lit, n)).alias("names"))
    three = Q.pair_texts(docs, names(docs, "A", "B", "C"), upper_model, target=1, triples=True)
    two = Q.pair_texts(docs, names(docs.where("doc_id % 2 = 0"), "A", "B"), upper_model, target=1)
    return three.unionByName(two).select("doc", "a", "b", "c", digest(F.col("passage")).alias("passage"))


@query("""SELECT doc_id, CASE WHEN length(text) < 10 THEN 'blank' WHEN doc_id % 3 = 0 THEN 'failed' WHEN doc_id % 3 = 1 THEN 'empty' ELSE 'read' END AS status, CASE WHEN length(text) >= 10 AND doc_id % 3 = 2 THEN 2 ELSE 0 END AS n
FROM (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'short' ELSE 'a text with number ' || doc_id END AS text FROM documents)""")
def extraction_status(spark, sf_dir):
    """Extraction of all documents with what became of each: a reply that fails or can't be read loses no other."""
    def reply(prompt: str) -> str:
        n = int(prompt.rsplit(" ", 1)[-1])
        if n % 3 == 0:
            raise TimeoutError("no reply")
        return "nothing" if n % 3 == 1 else '{"entities": [{"name": "A", "type": "PERSON", "description": "d"}, {"name": "B", "type": "odd"}], "relations": []}'

    class One(Scripted):
        def complete(self, prompts: list[str]) -> list[str]:
            return [self.rule(p) for p in prompts]

    text = F.when(F.col("doc_id") % 7 == 0, "short").otherwise(F.concat(F.lit("a text with number "), F.col("doc_id").cast("string")))
    docs = table(spark, sf_dir, "documents").select("doc_id", text.alias("text"))
    entities, _, status = B.extract(docs, lambda: One(reply), B.BuildOptions(tries=1, batch=1))
    counts = entities.groupBy(F.col("doc").alias("doc_id")).agg(F.count(F.lit(1)).alias("n"))
    return status.join(counts, "doc_id", "left").select("doc_id", "status", F.coalesce("n", F.lit(0)).cast("int").alias("n"))


@query("""SELECT item_id, 'FIRST' || chr(10) || 'MORE' AS reply FROM benchmark WHERE item_id % 2 = 0 UNION ALL SELECT item_id, 'FIRST' FROM benchmark WHERE item_id % 2 = 1""")
def gleaned_replies(spark, sf_dir):
    """A second round of extraction where the model says that something is missing."""
    def reply(prompt: str) -> str:
        if "YES or NO" in prompt:
            return "yes" if int(prompt.split(" ")[0]) % 2 == 0 else "no"
        return "MORE" if "Add what" in prompt else "FIRST"

    rows = table(spark, sf_dir, "benchmark").select("item_id", F.concat(F.col("item_id").cast("string"), F.lit(" is asked")).alias("p"))
    return L.gleaned(rows, "p", "reply", lambda: Scripted(reply), rounds=2).select("item_id", F.regexp_replace("reply", "\n+$", "").alias("reply"))


@query("SELECT doc_id, doc_id % 2 = 0 AS checked FROM documents")
def checked_replies(spark, sf_dir):
    """Replies that must pass a check: those that don't are errors after all tries, and no reply."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("p"))
    asked = L.complete(rows, "p", "reply", lambda: Checked(Scripted(lambda p: p), lambda r: int(r) % 2 == 0), batch=1, tries=2, wait=0.0)
    return asked.select("doc_id", F.col("reply").isNotNull().alias("checked"))


@query(f"WITH k AS (SELECT vec_id, label FROM embeddings WHERE vec_id % 20 <> 0) SELECT vec_id, label FROM k")
def resumed_embedding(spark, sf_dir):
    """Vectors of the rows that have none yet."""
    rows = _vectors(spark, sf_dir).select("vec_id", "label", F.col("vec_id").cast("string").alias("text"))
    todo = I.remaining(rows, rows.where("vec_id % 20 = 0"), "vec_id")
    return L.embed(todo, "text", "vector", Measures).where("size(vector) = 2").select("vec_id", "label")
