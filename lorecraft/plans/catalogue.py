"""The query catalogue: every operator of the library on the shared tables, with DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecraft.functions import parse as P
from lorecraft.functions import prompts as R
from lorecraft.functions import text as X
from lorecraft.functions import vectors as V
from lorecraft.operators import graph as G
from lorecraft.operators import instruct as I
from lorecraft.operators import mentions as M
from lorecraft.operators import metrics as E
from lorecraft.operators import reason as Z
from lorecraft.operators import retrieve as S
from lorecraft.operators.components import connected_components
from lorecraft.session import ensure_checkpoint_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Similarity at which the catalogue links vectors; the fixtures have none above 0.6.
NEAR = 0.3


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its SQL if it can be expressed."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL shared by several queries -------------------------------------------------------------

CLEAN = r"trim(regexp_replace(regexp_replace(coalesce(text,''),'[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]',' ','g'),'[ \t\n\r]+',' ','g'))"
WORDS = r"CASE WHEN trim(regexp_replace(coalesce({0},''),'[ \t\n\r]+',' ','g'))='' THEN []::VARCHAR[] ELSE string_split(trim(regexp_replace(coalesce({0},''),'[ \t\n\r]+',' ','g')),' ') END"
SENTENCES = r"""
sents AS (SELECT doc_id AS doc, CAST(unnest(range(len(s))) AS INTEGER) AS pos, unnest(s) AS sentence
  FROM (SELECT doc_id, string_split(regexp_replace(coalesce(text,''),'([.!?])[ \t\n\r]+','\1'||chr(1),'g'),chr(1)) AS s FROM documents)),
mentions AS (SELECT DISTINCT doc, pos, unnest(regexp_extract_all(sentence,'[A-Z][a-z]{4,}')) AS name FROM sents),
freq AS (SELECT name, count(DISTINCT doc) AS df FROM mentions GROUP BY name HAVING count(DISTINCT doc) >= 3)
"""
LINKS = (
    SENTENCES
    + r""",
words AS (SELECT DISTINCT doc, pos, unnest(regexp_extract_all(sentence,'[\p{L}\p{N}_]+')) AS word FROM sents),
keyed AS (SELECT doc, pos, word AS key FROM words UNION SELECT doc, pos, regexp_replace(word,'s$','') FROM words),
links AS (SELECT DISTINCT doc, pos, name FROM keyed JOIN freq ON key = name)
"""
)
FILLED = (
    LINKS
    + """,
own AS (SELECT doc, pos, list_sort(list(DISTINCT name)) AS own FROM links GROUP BY doc, pos),
lined AS (SELECT s.doc, s.pos, own FROM sents s LEFT JOIN own USING (doc, pos)),
sides AS (SELECT doc, pos, own,
   last_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b,
   first_value(own IGNORE NULLS) OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS a FROM lined),
filled AS (SELECT doc, pos, coalesce(own, list_sort(list_distinct(list_concat(coalesce(b, []::VARCHAR[]), coalesce(a, []::VARCHAR[]))))) AS names FROM sides)
"""
)
#: A word is made of these; the border of a word is where they begin or end.
LETTERS = r"[\p{L}\p{N}_]"
PHRASES = rf"""{SENTENCES.split("mentions AS")[0]}
phrases AS (SELECT name FROM (SELECT doc, unnest(regexp_extract_all(sentence, '{X.PHRASE}')) AS name FROM sents) GROUP BY name HAVING count(DISTINCT doc) >= 8)"""
#: Every pair of a sentence and a phrase: where the sentence holds the phrase, is it between borders of words?
PHRASE_LINKS = rf"""{PHRASES},
held AS MATERIALIZED (SELECT doc, pos, name, sentence FROM sents JOIN phrases ON contains(sentence, name)),
links AS (SELECT doc, pos, name FROM held WHERE regexp_matches(sentence, '(^|[^\p{{L}}\p{{N}}_])' || name || 's?($|[^\p{{L}}\p{{N}}_])'))"""
VECTORS = "vec AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
PAIRS = VECTORS + f""",
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.v, b.v) AS sim FROM vec a JOIN vec b ON a.label = b.label AND a.vec_id < b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= {NEAR})"""
COMPONENTS = PAIRS + """,
near AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
reach(id, other) AS (SELECT a, a FROM near UNION SELECT r.id, n.b FROM reach r JOIN near n ON r.other = n.a),
comps AS (SELECT id, min(other) AS component FROM reach GROUP BY id)"""
KNN = VECTORS + """,
knn AS (SELECT * FROM (SELECT q.vec_id AS query, c.vec_id AS id, list_cosine_similarity(q.v, c.v) AS sim,
   row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(q.v, c.v) DESC, c.vec_id) AS rank
   FROM vec q CROSS JOIN vec c WHERE q.vec_id % 20 = 0) WHERE rank <= 5)"""


# ---- text ---------------------------------------------------------------------------------------


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.sentence_table(_docs(spark, sf_dir))


def _links(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sentences, known names and the links between them. Sentences are cut anew where they are read: that is less than writing them."""
    ensure_checkpoint_dir(spark)
    sentences = _sentences(spark, sf_dir)
    names = M.entity_frequencies(M.name_mentions(sentences)).checkpoint()
    return sentences, names, M.link_names(sentences, names).checkpoint()


@query(f"""SELECT doc_id, length(c) AS n_chars, md5(c) AS digest FROM (SELECT doc_id, CASE WHEN length(t) < 10 THEN '' WHEN length(t) > 4000 THEN substr(t,1,4000)||'...' ELSE t END AS c
 FROM (SELECT doc_id, {CLEAN} AS t FROM documents))""")
def clean_chunks(spark, sf_dir):
    c = _docs(spark, sf_dir).select("doc_id", X.clean(F.col("text")).alias("c"))
    return c.select("doc_id", F.length("c").cast("bigint").alias("n_chars"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query(f"""WITH w AS (SELECT doc_id, {WORDS.format('text')} AS words FROM documents), s AS (SELECT doc_id, words, unnest(range(0, len(words), 56)) AS start FROM w)
SELECT doc_id, start, len(words[start+1:start+64]) AS n_tokens, md5(array_to_string(words[start+1:start+64],' ')) AS digest FROM s""")
def token_windows(spark, sf_dir):
    w = _docs(spark, sf_dir).select("doc_id", F.explode(X.windows(X.tokens(F.col("text")), 64, 8)).alias("w"))
    return w.select("doc_id", F.col("w.start").cast("bigint").alias("start"), F.size("w.words").cast("bigint").alias("n_tokens"), F.md5(F.array_join("w.words", " ").cast("binary")).alias("digest"))


@query(f"WITH {SENTENCES} SELECT doc, pos, md5(sentence) AS digest FROM sents")
def sentence_split(spark, sf_dir):
    return _sentences(spark, sf_dir).select("doc", "pos", F.md5(F.col("sentence").cast("binary")).alias("digest"))


@query("SELECT min(doc_id) AS doc_id, 'doc-' || md5(coalesce(text,'')) AS hash FROM documents GROUP BY md5(coalesce(text,''))")
def dedup_documents(spark, sf_dir):
    return I.first_of_equal(_docs(spark, sf_dir), id="doc_id", text="text", prefix="doc-")


@query(f"""SELECT doc_id, md5(CASE WHEN instr(text, 'Licen') > 0 THEN regexp_replace(substr(text, 1, instr(text, 'Licen') - 1), '[ \\t\\n\\r]+$', '') || chr(10) ELSE text END) AS head,
 md5(regexp_replace(text, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]', '', 'g')) AS bare FROM documents""")
def strip_marker(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", F.md5(X.before_marker(F.col("text"), "Licen").cast("binary")).alias("head"), F.md5(X.without_controls(F.col("text")).cast("binary")).alias("bare"))


# ---- entities and relations ---------------------------------------------------------------------


@query(f"""WITH {SENTENCES}, firsts AS (SELECT name, min((doc, pos)) AS f FROM mentions JOIN freq USING (name) GROUP BY name)
SELECT row_number() OVER (ORDER BY f, name) - 1 AS id, name, 'T' || (length(name) % 4) AS type, df FROM firsts JOIN freq USING (name)""")
def entity_table(spark, sf_dir):
    mentions = M.name_mentions(_sentences(spark, sf_dir))
    names = M.entity_frequencies(mentions)
    first = mentions.groupBy("name").agg(F.min(F.struct("doc", "pos")).alias("f")).join(names, "name").select("name", "df", F.col("f.doc").alias("doc"), F.col("f.pos").alias("pos"))
    return G.dense_ids(first, "doc", "pos", "name").select("id", "name", F.concat(F.lit("T"), (F.length("name") % 4).cast("string")).alias("type"), "df")


EDGES = LINKS + ", edges AS (SELECT a.name AS source, b.name AS target, count(*) AS weight FROM links a JOIN links b ON a.doc = b.doc AND a.pos = b.pos AND a.name < b.name GROUP BY ALL)"


def _edges(links: DataFrame) -> DataFrame:
    groups = links.groupBy("doc", "pos").agg(F.array_sort(F.collect_set("name")).alias("names")).where(F.size("names") > 1)
    pairs = I.entity_pairs(groups.select(F.struct("doc", "pos").alias("doc"), "names"))
    return pairs.groupBy(F.col("a").alias("source"), F.col("b").alias("target")).agg(F.count(F.lit(1)).alias("weight"))


@query(f"WITH {EDGES} SELECT * FROM edges")
def cooccurrence_edges(spark, sf_dir):
    return _edges(_links(spark, sf_dir)[2])


@query(f"""WITH {LINKS}, ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS id FROM freq),
edges AS (SELECT a.name AS source, b.name AS target, count(*) AS weight FROM links a JOIN links b ON a.doc = b.doc AND a.pos = b.pos AND a.name < b.name GROUP BY ALL)
SELECT s.id AS source, t.id AS target, weight FROM edges JOIN ids s ON s.name = edges.source JOIN ids t ON t.name = edges.target""")
def edge_ids(spark, sf_dir):
    _, names, links = _links(spark, sf_dir)
    return G.resolve_ids(_edges(links), G.dense_ids(names, "name")).select("source", "target", "weight")


@query(f"""WITH {LINKS}, d AS (SELECT name, list_sort(list(DISTINCT sentence)) AS ds, count(*) AS n FROM links JOIN sents USING (doc, pos) GROUP BY name)
SELECT name, 'T' || (length(name) % 4) AS type, len(ds) AS n_descriptions, md5(CASE WHEN len(ds) = 1 THEN ds[1] ELSE array_to_string(ds, chr(10)||chr(10)) END) AS description FROM d""")
def merge_descriptions(spark, sf_dir):
    sentences, _, links = _links(spark, sf_dir)
    rows = links.join(sentences, ["doc", "pos"]).select("name", F.concat(F.lit("T"), (F.length("name") % 4).cast("string")).alias("type"), F.col("sentence").alias("description"), "doc", "pos")
    merged = G.merge_entities(rows, as_set=True)
    summary = G.consolidate(F.col("descriptions"), lambda text: text)
    return merged.select("name", "type", F.size("descriptions").cast("bigint").alias("n_descriptions"), F.md5(summary.cast("binary")).alias("description"))


@query("SELECT least(doc_id % 50, doc_id % 7) AS source, greatest(doc_id % 50, doc_id % 7) AS target, count(*) AS n, md5(array_to_string(list(lang ORDER BY doc_id), '|')) AS descriptions FROM documents GROUP BY ALL")
def merge_relations(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("source"), (F.col("doc_id") % 7).alias("target"), F.col("lang").alias("description"), F.col("doc_id").alias("doc"), F.lit(0).alias("pos"))
    return G.merge_relations(rows).select("source", "target", "n", F.md5(F.array_join("descriptions", "|").cast("binary")).alias("descriptions"))


@query(f"WITH {LINKS} SELECT * FROM links")
def entity_sentence_links(spark, sf_dir):
    return _links(spark, sf_dir)[2]


@query(f"WITH {SENTENCES}, words AS (SELECT DISTINCT doc, pos, unnest(regexp_extract_all(sentence,'{LETTERS}+')) AS word FROM sents), hit AS (SELECT word, name FROM (SELECT DISTINCT word FROM words) JOIN freq ON starts_with(word, name)) SELECT DISTINCT doc, pos, name FROM words JOIN hit USING (word)")
def entity_prefix_links(spark, sf_dir):
    sentences = _sentences(spark, sf_dir)
    names = M.entity_frequencies(M.name_mentions(sentences))
    return M.link_names(sentences, names, match="prefix")


def _phrases(sentences: DataFrame) -> DataFrame:
    return M.entity_frequencies(M.name_mentions(sentences, X.PHRASE), least=8)


@query(f"WITH {PHRASE_LINKS} SELECT * FROM links")
def phrase_links(spark, sf_dir):
    sentences = _sentences(spark, sf_dir)
    return M.link_names(sentences, _phrases(sentences))


@query(rf"""WITH {PHRASES}, held AS MATERIALIZED (SELECT doc, pos, name, lower(sentence) AS line FROM sents JOIN phrases ON contains(lower(sentence), lower(name)))
SELECT doc, pos, name FROM held WHERE regexp_matches(line, '(^|[^\p{{L}}\p{{N}}_])' || lower(name))""")
def phrase_prefix_links(spark, sf_dir):
    sentences = _sentences(spark, sf_dir)
    return M.link_names(sentences, _phrases(sentences), match="prefix", ignore_case=True, apart=True)


@query(f"WITH {FILLED} SELECT doc, pos, array_to_string(names, ',') AS names FROM filled")
def blank_sentence_fill(spark, sf_dir):
    sentences, _, links = _links(spark, sf_dir)
    return M.fill_blanks(sentences, links).select("doc", "pos", F.array_join("names", ",").alias("names"))


ISLANDS = FILLED + """,
hits AS (SELECT doc, pos, unnest(names) AS name FROM filled),
flagged AS (SELECT doc, name, pos, CASE WHEN pos - lag(pos) OVER w > 2 OR lag(pos) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM hits WINDOW w AS (PARTITION BY doc, name ORDER BY pos)),
numbered AS (SELECT *, sum(new) OVER (PARTITION BY doc, name ORDER BY pos) AS run FROM flagged),
ends AS (SELECT doc, max(pos) AS last FROM sents GROUP BY doc),
islands AS (SELECT doc, name, greatest(min(pos) - 1, 0) AS l, least(max(pos) + 1, any_value(last)) AS r FROM numbered JOIN ends USING (doc) GROUP BY doc, name, run)"""


@query(f"WITH {ISLANDS} SELECT * FROM islands")
def sentence_islands(spark, sf_dir):
    sentences, _, links = _links(spark, sf_dir)
    hits = M.fill_blanks(sentences, links).select("doc", "pos", F.explode("names").alias("name"))
    return M.islands(hits, sentences.groupBy("doc").agg(F.max("pos").alias("last")))


REDUCED = ISLANDS + """,
sorted AS (SELECT doc, l, r, row_number() OVER (PARTITION BY doc ORDER BY l, r) AS n FROM (SELECT DISTINCT doc, l, r FROM islands)),
fold(doc, n, l, r, part) AS (SELECT doc, n, l, r, 1 FROM sorted WHERE n = 1
  UNION ALL SELECT s.doc, s.n,
    CASE WHEN f.r > s.l AND (f.r - s.l + 1) / least(f.r - f.l + 1, s.r - s.l + 1)::DOUBLE >= 0.9 THEN f.l ELSE s.l END,
    CASE WHEN f.r > s.l AND (f.r - s.l + 1) / least(f.r - f.l + 1, s.r - s.l + 1)::DOUBLE >= 0.9 THEN greatest(f.r, s.r) ELSE s.r END,
    CASE WHEN f.r > s.l AND (f.r - s.l + 1) / least(f.r - f.l + 1, s.r - s.l + 1)::DOUBLE >= 0.9 THEN f.part ELSE f.part + 1 END
    FROM fold f JOIN sorted s ON s.doc = f.doc AND s.n = f.n + 1),
cuts AS (SELECT doc, min(l) AS l, max(r) AS r FROM fold GROUP BY doc, part)"""


@query(f"WITH RECURSIVE {REDUCED} SELECT doc, l, r FROM cuts")
def interval_reduce(spark, sf_dir):
    sentences, _, links = _links(spark, sf_dir)
    return M.text_units(sentences, links).select("doc", "l", "r")


UNITS = REDUCED + """,
units AS (SELECT md5(c.doc||'|'||c.l||'|'||c.r) AS id, c.doc, c.l, c.r, string_agg(sentence, ' ' ORDER BY pos) AS content FROM cuts c JOIN sents s ON s.doc = c.doc AND pos BETWEEN c.l AND c.r GROUP BY c.doc, c.l, c.r),
unit_names AS (SELECT c.doc, c.l, c.r, list_sort(list(DISTINCT name)) AS names FROM cuts c JOIN links s ON s.doc = c.doc AND pos BETWEEN c.l AND c.r GROUP BY c.doc, c.l, c.r)"""


@query(f"WITH RECURSIVE {UNITS} SELECT id, doc, l, r, md5(content) AS content, array_to_string(names, ',') AS names FROM units JOIN unit_names USING (doc, l, r)")
def text_units(spark, sf_dir):
    sentences, _, links = _links(spark, sf_dir)
    units = M.text_units(sentences, links)
    return units.select("id", "doc", "l", "r", F.md5(F.col("content").cast("binary")).alias("content"), F.array_join("names", ",").alias("names"))


@query(f"WITH RECURSIVE {UNITS.replace(LINKS, PHRASE_LINKS)} SELECT id, doc, l, r, md5(content) AS content, array_to_string(names, ',') AS names FROM units JOIN unit_names USING (doc, l, r)")
def phrase_units(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    sentences = _sentences(spark, sf_dir)
    units = M.text_units(sentences, M.link_names(sentences, _phrases(sentences)).checkpoint())
    return units.select("id", "doc", "l", "r", F.md5(F.col("content").cast("binary")).alias("content"), F.array_join("names", ",").alias("names"))


@query(f"WITH {LINKS} SELECT name, count(*) AS n_units, md5(string_agg(doc||':'||pos, ',' ORDER BY doc||':'||pos)) AS units FROM links GROUP BY name")
def inverted_text_units(spark, sf_dir):
    _, names, links = _links(spark, sf_dir)
    units = links.groupBy(F.concat_ws(":", F.col("doc").cast("string"), F.col("pos").cast("string")).alias("id")).agg(F.collect_set("name").alias("names"))
    rows = M.units_by_name(units, names)
    return rows.select("name", F.size("units").cast("bigint").alias("n_units"), F.md5(F.array_join("units", ",").cast("binary")).alias("units"))


# ---- similarity, components, retrieval ----------------------------------------------------------


def _vectors(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


def _pairs(spark, sf_dir) -> DataFrame:
    return V.similar_pairs(_vectors(spark, sf_dir), id="vec_id", vector="embedding", group="label", threshold=NEAR)


@query(f"WITH {PAIRS} SELECT a, b, round(sim, 6) AS similarity FROM pairs")
def similarity_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT label, count(*) AS n, min(vec_id) AS first_id FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL GROUP BY label HAVING count(*) > 1")
def type_blocks(spark, sf_dir):
    rows = _vectors(spark, sf_dir).where("label IS NOT NULL AND embedding IS NOT NULL")
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.min("vec_id").alias("first_id")).where("n > 1")


@query(f"WITH RECURSIVE {COMPONENTS} SELECT id, component FROM comps")
def alignment_components(spark, sf_dir):
    return connected_components(_pairs(spark, sf_dir), "a", "b")


@query(f"WITH RECURSIVE {COMPONENTS} SELECT c.id, string_agg(d.id::VARCHAR, ',' ORDER BY d.id) AS alias FROM comps c JOIN comps d ON c.component = d.component AND c.id <> d.id GROUP BY c.id")
def alias_lists(spark, sf_dir):
    step = lambda g: connected_components(_pairs(spark, sf_dir), "a", "b").select(F.col("component").alias("group"), "id")
    types = _vectors(spark, sf_dir).where("embedding IS NOT NULL").select(F.col("label").alias("group"), F.col("vec_id").alias("id"))
    return G.aliases(G.refine(types, [step]), lambda x: x.cast("string")).select("id", F.array_join("alias", ",").alias("alias"))


def _knn(spark, sf_dir, threshold=None) -> DataFrame:
    rows = _vectors(spark, sf_dir)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("q"))
    return V.nearest(asked, rows, query_id="qid", query="q", id="vec_id", vector="embedding", k=5, threshold=threshold)


@query(f"WITH {KNN} SELECT query, id, round(sim, 6) AS similarity, rank FROM knn")
def knn_topk(spark, sf_dir):
    return _knn(spark, sf_dir).select("query", "id", F.round("similarity", 6).alias("similarity"), F.col("rank").cast("bigint").alias("rank"))


@query(f"WITH {KNN} SELECT query, id, round(sim, 6) AS similarity FROM knn WHERE sim >= 0.35")
def knn_threshold(spark, sf_dir):
    return _knn(spark, sf_dir, 0.35).select("query", "id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {PAIRS}, strong AS (SELECT * FROM pairs WHERE sim >= 0.33), ids AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 20 = 0 UNION SELECT a FROM strong UNION SELECT b FROM strong)
SELECT a AS source, b AS target, round(sim, 6) AS weight FROM pairs WHERE a IN (SELECT id FROM ids) AND b IN (SELECT id FROM ids)""")
def induced_subgraph(spark, sf_dir):
    edges = _pairs(spark, sf_dir).select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("similarity").alias("weight"))
    ids = G.with_relation_ends(_vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("id")), edges.where("weight >= 0.33"))
    return G.induced(edges, ids).select("source", "target", F.round("weight", 6).alias("weight"))


HOPS = PAIRS + """,
near AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
h0 AS (SELECT DISTINCT a AS root, a AS id FROM near WHERE a % 20 = 0),
h1 AS (SELECT DISTINCT root, b AS id FROM h0 JOIN near ON id = a),
h2 AS (SELECT DISTINCT root, b AS id FROM h1 JOIN near ON id = a),
hops AS (SELECT root, id, min(hop) AS hop FROM (SELECT root, id, 0 AS hop FROM h0 UNION ALL SELECT root, id, 1 FROM h1 UNION ALL SELECT root, id, 2 FROM h2) GROUP BY root, id)"""


@query(f"WITH {HOPS} SELECT * FROM hops")
def khop_nodes(spark, sf_dir):
    ensure_checkpoint_dir(spark)
    edges = _pairs(spark, sf_dir).checkpoint()  # read twice
    return G.hops(edges, edges.select(F.explode(F.array("a", "b")).alias("root")).where("root % 20 = 0").distinct(), 2, source="a", target="b")


@query("""WITH near AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p FROM orders JOIN lineitem ON l_orderkey = o_orderkey),
roots AS (SELECT DISTINCT c AS root FROM near WHERE c % 20 = 0), one AS (SELECT root, p FROM roots JOIN near ON c = root),
two AS (SELECT DISTINCT root, c FROM one JOIN near USING (p))
SELECT r.root, (SELECT count(*) FROM one o WHERE o.root = r.root) AS parts, (SELECT count(*) FROM two t WHERE t.root = r.root AND t.c <> r.root) AS customers FROM roots r""")
def khop_star(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    bought = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") * 2).alias("source"), (F.col("l_partkey") * 2 + 1).alias("target")).distinct()
    roots = bought.where("source % 40 = 0").select(F.col("source").alias("root")).distinct()
    found = G.hops(bought, roots, 2)
    return found.groupBy((F.col("root") / 2).cast("bigint").alias("root")).agg(F.count_if(F.col("hop") == 1).alias("parts"), F.count_if(F.col("hop") == 2).alias("customers"))


@query(f"""WITH {EDGES}, start AS (SELECT min(source) AS name FROM edges), near AS (SELECT source AS a, target AS b FROM edges UNION SELECT target, source FROM edges),
ids AS (SELECT name FROM start UNION SELECT b FROM near JOIN start ON a = name), units AS (SELECT doc, pos, list_sort(list(DISTINCT name)) AS names FROM links GROUP BY doc, pos)
SELECT doc, pos, array_to_string(names, ',') AS names FROM units WHERE list_has_any(names, (SELECT list(name) FROM ids))""")
def khop_text_units(spark, sf_dir):
    links = _links(spark, sf_dir)[2]
    edges = _edges(links).checkpoint()  # read twice
    around = G.hops(edges, edges.agg(F.min("source").alias("root")), 1).select(F.col("id").alias("name")).distinct()
    units = links.groupBy("doc", "pos").agg(F.array_sort(F.collect_set("name")).alias("names"))
    hit = links.join(around, "name", "left_semi").select("doc", "pos").distinct()
    return units.join(hit, ["doc", "pos"]).select("doc", "pos", F.array_join("names", ",").alias("names"))


@query(f"""WITH RECURSIVE {COMPONENTS}, seeds AS (SELECT vec_id AS id FROM embeddings WHERE vec_id % 20 = 0), wide AS (SELECT id FROM seeds UNION SELECT d.id FROM seeds s JOIN comps c ON c.id = s.id JOIN comps d ON d.component = c.component)
SELECT doc_id FROM documents WHERE doc_id IN (SELECT id FROM wide)""")
def alias_expansion(spark, sf_dir):
    alias = G.aliases(connected_components(_pairs(spark, sf_dir), "a", "b").select(F.col("component").alias("group"), "id"))
    wide = G.expand_aliases(_vectors(spark, sf_dir).where("vec_id % 20 = 0").select(F.col("vec_id").alias("id")), alias)
    return _docs(spark, sf_dir).select("doc_id").join(wide, F.col("doc_id") == F.col("id"), "left_semi")


@query(f"WITH {LINKS}, counts AS (SELECT name, count(*) AS n FROM links GROUP BY name) SELECT name, n FROM counts WHERE n >= (SELECT avg(n) FROM counts)")
def frequent_seeds(spark, sf_dir):
    links = _links(spark, sf_dir)[2]
    return S.frequent_seeds(links.groupBy("doc", "pos").agg(F.collect_list("name").alias("names")))


@query(f"""WITH {KNN}, four AS (SELECT k.*, d.text AS content FROM knn k JOIN documents d ON d.doc_id = k.id WHERE rank <= 4),
two AS (SELECT x.query, row_number() OVER (PARTITION BY x.query ORDER BY x.rank, y.rank) - 1 AS combo, x.id AS i, y.id AS j, x.content <> y.content AS ok FROM four x JOIN four y ON x.query = y.query AND x.rank < y.rank),
used AS (SELECT *, row_number() OVER (PARTITION BY least(i, j), greatest(i, j) ORDER BY query, combo) AS n FROM two WHERE ok)
SELECT query, combo, i||','||j AS ids FROM used WHERE n = 1 ORDER BY query, combo LIMIT 2000""")
def unit_combinations(spark, sf_dir):
    content = _docs(spark, sf_dir).select(F.col("doc_id").alias("d"), F.col("text").alias("content"))
    four = _knn(spark, sf_dir).where("rank <= 4").join(content, F.col("id") == F.col("d")).select("query", "rank", "id", "content")
    combos = I.combinations(four, 2, cap=2000)
    return combos.select("query", F.col("combo").cast("bigint").alias("combo"), F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("ids"))


@query(f"""WITH w AS (SELECT doc_id AS id, {WORDS.format('lower(text)')} AS words FROM documents), total AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM w),
tf AS (SELECT id, word, count(*) AS tf FROM (SELECT id, unnest(words) AS word FROM w) GROUP BY ALL),
raw AS (SELECT word, ln(docs - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf CROSS JOIN total GROUP BY word, docs),
idf AS (SELECT word, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
asked AS (SELECT item_id AS query, word, count(*) AS times FROM (SELECT item_id, unnest({WORDS.format('lower(text)')}) AS word FROM benchmark) GROUP BY ALL),
scored AS (SELECT query, id, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(words) / mean))), 6) AS score FROM asked JOIN idf USING (word) JOIN tf USING (word) JOIN w USING (id) CROSS JOIN total GROUP BY query, id)
SELECT query, id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 3""")
def bm25_topn(spark, sf_dir):
    found = S.bm25(_docs(spark, sf_dir), table(spark, sf_dir, "benchmark"), id="doc_id", text="text", query_id="item_id", query="text", k=3)
    return found.select("query", "id", "score", F.col("rank").cast("bigint").alias("rank"))


@query(f"""WITH {SENTENCES}, ids AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS entity FROM freq),
hits AS (SELECT item_id AS query, entity, lower(name) AS name, row_number() OVER (PARTITION BY item_id ORDER BY entity) AS rank FROM benchmark JOIN ids ON contains(lower(text), lower(name)))
SELECT * FROM hits WHERE rank <= 3""")
def seed_linking(spark, sf_dir):
    names = G.dense_ids(M.entity_frequencies(M.name_mentions(_sentences(spark, sf_dir))), "name")
    found = M.names_in_queries(table(spark, sf_dir, "benchmark"), names, id="item_id", text="text", width=3)
    return found.withColumn("rank", F.col("rank").cast("bigint"))


# ---- reasoning ----------------------------------------------------------------------------------

BEAM = EDGES + """,
rel AS (SELECT source AS entity, target AS next, 'with-' || (weight % 5) AS relation, weight FROM edges UNION ALL SELECT target, source, 'with-' || (weight % 5), weight FROM edges),
seeds AS (SELECT name AS query, name AS entity FROM (SELECT source AS name FROM edges UNION SELECT target FROM edges)) ,
beam AS (SELECT query, entity, relation, next, weight::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY weight DESC, relation, entity, next) AS n FROM seeds JOIN rel USING (entity))"""


def _relations(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    edges = _edges(_links(spark, sf_dir)[2]).withColumn("relation", F.concat(F.lit("with-"), (F.col("weight") % 5).cast("string"))).checkpoint()
    ends = edges.select(F.explode(F.array("source", "target")).alias("query")).distinct()
    return ends.select("query", F.col("query").alias("entity")), edges


@query(f"WITH {BEAM} SELECT query, entity, relation, next, score FROM beam WHERE n <= 3")
def relation_beam(spark, sf_dir):
    seeds, edges = _relations(spark, sf_dir)
    return Z.explore(seeds, edges, lambda q, r, w: F.col(w).cast("double"), 3).select("query", "entity", "relation", "next", "score")


@query(f"""WITH {BEAM}, step AS (SELECT * FROM beam WHERE n <= 3), r AS (SELECT DISTINCT query, entity, relation FROM step), t AS (SELECT DISTINCT query, next FROM step)
SELECT query, '(' || entity || ', ' || relation || ', ' || next || ')' AS line FROM r JOIN t USING (query)""")
def triplets(spark, sf_dir):
    seeds, edges = _relations(spark, sf_dir)
    return Z.triplets(Z.reason(seeds, edges, depth=1)).select("query", "line")


@query(f"""WITH {BEAM}, s1 AS (SELECT * FROM beam WHERE n <= 3), v1 AS (SELECT query, entity FROM seeds), f2 AS (SELECT DISTINCT query, next AS entity FROM s1 EXCEPT SELECT query, entity FROM v1),
s2 AS (SELECT * FROM (SELECT query, entity, relation, next, weight::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY weight DESC, relation, entity, next) AS n FROM f2 JOIN rel USING (entity)) WHERE n <= 3),
v2 AS (SELECT * FROM v1 UNION SELECT * FROM f2), f3 AS (SELECT DISTINCT query, next AS entity FROM s2 EXCEPT SELECT query, entity FROM v2),
s3 AS (SELECT * FROM (SELECT query, entity, relation, next, weight::DOUBLE AS score, row_number() OVER (PARTITION BY query ORDER BY weight DESC, relation, entity, next) AS n FROM f3 JOIN rel USING (entity)) WHERE n <= 3)
SELECT query, 1 AS depth, entity, relation, next, score FROM s1 UNION ALL SELECT query, 2, entity, relation, next, score FROM s2 UNION ALL SELECT query, 3, entity, relation, next, score FROM s3""")
def reason_chain(spark, sf_dir):
    seeds, edges = _relations(spark, sf_dir)
    return Z.reason(seeds, edges, depth=3, width=3)


# ---- replies, logs, filters ---------------------------------------------------------------------

JUDGED = """judged AS (SELECT 'question_' || doc_id || '.txt' AS file_name, doc_id, 'Confidence (A): ' || (doc_id * 7 % 101) || '% and confidence (A+B): ' || (doc_id * 13 % 101) || '%' ||
 CASE WHEN doc_id % 5 = 0 THEN '' WHEN quality = 1 THEN ' **Relevance** Yes' ELSE ' **Relevance** no' END AS body FROM labels),
parsed AS (SELECT *, list_transform(regexp_extract_all(body, '(?i)confidence \\([^)]*\\): ([0-9]+)%', 1), lambda x: CAST(x AS INTEGER)) AS c,
 nullif(regexp_extract(body, '(?i)\\*\\*relevance\\*\\*[ \\t\\n\\r]*:?[ \\t\\n\\r]*(yes|no)', 1), '') AS relevance FROM judged)"""


def _judged(spark, sf_dir) -> DataFrame:
    s = lambda c: c.cast("string")
    d = F.col("doc_id")
    verdict = F.when(d % 5 == 0, "").when(F.col("quality") == 1, " **Relevance** Yes").otherwise(" **Relevance** no")
    body = F.concat(F.lit("Confidence (A): "), s(d * 7 % 101), F.lit("% and confidence (A+B): "), s(d * 13 % 101), F.lit("%"), verdict)
    return table(spark, sf_dir, "labels").select(F.concat(F.lit("question_"), s(d), F.lit(".txt")).alias("file_name"), "doc_id", body.alias("body"))


@query(f"WITH {JUDGED} SELECT file_name, list_sum(c)::BIGINT AS total, list_max(c) AS top, len(list_filter(c, lambda x: x >= 50)) = len(c) AND len(c) > 0 AS ok FROM parsed")
def confidence_parse(spark, sf_dir):
    c = P.confidences(F.col("body"))
    return _judged(spark, sf_dir).select("file_name", F.aggregate(c, F.lit(0).cast("bigint"), lambda s, x: s + x).alias("total"), F.array_max(c).alias("top"), I.confident(c, 50).alias("ok"))


@query(f"""WITH {JUDGED}, good AS (SELECT file_name, list_sum(c) AS total, list_max(c) AS top, relevance FROM parsed WHERE len(list_filter(c, lambda x: x >= 20)) = len(c) AND (relevance IS NULL OR lower(relevance) = 'yes')),
best AS (SELECT *, row_number() OVER (ORDER BY total DESC, top DESC, file_name) AS rank FROM good QUALIFY rank <= 50)
SELECT file_name, total::INTEGER AS total, top, relevance, rank::INTEGER AS rank FROM best UNION ALL SELECT file_name, list_sum(c)::INTEGER, list_max(c), relevance, 0 FROM parsed WHERE lower(relevance) = 'yes' AND file_name NOT IN (SELECT file_name FROM best)""")
def quality_topk(spark, sf_dir):
    return I.judged(_judged(spark, sf_dir), threshold=20, keep=50).na.fill({"rank": 0})


@query(f"WITH {JUDGED} SELECT count(*) FILTER (lower(relevance) = 'yes') AS yes, count(*) FILTER (lower(relevance) = 'no') AS no, count(*) FILTER (relevance IS NULL) AS unknown FROM parsed")
def relevance_stats(spark, sf_dir):
    return I.relevance_counts(_judged(spark, sf_dir))


RECORDS = "records AS (SELECT conv_id * 100 + turn AS id, role AS type, regexp_replace(text, '[\\n\\r]+', ' ', 'g') AS question, CASE WHEN turn % 4 = 3 THEN 'I CANNOT ANSWER' ELSE md5(text) END AS answer FROM conversations WHERE text IS NOT NULL)"


def _records(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    return c.select(
        (F.col("conv_id") * 100 + F.col("turn")).alias("id"), F.col("role").alias("type"), F.regexp_replace("text", "[\\n\\r]+", " ").alias("question"),
        F.when(F.col("turn") % 4 == 3, "I CANNOT ANSWER").otherwise(F.md5(F.col("text").cast("binary"))).alias("answer"),
    )


@query(f"WITH {RECORDS} SELECT id::VARCHAR AS id, type, md5(trim(question)) AS question, CASE WHEN answer = 'I CANNOT ANSWER' THEN '' ELSE answer END AS answer FROM records")
def log_records(spark, sf_dir):
    from lorecraft.sources.io import interactions

    blocks = interactions(_records(spark, sf_dir)).select(F.explode(F.split("block", f"\\n{P.RULE}\\n")).alias("b")).where(F.length("b") > 0)
    r = blocks.select(P.log_record(F.col("b")).alias("r")).select("r.*")
    return r.select("id", "type", F.md5(F.col("question").cast("binary")).alias("question"), "answer")


@query(f"""WITH {RECORDS}, clean AS (SELECT id, type, question, CASE WHEN answer = 'I CANNOT ANSWER' THEN '' ELSE answer END AS answer FROM records)
SELECT 'rows' AS measure, count(*) AS n FROM clean UNION ALL SELECT 'field:question', count(*) FILTER (length(trim(question)) > 0) FROM clean
UNION ALL SELECT 'field:answer', count(*) FILTER (length(trim(answer)) > 0) FROM clean UNION ALL SELECT 'type:' || coalesce(type, 'unknown'), count(*) FROM clean GROUP BY 1""")
def quality_report(spark, sf_dir):
    r = _records(spark, sf_dir).withColumn("answer", F.when(F.col("answer") == "I CANNOT ANSWER", "").otherwise(F.col("answer")))
    return I.quality_report(r, ["question", "answer"], "type")


@query("""SELECT event_id, event_type AS name, CASE WHEN event_id % 3 = 2 THEN 0 ELSE event_id % 4 END AS n_relations, CASE WHEN event_id % 3 = 2 THEN 0 ELSE 1 END AS n_entities,
 CASE WHEN event_id % 3 = 2 THEN NULL ELSE md5(props) END AS description FROM (SELECT * REPLACE (coalesce(props, '') AS props) FROM events)""")
def json_repair(spark, sf_dir):
    """Replies around each event's properties, with fences, trailing commas, or no JSON at all."""
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.coalesce("props", F.lit("")).alias("props"))
    rel = F.array_join(F.array_repeat(F.lit('{"source": "a", "target": "b", "description": "http://x"}'), (F.col("event_id") % 4).cast("int")), ", ")
    entity = F.to_json(F.struct(F.col("event_type").alias("name"), F.lit("T").alias("type"), F.col("props").alias("description")))
    body = F.concat(F.lit('Here you are:\n```json\n{"entities": ['), entity, F.lit(',], "relations": ['), rel, F.lit(", ]}\n```"))
    body = F.when(F.col("event_id") % 4 == 0, F.regexp_replace(body, r"\[, \]", "[]")).otherwise(body)
    reply = F.when(F.col("event_id") % 3 == 2, "no json here").otherwise(body)
    rows = e.withColumn("g", P.graph_of(reply))
    return rows.select("event_id", F.col("event_type").alias("name"), F.size("g.relations").cast("bigint").alias("n_relations"), F.size("g.entities").alias("n_entities"), F.md5(F.get("g.entities", 0)["description"].cast("binary")).alias("description"))


@query("""SELECT doc_id, coalesce(source, 'none') || '_' || (doc_id % 7) AS relation, CASE WHEN doc_id % 10 = 0 THEN 0.25 ELSE round((doc_id % 10) / 10.0, 1) END AS score, 1 AS n_relations FROM documents""")
def relation_score_parse(spark, sf_dir):
    d = F.col("doc_id")
    score = F.concat(F.lit("0."), (d % 10).cast("string"))
    reply = F.concat(F.lit("1. {"), F.coalesce("source", F.lit("none")), F.lit("_"), (d % 7).cast("string"), F.lit(" (Score: "), score, F.lit(")}: because. 2. {a; b (Score: 0.3)}"))
    rows = table(spark, sf_dir, "documents").select("doc_id", P.relation_scores(reply).alias("r"), P.shared_scores(P.scores(F.concat(F.lit("scores "), score, F.lit(", 0.0, 0.0, 0.0")), F.lit(4))).alias("s"))
    return rows.select("doc_id", F.col("r")[0]["relation"].alias("relation"), F.round(F.col("s")[0], 1 + 1).alias("score"), F.size("r").alias("n_relations"))


@query(f"""SELECT conv_id, md5(string_agg(CASE role WHEN 'system' THEN 'System: ' WHEN 'user' THEN 'User: ' WHEN 'assistant' THEN 'Assistant: ' ELSE '' END || text, chr(10) ORDER BY turn, role, text) || chr(10) || 'Assistant:') AS prompt,
 sum(len({WORDS.format('text')}))::BIGINT AS n_tokens FROM conversations WHERE text IS NOT NULL GROUP BY conv_id""")
def chat_to_prompt(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"), F.sum(X.token_count(F.col("text"))).alias("n_tokens"))
    return talks.select("conv_id", F.md5(R.chat(F.col("m")).cast("binary")).alias("prompt"), F.col("n_tokens").cast("bigint").alias("n_tokens"))


@query(f"""WITH {RECORDS}, b AS (SELECT id, question, 'Question: ' || question || ' Answer: ' || answer AS block FROM records),
q AS (SELECT *, string_split(block, 'Question: ')[-1] AS last_q, string_split(block, 'Answer: ')[-1] AS last_a FROM b)
SELECT id, md5(string_split(last_q, 'Answer: ')[1]) AS question, md5(trim(last_a)) AS answer, len(list_filter([question], lambda x: contains(x, 'Question:'))) AS n FROM q""")
def qa_pair_parse(spark, sf_dir):
    """The first pair of a block, whatever labels its texts hold."""
    r = _records(spark, sf_dir)
    block = F.concat(F.lit("Question: "), "question", F.lit(" Answer: "), "answer", F.lit("\n\nQuestion: other Answer: another"))
    rows = r.select("id", "question", P.question_answer(block).alias("qa"), P.question_lines(F.col("question")).alias("lines"))
    return rows.select("id", F.md5(F.col("qa.question").cast("binary")).alias("question"), F.md5(F.col("qa.answer").cast("binary")).alias("answer"), F.size("lines").cast("bigint").alias("n"))


# ---- datasets -----------------------------------------------------------------------------------


@query(f"""WITH {SENTENCES}, e AS (SELECT doc, list_sort(list(DISTINCT name)) AS names FROM mentions JOIN freq USING (name) GROUP BY doc),
p AS (SELECT x.doc, x.name AS a, y.name AS b FROM (SELECT DISTINCT doc, name FROM mentions JOIN freq USING (name)) x JOIN (SELECT DISTINCT doc, name FROM mentions JOIN freq USING (name)) y ON x.doc = y.doc AND x.name < y.name)
SELECT doc, a, b FROM (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY md5('42|'||doc||'|'||a||'|'||b), a, b) AS n FROM p) WHERE n <= 3""")
def entity_pair_sample(spark, sf_dir):
    mentions = M.name_mentions(_sentences(spark, sf_dir))
    known = mentions.join(M.entity_frequencies(mentions).select("name"), "name").groupBy("doc").agg(F.array_sort(F.collect_set("name")).alias("names"))
    return I.entity_pairs(known, seed=42, per_doc=3)


@query("SELECT text AS question, role AS answer FROM conversations WHERE text IS NOT NULL AND role IS NOT NULL UNION ALL SELECT text, item_id::VARCHAR FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL")
def merge_datasets(spark, sf_dir):
    items = table(spark, sf_dir, "benchmark").withColumn("output", F.col("item_id").cast("string"))
    return I.union_renamed([(table(spark, sf_dir, "conversations"), {"text": "question", "role": "answer"}), (items, {"text": "question", "output": "answer"})])


@query("SELECT doc_id, ('0x' || substr(md5('42|' || doc_id), 1, 6))::BIGINT % 100 < 10 AS is_test, length(coalesce(text,'')) + length(coalesce(lang,'')) AS n FROM documents")
def train_split(spark, sf_dir):
    rows = I.split(table(spark, sf_dir, "documents"), "doc_id", 10)
    return rows.select("doc_id", "is_test", (F.length(F.coalesce("text", F.lit(""))) + F.length(F.coalesce("lang", F.lit("")))).cast("bigint").alias("n"))


@query("SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5('42|' || doc_id), doc_id) AS n FROM documents) WHERE n <= 10")
def sample_per_source(spark, sf_dir):
    return I.sample_per_group(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 10)


@query(f"""WITH {RECORDS} SELECT id, md5('<|input|>' || chr(10) || question || chr(10) || '<|output|>' || chr(10) || answer) AS instruct, md5('[INST] ' || question || ' [/INST]') AS bracketed,
 md5('<|tasktype|>' || chr(10) || type || chr(10) || '<|context|>' || chr(10) || question || chr(10) || '<|task|>' || chr(10)) AS task, length(question) + length(answer) AS n FROM records""")
def instruct_format(spark, sf_dir):
    digest = lambda c: F.md5(c.cast("binary"))
    q, a = F.col("question"), F.col("answer")
    r = _records(spark, sf_dir)
    return r.select("id", digest(R.instruct(q, a)).alias("instruct"), digest(R.bracketed(q)).alias("bracketed"), digest(R.task_input(F.col("type"), q)).alias("task"), (F.length(q) + F.length(a)).cast("bigint").alias("n"))


@query("""SELECT doc_id, md5(text || chr(10) || 'Claim: "' || lang || '". Does it hold? no, yes.') AS input, CASE WHEN quality = 1 THEN 'yes' ELSE 'no' END AS output, quality AS label FROM labels JOIN documents USING (doc_id)""")
def template_apply(spark, sf_dir):
    book = R.TemplateRegistry()
    book.add("documents", None, "implied", R.verdict("text", "lang", "label", ("no", "yes")))
    t = book.choose("documents", None, "implied")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id")
    made = rows.select("doc_id", t.apply(text=F.col("text"), lang=F.col("lang"), label=F.col("quality")).alias("t"))
    choices = F.array(*map(F.lit, t.choices))
    return made.select("doc_id", F.md5(F.col("t.input").cast("binary")).alias("input"), F.col("t.output").alias("output"), R.label_index(choices, F.col("t.output")).alias("label"))


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def anti_join_resume(spark, sf_dir):
    return I.remaining(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), "doc_id")


@query("SELECT doc_id % 10 AS task, max(quality) AS score, max(doc_id) FILTER (quality = 1) AS best FROM labels GROUP BY 1")
def best_of_attempts(spark, sf_dir):
    rows = table(spark, sf_dir, "labels").select((F.col("doc_id") % 10).alias("task"), F.struct("quality", "doc_id").alias("key"), "doc_id", "quality")
    best = I.best_attempt(rows, "task", "doc_id", "key")
    return best.select("task", F.col("key.quality").alias("score"), F.when(F.col("key.quality") == 1, F.col("doc_id")).alias("best"))


# ---- measures -----------------------------------------------------------------------------------

GUESSED = "guessed AS (SELECT toxic AS y, CASE WHEN contains(lower(text), 'idiot') OR contains(lower(text), 'trash') THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id))"


@query(f"""WITH {GUESSED}, classes AS (SELECT y AS c FROM guessed UNION SELECT p FROM guessed),
f AS (SELECT c, 2.0 * count(*) FILTER (y = c AND p = c) / (count(*) FILTER (y = c) + count(*) FILTER (p = c)) AS f1 FROM classes CROSS JOIN guessed GROUP BY c)
SELECT round((SELECT avg((y = p)::INTEGER) FROM guessed), 9) AS accuracy, round(avg(f1), 9) AS macro_f1 FROM f""")
def accuracy_macro_f1(spark, sf_dir):
    text = F.lower("text")
    hit = (F.contains(text, F.lit("idiot")) | F.contains(text, F.lit("trash"))).cast("int")
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(F.col("toxic").alias("y"), hit.alias("p"))
    return E.classification(rows, "y", "p").select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@query("""WITH g AS (SELECT CASE WHEN contains(lower(text), lower(trim(lang))) THEN 1 ELSE 0 END AS p FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL), s AS (SELECT avg(p) AS a FROM g)
SELECT round(a, 9) AS accuracy, round(CASE WHEN a = 1 THEN 1 ELSE (2 * a / (1 + a)) / 2 END, 9) AS macro_f1 FROM s""")
def containment_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").where("text IS NOT NULL AND lang IS NOT NULL")
    return E.containment(rows, F.col("lang"), F.col("text")).select(F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


NORMAL = r"trim(regexp_replace(regexp_replace(regexp_replace(lower({0}),'[!-/:-@\[-`{{-~]','','g'),'(^|[ \t\n\r])(a|an|the)([ \t\n\r]+(a|an|the))*($|[ \t\n\r])',' ','g'),'[ \t\n\r]+',' ','g'))"


@query(f"""WITH b AS (SELECT x.item_id, {NORMAL.format('x.text')} AS t, {NORMAL.format('y.text')} AS p FROM benchmark x JOIN benchmark y ON y.item_id = (x.item_id + 1) % (SELECT count(*) FROM benchmark)),
tw AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split(t, ' ')) AS w FROM b WHERE t <> '') GROUP BY ALL), pw AS (SELECT item_id, w, count(*) AS n FROM (SELECT item_id, unnest(string_split(p, ' ')) AS w FROM b WHERE p <> '') GROUP BY ALL),
o AS (SELECT item_id, sum(least(tw.n, pw.n)) AS o FROM tw JOIN pw USING (item_id, w) GROUP BY item_id), n AS (SELECT item_id, (SELECT sum(n) FROM tw WHERE tw.item_id = b.item_id) + (SELECT sum(n) FROM pw WHERE pw.item_id = b.item_id) AS n FROM b)
SELECT b.item_id, (t = p)::INTEGER AS exact, round(coalesce(2.0 * o / n, 0), 6) AS f1 FROM b LEFT JOIN o USING (item_id) JOIN n USING (item_id)""")
def squad_token_f1(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark")
    n = rows.agg(F.count(F.lit(1)).alias("n"))
    other = rows.select(F.col("item_id").alias("other"), F.col("text").alias("predicted"))
    both = rows.crossJoin(n).join(other, F.col("other") == (F.col("item_id") + 1) % F.col("n"))
    s = both.select("item_id", E.squad(F.col("text"), F.col("predicted")).alias("s"))
    return s.select("item_id", F.col("s.exact").alias("exact"), F.round("s.f1", 6).alias("f1"))


def _rouge(spark, sf_dir, stemmed: bool) -> DataFrame:
    rows = table(spark, sf_dir, "benchmark")
    other = rows.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("predicted"))
    return E.rouge_l(rows.join(other, "item_id"), "text", "predicted", stemmed=stemmed).select("item_id", F.round("rouge_l", 6).alias("rouge_l"))


@query()
def rouge_l(spark, sf_dir):
    return _rouge(spark, sf_dir, True)


@query("""WITH RECURSIVE w AS (SELECT x.item_id, regexp_extract_all(lower(coalesce(x.text, '')), '[a-z0-9]+') AS a, regexp_extract_all(lower(coalesce(y.text, '')), '[a-z0-9]+') AS b
 FROM benchmark x JOIN benchmark y ON y.item_id = x.item_id + 1),
rows(item_id, k, best) AS (SELECT item_id, 0, list_transform(range(len(b) + 1), lambda j: 0) FROM w UNION ALL
 SELECT r.item_id, k + 1, list_transform(range(len(b) + 1), lambda j: list_max(list_transform(range(j + 1), lambda i: CASE WHEN i > 0 AND b[i] = a[k + 1] THEN best[i] + 1 ELSE best[i + 1] END))) FROM rows r JOIN w USING (item_id) WHERE k < len(a))
SELECT item_id, round(CASE WHEN len(a) + len(b) = 0 THEN 0 ELSE 2.0 * best[len(b) + 1] / (len(a) + len(b)) END, 6) AS rouge_l FROM rows JOIN w USING (item_id) WHERE k = len(a)""")
def rouge_l_words(spark, sf_dir):
    return _rouge(spark, sf_dir, False)


@query("""WITH per AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS c FROM events GROUP BY user_id), least AS (SELECT min(n) AS m FROM per)
SELECT k, round(avg(CASE WHEN n - c < k THEN 1.0 WHEN c = 0 THEN 0.0 ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - k::DOUBLE / i)) END), 9) AS pass_at_k
FROM per CROSS JOIN (SELECT unnest([1, 2, 5]) AS k) CROSS JOIN least WHERE m >= k GROUP BY k""")
def pass_at_k(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), (F.col("event_type") == "purchase").alias("passed"))
    return E.pass_at_k(rows, [1, 2, 5]).select("k", F.round("pass_at_k", 9).alias("pass_at_k"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS completion_id FROM events")
def completion_ids(spark, sf_dir):
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return table(spark, sf_dir, "events").select("user_id", "event_id", n.cast("bigint").alias("completion_id"))


@query(f"""WITH RECURSIVE {PAIRS}, near AS (SELECT a, b, sim AS w FROM pairs UNION ALL SELECT b, a, sim FROM pairs), start AS (SELECT min(a) AS s FROM pairs),
far(id, hop) AS (SELECT s, 0 FROM start UNION SELECT b, hop + 1 FROM far JOIN near ON a = id WHERE hop < 2),
goal AS (SELECT id AS g FROM (SELECT id, min(hop) AS hop FROM far GROUP BY id) ORDER BY hop DESC, id LIMIT 1),
paths(path, last, least, cost) AS (SELECT [s], s, 1.0::DOUBLE, 0.0::DOUBLE FROM start UNION ALL
 SELECT list_append(path, b), b, least(least, w), cost + w FROM paths JOIN near ON a = last WHERE NOT list_contains(path, b) AND len(path) < 7 AND last <> (SELECT g FROM goal)),
found AS (SELECT path, cost, floor(least * 16) / 16 AS level FROM paths WHERE last = (SELECT g FROM goal)),
best AS (SELECT max(level) AS level FROM found)
SELECT level, array_to_string(path[2:-2], ',') AS inner_ids FROM found JOIN best USING (level) ORDER BY cost LIMIT 1""")
def max_avg_path(spark, sf_dir):
    """The first vertex and the farthest within two hops; paths of more than six edges never win here."""
    edges = _pairs(spark, sf_dir).select(F.col("a").alias("source"), F.col("b").alias("target"), F.col("similarity").alias("weight")).checkpoint()
    end = G.hops(edges, edges.agg(F.min("source").alias("root")), 2).orderBy(F.desc("hop"), "id").limit(1).collect()
    level, inner = G.best_average_path(edges, end[0]["root"], end[0]["id"]) if end else (-1.0, [])
    return spark.createDataFrame([(level, ",".join(map(str, inner)))] if end else [], "level double, inner_ids string")


# ---- streams and the star schema ----------------------------------------------------------------


@query(f"WITH {SENTENCES} SELECT name, count(*) AS n, count(DISTINCT doc) AS docs FROM mentions GROUP BY name")
def stream_upsert_graph(spark, sf_dir):
    from uuid import uuid4

    from lorecraft.streaming import graphs

    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"
    docs = _docs(spark, sf_dir)
    docs.repartition(3, "doc_id").write.parquet(f"{folder}/in")
    graphs.stream_mentions(spark, f"{folder}/in", docs.schema, f"{folder}/graph", f"{folder}/checkpoint").awaitTermination()
    return graphs.latest(spark, f"{folder}/graph")


def _said(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Names of each sentence as entities, and each name with the next one as a relation; the sentence describes both."""
    named = M.sentence_table(docs).select(F.col("doc"), F.col("pos"), F.col("sentence").alias("description"), F.array_distinct(X.names(F.col("sentence"))).alias("names"))
    kind = F.when(F.length("name") % 3 == 0, "").otherwise(F.concat(F.lit("T"), (F.col("doc") % 4).cast("string")))
    entities = named.select("doc", "pos", "description", F.explode("names").alias("name")).withColumn("type", kind)
    pair = F.transform(F.slice("names", 2, F.size("names")), lambda n, i: F.struct(F.get("names", i).alias("source"), n.alias("target")))
    relations = named.where(F.size("names") > 1).select("doc", "pos", "description", F.explode(pair).alias("p")).select("doc", "pos", "description", "p.source", "p.target")
    return entities, relations


def _streamed_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The graph of a stream that reads four files, stops, starts again, and meets files with documents that it has seen."""
    from uuid import uuid4

    from lorecraft.streaming import graphs

    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"
    docs = _docs(spark, sf_dir)
    run = lambda: graphs.stream_graph(spark, f"{folder}/in", docs.schema, _said, f"{folder}/graph", f"{folder}/checkpoint", files_per_trigger=2).awaitTermination()
    docs.where("doc_id % 3 > 0").repartition(4, "doc_id").write.parquet(f"{folder}/in")
    run()
    docs.where("doc_id % 3 = 0 OR doc_id % 7 = 1").repartition(3, "doc_id").write.mode("append").parquet(f"{folder}/in")
    docs.where("doc_id % 5 = 0").repartition(1).write.mode("append").parquet(f"{folder}/in")
    run()
    return graphs.graph(spark, f"{folder}/graph")


SAID = SENTENCES.split("mentions AS")[0] + """
named AS (SELECT doc, pos, sentence, unnest(ns) AS name, unnest(range(len(ns))) AS place FROM (SELECT doc, pos, sentence, regexp_extract_all(sentence, '[A-Z][a-z]{4,}') AS ns FROM sents)),
firsts AS (SELECT doc, pos, sentence, name, min(place) AS place FROM named GROUP BY ALL),
placed AS (SELECT *, lead(name) OVER (PARTITION BY doc, pos ORDER BY place) AS next, CASE WHEN length(name) % 3 = 0 THEN '' ELSE 'T' || (doc % 4) END AS type FROM firsts)"""


@query(f"""WITH {SAID},
votes AS (SELECT name, type, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, type) AS r FROM placed WHERE type <> '' GROUP BY name, type)
SELECT p.name, coalesce(any_value(v.type), '') AS type, count(*) FILTER (sentence <> '') AS n, md5(string_agg(sentence, '|' ORDER BY doc, pos)) AS descriptions, min(doc) AS first_doc FROM placed p LEFT JOIN votes v ON v.name = p.name AND r = 1 GROUP BY p.name""")
def stream_graph_entities(spark, sf_dir):
    entities = _streamed_graph(spark, sf_dir)[0]
    return entities.select("name", "type", F.size("descriptions").cast("bigint").alias("n"), F.md5(F.array_join("descriptions", "|").cast("binary")).alias("descriptions"), "first_doc")


@query(f"""WITH {SAID} SELECT least(name, next) AS source, greatest(name, next) AS target, count(*) AS n, md5(string_agg(sentence, '|' ORDER BY doc, pos)) AS descriptions FROM placed WHERE next IS NOT NULL GROUP BY ALL""")
def stream_graph_relations(spark, sf_dir):
    relations = _streamed_graph(spark, sf_dir)[1]
    return relations.select("source", "target", "n", F.md5(F.array_join("descriptions", "|").cast("binary")).alias("descriptions"))


def _replayed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """A stream of the events in the order of their arrival, and its folder: eight parts of their time, a file each. One in ten comes a part late, in
    time for a watermark of a part and a half; one in ten of the first six parts comes four parts late; one in five comes
    again in the next part. A last row, much later, settles all that is open."""
    from uuid import uuid4

    folder = f"{ensure_checkpoint_dir(spark)}/stream-{uuid4().hex}"
    events = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    span = events.agg(F.min(F.unix_micros("ts")).alias("low"), F.max(F.unix_micros("ts")).alias("high")).first()
    part = F.expr(f"(unix_micros(ts) - {span['low']}) * 8 div {span['high'] - span['low'] + 1}")
    rows = events.withColumn("part", part).withColumn("comes", F.expr("part + CASE event_id % 10 WHEN 3 THEN 1 WHEN 7 THEN if(part <= 5, 4, 0) ELSE 0 END"))
    again = rows.where("event_id % 5 = 0").withColumn("comes", F.col("comes") + 1)
    end = rows.limit(1).withColumns({"event_id": F.lit(-1).cast("bigint"), "ts": F.timestamp_micros(F.lit(span["high"] + 400 * 86_400 * 10**6)), "comes": F.lit(99).cast("bigint")})
    for k in [*range(10), 99]:
        rows.unionByName(again).unionByName(end).where(F.col("comes") == k).select(*events.columns).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    late = f"{(span['high'] - span['low'] + 1) * 3 // 16} microseconds"
    from lorecraft.streaming.graphs import settled

    return settled(stream, late=late), folder


#: The rows that count: all but those that come four parts late.
ARRIVED = """span AS (SELECT min(epoch_us(ts)) AS low, max(epoch_us(ts)) AS high FROM events),
arrived AS (SELECT e.* FROM events e CROSS JOIN span WHERE NOT (event_id % 10 = 7 AND (epoch_us(ts) - low) * 8 // (high - low + 1) <= 5))"""


@query(f"WITH {ARRIVED} SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM arrived GROUP BY ALL")
def late_event_windows(spark, sf_dir):
    from lorecraft.streaming import graphs

    rows, folder = _replayed(spark, sf_dir)
    out = graphs.written(graphs.event_windows(rows, size="1 hour"), f"{folder}/out", f"{folder}/checkpoint")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query(f"""WITH {ARRIVED}, e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM arrived WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, run""")
def late_user_sessions(spark, sf_dir):
    from lorecraft.streaming import graphs

    rows, folder = _replayed(spark, sf_dir)
    out = graphs.written(graphs.user_sessions(rows), f"{folder}/out", f"{folder}/checkpoint")
    return out.select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("SELECT date_trunc('day', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def event_windows(spark, sf_dir):
    from lorecraft.streaming.graphs import event_windows as windows

    w = windows(table(spark, sf_dir, "events"))
    return w.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts >= lag(ts) OVER w + INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM e) SELECT user_id, min(ts) AS session_start, count(*) AS n FROM s GROUP BY user_id, run""")
def user_sessions(spark, sf_dir):
    from lorecraft.streaming.graphs import user_sessions as sessions

    return sessions(table(spark, sf_dir, "events")).select("user_id", F.col("session_start").cast("timestamp_ntz").alias("session_start"), "n")


@query("""SELECT coalesce(n_name, 'all') AS nation, coalesce(year(o_orderdate), 0) AS year, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey
 JOIN nation ON n_nationkey = c_nationkey GROUP BY ROLLUP (n_name, year(o_orderdate))""")
def star_rollup(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    rows = t("lineitem").join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey"))
    revenue = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return rows.rollup(F.col("n_name").alias("nation"), F.year("o_orderdate").cast("bigint").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(revenue), 2).alias("revenue")).na.fill({"nation": "all", "year": 0})


from lorecraft.plans import catalogue_data, catalogue_models  # noqa: E402, F401  (register more queries)
