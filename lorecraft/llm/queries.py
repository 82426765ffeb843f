"""Queries of the training-data operators: thin bindings with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def vocabulary(name: str) -> str:
    """The place of a public vocabulary file: in the folder of ``LORECRAFT_TOKENIZERS``, or in ``public_tokenizers``."""
    if folder := os.environ.get("LORECRAFT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_vector_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of near-duplicate vectors with equal labels."""
    from lorecraft.llm.vector_dups import vector_duplicates

    return vector_duplicates(_table(spark, sf_dir, "embeddings"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of every text, learned from the labels of two thirds of the documents."""
    from lorecraft.llm.language_id import split_of
    from lorecraft.llm.toxicity import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (split_of("doc_id", 3) == 1).alias("held_out"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = train(docs.where(~F.col("held_out")), labels)
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words to take of every document so that sources come to their target weights."""
    from lorecraft.llm.mixing import plan_mix

    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, shuffled into 8 shards whose row counts differ by one at most."""
    from lorecraft.llm.sharding import external_shuffle

    text = F.coalesce(F.col("text"), F.lit(""))
    size = (F.octet_length(text).cast("bigint") + 1).alias("size")
    shuffled = external_shuffle(_table(spark, sf_dir, "documents"), shards=8)
    return shuffled.select("doc_id", size, F.crc32(text.cast("binary")).alias("text_crc32"), "law", "shard", "slot", "grown_shard")


def op4_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies among the images drawn of all ``embeddings`` (no table has images of its own)."""
    from lorecraft.llm.media import image_copies, render_vectors

    images = render_vectors(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), vector="embedding")
    return image_copies(images, id="vec_id")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every text, learned from four fifths of the documents."""
    from lorecraft.llm.language_id import identify, split_of, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (split_of("doc_id", 5) == 0).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    return identify(docs, model).select("doc_id", "held_out", "lang_pred", "score")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality of every text, learned from the labels of four fifths of the documents."""
    from lorecraft.llm.language_id import split_of
    from lorecraft.llm.quality import score, train

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (split_of("doc_id", 5) == 0).alias("held_out"))
    labels = _table(spark, sf_dir, "labels").select("doc_id", "quality")
    model = train(docs.where(~F.col("held_out")), labels)
    return score(docs, model).select("doc_id", "held_out", "score", "predicted")


def op7_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near duplicates of every document, and which one of it stays."""
    from lorecraft.llm.near_dups import near_duplicates

    return near_duplicates(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every text and what they decode to, as digests."""
    from lorecraft.llm.pieces import Pieces

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    digest = Pieces(spark, vocabulary("piece_bpe_32k.model")).digest("text")
    return docs.select("doc_id", digest.alias("d")).select("doc_id", "d.n_tokens", "d.ids_sha256", "d.decoded_sha256")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every text, and whether it is over 1024 tokens."""
    from lorecraft.llm.token_counts import count_tokens

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, vocabulary("byte_bpe_50k.json")).select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op11_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level ids of every text and what they decode to, as digests."""
    from lorecraft.llm.byte_pieces import encode_decode

    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = encode_decode(docs, vocabulary("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of every conversation, after damage by a checksum."""
    from lorecraft.llm.conversations import damage, digests, repair

    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, repaired = repair(damage(given))
    of = lambda df, c: df.withColumnRenamed("conv_id", c)
    every = given.select("conv_id").distinct()
    out = every.join(of(report, "r"), F.col("conv_id").eqNullSafe(F.col("r")), "left").join(of(digests(repaired), "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    longs = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *longs, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten exact rounds of eight centroids over all vectors."""
    from lorecraft.llm.ball_trees import cluster

    found = cluster(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per source of the mix: its size, its target, and whether the words taken come to it but for a hundredth of it and a tenth of its longest document."""
    plan = op3_mix(spark, sf_dir).join(_table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    sums = plan.groupBy("source").agg(F.max("source_size").alias("source_size"), F.max("target").alias("target"), F.sum("taken").alias("taken"), F.max("size").alias("most"))
    return sums.select("source", "source_size", F.round("target", 4).alias("target"), (F.abs(F.col("taken") - F.col("target")) <= 0.01 * F.col("target") + F.col("most") / 10).alias("near"))


def shard_law(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per shard: its rows, and its first and last slot."""
    return op10_shards(spark, sf_dir).groupBy("law", "shard").agg(F.count(F.lit(1)).alias("n"), F.min("slot").alias("first_slot"), F.max("slot").alias("last_slot"), F.count_distinct("slot").alias("slots"))


def shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the shards hold of each document."""
    return op10_shards(spark, sf_dir).select("doc_id", "size")


def piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pieces of each text decode to, as a digest."""
    return op8_pieces(spark, sf_dir).select("doc_id", "decoded_sha256")


def token_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bytes of each text, and whether it has a token for at most each byte."""
    return op9_token_counts(spark, sf_dir).select("doc_id", "n_bytes", (F.col("n_tokens") <= F.col("n_bytes")).alias("fits"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_vector_dups": op1_vector_dups,
        "op2_toxicity": op2_toxicity,
        "op3_mix": op3_mix,
        "op4_media": op4_media,
        "op5_language": op5_language,
        "op6_quality": op6_quality,
        "op7_near_dups": op7_near_dups,
        "op8_pieces": op8_pieces,
        "op9_token_counts": op9_token_counts,
        "op10_shards": op10_shards,
        "op11_byte_pieces": op11_byte_pieces,
        "op12_repair": op12_repair,
        "op13_clusters": op13_clusters,
        "mix_targets": mix_targets,
        "shard_law": shard_law,
        "shard_rows": shard_rows,
        "piece_round_trip": piece_round_trip,
        "token_bytes": token_bytes,
    }


#: The components of links(a, b), as class(id, least).
_CLASSES = """both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(id, other) AS (SELECT a, a FROM both_ways UNION SELECT r.id, n.b FROM reach r JOIN both_ways n ON r.other = n.a),
class AS (SELECT id, min(other) AS least FROM reach GROUP BY id)"""


#: The cheapest repair, row by row: for each state the least (cost, audit) so far, with what is left.
_REPAIR = """WITH RECURSIVE t AS (SELECT list_transform(range(256), lambda n: list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS t),
keyed AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
hashed AS (SELECT *, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ord(c)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS h FROM keyed CROSS JOIN t),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE WHEN h = 1 THEN '' WHEN h = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
 unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hashed WHERE h <> 0),
numbered AS (SELECT *, dense_rank() OVER (ORDER BY conv_id NULLS FIRST) AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS i FROM damaged),
r AS (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 1 WHEN row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 THEN 2 WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') THEN 3 ELSE 0 END AS fault,
 lag(role) OVER (PARTITION BY c ORDER BY i) AS before FROM numbered),
ins(q, q2, cost, audit, lines) AS (VALUES (0, 0, 0, '', []::VARCHAR[]), (1, 1, 0, '', []), (2, 2, 0, '', []), (3, 3, 0, '', []), (0, 2, 3, 'I', ['user:']), (1, 2, 3, 'I', ['user:']), (3, 2, 3, 'I', ['user:']), (2, 3, 3, 'I', ['assistant:']),
 (0, 3, 6, 'II', ['user:', 'assistant:']), (1, 3, 6, 'II', ['user:', 'assistant:'])),
ops(q, q3, e, initial, cost) AS (VALUES (0, 0, 'D', NULL, 4), (1, 1, 'D', NULL, 4), (2, 2, 'D', NULL, 4), (3, 3, 'D', NULL, 4), (0, 1, 'K', 's', 0), (0, 2, 'K', 'u', 0), (1, 2, 'K', 'u', 0), (2, 3, 'K', 'a', 0), (3, 2, 'K', 'u', 0),
 (0, 2, 'R', NULL, 3), (1, 2, 'R', NULL, 3), (2, 3, 'R', NULL, 3), (3, 2, 'R', NULL, 3)),
dp AS (SELECT DISTINCT c, 0::BIGINT AS i, 0 AS q, {'cost': 0::BIGINT, 'audit': '', 'lines': []::VARCHAR[]} AS b FROM r
UNION ALL SELECT c, i, q3, min(b) FROM (SELECT dp.c, r.i, ops.q3, {'cost': dp.b.cost + ins.cost + ops.cost + CASE WHEN e <> 'D' AND fault = 3 THEN 3 ELSE 0 END, 'audit': dp.b.audit || ins.audit || e,
  'lines': list_concat(dp.b.lines, ins.lines, CASE e WHEN 'D' THEN [] WHEN 'K' THEN [role || ':' || text] ELSE [CASE WHEN q3 = 2 THEN 'user:' ELSE 'assistant:' END || text] END)} AS b
 FROM dp JOIN ins ON ins.q = dp.q JOIN r ON r.c = dp.c AND r.i = dp.i + 1 JOIN ops ON ops.q = ins.q2 AND (e = 'D' OR fault NOT IN (1, 2) AND (e = 'R' OR left(role, 1) = initial))) GROUP BY c, i, q3),
n AS (SELECT c, any_value(conv_id) AS conv_id, max(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 1) AS blank, count(*) FILTER (fault = 2) AS duplicate, count(*) FILTER (fault = 3) AS truncated,
 count(*) FILTER (before IS NOT NULL AND left(before, 1) || left(role, 1) NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c),
best AS (SELECT n.c, min({'cost': dp.b.cost + ins.cost, 'audit': dp.b.audit || ins.audit, 'lines': list_concat(dp.b.lines, ins.lines)}) AS b FROM dp JOIN n ON dp.c = n.c AND dp.i = n.n JOIN ins ON ins.q = dp.q AND ins.q2 IN (0, 3) GROUP BY n.c)
SELECT g.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
 coalesce(b.cost, 0) AS cost, coalesce(b.audit, '') AS audit, sha256(coalesce(array_to_string(b.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN n ON g.conv_id IS NOT DISTINCT FROM n.conv_id LEFT JOIN best ON best.c = n.c"""


def _rounds(rounds: int = 10, k: int = 8) -> str:
    """Rounds of centroids over all pairs of a vector and a centroid."""
    steps = []
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (SELECT id, any_value(v.v) AS v, min({{'d': list_sum(list_transform(list_zip(v.v, c{r}.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, 'k': k}}) AS b FROM v CROSS JOIN c{r} GROUP BY id)""")
        if r < rounds:
            steps.append(f"""m{r} AS (SELECT k, i, sum(x)::BIGINT AS s, count(*) AS n FROM (SELECT b.k AS k, unnest(v) AS x, unnest(range(64)) AS i FROM a{r}) GROUP BY k, i),
n{r} AS (SELECT k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM m{r} GROUP BY k),
c{r + 1} AS MATERIALIZED (SELECT c{r}.k, coalesce(n{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN n{r} ON n{r}.k = c{r}.k)""")
    return f"""WITH v AS MATERIALIZED (SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
 WHERE len(embedding) = 64 AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x)))),
c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY sha256('3:' || vec_id), v) - 1)::INTEGER AS k, v FROM v QUALIFY k < {k}),
{', '.join(steps)},
t AS (SELECT b.k AS k, sum(b.d)::BIGINT AS inertia FROM a{rounds} GROUP BY 1)
SELECT vec_id, t.k AS cluster, b.d AS distance, t.inertia AS cluster_inertia, (SELECT sum(inertia)::BIGINT FROM t) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN v USING (id) JOIN t ON t.k = a.b.k JOIN c{rounds} ON c{rounds}.k = t.k"""


def oracle_sql() -> dict[str, str]:
    """SQL of the operators that it can express: all pairs by cosine, and all pairs by shared runs of five words.

    Trained models, draws, merges of a tokenizer and local descriptors it can't.
    """
    return {
        "op1_vector_dups": f"""WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL AND list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]) > 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id AND len(x.v) = len(y.v) WHERE list_cosine_similarity(x.v, y.v) >= 0.93),
{_CLASSES}, n AS (SELECT a AS id, count(*) AS n FROM both_ways GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(least, vec_id) AS component_id, coalesce(least, vec_id) = vec_id AS kept FROM embeddings LEFT JOIN class ON class.id = vec_id LEFT JOIN n ON n.id = vec_id""",
        "op7_near_dups": f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS ws FROM documents),
runs AS (SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ') || ' .'] ELSE [] END) AS run FROM w),
e AS (SELECT doc_id, run, count(*) AS n FROM runs GROUP BY ALL), s AS (SELECT doc_id, sum(n) AS s FROM e GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, sum(least(x.n, y.n)) AS k FROM e x JOIN e y ON x.run = y.run AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE k / (x.s + y.s - k)::DOUBLE >= 0.8),
{_CLASSES}
SELECT doc_id, coalesce(least, doc_id) AS class_id, coalesce(least, doc_id) = doc_id AS kept FROM documents LEFT JOIN class ON class.id = doc_id""",
        "op12_repair": _REPAIR,
        "op13_clusters": _rounds(),
        "mix_targets": """WITH d AS (SELECT source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
l AS (SELECT *, cap / w::DOUBLE AS ratio, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
 / sum(w) OVER (ORDER BY cap / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::DOUBLE AS level FROM w),
m AS (SELECT max(level) AS level FROM l WHERE level <= ratio)
SELECT source, source_size, round(CASE WHEN m.level < ratio THEN m.level * w ELSE cap END, 4) AS target, true AS near FROM l CROSS JOIN m""",
        "shard_law": """WITH n AS (SELECT count(*) AS n FROM documents) SELECT 'rows' AS law, CAST(k AS INTEGER) AS shard, (n + 7 - k) // 8 AS n, 0 AS first_slot, (n + 7 - k) // 8 - 1 AS last_slot, (n + 7 - k) // 8 AS slots
FROM n CROSS JOIN (SELECT unnest(range(8)) AS k) WHERE k < n""",
        "shard_rows": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 AS size FROM documents",
        "piece_round_trip": "SELECT doc_id, sha256(coalesce(text, '')) AS decoded_sha256 FROM documents",
        "token_bytes": "SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n_bytes, true AS fits FROM documents",
    }
