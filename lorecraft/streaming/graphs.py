"""Streams: graphs kept up to date from arriving extractions, and event windows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


#: Batches after which their counts are merged into one version.
COMPACT = 20


def versions(spark: SparkSession, folder: str, prefix: str = "v") -> list[int]:
    """Numbers of the complete versions in a folder, ascending."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [s.getPath() for s in fs.listStatus(path)]
    done = [p.getName() for p in names if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(int(n[len(prefix) :]) for n in done if n.startswith(prefix) and n[len(prefix) :].isdigit())


def _state(spark: SparkSession, folder: str, upto: int) -> DataFrame | None:
    """The counts after batch ``upto``: the last whole version and the batches since."""
    whole = [v for v in versions(spark, folder) if v <= upto]
    since = [d for d in versions(spark, folder, "d") if (whole[-1] if whole else -1) < d <= upto]
    parts = [f"{folder}/v{v}" for v in whole[-1:]] + [f"{folder}/d{d}" for d in since]
    if not parts:
        return None
    return spark.read.parquet(*parts).groupBy("name").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def latest(spark: SparkSession, folder: str) -> DataFrame | None:
    """The counts (name, n, docs) after the last complete batch, or None."""
    return _state(spark, folder, 1 << 62)


def upsert_mentions(spark: SparkSession, batch: DataFrame, folder: str, epoch: int) -> None:
    """Writes the counts (name, n, docs) of a batch (name, doc, n) as delta ``epoch``.

    A batch that is run again writes the same rows. Every ``COMPACT`` batches the
    deltas become one version, so a batch costs what it brings, not what is known.
    """
    new = batch.groupBy("name").agg(F.sum("n").alias("n"), F.count_distinct("doc").alias("docs"))
    new.write.mode("overwrite").parquet(f"{folder}/d{epoch}")
    if (epoch + 1) % COMPACT == 0:
        _state(spark, folder, epoch).write.mode("overwrite").parquet(f"{folder}/v{epoch}")


def stream_mentions(spark: SparkSession, path: str, schema, folder: str, checkpoint: str, *, files_per_trigger: int = 1, id: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Follows a folder of Parquet documents and keeps the counts of their names; resumes from its checkpoint.

    A document must arrive once: counts of documents add up over batches.
    """
    from lorecraft.operators.mentions import name_mentions, sentence_table

    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

    def merge(batch: DataFrame, epoch: int) -> None:
        found = name_mentions(sentence_table(batch, id=id, text=text))
        upsert_mentions(spark, found.groupBy("name", "doc").agg(F.count(F.lit(1)).alias("n")), folder, epoch)

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


#: Columns of what a chunk says of entities and of relations.
ENTITY, RELATION = ["name", "type", "description", "doc", "pos"], ["source", "target", "description", "doc", "pos"]
KINDS = {"entities": ENTITY, "relations": RELATION}


def _first_arrivals(facts: DataFrame) -> DataFrame:
    """Facts of each document from the batch that it first came in, each once."""
    first = facts.groupBy("doc").agg(F.min("epoch").alias("epoch"))
    return facts.join(first, ["doc", "epoch"]).distinct()


def facts(spark: SparkSession, folder: str, kind: str, upto: int = 1 << 62) -> DataFrame | None:
    """What is known of ``entities`` or ``relations`` after batch ``upto``, or None: the last whole version and the batches since."""
    own = f"{folder}/{kind}"
    whole = [v for v in versions(spark, own) if v <= upto]
    since = [d for d in versions(spark, own, "d") if (whole[-1] if whole else -1) < d <= upto]
    parts = [f"{own}/v{v}" for v in whole[-1:]] + [f"{own}/d{d}" for d in since]
    return _first_arrivals(spark.read.parquet(*parts)) if parts else None


def upsert_graph(spark: SparkSession, entities: DataFrame, relations: DataFrame, folder: str, epoch: int) -> None:
    """Writes what a batch says (columns ``ENTITY`` and ``RELATION``) as delta ``epoch``.

    A batch that runs again writes the same delta. A document that comes again, in the same batch or a later one, changes nothing: it counts as it
    first came. Facts stay rows, so an entity that a third of all documents name is no long list. Every ``COMPACT`` batches
    the deltas become one version; a batch costs what it brings, not what is known.
    """
    for kind, rows in (("entities", entities), ("relations", relations)):
        own = f"{folder}/{kind}"
        rows.select(*KINDS[kind]).withColumn("epoch", F.lit(epoch).cast("bigint")).write.mode("overwrite").parquet(f"{own}/d{epoch}")
        if (epoch + 1) % COMPACT == 0:
            facts(spark, folder, kind, epoch).write.mode("overwrite").parquet(f"{own}/v{epoch}")


def graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame] | None:
    """Merged entities and relations of all batches so far, as ``merge_entities`` and ``merge_relations`` give them; None before the first."""
    from lorecraft.operators.graph import merge_entities, merge_relations

    known = [facts(spark, folder, kind) for kind in KINDS]
    return None if None in known else (merge_entities(known[0].drop("epoch")), merge_relations(known[1].drop("epoch")))


def stream_graph(spark: SparkSession, path: str, schema, extract: Callable[[DataFrame], tuple[DataFrame, DataFrame]], folder: str, checkpoint: str, *, files_per_trigger: int = 1) -> StreamingQuery:
    """Follows a folder of Parquet documents and keeps a graph of what ``extract`` finds in them; resumes from its checkpoint.

    ``extract`` makes entities and relations of documents; it runs once a batch, so what it asks of a model is stored as it came.
    """
    docs = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)

    def merge(batch: DataFrame, epoch: int) -> None:
        upsert_graph(spark, *extract(batch), folder, epoch)

    return docs.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def settled(events: DataFrame, *, key: str = "event_id", late: str = "1 hour") -> DataFrame:
    """A stream of events without the rows that come more than ``late`` after others, and without repeats of a key within that time.

    Repeats may differ in other columns; the first to come stays. A batch gives each key once.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if not events.isStreaming:
        return rows.dropDuplicates([key])
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def written(rows: DataFrame, folder: str, checkpoint: str) -> DataFrame:
    """What a stream has settled once it has read all that is there; it goes on from ``checkpoint`` when more has come."""
    rows.writeStream.format("parquet").outputMode("append").option("path", folder).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _has_watermark(rows: DataFrame) -> bool:
    return "EventTimeWatermark" in rows._jdf.queryExecution().analyzed().toString()


def event_windows(events: DataFrame, *, size: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total): tumbling windows, for batches and streams alike."""
    rows = events if dict(events.dtypes)["ts"] == "timestamp" else events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming and not _has_watermark(events):
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.window("ts", size).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def user_sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user_id, session_start, n): a user's events without a longer gap."""
    rows = events if dict(events.dtypes)["ts"] == "timestamp" else events.withColumn("ts", F.col("ts").cast("timestamp"))
    if events.isStreaming and not _has_watermark(events):
        rows = rows.withWatermark("ts", late)
    grouped = rows.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return grouped.select("user_id", F.col("w.start").alias("session_start"), "n")
