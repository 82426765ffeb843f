"""Readers and writers of the formats that corpora, graphs and datasets come in."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorecraft.functions import text as X


def read_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Entities and relations of a saved graph; of parallel relations the last one."""
    from lorecraft.operators.graph import last_edges

    return spark.read.parquet(f"{folder}/entities.parquet"), last_edges(spark.read.parquet(f"{folder}/relations.parquet"))


def write_graph(entities: DataFrame, relations: DataFrame, folder: str) -> None:
    """Two Parquet tables; a new version goes to a new folder, none is rewritten in place."""
    entities.write.parquet(f"{folder}/entities.parquet")
    relations.write.parquet(f"{folder}/relations.parquet")


def read_corpus(spark: SparkSession, path: str, field: str = "input", limit: int | None = None) -> DataFrame:
    """(line, field) of JSON lines (gzip too), without blank ones; ``limit`` keeps the first lines of one file."""
    lines = read_lines(spark, path, T.StructType([T.StructField(field, T.StringType())]))
    return lines if limit is None else lines.orderBy("file", "line").limit(limit)


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(file, line, fields) of JSON lines; control characters are deleted, lines that aren't JSON objects are left out.

    An object stays if all its fields are null or missing, as does one with a field of another type (which becomes null).
    """
    raw = spark.read.text(path).select(F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"), X.without_controls(F.col("value")).alias("value"))
    verdict = T.StructType([*schema, T.StructField("__corrupt", T.StringType())])
    parsed = raw.where(F.length(F.trim("value")) > 0).withColumn("r", F.from_json("value", verdict, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__corrupt"}))
    some = F.coalesce(*[F.col(f"r.{f.name}").cast("string") for f in schema]).isNotNull()
    return parsed.where("r IS NOT NULL").where(some | F.col("r.__corrupt").isNull()).select("file", "line", *[F.col(f"r.{f.name}") for f in schema])


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """(doc, chunk, content) of a JSON list of lists of {content}; blank chunks are left out."""
    kind = T.ArrayType(T.ArrayType(T.StructType([T.StructField("content", T.StringType())])))
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", kind).alias("docs"))
    chunks = whole.select(F.posexplode("docs").alias("doc", "chunks")).select("doc", F.posexplode("chunks").alias("chunk", "c"))
    return chunks.select("doc", "chunk", X.without_nulls(F.col("c.content")).alias("content")).where(F.length(F.trim("content")) > 0)


def read_keyed(rows: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key: the last in ``order``."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def read_json_or_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document, or JSON lines if the whole isn't one."""
    whole = spark.read.json(path, multiLine=True)
    return spark.read.json(path) if "_corrupt_record" in whole.columns else whole


def read_dimension(spark: SparkSession, path: str) -> DataFrame:
    """A CSV table with a header; empty fields are null."""
    return spark.read.csv(path, header=True)


def read_texts(spark: SparkSession, folder: str, pattern: str = "*.txt") -> DataFrame:
    """(file_name, body) of the text files of a folder."""
    return spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True).select(F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("body"))


def read_shards(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(shard, fields) of JSON files or folders named ``..._<number>.json``; order by ``shard`` is numeric."""
    rows = spark.read.schema(schema).json(path, multiLine=True)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"([0-9]+)\.json(?:/[^/]*)?$", 1)
    return rows.select(number.cast("int").alias("shard"), "*")


def write_lines(rows: DataFrame, path: str, *, compress: bool = False, append: bool = False) -> None:
    """JSON lines, gzipped or appended if asked."""
    rows.write.mode("append" if append else "errorifexists").json(path, compression="gzip" if compress else "none")


def write_shards(rows: DataFrame, path: str, *order: str, size: int = 10_000) -> None:
    """JSON lines in a folder for each shard of ``size`` rows."""
    from lorecraft.operators.instruct import numbered_shards

    numbered_shards(rows, *order, size=size).repartition("shard").write.partitionBy("shard").json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.csv(path, header=True)


def write_sections(files: DataFrame, path: str) -> None:
    """A text per row of (file_name, body) in a folder named by the file."""
    files.select("file_name", "body").write.partitionBy("file_name").text(path)


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """(file_name, body) of what ``write_sections`` wrote."""
    return spark.read.schema("body string, file_name string").text(path, wholetext=True).select("file_name", F.regexp_replace("body", "\n$", "").alias("body"))


def with_section(files: DataFrame, title: str, text: str, body: str = "body") -> DataFrame:
    """``files`` with ``**title**`` and the text of a column after the body; rows where it is null stay."""
    added = F.concat(F.col(body), F.lit(f"\n**{title}**\n"), F.col(text))
    return files.withColumn(body, F.coalesce(added, F.col(body)))


def interactions(rows: DataFrame) -> DataFrame:
    """(id, block): log blocks of (id, type, question, answer), to be parsed again by ``parse.log_record``."""
    from lorecraft.functions.parse import RULE

    field = lambda n: F.coalesce(F.col(n).cast("string"), F.lit(""))
    return rows.select(
        "id", F.concat(F.lit("Id: "), field("id"), F.lit("\nType: "), field("type"), F.lit("\nQuestion: "), field("question"), F.lit("\nAnswer: "), field("answer"), F.lit(f"\n{RULE}\n")).alias("block")
    )


def write_array(rows: DataFrame, path: str) -> None:
    """One JSON array in one text file, for datasets small enough for one task; others take ``write_lines``."""
    one = rows.select(F.to_json(F.struct(*rows.columns)).alias("j")).coalesce(1).agg(F.concat(F.lit("["), F.array_join(F.collect_list("j"), ",\n"), F.lit("]")).alias("value"))
    one.write.text(path)


def read_arrow(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of Arrow IPC files (file or stream format) with the given columns."""
    return from_arrow(spark.read.format("binaryFile").load(path), schema)


def from_arrow(files: DataFrame, schema: T.StructType, content: str = "content") -> DataFrame:
    """Rows of the Arrow IPC data in a binary column."""
    names = schema.names

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                data = pa.BufferReader(value.as_buffer())
                try:
                    found = pa.ipc.open_file(data)
                    yield from (found.get_batch(i).select(names) for i in range(found.num_record_batches))
                except pa.ArrowInvalid:
                    data.seek(0)
                    yield from (b.select(names) for b in pa.ipc.open_stream(data))

    return files.select(content).where(F.col(content).isNotNull()).mapInArrow(rows, schema)


def to_arrow(rows: DataFrame) -> DataFrame:
    """(content): the rows as Arrow IPC streams, one for each batch."""

    def streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as w:
                w.write_batch(batch)
            yield pa.record_batch([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["content"])

    return rows.mapInArrow(streams, "content binary")


def write_intervals(rows: DataFrame, path: str, *order: str, every: int = 2000) -> None:
    """JSON lines in a folder ``upto=N`` for each ``every`` rows; all up to N are the state after N rows."""
    from lorecraft.operators.graph import dense_ids

    placed = dense_ids(rows, *order, name="__id").withColumn("upto", (F.floor(F.col("__id") / every) + 1) * every).drop("__id")
    placed.repartition("upto").write.partitionBy("upto").json(path)


def read_interval(spark: SparkSession, path: str, schema: T.StructType, upto: int | None = None) -> DataFrame:
    """What ``write_intervals`` had written after ``upto`` rows; all without it."""
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("upto", T.LongType())])).json(path)
    return (rows if upto is None else rows.where(F.col("upto") <= upto)).drop("upto")


def write_version(rows: DataFrame, folder: str) -> int:
    """Writes ``rows`` as the next version of a Parquet table; versions before it stay. Returns its number."""
    from lorecraft.streaming.graphs import versions

    number = max(versions(rows.sparkSession, folder), default=0) + 1
    rows.write.parquet(f"{folder}/v{number}")
    return number


def read_version(spark: SparkSession, folder: str, number: int | None = None) -> DataFrame:
    """A version of a table; the last complete one unless told."""
    from lorecraft.streaming.graphs import versions

    return spark.read.parquet(f"{folder}/v{max(versions(spark, folder)) if number is None else number}")


def write_results(predictions: DataFrame, metrics: DataFrame, folder: str) -> None:
    """Predictions as CSV and metrics as JSON, in two folders."""
    write_csv(predictions, f"{folder}/predictions")
    metrics.coalesce(1).write.json(f"{folder}/metrics")


def stream_lines(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the JSON lines of a folder as its files arrive; blank lines and those that can't be read are left out."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_trigger).text(path).select(X.without_controls(F.col("value")).alias("value"))
    parsed = raw.where(F.length(F.trim("value")) > 0).withColumn("r", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    return parsed.where(F.coalesce(*[F.col(f"r.{f.name}").cast("string") for f in schema]).isNotNull()).select("r.*")
