"""Bounded samples of labelled documents, without moving the texts of the others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType
from pyspark.sql.window import Window

#: Characters of the texts of one class in a sample, about.
CHARS = 8_000_000


def binary_labels(docs: DataFrame, labels: DataFrame, key: str, label: str) -> DataFrame:
    """Rows (``key``, ``label``) of the documents that have a label 0 or 1; others are none."""
    return docs.select(key).join(labels.where(F.col(label).isin(0, 1)).select(key, F.col(label).cast("int").alias(label)), key)


def labelled_sample(docs: DataFrame, known: DataFrame, *, key: str, text: str, label: str, per_class: int, chars: int = CHARS) -> tuple[list[str], list, dict]:
    """Texts and labels of at most ``per_class`` documents of each class, and the rows of each class in all.

    ``known`` has rows (``key``, ``label``). Documents are chosen by a hash of the key within
    their class, from keys and labels alone, so copies of a text count as what they are
    and a large class pushes out no other. Only the chosen keys are broadcast to fetch their
    texts, each key once. Texts beyond ``chars`` characters of a class, in the
    order of the hash, stay out; the first of a class always stays.
    """
    spark = docs.sparkSession
    counts = known.groupBy(label).agg(F.count(F.lit(1)).alias("__rows"), F.approx_count_distinct(key).alias("__keys")).collect()
    rows = {r[label]: r["__rows"] for r in counts}
    if not rows:
        return [], [], {}
    shares = spark.createDataFrame([(r[label], min(1.0, (1.5 * per_class + 50) / max(r["__keys"], 1))) for r in counts], f"`{label}` {known.schema[label].dataType.simpleString()}, __share double")
    chance = F.xxhash64(key, F.lit(17))
    hashed = known.join(F.broadcast(shares), label).where(F.pmod(chance, F.lit(1 << 30)) < F.col("__share") * (1 << 30)).select(key, label).distinct()
    in_class = Window.partitionBy(label).orderBy("__chance", key)
    chosen = hashed.withColumn("__chance", chance).withColumn("__rank", F.row_number().over(in_class)).where(F.col("__rank") <= per_class).select(key, label, "__rank").collect()
    wanted = spark.createDataFrame([tuple(r) for r in chosen], known.select(key, label).schema.add("__rank", IntegerType()))
    on = [key, label] if label in docs.columns else [key]
    value = F.coalesce(F.col(text).cast("string"), F.lit("")).alias("__text")
    found = docs.select(*on, value).join(F.broadcast(wanted), on).dropDuplicates([key, label])
    before = F.sum(F.length("__text")).over(Window.partitionBy(label).orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1))
    kept = found.withColumn("__before", F.coalesce(before, F.lit(0))).where(F.col("__before") < chars).select("__text", label).collect()
    return [r["__text"] for r in kept], [r[label] for r in kept], rows
