"""Two-pass external shuffle of whole rows into shards of equal row counts, in DataFrame operations.

Pass one gives every row a seeded hash and scatters the rows uniformly into buckets
that fit a task's memory, whatever a row holds: short and empty rows count too. Pass two shuffles each bucket by Fisher-Yates (Spark's
``shuffle`` of an array), deals the buckets, one after the other, to the shards and
writes these as Parquet. The position of a row in the whole shuffled order decides:
shard = position mod shards, slot = position div shards. So the law is ``rows``:
counts differ by one at most, slots are gapless.

Equal rows are counted before the scatter and told apart by their copy number,
so a row repeated for a third of the table still spreads over all buckets. Only rows
whose hash is in a slot that holds equal rows take that way, the others move once. The
result depends on the rows and the seed only, not on how the input was split.
The input is read several times and must give the same rows each time (else an
error): checkpoint one that doesn't. A very long text is a record like others: a bucket is as large as its records, at least one. Nulls are values like others; an empty table gives
an empty result; input columns named like a result are replaced. Columns must be orderable (no maps).
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DataType, StringType, StructType
from pyspark.sql.window import Window

from lorecraft.llm.mixing import numbered
from lorecraft.session import ensure_checkpoint_dir

RESULTS = ("law", "shard", "slot", "grown_shard")
#: Slots of row hashes by which rows without equals are told, in a broadcast table.
SLOTS = 1 << 16


def record_bytes(df: DataFrame) -> Column:
    """The bytes of a row in a task's memory, about: 64, what texts and bytes hold, and 16 for each value beside."""

    def of(name: str, kind: DataType) -> Column:
        c = F.col(f"`{name}`")
        if isinstance(kind, (StringType, BinaryType)):
            return F.octet_length(c)
        if isinstance(kind, ArrayType):
            texts = isinstance(kind.elementType, (StringType, BinaryType))
            return F.size(c) * 16 + (F.aggregate(c, F.lit(0).cast("bigint"), lambda n, x: n + F.coalesce(F.octet_length(x), F.lit(0))) if texts else 0)
        return F.octet_length(F.to_json(F.struct(c))) if isinstance(kind, StructType) else F.lit(16)

    out = F.lit(64).cast("bigint")
    for field in df.schema.fields:
        out = out + F.coalesce(of(field.name, field.dataType), F.lit(0)).cast("bigint")
    return out


def external_shuffle(
    df: DataFrame, *, shards: int = 8, seed: int = 7, bucket_bytes: int = 32 << 20, path: str | None = None
) -> DataFrame:
    """``df`` with ``law``, ``shard`` (0 to ``shards`` - 1), ``slot`` and ``grown_shard`` (null here), read from the shards.

    Buckets hold about ``bucket_bytes`` of records (raise it with the input: 1 GiB for 100 TB). The shards are
    folders ``shard=0``, ... of ``path``, a new folder beside the checkpoints if None; a
    shard's files hold its rows by slot, in the order of their names.
    """
    spark = df.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark)}/shards-{uuid.uuid4().hex}"
    columns = [c for c in df.columns if c not in RESULTS]
    keyed = df.select(*columns).withColumn("__key", F.xxhash64(F.lit(seed), F.lit(1).cast("bigint"), *columns))
    total = df.agg(F.coalesce(F.sum(record_bytes(df.select(*columns))), F.lit(0))).first()[0]
    buckets = max(1, -(-int(total) // bucket_bytes))
    slot_of = F.pmod("__key", F.lit(SLOTS)).alias("__equal")
    # at most SLOTS rows; other rows that share a slot with equal ones are counted too, and are once there
    equal = keyed.groupBy("__key").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(slot_of).distinct().checkpoint()
    several = equal.count()
    one = keyed.withColumn("__copy", F.lit(1).cast("bigint")).withColumnRenamed("__key", "__hash")
    if several:
        flagged = keyed.withColumn("__equal", slot_of)
        one = flagged.join(F.broadcast(equal), "__equal", "left_anti").select(*columns, F.col("__key").alias("__hash"), F.lit(1).cast("bigint").alias("__copy"))
        copies = flagged.join(F.broadcast(equal), "__equal", "left_semi").groupBy(*columns).agg(F.count(F.lit(1)).alias("__n"))
        copies = numbered(copies, "__n", "__copy")
        one = one.unionByName(copies.drop("__n").withColumn("__hash", F.xxhash64(F.lit(seed), "__copy", *columns)))
    placed = one.withColumn("__bucket", F.pmod(F.col("__hash"), F.lit(buckets)).cast("int"))
    before = Window.orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    counted = placed.groupBy("__bucket").agg(F.count(F.lit(1)).alias("__rows")).checkpoint()
    starts = counted.select("__bucket", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    record = F.struct("__hash", "__copy", *columns)
    shuffled = (
        # partition = bucket: the generator of each bucket starts from seed + bucket, whatever runs where
        placed.repartitionById(buckets, F.col("__bucket"))
        .groupBy("__bucket")
        .agg(F.sort_array(F.collect_list(record)).alias("__rows"))
        .select("__bucket", F.posexplode(F.shuffle("__rows", seed)).alias("__at", "__row"))
    )
    position = F.col("__start") + F.col("__at")
    # as many rows as buckets: a broadcast, so that rows don't move again
    dealt = shuffled.join(F.broadcast(starts), "__bucket").select(
        *[F.col("__row")[c].alias(c) for c in columns],
        F.lit("rows").alias("law"),
        (position % shards).cast("int").alias("shard"),
        F.floor(position / shards).cast("bigint").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    dealt.sortWithinPartitions("shard", "slot").write.partitionBy("shard").option("compression", "zstd").parquet(path)
    written = spark.read.schema(dealt.schema).parquet(path).select(*dealt.columns)
    rows = counted.agg(F.coalesce(F.sum("__rows"), F.lit(0))).first()[0]
    if written.count() != rows:
        raise ValueError("the input gave other rows when read again; checkpoint it")
    return written
