"""Classes of items that share buckets and pass a test of pairs, without all pairs of a bucket."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorecraft.operators.components import connected_components
from lorecraft.session import release


def shared_members(bucketed: DataFrame) -> DataFrame:
    """Rows of (bucket, item, ...) in buckets with more than one item."""
    shared = bucketed.groupBy("bucket").agg(F.min("item").alias("low"), F.max("item").alias("top")).where("low < top").select("bucket")
    return bucketed.join(shared, "bucket").checkpoint()


def link_classes(members: DataFrame, verified: Callable[[DataFrame], DataFrame], *, least: int = 1) -> DataFrame:
    """``id, component`` of all items that are linked to another.

    ``members`` has rows (bucket, item). Items are candidates if they share ``least`` buckets or more.
    ``verified`` gets pairs (a, b), a < b, and returns those that are links. The hub of a
    bucket is its item with most buckets. First each item is tested against the hub that it
    meets most often; then, in buckets that hold several components, items against the hub of
    another; then, in those that still do, candidates of different components against each
    other. Pairs within a component need no test: they can't change it. So every
    candidate pair that could join two classes is tested, and a group of thousands of
    copies costs a few pairs a copy.
    """
    spark = members.sparkSession
    met = members.groupBy("item").agg(F.count(F.lit(1)).alias("met"))
    hubs = members.join(met, "item").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("item")).alias("i"))).alias("top"))
    members = members.join(hubs.select("bucket", "top.met", (-F.col("top.i")).alias("hub")), "bucket").checkpoint()
    release(spark)
    pair = [F.least("item", "hub").alias("a"), F.greatest("item", "hub").alias("b")]
    often = members.where("item <> hub").groupBy("item", "hub", "met").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    greatest = often.groupBy("item").agg((-F.max(F.struct("n", "met", (-F.col("hub")).alias("h")))["h"]).alias("hub"))
    tested = greatest.select(*pair).distinct().checkpoint()
    links = verified(tested).checkpoint()

    def placed(links: DataFrame) -> DataFrame:
        """Members with their component so far, in buckets that hold several."""
        joined = connected_components(links, "a", "b").withColumnRenamed("id", "item")
        rows = members.join(joined, "item", "left").withColumn("c", F.coalesce("component", "item")).drop("component", "met")
        several = rows.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
        rows = rows.join(several, "bucket").checkpoint()
        release(spark)
        return rows

    rows = placed(links)
    heads = rows.where("item = hub").select("bucket", F.col("c").alias("hub_c"))
    stars = rows.join(heads, "bucket").where("item <> hub AND c <> hub_c").select(*pair).groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n").join(tested, ["a", "b"], "left_anti").checkpoint()
    links = links.unionByName(verified(stars)).checkpoint()
    tested = tested.unionByName(stars)

    rows = placed(links)
    rows = rows.join(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("item"), "item").checkpoint()
    side = lambda s: rows.select("bucket", *[F.col(c).alias(f"{c}{s}") for c in ("item", "c")])
    cross = side("_x").join(side("_y"), "bucket").where("item_x < item_y AND c_x <> c_y").groupBy(F.col("item_x").alias("a"), F.col("item_y").alias("b")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).drop("n")
    return connected_components(links.unionByName(verified(cross.join(tested, ["a", "b"], "left_anti"))).checkpoint(), "a", "b")
