"""Connected components of an edge table."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorecraft.session import Settled, release


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, component`` for every vertex with an edge to another; a component is its least id.

    Each round takes the least label among a vertex and its neighbours and then
    jumps to the label of that label, so rounds grow with the logarithm of the
    longest path. Rounds end with a table of the labels, which cuts the plan and has its real size; the driver sees
    one count a round. Loops, repeats and nulls among the edges are ignored.
    """
    spark = edges.sparkSession
    e = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    table = Settled(e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    links = table.rows
    labels = links.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("component"))
    last = Settled(labels)
    for round_ in count(1):
        labels = last.rows.select("id", "component")
        near = links.join(labels.select(F.col("id").alias("b"), "component"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("m"))
        better = labels.join(near, "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("c"))
        target = better.select(F.col("id").alias("c"), F.col("c").alias("component"))
        new = Settled(better.join(target, "c").select("id", "old", "component"))
        last.discard()
        last = new
        moved = new.rows.where("old <> component").count()
        del near, better, target
        if not moved or round_ % 3 == 0:
            release(spark)
        if not moved:
            table.discard()
            return new.rows.select("id", "component")
