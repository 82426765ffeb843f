"""Vectors: cosine as an expression, and similarity joins in blocks with matrix products.

Blocks are made around pivots, a bounded sample of the vectors. Angles obey the triangle
inequality, so two blocks whose pivots are farther apart than their radii and the
threshold's angle together hold no similar pair and don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecraft.session import ensure_checkpoint_dir, ship_package

#: Rows of a block; two blocks and their product are what a task holds.
BLOCK = 1024
#: Vectors of a part of a group, about; two parts meet in one task, block by block.
PART = 16384
#: Vectors that blocks are made around, in all.
PIVOTS = 128
#: Rows of a cell of a search, about, and cells, at most.
CELL, CELLS = 4096, 1024
#: Share of the lengths' product that a dot product may differ by, for the order of its sum.
SLACK = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine in double precision; null where a vector is null or zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def unit(v: Column) -> Column:
    """The vector at length one, in doubles; null if it is null, empty or zero."""
    norm = F.nullif(F.sqrt(dot(v, v)), F.lit(0.0))
    scaled = F.transform(F.array(norm), lambda n: F.when(n.isNotNull(), F.transform(v, lambda x: x.cast("double") / n)))  # the norm once
    return scaled[0]


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_list())


def _cells(rows: DataFrame, pivots: np.ndarray, width: int) -> DataFrame:
    """``rows`` (v, ...) with the nearest pivot and the angle to it; vectors of another length are by themselves."""
    if len(pivots) == 1:  # all in one cell
        return rows.select("*", F.when(F.size("v") == width, 0).otherwise(-1).alias("cell"), F.lit(float(np.pi)).alias("angle"))
    shared = rows.sparkSession.sparkContext.broadcast(pivots)

    @F.pandas_udf("struct<cell:int,angle:double>")
    def nearest_pivot(v: pd.Series) -> pd.DataFrame:
        cell, angle = np.full(len(v), -1), np.full(len(v), np.pi)
        here = np.flatnonzero(v.map(len).to_numpy() == width)
        for at in np.array_split(here, max(1, len(here) // 4096)):
            if len(at):
                s = _matrix(v.iloc[at]) @ shared.value.T
                cell[at] = s.argmax(1)
                angle[at] = np.arccos(np.clip(s.max(1), -1, 1))
        return pd.DataFrame({"cell": cell, "angle": angle})

    return rows.withColumn("__p", nearest_pivot("v")).select("*", "__p.cell", "__p.angle").drop("__p")


def similar_pairs(df: DataFrame, *, id: str, vector: str, group: str, threshold: float, block: int = BLOCK) -> DataFrame:
    """(a, b, similarity) of vectors of the same group and length with a < b and a cosine of ``threshold`` or more.

    Rows with a null group or vector take no part. Blocks meet in pairs of a group,
    so a group that holds most rows is more tasks, not a longer one; only those meet that can
    hold a similar pair.
    """
    spark = df.sparkSession
    ship_package(spark)
    rows = df.select(F.col(id).alias("id"), F.col(group).alias("g"), unit(F.col(vector)).alias("v")).where("g IS NOT NULL AND v IS NOT NULL")
    wanted = max(1, min(PIVOTS, rows.count() // (2 * block)))  # blocks stay about full
    sample = rows.orderBy(F.xxhash64("id"), "id").limit(wanted).select("v").collect()  # the same in each run
    if not sample:
        return spark.createDataFrame([], "a bigint, b bigint, similarity double")
    width = max(len(r["v"]) for r in sample)
    pivots = np.array([r["v"] for r in sample if len(r["v"]) == width], float).reshape(-1, width)
    placed = _cells(rows, pivots, width).withColumn("d", F.size("v"))
    if len(pivots) > 1:
        ensure_checkpoint_dir(spark)
        placed = placed.checkpoint()  # read several times
    counts = placed.groupBy("g", "d", "cell").agg(F.count(F.lit(1)).alias("n"), F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = placed.join(counts.drop("n"), ["g", "d", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    left = dealt.groupBy("g", "d", "cell", "block").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vectors"), F.max("angle").alias("radius"))
    # blocks of a group are dealt to parts and each two parts are a key of the join: a block moves as often as its group has parts, not cells
    parts = counts.groupBy("g", "d").agg(F.ceil(F.sum("n") / PART).cast("int").alias("parts"))
    shared = left.join(parts, ["g", "d"]).withColumn("part", F.pmod(F.xxhash64("cell", "block"), "parts").cast("int"))
    ones = shared.withColumn("part2", F.explode(F.sequence("part", F.col("parts") - 1))).drop("parts")
    others = shared.select("g", "d", F.explode(F.sequence(F.lit(0), "part")).alias("part"), F.col("part").alias("part2"), F.col("cell").alias("cell2"), F.col("block").alias("other"), F.col("ids").alias("ids2"), F.col("vectors").alias("vectors2"), F.col("radius").alias("radius2"))
    angles = np.arccos(np.clip(pivots @ pivots.T, -1, 1))
    apart = [(-1, -1, 0.0)] + [(i, j, float(angles[i, j])) for i in range(len(pivots)) for j in range(len(pivots))]
    gaps = spark.createDataFrame(apart, "cell int, cell2 int, gap double")  # at most PIVOTS squared rows
    reach = float(np.arccos(np.clip(threshold, -1, 1))) + 1e-9
    once = (F.col("part") < F.col("part2")) | (F.struct("cell", "block") <= F.struct("cell2", "other"))
    met = ones.join(others, ["g", "d", "part", "part2"]).where(once).join(F.broadcast(gaps), ["cell", "cell2"]).where(F.col("gap") - F.col("radius") - F.col("radius2") <= reach)

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                s = np.stack(r.vectors) @ np.stack(r.vectors2).T
                i, j = np.nonzero(s >= threshold)
                a, b = np.asarray(r.ids)[i], np.asarray(r.ids2)[j]
                keep = a < b if (r.cell, r.block) == (r.cell2, r.other) else a != b
                yield pd.DataFrame({"a": np.minimum(a, b)[keep], "b": np.maximum(a, b)[keep], "similarity": s[i, j][keep]})

    return met.mapInPandas(products, "a bigint, b bigint, similarity double")


def _placed(rows: DataFrame, pivots: np.ndarray) -> DataFrame:
    """``rows`` (v, ...) with the nearest pivot (``cell``), the distance to it and ``d``, the length; -1 for other lengths than the pivots'."""
    shared, squares = rows.sparkSession.sparkContext.broadcast(pivots), (pivots**2).sum(1)
    width = pivots.shape[1]

    @F.pandas_udf("struct<cell:int,away:double>")
    def nearest_pivot(v: pd.Series) -> pd.DataFrame:
        cell, away = np.full(len(v), -1), np.zeros(len(v))
        here = np.flatnonzero(v.map(len).to_numpy() == width)
        for at in np.array_split(here, max(1, len(here) // 1024)):
            if len(at):
                x = _matrix(v.iloc[at])
                cell[at] = (squares - 2 * (x @ shared.value.T)).argmin(1)
                away[at] = np.linalg.norm(x - shared.value[cell[at]], axis=1)
        return pd.DataFrame({"cell": cell, "away": away})

    return rows.withColumn("__p", nearest_pivot.asNondeterministic()("v")).select("*", F.size("v").alias("d"), "__p.cell", "__p.away").drop("__p")


def _dealt(placed: DataFrame, block: int) -> DataFrame:
    """Blocks (d, cell, block, ids, vectors, radius) of about ``block`` rows, by a hash."""
    counts = placed.groupBy("d", "cell").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = placed.join(counts, ["d", "cell"]).withColumn("block", F.pmod(F.xxhash64("id"), "blocks").cast("int"))
    return dealt.groupBy("d", "cell", "block").agg(F.collect_list("id").alias("ids"), F.collect_list("v").alias("vectors"), F.max("away").alias("radius"))


def _best(q: np.ndarray, ids: np.ndarray, v: np.ndarray, k: int | None, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, similarity) of each query's ``k`` best rows (None: of all) at its ``least`` or more; ties go to the smaller id."""
    s = q @ v.T
    slack = SLACK * np.linalg.norm(q, axis=1) * np.linalg.norm(v, axis=1).max()
    edge = least
    if k is not None:
        n = min(k, s.shape[1])
        edge = np.maximum(least, np.partition(s, s.shape[1] - n, axis=1)[:, s.shape[1] - n])
    i, j = np.nonzero(s >= (edge - slack)[:, None])
    exact = np.einsum("ij,ij->i", q[i], v[j])  # the same for equal vectors, wherever they are
    keep = exact >= least[i]
    i, j, exact = i[keep], j[keep], exact[keep]
    if k is not None:
        order = np.lexsort((ids[j], -exact, i))
        i, j, exact = i[order], j[order], exact[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j, exact = i[first], j[first], exact[first]
    return i, j, exact


def nearest(queries: DataFrame, corpus: DataFrame, *, query_id: str, query: str, id: str, vector: str, k: int | None, threshold: float | None = None, block: int = BLOCK, scaled: bool = True) -> DataFrame:
    """(query, id, similarity, rank) of the ``k`` most similar rows of ``corpus`` for each query; None: of all at ``threshold`` or more.

    Similarity is the cosine, or the dot product of vectors as they are if not ``scaled``. Ties go to the smaller id; ``threshold`` (inclusive) applies after the ranking.
    Vectors that are null, hold null or non-finite components or (if scaled) are zero take no part; others meet those of their own length.
    An id that repeats is as many rows.

    The result is exact. Corpus and queries lie in cells around pivots. A first pass meets one block of a query's own cell, whose ``k``-th
    best is a score to beat. No row of a cell can score more than the pivot's dot product and the query's norm times the
    cell's radius, so a second pass leaves out cells where that reaches the score to beat for no query of a block.
    """
    return _nearest(queries, corpus, query_id, query, id, vector, k, threshold, block, scaled)[0]


def _nearest(queries: DataFrame, corpus: DataFrame, query_id: str, query: str, id: str, vector: str, k: int | None, threshold: float | None, block: int, scaled: bool) -> tuple[DataFrame, DataFrame]:
    """The ranked rows, and the blocks of queries with the cells that they meet (``open``)."""
    spark = queries.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    value = unit if scaled else (lambda v: v.cast("array<double>"))
    finite = F.forall("v", lambda x: F.abs(x) < float("inf"))  # null and NaN aren't
    rows = lambda df, i, v: df.select(F.col(i).alias("id"), value(F.col(v)).alias("v")).where((F.size("v") > 0) & finite)
    found = rows(corpus, id, vector)
    cells = max(1, min(CELLS, found.count() // CELL))
    sample = [r["v"] for r in found.orderBy(F.xxhash64("id"), "id").limit(4 * cells).select("v").collect()]  # bounded
    lengths = [len(v) for v in sample]
    width = max(set(lengths), key=lambda n: (lengths.count(n), n)) if sample else 1
    full = [v for v in sample if len(v) == width]
    pivots = np.array(full[:cells] or [[0.0]], float)
    c = _dealt(_placed(found, pivots), block).checkpoint()  # read several times
    radius = np.full(len(pivots), -1.0)
    for r in c.where("cell >= 0").groupBy("cell").agg(F.max("radius").alias("radius")).collect():  # at most CELLS rows
        radius[r["cell"]] = r["radius"]
    asked = _dealt(_placed(rows(queries, query_id, query), pivots), block).select("d", "cell", F.col("block").alias("q_block"), F.col("ids").alias("qids"), F.col("vectors").alias("qvectors"))
    floor = -np.inf if threshold is None else threshold

    shared = spark.sparkContext.broadcast((pivots, radius, np.linalg.norm(pivots, axis=1)))

    def opened(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, around, lengths = shared.value
        for batch in batches:
            for r in batch.itertuples():
                q, least, cells = np.stack(r.qvectors), np.full(len(r.qids), floor), [-1]
                norms = np.linalg.norm(q, axis=1)
                if k is not None and r.vectors is not None and len(r.vectors) >= k:
                    v = np.stack(r.vectors)
                    slack = SLACK * norms * np.linalg.norm(v, axis=1).max()
                    least = np.maximum(least, np.partition(q @ v.T, len(v) - k, axis=1)[:, len(v) - k] - slack)
                if r.d == centres.shape[1]:
                    bound = q @ centres.T + norms[:, None] * (around + SLACK * (lengths + around))
                    cells = np.flatnonzero(((bound >= least[:, None]) & (around >= 0)).any(0))
                yield pd.DataFrame({"qids": [r.qids], "qvectors": [r.qvectors], "least": [least], "open": [[(int(r.d), int(x)) for x in cells]]})

    first = asked.join(c.where("block = 0").select("d", "cell", "vectors"), ["d", "cell"], "left")
    ready = first.mapInPandas(opened, "qids array<bigint>, qvectors array<array<double>>, least array<double>, open array<struct<d:int,cell:int>>").checkpoint()
    met = ready.join(c.select("d", "cell", "ids", "vectors"), F.array_contains("open", F.struct("d", "cell"))).select("qids", "qvectors", "least", "ids", "vectors")  # blocks, not rows

    def products(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples():
                ids = np.asarray(r.ids)
                i, j, s = _best(np.stack(r.qvectors), ids, np.stack(r.vectors), k, np.asarray(r.least))
                yield pd.DataFrame({"query": np.asarray(r.qids)[i], "id": ids[j], "similarity": s})

    ranked = met.mapInPandas(products, "query bigint, id bigint, similarity double").withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("similarity"), "id")))
    return (ranked if k is None else ranked.where(F.col("rank") <= k)), ready
