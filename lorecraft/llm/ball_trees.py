"""Exact k-means rounds over ball trees.

Vectors become whole numbers, floor(``scale`` times a component), so sums and squared distances are exact and
a rerun gives the same clusters. Each partition's vectors are cut into trees of at most ``TREE`` vectors: a node
(ball) has a centre, a radius, a count and the integer sum of its vectors. A round takes the
balls from the root: by the triangle inequality a centroid b can't win any vector of a ball around c with radius r if
|c - b| - r > |c - a| + r for another centroid a. A ball that is left with one centroid goes to it whole, as count
and sum; the others hand the centroids that are left to their children; leaves compare exact distances with those.
A task returns a row of sums for each centroid, never vectors.

Only vectors of exactly ``width`` components, none of them null or non-finite, are kept. Vectors whose
whole numbers are too large for exact sums of squares in doubles (over 5.9 million for 64 components) are compared in
unbounded integers, vector by vector. A distance or inertia over 2**63 - 1 is null. Equal ids are vectors of their own; among
those the first centroids are the ones with the least components; null ids come last. Fewer vectors than
centroids make fewer centroids; an empty table gives an empty result. Only the id and the vector are
read, so other columns may have any names.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecraft.session import ensure_checkpoint_dir, ship_package

#: Vectors of a tree, and of a leaf, at most.
TREE, LEAF = 8192, 32
#: Bits of a part of a sum: sums may be larger than any type of a column.
PART = 40
#: Groups of tasks whose sums are added up before the driver has them.
GROUPS = 16
MOST = (1 << 63) - 1


@dataclass
class BallTree:
    """Nodes in the order of a walk from the root; a node's vectors are ``lo:hi`` of the tree's, its left child is the next node."""

    points: np.ndarray  # doubles that are whole numbers
    lo: np.ndarray
    hi: np.ndarray
    right: np.ndarray  # -1 for a leaf
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray

    @staticmethod
    def build(points: np.ndarray) -> tuple["BallTree", np.ndarray]:
        """The tree, and the order that it puts the vectors in."""
        order = np.arange(len(points))
        lo, hi, right, centres, radii, sums = [], [], [], [], [], []

        def node(a: int, b: int) -> None:
            here, own = len(lo), points[order[a:b]]
            total = own.sum(0)
            centre = total / (b - a)
            away = np.sqrt(((own - centre) ** 2).sum(1))
            lo.append(a), hi.append(b), right.append(-1), centres.append(centre), radii.append(away.max()), sums.append(total)
            if b - a <= LEAF or not away.max():
                return
            far = own[away.argmax()]  # cut between the vector farthest from the centre and the one farthest from that
            other = own[((own - far) ** 2).sum(1).argmax()]
            side = np.argsort(own @ (other - far), kind="stable")
            order[a:b] = order[a:b][side]
            node(a, (a + b) // 2)
            right[here] = len(lo)
            node((a + b) // 2, b)

        node(0, len(points))
        return BallTree(points[order], *(np.array(x) for x in (lo, hi, right, centres, radii, sums))), order

    def assign(self, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The centroid of each vector; counts and integer sums by centroid."""
        k = len(centroids)
        cluster = np.zeros(len(self.points), np.int64)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, self.points.shape[1]))
        reach = np.sqrt(((self.centre[:, None, :] - centroids[None]) ** 2).sum(2))
        stack = [(0, np.arange(k))]
        while stack:
            n, left = stack.pop()
            # an allowance for the rounding of centres and roots: too many centroids left are no error
            slack = 2 * self.radius[n] + (reach[n].max() + self.radius[n] + 1) * 1e-9
            left = left[reach[n, left] <= reach[n, left].min() + slack]
            a, b = self.lo[n], self.hi[n]
            if len(left) == 1:
                cluster[a:b] = left[0]
                counts[left[0]] += b - a
                sums[left[0]] += self.sums[n]
            elif self.right[n] >= 0:
                stack += [(n + 1, left), (self.right[n], left)]
            else:
                own = self.points[a:b]
                found = left[((own[:, None, :] - centroids[left][None]) ** 2).sum(2).argmin(1)]  # exact; ties: the first
                cluster[a:b] = found
                np.add.at(counts, found, 1)
                np.add.at(sums, found, own)
        return cluster, counts, sums


def whole(vector: Column, width: int) -> Column:
    """The vector in doubles, null unless it is kept."""
    v = vector.cast("array<double>")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return F.when((F.size(v) == width) & ~odd, v)


def exact(width: int) -> int:
    """Whole numbers up to this have exact squared distances in doubles: width * (2 * x)**2 <= 2**53."""
    return math.isqrt(2**53 // width) // 2


def floors(vectors: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of the vectors, and which of the vectors have exact distances in doubles."""
    with np.errstate(over="ignore"):
        out = np.floor(vectors * float(scale))
    return out, (np.abs(out) <= exact(vectors.shape[1])).all(1)


def huge(vector: np.ndarray, scale: int) -> list[int]:
    """The same in unbounded integers: a double is a fraction of two of them."""
    return [(n * scale) // d for n, d in (float(x).as_integer_ratio() for x in vector)]


def nearest(vector: list[int], centroids: list[list[int]]) -> tuple[int, int]:
    """The centroid and the squared distance, in unbounded integers."""
    found = [sum((x - y) ** 2 for x, y in zip(vector, c)) for c in centroids]
    best = min(range(len(found)), key=found.__getitem__)
    return best, found[best]


def parted(totals: dict[int, list[int]]) -> pa.RecordBatch:
    """Rows (cluster, part, s) of whole numbers of any size, in parts of ``PART`` bits from the lowest; the last part has the sign."""
    rows = []
    for j, t in totals.items():
        part = 0
        while any(t):
            low = [x if -(1 << PART) < x < (1 << PART) else x & ((1 << PART) - 1) for x in t]
            rows.append((j, part, low))
            t, part = [(x - y) >> PART for x, y in zip(t, low)], part + 1
    columns = [[r[k] for r in rows] for k in range(3)]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.list_(pa.int64())))], names=["cluster", "part", "s"])


def added(rows: Iterable[tuple[int, int, list[int]]], size: int) -> dict[int, list[int]]:
    """What rows of ``parted`` add up to, by cluster."""
    totals: dict[int, list[int]] = {}
    for j, part, s in rows:
        t = totals.setdefault(j, [0] * size)
        for i, x in enumerate(s):
            t[i] += x << (PART * part)
    return totals


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = [tuple(r.values()) for batch in batches for r in batch.to_pylist()]
    if rows:
        yield parted(added(rows, len(rows[0][2])))


def cluster(df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", width: int = 64, scale: int = 1024, k: int = 8, rounds: int = 10, seed: int = 3) -> DataFrame:
    """``id``, ``cluster``, ``distance``, ``cluster_inertia``, ``inertia`` and ``centroid`` (decimal integers joined by commas) of each kept vector.

    The first centroids are the vectors with the ``k`` least SHA-256 of ``<seed>:<id>``. Each of ``rounds`` rounds assigns
    every vector to the nearest centroid and then moves every centroid to the floor of the mean of its own.
    """
    spark = df.sparkSession
    ship_package(spark)
    shared = ensure_checkpoint_dir(spark)
    kept = df.select(F.col(id).alias("id"), whole(F.col(vector), width).alias("v")).where("v IS NOT NULL")
    least = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    first = kept.orderBy(least.asc_nulls_last(), "v").limit(k).collect()
    centroids = [huge(r["v"], scale) for r in first]
    number = kept.schema["id"].dataType

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each tree; vectors too large for one come as a row of their own without nodes."""
        held: list[pa.RecordBatch] = []

        def grow(batch: pa.Table) -> Iterator[pa.RecordBatch]:
            ids = batch.column("id").combine_chunks()
            raw = batch.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            numbers, plain = floors(raw, scale)
            for own, small in ((np.flatnonzero(plain), True), (np.flatnonzero(~plain), False)):
                if len(own):
                    tree, order = BallTree.build(numbers[own]) if small else (None, np.arange(len(own)))
                    parts = [tree.points.astype(np.int32), tree.lo, tree.hi, tree.right, tree.centre, tree.radius, tree.sums] if small else [raw[own]]
                    lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), ids.take(pa.array(own[order])))
                    yield pa.record_batch([pa.array([small]), lists, pa.array([[p.tobytes() for p in parts]], pa.list_(pa.binary()))], names=["small", "ids", "parts"])

        count = 0
        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            while count >= TREE:
                table = pa.Table.from_batches(held)
                yield from grow(table.slice(0, TREE))
                held = table.slice(TREE).to_batches()
                count -= TREE
        if count:
            yield from grow(pa.Table.from_batches(held))

    folder = f"{shared}/ball-trees-{uuid.uuid4().hex}"
    schema = f"small boolean, ids array<{number.simpleString()}>, parts array<binary>"
    kept.mapInArrow(trees, schema).write.parquet(folder)
    forest = spark.read.schema(schema).parquet(folder)

    def assigned(row: dict, centroids: list[list[int]]) -> tuple[np.ndarray, list[int], dict[int, tuple[int, list[int]]]]:
        """Of a tree: clusters and distances of its vectors, and counts and sums by cluster."""
        if row["small"]:
            kinds = (np.int32, np.int64, np.int64, np.int64, np.float64, np.float64, np.float64)
            points, lo, hi, right, centre, radius, sums = (np.frombuffer(p, t) for p, t in zip(row["parts"], kinds))
            tree = BallTree(points.reshape(-1, width).astype(float), lo, hi, right, centre.reshape(-1, width), radius, sums.reshape(-1, width))
            if max((abs(x) for c in centroids for x in c), default=0) <= exact(width):
                middle = np.array(centroids, float)
                found, counts, sums = tree.assign(middle)
                distance = ((tree.points - middle[found]) ** 2).sum(1).astype(np.int64).tolist()
                return found, distance, {j: (int(counts[j]), [int(x) for x in sums[j]]) for j in np.flatnonzero(counts).tolist()}
            vectors = [[int(x) for x in p] for p in tree.points]
        else:
            vectors = [huge(v, scale) for v in np.frombuffer(row["parts"][0], np.float64).reshape(-1, width)]
        pairs = [nearest(v, centroids) for v in vectors]
        totals: dict[int, tuple[int, list[int]]] = {}
        for v, (j, _) in zip(vectors, pairs):
            n, s = totals.get(j, (0, [0] * width))
            totals[j] = (n + 1, [x + y for x, y in zip(s, v)])
        return np.array([j for j, _ in pairs]), [d for _, d in pairs], totals

    def summed(centroids: list[list[int]]):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Count, inertia and sums of a task's vectors by cluster."""
            totals: dict[int, list[int]] = {}
            for batch in batches:
                for row in batch.to_pylist():
                    found, distance, own = assigned(row, centroids)
                    for j, (n, s) in own.items():
                        t = totals.setdefault(j, [0] * (width + 2))
                        t[0] += n
                        t[2:] = [x + y for x, y in zip(t[2:], s)]
                    for j, d in zip(found.tolist(), distance):
                        totals[j][1] += d
            yield parted(totals)

        return run

    def totals(centroids: list[list[int]]) -> dict[int, list[int]]:
        """The same of all vectors: the tasks' rows are added up in ``GROUPS`` groups of tasks first."""
        schema = "cluster int, part int, s array<bigint>"
        rows = forest.mapInArrow(summed(centroids), schema).repartition(GROUPS)
        return added((tuple(r) for r in rows.mapInArrow(_folded, schema).collect()), width + 2)  # of each group, clusters times parts

    for _ in range(rounds if centroids else 0):
        for j, (n, _, *s) in totals(centroids).items():
            centroids[j] = [x // n for x in s]
    inertia = {j: t[1] for j, t in totals(centroids).items()} if centroids else {}
    long = lambda x: x if x <= MOST else None
    texts = [",".join(map(str, c)) for c in centroids]
    of_cluster, of_all = {j: long(x) for j, x in inertia.items()}, long(sum(inertia.values()))

    def result(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, row in enumerate(batch.select(["small", "parts"]).to_pylist()):
                found, distance, _ = assigned(row, centroids)
                clusters = found.tolist()
                columns = [[long(d) for d in distance], [of_cluster[j] for j in clusters], [of_all] * len(clusters)]
                ids = batch.column(1).slice(k, 1).flatten()
                yield pa.record_batch([ids, pa.array(clusters, pa.int32()), *(pa.array(c, pa.int64()) for c in columns), pa.array([texts[j] for j in clusters], pa.string())], names=names)

    names = [id, "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return forest.mapInArrow(result, f"`{id}` {number.simpleString()}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid string")
