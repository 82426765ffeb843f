"""Near-duplicate vectors by product quantisation: inverted lists, residual codes, exact rerank.

Unit vectors go to the coarse list of their nearest centroid; what the centroid
leaves is cut into subspaces, each coded by its nearest of 256 codewords. A query
probes its own list and those beyond whose border a neighbour within the threshold
could be. In a list, distances come from a table of query parts against codewords, one
lookup a subspace; a member stays a candidate unless its distance exceeds the threshold by
more than its own coding error, so the codes lose no link. Candidates are settled by
their cosine in double precision. Lists beyond a border are probed from one side only:
the border is as near to the one vector of a link as the step between them allows to the other.

A query probes all lists that the triangle inequality leaves, so no link is lost. ``spread`` gives up that proof for
fewer probes: a step of the threshold's length goes all of it in the border's direction only by chance, so a query
looks only ``spread`` standard deviations of a step beyond a border, with the directions that vectors have around
their centroids, measured for each pair of lists. The sample's own links are a check: ``spread`` doubles until 99 in 100 of
them are found.

Each length of vectors is indexed on its own: vectors of different lengths never link. The
models are fitted on a sample of at most ``SAMPLE`` vectors a length and broadcast; lengths with no more
vectors than there are codewords have nothing to code: one list. Every vector is indexed and every
vector is a query. Lists are worked on in blocks of members and queries, so a label or
list that holds a third of the vectors is only more blocks. A block returns link counts and
a spanning forest, never all links. Equal vectors of a label are one vector with a count.

Vectors that are null, zero, or hold null or non-finite components, and those with a null
label, link with nothing: ``n_links`` 0, their own component. Rows that share an id with
others join one component. Vectors of any finite size count: each is scaled by its greatest component before its length is taken.
Equal cosines at the threshold link. An empty table gives an empty one; only the three named columns are read, whatever others are called.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from lorecraft.operators.components import connected_components
from lorecraft.session import ensure_checkpoint_dir, ship_package

CODEWORDS = 256
#: Rows of a block of members or queries of a list.
BLOCK = 2048
#: Vectors of a length that its model is fitted on, at most.
SAMPLE = 200_000


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    norm, step = (centres * centres).sum(1), max(1, 8_000_000 // max(1, len(centres)))
    return np.concatenate([np.zeros(0, np.int64), *((norm - 2 * x[k : k + step] @ centres.T).argmin(1) for k in range(0, len(x), step))])


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows at length one, whatever their size."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres (fewer rows: repeated rows); an empty centre moves to a random row."""
    centres = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = _nearest(x, centres)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(centres)
        np.add.at(total, own, x)
        centres = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(len(x), size=k)])
    return centres


@dataclass
class Quantizer:
    centres: np.ndarray  # list x dimension
    codewords: list[np.ndarray]  # for each subspace, codeword x its dimensions
    cuts: list[tuple[int, int]]
    radius: float  # distance of unit vectors at the threshold
    reach: np.ndarray | None = None  # list x list: how far beyond their border a query looks; none: as far as the threshold goes

    @staticmethod
    def plain(dimension: int, threshold: float) -> "Quantizer":
        """One list without codes: everything is a candidate."""
        return Quantizer(np.zeros((1, dimension)), [], [], math.sqrt(max(0.0, 2 - 2 * threshold)))

    def apart(self, at: np.ndarray) -> np.ndarray:
        """Distances of some centres to all."""
        norm = (self.centres**2).sum(1)
        return np.sqrt(np.maximum(norm[at][:, None] + norm - 2 * self.centres[at] @ self.centres.T, 0))

    @staticmethod
    def fit(x: np.ndarray, lists: int, threshold: float, subspaces: int = 8, spread: float | None = None, seed: int = 1) -> "Quantizer":
        rng = np.random.default_rng(seed)
        centres = k_means(x, lists, 12 if lists <= 1024 else 4, rng)
        own = _nearest(x, centres)
        left = x - centres[own]
        edges = np.linspace(0, x.shape[1], min(subspaces, x.shape[1]) + 1).astype(int)
        cuts = list(zip(edges[:-1].tolist(), edges[1:].tolist()))
        radius = math.sqrt(max(0.0, 2 - 2 * threshold))
        model = Quantizer(centres, [k_means(left[:, a:b], CODEWORDS, 8, rng) for a, b in cuts], cuts, radius)
        if spread is None:
            return model
        apart = model.apart(np.arange(len(centres)))
        # how much of a step goes in the direction between two centres, by the directions of the residuals
        unit = left / np.maximum(np.linalg.norm(left, axis=1, keepdims=True), 1e-12)
        turned = centres @ (unit.T @ unit / len(unit))
        square = (turned * centres).sum(1)
        along = np.maximum(square[:, None] + square - 2 * turned @ centres.T, 0) / np.maximum(apart, 1e-12) ** 2
        deviation = radius * np.sqrt(np.maximum(along, 1 / x.shape[1]))
        some = x[rng.permutation(len(x))[:4096]]
        i, j = np.nonzero(np.triu(some @ some.T >= threshold, 1))
        while True:
            model.reach = np.minimum(radius, spread * deviation)
            if (model.reach >= radius).all() or not len(i):
                return model
            at, _, _, probes = model.encode(some)
            pairs = np.zeros((len(some), len(centres)), bool)
            for k, p in enumerate(probes):
                pairs[k, p] = True
            if (pairs[i, at[j]] | pairs[j, at[i]]).mean() >= 0.99:
                return model
            spread *= 2

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
        """List, codes, coding error and lists to probe (its own and later ones) of each unit vector."""
        own, codes, error, probes = [np.zeros(0, np.int64)], [np.zeros((0, len(self.cuts)), np.uint8)], [np.zeros(0)], []
        step = max(1, 4_000_000 // max(len(self.centres), x.shape[1]))
        norm = (self.centres**2).sum(1)
        for some in (x[k : k + step] for k in range(0, len(x), step)):
            square = np.maximum((some * some).sum(1)[:, None] + norm - 2 * some @ self.centres.T, 0)
            at = square.argmin(1)
            left = some - self.centres[at]
            code = np.stack([_nearest(left[:, a:b], w) for (a, b), w in zip(self.cuts, self.codewords)], 1) if self.cuts else np.zeros((len(some), 0), int)
            rest = left - np.concatenate([w[code[:, s]] for s, w in enumerate(self.codewords)], 1) if self.cuts else left
            lists, place = np.unique(at, return_inverse=True)
            reach = self.radius if self.reach is None else self.reach[at]
            probe = square - square[np.arange(len(some)), at][:, None] <= 2 * reach * self.apart(lists)[place] + 1e-9
            probe &= np.arange(len(self.centres)) >= at[:, None]
            own.append(at), codes.append(code.astype(np.uint8)), error.append(np.sqrt((rest * rest).sum(1)))
            probes += [np.flatnonzero(p) for p in probe]
        return np.concatenate(own), np.concatenate(codes), np.concatenate(error), probes

    def candidates(self, queries: np.ndarray, which: int, codes: np.ndarray, error: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, member) that the codes of a list's members don't rule out."""
        if not self.cuts:
            return tuple(np.indices((len(queries), len(codes))).reshape(2, -1))
        left = queries - self.centres[which]
        square = np.zeros((len(queries), len(codes)))
        for s, ((a, b), w) in enumerate(zip(self.cuts, self.codewords)):
            part = left[:, a:b]
            table = (part * part).sum(1)[:, None] + (w * w).sum(1) - 2 * part @ w.T
            square += table[:, codes[:, s]]
        return np.nonzero(square <= (self.radius + error + 1e-6) ** 2)


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node that links (a, b) connect each of ``n`` nodes to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _units(raw: list[bytes], kind: str) -> np.ndarray:
    return _unit(np.frombuffer(b"".join(raw), kind).astype(float).reshape(len(raw), -1))


def link_block(model: Quantizer, threshold: float, kind: str, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
    """Rows (a, b, n): links of vector ``a`` where ``b`` is null, else an edge of the block's forest.

    Queries of the list itself meet each of its members once, from the greater id.
    """
    which = int(members["list"].iloc[0])
    q, x = _units(queries["raw"].tolist(), kind), _units(members["raw"].tolist(), kind)
    codes = np.stack([np.frombuffer(v, np.uint8) for v in members["codes"]])
    error = members["error"].to_numpy()
    q_id, x_id, at_home = queries["item"].to_numpy(), members["item"].to_numpy(), queries["own"].to_numpy() == which
    links = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    step = max(1, min(128, 500_000 // len(x)))
    for at in range(0, len(q), step):
        i, j = model.candidates(q[at : at + step], which, codes, error)
        i = i + at
        once = ~at_home[i] | (q_id[i] > x_id[j])
        i, j = i[once], j[once]
        near = [np.einsum("ij,ij->i", q[i[k : k + 65536]], x[j[k : k + 65536]]) >= threshold for k in range(0, len(i), 65536)]
        near = np.concatenate([np.zeros(0, bool), *near])
        links.append((i[near], j[near]))
    i, j = (np.concatenate(p) for p in zip(*links))
    n = np.r_[np.bincount(i, weights=members["copies"].to_numpy()[j], minlength=len(q)), np.bincount(j, weights=queries["copies"].to_numpy()[i], minlength=len(x))].astype(np.int64)
    some, both = np.flatnonzero(n), np.r_[q_id, x_id]
    ids, place = np.unique(np.r_[q_id[i], x_id[j]], return_inverse=True)
    root = _roots(place[: len(i)], place[len(i) :], len(ids))
    tree = np.flatnonzero(root != np.arange(len(ids)))
    counts = pd.DataFrame({"a": both[some], "b": pd.array([None] * len(some), "Int64"), "n": n[some]})
    forest = pd.DataFrame({"a": ids[tree], "b": pd.array(ids[root[tree]], "Int64"), "n": np.zeros(len(tree), np.int64)})
    return pd.concat([counts, forest], ignore_index=True)


def _usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _dealt(rows: DataFrame, key: str, side: str, sizes: DataFrame) -> DataFrame:
    """``rows`` of a list, each in a block of its own side and copied to all blocks of the other."""
    own, other = ("members", "queries") if side == "member" else ("queries", "members")
    number = lambda n: F.ceil(F.col(n) / BLOCK).cast("int")
    dealt = (
        rows.join(sizes, ["label", "length", "list"])
        .withColumn(f"{own}_block", F.pmod(F.xxhash64(key), number(own)).cast("int"))
        .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), number(other) - 1)))
        .drop("members", "queries")
    )
    return dealt.select(*[F.col(c).alias(c) for c in dealt.columns])  # both sides come from one table


def _model(vectors: DataFrame, size: int, labels: float, threshold: float, spread: float | None) -> Quantizer:
    """A model of vectors of one length, from a sample; ``labels`` is the mean number of vectors that share a label."""
    lists = 2 ** round(math.log2(max(math.sqrt(labels) / 4, 4)))
    wanted = min(SAMPLE, max(32 * lists, 4096))
    taken = vectors.where(F.pmod(F.xxhash64("vector"), F.lit(1 << 30)) < min(1.0, wanted / size) * (1 << 30)).limit(min(SAMPLE, 2 * wanted)).toArrow()
    if not len(taken):
        taken = vectors.limit(1).toArrow()
    x = taken.column(0).combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(taken), -1)
    return Quantizer.fit(_unit(x), lists, threshold, spread=spread)


def vector_duplicates(
    df: DataFrame, *, id: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.93, spread: float | None = None
) -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_links``, ``component_id`` and ``kept``.

    Two vectors with equal labels are linked if their cosine is ``threshold`` or more.
    """
    spark = df.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    kind = "f4" if rows.schema["vector"].dataType.elementType == FloatType() else "f8"
    if kind == "f8":
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    usable = rows.where(F.col("label").isNotNull() & F.col("id").isNotNull() & _usable(F.col("vector")))
    distinct = usable.groupBy("label", "vector").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies")).withColumn("length", F.size("vector")).withColumn("item", F.monotonically_increasing_id()).checkpoint()
    counted = distinct.groupBy("length", "label").agg(F.count(F.lit(1)).alias("n")).groupBy("length")
    large = counted.agg(F.sum("n").alias("n"), (F.sum(F.col("n").cast("double") ** 2) / F.sum("n")).alias("labels")).where(F.col("n") > CODEWORDS).collect()
    models = {r["length"]: _model(distinct.where(F.col("length") == r["length"]).select("vector"), r["n"], r["labels"], threshold, spread) for r in large}
    shared = spark.sparkContext.broadcast(models)

    def model_of(length: int) -> Quantizer:
        return shared.value[length] if length in shared.value else Quantizer.plain(length, threshold)

    @F.arrow_udf("struct<raw:binary,own:int,codes:binary,error:double,probes:array<int>>")
    def indexed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kinds = (pa.binary(), pa.int32(), pa.binary(), pa.float64(), pa.list_(pa.int32()))
        for batch in batches:
            lengths = pc.list_value_length(batch).to_numpy(zero_copy_only=False)
            out: list[tuple | None] = [None] * len(batch)
            for length in np.unique(lengths).tolist():
                at = np.flatnonzero(lengths == length)
                raw = batch.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(at), length)
                own, codes, error, probes = model_of(length).encode(_unit(raw.astype(float)))
                for k, row in zip(at.tolist(), zip([v.tobytes() for v in raw], own.tolist(), [c.tobytes() for c in codes], error.tolist(), [p.tolist() for p in probes])):
                    out[k] = row
            columns = list(zip(*out)) or [()] * 5
            yield pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["raw", "own", "codes", "error", "probes"])

    index = distinct.withColumn("x", indexed("vector")).select("label", "length", "item", "copies", "x.*").checkpoint()
    members = index.select("label", "length", F.col("own").alias("list"), "item", "copies", "raw", "codes", "error")
    queries = index.select("label", "length", F.explode("probes").alias("list"), "item", "copies", "raw", "own")
    sizes = members.groupBy("label", "length", "list").agg(F.count(F.lit(1)).alias("members")).join(queries.groupBy("label", "length", "list").agg(F.count(F.lit(1)).alias("queries")), ["label", "length", "list"])
    block = ["label", "length", "list", "members_block", "queries_block"]

    def linked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"a": pd.Series(dtype="int64"), "b": pd.Series(dtype="Int64"), "n": pd.Series(dtype="int64")})
        return link_block(model_of(int(right["length"].iloc[0])), threshold, kind, left, right)

    found = (
        _dealt(queries, "item", "query", sizes)
        .groupBy(*block)
        .cogroup(_dealt(members, "item", "member", sizes).groupBy(*block))
        .applyInPandas(linked, "a bigint, b bigint, n bigint")
        .checkpoint()
    )
    links = found.where("b IS NULL").groupBy(F.col("a").alias("item")).agg(F.sum("n").alias("n"))
    # ids of several vectors, if any, bring their vectors together as well
    value = F.xxhash64("label", "vector")
    several = usable.groupBy("id").agg(F.min(value).alias("low"), F.max(value).alias("high")).where("low < high").select("id")
    texts = usable.join(several, "id").join(distinct, ["label", "vector"]).select("id", "item").distinct().checkpoint()
    same = texts.groupBy("id").agg(F.min("item").alias("a")).join(texts, "id").select("a", F.col("item").alias("b"))
    classes = connected_components(found.where("b IS NOT NULL").select("a", "b").unionByName(same), "a", "b").withColumnRenamed("id", "item")
    of_vector = distinct.join(links, "item", "left").join(classes, "item", "left").withColumn("component", F.coalesce("component", "item")).checkpoint()
    least = of_vector.groupBy("component").agg(F.min("rep").alias("component_id"))
    of_vector = of_vector.join(least, "component").select(
        F.col("label").alias("__label"), F.col("vector").alias("__vector"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"
    )
    good = F.col("label").isNotNull() & F.col("id").isNotNull() & _usable(F.col("vector"))
    out = rows.withColumn("__label", F.when(good, F.col("label"))).withColumn("__vector", F.when(good, F.col("vector")))
    component = F.coalesce("component_id", "id")
    return out.join(of_vector, ["__label", "__vector"], "left").select(
        F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(True)).alias("kept")
    )
