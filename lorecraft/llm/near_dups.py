"""Near-duplicate documents by weighted Jaccard: BagMinHash signatures, bands, exact overlap.

A text is the multiset of its runs of five words (lower-cased letters and digits; a
shorter text is one run). BagMinHash draws, for every run, the points of a
Poisson process over its weight: the weight axis is cut into the cells
0-1, 1-2, 2-4, 4-8, ..., each with a process of its own, seeded by the run, whose
points fall on a unit of weight and a component of the signature. Points come
in order of time, so a run stops as soon as its next point is later than
every component found so far. Two signatures agree in a component with the
probability of the weighted Jaccard similarity.

Equal texts are one item; items that agree in a whole band are candidates. In each
bucket the item that shares most buckets with others is the hub: of a group of edited
copies, the least edited one. First every item is verified against the greatest hub
of its buckets, and verified links join into components. What is left are pairs from
different components of a bucket. In buckets of at most ``SMALL`` all of them that sizes
don't rule out are verified. Larger ones get a reference: the runs that most of a sample
of their main component have. With D the runs that an item and the reference don't have
in common, items A and B are a link exactly if D(A) and D(B) share enough runs, a number
that follows from their sizes. Where none is enough, both are linked to the item
next to the reference. Where some are needed, they meet on the first runs of D, rare
ones first; the more must be shared, the fewer runs can be the first shared one, and
a meeting so late that too few runs are left is none (prefix and position filters).
So no pair that shares a band and could join two classes is left out, and a group of
thousands of copies costs a few pairs a copy. With 25 bands of five, a pair at 0.8
shares none with probability 5e-5, at 0.9 with 4e-10.

Rows with a null id or without a word link with nothing and are kept. There is a row for
each input row; rows that repeat an id are in one class, whatever their texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecraft.llm.chargrams import code_points, groups
from lorecraft.operators.components import connected_components
from lorecraft.session import ensure_checkpoint_dir, release, ship_package

WORDS = 5
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS
#: Buckets of at most so many documents are worked on pair by pair.
SMALL = 16
#: Documents of a component that its reference is made of, about.
SAMPLED = 64
#: Items of a reference that meet one copy of it, about.
PART = 512

_alnum: list[np.ndarray] = []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _add(x: np.ndarray, n: int) -> np.ndarray:
    return _mix(x + np.uint64(n * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))


def words_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text where its words begin (with the end as the last)."""
    if not _alnum:
        _alnum.append(np.fromiter((chr(c).isalnum() for c in range(0x110000)), bool, 0x110000))
    flat, marks = code_points([t.lower() for t in texts])
    inside = _alnum[0][flat]
    begins = np.flatnonzero(inside & ~np.r_[False, inside[:-1]])
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64)
    start = np.zeros(len(flat), np.int64)
    start[begins] = np.diff(np.r_[0, begins])
    offset = (np.arange(len(flat)) - np.cumsum(start)).astype(np.uint64)
    value = (flat.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    value = np.where(inside, _mix(value) * (offset * np.uint64(2) + np.uint64(1)), np.uint64(0))
    return _mix(np.add.reduceat(value, begins)), np.searchsorted(begins, marks)


def runs_of(texts: list[str]) -> Iterator[np.ndarray]:
    """Hashes of the runs of ``WORDS`` words of each text, in order, repeats included."""
    words, bounds = words_of(texts)
    run = words.copy()
    for k in range(1, WORDS):
        run = _add(run, k) + np.roll(words, -k)
    run = _mix(run)
    for u, v in zip(bounds[:-1], bounds[1:]):
        if v - u >= WORDS:
            yield run[u : v - WORDS + 1]
        elif v > u:
            yield np.array([_add(words[u:v] + np.arange(1, v - u + 1, dtype=np.uint64), int(v - u)).sum()], np.uint64)
        else:
            yield np.zeros(0, np.uint64)


def elements_of(runs: np.ndarray) -> np.ndarray:
    """The multiset as a set: the k-th occurrence of a run is an element of its own; ascending."""
    ordered = np.sort(runs)
    first = np.r_[True, ordered[1:] != ordered[:-1]] if len(ordered) else np.zeros(0, bool)
    nth = np.arange(len(ordered)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(ordered) else np.zeros(0, np.int64)
    return np.sort(_mix(ordered + nth.astype(np.uint64) * np.uint64(0xD1342543DE82EF95)).view(np.int64))


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """A row of ``size`` arrival times for each bag (distinct hashes, whole weights >= 1).

    Infinity stands in the rows of empty bags.
    """
    found = np.full((len(bags), size), np.inf)
    some = [i for i, (h, _) in enumerate(bags) if len(h)]
    if not some:
        return found
    hashes = np.concatenate([bags[i][0] for i in some])
    weight = np.concatenate([bags[i][1] for i in some]).astype(np.int64)
    owner = np.repeat(np.array(some), [len(bags[i][0]) for i in some])
    seeds, owners, weights, lows, widths = [_add(hashes, 1)], [owner], [weight], [np.zeros(len(hashes), np.int64)], [np.ones(len(hashes), np.int64)]
    low = 1
    while (more := weight > low).any():  # cells low to 2 low, as far as the weight reaches into them
        seeds.append(_add(hashes[more], 1 + low)), owners.append(owner[more]), weights.append(weight[more])
        lows.append(np.full(more.sum(), low)), widths.append(np.full(more.sum(), low))
        low *= 2
    seed, owner, weight, low, width = (np.concatenate(x) for x in (seeds, owners, weights, lows, widths))
    time = np.zeros(len(seed))
    flat = found.reshape(-1)
    step = 0
    while len(seed):
        step += 1
        a, b = _add(seed, 3 * step), _add(seed, 3 * step + 1)
        time = time - np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) / 2.0**53) / (size * width)
        component = (b % np.uint64(size)).astype(np.int64)
        unit = low + ((b >> np.uint64(20)) % width.astype(np.uint64)).astype(np.int64)
        hit = unit < weight
        np.minimum.at(flat, owner[hit] * size + component[hit], time[hit])
        on = time <= found.max(axis=1)[owner]
        if not on.all():
            seed, owner, weight, low, width, time = (x[on] for x in (seed, owner, weight, low, width, time))
    return found


def bands_of(found: np.ndarray) -> np.ndarray:
    """One hash for each band of each row."""
    bits = found.view(np.uint64).reshape(len(found), BANDS, ROWS)
    h = np.broadcast_to(_add(np.arange(BANDS, dtype=np.uint64), 9), bits.shape[:2]).copy()
    for k in range(ROWS):
        h = _mix(h * np.uint64(3) + bits[:, :, k])
    return h.view(np.int64)


def _marks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows: list[list[int] | None] = []
        sizes: list[int] = []
        for group in groups(batch.to_pylist(), 500_000):
            runs = list(runs_of(group))
            bags = [np.unique(r, return_counts=True) for r in runs]
            rows += [b if len(h) else None for (h, _), b in zip(bags, bands_of(signatures(bags)).tolist())]
            sizes += map(len, runs)
        yield pa.StructArray.from_arrays([pa.array(rows, pa.list_(pa.int64())), pa.array(sizes, pa.int64())], names=["bands", "s"])


def _elements(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        rows = [elements_of(r) for group in groups(batch.to_pylist(), 500_000) for r in runs_of(group)]
        ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
        yield pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *rows])))


def _pairs_of_small(placed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of items of different components in the same bucket, of sizes that could be a link."""
    x, y = (placed.select("bucket", *[F.col(c).alias(f"{c}_{n}") for c in ("item", "c", "s")]) for n in "xy")
    both = x.join(y, "bucket").where((F.col("item_x") < F.col("item_y")) & (F.col("c_x") != F.col("c_y")) & _sizes("s_x", "s_y", threshold))
    return both.select(F.col("item_x").alias("a"), F.col("item_y").alias("b")).distinct()


def _sizes(x: str, y: str, threshold: float) -> Column:
    return F.least(x, y) >= threshold * F.greatest(x, y)


def _spread(small: DataFrame, parts: DataFrame) -> DataFrame:
    """A row of ``small`` (ref, ...) for each part of its ref: what many rows of one ref are joined with."""
    return small.join(parts, "ref").withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")


def _references(large: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """For rows (bucket, item, c): the largest component in each bucket as its ``ref``, and the runs of each ref.

    A reference holds the runs of more than half of about ``SAMPLED`` of its component's
    documents. Any set would do for right results; this one makes differences small.
    """
    sizes = large.select("item", "c").distinct().groupBy("c").agg(F.count(F.lit(1)).alias("m"))
    refs = large.select("bucket", "c").distinct().join(sizes, "c").groupBy("bucket").agg((-F.max(F.struct("m", (-F.col("c")).alias("c")))["c"]).alias("ref"))
    of_ref = large.select("item", F.col("c").alias("ref")).distinct().join(refs.select("ref").distinct(), "ref")
    size = of_ref.groupBy("ref").agg(F.count(F.lit(1)).alias("m"))
    chosen = of_ref.join(size, "ref").where(F.pmod(F.xxhash64("item", F.lit(5)), F.lit(1 << 30)) < F.lit(SAMPLED) / F.col("m") * (1 << 30)).select("ref", "item")
    chosen = chosen.checkpoint()
    votes = chosen.join(sets, "item").select("ref", F.explode("e").alias("run")).groupBy("ref", "run").agg(F.count(F.lit(1)).alias("n"))
    most = votes.join(chosen.groupBy("ref").agg(F.count(F.lit(1)).alias("m")), "ref").where("2 * n > m")
    return refs, refs.select("ref").distinct().join(most.groupBy("ref").agg(F.collect_list("run").alias("h")), "ref", "left").select("ref", F.coalesce("h", F.array().cast("array<bigint>")).alias("h"))


def _pairs_of_large(items: DataFrame, reference: DataFrame, sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Of rows (ref, item, c): sure links (c, d) of components, and pairs (a, b) of items that may be links.

    D are the runs that a document and its reference don't have in common, d their number
    and f = d - r s with r = (1 - t) / (1 + t). Two documents are a link exactly if
    their Ds share at least (f(A) + f(B)) / 2 runs.
    """
    ratio = (1 - threshold) / (1 + threshold)
    parts = items.groupBy("ref").agg(F.ceil(F.count(F.lit(1)) / PART).alias("parts")).checkpoint()
    dealt = items.join(parts, "ref").withColumn("part", F.pmod(F.xxhash64("item"), "parts")).drop("parts")
    known = (
        dealt.join(sets, "item")
        .join(_spread(reference, parts), ["ref", "part"])
        .select("ref", "part", "item", "c", F.size("e").alias("s"), F.concat(F.array_except("e", "h"), F.array_except("h", "e")).alias("delta"))
        .withColumn("d", F.size("delta"))
        .withColumn("f", F.col("d") - ratio * F.col("s"))
        .checkpoint()
    )
    nearest = known.groupBy("ref").agg(F.min(F.struct("f", "item", "c")).alias("n")).select("ref", F.col("n.c").alias("near"), F.col("n.f").alias("least"))
    plain = known.drop("delta", "s").join(_spread(nearest, parts), ["ref", "part"]).withColumn("sure", F.col("f") + F.col("least") <= 1e-9).checkpoint()
    sure = plain.where("sure AND c <> near").select("c", F.col("near").alias("d")).distinct()
    main = plain.where("sure").select("ref", "c").distinct().withColumn("main", F.lit(True))
    plain = plain.select("ref", "part", "item", "c", "d", "f").join(_spread(main, parts), ["ref", "part", "c"], "left").withColumn("main", F.coalesce("main", F.lit(False)))
    bounds = plain.groupBy("ref").agg(F.min(F.when(~F.col("main"), F.col("f"))).alias("stray_least"), F.min(F.when(F.col("main"), F.col("f"))).alias("main_least")).where("stray_least IS NOT NULL")

    # how many of a document's runs, in the common order, can hold the first one that a link shares
    need = lambda other: F.greatest(F.ceil((F.col("f") + F.col(other)) / 2 - 1e-9), F.lit(1))
    first = lambda other: F.when(F.col(other).isNotNull(), F.greatest(F.col("d") - need(other) + 1, F.lit(0))).otherwise(0)
    plain = plain.join(_spread(bounds, parts), ["ref", "part"])
    plain = plain.withColumn("to_stray", first("stray_least")).withColumn("to_main", F.when(F.col("main"), 0).otherwise(first("main_least")))
    plain = plain.where("to_stray > 0 OR to_main > 0").select("ref", "item", "c", "d", "f", "main", "to_stray", "to_main").checkpoint()

    # the common order: runs by how many documents of the ref have them in D; those of one document meet nothing
    runs = known.select("ref", "item", "delta").join(plain.select("ref", "item"), ["ref", "item"]).select("ref", "item", F.explode("delta").alias("run"))
    shared = runs.groupBy("ref", "run").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    ordered = runs.join(shared, ["ref", "run"]).groupBy("ref", "item").agg(F.sort_array(F.collect_list(F.struct("n", "run"))).alias("shared"))
    placed = (
        plain.join(ordered, ["ref", "item"])
        .select("*", F.posexplode("shared").alias("k", "x"))
        .select("ref", F.col("x.run").alias("run"), "item", "c", "d", "f", "main", "to_stray", "to_main", (F.col("d") - F.size("shared") + F.col("k")).alias("at"))
        .where("at < greatest(to_stray, to_main)")
        .checkpoint()
    )
    side = lambda rows, n: rows.select("ref", "run", *[F.col(c).alias(f"{c}_{n}") for c in ("item", "c", "d", "f", "at")])
    shares = F.greatest((F.col("f_x") + F.col("f_y")) / 2 - 1e-9, F.lit(0.5))
    possible = (F.col("c_x") != F.col("c_y")) & (F.least(F.col("d_x") - F.col("at_x"), F.col("d_y") - F.col("at_y")) >= shares)
    strays = placed.where("NOT main")
    met = side(strays.where("at < to_main"), "x").join(side(placed.where("main AND at < to_stray"), "y"), ["ref", "run"]).where(possible)
    each = strays.where("at < to_stray")
    among = side(each, "x").join(side(each, "y"), ["ref", "run"]).where(possible & (F.col("item_x") < F.col("item_y")))
    both = met.select("item_x", "item_y").unionByName(among.select("item_x", "item_y"))
    return sure, both.select(F.least("item_x", "item_y").alias("a"), F.greatest("item_x", "item_y").alias("b")).distinct()


def near_duplicates(df: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """One row for each row of ``df``: ``id``, ``class_id`` (least id of the class) and ``kept``.

    Documents are linked at a weighted Jaccard similarity of ``threshold`` or more;
    a class is what links connect. Of each class the row with the least id is kept.
    """
    spark = df.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)
    marks, elements = F.arrow_udf(_marks, "struct<bands:array<bigint>,s:bigint>"), F.arrow_udf(_elements, "array<bigint>")
    rows = df.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    content = F.unhex(F.md5(F.col("text").cast("binary")))
    signed = rows.select("id", content.alias("content"), marks("text").alias("x")).select("id", "content", "x.*").checkpoint()

    # everything goes by contents: ``item`` numbers them
    linkable = signed.where("id IS NOT NULL AND bands IS NOT NULL")
    contents = linkable.groupBy("content").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"), F.first("s").alias("s"))
    contents = contents.withColumn("item", F.monotonically_increasing_id()).checkpoint()
    bucketed = contents.select("item", "s", F.explode("bands").alias("bucket"))
    shared = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    member = bucketed.join(shared, "bucket").checkpoint()
    met = member.groupBy("item", "s").agg(F.sum("n").alias("met"))
    hubs = member.join(met.drop("s"), "item").groupBy("bucket").agg(F.max(F.struct("met", (-F.col("item")).alias("i"), "s")).alias("hub"))
    release(spark)

    wanted = contents.select("item", "rep", "content").join(met.select("item"), "item").select("item", F.col("rep").alias("id"), "content")
    sets = (
        rows.where("id IS NOT NULL")
        .withColumn("content", content)
        .join(wanted, ["id", "content"])
        .dropDuplicates(["id", "content"])  # rows that repeat an id and its text
        .select("item", elements("text").alias("e"))
        .checkpoint()
    )
    release(spark)

    def linked(pairs: DataFrame) -> DataFrame:
        """Those of ``pairs`` (a, b) whose overlap says that they are links."""
        left, right = (sets.select(F.col("item").alias(n), F.col("e").alias(f"e{n}")) for n in "ab")
        k = F.size(F.array_intersect("ea", "eb"))
        return pairs.join(right, "b").join(left, "a").where(k / (F.size("ea") + F.size("eb") - k) >= threshold).select("a", "b").checkpoint()

    # each document and the greatest hub of its buckets
    hub = member.join(hubs, "bucket").groupBy("item", "s").agg(F.max("hub").alias("hub"))
    stars = hub.select((-F.col("hub.i")).alias("a"), F.col("item").alias("b"), F.col("hub.s").alias("s_a"), F.col("s").alias("s_b")).where("a <> b").where(_sizes("s_a", "s_b", threshold)).select("a", "b").checkpoint()
    links = linked(stars)
    release(spark)
    # ids of several contents, if any, bring these together as well
    several = linkable.select("id", "content").groupBy("id").agg(F.min(F.xxhash64("content")).alias("low"), F.max(F.xxhash64("content")).alias("high")).where("low < high").select("id")
    texts = linkable.join(several, "id").select("id", "content").distinct().join(contents.select("content", "item"), "content").checkpoint()
    same = texts.groupBy("id").agg(F.min("item").alias("a")).join(texts, "id").select("a", F.col("item").alias("b"))
    joined = connected_components(links.unionByName(same), "a", "b").withColumnRenamed("id", "item").checkpoint()

    placed = member.join(joined, "item", "left").withColumn("c", F.coalesce("component", "item")).drop("component")
    open_ = placed.groupBy("bucket").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("bucket")
    placed = placed.join(open_, "bucket").checkpoint()
    release(spark)

    large = placed.where(F.col("n") > SMALL)
    refs, reference = _references(large, sets)
    items = large.join(refs, "bucket").select("ref", "item", "c").distinct().checkpoint()
    sure, pairs = _pairs_of_large(items, reference, sets, threshold)
    small = _pairs_of_small(placed.where(F.col("n") <= SMALL), threshold)
    done = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = small.unionByName(pairs).distinct().join(done, ["a", "b"], "left_anti").checkpoint()
    release(spark)
    second = linked(pairs)

    # links found last join components, not documents
    component = placed.select("item", "c").distinct()
    between = second.join(component.select(F.col("item").alias("a"), "c"), "a").join(component.select(F.col("item").alias("b"), F.col("c").alias("d")), "b").select("c", "d").unionByName(sure)
    merged = connected_components(between, "c", "d").select(F.col("id").alias("c"), F.col("component").alias("whole"))
    parts = contents.select("item", "rep", "content").join(joined, "item", "left").select("rep", "content", F.coalesce("component", "item").alias("c"))
    whole = parts.join(merged, "c", "left").select("rep", "content", F.coalesce("whole", "c").alias("whole")).checkpoint()
    class_of = whole.groupBy("whole").agg(F.min("rep").alias("class_id"))
    of_content = whole.join(class_of, "whole").select("content", "class_id")
    keyed = signed.select("id", F.when(F.col("id").isNotNull() & F.col("bands").isNotNull(), F.col("content")).alias("content"))
    class_id = F.coalesce("class_id", "id")
    return keyed.join(of_content, "content", "left").select(F.col("id").alias(id), class_id.alias("class_id"), F.coalesce(class_id == F.col("id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(df: DataFrame, *, id: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """``df`` with one row of each class: that of its least id (any one of rows that repeat it)."""
    found = near_duplicates(df, id=id, text=text, threshold=threshold).checkpoint()
    release(df.sparkSession)
    left = df.join(found.where("NOT kept").select(id).distinct(), id, "left_anti")
    repeated = found.where(F.col(id).isNotNull()).groupBy(id).agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select(id)
    if repeated.isEmpty():
        return left.select(*df.columns)
    once = left.join(repeated, id, "left_anti").unionByName(left.join(repeated, id, "left_semi").dropDuplicates([id]))
    return once.select(*df.columns)
