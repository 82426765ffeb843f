"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame operations.

A document should be taken ``target / size`` of its source times. The whole part
of that is sure; the fraction is a probability. Two fractions are paired: a
random amount of words moves from one document to the other, in one direction or
the other, until one of them is taken for sure or left for sure. Directions are
drawn so that every document keeps its expected copies, and words are conserved,
so the words taken of a source stay at its target but for the last document;
what drawing that one is off moves on to settled documents of its block.

Pairs are folded in blocks; the one fraction that a block may leave goes on to
the block's parent, and so on to one per source: a reduction tree whose levels
shuffle the remaining fractions only. A source that holds most rows is only more
blocks. Every draw is a hash of the seed and the documents, so reruns agree and
lost tasks repeat their decisions.

Null texts have size 0 and take nothing; a null source is a source of its own,
the last. Equal rows are folded as one with their count, and are shared out again in
chunks. Input columns named like a result are replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from lorecraft.operators.graph import dense_ids
from lorecraft.session import ensure_checkpoint_dir

#: Words are runs of anything but these.
WORD = r"[^\x20\x09-\x0D]+"
#: Copies of a row that one task makes at a time.
CHUNK = 4096
#: A settled document: words, hash, what it is, and whether it is taken once more.
DONE = "struct<w:bigint,h:bigint,id:struct<key:string,n:bigint>,more:bigint>"


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, most: int = 3) -> DataFrame:
    """Adds ``target`` to rows (source, source_size, ...), one per source.

    Sources by code point, null last, weigh ``weights`` in turn and share
    ``share`` of all sizes; a target stops at ``most`` times its source's size and
    the excess goes to the others by weight. The level, words for each unit of weight,
    rises in rounds: sources that it takes to their cap leave, what is left is shared by the
    others. The driver sees two sums a round, however many sources there are.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("__place") % len(weights) + 1).cast("int"))
    named = dense_ids(sizes, F.col("source").asc_nulls_last(), name="__place").withColumn("__weight", weight).withColumn("__cap", most * F.col("source_size"))
    named = named.withColumn("__ratio", F.col("__cap") / F.col("__weight")).checkpoint()
    total = named.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0] * share
    level, full = 0.0, F.col("__ratio")
    while True:
        capped, free = named.agg(F.coalesce(F.sum(F.when(full <= level, F.col("__cap"))), F.lit(0)), F.coalesce(F.sum(F.when(full > level, F.col("__weight"))), F.lit(0))).first()
        if not free or (total - capped) / free <= level:
            break
        level = (total - capped) / free
    return named.withColumn("target", F.when(full > level, level * F.col("__weight")).otherwise(F.col("__cap")).cast("double")).drop("__place", "__weight", "__cap", "__ratio")


def numbered(rows: DataFrame, n: str, name: str) -> DataFrame:
    """Each row ``n`` times, ``name`` from 1 on; a row that is repeated very often is shared out."""
    few = rows.where(F.col(n) <= CHUNK).withColumn(name, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(n))))
    last = F.ceil(F.col(n) / CHUNK) - 1
    many = rows.where(F.col(n) > CHUNK).withColumn("__chunk", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).repartition("__chunk")
    first = F.col("__chunk") * CHUNK + 1
    many = many.withColumn(name, F.explode(F.sequence(first, F.least(first + CHUNK - 1, F.col(n))))).drop("__chunk")
    return few.unionByName(many)


def _draw(*parts: str) -> str:
    """SQL: a number in [0, 1) from the hash of ``parts``."""
    return f"(shiftrightunsigned(xxhash64({', '.join(parts)}), 11) / 9007199254740992D)"


def _fold(seed: int, level: int) -> Column:
    """Folds ``units`` (w, h, p, id) to decided ones and at most one fraction left."""
    unit = "struct<w:bigint,h:bigint,p:double,id:struct<key:string,n:bigint>>"
    done = f"array<{DONE}>"
    pair = "named_struct('a', s.rest, 'b', u, 'up', least((1 - s.rest.p) * s.rest.w, u.p * u.w), 'down', least(s.rest.p * s.rest.w, (1 - u.p) * u.w))"
    moved = f"named_struct('a', x.a, 'b', x.b, 'move', if({_draw(str(seed), str(level), 'x.a.h', 'x.b.h')} * (x.up + x.down) < x.down, x.up, -x.down))"
    settled = (
        "named_struct('a', x.a, 'b', x.b,"
        " 'p', CASE WHEN x.move = (1 - x.a.p) * x.a.w THEN 1D WHEN -x.move = x.a.p * x.a.w THEN 0D ELSE x.a.p + x.move / x.a.w END,"
        " 'q', CASE WHEN x.move = x.b.p * x.b.w THEN 0D WHEN -x.move = (1 - x.b.p) * x.b.w THEN 1D ELSE x.b.p - x.move / x.b.w END)"
    )
    open_a, open_b = "x.p > 0 AND x.p < 1", "x.q > 0 AND x.q < 1"
    keep = lambda side, p: f"named_struct('w', x.{side}.w, 'h', x.{side}.h, 'p', x.{p}, 'id', x.{side}.id)"
    put = lambda side, p: f"array(named_struct('w', x.{side}.w, 'h', x.{side}.h, 'id', x.{side}.id, 'more', CAST(greatest(0D, least(1D, x.{p})) AS BIGINT)))"
    after = (
        f"named_struct('rest', CASE WHEN {open_a} THEN {keep('a', 'p')} WHEN {open_b} THEN {keep('b', 'q')} END,"
        f" 'done', concat(s.done, if({open_a}, CAST(array() AS {done}), {put('a', 'p')}), if({open_b}, CAST(array() AS {done}), {put('b', 'q')})))"
    )
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    step = let(pair, "x", let(moved, "x", let(settled, "x", after)))
    return F.expr(
        f"aggregate(units, named_struct('rest', CAST(NULL AS {unit}), 'done', CAST(array() AS {done})),"
        f" (s, u) -> if(s.rest IS NULL, named_struct('rest', u, 'done', s.done), {step}))"
    )


def _settle(last: DataFrame, leaves: DataFrame) -> DataFrame:
    """The last document of each source, taken once more or not, and what then changes in its leaf block: (source, id, more).

    Either way moves that document off its fraction by some of its words. Settled documents of the block it comes from, from long to
    short, change sides as long as they fit into what remains. Of the two ways the one that leaves fewer words is taken, of equal ones the drawn one.
    """
    owed = last.select(
        F.col("source").alias("__last"),
        "u",
        "drawn",
        F.pmod("u.h", "__blocks").alias("__leaf"),
        F.explode(F.array(F.lit(0).cast("bigint"), F.lit(1).cast("bigint"))).alias("way"),
    ).withColumn("owed", (F.col("u.p") - F.col("way")) * F.col("u.w"))
    blocks = owed.join(leaves, F.col("__last").eqNullSafe(F.col("source")) & (F.col("__leaf") == F.col("b")))
    changes = F.expr(
        "aggregate(array_sort(filter(f.done, d -> d.more = if(owed > 0, 0, 1)), (x, y) -> CASE WHEN x.w > y.w THEN -1 WHEN x.w < y.w THEN 1 WHEN x.h > y.h THEN -1 WHEN x.h < y.h THEN 1 ELSE 0 END),"
        f" named_struct('left', abs(owed), 'moved', CAST(array() AS array<{DONE}>)),"
        " (s, d) -> if(d.w <= s.left, named_struct('left', s.left - d.w, 'moved', concat(s.moved, array(d))), s))"
    )
    tried = blocks.withColumn("c", changes)
    best = tried.groupBy("source").agg(F.min_by(F.struct("u", "way", "owed", "c.moved"), F.struct("c.left", F.when(F.col("way") == F.col("drawn"), 0).otherwise(1))).alias("x"))
    sign = F.when(F.col("x.owed") > 0, F.lit(1)).otherwise(F.lit(-1)).cast("bigint")
    own = best.select("source", F.col("x.u.id").alias("id"), F.col("x.way").alias("more"))
    return own.unionByName(best.select("source", sign.alias("more"), F.explode("x.moved").alias("d")).select("source", "d.id", "more"))


def _plan_units(
    df: DataFrame,
    *,
    key: str = "doc_id",
    source: str = "source",
    text: str = "text",
    weights: tuple[int, ...] = (1, 2, 3),
    share: float = 1.0,
    most: int = 3,
    seed: int = 3,
    block: int = 64,
) -> DataFrame:
    """What to take of equal rows (__key, text_hash, source, size): all ``n`` rows ``base`` times, ``extra`` of them once more."""
    ensure_checkpoint_dir(df.sparkSession)
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    units = (
        df.select(F.col(key).alias("__key"), F.col(source).cast("string").alias("source"), F.regexp_count(value, F.lit(WORD)).cast("bigint").alias("size"), F.xxhash64(value).alias("text_hash"))
        .groupBy("__key", "source", "size", "text_hash")
        .agg(F.count(F.lit(1)).alias("n"))
        .checkpoint()
    )
    sources = source_targets(units.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"), F.count(F.lit(1)).alias("__units")), weights, share, most)
    sources = sources.select("source", "source_size", "target", F.ceil(F.col("__units") / block).cast("bigint").alias("__blocks"), F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0).alias("rate")).checkpoint()
    widest = sources.agg(F.coalesce(F.max("__blocks"), F.lit(1))).first()[0]
    named = sources.select(F.col("source").alias("__source"), "source_size", "target", "__blocks", "rate")
    rated = (
        units.join(named, F.col("source").eqNullSafe(F.col("__source")))
        .drop("__source")
        .withColumn("base", F.floor("rate"))
        .withColumn("__sum", (F.col("rate") - F.col("base")) * F.col("n"))
        .withColumn("sure", F.floor("__sum"))
        .withColumn("p", F.col("__sum") - F.col("sure"))
        .withColumn("h", F.xxhash64(F.lit(seed), "__key", "text_hash", "size", "source"))
        .withColumn("id", F.struct(F.col("__key").cast("string").alias("key"), F.col("text_hash").alias("n")))
    )
    level = 0
    fractions = rated.where((F.col("p") > 0) & (F.col("size") > 0)).select(
        "source", F.pmod("h", "__blocks").alias("b"), F.struct(F.col("size").alias("w"), "h", "p", "id").alias("u")
    )
    decided = []
    leaves = None
    while True:
        folded = (
            fractions.groupBy("source", "b")
            .agg(F.sort_array(F.collect_list("u"), asc=False).alias("units"))
            .select("source", "b", _fold(seed, level).alias("f"))
            .checkpoint()
        )
        leaves = folded if leaves is None else leaves
        decided.append(folded.select("source", F.explode("f.done").alias("d")).select("source", "d.id", "d.more"))
        left = folded.where("f.rest IS NOT NULL").select("source", F.floor(F.col("b") / block).alias("b"), F.col("f.rest").alias("u"))
        if widest <= 1:
            break
        fractions, widest, level = left, math.ceil(widest / block), level + 1
    last = left.select("source", "u", F.expr(f"CAST({_draw(str(seed), '-1', 'u.h')} < u.p AS BIGINT)").alias("drawn"))
    decided.append(_settle(last.join(named, F.col("source").eqNullSafe(F.col("__source"))), leaves))
    more = decided[0]
    for part in decided[1:]:
        more = more.unionByName(part)
    more = more.groupBy(F.col("source").alias("__source"), F.col("id").alias("__id")).agg(F.sum("more").alias("more"))
    each = rated.join(more, F.col("source").eqNullSafe(F.col("__source")) & F.col("id").eqNullSafe(F.col("__id")), "left")
    extra = F.col("sure") + F.coalesce(F.col("more"), F.lit(0))
    return each.select("__key", "text_hash", "source", "size", "source_size", "target", "n", F.col("base").cast("bigint").alias("base"), extra.cast("bigint").alias("extra"))


def plan_mix(df: DataFrame, *, key: str = "doc_id", **options) -> DataFrame:
    """What to take: ``key, text_hash, source, size, source_size, target, copies, taken`` for every row.

    ``size`` counts the words of ``text``; ``taken`` is ``copies * size``. Options:
    ``source``, ``text``, ``weights``, ``share``, ``most``, ``seed``, ``block``.
    """
    each = numbered(_plan_units(df, key=key, **options), "n", "__copy")
    copies = F.col("base") + F.when(F.col("__copy") <= F.col("extra"), 1).otherwise(0)
    return each.withColumn("copies", copies.cast("bigint")).select(
        F.col("__key").alias(key), "text_hash", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")
    )


def mix(df: DataFrame, *, key: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mixed rows themselves: each row of ``df`` as often as its copies say.

    Texts move once, to their plan. Rows with equal key, text and source are counted before
    they are told apart by their other columns, so a row repeated for a third of the table
    is a few counts; columns must be orderable (no maps).
    """
    unit = ["__key", "__hash", "__from"]
    plan = _plan_units(df, key=key, text=text, source=source, **options)
    plan = plan.select(F.col("__key"), F.col("text_hash").alias("__hash"), F.col("source").alias("__from"), F.col("n").alias("__n"), F.col("base").alias("__base"), F.col("extra").alias("__extra")).checkpoint()
    rows = df.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col(text).cast("string"), F.lit(""))))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__text_hash") == F.col("__hash")) & F.col(source).cast("string").eqNullSafe(F.col("__from"))
    single = rows.join(plan.where("__n = 1"), same).withColumn("__times", F.col("__base") + F.col("__extra"))

    equal = rows.join(plan.where("__n > 1"), same).groupBy(*[F.col(c) for c in df.columns], *unit, "__n", "__base", "__extra").agg(F.count(F.lit(1)).alias("__rows"))
    equal = equal.withColumn("__row", F.xxhash64(*[F.col(c) for c in df.columns])).withColumn("__part", F.pmod("__row", F.ceil(F.col("__n") / CHUNK))).checkpoint()
    parts = equal.groupBy(*unit, "__part").agg(F.sum("__rows").alias("__held"))
    earlier = F.coalesce(F.sum("__held").over(Window.partitionBy(*unit).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select(*[F.col(c).alias(f"{c}_2") for c in (*unit, "__part")], earlier.alias("__start"))
    there = (F.col("__part") == F.col("__part_2")) & (F.col("__hash") == F.col("__hash_2")) & F.col("__key").eqNullSafe(F.col("__key_2")) & F.col("__from").eqNullSafe(F.col("__from_2"))
    within = Window.partitionBy(*unit, "__part").orderBy("__row", *[F.col(c) for c in df.columns]).rowsBetween(Window.unboundedPreceding, -1)
    more = F.least(F.col("__rows"), F.greatest(F.lit(0), F.col("__extra") - F.col("__start") - F.coalesce(F.sum("__rows").over(within), F.lit(0))))
    repeated = equal.join(starts, there).withColumn("__times", F.col("__base") * F.col("__rows") + more)

    return numbered(single.select(*df.columns, "__times").unionByName(repeated.select(*df.columns, "__times")).where("__times > 0"), "__times", "__time").select(*df.columns)
