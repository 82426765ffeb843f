"""Cheapest repair of damaged conversations.

A conversation is legal if the initials of its roles read ``(s?(ua)+)?``. Edits are Keep (0), Rerole
to user or assistant (3), Delete (4, the only one for blank and duplicate rows) and Insert of an empty user or assistant
turn anywhere (3); a truncated row that stays costs 3 more. The rows of a conversation and the four states of
that pattern (nothing yet, after s, after u, after a) span a graph whose paths are repairs. Costs are small whole numbers, so
Dial's bucket queue gives the distance of every node from the end; many conversations share its buckets. Then each conversation
walks from its start, always along the tight arc with the least initial.

Rows are told apart by a digest of their text, so texts move once, to the rows that stay. Rows are dealt out by
ranges of (conversation, turn, role, digest): the rows of a conversation within a range are a run. A
conversation that spans many ranges is many runs: each gives its 4 x 4 least costs from state to state; these, chained from the
end, give each run its distances; walks from each of the four states, chained from the start, tell where the run begins.

Nulls in role and text are one space; a null turn comes first; a null conversation is one of its own. Rows of one turn are ordered by
role, then by the SHA-256 of their text; equal rows are counted before they move, all but the first are duplicates. An empty role, like any
other initial, can't be kept. Empty texts are blank. An empty table gives empty results. Only the four columns are read, so
others may have any names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorecraft.session import ensure_checkpoint_dir, ship_package

KEEP, REROLE, DELETE, INSERT, CUT = 0, 3, 4, 3, 3
#: Initials in the order of a walk; and the costs of DELETE, INSERT, KEEP, REROLE in that order.
EDITS = "DIKR"
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state, the state after a new or reroled turn: after u only a can follow, else only u.
NEXT = np.array([USER, USER, ASSISTANT, USER])
#: From each state, the state after a kept row with initial s, u, a or another; -1 where it can't follow.
KEPT = np.array([[SYSTEM, USER, -1, -1], [-1, USER, -1, -1], [-1, -1, ASSISTANT, -1], [-1, USER, -1, -1]])
#: Distances from the states at the end: only nothing at all and a last assistant turn are legal.
ENDS = [0, None, None, 0]
FAR = np.int64(1) << 60
BLANK, DUPLICATE, TRUNCATED = 1, 2, 3
WHITE = " \t\n\x0b\x0c\r"


@dataclass
class Runs:
    """Rows of many runs, one after the other: initial (0 to 3) and fault of each, and how many rows each run has."""

    initial: np.ndarray
    fault: np.ndarray
    sizes: np.ndarray

    def __post_init__(self) -> None:
        n, k = len(self.initial), len(self.sizes)
        ends = np.cumsum(self.sizes)
        self.first = ends - self.sizes + np.arange(k)  # layers: one more than rows in each run
        self.last = ends + np.arange(k)
        self.row = np.full(n + k, -1, np.int64)  # that leads to a layer
        inner = np.ones(n + k, bool)
        inner[self.first] = False
        self.row[inner] = np.arange(n)
        self.stays = (self.fault != BLANK) & (self.fault != DUPLICATE)
        self.more = np.where(self.fault == TRUNCATED, CUT, 0)

    def distances(self, ends: np.ndarray) -> np.ndarray:
        """Of all nodes (layer, state) from the end; ``ends``: distances from the states at the end of each run."""
        far = np.full((len(self.row), 4), FAR)
        far[self.last] = ends
        flat = far.reshape(-1)
        buckets: dict[int, list[np.ndarray]] = {}
        known = flat[(begin := (self.last[:, None] * 4 + np.arange(4)).reshape(-1))]
        for d in np.unique(known[known < FAR]).tolist():
            buckets[d] = [begin[known == d]]
        done = np.zeros(len(flat), bool)
        d = min(buckets, default=0)

        def relax(nodes: np.ndarray, cost: int) -> None:
            nodes = nodes[flat[nodes] > cost]
            if len(nodes):
                flat[nodes] = cost
                buckets.setdefault(cost, []).append(nodes)

        while buckets:
            if d not in buckets:
                d += 1  # costs are small: the next bucket is near
                continue
            nodes = np.unique(np.concatenate(buckets.pop(d)))
            nodes = nodes[~done[nodes] & (flat[nodes] == d)]
            done[nodes] = True
            layer, state = nodes >> 2, nodes & 3
            row = self.row[layer]
            inner = row >= 0
            above, row, state_of = (layer[inner] - 1) * 4, row[inner], state[inner]
            relax(above + state_of, d + DELETE)
            stays = self.stays[row]
            above, row, state_of = above[stays], row[stays], state_of[stays]
            for q in range(4):
                relax(layer[state == NEXT[q]] * 4 + q, d + INSERT)
                kept, other = KEPT[q, self.initial[row]] == state_of, state_of == NEXT[q]
                for more in (0, CUT):
                    own = self.more[row] == more
                    relax(above[kept & own] + q, d + KEEP + more)
                    relax(above[other & own] + q, d + REROLE + more)
        return far

    def walk(self, far: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, ...]:
        """The steps of all runs: run, edit (place in EDITS), row (-1 for an insertion), state after it; and the last state of each run."""
        steps: list[tuple[np.ndarray, ...]] = []
        run, layer, state = np.arange(len(self.sizes)), self.first.copy(), starts.copy()
        final = starts.copy()
        while len(run):
            here = far[layer, state]
            more = ~((layer == self.last[run]) & (here == ends[run, state]))
            final[run[~more]] = state[~more]
            run, layer, state, here = run[more], layer[more], state[more], here[more]
            inner = layer < self.last[run]
            below = np.where(inner, layer + 1, layer)
            row = np.where(inner, self.row[below], -1)
            stays = inner & self.stays[row]
            after, kept = NEXT[state], KEPT[state, self.initial[row]]
            cut = self.more[row]
            tight = [
                inner & (far[below, state] + DELETE == here),
                far[layer, after] + INSERT == here,
                stays & (kept >= 0) & (far[below, kept] + KEEP + cut == here),
                stays & (far[below, after] + REROLE + cut == here),
            ]
            edit = np.argmax(tight, axis=0) if len(run) else np.zeros(0, np.int64)
            to = np.choose(edit, [state, after, kept, after])
            steps.append((run, edit, np.where(edit == 1, -1, row), to))
            layer, state = np.where(edit == 1, layer, below), to
        parts = [np.concatenate([s[k] for s in steps] or [np.zeros(0, np.int64)]) for k in range(4)]
        order = np.argsort(parts[0], kind="stable")
        return *(p[order] for p in parts), final


def vectors(rows: list[list[int | None] | None]) -> np.ndarray:
    """Distances of states, null for none."""
    return np.array([[FAR if x is None else x for x in row] for row in rows], np.int64).reshape(-1, 4)


def marked(df: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` without nulls in the latter two, and of the text its digest, whether it is blank, and whether it is cut off."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text"))
    end = F.rtrim(F.col("text"), F.lit(WHITE))
    rows = df.select("conv_id", F.col("turn").cast("bigint").alias("turn"), role, text)
    return rows.select("*", F.unhex(F.sha2("text", 256)).alias("digest"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))


KEYS = ["turn", "role", "digest"]
HEAD = "struct<has:boolean,turn:bigint,role:string,digest:binary>"
STATS = "first_initial string, last_initial string, first_turn bigint, last_turn bigint, least bigint, most bigint, turns bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint"
LEGAL = ("su", "ua", "au")


def repair(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A report and the repaired rows of conversations with ``conv_id``, ``turn``, ``role`` and ``text``.

    Report, a row for each conversation: ``gaps`` (turns that lack between the first and the last), ``blank``, ``duplicate`` and ``truncated``
    (rows by their first fault), ``illegal`` (neighbours whose initials are none of su, ua, au), ``cost`` and ``audit`` (the initials of the
    edits in order). Repaired: ``conv_id``, ``position`` from 0, ``turn`` (null for an insertion), ``role``, ``text``.
    """
    spark = df.sparkSession
    ship_package(spark)
    shared = f"{ensure_checkpoint_dir(spark)}/conversations-{uuid.uuid4().hex}"
    rows = marked(df)
    one = rows.groupBy("conv_id", *KEYS, "blank", "cut").agg(F.count(F.lit(1)).alias("n"))
    when = F.struct(F.col("turn").isNotNull().alias("has"), "turn")
    firsts = one.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(when).alias("earliest"), F.count(F.lit(1)).alias("m")).where("m > 1").drop("m")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    seen = F.coalesce(F.col("earliest") < when, F.lit(False))
    fault = F.when(F.col("blank"), BLANK).when(seen, DUPLICATE).when(F.col("cut"), TRUNCATED).otherwise(0).cast("int").alias("fault")
    ranged = one.join(firsts, same, "left").select("conv_id", *KEYS, "n", fault).repartitionByRange("conv_id", *KEYS).sortWithinPartitions("conv_id", *KEYS)
    number = df.schema["conv_id"].dataType.simpleString()
    listed = "rows array<struct<turn:bigint,role:string,digest:binary,n:bigint,fault:int>>"

    ranged.mapInArrow(_runs, f"conv_id {number}, run bigint, border boolean, head {HEAD}, {listed}, {STATS}, costs array<int>").write.parquet(f"{shared}/runs")
    runs = spark.read.parquet(f"{shared}/runs")

    # conversations that reach over the border of a range: at most two runs of each range
    border = runs.where("border")
    ends = border.select("conv_id", "run", "head", "costs", "first_initial", "last_initial", "first_turn", "last_turn").groupBy("conv_id").applyInArrow(_ends, "run bigint, ends array<bigint>, more_illegal bigint, same_turn bigint")
    ends.write.parquet(f"{shared}/ends")
    ends = spark.read.parquet(f"{shared}/ends")
    walked = border.select("conv_id", "run", "head", "rows").join(ends, "run").mapInArrow(_walked, f"conv_id {number}, run bigint, head {HEAD}, lasts array<int>, sizes array<bigint>")
    starts = walked.groupBy("conv_id").applyInArrow(_starts, "run bigint, start int, offset bigint")
    placed = runs.join(ends, "run", "left").join(starts, "run", "left")
    out = "array<struct<position:bigint,turn:bigint,old:string,role:string,digest:binary>>"
    placed.mapInArrow(_edited, f"conv_id {number}, head {HEAD}, {STATS}, more_illegal bigint, same_turn bigint, cost bigint, audit string, out {out}").write.parquet(f"{shared}/edited")
    edited = spark.read.parquet(f"{shared}/edited")

    long = lambda c: F.sum(c).cast("bigint").alias(c)
    gaps = "try_cast(CAST(max(most) AS DECIMAL(20, 0)) - min(least) + 1 - (sum(turns) - sum(same_turn)) AS BIGINT)"
    report = edited.groupBy("conv_id").agg(
        F.when(F.max("most").isNull(), F.lit(0)).otherwise(F.expr(gaps)).alias("gaps"), long("blank"), long("duplicate"), long("truncated"),
        (F.sum("illegal") + F.sum("more_illegal")).cast("bigint").alias("illegal"), long("cost"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("head", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    own = rows.groupBy(*[F.col(c).alias(f"_{c}") for c in ("conv_id", *KEYS)]).agg(F.first("text").alias("_text"))
    kept = edited.select("conv_id", F.explode("out").alias("o")).select("conv_id", "o.*")
    found = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & F.col("turn").eqNullSafe(F.col("_turn")) & (F.col("old") == F.col("_role")) & (F.col("digest") == F.col("_digest"))
    with_text = kept.where("digest IS NOT NULL").join(own, found).select("conv_id", "position", "turn", "role", F.col("_text").alias("text"))
    new = kept.where("digest IS NULL").select("conv_id", "position", "turn", "role", F.lit("").alias("text"))
    return report, with_text.unionByName(new)


def digests(repaired: DataFrame) -> DataFrame:
    """``conv_id, repaired_sha256`` of the lines ``role:text``, joined by line feeds; rows of a conversation pass in order and are never held together."""
    number = repaired.schema["conv_id"].dataType.simpleString()
    lines = repaired.select("conv_id", "position", F.concat("role", F.lit(":"), "text").alias("line"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begun, last, state = False, None, sha256()
        for batch in batches:
            ids, found = [], []
            for c, line in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if begun and c == last:
                    state.update(b"\n")
                else:
                    if begun:
                        ids.append(last), found.append(state.hexdigest())
                    begun, last, state = True, c, sha256()
                state.update(line.encode())
            yield pa.record_batch([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.string())], names=["conv_id", "repaired_sha256"])
        if begun:
            yield pa.record_batch([pa.array([last], batch.schema.field(0).type), pa.array([state.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

    return lines.repartition("conv_id").sortWithinPartitions("conv_id", "position").mapInArrow(hashed, f"conv_id {number}, repaired_sha256 string")


def damage(df: DataFrame) -> DataFrame:
    """Faults by the rest of crc32(``conv_id:turn``) by 20: 0 drops a row, 1 empties its text, 2 removes the ends of sentences, 3 repeats it, 4 makes it the user's. Nulls are one space."""
    of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rest = F.crc32(F.concat(of("conv_id"), F.lit(":"), of("turn")).cast("binary")) % 20
    text = F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text")
    role = F.when(F.col("h") == 4, "user").otherwise(F.col("role")).alias("role")
    rows = df.select("conv_id", "turn", of("role").alias("role"), of("text").alias("text"), rest.alias("h")).where("h <> 0").select("conv_id", "turn", role, text, "h")
    return rows.withColumn("copy", F.explode(F.when(F.col("h") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("h", "copy")


def _expanded(lists: pa.ListArray) -> tuple[Runs, pa.StructArray, np.ndarray]:
    """The runs, their rows, and for each row of a run (copies told apart) which of those it is."""
    rows = lists.flatten()
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    n, fault = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("n", "fault"))
    which = np.repeat(np.arange(len(n)), n)
    again = np.r_[False, which[1:] == which[:-1]] if len(which) else np.zeros(0, bool)
    own = fault[which]
    initial = pc.index_in(pc.utf8_slice_codeunits(rows.field("role"), 0, 1), pa.array(["s", "u", "a"])).fill_null(3).to_numpy(zero_copy_only=False)[which]
    run = np.repeat(np.arange(len(sizes)), sizes)
    counts = np.bincount(run, weights=n, minlength=len(sizes)).astype(np.int64)
    return Runs(initial, np.where(again & (own != BLANK), DUPLICATE, own), counts), rows, which


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of a range, with its figures; those at the borders get their least costs from state to state."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    begun = False

    def close(table: pa.Table, last: bool) -> pa.RecordBatch:
        nonlocal number, begun
        table = table.combine_chunks()
        ids = table.column("conv_id").combine_chunks()
        first = np.r_[0, _changes(ids) + 1]
        rows = pa.StructArray.from_arrays([table.column(c).combine_chunks() for c in (*KEYS, "n", "fault")], names=[*KEYS, "n", "fault"])
        lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(ids)], pa.int32()), rows)
        runs, _, which = _expanded(lists)
        border = np.zeros(len(first), bool)
        border[0] |= not begun
        border[-1] |= last
        begun = True
        at = rows.take(pa.array(first))
        head = pa.StructArray.from_arrays([pc.is_valid(at.field("turn")), *(at.field(c) for c in KEYS)], names=["has", *KEYS])
        initials = np.array(pc.utf8_slice_codeunits(rows.field("role"), 0, 1).to_pylist(), object)[which]
        turns = rows.field("turn")
        ends = np.cumsum(runs.sizes)
        run_of = np.repeat(np.arange(len(first)), runs.sizes)
        odd = np.array([a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:])], bool) & (run_of[1:] == run_of[:-1])
        counts = [np.bincount(run_of[runs.fault == f], minlength=len(first)) for f in (BLANK, DUPLICATE, TRUNCATED)]
        illegal = np.bincount(run_of[1:][odd], minlength=len(first))
        figures: list[list] = [[], [], [], [], []]
        for k in range(len(first)):
            own = lists.flatten().field("turn").slice(int(first[k]), len(lists[k])).drop_null()
            low_high = pc.min_max(own).as_py() if len(own) else {"min": None, "max": None}
            for column, value in zip(figures, (turns[int(first[k])].as_py(), turns[int(first[k]) + len(lists[k]) - 1].as_py(), low_high["min"], low_high["max"], len(own.unique()))):
                column.append(value)
        costs: list[list[int | None] | None] = [None] * len(first)
        for k in np.flatnonzero(border).tolist():
            alone = Runs(runs.initial[run_of == k], runs.fault[run_of == k], runs.sizes[k : k + 1])
            to = [alone.distances(vectors([[0 if r == q else None for q in range(4)]]))[0] for r in range(4)]
            costs[k] = [None if to[r][q] >= FAR else int(to[r][q]) for q in range(4) for r in range(4)]
        out = [
            ids.take(pa.array(first)), pa.array(number + np.arange(len(first)), pa.int64()), pa.array(border), head, lists,
            pa.array(initials[ends - runs.sizes].tolist(), pa.string()), pa.array(initials[ends - 1].tolist(), pa.string()),
            *(pa.array(f, pa.int64()) for f in figures), *(pa.array(c, pa.int64()) for c in (*counts, illegal)), pa.array(costs, pa.list_(pa.int32())),
        ]
        number += len(first)
        return pa.record_batch(out, names=["conv_id", "run", "border", "head", "rows", *(s.split()[0] for s in STATS.split(", ")), "costs"])

    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0)
        changes = _changes(ids)
        cut = int(changes[-1]) + 1 if len(changes) else 0 if held and last != ids[0].as_py() else None
        last = ids[-1].as_py()
        if cut is not None:  # all but the last conversation of the batch are whole
            yield close(pa.Table.from_batches([*held, batch.slice(0, cut)]), False)
            held, batch = [], batch.slice(cut)
        held.append(batch)
    if held:
        yield close(pa.Table.from_batches(held), True)


def _changes(ids: pa.Array) -> np.ndarray:
    """Places before which the id changes, less one."""
    codes = ids.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
    return np.flatnonzero(codes[1:] != codes[:-1])


def _ordered(table: pa.Table) -> list[dict]:
    """The runs of a conversation, in order."""
    key = lambda r: (r["head"]["has"], r["head"]["turn"] or 0, r["head"]["role"], r["head"]["digest"])
    return sorted(table.to_pylist(), key=key)


def _ends(table: pa.Table) -> pa.Table:
    """Distances at the end of each run; faults and equal turns between it and the one before."""
    runs, out = _ordered(table), []
    after: list[int | None] = ENDS
    for k in range(len(runs) - 1, -1, -1):
        run, before = runs[k], runs[k - 1] if k else None
        illegal = before is not None and before["last_initial"] + run["first_initial"] not in LEGAL
        same = before is not None and run["first_turn"] is not None and before["last_turn"] == run["first_turn"]
        out.append({"run": run["run"], "ends": after, "more_illegal": int(illegal), "same_turn": int(same)})
        costs = run["costs"]
        sums = [[costs[4 * q + r] + after[r] for r in range(4) if costs[4 * q + r] is not None and after[r] is not None] for q in range(4)]
        after = [min(s, default=None) for s in sums]
    return pa.Table.from_pylist(out, pa.schema([("run", pa.int64()), ("ends", pa.list_(pa.int64())), ("more_illegal", pa.int64()), ("same_turn", pa.int64())]))


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each run, from each of the four states: the last state, and how many rows stay or are new."""
    for batch in batches:
        if not batch.num_rows:
            continue
        runs, _, _ = _expanded(batch.column(batch.schema.get_field_index("rows")))
        ends = vectors(batch.column(batch.schema.get_field_index("ends")).to_pylist())
        far = runs.distances(ends)
        lasts, sizes = [], []
        for start in range(4):
            run, edit, _, _, final = runs.walk(far, ends, np.full(len(runs.sizes), start))
            lasts.append(final)
            sizes.append(np.bincount(run[edit != 0], minlength=len(runs.sizes)))
        own = [batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "run", "head")]
        yield pa.record_batch([*own, pa.array(np.array(lasts).T.tolist(), pa.list_(pa.int32())), pa.array(np.array(sizes).T.tolist(), pa.list_(pa.int64()))], names=["conv_id", "run", "head", "lasts", "sizes"])


def _starts(table: pa.Table) -> pa.Table:
    """The state that each run starts from, and how many rows the runs before it give."""
    state, offset, out = START, 0, []
    for run in _ordered(table):
        out.append({"run": run["run"], "start": state, "offset": offset})
        state, offset = run["lasts"][state], offset + run["sizes"][state]
    return pa.Table.from_pylist(out, pa.schema([("run", pa.int64()), ("start", pa.int32()), ("offset", pa.int64())]))


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edits of each run, and the rows that they leave."""
    stats = [s.split()[0] for s in STATS.split(", ")]
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda c: batch.column(batch.schema.get_field_index(c))  # noqa: B023, E731
        runs, rows, which = _expanded(column("rows"))
        ends = vectors([e or ENDS for e in column("ends").to_pylist()])
        starts = pc.fill_null(column("start"), START).to_numpy(zero_copy_only=False).astype(np.int64)
        far = runs.distances(ends)
        run, edit, row, state, final = runs.walk(far, ends, starts)
        k = np.arange(len(runs.sizes))
        cost = far[runs.first, starts] - ends[k, final]
        letters = np.frombuffer(EDITS.encode(), np.uint8)[edit]
        cuts = np.searchsorted(run, np.r_[k, len(k)])
        audit = [letters[a:b].tobytes().decode() for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        stays = edit != 0
        run, edit, row, state = run[stays], edit[stays], row[stays], state[stays]
        bounds = np.searchsorted(run, np.r_[k, len(k)])
        offset = pc.fill_null(column("offset"), 0).to_numpy(zero_copy_only=False)
        position = np.arange(len(run)) - bounds[run] + offset[run]
        at = pa.array(np.where(row >= 0, which[row] if len(which) else 0, 0), pa.int64(), mask=row < 0)
        own = rows.take(at)
        fresh = pa.array(np.where(state == USER, "user", "assistant").tolist(), pa.string())
        role = pc.if_else(pa.array(edit == EDITS.index("K")), pc.struct_field(own, "role"), fresh)
        made = pa.StructArray.from_arrays([pa.array(position, pa.int64()), pc.struct_field(own, "turn"), pc.struct_field(own, "role"), role, pc.struct_field(own, "digest")], names=["position", "turn", "old", "role", "digest"])
        out = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), made)
        filled = [pc.fill_null(column(c), 0) for c in ("more_illegal", "same_turn")]
        yield pa.record_batch([column("conv_id"), column("head"), *(column(c) for c in stats), *filled, pa.array(cost, pa.int64()), pa.array(audit, pa.string()), out], names=["conv_id", "head", *stats, "more_illegal", "same_turn", "cost", "audit", "out"])
