"""Repair of conversations against a search over all edits, row by row."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lorecraft.llm import conversations
from lorecraft.llm.conversations import FAR, Runs, damage, digests, repair, vectors
from lorecraft.llm.queries import op12_repair

SCHEMA = "conv_id long, turn long, role string, text string, n_chars long"
INSERTS = {0: [(0, "", []), (2, "I", ["user:"]), (3, "II", ["user:", "assistant:"])], 1: [(1, "", []), (2, "I", ["user:"]), (3, "II", ["user:", "assistant:"])], 2: [(2, "", []), (3, "I", ["assistant:"])], 3: [(3, "", []), (2, "I", ["user:"])]}
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}


def wanted(rows):
    """gaps, blank, duplicate, truncated, illegal, cost, audit and lines of the rows (turn, role, text) of a conversation."""
    rows = sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, faults = set(), []
    for _, role, text in rows:
        end = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {0: (0, "", [])}

    def inserted(best):
        out = {}
        for q, (cost, audit, lines) in best.items():
            for to, edits, more in INSERTS[q]:
                new = (cost + 3 * len(edits), audit + edits, lines + more)
                out[to] = min(out.get(to, new), new)
        return out

    for (_, role, text), fault in zip(rows, faults):
        after = {}
        for q, (cost, audit, lines) in inserted(best).items():
            options = [(q, 4, "D", [])]
            if fault not in ("blank", "duplicate"):
                more, to = 3 * (fault == "truncated"), 3 if q == 2 else 2
                options.append((to, 3 + more, "R", [f"{'assistant' if to == 3 else 'user'}:{text}"]))
                if (q, role[:1]) in KEEPS:
                    options.append((KEEPS[q, role[:1]], more, "K", [f"{role}:{text}"]))
            for to, c, e, line in options:
                new = (cost + c, audit + e, lines + line)
                after[to] = min(after.get(to, new), new)
        best = after
    cost, audit, lines = min(v for q, v in inserted(best).items() if q in (0, 3))
    turns = {t for t, *_ in rows if t is not None}
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def damaged(c, t, role, text):
    h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
    role, text = " " if role is None else role, " " if text is None else text
    text = "" if h == 1 else re.sub(r"[.!?]", "", text) if h == 2 else text
    return [] if h == 0 else [("user" if h == 4 else role, text)] * (1 + (h == 3))


ROLES = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "sys", "Über"]
TEXTS = ["Yes.", "No!", "cut", "why?\n", "odd. ", "", " \t\x0b", None, "x" * 3000 + ".", "end.\x85", " ", "à la carte."]


def talk(r, n, roles=ROLES):
    return [(r.choice([None, k, k, k, r.randrange(n)]), r.choice(roles), r.choice(TEXTS) if r.random() < 0.5 else f"{r.random()}.") for k in range(n)]


def rows_of(talks):
    return [(c, t, role, text, 1) for c, rows in talks.items() for t, role, text in rows]


def found(df):
    report, repaired = repair(df)
    ends = {r[0]: r[1] for r in digests(repaired).collect()}
    return {r["conv_id"]: (*r[1:], ends.get(r["conv_id"], hashlib.sha256(b"").hexdigest())) for r in report.collect()}


@pytest.fixture()
def apart(spark):
    """Ranges stay apart, so conversations span several."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_many_small(spark):
    r = random.Random(1)
    talks = {c: talk(r, r.randint(1, 9)) for c in range(400)} | {None: talk(r, 5)}
    got = found(spark.createDataFrame(rows_of(talks), SCHEMA).repartition(3))
    assert got == {c: wanted(rows) for c, rows in talks.items()}


def test_one_conversation_with_most_rows(spark, apart):
    r = random.Random(2)
    talks = {c: talk(r, 3) for c in range(9)} | {4: talk(r, 700, ["user", "assistant", "system"]), 5: [(0, "user", "Same.")] * 300 + [(k, "assistant", "Same.") for k in range(200)], 6: [(None, "system", "A.")] * 2 + [(k, "user", "B.") for k in range(90)]}
    got = found(spark.createDataFrame(rows_of(talks), SCHEMA).repartition(3))
    assert got == {c: wanted(rows) for c, rows in talks.items()}


def test_small_batches(spark, apart):
    r = random.Random(3)
    talks = {c: talk(r, r.choice([1, 2, 30])) for c in range(40)}
    df = spark.createDataFrame(rows_of(talks), SCHEMA)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found(df) == {c: wanted(rows) for c, rows in talks.items()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_buckets_hold_shortest_distances():
    """Distances from all nodes to each end agree with those of relaxing all arcs until nothing changes."""
    r = np.random.default_rng(4)
    initial, fault = r.integers(0, 4, 60), r.integers(0, 4, 60)
    runs = Runs(initial, fault, np.array([1, 7, 52]))
    ends = vectors([[0, None, None, 0], [2, 5, None, 9], [None, None, 0, None]])
    got = runs.distances(ends)
    want = np.full_like(got, FAR)
    want[runs.last] = ends
    for _ in range(130):
        for layer in range(len(want) - 1, -1, -1):
            for q in range(4):
                to = [want[layer, conversations.NEXT[q]] + 3]
                if layer not in runs.last:
                    row = runs.row[layer + 1]
                    to.append(want[layer + 1, q] + 4)
                    if fault[row] in (0, 3):
                        more = 3 * (fault[row] == 3)
                        to.append(want[layer + 1, conversations.NEXT[q]] + 3 + more)
                        if (k := conversations.KEPT[q, initial[row]]) >= 0:
                            to.append(want[layer + 1, k] + more)
                want[layer, q] = min(want[layer, q], *to)
    assert (np.minimum(got, FAR) == np.minimum(want, FAR)).all()


def test_odd_turns_and_extra_columns(spark):
    talks = {1: [(-(2**63), "user", "A."), (2**63 - 1, "assistant", "B.")], 2: [(None, None, None)], 3: [(5, "assistant", "x" * 1_000_000 + "!")]}
    df = spark.createDataFrame([(c, t, a, b, "n", "o", "r") for c, rows in talks.items() for t, a, b in rows], "conv_id long, turn long, role string, text string, audit string, out string, run string")
    got = found(df)
    assert got[1][0] is None and got[1][5:7] == (0, "KK")  # more turns lack than a long can say
    assert {c: got[c] for c in (2, 3)} == {c: wanted(talks[c]) for c in (2, 3)}


def test_empty(spark):
    report, repaired = repair(spark.createDataFrame([], SCHEMA))
    assert (report.count(), repaired.count(), digests(repaired).count()) == (0, 0, 0)


def test_query(spark, tmp_path):
    r = random.Random(5)
    talks = {c: talk(r, r.randint(1, 8)) for c in [*range(150), None]}
    rows = rows_of(talks)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {g[0]: tuple(g[1:]) for g in op12_repair(spark, str(tmp_path)).collect()}
    want = {}
    for c, own in talks.items():
        left = [(t, role, text) for t, a, b in own for role, text in damaged(c, t, a, b)]
        want[c] = wanted(left) if left else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert got == want
    assert damage(spark.createDataFrame(rows, SCHEMA)).columns == ["conv_id", "turn", "role", "text"]
