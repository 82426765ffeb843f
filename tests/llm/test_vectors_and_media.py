import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorecraft.llm import media as M
from lorecraft.llm import vector_dups as V
from lorecraft.llm.linking import link_classes, shared_members


def brute(rows, threshold=0.93):
    ok = [(i, g, np.array(v, float)) for i, g, v in rows if g is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, root = {i: 0 for i, _, _ in rows}, {i: i for i, _, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, (i, g, v) in enumerate(ok):
        for j, h, w in ok[:a]:
            if g == h and len(v) == len(w) and v @ w / np.linalg.norm(v) / np.linalg.norm(w) >= threshold:
                links[i] += 1
                links[j] += 1
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (links[i], find(i)) for i in links}


@pytest.mark.parametrize("block, codewords", [(2048, 256), (16, 16), (64, 64)])
def test_vectors_against_brute_force(spark, monkeypatch, block, codewords):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "CODEWORDS", codewords)  # fewer vectors have lists and codes
    r = np.random.default_rng(3)
    rows, n = [], 0
    for g in range(3):
        for _ in range(25):
            c = r.normal(size=16)
            for k in range(r.integers(1, 6)):
                rows.append((n, g, (c + k * 0.12 * r.normal(size=16)).tolist()))
                n += 1
    rows += [(1000 + i, 0, rows[0][2]) for i in range(40)]  # a hot vector
    rows += [(2000, None, rows[0][2]), (2001, 0, None), (2002, 0, [0.0] * 16), (2003, 0, [float("nan")] * 16), (2004, 0, [float("inf")] * 16), (2005, 0, []), (2006, 0, [1.0]), (2007, 0, [None] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").withColumn("kept", F.lit("clash"))
    got = {x["vec_id"]: x for x in V.vector_duplicates(df).collect()}
    want = brute(rows)
    found = sum(x["n_links"] for x in got.values())
    assert found == sum(n for n, _ in want.values())
    assert all(got[i]["n_links"] == n and got[i]["component_id"] == c for i, (n, c) in want.items())
    assert all(x["kept"] == (x["component_id"] == i) for i, x in got.items())
    assert all(got[i]["n_links"] == 0 and got[i]["kept"] for i in range(2000, 2008))


def test_all_lengths_are_compared(spark, monkeypatch):
    monkeypatch.setattr(V, "BLOCK", 16)
    r = np.random.default_rng(4)
    rows = [(i, 0, (r.normal(size=6) + 2).tolist()) for i in range(60)]
    rows += [(100, 0, [1.0, 0.0, 0.0]), (101, 0, [1.0, 0.01, 0.0]), (102, 1, [1.0, 0.0, 0.0])]
    rows += [(200 + i, 0, (r.normal(size=3)).tolist()) for i in range(40)]
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in V.vector_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    assert got == brute(rows)


@pytest.mark.parametrize("k", [2, 4, 8, 64])
def test_probes_find_links_of_data_with_few_dimensions(k):
    r = np.random.default_rng(k)
    turn = np.linalg.qr(r.normal(size=(64, 64)))[0][:k]
    x = r.normal(size=(1500, k))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    step = r.normal(size=x.shape)
    step -= (step * x).sum(1, keepdims=True) * x
    step /= np.linalg.norm(step, axis=1, keepdims=True)
    angle = np.arccos(0.931)
    y = (np.cos(angle) * x + np.sin(angle) * step) @ turn
    x = x @ turn
    sample = np.r_[x[:800], y[800:]]
    for spread, least in ((3.5, 0.99), (None, 1.0)):
        q = V.Quantizer.fit(sample, 64, 0.93, spread=spread)
        (own_x, _, _, at_x), (own_y, _, _, at_y) = q.encode(x), q.encode(y)
        found = [b in p or a in s for a, b, p, s in zip(own_x, own_y, at_x, at_y)]
        assert np.mean(found) >= least


def test_sizes_of_vectors_do_not_matter(spark):
    r = np.random.default_rng(8)
    near = [(1e200, 1e200), (1e200, 1.0001e200), (1e-200, 1e-200), (5e-324, 5e-324), (1.7e308, 1.7e308), (1e-200, -1e-200), (1.0, 0.0)]
    rows = [(i, 0, list(v)) for i, v in enumerate(near)] + [(100 + i, 1, (v * 10.0 ** r.integers(-300, 300)).tolist()) for i, v in enumerate(r.normal(size=(300, 4)))]
    got = {x["vec_id"]: (x["n_links"], x["component_id"]) for x in V.vector_duplicates(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")).collect()}
    scaled = brute([(i, g, (np.array(v) / np.abs(v).max()).tolist()) for i, g, v in rows])
    assert got == scaled and got[0] == (4, 0) and got[5] == (0, 5)


def test_vector_edges(spark):
    kind = "vec_id long, label int, embedding array<float>"
    assert V.vector_duplicates(spark.createDataFrame([], kind)).count() == 0
    rows = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 0, [1.0, 0.0]), (None, 0, [1.0, 0.0]), (3, 0, [2.0, 0.0])], kind)
    got = sorted((x["vec_id"] or -1, x["n_links"], x["component_id"]) for x in V.vector_duplicates(rows).collect())
    assert got == [(-1, 0, None), (1, 2, 1), (1, 2, 1), (3, 2, 1)]
    again = spark.createDataFrame([(1, 0, [1.0, 0.0]), (1, 0, [0.0, 1.0]), (2, 0, [0.1, 1.0])], kind)  # an id of two vectors
    got = sorted((x["vec_id"], x["n_links"], x["component_id"]) for x in V.vector_duplicates(again).collect())
    assert got == [(1, 0, 1), (1, 1, 1), (2, 1, 1)]


def test_codes_rule_out_no_link():
    r = np.random.default_rng(5)
    x = r.normal(size=(600, 32))
    y = x + 0.25 * r.normal(size=x.shape)
    x, y = (a / np.linalg.norm(a, axis=1, keepdims=True) for a in (x, y))
    q = V.Quantizer.fit(np.r_[x, y], 8, 0.93)
    own, codes, error, _ = q.encode(y)
    for which in range(8):
        inside = np.flatnonzero(own == which)
        if len(inside):
            i, j = q.candidates(x, which, codes[inside], error[inside])
            near = set(zip(*np.nonzero(x @ y[inside].T >= 0.93)))
            assert near <= set(zip(i.tolist(), j.tolist()))


def picture(seed: int, side: int = 24, zoom: int = 4) -> np.ndarray:
    grey = np.clip(128 + 50 * np.random.default_rng(seed).normal(size=(side, side)), 0, 255)
    return np.kron(grey, np.ones((zoom, zoom))).astype(np.uint8)


def pgm(a: np.ndarray) -> bytes:
    return b"P5\n# made here\n%d %d\n255\n" % (a.shape[1], a.shape[0]) + a.astype(np.uint8).tobytes()


def png(a: np.ndarray, kind: int) -> bytes:
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    lines, before = b"", np.zeros(a.shape[1] + 1, int)
    for row in a.astype(int):
        left, up, corner = np.r_[0, row[:-1]], before[1:], before[:-1]
        guess = [0 * row, left, up, (left + up) // 2][kind] if kind < 4 else np.array([min((abs(u - c), 0, x), (abs(x - c), 1, u), (abs(x + u - 2 * c), 2, c))[2] for x, u, c in zip(left, up, corner)])
        lines += bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = np.r_[0, row]
    head = struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines)) + chunk(b"IEND", b"")


def test_decoding():
    a = picture(1)
    assert (M.decode(pgm(a)) == a).all()
    for kind in range(5):
        assert (M.decode(png(a, kind)) == a).all()
    for bad in (None, b"", b"P5", b"P5 9 9 255\nshort", b"\x89PNG\r\n\x1a\nxx", b"GIF89a", png(a, 0)[:60]):
        assert M.decode(bad) is None


def test_copies_are_found(spark):
    rows = [(i, pgm(picture(i))) for i in range(25)]
    rows += [(100 + i, pgm(picture(i)[10:86, 8:84])) for i in range(5)]  # cropped
    rows += [(200 + i, pgm(np.clip(picture(i).astype(float) * 1.2 + 10, 0, 255))) for i in range(5, 10)]  # brighter
    rows += [(300 + i, pgm(np.rot90(picture(i)))) for i in range(10, 13)]
    rows += [(400 + i, pgm(np.clip(picture(i) + np.random.default_rng(i).normal(0, 6, (96, 96)), 0, 255))) for i in range(13, 16)]
    rows += [(500 + i, pgm(picture(20))) for i in range(30)]  # a hot image
    rows += [(600, None), (601, b""), (602, b"junk"), (603, pgm(np.zeros((96, 96)))), (604, pgm(np.zeros((1, 1)))), (None, pgm(picture(3)))]
    df = spark.createDataFrame(rows, "id long, media binary").withColumn("class_id", F.lit("clash"))
    got = {x["id"]: x for x in M.image_copies(df).collect()}
    want = {i: i for i in range(25)} | {100 + i: i for i in range(5)} | {200 + i: i for i in range(5, 10)} | {300 + i: i for i in range(10, 13)} | {400 + i: i for i in range(13, 16)} | {500 + i: 20 for i in range(30)}
    assert {i: got[i]["class_id"] for i in want} == want
    assert all(got[i]["kept"] and got[i]["n_corners"] == 0 for i in range(600, 605)) and got[None]["kept"]
    assert M.image_copies(spark.createDataFrame([], "id long, media binary")).count() == 0


def test_rendered_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [])], "vec_id long, v array<double>")
    got = {r["vec_id"]: r["media"] for r in M.render_vectors(df, vector="v").collect()}
    assert M.decode(bytes(got[0])).shape == (96, 96) and got[1] is None and got[2] is None and got[3] is None


def test_linking_tests_what_could_join(spark):
    members = shared_members(spark.createDataFrame([(0, i) for i in range(6)] + [(1, 9)], "bucket long, item long"))
    true = {(1, 2), (2, 3), (4, 5)}
    links = spark.createDataFrame(sorted(true), "a long, b long")
    got = {r["id"]: r["component"] for r in link_classes(members, lambda pairs: pairs.join(links, ["a", "b"])).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def textured(seed: int, side: int = 160) -> np.ndarray:
    """Smooth noise of several scales with a few rectangles."""
    r, a = np.random.default_rng(seed), np.zeros((side, side))
    for s in (4, 8, 16, 32, 64):
        n = side // s + 2
        g, t = r.normal(size=(n, n)), np.arange(side) / s
        i, f = t.astype(int), t - t.astype(int)
        g = g[i] * (1 - f)[:, None] + g[i + 1] * f[:, None]
        a += (g[:, i] * (1 - f) + g[:, i + 1] * f) * s**0.7
    for _ in range(30):
        x, y, w, h = *r.integers(0, side - 20, 2), *r.integers(6, 40, 2)
        a[y : y + h, x : x + w] += r.normal() * 12
    return np.rint(np.clip((a - a.mean()) / a.std() * 45 + 128, 0, 255))


def turned(a: np.ndarray, degrees: float) -> np.ndarray:
    n = len(a)
    y, x = np.mgrid[:n, :n] - n / 2
    c, s = np.cos(np.deg2rad(degrees)), np.sin(np.deg2rad(degrees))
    u, v = np.clip(x * c - y * s + n / 2, 0, n - 1.001), np.clip(x * s + y * c + n / 2, 0, n - 1.001)
    u0, v0 = np.minimum(u.astype(int), n - 2), np.minimum(v.astype(int), n - 2)
    fu, fv = u - u0, v - v0
    return np.rint((a[v0, u0] * (1 - fu) + a[v0, u0 + 1] * fu) * (1 - fv) + (a[v0 + 1, u0] * (1 - fu) + a[v0 + 1, u0 + 1] * fu) * fv)


EDITS = {
    "crop to 60 %": (0.85, lambda a: a[21:117, 21:117]),
    "shrink by 1.5": (0.9, lambda a: np.rint(M._shrink(a, 1.5))),
    "shrink by 2": (0.9, lambda a: np.rint(a.reshape(80, 2, 80, 2).mean((1, 3)))),
    "turn by 15": (0.9, lambda a: turned(a, 15)),
    "noise": (0.9, lambda a: np.clip(a + np.random.default_rng(1).normal(0, 6, a.shape), 0, 255)),
    "blur": (0.9, lambda a: np.rint(M._box(a, 1))),
    "brighter": (0.9, lambda a: np.clip(a * 1.2 + 8, 0, 255)),
}


def test_recall_of_edited_copies(spark):
    """End to end, with the classes of all pairs by ``agreeing`` as the other measure."""
    images = {i: textured(i) for i in range(30)}
    for k, (_, edit) in enumerate(EDITS.values(), 1):
        images |= {100 * k + i: edit(images[i]) for i in range(30)}
    got = {x["id"]: x["class_id"] for x in M.image_copies(spark.createDataFrame([(i, pgm(a)) for i, a in images.items()], "id long, media binary")).collect()}
    assert all(got[i] in (i, i % 100) for i in got)  # unrelated images stay apart
    for k, (name, (least, _)) in enumerate(EDITS.items(), 1):
        assert np.mean([got[100 * k + i] == i for i in range(30)]) >= least, name
    found = {i: M.corners(a, 96) for i, a in images.items() if i % 100 < 8}
    links = [(i, j) for i in found for j in found if i < j and M.agreeing(found[i], found[j]) >= 8]
    assert len(links) > 100 and np.mean([got[i] == got[j] for i, j in links]) >= 0.99


@settings(max_examples=300, deadline=None)
@given(st.sampled_from(range(8)), st.lists(st.tuples(st.integers(0, 400), st.integers(0, 255)), max_size=6), st.integers(0, 1200))
def test_any_bytes_decode_or_not(which, changes, cut):
    data = bytearray([*(png(picture(1, 12, 2), k) for k in range(5)), pgm(picture(1, 12, 2)), b"\x89PNG\r\n\x1a\n", b"P6 2 2 255\n" + bytes(12)][which])
    for at, value in changes:
        if at < len(data):
            data[at] = value
    image = M.decode(bytes(data[: len(data) - cut if cut < len(data) else cut]))
    assert image is None or (image.ndim == 2 and len(M.corners(image, 8) if min(image.shape) > 2 else []) <= 8)


def test_media_that_break(spark):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    head = lambda w, h, colour: b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, colour, 0, 0, 0))
    bad = [
        b"\x89PNG\r\n\x1a\n",
        b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", zlib.compress(bytes(9))),
        head(2, 2, 3) + chunk(b"IDAT", zlib.compress(bytes(6))),  # no palette
        head(2, 2, 9) + chunk(b"IDAT", zlib.compress(bytes(6))),
        head(1 << 30, 1 << 30, 0) + chunk(b"IDAT", zlib.compress(bytes(6))),
        head(0, 5, 0) + chunk(b"IDAT", zlib.compress(b"")),
        b"P5 999999 999999 255\n",
        b"P5 0 0 255\n",
    ]
    assert all(M.decode(b) is None or not M.decode(b).size for b in bad)
    rows = [(i, b) for i, b in enumerate(bad)] + [(100 + i, b) for i, b in enumerate(bad)]
    got = {x["id"]: x["class_id"] for x in M.image_copies(spark.createDataFrame(rows, "id long, media binary")).collect()}
    assert all(got[i] == got[100 + i] == i for i in range(len(bad)))  # equal bytes are copies all the same
