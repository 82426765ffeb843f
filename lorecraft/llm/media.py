"""Edited and cropped copies among images, by local descriptors and geometric consensus.

An image is decoded to grey levels (PGM, PPM, and PNG of 8 bits a sample, not
interlaced, of at most ``MOST_PIXELS``) and shrunk by steps of 1.25. At each scale corners
are local maxima of Harris' measure; the ``features`` strongest of an image are kept. A
corner's direction is that of the brightness around it, and 256 comparisons of pairs of
smoothed pixels, turned by that direction, are its descriptor. Each of ``TABLES`` tables
keys a descriptor by ``KEY_BITS`` of its bits; images that share ``SHARED`` keys or more, of corners
that have a partner within ``CLOSE`` bits, are candidates. Tables are met one after the
other, each in ``PARTS`` parts, only corners with such a partner are kept, and pairs are
tested a quarter as many at a time as there are images, so more tables and pairs take time
rather than disk.
A candidate pair is a copy if at least ``consensus`` of its matching corners agree on
one shift, turn and scale: every match is tried as the hypothesis, none at random.

Media with equal bytes are one, whatever they are. Those that can't be decoded and images
without corners link with nothing else. Null and empty media link with nothing and
are kept; so are rows with a null id. Corners per image are a bound of the
description, documented, not of the candidates.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lorecraft.llm.linking import link_classes
from lorecraft.session import ensure_checkpoint_dir, release, ship_package

BITS, TABLES = 256, 8
#: Bits of a descriptor in a key: the more of them, the fewer chance meetings to test, and the more tables for the same recall.
KEY_BITS = 48
#: Descriptors match if at most so many of their bits differ.
DISTANCE = 56
#: Corners make candidates if at most so many do: those of edited copies mostly differ in less than 30.
CLOSE = 36
STEP, SCALES, MARGIN = 1.25, 4, 13
#: Keys that two images must share: edited copies share ten and more, images of plain corners one or two by chance.
SHARED = 3
#: Larger images are not decoded.
MOST_PIXELS = 1 << 26
#: A corner as stored: place in the full image, number of the scale, direction in 256ths of a turn, descriptor.
CORNER = np.dtype([("x", "<f4"), ("y", "<f4"), ("s", "u1"), ("t", "u1"), ("d", "u1", BITS // 8)])
WORDS = ("w0", "w1", "w2", "w3")
#: Pixels of images that are described together.
STACK = 1 << 17
#: Parts of a table's keys that are met at a time.
PARTS = 2
#: Pairs whose corners are fetched at a time (about 4 kB each), or a quarter as many as there are images.
SLICE = 10_000


def _pattern() -> np.ndarray:
    """Pairs of points within a disc, from a fixed seed: pair x (first, second) x (x, y)."""
    p = np.random.default_rng(4).normal(0, 4.5, (BITS, 2, 2))
    return p * np.minimum(1, 9 / np.maximum(np.linalg.norm(p, axis=2, keepdims=True), 1e-9))


PATTERN = _pattern()
#: The bits that each table takes: disjoint ones of a permutation of all bits, then of the next.
TAKEN = [np.random.default_rng(9 + t // (BITS // KEY_BITS)).permutation(BITS)[t % (BITS // KEY_BITS) * KEY_BITS :][:KEY_BITS] for t in range(TABLES)]


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey levels of an image as a float matrix; None if it can't be read, whatever the bytes."""
    try:
        if not data:
            return None
        if data[:2] in (b"P5", b"P6"):
            return _netpbm(data)
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (ValueError, ArithmeticError, LookupError, TypeError, struct.error, zlib.error):
        return None
    return None


def _grey(pixels: np.ndarray) -> np.ndarray:
    pixels = pixels.astype(float)
    if pixels.ndim == 2 or pixels.shape[2] <= 2:
        return pixels if pixels.ndim == 2 else pixels[:, :, 0]
    return pixels[:, :, 0] * 0.299 + pixels[:, :, 1] * 0.587 + pixels[:, :, 2] * 0.114


def _netpbm(data: bytes) -> np.ndarray:
    fields, at = [], 2
    while len(fields) < 3:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        fields.append(int(data[at:end]))
        at = end
    width, height, top = fields
    if top > 255 or width * height > MOST_PIXELS:
        raise ValueError("more than 8 bits a sample, or too large")
    depth = 1 if data[:2] == b"P5" else 3
    return _grey(np.frombuffer(data, np.uint8, width * height * depth, at + 1).reshape(height, width, depth)) * (255 / max(top, 1))


def _png(data: bytes) -> np.ndarray:
    at, body, palette, head = 8, [], None, None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"PLTE":
            palette = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            body.append(chunk)
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    width, height, depth, colour, _, _, interlaced = head
    if depth != 8 or interlaced or not 0 < width * height <= MOST_PIXELS or (colour == 3 and palette is None):
        raise ValueError("not 8 bits a sample in one pass, too large, or without its colours")
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw = np.frombuffer(zlib.decompressobj().decompress(b"".join(body), height * (1 + width * n)), np.uint8).reshape(height, 1 + width * n)
    lines = np.zeros((height + 1, width + 1, n), np.int64)
    for y in range(height):
        line, up = raw[y, 1:].reshape(width, n).astype(np.int64), lines[y]
        kind, out = raw[y, 0], lines[y + 1]
        if kind == 0:
            out[1:] = line
        elif kind == 2:
            out[1:] = (line + up[1:]) % 256
        elif kind == 1:
            out[1:] = np.cumsum(line, 0) % 256
        else:
            for x in range(width):
                a, b, c = out[x], up[x + 1], up[x]
                if kind == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = np.abs(b - c), np.abs(a - c), np.abs(a + b - 2 * c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                out[x + 1] = (line[x] + guess) % 256
    pixels = lines[1:, 1:]
    return _grey(palette[pixels[:, :, 0]] if colour == 3 else pixels)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Mean over squares of side ``2 r + 1`` of each image of a stack; borders repeat."""
    k = 2 * r + 1
    s = np.cumsum(np.cumsum(np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r + 1, r), (r + 1, r)], mode="edge"), -2), -1)
    return (s[..., k:, k:] - s[..., :-k, k:] - s[..., k:, :-k] + s[..., :-k, :-k]) / (k * k)


def _shrink(a: np.ndarray, factor: float) -> np.ndarray:
    h, w = int(a.shape[-2] / factor), int(a.shape[-1] / factor)
    y, x = (np.arange(h) + 0.5) * factor - 0.5, (np.arange(w) + 0.5) * factor - 0.5
    y0, x0 = np.clip(y.astype(int), 0, a.shape[-2] - 2), np.clip(x.astype(int), 0, a.shape[-1] - 2)
    fy, fx = np.clip(y - y0, 0, 1)[:, None], np.clip(x - x0, 0, 1)[None]
    rows = a[..., y0, :] * (1 - fy) + a[..., y0 + 1, :] * fy
    return rows[..., x0] * (1 - fx) + rows[..., x0 + 1] * fx


def _around(a: np.ndarray, axis: int) -> np.ndarray:
    """The greatest of five neighbours along an axis; borders repeat."""
    pad = [(0, 0)] * a.ndim
    pad[axis] = (2, 2)
    p, n = np.moveaxis(np.pad(a, pad, mode="edge"), axis, 0), a.shape[axis]
    two = np.maximum(p[:-1], p[1:])
    return np.moveaxis(np.maximum(np.maximum(two[:n], two[2 : n + 2]), p[4:]), 0, axis)


def _strongest(image: np.ndarray, strength: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` strongest of each image, by image and place."""
    order = np.lexsort((-strength, image))
    n = np.arange(len(order)) - np.searchsorted(image[order], image[order])
    return np.sort(order[n < most])


def corners(image: np.ndarray, features: int) -> np.ndarray:
    """The strongest corners of all scales with direction and descriptor."""
    return corners_of(image[None], features)[0]


def corners_of(images: np.ndarray, features: int) -> list[np.ndarray]:
    """The same for each of a stack of images of one size."""
    homes, found, force = [], [], []
    level, factor = images, 1.0
    d = np.arange(-8, 9)
    inside = np.nonzero(d[:, None] ** 2 + d[None] ** 2 <= 64)
    dy, dx = d[inside[0]], d[inside[1]]
    for scale in range(SCALES):
        if min(level.shape[1:]) < 2 * MARGIN + 3:
            break
        smooth = _box(level, 1)
        gy, gx = np.gradient(smooth, axis=(1, 2))
        xx, yy, xy = _box(gx * gx, 2), _box(gy * gy, 2), _box(gx * gy, 2)
        r = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        peak = (r == _around(_around(r, 1), 2)) & (r > 1e-3)
        peak[:, :MARGIN] = peak[:, -MARGIN:] = False
        peak[:, :, :MARGIN] = peak[:, :, -MARGIN:] = False
        b, y, x = np.nonzero(peak)
        best = _strongest(b, r[b, y, x], features)
        b, y, x = b[best], y[best], x[best]
        if len(y):
            flat, width = smooth.reshape(-1), level.shape[2]
            centre = (b * level.shape[1] + y) * width + x
            disc = flat[centre[:, None] + dy * width + dx]
            angle = np.arctan2(disc @ dy, disc @ dx)
            c, s = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
            px = np.rint(PATTERN[None, :, :, 0] * c - PATTERN[None, :, :, 1] * s).astype(int)
            py = np.rint(PATTERN[None, :, :, 0] * s + PATTERN[None, :, :, 1] * c).astype(int)
            value = flat[centre[:, None, None] + py * width + px]
            out = np.zeros(len(y), CORNER)
            out["x"], out["y"], out["s"] = (x + 0.5) * factor, (y + 0.5) * factor, scale
            out["t"] = np.rint(angle * (128 / np.pi)).astype(int) % 256
            out["d"] = np.packbits(value[:, :, 0] < value[:, :, 1], axis=1)
            homes.append(b), found.append(out), force.append(r[b, y, x])
        level, factor = _shrink(level, STEP), factor * STEP
    if not found:
        return [np.zeros(0, CORNER) for _ in images]
    home, all_ = np.concatenate(homes), np.concatenate(found)
    best = _strongest(home, np.concatenate(force), features)
    best = best[np.argsort(home[best], kind="stable")]
    return np.split(all_[best], np.searchsorted(home[best], np.arange(1, len(images))))


def table_keys(found: np.ndarray, table: int, part: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The keys of an image's corners in a table (or a part of it), each once, and for each a corner that has it."""
    taken = np.packbits(np.unpackbits(found["d"], axis=1)[:, TAKEN[table]], axis=1).astype(np.int64)
    keys, first = np.unique(taken @ (1 << 8 * np.arange(KEY_BITS // 8, dtype=np.int64)), return_index=True)
    if part is not None:
        here = (keys ^ keys >> 16) % PARTS == part
        keys, first = keys[here], first[here]
    return keys << 5 | table, first


def agreeing(a: np.ndarray, b: np.ndarray, distance: int = DISTANCE, pixels: float = 4.0) -> int:
    """How many matching corners of two images agree on one similarity transform."""
    if not len(a) or not len(b):
        return 0
    m, n = (np.ascontiguousarray(x["d"]).view(np.uint64) for x in (a, b))
    far = np.bitwise_count(m[:, None] ^ n[None]).sum(2, dtype=np.int64)
    i, j = np.arange(len(a)), far.argmin(1)
    ok = (far[i, j] <= distance) & (far.argmin(0)[j] == i)
    m, n = a[i[ok]], b[j[ok]]
    if len(m) < 2:
        return len(m)
    scale = STEP ** (n["s"].astype(float) - m["s"])
    turn = (n["t"].astype(float) - m["t"]) * (np.pi / 128)
    step = scale * np.exp(1j * turn)
    p, q = m["x"] + 1j * m["y"], n["x"] + 1j * n["y"]
    # a first guess from each match alone, then from the farthest match that agrees with it
    def votes(factor: np.ndarray, slack: float) -> np.ndarray:
        return np.abs(factor[:, None] * (p[None] - p[:, None]) + q[:, None] - q[None]) <= pixels + slack * np.abs(p[None] - p[:, None])

    near = votes(step, 0.25)
    partner = np.where(near, np.abs(p[None] - p[:, None]), -1).argmax(1)
    apart = p[partner] - p
    refined = np.where(np.abs(apart) > 8, (q[partner] - q) / np.where(apart == 0, 1, apart), step)
    refined = np.where((np.abs(refined) > 0.3) & (np.abs(refined) < 3.3), refined, step)
    return int(votes(refined, 0.02).sum(1).max())


def image_copies(df: DataFrame, *, id: str = "id", media: str = "media", features: int = 96, consensus: int = 8) -> DataFrame:
    """One row per row of ``df``: ``id``, ``n_corners``, ``class_id`` (least id of the class) and ``kept``."""
    spark = df.sparkSession
    ship_package(spark)
    ensure_checkpoint_dir(spark)

    @F.arrow_udf("binary")
    def described(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out = [b""] * len(batch)
            waiting: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = {}

            def close(shape: tuple[int, int]) -> None:
                places, images = zip(*waiting.pop(shape))
                for k, found in zip(places, corners_of(np.stack(images), features)):
                    out[k] = found.tobytes()

            for k, value in enumerate(batch):
                image = decode(value.as_py())
                if image is not None and min(image.shape) > 2:
                    waiting.setdefault(image.shape, []).append((k, image))
                    if len(waiting[image.shape]) * image.size >= STACK:
                        close(image.shape)
            for shape in list(waiting):
                close(shape)
            yield pa.array(out, pa.binary())

    def keys(table: int, part: int) -> Callable[..., Column]:
        @F.arrow_udf("array<struct<bucket:bigint,w0:bigint,w1:bigint,w2:bigint,w3:bigint>>")
        def keyed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            for batch in batches:
                ends, buckets, words = [0], [np.zeros(0, np.int64)], [np.zeros((0, 4), np.int64)]
                for value in batch:
                    found = np.frombuffer(value.as_py(), CORNER)
                    key, at = table_keys(found, table, part)
                    ends.append(ends[-1] + len(key))
                    buckets.append(key)
                    words.append(np.ascontiguousarray(found["d"][at]).view(np.int64))
                four = np.concatenate(words)
                rows = pa.StructArray.from_arrays([pa.array(np.concatenate(buckets)), *(pa.array(four[:, k].copy()) for k in range(4))], names=["bucket", *WORDS])
                yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)

        return keyed

    @F.arrow_udf("int")
    def agreed(left: pa.Array, right: pa.Array) -> pa.Array:
        return pa.array([agreeing(np.frombuffer(a.as_py(), CORNER), np.frombuffer(b.as_py(), CORNER)) for a, b in zip(left, right)], pa.int32())

    media_ = F.col(media).cast("binary")
    rows = df.select(F.col(id).alias("id"), F.when(F.col(id).isNotNull() & (F.length(media_) > 0), F.unhex(F.md5(media_))).alias("content"), described(media_).alias("corners")).checkpoint()
    images = rows.where("content IS NOT NULL").groupBy("content").agg(F.min("id").alias("item"), F.first("corners").alias("corners")).checkpoint()
    rows = rows.select("id", "content", (F.length("corners") / CORNER.itemsize).cast("int").alias("n_corners")).checkpoint()
    release(spark)
    contents, images = images.select("content", "item"), images.where("length(corners) > 0").select("item", "corners")
    far = lambda x, y: sum((F.bit_count(F.col(f"w{k}{x}").bitwiseXOR(F.col(f"w{k}{y}"))) for k in range(4)), F.lit(0))
    met = []
    for table, part in product(range(TABLES), range(PARTS)):
        bucketed = images.select("item", F.explode(keys(table, part)("corners")).alias("k")).select("item", "k.*")
        other = bucketed.select("bucket", *[F.col(c).alias(f"{c}_y") for c in ("item", *WORDS)])
        near = (bucketed["bucket"] == other["bucket"]) & (F.col("item") != F.col("item_y")) & (far("", "_y") <= CLOSE)
        met.append(bucketed.join(other, near, "left_semi").select("bucket", "item").checkpoint())
        release(spark)
    members = reduce(DataFrame.unionByName, met)
    at_once = max(SLICE, images.count() // 4)
    sides = images.select(F.col("item").alias("a"), F.col("corners").alias("ca")), images.select(F.col("item").alias("b"), F.col("corners").alias("cb"))

    def verified(pairs: DataFrame) -> DataFrame:
        pairs, out = pairs.checkpoint(), []
        slices = max(1, -(-pairs.count() // at_once))
        for k in range(slices):
            some = pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(slices)) == k)
            out.append(some.join(sides[1], "b").join(sides[0], "a").where(agreed("ca", "cb") >= consensus).select("a", "b").checkpoint())
            release(spark)
        return reduce(DataFrame.unionByName, out)

    classes = link_classes(members, verified, least=SHARED).withColumnRenamed("id", "item")
    of_content = contents.join(classes, "item", "left").select("content", F.coalesce("component", "item").alias("class_id"))
    class_id = F.coalesce("class_id", "id")
    return rows.join(of_content, "content", "left").select(
        F.col("id").alias(id), "n_corners", class_id.alias("class_id"), F.coalesce(class_id == F.col("id"), F.lit(True)).alias("kept")
    )


def render_vectors(df: DataFrame, *, vector: str, media: str = "media", side: int = 24, zoom: int = 4) -> DataFrame:
    """``df`` with an image of each vector in place of ``vector``: tables without images get a media column.

    Each of ``side`` x ``side`` patches takes its grey level from a fixed random projection
    of the vector, so near vectors give edited copies of an image. Null, empty,
    zero and non-finite vectors give null.
    """
    ship_package(df.sparkSession)

    @F.arrow_udf("binary")
    def drawn(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        planes: dict[int, np.ndarray] = {}
        head = b"P5 %d %d 255\n" % (side * zoom, side * zoom)
        for batch in batches:
            out = []
            for value in batch:
                x = np.array(value.as_py() or [], float)
                size = np.linalg.norm(x) if len(x) else 0.0
                if not size or not np.isfinite(size):
                    out.append(None)
                    continue
                if len(x) not in planes:
                    planes[len(x)] = np.random.default_rng(len(x)).normal(0, 1, (side * side, len(x)))
                grey = np.clip(128 + 50 * (planes[len(x)] @ (x / size)), 0, 255).astype(np.uint8).reshape(side, side)
                out.append(head + np.kron(grey, np.ones((zoom, zoom), np.uint8)).tobytes())
            yield pa.array(out, pa.binary())

    return df.select(*[c for c in df.columns if c not in {vector, media}], drawn(F.col(vector)).alias(media))
