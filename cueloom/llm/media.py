"""Copies of images by local descriptors: corners, binary tests, Hamming tables and geometric consensus."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bits import bitmap, is_set
from .near_dup import bounded_batches
from .scratch import Scratch

#: Side of the derived images, step between scales, scales of an image and of an edited copy (which may be enlarged), corners of each scale.
SIDE, STEP, SCALES, QUERY_SCALES, CORNERS = 96, 1.1, 2, 8, 40
#: Tests of a descriptor, tables that they are dealt to, and tests of a table.
TESTS, TABLES, BITS = 120, 5, 24
#: Distance of corners from the border, distance of the points of a test from their corner, and steps of their orientation.
EDGE, RADIUS, STEPS = 13, 11, 60
#: Most differing tests of a match, and least matches that agree on one similarity transform.
DISTANCE, AGREE = 16, 4
#: Turns of a whole circle that matches vote for.
TURNS = 24
#: Least blocks that the images are dealt to, images of a block beyond that, and matches that a task counts at once.
BLOCKS, IMAGES, MATCHES = 16, 4096, 1 << 17
#: The edits of the query images: zoom, turn in degrees, shift of the centre as shares of the side, gain, lift, and share of the side under a banner.
EDITS = {
    "crop 10 %": (1 / 0.9, 0, 0.04, -0.03, 0.8, 20, 0),
    "crop 25 %": (1 / 0.75, 0, -0.1, 0.1, 1.0, 0, 0),
    "crop 40 %": (1 / 0.6, 0, 0.1, 0.05, 1.1, -10, 0),
    "quarter turn": (1.0, 90, 0, 0, 1.0, 0, 0),
    "turn by 20 degrees": (1.05, 20, 0, 0, 0.9, 5, 0),
    "banner and contrast": (1.0, 0, 0, 0, 1.3, -20, 0.25),
}


def _sample(images, y, x):
    """Bilinear values of a stack of images at points, those outside taken from the border."""
    import numpy as np

    n = images.shape[1]
    y, x = np.clip(y, 0, n - 1), np.clip(x, 0, n - 1)
    y0, x0 = np.minimum(y.astype(int), n - 2), np.minimum(x.astype(int), n - 2)
    fy, fx = (y - y0).astype(np.float32), (x - x0).astype(np.float32)
    top = images[:, y0, x0] * (1 - fx) + images[:, y0, x0 + 1] * fx
    low = images[:, y0 + 1, x0] * (1 - fx) + images[:, y0 + 1, x0 + 1] * fx
    return top * (1 - fy) + low * fy


def _resize(images, side: int):
    """Bilinear resampling of a stack of square images."""
    import numpy as np

    n = images.shape[1]
    at = (np.arange(side) + 0.5) * n / side - 0.5
    lo = np.clip(np.floor(at).astype(int), 0, n - 2)
    f = np.clip(at - lo, 0, 1).astype(np.float32)
    rows = images[:, lo] * (1 - f)[None, :, None] + images[:, lo + 1] * f[None, :, None]
    return rows[:, :, lo] * (1 - f) + rows[:, :, lo + 1] * f


def _smooth(images):
    import numpy as np

    p = np.pad(images, ((0, 0), (2, 2), (2, 2)), mode="edge")
    k = np.array([1, 4, 6, 4, 1], np.float32) / 16
    rows = sum(k[i] * p[:, i : i + images.shape[1]] for i in range(5))
    return sum(k[i] * rows[:, :, i : i + images.shape[2]] for i in range(5))


def _corners(images, count: int):
    """Image, y, x and angle of the ``count`` strongest corners of each of some smoothed images.

    Corners are local maxima of the Harris measure; their angle is the direction of the intensity centroid.
    """
    import numpy as np

    side = images.shape[1]
    gx, gy = np.zeros_like(images), np.zeros_like(images)
    gx[:, :, 1:-1] = images[:, :, 2:] - images[:, :, :-2]
    gy[:, 1:-1] = images[:, 2:] - images[:, :-2]
    a, b, c = _smooth(gx * gx), _smooth(gy * gy), _smooth(gx * gy)
    harris = a * b - c * c - 0.05 * (a + b) ** 2
    inner = harris[:, EDGE:-EDGE, EDGE:-EDGE]
    wide = harris[:, EDGE - 2 : side - EDGE + 2, EDGE - 2 : side - EDGE + 2]
    across = np.max([wide[:, :, d : d + inner.shape[2]] for d in range(5)], axis=0)
    around = np.max([across[:, d : d + inner.shape[1]] for d in range(5)], axis=0)
    peak = np.where((inner >= around) & (inner > 1e-6), inner, 0).reshape(len(images), -1)
    best = np.argsort(-peak, axis=1, kind="stable")[:, :count]
    img, flat = np.repeat(np.arange(len(images)), best.shape[1]), best.ravel()
    keep = peak[img, flat] > 0
    img, flat = img[keep], flat[keep]
    y, x = flat // inner.shape[2] + EDGE, flat % inner.shape[2] + EDGE
    dy, dx = np.mgrid[-5:6, -5:6]
    disc = (dx * dx + dy * dy <= 25).ravel()
    dy, dx = dy.ravel()[disc], dx.ravel()[disc]
    patch = images[img[:, None], y[:, None] + dy, x[:, None] + dx]
    return img, y, x, np.arctan2((patch * dy).sum(1), (patch * dx).sum(1))


def _answers(images, img, y, x, angle, points):
    """Whether the first point of each test, turned by a corner's angle (in STEPS of a whole turn), is darker than the second."""
    import numpy as np

    turned = []
    for k in range(STEPS):
        c, s = np.cos(2 * np.pi * k / STEPS), np.sin(2 * np.pi * k / STEPS)
        x1, y1, x2, y2 = points.T
        turned.append(np.rint(np.stack([c * x1 - s * y1, s * x1 + c * y1, c * x2 - s * y2, s * x2 + c * y2])).astype(int))
    p = np.stack(turned)[np.rint(angle / (2 * np.pi) * STEPS).astype(int) % STEPS]
    lim = images.shape[1] - 1
    at = lambda px, py: images[img[:, None], np.clip(y[:, None] + py, 0, lim), np.clip(x[:, None] + px, 0, lim)]
    return at(p[:, 0], p[:, 1]) < at(p[:, 2], p[:, 3])


@functools.cache
def binary_tests():
    """TESTS pairs of points that answer evenly and independently of one another, so that table keys are spread.

    Chosen from 3,000 random pairs by their answers at the corners of images of
    random vectors: nearest to an even split first, each with a correlation to
    the earlier ones below the least limit that leaves TESTS of them.
    """
    import numpy as np

    rng = np.random.Generator(np.random.PCG64(4))
    points = rng.uniform(-1, 1, (12_000, 4)) * RADIUS
    fits = (np.hypot(points[:, 0], points[:, 1]) <= RADIUS) & (np.hypot(points[:, 2], points[:, 3]) <= RADIUS) & (np.hypot(points[:, 0] - points[:, 2], points[:, 1] - points[:, 3]) >= 3)
    points = points[fits][:3000]
    images = _smooth(derived_images(rng.standard_normal((100, 64)).astype(np.float32)))
    bits = _answers(images, *_corners(images, CORNERS), points)
    mean = bits.mean(axis=0)
    z = ((bits - mean) / np.maximum(bits.std(axis=0), 1e-6)).astype(np.float32)
    order = np.argsort(np.abs(mean - 0.5), kind="stable")
    for limit in np.arange(0.2, 1.01, 0.05):
        chosen: list = []
        for k in order:
            if not chosen or np.abs(z[:, chosen].T @ z[:, k]).max() / len(z) < limit:
                chosen.append(k)
                if len(chosen) == TESTS:
                    return points[np.array(chosen).reshape(BITS, TABLES).T.ravel()]
    return points[order[:TESTS]]


def describe(images, tests, scales: int = SCALES):
    """Corners of a stack of square images: image, x, y, scale number, angle and answers to the tests of each."""
    import numpy as np

    images = images.astype(np.float32)
    rows = []
    for level in range(scales):
        factor = STEP**level
        small = _smooth(images if level == 0 else _resize(images, int(round(images.shape[1] / factor))))
        img, y, x, angle = _corners(small, CORNERS)
        rows.append((img, x * factor, y * factor, np.full(len(img), level), angle, _answers(small, img, y, x, angle, tests)))
    return tuple(np.concatenate([r[i] for r in rows]) for i in range(6))


def derived_images(vectors, side: int = SIDE):
    """A grey image for each vector: its values weigh fixed patterns of smoothed noise, drawn by rule from a seeded generator."""
    import numpy as np

    n, d = vectors.shape
    noise = np.random.Generator(np.random.PCG64(8)).standard_normal((d, side, side)).astype(np.float32)
    basis = _smooth(_smooth(_smooth(noise))).reshape(d, -1)
    images = vectors.astype(np.float32) @ basis
    images /= np.maximum(images.std(axis=1, keepdims=True), 1e-9)
    return (images * 40 + 128).reshape(n, side, side)


def edited(images, kind: str):
    """Images after one of the EDITS."""
    import numpy as np

    zoom, degrees, right, down, gain, lift, banner = EDITS[kind]
    side = images.shape[1]
    mid = (side - 1) / 2
    c, s = np.cos(np.radians(degrees)), np.sin(np.radians(degrees))
    y, x = np.mgrid[0:side, 0:side] - mid
    out = _sample(images, mid + down * side + (s * x + c * y) / zoom, mid + right * side + (c * x - s * y) / zoom) * gain + lift
    if banner:
        out[:, side - int(banner * side) :] = 255.0
    return out


def edit_of(id, every: int):  # noqa: A002
    """Which edit the query image of this id undergoes."""
    return list(EDITS)[id // every % len(EDITS)]


def descriptors(vectors: DataFrame, every: int = 0, wanted=None) -> DataFrame:
    """id, x, y, scale, angle, lo, hi (60 tests each), slots (tables and their keys) of the images derived from vectors(id, v).

    With ``every`` the images are edited copies. With ``wanted``, a broadcast
    bitmap of slots, only these slots are listed and descriptors without any are
    left out.
    """
    tests = binary_tests()

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for rb in batches:
            for a in range(0, rb.num_rows, 128):
                part = rb.slice(a, 128)
                ids, values = part.column(0).to_pylist(), part.column(1).to_pylist()
                groups: dict = {}
                for i, v in enumerate(values):
                    if v:
                        groups.setdefault((len(v), edit_of(ids[i], every) if every else None), []).append(i)
                for (_, kind), rows in groups.items():
                    images = derived_images(np.nan_to_num(np.array([[x if x is not None else 0.0 for x in values[i]] for i in rows], np.float32)))
                    img, x, y, s, angle, bits = describe(edited(images, kind), tests, QUERY_SCALES) if kind else describe(images, tests)
                    weights = np.int64(1) << np.arange(60, dtype=np.int64)
                    lo, hi = bits[:, :60] @ weights, bits[:, 60:] @ weights
                    keys = bits.reshape(len(bits), TABLES, BITS) @ weights[:BITS] + (np.arange(TABLES, dtype=np.int64) << BITS)
                    hit = is_set(wanted.value, keys) if wanted else np.ones(keys.shape, bool)
                    some = hit.any(axis=1)
                    slots = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(hit[some].sum(axis=1))]).astype(np.int32)), pa.array(keys[hit]))
                    yield pa.RecordBatch.from_arrays(
                        [
                            part.column(0).take(pa.array(np.array(rows, np.int64)[img[some]])), *(pa.array(np.asarray(c[some], np.float32)) for c in (x, y, s, angle)),
                            pa.array(lo[some]), pa.array(hi[some]), slots,
                        ],
                        names=["id", "x", "y", "scale", "angle", "lo", "hi", "slots"],
                    )

    return vectors.select("id", "v").mapInArrow(work, "id long, x float, y float, scale float, angle float, lo long, hi long, slots array<long>")


def _votes(rows, agree: int):
    """Row, id and agreeing corners of the matches (row, id, zoom, part of a turn, qx, qy, x, y) of which ``agree`` or more fit one transform."""
    import numpy as np

    row, id, zoom, part, qx, qy, x, y = rows  # noqa: A001
    turn, mid = np.floor(part), SIDE / 2
    turn = np.concatenate([turn, turn + 1])
    row, id, zoom, qx, qy, x, y = (np.tile(c, 2) for c in (row, id, zoom, qx, qy, x, y))  # noqa: A001
    ratio, a = STEP**zoom, turn * (6.283185307179586 / TURNS)
    corner = np.floor(qx).astype(np.int64) * 65536 + np.floor(qy).astype(np.int64)
    qx, qy = qx - mid, qy - mid
    sx = x - mid - ratio * (np.cos(a) * qx - np.sin(a) * qy)
    sy = y - mid - ratio * (np.sin(a) * qx + np.cos(a) * qy)
    ways = lambda v: np.stack([np.floor(v), np.floor(v + 0.5) + 100000])
    cells = [np.broadcast_to(c, (2, 2, 2, len(row))).ravel() for c in (row, id, np.mod(turn, TURNS), ways(zoom / 2)[:, None, None], ways(sx / 16)[None, :, None], ways(sy / 16)[None, None, :], corner)]
    cells = np.stack([c.astype(np.int64) for c in cells])
    cells = cells[:, np.lexsort(cells[::-1])]
    new = np.concatenate([[True], (cells[:, 1:] != cells[:, :-1]).any(axis=0)]) if cells.shape[1] else np.zeros(0, bool)
    cells = cells[:6, new]
    start = np.flatnonzero(np.concatenate([[True], (cells[:, 1:] != cells[:, :-1]).any(axis=0)])) if cells.shape[1] else np.zeros(0, np.int64)
    many, pair = np.diff(np.append(start, cells.shape[1])), cells[:2, start]
    first = np.flatnonzero(np.concatenate([[True], (pair[:, 1:] != pair[:, :-1]).any(axis=0)])) if len(start) else start
    most = np.maximum.reduceat(many, first) if len(first) else many
    keep = most >= agree
    return pair[0, first][keep], pair[1, first][keep], most[keep]


def find_copies(queries: DataFrame, index: DataFrame, distance: int = DISTANCE, agree: int = AGREE, blocks: int = BLOCKS) -> DataFrame:
    """(query, id, agreeing): pairs of images of which ``agree`` or more corners match and fit one similarity transform.

    Descriptors meet in TABLES tables of 24 tests each, so every pair of
    descriptors that differs in fewer than TABLES tests meets for certain, and
    others meet where one table agrees, and each pair in its first such table; matches differ in ``distance`` tests at
    most. Each match votes for its turn (the two nearest of TURNS), zoom and shift, in overlapping cells;
    a corner of the query counts once in a cell, and the fullest cell counts.

    The images are dealt to ``blocks``; a block's descriptors of a slot are one row, and a query's matches
    with a block are counted in one task. So near copies meet a query as a block, not one by one: rows
    grow with the number of blocks, and only comparisons inside a task with the number of pairs.
    """
    q = queries.select(F.explode("slots").alias("slot"), F.col("id").alias("query"), *(F.col(c).alias(f"q{c}") for c in ("x", "y", "scale", "angle", "lo", "hi")))
    d = index.select(F.explode("slots").alias("slot"), F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), F.struct("id", "x", "y", "scale", "angle", "lo", "hi").alias("d"))
    d = d.groupBy("slot", "block").agg(F.collect_list("d").alias("met"))

    def matches(d: Column) -> Column:
        x, y, table = F.col("qlo").bitwiseXOR(d.lo), F.col("qhi").bitwiseXOR(d.hi), F.shiftright("slot", BITS)
        part = lambda v, down, bits: F.shiftright(v, down).bitwiseAND(F.lit((1 << bits) - 1)) == 0
        again = F.lit(False)
        for t, same in enumerate([part(x, 0, 24), part(x, 24, 24), part(x, 48, 12) & part(y, 0, 12), part(y, 12, 24)]):
            again = again | ((table > t) & same)
        return (F.bit_count(x) + F.bit_count(y) <= distance) & ~again

    def count(batches):
        import numpy as np
        import pyarrow as pa

        for rb in batches:
            if not rb.num_rows:
                continue
            corners = rb.column(1).flatten()  # a query's corners, each with its matches
            per_row = np.diff(rb.column(1).offsets.to_numpy())
            met = corners.field("met")
            per_corner = np.diff(met.offsets.to_numpy())
            met = met.flatten()
            q = {c: np.repeat(corners.field(f"q{c}").to_numpy(), per_corner) for c in ("x", "y", "scale", "angle")}
            d = {c: met.field(c).to_numpy() for c in ("id", "x", "y", "scale", "angle")}
            row = np.repeat(np.repeat(np.arange(rb.num_rows), per_row), per_corner)
            zoom = (d["scale"] - q["scale"]).astype(np.float64)
            part = (d["angle"] - q["angle"]).astype(np.float64) / 6.283185307179586 * TURNS
            # rows at a time, so that a batch of many matches doesn't swell the worker
            upto = np.searchsorted(row, np.arange(rb.num_rows + 1))
            at = 0
            while at < rb.num_rows:
                to = max(at + 1, int(np.searchsorted(upto, upto[at] + MATCHES, side="right")) - 1)
                s = slice(upto[at], upto[to])
                own, ids, most = _votes([row[s], d["id"][s], zoom[s], part[s], *(c[s].astype(np.float64) for c in (q["x"], q["y"], d["x"], d["y"]))], agree)
                yield pa.RecordBatch.from_arrays([rb.column(0).take(pa.array(own)), pa.array(ids), pa.array(most.astype(np.int64))], names=["query", "id", "agreeing"])
                at = to

    met = q.join(d.withColumnRenamed("slot", "there"), (F.col("slot") == F.col("there")) & F.exists("met", matches))
    hit = F.transform(F.filter("met", matches), lambda e: F.struct(*(e[c].alias(c) for c in ("id", "x", "y", "scale", "angle"))))
    rows = met.groupBy("query", "block").agg(F.collect_list(F.struct("qx", "qy", "qscale", "qangle", hit.alias("met"))).alias("corners"))
    return rows.select("query", "corners").mapInArrow(count, "query long, id long, agreeing long")


def edited_copies(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """query_id, edit, rep_id, agreeing, n_reps, copies: which image an edited copy of each query image is found to come from.

    rep_id is the image with the most agreeing corners (the smallest of several),
    n_reps the number of images found and copies that of their members;
    ``find_copies`` has all pairs.

    The images are derived from ``embeddings(vec_id, embedding)``. Queries are the rows whose
    vec_id is divisible by ``every``; each undergoes one of the EDITS, by turns
    of their ids, and is searched for among all images. Images of equal vectors are one
    class, searched once under its smallest vec_id, with the number of its
    members. A query without a find has rep_id null. Descriptors
    of the index that share no table entry with any query are left out where
    they are made, by a bitmap of all table entries (10 MB whatever the input).

    Null ids, and null or empty vectors, are left out; null values
    count as 0; repeated rows are members of their class. Other columns are ignored. No rows give no rows.
    """
    spark = embeddings.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "media")
    v = F.col("embedding").cast("array<float>")
    rows = embeddings.select(F.col("vec_id").cast("long").alias("id"), v.alias("v")).where("id is not null and size(v) > 0")
    rows = rows.withColumn("content", F.sha2(F.array_join(F.transform("v", lambda x: F.coalesce(x.cast("string"), F.lit("0"))), ","), 256))
    classes = scratch.cut(rows.groupBy("content").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    reps = rows.join(classes.select("content", F.col("rep").alias("id")), ["content", "id"]).dropDuplicates(["content"]).select("id", "v")
    shuffles = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = scratch.cut(rows.where(F.col("id") % every == 0).dropDuplicates(["id", "content"]), "asked")
    queries = scratch.cut(descriptors(asked.repartition(shuffles, "id"), every), "queries")
    wanted = bitmap(queries.select(F.explode("slots").alias("key")))
    index = descriptors(reps.repartition(shuffles, "id"), wanted=wanted)
    blocks = max(BLOCKS, -(-classes.count() // IMAGES))
    found = scratch.cut(find_copies(queries, index, blocks=blocks), "found")
    edit = F.element_at(F.array(*map(F.lit, EDITS)), (F.floor(F.col("query_id") / every) % len(EDITS)).cast("int") + 1)
    sized = found.join(classes.select(F.col("rep").alias("id"), "copies"), "id")
    best = sized.groupBy(F.col("query").alias("query_id")).agg(F.max(F.struct("agreeing", (-F.col("id")).alias("under"))).alias("best"), F.count("*").alias("n_reps"), F.sum("copies").alias("copies"))
    return asked.select(F.col("id").alias("query_id")).join(best, "query_id", "left").select(
        "query_id", edit.alias("edit"), (-F.col("best.under")).alias("rep_id"), F.col("best.agreeing").alias("agreeing"),
        F.coalesce("n_reps", F.lit(0)).alias("n_reps"), F.coalesce("copies", F.lit(0)).alias("copies"),
    )
