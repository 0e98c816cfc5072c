"""Centroid clustering over a VA-file: vectors in few-bit cells, full vectors only where the cells don't decide.

Components become integers, so every distance and every mean is exact. Each
component is also put into one of 2^bits cells, whose edges are approximate quantiles.
A table for each dimension, cell and centroid gives the least and the greatest
squared difference; their sums are an interval for each vector and centroid. Only
centroids whose interval begins at or below the least upper end stay, and full
vectors settle between these.

A round reads the cells alone and asks for the full vectors of two kinds of rows: those whose
intervals overlap, and those that move from one cluster to another, as the
sums of the clusters are kept up by what moves. The cells are under a sixth of the vectors.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .near_dup import bounded_batches
from .scratch import Scratch

#: Integers beyond this would let a squared distance leave 64 bits.
LARGEST = 1 << 26
#: Pairs of a vector and a centroid compared at once.
PAIRS = 1 << 16


def whole_vectors(vectors: DataFrame, dim: int, scale: int) -> DataFrame:
    """(vec_id, x array<int>) of the vectors of ``dim`` finite components: floor(scale * component)."""
    v = F.col("embedding")
    good = F.coalesce((F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & (F.abs(x) < float("inf"))), F.lit(False))
    scaled = F.transform(v, lambda c: F.lit(float(scale)) * c.cast("double"))
    x = F.transform(scaled, lambda c: F.when(F.abs(c) <= LARGEST, F.floor(c).cast("int")))
    x = F.when(good & F.exists(x, lambda c: c.isNull()), F.raise_error(F.lit(f"a component exceeds {LARGEST} after scaling"))).otherwise(x)
    return vectors.where(good).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def cell_edges(whole: DataFrame, bits: int) -> list[tuple[int, int, list[int]]]:
    """Of each dimension: least and greatest component, and the lower ends of the cells after the first."""
    shares = [i / (1 << bits) for i in range(1, 1 << bits)]
    found = whole.select(F.posexplode("x").alias("at", "c")).groupBy("at").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.percentile_approx("c", shares, 1000).alias("cuts"))
    return [(r.lo, r.hi, sorted({c for c in r.cuts if c > r.lo})) for r in sorted(found.collect(), key=lambda r: r.at)]


def _columns(batch, name: str, dim: int):
    import numpy as np

    return batch.column(name).flatten().to_numpy().reshape(batch.num_rows, dim).astype(np.int64)


def with_cells(whole: DataFrame, edges: list, bits: int) -> DataFrame:
    """(vec_id, x, cells binary): ``bits`` bits of each dimension."""

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            x = _columns(batch, "x", len(edges))
            cells = np.stack([np.searchsorted(cuts, x[:, d], side="right") for d, (_, _, cuts) in enumerate(edges)], axis=1).astype(np.uint8)
            packed = np.packbits(np.unpackbits(cells[:, :, None], axis=2)[:, :, 8 - bits :].reshape(len(x), -1), axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("x"), pa.array([r.tobytes() for r in packed], pa.binary())], names=["vec_id", "x", "cells"])

    return whole.mapInArrow(work, "vec_id long, x array<int>, cells binary")


def _tables(edges: list, centroids: list, bits: int):
    """Least and greatest squared difference by dimension, cell and centroid."""
    import numpy as np

    c = np.array(centroids, np.int64)
    low, high = np.zeros((2, len(edges), 1 << bits, len(c)), np.int64)
    for d, (lo, hi, cuts) in enumerate(edges):
        for cell, (a, b) in enumerate(zip([lo, *cuts], [*(x - 1 for x in cuts), hi])):
            below, above = a - c[:, d], c[:, d] - b
            low[d, cell] = np.maximum(np.maximum(below, above), 0) ** 2
            high[d, cell] = np.maximum(np.abs(below), np.abs(above)) ** 2
    small = int(high.max(axis=1).sum(axis=0).max()) < 1 << 31
    return (low.astype(np.int32), high.astype(np.int32)) if small else (low, high)


def _open_cells(batch, dim: int, bits: int):
    import numpy as np

    packed = np.frombuffer(b"".join(batch.column("cells").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
    each = np.unpackbits(packed, axis=1)[:, : dim * bits].reshape(batch.num_rows, dim, bits)
    return each @ (1 << np.arange(bits - 1, -1, -1))


def _near(cells, tables):
    """Which centroids' intervals reach below the least upper end of the vector's intervals: a row of booleans each."""
    low, high = (sum(t[d][cells[:, d]] for d in range(cells.shape[1])) for t in tables)
    return low <= high.min(axis=1)[:, None]


def _settle(x, near, centroids):
    """The nearest of the marked centroids (ties: the smaller number) and its squared distance, from full vectors."""
    import numpy as np

    row, c = np.nonzero(near)
    far = np.concatenate([((x[row[i : i + PAIRS]] - centroids[c[i : i + PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(row), PAIRS)]) if len(row) else row
    least = np.minimum.reduceat(far, np.flatnonzero(np.diff(row, prepend=-1))) if len(row) else far
    best = np.flatnonzero(far == least[row])
    first = best[np.flatnonzero(np.diff(row[best], prepend=-1))]
    return c[first], least


def wanting(table: DataFrame, edges: list, old: list, new: list, bits: int) -> DataFrame:
    """(row_id, was, now): rows whose full vector a round needs, with the centroids that stay, before and now, as lists."""
    before, after = _tables(edges, old, bits), _tables(edges, new, bits)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if not batch.num_rows:
                continue
            cells = _open_cells(batch, len(edges), bits)
            was, now = _near(cells, before), _near(cells, after)
            need = np.flatnonzero((was.sum(axis=1) > 1) | (now.sum(axis=1) > 1) | (was != now).any(axis=1))
            lists = [pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(m[need].sum(axis=1))]).astype(np.int32)), pa.array(np.nonzero(m[need])[1].astype(np.int32))) for m in (was, now)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(need)), *lists], names=["row_id", "was", "now"])

    return table.select("row_id", "cells").mapInArrow(work, "row_id long, was array<int>, now array<int>")


def sums_moved(rows: DataFrame, dim: int, old: list | None, new: list) -> DataFrame:
    """(cluster, place, total): what the clusters gain, by dimension, and as their count (place ``dim``), from ``rows(x, now)``, with ``was`` unless old is None.

    A task holds one running sum a cluster; these are added up before they reach the driver.
    """
    k = len(new)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        total = np.zeros((k, dim + 1), np.int64)
        for batch in batches:
            x = _columns(batch, "x", dim)
            one = np.concatenate([x, np.ones((len(x), 1), np.int64)], axis=1)
            to = {}
            for name, centroids in (("was", old), ("now", new)):
                if centroids is not None:
                    lists = batch.column(name)
                    near = np.zeros((len(x), k), bool)
                    near[np.repeat(np.arange(len(x)), np.diff(lists.offsets.to_numpy())), lists.flatten().to_numpy()] = True
                    to[name] = _settle(x, near, np.array(centroids, np.int64))[0]
            moved = to["was"] != to["now"] if "was" in to else np.ones(len(x), bool)
            np.add.at(total, to["now"][moved], one[moved])
            if "was" in to:
                np.subtract.at(total, to["was"][moved], one[moved])
        c, at = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(at.astype(np.int32)), pa.array(total[c, at])], names=["cluster", "place", "total"])

    parts = rows.mapInArrow(work, "cluster int, place int, total long")
    return parts.groupBy("cluster", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))


def assigned(table: DataFrame, edges: list, centroids: list, bits: int) -> DataFrame:
    """(vec_id, cluster, distance) of every vector."""
    tables = _tables(edges, centroids, bits)

    def work(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                c, far = _settle(_columns(batch, "x", len(edges)), _near(_open_cells(batch, len(edges), bits), tables), np.array(centroids, np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(c.astype(np.int32)), pa.array(far)], names=["vec_id", "cluster", "distance"])

    return table.select("vec_id", "cells", "x").mapInArrow(work, "vec_id long, cluster int, distance long")


def cluster_vectors(vectors: DataFrame, k: int = 40, rounds: int = 5, dim: int = 64, scale: int = 256, bits: int = 4, salt: str = "2:") -> tuple[DataFrame, list[list[int]]]:
    """The clusters of ``vectors(vec_id, embedding)`` and their centroids.

    Vectors are kept that have ``dim`` components, none null, infinite or NaN; each
    component c becomes floor(scale * c). Centroids 0, 1, ... begin as the k
    kept vectors with the smallest SHA-256 of salt and vec_id (ties, of repeated
    ids, by components; null ids last). In each round every vector goes to its
    nearest centroid (ties: the smaller number), and centroids with vectors become
    the floor of their mean. Returns (vec_id, cluster, distance, cluster_inertia,
    inertia, centroid_sha256) of every kept row, repeated rows and null ids
    included, and the final centroids.

    Fewer vectors than k: as many centroids. No vectors: no rows. A component
    beyond 2^26 after scaling raises an error, as distances would leave 64 bits. Other columns are ignored.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "vafile")
    whole = whole_vectors(vectors, dim, scale)
    hashed = F.sha2(F.concat(F.lit(salt), F.col("vec_id").cast("string")), 256)
    centroids = [list(r.x) for r in whole.select("x", hashed.alias("h")).orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()]
    if not centroids:
        return whole.selectExpr("vec_id", "0 AS cluster", "0L AS distance", "0L AS cluster_inertia", "0L AS inertia", "'' AS centroid_sha256"), []
    edges = cell_edges(whole, bits)
    table = scratch.cut(with_cells(whole, edges, bits).withColumn("row_id", F.monotonically_increasing_id()), "vectors")

    totals, old = [[0] * (dim + 1) for _ in centroids], None
    for _ in range(rounds):
        if old is None:
            every = F.array(*[F.lit(c) for c in range(len(centroids))])
            rows = table.select("x", every.alias("now"))
        else:
            rows = wanting(table, edges, old, centroids, bits).join(table.select("row_id", "x"), "row_id")
        for r in sums_moved(rows, dim, old, centroids).collect():
            totals[r.cluster][r.place] += int(r.total)
        old, centroids = centroids, [[t // n for t in sums] if n else c for (*sums, n), c in zip(totals, centroids)]

    out = scratch.cut(assigned(table, edges, centroids, bits), "assigned")
    spread = {r.cluster: int(r.total) for r in out.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    told = [(c, total, sum(spread.values()), hashlib.sha256(",".join(map(str, centroids[c])).encode()).hexdigest()) for c, total in spread.items()]
    told = spark.createDataFrame(told, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return out.join(F.broadcast(told), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids
