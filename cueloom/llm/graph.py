"""Distributed connected components, by DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Edges from which nodes of very many neighbours are looked for, and the share of the edges that makes one.
LARGE, SHARE = 5_000, 500


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row.n, row.h


def _with_least(rows: DataFrame, least: DataFrame, n_edges: int) -> DataFrame:
    """rows(u, v) with m of least(u, m, degree).

    A node whose neighbours are more than 1 / SHARE of all edges is joined by
    broadcast (fewer than 2 * SHARE such nodes exist), so that its rows stay
    where they are; the others are joined by a shuffle in which no key is large.
    """
    if n_edges < LARGE:
        return rows.join(least.drop("degree"), "u")
    most = n_edges // SHARE
    hubs = least.where(F.col("degree") > most).select("u", "m")
    rest = least.where(F.col("degree") <= most).select("u", "m")
    others = rows.join(F.broadcast(hubs.select("u")), "u", "left_anti").join(rest, "u")
    return rows.join(F.broadcast(hubs), "u").unionByName(others)


def connected_components(edges: DataFrame, scratch: Scratch, tag: str = "cc", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges(u, v)``; the component is its smallest node.

    Alternates the large-star and small-star steps until the edges are stars
    around the smallest nodes. Each step's rows are written to the shared
    folder, so lineage stays one step long: in one plan, the minima would be repeated
    for each of their uses, and the driver would hold some 40 broadcasts a round. Minima are pre-aggregated on the
    map side, and nodes of very many neighbours are joined by broadcast. Null
    ends and self loops are ignored; no edges give no rows.
    """
    e = (
        edges.where("u is not null and v is not null and u <> v")
        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .distinct()
    )
    e = scratch.cut(e, tag)
    state = _state(e)
    for _ in range(max_rounds if state[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        before = [scratch.last.get(tag)]

        def step(df: DataFrame, name: str) -> DataFrame:
            out = scratch.cut(df, f"{tag}-{name}")
            before.append(scratch.last[f"{tag}-{name}"])
            return out

        low = step(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")).select("u", F.least("u", "m").alias("m"), "degree"), "low")
        large = step(_with_least(both.where("v > u"), low, 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v"), "large")
        low2 = step(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("degree")), "low2")
        small = _with_least(large, low2, 2 * state[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = scratch.cut(small.unionByName(low2.select("u", F.col("m").alias("v"))).distinct(), tag)
        for done in before:
            scratch.delete(done)
        now = _state(e)
        if now == state:
            break
        state = now
    else:
        if state[0]:
            raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
