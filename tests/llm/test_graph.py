"""Components: the size of a round's plans."""

import random

import pytest

from cueloom.llm import graph
from cueloom.llm.near_dup import near_duplicates
from cueloom.llm.scratch import Scratch


def plans_of(monkeypatch):
    """The plans of the tables that are written from now on."""
    plans, cut = [], Scratch.cut

    def seen(self, df, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return cut(self, df, *args, **kwargs)

    monkeypatch.setattr(Scratch, "cut", seen)
    return plans


@pytest.mark.parametrize("large", [0, 5000])
def test_plans_of_a_round_stay_small(spark, monkeypatch, large):
    rng = random.Random(5)
    edges = [(0, n) for n in range(1, 300)] + [(n, n + 1) for n in range(1000, 1060)] + [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(300)]
    monkeypatch.setattr(graph, "LARGE", large)
    monkeypatch.setattr(graph, "SHARE", 10)
    plans = plans_of(monkeypatch)
    found = {r.node: r.component for r in graph.connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    root = {}

    def top(x):
        while root.get(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert found == {x: top(x) for u, v in edges if u != v for x in (u, v)}
    assert max(p.count("Exchange") for p in plans) <= 12


def test_plans_of_near_dedup_stay_small(spark, monkeypatch):
    monkeypatch.setattr(graph, "LARGE", 0)
    plans = plans_of(monkeypatch)
    texts = [" ".join(f"w{n}" for n in range(k % 3 * 100, k % 3 * 100 + 40 + k // 3)) for k in range(12)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, k=2).collect()} == {k: k % 3 for k in range(12)}
    assert max(p.count("Exchange") for p in plans) <= 30
