"""Clusters by cells and ranked search against brute force on small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest

from cueloom.llm.treap import build_treap, rank_documents, search_treap
from cueloom.llm.vafile import _near, _open_cells, _settle, _tables, cell_edges, cluster_vectors, whole_vectors, with_cells

VECTORS = "vec_id long, embedding array<float>, label int, x string, cells int"


def brute_clusters(rows, k, rounds, dim):
    kept = [(i, np.array([math.floor(256 * float(np.float32(c))) for c in v])) for i, v in rows if v is not None and len(v) == dim and all(c is not None and math.isfinite(c) for c in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1].tolist())
    centroids = [v for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((int(((v - c) ** 2).sum()), j) for j, c in enumerate(centroids))

    for _ in range(rounds):
        at = [nearest(v)[1] for _, v in kept]
        centroids = [np.array([int(s) // at.count(j) for s in sum(v for (_, v), a in zip(kept, at) if a == j)]) if j in at else c for j, c in enumerate(centroids)]
    out = [(i, *reversed(nearest(v))) for i, v in kept]
    total = {j: sum(d for _, a, d in out if a == j) for j in range(len(centroids))}
    return sorted(((i, c, d, total[c], sum(total.values()), hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest()) for i, c, d in out), key=repr)


def vectors(rnd, dim):
    hubs = [[rnd.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [h + rnd.gauss(0, 0.2) for h in rnd.choice(hubs)]) for i in range(120)]
    rows += [(7, rows[7][1]), (7, rows[8][1]), (None, rows[3][1]), (None, None), (200, []), (201, [float("nan")] * dim), (202, [float("inf")] + [0.0] * (dim - 1)), (203, [None] + [0.0] * (dim - 1))]
    return rows + [(300 + i, [0.5] * dim) for i in range(60)] + [(400, [1000.0] + [0.0] * (dim - 1))]


@pytest.mark.parametrize("k,dim,bits", [(9, 8, 4), (9, 8, 1), (300, 3, 2)])
def test_clusters(spark, k, dim, bits):
    rows = vectors(random.Random(k + bits), dim)
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS).repartition(3)
    got = sorted((tuple(r) for r in cluster_vectors(df, k=k, rounds=3, dim=dim, bits=bits)[0].collect()), key=repr)
    assert got == brute_clusters(rows, k, 3, dim)


def test_no_vectors(spark):
    df = spark.createDataFrame([(1, [1.0], 0, "x", 2), (2, None, 0, "x", 2)], VECTORS)
    out, centroids = cluster_vectors(df)
    assert out.collect() == [] and centroids == []


def test_too_large_components_are_told(spark):
    with pytest.raises(Exception, match="exceeds"):
        cluster_vectors(spark.createDataFrame([(1, [1e30, 0.0], 0, "x", 2)], VECTORS), dim=2)


def test_intervals_hold_the_distances_and_leave_few_centroids(spark):
    rows = vectors(random.Random(3), 16)
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], VECTORS)
    whole = whole_vectors(df, 16, 256)
    edges = cell_edges(whole, 4)
    batch = with_cells(whole, edges, 4).toArrow().combine_chunks().to_batches()[0]
    x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, 16).astype(np.int64)
    centroids = x[::40]
    tables = _tables(edges, centroids.tolist(), 4)
    cells = _open_cells(batch, 16, 4)
    low, high = (sum(t[d][cells[:, d]] for d in range(16)) for t in tables)
    true = ((x[:, None, :] - centroids[None]) ** 2).sum(axis=2)
    assert (low <= true).all() and (true <= high).all()
    near = _near(cells, tables)
    assert near.sum() < 0.7 * near.size
    c, far = _settle(x, near, centroids)
    assert (c == true.argmin(axis=1)).all() and (far == true.min(axis=1)).all()


def test_treap_search():
    rnd = np.random.default_rng(5)
    for height, n in ((1, 2), (4, 60), (7, 3000)):
        side = 1 << height
        at = rnd.choice(side * side, n, replace=False)
        row, col, impact = at // side, at % side, rnd.integers(1, 50, n)
        treap = build_treap(row, col, impact, height)
        grid = np.zeros((side, side), np.int64)
        grid[row, col] = impact
        for opened in (1, 7, 128):
            rows = rnd.choice(side, min(side, 5), replace=False)
            score = grid[rows].sum(axis=0)
            want = [(c, score[c]) for c in np.lexsort((np.arange(side), -score)) if score[c] > 0][:10]
            assert list(zip(*search_treap(treap, rows, 10, opened).tolist())) == want


def brute_rank(docs, items, k):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    bags = [(i, split(t)) for i, t in docs]
    nn, ll = sum(1 for _, b in bags if b), sum(len(b) for _, b in bags)
    out, asked = [], {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    for item, terms in asked.items():
        w = {t: math.floor(1000 * math.log((2 * nn + 2) / (2 * sum(t in b for _, b in bags) + 1))) for t in terms}
        scores = []
        for i, b in bags:
            m = 50 + 50 * len(b) * nn // max(ll, 1)
            scores.append((-sum(w[t] * (10**9 * b.count(t) // (1000 * b.count(t) + 20 * m)) for t in terms if t in b), i is None, i or 0))
        out += [(item, n + 1, None if none else i, -s) for n, (s, none, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_terms", [1 << 20, 20])
def test_ranked_search(spark, block_terms):
    rnd = random.Random(9)
    words = [f"w{i}" for i in range(40)] + ["É", "é", "x_y", "A-b", "日本", "ª²"]
    docs = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(60)))) for i in range(300)]
    docs += [(5, "W1 w2 w3"), (5, "w1 W2 w3"), (None, "w1 w2"), (900, None), (901, ""), (902, "--"), (903, "w1 " * 20000)] + [(1000 + i, "w7 w8 same text") for i in range(90)]
    items = [(i, " ".join(rnd.choice(words) for _ in range(8))) for i in range(12)] + [(3, "w1 same"), (None, "w2"), (50, None), (51, "unknown words only"), (52, "w7 W8 same")]
    d = spark.createDataFrame([(*r, 1, "t") for r in docs], "doc_id long, text string, n int, terms string").repartition(4)
    q = spark.createDataFrame([(*r, 1) for r in items], "item_id long, text string, rank int")
    got = sorted((tuple(r) for r in rank_documents(d, q, k=50, range_docs=64, block_terms=block_terms).collect()), key=repr)
    assert got == brute_rank(docs, items, 50)
    assert rank_documents(d.limit(0), q).collect() == [] and rank_documents(d, q.limit(0)).collect() == []
