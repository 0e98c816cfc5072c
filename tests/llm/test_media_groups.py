"""Media search among near copies: rows of its joins."""

import numpy as np

from cueloom.llm import media


def joined_rows(node) -> list[int]:
    """Rows made by the joins of a plan that has run."""
    name = node.nodeName()
    if name == "AdaptiveSparkPlan":
        return joined_rows(node.executedPlan())
    if "QueryStage" in name:
        return joined_rows(node.plan())
    own = [node.metrics().apply("numOutputRows").value()] if "Join" in name else []
    return own + [x for i in range(node.children().size()) for x in joined_rows(node.children().apply(i))]


def test_near_copies_meet_a_query_in_blocks(spark):
    rng = np.random.Generator(np.random.PCG64(3))
    base = rng.standard_normal(64)
    vectors = [(base + 0.02 * rng.standard_normal(64)).astype(np.float32).tolist() for _ in range(300)]
    table = spark.createDataFrame(list(enumerate(vectors)), "id long, v array<float>")
    queries, index = media.descriptors(table.where("id % 50 = 0"), every=50).cache(), media.descriptors(table)
    df = media.find_copies(queries, index)
    rows = df.collect()
    pairs = {(r["query"], r.id) for r in rows}
    assert len(pairs) == len(rows) and len(pairs) >= 0.9 * 6 * 300
    # one row for a query's corner and a block of images at most, in each table, not one for each image
    made = sum(joined_rows(df._jdf.queryExecution().executedPlan()))
    assert 0 < made <= media.BLOCKS * media.TABLES * queries.count()
    assert made < 8 * len(rows)
