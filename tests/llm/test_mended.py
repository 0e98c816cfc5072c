"""Crafted words, hot buckets and workers without the package."""

import os
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from cueloom.llm import lsh
from cueloom.llm.decontaminate import compare
from cueloom.llm.near_dup import near_duplicates

REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def test_documents_without_a_common_shingle_stay_apart(spark):
    """Words that clash in any polynomial hash of 64 bits."""
    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"x {word}"), (2, f"x {other}"), (3, f"X  {word}\n"), (4, "one two three four"), (5, "One TWO three\tfour"), (6, "one two three four one two")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 4, 5: 4, 6: 6}


def test_equal_digests_of_different_sets_are_told_apart(spark, monkeypatch):
    """Were all digests equal, the full sets would still decide."""
    import cueloom.llm.near_dup as nd

    real = nd.signatures
    monkeypatch.setattr(nd, "signatures", lambda *a: real(*a).withColumns({"d1": F.lit(0).cast("long"), "d2": F.lit(0).cast("long")}))
    rows = [(1, "a b c d"), (2, "a b c e"), (3, "A b  c d"), (4, "a b c e"), (5, "q r s t")]
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5}


@pytest.mark.parametrize("members", [10_000, 40_000])
def test_a_hot_bucket_with_one_outlier_shuffles_in_proportion(spark, members, monkeypatch):
    """Rows that meet in blocks: each member of the large component once, the outlier once a block."""
    counted = []
    kept = lsh._groups
    rest = spark.range(members + 1).select(
        F.lit(1).cast("long").alias("bucket"), F.col("id").alias("node"), F.when(F.col("id") < members, 0).otherwise(F.col("id")).alias("component"), F.lit(0).cast("long").alias("main"),
        F.lit(1).alias("blocks"), F.ceil(F.lit(members / lsh.MEMBERS)).cast("int").alias("main_blocks"), F.lit(0).cast("long").alias("sketch"), F.lit(1).alias("n"))
    seen = spark.sparkContext.accumulator(0)

    def counting(batches, n):
        for group, rb in kept(batches, n):
            seen.add(rb.num_rows)
            yield group, rb

    monkeypatch.setattr(lsh, "_groups", counting)
    met = lsh.likely_members(rest, 80, 64).collect()
    counted.append(seen.value)
    assert counted[0] <= members + 1 + 2 * (members // lsh.MEMBERS + 1) + 300
    assert {r.node for r in met} == set(range(members + 1))


def test_outliers_of_a_hot_bucket_find_their_links(spark):
    """Near copies of one text in many components, and a few that are linked across."""
    rnd = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    base = [rnd.choice(words) for _ in range(60)]
    rows = [(i, " ".join(base[:55] + [f"t{i}a", f"t{i}b"])) for i in range(600)] + [(1000 + i, " ".join([f"s{i}a", f"s{i}b", f"s{i}c"] + base[:50] + [f"u{i}"])) for i in range(40)]
    sets = {i: {tuple(w[j : j + 2]) for j in range(len(w) - 1)} for i, w in ((i, t.split()) for i, t in rows)}
    link = lambda a, b: 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    root = {i: i for i in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if top(a) != top(b) and link(a, b):
                root[max(top(a), top(b))] = min(top(a), top(b))
    got = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()}
    assert got == {i: top(i) for i in ids}


def test_a_stretch_is_sought_from_every_shared_word():
    item = list(range(40))
    held = [*range(0, 40, 3), *range(1, 40, 3), *range(2, 40, 3)]
    exact = sorted(held)[:28]
    region = [(7, 39)] + [(10 + n, w) for n, w in enumerate(exact)]
    assert compare(item, [], region)[0] == 0.7


def test_workers_without_the_package(tmp_path):
    """Helpers and indexes reach tasks by value."""
    code = f"""
import sys
sys.path.insert(0, {REPO!r})
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
from pyspark.sql import functions as F
@F.udf("boolean")
def there(x):
    import importlib.util
    return importlib.util.find_spec("cueloom") is not None
assert not s.range(1).select(there("id")).first()[0]
from cueloom.llm.decontaminate import find_leaks, without_leaks
from cueloom.llm.phrases import remove_repeats
from cueloom.llm.treap import rank_documents
from cueloom.llm.vafile import cluster_vectors
item = " ".join(f"w{{i}}" for i in range(40))
docs = s.createDataFrame([(1, "before " + item + " after"), (2, "nothing of it"), (3, item)], "doc_id long, text string")
items = s.createDataFrame([(7, item)], "item_id long, text string")
assert sorted(r.doc_id for r in find_leaks(docs, items).collect()) == [1, 3]
assert [r.doc_id for r in without_leaks(docs, items).collect()] == [2]
assert sorted(r.n_removed for r in remove_repeats(docs).collect()) == [0, 0, 40]
assert [r.doc_id for r in rank_documents(docs, items).orderBy("rank").collect()][:2] == [3, 1]
v = s.createDataFrame([(i, [float(i % 3), 0.5]) for i in range(30)], "vec_id long, embedding array<float>")
assert cluster_vectors(v, k=3, dim=2)[0].count() == 30
print("all by value")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert "all by value" in got.stdout, got.stderr[-2000:]


def test_only_members_of_recurring_buckets_of_lines_are_sorted(spark):
    """Every member of a bucket with two different lines is there, and hardly any other."""
    import struct
    from collections import defaultdict

    from cueloom.llm.fuzzy_lines import line_keys, recurring_members

    texts = [(i, i, "\n".join(f"line {(i * 7 + j * j) % 90} of {j % 3} has {'some' if i % 4 else 'more'} words {i * j * 7919}" for j in range(6)) + "\nsame in all\n \n") for i in range(120)]
    table = line_keys(spark.createDataFrame([*texts, (900, 900, ""), (901, 901, None)], "row long, doc_id long, text string").repartition(5)).persist()
    nodes = defaultdict(set)
    for r in table.where("length(keys) > 0").collect():
        for band, key in enumerate(struct.unpack("<14I", r["keys"])):
            nodes[band << 32 | key].add(r.node)
    got = {(r.bucket, r.node) for r in recurring_members(table).collect()}
    want = {(b, n) for b, found in nodes.items() if len(found) > 1 for n in found}
    alone = {(b, n) for b, found in nodes.items() if len(found) == 1 for n in found}
    assert want and want <= got <= want | alone and len(got - want) < 0.01 * len(alone)
    assert recurring_members(table.where("line_no is null")).count() == 0
