"""Repeated passages against a brute-force search, and crafted words."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.llm import textvec
from cueloom.llm.phrases import remove_repeats

SCHEMA = "doc_id long, text string, shard int, source string, key int"


def brute(rows, width):
    first = {}
    for doc_id, text in rows:
        words = (text or "").encode().split()
        for i in range(len(words) - width + 1):
            k = tuple(words[i : i + width])
            if doc_id is not None:
                first[k] = min(first.get(k, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words, gone = (text or "").encode().split(), set()
        for i in range(len(words) - width + 1):
            if doc_id is not None and first[tuple(words[i : i + width])] < doc_id:
                gone |= set(range(i, i + width))
        out.append((doc_id, len(words), len(gone), " ".join(w.decode() for i, w in enumerate(words) if i not in gone)))
    return out


def order(row):
    return repr(row)


@pytest.mark.parametrize("group_bytes", [300, 1 << 20])
def test_random_documents(spark, group_bytes):
    rnd = random.Random(group_bytes)
    base = [" ".join(rnd.choice("abcdé") for _ in range(n)) for n in (12, 13, 14, 40, 200)]
    rows = []
    for i in range(60):
        parts = [" ".join(rnd.choice("abcdéfghijk") for _ in range(rnd.randrange(30)))]
        for _ in range(rnd.randrange(3)):
            parts += [rnd.choice(base), rnd.choice(["x", "\t\n", "ÿ y"])]
        rows.append((rnd.randrange(50), " ".join(parts)))
    rows += [(None, base[3]), (None, None), (100, None), (101, ""), (102, " \n "), (103, base[4]), (103, base[4]), (104, "tick tock " * 300), (105, "tick tock " * 200), (106, "A " + base[3].upper())]
    df = spark.createDataFrame([(*r, 0, "s", 1) for r in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in remove_repeats(df, group_bytes=group_bytes).select("doc_id", "n_words", "n_removed", "kept_text").collect()]
    assert sorted(got, key=order) == sorted(brute(rows, 13), key=order)
    spans = remove_repeats(df, group_bytes=group_bytes).select("n_removed", F.expr("aggregate(removed, 0L, (a, x) -> a + x.stop - x.start)").alias("n"))
    assert spans.where("n <> n_removed").count() == 0


def test_no_rows(spark):
    assert remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_one_passage_in_every_document(spark):
    """A hot passage: every document but the first loses it with the word before it, none loses its own words."""
    passage = " ".join(f"p{i}" for i in range(60))
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("own"), F.col("id"), F.lit(" words "), F.lit(passage), F.lit(" tail"), F.col("id")).alias("text"))
    got = {r.n_removed: r.n for r in remove_repeats(df, group_bytes=20_000).groupBy("n_removed").agg(F.count("*").alias("n")).collect()}
    assert got == {0: 1, 61: 2999}


def test_word_hashes_tell_crafted_words_apart():
    import pyarrow as pa

    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    for n in (1, 8, 9, 64, 256, 2048):
        texts = pa.array([word[:n], word[:n].translate(str.maketrans("ab", "ba")), word[:n] + "\x00"])
        h, bounds, _, _ = textvec.words(*textvec.string_buffers(texts))
        assert len(set(h.tolist())) == 3 and bounds.tolist() == [0, 1, 2, 3]
