"""Guards on values that the given tables don't hold."""

from pyspark.sql import functions as F

from cueloom.operators import guards as gd


def test_fillers_are_taken_longest_first(spark):
    rows = spark.createDataFrame([("うんうん",), ("はい。",), ("12",), ("個",), ("うんと",), ("",)], "t string")
    kind = gd.short_text_kind(F.col("t"), ["うん", "う", "ん"], ["はい"], ["個"])
    assert [r[0] for r in rows.select(kind).collect()] == ["filler", "response", "numeric", "numeric", "other", "other"]


def test_payloads(spark):
    texts = [None, "plain", "{not json", '{"translation": "a", "suspect": true, "confidence": 1.5}', '{"other": 1}']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(gd.translation_payload(F.col("t")).alias("p")).select("p.*").collect()
    assert [tuple(r) for r in got] == [("", False, 1.0), ("plain", False, 1.0), ("{not json", False, 1.0), ("a", True, 1.0), ('{"other": 1}', False, 1.0)]


def test_languages_without_a_way(spark):
    rows = spark.createDataFrame([("JA",), (None,), ("xx",)], "t string").select(gd.language_route(F.col("t")).alias("r")).select("r.*").collect()
    assert [tuple(r) for r in rows] == [("Japanese", "model", ["model", "local"]), ("Auto", "model", ["model"]), ("xx", None, [])]


def test_unbounded_proposal_is_refused(spark):
    cols = "new_start long, new_end long, start_ms long, end_ms long, short boolean, previous_end long, next_start long"
    rows = [(None, 5, 0, 10, False, None, None), (0, 10, 0, 10, False, None, None), (0, 900, 0, 1000, True, None, None), (0, 900, 0, 1000, False, 150, None)]
    got = spark.createDataFrame(rows, cols).select(gd.coarse_guard()).collect()
    assert [r[0] for r in got] == ["bounds_invalid", "accepted", "short_response_too_wide", "neighbour_overlap"]
