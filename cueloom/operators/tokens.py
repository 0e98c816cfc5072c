"""Checks of aligned tokens: timing errors, runs, densities and metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SEGMENT = ("media_id", "cue_id")


def _runs(tokens: DataFrame, flag) -> DataFrame:
    """Lengths of the runs of flagged tokens of each segment."""
    order = Window.partitionBy(*SEGMENT).orderBy("pos")
    t = tokens.withColumn("flag", flag.cast("int"))
    t = t.withColumn("run", F.sum(1 - F.col("flag")).over(order))
    return t.where("flag = 1").groupBy(*SEGMENT, "run").agg(F.count("*").alias("n"))


def one_ms_runs(tokens: DataFrame) -> DataFrame:
    """Number and longest run of tokens that last 1 ms at most, but more than nothing."""
    dur = F.col("end_ms") - F.col("start_ms")
    return _runs(tokens, (dur > 0) & (dur <= 1)).groupBy(*SEGMENT).agg(F.sum("n").alias("one_ms"), F.max("n").alias("longest_run"))


def token_metrics(tokens: DataFrame, long_ms: int = 3000) -> DataFrame:
    order = Window.partitionBy(*SEGMENT).orderBy("pos")
    dur = F.col("end_ms") - F.col("start_ms")
    t = tokens.withColumn("previous", F.lag("start_ms").over(order))
    return t.groupBy(*SEGMENT).agg(
        F.count("*").alias("tokens"),
        F.count_if(dur <= 0).alias("zero"),
        F.count_if((dur > 0) & (dur <= 1)).alias("one_ms"),
        F.count_if(F.col("start_ms") < F.col("previous")).alias("non_monotonic"),
        F.count_if(dur > long_ms).alias("long"),
    )


def _windows(tokens: DataFrame, width: int = 12) -> DataFrame:
    """Characters and end of the windows of 1 to ``width`` tokens that begin at each token, side by side."""
    order = Window.partitionBy(*SEGMENT).orderBy("pos")
    t = tokens.where("trim(token) <> '' and end_ms >= start_ms").withColumn("chars", F.length(F.trim("token")))
    frames = [
        F.struct(F.sum("chars").over(order.rowsBetween(0, k)).alias("chars"), (F.max("end_ms").over(order.rowsBetween(0, k)) - F.col("start_ms")).alias("ms"))
        for k in range(width)
    ]
    return t.select(*SEGMENT, "pos", F.array(*frames).alias("windows"))


def local_max_cps(tokens: DataFrame) -> DataFrame:
    """Most characters a second of any window of 1 to 12 tokens."""
    rates = F.transform(F.filter("windows", lambda w: w["ms"] > 0), lambda w: w["chars"] * 1000 / w["ms"])
    return _windows(tokens).groupBy(*SEGMENT).agg(F.max(F.array_max(rates)).alias("max_cps"))


def token_timing_error(tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """The first timing error of each of segments(media_id, cue_id, start_ms, end_ms), or ok.

    In order: no tokens, starts that go back, less than a fifth covered, more
    than 8 tokens without duration in a row, half of them without and less than
    half covered, 8 or more characters within half a second at 35 a second.
    """
    order = Window.partitionBy(*SEGMENT).orderBy("pos")
    positive = F.col("end_ms") > F.col("start_ms")
    t = tokens.withColumn("back", F.col("start_ms") < F.lag("start_ms").over(order))
    basic = t.groupBy(*SEGMENT).agg(
        F.count("*").alias("n"),
        F.count_if(~positive).alias("zero"),
        F.bool_or("back").alias("back"),
        (F.max(F.when(positive, F.col("end_ms"))) - F.min(F.when(positive, F.col("start_ms")))).alias("covered"),
    )
    runs = _runs(tokens, ~positive).groupBy(*SEGMENT).agg(F.max("n").alias("run"))
    dense = F.exists("windows", lambda w: (w["ms"] > 0) & (w["chars"] >= 8) & (w["ms"] <= 500) & (w["chars"] * 1000 >= w["ms"] * 35))
    packed = _windows(tokens).groupBy(*SEGMENT).agg(F.bool_or(dense).alias("dense"))
    out = reduce(lambda a, b: a.join(b, list(SEGMENT), "left"), [basic, runs, packed], segments.select(*SEGMENT, (F.col("end_ms") - F.col("start_ms")).alias("ms")))
    share = F.coalesce("covered", F.lit(0)) / F.col("ms")
    error = (
        F.when(F.col("n").isNull(), "no_tokens")
        .when(F.col("back"), "not_monotonic")
        .when((F.col("ms") > 0) & (share < 0.2), "low_coverage")
        .when(F.col("run") > 8, "zero_run")
        .when((F.col("ms") > 0) & (F.col("zero") * 2 >= F.col("n")) & (share < 0.5), "zero_ratio")
        .when(F.col("dense"), "local_density")
        .otherwise("ok")
    )
    return out.select(*SEGMENT, error.alias("error"))


def alignment_health(errors: DataFrame, tokens: DataFrame) -> DataFrame:
    """Segments, errors, 1-ms clusters and status of each media file."""
    clusters = one_ms_runs(tokens).where("longest_run >= 3 or one_ms >= 5").select(*SEGMENT, F.lit(1).alias("cluster"))
    out = errors.join(clusters, list(SEGMENT), "left").groupBy("media_id").agg(
        F.count("*").alias("segments"), F.count_if(F.col("error") != "ok").alias("timing_errors"), F.count("cluster").alias("clusters")
    )
    return out.withColumn("status", F.when(F.col("timing_errors") > 0, "FAIL").when(F.col("clusters") > 0, "WARN").otherwise("PASS"))
