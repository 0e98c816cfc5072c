"""Matching cues with reference dialogue by time and text, and mining word pairs from matches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import norm_latin
from cueloom.operators.intervals import iou, overlap_join, overlap_ms


def boundary_score(a_start, a_end, b_start, b_end) -> Column:
    off = F.abs(a_start - b_start) + F.abs(a_end - b_end)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1.0 - off / (F.greatest(F.lit(800), a_end - a_start) * 1.6)))


def match_score(m: DataFrame) -> DataFrame:
    """Adds the sub-scores, score and reasons to rows(start_ms, end_ms, key, r_start, r_end, r_key, n_merged, covered_ms)."""
    a, b, c, d = (F.col(x) for x in ("start_ms", "end_ms", "r_start", "r_end"))
    left, right = F.length("key"), F.length("r_key")
    m = (
        m.withColumn("time_overlap", iou(a, b, c, d))
        .withColumn("boundary", boundary_score(a, b, c, d))
        .withColumn("length_ratio", F.when((left == 0) | (right == 0), F.lit(0.0)).otherwise(F.least(left, right) / F.greatest(left, right)))
        .withColumn("merge_penalty", F.least(F.lit(0.4), (F.col("n_merged") - 1) * 0.08))
        .withColumn("token_coverage", F.least(F.lit(1.0), F.col("covered_ms") / F.greatest(F.lit(1), b - a)))
    )
    raw = F.col("time_overlap") * 0.45 + F.col("boundary") * 0.20 + F.col("length_ratio") * 0.15 + F.col("token_coverage") * 0.20 - F.col("merge_penalty")
    reasons = F.array_compact(F.array(
        F.when(F.col("time_overlap") < 0.45, "time weak"), F.when(F.col("n_merged") >= 3, F.concat(F.lit("merged "), F.col("n_merged").cast("string"), F.lit(" splits"))),
        F.when(F.col("token_coverage") < 0.55, "sparse tokens"), F.when(F.col("length_ratio") < 0.45, "length drift"), F.when(right == 0, "empty source"),
    ))
    m = m.withColumn("score", F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)), 4))
    return m.withColumn("reasons", F.when(F.size(reasons) == 0, F.lit("ok")).otherwise(F.array_join(reasons, ",")))


def match_level(score: Column, least: float = 0.75) -> Column:
    return F.when(score >= least, "high").when(score >= least - 0.18, "medium").otherwise("low")


def quality_level(score: Column) -> Column:
    return F.when(score < 0.20, "fail").when(score < 0.45, "low").when(score < 0.75, "warn").otherwise("ok")


def cue_runs(cues: DataFrame, longest: int = 4) -> DataFrame:
    """Every run of 1 to ``longest`` consecutive cues, with its bounds, joined key and covered time."""
    order = Window.partitionBy("media_id").orderBy("start_ms", "cue_id")
    c = cues.withColumn("r_key", norm_latin(F.col("text"))).withColumn("dur", F.col("end_ms") - F.col("start_ms"))
    runs = [
        F.struct(
            F.lit(k + 1).alias("n_merged"), F.max("end_ms").over(order.rowsBetween(0, k)).alias("end_ms"), F.array_join(F.collect_list("r_key").over(order.rowsBetween(0, k)), "").alias("r_key"),
            F.sum("dur").over(order.rowsBetween(0, k)).alias("sum_ms"), F.count("*").over(order.rowsBetween(0, k)).alias("have"),
        )
        for k in range(longest)
    ]
    c = c.select("media_id", "cue_id", "start_ms", F.array(*runs).alias("runs")).select("media_id", "cue_id", "start_ms", F.explode("runs").alias("r")).where("r.have = r.n_merged")
    return c.select("media_id", "cue_id", "start_ms", "r.end_ms", "r.n_merged", "r.r_key", "r.sum_ms")


def match_dialogues(dialogues: DataFrame, cues: DataFrame, margin_ms: int = 2500) -> DataFrame:
    """Each dialogue line with its best run of cues within ``margin_ms``, or as missing with score 0."""
    lines = dialogues.select("media_id", "line_id", "start_ms", "end_ms", norm_latin(F.col("text")).alias("key"))
    met = overlap_join(lines, cue_runs(cues), margin_ms)
    met = met.withColumn("covered_ms", F.least("sum_ms", overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end"))))
    best = match_score(met).groupBy("media_id", "line_id").agg(F.max(F.struct("score", (-F.col("n_merged")).alias("fewer"), (-F.col("cue_id")).alias("first"), "reasons")).alias("b"))
    out = lines.select("media_id", "line_id").join(best, ["media_id", "line_id"], "left")
    score = F.coalesce("b.score", F.lit(0.0))
    return out.select("media_id", "line_id", (-F.col("b.first")).alias("cue_id"), F.coalesce(-F.col("b.fewer"), F.lit(0)).alias("n_merged"), score.alias("score"), match_level(score).alias("level"), F.coalesce("b.reasons", F.lit("missing")).alias("reasons"))


def match_summary(matches: DataFrame) -> DataFrame:
    """Mean, median and counts by threshold of each media file.

    Scores have four decimals, so they are summed as whole numbers of ten-thousandths, whatever the order of the rows.
    """
    points = F.round(F.col("score") * 10000).cast("long")
    s = matches.groupBy("media_id").agg(
        F.count("*").alias("lines"), (F.sum(points) / (F.count("*") * 10000)).alias("mean"), (F.median(points) / 10000).alias("median"), *(F.count_if(F.col("level") == x).alias(x) for x in ("high", "medium", "low")),
        F.count_if(F.col("score") >= 0.75).alias("good"), F.count_if(F.col("score") < 0.45).alias("weak"), F.count_if(F.col("score") < 0.20).alias("failed"),
    )
    return s.withColumn("status", F.when(F.col("failed") > 0, "FAIL").when(F.col("weak") > 0, "WARN").otherwise("PASS"))


def select_reference(dialogues: DataFrame, styles: list[str], skip: tuple[str, ...] = ("OP", "ED")) -> DataFrame:
    """Lines of the styles, without those of skipped prefixes or without text; the first of equal (start, end, text)."""
    d = dialogues.where(F.col("style").isin(styles) & (norm_latin(F.col("text")) != ""))
    for prefix in skip:
        d = d.where(~F.startswith(F.upper("style"), F.lit(prefix)))
    w = Window.partitionBy("media_id", "start_ms", "end_ms", "text").orderBy("line_id")
    return d.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def mine_pairs(pairs: DataFrame, least: int = 2) -> DataFrame:
    """For each source term its most frequent target (the first seen on ties), other targets and media files.

    Pairs are counted by (source, target) first, so a frequent source is
    spread over many tasks before its few targets meet.
    """
    counts = pairs.groupBy("source", "target").agg(F.count("*").alias("n"), F.min(F.struct("media_id", "cue_id")).alias("first"))
    w = Window.partitionBy("source").orderBy(F.desc("n"), "first.media_id", "first.cue_id", "target")
    ranked = counts.withColumn("rank", F.row_number().over(w)).withColumn("total", F.sum("n").over(Window.partitionBy("source")))
    top = ranked.where("rank <= 4").groupBy("source").agg(
        F.max("total").alias("total"), F.max(F.when(F.col("rank") == 1, F.col("target"))).alias("target"), F.max(F.when(F.col("rank") == 1, F.col("n"))).alias("n"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "target")))), lambda x: x["target"]), ",").alias("alternates"),
    )
    return top.where(F.col("n") >= least)


def glossary_hits(cues: DataFrame, glossary: DataFrame, limit: int = 80) -> DataFrame:
    """Entries(term, grp) that occur as words of each cue, then the general ones, cut to ``limit``."""
    words = cues.select("media_id", "cue_id", F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))).alias("term"))
    hits = words.join(glossary, "term").select("media_id", "cue_id", "term", "grp", F.lit(0).alias("rank"))
    w = Window.partitionBy("media_id", "cue_id").orderBy("rank", "term")
    return hits.withColumn("n", F.row_number().over(w).cast("long")).where(F.col("n") <= limit).select("media_id", "cue_id", "term", "grp", "n")


def estimate_offset(dialogues: DataFrame, cues: DataFrame, bucket_ms: int = 500) -> DataFrame:
    """The time shift between each media file's dialogue and cues.

    Lines and cues of equal normalised text (6 characters or more) vote by the
    difference of their starts, in half-even buckets; the fullest bucket's median,
    with its neighbours, rounded to 10 ms, is the offset.
    """
    a = dialogues.select("media_id", "start_ms", norm_latin(F.col("text")).alias("key")).where("length(key) >= 6")
    b = cues.select("media_id", F.col("start_ms").alias("cue_start"), norm_latin(F.col("text")).alias("key"))
    votes = a.join(b, ["media_id", "key"]).withColumn("shift", F.col("start_ms") - F.col("cue_start")).withColumn("bucket", F.bround(F.col("shift") / bucket_ms).cast("long"))
    top = votes.groupBy("media_id", "bucket").agg(F.count("*").alias("n")).groupBy("media_id").agg(F.max_by("bucket", F.struct("n", -F.abs("bucket"))).alias("top"))
    near = votes.join(top, "media_id").where(F.abs(F.col("bucket") - F.col("top")) <= 1)
    return near.groupBy("media_id").agg(F.count("*").alias("votes"), (F.bround(F.median("shift") / 10) * 10).cast("long").alias("offset_ms"))


def ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b, autojunk=False).ratio()


def best_window_ratio(a: str, b: str, least: float = 0.0) -> float:
    """Similarity of the shorter text with the most similar stretch (0.7 to 1.3 of its length) of the longer one.

    Below ``least`` the answer may be 0: only stretches of lengths that can reach it are tried then.
    """
    if not a or not b:
        return 0.0
    a, b = sorted((a, b), key=len)
    if len(b) <= len(a) * 1.3:
        return ratio(a, b)
    best = floor = max(0.0, least - 1e-9)
    match = SequenceMatcher(None, "", a, autojunk=False)
    for size in range(max(1, round(len(a) * 0.7)), min(len(b), round(len(a) * 1.3)) + 1):
        if 2 * min(size, len(a)) / (size + len(a)) <= best:
            continue
        for at in range(len(b) - size + 1):
            match.set_seq1(b[at : at + size])
            if match.real_quick_ratio() > best and match.quick_ratio() > best:
                best = max(best, ratio(a, b[at : at + size]))
    return best if best > floor else 0.0


def window_ratio(a: Column, b: Column, least: float = 0.0) -> Column:
    """``best_window_ratio`` of two columns."""

    @F.pandas_udf("double")
    def score(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([best_window_ratio(s or "", t or "", least) for s, t in zip(x, y)], dtype="float64")

    return score(a, b)


def text_similarity(pairs: DataFrame) -> DataFrame:
    """Adds ``similarity`` to pairs(key, r_key): each distinct pair is compared once, equal keys without a comparison."""
    distinct = pairs.select("key", "r_key").where("key <> r_key").distinct().withColumn("s", window_ratio(F.col("key"), F.col("r_key")))
    return pairs.join(distinct, ["key", "r_key"], "left").withColumn("similarity", F.when(F.col("key") == F.col("r_key"), F.when(F.col("key") == "", 0.0).otherwise(1.0)).otherwise(F.coalesce("s", F.lit(0.0)))).drop("s")


def best_text_match(dialogues: DataFrame, cues: DataFrame, margin_ms: int = 1200) -> DataFrame:
    """Each line with the cue of the most similar text within ``margin_ms``, the first on ties, or score 0."""
    lines = dialogues.select("media_id", "line_id", "start_ms", "end_ms", norm_latin(F.col("text")).alias("key"))
    met = overlap_join(lines, cues.select("media_id", "cue_id", "start_ms", "end_ms", norm_latin(F.col("text")).alias("r_key")), margin_ms)
    best = text_similarity(met).groupBy("media_id", "line_id").agg(F.max(F.struct("similarity", (-F.col("cue_id")).alias("first"))).alias("b"))
    out = lines.select("media_id", "line_id").join(best, ["media_id", "line_id"], "left")
    return out.select("media_id", "line_id", (-F.col("b.first")).alias("cue_id"), F.coalesce("b.similarity", F.lit(0.0)).alias("score"))
