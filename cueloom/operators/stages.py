"""Joins, set operations and roll-ups between the stages of a media file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["media_id", "cue_id"]


def resolve_best_stage(stages: list[DataFrame]) -> DataFrame:
    """Of each media file the rows of the first stage, in the order given, that has any; adds ``stage_rank``."""
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [s.withColumn("stage_rank", F.lit(i)) for i, s in enumerate(stages)])
    best = F.min("stage_rank").over(Window.partitionBy("media_id"))
    return every.withColumn("best", best).where("stage_rank = best").drop("best")


def filter_completed(rows: DataFrame) -> DataFrame:
    """Status absent or completed, and a text that isn't blank."""
    return rows.where((F.coalesce("status", F.lit("completed")) == "completed") & (F.trim(F.coalesce("text", F.lit(""))) != ""))


def pending(wanted: DataFrame, done: DataFrame, on: list[str]) -> DataFrame:
    """What is wanted and has no completed row yet."""
    return wanted.join(done.select(*on).distinct(), on, "left_anti")


def key_sets(before: DataFrame, after: DataFrame) -> DataFrame:
    """Keys that are missing, shared or extra in the later stage."""
    a, b = before.select(*KEY).distinct(), after.select(*KEY).distinct()
    parts = {"missing": a.exceptAll(b), "extra": b.exceptAll(a), "shared": a.intersect(b)}
    return reduce(DataFrame.unionByName, [p.withColumn("kind", F.lit(k)) for k, p in parts.items()])


def stage_diff(before: DataFrame, after: DataFrame, drop: float = 0.15) -> DataFrame:
    """Regressions of rows(media_id, cue_id, score, level, text): became fail or low, score drop, worse level, shortened text."""
    rank = lambda c: F.array_position(F.array(*map(F.lit, ("fail", "low", "warn", "ok"))), c)
    j = before.alias("a").join(after.alias("b"), KEY)
    fell = F.round(F.col("a.score") - F.col("b.score"), 6)
    item = lambda severity, kind: F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"))
    found = F.array(
        F.when((F.col("b.level") == "fail") & (F.col("a.level") != "fail"), item("FAIL", "became_fail")),
        F.when((F.col("b.level") == "low") & F.col("a.level").isin("warn", "ok"), item("WARN", "became_low")),
        F.when(fell >= drop, item("WARN", "score_drop")),
        F.when(rank(F.col("b.level")) < rank(F.col("a.level")), item("WARN", "level_worse")),
        F.when(F.length("b.text") < F.length("a.text") * 0.6, item("WARN", "text_shortened")),
    )
    return j.select(*KEY, fell.alias("fell"), F.explode(F.array_compact(found)).alias("i")).select(*KEY, "fell", "i.severity", "i.type")


def top_issues(issues: DataFrame, k: int) -> DataFrame:
    """The first k issues of each media file by severity, drop (largest first), type and id."""
    w = Window.partitionBy("media_id").orderBy(F.when(F.col("severity") == "FAIL", 0).otherwise(1), F.desc("fell"), "type", "cue_id")
    return issues.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def distinct_issues(issues: DataFrame, order: list[str]) -> DataFrame:
    """The first of equal (media_id, severity, type, amount)."""
    w = Window.partitionBy("media_id", "severity", "type", "amount").orderBy(*order)
    return issues.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """The old rows whose key isn't in the new ones, and the new rows."""
    return old.join(new, on, "left_anti").unionByName(new)


def expand_neighbours(ids: DataFrame, cues: DataFrame, k: int = 2) -> DataFrame:
    """The ids and those within k of them, as far as they exist."""
    near = ids.select("media_id", F.explode(F.sequence(F.col("cue_id") - k, F.col("cue_id") + k)).alias("cue_id")).distinct()
    return near.join(cues.select(*KEY), KEY, "left_semi")


def numeric_first(rows: DataFrame) -> DataFrame:
    """Numbers the keys of each media file: numeric keys by value, then the others by text."""
    number = F.col("key").try_cast("long")
    w = Window.partitionBy("media_id").orderBy(F.when(F.col("key").rlike(r"^\d+$"), 0).otherwise(1), F.when(F.col("key").rlike(r"^\d+$"), number), "key")
    return rows.withColumn("pos", F.row_number().over(w).cast("long"))


def unique_workdirs(tasks: DataFrame) -> DataFrame:
    """Work folders that clash (case aside) get -2, -3, in order of id."""
    w = Window.partitionBy(F.lower("workdir")).orderBy("task_id")
    n = F.row_number().over(w)
    return tasks.withColumn("n", n).select("task_id", F.when(F.col("n") == 1, F.col("workdir")).otherwise(F.concat("workdir", F.lit("-"), F.col("n").cast("string"))).alias("workdir"))


def artifact_counts(rows: DataFrame, stages: list[str]) -> DataFrame:
    """Rows of each media file by stage, side by side."""
    return rows.groupBy("media_id").pivot("stage", stages).count().na.fill(0)


def run_summary(runs: DataFrame) -> DataFrame:
    """Runs, successes, means and real-time factor by variant of runs(variant, success, total_s, audio_s)."""
    return runs.groupBy("variant").agg(
        F.count("*").alias("runs"), F.count_if("success").alias("successes"), F.round(F.avg(F.when(F.col("success"), F.col("total_s"))), 6).alias("mean_total"),
        F.round(F.sum(F.when(F.col("success"), F.col("total_s"))) / F.sum(F.when(F.col("success"), F.col("audio_s"))), 6).alias("rtf"),
    )


def timing_profile(events: DataFrame) -> DataFrame:
    """Calls, total and average of events(kind, name, value)."""
    return events.groupBy("kind", "name").agg(F.count("*").alias("calls"), F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("average"))


def case_counts(cases: DataFrame) -> DataFrame:
    """Counts by owner, by cause, and by both."""
    sets = cases.groupingSets([[F.col("owner")], [F.col("cause")], [F.col("owner"), F.col("cause")]], "owner", "cause")
    return sets.agg(F.count("*").alias("cases"), F.grouping_id("owner", "cause").cast("long").alias("level"))


def recovery_queue(failed: DataFrame, aligned: DataFrame) -> DataFrame:
    """Failed rows with their neighbours' texts and reasons, short answers first."""
    w = Window.partitionBy("media_id").orderBy("cue_id")
    a = aligned.select(*KEY, F.lag("text").over(w).alias("previous_text"), F.lead("text").over(w).alias("next_text"))
    letters = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    reasons = F.array_compact(F.array(F.when(letters <= 4, "short_response"), F.when(F.col("error") == "no_tokens", "no_tokens"), F.when(F.col("error") == "low_coverage", "low_coverage"), F.when(F.col("error").isin("zero_run", "zero_ratio"), "zero_duration_token")))
    out = failed.join(a, KEY).withColumn("priority", F.when(letters <= 4, 0).otherwise(1)).withColumn("reasons", F.array_join(reasons, ","))
    order = Window.partitionBy("media_id").orderBy("priority", "start_ms", "cue_id")
    return out.withColumn("place", F.row_number().over(order).cast("long")).select(*KEY, "place", "reasons", "previous_text", "next_text")
