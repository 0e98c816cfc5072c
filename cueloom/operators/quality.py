"""Issues of cues and their roll-up to PASS, WARN and FAIL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Short answers whose cues may be short.
PROTECTED = ["はい", "え", "うん", "ううん", "いいえ", "駄目", "だめ", "ダメ", "違う", "痛い", "あ", "ああ", "いや", "お", "おお", "はあ"]


def issue(severity: str, kind: str, amount: Column | None = None) -> Column:
    return F.struct(F.lit(severity).alias("severity"), F.lit(kind).alias("type"), (amount if amount is not None else F.lit(None)).cast("long").alias("amount"))


def readability_issues(cues: DataFrame) -> DataFrame:
    """(media_id, cue_id, severity, type, amount): every readability issue of every cue, overlaps with the previous cue included."""
    order = Window.partitionBy("media_id").orderBy("cue_id")
    text = F.trim(F.coalesce("text", F.lit("")))
    timed = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull()
    dur = F.col("end_ms") - F.col("start_ms")
    short = F.col("key").isin(PROTECTED)
    late = F.col("previous_end") - F.col("start_ms")
    found = F.array(
        F.when(F.col("shown") == "", issue("FAIL", "empty_text")),
        F.when(~timed, issue("FAIL", "missing_time")),
        F.when(timed & ((F.col("start_ms") < 0) | (F.col("end_ms") < 0)), issue("FAIL", "negative_time")),
        F.when(timed & (dur <= 0), issue("FAIL", "non_positive_duration", dur))
        .when(timed & (dur < 120) & short, issue("WARN", "protected_short_too_fast", dur))
        .when(timed & ((dur < 120) | ((dur < 500) & ~short)), issue("WARN", "ordinary_subtitle_too_fast", dur))
        .when(timed & (dur > 8000), issue("WARN", "very_long_duration", dur)),
        F.when(timed & (F.length("shown") > 80), issue("WARN", "long_text", F.length("shown"))),
        F.when(timed & (late > 500), issue("FAIL", "overlap", late)).when(timed & (late > 0), issue("WARN", "overlap", late)),
    )
    previous = F.last(F.when(timed, F.col("end_ms")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    c = cues.withColumn("shown", text).withColumn("key", F.regexp_replace(text, r"[\p{P}\p{S}\s]", "")).withColumn("previous_end", previous)
    return c.select("media_id", "cue_id", F.explode(F.array_compact(found)).alias("i")).select("media_id", "cue_id", "i.severity", "i.type", "i.amount")


def overlap_issues(cues: DataFrame) -> DataFrame:
    """Overlaps with the previous cue: FAIL beyond 500 ms."""
    return readability_issues(cues).where("type = 'overlap'")


def issue_counts(issues: DataFrame) -> DataFrame:
    """Counts by severity and type, with totals for each media file and the whole catalogue."""
    return issues.rollup("media_id", "type").agg(
        F.count_if(F.col("severity") == "FAIL").alias("fails"), F.count_if(F.col("severity") == "WARN").alias("warns"), F.grouping_id().cast("long").alias("level")
    )


def media_summary(cues: DataFrame, issues: DataFrame) -> DataFrame:
    """Cues, fails, warns and status of each media file, files without issues included."""
    n = cues.groupBy("media_id").agg(F.count("*").alias("cues"))
    i = issues.groupBy("media_id").agg(F.count_if(F.col("severity") == "FAIL").alias("fails"), F.count_if(F.col("severity") == "WARN").alias("warns"))
    out = n.join(i, "media_id", "left").select("media_id", "cues", F.coalesce("fails", F.lit(0)).alias("fails"), F.coalesce("warns", F.lit(0)).alias("warns"))
    return out.withColumn("status", status(F.col("fails"), F.col("warns")))


def status(fails: Column, warns: Column) -> Column:
    return F.when(fails > 0, "FAIL").when(warns > 0, "WARN").otherwise("PASS")


def quality_gate(checks: DataFrame) -> DataFrame:
    """Worst status and counts of checks(media_id, check, status); skipped counts as PASS."""
    known = F.when(F.col("status").isin("FAIL", "WARN"), F.col("status")).otherwise("PASS")
    c = checks.withColumn("s", known)
    out = c.groupBy("media_id").agg(*(F.count_if(F.col("s") == x).alias(f"{x.lower()}_count") for x in ("PASS", "WARN", "FAIL")))
    return out.withColumn("status", status(F.col("fail_count"), F.col("warn_count")))


def boundary_overlap(previous: Column, current: Column, most: int = 20) -> Column:
    """Length of the longest suffix of one text that begins the next, at most ``most`` characters."""
    sizes = F.sequence(F.lit(most), F.lit(1), F.lit(-1))
    fits = F.filter(sizes, lambda k: (k <= F.length(previous)) & (k <= F.length(current)) & (F.right(previous, k) == F.left(current, k)))
    return F.coalesce(F.get(fits, F.lit(0)), F.lit(0))


def boundary_duplicates(cues: DataFrame) -> DataFrame:
    """Neighbours at most 500 ms apart whose texts are equal, or of which one ends as the next begins."""
    order = Window.partitionBy("media_id").orderBy("start_ms", "cue_id")
    c = cues.withColumn("key", F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", ""))
    c = c.withColumn("pk", F.lag("key").over(order)).withColumn("pe", F.lag("end_ms").over(order)).where("pk is not null and start_ms - pe <= 500")
    same = (F.col("key") == F.col("pk")) & (F.length("key") >= 2)
    c = c.withColumn("chars", F.when(same, F.length("key")).otherwise(boundary_overlap(F.col("pk"), F.col("key"))))
    least = F.when(F.col("start_ms") < F.col("pe"), 2).otherwise(3)
    return c.where(same | (F.col("chars") >= least)).select("media_id", "cue_id", F.col("chars").cast("long").alias("chars"), same.alias("equal"))


def introduced_duplicates(source: DataFrame, target: DataFrame) -> DataFrame:
    """Bag difference: the occurrences of a text in the target beyond those in the source."""
    key = F.lower(F.trim("text"))
    n = source.groupBy("media_id", key.alias("key")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("media_id", "key").orderBy("cue_id")
    t = target.withColumn("key", key).withColumn("nth", F.row_number().over(w).cast("long")).join(n, ["media_id", "key"], "left")
    return t.where(F.col("nth") > F.coalesce("n", F.lit(0))).select("media_id", "cue_id", "nth")


def adjacent_duplicates(cues: DataFrame) -> DataFrame:
    """Cues whose text equals the previous one's, case and punctuation aside."""
    order = Window.partitionBy("media_id").orderBy("cue_id")
    key = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "")
    return cues.withColumn("key", key).withColumn("pk", F.lag("key").over(order)).where("key = pk and key <> ''").select("media_id", "cue_id", "key")


def stage_metrics(cues: DataFrame) -> DataFrame:
    """Items, letters and digits, texts that occur once, bad and non-monotonic times, adjacent duplicates, by media and stage."""
    order = Window.partitionBy("media_id", "stage").orderBy("cue_id")
    key = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "")
    c = cues.withColumn("key", key)
    c = c.withColumn("n", F.count("*").over(Window.partitionBy("media_id", "stage", "key"))).withColumn("pk", F.lag("key").over(order)).withColumn("ps", F.lag("start_ms").over(order))
    return c.groupBy("media_id", "stage").agg(
        F.count("*").alias("items"),
        F.sum(F.length("key")).alias("chars"),
        F.count_if((F.col("n") == 1) & (F.col("key") != "")).alias("once"),
        F.count_if(F.col("end_ms") <= F.col("start_ms")).alias("invalid_times"),
        F.count_if(F.col("start_ms") < F.col("ps")).alias("non_monotonic"),
        F.count_if((F.col("key") == F.col("pk")) & (F.col("key") != "")).alias("adjacent_duplicates"),
    )


def content_hash(cues: DataFrame) -> DataFrame:
    """SHA-256 of the normalised texts of a media file, in order."""
    key = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]", "")
    parts = F.array_sort(F.collect_list(F.struct("cue_id", key.alias("key"))))
    return cues.groupBy("media_id").agg(F.sha2(F.array_join(F.transform(parts, lambda x: x["key"]), ""), 256).alias("content"))


def worst_rows(scored: DataFrame, k: int, *by: str) -> DataFrame:
    """The k rows of the lowest score of each group, lowest id first on ties."""
    w = Window.partitionBy(*by).orderBy("score", "cue_id")
    return scored.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= k)


def translation_checks(split: DataFrame, translated: DataFrame) -> DataFrame:
    """Missing, blank and extra keys of the translation of each media file."""
    a = split.select("media_id", "cue_id", F.lit(True).alias("a"))
    b = translated.select("media_id", "cue_id", (F.trim(F.coalesce("translated", F.lit(""))) == "").alias("blank"), F.lit(True).alias("b"))
    j = a.join(b, ["media_id", "cue_id"], "full")
    out = j.groupBy("media_id").agg(
        F.count_if(F.col("b").isNull()).alias("missing"), F.count_if(F.col("a").isNotNull() & F.col("blank")).alias("blank"), F.count_if(F.col("a").isNull()).alias("extra"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("shared")
    )
    return out.withColumn("status", status(F.col("missing") + F.col("blank"), F.col("extra")))
