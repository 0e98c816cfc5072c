"""Choosing, ranking and summing up what is to be reviewed; grouping of tokens and cues."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The marks that end a sentence, ideographs and kana, and the severities in order.
SENTENCE_END = r"[.!?…。！？]$"
UNSPACED = r"[぀-ヿ㐀-鿿]"
SEVERITIES = ["FAIL", "WARN", "INFO"]


def token_text(pieces: Column) -> Column:
    """The pieces as one text: as they are where any of them holds a space, an ideograph or kana, else with spaces between."""
    joined = F.exists(pieces, lambda p: p.contains(" ") | p.rlike(UNSPACED))
    return F.when(joined, F.array_join(pieces, "")).otherwise(F.array_join(pieces, " "))


def per_second(amount: Column, start_ms: Column, end_ms: Column) -> Column:
    """Amount by second; 0 without a duration."""
    return F.when(end_ms > start_ms, amount * 1000.0 / (end_ms - start_ms)).otherwise(F.lit(0.0))


def sentence_groups(tokens: DataFrame) -> DataFrame:
    """Adds ``grp`` to tokens(media_id, cue_id, pos, token): a new group begins after each sentence end."""
    w = Window.partitionBy("media_id", "cue_id").orderBy("pos")
    ended = F.coalesce(F.lag(F.col("token").rlike(SENTENCE_END)).over(w), F.lit(False))
    return tokens.withColumn("grp", F.sum(ended.cast("long")).over(w))


def merge_cues(cues: DataFrame, group: Column) -> DataFrame:
    """One cue for each media file and group: texts in order, first start, last end, and the number of cues."""
    rows = cues.withColumn("grp", group).groupBy("media_id", "grp").agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.array_sort(F.collect_list(F.struct("cue_id", "text"))).alias("parts"), F.count("*").alias("cues")
    )
    return rows.select("media_id", "grp", "start_ms", "end_ms", F.array_join(F.transform("parts", lambda p: p["text"]), " ").alias("text"), "cues")


def join_by_segment(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = ("media_id", "cue_id")) -> DataFrame:
    """Every left row with the right row of the same segment, whose other columns get the prefix ``r_``; null where there is none."""
    named = right.select(*keys, *(F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys))
    return left.join(named, list(keys), "left")


def compare_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """For each media file the segments added, gone and changed between two runs(media_id, cue_id, text), and whether the content held."""
    b = before.select("media_id", "cue_id", F.col("text").alias("was"), F.lit(True).alias("old"))
    a = after.select("media_id", "cue_id", F.col("text").alias("now"), F.lit(True).alias("new"))
    both = b.join(a, ["media_id", "cue_id"], "full")
    out = both.groupBy("media_id").agg(
        F.count_if(F.col("old").isNull()).alias("added"), F.count_if(F.col("new").isNull()).alias("gone"), F.count_if(F.col("old") & F.col("new") & ~F.col("was").eqNullSafe(F.col("now"))).alias("changed")
    )
    return out.withColumn("same", (F.col("added") == 0) & (F.col("gone") == 0) & (F.col("changed") == 0))


def diagnostics_added(before: Column, after: Column, tracked: list[str]) -> Column:
    """The tracked diagnostics that the later array has and the earlier one hasn't, in order."""
    known = F.array(*map(F.lit, tracked))
    return F.array_intersect(F.array_except(after, before), known)


def union_candidates(reports: dict[str, DataFrame]) -> DataFrame:
    """Candidates(media_id, cue_id, start_ms, severity, type) of several reports, with the report's name and rank."""
    out = None
    for rank, (name, rows) in enumerate(reports.items()):
        part = rows.select("media_id", "cue_id", "start_ms", "severity", "type", F.lit(name).alias("report"), F.lit(rank).alias("report_rank"))
        out = part if out is None else out.unionByName(part)
    return out


def rank_candidates(candidates: DataFrame, k: int) -> DataFrame:
    """The first ``k`` candidates of each media file by severity, report, start and id; of equal cue, times, text and type only the first report's counts."""
    order = [F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity")), F.col("report_rank"), F.col("start_ms"), F.col("cue_id"), F.col("type")]
    same = [c for c in ("media_id", "cue_id", "start_ms", "end_ms", "text", "type") if c in candidates.columns]
    once = candidates.withColumn("n", F.row_number().over(Window.partitionBy(*same).orderBy("report_rank", *order))).where("n = 1").drop("n")
    return once.withColumn("rank", F.row_number().over(Window.partitionBy("media_id").orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def capped_samples(issues: DataFrame, k: int) -> DataFrame:
    """At most ``k`` issues of each type of a media file, the earliest cues, and how many of the type there are."""
    kind = Window.partitionBy("media_id", "type")
    ranked = issues.withColumn("n", F.row_number().over(kind.orderBy("cue_id")).cast("long")).withColumn("total", F.count("*").over(kind))
    return ranked.where(F.col("n") <= k)


def suspect_types(cues: DataFrame) -> DataFrame:
    """media_id, cue_id and types: the distinct suspect types of ``cues(media_id, cue_id, types, more)``, in the order in which they were found."""
    return cues.select("media_id", "cue_id", F.array_distinct(F.concat("types", "more")).alias("types"))


def review_candidates(cues: DataFrame, threshold: float = 0.75, realign_only: tuple[str, ...] = ("timing",)) -> DataFrame:
    """The rows of ``cues(media_id, cue_id, flagged, types, confidence)`` to be heard again, with the reason.

    That is: flagged ones, those of a type that isn't a matter of realignment only, and those below ``threshold``.
    """
    content = F.size(F.array_except("types", F.array(*map(F.lit, realign_only)))) > 0
    reason = F.when(F.col("flagged"), "flagged").when(content, "type").when(F.col("confidence") < threshold, "confidence")
    return cues.select("media_id", "cue_id", reason.alias("reason")).where("reason is not null")


def recovery_reasons(rows: DataFrame) -> DataFrame:
    """media_id, cue_id and the codes for which a segment of ``rows(media_id, cue_id, text, tokens, zero_tokens, coverage)`` is tried again."""
    signal = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", ""))
    codes = F.array_compact(F.array(
        F.when(signal <= 4, "short_response"), F.when(F.col("tokens") == 0, "no_tokens"), F.when(F.col("zero_tokens") > 0, "zero_duration_token"), F.when(F.col("coverage") < 0.5, "low_coverage"),
    ))
    return rows.select("media_id", "cue_id", codes.alias("reasons")).where("size(reasons) > 0")


def status_summary(rows: DataFrame, by: str, names: list[str]) -> DataFrame:
    """Rows of each ``by``, the count of each named status, and FAIL, WARN or PASS."""
    out = rows.groupBy(by).agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == n).alias(n) for n in names))
    return out.withColumn("verdict", F.when(F.col("failed") > 0, "FAIL").when(F.col(names[0]) < F.col("total"), "WARN").otherwise("PASS"))
