"""Re-timing of cues: display timing, gap closing, bounds and clamps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class DisplayTiming:
    extend_ms: int = 350
    snap_gap_ms: int = 200
    min_blank_ms: int = 300
    min_duration_ms: int = 300

    def __post_init__(self):
        if min(self.extend_ms, self.snap_gap_ms) < 0 or self.min_duration_ms <= 0:
            raise ValueError("extend_ms and snap_gap_ms must be 0 or more, min_duration_ms more than 0")
        if self.min_blank_ms < self.snap_gap_ms:
            raise ValueError("min_blank_ms must be at least snap_gap_ms")


def normalize_timing(cues: DataFrame, timing: DisplayTiming = DisplayTiming()) -> DataFrame:
    """Display times: ends are extended, small gaps closed, small blanks kept, short cues lengthened.

    Only the next cue's start is read, so this is one ``lead``. Cues that share a
    start are one cue with the texts in order, under the last one's id.
    """
    order = Window.partitionBy("media_id").orderBy("start_ms", "cue_id")
    nxt = F.lead("start_ms").over(order)
    c = cues.withColumn("nxt", nxt).withColumn("e", F.col("end_ms") + timing.extend_ms).withColumn("gap", F.col("nxt") - F.col("e"))
    c = c.withColumn("e", F.when(F.col("gap") < timing.snap_gap_ms, F.col("nxt")).when(F.col("gap") <= timing.min_blank_ms, F.greatest("end_ms", F.col("nxt") - timing.min_blank_ms)).otherwise(F.col("e")))
    c = c.withColumn("e", F.when(F.col("e") <= F.col("start_ms"), F.col("end_ms")).otherwise(F.col("e")))
    c = c.withColumn("e", F.when(F.col("e") > F.col("nxt"), F.col("nxt")).otherwise(F.col("e")))
    least = F.col("start_ms") + timing.min_duration_ms
    c = c.withColumn("e", F.when(F.col("e") < least, F.least(least, F.coalesce("nxt", least))).otherwise(F.col("e")))
    parts = F.array_sort(F.collect_list(F.struct("cue_id", "text")))
    return c.groupBy("media_id", "start_ms").agg(F.max("cue_id").alias("cue_id"), F.max("e").alias("end_ms"), F.array_join(F.transform(parts, lambda x: x["text"]), "").alias("text")).select("media_id", "cue_id", "start_ms", "end_ms", "text")


def optimize_timing(cues: DataFrame, threshold_ms: int = 1000) -> DataFrame:
    """Neighbours closer than ``threshold_ms`` meet three quarters into their gap."""
    order = Window.partitionBy("media_id").orderBy("start_ms", "cue_id")
    meet = lambda end, start: F.floor((end + start) / 2) + F.floor((start - end) / 4)
    before, after = F.lag("end_ms").over(order), F.lead("start_ms").over(order)
    c = cues.withColumn("b", before).withColumn("a", after)
    return c.select(
        "media_id", "cue_id",
        F.when(F.col("start_ms") - F.col("b") < threshold_ms, meet(F.col("b"), F.col("start_ms"))).otherwise(F.col("start_ms")).alias("start_ms"),
        F.when(F.col("a") - F.col("end_ms") < threshold_ms, meet(F.col("end_ms"), F.col("a"))).otherwise(F.col("end_ms")).alias("end_ms"),
    )


def owned_bounds(cues: DataFrame) -> DataFrame:
    """Overlaps of neighbours cut at the midpoint; at least 1 ms is left."""
    order = Window.partitionBy("media_id").orderBy("cue_id")
    c = cues.withColumn("pe", F.lag("end_ms").over(order)).withColumn("ns", F.lead("start_ms").over(order))
    c = c.withColumn("own_start", F.when(F.col("pe") > F.col("start_ms"), F.floor((F.col("pe") + F.col("start_ms")) / 2)).otherwise(F.col("start_ms")))
    c = c.withColumn("own_end", F.when(F.col("end_ms") > F.col("ns"), F.floor((F.col("end_ms") + F.col("ns")) / 2)).otherwise(F.col("end_ms")))
    return c.select("media_id", "cue_id", "own_start", F.greatest("own_end", F.col("own_start") + 1).alias("own_end"))


def neighbour_bounds(cues: DataFrame) -> DataFrame:
    """Latest end of all earlier cues and earliest start of all later ones, cues without duration left out."""
    order = Window.partitionBy("media_id").orderBy("cue_id")
    ok = F.col("end_ms") > F.col("start_ms")
    return cues.select(
        "media_id", "cue_id",
        F.max(F.when(ok, F.col("end_ms"))).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("previous_end"),
        F.min(F.when(ok, F.col("start_ms"))).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("next_start"),
    )


def monotonic_clamp(cues: DataFrame) -> DataFrame:
    """No cue starts before the previous one ends and each lasts 1 ms at least.

    The recursion over integers is a running maximum of
    max(end, start + 1) - rank, plus rank.
    """
    order = Window.partitionBy("media_id").orderBy("cue_id")
    c = cues.withColumn("i", F.row_number().over(order)).withColumn("v", F.greatest("end_ms", F.col("start_ms") + 1) - F.col("i"))
    c = c.withColumn("end2", F.max("v").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i"))
    return c.select("media_id", "cue_id", F.greatest("start_ms", F.coalesce(F.lag("end2").over(order), F.col("start_ms"))).alias("start_ms"), F.col("end2").alias("end_ms"))


def timing_guard(candidates: DataFrame, cues: DataFrame, max_overlap_ms: int = 120, min_ms: int = 500, pad_ms: int = 120) -> DataFrame:
    """Verdict on candidates(media_id, cue_id, new_start, new_end): rejected without duration or with a severe overlap, else clamped and padded."""
    c = candidates.join(neighbour_bounds(cues), ["media_id", "cue_id"])
    back, forth = F.greatest(F.lit(0), F.coalesce(F.col("previous_end") - F.col("new_start"), F.lit(0))), F.greatest(F.lit(0), F.coalesce(F.col("new_end") - F.col("next_start"), F.lit(0)))
    reason = F.when(F.col("new_end") <= F.col("new_start"), "non-positive-duration").when((back > max_overlap_ms) | (forth > max_overlap_ms), "severe-neighbor-overlap")
    s, e = F.greatest("new_start", F.coalesce("previous_end", "new_start")), F.least("new_end", F.coalesce("next_start", "new_end"))
    c = c.withColumn("reason", reason).withColumn("s", s).withColumn("e", e)
    short = F.greatest(F.lit(0), F.lit(min_ms) - (F.col("e") - F.col("s")))
    longer = F.least(F.col("e") + F.least(short, F.lit(pad_ms)), F.coalesce("next_start", F.col("e") + pad_ms))
    return c.select("media_id", "cue_id", F.coalesce("reason", F.lit("accepted")).alias("reason"), F.when(F.col("reason").isNull(), F.col("s")).alias("start_ms"), F.when(F.col("reason").isNull(), F.greatest("e", longer)).alias("end_ms"))


def display_clamp(candidates: DataFrame, max_ms: int = 8000) -> DataFrame:
    """A candidate of more than ``max_ms`` falls back to the old window that lies inside it."""
    fall = (F.col("new_end") - F.col("new_start") > max_ms) & (F.col("old_start") >= F.col("new_start")) & (F.col("old_end") <= F.col("new_end")) & (F.col("old_end") > F.col("old_start"))
    return candidates.select("media_id", "cue_id", F.when(fall, F.col("old_start")).otherwise(F.col("new_start")).alias("start_ms"), F.when(fall, F.col("old_end")).otherwise(F.col("new_end")).alias("end_ms"), fall.alias("clamped"))
