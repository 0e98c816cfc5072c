"""Interval algebra: islands, gaps, and joins by overlap or distance, all keyed by media_id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Width of the time bins that large media are cut into for range joins.
BIN_MS = 60_000


def overlap_ms(a_start, a_end, b_start, b_end) -> Column:
    return F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))


def iou(a_start, a_end, b_start, b_end) -> Column:
    """Overlap over hull, 0 where the hull is empty."""
    union = F.greatest(a_end, b_end) - F.least(a_start, b_start)
    return F.when(union > 0, overlap_ms(a_start, a_end, b_start, b_end) / union).otherwise(F.lit(0.0))


def range_distance(a_start, a_end, b_start, b_end) -> Column:
    """0 for overlapping or touching ranges, else the gap between them."""
    return F.greatest(F.lit(0), b_start - a_end, a_start - b_end)


def merge_regions(regions: DataFrame, gap_ms: int = 0) -> DataFrame:
    """Islands: regions of a media file that start within ``gap_ms`` of what runs before them are one."""
    order = Window.partitionBy("media_id").orderBy("start_ms", "end_ms", "region_id")
    reach = F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.when(reach.isNull() | (F.col("start_ms") > reach + gap_ms), 1).otherwise(0)
    numbered = regions.withColumn("new", new).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("media_id", "island").agg(F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count("*").alias("n_regions"))


def silences(regions: DataFrame, durations: DataFrame) -> DataFrame:
    """What the regions leave of [0, duration_ms] of every row of durations(media_id, duration_ms)."""
    order = Window.partitionBy("media_id").orderBy("start_ms", "end_ms")
    cursor = F.greatest(F.lit(0), F.coalesce(F.max("end_ms").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    between = regions.select("media_id", cursor.alias("s"), F.col("start_ms").alias("e"))
    reach = regions.groupBy("media_id").agg(F.max("end_ms").alias("reach"))
    tail = durations.join(reach, "media_id", "left").select("media_id", F.greatest(F.lit(0), F.coalesce("reach", F.lit(0))).alias("s"), F.col("duration_ms").alias("e"))
    return between.unionByName(tail).where("s < e").select("media_id", F.col("s").alias("start_ms"), F.col("e").alias("end_ms"))


def filter_short(regions: DataFrame, min_ms: int) -> DataFrame:
    return regions.where(F.col("end_ms") - F.col("start_ms") >= min_ms)


def pad(regions: DataFrame, pad_ms: int, durations: DataFrame) -> DataFrame:
    """Widens by ``pad_ms`` on both sides, inside [0, duration_ms]."""
    return regions.join(durations, "media_id").select(
        "media_id", "region_id", F.greatest(F.lit(0), F.col("start_ms") - pad_ms).alias("start_ms"), F.least(F.col("duration_ms"), F.col("end_ms") + pad_ms).alias("end_ms")
    )


def overlap_join(left: DataFrame, right: DataFrame, margin_ms: int = 0, closed: bool = False, bin_ms: int = BIN_MS) -> DataFrame:
    """Pairs of ranges of one media file that overlap, or come within ``margin_ms``; ``closed`` lets them touch.

    The columns of ``right`` other than media_id must not occur in ``left`` but for
    start_ms and end_ms, which come back as r_start and r_end. Both sides are
    cut into time bins and meet in the first bin that they share, so a long
    media file spreads over many tasks.
    """
    cut = lambda d, s, e, m: d.withColumn("_bin", F.explode(F.sequence(F.floor((F.col(s) - m) / bin_ms), F.floor((F.greatest(F.col(s), F.col(e)) + m) / bin_ms))))
    a = cut(left, "start_ms", "end_ms", margin_ms)
    r = right.withColumnsRenamed({"start_ms": "r_start", "end_ms": "r_end"})
    b = cut(r, "r_start", "r_end", 0)
    first = F.col("_bin") == F.greatest(F.floor((F.col("start_ms") - margin_ms) / bin_ms), F.floor(F.col("r_start") / bin_ms))
    if closed:
        meets = (F.col("end_ms") >= F.col("r_start") - margin_ms) & (F.col("start_ms") <= F.col("r_end") + margin_ms)
    else:
        meets = (F.col("end_ms") > F.col("r_start") - margin_ms) & (F.col("start_ms") < F.col("r_end") + margin_ms)
    return a.join(b, ["media_id", "_bin"]).where(first & meets).drop("_bin")


def point_in_interval(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Each cue with the first segment that holds its start, if any."""
    points = cues.select("media_id", "cue_id", "start_ms", F.col("start_ms").alias("end_ms"))
    inside = overlap_join(points, segments, closed=True).where("r_start <= start_ms and start_ms < r_end")
    found = inside.groupBy("media_id", "cue_id").agg(F.min_by("seg_idx", F.struct("r_start", "seg_idx")).alias("seg_idx"))
    return cues.select("media_id", "cue_id").join(found, ["media_id", "cue_id"], "left")


def best_overlap(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Each cue with the segment that it overlaps most, the first on ties."""
    met = overlap_join(cues.select("media_id", "cue_id", "start_ms", "end_ms"), segments.select("media_id", "seg_idx", "start_ms", "end_ms"))
    met = met.withColumn("overlap", overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end")))
    best = met.where("overlap > 0").groupBy("media_id", "cue_id").agg(F.max_by(F.struct("seg_idx", "overlap"), F.struct("overlap", -F.col("seg_idx"))).alias("b"))
    return best.select("media_id", "cue_id", F.col("b.seg_idx").alias("seg_idx"), F.col("b.overlap").alias("overlap"))


def nearest_interval(targets: DataFrame, cues: DataFrame, max_ms: int = 8000) -> DataFrame:
    """As-of by distance: each target with the cue nearest to it (lowest id on ties), at most ``max_ms`` away."""
    met = overlap_join(targets, cues.select("media_id", "cue_id", "start_ms", "end_ms"), max_ms, closed=True)
    met = met.withColumn("distance", range_distance(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end")))
    return met.where(F.col("distance") <= max_ms).groupBy("media_id", "target_id").agg(F.min(F.struct("distance", "cue_id")).alias("b")).select("media_id", "target_id", F.col("b.cue_id").alias("cue_id"), F.col("b.distance").alias("distance"))


def nearest_scored(targets: DataFrame, cues: DataFrame, max_ms: int = 2500) -> DataFrame:
    """Each target with the cue of the least ten times the distance plus the shift of the midpoints."""
    met = overlap_join(targets, cues.select("media_id", "cue_id", "start_ms", "end_ms"), max_ms, closed=True)
    far = range_distance(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end"))
    shift = F.abs(F.floor((F.col("start_ms") + F.col("end_ms")) / 2) - F.floor((F.col("r_start") + F.col("r_end")) / 2))
    met = met.withColumn("distance", far).withColumn("cost", far * 10 + shift)
    return met.where(F.col("distance") <= max_ms).groupBy("media_id", "target_id").agg(F.min(F.struct("cost", "cue_id")).alias("b")).select("media_id", "target_id", F.col("b.cue_id").alias("cue_id"), F.col("b.cost").alias("cost"))


def reference_for_cue(cues: DataFrame, dialogues: DataFrame, max_ms: int = 3000) -> DataFrame:
    """Each cue with the reference line of the largest overlap, then of the nearest midpoint, if they overlap or lie within ``max_ms``."""
    met = overlap_join(cues.select("media_id", "cue_id", "start_ms", "end_ms"), dialogues.select("media_id", "line_id", "start_ms", "end_ms"), max_ms, closed=True)
    met = met.withColumn("overlap", overlap_ms(F.col("start_ms"), F.col("end_ms"), F.col("r_start"), F.col("r_end")))
    shift = F.abs(F.col("start_ms") + F.col("end_ms") - F.col("r_start") - F.col("r_end"))
    best = met.groupBy("media_id", "cue_id").agg(F.max(F.struct("overlap", (-shift).alias("near"), (-F.col("line_id")).alias("back"))).alias("b"))
    return best.select("media_id", "cue_id", (-F.col("b.back")).alias("line_id"), F.col("b.overlap").alias("overlap"))


def music_filter(segments: DataFrame, music: DataFrame, keep: bool = False) -> DataFrame:
    """Segments that overlap no music region (or only those that do, with ``keep``)."""
    hit = overlap_join(segments.select("media_id", "seg_idx", "start_ms", "end_ms"), music.select("media_id", "start_ms", "end_ms")).select("media_id", "seg_idx").distinct()
    return segments.join(hit, ["media_id", "seg_idx"], "left_semi" if keep else "left_anti")


def group_gaps(cues: DataFrame, max_gap_ms: int = 500) -> DataFrame:
    """Numbers the groups that gaps of more than ``max_gap_ms`` cut a media file into."""
    order = Window.partitionBy("media_id").orderBy("start_ms", "cue_id")
    new = F.when(F.col("start_ms") - F.lag("end_ms").over(order) > max_gap_ms, 1).otherwise(0)
    return cues.withColumn("new", new).withColumn("group_id", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


def coverage(regions: DataFrame, durations: DataFrame) -> DataFrame:
    """Speech time of each media file (regions merged) and its share of the duration."""
    speech = merge_regions(regions).groupBy("media_id").agg(F.sum(F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))).alias("speech_ms"))
    out = durations.join(speech, "media_id", "left").withColumn("speech_ms", F.coalesce("speech_ms", F.lit(0)))
    return out.withColumn("share", F.when(F.col("duration_ms") > 0, F.col("speech_ms") / F.col("duration_ms")).otherwise(F.lit(0.0)))
