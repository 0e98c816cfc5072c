"""Interval and timing queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.operators import intervals as iv
from cueloom.operators import timing as tm
from cueloom.sources import derived as d
from cueloom.sources.derived import with_tables as q

DURATION_MS = 9_000_000


def durations(spark, sf_dir):
    """Every media file of the regions, a fixed 9,000 s long."""
    return d.regions(spark, sf_dir).select("media_id").distinct().withColumn("duration_ms", F.lit(DURATION_MS).cast("long"))


def targets(spark, sf_dir):
    c = d.regressed_cues(spark, sf_dir)
    return c.select("media_id", F.col("cue_id").alias("target_id"), (F.col("start_ms") + 137).alias("start_ms"), (F.col("end_ms") + 137).alias("end_ms"))


def cue_segments(spark, sf_dir):
    """Segments of the media files that cues have, 0.3 s for each second."""
    c = d.cues(spark, sf_dir)
    return c.where("cue_id % 3 = 1").select("media_id", F.col("cue_id").alias("seg_idx"), F.col("start_ms"), (F.col("end_ms") + 2000).alias("end_ms"))


def music(spark, sf_dir):
    return d.regions(spark, sf_dir).where("region_id % 97 = 0").select("media_id", "start_ms", "end_ms")


def timed_regions(spark, sf_dir):
    return d.regions(spark, sf_dir).withColumnRenamed("region_id", "seg_idx")


def guard_candidates(spark, sf_dir):
    return d.cues(spark, sf_dir).select("media_id", "cue_id", (F.col("start_ms") - 60).alias("new_start"), (F.col("end_ms") - F.col("cue_id") % 5 * 400).alias("new_end"))


QUERIES = {
    "merge_regions": lambda s, f: iv.merge_regions(d.regions(s, f)).select("media_id", "start_ms", "end_ms", "n_regions"),
    "merge_regions_gap": lambda s, f: iv.merge_regions(d.regions(s, f), 2000).select("media_id", "start_ms", "end_ms", "n_regions"),
    "silences": lambda s, f: iv.silences(d.regions(s, f), durations(s, f)),
    "short_regions_padded": lambda s, f: iv.pad(iv.filter_short(d.regions(s, f), 5000), 300, durations(s, f)),
    "overlap_join_open": lambda s, f: iv.overlap_join(targets(s, f), d.cues(s, f).select("media_id", "cue_id", "start_ms", "end_ms"), 0).select("media_id", "target_id", "cue_id"),
    "overlap_join_margin": lambda s, f: iv.overlap_join(targets(s, f), d.cues(s, f).select("media_id", "cue_id", "start_ms", "end_ms"), 1200, closed=True).select("media_id", "target_id", "cue_id"),
    "point_in_interval": lambda s, f: iv.point_in_interval(d.cues(s, f), cue_segments(s, f)),
    "best_overlap": lambda s, f: iv.best_overlap(d.cues(s, f), cue_segments(s, f)),
    "nearest_interval": lambda s, f: iv.nearest_interval(targets(s, f), d.cues(s, f)),
    "nearest_scored": lambda s, f: iv.nearest_scored(targets(s, f), d.cues(s, f)),
    "reference_for_cue": lambda s, f: iv.reference_for_cue(d.cues(s, f), d.dialogues(s, f)),
    "music_excluded": lambda s, f: iv.music_filter(timed_regions(s, f), music(s, f)).select("media_id", "seg_idx", "start_ms", "end_ms"),
    "music_only": lambda s, f: iv.music_filter(timed_regions(s, f), music(s, f), keep=True).select("media_id", "seg_idx", "start_ms", "end_ms"),
    "group_gaps": lambda s, f: iv.group_gaps(d.cues(s, f)).groupBy("media_id", "group_id").agg(F.count("*").alias("cues"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms")),
    "speech_coverage": lambda s, f: iv.coverage(d.regions(s, f), durations(s, f)).select("media_id", "speech_ms", F.round("share", 6).alias("share")),
    "normalize_timing": lambda s, f: tm.normalize_timing(d.cues(s, f)),
    "optimize_timing": lambda s, f: tm.optimize_timing(d.cues(s, f)),
    "owned_bounds": lambda s, f: tm.owned_bounds(d.cues(s, f)),
    "neighbour_bounds": lambda s, f: tm.neighbour_bounds(d.regressed_cues(s, f)),
    "monotonic_clamp": lambda s, f: tm.monotonic_clamp(d.regressed_cues(s, f)),
    "timing_guard": lambda s, f: tm.timing_guard(guard_candidates(s, f), d.cues(s, f)),
    "display_clamp": lambda s, f: tm.display_clamp(
        d.cues(s, f).select("media_id", "cue_id", (F.col("start_ms") - 500).alias("new_start"), (F.col("end_ms") + 1500).alias("new_end"), F.col("start_ms").alias("old_start"), F.col("end_ms").alias("old_end"))
    ),
}

ISLANDS = """
SELECT media_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_regions FROM (
  SELECT *, sum(new) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, region_id) AS island FROM (
    SELECT *, CASE WHEN start_ms > max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap} THEN 1 ELSE 0 END AS new FROM region))
GROUP BY media_id, island"""
TARGET = "(SELECT media_id, cue_id AS target_id, start_ms + 137 AS start_ms, end_ms + 137 AS end_ms FROM cue_b)"
CUE_SEGMENTS = "(SELECT media_id, cue_id AS seg_idx, start_ms AS s, end_ms + 2000 AS e FROM cue WHERE cue_id % 3 = 1)"
MUSIC = "SELECT media_id, region_id AS seg_idx, start_ms, end_ms FROM region r WHERE {no} EXISTS (SELECT 1 FROM region m WHERE m.media_id = r.media_id AND m.region_id % 97 = 0 AND r.end_ms > m.start_ms AND r.start_ms < m.end_ms)"
DISTANCE = "greatest(0, c.start_ms - t.end_ms, t.start_ms - c.end_ms)"

ORACLES = {
    "merge_regions": q("region", ISLANDS.format(gap=0)),
    "merge_regions_gap": q("region", ISLANDS.format(gap=2000)),
    "silences": q("region", """
SELECT media_id, s AS start_ms, e AS end_ms FROM (
  SELECT media_id, greatest(0, coalesce(max(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS s, start_ms AS e FROM region
  UNION ALL SELECT media_id, greatest(0, max(end_ms)), 9000000 FROM region GROUP BY media_id) WHERE s < e"""),
    "short_regions_padded": q("region", "SELECT media_id, region_id, greatest(0, start_ms - 300) AS start_ms, least(9000000, end_ms + 300) AS end_ms FROM region WHERE end_ms - start_ms >= 5000"),
    "overlap_join_open": q("cue_b", f"SELECT media_id, target_id, cue_id FROM {TARGET} t JOIN cue c USING (media_id) WHERE t.end_ms > c.start_ms AND t.start_ms < c.end_ms"),
    "overlap_join_margin": q("cue_b", f"SELECT media_id, target_id, cue_id FROM {TARGET} t JOIN cue c USING (media_id) WHERE t.end_ms >= c.start_ms - 1200 AND t.start_ms <= c.end_ms + 1200"),
    "point_in_interval": q("cue", f"SELECT c.media_id, cue_id, arg_min(seg_idx, (s, seg_idx)) AS seg_idx FROM cue c LEFT JOIN {CUE_SEGMENTS} g ON g.media_id = c.media_id AND s <= c.start_ms AND c.start_ms < e GROUP BY ALL"),
    "best_overlap": q("cue", f"""SELECT media_id, cue_id, seg_idx, o AS overlap FROM (
  SELECT c.media_id, cue_id, seg_idx, least(c.end_ms, e) - greatest(c.start_ms, s) AS o, row_number() OVER (PARTITION BY c.media_id, cue_id ORDER BY least(c.end_ms, e) - greatest(c.start_ms, s) DESC, seg_idx) AS n
  FROM cue c JOIN {CUE_SEGMENTS} g ON g.media_id = c.media_id AND s < c.end_ms AND c.start_ms < e) WHERE n = 1"""),
    "nearest_interval": q("cue_b", f"""SELECT media_id, target_id, cue_id, d AS distance FROM (
  SELECT media_id, target_id, cue_id, {DISTANCE} AS d, row_number() OVER (PARTITION BY media_id, target_id ORDER BY {DISTANCE}, cue_id) AS n FROM {TARGET} t JOIN cue c USING (media_id)) WHERE n = 1 AND d <= 8000"""),
    "nearest_scored": q("cue_b", f"""SELECT media_id, target_id, cue_id, k AS cost FROM (
  SELECT *, row_number() OVER (PARTITION BY media_id, target_id ORDER BY k, cue_id) AS n FROM (
    SELECT media_id, target_id, cue_id, {DISTANCE} AS d, {DISTANCE} * 10 + abs(floor((t.start_ms + t.end_ms) / 2)::BIGINT - floor((c.start_ms + c.end_ms) / 2)::BIGINT) AS k FROM {TARGET} t JOIN cue c USING (media_id)) WHERE d <= 2500) WHERE n = 1"""),
    "reference_for_cue": q("dialogue", """SELECT media_id, cue_id, line_id, o AS overlap FROM (
  SELECT *, row_number() OVER (PARTITION BY media_id, cue_id ORDER BY o DESC, far, line_id) AS n FROM (
    SELECT c.media_id, cue_id, line_id, greatest(0, least(c.end_ms, d.end_ms) - greatest(c.start_ms, d.start_ms)) AS o, abs(c.start_ms + c.end_ms - d.start_ms - d.end_ms) AS far
    FROM cue c JOIN dialogue d ON d.media_id = c.media_id AND c.end_ms >= d.start_ms - 3000 AND c.start_ms <= d.end_ms + 3000)) WHERE n = 1"""),
    "music_excluded": q("region", MUSIC.format(no="NOT")),
    "music_only": q("region", MUSIC.format(no="")),
    "group_gaps": q("cue", """SELECT media_id, g AS group_id, count(*) AS cues, min(start_ms) AS start_ms, max(end_ms) AS end_ms FROM (
  SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY start_ms, cue_id)::BIGINT AS g FROM (
    SELECT *, CASE WHEN start_ms - lag(end_ms) OVER (PARTITION BY media_id ORDER BY start_ms, cue_id) > 500 THEN 1 ELSE 0 END AS n FROM cue)) GROUP BY ALL"""),
    "speech_coverage": q("region", f"SELECT media_id, sum(end_ms - start_ms)::BIGINT AS speech_ms, round(sum(end_ms - start_ms) / 9000000, 6) AS share FROM ({ISLANDS.format(gap=0)}) GROUP BY media_id"),
    "normalize_timing": q("cue", """SELECT media_id, cue_id, start_ms, CASE WHEN e4 - start_ms < 300 THEN least(start_ms + 300, coalesce(nxt, start_ms + 300)) ELSE e4 END AS end_ms, text FROM (
  SELECT *, CASE WHEN e3 > nxt THEN nxt ELSE e3 END AS e4 FROM (
    SELECT *, CASE WHEN e2 <= start_ms THEN end_ms ELSE e2 END AS e3 FROM (
      SELECT *, CASE WHEN nxt - e1 < 200 THEN nxt WHEN nxt - e1 <= 300 THEN greatest(end_ms, nxt - 300) ELSE e1 END AS e2 FROM (
        SELECT *, end_ms + 350 AS e1, lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, cue_id) AS nxt FROM cue))))"""),
    "optimize_timing": q("cue", """SELECT media_id, cue_id,
  CASE WHEN start_ms - b < 1000 THEN floor((b + start_ms) / 2)::BIGINT + floor((start_ms - b) / 4)::BIGINT ELSE start_ms END AS start_ms,
  CASE WHEN a - end_ms < 1000 THEN floor((end_ms + a) / 2)::BIGINT + floor((a - end_ms) / 4)::BIGINT ELSE end_ms END AS end_ms
  FROM (SELECT *, lag(end_ms) OVER w AS b, lead(start_ms) OVER w AS a FROM cue WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, cue_id))"""),
    "owned_bounds": q("cue", """SELECT media_id, cue_id, s AS own_start, greatest(e, s + 1) AS own_end FROM (
  SELECT media_id, cue_id, CASE WHEN pe > start_ms THEN floor((pe + start_ms) / 2)::BIGINT ELSE start_ms END AS s, CASE WHEN end_ms > ns THEN floor((end_ms + ns) / 2)::BIGINT ELSE end_ms END AS e
  FROM (SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns FROM cue WINDOW w AS (PARTITION BY media_id ORDER BY cue_id)))"""),
    "neighbour_bounds": q("cue_b", """SELECT media_id, cue_id, max(end_ms) FILTER (end_ms > start_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_end,
  min(start_ms) FILTER (end_ms > start_ms) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start FROM cue_b WINDOW w AS (PARTITION BY media_id ORDER BY cue_id)"""),
    "monotonic_clamp": q("cue_b", """SELECT media_id, cue_id, greatest(start_ms, coalesce(lag(e) OVER (PARTITION BY media_id ORDER BY cue_id), start_ms)) AS start_ms, e AS end_ms FROM (
  SELECT *, i + max(greatest(end_ms, start_ms + 1) - i) OVER (PARTITION BY media_id ORDER BY cue_id) AS e FROM (
    SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY cue_id) AS i FROM cue_b))"""),
    "timing_guard": q("cue", """SELECT media_id, cue_id, coalesce(reason, 'accepted') AS reason, CASE WHEN reason IS NULL THEN s END AS start_ms,
  CASE WHEN reason IS NULL THEN greatest(e, least(e + least(greatest(0, 500 - (e - s)), 120), coalesce(ns, e + 120))) END AS end_ms FROM (
  SELECT *, greatest(a, coalesce(pe, a)) AS s, least(b, coalesce(ns, b)) AS e,
    CASE WHEN b <= a THEN 'non-positive-duration' WHEN coalesce(pe - a, 0) > 120 OR coalesce(b - ns, 0) > 120 THEN 'severe-neighbor-overlap' END AS reason FROM (
    SELECT media_id, cue_id, start_ms - 60 AS a, end_ms - cue_id % 5 * 400 AS b, max(end_ms) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe,
      min(start_ms) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ns FROM cue WINDOW w AS (PARTITION BY media_id ORDER BY cue_id)))"""),
    "display_clamp": q("cue", """SELECT media_id, cue_id, CASE WHEN end_ms - start_ms + 2000 > 8000 THEN start_ms ELSE start_ms - 500 END AS start_ms,
  CASE WHEN end_ms - start_ms + 2000 > 8000 THEN end_ms ELSE end_ms + 1500 END AS end_ms, end_ms - start_ms + 2000 > 8000 AS clamped FROM cue"""),
}
