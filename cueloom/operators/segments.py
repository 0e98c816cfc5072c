"""Audio segments: profiles, warnings, windows, batches and cuts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Upper bounds of the duration buckets in ms.
BUCKETS = [(15_000, "0-15s"), (30_000, "15-30s"), (60_000, "30-60s"), (120_000, "60-120s")]


def duration_bucket(ms: Column) -> Column:
    out = F.lit("120s+")
    for bound, label in reversed(BUCKETS):
        out = F.when(ms <= bound, label).otherwise(out)
    return out


def segment_warnings(segments: DataFrame) -> DataFrame:
    """Long shares and segments a minute of each media file, with the warnings that they give."""
    s = segments.groupBy("media_id").agg(
        F.count("*").alias("segments"), F.count_if(F.col("duration_ms") >= 100_000).alias("long"), F.count_if(F.col("duration_ms") >= 108_000).alias("near_limit"), F.sum("duration_ms").alias("total_ms")
    )
    s = s.withColumn("per_minute", F.col("segments") * 60_000 / F.greatest("total_ms", F.lit(1)))
    flags = F.array(
        F.when(F.col("long") / F.col("segments") >= 0.25, "many_long"), F.when(F.col("near_limit") / F.col("segments") >= 0.15, "many_near_limit"),
        F.when(F.col("per_minute") > 4.0, "fragmented"), F.when(F.col("per_minute") < 0.35, "sparse"),
    )
    return s.select("media_id", "segments", "long", "near_limit", F.round("per_minute", 6).alias("per_minute"), F.array_join(F.array_compact(flags), ",").alias("warnings"))


def duration_profile(segments: DataFrame) -> DataFrame:
    """Nearest-rank p50, p75 and p90, long shares, profile and batch limits of each media file."""
    w = Window.partitionBy("media_id")
    s = segments.select("media_id", F.greatest(F.lit(0), F.col("duration_ms")).alias("ms")).withColumn("i", F.row_number().over(w.orderBy("ms")) - 1).withColumn("n", F.count("*").over(w))
    at = lambda r: F.max(F.when(F.col("i") == F.bround((F.col("n") - 1) * r).cast("long"), F.col("ms")))
    p = s.groupBy("media_id").agg(
        F.count("*").alias("segments"), at(0.5).alias("p50"), at(0.75).alias("p75"), at(0.9).alias("p90"), F.avg((F.col("ms") >= 90_000).cast("int")).alias("long_share"), F.avg((F.col("ms") >= 120_000).cast("int")).alias("ultra_share")
    )
    kind = F.when((F.col("p50") >= 85_000) | (F.col("long_share") >= 0.4), "long_form").when((F.col("p75") >= 75_000) | (F.col("long_share") >= 0.2), "mixed").otherwise("short_form")
    p = p.withColumn("profile", kind)
    pick = lambda a, b, c: F.when(F.col("profile") == "long_form", a).when(F.col("profile") == "mixed", b).otherwise(c)
    p = p.withColumn("batch_size", pick(3, 4, 5)).withColumn("target_s", pick(300, 260, 220)).withColumn("threshold_s", pick(90, 95, 110))
    p = p.withColumn("threshold_s", F.when(F.col("ultra_share") >= 0.1, F.least("threshold_s", F.lit(90))).otherwise(F.col("threshold_s")))
    return p.withColumn("long_share", F.round("long_share", 6)).withColumn("ultra_share", F.round("ultra_share", 6))


def fixed_windows(segments: DataFrame, window_ms: int = 20_000) -> DataFrame:
    """Consecutive windows of each segment, the last one shorter."""
    n = F.greatest(F.lit(1), F.ceil(F.col("duration_ms") / window_ms))
    s = segments.select("media_id", "seg_idx", "start_ms", "end_ms", F.explode(F.sequence(F.lit(0), n - 1)).alias("k"))
    return s.select("media_id", "seg_idx", (F.col("k") + 1).alias("window"), (F.col("start_ms") + F.col("k") * window_ms).alias("start_ms"), F.least("end_ms", F.col("start_ms") + (F.col("k") + 1) * window_ms).alias("end_ms"))


def bucket_counts(segments: DataFrame) -> DataFrame:
    return segments.groupBy(duration_bucket(F.col("duration_ms")).alias("bucket")).agg(F.count("*").alias("segments"), F.sum("duration_ms").alias("total_ms"), F.min("duration_ms").alias("min_ms"), F.max("duration_ms").alias("max_ms"))


def plan_batches(segments: DataFrame, max_items: int = 5, target_ms: int = 220_000, threshold_ms: int = 90_000) -> DataFrame:
    """(media_id, seg_idx, bucket, batch, singleton): greedy batches of each media file and duration bucket.

    A batch takes segments in order while it has fewer than ``max_items`` and
    stays within ``target_ms``. Segments of ``threshold_ms`` or more go alone.
    The rows of a media file and bucket are read as a sorted stream, so a file
    of any length needs no more memory than a short one.
    """

    def fill(frames):
        group, batch, items, total = None, 0, 0, 0
        for g in frames:
            out, alone = [], []
            for media, bucket, ms in zip(g["media_id"], g["bucket"], g["duration_ms"]):
                if (media, bucket) != group:
                    group, batch, items = (media, bucket), 0, 0
                long = ms >= threshold_ms
                if items and (long or items >= max_items or total + ms > target_ms):
                    items = 0
                if not items:
                    batch, total = batch + 1, 0
                items, total = (max_items if long else items + 1), total + ms
                out.append(batch)
                alone.append(bool(long))
            yield g[["media_id", "seg_idx", "bucket"]].assign(batch=out, singleton=alone)

    s = segments.select("media_id", "seg_idx", "duration_ms", duration_bucket(F.col("duration_ms")).alias("bucket"))
    ordered = s.repartition("media_id", "bucket").sortWithinPartitions("media_id", "bucket", "seg_idx")
    return ordered.mapInPandas(fill, "media_id long, seg_idx long, bucket string, batch long, singleton boolean")


def batch_profile(batches: DataFrame, segments: DataFrame) -> DataFrame:
    """Batches, largest size, longest audio and singletons of each media file."""
    b = batches.join(segments.select("media_id", "seg_idx", "duration_ms"), ["media_id", "seg_idx"]).groupBy("media_id", "bucket", "batch").agg(F.count("*").alias("items"), F.sum("duration_ms").alias("ms"), F.bool_or("singleton").alias("singleton"))
    return b.groupBy("media_id").agg(F.count("*").alias("batches"), F.max("items").alias("max_items"), F.max("ms").alias("max_ms"), F.count_if("singleton").alias("singletons"))


def cut_segments(regions: DataFrame, gaps: DataFrame, max_ms: int = 15_000, min_ms: int = 2000, preferred_ms: int = 800, least_ms: int = 500, pad_ms: int = 300) -> DataFrame:
    """Cuts each media file's speech into segments of at most ``max_ms``.

    From the first region on, each cut is the midpoint of the silence nearest
    the limit (of ``preferred_ms`` or more if there is one, else of
    ``least_ms``), else the limit. Pieces shorter than ``min_ms`` join the one
    before; segments are padded at the end. The cuts depend on one another, so
    one media file is one group.
    """
    rows = regions.select("media_id", "start_ms", "end_ms", F.lit(True).alias("speech")).unionByName(gaps.select("media_id", "start_ms", "end_ms", F.lit(False).alias("speech")))

    def cut(g: pd.DataFrame) -> pd.DataFrame:
        import bisect

        speech = g[g["speech"]].sort_values(["start_ms", "end_ms"])
        quiet = g[~g["speech"]]
        found = []
        for least in (preferred_ms, least_ms):
            q = quiet[quiet["end_ms"] - quiet["start_ms"] >= least]
            found.append(sorted(((q["start_ms"] + q["end_ms"]) / 2).tolist()))
        pieces = []
        if len(speech):
            at, end = float(speech["start_ms"].iloc[0]), float(speech["end_ms"].iloc[-1])
            while at < end:
                stop = min(at + max_ms, end)
                if end - at > max_ms:
                    for mids in found:
                        i = bisect.bisect_right(mids, stop) - 1
                        if i >= 0 and mids[i] >= at + min_ms:
                            stop = mids[i]
                            break
                if pieces and stop - at < min_ms:
                    pieces[-1][1] = stop
                else:
                    pieces.append([at, stop])
                at = stop
        return pd.DataFrame(
            [(int(g["media_id"].iloc[0]), i + 1, int(max(0, a - pad_ms)), int(b + pad_ms)) for i, (a, b) in enumerate(pieces)], columns=["media_id", "seg_idx", "start_ms", "end_ms"]
        )

    return rows.groupBy("media_id").applyInPandas(cut, "media_id long, seg_idx long, start_ms long, end_ms long")
