"""Alignment states and structure of aligned segments with nested tokens, and guards on edits."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import norm_latin
from cueloom.operators.intervals import overlap_join

#: The states of an alignment.
STATES = ["completed_exact", "completed_coarse", "failed"]


def nest_tokens(segments: DataFrame, tokens: DataFrame) -> DataFrame:
    """Segments with their tokens as an array in order, empty where there are none."""
    parts = F.array_sort(F.collect_list(F.struct("pos", "token", "start_ms", "end_ms")))
    t = tokens.groupBy("media_id", "cue_id").agg(parts.alias("tokens"))
    return segments.join(t, ["media_id", "cue_id"], "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<struct<pos:bigint,token:string,start_ms:bigint,end_ms:bigint>>")))


def alignment_state(aligned: DataFrame) -> Column:
    """The explicit state if it is a known one, else from status, unit and whether any token has a duration."""
    explicit = F.trim(F.coalesce("alignment_state", F.lit("")))
    positive = F.exists("tokens", lambda t: t["end_ms"] > t["start_ms"])
    return (
        F.when(explicit.isin(STATES), explicit)
        .when(F.coalesce("status", F.lit("completed")) != "completed", "failed")
        .when(F.coalesce("alignment_unit", F.lit("token")) != "token", "completed_coarse")
        .when(~positive, "completed_coarse")
        .otherwise("completed_exact")
    )


def state_counts(aligned: DataFrame) -> DataFrame:
    """Segments by media file and state with totals, and short failures (4 letters or digits at most)."""
    short = F.length(F.regexp_replace("text", r"[^\p{L}\p{N}]", "")) <= 4
    return aligned.withColumn("state", alignment_state(aligned)).cube("media_id", "state").agg(
        F.count("*").alias("segments"), F.count_if(short & (F.col("state") == "failed")).alias("short_failed"), F.grouping_id().cast("long").alias("level")
    )


def structural_metrics(aligned: DataFrame) -> DataFrame:
    """Bad times, tokens out of range, segments whose tokens go back, and overlaps of more than 100 ms, by media file."""
    w = Window.partitionBy("media_id").orderBy("cue_id")
    n = lambda test: F.size(F.filter("tokens", test))
    starts = F.transform("tokens", lambda t: t["start_ms"])
    a = aligned.withColumn("before", F.lag("end_ms").over(w))
    return a.groupBy("media_id").agg(
        F.count("*").alias("segments"),
        F.sum((F.col("end_ms") <= F.col("start_ms")).cast("int") + n(lambda t: t["end_ms"] <= t["start_ms"])).alias("illegal"),
        F.sum(n(lambda t: (t["start_ms"] < F.col("start_ms")) | (t["end_ms"] > F.col("end_ms")))).alias("out_of_range"),
        F.count_if(starts != F.array_sort(starts)).alias("non_monotonic"),
        F.count_if(F.col("start_ms") < F.col("before") - 100).alias("severe_overlaps"),
    )


def keep_original_timing(text: Column, start: Column, end: Column) -> Column:
    """Long cues of mixed scripts: 40 characters, 4 s, 20 Latin letters and 8 Japanese characters at least."""
    latin, japanese = F.regexp_count(text, F.lit("[A-Za-z]")), F.regexp_count(text, F.lit(r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]"))
    return (F.length(F.trim(text)) >= 40) & (end - start >= 4000) & (latin >= 20) & (japanese >= 8)


def classify_run(runs: DataFrame) -> Column:
    """Cause of a bad alignment run, the first that fits."""
    return (
        F.when(F.col("error") == "ok", "ok")
        .when(F.col("back"), "adapter_mismatch")
        .when(F.col("low_energy") >= 0.6, "window_context")
        .when((F.col("peak") >= 0.8) & (F.col("zero_run") > 0), "audio_chain")
        .when(F.col("cps") <= 1.0, "text_mismatch")
        .when((F.col("zero_run") > 0) | (F.col("local_cps") >= 35.0), "model_or_audio_collapse")
        .otherwise("unknown")
    )


def classify_short(cues: DataFrame, protected: list[str], parts: list[str], below_ms: int = 500) -> DataFrame:
    """What a cue shorter than ``below_ms`` could be merged with, from protection, structure and the gaps around it."""
    w = Window.partitionBy("media_id").orderBy("start_ms", "cue_id")
    c = cues.withColumn("key", norm_latin(F.col("text"))).withColumn("left", F.col("start_ms") - F.lag("end_ms").over(w)).withColumn("right", F.lead("start_ms").over(w) - F.col("end_ms"))
    piece = F.lit(False)
    for p in parts:
        piece = piece | F.startswith("key", F.lit(p)) | F.endswith("key", F.lit(p))
    kind = (
        F.when(F.col("key").isin(protected), "protected_short")
        .when(piece & (F.col("left") <= 8000), "fragment_merge_left")
        .when(piece & (F.col("right") <= 800), "fragment_merge_right")
        .when(piece, "fragment_alone")
        .when(F.col("right") <= 80, "merge_next")
        .when(F.col("left") <= 80, "merge_previous")
        .when(F.length("key") <= 2, "tiny")
        .otherwise("source_timing")
    )
    return c.where(F.col("end_ms") - F.col("start_ms") < below_ms).select("media_id", "cue_id", kind.alias("kind"))


def edit_verdicts(edits: DataFrame, cues: DataFrame) -> DataFrame:
    """The first rule that each of edits(media_id, edit_id, cue_id, start_ms, end_ms, text) breaks, or ok."""
    met = overlap_join(edits.select("media_id", "edit_id", F.col("cue_id").alias("own"), "start_ms", "end_ms").where("end_ms > start_ms"), cues.select("media_id", "cue_id", "start_ms", "end_ms"))
    clash = met.where("own <> cue_id").groupBy("media_id", "edit_id").agg(F.min("cue_id").alias("clash"))
    text = F.trim(F.coalesce("text", F.lit("")))
    verdict = F.when(text == "", "text_required").when(F.length(text) > 10_000, "text_too_long").when((F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")), "time_invalid").when(F.col("clash").isNotNull(), "time_overlap").otherwise("ok")
    return edits.join(clash, ["media_id", "edit_id"], "left").select("media_id", "edit_id", "cue_id", verdict.alias("verdict"), "clash")


def nearby_batches(cues: DataFrame, size: int = 4, max_gap_ms: int = 500) -> DataFrame:
    """Batches of neighbouring cues of one segment: at most ``size``, none more than ``max_gap_ms`` after the running end."""

    def fill(frames):
        group, batch, items, reach = None, 0, 0, 0
        for g in frames:
            out = []
            for media, seg, start, end in zip(g["media_id"], g["seg_idx"], g["start_ms"], g["end_ms"]):
                if media != (group or (None,))[0]:
                    batch = 0
                if (media, seg) != group or items >= size or start - reach > max_gap_ms:
                    group, batch, items, reach = (media, seg), batch + 1, 0, end
                items, reach = items + 1, max(reach, end)
                out.append(batch)
            yield g[["media_id", "cue_id", "seg_idx"]].assign(batch=out)

    rows = cues.select("media_id", "cue_id", "seg_idx", "start_ms", "end_ms").repartition("media_id").sortWithinPartitions("media_id", "seg_idx", "start_ms", "cue_id")
    return rows.mapInPandas(fill, "media_id long, cue_id long, seg_idx long, batch long")


def sentence_units(cues: DataFrame) -> DataFrame:
    """Cues cut at sentence marks, the time shared by normalised length, each unit 1 ms at least."""
    parts = F.filter(F.transform(F.regexp_extract_all("text", F.lit(r"[^.。！？!?…]+[.。！？!?…]*"), F.lit(0)), lambda p: F.trim(p)), lambda p: norm_latin(p) != "")
    c = cues.withColumn("parts", parts).withColumn("parts", F.when(F.size("parts") <= 1, F.array("text")).otherwise(F.col("parts")))
    u = c.select("media_id", "cue_id", "start_ms", "end_ms", F.size("parts").alias("n"), F.posexplode("parts").alias("i", "unit"))
    w = Window.partitionBy("media_id", "cue_id")
    weight = F.greatest(F.lit(1), F.length(norm_latin(F.col("unit"))))
    u = u.withColumn("upto", F.sum(weight).over(w.orderBy("i"))).withColumn("total", F.sum(weight).over(w))
    dur = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    cut = F.when(F.col("i") == F.col("n") - 1, F.col("end_ms")).otherwise(F.least(F.col("end_ms") - (F.col("n") - F.col("i") - 1), F.col("start_ms") + F.bround(dur * F.col("upto") / F.col("total")).cast("long")))
    u = u.withColumn("cut", cut)
    run = w.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    u = u.withColumn("end2", F.greatest(F.max(F.col("cut") - F.col("i")).over(run), F.col("start_ms") + 1) + F.col("i"))
    start = F.coalesce(F.lag("end2").over(w.orderBy("i")), F.col("start_ms"))
    return u.select("media_id", "cue_id", F.col("i").cast("long").alias("unit_no"), start.alias("start_ms"), F.col("end2").alias("end_ms"), F.regexp_replace("unit", r"[.。！？!?…]+$", "").alias("text"))


def shared_run(a: str, b: str, least: int) -> tuple[int, int, int] | None:
    """The longest common stretch (start in a, start in b, length) of two texts if it has 2 * least - 1 characters, the first in a and then in b of equal ones.

    Such a stretch holds one of the blocks of ``least`` characters that a is cut into. Where blocks recur
    so often that following them all would take long, the answer is that of ``longest_run``, which may be shorter.
    """
    blocks: dict[str, list[int]] = {}
    for i in range(0, len(a) - least + 1, least):
        blocks.setdefault(a[i : i + least], []).append(i)
    best, met, reach = (0, 0, 0), 0, {}
    for k in range(len(b) - least + 1):
        for i in blocks.get(b[k : k + least], ()):
            met += 1
            if met > 4 * (len(a) + len(b)):
                return longest_run(a, b)
            # places of one diagonal that a found stretch covers lead to the same stretch
            if reach.get(i - k, -1) <= i:
                x, n = shared_start(a, i, b, k), shared_end(a, i, b, k)
                reach[i - k] = i + n
                best = max(best, (x + n, x - i, x - k))
    return (-best[1], -best[2], best[0]) if best[0] >= 2 * least - 1 else None


def shared_end(a: str, i: int, b: str, k: int) -> int:
    """How many characters two texts share from a[i] and b[k] on: growing, then shrinking steps."""
    n, step = 0, 64
    while step:
        x = a[i + n : i + n + step]
        if len(x) == step and x == b[k + n : k + n + step]:
            n, step = n + step, step * 2
        else:
            step //= 2
    return n


def shared_start(a: str, i: int, b: str, k: int) -> int:
    """How many characters two texts share before a[i] and b[k]."""
    n, step = 0, 64
    while step:
        if n + step <= min(i, k) and a[i - n - step : i - n] == b[k - n - step : k - n]:
            n, step = n + step, step * 2
        else:
            step //= 2
    return n


def longest_run(a: str, b: str) -> tuple[int, int, int] | None:
    """The longest common stretch of any length, in memory that grows with the lengths.

    Stretches are numbered by the numbers of their halves, and only those that both texts
    have are doubled; the greatest length lies between two doublings and is found by halving.
    """
    import numpy as np

    n = len(a)
    codes = np.frombuffer((a + b).encode("utf-32-le"), np.uint32).astype(np.int64)

    def shared(at, left, right):
        """Of the places ``at`` with a pair of numbers each: those whose pair stands in both texts, and the pairs' numbers."""
        number = np.unique(left * (len(codes) + 1) + right, return_inverse=True)[1]
        in_a, in_b = (np.bincount(number[side], minlength=number.max(initial=-1) + 1) > 0 for side in (at < n, at >= n))
        keep = (in_a & in_b)[number]
        return at[keep], number[keep]

    def longer(size):
        """Stretches of ``size``, from the numbers of those of ``power`` at both of their ends."""
        end = at + size - power
        ok = (end + power <= np.where(at < n, n, len(codes))) & (number_at[np.minimum(end, len(codes) - 1)] >= 0)
        return shared(at[ok], number[ok], number_at[end[ok]])

    at, number = shared(np.arange(len(codes)), np.zeros(len(codes), np.int64), np.unique(codes, return_inverse=True)[1])
    if not len(at):
        return None
    power = 1
    while True:
        number_at = np.full(len(codes), -1, np.int64)
        number_at[at] = number
        more = longer(2 * power)
        if not len(more[0]):
            break
        (at, number), power = more, 2 * power
    low, high, best = power, 2 * power - 1, (at, number)
    while low < high:
        mid = (low + high + 1) // 2
        found = longer(mid)
        if len(found[0]):
            low, best = mid, found
        else:
            high = mid - 1
    i = best[0].min()
    k = best[0][(best[1] == best[1][best[0].argmin()]) & (best[0] >= n)].min() - n
    return int(i), int(k), low


def matched_in_order(a: str, b: str, small: int = 200_000) -> int:
    """Characters in the matching blocks that ``SequenceMatcher`` finds: the longest common stretch, then those on both sides of it.

    The same stretches are found without a comparison of all places with all; only small rests are left to ``SequenceMatcher``.
    """
    kept, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        if i == j or k == m:
            continue
        x, y = a[i:j], b[k:m]
        if x == y:
            kept += len(x)
        elif len(x) * len(y) <= small:
            kept += sum(t.size for t in SequenceMatcher(None, x, y, autojunk=False).get_matching_blocks())
        elif run := shared_run(x, y, 32) or longest_run(x, y):
            s, t, n = run
            kept += n
            todo += [(i, i + s, k, k + t), (i + s + n, j, k + t + n, m)]
    return kept


def content_retention(source: DataFrame, target: DataFrame, least: float = 0.90) -> DataFrame:
    """Share of each media file's normalised text that its later stage keeps in order.

    The text of one media file is one string; equal texts are not compared, and
    the others are compared in parallel over media files.
    """

    def joined(d: DataFrame, name: str) -> DataFrame:
        parts = F.transform(F.array_sort(F.collect_list(F.struct("cue_id", norm_latin(F.col("text")).alias("k")))), lambda x: x["k"])
        return d.groupBy("media_id").agg(F.array_join(parts, "").alias(name))

    @F.pandas_udf("long")
    def matched(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([matched_in_order(x, y) for x, y in zip(a, b)], dtype="int64")

    j = joined(source, "a").join(joined(target, "b"), "media_id", "left").withColumn("b", F.coalesce("b", F.lit("")))
    j = j.select("media_id", matched("a", "b").alias("kept"), F.length("a").alias("chars"))
    out = j.withColumn("retention", F.round(F.col("kept") / F.greatest(F.lit(1), F.col("chars")), 6))
    return out.withColumn("status", F.when((F.col("chars") > 0) & (F.col("retention") < least), "FAIL").otherwise("PASS"))
