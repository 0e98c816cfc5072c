"""Guards on proposed timings and edits, causes of failures, and summaries of proofreading and realignment."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import count_words, norm_filler, normalise, wrap_text
from cueloom.operators.timing import owned_bounds

SEGMENT = ["media_id", "cue_id"]

#: Languages by alias.
ALIASES = {"ja": "japanese", "jp": "japanese", "en": "english", "zh": "chinese"}
#: The ways in which segments of a language may be recovered, the usual one first.
STRATEGIES = {"japanese": ["model", "local"], "english": ["model"], "chinese": ["model"], "auto": ["model"]}


def _first(*cases: tuple[Column, str], other: str) -> Column:
    """The name of the first case that holds."""
    return F.coalesce(*(F.when(test, F.lit(name)) for test, name in cases), F.lit(other))


def _codes(*cases: tuple[Column, str]) -> Column:
    """The names of all cases that hold."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for test, name in cases)))


def coarse_guard(overlap_ms: int = 100, widest_ms: int = 6000) -> Column:
    """Whether proposed bounds of a failed segment may be taken, else the first reason against them.

    Reads new_start, new_end, start_ms, end_ms, short, previous_end and
    next_start; a missing neighbour is in nobody's way.
    """
    width, whole = F.col("new_end") - F.col("new_start"), F.col("end_ms") - F.col("start_ms")
    too_wide = F.col("short") & ((width > widest_ms) | (width >= F.round(whole * 0.8)))
    over = F.greatest(F.col("previous_end") - F.col("new_start"), F.col("new_end") - F.col("next_start"))
    return _first(
        (F.col("new_start").isNull() | F.col("new_end").isNull(), "bounds_invalid"),
        ((F.col("new_start") < F.col("start_ms")) | (F.col("new_end") > F.col("end_ms")) | (width <= 0), "out_of_range"),
        (too_wide, "short_response_too_wide"),
        (over > overlap_ms, "neighbour_overlap"),
        other="accepted",
    )


def language_route(language: Column) -> Column:
    """Struct of the language's name, its default strategy and all of its strategies; none for a language without any."""
    text = lambda d: F.create_map(*(F.lit(x) for kv in d.items() for x in kv))
    given = F.when(F.coalesce(language, F.lit("")) == "", "auto").otherwise(language)
    low = F.lower(F.trim(given))
    name = F.coalesce(F.element_at(text(ALIASES), low), low)
    ways = F.coalesce(F.element_at(F.create_map(*(x for k, v in STRATEGIES.items() for x in (F.lit(k), F.array(*map(F.lit, v))))), name), F.array().cast("array<string>"))
    known = F.size(ways) > 0
    return F.struct(F.when(known, F.initcap(name)).otherwise(language).alias("language"), F.when(known, F.get(ways, 0)).alias("default_strategy"), ways.alias("strategies"))


def clear_punctuation_only(rows: DataFrame, key: Callable[[Column], Column] = lambda c: normalise(c, "realign")) -> DataFrame:
    """Rows(needs_realign, realign_status, realign_method, history of before and after) whose latest change of the text keeps its ``key`` need no realignment any more."""
    last = F.element_at(F.filter("history", lambda h: h["before"].isNotNull() | h["after"].isNotNull()), -1)
    # element_at fails on an empty array in ANSI mode
    some = F.exists("history", lambda h: h["before"].isNotNull() | h["after"].isNotNull())
    r = rows.withColumn("last", F.when(some, last)).withColumn("was", F.coalesce("last.before", F.lit(""))).withColumn("now", F.coalesce("last.after", F.lit("")))
    clear = F.col("needs_realign") & F.col("last").isNotNull() & (key(F.col("was")) == key(F.col("now")))
    r = r.withColumn("clear", F.coalesce(clear, F.lit(False)))
    return r.select(
        *SEGMENT, (F.col("needs_realign") & ~F.col("clear")).alias("needs_realign"),
        F.when(F.col("clear"), "completed").otherwise(F.col("realign_status")).alias("realign_status"), F.when(F.col("clear"), "punctuation-only").otherwise(F.col("realign_method")).alias("realign_method"),
    )


def observed_conditions(segments: DataFrame) -> DataFrame:
    """Conditions of segments(media_id, cue_id, start_ms, end_ms, text, language, tokens, content_error) and the cause that they point to."""
    order = Window.partitionBy("media_id").orderBy("cue_id")
    zero, n = F.size(F.filter("tokens", lambda t: t["end_ms"] <= t["start_ms"])), F.size("tokens")
    covered = F.aggregate("tokens", F.lit(0).cast("long"), lambda a, t: a + F.greatest(t["end_ms"] - t["start_ms"], F.lit(0)))
    s = segments.withColumn("before", F.lag("end_ms").over(order)).withColumn("after", F.lead("start_ms").over(order))
    mixed = (F.lower("language") == "japanese") & F.col("text").rlike(r"\p{IsLatin}")
    codes = _codes(
        (F.lit(True), "transcript_correctness_unknown"), (n == 0, "no_tokens"), (zero > 0, "zero_duration_token"), ((n > 0) & (zero * 2 >= n), "dense_zero_tokens"),
        (covered < (F.col("end_ms") - F.col("start_ms")) * 0.2, "low_coverage"), (F.col("content_error"), "rewrite_rejected"), (mixed, "language_mismatch"),
        ((F.col("start_ms") < F.col("before")) | (F.col("end_ms") > F.col("after")), "neighbour_overlap"),
    )
    cause = _first((mixed, "language_route_mismatch"), (F.col("content_error"), "short_window_content_rejected"), other="coverage_below_threshold")
    return s.select(*SEGMENT, codes.alias("conditions"), cause.alias("cause"))


def classify_case(key: Callable[[Column], Column] = lambda c: normalise(c, "match")) -> Column:
    """Struct of detail, owner and confidence of a difference between the aligned and the split stage, the first that fits.

    Reads issue, target, aligned_text, split_text, aligned_score, split_score,
    mode, non_monotonic, one_ms, zero and diagnostics.
    """
    target = key(F.col("target"))
    within = lambda c: (target != "") & F.contains(key(F.col(c)), target)
    rule = F.col("mode") == "rule"
    named = lambda detail, owner, confidence: F.struct(F.lit(detail).alias("detail"), F.lit(owner).alias("owner"), F.lit(confidence).alias("confidence"))
    by_mode = lambda detail, owner, other: F.when(rule, named(detail, owner, "medium")).otherwise(named(other, "unknown", "low"))
    return (
        F.when((F.col("non_monotonic") > 0) | (F.col("one_ms") >= 3) | (F.col("zero") >= 3), named("align-token-structure", "align", "high"))
        .when((F.col("aligned_score") < 0.2) & (F.col("split_score") < 0.2), named("align-low-score-inherited", "align", "high"))
        .when((F.col("issue") == "matched-text-shortened") | (within("aligned_text") & ~within("split_text")), by_mode("rule-or-postprocess-content-loss", "postprocess", "split-mode-unknown-content-loss"))
        .when(F.col("issue").isin("became-fail", "score-drop") & (F.col("aligned_score") >= 0.45) & (F.col("split_score") < F.col("aligned_score")), by_mode("rule-boundary-error", "rule", "split-mode-unknown-boundary-error"))
        .when(F.col("issue").startswith("short-dialogue") & within("split_text"), named("evaluator-window-or-timing-shift", "evaluator", "medium"))
        .when(F.col("issue").startswith("short-dialogue"), by_mode("rule-short-dialogue-merged", "rule", "split-mode-unknown-short-dialogue-merged"))
        .when(F.arrays_overlap("diagnostics", F.array(F.lit("introduced-duplicate"), F.lit("duplicate-nearby"))), named("postprocess-duplicate-boundary", "postprocess", "medium"))
        .otherwise(named("manual-review-required", "unknown", "low"))
    )


def episode_summary(matches: DataFrame, warnings: DataFrame) -> DataFrame:
    """Matches of each media file by level, with the warnings of its segments."""
    counts = matches.groupBy("media_id").agg(F.count("*").alias("matches"), *(F.count_if(F.col("level") == n).alias(n) for n in ("high", "medium", "low")))
    return counts.join(warnings.select("media_id", "warnings"), "media_id", "left").withColumn("warnings", F.coalesce("warnings", F.lit("")))


def proofread_summary(items: DataFrame, cues: DataFrame) -> DataFrame:
    """What became of the proofread items(media_id, item_id, status, target_ids, applied, rejected, suggestions, content, elapsed_ms).

    An item without targets reviews the cue of its own id.
    """
    done = F.col("status") == "completed"
    targets = F.when(F.size("target_ids") > 0, F.col("target_ids")).otherwise(F.array("item_id"))
    reviewed = items.where(done).select("media_id", F.explode(targets).alias("cue_id")).groupBy("media_id").agg(F.count_distinct("cue_id").alias("reviewed"))
    silent = done & (F.col("suggestions") == 0) & (F.trim("content") != "")
    out = items.groupBy("media_id").agg(
        F.count_if(done).alias("completed"), F.count_if(F.col("status") == "failed").alias("failed"), F.sum(F.when(done, F.col("applied")).otherwise(0)).alias("applied"),
        F.sum(F.when(done, F.col("rejected")).otherwise(0)).alias("rejected"), F.count_if((F.col("status") == "failed") | silent).alias("unresolved"), F.sum("elapsed_ms").alias("elapsed_ms"),
    )
    length = cues.groupBy("media_id").agg(F.sum(F.col("end_ms") - F.col("start_ms")).alias("ms"))
    out = out.join(reviewed, "media_id", "left").join(length, "media_id", "left").withColumn("reviewed", F.coalesce("reviewed", F.lit(0)))
    return out.select(
        "media_id", "completed", "failed", "reviewed", "applied", "rejected", "unresolved",
        F.when(F.col("ms") > 0, F.col("reviewed") * 60000.0 / F.col("ms")).otherwise(0.0).alias("per_minute"), F.when(F.col("reviewed") > 0, F.col("elapsed_ms") * 1.0 / F.col("reviewed")).otherwise(0.0).alias("ms_each"),
    )


def realign_summary(rows: DataFrame) -> DataFrame:
    """Counts of rows(media_id, cue_id, status, method, local_status, needs_realign) by outcome, the pending and failed ids in order, and the status that follows.

    Pending is what still needs a realignment that isn't completed.
    """
    count = lambda c, v: F.count_if(F.col(c) == v)
    ids = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("cue_id"))))
    out = rows.groupBy("media_id").agg(
        count("status", "completed").alias("completed"), count("status", "fallback").alias("fallback"), count("status", "failed").alias("failed"),
        count("local_status", "unusable").alias("unusable"), count("local_status", "rejected").alias("rejected"), ids(F.col("status") == "failed").alias("failed_ids"),
        ids(F.coalesce("needs_realign", F.lit(False)) & (F.coalesce("status", F.lit("")) != "completed")).alias("pending_ids"),
    )
    return out.withColumn("verdict", F.when((F.col("failed") > 0) | (F.size("pending_ids") > 0), "FAIL").when(F.col("fallback") + F.col("unusable") + F.col("rejected") > 0, "WARN").otherwise("PASS"))


def proofread_coverage(wanted: DataFrame, items: DataFrame) -> DataFrame:
    """Of each media file the cues to be reviewed, what the proofread items did of them, and the status.

    FAIL: fewer cues among the items than are wanted, an item that failed, or fewer cues reviewed than
    there are among the items. WARN: completed items without suggestions though they say something, or edits applied without evidence.
    """
    targets = F.when(F.size("target_ids") > 0, F.col("target_ids")).otherwise(F.array("item_id"))
    asked = items.select("media_id", F.explode(targets).alias("cue_id"), (F.col("status") == "completed").alias("seen")).groupBy(*SEGMENT).agg(F.bool_or("seen").alias("seen"))
    rows = wanted.select(*SEGMENT).distinct().withColumn("wanted", F.lit(1)).join(asked.withColumn("asked", F.lit(1)), SEGMENT, "full").groupBy("media_id").agg(
        F.count("wanted").alias("wanted"), F.count_if(F.col("wanted").isNotNull() & F.col("seen")).alias("reviewed"), F.count("asked").alias("candidates"), F.count_if("seen").alias("completed"))
    done = F.col("status") == "completed"
    each = items.groupBy("media_id").agg(
        F.count_if(F.col("status") == "failed").alias("failed"), F.count_if(done & (F.col("suggestions") == 0) & (F.trim("content") != "")).alias("unresolved"), F.count_if(done & (F.col("applied") > 0) & (F.trim("content") == "")).alias("unproved"))
    out = rows.join(each, "media_id", "left").na.fill(0, ["failed", "unresolved", "unproved"])
    bad = ((F.col("wanted") > 0) & (F.col("candidates") < F.col("wanted"))) | (F.col("failed") > 0) | (F.col("completed") < F.col("candidates"))
    status = F.when(bad, "FAIL").when(F.col("unresolved") + F.col("unproved") > 0, "WARN").otherwise("PASS")
    return out.select("media_id", "wanted", "reviewed", (F.col("wanted") - F.col("reviewed")).alias("left"), "candidates", "completed", "failed", "unresolved", "unproved", status.alias("status"))


def align_cues_to_segments(cues: DataFrame, segments: DataFrame) -> DataFrame:
    """Segments rebuilt from cues: a cue goes to the first segment whose owned range ends after its midpoint, the rest to the last, and none before an earlier cue's.

    Files without segments become one. Segments without cues are left out.
    """
    own = owned_bounds(segments.withColumnRenamed("seg_idx", "cue_id")).withColumnRenamed("cue_id", "seg_idx")
    in_media = Window.partitionBy("media_id")
    own = own.withColumn("at", F.row_number().over(in_media.orderBy("seg_idx"))).withColumn("of", F.count("*").over(in_media))
    ends = own.where("at < of").select("media_id", F.col("own_end").alias("ms"), F.lit(None).cast("long").alias("cue_id"))
    mids = cues.select("media_id", F.floor((F.col("start_ms") + F.col("end_ms")) / 2).alias("ms"), "cue_id", "start_ms", "end_ms", "text")
    upto = in_media.orderBy("ms", F.col("cue_id").isNotNull()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    passed = ends.unionByName(mids, allowMissingColumns=True).withColumn("passed", F.count_if(F.col("cue_id").isNull()).over(upto)).where("cue_id is not null")
    placed = passed.withColumn("at", F.max("passed").over(in_media.orderBy("cue_id")) + 1)
    parts = F.array_sort(F.collect_list(F.struct("cue_id", "text")))
    built = placed.groupBy("media_id", "at").agg(F.min("start_ms").alias("first"), F.max("end_ms").alias("last"), F.count("*").alias("cues"), F.transform(parts, lambda p: p["text"]).alias("texts"))
    return built.join(own, ["media_id", "at"], "left").select(
        "media_id", F.coalesce("seg_idx", F.lit(1)).alias("seg_idx"), F.coalesce("own_start", "first").alias("start_ms"), F.coalesce("own_end", "last").alias("end_ms"), "cues", F.array_join("texts", " ").alias("text")
    )


def rank_for_diagnosis(segments: DataFrame, low_cps: float = 1.0) -> DataFrame:
    """Rank of each of segments(media_id, cue_id, start_ms, end_ms, text, status, n_tokens) in its file: failed ones first (100), then slow ones (10), the shortest first."""
    ms = F.greatest(F.col("end_ms") - F.col("start_ms"), F.lit(0))
    failed = (F.col("status") != "completed") | (F.col("n_tokens") == 0)
    slow = F.length("text") * 1000 <= ms * low_cps
    s = segments.withColumn("score", F.when(failed, 100).otherwise(0) + F.when(slow | (ms == 0), 10).otherwise(0)).withColumn("ms", ms)
    return s.select(*SEGMENT, "score", F.row_number().over(Window.partitionBy("media_id").orderBy(F.desc("score"), "ms", "cue_id")).cast("long").alias("rank"))


def standalone_responses(rows: DataFrame, order: Sequence[str], protected: Sequence[str], sensitive: Sequence[str], key: Callable[[Column], Column] = lambda c: normalise(c, "match"), gap_ms: int = 500) -> DataFrame:
    """Rows that are protected answers of 120 to 1,800 ms.

    Sensitive ones must be ``gap_ms`` away from the row before, and from the
    next one too unless a mark ends them.
    """
    w = Window.partitionBy("media_id").orderBy(*order)
    r = rows.withColumn("before", F.lag("end_ms").over(w)).withColumn("after", F.lead("start_ms").over(w)).withColumn("key", key(F.col("text")))
    left = F.col("before").isNull() | (F.col("start_ms") - F.col("before") >= gap_ms)
    right = F.col("after").isNull() | (F.col("after") - F.col("end_ms") >= gap_ms) | F.col("text").rlike("[。！？!?]")
    return r.where(F.col("key").isin(*protected) & (F.col("end_ms") - F.col("start_ms")).between(120, 1800) & (~F.col("key").isin(*sensitive) | (left & right))).drop("before", "after")


def short_text_kind(text: Column, fillers: Sequence[str], responses: Sequence[str], units: Sequence[str]) -> Column:
    """response, filler (nothing but fillers, taken longest first, and six words at most), numeric (digits or a unit), or other."""
    t = norm_filler(text)
    rest = F.regexp_replace(t, "|".join(sorted(fillers, key=lambda x: (-len(x), x))), "")
    return _first((t.isin(*responses), "response"), ((t != "") & (rest == "") & (count_words(t) <= 6), "filler"), (t.rlike("^[0-9]+$") | t.isin(*units), "numeric"), other="other")


def low_energy(frames: DataFrame, low: float, silent: float, clipped: float, frame_ms: int = 100) -> DataFrame:
    """Low, silent and clipped shares of frames(media_id, frame, rms), and the leading, trailing and longest low stretches in milliseconds."""
    f = frames.withColumn("low", F.col("rms") < low).withColumn("run", F.count_if(~F.col("low")).over(Window.partitionBy("media_id").orderBy("frame")))
    runs = f.groupBy("media_id", "run").agg(F.count_if("low").alias("n"), F.count("*").alias("all"), F.count_if(F.col("rms") < silent).alias("silent"), F.count_if(F.col("rms") >= clipped).alias("clipped"))
    total = F.sum("all")
    return runs.groupBy("media_id").agg(
        total.alias("frames"), (F.sum("n") / total).alias("low_ratio"), (F.sum("silent") / total).alias("silence_ratio"), (F.sum("clipped") / total).alias("clipping_ratio"),
        (F.max("n") * frame_ms).alias("longest_ms"), (F.coalesce(F.max(F.when(F.col("run") == 0, F.col("n"))), F.lit(0)) * frame_ms).alias("leading_ms"), (F.max_by("n", "run") * frame_ms).alias("trailing_ms"),
    )


def sample_cases(issues: DataFrame, n: int, whole: Sequence[str] = ("became_fail",), ranked: Sequence[str] = ("score_drop", "text_shortened")) -> DataFrame:
    """Every issue of the ``whole`` types and of each ``ranked`` type the ``n`` largest drops; a cue counts once a type."""
    once = issues.groupBy(*SEGMENT, "type").agg(F.max("fell").alias("fell"))
    out = once.where(F.col("type").isin(*whole))
    for kind in ranked:
        out = out.unionByName(once.where(F.col("type") == kind).orderBy(F.desc("fell"), *SEGMENT).limit(n))
    return out


def translation_payload(text: Column) -> Column:
    """Struct of translation, suspect and confidence: an old payload is the plain translation (not suspect, confidence 1), a new one an object with these fields."""
    inner = F.from_json(text, "translation string, suspect boolean, confidence double")
    new = F.coalesce(F.trim(text).startswith("{") & inner["translation"].isNotNull(), F.lit(False))
    return F.struct(
        F.when(new, inner["translation"]).otherwise(F.coalesce(text, F.lit(""))).alias("translation"), F.coalesce(F.when(new, inner["suspect"]), F.lit(False)).alias("suspect"),
        F.when(new, F.least(F.greatest(F.coalesce(inner["confidence"], F.lit(1.0)), F.lit(0.0)), F.lit(1.0))).otherwise(1.0).alias("confidence"),
    )


def coarse_cues(transcripts: DataFrame, shortest_ms: int = 1000, longest_ms: int = 6000) -> DataFrame:
    """One cue for each completed transcript(media_id, cue_id, start_ms, end_ms, text, status) with a text: no shorter or longer than the limits, and wrapped."""
    end = F.least(F.col("start_ms") + longest_ms, F.greatest(F.col("start_ms") + shortest_ms, F.col("end_ms")))
    return transcripts.where("status = 'completed' and trim(text) <> ''").select(*SEGMENT, "start_ms", end.alias("end_ms"), wrap_text(F.col("text")).alias("text"))


def exact_recovery_guard(results: DataFrame, key: Callable[[Column], Column] = lambda c: normalise(c, "strict")) -> DataFrame:
    """Whether results(media_id, cue_id, start_ms, end_ms, text, tokens, timing, failed) may be taken as exact, else the first reason against it.

    ``timing`` is the timing error of the tokens or ``ok``. The range of the tokens must not reach into
    the neighbouring segments, unless their own alignment ``failed``.
    """
    order = Window.partitionBy("media_id").orderBy("cue_id")
    starts = F.transform("tokens", lambda t: t["start_ms"])
    counts = ~F.coalesce("failed", F.lit(False))
    r = results.withColumn("before", F.lag(F.when(counts, F.col("end_ms"))).over(order)).withColumn("after", F.lead(F.when(counts, F.col("start_ms"))).over(order))
    r = r.withColumn("joined", key(F.array_join(F.transform("tokens", lambda t: t["token"]), " "))).withColumn("wanted", key(F.col("text")))
    first, last = F.array_min(starts), F.array_max(F.transform("tokens", lambda t: t["end_ms"]))
    verdict = _first(
        (F.size("tokens") == 0, "no_tokens"), (F.exists("tokens", lambda t: t["end_ms"] <= t["start_ms"]), "not_positive"), (starts != F.array_sort(starts), "not_monotonic"),
        (F.exists("tokens", lambda t: (t["start_ms"] < F.col("start_ms")) | (t["end_ms"] > F.col("end_ms"))), "outside"), (F.col("timing") != "ok", "timing"),
        (F.col("joined") != F.col("wanted"), "text_differs"), ((first < F.col("before")) | (last > F.col("after")), "neighbour_overlap"),
        other="accepted",
    )
    return r.select(*SEGMENT, verdict.alias("verdict"))
