"""Suspect cues: marks from quality rows, and guards for suggested texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.text import JAPANESE, japanese_signal, norm_kana, norm_match
from cueloom.operators.conservation import common_substring_len
from cueloom.operators.fuzzy import EXTRA, SHORT
from cueloom.operators.intervals import nearest_interval
from cueloom.operators.matching import ratio, text_similarity

#: Suspect types that mean a realignment only, and the one of them that must be there.
REALIGN_ONLY = ("ass_short_dialogue_timing_shifted", "ass_low_score", "ass_fail_score")
SHIFTED = "ass_short_dialogue_timing_shifted"
#: Suggestions that say nothing, and answers that aren't replaced without a reference.
PLACEHOLDERS = ("none", "null", "nil", "n/a", "na", "なし", "無し", "无", "無")
PROTECTED = ("はい", "え", "うん", "ううん", "いいえ", "駄目", "だめ", "ダメ", "はあ", "お", "おお")


def apply_suspects(cues: DataFrame, rows: DataFrame, max_ms: int = 8000) -> DataFrame:
    """``cues`` with the marks that quality rows leave on them.

    ``cues(media_id, cue_id, start_ms, end_ms, types, reason, confidence)``,
    ``rows(media_id, row_no, start_ms, end_ms, key, extra_key, types, reason)``. A row marks the cue of its key; rows whose
    key names no cue mark the nearest one in time, at most ``max_ms`` away. Another existing cue that ``extra_key`` names is marked too.
    Marks are laid on in the order of rows: types once each, reasons after one another. After each row, the
    types so far ask for another hearing (asr_suspect, needs_audio_review, a confidence of at most 0.25), unless
    a shifted short dialogue is all they say, scores aside: then for a realignment (needs_realign).
    """
    ids = cues.select("media_id", F.col("cue_id").alias("key"))
    keyed = rows.join(ids, ["media_id", "key"], "left_semi").select("media_id", "row_no", F.col("key").alias("cue_id"))
    rest = rows.join(ids, ["media_id", "key"], "left_anti")
    nearest = nearest_interval(rest.select("media_id", F.col("row_no").alias("target_id"), "start_ms", "end_ms"), cues, max_ms)
    nearest = nearest.select("media_id", F.col("target_id").alias("row_no"), "cue_id")
    first = keyed.unionByName(nearest)
    extra = rows.where("extra_key is not null").select("media_id", "row_no", F.col("extra_key").alias("key")).join(ids, ["media_id", "key"], "left_semi").withColumnRenamed("key", "cue_id")
    marks = first.unionByName(extra).distinct().join(rows.select("media_id", "row_no", F.col("types").alias("new"), F.col("reason").alias("why")), ["media_id", "row_no"])
    laid = marks.groupBy("media_id", "cue_id").agg(F.array_sort(F.collect_list(F.struct("row_no", "new", "why"))).alias("marks"))

    c = cues.withColumn("types", F.coalesce("types", F.array().cast("array<string>"))).join(laid, ["media_id", "cue_id"], "left").withColumn("marks", F.coalesce("marks", F.array().cast("array<struct<row_no: bigint, new: array<string>, why: string>>")))
    upto = F.transform(F.when(F.size("marks") > 0, F.sequence(F.lit(1), F.size("marks"))).otherwise(F.array().cast("array<int>")), lambda n: F.array_distinct(F.concat("types", F.flatten(F.transform(F.slice("marks", 1, n), lambda m: m["new"])))))
    only = F.array(*map(F.lit, REALIGN_ONLY))
    c = c.withColumn("upto", upto)
    shifted = lambda t: F.array_contains(t, SHIFTED) & (F.size(F.array_except(t, only)) == 0)
    c = c.withColumn("hear", F.exists("upto", lambda t: ~shifted(t))).withColumn("realign", F.exists("upto", shifted))
    why = F.array_join(F.filter(F.concat(F.array(F.trim(F.coalesce("reason", F.lit("")))), F.transform("marks", lambda m: m["why"])), lambda x: x != ""), "; ")
    return c.select(
        "media_id", "cue_id", "start_ms", "end_ms", F.when(F.size("upto") > 0, F.element_at("upto", -1)).otherwise(F.col("types")).alias("types"), why.alias("reason"),
        F.when(F.col("hear"), F.least(F.coalesce("confidence", F.lit(1.0)), F.lit(0.25))).otherwise(F.col("confidence")).alias("confidence"),
        F.col("hear").alias("asr_suspect"), F.col("hear").alias("needs_audio_review"), F.col("realign").alias("needs_realign"),
    )


def reference_scores(pairs: DataFrame) -> DataFrame:
    """reference, text, score of the distinct ``pairs(reference, text)``, by the rule of ``match_windows``."""

    @F.pandas_udf("double")
    def whole(a, b):
        import pandas as pd

        return pd.Series([ratio(x, y) if x and y else 0.0 for x, y in zip(a, b)])

    p = pairs.distinct().withColumn("key", norm_match(F.col("reference"))).withColumn("r_key", norm_match(F.col("text")))
    same = norm_kana(F.col("reference")) == norm_kana(F.col("text"))
    n, m = F.length("key"), F.length("r_key")
    plain = (m < F.greatest(F.lit(1), F.bround(n * 0.7))) | ((n <= SHORT) & (m > n + EXTRA))
    p = p.withColumn("same", same).withColumn("plain", plain & (n > 0) & (m > 0) & ~same)
    direct = p.where("plain").select("reference", "text", whole("key", "r_key").alias("score"))
    sought = text_similarity(p.where("not plain")).select("reference", "text", F.when((F.col("key") == "") | (F.col("r_key") == ""), 0.0).when(F.col("same"), 1.0).otherwise(F.col("similarity")).alias("score"))
    return direct.unionByName(sought)


def _safe(value: str, current: str, lost: Column) -> Column:
    """A suggestion, or nothing where it is a placeholder, changes nothing or loses the script."""
    text = F.trim(F.coalesce(value, F.lit("")))
    return F.when(F.lower(text).isin(*PLACEHOLDERS) | (text == F.col(current)) | lost, F.lit("")).otherwise(text)


def suggestion_guard(suggestions: DataFrame, apply_from: float = 0.75, least_gain: float = 0.05) -> DataFrame:
    """media_id, cue_id, field, reason, new_original, new_translation: what becomes of a suggested text.

    ``suggestions(media_id, cue_id, original, translation, new_original,
    new_translation, reference, confidence, asr_suspect, needs_audio_review)``.
    The first reason that speaks against a suggestion rejects all of it, in this order:
    against a reference, a fragment of a long line or a score that isn't better; without one, dropped content,
    a replaced or expanded short answer, any change of what is said; a translation cut to under a third.
    What is accepted is applied by confidence: the original from 0.9 on, for a suspect that needs no other hearing and has a translation too.
    Reasons are fixed values.
    """
    s = suggestions.select("*", F.trim(F.coalesce("reference", F.lit(""))).alias("ref"))
    s = s.withColumns({c: F.trim(F.coalesce(c, F.lit(""))) for c in ("original", "translation")})
    has = lambda c, chars: F.col(c).rlike(f"[{chars}]")
    cjk = r"\x{3400}-\x{9FFF}"
    s = s.withColumn("so", _safe("new_original", "original", has("original", JAPANESE) & ~F.coalesce(has("new_original", JAPANESE), F.lit(False))))
    s = s.withColumn("st", _safe("new_translation", "translation", F.coalesce(has("translation", cjk) & ~has("new_translation", cjk) & F.col("new_translation").rlike("[A-Za-z]{2,}"), F.lit(False))))
    judged = (F.col("so") != "") & (F.col("ref") != "")
    for name, text in (("now", "original"), ("then", "so")):
        scores = reference_scores(s.where(judged).select(F.col("ref").alias("reference"), F.col(text).alias("text"))).select(F.col("reference").alias("ref"), F.col("text").alias(text), F.col("score").alias(name))
        s = s.join(scores, ["ref", text], "left")
    key = {n: norm_match(F.col(c)) for n, c in (("rk", "ref"), ("ck", "original"), ("sk", "so"))}
    s = s.withColumns(key).withColumn("cs", japanese_signal(F.col("original"))).withColumn("ss", japanese_signal(F.col("so")))
    shared = common_substring_len(F.col("ck"), F.col("sk"))
    s = s.withColumn("shared", F.when(judged, shared)).withColumn("kept", F.when(~judged & (F.col("so") != ""), common_substring_len(F.col("cs"), F.col("ss"))))
    units = lambda c: F.length(F.regexp_replace(c, r"[^\x{3400}-\x{9FFF}]", ""))
    fragment = (F.length("rk") >= 12) & (F.length("ck") >= 6) & (F.col("sk") != "") & (F.col("now") >= 0.2) & (F.col("then") < 0.75) & (F.length("sk") < F.length("rk") * 0.75) & (F.col("shared") <= F.least(F.length("ck"), F.length("sk")) * 0.5)
    better = (F.col("then") >= 0.95) | ((F.col("now") >= 0.75) & (F.col("then") + 1e-9 >= F.col("now"))) | (F.col("then") + 1e-9 >= F.col("now") + least_gain)
    free = (F.col("so") != "") & (F.col("ref") == "") & (F.col("ss") != "")
    dropped = free & (F.length("cs") >= 4) & ~F.contains("ss", "cs") & (F.length("cs") - F.col("kept") >= 3)
    answer = free & (F.col("cs") != "") & (F.col("cs") != F.col("ss"))
    shorter = (F.col("st") != "") & (units("translation") >= 8) & (units("st") > 0) & (units("st") < units("translation") * 0.34)
    reason = (
        F.when(judged & fragment, "ass-long-reference-fragment-replacement").when(judged & ~better, "ass-score-not-improved").when(dropped, "original-content-dropped-without-ass-reference")
        .when(answer & F.col("cs").isin(*PROTECTED), "protected-short-response-replaced-without-ass-reference").when(answer & (F.length("cs") <= 3) & (F.length("ss") >= 12), "short-response-expanded-without-ass-reference")
        .when(answer, "no-ass-reference-original-change").when(shorter, "translation-abnormally-shortened")
    )
    s = s.withColumn("why", reason)
    sure, quiet = F.coalesce("confidence", F.lit(1.0)), ~F.coalesce("needs_audio_review", F.lit(False))
    fits = F.col("why").isNull()
    original = fits & (F.col("so") != "") & F.coalesce("asr_suspect", F.lit(False)) & quiet & (F.col("st") != "") & (sure >= max(0.9, apply_from))
    translation = fits & (F.col("st") != "") & quiet & (sure >= apply_from)
    return s.select(
        "media_id", "cue_id", F.when(~fits, F.when(F.col("why") == "translation-abnormally-shortened", "translation").otherwise("original")).alias("field"), F.coalesce("why", F.lit("accepted")).alias("reason"),
        F.when(original, F.col("so")).alias("new_original"), F.when(translation, F.col("st")).alias("new_translation"),
    )
