"""Rules on single rows: suspect translations, edits after proofreading, glossary candidates, suggestions, local alignments, labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cueloom.functions.text import apply_term_table, clean_subtitle_text, norm_match
from cueloom.operators.intervals import overlap_ms, range_distance
from cueloom.operators.suspects import PLACEHOLDERS

# Characters, endings and words by which a source text and its translation are judged.
KANA, HAN = r"[\x{3040}-\x{30ff}]", r"[\x{3400}-\x{9fff}]"
LATIN, DIGITS = "[A-Za-z][A-Za-z0-9_-]{1,}", "[0-9]+"
IGNORED = "[\\s　、。，,.!?！？\"'`~\\-—…]+"
SHORT_RESPONSES = ("はい", "うん", "ええ", "いいえ", "いや", "ううん", "だめ", "ダメ")
FRAGMENTS = ("あ", "え", "ん", "あの", "その", "でも", "じゃあ", "けど", "って")
ASKS, ASKED = r"[?？]\s*$|(?:か|の)\s*[?？]?\s*$", r"[?？]|[吗呢吧么]\s*$"
DENIES, DENIED = "ない|ません|ぬ|じゃない|ではない|嫌|ダメ|だめ", "不|没|無|无|别|非|否|未"
NAMED = r"[\x{3040}-\x{30ff}\x{3400}-\x{9fff}]{2,}(?:さん|君|ちゃん|先生)"
KATAKANA = r"[\x{30a1}-\x{30ff}]{3,}"
LINKED = "^(?:でも|だから|じゃあ|それで)"
#: Suspect types, their reasons and confidences, in order.
SUSPECT_RULES = (
    ("short_response", "short response needs audio confirmation", 0.72),
    ("fragment", "source looks fragmentary", 0.68),
    ("untranslated", "translation appears to contain source-language text", 0.55),
    ("question", "source looks interrogative but translation is not marked as a question", 0.70),
    ("negation", "source contains negation that is not obvious in translation", 0.68),
    ("quantity", "numeric content differs between source and translation", 0.66),
    ("name", "source contains a name-like expression", 0.74),
    ("entity", "source contains an entity-like expression", 0.76),
    ("content_conservation", "translation may have dropped source content", 0.58),
    ("time", "source is dense for a very short timing span", 0.62),
    ("context_linkage", "source depends on adjacent context", 0.72),
)


def signal_units(text: Column) -> Column:
    """Kana, Han characters, characters of Latin words and digits of a text."""
    letters = lambda p: F.length(F.array_join(F.regexp_extract_all(text, F.lit(p), F.lit(0)), ""))
    return F.regexp_count(text, F.lit(HAN)) + F.regexp_count(text, F.lit(KANA)) + letters(LATIN) + letters(DIGITS)


def translation_suspects(cues: DataFrame) -> DataFrame:
    """``cues`` with suspect_types, suspect_reason, suspect_confidence, asr_suspect and needs_audio_review after the rules.

    ``cues(text, translated, start_ms, end_ms)`` and, if they have them, the marks that a model gave: the five columns of
    these names. Types and reasons of the rules follow the model's, each once; the confidence is the least of all (1 without any).
    Texts without letters or digits hit no rule. Null texts and marks count as empty.
    """
    given = lambda name, default: F.coalesce(F.col(name), default) if name in cues.columns else default
    trimmed = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"^\s+|\s+$", "")
    types, reason, sure = given("suspect_types", F.array().cast("array<string>")), F.trim(given("suspect_reason", F.lit(""))), given("suspect_confidence", F.lit(1.0))
    heard, review = given("asr_suspect", F.lit(False)), given("needs_audio_review", F.lit(False))
    c = cues.withColumn("_s", trimmed("text")).withColumn("_t", trimmed("translated"))
    c = c.withColumn("_a", F.regexp_replace("_s", IGNORED, "")).withColumn("_b", F.regexp_replace("_t", IGNORED, ""))
    s, t, a, b = (F.col(n) for n in ("_s", "_t", "_a", "_b"))
    numbers = lambda x: F.regexp_extract_all(x, F.lit(DIGITS), F.lit(0))
    units, lasts = signal_units(s), F.col("end_ms") - F.col("start_ms")
    named = s.rlike(NAMED)
    conditions = (
        a.isin(*SHORT_RESPONSES),
        a.isin(*FRAGMENTS) | s.endswith("…") | s.endswith("..."),
        (b != "") & ((a == b) | t.rlike(KANA)),
        s.rlike(ASKS) & (t != "") & ~t.rlike(ASKED),
        s.rlike(DENIES) & (t != "") & ~t.rlike(DENIED),
        (F.size(numbers(s)) > 0) & (numbers(s) != numbers(t)),
        named,
        ~named & (s.rlike(KATAKANA) | s.rlike(LATIN)),
        (t != "") & (units >= 8) & (signal_units(t) <= F.greatest(F.lit(1), F.floor(units / 5))),
        (lasts > 0) & (lasts <= 350) & (F.length(a) >= 5),
        a.rlike(LINKED),
    )
    hit = [F.when((a != "") & ok, F.struct(F.lit(n).alias("type"), F.lit(why).alias("reason"), F.lit(p).alias("p"))) for (n, why, p), ok in zip(SUSPECT_RULES, conditions)]
    c = c.withColumn("_hits", F.array_compact(F.array(*hit)))
    every = F.array_distinct(F.concat(types, F.transform("_hits", lambda h: h["type"])))
    reasons = F.array_distinct(F.filter(F.concat(F.array(reason), F.transform("_hits", lambda h: h["reason"])), lambda r: r != ""))
    any_hit = F.size("_hits") > 0
    c = c.withColumns({
        "suspect_types": every, "suspect_reason": F.array_join(reasons, "; "), "suspect_confidence": F.least(sure, F.array_min(F.transform("_hits", lambda h: h["p"]))),
        "asr_suspect": heard | any_hit, "needs_audio_review": review | any_hit,
    })
    return c.drop("_s", "_t", "_a", "_b", "_hits")


#: Short answers that an edit must keep, least share of characters kept, and reasons that excuse a loss.
KEPT_ANSWERS = ("はい", "え", "うん", "いいえ", "駄目", "だめ")
LEAST_KEPT, EXCUSES = 0.60, ("ass-improved", "ass-high-score")


def content_regressed(before: Column, after: Column) -> Column:
    """Whether normalised ``after`` has under 60 % of the characters of ``before`` or lost a short answer; give normalised texts."""
    shorter = (before != "") & (F.length(after) / F.greatest(F.length(before), F.lit(1)) < LEAST_KEPT)
    lost = F.lit(False)
    for answer in KEPT_ANSWERS:
        lost = lost | (before.contains(answer) & ~after.contains(answer))
    return shorter | lost


def post_edit_guard(history: DataFrame) -> DataFrame:
    """``history`` with ``issue``: why an applied edit of an original text shouldn't stand, or null.

    ``history(source, before, after, has_evidence, has_guard, accepted, current_score, suggested_score, guard_reason)``.
    Only entries whose source begins with mimo- are judged; the first reason counts. Missing scores aren't compared.
    """
    h = history.withColumn("_b", norm_match(F.coalesce("before", F.lit("")))).withColumn("_a", norm_match(F.coalesce("after", F.lit(""))))
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    issue = (
        F.when(~F.coalesce(F.startswith("source", F.lit("mimo-")), F.lit(False)), None)
        .when(~yes("has_evidence"), "missing_evidence").when(~yes("has_guard"), "missing_ass_guard").when(~yes("accepted"), "ass_guard_rejected_but_applied")
        .when(F.col("suggested_score") < F.col("current_score"), "ass_score_regression")
        .when(content_regressed(F.col("_b"), F.col("_a")) & ~F.coalesce(F.col("guard_reason").isin(*EXCUSES), F.lit(False)), "content_regression_without_ass_support")
    )
    return h.withColumn("issue", issue).drop("_b", "_a")


ENDS, ASCII_ONLY, ASCII_WORD = "[。？！…]", "^[A-Za-z0-9 .!?'_-]+$", "[A-Za-z]{2,}"
GLOSSARY_HAN = r"[\x{4e00}-\x{9fff}]"


def glossary_candidate(source: Column, target: Column, segments: Column, length_score: Column, time_score: Column, token_score: Column) -> Column:
    """Whether a matched pair may become a glossary entry: short, well placed, and of scripts that make a term."""
    return (
        (source != "") & (target != "") & (F.length(source) <= 18) & (F.length(target) <= 18) & ~source.contains("\n") & ~target.contains("\n")
        & (segments <= 2) & (length_score >= 0.55) & (time_score >= 0.7) & (token_score >= 0.7)
        & ~(source.rlike(ASCII_WORD) & (F.length(source) < 3)) & (F.lower(source) != F.lower(target)) & ~target.rlike(ASCII_ONLY)
        & ~(source.rlike(ASCII_ONLY) & (F.length(source) <= 6)) & ~(source.rlike(ENDS) & (F.length(source) > 12)) & ~(target.rlike(ENDS) & (F.length(target) > 12))
        & (source.rlike(GLOSSARY_HAN) | source.rlike(KANA) | source.rlike(ASCII_WORD)) & (target.rlike(GLOSSARY_HAN) | target.rlike(ASCII_WORD))
    )


#: Words of sentences, and of roles that depend on their context.
SENTENCE_WORDS = "我们|你们|你|我|大家|因为|所以|如果|但是|然后|的话|了|呢|吗|吧|就是|不是|真的|感觉|觉得|想|要|会"
ROLE_WORDS = "导演|老师|同学|嘉宾|主持|监督|担当|桑|さん|君|ちゃん"


def sentence_like(text: Column) -> Column:
    return (F.length(text) >= 14) | (text.rlike(SENTENCE_WORDS) & (F.length(text) >= 8)) | text.rlike("[。！？，,]")


def role_phrase(source: Column, target: Column) -> Column:
    return (target.rlike(ROLE_WORDS) & (F.length(target) >= 4)) | (source.rlike(ROLE_WORDS) & (F.length(source) >= 4))


def entry_allowed(source: Column, target: Column, group: Column) -> Column:
    """Whether an entry that a model proposed may stand: at most 20 characters, no sentence, no role, within its group's lengths."""
    fits = F.when(group == "names", (F.length(source) <= 8) & (F.length(target) <= 8)).when(group == "fixed_phrases", F.length(target) <= 12).when(group == "show_terms", F.length(target) <= 16).otherwise(True)
    return (F.length(source) <= 20) & (F.length(target) <= 20) & ~sentence_like(source) & ~sentence_like(target) & ~role_phrase(source, target) & fits


#: The long and short names of a suggestion's fields, and the error types it may have.
FIELDS = {
    "id": ("id", "i"), "error_type": ("error_type", "t"), "original": ("original", "o"), "translation": ("translation", "tr"), "suggested_translation": ("suggested_translation", "s"),
    "suggested_original": ("suggested_original", "suspected_original", "so"), "asr_suspect": ("asr_suspect", "a"), "needs_audio_review": ("needs_audio_review", "n"), "reason": ("reason", "r"), "confidence": ("confidence", "c"),
}
ERROR_TYPES = ("translation_error", "term_error", "asr_suspect", "needs_context", "style_only")
TRUE_WORDS = ("1", "true", "yes", "y", "on")


def suggestions(answers: DataFrame, column: str = "content") -> DataFrame:
    """One row for each suggestion in a model's answer: the other columns, pos, and the fields in one form.

    The array may stand in a fence or in free text; one object counts as an array of one. Answers without JSON give no rows.
    Unknown error types and placeholders become empty, a confidence that is no number 0, others are put between 0 and 1.
    """
    text = F.regexp_replace(F.trim(F.coalesce(column, F.lit(""))), r"^\s+|\s+$", "")
    fenced = F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)\s*```", 1)
    text = F.when(fenced != "", fenced).otherwise(F.trim(F.regexp_replace(text, r"(?i)^```(?:json)?\s*", "")))
    inner = F.regexp_extract(text, r"(?s)\[.*\]", 0)
    text = F.when(F.startswith(text, F.lit("[")) | (inner == "") | F.startswith(text, F.lit("{")), text).otherwise(inner)
    one = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    array = F.when(F.startswith(text, F.lit("[")), text).when(one != "", F.concat(F.lit("["), one, F.lit("]")))
    rest = [c for c in answers.columns if c != column]
    rows = answers.select(*rest, F.posexplode(F.from_json(array, "array<map<string, string>>")).alias("pos", "_m")).where("_m is not null")
    of = lambda name: F.coalesce(*(F.element_at("_m", k) for k in FIELDS[name]))
    said = lambda name: F.regexp_replace(F.coalesce(of(name), F.lit("")), r"^\s+|\s+$", "")
    held = lambda name: F.when(F.lower(said(name)).isin(*PLACEHOLDERS), "").otherwise(said(name))
    flag = lambda name: F.lower(said(name)).isin(*TRUE_WORDS)
    sure = F.coalesce(of("confidence").try_cast("double"), F.lit(0.0))
    return rows.select(
        *rest, F.col("pos").cast("long").alias("pos"), said("id").alias("id"), F.when(said("error_type").isin(*ERROR_TYPES), said("error_type")).otherwise("").alias("error_type"),
        said("original").alias("original"), said("translation").alias("translation"), held("suggested_translation").alias("suggested_translation"), held("suggested_original").alias("suggested_original"),
        flag("asr_suspect").alias("asr_suspect"), flag("needs_audio_review").alias("needs_audio_review"), said("reason").alias("reason"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(sure), 0.0).otherwise(sure))).alias("confidence"),
    )


LEAST_SCORE = 0.45


def local_result_guard(results: DataFrame) -> DataFrame:
    """``results`` with time_overlaps, time_distance_ms, reasons and status (PASS or FAIL) of a locally aligned stretch.

    ``results(start_ms, end_ms, word_start, word_end, text_score, usable, unknown_count)``: the candidate's range, the range of its
    aligned words (null without any) and how well their text fits. Nulls fail.
    """
    a = (F.col("start_ms"), F.col("end_ms"), F.col("word_start"), F.col("word_end"))
    known = F.col("start_ms").isNotNull() & F.col("end_ms").isNotNull() & F.col("word_start").isNotNull() & F.col("word_end").isNotNull()
    meets = known & (overlap_ms(*a) > 0)
    usable, unknown, score = F.coalesce("usable", F.lit(False)), F.coalesce("unknown_count", F.lit(0)), F.coalesce("text_score", F.lit(0.0))
    reasons = F.array_compact(F.array(F.when(~usable, "mfa-output-unusable"), F.when(unknown != 0, "mfa-unknown-word"), F.when(score < LEAST_SCORE, "local-text-score-low"), F.when(~meets, "mfa-time-outside-candidate-window")))
    r = results.withColumn("time_overlaps", meets).withColumn("time_distance_ms", F.when(known, range_distance(*a))).withColumn("reasons", reasons)
    return r.withColumn("status", F.when(F.size("reasons") == 0, "PASS").otherwise("FAIL"))


def writeback_decision(guarded: DataFrame) -> DataFrame:
    """``guarded`` with write_status and write_reasons: SKIP where something is missing, FAIL where a score would fall, else PASS.

    ``guarded(status, text_score, previous_score, current_score)``, as ``local_result_guard`` leaves it.
    """
    g, p, c = F.col("text_score"), F.col("previous_score"), F.col("current_score")
    missing = F.array_compact(F.array(F.when(~F.coalesce(F.col("status") == "PASS", F.lit(False)), "local-guard-not-pass"), F.when(p.isNull() | c.isNull(), "missing-baseline-score"), F.when(g.isNull(), "missing-guard-score")))
    falls = F.array_compact(F.array(F.when(g + 1e-9 < c, "would-lower-current-score"), F.when((p >= LEAST_SCORE) & (g < LEAST_SCORE), "would-drop-below-low-threshold")))
    r = guarded.withColumn("write_reasons", F.when(F.size(missing) > 0, missing).otherwise(falls))
    return r.withColumn("write_status", F.when(F.size(missing) > 0, "SKIP").when(F.size("write_reasons") > 0, "FAIL").otherwise("PASS"))


def label_text(text: Column, answers: list[str] | None = None) -> Column:
    """Text for an aligner: punctuation, symbols and marks become spaces, spaces one; hiragana of one or two letters before a known answer go.

    Give text in NFKC where it may hold other forms, as SQL has no such function.
    """
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{P}\p{S}\p{M}\s]", " "), " +", " "))
    if not answers:
        return clean
    known = "|".join(sorted(answers, key=len, reverse=True))
    return F.regexp_replace(clean, rf"^(?:[\x{{3040}}-\x{{309f}}]{{1,2}} )+({known})$", "$1")


def correct_transcripts(transcripts: DataFrame, terms: list[tuple[str, str, bool]]) -> DataFrame:
    """``transcripts(text, status)`` with completed texts cleaned and their terms replaced, and original_text, changed and reason.

    Rows of another status, and null or blank texts, stay as they are, unchanged and with the reason not-completed or empty.
    """
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    done = F.coalesce(F.col("status") == "completed", F.lit(False))
    t = transcripts.withColumn("original_text", F.col("text")).withColumn("_clean", clean_subtitle_text(F.col("text")))
    t = t.withColumn("_new", apply_term_table(F.col("_clean"), terms))
    t = t.withColumn("text", F.when(done & ~blank, F.col("_new")).otherwise(F.col("text")))
    changed = done & ~blank & (F.col("text") != F.col("original_text"))
    reason = F.when(~done, "not-completed").when(blank, "empty").when(F.col("_clean") != F.col("_new"), "terms").when(changed, "clean-up").otherwise("unchanged")
    return t.withColumn("changed", changed).withColumn("reason", reason).drop("_clean", "_new")
