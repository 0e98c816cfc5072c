"""Queries of rules on translations, edits, glossary candidates and suggestions, with their SQL.

The given texts are in Latin letters. Here their letters are replaced by kana and Han characters, one for one, so that
rules on these scripts decide over all words of the tables.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueloom.operators import rules as ru
from cueloom.sources import derived as d
from cueloom.sources.derived import with_tables as q

C = F.col
LETTERS, KANA, HAN = "ntaioersdlyub.,", "なだあいめえんでもうや君バ?3", "不他我人大的中是地了也吗エ?3"
ANSWERS = ["だめ", "あ", "めん", "でめ"]


def following(name):
    return F.lead(name).over(Window.partitionBy("media_id", "cue_id").orderBy("pos"))


def kana(c):
    return F.translate(c, LETTERS, KANA)


def lines(s, f):
    """Each word as a line of its own, in kana, with the next word of its cue in Han characters as translation."""
    return d.tokens(s, f).select("media_id", "cue_id", "pos", "start_ms", "end_ms", kana(C("token")).alias("text"), F.coalesce(F.translate(following("token"), LETTERS, HAN), F.lit("")).alias("translated"))


def suspects(s, f):
    return ru.translation_suspects(lines(s, f)).select("media_id", "cue_id", "pos", F.array_join("suspect_types", ",").alias("types"), "suspect_reason", "suspect_confidence", "asr_suspect", "needs_audio_review")


def terms(s, f):
    """Words and their translations as glossary entries, scored by how alike their lengths and times are."""
    t = lines(s, f).withColumn("lasts", C("end_ms") - C("start_ms")).withColumn("next", F.coalesce(following("lasts"), F.lit(0)))
    n, m = F.length("text"), F.length("translated")
    sized, timed = F.least(n, m) / F.greatest(n, m, F.lit(1)), F.least("lasts", "next") / F.greatest("lasts", "next", F.lit(1))
    group = F.when((n <= 6) & (m <= 6), "names").otherwise("fixed_phrases")
    return t.select(
        "media_id", "cue_id", "pos", ru.glossary_candidate(C("text"), C("translated"), F.size(F.split("text", "\n")), sized, timed, sized).alias("candidate"), ru.entry_allowed(C("text"), C("translated"), group).alias("allowed")
    )


def both_stages(s, f):
    b = d.regressed_cues(s, f).select("media_id", "cue_id", C("start_ms").alias("b_start"), C("end_ms").alias("b_end"), C("text").alias("b_text"))
    return d.translated_cues(s, f).join(b, ["media_id", "cue_id"], "left")


def edits(s, f):
    """The second stage as applied edits of the first: late ones weren't accepted, a cue without translation gives no evidence."""
    h = both_stages(s, f).where("b_text is not null").select(
        "media_id", "cue_id", F.concat(F.when(C("role") == "system", "manual-").otherwise("mimo-"), "role").alias("source"), kana(C("text")).alias("before"), kana(C("b_text")).alias("after"), (C("translated") != "").alias("has_evidence"), F.lit(True).alias("has_guard"),
        (C("b_start") == C("start_ms")).alias("accepted"), F.length("translated").cast("double").alias("current_score"), F.length("b_text").cast("double").alias("suggested_score"), F.lit(None).cast("string").alias("guard_reason"),
    )
    return ru.post_edit_guard(h).select("media_id", "cue_id", "issue")


def local_results(s, f):
    """The second stage as what an aligner found of each cue; words of more than 12 letters are unknown to it."""
    n = F.length("text")
    r = both_stages(s, f).select(
        "media_id", "cue_id", "start_ms", "end_ms", C("b_start").alias("word_start"), C("b_end").alias("word_end"), (F.length("b_text") / n).alias("text_score"), C("b_text").isNotNull().alias("usable"),
        F.regexp_count("b_text", F.lit("[A-Za-z]{13,}")).alias("unknown_count"), F.when(C("translated") != "", F.least(n, F.length("translated")) / F.greatest(n, F.length("translated"))).alias("previous_score"), F.least(n, F.lit(300)).cast("double").alias("capped"),
    )
    r = r.withColumn("current_score", C("capped") / 300).drop("capped")
    return ru.writeback_decision(ru.local_result_guard(r)).select("media_id", "cue_id", "time_overlaps", "time_distance_ms", F.array_join("reasons", ",").alias("reasons"), "status", F.array_join("write_reasons", ",").alias("write_reasons"), "write_status")


def answers(s, f):
    """One answer for each media file: in a fence, in free text or plain, by turns, with short or long names."""
    t = d.translated_cues(s, f)
    short = F.struct(
        C("cue_id").cast("string").alias("i"), F.when(C("role") == "user", "term_error").when(C("role") == "assistant", "translation_error").otherwise(C("role")).alias("t"), C("text").alias("o"),
        F.when(C("translated") == "", "None").otherwise(C("translated")).alias("s"), (F.length("text") > 200).alias("a"), (F.length("text") / 256).alias("c"),
    )
    arrays = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("cue_id", short.alias("x")))), lambda p: p["x"]))
    g = t.groupBy("media_id").agg(arrays.alias("j"))
    named = F.regexp_replace(F.regexp_replace("j", '"o":', '"original":'), '"s":', '"suggested_translation":')
    content = F.when(C("media_id") % 3 == 0, F.concat(F.lit("So:\n```json\n"), "j", F.lit("\n```\nDone."))).when(C("media_id") % 3 == 1, F.concat(F.lit("These are "), named, F.lit(" all."))).otherwise(C("j"))
    return ru.suggestions(g.select("media_id", content.alias("content"))).drop("translation", "suggested_original", "needs_audio_review", "reason")


def labels(s, f):
    t = lines(s, f)
    pair = F.concat_ws(" ", "text", following("text"))
    return t.select("media_id", "cue_id", "pos", ru.label_text(pair, ANSWERS).alias("label"))


def corrected(s, f):
    t = d.cues(s, f).withColumn("status", F.when(C("role") == "system", "failed").otherwise("completed"))
    return ru.correct_transcripts(t, [("thing", "matter", False)]).select("media_id", "cue_id", "text", "changed", "reason")


QUERIES = {
    "translation_suspects": suspects,
    "glossary_candidates": terms,
    "post_edit_guard": edits,
    "local_result_guard": local_results,
    "suggestion_rows": answers,
    "label_text": labels,
    "correct_transcripts": corrected,
}

TO_KANA, TO_HAN = f"translate({{0}}, '{LETTERS}', '{KANA}')", f"translate({{0}}, '{LETTERS}', '{HAN}')"
LINES = f""", line AS (SELECT media_id, cue_id, pos, start_ms, end_ms, {TO_KANA.format('token')} AS text,
  coalesce({TO_HAN.format('lead(token) OVER (PARTITION BY media_id, cue_id ORDER BY pos)')}, '') AS translated FROM token)"""
STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
SIGNS = ru.IGNORED.replace("'", "''")
UNITS = f"(length(regexp_replace({{0}}, '[^\\x{{{{3400}}}}-\\x{{{{9fff}}}}\\x{{{{3040}}}}-\\x{{{{30ff}}}}]', '', 'g')) + length(array_to_string(regexp_extract_all({{0}}, '{ru.LATIN.replace('{', '{{').replace('}', '}}')}'), '')) + length(array_to_string(regexp_extract_all({{0}}, '[0-9]+'), '')))"
WHEN = (
    "a IN ('はい', 'うん', 'ええ', 'いいえ', 'いや', 'ううん', 'だめ', 'ダメ')",
    "a IN ('あ', 'え', 'ん', 'あの', 'その', 'でも', 'じゃあ', 'けど', 'って') OR s LIKE '%…' OR s LIKE '%...'",
    f"b <> '' AND (a = b OR regexp_matches(t, '{ru.KANA}'))",
    f"t <> '' AND regexp_matches(s, '{ru.ASKS}') AND NOT regexp_matches(t, '{ru.ASKED}')",
    f"t <> '' AND regexp_matches(s, '{ru.DENIES}') AND NOT regexp_matches(t, '{ru.DENIED}')",
    "len(regexp_extract_all(s, '[0-9]+')) > 0 AND regexp_extract_all(s, '[0-9]+') <> regexp_extract_all(t, '[0-9]+')",
    f"regexp_matches(s, '{ru.NAMED}')",
    f"NOT regexp_matches(s, '{ru.NAMED}') AND (regexp_matches(s, '{ru.KATAKANA}') OR regexp_matches(s, '{ru.LATIN}'))",
    "t <> '' AND us >= 8 AND ut <= greatest(1, us // 5)",
    "end_ms - start_ms BETWEEN 1 AND 350 AND length(a) >= 5",
    f"regexp_matches(a, '{ru.LINKED}')",
)
PICK = "array_to_string(list_transform(hits, lambda i: [{0}][i]), '{1}')"

ORACLES = {
    "translation_suspects": q("token", LINES + f""", u AS (SELECT *, {STRIP.format('text')} AS s, {STRIP.format('translated')} AS t FROM line),
v AS (SELECT *, regexp_replace(s, '{SIGNS}', '', 'g') AS a, regexp_replace(t, '{SIGNS}', '', 'g') AS b, {UNITS.format('s')} AS us, {UNITS.format('t')} AS ut FROM u),
w AS (SELECT *, list_filter([{', '.join(f"CASE WHEN a <> '' AND ({c}) THEN {i} END" for i, c in enumerate(WHEN, 1))}], lambda x: x IS NOT NULL) AS hits FROM v)
SELECT media_id, cue_id, pos, {PICK.format(', '.join(f"'{n}'" for n, _, _ in ru.SUSPECT_RULES), ',')} AS types, {PICK.format(', '.join(f"'{r}'" for _, r, _ in ru.SUSPECT_RULES), '; ')} AS suspect_reason,
  coalesce(list_min(list_transform(hits, lambda i: [{', '.join(f'{p}::DOUBLE' for _, _, p in ru.SUSPECT_RULES)}][i])), 1.0::DOUBLE) AS suspect_confidence, len(hits) > 0 AS asr_suspect, len(hits) > 0 AS needs_audio_review FROM w"""),
    "glossary_candidates": q("token", LINES + f""", x AS (SELECT *, end_ms - start_ms AS lasts, length(text) AS n, length(translated) AS m FROM line),
y AS (SELECT *, coalesce(lead(lasts) OVER (PARTITION BY media_id, cue_id ORDER BY pos), 0) AS nxt FROM x),
z AS (SELECT *, least(n, m) / greatest(n, m, 1) AS sized, least(lasts, nxt) / greatest(lasts, nxt, 1) AS timed, CASE WHEN n <= 6 AND m <= 6 THEN 8 ELSE 12 END AS most FROM y)
SELECT media_id, cue_id, pos, n > 0 AND m > 0 AND n <= 18 AND m <= 18 AND NOT contains(text, chr(10)) AND NOT contains(translated, chr(10)) AND sized >= 0.7 AND timed >= 0.7
  AND NOT (regexp_matches(text, '[A-Za-z]{{2,}}') AND n < 3) AND lower(text) <> lower(translated) AND NOT regexp_matches(translated, '^[A-Za-z0-9 .!?''_-]+$') AND NOT (n <= 6 AND regexp_matches(text, '^[A-Za-z0-9 .!?''_-]+$'))
  AND NOT (n > 12 AND regexp_matches(text, '{ru.ENDS}')) AND NOT (m > 12 AND regexp_matches(translated, '{ru.ENDS}'))
  AND regexp_matches(text, '[\\x{{4e00}}-\\x{{9fff}}\\x{{3040}}-\\x{{30ff}}]|[A-Za-z]{{2,}}') AND regexp_matches(translated, '[\\x{{4e00}}-\\x{{9fff}}]|[A-Za-z]{{2,}}') AS candidate,
  n <= 20 AND m <= 20 AND n < 14 AND m < 14 AND NOT (n >= 8 AND regexp_matches(text, '{ru.SENTENCE_WORDS}')) AND NOT (m >= 8 AND regexp_matches(translated, '{ru.SENTENCE_WORDS}')) AND NOT regexp_matches(text || '|' || translated, '[。！？，,]')
  AND NOT (n >= 4 AND regexp_matches(text, '{ru.ROLE_WORDS}')) AND NOT (m >= 4 AND regexp_matches(translated, '{ru.ROLE_WORDS}')) AND m <= most AS allowed FROM z"""),
    "post_edit_guard": q("translated cue_b", f""", h AS (SELECT a.media_id, a.cue_id, a.role, a.translated, b.text AS b_text, a.start_ms <> b.start_ms AS late, {{0}} AS x, {{1}} AS y FROM translated a JOIN cue_b b ON a.media_id = b.media_id AND a.cue_id = b.cue_id)
SELECT media_id, cue_id, CASE WHEN role = 'system' THEN NULL WHEN translated = '' THEN 'missing_evidence' WHEN late THEN 'ass_guard_rejected_but_applied' WHEN length(b_text) < length(translated) THEN 'ass_score_regression'
  WHEN (x <> '' AND length(y) / greatest(length(x), 1) < 0.6) OR list_bool_or(list_transform(['はい', 'え', 'うん', 'いいえ', '駄目', 'だめ'], lambda k: contains(x, k) AND NOT contains(y, k))) THEN 'content_regression_without_ass_support' END AS issue FROM h""".format(
        *(f"regexp_replace(replace(lower({TO_KANA.format(c)}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')" for c in ("a.text", "b.text"))
    )),
    "local_result_guard": q("translated cue_b", """, r AS (SELECT a.media_id, a.cue_id, a.start_ms, a.end_ms, b.start_ms AS s, b.end_ms AS e, length(b.text) / length(a.text) AS g, b.text IS NOT NULL AS usable, len(regexp_extract_all(coalesce(b.text, ''), '[A-Za-z]{13,}')) AS unknown,
  CASE WHEN translated <> '' THEN least(length(a.text), length(translated)) / greatest(length(a.text), length(translated)) END AS p, least(length(a.text), 300) / 300 AS c FROM translated a LEFT JOIN cue_b b ON a.media_id = b.media_id AND a.cue_id = b.cue_id),
v AS (SELECT *, coalesce(least(end_ms, e) > greatest(start_ms, s) AND s IS NOT NULL, false) AS meets FROM r),
w AS (SELECT *, CASE WHEN s IS NULL THEN NULL WHEN meets THEN 0 WHEN end_ms <= s THEN s - end_ms ELSE start_ms - e END AS gap,
  list_filter([CASE WHEN NOT usable THEN 'mfa-output-unusable' END, CASE WHEN unknown > 0 THEN 'mfa-unknown-word' END, CASE WHEN coalesce(g, 0) < 0.45 THEN 'local-text-score-low' END, CASE WHEN NOT meets THEN 'mfa-time-outside-candidate-window' END], lambda x: x IS NOT NULL) AS why FROM v),
z AS (SELECT *, list_filter([CASE WHEN len(why) > 0 THEN 'local-guard-not-pass' END, CASE WHEN p IS NULL THEN 'missing-baseline-score' END, CASE WHEN g IS NULL THEN 'missing-guard-score' END], lambda x: x IS NOT NULL) AS lacks,
  list_filter([CASE WHEN g + 1e-9 < c THEN 'would-lower-current-score' END, CASE WHEN p >= 0.45 AND g < 0.45 THEN 'would-drop-below-low-threshold' END], lambda x: x IS NOT NULL) AS falls FROM w)
SELECT media_id, cue_id, meets AS time_overlaps, gap AS time_distance_ms, array_to_string(why, ',') AS reasons, CASE WHEN len(why) = 0 THEN 'PASS' ELSE 'FAIL' END AS status, array_to_string(CASE WHEN len(lacks) > 0 THEN lacks ELSE falls END, ',') AS write_reasons,
  CASE WHEN len(lacks) > 0 THEN 'SKIP' WHEN len(falls) > 0 THEN 'FAIL' ELSE 'PASS' END AS write_status FROM z"""),
    "suggestion_rows": q("translated", f"""SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY cue_id) - 1 AS pos, cue_id::VARCHAR AS id, CASE role WHEN 'user' THEN 'term_error' WHEN 'assistant' THEN 'translation_error' ELSE '' END AS error_type,
  {STRIP.format('text')} AS original, {STRIP.format('translated')} AS suggested_translation, length(text) > 200 AS asr_suspect, least(1.0::DOUBLE, length(text) / 256) AS confidence FROM translated"""),
    "label_text": q("token", LINES + r""", p AS (SELECT media_id, cue_id, pos, concat_ws(' ', text, lead(text) OVER (PARTITION BY media_id, cue_id ORDER BY pos)) AS t FROM line)
SELECT media_id, cue_id, pos, regexp_replace(trim(regexp_replace(regexp_replace(t, '[\p{P}\p{S}\p{M}\s]', ' ', 'g'), ' +', ' ', 'g')), '^(?:[\x{3040}-\x{309f}]{1,2} )+(だめ|めん|でめ|あ)$', '\1') AS label FROM p"""),
}
