"""Queries of guards, causes and summaries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueloom.operators import alignment as al
from cueloom.operators import guards as gd
from cueloom.operators import segments as sg
from cueloom.operators import tokens as tk
from cueloom.plans import stage_queries as sq
from cueloom.plans import text_queries as tq
from cueloom.sources import derived as d
from cueloom.sources.derived import with_tables as q

C = F.col


def num():
    return C("media_id") + C("cue_id")


def coarse(s, f):
    w = Window.partitionBy("media_id").orderBy("cue_id")
    rows = d.cues(s, f).withColumn("previous_end", F.lag("end_ms").over(w)).withColumn("next_start", F.lead("start_ms").over(w))
    rows = rows.withColumn("new_start", F.when(num() % 23 != 0, C("start_ms") - 5 + (C("media_id") * 7 + C("cue_id") * 3) % 40)).withColumn("new_end", C("end_ms") + 5 - (C("media_id") * 11 + C("cue_id") * 5) % 900)
    return rows.withColumn("short", F.length("text") % 3 == 0).select("media_id", "cue_id", gd.coarse_guard().alias("verdict"))


def routes(s, f):
    lang = F.when(C("doc_id") % 5 == 0, " JP ").when(C("doc_id") % 5 == 1, "").otherwise(C("lang"))
    r = d.read(s, f, "documents").select("doc_id", gd.language_route(lang).alias("r"))
    return r.select("doc_id", "r.language", "r.default_strategy", F.array_join("r.strategies", ",").alias("strategies"))


def edited(s, f):
    change = lambda b, a: F.struct(b.cast("string").alias("before"), a.cast("string").alias("after"))
    after = F.when(C("cue_id") % 3 == 0, F.concat("text", F.lit("!?"))).when(C("cue_id") % 3 == 1, F.upper("text")).otherwise(F.concat("text", F.lit(" more")))
    history = F.when(C("cue_id") % 7 == 6, F.array(change(F.lit(None), F.lit(None)))).otherwise(F.array(change(C("text"), F.concat("text", F.lit(" x"))), change(C("text"), after), change(F.lit(None), F.lit(None))))
    return d.cues(s, f).select("media_id", "cue_id", (num() % 4 != 0).alias("needs_realign"), F.lit("pending").alias("realign_status"), F.lit(None).cast("string").alias("realign_method"), history.alias("history"))


def conditions(s, f):
    a = al.nest_tokens(d.cues(s, f), d.tokens(s, f).where("cue_id % 6 <> 0 and (cue_id % 5 <> 0 or pos % 7 = 6)"))
    a = a.withColumn("language", F.when(C("role") == "user", "Japanese").otherwise("English")).withColumn("content_error", num() % 10 == 0)
    return gd.observed_conditions(a).select("media_id", "cue_id", F.array_join("conditions", ",").alias("conditions"), "cause")


def cases(s, f):
    zero = d.tokens(s, f).groupBy("media_id", "cue_id").agg(F.count_if(C("end_ms") <= C("start_ms")).alias("zero"))
    b = d.regressed_cues(s, f).select("media_id", "cue_id", C("text").alias("split_text"))
    j = d.cues(s, f).join(b, ["media_id", "cue_id"]).join(zero, ["media_id", "cue_id"])
    names = F.array(*map(F.lit, ("score-drop", "matched-text-shortened", "short-dialogue-missing", "became-fail", "other")))
    j = j.select(
        "media_id", "cue_id", C("text").alias("target"), C("text").alias("aligned_text"), "split_text", F.get(names, (num() % 5).cast("int")).alias("issue"), F.when(C("media_id") % 2 == 0, "rule").otherwise("unknown").alias("mode"),
        (C("zero") * (C("cue_id") % 4 == 1).cast("int")).alias("zero"), F.lit(0).alias("non_monotonic"), (num() % 4).alias("one_ms"),
        ((C("media_id") * 31 + C("cue_id") * 17) % 100).alias("as100"), ((C("media_id") * 13 + C("cue_id") * 29) % 100).alias("bs100"), F.when(num() % 3 == 0, F.array(F.lit("duplicate-nearby"))).otherwise(F.array().cast("array<string>")).alias("diagnostics"),
    ).withColumn("aligned_score", C("as100") / 100).withColumn("split_score", C("bs100") / 100)
    return j.select("media_id", "cue_id", gd.classify_case().alias("c")).select("media_id", "cue_id", "c.detail", "c.owner", "c.confidence")


def items(s, f):
    targets = F.when(num() % 3 != 0, F.array(C("cue_id"), C("cue_id") + 1)).otherwise(F.array().cast("array<bigint>"))
    return d.cues(s, f).select(
        "media_id", C("cue_id").alias("item_id"), F.when(num() % 10 == 0, "failed").otherwise("completed").alias("status"), targets.alias("target_ids"), (num() % 2).alias("applied"), F.when(num() % 4 == 3, 1).otherwise(0).alias("rejected"),
        (num() % 3).alias("suggestions"), F.when(num() % 7 == 0, " ").otherwise(C("text")).alias("content"), (num() * 1000).alias("elapsed_ms"),
    )


def realigned(s, f):
    status = F.when(num() % 8 == 0, "failed").when(num() % 5 == 0, "fallback").otherwise("completed")
    local = F.when(num() % 7 == 0, "unusable").when(num() % 7 == 3, "rejected").otherwise("usable")
    return d.cues(s, f).select("media_id", "cue_id", status.alias("status"), F.lit("local").alias("method"), local.alias("local_status"), (C("end_ms") - C("start_ms") > 5000).alias("needs_realign"))


def short_segments(s, f):
    return d.segments(s, f).select("media_id", "seg_idx", F.floor(C("start_ms") / 20).alias("start_ms"), F.floor(C("end_ms") / 20).alias("end_ms"))


def to_diagnose(s, f):
    n = d.tokens(s, f).where("(media_id + cue_id) % 11 <> 0").groupBy("media_id", "cue_id").agg(F.count("*").alias("n_tokens"))
    rows = d.cues(s, f).withColumn("end_ms", C("end_ms") + num() % 3 * 400_000).withColumn("status", F.when(num() % 8 == 0, "failed").otherwise("completed"))
    return gd.rank_for_diagnosis(rows.join(n, ["media_id", "cue_id"], "left").fillna(0, ["n_tokens"]))


def responses(s, f):
    rows = d.tokens(s, f).withColumn("text", C("token"))
    return gd.standalone_responses(rows, ["cue_id", "pos"], ["the", "and", "of", "is"], ["and", "is"]).select("media_id", "cue_id", "pos", "key", "start_ms", "end_ms")


def kinds(s, f):
    text = F.when(C("pos") % 9 == 4, C("cue_id").cast("string")).otherwise(C("token"))
    return d.tokens(s, f).select("media_id", "cue_id", "pos", gd.short_text_kind(text, ["th", "the", "er", "an", "on"], ["and", "the"], ["of"]).alias("kind"))


def frames(s, f):
    return d.read(s, f, "events").select(C("user_id").alias("media_id"), C("event_id").alias("frame"), C("value").alias("rms"))


def payloads(s, f):
    new = F.to_json(F.struct(C("text").alias("translation"), (num() % 2 == 0).alias("suspect"), F.when(num() % 5 != 0, (num() % 150) / 100).alias("confidence")))
    return d.cues(s, f).select("media_id", "cue_id", gd.translation_payload(F.when(num() % 3 == 0, new).otherwise(C("text"))).alias("p")).select("media_id", "cue_id", "p.translation", "p.suspect", "p.confidence")


def completed(s, f):
    return d.cues(s, f).withColumn("status", F.when(num() % 9 == 0, "failed").otherwise("completed"))


def exact(s, f):
    t = d.tokens(s, f).where("cue_id % 6 <> 0 and (cue_id % 2 = 1 or end_ms > start_ms)").withColumn("end_ms", F.when(C("cue_id") % 5 == 0, F.greatest("end_ms", C("start_ms") + 1)).otherwise(C("end_ms")))
    errors = tk.token_timing_error(d.tokens(s, f), tq.cue_bounds(s, f)).select("media_id", "cue_id", C("error").alias("timing"))
    rows = al.nest_tokens(d.cues(s, f), t).join(errors, ["media_id", "cue_id"])
    return gd.exact_recovery_guard(rows.withColumn("failed", ~F.exists("tokens", lambda x: x["end_ms"] > x["start_ms"])))


QUERIES = {
    "coarse_guard": coarse,
    "language_route": routes,
    "clear_punctuation_only": lambda s, f: gd.clear_punctuation_only(edited(s, f)),
    "observed_conditions": conditions,
    "classify_case": cases,
    "episode_summary": lambda s, f: gd.episode_summary(sq.matches(s, f), sg.segment_warnings(d.segments(s, f))),
    "proofread_summary": lambda s, f: gd.proofread_summary(items(s, f), d.cues(s, f)),
    "realign_summary": lambda s, f: gd.realign_summary(realigned(s, f)).withColumns({n: F.array_join(n, ",") for n in ("failed_ids", "pending_ids")}),
    "proofread_coverage": lambda s, f: gd.proofread_coverage(d.cues(s, f).where("(media_id + cue_id) % 4 = 1"), items(s, f)),
    "align_cues_to_segments": lambda s, f: gd.align_cues_to_segments(d.cues(s, f), short_segments(s, f)),
    "rank_for_diagnosis": to_diagnose,
    "standalone_responses": responses,
    "short_text_kind": kinds,
    "low_energy": lambda s, f: gd.low_energy(frames(s, f), 60.0, 20.0, 300.0),
    "sample_cases": lambda s, f: gd.sample_cases(sq.diff(s, f), 20),
    "translation_payload": payloads,
    "coarse_cues": lambda s, f: gd.coarse_cues(completed(s, f)),
    "exact_recovery_guard": exact,
}


def key(column: str) -> str:
    return tq.LATIN.replace("text", column)


ITEM = """item AS (SELECT media_id, cue_id AS item_id, CASE WHEN n % 10 = 0 THEN 'failed' ELSE 'completed' END AS status, CASE WHEN n % 3 <> 0 THEN [cue_id, cue_id + 1] ELSE [cue_id] END AS seen,
  n % 2 AS applied, (n % 4 = 3)::INT AS rejected, n % 3 AS suggestions, n % 7 = 0 AS blank, n * 1000 AS ms FROM (SELECT *, media_id + cue_id AS n FROM cue)),
reviewed AS (SELECT DISTINCT media_id, unnest(seen) AS cue_id FROM item WHERE status = 'completed')"""


def item_sql(body: str) -> str:
    return q("cue", body).replace("\nSELECT", f",\n{ITEM}\nSELECT", 1)


ORACLES = {
    "coarse_guard": q("cue", """SELECT media_id, cue_id, CASE WHEN ns IS NULL THEN 'bounds_invalid' WHEN ns < start_ms OR ne > end_ms OR ne <= ns THEN 'out_of_range'
  WHEN length(text) % 3 = 0 AND (ne - ns > 6000 OR ne - ns >= ((end_ms - start_ms) * 8 + 5) // 10) THEN 'short_response_too_wide' WHEN pe - ns > 100 OR ne - fs > 100 THEN 'neighbour_overlap' ELSE 'accepted' END AS verdict
  FROM (SELECT *, CASE WHEN (media_id + cue_id) % 23 <> 0 THEN start_ms - 5 + (media_id * 7 + cue_id * 3) % 40 END AS ns, end_ms + 5 - (media_id * 11 + cue_id * 5) % 900 AS ne,
    lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS fs FROM cue WINDOW w AS (PARTITION BY media_id ORDER BY cue_id))"""),
    "language_route": """SELECT doc_id, CASE l WHEN 'jp' THEN 'Japanese' WHEN '' THEN 'Auto' WHEN 'en' THEN 'English' WHEN 'zh' THEN 'Chinese' ELSE l END AS language, CASE WHEN l IN ('jp', '', 'en', 'zh') THEN 'model' END AS default_strategy,
  CASE WHEN l = 'jp' THEN 'model,local' WHEN l IN ('', 'en', 'zh') THEN 'model' ELSE '' END AS strategies FROM (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'jp' WHEN 1 THEN '' ELSE lang END AS l FROM documents)""",
    "clear_punctuation_only": q("cue", """SELECT media_id, cue_id, needs AND NOT clear AS needs_realign, CASE WHEN needs AND clear THEN 'completed' ELSE 'pending' END AS realign_status, CASE WHEN needs AND clear THEN 'punctuation-only' END AS realign_method
  FROM (SELECT *, (media_id + cue_id) % 4 <> 0 AS needs, cue_id % 7 <> 6 AND cue_id % 3 IN (0, 1) AS clear FROM cue)"""),
    "observed_conditions": q("token", """SELECT media_id, cue_id, array_to_string(list_filter(['transcript_correctness_unknown', CASE WHEN n = 0 THEN 'no_tokens' END, CASE WHEN z > 0 THEN 'zero_duration_token' END, CASE WHEN n > 0 AND z * 2 >= n THEN 'dense_zero_tokens' END,
    CASE WHEN covered * 5 < end_ms - start_ms THEN 'low_coverage' END, CASE WHEN wrong THEN 'rewrite_rejected' END, CASE WHEN mixed THEN 'language_mismatch' END, CASE WHEN start_ms < pe OR end_ms > fs THEN 'neighbour_overlap' END], lambda x: x IS NOT NULL), ',') AS conditions,
  CASE WHEN mixed THEN 'language_route_mismatch' WHEN wrong THEN 'short_window_content_rejected' ELSE 'coverage_below_threshold' END AS cause
  FROM (SELECT c.*, coalesce(n, 0) AS n, coalesce(z, 0) AS z, coalesce(covered, 0) AS covered, (media_id + cue_id) % 10 = 0 AS wrong, role = 'user' AND regexp_matches(text, '\\p{Latin}') AS mixed, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS fs
    FROM cue c LEFT JOIN (SELECT media_id, cue_id, count(*) AS n, count(*) FILTER (end_ms <= start_ms) AS z, sum(greatest(end_ms - start_ms, 0)) AS covered FROM token WHERE cue_id % 6 <> 0 AND (cue_id % 5 <> 0 OR pos % 7 = 6) GROUP BY ALL) USING (media_id, cue_id)
    WINDOW w AS (PARTITION BY media_id ORDER BY cue_id))"""),
    "classify_case": q("cue_b token", f"""SELECT media_id, cue_id, split_part(c, '|', 1) AS detail, split_part(c, '|', 2) AS owner, split_part(c, '|', 3) AS confidence FROM (SELECT media_id, cue_id, CASE
    WHEN n % 4 >= 3 OR zero >= 3 THEN 'align-token-structure|align|high' WHEN sa < 20 AND sb < 20 THEN 'align-low-score-inherited|align|high'
    WHEN n % 5 = 1 OR (k <> '' AND NOT contains(kb, k)) THEN CASE WHEN media_id % 2 = 0 THEN 'rule-or-postprocess-content-loss|postprocess|medium' ELSE 'split-mode-unknown-content-loss|unknown|low' END
    WHEN n % 5 IN (0, 3) AND sa >= 45 AND sb < sa THEN CASE WHEN media_id % 2 = 0 THEN 'rule-boundary-error|rule|medium' ELSE 'split-mode-unknown-boundary-error|unknown|low' END
    WHEN n % 5 = 2 AND k <> '' AND contains(kb, k) THEN 'evaluator-window-or-timing-shift|evaluator|medium'
    WHEN n % 5 = 2 THEN CASE WHEN media_id % 2 = 0 THEN 'rule-short-dialogue-merged|rule|medium' ELSE 'split-mode-unknown-short-dialogue-merged|unknown|low' END
    WHEN n % 3 = 0 THEN 'postprocess-duplicate-boundary|postprocess|medium' ELSE 'manual-review-required|unknown|low' END AS c
  FROM (SELECT a.media_id, a.cue_id, a.media_id + a.cue_id AS n, {key('a.text')} AS k, {key('b.text')} AS kb, (a.media_id * 31 + a.cue_id * 17) % 100 AS sa, (a.media_id * 13 + a.cue_id * 29) % 100 AS sb, CASE WHEN a.cue_id % 4 = 1 THEN z ELSE 0 END AS zero
    FROM cue a JOIN cue_b b USING (media_id, cue_id) JOIN (SELECT media_id, cue_id, count(*) FILTER (end_ms <= start_ms) AS z FROM token GROUP BY ALL) t USING (media_id, cue_id)))"""),
    "episode_summary": f"""SELECT media_id, matches, high, medium, low, coalesce(warnings, '') AS warnings FROM (SELECT media_id, count(*) AS matches, count(*) FILTER (level = 'high') AS high, count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low
  FROM ({sq.ORACLES['match_dialogues']}) GROUP BY 1) LEFT JOIN ({tq.ORACLES['segment_warnings']}) USING (media_id)""",
    "proofread_summary": item_sql("""SELECT media_id, completed, failed, coalesce(r, 0) AS reviewed, applied, rejected, unresolved, coalesce(r, 0) * 60000.0::DOUBLE / ms AS per_minute, CASE WHEN r > 0 THEN elapsed * 1.0::DOUBLE / r ELSE 0.0 END AS ms_each
  FROM (SELECT media_id, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed, sum(CASE WHEN status = 'completed' THEN applied ELSE 0 END)::BIGINT AS applied, sum(CASE WHEN status = 'completed' THEN rejected ELSE 0 END)::BIGINT AS rejected,
    count(*) FILTER (status = 'failed' OR (suggestions = 0 AND NOT blank)) AS unresolved, sum(ms)::BIGINT AS elapsed FROM item GROUP BY 1)
  LEFT JOIN (SELECT media_id, count(*) AS r FROM reviewed GROUP BY 1) USING (media_id) LEFT JOIN (SELECT media_id, sum(end_ms - start_ms)::BIGINT AS ms FROM cue GROUP BY 1) USING (media_id)"""),
    "realign_summary": q("cue", """SELECT *, CASE WHEN failed > 0 OR pending_ids <> '' THEN 'FAIL' WHEN fallback + unusable + rejected > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT media_id, coalesce(string_agg(cue_id::VARCHAR, ',' ORDER BY cue_id) FILTER (end_ms - start_ms > 5000 AND (n % 8 = 0 OR n % 5 = 0)), '') AS pending_ids, count(*) FILTER (n % 8 <> 0 AND n % 5 <> 0) AS completed, count(*) FILTER (n % 8 <> 0 AND n % 5 = 0) AS fallback,
  count(*) FILTER (n % 8 = 0) AS failed, count(*) FILTER (n % 7 = 0) AS unusable, count(*) FILTER (n % 7 = 3) AS rejected, coalesce(string_agg(cue_id::VARCHAR, ',' ORDER BY cue_id) FILTER (n % 8 = 0), '') AS failed_ids FROM (SELECT *, media_id + cue_id AS n FROM cue) GROUP BY 1)"""),
    "proofread_coverage": item_sql("""SELECT *, CASE WHEN candidates < wanted OR failed > 0 OR completed < candidates THEN 'FAIL' WHEN unresolved + unproved > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM (
  SELECT media_id, coalesce(wanted, 0) AS wanted, coalesce(reviewed, 0) AS reviewed, coalesce(wanted, 0) - coalesce(reviewed, 0) AS left, candidates, completed, failed, unresolved, unproved FROM (
    SELECT media_id, count(DISTINCT t) AS candidates, count(DISTINCT t) FILTER (status = 'completed') AS completed FROM (SELECT media_id, status, unnest(seen) AS t FROM item) GROUP BY 1)
  JOIN (SELECT media_id, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'completed' AND suggestions = 0 AND NOT blank) AS unresolved, count(*) FILTER (status = 'completed' AND applied > 0 AND blank) AS unproved FROM item GROUP BY 1) USING (media_id)
  LEFT JOIN (SELECT c.media_id, count(*) AS wanted, count(r.cue_id) AS reviewed FROM cue c LEFT JOIN reviewed r ON c.media_id = r.media_id AND c.cue_id = r.cue_id WHERE (c.media_id + c.cue_id) % 4 = 1 GROUP BY 1) USING (media_id))"""),
    "align_cues_to_segments": q("cue segment", """SELECT media_id, coalesce(seg_idx, 1) AS seg_idx, coalesce(s, first) AS start_ms, coalesce(e, last) AS end_ms, cues, text FROM (
  SELECT media_id, nth, min(start_ms) AS first, max(end_ms) AS last, count(*) AS cues, string_agg(text, ' ' ORDER BY cue_id) AS text FROM (
    SELECT *, 1 + max(passed) OVER (PARTITION BY media_id ORDER BY cue_id) AS nth FROM (SELECT c.media_id, c.cue_id, any_value(c.text) AS text, any_value(c.start_ms) AS start_ms, any_value(c.end_ms) AS end_ms, count(o.media_id) AS passed
      FROM cue c LEFT JOIN (SELECT * FROM own WHERE seg_idx < of) o ON c.media_id = o.media_id AND o.e <= (c.start_ms + c.end_ms) // 2 GROUP BY 1, 2)) GROUP BY 1, 2)
  LEFT JOIN (SELECT *, seg_idx AS nth FROM own) USING (media_id, nth)""").replace("\nSELECT", """,
own AS (SELECT media_id, seg_idx, of, s, greatest(e, s + 1) AS e FROM (SELECT *, CASE WHEN pe > start_ms THEN (pe + start_ms) // 2 ELSE start_ms END AS s, CASE WHEN end_ms > ns THEN (end_ms + ns) // 2 ELSE end_ms END AS e FROM (
  SELECT media_id, seg_idx, start_ms // 20 AS start_ms, end_ms // 20 AS end_ms, count(*) OVER (PARTITION BY media_id) AS of, lag(end_ms // 20) OVER w AS pe, lead(start_ms // 20) OVER w AS ns FROM segment WINDOW w AS (PARTITION BY media_id ORDER BY seg_idx))))
SELECT""", 1),
    "rank_for_diagnosis": q("token", """SELECT media_id, cue_id, score, row_number() OVER (PARTITION BY media_id ORDER BY score DESC, ms, cue_id) AS rank FROM (SELECT c.media_id, c.cue_id, ms, CASE WHEN (media_id + cue_id) % 8 = 0 OR t.n IS NULL THEN 100 ELSE 0 END + CASE WHEN length(text) * 1000 <= ms THEN 10 ELSE 0 END AS score
  FROM (SELECT *, end_ms - start_ms + (media_id + cue_id) % 3 * 400000 AS ms FROM cue) c LEFT JOIN (SELECT media_id, cue_id, count(*) AS n FROM token WHERE (media_id + cue_id) % 11 <> 0 GROUP BY ALL) t USING (media_id, cue_id))"""),
    "standalone_responses": q("token", f"""SELECT media_id, cue_id, pos, key, start_ms, end_ms FROM (SELECT *, {key('token')} AS key, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS fs FROM token WINDOW w AS (PARTITION BY media_id ORDER BY cue_id, pos))
  WHERE key IN ('the', 'and', 'of', 'is') AND end_ms - start_ms BETWEEN 120 AND 1800 AND (key IN ('the', 'of') OR (coalesce(start_ms - pe >= 500, true) AND (coalesce(fs - end_ms >= 500, true) OR regexp_matches(token, '[。！？!?]'))))"""),
    "short_text_kind": q("token", f"""SELECT media_id, cue_id, pos, CASE WHEN t IN ('and', 'the') THEN 'response' WHEN t <> '' AND regexp_replace(t, 'the|an|er|on|th', '', 'g') = '' THEN 'filler' WHEN regexp_matches(t, '^[0-9]+$') OR t = 'of' THEN 'numeric' ELSE 'other' END AS kind
  FROM (SELECT *, regexp_replace(trim(CASE WHEN pos % 9 = 4 THEN cue_id::VARCHAR ELSE token END), '{tq.FILLER}', '', 'g') AS t FROM token)"""),
    "low_energy": """SELECT media_id, sum(a)::BIGINT AS frames, sum(n)::DOUBLE / sum(a) AS low_ratio, sum(silent)::DOUBLE / sum(a) AS silence_ratio, sum(clipped)::DOUBLE / sum(a) AS clipping_ratio, max(n) * 100 AS longest_ms, coalesce(max(n) FILTER (run = 0), 0) * 100 AS leading_ms, arg_max(n, run) * 100 AS trailing_ms
  FROM (SELECT media_id, run, count(*) AS a, count(*) FILTER (value < 60) AS n, count(*) FILTER (value < 20) AS silent, count(*) FILTER (value >= 300) AS clipped FROM (
    SELECT user_id AS media_id, value, count(*) FILTER (value >= 60) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM events) GROUP BY 1, 2) GROUP BY 1""",
    "sample_cases": q("cue_b", f"""SELECT media_id, cue_id, type, fell FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY fell DESC, media_id, cue_id) AS n FROM (SELECT media_id, cue_id, type, max(fell) AS fell FROM (SELECT * FROM {sq.DIFF}) GROUP BY 1, 2, 3))
  WHERE type = 'became_fail' OR (type IN ('score_drop', 'text_shortened') AND n <= 20)"""),
    "translation_payload": q("cue", """SELECT media_id, cue_id, text AS translation, n % 6 = 0 AS suspect, CASE WHEN n % 3 = 0 AND n % 5 <> 0 THEN least(n % 150 / 100.0, 1.0) ELSE 1.0 END::DOUBLE AS confidence FROM (SELECT *, media_id + cue_id AS n FROM cue)"""),
    "coarse_cues": f"""SELECT media_id, cue_id, start_ms, least(start_ms + 6000, greatest(start_ms + 1000, end_ms)) AS end_ms, wrapped AS text FROM ({q('cue', 'SELECT * FROM cue')}) JOIN ({tq.ORACLES['wrap_text']}) USING (media_id, cue_id) WHERE (media_id + cue_id) % 9 <> 0""",
    "exact_recovery_guard": q("token", f"""SELECT media_id, cue_id, CASE WHEN n IS NULL THEN 'no_tokens' WHEN empty THEN 'not_positive' WHEN back THEN 'not_monotonic' WHEN outside THEN 'outside' WHEN error <> 'ok' THEN 'timing'
    WHEN {key('joined')} <> {key('text')} THEN 'text_differs' WHEN pe > lo OR fs < hi THEN 'neighbour_overlap' ELSE 'accepted' END AS verdict
  FROM (SELECT *, lag(CASE WHEN fine THEN end_ms END) OVER w AS pe, lead(CASE WHEN fine THEN start_ms END) OVER w AS fs FROM cue LEFT JOIN (SELECT media_id, cue_id, count(*) AS n, bool_or(e > s) AS fine, min(s) AS lo, max(e) AS hi, bool_or(e <= s) AS empty, bool_or(coalesce(s < ps, false)) AS back,
      bool_or(s < cue_start OR e > cue_end) AS outside, string_agg(token, ' ' ORDER BY pos) AS joined FROM (
    SELECT *, lag(s) OVER (PARTITION BY media_id, cue_id ORDER BY pos) AS ps FROM (SELECT *, start_ms AS s, CASE WHEN cue_id % 5 = 0 THEN greatest(end_ms, start_ms + 1) ELSE end_ms END AS e FROM token WHERE cue_id % 6 <> 0 AND (cue_id % 2 = 1 OR end_ms > start_ms))) GROUP BY ALL) t USING (media_id, cue_id)
    WINDOW w AS (PARTITION BY media_id ORDER BY cue_id)) JOIN (SELECT media_id, cue_id, error FROM {tq.ERRORS}) e USING (media_id, cue_id)"""),
}
