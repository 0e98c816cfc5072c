"""Alignment and edit queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.operators import alignment as al
from cueloom.operators import tokens as tk
from cueloom.plans.text_queries import ERRORS, cue_bounds
from cueloom.sources import derived as d
from cueloom.sources.derived import with_tables as q

C = F.col


def aligned(s, f):
    a = al.nest_tokens(d.cues(s, f), d.tokens(s, f).where("cue_id % 6 <> 0"))
    return (
        a.withColumn("alignment_state", F.when(C("cue_id") % 8 == 0, "failed"))
        .withColumn("status", F.when(C("cue_id") % 5 == 0, "failed").otherwise("completed"))
        .withColumn("alignment_unit", F.when(C("cue_id") % 7 == 0, "segment").otherwise("token"))
    )


def shifted(s, f):
    return d.cues(s, f).select("media_id", (C("cue_id") * 10).alias("edit_id"), "cue_id", (C("start_ms") - 90 + C("cue_id") % 4 * 60).alias("start_ms"), (C("end_ms") - C("cue_id") % 3 * 300).alias("end_ms"), F.when(C("cue_id") % 9 == 0, " ").otherwise(C("text")).alias("text"))


def short_cues(s, f):
    return d.cues(s, f).withColumn("end_ms", F.when(C("cue_id") % 2 == 0, C("start_ms") + 300).otherwise(C("end_ms")))


def run_rows(s, f):
    e = tk.token_timing_error(d.tokens(s, f), cue_bounds(s, f))
    n = lambda k, m: (C("media_id") * 7 + C("cue_id") * k) % m
    return e.select("media_id", "cue_id", "error", (n(3, 5) == 0).alias("back"), (n(5, 10) / 10).alias("low_energy"), (n(11, 10) / 10).alias("peak"), n(2, 3).alias("zero_run"), (n(13, 4) / 2).alias("cps"), (n(17, 50)).alias("local_cps"))


QUERIES = {
    "alignment_state": lambda s, f: aligned(s, f).select("media_id", "cue_id", al.alignment_state(aligned(s, f)).alias("state")),
    "state_counts": lambda s, f: al.state_counts(aligned(s, f)),
    "structural_metrics": lambda s, f: al.structural_metrics(aligned(s, f)),
    "classify_run": lambda s, f: run_rows(s, f).select("media_id", "cue_id", al.classify_run(run_rows(s, f)).alias("kind")),
    "classify_short": lambda s, f: al.classify_short(short_cues(s, f), ["anble", "was"], ["the", "on"]),
    "edit_verdicts": lambda s, f: al.edit_verdicts(shifted(s, f), d.cues(s, f)),
    "nearby_batches": lambda s, f: al.nearby_batches(d.cues(s, f).withColumn("seg_idx", F.floor(C("cue_id") / 6))),
    "sentence_units": lambda s, f: al.sentence_units(d.cues(s, f)),
    "content_retention": lambda s, f: al.content_retention(d.cues(s, f), d.regressed_cues(s, f)),
}

STATE = "CASE WHEN cue_id % 8 = 0 THEN 'failed' WHEN cue_id % 5 = 0 THEN 'failed' WHEN cue_id % 7 = 0 THEN 'completed_coarse' WHEN cue_id % 6 = 0 OR NOT coalesce(pos_tokens, false) THEN 'completed_coarse' ELSE 'completed_exact' END"
ALIGNED = "(SELECT c.*, t.pos_tokens, t.toks FROM cue c LEFT JOIN (SELECT media_id, cue_id, bool_or(end_ms > start_ms) AS pos_tokens, list({'s': start_ms, 'e': end_ms} ORDER BY pos) AS toks FROM token WHERE cue_id % 6 <> 0 GROUP BY ALL) t ON t.media_id = c.media_id AND t.cue_id = c.cue_id)"
LATIN = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"

ORACLES = {
    "alignment_state": q("cue token", f"SELECT media_id, cue_id, {STATE} AS state FROM {ALIGNED}"),
    "state_counts": q("cue token", f"""SELECT media_id, state, count(*) AS segments, count(*) FILTER (state0 = 'failed' AND k <= 4) AS short_failed, grouping(media_id, state)::BIGINT AS level
  FROM (SELECT media_id, {STATE} AS state, {STATE} AS state0, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS k FROM {ALIGNED}) GROUP BY CUBE (media_id, state)"""),
    "structural_metrics": q("cue token", f"""SELECT media_id, count(*) AS segments, sum((end_ms <= start_ms)::INT + coalesce(len(list_filter(toks, lambda t: t.e <= t.s)), 0))::BIGINT AS illegal,
  sum(coalesce(len(list_filter(toks, lambda t: t.s < start_ms OR t.e > end_ms)), 0))::BIGINT AS out_of_range, count(*) FILTER (list_transform(toks, lambda t: t.s) <> list_sort(list_transform(toks, lambda t: t.s))) AS non_monotonic,
  count(*) FILTER (start_ms < b - 100) AS severe_overlaps FROM (SELECT *, lag(end_ms) OVER (PARTITION BY media_id ORDER BY cue_id) AS b FROM {ALIGNED}) GROUP BY media_id"""),
    "classify_run": q("token", f"""SELECT media_id, cue_id, CASE WHEN error = 'ok' THEN 'ok' WHEN (media_id * 7 + cue_id * 3) % 5 = 0 THEN 'adapter_mismatch' WHEN (media_id * 7 + cue_id * 5) % 10 >= 6 THEN 'window_context'
  WHEN (media_id * 7 + cue_id * 11) % 10 >= 8 AND (media_id * 7 + cue_id * 2) % 3 > 0 THEN 'audio_chain' WHEN (media_id * 7 + cue_id * 13) % 4 <= 2 THEN 'text_mismatch'
  WHEN (media_id * 7 + cue_id * 2) % 3 > 0 OR (media_id * 7 + cue_id * 17) % 50 >= 35 THEN 'model_or_audio_collapse' ELSE 'unknown' END AS kind FROM {ERRORS}"""),
    "classify_short": q("cue", f"""SELECT media_id, cue_id, CASE WHEN k IN ('anble', 'was') THEN 'protected_short' WHEN p AND lft <= 8000 THEN 'fragment_merge_left' WHEN p AND rgt <= 800 THEN 'fragment_merge_right' WHEN p THEN 'fragment_alone'
  WHEN rgt <= 80 THEN 'merge_next' WHEN lft <= 80 THEN 'merge_previous' WHEN length(k) <= 2 THEN 'tiny' ELSE 'source_timing' END AS kind FROM (
  SELECT *, starts_with(k, 'the') OR ends_with(k, 'the') OR starts_with(k, 'on') OR ends_with(k, 'on') AS p, start_ms - lag(e) OVER w AS lft, lead(start_ms) OVER w - e AS rgt FROM (
    SELECT *, {LATIN.format('text')} AS k, CASE WHEN cue_id % 2 = 0 THEN start_ms + 300 ELSE end_ms END AS e FROM cue) WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, cue_id)) WHERE e - start_ms < 500"""),
    "edit_verdicts": q("cue", """SELECT media_id, edit_id, cue_id, CASE WHEN trim(t) = '' THEN 'text_required' WHEN length(trim(t)) > 10000 THEN 'text_too_long' WHEN s < 0 OR e <= s THEN 'time_invalid' WHEN clash IS NOT NULL THEN 'time_overlap' ELSE 'ok' END AS verdict, clash FROM (
  SELECT x.*, (SELECT min(c.cue_id) FROM cue c WHERE c.media_id = x.media_id AND c.cue_id <> x.cue_id AND x.e > x.s AND x.s < c.end_ms AND c.start_ms < x.e) AS clash FROM (
    SELECT media_id, cue_id * 10 AS edit_id, cue_id, start_ms - 90 + cue_id % 4 * 60 AS s, end_ms - cue_id % 3 * 300 AS e, CASE WHEN cue_id % 9 = 0 THEN ' ' ELSE text END AS t FROM cue) x)"""),
}
