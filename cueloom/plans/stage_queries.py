"""Matching and stage queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.operators import matching as mt
from cueloom.operators import quality as ql
from cueloom.operators import stages as st
from cueloom.operators import tokens as tk
from cueloom.plans.text_queries import ERRORS, cue_bounds
from cueloom.plans.quality_queries import ISSUES
from cueloom.sources import derived as d
from cueloom.sources.derived import with_tables as q

C = F.col


def near_dialogues(s, f):
    """Reference lines shifted back to the cues' times, 200 ms late."""
    return d.dialogues(s, f).withColumn("start_ms", C("start_ms") - 5980).withColumn("end_ms", C("end_ms") - 5980)


def matches(s, f):
    return mt.match_dialogues(near_dialogues(s, f), d.regressed_cues(s, f))


def word_pairs(s, f):
    first = lambda c: F.lower(F.element_at(F.split(c, " "), 1))
    return d.cues(s, f).select("media_id", "cue_id", first(C("text")).alias("source"), F.lower(F.element_at(F.split("text", " "), -1)).alias("target"))


def glossary(s, f):
    return d.cues(s, f).select(F.lower(F.element_at(F.split("text", " "), 1)).alias("term")).distinct().withColumn("grp", F.lit("general"))


def graded(c, late: int):
    score = ((C("media_id") * 7 + C("cue_id") * (11 + late)) % 100) / 100
    return c.select("media_id", "cue_id", score.alias("score"), mt.quality_level(score).alias("level"), "text")


def diff(s, f):
    return st.stage_diff(graded(d.cues(s, f), 0), graded(d.regressed_cues(s, f), 2))


def runs(s, f):
    e = d.read(s, f, "events")
    return e.select(C("event_type").alias("variant"), (C("user_id") % 9 != 0).alias("success"), C("value").alias("total_s"), (C("event_id") % 50 + 10).alias("audio_s"))


def failed(s, f):
    return tk.token_timing_error(d.tokens(s, f), cue_bounds(s, f)).where("error <> 'ok' or cue_id % 4 = 0").join(d.cues(s, f), ["media_id", "cue_id"])


def both(s, f):
    return d.cues(s, f).withColumn("stage", F.lit("split")).unionByName(d.regressed_cues(s, f).withColumn("stage", F.lit("translated")))


QUERIES = {
    "match_dialogues": matches,
    "match_summary": lambda s, f: mt.match_summary(matches(s, f)),
    "select_reference": lambda s, f: mt.select_reference(d.dialogues(s, f), ["assistant", "system"]),
    "mine_pairs": lambda s, f: mt.mine_pairs(word_pairs(s, f)),
    "glossary_hits": lambda s, f: mt.glossary_hits(d.cues(s, f), glossary(s, f)),
    "estimate_offset": lambda s, f: mt.estimate_offset(d.dialogues(s, f), d.cues(s, f)),
    "resolve_best_stage": lambda s, f: st.resolve_best_stage([d.regressed_cues(s, f).where("media_id % 3 = 0"), d.cues(s, f)]).select("media_id", "cue_id", "start_ms", "stage_rank"),
    "pending_cues": lambda s, f: st.pending(d.cues(s, f), d.regressed_cues(s, f), ["media_id", "cue_id"]).select("media_id", "cue_id", "text"),
    "key_sets": lambda s, f: st.key_sets(d.cues(s, f).where("cue_id > 1"), d.regressed_cues(s, f)),
    "stage_diff": diff,
    "top_issues": lambda s, f: st.top_issues(diff(s, f), 3),
    "distinct_issues": lambda s, f: st.distinct_issues(ql.readability_issues(d.cues(s, f)), ["cue_id"]).select("media_id", "cue_id", "severity", "type", "amount"),
    "upsert": lambda s, f: st.upsert(d.cues(s, f), d.regressed_cues(s, f), ["media_id", "cue_id"]),
    "expand_neighbours": lambda s, f: st.expand_neighbours(d.cues(s, f).where("cue_id % 5 = 0"), d.cues(s, f)),
    "numeric_first": lambda s, f: st.numeric_first(d.cues(s, f).select("media_id", F.when(C("cue_id") % 4 == 0, F.concat(F.lit("x"), C("cue_id").cast("string"))).otherwise(C("cue_id").cast("string")).alias("key"))),
    "unique_workdirs": lambda s, f: st.unique_workdirs(d.read(s, f, "customer").select(C("c_custkey").alias("task_id"), F.concat(F.when(C("c_custkey") % 2 == 0, "Run").otherwise("run"), (C("c_custkey") % 7).cast("string")).alias("workdir"))),
    "artifact_counts": lambda s, f: st.artifact_counts(both(s, f), ["split", "translated"]),
    "run_summary": lambda s, f: st.run_summary(runs(s, f)),
    "timing_profile": lambda s, f: st.timing_profile(d.read(s, f, "events").select(C("event_type").alias("kind"), (C("user_id") % 5).cast("string").alias("name"), "value")),
    "case_counts": lambda s, f: st.case_counts(diff(s, f).select(C("severity").alias("owner"), C("type").alias("cause"))),
    "recovery_queue": lambda s, f: st.recovery_queue(failed(s, f), d.cues(s, f)),
}

LATIN = "regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}]', '', 'g')"
MATCHES = f"""(SELECT media_id, line_id, cue_id, coalesce(n, 0)::INT AS n_merged, coalesce(score, 0) AS score, CASE WHEN coalesce(score, 0) >= 0.75 THEN 'high' WHEN coalesce(score, 0) >= 0.75 - 0.18 THEN 'medium' ELSE 'low' END AS level, coalesce(reasons, 'missing') AS reasons FROM (
  SELECT *, row_number() OVER (PARTITION BY media_id, line_id ORDER BY score DESC NULLS LAST, n, cue_id) AS rk FROM (
    SELECT media_id, line_id, cue_id, n, round_even(greatest(0, least(1, t * 0.45 + b * 0.20 + l * 0.15 + c * 0.20 - least(0.4::DOUBLE, (n - 1) * 0.08::DOUBLE))), 4) AS score,
      CASE WHEN cue_id IS NOT NULL THEN coalesce(nullif(array_to_string(list_filter([CASE WHEN t < 0.45 THEN 'time weak' END, CASE WHEN n >= 3 THEN 'merged ' || n || ' splits' END, CASE WHEN c < 0.55 THEN 'sparse tokens' END, CASE WHEN l < 0.45 THEN 'length drift' END, CASE WHEN rlen = 0 THEN 'empty source' END], lambda x: x IS NOT NULL), ','), ''), 'ok') END AS reasons FROM (
      SELECT d.media_id, line_id, r.cue_id, r.n, r.rlen, (greatest(0, least(d.e, r.e) - greatest(d.s, r.s)) / (greatest(d.e, r.e) - least(d.s, r.s)))::DOUBLE AS t,
        greatest(0::DOUBLE, least(1::DOUBLE, 1.0::DOUBLE - (abs(d.s - r.s) + abs(d.e - r.e)) / (greatest(800, d.e - d.s) * 1.6::DOUBLE))) AS b,
        CASE WHEN d.dlen = 0 OR r.rlen = 0 THEN 0 ELSE least(d.dlen, r.rlen) / greatest(d.dlen, r.rlen) END::DOUBLE AS l,
        least(1::DOUBLE, least(r.sm, greatest(0, least(d.e, r.e) - greatest(d.s, r.s))) / greatest(1, d.e - d.s))::DOUBLE AS c
      FROM (SELECT media_id, line_id, start_ms - 5980 AS s, end_ms - 5980 AS e, length({LATIN}) AS dlen FROM dialogue) d
      LEFT JOIN (SELECT media_id, cue_id, start_ms AS s, unnest([1, 2, 3, 4]) AS n, unnest([end_ms, e2, e3, e4]) AS e, unnest([l1, l2, l3, l4]) AS rlen, unnest([m1, m2, m3, m4]) AS sm, unnest([h1, h2, h3, h4]) AS have FROM (
        SELECT media_id, cue_id, start_ms, end_ms, len AS l1, m AS m1, 1 AS h1,
          max(end_ms) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS e2, max(end_ms) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS e3, max(end_ms) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS e4,
          sum(len) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS l2, sum(len) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS l3, sum(len) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS l4,
          sum(m) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS m2, sum(m) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS m3, sum(m) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS m4,
          count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 1 FOLLOWING) AS h2, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS h3, count(*) OVER (w ROWS BETWEEN CURRENT ROW AND 3 FOLLOWING) AS h4
        FROM (SELECT *, length({LATIN}) AS len, end_ms - start_ms AS m FROM cue_b) WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, cue_id))) r
      ON r.media_id = d.media_id AND r.have = r.n AND d.e > r.s - 2500 AND d.s < r.e + 2500))) WHERE rk = 1)"""
GRADED = "(SELECT media_id, cue_id, score, CASE WHEN score < 0.20 THEN 'fail' WHEN score < 0.45 THEN 'low' WHEN score < 0.75 THEN 'warn' ELSE 'ok' END AS level, text FROM (SELECT *, ((media_id * 7 + cue_id * {1}) % 100) / 100 AS score FROM {0}))"
RANK = "list_position(['fail', 'low', 'warn', 'ok'], {0})"
DIFF = f"""(SELECT media_id, cue_id, fell, i[1] AS severity, i[2] AS type FROM (SELECT a.media_id, a.cue_id, round(a.score - b.score, 6) AS fell, unnest(list_filter([
   CASE WHEN b.level = 'fail' AND a.level <> 'fail' THEN ['FAIL', 'became_fail'] END, CASE WHEN b.level = 'low' AND a.level IN ('warn', 'ok') THEN ['WARN', 'became_low'] END, CASE WHEN round(a.score - b.score, 6) >= 0.15 THEN ['WARN', 'score_drop'] END,
   CASE WHEN {RANK.format('b.level')} < {RANK.format('a.level')} THEN ['WARN', 'level_worse'] END, CASE WHEN length(b.text) < length(a.text) * 0.6 THEN ['WARN', 'text_shortened'] END], lambda x: x IS NOT NULL)) AS i
  FROM {GRADED.format('cue', 11)} a JOIN {GRADED.format('cue_b', 13)} b ON a.media_id = b.media_id AND a.cue_id = b.cue_id))"""

ORACLES = {
    "match_dialogues": q("cue_b dialogue", f"SELECT * FROM {MATCHES}"),
    "match_summary": q("cue_b dialogue", f"""SELECT *, CASE WHEN failed > 0 THEN 'FAIL' WHEN weak > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM (SELECT media_id, count(*) AS lines, sum(round(score * 10000)::BIGINT)::DOUBLE / (count(*) * 10000) AS mean, median(round(score * 10000)::BIGINT) / 10000 AS median, count(*) FILTER (level = 'high') AS high,
  count(*) FILTER (level = 'medium') AS medium, count(*) FILTER (level = 'low') AS low, count(*) FILTER (score >= 0.75) AS good, count(*) FILTER (score < 0.45) AS weak, count(*) FILTER (score < 0.20) AS failed FROM {MATCHES} GROUP BY media_id)"""),
    "distinct_issues": q("cue", f"SELECT media_id, cue_id, i.s AS severity, i.t AS type, i.a AS amount FROM {ISSUES.format('cue')} QUALIFY row_number() OVER (PARTITION BY media_id, i.s, i.t, i.a ORDER BY cue_id) = 1"),
    "select_reference": q("dialogue", f"SELECT media_id, line_id, start_ms, end_ms, style, text FROM dialogue WHERE style IN ('assistant', 'system') AND {LATIN} <> '' QUALIFY row_number() OVER (PARTITION BY media_id, start_ms, end_ms, text ORDER BY line_id) = 1"),
    "mine_pairs": q("cue", """SELECT source, max(total)::BIGINT AS total, max(target) FILTER (rk = 1) AS target, max(n) FILTER (rk = 1) AS n, coalesce(string_agg(target, ',' ORDER BY rk) FILTER (rk > 1), '') AS alternates FROM (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, m, c, target) AS rk, sum(n) OVER (PARTITION BY source) AS total FROM (
    SELECT source, target, count(*) AS n, min((media_id, cue_id))[1] AS m, min((media_id, cue_id))[2] AS c FROM (SELECT media_id, cue_id, lower(string_split(text, ' ')[1]) AS source, lower(string_split(text, ' ')[-1]) AS target FROM cue) GROUP BY ALL))
  WHERE rk <= 4 GROUP BY source HAVING max(n) FILTER (rk = 1) >= 2"""),
    "glossary_hits": q("cue", """SELECT media_id, cue_id, term, 'general' AS grp, n FROM (SELECT *, row_number() OVER (PARTITION BY media_id, cue_id ORDER BY term) AS n FROM (
  SELECT media_id, cue_id, unnest(list_distinct(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'))) AS term FROM cue) JOIN (SELECT DISTINCT lower(string_split(text, ' ')[1]) AS term FROM cue) USING (term)) WHERE n <= 80"""),
    "estimate_offset": q("dialogue", f"""SELECT media_id, count(*) AS votes, (round_even(median(shift) / 10, 0) * 10)::BIGINT AS offset_ms FROM (
  SELECT *, first_value(b) OVER (PARTITION BY media_id ORDER BY n DESC, abs(b)) AS top FROM (SELECT *, count(*) OVER (PARTITION BY media_id, b) AS n FROM (
    SELECT d.media_id, d.start_ms - c.start_ms AS shift, round_even((d.start_ms - c.start_ms) / 500, 0)::BIGINT AS b FROM (SELECT media_id, start_ms, {LATIN} AS k FROM dialogue) d JOIN (SELECT media_id, start_ms, {LATIN} AS k FROM cue) c ON c.media_id = d.media_id AND c.k = d.k WHERE length(d.k) >= 6)))
  WHERE abs(b - top) <= 1 GROUP BY media_id"""),
    "resolve_best_stage": q("cue_b", "SELECT media_id, cue_id, start_ms, r AS stage_rank FROM (SELECT *, min(r) OVER (PARTITION BY media_id) AS best FROM (SELECT *, 0 AS r FROM cue_b WHERE media_id % 3 = 0 UNION ALL SELECT *, 1 FROM cue)) WHERE r = best"),
    "pending_cues": q("cue_b", "SELECT media_id, cue_id, text FROM cue c WHERE NOT EXISTS (SELECT 1 FROM cue_b b WHERE b.media_id = c.media_id AND b.cue_id = c.cue_id)"),
    "key_sets": q("cue_b", """SELECT coalesce(a.media_id, b.media_id) AS media_id, coalesce(a.cue_id, b.cue_id) AS cue_id, CASE WHEN b.media_id IS NULL THEN 'missing' WHEN a.media_id IS NULL THEN 'extra' ELSE 'shared' END AS kind
  FROM (SELECT * FROM cue WHERE cue_id > 1) a FULL JOIN cue_b b ON a.media_id = b.media_id AND a.cue_id = b.cue_id"""),
    "stage_diff": q("cue_b", f"SELECT * FROM {DIFF}"),
    "top_issues": q("cue_b", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY CASE WHEN severity = 'FAIL' THEN 0 ELSE 1 END, fell DESC, type, cue_id) AS rank FROM {DIFF}) WHERE rank <= 3"),
    "upsert": q("cue_b", "SELECT * FROM cue_b UNION ALL SELECT * FROM cue c WHERE NOT EXISTS (SELECT 1 FROM cue_b b WHERE b.media_id = c.media_id AND b.cue_id = c.cue_id)"),
    "expand_neighbours": q("cue", "SELECT DISTINCT c.media_id, c.cue_id FROM cue c JOIN cue o ON o.media_id = c.media_id AND o.cue_id % 5 = 0 AND abs(o.cue_id - c.cue_id) <= 2"),
    "numeric_first": q("cue", """SELECT media_id, key, row_number() OVER (PARTITION BY media_id ORDER BY CASE WHEN key LIKE 'x%' THEN 1 ELSE 0 END, CASE WHEN key NOT LIKE 'x%' THEN key::BIGINT END, key) AS pos
  FROM (SELECT media_id, CASE WHEN cue_id % 4 = 0 THEN 'x' || cue_id ELSE cue_id::VARCHAR END AS key FROM cue)"""),
    "unique_workdirs": "SELECT task_id, CASE WHEN n = 1 THEN w ELSE w || '-' || n END AS workdir FROM (SELECT *, row_number() OVER (PARTITION BY lower(w) ORDER BY task_id) AS n FROM (SELECT c_custkey AS task_id, CASE WHEN c_custkey % 2 = 0 THEN 'Run' ELSE 'run' END || (c_custkey % 7) AS w FROM customer))",
    "artifact_counts": q("cue_b", "SELECT media_id, count(*) FILTER (s = 1) AS split, count(*) FILTER (s = 2) AS translated FROM (SELECT media_id, 1 AS s FROM cue UNION ALL SELECT media_id, 2 FROM cue_b) GROUP BY media_id"),
    "run_summary": """SELECT event_type AS variant, count(*) AS runs, count(*) FILTER (user_id % 9 <> 0) AS successes, round(avg(value) FILTER (user_id % 9 <> 0), 6) AS mean_total,
  round(sum(value) FILTER (user_id % 9 <> 0) / sum(event_id % 50 + 10) FILTER (user_id % 9 <> 0), 6) AS rtf FROM events GROUP BY event_type""",
    "timing_profile": "SELECT event_type AS kind, (user_id % 5)::VARCHAR AS name, count(*) AS calls, round(sum(value), 4) AS total, round(avg(value), 6) AS average FROM events GROUP BY ALL",
    "case_counts": q("cue_b", f"SELECT severity AS owner, type AS cause, count(*) AS cases, grouping(severity, type)::BIGINT AS level FROM {DIFF} GROUP BY GROUPING SETS ((severity), (type), (severity, type))"),
    "recovery_queue": q("token", f"""SELECT media_id, cue_id, row_number() OVER (PARTITION BY media_id ORDER BY CASE WHEN k <= 4 THEN 0 ELSE 1 END, start_ms, cue_id) AS place,
  array_to_string(list_filter([CASE WHEN k <= 4 THEN 'short_response' END, CASE WHEN error = 'no_tokens' THEN 'no_tokens' END, CASE WHEN error = 'low_coverage' THEN 'low_coverage' END, CASE WHEN error IN ('zero_run', 'zero_ratio') THEN 'zero_duration_token' END], lambda x: x IS NOT NULL), ',') AS reasons, previous_text, next_text FROM (
  SELECT c.*, error, length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS k FROM (SELECT *, lag(text) OVER w AS previous_text, lead(text) OVER w AS next_text FROM cue WINDOW w AS (PARTITION BY media_id ORDER BY cue_id)) c
  JOIN {ERRORS} e ON e.media_id = c.media_id AND e.cue_id = c.cue_id WHERE error <> 'ok' OR c.cue_id % 4 = 0)"""),
}
