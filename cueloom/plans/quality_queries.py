"""Cue quality queries with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueloom.operators import quality as ql
from cueloom.operators import timing as tm
from cueloom.sources import derived as d
from cueloom.sources.derived import with_tables as q


def both_stages(s, f):
    return d.cues(s, f).withColumn("stage", F.lit("A")).unionByName(d.regressed_cues(s, f).withColumn("stage", F.lit("B")))


def normalised(s, f):
    return tm.normalize_timing(d.cues(s, f))


def echoed(s, f):
    """Stage A, where every fifth cue says again what the cue before it said."""
    before = F.lag("text").over(Window.partitionBy("media_id").orderBy("cue_id"))
    text = F.when((F.col("media_id") + F.col("cue_id")) % 5 == 0, F.coalesce(before, F.col("text"))).otherwise(F.col("text"))
    return d.cues(s, f).select("media_id", "cue_id", text.alias("text"))


def scored(s, f):
    """Reading speed as a score."""
    return d.cues(s, f).select("media_id", "cue_id", F.round((F.col("end_ms") - F.col("start_ms")) / (F.length("text") + 1), 6).alias("score"))


def checks(s, f):
    i = ql.media_summary(normalised(s, f), ql.readability_issues(normalised(s, f))).select("media_id", F.lit("readability").alias("check"), "status")
    t = ql.translation_checks(d.cues(s, f), d.translated_cues(s, f)).select("media_id", F.lit("translation").alias("check"), "status")
    o = d.cues(s, f).select("media_id").distinct().select("media_id", F.lit("realign").alias("check"), F.lit("SKIP").alias("status"))
    return i.unionByName(t).unionByName(o)


QUERIES = {
    "media_issue_summary": lambda s, f: ql.media_summary(normalised(s, f), ql.readability_issues(normalised(s, f))),
    "readability_issues": lambda s, f: ql.readability_issues(d.regressed_cues(s, f)),
    "overlap_issues": lambda s, f: ql.overlap_issues(d.cues(s, f)),
    "issue_counts": lambda s, f: ql.issue_counts(ql.readability_issues(d.regressed_cues(s, f))),
    "quality_gate": lambda s, f: ql.quality_gate(checks(s, f)),
    "boundary_duplicates": lambda s, f: ql.boundary_duplicates(d.cues(s, f)),
    "introduced_duplicates": lambda s, f: ql.introduced_duplicates(d.regressed_cues(s, f), d.cues(s, f)),
    "adjacent_duplicates": lambda s, f: ql.adjacent_duplicates(echoed(s, f)),
    "stage_metrics": lambda s, f: ql.stage_metrics(both_stages(s, f)),
    "stage_content_hash": lambda s, f: ql.content_hash(d.cues(s, f)),
    "worst_rows": lambda s, f: ql.worst_rows(scored(s, f), 3, "media_id"),
    "translation_checks": lambda s, f: ql.translation_checks(d.regressed_cues(s, f), d.translated_cues(s, f)),
}

ISSUES = """(SELECT media_id, cue_id, unnest(list_filter([
   CASE WHEN trim(text) = '' THEN {{'s': 'FAIL', 't': 'empty_text', 'a': NULL::BIGINT}} END,
   CASE WHEN dur <= 0 THEN {{'s': 'FAIL', 't': 'non_positive_duration', 'a': dur}} WHEN dur < 500 THEN {{'s': 'WARN', 't': 'ordinary_subtitle_too_fast', 'a': dur}} WHEN dur > 8000 THEN {{'s': 'WARN', 't': 'very_long_duration', 'a': dur}} END,
   CASE WHEN length(trim(text)) > 80 THEN {{'s': 'WARN', 't': 'long_text', 'a': length(trim(text))}} END,
   CASE WHEN pe - start_ms > 500 THEN {{'s': 'FAIL', 't': 'overlap', 'a': pe - start_ms}} WHEN pe - start_ms > 0 THEN {{'s': 'WARN', 't': 'overlap', 'a': pe - start_ms}} END], lambda x: x IS NOT NULL)) AS i
  FROM (SELECT *, end_ms - start_ms AS dur, lag(end_ms) OVER (PARTITION BY media_id ORDER BY cue_id) AS pe FROM {0}))"""
NORMALISED = """(SELECT media_id, cue_id, start_ms, CASE WHEN e4 - start_ms < 300 THEN least(start_ms + 300, coalesce(nxt, start_ms + 300)) ELSE e4 END AS end_ms, text FROM (
  SELECT *, CASE WHEN e3 > nxt THEN nxt ELSE e3 END AS e4 FROM (SELECT *, CASE WHEN e2 <= start_ms THEN end_ms ELSE e2 END AS e3 FROM (
      SELECT *, CASE WHEN nxt - e1 < 200 THEN nxt WHEN nxt - e1 <= 300 THEN greatest(end_ms, nxt - 300) ELSE e1 END AS e2 FROM (
        SELECT *, end_ms + 350 AS e1, lead(start_ms) OVER (PARTITION BY media_id ORDER BY start_ms, cue_id) AS nxt FROM cue)))))"""
SUMMARY = f"""(SELECT c.media_id, cues, coalesce(fails, 0) AS fails, coalesce(warns, 0) AS warns, CASE WHEN fails > 0 THEN 'FAIL' WHEN warns > 0 THEN 'WARN' ELSE 'PASS' END AS status
  FROM (SELECT media_id, count(*) AS cues FROM cue GROUP BY 1) c LEFT JOIN (
    SELECT media_id, count(*) FILTER (i.s = 'FAIL') AS fails, count(*) FILTER (i.s = 'WARN') AS warns FROM {ISSUES.format(NORMALISED)} GROUP BY 1) x ON x.media_id = c.media_id)"""
KEY = "regexp_replace(lower(text), '[^\\p{L}\\p{N}]', '', 'g')"
TRANSLATION = """(SELECT coalesce(a.media_id, b.media_id) AS media_id, count(*) FILTER (b.media_id IS NULL) AS missing, count(*) FILTER (a.media_id IS NOT NULL AND trim(translated) = '') AS blank,
  count(*) FILTER (a.media_id IS NULL) AS extra, count(*) FILTER (a.media_id IS NOT NULL AND b.media_id IS NOT NULL) AS shared
  FROM {0} a FULL JOIN translated b ON a.media_id = b.media_id AND a.cue_id = b.cue_id GROUP BY 1)"""
STATUS = "CASE WHEN missing + blank > 0 THEN 'FAIL' WHEN extra > 0 THEN 'WARN' ELSE 'PASS' END"

ORACLES = {
    "media_issue_summary": q("cue", f"SELECT * FROM {SUMMARY}"),
    "readability_issues": q("cue_b", f"SELECT media_id, cue_id, i.s AS severity, i.t AS type, i.a AS amount FROM {ISSUES.format('cue_b')}"),
    "overlap_issues": q("cue", f"SELECT media_id, cue_id, i.s AS severity, i.t AS type, i.a AS amount FROM {ISSUES.format('cue')} WHERE i.t = 'overlap'"),
    "issue_counts": q("cue_b", f"SELECT media_id, i.t AS type, count(*) FILTER (i.s = 'FAIL') AS fails, count(*) FILTER (i.s = 'WARN') AS warns, grouping(media_id, i.t)::BIGINT AS level FROM {ISSUES.format('cue_b')} GROUP BY ROLLUP (media_id, i.t)"),
    "quality_gate": q("cue translated", f"""SELECT media_id, count(*) FILTER (status NOT IN ('FAIL', 'WARN')) AS pass_count, count(*) FILTER (status = 'WARN') AS warn_count, count(*) FILTER (status = 'FAIL') AS fail_count,
  CASE WHEN bool_or(status = 'FAIL') THEN 'FAIL' WHEN bool_or(status = 'WARN') THEN 'WARN' ELSE 'PASS' END AS status FROM (
  SELECT media_id, status FROM {SUMMARY} UNION ALL SELECT media_id, {STATUS} FROM {TRANSLATION.format('cue')} UNION ALL SELECT DISTINCT media_id, 'SKIP' FROM cue) GROUP BY media_id"""),
    "boundary_duplicates": q("cue", f"""SELECT media_id, cue_id, CASE WHEN same THEN length(k) ELSE n END AS chars, same AS equal FROM (
  SELECT *, k = pk AND length(k) >= 2 AS same, coalesce(list_max(list_filter(range(1, 21), lambda x: x <= length(k) AND x <= length(pk) AND right(pk, x) = left(k, x))), 0) AS n FROM (
    SELECT *, lag(k) OVER w AS pk, lag(end_ms) OVER w AS pe FROM (SELECT *, {KEY} AS k FROM cue) WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, cue_id))
  WHERE pk IS NOT NULL AND start_ms - pe <= 500) WHERE same OR n >= CASE WHEN start_ms < pe THEN 2 ELSE 3 END"""),
    "introduced_duplicates": q("cue_b", """SELECT t.media_id, t.cue_id, nth FROM (SELECT *, lower(trim(text)) AS k, row_number() OVER (PARTITION BY media_id, lower(trim(text)) ORDER BY cue_id) AS nth FROM cue) t
  LEFT JOIN (SELECT media_id, lower(trim(text)) AS k, count(*) AS n FROM cue_b GROUP BY ALL) s ON s.media_id = t.media_id AND s.k = t.k WHERE nth > coalesce(n, 0)"""),
    "adjacent_duplicates": q("cue", f"""SELECT media_id, cue_id, k AS key FROM (SELECT *, lag(k) OVER (PARTITION BY media_id ORDER BY cue_id) AS pk FROM (
  SELECT media_id, cue_id, {KEY} AS k FROM (SELECT media_id, cue_id, CASE WHEN (media_id + cue_id) % 5 = 0 THEN coalesce(lag(text) OVER (PARTITION BY media_id ORDER BY cue_id), text) ELSE text END AS text FROM cue))) WHERE k = pk AND k <> ''"""),
    "stage_metrics": q("cue_b", f"""SELECT media_id, stage, count(*) AS items, sum(length(k))::BIGINT AS chars, count(*) FILTER (n = 1 AND k <> '') AS once, count(*) FILTER (end_ms <= start_ms) AS invalid_times,
  count(*) FILTER (start_ms < ps) AS non_monotonic, count(*) FILTER (k = pk AND k <> '') AS adjacent_duplicates FROM (
  SELECT *, count(*) OVER (PARTITION BY media_id, stage, k) AS n, lag(k) OVER w AS pk, lag(start_ms) OVER w AS ps FROM (
    SELECT *, {KEY} AS k FROM (SELECT *, 'A' AS stage FROM cue UNION ALL SELECT *, 'B' FROM cue_b)) WINDOW w AS (PARTITION BY media_id, stage ORDER BY cue_id)) GROUP BY media_id, stage"""),
    "stage_content_hash": q("cue", f"SELECT media_id, sha256(string_agg({KEY}, '' ORDER BY cue_id)) AS content FROM cue GROUP BY media_id"),
    "worst_rows": q("cue", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY score, cue_id) AS rank FROM (
  SELECT media_id, cue_id, round((end_ms - start_ms) / (length(text) + 1), 6) AS score FROM cue)) WHERE rank <= 3"""),
    "translation_checks": q("cue_b translated", f"SELECT *, {STATUS} AS status FROM {TRANSLATION.format('cue_b')}"),
}
