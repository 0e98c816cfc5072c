"""Review queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.operators import quality as ql
from cueloom.operators import review as rv
from cueloom.plans.quality_queries import ISSUES
from cueloom.sources import derived as d
from cueloom.sources.derived import with_tables as q

C = F.col


def token_texts(s, f):
    """Each cue's words as one text again."""
    t = d.tokens(s, f).groupBy("media_id", "cue_id").agg(F.array_sort(F.collect_list(F.struct("pos", "token"))).alias("t"))
    return t.select("media_id", "cue_id", rv.token_text(F.transform("t", lambda x: x["token"])).alias("text"))


def speeds(s, f):
    c = d.cues(s, f)
    return c.select("media_id", "cue_id", rv.per_second(F.length("text"), C("start_ms"), C("end_ms")).alias("chars_per_second"), rv.per_second(F.size(F.split("text", " ")), C("start_ms"), C("start_ms") + (C("end_ms") - C("start_ms")) * (C("cue_id") % 2)).alias("words_per_second"))


def issues(s, f):
    return ql.readability_issues(d.regressed_cues(s, f))


def candidates(s, f):
    c = d.regressed_cues(s, f)
    placed = issues(s, f).join(c.select("media_id", "cue_id", "start_ms"), ["media_id", "cue_id"])
    late = c.where((C("media_id") + C("cue_id") - 1) % 17 == 0).select("media_id", "cue_id", "start_ms", F.lit("INFO").alias("severity"), F.lit("late").alias("type"))
    return rv.union_candidates({"readability": placed, "timing": late})


def suspects(s, f):
    """Suspect types, a flag and a confidence for every cue, by rule."""
    n = C("media_id") + C("cue_id")
    names = F.array(F.lit("timing"), F.lit("wording"), F.lit("speaker"))
    return d.cues(s, f).select(
        "media_id", "cue_id", (n % 9 == 0).alias("flagged"), F.slice(names, 1, (n % 3).cast("int")).alias("types"), F.slice(names, 2, (n % 2 + 1).cast("int")).alias("more"), ((n * 37 % 100) / 100.0).alias("confidence")
    )


def added(s, f):
    return suspects(s, f).select("media_id", "cue_id", F.array_join(rv.diagnostics_added(C("types"), C("more"), ["speaker", "wording"]), ",").alias("added"))


def recovery(s, f):
    t = d.tokens(s, f).groupBy("media_id", "cue_id").agg(F.count("*").alias("tokens"), F.count_if(C("end_ms") <= C("start_ms")).alias("zero_tokens"), (F.sum(C("end_ms") - C("start_ms")) / F.max(C("cue_end") - C("cue_start"))).alias("coverage"))
    rows = d.cues(s, f).select("media_id", "cue_id", "text").join(t, ["media_id", "cue_id"])
    return rv.recovery_reasons(rows).select("media_id", "cue_id", F.array_join("reasons", ",").alias("reasons"))


def tasks(s, f):
    k = C("l_partkey") % 10
    return d.read(s, f, "lineitem").select(C("l_suppkey").alias("batch"), F.when(k == 0, "failed").when(k < 3, "skipped").otherwise("succeeded").alias("status"))


QUERIES = {
    "token_text": token_texts,
    "reading_speed": speeds,
    "sentence_groups": lambda s, f: rv.sentence_groups(d.tokens(s, f)).select("media_id", "cue_id", "pos", "grp"),
    "merge_cues": lambda s, f: rv.merge_cues(d.cues(s, f), F.floor((C("cue_id") - 1) / 3)),
    "join_by_segment": lambda s, f: rv.join_by_segment(d.cues(s, f), d.regressed_cues(s, f)).select("media_id", "cue_id", "text", "r_text", "r_start_ms"),
    "compare_runs": lambda s, f: rv.compare_runs(d.cues(s, f), d.regressed_cues(s, f)),
    "diagnostics_added": added,
    "union_candidates": candidates,
    "rank_candidates": lambda s, f: rv.rank_candidates(candidates(s, f).unionByName(candidates(s, f).withColumns({"report": F.lit("again"), "report_rank": F.lit(9)})), 4),
    "capped_samples": lambda s, f: rv.capped_samples(issues(s, f), 2).select("media_id", "cue_id", "type", "n", "total"),
    "suspect_types": lambda s, f: rv.suspect_types(suspects(s, f)).select("media_id", "cue_id", F.array_join("types", ",").alias("types")),
    "review_candidates": lambda s, f: rv.review_candidates(suspects(s, f)),
    "recovery_reasons": recovery,
    "batch_summary": lambda s, f: rv.status_summary(tasks(s, f), "batch", ["succeeded", "failed", "skipped"]),
}

SUSPECT = """suspect AS (SELECT media_id, cue_id, (media_id + cue_id) % 9 = 0 AS flagged, ['timing', 'wording', 'speaker'][1:(media_id + cue_id) % 3] AS types,
  ['wording', 'speaker'][1:(media_id + cue_id) % 2 + 1] AS more, ((media_id + cue_id) * 37 % 100) / 100.0::DOUBLE AS confidence FROM cue)"""
CANDIDATES = f"""(SELECT i.media_id, i.cue_id, start_ms, i.i.s AS severity, i.i.t AS type, 'readability' AS report, 0 AS report_rank FROM {ISSUES.format('cue_b')} i JOIN cue_b USING (media_id, cue_id)
  UNION ALL SELECT media_id, cue_id, start_ms, 'INFO', 'late', 'timing', 1 FROM cue_b WHERE (media_id + cue_id - 1) % 17 = 0)"""
ORDER = "CASE severity WHEN 'FAIL' THEN 1 WHEN 'WARN' THEN 2 ELSE 3 END, report_rank, start_ms, cue_id, type"


def suspect_sql(body: str) -> str:
    return q("cue", body).replace("\nSELECT", f",\n{SUSPECT}\nSELECT", 1)


ORACLES = {
    "token_text": q("token", "SELECT media_id, cue_id, string_agg(token, ' ' ORDER BY pos) AS text FROM token GROUP BY ALL"),
    "reading_speed": q("cue", "SELECT media_id, cue_id, CASE WHEN end_ms > start_ms THEN length(text) * 1000.0::DOUBLE / (end_ms - start_ms) ELSE 0.0 END AS chars_per_second, CASE WHEN end_ms > start_ms AND cue_id % 2 = 1 THEN len(string_split(text, ' ')) * 1000.0::DOUBLE / (end_ms - start_ms) ELSE 0.0 END AS words_per_second FROM cue"),
    "sentence_groups": q("token", "SELECT media_id, cue_id, pos, (coalesce(sum(regexp_matches(token, '[.!?…。！？]$')::INT) OVER (PARTITION BY media_id, cue_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::BIGINT AS grp FROM token"),
    "merge_cues": q("cue", "SELECT media_id, (cue_id - 1) // 3 AS grp, min(start_ms) AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY cue_id) AS text, count(*) AS cues FROM cue GROUP BY 1, 2"),
    "join_by_segment": q("cue_b", "SELECT a.media_id, a.cue_id, a.text, b.text AS r_text, b.start_ms AS r_start_ms FROM cue a LEFT JOIN cue_b b ON a.media_id = b.media_id AND a.cue_id = b.cue_id"),
    "compare_runs": q("cue_b", """SELECT *, added = 0 AND gone = 0 AND changed = 0 AS same FROM (SELECT a.media_id, 0::BIGINT AS added, count(*) FILTER (b.media_id IS NULL) AS gone, count(*) FILTER (b.text <> a.text) AS changed
  FROM cue a LEFT JOIN cue_b b ON a.media_id = b.media_id AND a.cue_id = b.cue_id GROUP BY a.media_id)"""),
    "diagnostics_added": suspect_sql("SELECT media_id, cue_id, array_to_string(list_filter(more, lambda x: NOT list_contains(types, x)), ',') AS added FROM suspect"),
    "union_candidates": q("cue_b", f"SELECT * FROM {CANDIDATES}"),
    "rank_candidates": q("cue_b", f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY {ORDER}) AS rank FROM {CANDIDATES}) WHERE rank <= 4"),
    "capped_samples": q("cue_b", f"SELECT * FROM (SELECT media_id, cue_id, i.t AS type, row_number() OVER (PARTITION BY media_id, i.t ORDER BY cue_id) AS n, count(*) OVER (PARTITION BY media_id, i.t) AS total FROM {ISSUES.format('cue_b')}) WHERE n <= 2"),
    "suspect_types": suspect_sql("SELECT media_id, cue_id, array_to_string(list_concat(types, list_filter(more, lambda x: NOT list_contains(types, x))), ',') AS types FROM suspect"),
    "review_candidates": suspect_sql("SELECT * FROM (SELECT media_id, cue_id, CASE WHEN flagged THEN 'flagged' WHEN len(list_filter(types, lambda x: x <> 'timing')) > 0 THEN 'type' WHEN confidence < 0.75 THEN 'confidence' END AS reason FROM suspect) WHERE reason IS NOT NULL"),
    "recovery_reasons": q("token", """SELECT * FROM (SELECT media_id, cue_id, array_to_string(list_filter([CASE WHEN length(regexp_replace(text, '[^\\p{L}\\p{N}]', '', 'g')) <= 4 THEN 'short_response' END, CASE WHEN tokens = 0 THEN 'no_tokens' END,
  CASE WHEN zero > 0 THEN 'zero_duration_token' END, CASE WHEN coverage < 0.5 THEN 'low_coverage' END], lambda x: x IS NOT NULL), ',') AS reasons FROM cue JOIN (
    SELECT media_id, cue_id, count(*) AS tokens, count(*) FILTER (end_ms <= start_ms) AS zero, sum(end_ms - start_ms)::DOUBLE / max(cue_end - cue_start) AS coverage FROM token GROUP BY ALL) USING (media_id, cue_id)) WHERE reasons <> ''"""),
    "batch_summary": """SELECT *, CASE WHEN failed > 0 THEN 'FAIL' WHEN succeeded < total THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT l_suppkey AS batch, count(*) AS total, count(*) FILTER (l_partkey % 10 >= 3) AS succeeded,
  count(*) FILTER (l_partkey % 10 = 0) AS failed, count(*) FILTER (l_partkey % 10 IN (1, 2)) AS skipped FROM lineitem GROUP BY 1)""",
}
