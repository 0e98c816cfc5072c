"""Queries on what stages keep, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueloom.functions.text import norm_strict
from cueloom.operators import conservation as cv
from cueloom.sources import derived as d
from cueloom.sources.derived import with_tables as q

C = F.col


def lines(c):
    """Sentences of a stage, in order."""
    parts = F.posexplode(F.split("text", r"\.\s*")).alias("n", "line")
    return c.select("media_id", "cue_id", parts).select("media_id", (C("cue_id") * 1000 + C("n")).alias("pos"), F.trim("line").alias("line")).where("line <> ''")


def word_answers(s, f):
    """Every fifth word of a cue as an answer that must stay apart."""
    return d.tokens(s, f).where("end_ms > start_ms and pos % 5 = 2").select("media_id", "start_ms", "end_ms", C("token").alias("text"))


def common(s, f):
    j = d.cues(s, f).select("media_id", "cue_id", C("text").alias("a")).join(d.regressed_cues(s, f).select("media_id", "cue_id", C("text").alias("b")), ["media_id", "cue_id"])
    return j.select("media_id", "cue_id", cv.common_substring_len(F.reverse("a"), F.reverse("b")).cast("long").alias("chars"))


def neighbours_common(s, f):
    """Of each word and the next one of its cue."""
    after = F.lead("token").over(Window.partitionBy("media_id", "cue_id").orderBy("pos"))
    t = d.tokens(s, f).select("media_id", "cue_id", "pos", F.lower("token").alias("a"), F.lower(F.coalesce(after, F.lit(""))).alias("b"))
    return t.select("media_id", "cue_id", "pos", cv.common_substring_len(C("a"), C("b")).cast("long").alias("chars"))


QUERIES = {
    "align_lists": lambda s, f: cv.align_lists(lines(d.cues(s, f)), lines(d.regressed_cues(s, f))),
    "stage_anchors": lambda s, f: cv.anchors(d.cues(s, f), d.regressed_cues(s, f)),
    "stage_retention": lambda s, f: cv.stage_retention(d.cues(s, f), d.regressed_cues(s, f)),
    "content_conservation": lambda s, f: cv.content_conservation(d.cues(s, f), d.regressed_cues(s, f), ("split", "proofread"), responses=("de", "la", "the", "und")),
    "text_occurrences": lambda s, f: cv.occurs_in(d.tokens(s, f).select("media_id", "token").distinct().select("media_id", norm_strict(C("token")).alias("key")), d.regressed_cues(s, f)),
    "protect_answers": lambda s, f: cv.protect_answers(d.cues(s, f), word_answers(s, f)),
    "common_substring": common,
    "neighbours_common_substring": neighbours_common,
}

NORM = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"


def once(table, name):
    return f"(SELECT media_id, any_value(cue_id) AS {name}, key FROM (SELECT media_id, cue_id, {NORM.format('text')} AS key FROM {table}) WHERE length(key) >= 8 GROUP BY media_id, key HAVING count(*) = 1)"


ORACLES = {
    "stage_anchors": q("cue cue_b", f"""SELECT media_id, a, b, length(key) AS chars FROM (SELECT *, max(b) OVER (PARTITION BY media_id ORDER BY a ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS m,
  min(b) OVER (PARTITION BY media_id ORDER BY a ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS l FROM {once("cue", "a")} JOIN {once("cue_b", "b")} USING (media_id, key)) WHERE (m IS NULL OR m < b) AND (l IS NULL OR l > b)"""),
    "text_occurrences": q("cue cue_b token", f"""SELECT DISTINCT media_id, key FROM (SELECT DISTINCT media_id, {NORM.format("token")} AS key FROM token) w
JOIN (SELECT media_id, string_agg({NORM.format("text")}, '' ORDER BY cue_id) AS whole FROM cue_b GROUP BY media_id) USING (media_id) WHERE length(key) BETWEEN 1 AND 12 AND contains(whole, key)"""),
    "common_substring": q("cue cue_b", "SELECT media_id, cue_id, length(b.text) AS chars FROM cue JOIN cue_b b USING (media_id, cue_id)"),
    "neighbours_common_substring": q("token", """SELECT media_id, cue_id, pos, coalesce(list_max(list_transform(range(1, length(a) + 1), lambda i: len(list_filter(range(1, length(a) - i + 2), lambda n: contains(b, substr(a, i, n)))))), 0)::BIGINT AS chars
  FROM (SELECT media_id, cue_id, pos, lower(token) AS a, lower(coalesce(lead(token) OVER (PARTITION BY media_id, cue_id ORDER BY pos), '')) AS b FROM token)"""),
}
