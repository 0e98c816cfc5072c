"""Queries on similar words, suspects and glossaries, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions.text import norm_match
from cueloom.operators import fuzzy as fz
from cueloom.operators import suspects as su
from cueloom.sources import derived as d
from cueloom.sources import glossary as gl
from cueloom.sources.derived import with_tables as q

C = F.col


def word_keys(c, name):
    """The distinct words of eight characters or more."""
    return c.select("media_id", F.explode(F.split("text", r"\s+")).alias("w")).select("media_id", norm_match(C("w")).alias(name)).where(F.length(name) >= 8).distinct()


def quality_rows(s, f):
    """What a comparison of both stages says: shortened cues by their key, late ones by their time, and the next cue besides."""
    j = d.cues(s, f).select("media_id", "cue_id", C("start_ms").alias("s"), C("text").alias("t")).join(d.regressed_cues(s, f), ["media_id", "cue_id"])
    short, late = C("text") != C("t"), C("start_ms") != C("s")
    types = F.array_compact(F.array(F.when(short, "ass_low_score"), F.when(late, "ass_short_dialogue_timing_shifted")))
    return j.where(short | late).select("media_id", C("cue_id").alias("row_no"), "start_ms", "end_ms", F.when(~late, C("cue_id")).alias("key"), F.when(short, C("cue_id") + 1).alias("extra_key"), types.alias("types"), F.concat(F.lit("row "), C("cue_id").cast("string")).alias("reason"))


def marked(s, f):
    cues = d.cues(s, f).select("media_id", "cue_id", "start_ms", "end_ms", F.array().cast("array<string>").alias("types"), F.lit("").alias("reason"), F.lit(None).cast("double").alias("confidence"))
    return su.apply_suspects(cues, quality_rows(s, f)).withColumn("types", F.array_join("types", ","))


def glossaries(s, f):
    """A glossary file of each media file, in one of two layouts: words of the line and of its translation."""
    t = d.translated_cues(s, f).select("media_id", "cue_id", *(F.regexp_replace(F.element_at(F.split(c, r"\s+"), 1), r'[",]', "").alias(n) for c, n in (("text", "source"), ("translated", "target"))))
    line = F.when(C("media_id") % 2 == 0, F.concat_ws(",", F.lit("names"), "source", "target", F.lit("of a line"))).otherwise(F.concat_ws(",", "source", F.lit("between"), "target", "source"))
    head = F.when(C("media_id") % 2 == 0, F.lit("group,source,target,note")).otherwise(F.lit("日文,x,中文,备注"))
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_id", line.alias("line")))), lambda x: x["line"]), "\n")
    files = t.groupBy("media_id").agg(rows.alias("rows")).select(F.concat(F.lit("file:/in/m"), C("media_id").cast("string"), F.lit(".csv")).alias("path"), F.concat(head, F.lit("\n"), "rows").alias("content"))
    return gl.glossary_entries(files)


QUERIES = {
    "similar_words": lambda s, f: fz.similar_pairs(word_keys(d.cues(s, f), "key"), word_keys(d.regressed_cues(s, f), "r_key")).withColumn("similarity", F.round("similarity", 9)),
    "apply_suspects": marked,
    "glossary_entries": glossaries,
}

DISTANCE = "CASE WHEN least(c.end_ms, r.end_ms) > greatest(c.start_ms, r.start_ms) THEN 0 WHEN c.end_ms <= r.start_ms THEN r.start_ms - c.end_ms ELSE c.start_ms - r.end_ms END"

ORACLES = {
    "apply_suspects": q("cue cue_b", f""", r AS (
  SELECT b.media_id, b.cue_id AS row_no, b.start_ms, b.end_ms, CASE WHEN b.start_ms = a.start_ms THEN b.cue_id END AS key, CASE WHEN a.text <> b.text THEN b.cue_id + 1 END AS extra,
    list_filter([CASE WHEN a.text <> b.text THEN 'ass_low_score' END, CASE WHEN a.start_ms <> b.start_ms THEN 'ass_short_dialogue_timing_shifted' END], lambda x: x IS NOT NULL) AS types
  FROM cue a JOIN cue_b b ON a.media_id = b.media_id AND a.cue_id = b.cue_id WHERE a.text <> b.text OR a.start_ms <> b.start_ms),
near AS (SELECT r.media_id, row_no, c.cue_id, types FROM r JOIN cue c ON c.media_id = r.media_id WHERE key IS NULL AND {DISTANCE} <= 8000 QUALIFY row_number() OVER (PARTITION BY r.media_id, row_no ORDER BY {DISTANCE}, c.cue_id) = 1),
m AS (SELECT DISTINCT media_id, row_no, cue_id, types FROM (SELECT media_id, row_no, key AS cue_id, types FROM r WHERE key IS NOT NULL UNION ALL SELECT * FROM near UNION ALL SELECT r.media_id, row_no, extra, types FROM r JOIN cue c ON c.media_id = r.media_id AND c.cue_id = extra)),
x AS (SELECT *, list_distinct(flatten(list(types) OVER (PARTITION BY media_id, cue_id ORDER BY row_no))) AS upto FROM m),
g AS (SELECT media_id, cue_id, string_agg('row ' || row_no, '; ' ORDER BY row_no) AS reason, bool_or(upto = ['ass_low_score']) AS hear, bool_or(list_contains(upto, 'ass_short_dialogue_timing_shifted')) AS realign,
  bool_or(list_contains(types, 'ass_low_score')) AS low, min(row_no) FILTER (list_contains(types, 'ass_low_score')) AS lo, min(row_no) FILTER (list_contains(types, 'ass_short_dialogue_timing_shifted')) AS hi FROM x GROUP BY ALL)
SELECT media_id, cue_id, start_ms, end_ms, CASE WHEN lo IS NULL AND hi IS NULL THEN '' WHEN hi IS NULL THEN 'ass_low_score' WHEN lo IS NULL THEN 'ass_short_dialogue_timing_shifted'
    WHEN lo <= hi THEN 'ass_low_score,ass_short_dialogue_timing_shifted' ELSE 'ass_short_dialogue_timing_shifted,ass_low_score' END AS types, coalesce(reason, '') AS reason,
  CASE WHEN hear THEN 0.25::DOUBLE END AS confidence, coalesce(hear, false) AS asr_suspect, coalesce(hear, false) AS needs_audio_review, coalesce(realign, false) AS needs_realign FROM cue LEFT JOIN g USING (media_id, cue_id)"""),
    "glossary_entries": q("translated", """SELECT * EXCLUDE (media_id, cue_id) FROM (
  SELECT media_id, cue_id, CASE WHEN media_id % 2 = 0 THEN 'names' ELSE '日文' END AS "group", a AS source, b AS target, CASE WHEN media_id % 2 = 0 THEN 'of a line' ELSE '' END AS note FROM (
    SELECT media_id, cue_id, trim(regexp_replace(string_split_regex(text, '\\s+')[1], '[",]', '', 'g')) AS a, trim(regexp_replace(string_split_regex(translated, '\\s+')[1], '[",]', '', 'g')) AS b FROM translated) WHERE a <> '' AND b <> '')
QUALIFY row_number() OVER (PARTITION BY "group", source, target ORDER BY 'file:/in/m' || media_id || '.csv', cue_id) = 1"""),
}
