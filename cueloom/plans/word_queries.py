"""Word queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.operators import words as wd
from cueloom.sources import derived as d
from cueloom.sources.derived import with_tables as q


def first_words(c):
    return c.withColumn("text", F.element_at(F.split("text", " "), 1))


QUERIES = {
    "split_words": lambda s, f: wd.split_words(d.cues(s, f)),
    "word_level": lambda s, f: wd.word_level(d.cues(s, f).withColumn("text", F.when(F.col("media_id") % 2 == 0, F.element_at(F.split("text", " "), 1)).otherwise(F.col("text")))),
    "word_quality": lambda s, f: wd.word_quality(wd.split_words(d.cues(s, f)).withColumn("word", F.when(F.col("pos") % 50 == 49, "<unk>").otherwise(F.col("word")))),
    "group_tokens": lambda s, f: wd.group_tokens(d.tokens(s, f)),
    "pair_responses": lambda s, f: wd.pair_responses(first_words(d.cues(s, f)), first_words(d.regressed_cues(s, f))),
}

WORDS = """(SELECT media_id, cue_id, pos, word, least(end_ms, start_ms + upto - ms) AS start_ms, least(end_ms, start_ms + upto) AS end_ms FROM (
  SELECT *, (sum(ms) OVER (PARTITION BY media_id, cue_id ORDER BY pos))::BIGINT AS upto FROM (
    SELECT *, floor((end_ms - start_ms) / greatest(sum(u) OVER (PARTITION BY media_id, cue_id), 1) * u)::BIGINT AS ms FROM (
      SELECT media_id, cue_id, start_ms, end_ms, w AS word, i - 1 AS pos, ceil(length(w) / 4)::BIGINT AS u FROM (
        SELECT *, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, regexp_extract_all(text, '[a-zA-Z\\x{00c0}-\\x{017f}'']+|[0-9]+') AS ws FROM cue))))))"""

ORACLES = {
    "split_words": q("cue", f"SELECT * FROM {WORDS}"),
    "word_level": q("cue", "SELECT media_id, avg((len(list_filter(string_split_regex(trim(CASE WHEN media_id % 2 = 0 THEN string_split(text, ' ')[1] ELSE text END), '\\s+'), lambda x: x <> '')) = 1)::INT) >= 0.8 AS word_level FROM cue GROUP BY media_id"),
    "word_quality": q("cue", f"""SELECT *, known > 0 AND unknown = 0 AS usable FROM (SELECT media_id, cue_id, count(*) AS words, count(*) FILTER (end_ms > start_ms) AS timed, count(*) FILTER (pos % 50 = 49) AS unknown,
  count(*) FILTER (end_ms > start_ms AND pos % 50 <> 49) AS known FROM {WORDS} GROUP BY ALL)"""),
}
