"""File format and journal queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.sources import derived as d
from cueloom.sources import subtitles as sb
from cueloom.sources.derived import with_tables as q
from cueloom.streaming import journal as jn

C = F.col


def one_line(c):
    return c.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " ")))


def events(s, f):
    e = d.read(s, f, "events")
    return e.select(C("event_type").alias("type"), C("user_id").alias("segment_id"), C("event_id").alias("seq"), "value", C("ts").cast("timestamp").alias("at"))


def edits(s, f):
    e = d.read(s, f, "events")
    return e.select(C("user_id").alias("cue_id"), C("event_id").alias("revision"), F.when(C("event_id") % 3 == 2, "undo").otherwise("edit").alias("action"), "value")


QUERIES = {
    "srt_round_trip": lambda s, f: sb.parse_srt(sb.to_srt(one_line(d.cues(s, f)))),
    "srt_files": lambda s, f: sb.to_srt(one_line(d.cues(s, f))),
    "vtt_files": lambda s, f: sb.to_vtt(one_line(d.cues(s, f))),
    "srt_legality": lambda s, f: sb.srt_legality(sb.to_srt(one_line(d.regressed_cues(s, f)))),
    "ass_round_trip": lambda s, f: sb.parse_ass(sb.to_ass(d.dialogues(s, f))),
    "manifest_round_trip": lambda s, f: sb.read_cue_manifest(sb.to_cue_manifest(d.translated_cues(s, f)), "translated"),
    "compact_journal": lambda s, f: jn.compact_journal(events(s, f)),
    "journal_progress": lambda s, f: jn.progress(events(s, f)),
    "journal_rates": lambda s, f: jn.rates(events(s, f)).select(F.unix_micros("start").alias("start_us"), "type", "events"),
    "journal_sessions": lambda s, f: jn.sessions(events(s, f), "12 hours").select("segment_id", F.unix_micros("start").alias("start_us"), "events"),
    "journal_checked": lambda s, f: jn.checked(events(s, f), events(s, f).groupBy("type").agg((F.max("value") - 20).alias("most"))).select("segment_id", "seq", "type"),
    "review_state": lambda s, f: jn.review_state(edits(s, f)),
}

LINE = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
CLOCK = "lpad((greatest({0}, 0) // 3600000)::VARCHAR, 2, '0') || ':' || lpad((greatest({0}, 0) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((greatest({0}, 0) // 1000 % 60)::VARCHAR, 2, '0') || '{1}' || lpad((greatest({0}, 0) % 1000)::VARCHAR, 3, '0')"
NUMBERED = f"(SELECT *, {LINE} AS line, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, cue_id) AS n FROM cue)"

ORACLES = {
    "srt_round_trip": q("cue", f"SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, cue_id) AS cue_id, start_ms, end_ms, {LINE} AS text FROM cue"),
    "srt_files": q("cue", f"SELECT media_id, string_agg(n || chr(10) || {CLOCK.format('start_ms', ',')} || ' --> ' || {CLOCK.format('end_ms', ',')} || chr(10) || line, chr(10) || chr(10) ORDER BY n) || chr(10) AS content FROM {NUMBERED} GROUP BY media_id"),
    "vtt_files": q("cue", f"SELECT media_id, 'WEBVTT' || chr(10) || chr(10) || string_agg({CLOCK.format('start_ms', '.')} || ' --> ' || {CLOCK.format('end_ms', '.')} || chr(10) || line, chr(10) || chr(10) ORDER BY n) || chr(10) AS content FROM {NUMBERED} GROUP BY media_id"),
    "srt_legality": q("cue_b", "SELECT media_id, n - 1 AS block, 'overlap' AS issue FROM (SELECT *, row_number() OVER w AS n, lag(end_ms) OVER w AS pe FROM cue_b WINDOW w AS (PARTITION BY media_id ORDER BY start_ms, cue_id)) WHERE start_ms < pe"),
    "ass_round_trip": q("dialogue", "SELECT media_id, line_id, start_ms // 10 * 10 AS start_ms, end_ms // 10 * 10 AS end_ms, style, trim(replace(text, chr(10), ' ')) AS text FROM dialogue"),
    "manifest_round_trip": q("translated", "SELECT media_id, 'translated' AS stage, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, cue_id) AS cue_id, start_ms, end_ms, text, translated FROM translated"),
    "compact_journal": "SELECT user_id AS segment_id, arg_max(event_type, event_id) AS type, arg_max(value, event_id) AS value, max(event_id) AS seq, min(event_id) AS first_seq, count(*) AS events FROM events GROUP BY 1",
    "journal_progress": "SELECT event_type AS type, count(*) AS total, count(*) FILTER (value >= 100) AS done, count(*) FILTER (value < 10) AS failed FROM events GROUP BY 1",
    "journal_rates": "SELECT epoch_us(ts) // 3600000000 * 3600000000 AS start_us, event_type AS type, count(*) AS events FROM events GROUP BY ALL",
    "journal_sessions": """SELECT segment_id, min(u) AS start_us, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY segment_id ORDER BY u) AS g FROM (
  SELECT user_id AS segment_id, epoch_us(ts) AS u, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) > 43200000000 THEN 1 ELSE 0 END AS new FROM events)) GROUP BY segment_id, g""",
    "journal_checked": "SELECT user_id AS segment_id, event_id AS seq, event_type AS type FROM events JOIN (SELECT event_type, max(value) - 20 AS most FROM events GROUP BY 1) USING (event_type) WHERE value > most",
    "review_state": """SELECT cue_id, arg_max(value, revision) FILTER (stands) AS value, max(revision) AS revision, count(*) FILTER (step = 1) AS edits, least(count(*) FILTER (stands), 100) AS undo_depth FROM (
  SELECT *, step = 1 AND total <= min(total) OVER (PARTITION BY cue_id ORDER BY revision DESC) AS stands FROM (
    SELECT *, sum(step) OVER (PARTITION BY cue_id ORDER BY revision) AS total FROM (SELECT user_id AS cue_id, event_id AS revision, value, CASE WHEN event_id % 3 = 2 THEN -1 ELSE 1 END AS step FROM events))) GROUP BY cue_id""",
}
