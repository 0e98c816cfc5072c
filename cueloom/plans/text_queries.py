"""Text, time-code, token and segment queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from cueloom.functions import text as tx
from cueloom.functions import timecode as tc
from cueloom.operators import intervals as iv
from cueloom.operators import segments as sg
from cueloom.operators import tokens as tk
from cueloom.sources import derived as d
from cueloom.sources.derived import with_tables as q

C = F.col


def keyed(s, f, *cols):
    return d.cues(s, f).select("media_id", "cue_id", *cols)


def previous_text():
    from pyspark.sql import Window

    return F.lag("text").over(Window.partitionBy("media_id").orderBy("cue_id"))


def echoed(s, f):
    """Each cue with a text that begins with the previous one's last two words."""
    c = d.cues(s, f).withColumn("previous", previous_text()).where("previous is not null")
    tail = F.array_join(F.slice(F.split("previous", " "), -2, 2), " ")
    return c.where(F.size(F.split("previous", " ")) >= 2).select("media_id", "cue_id", "previous", F.concat(tail, F.lit(" "), C("text")).alias("text"))


def cue_bounds(s, f):
    return d.cues(s, f).select("media_id", "cue_id", "start_ms", "end_ms")


def region_durations(s, f):
    return d.regions(s, f).groupBy("media_id").agg((F.max("end_ms") + 1000).alias("duration_ms"))


def cut(s, f):
    r = iv.merge_regions(d.regions(s, f)).select("media_id", "start_ms", "end_ms")
    return sg.cut_segments(r, iv.silences(d.regions(s, f), region_durations(s, f)))


QUERIES = {
    "norm_match": lambda s, f: keyed(s, f, tx.normalise(C("text"), "match").alias("key")),
    "norm_strict": lambda s, f: keyed(s, f, tx.normalise(C("text"), "strict").alias("key")),
    "norm_latin": lambda s, f: keyed(s, f, tx.norm_latin(C("text")).alias("key")),
    "norm_realign": lambda s, f: keyed(s, f, tx.normalise(C("text"), "realign").alias("key")),
    "norm_kana": lambda s, f: keyed(s, f, tx.norm_kana(C("text")).alias("key")),
    "norm_filler": lambda s, f: keyed(s, f, tx.norm_filler(C("text")).alias("key")),
    "norm_signal": lambda s, f: keyed(s, f, tx.norm_signal(C("text")).alias("key")),
    "norm_glossary": lambda s, f: keyed(s, f, tx.norm_glossary(C("text")).alias("key")),
    "script_metrics": lambda s, f: keyed(
        s, f, tx.count_words(C("text")).cast("long").alias("words"), tx.mainly_unspaced(C("text")).alias("unspaced"), tx.pure_punctuation(C("text")).alias("punctuation"), tx.has_kana(C("text")).alias("kana"), tx.mixed_language(C("text")).alias("mixed")
    ),
    "wrap_text": lambda s, f: keyed(s, f, tx.wrap_text(C("text")).alias("wrapped")),
    "boundary_trim": lambda s, f: echoed(s, f).select("media_id", "cue_id", tx.boundary_trim(C("previous"), C("text")).alias("text")),
    "clean_subtitle_text": lambda s, f: keyed(s, f, tx.clean_subtitle_text(F.concat(F.lit("  a b c  test at example . com ( x ) , "), C("text"))).alias("text")),
    "term_table": lambda s, f: keyed(s, f, tx.apply_term_table(C("text"), [("the", "THE", False), (r"\s+", " ", True), ("THE", "die", False)]).alias("text")),
    "time_formats": lambda s, f: keyed(s, f, tc.fmt_srt(C("start_ms")).alias("srt"), tc.fmt_vtt(C("start_ms")).alias("vtt"), tc.fmt_ass(C("start_ms")).alias("ass")),
    "time_round_trip": lambda s, f: keyed(s, f, tc.srt_ms(tc.fmt_srt(C("end_ms"))).alias("srt_ms"), tc.ass_ms(tc.fmt_ass(C("end_ms"))).alias("ass_ms")),
    "token_metrics": lambda s, f: tk.token_metrics(d.tokens(s, f)),
    "one_ms_runs": lambda s, f: tk.one_ms_runs(d.tokens(s, f).withColumn("end_ms", F.when(C("pos") % 5 < 2, C("start_ms") + 1).otherwise(C("end_ms")))),
    "local_max_cps": lambda s, f: tk.local_max_cps(d.tokens(s, f)).select("media_id", "cue_id", F.round("max_cps", 6).alias("max_cps")),
    "token_timing_error": lambda s, f: tk.token_timing_error(d.tokens(s, f), cue_bounds(s, f)),
    "alignment_health": lambda s, f: tk.alignment_health(tk.token_timing_error(d.tokens(s, f), cue_bounds(s, f)), d.tokens(s, f)),
    "segment_warnings": lambda s, f: sg.segment_warnings(d.segments(s, f)),
    "duration_profile": lambda s, f: sg.duration_profile(d.segments(s, f)),
    "fixed_windows": lambda s, f: sg.fixed_windows(d.segments(s, f)),
    "bucket_counts": lambda s, f: sg.bucket_counts(d.segments(s, f)),
    "plan_batches": lambda s, f: sg.plan_batches(d.segments(s, f)),
    "batch_profile": lambda s, f: sg.batch_profile(sg.plan_batches(d.segments(s, f)), d.segments(s, f)),
    "cut_segments": cut,
}

LATIN = "regexp_replace(replace(lower(text), 'ß', 'ss'), '[^\\p{L}\\p{N}]', '', 'g')"
FORMAT = "lpad((greatest({0}, 0) // 3600000)::VARCHAR, 2, '0') || ':' || lpad((greatest({0}, 0) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((greatest({0}, 0) // 1000 % 60)::VARCHAR, 2, '0') || '{1}' || lpad((greatest({0}, 0) % 1000)::VARCHAR, 3, '0')"
FILLER, SIGNAL = "[、。，．！？!?…・,.\\s　]", "[\\s　、。，．！？!?…・,.;:；：\"''“”‘’「」『』（）()\\[\\]【】]"
EDGES = "^[、。，．！？!?…・,.;:；：「」『』（）()【】]+|[、。，．！？!?…・,.;:；：「」『』（）()【】]+$"
ONE_MS = "(SELECT * REPLACE (CASE WHEN pos % 5 < 2 THEN start_ms + 1 ELSE end_ms END AS end_ms) FROM token)"
RUNS = """(SELECT media_id, cue_id, g, count(*) AS n FROM (
  SELECT *, sum(1 - f) OVER (PARTITION BY media_id, cue_id ORDER BY pos) AS g FROM (SELECT *, ({flag})::INT AS f FROM {table})) WHERE f = 1 GROUP BY ALL)"""
FRAMES = """(SELECT media_id, cue_id, pos, unnest(w) AS w FROM (SELECT media_id, cue_id, pos, [""" + ", ".join(
    f"{{'c': sum(length(trim(token))) OVER (o ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING), 'ms': max(end_ms) OVER (o ROWS BETWEEN CURRENT ROW AND {k} FOLLOWING) - start_ms}}" for k in range(12)
) + """] AS w FROM token WHERE trim(token) <> '' AND end_ms >= start_ms WINDOW o AS (PARTITION BY media_id, cue_id ORDER BY pos)))"""
ERRORS = f"""(SELECT c.media_id, c.cue_id, CASE WHEN n IS NULL THEN 'no_tokens' WHEN back THEN 'not_monotonic' WHEN ms > 0 AND coalesce(cov, 0) / ms < 0.2 THEN 'low_coverage' WHEN run > 8 THEN 'zero_run'
   WHEN ms > 0 AND zero * 2 >= n AND coalesce(cov, 0) / ms < 0.5 THEN 'zero_ratio' WHEN dense THEN 'local_density' ELSE 'ok' END AS error
  FROM (SELECT *, end_ms - start_ms AS ms FROM cue) c
  LEFT JOIN (SELECT media_id, cue_id, count(*) AS n, count(*) FILTER (end_ms <= start_ms) AS zero, bool_or(start_ms < p) AS back, max(end_ms) FILTER (end_ms > start_ms) - min(start_ms) FILTER (end_ms > start_ms) AS cov
    FROM (SELECT *, lag(start_ms) OVER (PARTITION BY media_id, cue_id ORDER BY pos) AS p FROM token) GROUP BY ALL) b USING (media_id, cue_id)
  LEFT JOIN (SELECT media_id, cue_id, max(n) AS run FROM {RUNS.format(flag='end_ms <= start_ms', table='token')} GROUP BY ALL) r USING (media_id, cue_id)
  LEFT JOIN (SELECT media_id, cue_id, bool_or(w.ms > 0 AND w.c >= 8 AND w.ms <= 500 AND w.c * 1000 >= w.ms * 35) AS dense FROM {FRAMES} GROUP BY ALL) d USING (media_id, cue_id))"""
BUCKET = "CASE WHEN duration_ms <= 15000 THEN '0-15s' WHEN duration_ms <= 30000 THEN '15-30s' WHEN duration_ms <= 60000 THEN '30-60s' WHEN duration_ms <= 120000 THEN '60-120s' ELSE '120s+' END"

ORACLES = {
    "norm_match": q("cue", f"SELECT media_id, cue_id, {LATIN} AS key FROM cue"),
    "norm_strict": q("cue", f"SELECT media_id, cue_id, {LATIN} AS key FROM cue"),
    "norm_latin": q("cue", f"SELECT media_id, cue_id, {LATIN} AS key FROM cue"),
    "norm_realign": q("cue", f"SELECT media_id, cue_id, {LATIN} AS key FROM cue"),
    "norm_kana": q("cue", f"SELECT media_id, cue_id, {LATIN} AS key FROM cue"),
    "norm_filler": q("cue", f"SELECT media_id, cue_id, regexp_replace(trim(text), '{FILLER}', '', 'g') AS key FROM cue"),
    "norm_signal": q("cue", f"SELECT media_id, cue_id, regexp_replace(text, '{SIGNAL}', '', 'g') AS key FROM cue"),
    "norm_glossary": q("cue", f"SELECT media_id, cue_id, regexp_replace(regexp_replace(text, '[\\s　]+', '', 'g'), '{EDGES}', '', 'g') AS key FROM cue"),
    "script_metrics": q("cue", """SELECT media_id, cue_id, len(list_filter(regexp_split_to_array(trim(text), '\\s+'), lambda w: regexp_matches(w, '[\\p{L}\\p{N}_]')))::BIGINT AS words, false AS unspaced,
  NOT regexp_matches(text, '[\\p{L}\\p{N}_]') AS punctuation, false AS kana, false AS mixed FROM cue"""),
    "boundary_trim": q("cue", """SELECT media_id, cue_id, array_to_string(string_split_regex(trim(text), '\\s+'), ' ') AS text FROM (
  SELECT *, lag(text) OVER (PARTITION BY media_id ORDER BY cue_id) AS p FROM cue) WHERE p IS NOT NULL AND len(string_split(p, ' ')) >= 2"""),
    "term_table": q("cue", "SELECT media_id, cue_id, replace(regexp_replace(replace(text, 'the', 'THE'), '\\s+', ' ', 'g'), 'THE', 'die') AS text FROM cue"),
    "time_formats": q("cue", f"""SELECT media_id, cue_id, {FORMAT.format('start_ms', ',')} AS srt, {FORMAT.format('start_ms', '.')} AS vtt,
  (start_ms // 3600000)::VARCHAR || ':' || lpad((start_ms // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((start_ms // 1000 % 60)::VARCHAR, 2, '0') || '.' || lpad((start_ms % 1000 // 10)::VARCHAR, 2, '0') AS ass FROM cue"""),
    "time_round_trip": q("cue", "SELECT media_id, cue_id, end_ms AS srt_ms, end_ms // 10 * 10 AS ass_ms FROM cue"),
    "token_metrics": q("token", """SELECT media_id, cue_id, count(*) AS tokens, count(*) FILTER (end_ms <= start_ms) AS zero, count(*) FILTER (end_ms - start_ms = 1) AS one_ms, count(*) FILTER (start_ms < p) AS non_monotonic, count(*) FILTER (end_ms - start_ms > 3000) AS long
  FROM (SELECT *, lag(start_ms) OVER (PARTITION BY media_id, cue_id ORDER BY pos) AS p FROM token) GROUP BY ALL"""),
    "one_ms_runs": q("token", f"SELECT media_id, cue_id, sum(n)::BIGINT AS one_ms, max(n) AS longest_run FROM {RUNS.format(flag='end_ms - start_ms = 1', table=ONE_MS)} GROUP BY ALL"),
    "local_max_cps": q("token", f"SELECT media_id, cue_id, round(max(CASE WHEN w.ms > 0 THEN w.c * 1000 / w.ms END), 6) AS max_cps FROM {FRAMES} GROUP BY ALL"),
    "token_timing_error": q("token", f"SELECT * FROM {ERRORS}"),
    "alignment_health": q("token", f"""SELECT *, CASE WHEN timing_errors > 0 THEN 'FAIL' WHEN clusters > 0 THEN 'WARN' ELSE 'PASS' END AS status FROM (
  SELECT e.media_id, count(*) AS segments, count(*) FILTER (error <> 'ok') AS timing_errors, count(k.cue_id) AS clusters FROM {ERRORS} e
  LEFT JOIN (SELECT media_id, cue_id FROM {RUNS.format(flag='end_ms - start_ms = 1', table='token')} GROUP BY ALL HAVING max(n) >= 3 OR sum(n) >= 5) k ON k.media_id = e.media_id AND k.cue_id = e.cue_id GROUP BY 1)"""),
    "segment_warnings": q("segment", """SELECT media_id, segments, long, near_limit, round(per_minute, 6) AS per_minute, array_to_string(list_filter([CASE WHEN long / segments >= 0.25 THEN 'many_long' END, CASE WHEN near_limit / segments >= 0.15 THEN 'many_near_limit' END,
   CASE WHEN per_minute > 4.0 THEN 'fragmented' END, CASE WHEN per_minute < 0.35 THEN 'sparse' END], lambda x: x IS NOT NULL), ',') AS warnings FROM (
  SELECT media_id, count(*) AS segments, count(*) FILTER (duration_ms >= 100000) AS long, count(*) FILTER (duration_ms >= 108000) AS near_limit, count(*) * 60000 / greatest(sum(duration_ms), 1) AS per_minute FROM segment GROUP BY 1)"""),
    "duration_profile": q("segment", """SELECT media_id, segments, p50, p75, p90, round(ls, 6) AS long_share, round(us, 6) AS ultra_share, profile, CASE profile WHEN 'long_form' THEN 3 WHEN 'mixed' THEN 4 ELSE 5 END AS batch_size,
  CASE profile WHEN 'long_form' THEN 300 WHEN 'mixed' THEN 260 ELSE 220 END AS target_s, CASE WHEN us >= 0.1 THEN 90 ELSE CASE profile WHEN 'long_form' THEN 90 WHEN 'mixed' THEN 95 ELSE 110 END END AS threshold_s FROM (
  SELECT *, CASE WHEN p50 >= 85000 OR ls >= 0.4 THEN 'long_form' WHEN p75 >= 75000 OR ls >= 0.2 THEN 'mixed' ELSE 'short_form' END AS profile FROM (
    SELECT media_id, count(*) AS segments, max(ms) FILTER (i = round_even((n - 1) * 0.5, 0)) AS p50, max(ms) FILTER (i = round_even((n - 1) * 0.75, 0)) AS p75, max(ms) FILTER (i = round_even((n - 1) * 0.9, 0)) AS p90, avg((ms >= 90000)::INT) AS ls, avg((ms >= 120000)::INT) AS us
    FROM (SELECT media_id, duration_ms AS ms, row_number() OVER (PARTITION BY media_id ORDER BY duration_ms) - 1 AS i, count(*) OVER (PARTITION BY media_id) AS n FROM segment) GROUP BY 1))"""),
    "fixed_windows": q("segment", """SELECT media_id, seg_idx, k + 1 AS "window", start_ms + k * 20000 AS start_ms, least(end_ms, start_ms + (k + 1) * 20000) AS end_ms FROM (
  SELECT *, unnest(range(greatest(1, ceil(duration_ms / 20000)::BIGINT))) AS k FROM segment)"""),
    "bucket_counts": q("segment", f"SELECT {BUCKET} AS bucket, count(*) AS segments, sum(duration_ms)::BIGINT AS total_ms, min(duration_ms) AS min_ms, max(duration_ms) AS max_ms FROM segment GROUP BY 1"),
    "plan_batches": q("segment", f"""SELECT media_id, seg_idx, bucket, batch::BIGINT AS batch, singleton FROM (WITH RECURSIVE s AS (SELECT media_id, seg_idx, duration_ms AS ms, {BUCKET} AS bucket, duration_ms >= 90000 AS long, row_number() OVER (PARTITION BY media_id, {BUCKET} ORDER BY seg_idx) AS i FROM segment),
  b AS (SELECT media_id, bucket, i, seg_idx, 1 AS batch, CASE WHEN long THEN 5 ELSE 1 END AS items, ms AS total, long AS singleton FROM s WHERE i = 1
    UNION ALL SELECT s.media_id, s.bucket, s.i, s.seg_idx, CASE WHEN s.long OR b.items >= 5 OR b.total + s.ms > 220000 THEN b.batch + 1 ELSE b.batch END,
      CASE WHEN s.long THEN 5 WHEN b.items >= 5 OR b.total + s.ms > 220000 THEN 1 ELSE b.items + 1 END, CASE WHEN s.long OR b.items >= 5 OR b.total + s.ms > 220000 THEN s.ms ELSE b.total + s.ms END, s.long
    FROM b JOIN s ON s.media_id = b.media_id AND s.bucket = b.bucket AND s.i = b.i + 1) SELECT * FROM b)"""),
    "batch_profile": None,
    "wrap_text": q("cue", """SELECT media_id, cue_id, array_to_string(list_slice(lines, 1, 2), chr(10)) AS wrapped FROM (SELECT media_id, cue_id, list_append(r.lines, r.line) AS lines FROM (
  SELECT media_id, cue_id, list_reduce(list_transform(string_split_regex(trim(text), '\\s+'), lambda w: {'lines': []::VARCHAR[], 'line': w}),
    lambda acc, x: CASE WHEN length(acc.line || ' ' || x.line) <= 42 THEN {'lines': acc.lines, 'line': acc.line || ' ' || x.line} ELSE {'lines': list_append(acc.lines, acc.line), 'line': x.line} END) AS r FROM cue))"""),
}
ORACLES["batch_profile"] = ORACLES["plan_batches"].replace("SELECT media_id, seg_idx, bucket, batch::BIGINT AS batch, singleton FROM (WITH", """SELECT media_id, count(*) AS batches, max(items) AS max_items, max(ms)::BIGINT AS max_ms, count(*) FILTER (singleton) AS singletons FROM (
  SELECT b.media_id, bucket, batch, count(*) AS items, sum(duration_ms) AS ms, bool_or(singleton) AS singleton FROM (WITH""") + " b JOIN segment g ON g.media_id = b.media_id AND g.seg_idx = b.seg_idx GROUP BY ALL) GROUP BY media_id"
