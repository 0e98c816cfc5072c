"""Queries on what stages leave in their folders, with their SQL. Files are made of the given tables and read back."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueloom.functions.timecode import fmt_srt
from cueloom.plans.rule_queries import TO_KANA, kana
from cueloom.sources import derived as d
from cueloom.sources import workdirs as wd
from cueloom.sources.derived import with_tables as q

C = F.col


def in_order(key, item):
    """The items of a group as an array, by ``key``."""
    return F.transform(F.array_sort(F.collect_list(F.struct(key, item.alias("x")))), lambda p: p["x"])


def joined(c):
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def transcripts(s, f):
    return d.cues(s, f).select("media_id", C("cue_id").alias("segment_id"), "start_ms", "end_ms", "text", F.when(C("role") == "system", "failed").otherwise("completed").alias("status"))


def segment_lists(s, f):
    files = wd.to_segment_list(transcripts(s, f)).select("media_id", F.concat(F.lit("﻿"), "content").alias("content"))
    return wd.read_segments(files).drop("tokens")


def raw_tokens(s, f):
    """An aligner's output for each cue: words, or an array of objects with tokens, times counted from the cue's start."""
    t = d.tokens(s, f)
    a, b = (C("start_ms") - C("cue_start")) / 1000, (C("end_ms") - C("cue_start")) / 1000
    g = t.groupBy("media_id", "cue_id", "cue_start").agg(in_order("pos", F.struct(C("token").alias("word"), a.alias("start"), b.alias("end"))).alias("w"), in_order("pos", F.struct("token", a.alias("start_time"), b.alias("end_time"))).alias("t"))
    content = F.when(C("cue_id") % 2 == 0, F.to_json(F.struct(C("w").alias("words")))).otherwise(F.to_json(F.array(F.struct(C("t").alias("tokens")))))
    return wd.globalise_tokens(g.select("media_id", C("cue_id").alias("seg_idx"), C("cue_start").alias("offset_ms"), content.alias("content")))


def word_files(s, f):
    """A file for each media file: every other one has words in its segments."""
    t = d.tokens(s, f).groupBy("media_id", "cue_id").agg(in_order("pos", F.struct(C("token").alias("word"), (C("start_ms") / 1000).alias("start"), (C("end_ms") / 1000).alias("end"))).alias("words"))
    c = d.cues(s, f).join(t, ["media_id", "cue_id"])
    one = F.struct("text", (C("start_ms") / 1000).alias("start"), (C("end_ms") / 1000).alias("end"), F.when(C("media_id") % 2 == 0, C("words")).alias("words"))
    return wd.flatten_word_json(c.groupBy("media_id").agg(F.to_json(F.struct(in_order("cue_id", one).alias("segments"))).alias("content")))


def srt_of(rows, order):
    """files(media_id, content) of rows(media_id, start_ms, end_ms, body)."""
    block = F.concat(fmt_srt(C("start_ms")), F.lit(" --> "), fmt_srt(C("end_ms")), F.lit("\n"), "body")
    g = rows.groupBy("media_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, block.alias("x")))), lambda p, i: F.concat((i + 1).cast("string"), F.lit("\n"), p["x"])).alias("b"))
    return g.select("media_id", F.array_join("b", "\n\n").alias("content"))


def karaoke(s, f):
    """A block for each word, lit between its neighbours; in every third media file nothing is lit."""
    w = Window.partitionBy("media_id", "cue_id").orderBy("pos")
    lit = F.concat(F.lit("<i>"), F.coalesce(F.lag("token").over(w), F.lit("")), F.lit("</i> <font color='#fff'>"), F.replace("token", F.lit("an"), F.lit("&quot;an")), F.lit("</font> "), F.coalesce(F.lead("token").over(w), F.lit("")))
    body = F.when(C("media_id") % 3 == 0, F.concat(F.lit("<b>"), "token", F.lit("</b>"))).otherwise(lit)
    return wd.parse_karaoke_srt(srt_of(d.tokens(s, f).withColumn("body", body), ["cue_id", "pos"]))


def bilingual(s, f):
    """A kana and a Latin line in every other file, two Latin lines in the others."""
    body = F.concat(joined(F.when(C("media_id") % 2 == 0, kana(C("text"))).otherwise(C("text"))), F.lit("\n"), joined("text"))
    return wd.parse_bilingual_srt(srt_of(d.cues(s, f).withColumn("body", body), ["cue_id"]))


def texts(s, f):
    """Each completed text begins with the last two words of the one before."""
    t = transcripts(s, f).withColumn("text", joined("text"))
    before = F.lag("text").over(Window.partitionBy("media_id", "status").orderBy("segment_id"))
    tail = F.array_join(F.slice(F.split(before, " "), F.greatest(F.size(F.split(before, " ")) - 1, F.lit(1)), F.lit(2)), " ")
    return wd.plain_text(t.select("media_id", C("segment_id").alias("seg_idx"), F.concat_ws(" ", tail, "text").alias("text"), "status"))


def paths(s, f):
    kind = F.when(C("l_linestatus") == "F", F.when(C("l_returnflag") == "A", ".MP3").otherwise(".mp3")).otherwise(F.when(C("l_tax") > 0.07, ".txt").otherwise(".ass"))
    name = F.concat(F.lit("/in/show # 0"), C("l_partkey").cast("string"), F.lit(" part "), C("l_orderkey").cast("string"), F.lit("-"), C("l_linenumber").cast("string"), kind)
    return wd.discover_pairs(d.read(s, f, "lineitem").select(name.alias("path")), "part")


def reports(s, f):
    c, b = d.cues(s, f), d.regressed_cues(s, f)
    j = c.select("media_id", "cue_id", C("start_ms").alias("s")).join(b, ["media_id", "cue_id"])
    return wd.union_issues({"short": c.where(F.length("text") < 90).select("media_id", "cue_id", F.length("text").alias("chars")), "late": j.where("start_ms > s").select("media_id", "cue_id", (C("start_ms") - C("s")).alias("late_ms"))})


QUERIES = {
    "segment_lists": segment_lists,
    "globalise_tokens": raw_tokens,
    "flatten_word_json": word_files,
    "karaoke_srt": karaoke,
    "bilingual_srt": bilingual,
    "plain_text": texts,
    "discover_pairs": paths,
    "union_issues": reports,
}

LONGER = "CASE WHEN end_ms > start_ms THEN end_ms ELSE start_ms + 20 END AS end_ms"
LINE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"
PATH = "'/in/show # 0' || l_partkey || ' part ' || l_orderkey || '-' || l_linenumber || "

ORACLES = {
    "segment_lists": q("cue", "SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, cue_id) AS seg_idx, cue_id::VARCHAR AS segment_id, start_ms, end_ms, text, CASE WHEN role = 'system' THEN 'failed' ELSE 'completed' END AS status FROM cue"),
    "globalise_tokens": q("token", "SELECT media_id, cue_id AS seg_idx, pos, token, start_ms, end_ms FROM token"),
    "flatten_word_json": q("token", f"""SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY cue_id, pos) AS pos, token AS text, start_ms, {LONGER} FROM token WHERE media_id % 2 = 0 AND trim(token) <> ''
UNION ALL SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY cue_id), text, start_ms, end_ms FROM cue WHERE media_id % 2 = 1"""),
    "karaoke_srt": q("token", rf"""SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY cue_id, pos) AS pos,
  CASE WHEN media_id % 3 = 0 THEN replace(t, chr(10), ' ') ELSE replace(t, 'an', '"an') END AS text, start_ms, {LONGER} FROM (SELECT *, regexp_replace(token, '^\s+|\s+$', '', 'g') AS t FROM token) WHERE t <> ''"""),
    "bilingual_srt": q("cue", f"""SELECT media_id, row_number() OVER (PARTITION BY media_id ORDER BY start_ms, cue_id) AS cue_id, start_ms, end_ms, CASE WHEN media_id % 2 = 0 THEN {LINE.format(TO_KANA.format('text'))} ELSE line || ' ' || line END AS text, CASE WHEN media_id % 2 = 0 THEN line ELSE '' END AS translated
FROM (SELECT *, {LINE.format('text')} AS line FROM cue)"""),
    "plain_text": q("cue", f"SELECT media_id, string_agg({LINE.format('text')}, chr(10) ORDER BY cue_id) || chr(10) AS content FROM cue WHERE role <> 'system' GROUP BY 1"),
    "discover_pairs": f"""SELECT l_partkey AS episode, max({PATH} CASE WHEN l_returnflag = 'A' THEN '.MP3' ELSE '.mp3' END) FILTER (l_linestatus = 'F') AS media_path, max({PATH} '.ass') FILTER (l_linestatus <> 'F' AND NOT l_tax > 0.07) AS script_path
FROM lineitem GROUP BY 1 HAVING media_path IS NOT NULL AND script_path IS NOT NULL""",
    "union_issues": q("cue cue_b", """SELECT media_id, cue_id, length(text) AS chars, 'short' AS report, NULL::BIGINT AS late_ms FROM cue WHERE length(text) < 90
UNION ALL SELECT b.media_id, b.cue_id, NULL, 'late', b.start_ms - a.start_ms FROM cue a JOIN cue_b b ON a.media_id = b.media_id AND a.cue_id = b.cue_id WHERE b.start_ms > a.start_ms"""),
}
