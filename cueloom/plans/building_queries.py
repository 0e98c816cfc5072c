"""Queries from aligned tokens to cues and files, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from cueloom.functions.text import norm_strict
from cueloom.operators import building as bd
from cueloom.operators import splitting as sp
from cueloom.operators import timing as tm
from cueloom.operators import tokens as tk
from cueloom.plans.text_queries import ERRORS, cue_bounds
from cueloom.sources import derived as d
from cueloom.sources import subtitles as sb
from cueloom.sources.derived import with_tables as q

C = F.col


def plain_pieces(s, f):
    """Tokens as a recogniser writes them: lower case, no punctuation."""
    return d.tokens(s, f).select("media_id", "cue_id", "pos", norm_strict(C("token")).alias("text"), "start_ms", "end_ms").where("text <> ''")


def timed_pieces(s, f):
    own = tm.owned_bounds(d.cues(s, f)).select("media_id", "cue_id", C("own_start").alias("owned_start"), C("own_end").alias("owned_end"))
    return d.tokens(s, f).withColumnRenamed("token", "text").join(own, ["media_id", "cue_id"])


def token_errors(s, f):
    return tk.token_timing_error(d.tokens(s, f), cue_bounds(s, f))


def built(s, f):
    """Cues of all tokens, in order, and the segments without use."""
    segments = cue_bounds(s, f).withColumn("status", F.lit("completed"))
    return bd.tokens_to_cues(segments, d.tokens(s, f), d.cues(s, f).select("media_id", "cue_id", "text"), token_errors(s, f))


def windowed(s, f):
    """The tokens of each cue in windows of six, the later windows first."""
    t = d.tokens(s, f).withColumn("window", (-F.floor(C("pos") / 6)).cast("int"))
    return bd.merge_window_alignments(t, d.cues(s, f).select("media_id", "cue_id", "text"), token_errors(s, f))


def words(s, f):
    return d.tokens(s, f).select("media_id", F.row_number().over(Window.partitionBy("media_id").orderBy("cue_id", "pos")).cast("long").alias("pos"), C("token").alias("text"), "start_ms", "end_ms")


def subtitles(s, f):
    """Files of subtitles from aligned segments: cues, lines, smoothing, display timing."""
    cues, _ = built(s, f)
    order = Window.partitionBy("media_id").orderBy("cue_id", "pos")
    tokens = cues.select("media_id", F.row_number().over(order).cast("long").alias("pos"), "text", "start_ms", "end_ms")
    return sb.to_srt(tm.normalize_timing(sp.smooth_cues(sp.rule_split(tokens))).withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))))


QUERIES = {
    "repair_ranges": lambda s, f: bd.repair_ranges(timed_pieces(s, f)),
    "restore_surface": lambda s, f: bd.restore_surface(plain_pieces(s, f), d.cues(s, f).select("media_id", "cue_id", "text")),
    "boundary_repeats": lambda s, f: bd.drop_boundary_repeats(plain_pieces(s, f), cue_bounds(s, f)).select("media_id", "cue_id", "pos", "text"),
    "tokens_to_cues": lambda s, f: built(s, f)[0],
    "merge_windows": lambda s, f: windowed(s, f).select("media_id", "cue_id", "accepted", "reason", F.array_join(F.transform("tokens", lambda t: t["text"]), " ").alias("said"), F.element_at("tokens", -1)["end_ms"].alias("end_ms")),
    "rule_split": lambda s, f: sp.rule_split(words(s, f)),
    "smooth_cues": lambda s, f: sp.smooth_cues(sp.rule_split(words(s, f))),
    "subtitles_from_tokens": subtitles,
}

NORM = "regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}]', '', 'g')"
OWN = """o AS (SELECT media_id, cue_id, start_ms AS cs, end_ms AS ce, CASE WHEN pe > start_ms THEN (pe + start_ms) // 2 ELSE start_ms END AS a, CASE WHEN end_ms > ns THEN (end_ms + ns) // 2 ELSE end_ms END AS b
  FROM (SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns FROM cue WINDOW w AS (PARTITION BY media_id ORDER BY cue_id)))"""
#: Pieces ``p(media_id, cue_id, pos, text, s, e, a, b)``, repaired one after the other.
REPAIRED = """h AS (SELECT *, count(*) OVER c AS n, row_number() OVER (PARTITION BY media_id, cue_id ORDER BY pos) AS i, greatest(b, a + 1, a + count(*) OVER c) AS z FROM p WINDOW c AS (PARTITION BY media_id, cue_id)),
g AS (SELECT *, CASE WHEN e > s THEN greatest(a, least(s, z - 1)) END AS gs, CASE WHEN e > s THEN greatest(greatest(a, least(s, z - 1)) + 1, least(e, z)) END AS ge FROM h),
j AS (SELECT *, max(CASE WHEN gs IS NOT NULL THEN i END) OVER (PARTITION BY media_id, cue_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pi,
  min(CASE WHEN gs IS NOT NULL THEN i END) OVER (PARTITION BY media_id, cue_id ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ni FROM g),
k AS (SELECT j.*, y.ge AS le, x.gs AS rs FROM j LEFT JOIN g x ON x.media_id = j.media_id AND x.cue_id = j.cue_id AND x.i = j.ni LEFT JOIN g y ON y.media_id = j.media_id AND y.cue_id = j.cue_id AND y.i = j.pi),
f AS (
  SELECT media_id, cue_id, 0::BIGINT AS i, any_value(a)::BIGINT AS c1, any_value(a)::BIGINT AS s2, any_value(a)::BIGINT AS c2 FROM h GROUP BY media_id, cue_id
  UNION ALL
  SELECT media_id, cue_id, i, e1, greatest(c2, least(s1, latest - 1)), greatest(greatest(c2, least(s1, latest - 1)) + 1, least(e1, latest)) FROM (
    SELECT media_id, cue_id, i, c2, coalesce(gs, c1) AS s1, greatest(c2 + 1, z - (n - i)) AS latest, coalesce(ge, CASE WHEN rs - le BETWEEN coalesce(ni, n + 1) - coalesce(pi, 0) - 1 AND 800
      THEN c1 + greatest(1, round_even((rs - c1)::DOUBLE / (coalesce(ni, n + 1) - i), 0)::BIGINT) ELSE greatest(c1 + 1, least(c1 + 160, coalesce(rs, z) - (coalesce(ni, n + 1) - i) + 1)) END) AS e1
    FROM (SELECT k.*, f.c1, f.c2 FROM k JOIN f ON f.media_id = k.media_id AND f.cue_id = k.cue_id AND k.i = f.i + 1)))"""
#: Pieces ``v(media_id, cue_id, pos, text, norm)`` of segments in order, with the number ``gone`` of first pieces that repeat the text before.
REPEATS = """vn AS (SELECT media_id, cue_id, list(norm ORDER BY pos) AS norms FROM v GROUP BY ALL),
vs AS (SELECT *, coalesce(lag(end_ms) OVER w > start_ms, false) AS over, row_number() OVER w AS i FROM vn JOIN cue USING (media_id, cue_id) WINDOW w AS (PARTITION BY media_id ORDER BY cue_id)),
vd AS (
  SELECT media_id, cue_id, i, 0::BIGINT AS gone, array_to_string(norms, '') AS previous FROM vs WHERE i = 1
  UNION ALL
  SELECT media_id, cue_id, i, gone, CASE WHEN array_to_string(norms[gone + 1:], '') = '' THEN previous ELSE array_to_string(norms[gone + 1:], '') END FROM (
    SELECT vs.media_id, vs.cue_id, vs.i, norms, previous, CASE WHEN over AND previous <> '' AND norms[1] <> '' THEN coalesce(list_max(list_filter(range(1, least(40, len(norms)) + 1),
      lambda n: length(array_to_string(norms[1:n], '')) <= 80 AND ends_with(previous, array_to_string(norms[1:n], '')))), 0) ELSE 0 END::BIGINT AS gone
    FROM vs JOIN vd ON vd.media_id = vs.media_id AND vs.i = vd.i + 1))"""
SURFACES = f"""(SELECT media_id, cue_id, pos, substr(text, CASE WHEN begun = 0 THEN 1 ELSE places[begun + 1] END, coalesce(places[begun + n + 1], length(text) + 1) - CASE WHEN begun = 0 THEN 1 ELSE places[begun + 1] END) AS text FROM (
  SELECT t.*, c.text, length(norm) AS n, (sum(length(norm)) OVER (PARTITION BY t.media_id, t.cue_id ORDER BY pos) - length(norm))::BIGINT AS begun, places
  FROM (SELECT media_id, cue_id, pos, {NORM.format("token")} AS norm FROM token) t
  JOIN (SELECT media_id, cue_id, text, flatten(list_transform(range(1, length(text) + 1), lambda i: list_transform(range(length({NORM.format("text[i]")})), lambda x: i))) AS places FROM cue) c USING (media_id, cue_id) WHERE norm <> ''))"""
SAME = f"""(SELECT media_id, cue_id, string_agg({NORM.format("token")}, '' ORDER BY pos) = any_value({NORM.format("cue.text")}) AND bool_and({NORM.format("token")} <> '') AS ok FROM token JOIN cue USING (media_id, cue_id) WHERE trim(token) <> '' GROUP BY ALL)"""


def recursive(names: str, body: str) -> str:
    return q(names, body).replace("WITH ", "WITH RECURSIVE ", 1)


ORACLES = {
    "repair_ranges": recursive("cue token", f""", {OWN}, p AS (SELECT media_id, cue_id, pos, token AS text, start_ms AS s, end_ms AS e, a, greatest(b, a + 1) AS b FROM token JOIN o USING (media_id, cue_id)), {REPAIRED}
SELECT media_id, cue_id, pos, s2 AS start_ms, c2 AS end_ms FROM f JOIN h USING (media_id, cue_id, i)"""),
    "restore_surface": q("cue token", f"SELECT media_id, cue_id, pos, s.text, start_ms, end_ms FROM {SURFACES} s JOIN token USING (media_id, cue_id, pos)"),
    "boundary_repeats": recursive("cue token", f""", v AS (SELECT * FROM (SELECT media_id, cue_id, pos, {NORM.format("token")} AS norm FROM token) WHERE norm <> ''), {REPEATS}
SELECT media_id, cue_id, pos, norm AS text FROM (SELECT *, row_number() OVER (PARTITION BY media_id, cue_id ORDER BY pos) AS nth FROM v) JOIN vd USING (media_id, cue_id) WHERE nth > gone"""),
    "tokens_to_cues": recursive("cue token", f""", {OWN}, r AS (SELECT o.*, error = 'ok' AND coalesce(ok, false) AS use, error = 'ok' AS sound FROM o JOIN {ERRORS} USING (media_id, cue_id) LEFT JOIN {SAME} USING (media_id, cue_id)),
w AS (SELECT media_id, cue_id, pos, CASE WHEN use THEN s.text ELSE trim(token) END AS text, t.start_ms AS s, t.end_ms AS e, a, b FROM token t JOIN r USING (media_id, cue_id) LEFT JOIN {SURFACES} s USING (media_id, cue_id, pos) WHERE sound AND trim(token) <> ''
  UNION ALL SELECT media_id, cue_id, 0, trim(text), a, greatest(b, a + 1), a, b FROM cue JOIN r USING (media_id, cue_id) WHERE NOT sound AND trim(text) <> ''),
v AS (SELECT *, {NORM.format("text")} AS norm FROM w), {REPEATS},
p AS (SELECT media_id, cue_id, pos, text, s, e, a, greatest(b, a + 1) AS b FROM (SELECT *, row_number() OVER (PARTITION BY media_id, cue_id ORDER BY pos) AS nth FROM v) JOIN vd USING (media_id, cue_id) WHERE nth > gone), {REPAIRED},
m AS (SELECT h.*, s2, c2, row_number() OVER (PARTITION BY h.media_id ORDER BY h.cue_id, h.pos) AS x FROM f JOIN h USING (media_id, cue_id, i)),
l AS (SELECT *, max(greatest(c2, s2 + 1) - x) OVER (PARTITION BY media_id ORDER BY x) + x AS stop FROM m)
SELECT media_id, cue_id, pos, greatest(s2, coalesce(lag(stop) OVER (PARTITION BY media_id ORDER BY x), s2)) AS start_ms, stop AS end_ms, text, CASE WHEN sound THEN 'tokens' ELSE 'transcript' END AS source FROM l JOIN r USING (media_id, cue_id)"""),
    "merge_windows": q("cue token", f"""SELECT media_id, cue_id, reason IS NULL AS accepted, reason, CASE WHEN reason IS NULL THEN said END AS said, CASE WHEN reason IS NULL THEN last END AS end_ms FROM (
  SELECT *, CASE WHEN said IS NULL THEN 'no_tokens' WHEN {NORM.format("said")} <> {NORM.format("text")} THEN 'text_differs' WHEN error <> 'ok' THEN error END AS reason
  FROM (SELECT media_id, cue_id, text FROM cue) LEFT JOIN (SELECT media_id, cue_id, string_agg(token, ' ' ORDER BY start_ms, -(pos // 6), pos) AS said, arg_max(end_ms, (start_ms, -(pos // 6), pos)) AS last FROM token WHERE trim(token) <> '' GROUP BY ALL) USING (media_id, cue_id)
  LEFT JOIN {ERRORS} USING (media_id, cue_id))"""),
}
