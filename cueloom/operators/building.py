"""From aligned tokens to cues: usable ranges, the transcript's own surface, repeats at boundaries.

A piece is one token of a segment: pieces(media_id, cue_id, pos, text, start_ms, end_ms);
cue_id is the segment. All steps but one are windows over a segment.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import norm_strict
from cueloom.operators.timing import owned_bounds

SEGMENT = ("media_id", "cue_id")

#: Answers that are narrowed when they last too long.
SHORT_RESPONSES = ("はい", "うん", "ううん", "え", "あ", "いや", "いいえ", "だめ", "ダメ")


def _interpolated(gap: Column, count: Column, upto: Column) -> Column:
    """Where the first ``upto`` of ``count`` steps across ``gap`` end, each step being the rest over the steps left, halves rounded to even.

    With gap = q * count + m, the steps are all q (or all q + 1, if 2 m > count)
    until what is left is exactly half a step too many; then q and q + 1 take turns, the even one first.
    """
    q, m = F.expr("gap div count"), gap % count
    even = F.abs(count - 2 * m)
    turns = F.greatest(upto - even, F.lit(0))
    longer = F.when(2 * m > count, F.least(upto, even)).otherwise(0)
    return upto * q + longer + F.floor((turns + F.when(q % 2 == 1, 1).otherwise(0)) / 2)


def repair_ranges(pieces: DataFrame, interpolate_ms: int = 800, step_ms: int = 160) -> DataFrame:
    """media_id, cue_id, pos, start_ms, end_ms of ``pieces(..., owned_start, owned_end)``: every piece lasts 1 ms at least, in order, inside the owned range.

    A run of pieces without duration is spread over the gap between its
    neighbours if that is at most ``interpolate_ms`` and 1 ms a piece at least; else its pieces take
    ``step_ms`` each from the left neighbour on, as far as there is room. The owned range
    is taken to hold a millisecond for each piece.
    """
    whole = Window.partitionBy(*SEGMENT)
    order = whole.orderBy("pos")
    past, ahead = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    p = pieces.withColumn("i", F.row_number().over(order)).withColumn("n", F.count("*").over(whole))
    p = p.withColumn("stop", F.greatest("owned_end", F.col("owned_start") + F.col("n")))
    good = F.col("end_ms") > F.col("start_ms")
    p = p.withColumn("s", F.when(good, F.greatest("owned_start", F.least("start_ms", F.col("stop") - 1))))
    p = p.withColumn("e", F.when(good, F.greatest(F.col("s") + 1, F.least("end_ms", "stop"))))
    p = p.select(
        "*", F.last("e", True).over(past).alias("left"), F.first("s", True).over(ahead).alias("right"),
        F.coalesce(F.last(F.when(good, F.col("i")), True).over(past), F.lit(0)).alias("before"), F.coalesce(F.first(F.when(good, F.col("i")), True).over(ahead), F.col("n") + 1).alias("after"),
    )
    p = p.withColumn("count", F.col("after") - F.col("before") - 1).withColumn("t", F.col("i") - F.col("before")).withColumn("gap", F.col("right") - F.col("left"))
    across = (F.col("gap") >= F.col("count")) & (F.col("gap") <= interpolate_ms)
    base = F.coalesce("left", "owned_start")
    room = F.coalesce("right", "stop") - F.col("count") + 1
    stepped = lambda t: F.when(t > 0, F.greatest(base + 1, F.least(base + 1 + (step_ms - 1) * t, room)) + t - 1).otherwise(base)
    at = lambda t: F.when(F.coalesce(across, F.lit(False)), F.col("left") + _interpolated(F.col("gap"), F.col("count"), t)).otherwise(stepped(t))
    p = p.withColumn("s", F.coalesce("s", at(F.col("t") - 1))).withColumn("e", F.coalesce("e", at(F.col("t"))))
    latest = F.col("stop") - F.col("n") + F.col("i")
    p = p.withColumn("latest", latest).withColumn("v", F.least("e", "latest") - F.col("i"))
    p = p.withColumn("end2", F.greatest(F.col("owned_start"), F.max("v").over(order.rowsBetween(Window.unboundedPreceding, 0))) + F.col("i"))
    start = F.greatest(F.coalesce(F.lag("end2").over(order), F.col("owned_start")), F.least("s", F.col("latest") - 1))
    return p.select(*SEGMENT, "pos", start.cast("long").alias("start_ms"), F.col("end2").cast("long").alias("end_ms"))


def narrow_responses(pieces: DataFrame, responses: tuple = SHORT_RESPONSES, long_ms: int = 3000, least_ms: int = 500, most_ms: int = 900, char_ms: int = 160) -> DataFrame:
    """Known short answers that last more than ``long_ms`` keep 500 to 900 ms about their middle, by their length."""
    norm = norm_strict(F.col("text"))
    p = pieces.withColumn("norm", norm)
    ms = F.col("end_ms") - F.col("start_ms")
    wanted = F.least(F.lit(most_ms), F.greatest(F.lit(least_ms), F.length("norm") * char_ms))
    first = F.col("start_ms") + F.floor(ms / 2) - F.floor(wanted / 2)
    cut = F.col("norm").isin(*responses) & (F.length("norm") <= 4) & (ms > long_ms)
    return p.withColumns({"start_ms": F.when(cut, first).otherwise(F.col("start_ms")), "end_ms": F.when(cut, first + wanted).otherwise(F.col("end_ms"))}).drop("norm")


def restore_surface(pieces: DataFrame, transcripts: DataFrame) -> DataFrame:
    """``pieces`` with the text that ``transcripts(media_id, cue_id, text)`` has for them, punctuation and spaces included.

    Each character of a transcript is normalised and placed by the normalised
    characters before it; the piece that begins last at or before this place owns it, and
    characters that vanish belong to the piece before them (leading ones to the first). Where normalised pieces and transcript
    differ, a piece is empty or a character crosses a boundary, the whole segment keeps its pieces.
    """
    seg = Window.partitionBy(*SEGMENT)
    order = seg.orderBy("pos")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    upto = lambda n: F.coalesce(F.sum(n).over(before), F.lit(0))
    p = pieces.withColumn("norm", norm_strict(F.col("text"))).withColumn("at", upto(F.length("norm"))).withColumn("stop", F.col("at") + F.length("norm"))
    chars = transcripts.select(*SEGMENT, F.posexplode(F.split("text", "")).alias("pos", "char"))
    chars = chars.withColumn("norm", norm_strict(F.col("char"))).withColumn("at", upto(F.length("norm")))

    nothing = F.lit(None)
    both = p.select(*SEGMENT, "at", "stop", F.col("pos").alias("piece"), F.col("pos").cast("int").alias("pos"), F.lit(0).alias("kind"), F.col("norm").alias("norm"), F.lit("").alias("char")).unionByName(
        chars.select(*SEGMENT, "at", nothing.cast("long").alias("stop"), nothing.cast("long").alias("piece"), F.col("pos").cast("int").alias("pos"), F.lit(1).alias("kind"), "norm", "char")
    )
    # a piece comes before the characters that begin where it does; a character that vanishes comes after the one before it, which begins earlier
    place = seg.orderBy("at", F.when(F.col("kind") == 1, F.when(F.col("norm") == "", 0).otherwise(2)).otherwise(1), "pos")
    upto_here = place.rowsBetween(Window.unboundedPreceding, 0)
    both = both.withColumn("owner", F.last("piece", True).over(upto_here)).withColumn("fits", F.last("stop", True).over(upto_here) >= F.col("at") + F.length("norm"))
    both = both.withColumn("owner", F.coalesce("owner", F.min("piece").over(seg)))
    text = lambda kind, field: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("pos", field)))), lambda x: x[field]), "")
    sound = both.groupBy(*SEGMENT).agg((text(0, "norm") == text(1, "norm")).alias("same"), F.bool_and((F.col("kind") == 0) | F.coalesce("fits", F.lit(True)) | (F.col("norm") == "")).alias("whole"), F.bool_and((F.col("kind") == 1) | (F.col("norm") != "")).alias("full"))
    surface = both.where("kind = 1").groupBy(*SEGMENT, F.col("owner").alias("pos")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "char"))), lambda x: x["char"]), "").alias("surface"))
    ok = sound.where("same and whole and full").select(*SEGMENT)
    found = surface.join(ok, list(SEGMENT))
    return pieces.join(found, [*SEGMENT, "pos"], "left").withColumn("text", F.coalesce("surface", "text")).drop("surface")


def drop_boundary_repeats(pieces: DataFrame, segments: DataFrame, most_pieces: int = 40, most_chars: int = 80) -> DataFrame:
    """``pieces`` without those that repeat the end of the segment before, where ``segments(media_id, cue_id, start_ms, end_ms)`` overlap.

    The longest run of first pieces (40 pieces, 80 characters at most) goes whose normalised text ends the text before. What counts is
    what is left of that text, so overlapping segments in a row are taken together; a segment that overlaps none begins anew.
    """
    media = Window.partitionBy("media_id").orderBy("cue_id")
    norm = pieces.withColumn("norm", norm_strict(F.col("text")))
    texts = norm.groupBy(*SEGMENT).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "norm"))), lambda x: x["norm"]).alias("norms"))
    s = segments.select(*SEGMENT, "start_ms", "end_ms").join(texts, list(SEGMENT))
    s = s.withColumn("over", F.coalesce(F.lag("end_ms").over(media) > F.col("start_ms"), F.lit(False)))
    s = s.withColumn("chain", F.sum(F.when(F.col("over"), 0).otherwise(1)).over(media))

    @F.pandas_udf("array<int>")
    def dropped(chains: pd.Series) -> pd.Series:
        def one(chain):
            out, previous = [], ""
            for k, norms in enumerate(chain):
                best, prefix = 0, ""
                for count, piece in enumerate(norms[:most_pieces] if k and previous else [], 1):
                    prefix += piece
                    if not prefix or len(prefix) > most_chars:
                        break
                    best = count if previous.endswith(prefix) else best
                out.append(best)
                previous = "".join(norms[best:]) or previous
            return out

        return chains.map(one)

    chains = s.groupBy("media_id", "chain").agg(F.array_sort(F.collect_list(F.struct("cue_id", "norms"))).alias("rows")).where("size(rows) > 1")
    cut = chains.select("media_id", F.explode(F.arrays_zip(F.transform("rows", lambda x: x["cue_id"]).alias("cue_id"), dropped(F.transform("rows", lambda x: x["norms"])).alias("gone"))).alias("x"))
    cut = cut.select("media_id", "x.cue_id", "x.gone").where("gone > 0")
    nth = F.row_number().over(Window.partitionBy(*SEGMENT).orderBy("pos"))
    return pieces.withColumn("nth", nth).join(cut, list(SEGMENT), "left").where("gone is null or nth > gone").drop("nth", "gone")


def tokens_to_cues(segments: DataFrame, tokens: DataFrame, transcripts: DataFrame, errors: DataFrame, responses: tuple = SHORT_RESPONSES) -> tuple[DataFrame, DataFrame]:
    """Cues of all media files from their aligned segments, and the segments that can't be used.

    ``segments(media_id, cue_id, start_ms, end_ms, status)``,
    ``tokens(media_id, cue_id, pos, token, start_ms, end_ms)``,
    ``transcripts(media_id, cue_id, text)``, ``errors(media_id, cue_id, error)``
    from ``token_timing_error``. A completed segment with sound timing whose tokens say
    what the transcript says gives a cue for each token, with the transcript's
    surface; any other segment gives one cue with the whole transcript over the range
    it owns. Segments without transcript then are failures (media_id, cue_id, reason).

    Returns cues(media_id, cue_id, pos, start_ms, end_ms, text, source) in order, without overlaps.
    """
    owned = owned_bounds(segments).select(*SEGMENT, F.col("own_start").alias("owned_start"), F.col("own_end").alias("owned_end"))
    spoken = tokens.where("trim(token) <> ''")
    said = spoken.groupBy(*SEGMENT).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token"))), lambda x: x["token"]), "").alias("said"))
    s = segments.select(*SEGMENT, F.coalesce("status", F.lit("completed")).alias("status")).join(owned, list(SEGMENT)).join(errors, list(SEGMENT), "left").join(said, list(SEGMENT), "left")
    s = s.join(transcripts.select(*SEGMENT, F.trim("text").alias("whole")), list(SEGMENT), "left").withColumn("whole", F.coalesce("whole", F.lit("")))
    sound = (F.col("status") == "completed") & (F.coalesce("error", F.lit("no_tokens")) == "ok")
    same = (F.col("whole") == "") | (norm_strict(F.col("whole")) == norm_strict(F.coalesce("said", F.lit(""))))
    reason = F.when(F.col("status") != "completed", F.concat(F.lit("status "), "status")).otherwise(F.coalesce("error", F.lit("no_tokens")))
    s = s.withColumn("source", F.when(sound & same, "tokens").when(F.col("whole") != "", "transcript").otherwise("failed")).withColumn("reason", reason)

    own = s.select(*SEGMENT, "source", "owned_start", "owned_end")
    pieces = spoken.select(*SEGMENT, "pos", F.trim("token").alias("text"), "start_ms", "end_ms").join(own.where("source = 'tokens'"), list(SEGMENT))
    pieces = restore_surface(pieces, s.where("source = 'tokens' and whole <> ''").select(*SEGMENT, F.col("whole").alias("text")))
    whole = s.where("source = 'transcript'").select(*SEGMENT, F.lit(0).cast("long").alias("pos"), F.col("whole").alias("text"), F.col("owned_start").alias("start_ms"), F.col("owned_end").alias("end_ms"), "source", "owned_start", "owned_end")
    pieces = drop_boundary_repeats(pieces.unionByName(whole), segments)
    timed = pieces.drop("start_ms", "end_ms").join(repair_ranges(pieces), [*SEGMENT, "pos"])
    timed = narrow_responses(timed, responses)

    order = Window.partitionBy("media_id").orderBy("cue_id", "pos")
    c = timed.withColumn("i", F.row_number().over(order)).withColumn("v", F.greatest("end_ms", F.col("start_ms") + 1) - F.col("i"))
    c = c.withColumn("end2", F.max("v").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("i"))
    c = c.withColumn("start_ms", F.greatest("start_ms", F.coalesce(F.lag("end2").over(order), F.col("start_ms"))))
    return c.select(*SEGMENT, "pos", "start_ms", F.col("end2").alias("end_ms"), "text", "source"), s.where("source = 'failed'").select(*SEGMENT, "reason")


def merge_window_alignments(windows: DataFrame, transcripts: DataFrame, errors: DataFrame) -> DataFrame:
    """media_id, cue_id, tokens, accepted, reason: the tokens of all windows of a segment, in order of time.

    ``windows(media_id, cue_id, window, pos, token, start_ms, end_ms)``;
    ``errors(media_id, cue_id, error)`` of the united tokens. They are accepted where they say what
    ``transcripts(media_id, cue_id, text)`` says and their timing is sound; else the segment stays as it was, with the reason.
    """
    token = F.struct("start_ms", "window", "pos", "end_ms", "token")
    w = windows.where("trim(token) <> ''").groupBy(*SEGMENT).agg(F.array_sort(F.collect_list(token)).alias("tokens"))
    w = transcripts.select(*SEGMENT, "text").join(w, list(SEGMENT), "left").join(errors, list(SEGMENT), "left")
    said = F.coalesce(F.array_join(F.transform("tokens", lambda x: x["token"]), ""), F.lit(""))
    reason = F.when(F.col("tokens").isNull(), "no_tokens").when(norm_strict(said) != norm_strict(F.col("text")), "text_differs").when(F.col("error") != "ok", F.col("error"))
    w = w.withColumn("reason", reason)
    kept = F.when(F.col("reason").isNull(), F.transform("tokens", lambda x: F.struct(x["token"].alias("text"), x["start_ms"].alias("start_ms"), x["end_ms"].alias("end_ms"))))
    return w.select(*SEGMENT, kept.alias("tokens"), F.col("reason").isNull().alias("accepted"), "reason")
