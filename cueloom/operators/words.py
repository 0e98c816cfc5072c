"""Words of cues, word-level files, cues from tokens, and pairing of short responses."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import WORD, mainly_unspaced, norm_latin


def split_words(cues: DataFrame) -> DataFrame:
    """The words of each cue (characters in scripts without spaces), the time shared by one unit for every four characters begun."""
    w = cues.select("media_id", "cue_id", "start_ms", "end_ms", F.posexplode(F.regexp_extract_all("text", F.lit(WORD), F.lit(0))).alias("pos", "word"))
    cue = Window.partitionBy("media_id", "cue_id")
    units = F.ceil(F.length("word") / 4)
    w = w.withColumn("units", units).withColumn("total", F.sum("units").over(cue))
    w = w.withColumn("ms", F.floor((F.col("end_ms") - F.col("start_ms")) / F.greatest("total", F.lit(1)) * F.col("units")))
    upto = F.sum("ms").over(cue.orderBy("pos"))
    at = lambda c: F.least("end_ms", F.col("start_ms") + c)
    return w.select("media_id", "cue_id", F.col("pos").cast("long").alias("pos"), "word", at(upto - F.col("ms")).alias("start_ms"), at(upto).alias("end_ms"))


def word_level(cues: DataFrame, share: float = 0.8) -> DataFrame:
    """Whether a media file's cues are single words (or one or two characters of a script without spaces)."""
    text = F.trim("text")
    single = F.when(mainly_unspaced(text), F.length(text) <= 2).otherwise(F.size(F.filter(F.split(text, r"\s+"), lambda x: x != "")) == 1)
    return cues.groupBy("media_id").agg((F.avg(single.cast("int")) >= share).alias("word_level"))


def group_tokens(tokens: DataFrame, pause_ms: int = 800, most_ms: int = 6000, least_ms: int = 800, width: int = 84) -> DataFrame:
    """Cues from the tokens of each segment: a new one after a pause, at 6 s, after end punctuation, or where the text would not fit.

    Each decision depends on the one before, so a segment's tokens are read as
    one sorted stream.
    """

    def group(frames):
        key, cue, rows = None, 0, []
        line, start, end = [], 0, 0

        def done():
            if line:
                rows.append((*key, cue, start, end, " ".join(line)))

        for g in frames:
            rows.clear()
            for m, c, t, s, e in zip(g["media_id"], g["cue_id"], g["token"], g["start_ms"], g["end_ms"]):
                if (m, c) != key:
                    done()
                    key, cue, line, start, end = (m, c), 1, [], s, e
                else:
                    length = sum(map(len, line)) + len(line) + len(t)
                    stop = bool(line) and line[-1][-1:] in ".!?。！？"
                    if (s - end >= pause_ms and e - start >= least_ms) or e - start >= most_ms or stop or length > width:
                        done()
                        cue, line, start = cue + 1, [], s
                line.append(t)
                end = e
            yield pd.DataFrame(list(rows), columns=["media_id", "seg_id", "cue_no", "start_ms", "end_ms", "text"])
        rows.clear()
        done()
        yield pd.DataFrame(list(rows), columns=["media_id", "seg_id", "cue_no", "start_ms", "end_ms", "text"])

    t = tokens.where("trim(token) <> ''").select("media_id", "cue_id", "pos", "token", "start_ms", "end_ms")
    ordered = t.repartition("media_id", "cue_id").sortWithinPartitions("media_id", "cue_id", "pos")
    return ordered.mapInPandas(group, "media_id long, seg_id long, cue_no long, start_ms long, end_ms long, text string")


def pair_responses(source: DataFrame, result: DataFrame, within_ms: int = 2500) -> DataFrame:
    """Each source response, in order, with the nearest unused result response of the same text within ``within_ms``, or without one."""
    side = lambda d, n: d.select("media_id", "cue_id", "start_ms", norm_latin(F.col("text")).alias("key"), F.lit(n).alias("side"))
    rows = side(source, 0).unionByName(side(result, 1)).where("key <> ''")

    def pair(frames):
        columns = ["media_id", "key", "cue_id", "matched_id"]
        group, wanted, free, out = None, [], [], []

        def settle():
            used = set()
            for cue, at in wanted:
                best = min(((abs(s - at), c) for c, s in free if c not in used and abs(s - at) <= within_ms), default=None)
                if best:
                    used.add(best[1])
                out.append((*group, cue, best[1] if best else None))

        for g in frames:
            out.clear()
            for m, k, n, c, s in zip(g["media_id"], g["key"], g["side"], g["cue_id"], g["start_ms"]):
                if (m, k) != group:
                    settle()
                    group, wanted, free = (m, k), [], []
                (free if n else wanted).append((c, s))
            yield pd.DataFrame(list(out), columns=columns)
        out.clear()
        settle()
        yield pd.DataFrame(list(out), columns=columns)

    ordered = rows.repartition("media_id", "key").sortWithinPartitions("media_id", "key", "side", "start_ms", "cue_id")
    return ordered.mapInPandas(pair, "media_id long, key string, cue_id long, matched_id long")


def word_quality(words: DataFrame) -> DataFrame:
    """Words, timed, unknown and timed known words of words(media_id, cue_id, word, start_ms, end_ms), and whether they are usable."""
    timed, unknown = F.col("end_ms") > F.col("start_ms"), F.col("word").isin("<unk>", "spn", "")
    out = words.groupBy("media_id", "cue_id").agg(F.count("*").alias("words"), F.count_if(timed).alias("timed"), F.count_if(unknown).alias("unknown"), F.count_if(timed & ~unknown).alias("known"))
    return out.withColumn("usable", (F.col("known") > 0) & (F.col("unknown") == 0))
