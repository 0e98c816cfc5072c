"""Similar texts without comparing all with all: postings of short pieces, then the exact ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import norm_kana, norm_match
from cueloom.operators.intervals import overlap_join
from cueloom.operators.matching import ratio, text_similarity, window_ratio

#: A reference of at most so many characters isn't sought inside a text that has over ``EXTRA`` more.
SHORT, EXTRA = 4, 6


def similar_pairs(left: DataFrame, right: DataFrame, least: float = 0.92) -> DataFrame:
    """media_id, key, r_key, similarity: the distinct texts ``left(media_id, key)`` and ``right(media_id, r_key)`` of a similarity of ``least`` or more.

    The similarity is that of the shorter text with the most similar stretch of the longer. With a
    ratio of ``least`` the shorter text, of n characters, differs from that stretch by at most
    e = 2 (1 - least) / least * n insertions and deletions, rounded down, and each of these touches at most one of
    e + 1 pieces that it is cut into. So one piece stands whole in the longer text. Pieces are looked up by their first four
    characters (or what all have) among all runs of the longer text; the first piece that is there makes the pair, so
    that pairs needn't be made distinct, and those whose edit distance is too large go no further. No pair is lost.
    Both sides' texts are joined once, each with its sides; equal and contained texts need no comparison.
    """
    side = lambda d, key, n: d.select("media_id", F.col(key).alias("key"), F.lit(n).alias("sides")).where("media_id is not null and key <> ''")
    texts = side(left, "key", 1).unionByName(side(right, "r_key", 2)).groupBy("media_id", "key").agg(F.bit_or("sides").alias("sides"))
    n, m = F.length("key"), F.length("other")
    edits = F.least(F.floor(F.lit(2 * (1 - least) / least + 1e-9) * n).cast("int"), n - 1)
    start = lambda i: F.floor(i * n / (edits + 1)).cast("int")
    piece = lambda i: F.substr("key", start(i) + 1, start(i + 1) - start(i))
    texts = texts.withColumn("size", F.least(F.lit(4), F.floor(n / (edits + 1)).cast("int")))
    texts = texts.withColumn("sizes", F.collect_set("size").over(Window.partitionBy("media_id")))

    short = texts.select("media_id", "key", "sides", "size", F.explode(F.sequence(F.lit(0), edits)).alias("nth"))
    short = short.select("media_id", F.left(piece(F.col("nth")), F.col("size")).alias("gram"), "key", "sides", "nth")
    runs = F.flatten(F.transform(F.filter("sizes", lambda k: k <= n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda at: F.substr("key", at, k))))
    long = texts.select("media_id", F.explode(F.array_distinct(runs)).alias("gram"), F.col("key").alias("other"), F.col("sides").alias("other_sides"))

    across = (F.col("sides").bitwiseAND(1) * F.col("other_sides").bitwiseAND(2) > 0) | (F.col("sides").bitwiseAND(2) * F.col("other_sides").bitwiseAND(1) > 0)
    met = short.join(long, ["media_id", "gram"]).where((n <= m) & (F.col("key") != F.col("other")) & across & F.contains("other", piece(F.col("nth"))))
    # the whole of both is compared up to 1.3 of the shorter one's length, else a stretch, outside which everything is inserted
    whole = m <= n * 1.3
    far = F.when(whole, F.floor(F.lit(1 - least + 1e-9) * (n + m))).otherwise(m - n + 2 * edits)
    met = met.where(F.levenshtein("key", "other") <= far)
    met = met.where((F.col("nth") == 0) | ~F.exists(F.sequence(F.lit(0), F.greatest(F.lit(0), F.col("nth") - 1)), lambda i: F.contains(F.col("other"), piece(i))))

    inside = F.contains("other", "key")
    same = texts.where("sides = 3").select("media_id", "key", F.col("key").alias("r_key"), F.lit(1.0).alias("similarity"))
    held = F.when(whole, F.lit(2.0) * n / (n + m)).otherwise(1.0)
    compared = window_ratio(F.when(~inside, F.col("key")), F.when(~inside, F.col("other")), least)
    met = met.withColumn("compared", compared).withColumn("similarity", F.when(inside, held).otherwise(F.col("compared")))
    found = met.where(F.col("similarity") >= least)
    # of two texts of one length, either is the shorter of a pair of its own
    forth = F.when((F.col("sides").bitwiseAND(1) > 0) & (F.col("other_sides").bitwiseAND(2) > 0), F.struct("key", F.col("other").alias("r_key")))
    back = F.when((n < m) & (F.col("sides").bitwiseAND(2) > 0) & (F.col("other_sides").bitwiseAND(1) > 0), F.struct(F.col("other").alias("key"), F.col("key").alias("r_key")))
    pairs = found.select("media_id", F.explode(F.array_compact(F.array(forth, back))).alias("p"), "similarity").select("media_id", "p.key", "p.r_key", "similarity")
    return same.unionByName(pairs).select("key", "r_key", "media_id", "similarity")


def estimate_offset(dialogues: DataFrame, cues: DataFrame, least: float = 0.92, bucket_ms: int = 500, tried: int = 5, window_ms: int = 1200) -> DataFrame:
    """media_id and offset_ms, by which each file's ``dialogues(media_id, line_id, start_ms, end_ms, text)`` are to be moved to meet its cues.

    Lines of 6 normalised characters or more and cues of a similar text vote by
    the difference of their starts, in buckets. The five fullest (then those of the highest sum of similarities)
    give a candidate each, the median of their and their neighbours' differences, in
    10 ms; the candidate wins at which lines of 4 characters or more find the most similar cues within ``window_ms``
    on the average. Files without votes have offset 0.
    """
    lines = dialogues.select("media_id", "line_id", "start_ms", "end_ms", norm_match(F.col("text")).alias("key"))
    said = cues.select("media_id", "cue_id", "start_ms", "end_ms", norm_match(F.col("text")).alias("r_key"))
    alike = similar_pairs(lines.where("length(key) >= 6"), said, least)
    votes = alike.join(lines.select("media_id", "key", F.col("start_ms").alias("line_start")), ["media_id", "key"]).join(said.select("media_id", "r_key", "start_ms"), ["media_id", "r_key"])
    votes = votes.select("media_id", "similarity", (F.col("start_ms") - F.col("line_start")).alias("shift")).withColumn("bucket", F.bround(F.col("shift") / bucket_ms).cast("long"))
    full = votes.groupBy("media_id", "bucket").agg(F.count("*").alias("n"), F.sum("similarity").alias("total"))
    order = Window.partitionBy("media_id").orderBy(F.desc("n"), F.desc("total"), "bucket")
    top = full.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= tried).select("media_id", "rank", F.explode(F.array(*[F.col("bucket") + k for k in (-1, 0, 1)])).alias("bucket"))
    candidates = votes.join(top, ["media_id", "bucket"]).groupBy("media_id", "rank").agg(F.median(F.bround(F.col("shift") / 10) * 10).cast("long").alias("offset_ms"))
    candidates = candidates.groupBy("media_id", "offset_ms").agg(F.min("rank").alias("rank"))

    moved = lines.where("length(key) >= 4").join(candidates, "media_id").select("media_id", "rank", "line_id", (F.col("start_ms") + F.col("offset_ms")).alias("start_ms"), (F.col("end_ms") + F.col("offset_ms")).alias("end_ms"), "key")
    near = text_similarity(overlap_join(moved, said, window_ms)).groupBy("media_id", "rank", "line_id").agg(F.max("similarity").alias("best"))
    scored = moved.select("media_id", "rank", "line_id").join(near, ["media_id", "rank", "line_id"], "left").withColumn("best", F.coalesce("best", F.lit(0.0)))
    scored = scored.groupBy("media_id", "rank").agg(F.round(F.avg("best"), 12).alias("mean"), F.count_if(F.col("best") >= 0.45).alias("good"))
    best = candidates.join(scored, ["media_id", "rank"], "left").groupBy("media_id").agg(F.max_by("offset_ms", F.struct(F.coalesce("mean", F.lit(0.0)), F.coalesce("good", F.lit(0)), -F.col("rank"))).alias("offset_ms"))
    return dialogues.select("media_id").distinct().join(best, "media_id", "left").na.fill(0, ["offset_ms"])


def match_windows(dialogues: DataFrame, cues: DataFrame, offsets: DataFrame, near_ms: int = 1200, far_ms: int = 8000) -> DataFrame:
    """Each line's best cue near its moved time and in a wide window: media_id, line_id, cue_id, score, far_id, far_score.

    Texts that are equal with katakana read as hiragana score 1. A cue of
    less than 0.7 of a line's length, or one over 6 characters longer than a line of at most 4, is
    compared as a whole; else the shorter text is sought in the longer. The
    first cue wins ties; without a cue the score is 0.
    """
    lines = dialogues.join(offsets, "media_id", "left").withColumn("offset_ms", F.coalesce("offset_ms", F.lit(0)))
    lines = lines.select("media_id", "line_id", (F.col("start_ms") + F.col("offset_ms")).alias("start_ms"), (F.col("end_ms") + F.col("offset_ms")).alias("end_ms"), norm_match(F.col("text")).alias("key"), norm_kana(F.col("text")).alias("kana"))
    said = cues.select("media_id", "cue_id", "start_ms", "end_ms", norm_match(F.col("text")).alias("r_key"), norm_kana(F.col("text")).alias("r_kana"))
    met = text_similarity(overlap_join(lines, said, far_ms))

    @F.pandas_udf("double")
    def whole(a, b):
        import pandas as pd

        return pd.Series([ratio(x, y) if x and y else 0.0 for x, y in zip(a, b)])

    n, m = F.length("key"), F.length("r_key")
    plain = (m < F.greatest(F.lit(1), F.bround(n * 0.7))) | ((n <= SHORT) & (m > n + EXTRA))
    empty = (n == 0) | (m == 0)
    compared = met.select("key", "r_key").where(plain & ~empty).distinct().withColumn("whole", whole("key", "r_key"))
    met = met.join(compared, ["key", "r_key"], "left")
    score = F.when(empty, 0.0).when(F.col("kana") == F.col("r_kana"), 1.0).otherwise(F.coalesce("whole", "similarity"))
    close = (F.col("r_end") > F.col("start_ms") - near_ms) & (F.col("r_start") < F.col("end_ms") + near_ms)
    met = met.withColumn("score", score).withColumn("rank", F.struct("score", -F.col("cue_id")))
    best = met.groupBy("media_id", "line_id").agg(F.max(F.when(close, F.struct("score", (-F.col("cue_id")).alias("id")))).alias("near"), F.max(F.struct("score", (-F.col("cue_id")).alias("id"))).alias("far"))
    out = lines.select("media_id", "line_id").join(best, ["media_id", "line_id"], "left")
    return out.select("media_id", "line_id", (-F.col("near.id")).alias("cue_id"), F.coalesce(F.round("near.score", 6), F.lit(0.0)).alias("score"), (-F.col("far.id")).alias("far_id"), F.coalesce(F.round("far.score", 6), F.lit(0.0)).alias("far_score"))
