"""Subtitle files: SRT, VTT and ASS parsing and writing, and keyed cue manifests.

Readers take files(media_id, content), one row for each file; writers give the
same shape, one file's text being one row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.functions.timecode import ass_ms, fmt_ass, fmt_srt, fmt_vtt, srt_ms

TAGS = r"</?[A-Za-z][^>]*>|\{[^}]*\}"


def read_files(spark: SparkSession, path: str, id_pattern: str = r"([^/]+)\.[^./]+$") -> DataFrame:
    """Whole text files with the media id from the path; a byte-order mark is dropped."""
    t = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("media_id"), "value")
    return t.select("media_id", F.regexp_replace("value", "^\\x{FEFF}", "").alias("content"))


def parse_srt(files: DataFrame) -> DataFrame:
    """Cues of SRT files: blocks of number, times and one or more lines; bad blocks are skipped, lines joined by spaces."""
    text = F.regexp_replace(F.regexp_replace("content", r"\r\n?", "\n"), r"^\s+|\s+$", "")
    b = files.select("media_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("block", "lines")).withColumn("lines", F.split("lines", "\n"))
    timed = F.filter(F.transform("lines", lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda r: r["x"].contains("-->"))
    b = b.withColumn("t", F.get(timed, F.lit(0))).where("t is not null")
    ends = F.split(F.col("t.x"), r"\s*-->\s*")
    start, end = srt_ms(F.get(ends, F.lit(0))), srt_ms(F.regexp_extract(F.get(ends, F.lit(1)), r"^\S+", 0))
    said = F.array_join(F.filter(F.slice("lines", F.col("t.i") + 2, F.size("lines")), lambda x: F.trim(x) != ""), " ")
    c = b.select("media_id", "block", start.alias("start_ms"), end.alias("end_ms"), F.trim(F.regexp_replace(said, TAGS, "")).alias("text"))
    c = c.where("start_ms is not null and end_ms is not null and text <> ''")
    order = Window.partitionBy("media_id").orderBy("start_ms", "block")
    return c.select("media_id", F.row_number().over(order).cast("long").alias("cue_id"), "start_ms", F.greatest("end_ms", F.col("start_ms") + 1).alias("end_ms"), "text")


def srt_legality(files: DataFrame) -> DataFrame:
    """(media_id, block, issue) of SRT blocks: short block, bad or non-continuous number, bad times, non-positive, overlap."""
    text = F.regexp_replace(F.regexp_replace("content", r"\r\n?", "\n"), r"^\s+|\s+$", "")
    b = files.select("media_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("block", "lines")).withColumn("lines", F.split("lines", "\n"))
    number = F.trim(F.get("lines", F.lit(0))).try_cast("long")
    ends = F.split(F.get("lines", F.lit(1)), r"\s*-->\s*")
    b = b.withColumn("number", number).withColumn("s", srt_ms(F.get(ends, F.lit(0)))).withColumn("e", srt_ms(F.get(ends, F.lit(1))))
    w = Window.partitionBy("media_id").orderBy("block")
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumn("expected", F.count("number").over(past) + 1).withColumn("before", F.last(F.when(F.col("s").isNotNull(), F.col("e")), ignorenulls=True).over(past))
    bad = F.col("s").isNull() | F.col("e").isNull()
    found = F.array(
        F.when(F.size("lines") < 3, "short_block"), F.when(F.col("number").isNull(), "bad_index").when(F.col("number") != F.col("expected"), "index_gap"),
        F.when(bad, "bad_time"), F.when(~bad & (F.col("e") <= F.col("s")), "non_positive"), F.when(~bad & (F.col("s") < F.col("before")), "overlap"),
    )
    return b.select("media_id", F.col("block").cast("long").alias("block"), F.explode(F.array_compact(found)).alias("issue"))


def parse_ass(files: DataFrame, dedupe: bool = True) -> DataFrame:
    """Dialogue lines of ASS files: style, times in ms and text without tags; the first of equal (start, end, text)."""
    lines = files.select("media_id", F.posexplode(F.split("content", r"\r?\n")).alias("pos", "line")).where(F.startswith("line", F.lit("Dialogue:")))
    f = F.split(F.regexp_extract("line", r"^Dialogue:\s*(.*)$", 1), ",", 10)
    text = F.trim(F.regexp_replace(F.regexp_replace(F.get(f, F.lit(9)), r"\{[^}]*\}", ""), r"\\[Nnh]", " "))
    d = lines.select("media_id", "pos", ass_ms(F.get(f, F.lit(1))).alias("start_ms"), ass_ms(F.get(f, F.lit(2))).alias("end_ms"), F.trim(F.get(f, F.lit(3))).alias("style"), text.alias("text")).where("text <> '' and start_ms is not null and end_ms is not null")
    if dedupe:
        first = F.row_number().over(Window.partitionBy("media_id", "start_ms", "end_ms", "text").orderBy("pos"))
        d = d.withColumn("n", first).where("n = 1").drop("n")
    order = Window.partitionBy("media_id").orderBy("start_ms", "pos")
    return d.select("media_id", F.row_number().over(order).cast("long").alias("line_id"), "start_ms", "end_ms", "style", "text")


def _file(cues: DataFrame, block, head: str = "", joined: str = "\n\n") -> DataFrame:
    order = Window.partitionBy("media_id").orderBy("start_ms", "cue_id")
    c = cues.withColumn("n", F.row_number().over(order))
    c = c.select("media_id", "n", block.alias("block"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", "block"))), lambda x: x["block"])
    return c.groupBy("media_id").agg(F.concat(F.lit(head), F.array_join(parts, joined), F.lit("\n")).alias("content"))


def to_srt(cues: DataFrame) -> DataFrame:
    return _file(cues, F.concat_ws("\n", F.col("n").cast("string"), F.concat(fmt_srt(F.col("start_ms")), F.lit(" --> "), fmt_srt(F.col("end_ms"))), F.col("text")))


def to_vtt(cues: DataFrame) -> DataFrame:
    return _file(cues, F.concat_ws("\n", F.concat(fmt_vtt(F.col("start_ms")), F.lit(" --> "), fmt_vtt(F.col("end_ms"))), F.col("text")), "WEBVTT\n\n")


def to_ass(dialogues: DataFrame) -> DataFrame:
    line = F.concat(F.lit("Dialogue: 0,"), fmt_ass(F.col("start_ms")), F.lit(","), fmt_ass(F.col("end_ms")), F.lit(","), F.col("style"), F.lit(",,0,0,0,,"), F.replace("text", F.lit("\n"), F.lit("\\N")))
    return _file(dialogues.withColumnRenamed("line_id", "cue_id"), line, "[Events]\nFormat: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text\n", "\n")


CUE_JSON = "map<string, struct<start_time: bigint, end_time: bigint, original_subtitle: string, translated_subtitle: string>>"


def to_cue_manifest(cues: DataFrame) -> DataFrame:
    """A JSON object for each media file, keyed "1" to "n"."""
    order = Window.partitionBy("media_id").orderBy("start_ms", "cue_id")
    c = cues.withColumn("n", F.row_number().over(order))
    entry = F.struct(F.col("n").cast("string").alias("key"), F.struct(F.col("start_ms").alias("start_time"), F.col("end_ms").alias("end_time"), F.col("text").alias("original_subtitle"), F.col("translated").alias("translated_subtitle")).alias("value"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("n", entry.alias("e")))), lambda x: x["e"])
    return c.groupBy("media_id").agg(F.to_json(F.map_from_entries(parts)).alias("content"))


def read_cue_manifest(files: DataFrame, stage: str) -> DataFrame:
    """Rows of keyed cue manifests: numeric keys first, blank texts dropped, stably sorted by start."""
    rows = files.select("media_id", F.explode(F.from_json("content", CUE_JSON)).alias("key", "c")).where(F.trim(F.coalesce("c.original_subtitle", F.lit(""))) != "")
    number = F.col("key").try_cast("long")
    order = Window.partitionBy("media_id").orderBy(F.col("c.start_time"), F.when(number.isNull(), 1).otherwise(0), number, "key")
    return rows.select("media_id", F.lit(stage).alias("stage"), F.row_number().over(order).cast("long").alias("cue_id"), F.col("c.start_time").alias("start_ms"), F.greatest("c.end_time", F.col("c.start_time") + 1).alias("end_ms"), F.col("c.original_subtitle").alias("text"), F.col("c.translated_subtitle").alias("translated"))


def write_files(files: DataFrame, path: str, suffix_column: str = "media_id") -> None:
    """One folder of text for each media file."""
    files.select(suffix_column, F.col("content").alias("value")).write.partitionBy(suffix_column).text(path)


def read_journal(spark: SparkSession, path: str, payload: str = "map<string, string>") -> DataFrame:
    """JSONL events (type, segment_id, seq, payload); blank and broken lines are skipped."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    e = lines.select(F.from_json("value", f"type string, segment_id bigint, seq bigint, payload {payload}").alias("e"))
    return e.where("e.segment_id is not null").select("e.*")
