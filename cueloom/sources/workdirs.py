"""What the stages of a job leave in its folders: segment lists, word timings of several layouts, transcripts, pairs of files.

Readers take files(media_id, content), one row for each file, as ``subtitles.read_files`` gives them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cueloom.functions.timecode import srt_ms

TOKEN_JSON = "array<struct<text: string, start_time: double, end_time: double>>"
SEGMENT_JSON = f"""array<struct<segment_id: string, source_file: string, segment_file: string, start_time: double, end_time: double,
  duration: double, text: string, language: string, status: string, error: string, tokens: {TOKEN_JSON}>>"""
#: Names under which word timings come, the first that is there being used; fixed values.
TOKEN_LISTS = ("tokens", "words", "timestamps")
TEXT_NAMES, START_NAMES, END_NAMES = ("text", "token", "word"), ("start", "start_time"), ("end", "end_time")
WORD = "struct<text: string, token: string, word: string, start: double, start_time: double, end: double, end_time: double>"
RAW_JSON = "struct<" + ", ".join(f"{n}: array<{WORD}>" for n in TOKEN_LISTS) + ">"
WORD_FILE_JSON = "struct<segments: array<struct<text: string, start: double, end: double, words: array<struct<word: string, start: double, end: double>>>>>"


def ms(seconds: Column) -> Column:
    """Whole milliseconds, halves to the even number."""
    return F.bround(seconds * 1000).cast("long")


def read_segments(files: DataFrame) -> DataFrame:
    """media_id, seg_idx, segment_id, start_ms, end_ms, text, status, tokens(text, start_ms, end_ms) of segment, transcript or aligned lists.

    A file holds one JSON array; a byte-order mark is ignored, and files that hold no array give no rows. Missing fields are null.
    """
    content = F.regexp_replace("content", "^\\x{FEFF}", "")
    rows = files.select("media_id", F.posexplode(F.from_json(content, SEGMENT_JSON)).alias("i", "s"))
    tokens = F.transform("s.tokens", lambda t: F.struct(t["text"].alias("text"), ms(t["start_time"]).alias("start_ms"), ms(t["end_time"]).alias("end_ms")))
    return rows.where("s is not null").select(
        "media_id", (F.col("i") + 1).cast("long").alias("seg_idx"), "s.segment_id", ms(F.col("s.start_time")).alias("start_ms"), ms(F.col("s.end_time")).alias("end_ms"), "s.text", "s.status", tokens.alias("tokens")
    )


def read_segment_files(spark: SparkSession, path: str, id_pattern: str = r"([^/]+)/[^/]+$") -> DataFrame:
    """``read_segments`` of all files of ``path``; the media id is the folder's name unless the pattern says otherwise."""
    t = spark.read.text(path, wholetext=True)
    return read_segments(t.select(F.regexp_extract(F.col("_metadata.file_path"), id_pattern, 1).alias("media_id"), F.col("value").alias("content")))


def to_segment_list(segments: DataFrame) -> DataFrame:
    """files(media_id, content): a JSON array for each media file, its segments by start; segments(media_id, segment_id, start_ms, end_ms, text, status)."""
    s = F.struct("segment_id", (F.col("start_ms") / 1000).alias("start_time"), (F.col("end_ms") / 1000).alias("end_time"), "text", "status")
    parts = F.array_sort(F.collect_list(F.struct("start_ms", "segment_id", s.alias("s"))))
    return segments.groupBy("media_id").agg(F.to_json(F.transform(parts, lambda x: x["s"])).alias("content"))


def _named(word: Column, names: tuple) -> Column:
    """The first name with a value; empty texts and zeros count as none."""
    return F.coalesce(*(F.when((word[n] != "") if names is TEXT_NAMES else (word[n] != 0), word[n]) for n in names))


def globalise_tokens(raw: DataFrame) -> DataFrame:
    """media_id, seg_idx, pos, token, start_ms, end_ms on the clock of the media file.

    ``raw(media_id, seg_idx, offset_ms, content)``: an aligner's JSON output for a segment, an object or an array of
    which the first object counts. The first list that has rows is used. A missing start is 0, a missing end the start.
    """
    text = F.trim("content")
    item = F.when(F.startswith(text, F.lit("[")), F.get(F.from_json(text, f"array<{RAW_JSON}>"), F.lit(0))).otherwise(F.from_json(text, RAW_JSON))
    lists = F.coalesce(*(F.when(F.size(item[n]) > 0, item[n]) for n in TOKEN_LISTS))
    t = raw.select("media_id", "seg_idx", "offset_ms", F.posexplode(lists).alias("pos", "w"))
    start = F.coalesce(_named(F.col("w"), START_NAMES), F.lit(0.0))
    end = F.coalesce(_named(F.col("w"), END_NAMES), start)
    return t.select(
        "media_id", "seg_idx", F.col("pos").cast("long").alias("pos"), F.coalesce(_named(F.col("w"), TEXT_NAMES), F.lit("")).alias("token"), (F.col("offset_ms") + ms(start)).alias("start_ms"), (F.col("offset_ms") + ms(end)).alias("end_ms")
    )


def _longer(start: Column, end: Column) -> Column:
    return F.when(end > start, end).otherwise(start + 20)


def flatten_word_json(files: DataFrame) -> DataFrame:
    """media_id, pos, text, start_ms, end_ms: the words of a file's segments, or their texts where the file has no words.

    Blank texts are dropped, missing times are the segment's, an end that isn't after its start is 20 ms after it.
    """
    s = files.select("media_id", F.posexplode(F.from_json("content", WORD_FILE_JSON)["segments"]).alias("i", "s"))
    w = s.select("media_id", "i", "s", F.posexplode_outer("s.words").alias("j", "w"))
    said = F.trim(F.coalesce("w.word", F.lit(""))) != ""
    w = w.withColumn("words", F.max(said).over(Window.partitionBy("media_id"))).withColumn("said", said)
    whole = ~F.col("words") & (F.coalesce("j", F.lit(0)) == 0) & (F.trim(F.coalesce("s.text", F.lit(""))) != "")
    w = w.where(F.when(F.col("words"), F.col("said")).otherwise(whole))
    of = lambda name: ms(F.coalesce(F.when(F.col("words"), F.col(f"w.{name}")), F.col(f"s.{name}"), F.lit(0.0)))
    order = Window.partitionBy("media_id").orderBy("i", "j")
    return w.select("media_id", F.row_number().over(order).cast("long").alias("pos"), F.when(F.col("words"), F.col("w.word")).otherwise(F.col("s.text")).alias("text"), of("start").alias("start_ms"), _longer(of("start"), of("end")).alias("end_ms"))


def unescape(text: Column) -> Column:
    """The named entities of HTML's core and decimal references of characters, the ampersand last."""
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("apos", "'"), ("nbsp", " "), ("#39", "'"), ("#34", '"'), ("#60", "<"), ("#62", ">"), ("#38", "&"), ("amp", "&")):
        text = F.replace(text, F.lit(f"&{name};"), F.lit(char))
    return text


def parse_karaoke_srt(files: DataFrame) -> DataFrame:
    """media_id, pos, text, start_ms, end_ms: what each block of an SRT file highlights with a font tag.

    Files without such a tag give the joined text of their blocks. Other tags go; blocks without times or text are skipped.
    """
    text = F.regexp_replace(F.regexp_replace("content", r"\r\n?", "\n"), r"^\s+|\s+$", "")
    b = files.select("media_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("block", "lines")).withColumn("lines", F.split("lines", "\n"))
    ends = F.split(F.trim(F.get("lines", F.lit(1))), r"\s*-->\s*")
    b = b.withColumn("s", srt_ms(F.get(ends, F.lit(0)))).withColumn("e", srt_ms(F.get(ends, F.lit(1)))).where("size(lines) >= 3 and s is not null and e is not null")
    body = F.array_join(F.slice("lines", 3, F.size("lines")), "\n")
    lit = F.regexp_extract_all(body, F.lit(r"(?is)<font\b[^>]*>(.*?)</font>"), F.lit(1))
    b = b.withColumn("body", body).withColumn("lit", lit).withColumn("sung", F.max(F.size("lit") > 0).over(Window.partitionBy("media_id")))
    shown = F.when(F.col("sung"), F.array_join("lit", "")).otherwise(F.replace("body", F.lit("\n"), F.lit(" ")))
    b = b.withColumn("text", F.regexp_replace(unescape(F.regexp_replace(shown, r"<[^>]+>", "")), r"^\s+|\s+$", "")).where("text <> ''")
    order = Window.partitionBy("media_id").orderBy("block")
    return b.select("media_id", F.row_number().over(order).cast("long").alias("pos"), "text", F.col("s").alias("start_ms"), _longer(F.col("s"), F.col("e")).alias("end_ms"))


def script(text: Column) -> Column:
    """kana, hangul, han, cyrillic, latin or other: the first of these that the text has."""
    return F.when(text.rlike(r"[\x{3040}-\x{30ff}]"), "kana").when(text.rlike(r"[\x{ac00}-\x{d7af}]"), "hangul").when(text.rlike(r"[\x{3400}-\x{9fff}]"), "han").when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsLatin}"), "latin").otherwise("other")


def parse_bilingual_srt(files: DataFrame, sample: int = 50, share: float = 0.7) -> DataFrame:
    """media_id, cue_id, start_ms, end_ms, text, translated: SRT blocks, in bilingual files with their fourth line as translation.

    A file is bilingual if all its blocks have four lines and, of its first ``sample`` ones, at least ``share`` have two
    lines in different scripts. Languages of one script aren't told apart. Other files join the lines; their translation is empty.
    """
    text = F.regexp_replace(F.regexp_replace("content", r"\r\n?", "\n"), r"^\s+|\s+$", "")
    b = files.select("media_id", F.posexplode(F.split(text, r"\n\s*\n")).alias("block", "lines")).withColumn("lines", F.split("lines", "\n"))
    line = lambda i: F.trim(F.get("lines", F.lit(i)))
    media = Window.partitionBy("media_id")
    first = F.col("block") < sample
    b = b.withColumn("both", F.min(F.size("lines") == 4).over(media) & (F.count_if(first & (script(line(2)) != script(line(3)))).over(media) >= F.count_if(first).over(media) * share))
    ends = F.split(line(1), r"\s*-->\s*")
    c = b.select(
        "media_id", "block", srt_ms(F.get(ends, F.lit(0))).alias("start_ms"), srt_ms(F.get(ends, F.lit(1))).alias("end_ms"),
        F.when(F.col("both"), line(2)).otherwise(F.array_join(F.transform(F.slice("lines", 3, F.size("lines")), F.trim), " ")).alias("text"), F.when(F.col("both"), line(3)).otherwise("").alias("translated"),
    ).where("start_ms is not null and end_ms is not null and text <> ''")
    return c.select("media_id", F.row_number().over(media.orderBy("start_ms", "block")).cast("long").alias("cue_id"), "start_ms", "end_ms", "text", "translated")


def discover_pairs(paths: DataFrame, wanted: str | None = None) -> DataFrame:
    """episode, media_path, script_path: recordings and scripts whose names carry the same ``#`` number.

    ``paths(path)``. Of several files of a kind and number the last path counts; ``wanted`` must stand in the name or the number.
    The rows are in the order of the numbers only when sorted by ``episode``.
    """
    name = F.regexp_extract("path", r"[^/]*$", 0)
    p = paths.select("path", name.alias("name"), F.regexp_extract(name, r"#\s*(\d+)", 1).alias("digits")).where("digits <> ''").withColumn("episode", F.col("digits").cast("decimal(38, 0)").cast("long"))
    if wanted:
        p = p.where(F.col("name").contains(wanted) | F.col("episode").cast("string").contains(wanted))
    kind = F.lower(F.regexp_extract("name", r"\.[^.]*$", 0))
    g = p.groupBy("episode").agg(F.max(F.when(kind == ".mp3", F.col("path"))).alias("media_path"), F.max(F.when(kind == ".ass", F.col("path"))).alias("script_path"))
    return g.where("media_path is not null and script_path is not null")


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """paths(path) of a folder, without reading the files."""
    return spark.read.format("binaryFile").load(folder).select("path")


def union_issues(reports: dict[str, DataFrame]) -> DataFrame:
    """The rows of all reports with the union of their columns and ``report``, the name of each."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("report", F.lit(name)) for name, df in reports.items()))


def write_issues(issues: DataFrame, path: str, kind: str = "jsonl") -> None:
    """Report rows as jsonl, tsv or csv files with a header; lists are joined by commas in the latter two."""
    if kind == "jsonl":
        issues.write.json(path, ignoreNullFields=False)
        return
    flat = [F.array_join(c, ",").alias(c) if t.startswith("array<string") else F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in issues.dtypes]
    issues.select(*flat).write.csv(path, sep={"tsv": "\t", "csv": ","}[kind], header=True)


def plain_text(transcripts: DataFrame) -> DataFrame:
    """files(media_id, content): the completed texts, one line each, without what a line repeats of the line before it.

    ``transcripts(media_id, seg_idx, text, status)``. A line is compared with the line that was written before it, so this
    is a fold over sorted rows; one row is held at a time, but a file's text is one string, as its content must be.
    """
    kept = transcripts.where(F.trim(F.coalesce("text", F.lit(""))) != "").where("status = 'completed'")
    rows = kept.select("media_id", "seg_idx", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).repartition("media_id").sortWithinPartitions("media_id", "seg_idx", "text")

    def lines(batches):
        import pandas as pd

        media, before = None, ""
        for b in batches:
            out = []
            for m, i, text in zip(b["media_id"], b["seg_idx"], b["text"]):
                if m != media:
                    media, before = m, ""
                line = _new_part(before, text) if before else text
                out.append((m, i, line))
                before = line or before
            yield pd.DataFrame(out, columns=["media_id", "seg_idx", "line"])

    types = dict(rows.dtypes)
    got = rows.mapInPandas(lines, f"media_id {types['media_id']}, seg_idx {types['seg_idx']}, line string").where("line <> ''")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "line"))), lambda x: x["line"])
    return got.groupBy("media_id").agg(F.concat(F.array_join(parts, "\n"), F.lit("\n")).alias("content"))


def _new_part(before: str, text: str) -> str:
    """``text`` without its start that ends ``before``: up to 20 words, all of ``before``, or up to 30 characters."""
    a, b = before.split(), text.split()
    for n in range(min(len(a), len(b), 20), 0, -1):
        if a[-n:] == b[:n]:
            return " ".join(b[n:])
    if text.startswith(before):
        return text[len(before) :].strip()
    for n in range(min(len(before), len(text), 30), 0, -1):
        if before.endswith(text[:n]):
            return text[n:].strip()
    return text
