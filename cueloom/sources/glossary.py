"""Glossaries in tables of different layouts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words by which header cells are told, and how many columns to the right a counterpart is sought.
SOURCE_HEADERS = ("日文", "通用日语", "广播用", "劇中成员名（日文）", "剧中成员名（日文）")
TARGET_HEADERS = ("中文",)
NOTE_HEADERS = ("注释", "备注", "角色")
LOOKAHEAD = 6


def glossary_entries(files: DataFrame, width: int = 64) -> DataFrame:
    """group, source, target, note of ``files(path, content)``, CSV texts whose first line is the header.

    A header with the cells source and target gives one pair of columns, with group and
    note if they are there. Any other header gives a pair for each source-like cell, with the first target-like
    cell within six columns to its right; note-like cells from there to six columns after it are joined by a fullwidth semicolon. The
    group is the group cell, else the pair's header, else the file's name. White space is
    collapsed; rows without source or target are dropped; the first of equal (group,
    source, target) stays, by file, pair and row. Files may have up to ``width`` columns; a cell can't hold a line break.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))
    schema = ", ".join(f"c{i} string" for i in range(width))
    lines = files.select("path", F.posexplode(F.split(F.regexp_replace("content", "^﻿", ""), "\r?\n")).alias("row", "line")).where("line <> ''")
    parsed = lines.withColumn("p", F.from_csv("line", schema))
    cells = parsed.select("path", "row", F.array(*[clean(F.col(f"p.c{i}")) for i in range(width)]).alias("cells"))
    head = cells.groupBy("path").agg(F.min_by("cells", "row").alias("head"), F.min("row").alias("first"))
    told = lambda words: lambda h: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(h, w))
    every = F.sequence(F.lit(0), F.lit(width - 1))
    lower = F.transform("head", lambda h: F.lower(h))
    at = lambda name: F.array_position(lower, name).cast("int") - 1
    group_at = F.when(at("group") >= 0, at("group")).otherwise(at("source"))
    plain = F.array(F.struct(at("source").alias("source"), at("target").alias("target"), group_at.alias("group_at"), F.filter(F.array(at("note")), lambda i: i >= 0).alias("notes")))
    paired = F.transform(F.filter(every, lambda i: told(SOURCE_HEADERS)(F.get("head", i))), lambda i: F.struct(i.alias("i"), F.get(F.filter(every, lambda j: (j > i) & (j <= i + LOOKAHEAD) & told(TARGET_HEADERS)(F.get("head", j))), F.lit(0)).alias("j")))
    paired = F.transform(F.filter(paired, lambda p: p["j"].isNotNull()), lambda p: F.struct(
        p["i"].alias("source"), p["j"].alias("target"), F.lit(-1).alias("group_at"),
        F.filter(every, lambda n: (n > p["i"]) & (n <= p["j"] + LOOKAHEAD) & (n != p["j"]) & told(NOTE_HEADERS)(F.get("head", n))).alias("notes"),
    ))
    canonical = (at("source") >= 0) & (at("target") >= 0)
    roles = head.withColumn("roles", F.when(canonical, plain).otherwise(paired)).select("path", "first", "head", F.posexplode("roles").alias("pair", "r"))
    e = cells.join(roles, "path").where("row > first")
    name = F.regexp_extract("path", r"([^/]*?)(\.[^./]*)?$", 1)
    source, target = F.get("cells", F.col("r.source")), F.get("cells", F.col("r.target"))
    group = F.when(F.col("r.group_at") >= 0, F.get("cells", F.col("r.group_at"))).otherwise(F.get("head", F.col("r.source")))
    notes = F.filter(F.transform("r.notes", lambda n: F.get("cells", n)), lambda v: (v != "") & ((F.col("r.group_at") >= 0) | ((v != source) & (v != target))))
    e = e.select("path", "pair", "row", F.when(group == "", name).otherwise(group).alias("group"), source.alias("source"), target.alias("target"), F.array_join(notes, "；").alias("note")).where("source <> '' and target <> ''")
    first = F.row_number().over(Window.partitionBy("group", "source", "target").orderBy("path", "pair", "row"))
    return e.withColumn("n", first).where("n = 1").select("group", "source", "target", "note")


def read_glossary(spark: SparkSession, path: str) -> DataFrame:
    """The entries of all CSV files below ``path``."""
    return glossary_entries(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")))


def normal_entries(entries: DataFrame) -> DataFrame:
    """Entries with white space collapsed, blank sources and targets dropped, each once."""
    columns = ["group", "source", "target", "note"]
    e = entries.select(*(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " ")).alias(c) for c in columns))
    return e.where("source <> '' and target <> ''").distinct()


def write_glossary(entries: DataFrame, path: str) -> None:
    normal_entries(entries).write.option("header", True).csv(path)
