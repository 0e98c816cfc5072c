"""Queries over the given tables, and their SQL, by name."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}

for _name in ("interval_queries", "quality_queries", "text_queries", "stage_queries", "file_queries", "alignment_queries", "word_queries", "review_queries", "guard_queries", "building_queries", "conservation_queries", "suspect_queries", "rule_queries", "workdir_queries"):
    _module = importlib.import_module(f"cueloom.plans.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary of cue issues for each media file."""
    return QUERIES["media_issue_summary"](spark, sf_dir)
