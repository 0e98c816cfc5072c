"""Timed-transcript tables derived from the given tables, and the same derivations as DuckDB SQL.

cue(media_id, cue_id, start_ms, end_ms, text, role) comes from conversations,
segment(media_id, seg_idx, start_ms, end_ms, duration_ms) from lineitem, and
region(media_id, region_id, start_ms, end_ms) from events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage A: one cue for each turn; neighbours overlap or leave gaps by rule."""
    t = read(spark, sf_dir, "conversations")
    media = Window.partitionBy("conv_id").orderBy("turn")
    dur = 300 + 40 * (F.length("text") % 200)
    gap = (F.col("conv_id") * 31 + F.col("turn") * 17) % 1200 - 200
    t = t.withColumn("dur", dur.cast("long")).withColumn("gap", gap)
    start = F.coalesce(F.sum(F.col("dur") + F.col("gap")).over(media.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return t.withColumn("start_ms", start).select(
        F.col("conv_id").alias("media_id"), (F.col("turn") + 1).alias("cue_id"), "start_ms", (F.col("start_ms") + F.col("dur")).alias("end_ms"), "text", "role"
    )


def regressed_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage B: some cues of stage A missing, cut to 60 % of their text, or 2.5 s late."""
    turn = F.col("cue_id") - 1
    late = F.when((F.col("media_id") + turn) % 17 == 0, 2500).otherwise(0)
    cut = F.when((F.col("media_id") + turn) % 13 == 0, F.expr("substr(text, 1, int(length(text) * 6 div 10))")).otherwise(F.col("text"))
    return (
        cues(spark, sf_dir)
        .where((F.col("media_id") * 7 + turn) % 11 != 0)
        .select("media_id", "cue_id", (F.col("start_ms") + late).alias("start_ms"), (F.col("end_ms") + late).alias("end_ms"), cut.alias("text"), "role")
    )


def dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reference lines: stage A shifted by 6,180 ms."""
    return cues(spark, sf_dir).select("media_id", F.col("cue_id").alias("line_id"), (F.col("start_ms") + 6180).alias("start_ms"), (F.col("end_ms") + 6180).alias("end_ms"), F.col("role").alias("style"), "text")


def translated_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stage A with the next turn's text as translation, blank for every ninth turn."""
    nxt = F.lead("text").over(Window.partitionBy("media_id").orderBy("cue_id"))
    return cues(spark, sf_dir).withColumn("translated", F.when((F.col("cue_id") - 1) % 9 == 0, "").otherwise(F.coalesce(nxt, F.lit(""))))


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One audio segment for each order line, end to end, 3 to 150 s long."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate", "l_quantity")
    s = read(spark, sf_dir, "lineitem").withColumn("duration_ms", (F.col("l_quantity") * 3000).cast("long"))
    end = F.sum("duration_ms").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return s.select(
        F.col("l_orderkey").alias("media_id"), F.row_number().over(order).cast("long").alias("seg_idx"), (end - F.col("duration_ms")).alias("start_ms"), end.alias("end_ms"), "duration_ms"
    )


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speech regions: one for each event, a real second being one millisecond."""
    start = F.expr("unix_micros(cast(ts as timestamp)) div 1000000 - 1704067200")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("media_id"), F.col("event_id").alias("region_id"), start.alias("start_ms"), (start + F.floor(F.col("value") * 100).cast("long")).alias("end_ms")
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of stage A with the cue's time shared out by length; every seventh has no duration."""
    t = cues(spark, sf_dir).select("media_id", "cue_id", "start_ms", "end_ms", F.posexplode(F.split("text", " ")).alias("pos", "token"))
    cue = Window.partitionBy("media_id", "cue_id")
    run = cue.orderBy("pos")
    w = F.length("token") + 1
    upto, total = F.sum(w).over(run.rowsBetween(Window.unboundedPreceding, 0)), F.sum(w).over(cue)
    t = t.withColumn("before", upto - w).withColumn("upto", upto).withColumn("total", total)
    at = lambda c: F.expr(f"start_ms + (end_ms - start_ms) * {c} div total")
    return t.select(
        "media_id", "cue_id", F.col("pos").cast("long").alias("pos"), "token",
        at("before").alias("start_ms"), F.when(F.col("pos") % 7 == 6, at("before")).otherwise(at("upto")).alias("end_ms"),
        F.col("start_ms").alias("cue_start"), F.col("end_ms").alias("cue_end"),
    )


#: The same tables in DuckDB, to be put before a query.
SQL = {
    "cue": """cue AS (SELECT conv_id AS media_id, turn + 1 AS cue_id, start_ms, start_ms + dur AS end_ms, text, role FROM (
  SELECT *, coalesce(sum(dur + gap) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ms FROM (
    SELECT *, 300 + 40 * (length(text) % 200) AS dur, (conv_id * 31 + turn * 17) % 1200 - 200 AS gap FROM conversations)))""",
    "cue_b": """cue_b AS (SELECT media_id, cue_id, start_ms + late AS start_ms, end_ms + late AS end_ms,
  CASE WHEN (media_id + cue_id - 1) % 13 = 0 THEN substr(text, 1, length(text) * 6 // 10) ELSE text END AS text, role
  FROM (SELECT *, CASE WHEN (media_id + cue_id - 1) % 17 = 0 THEN 2500 ELSE 0 END AS late FROM cue) WHERE (media_id * 7 + cue_id - 1) % 11 <> 0)""",
    "dialogue": "dialogue AS (SELECT media_id, cue_id AS line_id, start_ms + 6180 AS start_ms, end_ms + 6180 AS end_ms, role AS style, text FROM cue)",
    "translated": "translated AS (SELECT *, CASE WHEN (cue_id - 1) % 9 = 0 THEN '' ELSE coalesce(lead(text) OVER (PARTITION BY media_id ORDER BY cue_id), '') END AS translated FROM cue)",
    "segment": """segment AS (SELECT l_orderkey AS media_id, row_number() OVER w AS seg_idx, (sum(d) OVER w - d)::BIGINT AS start_ms, (sum(d) OVER w)::BIGINT AS end_ms, d AS duration_ms
  FROM (SELECT *, (l_quantity * 3000)::BIGINT AS d FROM lineitem)
  WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""",
    "region": "region AS (SELECT user_id AS media_id, event_id AS region_id, epoch_us(ts) // 1000000 - 1704067200 AS start_ms, epoch_us(ts) // 1000000 - 1704067200 + floor(value * 100)::BIGINT AS end_ms FROM events)",
    "token": """token AS (SELECT media_id, cue_id, pos, token, start_ms + (end_ms - start_ms) * (upto - w) // total AS start_ms,
  CASE WHEN pos % 7 = 6 THEN start_ms + (end_ms - start_ms) * (upto - w) // total ELSE start_ms + (end_ms - start_ms) * upto // total END AS end_ms, start_ms AS cue_start, end_ms AS cue_end
  FROM (SELECT *, length(token) + 1 AS w, (sum(length(token) + 1) OVER (PARTITION BY media_id, cue_id ORDER BY pos))::BIGINT AS upto, (sum(length(token) + 1) OVER (PARTITION BY media_id, cue_id))::BIGINT AS total
    FROM (SELECT media_id, cue_id, start_ms, end_ms, unnest(string_split(text, ' ')) AS token, generate_subscripts(string_split(text, ' '), 1) - 1 AS pos FROM cue)))""",
}
NEEDS = {"cue_b": ["cue"], "dialogue": ["cue"], "translated": ["cue"], "token": ["cue"]}


def with_tables(names: str, body: str) -> str:
    """``body`` after the definitions of the named derived tables."""
    wanted: list[str] = []
    for n in names.split():
        for x in [*NEEDS.get(n, []), n]:
            if x not in wanted:
                wanted.append(x)
    return "WITH " + ",\n".join(SQL[n] for n in wanted) + "\n" + body
