"""Journals as streams, each job with the batch job that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "type string, segment_id bigint, seq bigint, value double, at timestamp"


def stream_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(EVENT).json(path)


def compact_journal(events: DataFrame, checkpoint: DataFrame | None = None) -> DataFrame:
    """The last event of each segment over an optional earlier state, with its number of events and first seq."""
    every = events if checkpoint is None else checkpoint.unionByName(events, allowMissingColumns=True)
    return every.groupBy("segment_id").agg(F.max_by("type", "seq").alias("type"), F.max_by("value", "seq").alias("value"), F.max("seq").alias("seq"), F.min("seq").alias("first_seq"), F.count("*").alias("events"))


def _versions(spark: SparkSession, table: str) -> list[int]:
    """The versions of a table that are whole, the oldest first."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/version=*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path) or []
    return sorted(int(f.getPath().getParent().getName().partition("=")[2]) for f in found)


def compact_stream(events: DataFrame, table: str, checkpoint_dir: str):
    """Merges each micro-batch into a table of the last event by segment: a version folder for each batch, of which the last two stay.

    A batch that is run again replaces its own version; what it merges into is the newest whole version before it.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        last = lambda d: d.groupBy("segment_id").agg(F.max_by(F.struct("type", "value", "seq"), "seq").alias("e")).select("segment_id", "e.*")
        new, before = last(batch), [v for v in _versions(spark, table) if v < number]
        if before:
            new = last(spark.read.parquet(f"{table}/version={before[-1]}").unionByName(new))
        new.write.mode("overwrite").parquet(f"{table}/version={number}")
        for old in before[:-1]:
            path = spark._jvm.org.apache.hadoop.fs.Path(f"{table}/version={old}")
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint_dir).trigger(availableNow=True).start()


def compacted(spark: SparkSession, table: str) -> DataFrame:
    """The newest whole version of a compacted journal."""
    return spark.read.parquet(f"{table}/version={_versions(spark, table)[-1]}")


def progress(events: DataFrame) -> DataFrame:
    """Done, failed and total by kind."""
    return events.groupBy("type").agg(F.count("*").alias("total"), F.count_if(F.col("value") >= 100).alias("done"), F.count_if(F.col("value") < 10).alias("failed"))


def rates(events: DataFrame, width: str = "1 hour", late: str = "30 minutes") -> DataFrame:
    """Events by kind in tumbling windows of event time."""
    return events.withWatermark("at", late).groupBy(F.window("at", width).alias("w"), "type").agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), "type", "events")


def sessions(events: DataFrame, gap: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Bursts of a segment's events with no gap of ``gap`` or more."""
    s = events.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "segment_id").agg(F.count("*").alias("events"))
    return s.select("segment_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def first_copies(events: DataFrame, late: str = "30 minutes") -> DataFrame:
    """Drops repeats of an event that arrive within the watermark."""
    return events.withWatermark("at", late).dropDuplicatesWithinWatermark(["segment_id", "seq"])


def checked(events: DataFrame, limits: DataFrame) -> DataFrame:
    """Stream-static join: events over the limit of limits(type, most)."""
    return events.join(limits, "type").where("value > most").select("segment_id", "seq", "type", "value", "most")


def review_state(edits: DataFrame, depth: int = 100) -> DataFrame:
    """Current value, edits and undo depth of each cue from edits(cue_id, revision, action, value).

    An undo takes back the newest edit that still stands, and at most ``depth``
    edits can be taken back. An edit stands when from it on every later stretch
    holds no more undos than edits, so the state is a window over the later rows.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("cue_id").orderBy("revision")
    after = Window.partitionBy("cue_id").orderBy(F.desc("revision"))
    e = edits.withColumn("step", F.when(F.col("action") == "edit", 1).otherwise(-1))
    e = e.withColumn("total", F.sum("step").over(w)).withColumn("low", F.min("total").over(after))
    stands = (F.col("step") == 1) & (F.col("total") <= F.col("low"))
    return e.groupBy("cue_id").agg(
        F.max_by("value", F.when(stands, F.col("revision"))).alias("value"), F.max("revision").alias("revision"), F.count_if(F.col("action") == "edit").alias("edits"), F.least(F.count_if(stands), F.lit(depth)).alias("undo_depth")
    )


class UndoStacks(StatefulProcessor):
    """Keeps the edits of a cue that still stand, the newest last; a stack that rests for ``idle_ms`` is forgotten, its value stays."""

    def __init__(self, depth: int, idle_ms: int | None):
        self.depth, self.idle_ms = depth, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.stack = handle.getListState("stack", "revision bigint, value double")
        self.told = handle.getValueState("told", "base double, revision bigint, edits bigint, timer bigint")

    def handleInputRows(self, key, rows, timerValues):
        base, revision, edits, timer = tuple(self.told.get()) if self.told.exists() else (None, 0, 0, None)
        stack = [tuple(x) for x in self.stack.get()] if self.stack.exists() else []
        for r in sorted(rows, key=lambda r: r.revision):
            revision = max(revision, r.revision)
            if r.action == "edit":
                edits += 1
                stack.append((r.revision, r.value))
                if len(stack) > self.depth:
                    base = stack.pop(0)[1]
            elif stack:
                stack.pop()
        if self.idle_ms is not None:
            if timer is not None:
                self.handle.deleteTimer(timer)
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.stack.clear()
        if stack:
            self.stack.put(stack)
        self.told.update((base, revision, edits, timer))
        yield Row(cue_id=key[0], value=stack[-1][1] if stack else base, revision=revision, edits=edits, undo_depth=len(stack), dirty=edits > 0)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        base, revision, edits, _ = tuple(self.told.get())
        stack = [tuple(x) for x in self.stack.get()] if self.stack.exists() else []
        value = stack[-1][1] if stack else base
        self.stack.clear()
        self.told.update((value, revision, edits, None))
        yield Row(cue_id=key[0], value=value, revision=revision, edits=edits, undo_depth=0, dirty=edits > 0)

    def close(self) -> None:
        pass


def review_stream(edits: DataFrame, depth: int = 100, idle_ms: int | None = None) -> DataFrame:
    """The stream twin of ``review_state``: each cue's value, revision, edits, undo depth and whether it was edited, after each batch with edits of it.

    The standing edits are kept as state, at most ``depth`` of them; the oldest becomes the value below which no undo reaches. The
    session needs the RocksDB state store (spark.sql.streaming.stateStore.providerClass).
    """
    return edits.groupBy("cue_id").transformWithState(
        statefulProcessor=UndoStacks(depth, idle_ms), outputStructType="cue_id bigint, value double, revision bigint, edits bigint, undo_depth int, dirty boolean",
        outputMode="Update", timeMode="None" if idle_ms is None else "ProcessingTime",
    )


def run_now(stream: DataFrame, name: str, mode: str = "complete"):
    """Runs a stream over what is there and returns its rows."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
