"""Each stream gives the rows of its batch twin."""

import json
import os
import random

import pytest

from cueloom.streaming import journal as jn


@pytest.fixture()
def folder(spark, tmp_path):
    rows = [{"type": "done" if i % 3 else "fail", "segment_id": i % 7, "seq": i, "value": float(i), "at": f"2024-01-01T{i // 60 % 24:02d}:{i % 60:02d}:00Z"} for i in range(400)]
    path = tmp_path / "journal"
    path.mkdir()
    for k in range(4):
        (path / f"{k}.json").write_text("\n".join(json.dumps(r) for r in rows[k * 100 : k * 100 + 100]) + "\n\n")
    return str(path)


def sorted_rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_progress_stream(spark, folder):
    batch = jn.progress(spark.read.schema(jn.EVENT).json(folder))
    assert sorted_rows(jn.run_now(jn.progress(jn.stream_events(spark, folder)), "progress_now")) == sorted_rows(batch)


def test_rates_and_sessions(spark, folder):
    events = spark.read.schema(jn.EVENT).json(folder)
    assert sorted_rows(jn.run_now(jn.rates(jn.stream_events(spark, folder)), "rates_now")) == sorted_rows(jn.rates(events))
    got = {tuple(r) for r in jn.run_now(jn.sessions(jn.stream_events(spark, folder), "5 minutes"), "sessions_now", "append").collect()}
    want = {tuple(r) for r in jn.sessions(events, "5 minutes").collect()}
    # sessions that end before the watermark are out, those that may still grow aren't
    last = max(r[2] for r in want)
    closed = {r for r in want if (last - r[2]).total_seconds() > 36 * 60}
    assert closed and closed <= got <= want


def test_first_copies(spark, folder):
    s = jn.stream_events(spark, folder)
    assert jn.run_now(jn.first_copies(s.unionByName(s)), "copies_now", "append").count() == 400


def test_compact_stream_over_several_batches(spark, folder, tmp_path):
    table, ck = str(tmp_path / "table"), str(tmp_path / "ck")
    one_by_one = spark.readStream.schema(jn.EVENT).option("maxFilesPerTrigger", 1).json(folder)
    jn.compact_stream(one_by_one, table, ck).awaitTermination()
    want = jn.compact_journal(spark.read.schema(jn.EVENT).json(folder)).select("segment_id", "type", "value", "seq")
    got = lambda: sorted_rows(jn.compacted(spark, table).select("segment_id", "type", "value", "seq"))
    assert got() == sorted_rows(want) and jn._versions(spark, table) == [2, 3]
    # more events, one of them late: the stream goes on from its checkpoint
    more = [{"type": "late", "segment_id": 1, "seq": 1, "value": 0.0}, {"type": "new", "segment_id": 99, "seq": 500, "value": 1.0}, {"type": "done", "segment_id": 2, "seq": 501, "value": 7.0}]
    with open(folder + "/9.json", "w") as f:
        f.write("\n".join(map(json.dumps, more)))
    jn.compact_stream(one_by_one, table, ck).awaitTermination()
    assert got() == sorted_rows(jn.compact_journal(spark.read.schema(jn.EVENT).json(folder)).select("segment_id", "type", "value", "seq")) and jn._versions(spark, table) == [3, 4]


def test_undo_depth_as_state(spark, tmp_path):
    """Three batches of edits and undos: after each, the state is that of the batch job over all so far."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        rnd = random.Random(4)
        rows = [{"cue_id": rnd.randrange(6), "revision": n, "action": rnd.choice(["edit", "edit", "undo"]), "value": float(n)} for n in range(120)]
        schema, path = "cue_id bigint, revision bigint, action string, value double", tmp_path / "edits"
        path.mkdir()
        for k in range(3):
            (path / f"{k}.json").write_text("\n".join(map(json.dumps, rows[k * 40 : k * 40 + 40])))
            os.utime(path / f"{k}.json", (1_700_000_000 + k, 1_700_000_000 + k))
        seen = []
        stream = jn.review_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(path)))
        q = stream.writeStream.foreachBatch(lambda d, n: seen.append(d.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
        q.awaitTermination()
        state, seen = {}, [b for b in seen if b]
        assert len(seen) == 3
        for k, batch in enumerate(seen):
            state |= {r.cue_id: (r.value, r.revision, r.edits, r.undo_depth) for r in batch}
            upto = spark.createDataFrame([tuple(r.values()) for r in rows[: k * 40 + 40]], schema)
            assert state == {r.cue_id: (r.value, r.revision, r.edits, r.undo_depth) for r in jn.review_state(upto).collect()}
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_undo_takes_back_the_newest_standing_edit(spark):
    rows = [(1, 1, "edit", 1.0), (1, 2, "edit", 2.0), (1, 3, "undo", 0.0), (1, 4, "edit", 3.0), (1, 5, "undo", 0.0), (2, 1, "undo", 0.0), (2, 2, "edit", 5.0), (3, 1, "edit", 1.0), (3, 2, "undo", 0.0)]
    got = {r.cue_id: (r.value, r.undo_depth) for r in jn.review_state(spark.createDataFrame(rows, "cue_id int, revision int, action string, value double")).collect()}
    assert got == {1: (1.0, 1), 2: (5.0, 1), 3: (None, 0)}
