"""Rules and readers on values that the given tables don't hold."""

import json

from pyspark.sql import functions as F

from cueloom.operators import rules as ru
from cueloom.sources import workdirs as wd


def test_suspects_keep_the_marks_of_a_model(spark):
    rows = [("はい", "好", 0, 900, ["named"], "heard so", 0.9), ("そうか？", "这样。", 0, 900, [], "", 1.0), ("ミサキさん", "美咲", 0, 200, None, None, None), ("。。。", "x", 0, 100, [], "", 1.0), (None, None, 0, 0, [], "", 1.0)]
    df = spark.createDataFrame(rows, "text string, translated string, start_ms long, end_ms long, suspect_types array<string>, suspect_reason string, suspect_confidence double")
    got = ru.translation_suspects(df).collect()
    assert got[0].suspect_types == ["named", "short_response"] and got[0].suspect_reason == "heard so; short response needs audio confirmation" and got[0].suspect_confidence == 0.72
    assert got[1].suspect_types == ["question"]
    assert got[2].suspect_types == ["name", "time"] and got[2].suspect_confidence == 0.62
    assert [(r.suspect_types, r.suspect_confidence, r.asr_suspect) for r in got[3:]] == [([], 1.0, False)] * 2


def test_edits_after_proofreading(spark):
    ok = ("mimo-x", "うん、そうです", "うん、そうです", True, True, True, 0.5, 0.6, None)
    rows = [ok, ("manual", *ok[1:3], False, *ok[4:]), (*ok[:3], False, *ok[4:]), (*ok[:4], False, *ok[5:]), (*ok[:5], False, *ok[6:]), (*ok[:7], 0.4, None), (ok[0], "うんそうです", "そうです", *ok[3:]), (ok[0], "うんそうです", "そうです", *ok[3:8], "ass-improved"), (ok[0], None, None, True, True, True, None, None, None)]
    df = spark.createDataFrame(rows, "source string, before string, after string, has_evidence boolean, has_guard boolean, accepted boolean, current_score double, suggested_score double, guard_reason string")
    assert [r.issue for r in ru.post_edit_guard(df).collect()] == [None, None, "missing_evidence", "missing_ass_guard", "ass_guard_rejected_but_applied", "ass_score_regression", "content_regression_without_ass_support", None, None]


def test_suggestions_of_odd_answers(spark):
    rows = [(0, None), (1, "nothing"), (2, '{"i": 7, "t": "other", "s": " N/A ", "a": "Yes", "c": "much"}'), (3, '```json\n[{"id": "a", "error_type": "style_only", "so": "なし", "c": 3}]\n```'), (4, 'x [{"i": 1, "n": true, "o": "a]b"}] y'), (5, "[{]")]
    got = ru.suggestions(spark.createDataFrame(rows, "k long, content string")).orderBy("k").collect()
    assert [r.k for r in got if r.id] == [2, 3, 4]
    two, three, four = (r for r in got if r.id)
    assert (two.id, two.error_type, two.suggested_translation, two.asr_suspect, two.confidence) == ("7", "", "", True, 0.0)
    assert (three.error_type, three.suggested_original, three.confidence) == ("style_only", "", 1.0)
    assert four.needs_audio_review and four.original == "a]b"


def test_labels_and_corrections(spark):
    df = spark.createDataFrame([("あ え だめ!",), ("あっち だめ",), ("a—b\nc",), (None,)], "t string")
    assert [r.l for r in df.select(ru.label_text(F.col("t"), ["だめ"]).alias("l")).collect()] == ["だめ", "あっち だめ", "a b c", None]
    t = spark.createDataFrame([("one foo", "completed"), ("one foo", "failed"), (" ", "completed"), (None, "completed"), ("plain", None)], "text string, status string")
    got = ru.correct_transcripts(t, [("foo", "bar", False)]).collect()
    assert [(r.text, r.original_text, r.changed, r.reason) for r in got] == [("one bar", "one foo", True, "terms"), ("one foo", "one foo", False, "not-completed"), (" ", " ", False, "empty"), (None, None, False, "empty"), ("plain", "plain", False, "not-completed")]


def test_tokens_under_other_names(spark):
    rows = [(1, 1, 500, '{"timestamps": [{"token": "a", "start": 0.1}, {"text": "", "word": "b", "start_time": 1.0, "end_time": 1.2}], "words": []}'), (1, 2, 0, "[]"), (1, 3, 0, None)]
    got = wd.globalise_tokens(spark.createDataFrame(rows, "media_id long, seg_idx long, offset_ms long, content string")).orderBy("pos").collect()
    assert [(r.seg_idx, r.token, r.start_ms, r.end_ms) for r in got] == [(1, "a", 600, 600), (1, "b", 1500, 1700)]


def test_written_files_are_read_back(spark, tmp_path):
    folder = tmp_path / "in" / "ep1"
    folder.mkdir(parents=True)
    (folder / "aligned.json").write_text("﻿" + json.dumps([{"segment_id": "a", "start_time": 0.0, "end_time": 1.5, "tokens": [{"text": "x", "start_time": 0.2, "end_time": 0.4}]}]))
    (folder / "broken.json").write_text("{")
    (row,) = wd.read_segment_files(spark, str(tmp_path / "in" / "*")).collect()
    assert (row.media_id, row.end_ms, row.tokens[0].start_ms, row.text) == ("ep1", 1500, 200, None)

    issues = wd.union_issues({"a": spark.createDataFrame([(1, ["p", "q"])], "id long, kinds array<string>"), "b": spark.createDataFrame([(2, 0.5)], "id long, score double")})
    for kind in ("jsonl", "tsv", "csv"):
        wd.write_issues(issues, str(tmp_path / kind), kind)
    back = spark.read.csv(str(tmp_path / "tsv"), sep="\t", header=True).orderBy("id").collect()
    assert [(r.id, r.kinds, r.score, r.report) for r in back] == [("1", "p,q", None, "a"), ("2", None, "0.5", "b")]
    assert spark.read.json(str(tmp_path / "jsonl")).where("score = 0.5").count() == 1


def test_lines_without_what_they_repeat(spark):
    rows = [(1, 1, "we go home", "completed"), (1, 2, "go home now", "completed"), (1, 3, "now", "completed"), (1, 4, "bad", "failed"), (1, 5, "nowhere", "completed"), (2, 1, " ", "completed"), (3, 1, "abcdef", "completed"), (3, 2, "defghi", "completed")]
    got = wd.plain_text(spark.createDataFrame(rows, "media_id long, seg_idx long, text string, status string"))
    assert {r.media_id: r.content for r in got.collect()} == {1: "we go home\nnow\nhere\n", 3: "abcdef\nghi\n"}


def test_last_file_of_a_number_counts(spark):
    names = ["/a/x #2.mp3", "/a/x #02.MP3", "/a/x #2.ass", "/a/x #10.ass", "/a/y.mp3", "/a/#10 z.mp3"]
    got = wd.discover_pairs(spark.createDataFrame([(n,) for n in names], "path string")).orderBy("episode").collect()
    assert [tuple(r) for r in got] == [(2, "/a/x #2.mp3", "/a/x #2.ass"), (10, "/a/#10 z.mp3", "/a/x #10.ass")]
    assert wd.discover_pairs(spark.createDataFrame([(n,) for n in names], "path string"), "10").count() == 1


def test_word_files_without_times_or_words(spark):
    files = [(1, '{"segments": [{"text": "s", "start": 1.0, "end": 2.0, "words": [{"word": "a"}, {"word": " "}]}, {"text": "t", "start": 3}]}'), (2, '{"segments": [{"text": "u", "start": 1.0, "end": 1.0}, {"text": ""}]}'), (3, "{}"), (4, None)]
    got = wd.flatten_word_json(spark.createDataFrame(files, "media_id long, content string")).orderBy("media_id", "pos").collect()
    assert [(r.media_id, r.text, r.start_ms, r.end_ms) for r in got] == [(1, "a", 1000, 2000), (2, "u", 1000, 1020)]
