"""Marks on cues, guards of suggestions and glossaries of several layouts, case by case."""

from cueloom.operators import suspects as su
from cueloom.sources import glossary as gl

CUES = "media_id long, cue_id long, start_ms long, end_ms long, types array<string>, reason string, confidence double"
ROWS = "media_id long, row_no long, start_ms long, end_ms long, key long, extra_key long, types array<string>, reason string"
SHIFT, LOW, MISS = "ass_short_dialogue_timing_shifted", "ass_low_score", "ass_short_dialogue_missing"


def test_marks(spark):
    cues = [(1, 1, 0, 1000, ["old"], "seen", 0.9), (1, 2, 2000, 3000, None, None, None), (1, 3, 20000, 21000, [], " ", 0.1), (1, 4, 40000, 41000, [], None, None)]
    rows = [
        (1, 2, 0, 500, 1, None, [LOW], "r2"), (1, 1, 0, 500, 1, 2, [MISS, LOW], "r1"),
        (1, 3, 3500, 4000, 99, None, [SHIFT], "r3"), (1, 4, 12500, 12600, None, 77, [SHIFT, LOW], "r4"), (1, 5, 60000, 60500, None, 3, [LOW], "r5"),
    ]
    got = {r.cue_id: (r.types, r.reason, r.confidence, r.asr_suspect, r.needs_realign) for r in su.apply_suspects(spark.createDataFrame(cues, CUES), spark.createDataFrame(rows, ROWS)).collect()}
    assert got[1] == (["old", MISS, LOW], "seen; r1; r2", 0.25, True, False)
    # row 1 names it besides, and row 3 lies nearest: first a hearing, then still one, as the missing type stays
    assert got[2] == ([MISS, LOW, SHIFT], "r1; r3", 0.25, True, False)
    # row 4 is 7,400 ms away and says shifted only; row 5 names it besides
    assert got[3] == ([SHIFT, LOW], "r4; r5", 0.1, False, True)
    assert got[4] == ([], "", None, False, False)


GUARD = "media_id long, cue_id long, original string, translation string, new_original string, new_translation string, reference string, confidence double, asr_suspect boolean, needs_audio_review boolean"


def test_reasons_of_suggestions(spark):
    long_ref = "今日は朝から雨が降っているので川へは行けません"
    cases = {
        "ass-long-reference-fragment-replacement": (long_ref[:14], "", "明日の山の道", "", long_ref),
        "ass-score-not-improved": ("今日は雨です", "", "まったく違う話", "", "今日は雨です"),
        "original-content-dropped-without-ass-reference": ("今日は雨が降る", "", "今日", "", None),
        "protected-short-response-replaced-without-ass-reference": ("はい", "", "そうです", "", ""),
        "short-response-expanded-without-ass-reference": ("川だ", "", "川だとは思っていませんでしたよ", "", " "),
        "no-ass-reference-original-change": ("川だ", "", "川です", "", None),
        "translation-abnormally-shortened": ("川", "今天早上一直在下雨所以", "NONE", "下雨", None),
    }
    rows = [(1, i, *v, 0.95, True, False) for i, v in enumerate(cases.values())]
    rows += [
        (2, 1, "今日は雨です", "今天", "今日は雨ですね", "今天下雨", "今日は雨ですね", 0.95, True, False), (2, 2, "今日は雨です", "今天", "今日は雨ですね", "今天下雨", "今日は雨ですね", 0.85, True, False),
        (2, 3, "今日は雨です", "今天", "今日は雨ですね", "今天下雨", "今日は雨ですね", 0.95, True, True), (2, 4, "今日は雨です", "今天", "rain", "It rains", None, None, True, False), (2, 5, "川", "河", None, "河流", None, 0.5, None, None),
    ]
    got = {(r.media_id, r.cue_id): r for r in su.suggestion_guard(spark.createDataFrame(rows, GUARD)).collect()}
    assert [got[1, i].reason for i in range(len(cases))] == list(cases)
    assert got[1, 6].field == "translation" and got[1, 0].field == "original" and got[1, 0].new_original is None
    new = lambda i: (got[2, i].reason, got[2, i].new_original, got[2, i].new_translation)
    assert new(1) == ("accepted", "今日は雨ですね", "今天下雨") and new(2) == ("accepted", None, "今天下雨") and new(3) == ("accepted", None, None)
    # a suggestion that loses the script is none
    assert new(4) == ("accepted", None, None) and new(5) == ("accepted", None, None)


def test_glossaries_of_three_layouts(spark, tmp_path):
    (tmp_path / "a.csv").write_text('group,source,target,note\nnames,川 島,河岛,"a, b"\n,道,路,\n,,x,\n', encoding="utf-8-sig")
    (tmp_path / "b.csv").write_text("日文,罗马音,中文,备注,通用日语,x,中文名\n山,yama,山峰,高い,海,,大海\n山,yama,山峰,again,空,,\n川,kawa,川,川,月,,月亮\n", encoding="utf-8")
    (tmp_path / "c.csv").write_text("Target,SOURCE\r\nwide  river,広い川\r\nroad,道\r\n", encoding="utf-8")
    (tmp_path / "d.csv").write_text("nothing,to see\n1,2\n", encoding="utf-8")
    got = gl.read_glossary(spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted([
        ("names", "川 島", "河岛", "a, b"), ("a", "道", "路", ""),
        ("日文", "山", "山峰", "高い"), ("日文", "川", "川", ""), ("通用日语", "海", "大海", ""), ("通用日语", "月", "月亮", ""),
        ("広い川", "広い川", "wide river", ""), ("道", "道", "road", "")])
    gl.write_glossary(got.unionByName(got), str(tmp_path / "out"))
    assert sorted(map(tuple, gl.read_glossary(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, got.collect()))
