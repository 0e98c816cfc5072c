"""Small cases with known results."""

import random
import time
from difflib import SequenceMatcher

from cueloom.operators import alignment as al
from cueloom.operators import matching as mt
from cueloom.operators import segments as sg
from cueloom.operators import timing as tm
from cueloom.sources import subtitles as sb


def test_ties_are_merged_into_the_last_cue(spark):
    cues = spark.createDataFrame([(1, 1, 5200, 5200, "a"), (1, 2, 5200, 6100, "b")], "media_id long, cue_id long, start_ms long, end_ms long, text string")
    got = tm.normalize_timing(cues).collect()
    assert [(r.cue_id, r.text, r.start_ms) for r in got] == [(2, "ab", 5200)]


def test_batches(spark):
    rows = [(1, i + 1, ms) for i, ms in enumerate([12000, 13000, 14000, 48000, 92000])]
    s = spark.createDataFrame(rows, "media_id long, seg_idx long, duration_ms long")
    got = {r.seg_idx: (r.batch, r.singleton) for r in sg.plan_batches(s, 3, 40_000, 90_000).collect()}
    assert got[1][0] == got[2][0] == got[3][0] == 1 and got[5] == (1, True)


def test_window_ratio():
    assert mt.best_window_ratio("abc", "xxabcxx") == 1.0
    assert mt.best_window_ratio("", "a") == 0.0
    assert mt.best_window_ratio("abcd", "abxd") == 0.75


def test_text_match_takes_the_first_of_equal_cues(spark):
    d = spark.createDataFrame([(1, 1, 1000, 2000, "hello there"), (1, 2, 90000, 91000, "gone")], "media_id long, line_id long, start_ms long, end_ms long, text string")
    c = spark.createDataFrame([(1, 7, 900, 1500, "Hello, there!"), (1, 8, 1500, 2100, "hello there"), (1, 9, 1500, 2100, "other")], "media_id long, cue_id long, start_ms long, end_ms long, text string")
    got = {r.line_id: (r.cue_id, r.score) for r in mt.best_text_match(d, c).collect()}
    assert got == {1: (7, 1.0), 2: (None, 0.0)}


def test_ass_lines(spark):
    text = "[Events]\nDialogue: 0,0:00:07.10,0:00:08.35,Main,,0,0,0,,山の上\\N川の下\nDialogue: 0,0:00:09.00,0:00:11.20,Main,,0,0,0,,{\\i1}月の光\nDialogue: 0,0:00:09.00,0:00:11.20,Side,,0,0,0,,月の光\n"
    got = sb.parse_ass(spark.createDataFrame([("m", text)], "media_id string, content string")).collect()
    assert [(r.start_ms, r.end_ms, r.text) for r in got] == [(7100, 8350, "山の上 川の下"), (9000, 11200, "月の光")]


def test_files_and_journals(spark, tmp_path):
    (tmp_path / "a.srt").write_text("﻿1\n00:00:01,000 --> 00:00:02,000\nline one\nline <i>two</i>\n\nbroken\n\n3\n00:00:03.5 --> 00:00:03,000\nx\n")
    got = sb.parse_srt(sb.read_files(spark, str(tmp_path))).collect()
    assert [(r.media_id, r.start_ms, r.end_ms, r.text) for r in got] == [("a", 1000, 2000, "line one line two"), ("a", 3500, 3501, "x")]
    issues = {(r.block, r.issue) for r in sb.srt_legality(sb.read_files(spark, str(tmp_path))).collect()}
    assert (1, "short_block") in issues and (1, "bad_index") in issues and (2, "index_gap") in issues and (2, "non_positive") in issues
    j = tmp_path / "j"
    j.mkdir()
    (j / "x.jsonl").write_text('{"type": "a", "segment_id": 1, "seq": 1, "payload": {"k": "v"}}\n\nnot json\n')
    assert [(r.segment_id, r.payload) for r in sb.read_journal(spark, str(j)).collect()] == [(1, {"k": "v"})]


def test_nearby_batches(spark):
    from cueloom.operators.alignment import nearby_batches

    rows = [(1, 1, 0, 1000, 1, "a"), (1, 2, 1200, 2000, 1, "b"), (1, 3, 2100, 3000, 1, "c"), (1, 4, 3100, 4000, 2, "d")]
    c = spark.createDataFrame(rows, "media_id long, cue_id long, start_ms long, end_ms long, seg_idx long, text string")
    got = {r.cue_id: r.batch for r in nearby_batches(c, 2, 500).collect()}
    assert got[1] == got[2] and len({got[1], got[3], got[4]}) == 3


def test_sentence_units_share_the_time(spark):
    from cueloom.operators.alignment import sentence_units

    c = spark.createDataFrame([(1, 1, 0, 100, "aaaa. bbbbbb"), (1, 2, 200, 202, "a. b. c. d"), (1, 3, 300, 400, "whole")], "media_id long, cue_id long, start_ms long, end_ms long, text string")
    got = [(r.cue_id, r.start_ms, r.end_ms, r.text) for r in sentence_units(c).orderBy("cue_id", "unit_no").collect()]
    assert got[:2] == [(1, 0, 40, "aaaa"), (1, 40, 100, "bbbbbb")] and got[-1] == (3, 300, 400, "whole")
    assert all(e > s for _, s, e, _ in got)


def test_retention(spark):
    from cueloom.operators.alignment import content_retention

    schema = "media_id long, cue_id long, text string"
    a = spark.createDataFrame([(1, 1, "abcdefghij"), (2, 1, "same")], schema)
    b = spark.createDataFrame([(1, 1, "abcxefg"), (2, 1, "Same!")], schema)
    got = {r.media_id: (r.retention, r.status) for r in content_retention(a, b).collect()}
    assert got == {1: (0.6, "FAIL"), 2: (1.0, "PASS")}


def test_matched_characters_are_those_of_all_places_with_all():
    rnd = random.Random(3)

    def edited(a, letters):
        b = list(a)
        for _ in range(rnd.randrange(0, 6)):
            at = rnd.randrange(len(b) + 1)
            b[at : at + rnd.randrange(8)] = rnd.choice(letters) * rnd.randrange(2)
        return "".join(b) or "z"

    for n in range(900):
        letters = ("ab", "abcdefgh", "あ川é😀")[n % 3]
        a = "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 80)))
        b = edited(a, letters) if n % 2 else "".join(rnd.choice(letters) for _ in range(rnd.randrange(1, 80)))
        m = SequenceMatcher(None, a, b, autojunk=False)
        first = m.find_longest_match()
        want = (first.a, first.b, first.size) if first.size else None
        assert al.longest_run(a, b) == want
        assert al.shared_run(a, b, 3) in ([want] if first.size >= 5 else [want, None])
        assert al.matched_in_order(a, b, 0) == al.matched_in_order(a, b) == sum(t.size for t in m.get_matching_blocks())


def test_retention_of_a_long_file(spark):
    # comparing all places of equal letters took many minutes for such a file
    rnd = random.Random(4)
    cues = ["".join(rnd.choice("etaoinshr ") for _ in range(300)) for _ in range(400)]
    schema = "media_id long, cue_id long, text string"
    b = [(1, i, t[: 180 if i % 13 == 0 else 300]) for i, t in enumerate(cues) if i % 11]
    began = time.time()
    got = al.content_retention(spark.createDataFrame([(1, i, t) for i, t in enumerate(cues)], schema), spark.createDataFrame(b, schema)).collect()
    assert time.time() - began < 60
    whole, rest = (sum(len(t.replace(" ", "")) for t in x) for x in (cues, [t for _, _, t in b]))
    assert [(r.kept, r.chars) for r in got] == [(rest, whole)]


def test_responses_pair_with_the_nearest_unused(spark):
    from cueloom.operators.words import pair_responses

    schema = "media_id long, cue_id long, start_ms long, text string"
    a = spark.createDataFrame([(1, 1, 1000, "yes"), (1, 2, 1500, "Yes!"), (1, 3, 9000, "yes"), (1, 4, 0, "no")], schema)
    b = spark.createDataFrame([(1, 11, 1600, "yes"), (1, 12, 3000, "yes"), (1, 13, 20000, "yes")], schema)
    got = {r.cue_id: r.matched_id for r in pair_responses(a, b).collect()}
    assert got == {1: 11, 2: 12, 3: None, 4: None}


def test_tokens_group_by_pause_and_mark(spark):
    from cueloom.operators.words import group_tokens

    rows = [(1, 1, 0, "a", 0, 900), (1, 1, 1, "b.", 900, 1000), (1, 1, 2, "c", 1000, 2000), (1, 1, 3, "d", 4000, 4100), (2, 1, 0, "e", 0, 10)]
    got = [(r.media_id, r.cue_no, r.text) for r in group_tokens(spark.createDataFrame(rows, "media_id long, cue_id long, pos long, token string, start_ms long, end_ms long")).orderBy("media_id", "cue_no").collect()]
    assert got == [(1, 1, "a b."), (1, 2, "c"), (1, 3, "d"), (2, 1, "e")]
