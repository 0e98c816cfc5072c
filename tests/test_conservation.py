"""Aligned lists, kept and lost content, protected answers: against tables, whole texts and plain loops."""

import random
import time
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from cueloom.functions.text import _keep
from cueloom.operators import conservation as cv

CUES = "media_id long, cue_id long, start_ms long, end_ms long, text string"
LINES = "media_id long, pos long, line string"


def table_length(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for k, y in enumerate(b):
            t[i + 1][k + 1] = t[i][k] + 1 if x == y else max(t[i][k + 1], t[i + 1][k])
    return t[-1][-1]


def test_common_lines_are_as_many_as_the_table_says():
    rnd = random.Random(2)
    for _ in range(400):
        a, b = ([rnd.choice("abcdefg"[: rnd.randrange(2, 8)]) for _ in range(rnd.randrange(0, 25))] for _ in range(2))
        pairs = cv.common_lines(a, b)
        assert all(a[i] == b[k] for i, k in pairs) and len(pairs) == table_length(a, b)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_lists(spark):
    a = ["start", "one", "two", "three", "four", "five"]
    b = ["new", "one", "2", "four", "extra", "five"]
    rows = lambda m, x: [(m, i, v) for i, v in enumerate(x)]
    got = cv.align_lists(spark.createDataFrame(rows(1, a) + rows(2, ["x", "y"]) + rows(3, ["p", "q", "q"]), LINES), spark.createDataFrame(rows(1, b) + rows(2, ["y"]) + rows(4, ["z"]), LINES)).orderBy("media_id", "pos").collect()
    assert [(r.line, r.target_line, r.how) for r in got if r.media_id == 1] == [("start", "new", "changed"), ("one", "one", "same"), ("two", "2", "changed"), ("three", "2", "filled"), ("four", "four", "same"), ("five", "five", "same")]
    assert [(r.line, r.target_line, r.how) for r in got if r.media_id == 2] == [("x", None, "filled"), ("y", "y", "same")]
    assert {r.how for r in got if r.media_id == 3} == {"filled"} and all(r.target_line is None for r in got if r.media_id == 3) and {r.media_id for r in got} == {1, 2, 3}


def edited(rnd, texts):
    out = []
    for t in texts:
        kind = rnd.random()
        if kind < 0.1:
            continue
        if kind < 0.25:
            t = t[: len(t) // 2]
        elif kind < 0.4:
            t = t.replace("e", "", 1) + "q"
        out.append(t)
    return out


def test_retention_is_that_of_the_whole_texts(spark):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randrange(3, 9))) for _ in range(600)]
    files = {m: [" ".join(rnd.choice(words) for _ in range(rnd.randrange(2, 7))) for _ in range(rnd.randrange(1, 25))] for m in range(30)}
    after = {m: edited(rnd, x) for m, x in files.items()}
    rows = lambda d: [(m, i, i * 1000, i * 1000 + 900, t) for m, x in d.items() for i, t in enumerate(x)]
    got = {r.media_id: r for r in cv.stage_retention(spark.createDataFrame(rows(files), CUES), spark.createDataFrame(rows(after), CUES)).collect()}
    close = 0
    for m in files:
        a, b = ("".join(_keep(t, ()) for t in x[m]) for x in (files, after))
        whole = sum(k.size for k in SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks())
        assert (got[m].chars, got[m].target_chars) == (len(a), len(b))
        # anchors can only add matches that the longest blocks of a whole text cut off
        assert whole <= got[m].kept <= table_length(a, b) or abs(whole - got[m].kept) <= 0.01 * len(a), m
        close += got[m].kept == whole
    assert close >= 24


def test_occurrences_over_cue_boundaries(spark):
    s = spark.createDataFrame([(1, 1, 0, 1, "Ab, c"), (1, 2, 1, 2, "!"), (1, 3, 2, 3, "de f"), (2, 1, 0, 1, "abcdef")], CUES)
    w = spark.createDataFrame([(1, "abcd"), (1, "cdef"), (1, "f"), (1, "ba"), (2, "abcdef"), (2, "abcdefg"), (3, "a")], "media_id long, key string")
    assert sorted((r.media_id, r.key) for r in cv.occurs_in(w, s).collect()) == [(1, "abcd"), (1, "cdef"), (1, "f"), (2, "abcdef")]


def test_occurrences_are_those_of_whole_texts(spark):
    rnd = random.Random(21)
    files = {m: ["".join(rnd.choice(["ab", "c", "de", "É", "ﬁ", "雨", " ", ". "]) for _ in range(rnd.randrange(0, 9))) for _ in range(12)] for m in range(8)}
    rows = [(m, i, i, i + 1, t) for m, x in files.items() for i, t in enumerate(x)]
    wanted = {(m, "".join(rnd.choice("abcdeéfi雨") for _ in range(rnd.randrange(0, 5)))) for m in range(9) for _ in range(60)}
    for m, x in files.items():
        whole = "".join(_keep(t, ()) for t in x)
        wanted |= {(m, whole[i : i + n]) for i, n in ((rnd.randrange(len(whole)), rnd.randrange(1, 16)) for _ in range(40))} | {(m, _keep(w, ())) for t in x for w in t.split()}
        files[m] = whole
    want = {(m, k) for m, k in wanted if 1 <= len(k) <= 12 and k in files.get(m, "")}
    # few keys at a time, so that a file has several blocks of keys
    got = [tuple(r) for r in cv.occurs_in(spark.createDataFrame([*wanted, *wanted], "media_id long, key string"), spark.createDataFrame(rows, CUES), block=7).select("media_id", "key").collect()]
    assert set(got) == want and len(got) == len(want) > 200


def test_lost_content(spark):
    a = [(1, 1, 0, 1000, "はい。今日は雨が降っています"), (1, 2, 1000, 2000, "うん"), (1, 3, 7000, 7500, "川の道"), (1, 4, 10000, 12000, "山の上に月が出ています"), (1, 5, 20000, 21000, "ううん"), (1, 6, 30000, 31000, "長い道")]
    b = [(1, 1, 0, 1000, "今日は雨が降っています"), (1, 4, 10000, 12000, "山の上に月が出ています"), (1, 7, 12100, 13000, "出ています"), (1, 8, 15000, 16000, "うん"), (1, 9, 20000, 21000, "いや")]
    got = cv.content_conservation(spark.createDataFrame(a, CUES), spark.createDataFrame(b, CUES), ("split", "proofread"), spark.createDataFrame([(1, 9)], "media_id long, cue_id long"))
    assert sorted((r.severity, r.type, r.text) for r in got.collect()) == [
        ("FAIL", "content_retention", ""), ("FAIL", "missing_short_response", "はい"), ("FAIL", "missing_unique_text", "川の道"), ("FAIL", "missing_unique_text", "長い道"),
        ("WARN", "introduced_duplicate", "出ています"), ("WARN", "proofread_audio_evidence_changed_text", "ううん"), ("WARN", "short_response_timing_shifted", "うん")]
    short = cv.content_conservation(spark.createDataFrame(a, CUES), spark.createDataFrame([(1, 1, 0, 1000, "はい今日は雨"), *a[1:]], CUES), ("transcript", "align"), by_key=True)
    assert sorted((r.severity, r.type) for r in short.collect()) == [("FAIL", "alignment_fallback_too_short"), ("FAIL", "content_retention")]


def test_longest_common_substring(spark):
    rnd, rows = random.Random(7), []
    for _ in range(300):
        a, b = ("".join(rnd.choice("abcあ") for _ in range(rnd.randrange(0, 14))) for _ in range(2))
        best = max((n for i in range(len(a)) for n in range(len(a) - i + 1) if a[i : i + n] in b), default=0)
        assert cv.longest_common_substring(a, b) == best
        rows.append((a, b, best))
    df = spark.createDataFrame(rows, "a string, b string, best int")
    assert df.where(cv.common_substring_len(F.col("a"), F.col("b")) != F.col("best")).count() == 0


def test_spans():
    assert cv.normalised_span("では、はい。行く", "はい") == (3, 6)
    assert cv.normalised_span("ﬁne", "f") is None and cv.normalised_span("a ﬁ!", "fi") == (2, 4)
    assert cv.normalised_span("aab", "ab") == (1, 3) and cv.normalised_span("", "a") is None and cv.normalised_span("x", "") is None


def test_protected_answers(spark):
    c = [(1, 1, 0, 5000, "では、はい。行くよ、うん"), (1, 2, 5000, 6000, "はい"), (2, 1, 0, 4000, "前はい"), (3, 1, 0, 1000, "ただの文")]
    p = [(1, 1000, 1400, "はい"), (1, 4500, 5000, "うん。"), (1, 5900, 6100, "はい"), (2, 0, 400, "はい"), (3, 0, 100, "はい")]
    got = cv.protect_answers(spark.createDataFrame(c, CUES), spark.createDataFrame(p, "media_id long, start_ms long, end_ms long, text string")).orderBy("media_id", "cue_id", "part").collect()
    assert [(r.media_id, r.cue_id, r.start_ms, r.end_ms, r.text) for r in got] == [
        (1, 1, 0, 1000, "では、"), (1, 1, 1000, 1400, "はい。"), (1, 1, 1400, 4500, "行くよ、"), (1, 1, 4500, 5000, "うん"), (1, 2, 5000, 6000, "はい"),
        # the cut of file 2 would lose what stands before the answer, so nothing is cut there
        (2, 1, 0, 4000, "前はい"), (3, 1, 0, 1000, "ただの文")]


def test_many_answers_in_a_long_cue(spark):
    # each answer used to normalise the cue anew, four times over: minutes for this cue
    words = [f"Wort{i}ß" for i in range(3000)]
    c = [(1, 1, 0, 30_000, " ".join(words)), (1, 2, 30_000, 31_000, "rest")]
    p = [(1, i * 10, i * 10 + 10, w) for i, w in enumerate(words) if i % 2]
    began = time.time()
    got = cv.protect_answers(spark.createDataFrame(c, CUES), spark.createDataFrame(p, "media_id long, start_ms long, end_ms long, text string")).orderBy("cue_id", "part").collect()
    assert time.time() - began < 20
    assert [r.text.strip() for r in got] == [*words, "rest"] and [r.start_ms for r in got] == [i * 10 for i in range(3000)] + [30_000]


def test_answers_before_and_after_what_is_cut():
    assert cv.split_at_answers("a b c", 0, 9, [(0, 3, "a"), (3, 6, "b"), (6, 6, "c")]) == [("a ", 0, 3), ("b ", 3, 6), ("c", 6, 7)]
    # the first of equal words is taken in the part that holds the time; an answer that nothing says cuts nothing
    assert cv.split_at_answers("ja x ja", 0, 9, [(2, 3, "y"), (4, 6, "x"), (7, 9, "ja")]) == [("ja ", 0, 4), ("x ", 4, 6), ("ja", 7, 9)]
