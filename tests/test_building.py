"""Cue building against step-by-step versions on random tokens."""

import random

import pytest
from pyspark.sql import functions as F

from cueloom.operators import building as bd

PIECES = "media_id long, cue_id long, pos long, text string, start_ms long, end_ms long, owned_start long, owned_end long"


def stepwise_ranges(pieces, a, b):
    """Ranges one piece after the other, filling each run with a moving cursor."""
    n = len(pieces)
    b = max(b, a + n)
    got = []
    for s, e in pieces:
        s2 = max(a, min(s, b - 1))
        got.append((s2, max(s2 + 1, min(e, b))) if e > s else None)
    i = 0
    while i < n:
        if got[i] is None:
            j = i
            while j < n and got[j] is None:
                j += 1
            left, right = got[i - 1] if i else None, got[j] if j < n else None
            cursor = left[1] if left else a
            for k in range(i, j):
                rest = j - k
                if left and right and j - i <= right[0] - left[1] <= 800:
                    end = cursor + max(1, round((right[0] - cursor) / rest))
                else:
                    end = max(cursor + 1, min(cursor + 160, (right[0] if right else b) - rest + 1))
                got[k] = (cursor, end)
                cursor = end
            i = j
        i += 1
    out, cursor = [], a
    for k, (s, e) in enumerate(got):
        latest = max(cursor + 1, b - (n - k - 1))
        s = max(cursor, min(s, latest - 1))
        e = max(s + 1, min(e, latest))
        out.append((s, e))
        cursor = e
    return out


def test_repaired_ranges(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for cue in range(300):
        t, pieces = rnd.randrange(500), []
        for _ in range(rnd.randrange(1, 14)):
            step = rnd.choice([0, 0, 1, 3, 40, 200, 900])
            s = t + rnd.choice([0, 0, 0, 5, 60, -30, 2000 if rnd.random() < 0.05 else 0])
            pieces.append((s, s + step))
            t = s + step + rnd.choice([0, 0, 2, 7, 333, 900])
        a, b = rnd.randrange(300), rnd.randrange(300, 4000)
        rows += [(1, cue, p, "x", s, e, a, b) for p, (s, e) in enumerate(pieces)]
        want |= {(cue, p): x for p, x in enumerate(stepwise_ranges(pieces, a, b))}
    got = {(r.cue_id, r.pos): (r.start_ms, r.end_ms) for r in bd.repair_ranges(spark.createDataFrame(rows, PIECES)).collect()}
    assert {k: (v, want[k]) for k, v in got.items() if v != want[k]} == {} and len(got) == len(want)


@pytest.mark.parametrize("text,pieces,want", [
    ("«Oh, no!» she  said.", ["Oh", "no", "she", "said"], ["«Oh, ", "no!» ", "she  ", "said."]),
    ("はい、そうです。", ["はい", "そう", "です"], ["はい、", "そう", "です。"]),
    ("Ｆull ﬁne", ["full", "fine"], ["Ｆull ", "ﬁne"]),
    ("ﬁ", ["f", "i"], ["f", "i"]),
    ("other words", ["some", "words"], ["some", "words"]),
    ("a b", ["a", "-", "b"], ["a", "-", "b"]),
    ("Straße", ["stras", "se"], ["stras", "se"]),
    ("Tür auf", ["TÜR", "AUF"], ["Tür ", "auf"]),
])
def test_surface(spark, text, pieces, want):
    p = spark.createDataFrame([(1, 5, i, x, 0, 1, 0, 1) for i, x in enumerate(pieces)], PIECES)
    got = bd.restore_surface(p, spark.createDataFrame([(1, 5, text)], "media_id long, cue_id long, text string"))
    assert [r.text for r in got.orderBy("pos").collect()] == want


def test_repeats_at_boundaries(spark):
    texts = {1: "a b c d", 2: "c d e", 3: "e", 4: "e f", 5: "x e f", 6: "f g", 7: "q"}
    spans = {1: (0, 1000), 2: (900, 2000), 3: (1900, 3000), 4: (2900, 4000), 5: (3900, 5000), 6: (5000, 6000), 7: (5500, 7000)}
    p = spark.createDataFrame([(1, k, i, w, 0, 1, 0, 1) for k, t in texts.items() for i, w in enumerate(t.split())], PIECES)
    s = spark.createDataFrame([(1, k, *v) for k, v in spans.items()], "media_id long, cue_id long, start_ms long, end_ms long")
    got = {}
    for r in bd.drop_boundary_repeats(p, s).orderBy("cue_id", "pos").collect():
        got.setdefault(r.cue_id, []).append(r.text)
    # 3 repeats the e of 2 and vanishes, so 4 is compared with 2; 5 overlaps but begins otherwise; 6 touches 5 only
    assert got == {1: ["a", "b", "c", "d"], 2: ["e"], 4: ["f"], 5: ["x", "e", "f"], 6: ["f", "g"], 7: ["q"]}


def test_long_answers_are_narrowed(spark):
    rows = [(1, 1, 0, "はい。", 1000, 6000, 0, 0), (1, 1, 1, "ううん", 1000, 6001, 0, 0), (1, 1, 2, "はい", 1000, 4000, 0, 0), (1, 1, 3, "other", 0, 9000, 0, 0)]
    got = [(r.start_ms, r.end_ms) for r in bd.narrow_responses(spark.createDataFrame(rows, PIECES)).orderBy("pos").collect()]
    assert got == [(3250, 3750), (3250, 3750), (1000, 4000), (0, 9000)]


def test_unusable_segments_are_told(spark):
    seg = spark.createDataFrame([(1, 1, 0, 1000, "completed"), (1, 2, 900, 2000, "failed"), (1, 3, 2000, 3000, None), (1, 4, 3000, 4000, None), (1, 5, 4000, 5000, "failed")], "media_id long, cue_id long, start_ms long, end_ms long, status string")
    tok = spark.createDataFrame([(1, 1, 0, "hello", 100, 500), (1, 1, 1, "you", 500, 500), (1, 3, 0, "wrong", 2000, 2500), (1, 4, 0, "late", 3000, 3100)], "media_id long, cue_id long, pos long, token string, start_ms long, end_ms long")
    text = spark.createDataFrame([(1, 1, "Hello, you!"), (1, 2, "you never"), (1, 3, "right"), (1, 5, " ")], "media_id long, cue_id long, text string")
    err = spark.createDataFrame([(1, 1, "ok"), (1, 3, "ok"), (1, 4, "dense")], "media_id long, cue_id long, error string")
    cues, failed = bd.tokens_to_cues(seg, tok, text, err)
    assert [(r.cue_id, r.start_ms, r.end_ms, r.text, r.source) for r in cues.orderBy("cue_id", "pos").collect()] == [
        (1, 100, 500, "Hello, ", "tokens"), (1, 500, 660, "you!", "tokens"), (2, 950, 2000, "you never", "transcript"), (3, 2000, 3000, "right", "transcript")]
    assert sorted((r.cue_id, r.reason) for r in failed.collect()) == [(4, "dense"), (5, "status failed")]
    assert cues.where(F.col("end_ms") <= F.col("start_ms")).count() == 0


def test_windows_of_a_segment_are_united(spark):
    w = spark.createDataFrame([(1, 1, 2, 0, "two", 500, 900), (1, 1, 1, 0, "one", 0, 400), (1, 2, 1, 0, "x", 0, 1), (1, 4, 1, 0, "y", 0, 1)], "media_id long, cue_id long, window int, pos int, token string, start_ms long, end_ms long")
    text = spark.createDataFrame([(1, 1, "One, two."), (1, 2, "y"), (1, 3, "none"), (1, 4, "Y")], "media_id long, cue_id long, text string")
    err = spark.createDataFrame([(1, 1, "ok"), (1, 2, "ok"), (1, 4, "zero_run")], "media_id long, cue_id long, error string")
    got = {r.cue_id: (r.accepted, r.reason, [t.text for t in r.tokens or []]) for r in bd.merge_window_alignments(w, text, err).collect()}
    assert got == {1: (True, None, ["one", "two"]), 2: (False, "text_differs", []), 3: (False, "no_tokens", []), 4: (False, "zero_run", [])}
