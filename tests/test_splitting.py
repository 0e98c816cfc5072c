"""Rule splitting and smoothing: stretches against whole files, and single rules."""

import random

from cueloom.operators import splitting as sp

TOKENS = "media_id long, pos long, text string, start_ms long, end_ms long"
CUES = "media_id long, cue_id long, start_ms long, end_ms long, text string"
WORDS = ["and", "but", "stone", "river,", "their", "ours", "window", "go!", "yes.", "x", "時", "雨が", "はい、私は行く", "さあ！行こう", "。", "12", "for"]


def random_tokens(rnd, n):
    t, rows = 0, []
    for pos in range(n):
        t += rnd.choice([0, 0, 0, 0, 1, 5, 20, 90, 300, 499, 500, 501, 2000, -40])
        end = t + rnd.choice([0, 30, 120, 400, 1000])
        rows.append((pos, rnd.choice(WORDS), t, end))
        t = max(t, end)
    return rows


def test_stretches_give_what_the_whole_file_gives(spark):
    """A gap over 500 ms forgets all, so one pass over a whole file, which looks at that gap too, gives the same cues."""
    rnd, rules = random.Random(8), sp.SplitRules()
    files = {m: random_tokens(rnd, rnd.randrange(1, 160)) for m in range(25)}
    df = spark.createDataFrame([(m, *r) for m, rows in files.items() for r in rows], TOKENS).repartition(5)
    got = {}
    for r in sp.rule_split(df).orderBy("media_id", "cue_id").collect():
        got.setdefault(r.media_id, []).append((r.start_ms, r.end_ms, r.text))
    for m, rows in files.items():
        kept = []
        for pos, text, s, e in sorted((r for r in rows if r[1] != "。"), key=lambda r: (r[2], r[0])):
            kept.append({"media_id": m, "pos": pos, "start_ms": s, "end_ms": e, "text": text.lower() + " " if text.isascii() and text.isalnum() else text, "ends": text in ("go!", "さあ！")})
        want, group, recent = [], [], []
        for i, row in enumerate(kept):
            gap = row["start_ms"] - kept[i - 1]["end_ms"] if i else 0
            if i:
                recent = [*recent, gap][-5:]
                if len(recent) == 5 and gap > sum(recent) / 5 * 3 and len(group) > 5:
                    want.append(group)
                    group, recent = [], []
                if gap > 500:
                    want.append(group)
                    group, recent = [], []
            group.append(row)
        cues = []
        for g in [*want, group]:
            if g:
                # one group at a time, without gaps that end one
                shut = [dict(r) for r in g]
                cues += [(c["start_ms"], c["end_ms"], c["text"]) for c in sp.split_stretch(shut, sp.SplitRules(recent=10**6))]
        assert sorted(got.get(m, [])) == sorted(cues), m
    text = lambda rows: sorted("".join(x for x in "".join(rows).lower() if not x.isspace()))
    assert text(t for rows in got.values() for _, _, t in rows) == text(r[1] for rows in files.values() for r in rows if r[1] != "。")
    assert rules.max_words == 18


def test_cuts_at_the_widest_gap():
    texts = [f"w{i} " for i in range(30)]
    rules = sp.SplitRules()
    assert sp.widest_gap_cuts([i * 100 for i in range(30)], [i * 100 + 100 for i in range(30)], texts, rules) == [16]
    wide = [i * 100 + (300 if i > 12 else 0) for i in range(30)]
    assert sp.widest_gap_cuts(wide, [s + 100 for s in wide], texts, rules) == [13]


def test_common_words():
    rules = sp.SplitRules()
    assert sp.common_word_cuts(["a "] * 10 + ["but "] + ["a "] * 10, [], rules) == [10]
    assert sp.common_word_cuts(["a "] * 9 + ["but "] + ["a "] * 10, [], rules) == []
    assert sp.common_word_cuts(["a "] * 6 + ["b,"] + ["a "] * 3, [], rules) == [7]


def test_uneven_gaps():
    rules = sp.SplitRules()
    starts = [0, 100, 200, 300, 400, 500, 600, 1000, 1100]
    ends = [s + 100 for s in starts]
    assert sp.uneven_gaps(starts, ends, rules) == [7]
    assert sp.uneven_gaps(starts[2:], ends[2:], rules) == []


def test_dialogue_inside_a_line():
    assert sp.inline_parts("行く！そう？」はい") == ["行く！", "そう？」", "はい"]
    assert sp.inline_parts("はい、私は行く") == ["はい、", "私は行く"]
    assert sp.inline_parts("はい、今日は行く") == ["はい、今日は行く"]
    parts = sp.timed_parts(0, 1000, ["はい！", "そこにある大きな家です"], sp.SplitRules(fragments=()))
    assert parts[0][1] == parts[1][0] == 999 and parts[1][1] == 1000


def test_smoothing_in_stretches_is_smoothing_of_the_file(spark):
    rnd, rules = random.Random(3), sp.SmoothRules()
    texts = ["あの", "ね", "はい", "です", "けど", "そして", "3", "時", "今日は雨が降る", "ございます", "some words here", "すると", "まあね", "から", "だめ", "川"]
    files = {}
    for m in range(40):
        t, rows = 0, []
        for i in range(rnd.randrange(1, 60)):
            t = max(0, t + rnd.choice([0, 0, 0, 0, 40, 80, 81, 220, 221, 600, 7999, 8000, 8001, 9000, -200]))
            end = t + rnd.choice([1, 50, 119, 120, 300, 499, 500, 1500, 9500])
            rows.append((i, t, end, rnd.choice(texts)))
            t = end
        files[m] = rows
    df = spark.createDataFrame([(m, *r) for m, rows in files.items() for r in rows], CUES).repartition(4)
    got = {}
    for r in sp.smooth_cues(df).orderBy("media_id", "cue_id").collect():
        got.setdefault(r.media_id, []).append(sp.Cue(r.start_ms, r.end_ms, r.text))
    stretches = 0
    for m, rows in files.items():
        rows = sorted(rows, key=lambda r: (r[1], r[0]))
        want = sp.smooth_stretch([sp.Cue(s, e, t) for _, s, e, t in rows], rules)
        assert got[m] == want, m
        assert "".join(c.text for c in got[m]) == "".join(r[3] for r in rows)
        assert all(c.end - c.start <= 8000 for c in got[m])
        stretches += sum(b[1] - max(x[2] for x in rows[: i + 1]) > 8000 for i, b in enumerate(rows[1:]))
    assert stretches > 40


def test_smoothing_rules():
    r = sp.SmoothRules()
    cue = sp.Cue
    smooth = lambda *c: [(x.start, x.end, x.text) for x in sp.smooth_stretch([cue(*x) for x in c], r)]
    # a filler joins what is before it, unless that is an answer
    assert smooth((0, 1000, "今日は雨"), (1200, 1400, "まあね")) == [(0, 1400, "今日は雨まあね")]
    assert smooth((0, 1000, "はい"), (1200, 1400, "ね")) == [(0, 1000, "はい"), (1000, 1400, "ね")]
    # numbers join their unit, a tail joins its sentence across a long pause
    assert smooth((0, 600, "12"), (600, 1300, "時")) == [(0, 1300, "12時")]
    assert smooth((0, 3000, "川へ行きます"), (9000, 9700, "けど")) == [(0, 8000, "川へ行きますけど")]
    # a short cue grows into the silence after it, then into that before it
    assert smooth((1000, 1100, "川と山の道"), (1200, 3000, "今日は雨が降る"))[0] == (700, 1200, "川と山の道")
    # and none is shown for more than 8 s
    assert smooth((0, 20000, "今日は雨が降る"))[0] == (0, 8000, "今日は雨が降る")


def test_no_rows(spark):
    assert sp.rule_split(spark.createDataFrame([], TOKENS)).collect() == [] and sp.smooth_cues(spark.createDataFrame([], CUES)).collect() == []
