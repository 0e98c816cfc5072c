"""What a later stage keeps of an earlier one: aligned lists, retained text, lost and repeated units, protected answers.

Stages are cues(media_id, cue_id, start_ms, end_ms, text). No row holds the text of a whole file:
equal cues are anchors, and only the stretches between anchors are compared character by character.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Callable
from difflib import SequenceMatcher
from itertools import accumulate

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cueloom.functions.text import _keep, norm_match, norm_strict
from cueloom.operators.alignment import sentence_units
from cueloom.operators.intervals import overlap_join
from cueloom.operators.quality import boundary_duplicates
from cueloom.operators.splitting import fold_groups

#: Answers that no stage may lose.
SHORT_RESPONSES = ("はい", "うん", "ううん", "え", "いや", "いいえ", "だめ", "ダメ")


def common_lines(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence, in memory that grows with the lists and not with their product.

    Equal ends are taken first; then the first list is halved where the
    subsequences of both halves are longest together.
    """
    import numpy as np

    out, todo = [], [(0, len(a), 0, len(b))]
    number: dict = {}
    x, y = (np.array([number.setdefault(v, len(number)) for v in side], np.int64) for side in (a, b))

    def lengths(rows, columns):
        row = np.zeros(len(columns) + 1, np.int64)
        for v in rows:
            row[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + (columns == v)))
        return row

    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and x[i] == y[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and x[j - 1] == y[m - 1]:
            j, m = j - 1, m - 1
            out.append((j, m))
        if i >= j or k >= m:
            continue
        if j - i == 1:
            hit = np.flatnonzero(y[k:m] == x[i])
            out += [(i, k + int(hit[0]))] if len(hit) else []
            continue
        mid = (i + j) // 2
        cut = k + int(np.argmax(lengths(x[i:mid], y[k:m]) + lengths(x[mid:j][::-1], y[k:m][::-1])[::-1]))
        todo += [(i, mid, k, cut), (mid, j, cut, m)]
    return sorted(out)


def align_lists(source: DataFrame, target: DataFrame) -> DataFrame:
    """media_id, pos, line, target_pos, target_line, how: every line of ``source(media_id, pos, line)`` with its line of ``target``.

    Equal lines of a longest common subsequence are paired (same). Between
    them, lines are paired in order (changed); source lines left over repeat the line before (filled), or have
    none at the start of a file; target lines left over are dropped.
    """
    rows = source.select("media_id", F.lit(0).alias("side"), "pos", "line").unionByName(target.select("media_id", F.lit(1).alias("side"), "pos", "line"))

    def fold(group: list[dict]) -> list[dict]:
        a, b = ([r for r in group if r["side"] == side] for side in (0, 1))
        out, i, k = [], 0, 0
        for x, y in [*common_lines([r["line"] for r in a], [r["line"] for r in b]), (len(a), len(b))]:
            for n in range(i, x):
                at = k + n - i
                how, at = ("changed", at) if at < y else ("filled", min(at, y) - 1)
                out.append((a[n], b[at] if at >= 0 else None, how))
            if x < len(a):
                out.append((a[x], b[y], "same"))
            i, k = x + 1, y + 1
        return [{"media_id": r["media_id"], "pos": r["pos"], "line": r["line"], "target_pos": t and t["pos"], "target_line": t and t["line"], "how": how} for r, t, how in out]

    return fold_groups(rows, ["media_id"], ["side", "pos"], fold, "media_id long, pos long, line string, target_pos long, target_line string, how string")


def matched_characters(a: str, b: str) -> Column:
    """Characters in the matching blocks of two texts."""

    @F.pandas_udf("long")
    def work(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([sum(m.size for m in SequenceMatcher(None, s or "", t or "", autojunk=False).get_matching_blocks()) for s, t in zip(x, y)], dtype="int64")

    return work(a, b)


def anchors(source: DataFrame, target: DataFrame, least_chars: int = 8) -> DataFrame:
    """(media_id, a, b): cues of equal normalised text that stand once in either stage and in the same order as all other such pairs."""

    def once(d: DataFrame, name: str) -> DataFrame:
        d = d.select("media_id", F.col("cue_id").alias(name), norm_match(F.col("text")).alias("key")).where(F.length("key") >= least_chars)
        return d.groupBy("media_id", "key").agg(F.min(name).alias(name), F.count("*").alias("n")).where("n = 1").drop("n")

    order = Window.partitionBy("media_id").orderBy("a")
    pairs = once(source, "a").join(once(target, "b"), ["media_id", "key"])
    pairs = pairs.withColumn("most", F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))).withColumn("least", F.min("b").over(order.rowsBetween(1, Window.unboundedFollowing)))
    return pairs.where("(most is null or most < b) and (least is null or least > b)").select("media_id", "a", "b", F.length("key").cast("long").alias("chars"))


def stage_retention(source: DataFrame, target: DataFrame, least: float = 0.90) -> DataFrame:
    """media_id, chars, target_chars, kept, retention, status: the share of a file's normalised text that its later stage keeps.

    Anchors are kept whole. Between two anchors the texts of both stages are
    compared by matching blocks, which is a comparison as long as the change and not as the file.
    """
    pairs = anchors(source, target)

    def stretches(d: DataFrame, side: str) -> DataFrame:
        """Texts between anchors by the number of anchors before them."""
        d = d.select("media_id", "cue_id", norm_match(F.col("text")).alias("key"))
        d = d.join(pairs.select("media_id", F.col(side).alias("cue_id"), F.lit(1).alias("anchor")), ["media_id", "cue_id"], "left")
        order = Window.partitionBy("media_id").orderBy("cue_id").rowsBetween(Window.unboundedPreceding, 0)
        d = d.withColumn("stretch", F.coalesce(F.sum("anchor").over(order), F.lit(0))).where("anchor is null")
        text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("cue_id", "key"))), lambda x: x["key"]), "")
        return d.groupBy("media_id", "stretch").agg(text.alias(side))

    both = stretches(source, "a").join(stretches(target, "b"), ["media_id", "stretch"], "full")
    both = both.select("media_id", F.coalesce("a", F.lit("")).alias("a"), F.coalesce("b", F.lit("")).alias("b"))
    rest = both.where("a <> b and a <> '' and b <> ''").select("media_id", F.length("a").cast("long").alias("chars"), F.length("b").cast("long").alias("target_chars"), matched_characters("a", "b").alias("kept"))
    easy = both.where("a = b or a = '' or b = ''").select("media_id", F.length("a").cast("long").alias("chars"), F.length("b").cast("long").alias("target_chars"), F.when(F.col("a") == F.col("b"), F.length("a")).otherwise(0).cast("long").alias("kept"))
    sure = pairs.select("media_id", "chars", F.col("chars").alias("target_chars"), F.col("chars").alias("kept"))
    out = rest.unionByName(easy).unionByName(sure).groupBy("media_id").agg(F.sum("chars").alias("chars"), F.sum("target_chars").alias("target_chars"), F.sum("kept").alias("kept"))
    out = out.join(source.select("media_id").distinct(), "media_id", "right").na.fill(0, ["chars", "target_chars", "kept"])
    out = out.withColumn("retention", F.round(F.col("kept") / F.greatest(F.lit(1), F.col("chars")), 6))
    return out.withColumn("status", F.when((F.col("chars") > 0) & (F.col("retention") < least), "FAIL").otherwise("PASS"))


def occurs_in(wanted: DataFrame, stage: DataFrame, longest: int = 12, block: int = 512) -> DataFrame:
    """The distinct rows of ``wanted(media_id, key)``, of at most ``longest`` characters, that stand in the stage's normalised text, over cue boundaries too.

    Keys that are whole words of the stage, in ASCII, are found by grouping. Only the others are sought in the cues of their file, ``block`` of them
    at a time; each cue is extended by the beginning of what follows it.
    """
    words = stage.select("media_id", F.explode(F.split("text", r"\s+")).alias("word")).where(F.col("word").rlike(r"^[\x00-\x7F]+$"))
    words = words.select("media_id", F.regexp_replace(F.lower("word"), "[^a-z0-9]", "").alias("key"), F.lit(False).alias("wanted"), F.lit(True).alias("there"))
    keys = wanted.select("media_id", "key", F.lit(True).alias("wanted"), F.lit(False).alias("there")).unionByName(words).where("media_id is not null")
    # the length is an aggregate so that its filter doesn't have the keys normalised twice
    keys = keys.groupBy("media_id", "key").agg(F.max("wanted").alias("wanted"), F.max("there").alias("there"), F.max(F.length("key")).alias("size")).where(F.col("wanted") & F.col("size").between(1, longest))

    nth = F.row_number().over(Window.partitionBy("media_id").orderBy("key"))
    rest = keys.where("not there").withColumn("part", F.floor((nth - 1) / block)).groupBy("media_id", "part").agg(F.collect_list("key").alias("keys"))
    order = Window.partitionBy("media_id").orderBy("cue_id")
    s = stage.select("media_id", "cue_id", norm_match(F.col("text")).alias("key")).where("key <> ''")
    after = F.array_join(F.collect_list(F.left("key", F.lit(longest - 1))).over(order.rowsBetween(1, longest - 1)), "")
    s = s.select("media_id", F.concat("key", F.left(after, F.lit(longest - 1))).alias("text"))
    sought = s.join(rest, "media_id").select("media_id", F.explode(F.filter("keys", lambda k: F.contains("text", k))).alias("key")).distinct()
    return keys.where("there").select("media_id", "key").unionByName(sought)


def repeats_at_boundaries(cues: DataFrame) -> DataFrame:
    """media_id, cue_id, key, start_ms, end_ms: what neighbours repeat, over both cues' time."""
    order = Window.partitionBy("media_id").orderBy("start_ms", "cue_id")
    c = cues.select("media_id", "cue_id", "text", F.lag("start_ms").over(order).alias("start_ms"), "end_ms").join(boundary_duplicates(cues).select("media_id", "cue_id", "chars"), ["media_id", "cue_id"])
    return c.select("media_id", "cue_id", F.left(norm_match(F.col("text")), F.col("chars").cast("int")).alias("key"), "start_ms", "end_ms")


def content_conservation(source: DataFrame, target: DataFrame, names: tuple[str, str], evidence: DataFrame | None = None, responses: tuple = SHORT_RESPONSES, margin_ms: int = 500, by_key: bool = False, sentences: Callable = sentence_units) -> DataFrame:
    """media_id, severity, type, source, target, text, start_ms, end_ms: what the later of two stages lost or repeats.

    - content_retention (FAIL): less than 90 % of the text is kept.
    - introduced_duplicate (WARN): neighbours repeat a text more often than before.
    - For each sentence unit: a short answer that isn't near its time any more
      is short_response_timing_shifted (WARN) if the file still has it, else missing_short_response (FAIL);
      a text of at most 12 characters that stood once and is gone from the file and from its time is missing_unique_text (FAIL).
      Where ``evidence(media_id, cue_id)`` names a target cue nearby, both are proofread_audio_evidence_changed_text (WARN).
    - With ``by_key``, a cue that has less than 60 % of the characters it had is alignment_fallback_too_short (FAIL).

    Equal issues are told once.
    """
    units = sentences(source).select("media_id", "cue_id", "unit_no", "start_ms", "end_ms", "text").withColumn("key", norm_match(F.col("text"))).where("key <> ''")
    often = F.count("*").over(Window.partitionBy("media_id", "key"))
    units = units.withColumn("often", often).withColumn("answer", F.col("key").isin(*responses)).where("answer or (length(key) <= 12 and often = 1)")
    near = overlap_join(units.select("media_id", "cue_id", "unit_no", "start_ms", "end_ms"), target.select("media_id", F.col("cue_id").alias("r_id"), F.col("start_ms"), F.col("end_ms"), norm_match(F.col("text")).alias("r_key")), margin_ms, closed=True)
    flagged = near.join(evidence.select("media_id", F.col("cue_id").alias("r_id"), F.lit(True).alias("heard")), ["media_id", "r_id"], "left") if evidence is not None else near.withColumn("heard", F.lit(None).cast("boolean"))
    local = flagged.groupBy("media_id", "cue_id", "unit_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_id", "r_key"))), lambda x: x["r_key"]), "").alias("local"), F.bool_or("heard").alias("heard"))
    u = units.join(local, ["media_id", "cue_id", "unit_no"], "left").withColumn("local", F.coalesce("local", F.lit("")))
    u = u.where((F.col("answer") & ~F.contains("local", "key")) | (~F.col("answer") & (F.length("local") < F.length("key") * 0.5)))
    u = u.join(occurs_in(u.select("media_id", "key").distinct(), target).withColumn("there", F.lit(True)), ["media_id", "key"], "left")
    u = u.where("answer or there is null").withColumn("kept", matched_characters("key", "local")).where(F.col("answer") | (F.col("local") == "") | (F.col("kept") < F.length("key") * 0.25))
    kind = F.when(F.col("there"), "short_response_timing_shifted").when(F.col("heard"), "proofread_audio_evidence_changed_text").when(F.col("answer"), "missing_short_response").otherwise("missing_unique_text")
    lost = u.select("media_id", kind.alias("type"), "text", "start_ms", "end_ms")

    poor = stage_retention(source, target).where("status = 'FAIL'").select("media_id", F.lit("content_retention").alias("type"), F.lit("").alias("text"), F.lit(None).cast("long").alias("start_ms"), F.lit(None).cast("long").alias("end_ms"))
    before = repeats_at_boundaries(source).groupBy("media_id", "key").agg(F.count("*").alias("n"))
    nth = F.row_number().over(Window.partitionBy("media_id", "key").orderBy("start_ms", "cue_id"))
    again = repeats_at_boundaries(target).withColumn("nth", nth).join(before, ["media_id", "key"], "left").where(F.col("nth") > F.coalesce("n", F.lit(0)))
    again = again.select("media_id", F.lit("introduced_duplicate").alias("type"), F.col("key").alias("text"), "start_ms", "end_ms")
    out = lost.unionByName(poor).unionByName(again)
    if by_key:
        j = source.select("media_id", "cue_id", "text", "start_ms", "end_ms", F.length(norm_match(F.col("text"))).alias("n")).join(target.select("media_id", "cue_id", F.length(norm_match(F.col("text"))).alias("m")), ["media_id", "cue_id"])
        out = out.unionByName(j.where("n > 0 and m < n * 0.6").select("media_id", F.lit("alignment_fallback_too_short").alias("type"), "text", "start_ms", "end_ms"))
    mild = F.col("type").isin("short_response_timing_shifted", "proofread_audio_evidence_changed_text", "introduced_duplicate")
    return out.select("media_id", F.when(mild, "WARN").otherwise("FAIL").alias("severity"), "type", F.lit(names[0]).alias("source"), F.lit(names[1]).alias("target"), "text", "start_ms", "end_ms").distinct()


def longest_common_substring(a: str, b: str) -> int:
    """By a suffix automaton of the first text, in time that grows with the sum of the lengths."""
    step, link, size, last = [{}], [-1], [0], 0
    for c in a:
        now = len(step)
        step.append({})
        link.append(0)
        size.append(size[last] + 1)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = now
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] != size[p] + 1:
                copy = len(step)
                step.append(dict(step[q]))
                link.append(link[q])
                size.append(size[p] + 1)
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = copy
                    p = link[p]
                link[q] = copy
                q = copy
            link[now] = q
        last = now
    best = at = n = 0
    for c in b:
        while at and c not in step[at]:
            at = link[at]
            n = size[at]
        if c in step[at]:
            at, n = step[at][c], n + 1
        best = max(best, n)
    return best


def common_substring_len(a: Column, b: Column) -> Column:
    """Length of the longest common substring; contained and disjoint texts don't reach Python."""

    @F.pandas_udf("int")
    def work(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series([longest_common_substring(s, t) if s and t else 0 for s, t in zip(x, y)], dtype="int32")

    inside = F.contains(a, b) | F.contains(b, a)
    return F.when(inside, F.least(F.length(a), F.length(b))).otherwise(F.coalesce(work(F.when(~inside, a), F.when(~inside, b)), F.lit(0)))


def normalised_places(text: str, seen: dict | None = None) -> tuple[str, list[int]]:
    """The strictly normalised text and the source character of each of its characters; ``seen`` keeps characters from text to text."""
    seen = {} if seen is None else seen
    norms = []
    for c in text:
        if c not in seen:
            seen[c] = _keep(c, ())
        norms.append(seen[c])
    return "".join(norms), [i for i, n in enumerate(norms) for _ in n]


def span_within(whole: str, places: list[int], wanted: str, i: int, k: int) -> tuple[int, int] | None:
    """Where characters i to k of a text with these ``normalised_places`` say ``wanted``, with the signs after it; None if nowhere.

    A match must begin and end with whole source characters.
    """
    first, last = bisect_left(places, i), bisect_left(places, k)
    at = first - 1
    while wanted and (at := whole.find(wanted, at + 1, last)) >= 0:
        stop = at + len(wanted)
        if (at == first or places[at] != places[at - 1]) and (stop == last or places[stop] != places[stop - 1]):
            return places[at], places[stop] if stop < last else k
    return None


def normalised_span(text: str, wanted: str) -> tuple[int, int] | None:
    """Where a text says ``wanted`` (strictly normalised), with the signs after it; None if nowhere."""
    return span_within(*normalised_places(text), wanted, 0, len(text))


def split_at_answers(text: str, start: int, end: int, answers: list[tuple], seen: dict | None = None) -> list[tuple]:
    """The parts (text, start, end) of a cue cut at the protected answers (start, end, wanted), sorted by start, that its parts hold.

    The cue is normalised once and parts are its stretches. First parts that end before all answers to come are left aside.
    """
    whole, places = normalised_places(text, seen)
    to_come = [*accumulate((min(s, e) for s, e, _ in reversed(answers)), min)][::-1]
    done, parts = [], deque([(0, len(text), start, end)])
    for (s, e, wanted), least in zip(answers, to_come):
        while parts and parts[0][3] < least:
            done.append(parts.popleft())
        cut = deque()
        for i, k, a, b in parts:
            span = span_within(whole, places, wanted, i, k) if a <= s and e <= b else None
            if span is None:
                cut.append((i, k, a, b))
                continue
            x, y = span
            if text[i:x].strip() and s > a:
                cut.append((i, x, a, s))
            cut.append((x, y, s, max(s + 1, e)))
            if text[y:k].strip() and b > e:
                cut.append((y, k, e, b))
        parts = cut
    return [(text[i:k], a, b) for i, k, a, b in [*done, *parts]]


def protect_answers(cues: DataFrame, answers: DataFrame) -> DataFrame:
    """media_id, cue_id, part, start_ms, end_ms, text: cues cut at the ``answers(media_id, start_ms, end_ms, text)`` that lie wholly inside them and are said there.

    Where a cut would lose content, all cues of the file stay as they are.
    """
    c = cues.select("media_id", "cue_id", "start_ms", "end_ms", "text")
    said = answers.select("media_id", "start_ms", "end_ms", norm_strict(F.col("text")).alias("wanted"))
    held = overlap_join(c, said, 0, closed=True).where("start_ms <= r_start and r_end <= end_ms and end_ms > start_ms")
    items = held.groupBy("media_id", "cue_id").agg(F.array_sort(F.collect_list(F.struct(F.col("r_start").alias("s"), F.col("r_end").alias("e"), "wanted"))).alias("items"))

    @F.pandas_udf("array<struct<text string, s long, e long>>")
    def cut(text: pd.Series, s: pd.Series, e: pd.Series, items: pd.Series) -> pd.Series:
        seen: dict = {}

        def one(t, a, b, found):
            if t is None or found is None:
                return None
            parts = split_at_answers(t, a, b, [(x["s"], x["e"], x["wanted"]) for x in found], seen)
            return [{"text": t, "s": a, "e": max(b, a + 1)} for t, a, b in parts if t.strip()]

        return pd.Series([one(*x) for x in zip(text, s, e, items)])

    # the cut is made once: a window tells whether any cue of the file would lose content
    done = c.join(items, ["media_id", "cue_id"], "left").withColumn("parts", cut("text", "start_ms", "end_ms", "items")).drop("items")
    same = norm_strict(F.array_join(F.transform("parts", lambda p: p["text"]), "")) == norm_strict(F.col("text"))
    done = done.withColumn("bad", F.col("parts").isNotNull() & ~same)
    done = done.withColumn("bad", F.bool_or("bad").over(Window.partitionBy("media_id")))
    whole = F.array(F.struct("text", F.col("start_ms").alias("s"), F.col("end_ms").alias("e")))
    done = done.withColumn("parts", F.when((F.size("parts") > 1) & ~F.col("bad"), F.col("parts")).otherwise(whole))
    done = done.select("media_id", "cue_id", F.posexplode("parts").alias("part", "p"))
    return done.select("media_id", "cue_id", "part", F.col("p.s").alias("start_ms"), F.col("p.e").alias("end_ms"), F.col("p.text").alias("text"))
