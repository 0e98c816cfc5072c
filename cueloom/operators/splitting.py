"""Cues from timed words by rules, and the smoothing of short cues.

Both are folds along a media file whose state ends at known silences, so a file is
first cut there by a window; each stretch is read as a sorted stream of its rows, and no
task needs a whole file. The decisions are small functions on lists of numbers and texts.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cueloom.functions.text import count_words, mainly_unspaced, pure_punctuation

#: Words before which, and after which, a long line may be cut.
CUT_BEFORE = (
    "and", "or", "but", "if", "then", "because", "as", "until", "while", "what", "when", "where", "nor", "yet", "so", "for", "however", "moreover",
    "和", "或", "与", "但", "而", "因", "你", "他", "她", "它", "您", "这", "那", "哪",
)
CUT_AFTER = (
    ".", ",", "!", "?", "。", "，", "！", "？", "的", "了", "着", "过", "吗", "呢", "吧", "啊", "呀", "嘛", "啦", "mine", "yours", "hers", "its", "ours", "theirs", "either", "neither",
)
#: Fixed value: the end of a sentence, with closing brackets.
SENTENCE_END = "[。！？!?][」』）》】]*\\s*$"
#: A strong mark inside a line, an answer that opens it, and what must follow that answer.
INNER_MARK = "([。！？!?]+[」』）》】]*)(?=\\S)"
OPENING_ANSWER = "^(\\s*(?:はい|うん|ええ|いいえ|いや)[、,]+)"
AFTER_ANSWER = ("私", "僕", "俺", "あたし", "わたし")

_UNSPACED = re.compile("[一-鿿぀-ヿ가-힯฀-໿က-႟ក-៿ऀ-෿]")
_SIGNS = re.compile("[。、，！？,.!?;:；：・\\s]")


def words_in(text: str) -> int:
    """Characters of scripts without spaces, and words of the rest."""
    return len(_UNSPACED.findall(text)) + len(_UNSPACED.sub(" ", text).split())


def bare(text: str) -> str:
    return _SIGNS.sub("", text.strip())


def fold_groups(rows: DataFrame, keys: list[str], order: list[str], fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """``fold`` over the rows of each group, in order; groups are read one by one from a sorted stream."""
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def work(batches):
        import pyarrow as pa

        stream = (row for batch in batches for row in batch.to_pylist())
        out: list[dict] = []
        for _, group in itertools.groupby(stream, key=lambda r: tuple(r[k] for k in keys)):
            out += fold(list(group))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_pylist(out, schema=kind)
                out = []
        yield pa.RecordBatch.from_pylist(out, schema=kind)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(work, schema)


# ---- rule_split ----


@dataclass(frozen=True)
class SplitRules:
    gap_ms: int = 500
    max_words: int = 18
    recent: int = 5
    times_mean: int = 3
    before_share: float = 0.6
    after_share: float = 0.4
    least_tokens: int = 4
    cut_before: tuple = CUT_BEFORE
    cut_after: tuple = CUT_AFTER
    least_answer_ms: int = 1500
    #: Texts (normalised) that aren't lengthened as short utterances.
    fragments: tuple = ()


def uneven_gaps(starts: list[int], ends: list[int], rules: SplitRules) -> list[int]:
    """Where new groups begin inside a stretch: a gap over three times the mean of the last five, it included, after more than five tokens."""
    begins, recent, since = [], [], 0
    for i in range(1, len(starts)):
        gap = starts[i] - ends[i - 1]
        recent = [*recent, gap][-rules.recent :]
        if len(recent) == rules.recent and gap > sum(recent) / rules.recent * rules.times_mean and i - since > rules.recent:
            begins.append(i)
            recent, since = [], i
    return begins


def common_word_cuts(texts: list[str], unspaced: list[bool], rules: SplitRules) -> list[int]:
    """Where parts of a long group begin: before an opening word or after a closing one, once the part is long enough."""
    begins, size = [], 0
    for i, text in enumerate(texts):
        if size >= int(rules.max_words * rules.before_share) and text.lower().startswith(rules.cut_before):
            begins.append(i)
            size = 0
        if i and size >= int(rules.max_words * rules.after_share) and texts[i - 1].lower().endswith(rules.cut_after):
            begins.append(i)
            size = 0
        size += 1
    return begins


def widest_gap_cuts(starts: list[int], ends: list[int], texts: list[str], rules: SplitRules) -> list[int]:
    """Where parts begin after cutting at the widest gap of the middle, again and again, until parts are short enough or can't be cut."""
    begins, todo = [], [(0, len(starts))]
    while todo:
        a, b = todo.pop()
        n = b - a
        if n < rules.least_tokens or words_in("".join(texts[a:b])) <= rules.max_words:
            continue
        gaps = [starts[j + 1] - ends[j] for j in range(a, b - 1)]
        middle = range(max(n // 6, 1), min(5 * n // 6, n - 2))
        cut = n // 2 if max(gaps) == min(gaps) or not middle else max(middle, key=lambda j: (gaps[j], -j))
        begins.append(a + cut + 1)
        todo += [(a, a + cut + 1), (a + cut + 1, b)]
    return sorted(begins)


def inline_parts(text: str) -> list[str]:
    """A line cut after strong marks inside it, and after an answer that another speaker's words follow."""
    parts, cursor = [], 0
    for m in re.finditer(INNER_MARK, text):
        parts.append(text[cursor : m.end()])
        cursor = m.end()
    out = []
    for part in [*parts, text[cursor:]]:
        m = re.match(OPENING_ANSWER, part)
        rest = part[m.end() :] if m else ""
        out += [m[1], rest] if m and bare(rest).startswith(AFTER_ANSWER) and words_in(rest) >= 3 else [part]
    return [p for p in out if p.strip()]


def timed_parts(start: int, end: int, parts: list[str], rules: SplitRules) -> list[tuple[int, int, str]]:
    """The parts' share of a line's time by normalised length; a short whole utterance takes from the next part up to 1,500 ms."""
    weights = [max(1, len(bare(p))) for p in parts]
    edges = [start]
    for i in range(1, len(parts)):
        at = start + round(max(1, end - start) * sum(weights[:i]) / sum(weights))
        edges.append(max(edges[-1] + 1, min(end - (len(parts) - i), at)))
    edges.append(end)
    for i, part in enumerate(parts[:-1]):
        norm = bare(part)
        if norm and words_in(norm) <= 4 and norm not in rules.fragments and not norm.isdigit():
            edges[i + 1] += max(0, min(rules.least_answer_ms - max(0, edges[i + 1] - edges[i]), max(0, edges[i + 2] - edges[i + 1]) - 1))
    return [(a, b, p.strip()) for a, b, p in zip(edges, edges[1:], parts)]


def split_stretch(rows: list[dict], rules: SplitRules) -> list[dict]:
    """The cues of one stretch of tokens (text, start_ms, end_ms, ends)."""
    starts, ends, texts = ([r[k] for r in rows] for k in ("start_ms", "end_ms", "text"))
    groups = {0, *uneven_gaps(starts, ends, rules), *(i + 1 for i, r in enumerate(rows) if r["ends"])} - {len(rows)}
    cues = []
    for a, b in itertools.pairwise([*sorted(groups), len(rows)]):
        inner = common_word_cuts(texts[a:b], [], rules) if words_in("".join(texts[a:b])) > rules.max_words else []
        for c, d in itertools.pairwise([a, *(a + i for i in inner), b]):
            for e, f in itertools.pairwise([c, *(c + i for i in widest_gap_cuts(starts[c:d], ends[c:d], texts[c:d], rules)), d]):
                text = "".join(texts[e:f]).strip()
                parts = inline_parts(text)
                cues += timed_parts(starts[e], ends[f - 1], parts, rules) if len(parts) > 1 else [(starts[e], ends[f - 1], text)]
    return [{"media_id": rows[0]["media_id"], "pos": rows[0]["pos"], "part": n, "start_ms": a, "end_ms": b, "text": t} for n, (a, b, t) in enumerate(cues)]


def rule_split(tokens: DataFrame, rules: SplitRules = SplitRules()) -> DataFrame:
    """media_id, cue_id, start_ms, end_ms, text: cues of ``tokens(media_id, pos, text, start_ms, end_ms)``.

    Tokens of punctuation only are left out, and words of spaced scripts are
    lower-cased and followed by a space. A gap over 500 ms ends a stretch, with all that is
    remembered. Inside, groups end at uneven gaps and sentence ends; groups of
    more than 18 words are cut at common words, what is still longer at its widest gaps, and lines at dialogue marks.
    """
    media = Window.partitionBy("media_id").orderBy("start_ms", "pos")
    spaced = F.trim("text").rlike(r"^[a-zA-Z0-9'\"\x{0400}-\x{04ff}\x{0370}-\x{03ff}\x{0600}-\x{06ff}\x{0590}-\x{05ff}\x{0e00}-\x{0e7f}]+$")
    t = tokens.where(~pure_punctuation(F.col("text"))).withColumn("ends", F.col("text").rlike(SENTENCE_END))
    t = t.withColumn("text", F.when(spaced, F.concat(F.lower(F.trim("text")), F.lit(" "))).otherwise(F.col("text")))
    far = F.coalesce(F.col("start_ms") - F.lag("end_ms").over(media) > rules.gap_ms, F.lit(False))
    t = t.withColumn("far", far).withColumn("stretch", F.sum(F.col("far").cast("int")).over(media))
    schema = "media_id long, pos long, part int, start_ms long, end_ms long, text string"
    cues = fold_groups(t.select("media_id", "stretch", "pos", "start_ms", "end_ms", "text", "ends"), ["media_id", "stretch"], ["start_ms", "pos"], lambda rows: split_stretch(rows, rules), schema)
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("start_ms", "pos", "part")).cast("long")
    return cues.select("media_id", number.alias("cue_id"), "start_ms", "end_ms", "text")


# ---- smooth_cues ----


@dataclass(frozen=True)
class ShortTexts:
    """Word lists by which short cues are judged, over texts without punctuation and spaces. Fixed values."""

    fillers: tuple = ("あの", "まあ", "ね", "よ", "さ")
    answers: tuple = ("はい", "はいはい", "うん", "ううん", "ええ", "いや", "いいえ", "そう", "そうそう", "ああ", "え", "あ", "なに", "何", "なんで", "どうして", "だめ", "ダメ", "お", "おお", "はあ")
    shown: tuple = ("はい", "うん", "ううん", "すると", "ところで", "ちなみに")
    suffixes: tuple = (
        "です", "でした", "ます", "ました", "けど", "けれど", "けれども", "から", "ので", "のに", "し", "て", "た", "だ", "って", "という", "とか", "など", "な", "ね", "よ", "わ", "か", "に", "で", "と", "が", "を", "は", "も", "の", "へ", "こと",
    )
    prefixes: tuple = ("ということで", "そして", "それで", "だから", "あと", "でも", "じゃあ", "ただ", "また", "なので", "すると", "ところで", "ちなみに")
    weak: tuple = ("ございます", "よろしく", "お願いします")
    units: tuple = ("度", "日", "月", "年", "時", "分", "秒", "個", "回", "人", "枚", "本")
    trailing: tuple = ("んです", "んですが", "でしたが", "ますが", "けど", "けれど", "けれども", "から", "ので", "のに", "し", "て", "って", "という", "とか")
    leading: tuple = ("そして", "それで", "だから", "でも", "じゃあ", "ただ", "また", "なので", "すると")

    def answer(self, text: str) -> bool:
        return bare(text) in self.answers

    def filler(self, text: str) -> bool:
        t = bare(text)
        if not t or t in self.answers or words_in(t) > 6:
            return False
        # greedy from the left, the longest filler first
        return re.fullmatch("(?>" + "|".join(map(re.escape, sorted(self.fillers, key=len, reverse=True))) + ")++", t) is not None

    def numeric(self, text: str) -> bool:
        t = bare(text)
        return t.isdigit() or t in self.units

    def structural(self, text: str) -> bool:
        t = bare(text)
        return t in self.suffixes or t in self.prefixes or t.endswith(self.trailing) or t.startswith(self.leading) or self.numeric(t)

    def utterance(self, text: str) -> bool:
        """A short text that stands for itself."""
        t = bare(text)
        return bool(t) and words_in(t) <= 4 and not (self.structural(t) or self.filler(t) or t in self.weak)

    def tail(self, text: str) -> bool:
        t = bare(text)
        return t in self.suffixes and t not in self.answers and words_in(t) <= 3 and not self.numeric(t) and not self.utterance(t)


@dataclass(frozen=True)
class SmoothRules:
    filler_gap_ms: int = 220
    filler_words: int = 24
    near_gap_ms: int = 80
    far_gap_ms: int = 8000
    words: int = 32
    shown_ms: int = 120
    least_ms: int = 500
    most_ms: int = 8000
    texts: ShortTexts = ShortTexts()


@dataclass(frozen=True)
class Cue:
    start: int
    end: int
    text: str

    @property
    def ms(self) -> int:
        return max(0, self.end - self.start)

    def joined(self, other: Cue) -> Cue:
        return Cue(min(self.start, other.start), max(self.end, other.end), self.text + other.text)


def _gap(a: Cue, b: Cue) -> int:
    return max(0, b.start - a.end)


def _merge_fillers(cues: list[Cue], r: SmoothRules) -> list[Cue]:
    t = r.texts

    def may(a: Cue, b: Cue) -> bool:
        return not t.answer(a.text) and not t.answer(b.text) and _gap(a, b) <= r.filler_gap_ms and words_in(a.text + b.text) <= r.filler_words

    left: list[Cue] = []
    for c in cues:
        if left and t.filler(c.text) and may(left[-1], c):
            left[-1] = left[-1].joined(c)
        else:
            left.append(c)
    return _pairwise(left, lambda a, b: t.filler(a.text) and may(a, b))


def _pairwise(cues: list[Cue], join: Callable[[Cue, Cue], bool]) -> list[Cue]:
    """Joins a cue with the next where told to; the joined cue isn't looked at again."""
    out, i = [], 0
    while i < len(cues):
        both = i + 1 < len(cues) and join(cues[i], cues[i + 1])
        out.append(cues[i].joined(cues[i + 1]) if both else cues[i])
        i += 1 + both
    return out


def _merge_short(cues: list[Cue], r: SmoothRules) -> list[Cue]:
    """Joins structural and very short cues with the neighbour that they belong to."""
    t = r.texts

    def short(c: Cue) -> bool:
        return not t.answer(c.text) and (c.ms < r.least_ms or bare(c.text) in t.weak or t.structural(c.text))

    def may(a: Cue, b: Cue) -> bool:
        left, right = t.structural(a.text), t.structural(b.text)
        if t.answer(a.text) or t.answer(b.text) or (t.utterance(a.text) and not right) or t.utterance(b.text):
            return False
        return _gap(a, b) <= (r.far_gap_ms if left or right else r.near_gap_ms) and words_in(a.text + b.text) <= r.words

    def forward(before: Cue | None, c: Cue, after: Cue) -> bool:
        now = bare(c.text)
        if before is None or (t.numeric(now) and t.numeric(after.text)) or now in t.prefixes or now.startswith(t.leading):
            return True
        return not (now in t.suffixes or now.endswith(t.trailing)) and _gap(c, after) + 100 < _gap(before, c)

    out, i = [], 0
    while i < len(cues):
        c, before, after = cues[i], out[-1] if out else None, cues[i + 1] if i + 1 < len(cues) else None
        back, on = (short(c) and before is not None and may(before, c)), (short(c) and after is not None and may(c, after))
        i += 1
        if on and (not back or forward(before, c, after)):
            out.append(c.joined(after))
            i += 1
        elif back:
            out[-1] = before.joined(c)
        else:
            out.append(c)
    return out


def _merge_tails(cues: list[Cue], r: SmoothRules) -> list[Cue]:
    out: list[Cue] = []
    for c in cues:
        if out and r.texts.tail(c.text) and _gap(out[-1], c) <= r.far_gap_ms and words_in(out[-1].text + c.text) <= r.words:
            out[-1] = out[-1].joined(c)
        else:
            out.append(c)
    return out


def _lengthen(cues: list[Cue], i: int, least: int, before: int | None, after: int | None) -> None:
    """Extends a cue into the silence after it, then into that before it."""
    need = least - cues[i].ms
    if need <= 0:
        return
    nxt = cues[i + 1].start if i + 1 < len(cues) else after
    if nxt is not None:
        more = min(need, max(0, nxt - cues[i].end))
        cues[i] = replace(cues[i], end=cues[i].end + more)
        need -= more
    if need > 0:
        past = cues[i - 1].end if i else before
        back = need if past is None else min(need, max(0, cues[i].start - past))
        cues[i] = replace(cues[i], start=max(0, cues[i].start - back) if past is None else cues[i].start - back)


def smooth_stretch(cues: list[Cue], r: SmoothRules, before: int | None = None, after: int | None = None) -> list[Cue]:
    """One stretch of cues, smoothed; ``before`` and ``after`` are the times at which the neighbouring stretches end and begin."""
    t = r.texts
    cues = _merge_short(_merge_tails(_merge_short(_merge_fillers(cues, r), r), r), r)

    def touching(a: Cue, b: Cue) -> bool:
        if b.start != a.end or words_in(a.text + b.text) > r.words:
            return False
        shown = bare(a.text) in t.shown
        return (shown and bare(b.text) in t.shown and a.ms < r.shown_ms) or (not shown and a.ms < r.least_ms and not t.answer(a.text))

    cues = _pairwise(cues, touching)
    least = [r.shown_ms if bare(c.text) in t.shown else r.least_ms for c in cues]
    for turn in (r.shown_ms, r.least_ms):
        for i, ms in enumerate(least):
            if ms == turn:
                _lengthen(cues, i, ms, before, after)
    for i in range(len(cues) - 1):
        a, b = cues[i], cues[i + 1]
        shift = min(least[i] - a.ms, max(0, b.ms - least[i + 1])) if b.start == a.end else 0
        if shift > 0:
            cues[i], cues[i + 1] = replace(a, end=a.end + shift), replace(b, start=a.end + shift)
    for i, ms in enumerate(least):
        _lengthen(cues, i, ms, before, after)
    return [replace(c, end=min(c.end, c.start + r.most_ms)) for c in cues]


def smooth_cues(cues: DataFrame, rules: SmoothRules = SmoothRules()) -> DataFrame:
    """media_id, cue_id, start_ms, end_ms, text of ``cues(media_id, cue_id, start_ms, end_ms, text)``, numbered anew.

    Fillers, fragments and tails join their neighbours, short cues are
    lengthened into silence or by what a touching neighbour can spare, and none lasts more than 8 s. Nothing
    reaches across 8 s of silence, counted from the latest end so far: there a file is cut.
    """
    media = Window.partitionBy("media_id").orderBy("start_ms", "cue_id")
    c = cues.where(F.trim("text") != "").withColumn("latest", F.max("end_ms").over(media.rowsBetween(Window.unboundedPreceding, -1)))
    c = c.withColumn("cut", F.coalesce(F.col("start_ms") - F.col("latest") > rules.far_gap_ms, F.lit(False)))
    c = c.withColumn("stretch", F.sum(F.col("cut").cast("int")).over(media)).withColumn("after", F.when(F.lead("cut").over(media), F.lead("start_ms").over(media)))
    c = c.withColumn("before", F.when(F.col("cut"), F.col("latest")))

    def fold(rows: list[dict]) -> list[dict]:
        done = smooth_stretch([Cue(x["start_ms"], x["end_ms"], x["text"]) for x in rows], rules, rows[0]["before"], rows[-1]["after"])
        return [{"media_id": rows[0]["media_id"], "stretch": rows[0]["stretch"], "n": n, "start_ms": x.start, "end_ms": x.end, "text": x.text} for n, x in enumerate(done)]

    out = fold_groups(c.select("media_id", "stretch", "cue_id", "start_ms", "end_ms", "text", "before", "after"), ["media_id", "stretch"], ["start_ms", "cue_id"], fold, "media_id long, stretch long, n long, start_ms long, end_ms long, text string")
    number = F.row_number().over(Window.partitionBy("media_id").orderBy("stretch", "n")).cast("long")
    return out.select("media_id", number.alias("cue_id"), "start_ms", "end_ms", "text")
