"""Text normalisers, counts and small text functions as columns."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Punctuation sets and script ranges of the normalisers.
FILLER_PUNCTUATION = r"[、。，．！？!?…・,.\s　]"
SIGNAL_PUNCTUATION = r"[\s　、。，．！？!?…・,.;:；：\"'“”‘’「」『』（）()\[\]【】]"
EDGE_PUNCTUATION = r"^[、。，．！？!?…・,.;:；：「」『』（）()【】]+|[、。，．！？!?…・,.;:；：「」『』（）()【】]+$"
JAPANESE = r"\x{3040}-\x{30FF}\x{3400}-\x{9FFF}\x{FF66}-\x{FF9D}"
UNSPACED = r"[\x{4e00}-\x{9fff}\x{3040}-\x{30ff}\x{ac00}-\x{d7af}\x{0e00}-\x{0eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{0900}-\x{0dff}]"
WORD = (
    r"[a-zA-Z\x{00c0}-\x{017f}']+|[\x{0400}-\x{04ff}]+|[\x{0370}-\x{03ff}]+|[\x{0600}-\x{06ff}]+|[\x{0590}-\x{05ff}]+|[0-9]+"
    r"|[\x{4e00}-\x{9fff}]|[\x{3040}-\x{30ff}]|[\x{ac00}-\x{d7af}]|[\x{0e00}-\x{0e7f}][\x{0e30}-\x{0e3a}\x{0e47}-\x{0e4e}]*|[\x{0900}-\x{097f}]|[\x{0980}-\x{09ff}]|[\x{0e80}-\x{0eff}]|[\x{1000}-\x{109f}]"
)


def _keep(text: str | None, ranges: tuple) -> str:
    if not text:
        return ""
    folded = unicodedata.normalize("NFKC", text).casefold()
    return "".join(c for c in folded if c.isalnum() or any(a <= c <= b for a, b in ranges))


KEPT = {
    "match": (("぀", "ヿ"), ("㐀", "鿿"), ("ｦ", "ﾝ")),
    "strict": (),
    "realign": (("぀", "ヿ"), ("㐀", "鿿"), ("豈", "﫿"), ("ｦ", "ﾝ")),
}


def normalise(text: Column, kind: str) -> Column:
    """NFKC, casefold, and only letters, digits and the ranges of ``kind`` (match, strict or realign). NFKC has no SQL function."""
    ranges = KEPT[kind]

    @F.pandas_udf("string")
    def fold(s: pd.Series) -> pd.Series:
        return s.map(lambda t: _keep(t, ranges))

    return fold(text)


def _by_script(text: Column, kind: str) -> Column:
    """Texts in ASCII by SQL functions; only the others reach Python."""
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, F.regexp_replace(F.lower(text), "[^a-z0-9]", "")).otherwise(normalise(F.when(~plain, text), kind))


def norm_strict(text: Column) -> Column:
    return _by_script(text, "strict")


def norm_match(text: Column) -> Column:
    return _by_script(text, "match")


def norm_latin(text: Column) -> Column:
    """The match normaliser for composed Latin text, by SQL functions only."""
    return F.regexp_replace(F.replace(F.lower(text), F.lit("ß"), F.lit("ss")), r"[^\p{L}\p{N}]", "")


def norm_kana(text: Column) -> Column:
    """The match normaliser with katakana read as hiragana."""
    kata = "".join(map(chr, range(0x30A1, 0x30F7)))
    hira = "".join(map(chr, range(0x3041, 0x3097)))
    return F.translate(normalise(text, "match"), kata, hira)


def norm_filler(text: Column) -> Column:
    return F.regexp_replace(F.trim(text), FILLER_PUNCTUATION, "")


def norm_glossary(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"[\s　]+", ""), EDGE_PUNCTUATION, "")


def norm_signal(text: Column) -> Column:
    return F.regexp_replace(text, SIGNAL_PUNCTUATION, "")


def japanese_signal(text: Column) -> Column:
    return F.regexp_replace(text, f"[^{JAPANESE}]", "")


def count_words(text: Column) -> Column:
    """Characters of scripts without spaces plus space-separated words of the rest."""
    rest = F.trim(F.regexp_replace(text, UNSPACED, " "))
    words = F.size(F.filter(F.split(rest, r"\s+"), lambda w: w.rlike(r"[\p{L}\p{N}_]")))
    return F.regexp_count(text, F.lit(UNSPACED)) + words


def mainly_unspaced(text: Column, share: float = 0.5) -> Column:
    total = F.length(F.regexp_replace(text, r"\s", ""))
    return F.coalesce(F.regexp_count(text, F.lit(UNSPACED)) / F.nullif(total, F.lit(0)) > share, F.lit(False))


def pure_punctuation(text: Column) -> Column:
    return ~text.rlike(r"[\p{L}\p{N}_]")


def has_kana(text: Column) -> Column:
    return text.rlike(r"[\x{3040}-\x{30ff}]")


def has_cjk(text: Column) -> Column:
    return text.rlike(r"[\x{4e00}-\x{9fff}]")


def mixed_language(text: Column) -> Column:
    return text.rlike(r"[A-Za-z]") & (has_kana(text) | has_cjk(text))


def wrap_text(text: Column, cjk_width: int = 18, word_width: int = 42, max_lines: int = 2) -> Column:
    """At most ``max_lines`` lines: CJK by character count, other text by words; what is over is dropped."""
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    parts = F.transform(F.sequence(F.lit(0), F.lit(max_lines - 1)), lambda i: F.substr(text, i * cjk_width + 1, F.lit(cjk_width)))
    cjk = F.array_join(F.filter(parts, lambda p: p != ""), "\n")
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("line"))

    def add(acc: Column, word: Column) -> Column:
        longer = F.when(acc["line"] == "", word).otherwise(F.concat_ws(" ", acc["line"], word))
        fits = (F.length(longer) <= word_width) | (acc["line"] == "")
        return F.struct(F.when(fits, acc["lines"]).otherwise(F.concat(acc["lines"], F.array(acc["line"]))).alias("lines"), F.when(fits, longer).otherwise(word).alias("line"))

    words = F.aggregate(F.split(text, " "), start, add, lambda acc: F.slice(F.concat(acc["lines"], F.array(acc["line"])), 1, max_lines))
    return F.when(text == "", "").when(has_cjk(text), cjk).otherwise(F.array_join(words, "\n"))


def boundary_trim(previous: Column, current: Column) -> Column:
    """The current text without what it repeats of the previous one: up to 20 words, the whole previous text, or up to 30 characters."""
    a, b = F.split(F.trim(previous), r"\s+"), F.split(F.trim(current), r"\s+")
    words = F.filter(F.sequence(F.lit(20), F.lit(1), F.lit(-1)), lambda k: (k <= F.size(a)) & (k <= F.size(b)) & (F.slice(a, F.size(a) - k + 1, k) == F.slice(b, F.lit(1), k)))
    chars = F.filter(F.sequence(F.lit(30), F.lit(1), F.lit(-1)), lambda k: (k <= F.length(previous)) & (k <= F.length(current)) & (F.right(previous, k) == F.left(current, k)))
    n, m = F.get(words, F.lit(0)), F.get(chars, F.lit(0))
    rest = F.array_join(F.slice(b, n + 1, F.greatest(F.size(b) - n, F.lit(0))), " ")
    return (
        F.when((previous == "") | previous.isNull(), current)
        .when(n.isNotNull() & (F.trim(current) != ""), rest)
        .when(F.startswith(current, previous), F.trim(F.substr(current, F.length(previous) + 1)))
        .when(m.isNotNull(), F.trim(F.substr(current, m + 1)))
        .otherwise(current)
    )


def clean_subtitle_text(text: Column) -> Column:
    """Low-risk clean-up: spaces, numbers split before date units, spacing at punctuation and brackets, spelled letters and spaced addresses."""
    t = F.regexp_replace(F.trim(text), "[ \\t\u3000]+", " ")
    t = F.regexp_replace(t, f"(?<=[0-9]) (?=[0-9 ]*[{DATE_UNITS}])", "")
    t = F.regexp_replace(t, "([0-9][年月日]) (?=[0-9])", "$1")
    t = compact_spelled(t)
    return F.trim(F.regexp_replace(t, f" +(?=[{CLOSING}])|(?<=[{OPENING}]) +", ""))


#: Units after which a number ends, marks that follow a word directly, and brackets that open.
DATE_UNITS = "年月日时分秒"
CLOSING = ",.;:!?，。！？、；：）」』》】"
OPENING = "（「『《【"
_LEXEME = re.compile(r"[A-Za-z0-9_+-]+|\s+|.", re.DOTALL)


def _step(parts: list[str], i: int, way: int) -> int:
    """The next place from ``i`` in a direction that isn't space."""
    i += way
    while 0 <= i < len(parts) and parts[i].isspace():
        i += way
    return i


def _name(parts: list[str], i: int, way: int) -> tuple[int, int]:
    """The last place and the number of words of a dotted name that begins at ``i`` and goes in a direction; (i, 0) without one."""
    word = lambda k: 0 <= k < len(parts) and parts[k][0].isalnum() and parts[k].isascii()
    if not word(i):
        return i, 0
    words = 1
    while True:
        dot = _step(parts, i, way)
        after = _step(parts, dot, way)
        if not (0 <= dot < len(parts) and parts[dot] == "." and word(after)):
            return i, words
        i, words = after, words + 1


def joined_text(text: str) -> str:
    """Letters spelled one by one (three or more) joined, and addresses written with spaces or with the word at."""
    parts = _LEXEME.findall(text)
    out, i = [], 0
    while i < len(parts):
        j, letters = i, 0
        while j < len(parts) and len(parts[j]) == 1 and parts[j].isascii() and parts[j].isalpha():
            letters, last = letters + 1, j
            j = _step(parts, j, 1)
            if j - last == 1:
                break
        if letters >= 3 and (i == 0 or not parts[i - 1][-1].isalnum()):
            out.append("".join(p for p in parts[i : last + 1] if not p.isspace()))
            i = last + 1
            continue
        out.append(parts[i])
        i += 1
    parts = _LEXEME.findall("".join(out))
    i = 0
    while i < len(parts):
        said = parts[i].lower() == "at" and 0 < i < len(parts) - 1 and parts[i - 1].isspace() and parts[i + 1].isspace()
        if parts[i] == "@" or said:
            before, after = _step(parts, i, -1), _step(parts, i, 1)
            (first, owner), (last, labels) = _name(parts, before, -1), _name(parts, after, 1)
            whole = owner and labels > 1 and parts[last].isalpha() and len(parts[last]) > 1
            if said:
                whole, first = whole and len(parts[before]) > 2, before
            if whole:
                address = "".join(p for p in parts[first:i] + ["@"] + parts[i + 1 : last + 1] if not p.isspace())
                parts[first : last + 1] = [address]
                i = first
            elif not said:
                parts[before + 1 : after] = ["@"]
                i = before + 1
        i += 1
    return "".join(parts)


def compact_spelled(text: Column) -> Column:
    """``joined_text`` of every row."""

    @F.pandas_udf("string")
    def work(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else joined_text(t))

    return work(text)


def apply_term_table(text: Column, terms: list[tuple[str, str, bool]]) -> Column:
    """Replacements (from, to, is_pattern) in the order of the table."""
    for old, new, pattern in terms:
        text = F.regexp_replace(text, old, new) if pattern else F.replace(text, F.lit(old), F.lit(new))
    return text


def trim_terminal(text: Column) -> Column:
    return F.regexp_replace(text, r"[，。]+$", "")


def extract_reference(reason: Column) -> Column:
    """The last ``ass_text=...`` fragment of a reason."""
    return F.element_at(F.regexp_extract_all(reason, F.lit(r"ass_text=([^;|]*)"), F.lit(1)), -1)
