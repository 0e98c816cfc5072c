"""Time texts and milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def srt_ms(text: Column) -> Column:
    """``hh:mm:ss,mmm`` (or a point) to milliseconds; null where it isn't one, or minutes or seconds are 60 or more."""
    pattern = r"^\s*(\d{1,3}):(\d{2}):(\d{2})[,.](\d{1,3})\s*$"
    h, m, s, ms = (F.try_to_number(F.regexp_extract(text, pattern, i), F.lit("999")).cast("long") for i in range(1, 5))
    digits = F.rpad(F.regexp_extract(text, pattern, 4), 3, "0").cast("long")
    return F.when(text.rlike(pattern) & (m < 60) & (s < 60), ((h * 60 + m) * 60 + s) * 1000 + digits)


def ass_ms(text: Column) -> Column:
    """``h:mm:ss.cc`` to milliseconds."""
    pattern = r"^\s*(\d+):(\d{2}):(\d{2})[.](\d{1,3})\s*$"
    h, m, s = (F.regexp_extract(text, pattern, i) for i in range(1, 4))
    whole = (h.try_cast("long") * 60 + m.try_cast("long")) * 60 + s.try_cast("long")
    return F.when(text.rlike(pattern), whole * 1000 + F.rpad(F.regexp_extract(text, pattern, 4), 3, "0").try_cast("long"))


def _clock(ms: Column, sep: str) -> Column:
    ms = F.greatest(ms, F.lit(0))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    hours = F.floor(ms / 3_600_000)
    return F.concat(
        F.lpad(hours.cast("string"), F.greatest(F.lit(2), F.length(hours.cast("string"))), F.lit("0")), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit(sep), F.lpad((ms % 1000).cast("string"), 3, "0")
    )


def fmt_srt(ms: Column) -> Column:
    return _clock(ms, ",")


def fmt_vtt(ms: Column) -> Column:
    return _clock(ms, ".")


def fmt_ass(ms: Column) -> Column:
    ms = F.greatest(ms, F.lit(0))
    two = lambda c: F.lpad(c.cast("long").cast("string"), 2, "0")
    return F.concat(F.floor(ms / 3_600_000).cast("string"), F.lit(":"), two(F.floor(ms / 60_000) % 60), F.lit(":"), two(F.floor(ms / 1000) % 60), F.lit("."), two(F.floor(ms % 1000 / 10)))
