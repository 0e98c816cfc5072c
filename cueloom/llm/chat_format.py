"""Chat transcripts as training text, checked by a grammar round trip."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import let, running_starts

#: The grammar. A star in the opening marker says that the turn's content is escaped.
TURN = r"(?s)\[INST\*?\] .*? \[/INST\]|<s\*?> .*? </s>|\[ROLE\*?\] [^\n]*\n.*? \[/ROLE\]"
CONFLICT = r"\[/?INST|\[/?ROLE|</?s\*?>|\n"
ESCAPES = [("~", "~0"), ("[", "~1"), ("<", "~2"), ("\n", "~3")]


def escape(c: Column) -> Column:
    """No character that a marker begins with is left."""
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def render_turn(role: Column, text: Column, escaped: Column) -> Column:
    star = F.when(escaped, "*").otherwise("")
    role_text = F.when(escaped, escape(role)).otherwise(role)
    body = F.when(escaped, escape(text)).otherwise(text)
    return (
        F.when(role == "user", F.concat(F.lit("[INST"), star, F.lit("] "), body, F.lit(" [/INST]")))
        .when(role == "assistant", F.concat(F.lit("<s"), star, F.lit("> "), body, F.lit(" </s>")))
        .otherwise(F.concat(F.lit("[ROLE"), star, F.lit("] "), role_text, F.lit("\n"), body, F.lit(" [/ROLE]")))
    )


def parse(rendered: Column) -> Column:
    """array<struct<role, text>> recovered from rendered text."""

    def turn(t: Column) -> Column:
        user, assistant = F.startswith(t, F.lit("[INST")), F.startswith(t, F.lit("<s"))
        opening = F.instr(t, " ")
        escaped = F.substr(t, opening - 2, F.lit(1)) == "*"
        closing = F.when(user, 8).when(assistant, 5).otherwise(8)
        inner = F.substr(t, opening + 1, F.length(t) - opening - closing)
        line = F.instr(inner, "\n")
        other = ~user & ~assistant
        role = F.when(user, "user").when(assistant, "assistant").otherwise(F.substr(inner, F.lit(1), line - 1))
        body = F.when(other, F.substr(inner, line + 1)).otherwise(inner)
        return F.struct(F.when(escaped & other, unescape(role)).otherwise(role).alias("role"), F.when(escaped, unescape(body)).otherwise(body).alias("text"))

    return F.transform(F.regexp_extract_all(rendered, F.lit(TURN), F.lit(0)), turn)


def loss_mask(formatted: Column) -> Column:
    """array<struct<s, e, escaped>>: where in the formatted text, in code points from 0, the assistant's texts stand."""

    def placed(turns: Column) -> Column:
        mark = lambda t, at: F.struct(F.startswith(t, F.lit("<s")).alias("own"), at.alias("at"), F.instr(t, " ").alias("head"), F.length(t).alias("n"), F.startswith(t, F.lit("<s*")).alias("escaped"))
        spans = let(running_starts(F.transform(turns, F.length)), lambda starts: F.transform(turns, lambda t, i: mark(t, F.element_at(starts, i + 1))))
        return F.transform(F.filter(spans, lambda x: x["own"]), lambda x: F.struct((x["at"] + x["head"]).alias("s"), (x["at"] + x["n"] - 5).alias("e"), x["escaped"].alias("escaped")))

    return let(F.regexp_extract_all(formatted, F.lit(TURN), F.lit(0)), placed)


def masked_text(formatted: Column, mask: Column) -> Column:
    """The text under a loss mask, cut from the formatted text and unescaped, with nothing between the spans."""

    def cut(x: Column) -> Column:
        part = F.substr(formatted, x["s"] + 1, x["e"] - x["s"])
        return F.when(x["escaped"], unescape(part)).otherwise(part)

    return F.array_join(F.transform(mask, cut), "")


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, escape_level, parsed, loss_mask for every conversation of ``turns(conv_id, turn, role, text)``.

    Turns are taken by turn (then role and text). The text is first rendered as
    it is (level 0) and parsed again; where the recovered turns differ from the
    source, turns with control strings are escaped (level 1); should a
    difference be left, all turns are (level 2). ``parsed`` is what the parser
    reads back from ``formatted`` and equals the source; ``loss_mask`` has the
    spans of the assistant's texts in ``formatted``. An error is raised should
    level 2 not give the source back.

    Null text or role: empty. A null conv_id is a conversation of its own, a
    null turn comes first, repeated rows are kept. Other columns are ignored. No
    rows give no rows. One conversation is one string, so it must fit a task.
    """
    source = turns.select(
        "conv_id",
        F.struct(F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    each = source.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    each = each.withColumn("source", F.transform("turns", lambda t: F.struct(t.role.alias("role"), t.text.alias("text")))).drop("turns")

    def rendered(escaped) -> Column:
        return F.array_join(F.transform("source", lambda t: render_turn(t.role, t.text, escaped(t))), "")

    def conflict(t: Column) -> Column:
        return t.text.rlike(CONFLICT.removesuffix(r"|\n")) | (~t.role.isin("user", "assistant") & t.role.rlike(CONFLICT))

    each = each.withColumn("formatted", rendered(lambda t: F.lit(False))).withColumn("same", parse(F.col("formatted")) == F.col("source"))
    each = each.withColumn("escape_level", F.when(F.col("same"), 0).otherwise(1))
    each = each.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(rendered(conflict)))
    each = each.withColumn("same", F.col("same") | (parse(F.col("formatted")) == F.col("source")))
    each = each.withColumn("escape_level", F.when(F.col("same"), F.col("escape_level")).otherwise(2))
    each = each.withColumn("formatted", F.when(F.col("same"), F.col("formatted")).otherwise(rendered(lambda t: F.lit(True))))
    each = each.withColumn("parsed", parse(F.col("formatted")))
    each = each.withColumn("parsed", F.when(F.col("parsed") == F.col("source"), F.col("parsed")).otherwise(F.raise_error(F.lit("a conversation isn't recovered from its formatted text"))))
    return each.select("conv_id", "formatted", "escape_level", "parsed", loss_mask(F.col("formatted")).alias("loss_mask"))
