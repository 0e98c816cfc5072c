"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import let, running_starts

#: The base patterns.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
#: Runs that the models judge, and ordinary runs that they learn from.
RUN, ORDINARY = r"[A-Za-z0-9+/_=-]{20,}", r"[A-Za-z0-9+/_=-]{16,}"
PLAIN = r"^([A-Z]?[a-z]+|[A-Z]+|[-_=+/]+)$"
#: Documents whose words make identifiers to learn from.
SAMPLE = 200
#: Random strings by rule, and the least log-likelihood ratio in thousandths.
RANDOM_STRINGS, MARGIN = 2048, 20000
SYMBOLS = 65


def spans(text: Column, pattern: str, present: Column) -> Column:
    """array<struct<s, e, hit>> of the leftmost non-overlapping matches, in code points.

    The texts between the matches and the matches themselves are laid end to
    end, so that no match is searched for twice.
    """

    def placed(x: Column) -> Column:
        starts = running_starts(F.flatten(F.transform(x, lambda p: F.array(p["gap"], F.length(p["hit"])))))
        struct = lambda p, at: F.struct(at.alias("s"), (at + F.length(p["hit"])).alias("e"), p["hit"].alias("hit"))
        return let(starts, lambda known: F.transform(x, lambda p, i: struct(p, F.element_at(known, 2 * i + 2))))

    def paired(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        return F.zip_with(gaps, hits, lambda g, h: F.struct(F.length(g).alias("gap"), h.alias("hit")))

    pairs = let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)
    none = F.array().cast("array<struct<s:int,e:int,hit:string>>")
    return F.when(present, let(pairs, placed)).otherwise(none)


def identifiers(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(string): ordinary identifiers built from the words of ``sample`` documents, those of the smallest MD5 digests of their texts.

    Every three words in a row make one, in turn as snake_case, CamelCase,
    SCREAMING_CASE, a path, and with hyphens and a number.
    """
    chosen = docs.select(F.col("text").cast("string").alias("text")).where("text is not null").orderBy(F.md5(F.col("text").cast("binary")), "text").limit(sample)
    words = chosen.select(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,12}"), F.lit(0)).alias("w")).where("size(w) >= 3")
    three = words.select(F.posexplode(F.transform(F.sequence(F.lit(1), F.size("w") - 2, F.lit(3)), lambda i: F.slice("w", i, 3))).alias("i", "w"))
    low = F.transform("w", F.lower)
    camel = F.array_join(F.transform(low, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substr(x, F.lit(2)))), "")
    style = F.col("i") % 5
    string = (
        F.when(style == 0, F.array_join(low, "_")).when(style == 1, camel).when(style == 2, F.upper(F.array_join(low, "_"))).when(style == 3, F.array_join(low, "/"))
        .otherwise(F.concat_ws("-", F.array_join(low, "-"), F.col("i")))
    )
    return three.select(string.alias("string"))


def labelled_strings(docs: DataFrame) -> DataFrame:
    """(string, secret): random strings by rule, labelled 1; labelled 0 the plain long runs of all documents and the identifiers built from their words."""
    spark = docs.sparkSession
    digest = F.sha2(F.col("id").cast("string"), 256)
    made = spark.range(RANDOM_STRINGS).select(F.explode(F.array(digest, F.regexp_replace(F.base64(F.unhex(digest)), "=+$", ""))).alias("string"), F.lit(1).alias("secret"))
    text = F.col("text").cast("string")
    seen = docs.where(text.rlike(ORDINARY)).select(F.explode(F.regexp_extract_all(text, F.lit(ORDINARY), F.lit(0))).alias("string"))
    seen = seen.where(F.col("string").rlike(PLAIN)).unionByName(identifiers(docs))
    return made.unionByName(seen.select("string", F.lit(0).alias("secret")))


def log_ratios(labelled: DataFrame) -> list[int]:
    """For each pair of ASCII codes a * 128 + b, 1,000 * ln(P(b | a, random) / P(b | a, ordinary)).

    Counts of all labelled strings by character pair (at most 65 * 65 * 2 rows
    reach the driver). A pair's estimate leans on the frequency of b as five
    more observations would, and that on half a count for each character.
    """
    pairs = labelled.select("secret", "string", F.explode(F.sequence(F.lit(1), F.length("string") - 1)).alias("i")).where("length(string) > 1")
    counts = pairs.groupBy("secret", F.expr("substr(string, i, 2)").alias("pair")).count().collect()
    n: dict = {0: {}, 1: {}}
    first: dict = {0: {}, 1: {}}
    second: dict = {0: {}, 1: {}}
    for r in counts:
        n[r.secret][r.pair] = r["count"]
        first[r.secret][r.pair[0]] = first[r.secret].get(r.pair[0], 0) + r["count"]
        second[r.secret][r.pair[1]] = second[r.secret].get(r.pair[1], 0) + r["count"]
    total = {kind: sum(second[kind].values()) + 0.5 * SYMBOLS for kind in n}

    def p(kind: int, a: str, b: str) -> float:
        alone = (second[kind].get(b, 0) + 0.5) / total[kind]
        return (n[kind].get(a + b, 0) + 5 * alone) / (first[kind].get(a, 0) + 5)

    return [round(1000 * math.log(p(1, chr(a), chr(b)) / p(0, chr(a), chr(b)))) for a in range(128) for b in range(128)]


def _listed(found: dict[str, Column]) -> Column:
    """All spans as kind:start:end, by start and then the order of the kinds."""

    def of(i: int, kind: str, c: Column) -> Column:
        return F.transform(c, lambda x: F.struct(x["s"].alias("s"), F.lit(i).alias("i"), F.concat_ws(":", F.lit(kind), x["s"], x["e"]).alias("t")))

    rows = [of(i, kind, c) for i, (kind, c) in enumerate(found.items())]
    return F.array_join(F.transform(F.array_sort(F.concat(*rows)), lambda x: x["t"]), ",")


def scan_secrets(docs: DataFrame, labelled: DataFrame | None = None, margin: int = MARGIN) -> DataFrame:
    """doc_id and the spans (array of start, end, text) assign, access, hex and markov of every row of ``docs(doc_id, text)``.

    The first three are the matches of the fixed patterns, leftmost and without
    overlaps; assign needs a value of 6 or more characters. Runs of 20 or more
    characters of the base64 and URL alphabets that touch none of them are
    markov spans where the model of random strings beats that of ordinary
    identifiers by ``margin`` thousandths. ``labelled(string, secret)`` trains
    the models, by default ``labelled_strings(docs)``.

    Null text counts as empty and has no spans. Null ids are carried, repeated
    rows are scanned alike, other columns are ignored, no rows give no rows.
    """
    ratios = log_ratios(labelled if labelled is not None else labelled_strings(docs))
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<int>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    low = F.lower(text)
    told = F.lit(False)
    for w in ASSIGN_WORDS:
        told = told | F.contains(low, F.lit(w))
    rows = docs.select(
        "doc_id",
        F.filter(spans(text, ASSIGN, told), lambda x: F.length(F.regexp_extract(x["hit"], ASSIGN, 2)) >= 6).alias("assign"),
        spans(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        spans(text, HEX, text.rlike(HEX)).alias("hex"),
        spans(text, RUN, text.rlike(RUN)).alias("runs"),
    )

    def ratio(x: Column) -> Column:
        at = F.sequence(F.lit(1), F.length(x["hit"]) - 1)
        code = lambda i: F.ascii(F.substr(x["hit"], i, F.lit(1)))
        return F.aggregate(at, F.lit(0), lambda n, i: n + F.element_at(table, code(i) * 128 + code(i + 1) + 1))

    def free(x: Column) -> Column:
        return ~F.exists("base", lambda b: (b["s"] < x["e"]) & (x["s"] < b["e"]))

    rows = rows.withColumn("base", F.concat("assign", "access", "hex"))
    return rows.withColumn("markov", F.filter("runs", lambda x: (ratio(x) >= margin) & free(x))).drop("runs", "base")


def span_digest(scanned: DataFrame) -> DataFrame:
    """doc_id, the counts, the digest of the base spans and all spans as text."""
    base = {k: F.col(k) for k in ("assign", "access", "hex")}
    return scanned.select(
        "doc_id",
        *(F.size(k).cast("long").alias(f"n_{k}") for k in base),
        F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(base | {"markov": F.col("markov")}).alias("spans"),
    )
