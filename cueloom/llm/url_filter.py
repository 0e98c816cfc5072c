"""URL block and allow rules, spread over redirects and canonical links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .graph import connected_components
from .scratch import Scratch

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of an absolute URL; both empty where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), r"^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct(size, rule, action) of the longest rule that fits, or null.

    A rule ``host/path`` fits the host and its subdomains where the path starts
    with the rule's. The list is a parameter held by the driver.
    """
    table = F.array(*[
        F.struct(F.lit(len(r)).alias("size"), F.lit(r).alias("rule"), F.lit(a).alias("action"), F.lit(r.partition("/")[0]).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path"))
        for a, r in rules
    ])
    fits = F.filter(table, lambda x: ((host == x.host) | F.endswith(host, F.concat(F.lit("."), x.host))) & F.startswith(path, x.path))
    best = F.array_max(F.transform(fits, lambda x: F.struct(x.size.alias("size"), x.rule.alias("rule"), x.action.alias("action"))))
    return best


def alias_key(url: Column) -> Column:
    """One name for addresses that servers redirect to one another as a rule.

    Drops the scheme, a default port, the fragment, a trailing slash, an
    ``index.html`` or ``.html`` ending and tracking parameters. Null where
    ``://`` is missing.
    """
    host, path = host_and_path(url)
    host = F.regexp_replace(host, r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_replace(path, r"(/index)?\.html?$", ""), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[a-z]+|ref|fbclid|gclid)(=|$)"))
    return F.when(F.instr(url, "://") > 0, F.concat(host, path, F.lit("?"), F.array_join(kept, "&")))


def links_of(url: Column, html: Column) -> Column:
    """array<string>: absolute targets of a page's canonical link and of its immediate refresh."""
    tag = F.regexp_extract(html, r"(?is)<link\b[^>]*\brel\s*=\s*[\"']?canonical\b[^>]*>", 0)
    canonical = F.regexp_extract(tag, r"(?is)\bhref\s*=\s*[\"']?([^\"'\s>]+)", 1)
    meta = F.regexp_extract(html, r"(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b[^>]*>", 0)
    refresh = F.regexp_extract(meta, r"(?is)\burl\s*=\s*[\"']?([^\"'\s>]+)", 1)
    root = F.regexp_extract(url, r"^[^?#]*?://[^/?#]*", 0)
    folder = F.regexp_extract(url, r"^[^?#]*?://[^/?#]*(?:[^?#]*/)?", 0)

    def absolute(x: Column) -> Column:
        return (
            F.when(x.contains("://"), x)
            .when(F.startswith(x, F.lit("//")), F.concat(F.lit("https:"), x))
            .when(F.startswith(x, F.lit("/")), F.concat(root, x))
            .when(x.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), F.lit(None))
            .otherwise(F.concat(F.regexp_replace(folder, r"([^/])$", "$1/"), x))
        )

    return F.when(
        html.rlike(r"(?i)rel\s*=\s*[\"']?canonical|http-equiv\s*=\s*[\"']?refresh") & (F.instr(url, "://") > 0),
        F.transform(F.filter(F.array(canonical, refresh), lambda x: x != ""), absolute),
    ).otherwise(F.array().cast("array<string>"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], redirects: DataFrame | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and reason for every row of ``pages(page_id, url, html)``.

    ``rules`` are (action, "host/path") with action allow or block; the longest
    that fits a page's own URL decides. Other pages take the decision of their
    aliases: pages and link targets joined by the alias key, by canonical links
    and refreshes in the HTML, and by ``redirects(from_url, to_url)``. In such a
    class an explicit allow wins over any block; without either the verdict is
    allow. reason is rule, alias or default.

    A null url, or one without ``://``, has empty host and path, joins no class
    and is allowed unless a rule fits. Null html has no links. Repeated rows are
    judged alike. Other columns are ignored. No rows give no rows.
    """
    scratch = Scratch(pages.sparkSession, "url-filter")
    url = F.col("url")
    host, path = host_and_path(url)
    own = scratch.cut(
        pages.select("page_id", F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
        .select("page_id", "url", links_of(url, F.col("html")).alias("links"), host.alias("host"), path.alias("path"), alias_key(url).alias("key"))
        .withColumn("found", rule_for(F.col("host"), F.col("path"), rules))
        .select("page_id", "url", "links", "host", "path", "key", F.col("found.rule").alias("rule"), F.col("found.action").alias("action")),
        "pages",
    )
    hops = own.select(F.col("url").alias("from_url"), F.explode("links").alias("to_url"))
    if redirects is not None:
        hops = hops.unionByName(redirects.select("from_url", "to_url"))
    hops = hops.where("from_url is not null and to_url is not null")
    ends = hops.select(F.explode(F.array("from_url", "to_url")).alias("url")).distinct()
    h, p = host_and_path(url)
    ends = ends.select(alias_key(url).alias("key"), rule_for(h, p, rules)["action"].alias("action"))
    edges = hops.select(alias_key(F.col("from_url")).alias("u"), alias_key(F.col("to_url")).alias("v"))
    label = connected_components(edges, scratch)
    flags = (
        own.select("key", "action")
        .unionByName(ends)
        .where("key is not null")
        .groupBy("key")
        .agg(F.bool_or(F.col("action") == "allow").alias("allow"), F.bool_or(F.col("action") == "block").alias("block"))
        .join(label.select(F.col("node").alias("key"), "component"), "key", "left")
        .withColumn("component", F.coalesce("component", "key"))
    )
    decided = flags.groupBy("component").agg(F.bool_or("allow").alias("allow"), F.bool_or("block").alias("block")).where("allow or block")
    by_key = flags.select("key", "component").join(decided, "component").select("key", F.when(F.col("allow"), "allow").otherwise("block").alias("alias"))
    return own.join(by_key, "key", "left").select(
        "page_id",
        "host",
        "path",
        "rule",
        F.coalesce("action", "alias", F.lit("allow")).alias("verdict"),
        F.when(F.col("action").isNotNull(), "rule").when(F.col("alias").isNotNull(), "alias").otherwise("default").alias("reason"),
    )
