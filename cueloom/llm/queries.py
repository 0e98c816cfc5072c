"""The registered queries of the corpus operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .chat_format import format_conversations, masked_text
from .decontaminate import find_leaks
from .fuzzy_lines import fuzzy_lines, lines_by_document
from .media import edited_copies
from .mixing import mix, words_taken
from .near_dup import near_duplicates
from .phrases import remove_repeats
from .secrets import scan_secrets, span_digest
from .sharding import shard_documents
from .treap import rank_documents
from .url_filter import judge_urls
from .vafile import cluster_vectors

#: The rules that op3 judges by.
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item or a paraphrase of one, with the item."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of documents linked on 2-word shingles at a similarity of 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2, percent=80)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A verdict for every page."""
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return span_digest(scan_secrets(table(spark, sf_dir, "documents")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quality score of every document, learned from the labels that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.where(~quality.held_out(F.col("doc_id"))).select("doc_id", F.col("quality").alias("label"))
    scored = quality.score(docs, quality.train(docs, learned))
    return scored.select("doc_id", F.coalesce(quality.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", "predicted")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document."""
    return words_taken(*mix(table(spark, sf_dir, "documents"))).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_pieces")


def op7_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shards 0 to 7 of nearly equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", "map_version"
    )


def op8_media_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which images cropped and edited copies of every fiftieth image are found to come from."""
    return edited_copies(table(spark, sf_dir, "embeddings"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of all conversations, read back from their formatted text."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).selectExpr("-7L AS conv_id", "id AS turn", "if(id = 0, 'user', 'assistant') AS role", "'</s>[INST] ok [/INST]' AS text")
    done = format_conversations(turns.unionByName(hard))
    said = masked_text(F.col("formatted"), F.col("loss_mask"))
    told = F.array_join(F.transform("parsed", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("parsed").cast("long").alias("n_turns"),
        F.sha2(told, 256).alias("turns_sha256"),
        F.length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op10_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that repeat an earlier line, exactly or nearly."""
    return lines_by_document(fuzzy_lines(table(spark, sf_dir, "documents")))


def op11_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document that repeat a passage of an earlier one, and a digest of the rest."""
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op12_va_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """40 clusters of the embeddings after five rounds."""
    return cluster_vectors(table(spark, sf_dir, "embeddings"))[0]


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_minhash_near_dedup": op2_minhash_near_dedup,
    "op3_url_filter": op3_url_filter,
    "op4_secret_scan": op4_secret_scan,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_source_mixing": op6_source_mixing,
    "op7_slot_sharding": op7_slot_sharding,
    "op8_media_copies": op8_media_copies,
    "op9_chat_format": op9_chat_format,
    "op10_fuzzy_lines": op10_fuzzy_lines,
    "op11_repeated_phrases": op11_repeated_phrases,
    "op12_va_clusters": op12_va_clusters,
    "op13_ranked_search": op13_ranked_search,
}


def _cluster_sql(rounds: int = 5) -> str:
    """Rounds of assignment and update, one after the other."""
    nearest = """a{r} AS MATERIALIZED (
  SELECT vec_id, row_id, any_value(x) AS x, arg_min(c, d * 64 + c) AS c, min(d)::BIGINT AS d FROM (
    SELECT v.*, c, list_inner_product(v.x::DOUBLE[], v.x::DOUBLE[]) - 2 * list_inner_product(v.x::DOUBLE[], k.x::DOUBLE[]) + list_inner_product(k.x::DOUBLE[], k.x::DOUBLE[]) AS d FROM v, c{r} k)
  GROUP BY vec_id, row_id)"""
    update = """u{n} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i)::BIGINT[] AS x FROM (SELECT c, i, sum(y)::BIGINT AS s, count(*) AS n FROM (SELECT c, unnest(x) AS y, unnest(range(64)) AS i FROM a{r}) GROUP BY c, i) GROUP BY c),
c{n} AS MATERIALIZED (SELECT k.c, coalesce(u.x, k.x) AS x FROM c{r} k LEFT JOIN u{n} u ON u.c = k.c)"""
    steps = [t.format(r=r, n=r + 1) for r in range(rounds) for t in (nearest, update)]
    return f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, row_number() OVER () AS row_id, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda c: isfinite(c))) = 64),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id), x) - 1 AS c, x FROM v ORDER BY sha256('2:' || vec_id), x LIMIT 40),
{",\n".join(steps)},
{nearest.format(r=rounds)}
SELECT vec_id, a.c::INT AS cluster, d AS distance, sum(d) OVER (PARTITION BY a.c)::BIGINT AS cluster_inertia, sum(d) OVER ()::BIGINT AS inertia, sha256(array_to_string(k.x, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} k ON k.c = a.c
"""


ORACLES = {
    "op2_minhash_near_dedup": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT doc_id, w[1] AS x, '' AS y FROM w WHERE len(w) = 1
  UNION
  SELECT doc_id, unnest(w[1:len(w) - 1]) AS x, unnest(w[2:len(w)]) AS y FROM w WHERE len(w) > 1),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.x = b.x AND a.y = b.y AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n m ON m.doc_id = a JOIN n o ON o.doc_id = b WHERE 100 * k >= 80 * (m.n + o.n - k)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
c AS (SELECT u AS node, v AS seen FROM e UNION SELECT c.node, e.v FROM c JOIN e ON c.seen = e.u),
m AS (SELECT node, min(seen) AS component FROM c GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(m.component, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.component, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.node = d.doc_id
""",
    "op3_url_filter": r"""
WITH RECURSIVE u AS (
  SELECT page_id, url, html, CASE WHEN url LIKE '%://%' THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS raw FROM u),
p AS (
  SELECT page_id, url, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM h),
k AS (
  SELECT *, CASE WHEN url LIKE '%://%' THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(regexp_replace(path, '(/index)?\.html?$', ''), '/+$', '') || '?' ||
         array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(utm_[a-z]+|ref|fbclid|gclid)(=|$)')), '&') END AS key FROM p),
r(action, rule, rhost, rpath) AS (VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
f AS (
  SELECT k.page_id, k.url, k.host, k.path, k.key, max(struct_pack(n := length(rule), rule := rule, action := action)) FILTER (rule IS NOT NULL) AS best
  FROM k LEFT JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY ALL),
a AS (SELECT key, CASE WHEN bool_or(best.action = 'allow') THEN 'allow' WHEN bool_or(best.action = 'block') THEN 'block' END AS alias FROM f WHERE key IS NOT NULL GROUP BY key)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.action, alias, 'allow') AS verdict FROM f LEFT JOIN a ON f.key = a.key
""",
    "op4_secret_scan": r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k(kind, i, p) AS (VALUES ('assign', 0, '(?i)(?:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+'), ('access', 1, 'AKIA[A-Z0-9]{16,}'), ('hex', 2, '[0-9a-f]{24,}'), ('run', 3, '[A-Za-z0-9+/_=-]{20,}')),
m AS (SELECT doc_id, kind, i, string_split_regex(t, p) AS g, regexp_extract_all(t, p) AS h FROM d, k),
u AS (SELECT *, unnest(range(1, len(h) + 1)) AS n FROM m),
x AS (SELECT doc_id, kind, i, h[n] AS hit, (list_sum(list_transform(g[1:n], lambda v: length(v))) + coalesce(list_sum(list_transform(h[1:n - 1], lambda v: length(v))), 0))::BIGINT AS s FROM u),
b AS (SELECT *, s + length(hit) AS e FROM x WHERE kind NOT IN ('assign', 'run') OR (kind = 'assign' AND length(regexp_extract(hit, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2)) >= 6)),
r AS (SELECT doc_id, hit, s, s + length(hit) AS e FROM x WHERE kind = 'run' AND NOT EXISTS (SELECT 1 FROM b WHERE b.doc_id = x.doc_id AND b.s < x.s + length(x.hit) AND x.s < b.e)),
z AS (SELECT sha256(range::VARCHAR) AS q FROM range(2048)),
l AS (SELECT 1 AS secret, q AS string FROM z UNION ALL SELECT 1, rtrim(to_base64(unhex(q)), '=') FROM z
      UNION ALL SELECT 0, string FROM (SELECT unnest(regexp_extract_all(t, '[A-Za-z0-9+/_=-]{16,}')) AS string FROM d) WHERE regexp_matches(string, '^([A-Z]?[a-z]+|[A-Z]+|[-_=+/]+)$')
      UNION ALL SELECT 0, CASE n % 5 WHEN 0 THEN a || '_' || b || '_' || c WHEN 1 THEN upper(a[1]) || a[2:] || upper(b[1]) || b[2:] || upper(c[1]) || c[2:] WHEN 2 THEN upper(a || '_' || b || '_' || c)
        WHEN 3 THEN a || '/' || b || '/' || c ELSE a || '-' || b || '-' || c || '-' || n END
      FROM (SELECT n, lower(v[3 * n + 1]) AS a, lower(v[3 * n + 2]) AS b, lower(v[3 * n + 3]) AS c FROM (
        SELECT v, unnest(range(len(v) // 3)) AS n FROM (SELECT regexp_extract_all(text, '[A-Za-z]{3,12}') AS v FROM (SELECT text FROM documents WHERE text IS NOT NULL ORDER BY md5(text), text LIMIT 200))))),
w AS (SELECT secret, substr(string, i, 2) AS pair, count(*) AS n FROM (SELECT *, unnest(range(1, length(string))) AS i FROM l) GROUP BY ALL),
a1 AS (SELECT secret, pair[1] AS c, sum(n) AS n FROM w GROUP BY ALL), a2 AS (SELECT secret, pair[2] AS c, sum(n) AS n FROM w GROUP BY ALL), tt AS (SELECT secret, sum(n) + 32.5 AS n FROM w GROUP BY ALL),
y AS (SELECT doc_id, s, e, substr(hit, i, 2) AS pair FROM (SELECT *, unnest(range(1, length(hit))) AS i FROM r)),
o AS (SELECT DISTINCT pair, v AS secret FROM y, (VALUES (0), (1)) c(v)),
pr AS (SELECT o.pair, o.secret, (coalesce(w.n, 0) + 5 * ((coalesce(a2.n, 0) + 0.5) / coalesce(tt.n, 32.5)))::DOUBLE / (coalesce(a1.n, 0) + 5)::DOUBLE AS p FROM o
  LEFT JOIN w ON w.pair = o.pair AND w.secret = o.secret LEFT JOIN a1 ON a1.c = o.pair[1] AND a1.secret = o.secret LEFT JOIN a2 ON a2.c = o.pair[2] AND a2.secret = o.secret LEFT JOIN tt ON tt.secret = o.secret),
lr AS (SELECT p1.pair, round(1000 * ln(p1.p / p0.p)) AS v FROM pr p1 JOIN pr p0 ON p0.pair = p1.pair AND p0.secret = 0 WHERE p1.secret = 1),
f AS (SELECT doc_id, s, e FROM y JOIN lr USING (pair) GROUP BY ALL HAVING sum(v) >= 20000),
ff AS (SELECT doc_id, kind, i, s, e FROM b UNION ALL SELECT doc_id, 'markov', 3, s, e FROM f),
j AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, i) FILTER (i < 3), '') AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, i) AS spans FROM ff GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN j ON j.doc_id = d.doc_id
""",
    "op6_source_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(coalesce(doc_id::VARCHAR, '')) AS digest FROM documents),
s AS (SELECT source, sum(size)::HUGEINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][sid % 3 + 1]::HUGEINT AS w FROM s),
o AS (SELECT *, 200 * s AS cap, 150 * sum(s) OVER () - coalesce(sum(200 * s) OVER (ORDER BY s / w, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
             sum(w) OVER (ORDER BY s / w, sid ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS opn FROM w),
g AS (SELECT *, cap * opn > lft * w AS free FROM o),
l AS (SELECT arg_min(lft, struct_pack(r := s / w, i := sid)) AS lft, arg_min(opn, struct_pack(r := s / w, i := sid)) AS opn FROM g WHERE free),
t AS (SELECT g.sid, g.source, g.s::BIGINT AS source_size, CASE WHEN free THEN (g.w * l.lft)::DOUBLE / (100.0::DOUBLE * l.opn::DOUBLE) ELSE (2 * g.s)::DOUBLE END AS target FROM g LEFT JOIN l ON true),
c AS (
  SELECT d.*, sid, source_size, target, floor(target + 0.5)::BIGINT AS goal,
         (sum(size) OVER (PARTITION BY d.source ORDER BY digest, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size)::BIGINT AS cum
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
b AS (SELECT sid, ceil(goal / 2048)::BIGINT AS n FROM (SELECT DISTINCT sid, goal FROM c)),
v AS (SELECT sid, n, sum(n) OVER (ORDER BY sid) AS upto, sum(n) OVER () AS total FROM b),
i AS (SELECT unnest(range((SELECT max(total) FROM v)::BIGINT)) AS slot),
q AS (SELECT slot, ((slot + 0.5::DOUBLE) * 0.6180339887498949::DOUBLE) % 1.0::DOUBLE AS u FROM i),
sc AS (SELECT sid, slot, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS block FROM q JOIN v ON (upto - n)::DOUBLE / total::DOUBLE <= u AND u < upto::DOUBLE / total::DOUBLE),
pc AS (SELECT doc_id, sid, cum + e * source_size AS a, least(cum + e * source_size + size, goal) AS z FROM c, (VALUES (0), (1)) ep(e) WHERE size > 0),
pd AS (SELECT doc_id, sid, unnest(range(a // 2048, (z - 1) // 2048 + 1)) AS block FROM pc WHERE a < z),
ps AS (SELECT doc_id, min(coalesce(slot, total + upto - n + block)) AS first_slot, count(*) AS n_pieces FROM pd JOIN v USING (sid) LEFT JOIN sc USING (sid, block) GROUP BY doc_id)
SELECT c.doc_id, size, source_size, target,
       (greatest(0, least(cum + size, goal) - cum) + greatest(0, least(source_size + cum + size, goal) - source_size - cum))::BIGINT AS taken, first_slot::BIGINT AS first_slot, coalesce(n_pieces, 0) AS n_pieces
FROM c LEFT JOIN ps ON ps.doc_id = c.doc_id
""",
    "op9_chat_format": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
b AS (
  SELECT *, bool_or(CASE role WHEN 'user' THEN contains(text, ' [/INST]') WHEN 'assistant' THEN contains(text, ' </s>') ELSE contains(text, ' [/ROLE]') OR contains(role, chr(10)) END) OVER (PARTITION BY conv_id) AS bad FROM t),
e AS (
  SELECT *, bad AND (regexp_matches(text, '\[/?INST|\[/?ROLE|</?s\*?>') OR (role NOT IN ('user', 'assistant') AND regexp_matches(role, '\[/?INST|\[/?ROLE|</?s\*?>|\n'))) AS esc FROM b),
x AS (
  SELECT *, length(text) + CASE WHEN esc THEN 1 + length(text) - length(translate(text, '~[<' || chr(10), '')) ELSE 0 END AS body,
         length(role) + CASE WHEN esc THEN length(role) - length(translate(role, '~[<' || chr(10), '')) ELSE 0 END AS head FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(body + CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE head + 16 + 0 END)::BIGINT AS formatted_chars
FROM x GROUP BY conv_id
""",
    "op11_repeated_phrases": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 11), lambda i: array_to_string(w[i:i + 12], ' '))) AS k, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) >= 13),
m AS (SELECT k, min(doc_id) AS source FROM x GROUP BY k),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM x JOIN m USING (k) WHERE source < doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
k AS (SELECT p.doc_id, count(c.p) AS n, string_agg(word, ' ' ORDER BY p.p) FILTER (c.p IS NULL) AS kept FROM p LEFT JOIN c ON c.doc_id = p.doc_id AND c.p = p.p GROUP BY p.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k ON k.doc_id = d.doc_id
""",
    "op12_va_clusters": _cluster_sql(),
    "op13_ranked_search": r"""
WITH t AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
f AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM f GROUP BY doc_id),
s AS (SELECT count(*) AS nn, sum(n)::BIGINT AS ll FROM n),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
w AS (SELECT term, floor(1000 * ln((2 * any_value(nn) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM f, s GROUP BY term),
m AS (SELECT doc_id, 100 - 50 + (50 * n * nn) // ll AS m FROM n, s),
r AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score FROM q JOIN f USING (term) JOIN w USING (term) JOIN m USING (doc_id) GROUP BY ALL)
SELECT item_id, rank::INT AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0) WHERE rank <= 50
""",
}
