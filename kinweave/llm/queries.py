"""The registered queries op1 to op13 and the DuckDB SQL of those that SQL can express.

Each query hands whole tables to its operator and derives the result's digests from what the operator returns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import bpe_encode
from .decontaminate import benchmark_hits, contaminated, words_hit
from .exact_dedup import exact_dedup
from .language import identify_languages, learn_languages
from .line_dedup import dedup_lines
from .near_dedup import near_dedup
from .packing import pack
from .prefix_trie import conversations, prefix_trie, rebuilt
from .quality import fit_quality, score_quality
from .secret_scan import BASE_RULES, secret_scan
from .shared import crc_text
from .spelling import spelling_forms
from .substring_dedup import dedup_substrings
from .url_filter import filter_urls, host_of, path_of

#: Names of junk sites, each blocked with its subdomains under every one of the roots. These domains, and
#: the locations (host and path) of pages with less html than this, are the block list of op3.
THIN_HTML = 1_500
JUNK_NAMES = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
ROOTS = ("example.com", "example.net", "example.org")
LISTED = tuple(f"{name}.{root}" for name in JUNK_NAMES for root in ROOTS)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sha256(col) -> F.Column:
    return F.sha2(col, 256)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_substrings(table(spark, sf_dir, "documents"), length=400)
    text = F.make_valid_utf8(F.col("kept").cast("string"))  # a removed run may end within a character
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", sha256("kept").alias("kept_sha256"), text.alias("text"))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(crc_text(F.col(c)) % 3 == 1, F.lit(False))
    model = fit_quality(docs, table(spark, sf_dir, "labels"), learn=~held_out("__id"))
    scored = score_quality(docs, model)
    return scored.select("doc_id", held_out("doc_id").alias("held_out"), "score", "predicted")


def blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key): domains and locations that op3 blocks."""
    thin = table(spark, sf_dir, "pages").filter(F.length("html") < THIN_HTML)
    return spark.createDataFrame([(d,) for d in LISTED], "key string").unionAll(thin.select(F.concat(host_of(F.col("url")), path_of(F.col("url")))))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = filter_urls(table(spark, sf_dir, "pages"), blocked(spark, sf_dir))
    return found.select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = rf"""
WITH n AS (SELECT unnest(['adult-x', 'ads-track', 'casino-win', 'cheap-pills', 'free-bets', 'spam-farm']) AS name),
listed AS (SELECT name || '.example.' || root AS domain FROM n CROSS JOIN (SELECT unnest(['com', 'net', 'org']) AS root) z),
s AS (SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, rest, regexp_extract(rest, '^[^/?#]*') AS own FROM s),
u AS (
  SELECT page_id, coalesce(translate(own, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(substring(rest, length(own) + 1), '^[^?#]*'), '') AS path
  FROM p),
r(verdict, rhost, rpath) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
f AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM u JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id)
SELECT u.page_id, host, path, f.rule AS rule,
       coalesce(f.verdict, CASE WHEN EXISTS (SELECT 1 FROM listed l WHERE u.host = l.domain OR ends_with(u.host, '.' || l.domain))
         OR host || path IN (SELECT host || path FROM u JOIN pages p ON p.page_id = u.page_id WHERE length(html) < {THIN_HTML}) THEN 'block' ELSE 'allow' END) AS verdict
FROM u LEFT JOIN f ON u.page_id = f.page_id
"""


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_encode(table(spark, sf_dir, "documents"), vocabulary_path(), decoded=True)
    return coded.select("doc_id", "n_tokens", sha256("ids").alias("ids_sha256"), sha256("decoded").alias("decoded_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan(table(spark, sf_dir, "documents"))
    kinds = [r.kind for r in BASE_RULES]
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        "doc_id",
        *(count(k).alias(f"n_{k}") for k in kinds),
        sha256(said(F.filter("spans", lambda s: s["kind"].isin(kinds)))).alias("base_sha256"),
        said(F.col("spans")).alias("spans"),
    )


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = benchmark_hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = words_hit(F.col("spans"))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        sha256(F.array_join("items", ",")).alias("items_sha256"),
        contaminated(n_hit, F.col("n_words")).alias("contaminated"),
    )


LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP6_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWERED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (
  SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS key
  FROM (SELECT item, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0) z),
h AS (
  SELECT doc_id, i, x.n, item
  FROM (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS key
        FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d CROSS JOIN (SELECT DISTINCT n FROM p) l WHERE len(w) >= n) z) x
  JOIN p ON p.n = x.n AND p.key = x.key),
c AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS j FROM h) z GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, item FROM h WHERE item IS NOT NULL) z GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN c ON c.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), keep="largest")
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP7_SQL = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup_lines(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", sha256("text").alias("kept_sha256"))


OP8_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i
  FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, i, line, f.key IS NOT NULL AND k.doc_id <> keeper AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = lambda c: F.coalesce(crc_text(F.col(c)) % 4 == 2, F.lit(False))
    contents = learn_languages(docs, ~held_out("__id"))
    found = identify_languages(docs, contents)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "rejected")


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(table(spark, sf_dir, "documents"), least=85)


OP10_SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({LOWERED}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0) z),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (
  SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM s p JOIN s q ON p.g = q.g AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r(id, c) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.id)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r.c) AS component_id, min(r.c) = d.doc_id AS kept
FROM d JOIN r ON r.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id
"""


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    convs = conversations(table(spark, sf_dir, "conversations"))
    conv = F.col("conv_id")
    return prefix_trie(rebuilt(convs, conv - conv % 5, (crc_text(conv) % 9).cast("int"), 8))


def crc_sql(codes: str) -> str:
    """DuckDB SQL for the CRC-32 of a list of byte values (DuckDB has no function for it)."""
    step = "CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END"
    byte = f"list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: {step})"
    return f"xor(list_reduce(list_concat([4294967295::BIGINT], {codes}), lambda c, b: {byte}), 4294967295)"


OP11_SQL = f"""
WITH t AS (
  SELECT conv_id, list(struct_pack(r := coalesce(role, ''), t := coalesce(text, '')) ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS ts
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, ts, conv_id - conv_id % 5 AS base,
         {crc_sql("list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda z: CAST(ord(z) AS BIGINT))")} % 9 AS h
  FROM t),
r AS (SELECT h.conv_id, list_concat(CASE WHEN h > 0 THEN coalesce(b.ts[1:h], []) ELSE [] END, h.ts[h + 1:]) AS ts FROM h LEFT JOIN t b ON b.conv_id = h.base),
p AS (SELECT conv_id, d, ts[1:d] AS pre, len(ts) AS size FROM (SELECT conv_id, ts, unnest(range(0, len(ts) + 1)) AS d FROM r) z),
n AS (
  SELECT pre, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = d) AS ends
  FROM p GROUP BY pre),
u AS (SELECT c.conv_id, c.depth, b.conv_id AS up FROM n c JOIN n b ON b.depth = c.depth - 1 AND b.pre = c.pre[1:c.depth - 1]),
k AS (SELECT up AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM u GROUP BY ALL),
w AS (
  SELECT n.*, u.up AS parent_conv_id, coalesce(n_children, 0) AS n_children,
         CASE WHEN n.depth > 0 THEN (n_convs - 1) * strlen(n.pre[n.depth].t) ELSE 0 END AS saved
  FROM n LEFT JOIN u ON u.conv_id = n.conv_id AND u.depth = n.depth LEFT JOIN k ON k.conv_id = n.conv_id AND k.depth = n.depth),
s AS (
  SELECT p.pre, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved
  FROM w JOIN p ON p.conv_id = w.conv_id AND p.d <= w.depth GROUP BY p.pre)
SELECT w.conv_id, w.depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ends, '')) AS ends_sha256
FROM w JOIN s ON s.pre = w.pre
"""


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_forms(table(spark, sf_dir, "documents"))


BYTES_OF_RUN = """
flatten(list_transform(string_split(doc_id || ':' || run, ''),
  lambda z: CASE WHEN ord(z) < 128 THEN [CAST(ord(z) AS BIGINT)] ELSE [195::BIGINT, CAST(ord(z) AS BIGINT) - 64] END))"""
OP12_SQL = rf"""
WITH RECURSIVE o AS (
  SELECT doc_id, run, count(*) AS k
  FROM (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, unnest(regexp_extract_all({LOWERED}, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')) AS run FROM documents) z
  WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, k, {crc_sql(BYTES_OF_RUN)} AS h FROM o),
w AS (
  SELECT word, CAST(sum(k) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 31 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word, k FROM h) z
  WHERE length(word) >= 7 GROUP BY word HAVING sum(k) >= 2),
c AS (SELECT word, substring(word, 1, i) AS a, substring(word, i + 2) AS b FROM (SELECT word, unnest(range(0, length(word))) AS i FROM w) z),
d AS (SELECT DISTINCT c.word, w.word AS other FROM c JOIN w ON w.word = a || b),
near AS (
  SELECT DISTINCT x.word, y.word AS other FROM c x JOIN c y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT word, other FROM d UNION SELECT other, word FROM d),
best AS (SELECT near.word, count(*) AS n_near, first(o.word ORDER BY o.n DESC, o.word) AS other, max(o.n) AS m FROM near JOIN w o ON o.word = near.other GROUP BY near.word),
f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN other END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n
  FROM w LEFT JOIN best ON best.word = w.word),
r AS (SELECT word, word AS root, form FROM f UNION ALL SELECT r.word, f.word, f.form FROM r JOIN f ON f.word = r.form)
SELECT f.word, f.form, r.root, f.n, f.n_near, f.form_n FROM f JOIN r ON r.word = f.word AND r.form IS NULL
"""


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), vocabulary_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_substring_dedup": op1_substring_dedup,
        "op2_quality": op2_quality,
        "op3_url_filter": op3_url_filter,
        "op4_bpe": op4_bpe,
        "op5_secrets": op5_secrets,
        "op6_decontaminate": op6_decontaminate,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_line_dedup": op8_line_dedup,
        "op9_language": op9_language,
        "op10_near_dedup": op10_near_dedup,
        "op11_conversation_trie": op11_conversation_trie,
        "op12_spelling": op12_spelling,
        "op13_packing": op13_packing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op3_url_filter": OP3_SQL,
        "op6_decontaminate": OP6_SQL,
        "op7_exact_dedup": OP7_SQL,
        "op8_line_dedup": OP8_SQL,
        "op10_near_dedup": OP10_SQL,
        "op11_conversation_trie": OP11_SQL,
        "op12_spelling": OP12_SQL,
    }
