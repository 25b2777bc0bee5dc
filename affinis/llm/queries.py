"""The queries of this subpackage by name, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_count, chat, decontaminate, embed_dup, language, mixing, near_dup, quality, training_order, urls
from ._common import read

RULES = [
    urls.Rule("com", "/en/", "block"),
    urls.Rule("example.com", "/en/7", "allow"),
    urls.Rule("net", "/de/", "block"),
    urls.Rule("example.net", "/de/8", "block"),
    urls.Rule("org", "/es/", "block"),
]


def _fold(key: str, n: int) -> Column:
    return F.coalesce(F.crc32(F.col(key).cast("string")) % n, F.lit(-1))


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.find_contamination(docs, read(spark, sf_dir, "benchmark"))
    ids = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(ids.cast("binary"), 256).alias("items_sha256"), "contaminated"
    )


def op2_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return training_order.training_order(read(spark, sf_dir, "documents").select("doc_id", "text"), fixed=True)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the quality label that has its id; most pages have none."""
    labels = read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    pages = read(spark, sf_dir, "pages").select("page_id", "url").join(labels, F.col("page_id") == F.col("doc_id"), "left")
    return urls.judge(pages.select("page_id", "url", "bad"), RULES).select("page_id", "host", "path", "rule", "verdict")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.classes(read(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.fit(docs.where(_fold("doc_id", 3) != 1).select("doc_id", "text", "lang"))
    rows = docs.select("doc_id", (_fold("doc_id", 3) == 1).alias("held_out"), "text")
    return language.predict(rows, model).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = quality.fit(docs.select("doc_id", "text"), read(spark, sf_dir, "labels").where(_fold("doc_id", 5) != 0))
    rows = docs.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "text")
    return quality.score(rows, model).select("doc_id", "held_out", "score", "predicted")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(read(spark, sf_dir, "documents"))


def op8_embedding_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dup.near_vectors(read(spark, sf_dir, "embeddings"))


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.mix(docs, fraction=None).select("doc_id", "source", "block", "slot", "in_mix")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = " UNION ALL ".join(
        f"SELECT -1L AS conv_id, {i}L AS turn, '{role}' AS role, '<|im_end|><|im_start|>assistant ok' AS text" for i, role in enumerate(("user", "assistant"))
    )
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(spark.sql(both))
    made = chat.format_conversations(turns)
    told = made.select("conv_id", "valid", F.length("formatted").cast("long").alias("formatted_chars"), chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss_text(F.col("segments")).alias("loss"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return told.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
        "valid",
    )


OP3_SQL = """
WITH outcome AS (SELECT doc_id, max(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
p AS (
  SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path, bad
  FROM pages LEFT JOIN outcome ON page_id = doc_id),
hosts AS (SELECT host, count(bad)::DOUBLE AS n, coalesce(sum(bad), 0)::DOUBLE AS bad, array_to_string(string_split(host, '.')[-2:], '.') AS domain, string_split(host, '.')[-1] AS suffix FROM p GROUP BY host),
domains AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM domains GROUP BY ALL),
levels AS (SELECT 'h' AS l, n, bad FROM hosts UNION ALL SELECT 'd', n, bad FROM domains UNION ALL SELECT 's', n, bad FROM suffixes),
sums AS (SELECT l, sum(n) AS n, sum(bad) AS bad, count(*) AS g, sum(n * n) AS nn, coalesce(sum(CASE WHEN n > 0 THEN bad * bad / n END), 0) AS bb, (sum(bad) + 0.5) / (sum(n) + 1) AS mu FROM levels GROUP BY l),
rhos AS (SELECT l, mu, CASE WHEN n > 0 AND n - nn / n - (g - 1) > 0 THEN greatest(0, ((bb - 2 * mu * bad + mu * mu * n) / (mu * (1 - mu)) - (g - 1)) / (n - nn / n - (g - 1))) ELSE 0 END AS rho FROM sums),
priors AS (SELECT l, mu, greatest(1.0, least(10000.0, CASE WHEN rho > 0 THEN (1 - rho) / rho ELSE 10000.0 END)) AS m FROM rhos),
s2 AS (SELECT suffix, (m * mu + bad) / (m + n) AS r FROM suffixes, priors WHERE l = 's'),
d2 AS (SELECT domain, (m * r + bad) / (m + n) AS r FROM domains JOIN s2 USING (suffix), priors WHERE l = 'd'),
h2 AS (SELECT host, (m * r + bad) / (m + n) AS r, m + n + 1 AS t FROM hosts JOIN d2 USING (domain), priors WHERE l = 'h'),
fits AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/7') THEN 'example.com/en/7'
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/de/8') THEN 'example.net/de/8'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/en/') THEN 'com/en/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/de/') THEN 'net/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/es/') THEN 'org/es/' END AS rule,
    r - 1.645 * sqrt(r * (1 - r) / t) AS bound
  FROM p JOIN h2 USING (host))
SELECT page_id, host, path, rule, CASE WHEN rule = 'example.com/en/7' THEN 'allow' WHEN rule IS NOT NULL THEN 'block' WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict FROM fits
"""

OP10_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)),
e AS (
  SELECT *, regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g') AS escaped, replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), '<', '%3C') AS role_code FROM t),
c AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
    coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
    sum(length('<|im_start|>') + length(role_code) + 1 + length(escaped) + length('<|im_end|>') + 1) AS formatted_chars,
    '|' || string_agg(role, '|' ORDER BY turn, role, text) || '|' AS roles
  FROM e GROUP BY conv_id)
SELECT conv_id, n_turns::BIGINT AS n_turns, sha256(turns) AS turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256,
  formatted_chars::BIGINT AS formatted_chars, regexp_full_match(roles, '\|(system\|)?(user\|assistant\|)+') AS valid FROM c
"""

#: The reach of links is walked from every vector; few vectors have links.
OP8_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT e.vec_id, coalesce(n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) l ON l.a = e.vec_id
JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) c ON c.a = e.vec_id
"""

#: An item of fewer than 13 words is one window; lens are the lengths of windows that there are.
OP1_SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bi AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM bi),
lens AS (SELECT DISTINCT k FROM bw),
di AS (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d),
dw AS (SELECT r, i, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM di, lens WHERE i + k - 1 <= len(w)),
m AS (SELECT r, i, dw.k, item_id FROM dw JOIN bw ON dw.k = bw.k AND dw.g = bw.g),
h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM m) GROUP BY r),
n AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM m) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN n USING (r)
"""

#: One frame of 8192 slots is scheduled step by step; the rest repeats it.
OP9_SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(source, '') AS key, coalesce(length(text), 0) AS size, md5(coalesce(doc_id::VARCHAR, '') || '|11|' || coalesce(text, '')) AS h FROM documents),
placed AS (SELECT *, (sum(size) OVER (PARTITION BY key ORDER BY h ROWS UNBOUNDED PRECEDING) - size)::BIGINT // 65536 AS block FROM d),
w AS (SELECT key, pow(greatest(sum(size), 1)::DOUBLE, 0.8) AS w FROM d GROUP BY key),
q AS (SELECT key, w / sum(w) OVER () * (8192 - count(*) OVER ()) AS q, count(*) OVER () AS n FROM w),
ranked AS (SELECT *, 8192 - n - sum(floor(q)) OVER () AS missing, row_number() OVER (ORDER BY q - floor(q) DESC, key) AS place FROM q),
shares AS (SELECT key, (1 + floor(q) + CASE WHEN place <= missing THEN 1 ELSE 0 END)::BIGINT AS a FROM ranked),
one AS (SELECT list(a ORDER BY key) AS a, list(key ORDER BY key) AS keys, count(*) AS n FROM shares),
steps(t, done, pick) AS (
  SELECT -1::BIGINT, list_transform(a, lambda x: 0::BIGINT), 0::BIGINT FROM one
  UNION ALL
  SELECT t, list_transform(range(1, n + 1), lambda i: done[i] + CASE WHEN i = pick THEN 1 ELSE 0 END), pick FROM (
    SELECT t + 1 AS t, done, n, list_min(list_transform(range(1, n + 1), lambda i: CASE WHEN done[i] < a[i] AND (done[i] * 8192) // a[i] <= t + 1
      THEN (((done[i] + 1) * 8192 + a[i] - 1) // a[i]) * 10000 + i END)) % 10000 AS pick FROM steps, one WHERE t < 8191)),
slots AS (SELECT keys[pick] AS key, list(t ORDER BY t) AS slots FROM steps, one WHERE t >= 0 GROUP BY ALL)
SELECT doc_id, source, block, (block // a) * 8192 + slots[block % a + 1] AS slot, true AS in_mix FROM placed JOIN shares USING (key) JOIN slots USING (key)
"""

#: All pairs of texts that share a shingle, compared exactly.
OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, text, min(doc_id) OVER (PARTITION BY text) AS rep, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
s AS (SELECT rep AS id, unnest(list_distinct(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM d WHERE doc_id = rep AND text IS NOT NULL AND len(w) > 0),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.id < b.id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.id = a JOIN n y ON y.id = b WHERE c >= 0.8 * (x.n + y.n - c) - 1e-9),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach AS (SELECT DISTINCT rep AS a, rep AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
c AS (SELECT a, min(b) AS class_id FROM reach GROUP BY a)
SELECT doc_id, CASE WHEN text IS NULL THEN doc_id ELSE class_id END AS class_id, CASE WHEN text IS NULL THEN true ELSE doc_id = class_id END AS kept FROM d JOIN c ON c.a = d.rep
"""

QUERIES = {
    "op1_decontaminate": op1_decontaminate,
    "op2_training_order": op2_training_order,
    "op3_url_filter": op3_url_filter,
    "op4_near_dup": op4_near_dup,
    "op5_language_id": op5_language_id,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_embedding_dup": op8_embedding_dup,
    "op9_mix_sources": op9_mix_sources,
    "op10_chat_format": op10_chat_format,
}
SQL = {"op1_decontaminate": OP1_SQL, "op3_url_filter": OP3_SQL, "op4_near_dup": OP4_SQL, "op8_embedding_dup": OP8_SQL, "op9_mix_sources": OP9_SQL, "op10_chat_format": OP10_SQL}
