"""What SQL can express of the operators' results, as queries beside them with DuckDB's SQL.

Each takes its rows from the operator's own query, so that it checks what that returns; learned columns are left out.
Op11 to op13 have SQL for their whole queries.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anisotropic, crf, interpolation, kneser_ney, mixing, secret_scan, shared, url_rules

#: crc32 of doc_id's digits, by its table.
CRC = """t AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS t),
f AS (SELECT doc_id, xor(list_reduce(list_concat([4294967295], list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS crc FROM (SELECT DISTINCT doc_id FROM documents), t)"""


def language_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: which documents are held out, and which have a language at all."""
    from . import registry

    return registry.op1_language(spark, sf_dir).select("doc_id", "held_out", (F.col("lang_pred") != crf.UNKNOWN).alias("has_language"))


LANGUAGE_FOLDS = rf"WITH {CRC} SELECT doc_id, crc % 5 = 0 AS held_out, regexp_matches(coalesce(text, ''), '\p{{L}}') AS has_language FROM documents JOIN f USING (doc_id)"


def base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: counts and the base score."""
    shared.small_batches(spark)
    return interpolation.score(shared.table(spark, sf_dir, "documents")).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


BASE_SCORES = rf"""WITH {CRC}, w AS (SELECT doc_id, crc % 7 = 2 AS held_out, list_append(list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> ''), chr(10)) AS w FROM documents JOIN f USING (doc_id)),
x AS (SELECT doc_id, held_out, unnest(w) AS w FROM w), c AS (SELECT w, count(*) AS c FROM x WHERE NOT held_out GROUP BY 1), n AS (SELECT sum(c)::BIGINT AS n, count(*) AS v FROM c)
SELECT doc_id, any_value(held_out) AS held_out, count(*) AS n_tokens, count(c) AS n_known, any_value(n) AS train_tokens, round(sum(log10((coalesce(c, 0) + 1) / (n + (v + 1)))), 4) AS base_score FROM x LEFT JOIN c USING (w) CROSS JOIN n GROUP BY 1"""


def base_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: the counts and the verdict of the base rules."""
    shared.small_batches(spark)
    rows = kneser_ney.judge(shared.table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


BASE_QUALITY = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
g AS (SELECT doc_id, i, md5(array_to_string(w[i + 1 : i + 8], ' ')) AS k FROM (SELECT doc_id, w, unnest(range(0, len(w) - 7)) AS i FROM d)),
c AS (SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS t FROM g) WHERE t > 1), (SELECT unnest(range(0, 8)) AS j) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1)
SELECT doc_id, len(w) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, len(w) < 20 OR 100 * coalesce(c.n, 0) > 30 * len(w) AS base_failed FROM d LEFT JOIN c USING (doc_id) LEFT JOIN l USING (doc_id)"""


def nearest_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all of it, with the scores rounded."""
    rows = anisotropic.nearest(shared.table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
    return rows.select("query_id", "rank", "vec_id", F.round("score", 6).alias("score"))


NEAREST_ROUNDED = """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), s AS (SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x) AS s FROM v q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS rank FROM s) SELECT query_id, rank::INT AS rank, vec_id, round(s, 6) AS score FROM r WHERE rank <= 20"""


def fixed_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: hosts, paths, and what the fixed rules decide."""
    rows = url_rules.judge(shared.table(spark, sf_dir, "pages"))
    return rows.select("page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull(), F.col("verdict")).alias("verdict"))


FIXED_URL_RULES = """WITH r(rule_host, rule_path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
a AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS a FROM pages), h AS (SELECT page_id, a, regexp_extract(a, '^[^/?#]*') AS h FROM a),
u AS (SELECT page_id, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(substr(a, length(h) + 1), '^[^?#]*') AS path FROM h),
b AS (SELECT page_id, arg_max({'rule': rule_host || rule_path, 'verdict': verdict}, length(rule_host || rule_path)) AS b FROM u JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY 1)
SELECT page_id, host, path, b.rule AS rule, b.verdict AS verdict FROM u LEFT JOIN b USING (page_id)"""


def mixing_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8: documents and tokens of each source, as its first copies have them."""
    rows = mixing.plan(shared.table(spark, sf_dir, "documents")).where("copy = 0")
    return rows.groupBy("source").agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))


MIXING_TOTALS = r"SELECT source, count(*) AS docs, sum(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) + 1)::BIGINT AS tokens FROM documents GROUP BY 1"


def secret_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10: how often each fixed pattern is found."""
    shared.small_batches(spark)
    return secret_scan.scan(shared.table(spark, sf_dir, "documents")).select("doc_id", "n_assign", "n_access", "n_hex")


def either(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


ASSIGN = f"(?:{either('password')}|{either('passwd')}|{either('secret')}|{either('token')}|{either('api')}_?{either('key')})[\"'']?\\x20*[:=]\\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
SECRET_COUNTS = f"""SELECT doc_id, len(list_filter(regexp_extract_all(coalesce(text, ''), '{ASSIGN}', 1), lambda x: length(x) >= 6)) AS n_assign,
len(list_filter(regexp_extract_all(coalesce(text, ''), 'AKIA[A-Z0-9]+'), lambda x: length(x) >= 20)) AS n_access, len(list_filter(regexp_extract_all(coalesce(text, ''), '[0-9a-f]+'), lambda x: length(x) >= 24)) AS n_hex FROM documents"""

#: op11: all of it.
DIVERGENCE = r"""WITH d AS (SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
kt AS (SELECT lang, t FROM (SELECT lang, unnest(list_distinct(w)) AS t FROM d) GROUP BY ALL HAVING count(*) >= 10),
c AS (SELECT lang, source, t, n FROM (SELECT lang, source, t, count(*) AS n FROM (SELECT lang, source, unnest(w) AS t FROM d) GROUP BY ALL) JOIN kt USING (lang, t)),
v AS (SELECT lang, count(*) AS v FROM kt GROUP BY 1),
ns AS (SELECT lang, source, coalesce(sum(n), 0)::HUGEINT AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL), nl AS (SELECT lang, sum(n)::HUGEINT AS n FROM ns GROUP BY 1),
p AS (SELECT lang, source, t, coalesce(c.n, 0) AS c, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 2)) // (ns.n + 2 * v.v) AS p FROM ns JOIN v USING (lang) JOIN kt USING (lang) LEFT JOIN c USING (lang, source, t)),
q AS (SELECT lang, t, 1 + (1000000000::HUGEINT * (sum(c) + 2)) // (any_value(nl.n) + 2 * any_value(v.v)) AS q FROM p JOIN nl USING (lang) JOIN v USING (lang) GROUP BY ALL),
s AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.t = b.t AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
 UNION ALL SELECT lang, source, 'term', t, (((p - q) * (p - q)) // (p + q))::BIGINT FROM p JOIN q USING (lang, t) WHERE c > 0 AND p > q)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM r) WHERE part = 'pair' OR rank <= 10"""

#: op12: all of it, the links by counting shared shingles of each pair.
BOTTOM_K = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN CASE WHEN len(w) = 0 THEN [] ELSE [array_to_string(w, ' ')] END ELSE list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
k AS (SELECT doc_id, min(n) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM s JOIN n USING (doc_id) GROUP BY 1),
u AS (SELECT min(doc_id) AS doc_id, k FROM k GROUP BY k),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM (SELECT s.* FROM s JOIN u USING (doc_id)) a JOIN (SELECT s.* FROM s JOIN u USING (doc_id)) b USING (g) WHERE a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c) UNION SELECT u.doc_id, k.doc_id FROM u JOIN k USING (k) WHERE u.doc_id <> k.doc_id),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, root) AS (SELECT a, least(a, b) FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id WHERE r.root < e.b)
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept FROM documents LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY 1) USING (doc_id)"""

#: op13: all of it, with CRC-32 by its table.
IMPORTANCE = r"""WITH c AS (SELECT list_transform(range(0, 256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: xor(c >> 1, (c & 1) * 3988292384))) AS c),
d AS (SELECT 'd' AS of, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark),
w AS (SELECT of, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM d),
f AS (SELECT of, doc_id, array_to_string(w[i : i + n - 1], ' ') AS f FROM (SELECT of, doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS n))),
h AS (SELECT f, xor(list_reduce(list_concat([4294967295], list_transform(range(1, length(hex(encode(f))) // 2 + 1), lambda i: ('0x' || hex(encode(f))[2 * i - 1 : 2 * i])::BIGINT)), lambda s, b: xor(s >> 8, c[(xor(s, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM (SELECT DISTINCT f FROM f), c),
n AS (SELECT bucket, count(*) FILTER (of = 'd') AS s, count(*) FILTER (of = 'b') AS t FROM f JOIN h USING (f) GROUP BY 1),
g AS (SELECT bucket, floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM n) + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))::DOUBLE))::BIGINT AS gain FROM n),
x AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM f JOIN h USING (f) JOIN g USING (bucket) WHERE of = 'd' GROUP BY 1),
y AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, len(w) >= 20 AS able, coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM w LEFT JOIN x USING (doc_id) WHERE of = 'd')
SELECT doc_id, n_features, weight, score, CASE WHEN able AND r <= 5 * (SELECT count(*) FILTER (able) FROM y) // 100 THEN r END AS rank FROM (SELECT *, row_number() OVER (ORDER BY able DESC, score DESC, doc_id) AS r FROM y)"""

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (language_folds, base_scores, base_quality, nearest_rounded, fixed_url_rules, mixing_totals, secret_counts)}
SQL: dict[str, str] = {"language_folds": LANGUAGE_FOLDS, "base_scores": BASE_SCORES, "base_quality": BASE_QUALITY, "nearest_rounded": NEAREST_ROUNDED, "fixed_url_rules": FIXED_URL_RULES, "mixing_totals": MIXING_TOTALS, "secret_counts": SECRET_COUNTS, "op11_divergence": DIVERGENCE, "op12_bottom_k": BOTTOM_K, "op13_importance": IMPORTANCE}
