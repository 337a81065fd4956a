"""Queries of the training-data operators and their SQL for the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, htmltext, infill, language, neardup, packing, prefixes, quality, secrets, sharding, substrings, tokens, toxicity
from .common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"))


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeat_report(table(spark, sf_dir, "documents"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.page_texts(table(spark, sf_dir, "pages"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_report(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_report(table(spark, sf_dir, "documents"))


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.find_components(table(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie_report(table(spark, sf_dir, "conversations"))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return infill.infill_report(table(spark, sf_dir, "documents"))


def op13_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_sharding, op2_secret_scan, op3_decontamination, op4_substring_dedup, op5_main_text, op6_quality_rules, op7_token_ids, op8_language_id, op9_near_duplicates, op10_packing, op11_prefix_trie, op12_fill_in_middle, op13_toxicity, pipeline)}

LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = f"regexp_extract_all({LOWER.format('text')}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_WORDS = f"regexp_extract_all({LOWER.format('text')}, '[^\\x20\\x09-\\x0D]+')"

#: One bit of CRC-32, eight of which take in a byte.
_CRC_BIT = "xor(c >> 1, 3988292384 * (c & 1))"

#: SQL for the queries whose whole result SQL can state; tests compare the others with brute force.
ORACLE_SQL: dict[str, str] = {
    "op3_decontamination": f"""WITH d AS (SELECT doc_id, {_BENCH_WORDS} AS w FROM documents), i AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS} AS w FROM benchmark),
    iw AS (SELECT DISTINCT item, n, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS k FROM i WHERE len(w) > 0)),
    dw AS (SELECT doc_id, n, k, array_to_string(w[k:k + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM iw) WHERE len(w) >= n)),
    hit AS (SELECT dw.doc_id, dw.n, dw.k, iw.item FROM dw JOIN iw USING (n, win)),
    covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hit) GROUP BY doc_id),
    named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit WHERE item IS NOT NULL) GROUP BY doc_id)
    SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op4_substring_dedup": """WITH b AS (SELECT doc_id, row_number() OVER () AS r, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
    piece AS (SELECT r, n, p, substr(x, 2 * p + 1, 798) AS y FROM (SELECT r, n, x, unnest(range(0, n - 199, 200)) AS p FROM b WHERE n >= 200)),
    w AS (SELECT r, p + i AS k, md5(substr(y, 2 * i - 1, 400)) AS h FROM (SELECT r, p, y, unnest(range(1, least(200, n - 199 - p) + 1)) AS i FROM piece)),
    hit AS (SELECT r, k FROM w WHERE h IN (SELECT h FROM w GROUP BY h HAVING count(*) > 1)),
    run AS (SELECT r, k, sum(fresh) OVER (PARTITION BY r ORDER BY k) AS g FROM (SELECT r, k, CASE WHEN k <= lag(k) OVER (PARTITION BY r ORDER BY k) + 200 THEN 0 ELSE 1 END AS fresh FROM hit)),
    span AS (SELECT r, min(k) AS a, max(k) + 200 AS z FROM run GROUP BY r, g),
    gap AS (SELECT r, a, z, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 1) AS p FROM span),
    cut AS (SELECT r, count(*) AS n_spans, sum(z - a) AS n_removed, max(z) AS z, string_agg(substr(x, 2 * p - 1, 2 * (a - p)), '' ORDER BY a) AS kept FROM gap JOIN b USING (r) GROUP BY r)
    SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, '') || substr(x, 2 * coalesce(z, 1) - 1))) AS kept_sha256 FROM b LEFT JOIN cut USING (r)""",
    "op9_near_duplicates": f"""WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    s AS (SELECT DISTINCT doc_id, array_to_string(w[k:k + 1], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w), 2))) AS k FROM d WHERE len(w) > 0)),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    sized AS (SELECT s.doc_id, hash(g) AS g, n FROM s JOIN n USING (doc_id)),
    links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM sized a JOIN sized b ON a.g = b.g AND a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id HAVING 100 * count(*) >= 80 * (any_value(a.n) + any_value(b.n) - count(*))),
    e AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
    reach AS (SELECT doc_id AS x, doc_id AS least FROM d UNION SELECT e.b, r.least FROM reach r JOIN e ON e.a = r.x WHERE r.least < e.b)
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, c.component_id, c.component_id = d.doc_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT x, min(least) AS component_id FROM reach GROUP BY x) c ON c.x = d.doc_id""",
    "op11_prefix_trie": f"""WITH RECURSIVE o AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), x) AS k, x, w FROM (SELECT *, sha256(CAST(strlen(coalesce(role, '')) AS VARCHAR) || ':' || coalesce(role, '') || coalesce(text, '')) AS x, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS w FROM conversations WHERE conv_id IS NOT NULL)),
    t AS (SELECT conv_id, list(x ORDER BY k) AS x, list(w ORDER BY k) AS w FROM o GROUP BY conv_id),
    bits AS (SELECT conv_id, CAST(conv_id AS VARCHAR) AS s, 0 AS i, CAST(4294967295 AS BIGINT) AS c FROM t
      UNION ALL SELECT conv_id, s, i + 1, {_CRC_BIT} FROM (SELECT conv_id, s, i, CASE WHEN i % 8 = 0 THEN xor(c, CAST(ascii(substr(s, i // 8 + 1, 1)) AS BIGINT)) ELSE c END AS c FROM bits WHERE i < 8 * length(s))),
    h AS (SELECT conv_id, CAST(xor(c, 4294967295) % 4 AS INTEGER) AS h FROM bits WHERE i = 8 * length(s)),
    r AS (SELECT t.conv_id, list_concat(coalesce(b.x, [])[1:h], t.x[h + 1:]) AS x, list_concat(coalesce(b.w, [])[1:h], t.w[h + 1:]) AS w FROM t JOIN h USING (conv_id) LEFT JOIN t b ON b.conv_id = t.conv_id - t.conv_id % 20),
    p AS (SELECT conv_id, len(x) AS n, d, md5(array_to_string(x[1:d], ',')) AS v, CASE WHEN d > 0 THEN md5(array_to_string(x[1:d - 1], ',')) END AS above, CASE WHEN d > 0 THEN w[d] ELSE 0 END AS w FROM (SELECT *, unnest(range(0, len(x) + 1)) AS d FROM r)),
    node AS (SELECT v, d, any_value(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, sha256(coalesce(string_agg(CASE WHEN d = n THEN CAST(conv_id AS VARCHAR) END, ',' ORDER BY conv_id), '')) AS ends_sha256 FROM p GROUP BY v, d),
    kids AS (SELECT above AS v, d - 1 AS d, count(*) AS n_children FROM node WHERE d > 0 GROUP BY above, d),
    full_node AS (SELECT node.*, coalesce(n_children, 0) AS n_children FROM node LEFT JOIN kids USING (v, d)),
    below AS (SELECT p.v, p.d, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.w) AS saved FROM full_node f JOIN p ON p.conv_id = f.conv_id AND p.d <= f.d GROUP BY p.v, p.d)
    SELECT f.conv_id, f.d AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children, CAST(n_leaves AS BIGINT) AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256 FROM full_node f JOIN below USING (v, d) LEFT JOIN node u ON u.v = f.above AND u.d = f.d - 1""",
    "op12_fill_in_middle": """WITH x AS (SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
    h AS (SELECT doc_id, t, n, CAST('0x' || x[1:8] AS BIGINT) % (n + 1) AS h1, CAST('0x' || x[9:16] AS BIGINT) % (n + 1) AS h2, CAST('0x' || x[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || x[25:32] AS BIGINT) % 100 AS h4 FROM x),
    c AS (SELECT doc_id, t, n, least(h1, h2) AS a, greatest(h1, h2) AS b, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
    s AS (SELECT *, substr(t, 1, a) AS pre, substr(t, a + 1, b - a) AS mid, substr(t, b + 1) AS suf FROM c)
    SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars, sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM s""",
}
