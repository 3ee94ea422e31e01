"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadspark.llm import byte_bpe, decontamination, hard_negatives, language_id, line_templates, main_text, near_duplicates, prefix_trie, secret_scan, source_mix, token_files, url_filter, vector_links
from roadspark.llm.common import table


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kinds = F.array_join(F.transform("base", lambda s: s["kind"]), ",")
    counts = [F.regexp_count(kinds, F.lit(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")]
    return found.select("doc_id", *counts, F.sha2(secret_scan.listed("base"), 256).alias("base_sha256"), secret_scan.listed("spans").alias("spans"))


def op2_vector_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_links.links(table(spark, sf_dir, "embeddings"))


def op3_line_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_templates.drop_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


#: The same in DuckDB SQL, with templates as texts instead of hashes.
OP3_SQL = """
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
raw AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS i FROM docs),
masked AS (SELECT doc_id, text, line, i, trim(regexp_replace(' ' || lower(line), '([ ])[^\\s0-9]*[0-9][^\\s]*', '\\1<*>', 'g'), ' ') AS m FROM raw),
sketch AS (SELECT doc_id, text, list_sort(list(DISTINCT md5(m)))[1:3] AS least FROM masked WHERE m <> '' GROUP BY doc_id, text),
placed AS (
  SELECT doc_id, text, i, m, substring(md5(array_to_string(list_filter(least, lambda x: x <> md5(m))[1:2], ' ')), 1, 15) AS kind, string_split(m, ' ') AS t
  FROM masked JOIN sketch USING (doc_id, text) WHERE m <> ''
),
wholes AS (
  SELECT m FROM (SELECT m, text, min(kind) AS kind FROM placed GROUP BY m, text) GROUP BY m
  HAVING count(*) >= 5 AND count(DISTINCT kind) >= 5 AND count(DISTINCT kind) >= 0.5 * count(*)
),
leaved AS (SELECT *, len(t) || ' ' || t[1] || ' ' || t[2] AS leaf FROM placed WHERE len(t) >= 4),
leaves AS (SELECT leaf FROM (SELECT leaf, text, min(kind) AS kind FROM leaved GROUP BY leaf, text) GROUP BY leaf HAVING count(DISTINCT kind) >= 5),
spread AS (SELECT doc_id, text, i, leaf, kind, unnest(t) AS token, generate_subscripts(t, 1) AS p FROM leaved WHERE leaf IN (SELECT leaf FROM leaves) AND m NOT IN (SELECT m FROM wholes)),
fixed AS (SELECT leaf, p, token FROM spread WHERE p > 2 GROUP BY leaf, p, token HAVING count(DISTINCT kind) >= 5),
made AS (
  SELECT doc_id, text, i, kind, leaf || ' ' || string_agg(CASE WHEN p <= 2 OR f THEN token ELSE '<*> ' END, ' ' ORDER BY p) AS template,
    count(*) AS n, count(*) FILTER (p <= 2 OR f) AS n_fixed
  FROM (SELECT s.*, x.token IS NOT NULL AS f FROM spread s LEFT JOIN fixed x ON s.leaf = x.leaf AND s.p = x.p AND s.token = x.token)
  GROUP BY doc_id, text, i, kind, leaf HAVING n_fixed >= 3 AND n_fixed >= 0.5 * n
),
again AS (
  SELECT template FROM (SELECT template, text, min(kind) AS kind FROM made GROUP BY template, text) GROUP BY template
  HAVING count(*) >= 5 AND count(DISTINCT kind) >= 5 AND count(DISTINCT kind) >= 0.5 * count(*)
),
gone AS (
  SELECT DISTINCT doc_id, text, i FROM placed WHERE m IN (SELECT m FROM wholes)
  UNION SELECT DISTINCT doc_id, text, i FROM made WHERE template IN (SELECT template FROM again)
)
SELECT r.doc_id, count(*) AS n_lines, count(g.i) AS n_dropped,
  sha256(coalesce(string_agg(r.line, chr(10) ORDER BY r.i) FILTER (g.i IS NULL), '')) AS text_sha256
FROM raw r LEFT JOIN gone g USING (doc_id, text, i) GROUP BY r.doc_id
"""


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    profiles = language_id.learn(docs.where(~language_id.held_out()), key=F.col("doc_id"))
    judged = docs.select("doc_id", language_id.held_out().alias("held_out"), "text")
    return language_id.predict(judged, profiles).drop("text")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    return decontamination.contaminated(docs, items).select(F.col("k_id").alias("doc_id"), "item_id", F.round("score", 6).alias("score"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path, pattern).drop("text")
    decoded = byte_bpe.decode(encoded, path, pattern)
    return decoded.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_files.token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates.classes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("k_id").alias("doc_id"), "class_id", "kept")


def op9_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


#: The rules of the query.
RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_filter.judge(table(spark, sf_dir, "pages").select("page_id", "url"), RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", "by_method")


def op11_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = source_mix.taken(table(spark, sf_dir, "documents").select("doc_id", "source", "text"), weights=(5, 2, 1), share=1.5, most=2.0)
    return mixed.drop("source")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label")
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label, "embedding")
    return hard_negatives.mine(vectors, anchor=F.col("vec_id") % 100 == 0, positives=5, negatives=5, low=80, high=100)


#: The same in DuckDB SQL: anchors against all rows.
OP12_SQL = """
WITH v AS (
  SELECT vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
a AS (SELECT * FROM v WHERE vec_id % 100 = 0),
p AS (
  SELECT a.vec_id AS anchor_id, a.label, a.v, v.vec_id AS positive_id, CAST(list_sum(list_transform(list_zip(a.v, v.v), lambda z: z[1] * z[2])) AS BIGINT) AS positive_score
  FROM a JOIN v ON a.label = v.label AND a.vec_id <> v.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY positive_score DESC, v.vec_id) <= 5
),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS negative_id, CAST(list_sum(list_transform(list_zip(a.v, v.v), lambda z: z[1] * z[2])) AS BIGINT) AS negative_score
  FROM a JOIN v ON a.label <> v.label
)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INTEGER) AS rank, negative_id, positive_score, negative_score
FROM p JOIN s USING (anchor_id) WHERE 80 * positive_score <= 100 * negative_score AND 100 * negative_score <= 100 * positive_score
QUALIFY rank <= 5
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.trie(table(spark, sf_dir, "conversations"))


#: The same in DuckDB SQL: prefixes as lists of digests; CRC-32 is folded over the bits of the decimal digits.
OP13_SQL = """
WITH o AS (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS n
  FROM conversations WHERE conv_id IS NOT NULL
),
ids AS (
  SELECT c, c - c % 5 AS base, own, xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split(CAST(c AS VARCHAR), ''), lambda d: [CAST(ascii(d) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, b: xor(xor(a, b) >> 1, 3988292384 * (xor(a, b) & 1))), 4294967295) % 9 AS h
  FROM (SELECT c, count(*) AS own FROM o GROUP BY c)
),
r AS (
  SELECT ids.c, 0 AS part, o.n, o.role, o.text FROM ids JOIN o ON o.c = ids.base WHERE o.n < ids.h
  UNION ALL SELECT ids.c, 1, o.n, o.role, o.text FROM ids JOIN o ON o.c = ids.c WHERE o.n >= ids.h
),
t AS (SELECT c, row_number() OVER w AS depth, sha256(concat(length(role), ':', role, text)) AS digest, strlen(text) AS n_bytes FROM r WINDOW w AS (PARTITION BY c ORDER BY part, n)),
p AS (
  SELECT c, depth, n_bytes, sha256(string_agg(digest, ' ') OVER w) AS k, count(*) OVER (PARTITION BY c) AS len FROM t WINDOW w AS (PARTITION BY c ORDER BY depth)
  UNION ALL SELECT ids.c, 0, 0, '', (SELECT count(*) FROM t WHERE t.c = ids.c) FROM ids
),
nodes AS (
  SELECT k, min(c) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs, any_value(n_bytes) AS n_bytes,
    sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (depth = len), '')) AS ends_sha256
  FROM p GROUP BY k
),
up AS (SELECT nodes.k, p.k AS above, p.depth = nodes.depth - 1 AS direct FROM nodes JOIN p ON p.c = nodes.conv_id AND p.depth <= nodes.depth),
kids AS (SELECT above, count(*) AS n_children FROM up WHERE direct GROUP BY above),
sums AS (
  SELECT up.above, CAST(sum((n_convs - 1) * n_bytes) AS BIGINT) AS saved_tokens, count(*) FILTER (n_children IS NULL) AS n_leaves
  FROM up JOIN nodes USING (k) LEFT JOIN kids ON kids.above = up.k GROUP BY up.above
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(kids.n_children, 0) AS n_children, CAST(s.n_leaves AS BIGINT) AS n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.above = n.k
LEFT JOIN kids ON kids.above = n.k LEFT JOIN up ON up.k = n.k AND up.direct LEFT JOIN nodes m ON m.k = up.above
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secret_scan": op1_secret_scan,
        "op2_vector_links": op2_vector_links,
        "op3_line_templates": op3_line_templates,
        "op4_language_id": op4_language_id,
        "op5_decontamination": op5_decontamination,
        "op6_byte_bpe": op6_byte_bpe,
        "op7_token_files": op7_token_files,
        "op8_near_duplicates": op8_near_duplicates,
        "op9_main_text": op9_main_text,
        "op10_url_filter": op10_url_filter,
        "op11_source_mix": op11_source_mix,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_prefix_trie": op13_prefix_trie,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_line_templates": OP3_SQL, "op12_hard_negatives": OP12_SQL, "op13_prefix_trie": OP13_SQL}
