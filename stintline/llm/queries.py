"""The registered queries of this subpackage: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stintline.llm import decontaminate, divergence, htmltext, hyperplanes, language, linechunks, minhash, personal, pieces, quality, ranked, secretledger, urltree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.replace(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), percent=minhash.OP2_PERCENT)


def op3_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hyperplanes.near_vectors(_table(spark, sf_dir, "embeddings"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("items")


def op5_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linechunks.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = language.identify(docs, language.train(docs), keep=["doc_id"])
    return out.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


#: Where the public model file lies; a parameter of the operator.
MODEL = os.environ.get("SENTENCEPIECE_MODEL", "/opt/tokenizers/piece_bpe_32k.model")


def op7_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = htmltext.extract(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    out = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")), keep=["doc_id"])
    return out.select("doc_id", language.held_out("doc_id", 4, 2).alias("held_out"), "score", "predicted")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urltree.judge(_table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(_table(spark, sf_dir, "documents"), pieces.Pieces.load(MODEL), keep=["doc_id"])
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), F.xxhash64("ids").alias("ids_hash"), "round_trip")


def op11_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secretledger.scan(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_pii_surrogates, op2_minhash_near_dedup, op3_embedding_near_dedup, op4_benchmark_decontamination, op5_line_chunk_dedup, op6_language_id, op7_html_main_text, op8_quality, op9_sentencepiece, op10_url_filter, op11_secret_ledger, op12_source_divergence, op13_ranked_search)
}

_ASCII_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_COMPONENTS = """
reach(node, root) AS (
  SELECT u, u FROM link UNION SELECT l.v, r.root FROM reach r JOIN link l ON l.u = r.node),
component AS (SELECT node, min(root) AS root FROM reach GROUP BY node)
"""

def _spans_sql(kind: str, place: int, pattern: str, group: int = 0, least: int = 1) -> str:
    """Spans of a pattern: the pieces between its matches give their places."""
    p = pattern.replace("'", "''")
    return f"""
  SELECT rid, '{kind}' AS kind, {place} AS place, list_sum(list_transform(gap[:i], lambda x: length(x))) + coalesce(list_sum(list_transform(hit[:i - 1], lambda x: length(x))), 0) AS start, length(hit[i]) AS n
  FROM (SELECT rid, string_split_regex(text, '{p}') AS gap, regexp_extract_all(text, '{p}') AS hit, regexp_extract_all(text, '{p}', {group}) AS own, unnest(range(1, len(regexp_extract_all(text, '{p}')) + 1)) AS i FROM doc)
  WHERE length(own[i]) >= {least}"""


ORACLE_SQL: dict[str, str] = {
    "op2_minhash_near_dedup": rf"""
WITH RECURSIVE word AS (
  SELECT doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
shingle AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM word WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
pair AS (
  SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS common FROM shingle a JOIN shingle b ON a.s = b.s AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id),
link AS (
  SELECT u, v FROM pair JOIN size x ON x.doc_id = u JOIN size y ON y.doc_id = v
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
{_COMPONENTS}
SELECT doc_id, coalesce(n, 0) AS n_shingles, coalesce(root, doc_id) AS component_id, coalesce(root, doc_id) = doc_id AS kept
FROM documents LEFT JOIN size USING (doc_id) LEFT JOIN component ON node = doc_id
""",
    "op3_embedding_near_dedup": f"""
WITH RECURSIVE vec AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
link AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM vec a JOIN vec b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
{_COMPONENTS},
links AS (SELECT u, count(*) AS n FROM link GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, coalesce(root, vec_id) AS component_id, coalesce(root, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN links ON u = vec_id LEFT JOIN component ON node = vec_id
""",
    "op4_benchmark_decontamination": rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
gram AS (
  SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
found AS (SELECT DISTINCT rid, i, n, item_id FROM gram JOIN win USING (n, g)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM found) GROUP BY rid),
own AS (SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT rid, item_id FROM found) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN hit USING (rid) LEFT JOIN own USING (rid)
""",
    "op5_line_chunk_dedup": """
WITH doc AS (SELECT row_number() OVER () AS rid, md5(concat_ws('|', coalesce(CAST(doc_id AS VARCHAR), '-'), text)) AS k, doc_id, text FROM documents),
line AS (
  SELECT rid, k, doc_id, i, l, ('0x' || substr(md5(l), 1, 8))::BIGINT AS h
  FROM (SELECT rid, k, doc_id, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT rid, k, doc_id, string_split(text, chr(10)) AS ls FROM doc WHERE text IS NOT NULL))),
alone AS (SELECT *, length(l) >= 300 OR length(l) - length(replace(l, ' ', '')) >= 49 AS is_long FROM line),
flag AS (
  SELECT *, (h + coalesce(lag(h) OVER w, 0) * 31) % 3 = 0 OR is_long OR coalesce(lead(is_long) OVER w, false) AS is_end FROM alone WINDOW w AS (PARTITION BY rid ORDER BY i)),
piece AS (
  SELECT *, coalesce(sum(CAST(is_end AS INT)) OVER (PARTITION BY rid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM flag),
chunk AS (
  SELECT rid, k, doc_id, pos, count(*) AS n, bool_or(is_long) AS is_long, string_agg(l, chr(10) ORDER BY i) AS body FROM piece GROUP BY rid, k, doc_id, pos),
ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY body ORDER BY doc_id IS NULL, doc_id, k, pos) AS place FROM chunk WHERE (n >= 2 OR is_long) AND length(body) >= 40),
gone AS (SELECT rid, pos FROM ranked WHERE place > 1),
rest AS (
  SELECT c.rid, coalesce(string_agg(CASE WHEN g.rid IS NULL THEN body END, chr(10) ORDER BY c.pos), '') AS text,
    CAST(sum(n) AS BIGINT) AS n_lines, CAST(coalesce(sum(CASE WHEN g.rid IS NOT NULL THEN n END), 0) AS BIGINT) AS n_removed
  FROM chunk c LEFT JOIN gone g ON g.rid = c.rid AND g.pos = c.pos GROUP BY c.rid)
SELECT doc_id, rest.text, n_lines, coalesce(n_removed, 0) AS n_removed FROM doc LEFT JOIN rest USING (rid)
""",
    "op11_secret_ledger": f"""
WITH doc AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
span AS ({" UNION ALL ".join(_spans_sql(r.kind, i, r.pattern, r.group, r.least) for i, r in enumerate(secretledger.RULES))}),
named AS (SELECT rid, kind, place, start, concat(kind, ':', CAST(start AS BIGINT), ':', CAST(start + n AS BIGINT)) AS name FROM span),
own AS (
  SELECT rid, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(name, ',' ORDER BY start, place) FILTER (place < 3) AS base, string_agg(name, ',' ORDER BY start, place) AS spans FROM named GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM doc LEFT JOIN own USING (rid)
""",
    "op12_source_divergence": rf"""
WITH doc AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    unnest(list_append(regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+'), '')) AS term FROM documents),
grp AS (SELECT DISTINCT lang, source FROM doc),
kept AS (SELECT lang, term FROM doc WHERE term <> '' GROUP BY lang, term HAVING count(DISTINCT rid) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
cnt AS (SELECT lang, source, term, count(*) AS c FROM doc JOIN kept USING (lang, term) GROUP BY lang, source, term),
total AS (SELECT lang, term, sum(c) AS c FROM cnt GROUP BY lang, term),
gn AS (SELECT lang, source, sum(c) AS n FROM cnt GROUP BY lang, source),
ln AS (SELECT lang, sum(c) AS n FROM cnt GROUP BY lang),
p AS (
  SELECT lang, source, term, coalesce(c, 0) AS c, CAST(1 + (1000000000::HUGEINT * (coalesce(c, 0) + 2)) // (coalesce(n, 0) + 2 * v) AS BIGINT) AS p
  FROM grp JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN gn USING (lang, source) LEFT JOIN cnt USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + (1000000000::HUGEINT * (c + 2)) // (n + 2 * v) AS BIGINT) AS q FROM total JOIN ln USING (lang) JOIN v USING (lang)),
far AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
best AS (SELECT lang, source, 'term' AS part, term AS item, CAST((p - q) * (p - q) // (p + q) AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM best))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 10
""",
    "op13_ranked_search": rf"""
WITH word AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
size AS (SELECT CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_words FROM word WHERE len(w) > 0),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM (SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS term FROM word) GROUP BY rid, doc_id, n, term),
df AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM tf, size GROUP BY term, n_docs),
item AS (
  SELECT DISTINCT qid, item_id, term FROM (
    SELECT row_number() OVER () AS qid, item_id, unnest(regexp_extract_all({_ASCII_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)),
found AS (
  SELECT qid, item_id, rid, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_words)))) AS BIGINT) AS score
  FROM item JOIN df USING (term) JOIN tf USING (term), size GROUP BY qid, item_id, rid, doc_id),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id, rid) AS INT) AS rank FROM found WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 50
""",
}
