"""The corpus queries and, where SQL can state them, their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, hmm_lm, line_dedup, mixing, quality_classifier, quality_rules, secret_scan, simhash, topk_search, warc
from .common import table

#: Name of the tokenizer file that the queries use.
TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), tally=True)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.page_records(table(spark, sf_dir, "pages"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    book = quality_rules.ledger(table(spark, sf_dir, "documents"))
    return book.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (~quality_rules.passes("base")).alias("base_failed"), quality_rules.passes().alias("kept"), "failures",
    )


def quality_rule_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of the current policy costs, from the ledger alone."""
    return quality_rules.ablations(quality_rules.ledger(table(spark, sf_dir, "documents")))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm_lm.score(table(spark, sf_dir, "documents"))


def op8_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_search.top_k(table(spark, sf_dir, "embeddings"))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scan(table(spark, sf_dir, "documents"), secret_scan.dictionary(tokenizer_path()))
    return found.select("doc_id", "start", "length", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret")


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mixing, op2_line_dedup, op3_warc, op4_bpe, op5_quality_rules, op6_quality_classifier, op7_hmm_lm, op8_topk_search, op9_secret_scan, op10_simhash, quality_rule_ablations)}


#: The ledger of the quality rules in SQL.
LEDGER = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT u, i, count(*) OVER (PARTITION BY u, w[i], w[i + 1], w[i + 2]) AS n FROM (SELECT u, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
rep AS (SELECT u, count(DISTINCT p) AS n FROM (SELECT u, unnest([i, i + 1, i + 2]) AS p FROM win WHERE n > 1) GROUP BY u),
lin AS (SELECT u, count(*) - count(DISTINCT l) AS n, count(*) AS m FROM (SELECT u, unnest(string_split(t, chr(10))) AS l FROM d) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY u),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    coalesce(lin.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lin.m, 0) AS n_lines
  FROM d LEFT JOIN rep USING (u) LEFT JOIN lin USING (u)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
  + CASE WHEN word_chars < 2 * n_words OR word_chars > 14 * n_words THEN 8 ELSE 0 END + CASE WHEN 2 * n_dup_lines > n_lines THEN 16 ELSE 0 END)::BIGINT AS failures FROM m)
"""

ORACLES = {
    "op1_mixing": r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
k AS (
  SELECT doc_id, source, size,
    -ln((('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(t)), 1, 12))::BIGINT + 0.5) / 281474976710656.0)
      / (1.0 / (1.0 + len(regexp_extract_all(t, '[#*$%&|<>]')) / greatest(size, 1)::DOUBLE)) AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM k GROUP BY source),
c AS (SELECT source, source_size, (r - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM s),
v AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER () - coalesce(sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM c),
t AS (
  SELECT source, source_size, CASE WHEN cap / w < lv THEN cap::DOUBLE ELSE least(cap::DOUBLE, lv * w) END AS target
  FROM v, (SELECT max(level) AS lv FROM v WHERE level <= cap / w)),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
p AS (
  SELECT doc_id, size, source_size, target, epochs,
    sum(size) OVER (PARTITION BY k.source ORDER BY key) - sum(size) OVER (PARTITION BY k.source, key) / 2 <= target - epochs * source_size AS chosen
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN size * (epochs + chosen::INT) ELSE 0 END)::BIGINT AS taken FROM p
""",
    "op2_line_dedup": r"""
WITH d AS (SELECT doc_id, text, row_number() OVER (ORDER BY doc_id NULLS LAST, text) AS u, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT u, unnest(ls) AS line, unnest(range(0, len(ls))) AS pos FROM d),
c AS (SELECT *, sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) OVER (PARTITION BY u ORDER BY pos) AS upto, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS w FROM l),
f AS (SELECT a.u, a.pos AS s, min(b.pos) AS e FROM c a JOIN c b ON a.u = b.u AND b.upto >= a.upto - a.w + 50 GROUP BY ALL),
b AS (SELECT a.u, max(b.pos) AS s, a.pos AS e FROM c a JOIN c b ON a.u = b.u AND b.upto - b.w <= a.upto - 50 GROUP BY a.u, a.pos),
x AS (SELECT DISTINCT u, s, e FROM (SELECT * FROM f UNION ALL SELECT u, s, e FROM b)),
r AS (SELECT x.*, d.ls[s + 1:e + 1] AS run FROM x JOIN d USING (u)),
g AS (SELECT u, s, e, row_number() OVER (PARTITION BY run ORDER BY u, s) AS nth FROM r),
gone AS (SELECT DISTINCT u, unnest(range(s, e + 1)) AS pos FROM g WHERE nth > 1),
kept AS (SELECT l.u, string_agg(l.line, chr(10) ORDER BY l.pos) AS text, count(*) AS n FROM l ANTI JOIN gone USING (u, pos) GROUP BY l.u)
SELECT doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text, coalesce(len(ls), 0)::BIGINT AS n_lines,
  (coalesce(len(ls), 0) - coalesce(n, 0))::BIGINT AS n_removed
FROM d LEFT JOIN kept USING (u)
""",
    "op3_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, ''))::BIGINT AS n FROM pages),
q AS (SELECT page_id, n, sha256(h) AS digest, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS f FROM p)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f = page_id THEN NULL ELSE f END::BIGINT AS refers_to FROM q
""",
    "op5_quality_rules": LEDGER + r"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, failures & 3 <> 0 AS base_failed, failures = 0 AS kept, failures FROM b
""",
    "quality_rule_ablations": LEDGER + r""", r AS (SELECT unnest(['few_words', 'repeated_windows', 'symbols', 'word_length', 'repeated_lines']) AS rule, unnest([1, 2, 4, 8, 16]) AS bit)
SELECT rule, count(*) AS n_docs, count(*) FILTER (WHERE failures & bit <> 0) AS n_failed, count(*) FILTER (WHERE failures = bit) AS n_only, count(*) FILTER (WHERE failures IN (0, bit)) AS n_kept_without
FROM b, r GROUP BY rule
""",
    "op8_topk_search": r"""
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
""",
}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
