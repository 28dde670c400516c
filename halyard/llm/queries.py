"""The training-data operators as registered queries, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from halyard.llm import credentials, host_rules, mixing, near_dup, packing, quality_gbt, search, surrogates, token_counts, token_files


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer(name: str) -> str:
    """Where a public tokenizer's file is on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", mixing.word_count().alias("size"))
    return mixing.mix(docs)


def op2_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogates.replaced(documents(spark, sf_dir), key=surrogates.DEMO_KEY)


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(documents(spark, sf_dir))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return credentials.scanned(documents(spark, sf_dir))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.judged(documents(spark, sf_dir))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_gbt.scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counted(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op8_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return search.top_k(docs, docs.where("doc_id % 50 = 0"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_surrogates": op2_surrogates,
    "op3_near_duplicates": op3_near_duplicates,
    "op4_secrets": op4_secrets,
    "op5_host_rules": op5_host_rules,
    "op6_quality": op6_quality,
    "op7_token_counts": op7_token_counts,
    "op8_search": op8_search,
    "op9_token_files": op9_token_files,
    "op10_packing": op10_packing,
}

HOST_RULES_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '[^\x20\x09-\x0D]')] AS ls FROM d),
tri AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM tri) WHERE c > 1),
rep AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid),
f AS (
  SELECT w.rid, doc_id, source, len(ws)::BIGINT AS n_words,
    (length(t) - len(regexp_extract_all(t, '[\x20\x09-\x0D]')))::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(ls) AS n_lines,
    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.rid = rep.rid),
b AS (
  SELECT *, n_words < 50 AS short, 100 * n_repeat_words > 50 * n_words AS repeats, 100 * n_symbols > 10 * n_words AS symbols,
    100 * n_dup_lines > 30 * n_lines AS lines FROM f),
h AS (
  SELECT source, unnest(['short', 'repeats', 'symbols', 'lines']) AS rule, n, unnest([a, b, c, d]) AS failed
  FROM (SELECT source, count(*) AS n, sum(short::INT) AS a, sum(repeats::INT) AS b, sum(symbols::INT) AS c, sum(lines::INT) AS d FROM b GROUP BY source)),
m AS (SELECT rule, (sum(failed) + 0.5) / (sum(n) + 1) AS mean, coalesce(var_samp(failed / n), 0) AS v, avg(1 / n) AS inv FROM h GROUP BY rule),
s AS (SELECT rule, mean, least(greatest(CASE WHEN v - mean * (1 - mean) * inv > 1e-9 THEN mean * (1 - mean) / (v - mean * (1 - mean) * inv) - 1 ELSE 1e4 END, 10), 1e4) AS strength FROM m),
r AS (SELECT source, h.rule, mean, (failed + mean * strength) / (n + strength) AS rate, n + strength AS weight FROM h JOIN s ON h.rule = s.rule),
v AS (
  SELECT source, bool_or(rate - 2 * sqrt(rate * (1 - rate) / (weight + 1)) > least(greatest(3 * mean, 0.25), 0.9)) AS host_rejected,
    round(max(rate) FILTER (rule = 'short'), 9) AS rate_short, round(max(rate) FILTER (rule = 'repeats'), 9) AS rate_repeats,
    round(max(rate) FILTER (rule = 'symbols'), 9) AS rate_symbols, round(max(rate) FILTER (rule = 'lines'), 9) AS rate_lines
  FROM r GROUP BY source)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, short OR repeats AS base_failed,
  NOT (short OR repeats) AND NOT host_rejected AS kept, host_rejected, rate_short, rate_repeats, rate_symbols, rate_lines
FROM b JOIN v ON b.source IS NOT DISTINCT FROM v.source
"""

WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
NEAR_DUPLICATES_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
p AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, least(len(ws), 1)) + 1)) AS i FROM d),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS s FROM p),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM c JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS y FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(y, d.doc_id)) AS component_id, d.doc_id <= coalesce(y, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN m ON d.doc_id = m.x
"""

SEARCH_SQL = f"""
WITH w AS (SELECT doc_id, unnest({WORDS}) AS t FROM documents),
f AS (SELECT doc_id, t, count(*) AS c FROM w GROUP BY ALL),
l AS (SELECT doc_id, sum(c) AS n FROM f GROUP BY doc_id),
a AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT sum(n) FROM l) / (SELECT count(*) FROM documents) AS mean),
i AS (SELECT t, ln(1 + (a.n - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM f, a GROUP BY t, a.n),
s AS (
  SELECT q.doc_id AS query_id, f.doc_id, round(sum(q.c * idf * f.c * 2.2 / (f.c + 1.2 * (0.25 + 0.75 * l.n / mean))), 6) AS score
  FROM f q JOIN i ON q.t = i.t JOIN f ON f.t = q.t JOIN l ON f.doc_id = l.doc_id, a WHERE q.doc_id % 50 = 0 GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM s)
SELECT query_id, rank, doc_id, score FROM o WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op3_near_duplicates": NEAR_DUPLICATES_SQL, "op5_host_rules": HOST_RULES_SQL, "op8_search": SEARCH_SQL}
