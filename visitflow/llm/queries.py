"""The operators of this subpackage as named queries on the given tables, and their SQL twins where SQL has one."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

from visitflow.llm import context_mixing, decontaminate, importance_resampling, language_id, lattice, packing, simhash
from visitflow.llm import substring_dedup, suffix_dedup, token_counts, toxicity, url_filter, whitening
from visitflow.llm.common import held_out

RULES = (
    url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"),
    url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("org", "/fr/", "allow"),
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def tokenizer_bytes(name: str) -> bytes:
    import public_tokenizers

    return Path(public_tokenizers.path(name)).read_bytes()


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    outcomes = table(spark, folder, "labels").selectExpr("doc_id as page_id", "quality as outcome")
    return url_filter.judge_urls(table(spark, folder, "pages"), outcomes, RULES)


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = language_id.identify(docs, language_id.fit(docs))
    return found.select("doc_id", held_out(found.doc_id).alias("held_out"), "lang_pred", "score")


def op3_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.token_counts(table(spark, folder, "documents"), tokenizer_bytes("piece_bpe_32k.model"))


def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"), shingle=3)


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    return toxicity.score_texts(docs, toxicity.fit(docs, table(spark, folder, "labels")))


def op6_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, folder, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (found.n_removed > 0).alias("has_repeat"))


def op7_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return substring_dedup.near_passages(table(spark, folder, "documents"))


def op8_lattice(spark: SparkSession, folder: str) -> DataFrame:
    return lattice.near_vectors(table(spark, folder, "embeddings"))


def op9_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontaminate.tile_documents(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack_documents(
        table(spark, folder, "documents"), tokenizer_bytes("word_bpe_49k.json"), end_id=2)


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    return whitening.whiten(table(spark, folder, "embeddings"))


def op12_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return context_mixing.score_texts(table(spark, folder, "documents"))


def op13_importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return importance_resampling.resample(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (
        op1_url_filter, op2_language_id, op3_token_counts, op4_simhash, op5_toxicity, op6_suffix_dedup,
        op7_substring_dedup, op8_lattice, op9_decontamination, op10_packing, op11_whitening, op12_lm_scoring,
        op13_importance_resampling)
}

OP1_SQL = r"""
WITH parts AS (
    SELECT page_id,
        translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path
    FROM pages),
seen AS (
    SELECT doc_id AS page_id, count(*) AS n, sum(quality) AS k FROM labels WHERE quality IN (0, 1) GROUP BY 1),
hosts AS (
    SELECT host, coalesce(sum(n), 0)::DOUBLE AS n, coalesce(sum(k), 0)::DOUBLE AS k,
        regexp_extract(host, '(?:^|\.)((?:co|com|org|net|gov|ac|edu)\.[a-z][a-z]|[^.]+)$', 1) AS suffix,
        CASE WHEN regexp_extract(host, '(?:^|\.)([^.]+\.(?:(?:co|com|org|net|gov|ac|edu)\.[a-z][a-z]|[^.]+))$', 1) = ''
            THEN host ELSE
            regexp_extract(host, '(?:^|\.)([^.]+\.(?:(?:co|com|org|net|gov|ac|edu)\.[a-z][a-z]|[^.]+))$', 1) END AS domain
    FROM parts LEFT JOIN seen USING (page_id) GROUP BY host),
domains AS (SELECT suffix, domain, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
suffixes AS (SELECT suffix, sum(n) AS n, sum(k) AS k FROM hosts GROUP BY ALL),
overall AS (SELECT CASE WHEN sum(n) > 0 THEN sum(k) / sum(n) END AS p FROM hosts),
steps AS (
    SELECT 1 AS step, s.n, s.k, p FROM suffixes s, overall
    UNION ALL SELECT 2, d.n, d.k, s.k / s.n FROM domains d JOIN suffixes s USING (suffix) WHERE d.n > 0
    UNION ALL SELECT 3, h.n, h.k, d.k / d.n FROM hosts h JOIN domains d USING (suffix, domain) WHERE h.n > 0),
weights AS (
    SELECT step, 1 / CASE WHEN sum(p * (1 - p) * (n - 1)) > 0 THEN
        least(greatest(sum(n * (k / n - p) ** 2 - p * (1 - p)) / sum(p * (1 - p) * (n - 1)), 0.001), 0.999)
        ELSE 0.5 END - 1 AS w
    FROM steps WHERE n > 0 GROUP BY step),
w AS (
    SELECT max(w) FILTER (step = 1) AS ws, max(w) FILTER (step = 2) AS wd, max(w) FILTER (step = 3) AS wh FROM weights),
by_suffix AS (SELECT suffix, (k + ws * p) / (n + ws) AS m FROM suffixes, overall, w),
by_domain AS (
    SELECT suffix, domain, (k + wd * m) / (n + wd) AS m FROM domains JOIN by_suffix USING (suffix), w),
judged AS (
    SELECT host, (k + wh * m) / (n + wh) AS good, n + wh AS size
    FROM hosts JOIN by_domain USING (suffix, domain), w),
verdicts AS (
    SELECT host, CASE WHEN good + 1.645 * sqrt(good * (1 - good) / (size + 1)) < 0.5 THEN 'block' ELSE 'allow' END AS v
    FROM judged),
ruled AS (
    SELECT *, CASE
        WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
        WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
        WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
        WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/' END AS rule
    FROM parts)
SELECT page_id, host, path, rule,
    CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE v END AS verdict
FROM ruled JOIN verdicts USING (host)
"""

# The CRC's table is built from its polynomial; a word's bytes are read from its hexadecimal digits.
OP13_SQL = r"""
WITH table256 AS (
    SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)
        ORDER BY i) AS t
    FROM range(256) r(i)),
runs AS (
    SELECT 'd' AS side, doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word
    FROM documents
    UNION ALL
    SELECT 'b', NULL, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'))
    FROM benchmark),
words AS (SELECT DISTINCT word, hex(encode(word)) AS digits FROM runs),
hashed AS (
    SELECT word, xor(list_reduce(
        list_transform(range(len(digits) // 2), lambda i: ('0x' || substr(digits, 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295), 4294967295) % 10000 AS bucket
    FROM words, table256),
counted AS (
    SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 'b') AS t
    FROM runs JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::DOUBLE AS all_s, coalesce(sum(t), 0)::DOUBLE AS all_t FROM counted),
gains AS (
    SELECT bucket, floor(1000 * ln((t + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
    FROM counted, totals),
weighed AS (
    SELECT doc_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM runs JOIN hashed USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY doc_id),
scored AS (
    SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln(
            (('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM documents d LEFT JOIN weighed w USING (doc_id)),
placed AS (
    SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n
    FROM scored WHERE n_features >= 20)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 10 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed USING (doc_id)
"""

ORACLES: dict[str, str] = {"op1_url_filter": OP1_SQL, "op13_importance_resampling": OP13_SQL}
