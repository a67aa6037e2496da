"""Registered queries of this package: each binds an operator to its table and returns the digest of its contract."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hirelake.llm import (
    bpe, linededup, merkle, packing, periodic, pii, quality, qualityclassifier, secrets, simhash, spelling, toxicity, urls,
)
from hirelake.llm.common import table

QUERIES: dict[str, tuple] = {}


def query(sql: str | None = None):
    def register(function):
        QUERIES[function.__name__] = (function, sql)
        return function
    return register


def tokenizer_file(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query()
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data_documents(table(spark, sf_dir, "documents"))


@query()
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.token_digests(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query()
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_documents(table(spark, sf_dir, "documents"))


@query()
def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query()
def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_documents(table(spark, sf_dir, "documents"))


@query()
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup_documents(table(spark, sf_dir, "documents"))


# The counts of the contract and the rules' verdict, from words and lines taken apart one by one.
_SPACE = r"[ \t\n\x0B\f\r]+"
_STOP = ", ".join(f"'{w}'" for w in sorted(set().union(*quality.STOP_WORDS.values())))


def _verdict_sql(rules=quality.RULES) -> str:
    broken = []
    for rule in rules:
        sides = ([f"{rule.measure} < {rule.least}"] if rule.least is not None else []) + ([f"{rule.measure} > {rule.most}"] if rule.most is not None else [])
        broken.append(f"CASE WHEN ({' OR '.join(sides)}) AND n_words >= {rule.from_words} THEN '{rule.name}' END")
    return f"list_filter([{', '.join(broken)}], lambda x: x IS NOT NULL)"


QUALITY_SQL = rf"""
WITH parted AS (
  SELECT doc_id, coalesce(text, '') AS text, list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}'), lambda x: x <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^ \t\n\x0B\f\r]')) AS lines
  FROM documents),
placed AS (
  SELECT doc_id, i, words[i:i+4] AS five, count(*) OVER (PARTITION BY doc_id, words[i:i+4]) AS times
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 3)) AS i FROM parted WHERE len(words) >= 5)),
covered AS (
  SELECT doc_id, sum(least(5, i - before)) AS n
  FROM (SELECT doc_id, i, lag(i, 1, -5) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM placed WHERE times > 1) GROUP BY doc_id),
counted AS (
  SELECT p.doc_id, len(words) AS n_words, coalesce(list_sum(list_transform(words, lambda w: length(w))), 0)::BIGINT AS word_chars,
    (length(text) - length(translate(text, '#*$%&|<>', '')))::BIGINT AS n_symbols, len(lines) AS n_lines,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
    len(list_filter(words, lambda w: lower(w) IN ({_STOP}))) AS n_stop, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals
  FROM parted p LEFT JOIN covered c ON p.doc_id = c.doc_id),
measured AS (
  SELECT *, word_chars / nullif(n_words, 0) AS mean_word_chars, n_symbols / nullif(n_words, 0) AS symbol_ratio, n_stop / nullif(n_words, 0) AS stop_ratio,
    n_dup_lines / nullif(n_lines, 0) AS dup_line_ratio, n_repeat_words / nullif(n_words, 0) AS repeat_ratio, n_capitals / nullif(word_chars, 0) AS capital_ratio,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed
  FROM counted)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND len({_verdict_sql()}) = 0 AS kept, array_to_string({_verdict_sql()}, ',') AS failed
FROM measured
"""


@query(QUALITY_SQL)
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    return quality.quality_documents(table(spark, sf_dir, "documents")).withColumn("failed", F.array_join("failed", ","))


@query()
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_documents(table(spark, sf_dir, "documents"))


@query()
def op10_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(table(spark, sf_dir, "pages"))


@query()
def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qualityclassifier.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query()
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variant_groups(table(spark, sf_dir, "documents"))


@query()
def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digests(table(spark, sf_dir, "documents"))
