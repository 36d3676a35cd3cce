"""The registered queries of this subpackage: thin wrappers that return each contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provspark.llm import classifier, decontamination, language_id, line_dedup, mixing, near_dup, quality_rules, substring_dedup, tokens, url_filter
from provspark.llm.common import table

# The rules of the contract, and the hosts of the block list.
URL_RULES = [
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
]
BLOCK_HOSTS = [f"{name}.example.{top}" for name in ("spam-farm", "cheap-pills") for top in ("com", "net", "org")]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES, BLOCK_HOSTS)


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_substrings(table(spark, sf_dir, "documents"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.sha2(F.array_join(F.sort_array("items"), ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", items.alias("items_sha256"), "contaminated")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classifier.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    left = line_dedup.remove_repeated_lines(docs)
    lines = F.filter(F.split("text", "\n", -1), lambda x: x.rlike(r"[^ \x09-\x0D]"))
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long") + F.col("__n_removed")
    return left.select("doc_id", n_lines.alias("n_lines"), F.col("__n_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_languages(table(spark, sf_dir, "documents"))


def _url_oracle() -> str:
    rules = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in URL_RULES)
    hosts = ", ".join(f"('{h}')" for h in BLOCK_HOSTS)
    return f"""
WITH r(verdict, rh, rp) AS (VALUES {rules}), b(bh) AS (VALUES {hosts}),
u AS (SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS t FROM pages),
h AS (SELECT page_id, translate(regexp_extract(t, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(t, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
m AS (SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS v
    FROM h JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
l AS (SELECT DISTINCT page_id FROM h JOIN b ON host = bh OR ends_with(host, '.' || bh))
SELECT h.page_id, host, path, rule, CASE WHEN v IS NOT NULL THEN v WHEN l.page_id IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM h LEFT JOIN m ON m.page_id = h.page_id LEFT JOIN l ON l.page_id = h.page_id
"""


QUERIES = {
    "op1_mix_sources": op1_mix_sources,
    "op2_token_counts": op2_token_counts,
    "op3_quality_rules": op3_quality_rules,
    "op4_url_filter": op4_url_filter,
    "op5_substring_dedup": op5_substring_dedup,
    "op6_decontaminate": op6_decontaminate,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_line_dedup": op8_line_dedup,
    "op9_simhash": op9_simhash,
    "op10_language_id": op10_language_id,
}
ORACLES = {
    "op1_mix_sources": mixing.ORACLE,
    "op4_url_filter": _url_oracle(),
    "op6_decontaminate": decontamination.ORACLE,
    "op8_line_dedup": line_dedup.ORACLE,
}
