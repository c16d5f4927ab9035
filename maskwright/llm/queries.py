"""The operators as queries over the test tables, with DuckDB SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskwright.llm import decontaminate, licences, lm_score, near_duplicates, oracles, packing, quality_rules, repeated_strings, surrogates, url_trust, warc
from maskwright.llm.workspace import table

#: Fixed by the contract of op10: (verdict, host, path).
URL_RULES = [("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/")]

#: In production a secret of the deployment; fixed here so that a query gives the same rows each time.
PII_KEY = "maskwright"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op2_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_strings.remove_repeats(table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.join_components(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judge(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licences.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", F.array_join("identifiers", ",").alias("identifiers"), F.array_join("licences", ",").alias("licences"), (F.size("licences") > 0).alias("licensed"))


def op8_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_score.score(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", F.round("log_score", 4).alias("log_score"), F.round("mean_log_score", 6).alias("mean_log_score"))


def op9_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, _ = surrogates.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY, "n_entities")
    return changed.select("doc_id", "text", "n_entities")


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = url_trust.judge(table(spark, sf_dir, "pages"), url_trust.rule_table(spark, URL_RULES))
    return judged.select("page_id", "host", "path", "rule", "verdict")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_decontamination, op2_suffix_array_dedup, op3_ngram_jaccard_join, op4_quality_rules, op5_best_fit_packing, op6_warc, op7_licence_scan, op8_lm_scoring, op9_pii_surrogates, op10_url_filters)}
ORACLES: dict[str, str] = {"op1_decontamination": oracles.CONTAMINATION, "op2_suffix_array_dedup": oracles.REPEATED_STRINGS, "op3_ngram_jaccard_join": oracles.JACCARD_COMPONENTS, "op6_warc": oracles.WARC, "op8_lm_scoring": oracles.LM_SCORE, "op10_url_filters": oracles.URL_FILTERS}
