"""The operators over their whole tables, by name, and SQL forms where SQL can say the same."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from netstate.llm import (bpe, decontamination, divergence, fingerprints, languages, lines, neardups, packing, phrases, substrings,
                          suffixes, toxicity, urls)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_bpe(spark, sf_dir):
    return bpe.round_trip_digest(table(spark, sf_dir, "documents"), vocabulary())


def op2_url_filters(spark, sf_dir):
    return urls.filtered_urls(table(spark, sf_dir, "pages"))


def op7_decontamination(spark, sf_dir):
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark, sf_dir):
    return lines.line_digest(table(spark, sf_dir, "documents"))


def op3_substring_dedup(spark, sf_dir):
    return substrings.substring_digest(table(spark, sf_dir, "documents"))


def op4_language_id(spark, sf_dir):
    return languages.language_digest(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity.toxicity_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_minhash_near_dedup(spark, sf_dir):
    return neardups.near_digest(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark, sf_dir):
    return fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op10_suffix_dedup(spark, sf_dir):
    return suffixes.suffix_digest(table(spark, sf_dir, "documents"))


def op11_best_fit_packing(spark, sf_dir):
    return packing.packing_digest(table(spark, sf_dir, "documents"), vocabulary())


def op12_source_divergence(spark, sf_dir):
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op13_phrase_mining(spark, sf_dir):
    return phrases.collocations(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_bpe, op2_url_filters, op3_substring_dedup, op4_language_id, op5_minhash_near_dedup,
                                    op6_toxicity, op7_decontamination, op8_fingerprints, op9_line_dedup, op10_suffix_dedup,
                                    op11_best_fit_packing, op12_source_divergence, op13_phrase_mining)}
ORACLES: dict[str, str] = {"op2_url_filters": urls.SQL, "op12_source_divergence": divergence.SQL,
                           "op13_phrase_mining": phrases.SQL}
