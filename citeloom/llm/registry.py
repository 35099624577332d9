"""Queries of the training-data operators: thin calls with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.mixing import mix_sources

    return mix_sources(table(spark, sf_dir, "documents"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.labelled import held_out
    from citeloom.llm.ppm import score_documents

    out = held_out("doc_id", 7, 2)
    scored = score_documents(table(spark, sf_dir, "documents"), train=~out)
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.quality import score_quality

    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.simhash import hex_fingerprint, near_duplicates

    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", hex_fingerprint().alias("fingerprint"), "component_id")


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.rules import judge_with_statistics

    return judge_with_statistics(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.toxicity import score_toxicity

    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.urls import judge_urls

    return judge_urls(table(spark, sf_dir, "pages"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.licences import scan_licences

    return scan_licences(table(spark, sf_dir, "documents"))


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.repeats import remove_repeats

    return remove_repeats(table(spark, sf_dir, "documents"))


def op12_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.alignment import align_documents

    return align_documents(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    from citeloom.llm.resampling import resample

    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    named = (op1_best_fit_packing, op2_mixing, op3_lm_scoring, op4_quality_classifier, op5_simhash_near_dedup, op6_quality_rules, op7_toxicity, op8_exact_top_k, op9_url_filter, op10_license_scan, op11_suffix_array_dedup, op12_cross_tokenizer_alignment, op13_importance_resampling)
    return {f.__name__: f for f in named}


def oracle_sql() -> dict[str, str]:
    from citeloom.llm.repeats import REPEATS_SQL
    from citeloom.llm.resampling import RESAMPLING_SQL
    from citeloom.llm.rules import RULES_SQL
    from citeloom.llm.topk import TOP_K_SQL

    return {"op6_quality_rules": RULES_SQL, "op8_exact_top_k": TOP_K_SQL, "op11_suffix_array_dedup": REPEATS_SQL, "op13_importance_resampling": RESAMPLING_SQL}
