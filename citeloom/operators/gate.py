"""Evidence gate: whether what was retrieved suffices to answer."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import identifiers
from citeloom.operators.retrieval import document_key


@dataclass(frozen=True)
class GateConfig:
    enabled: bool = True
    minimum_dense: float = 0.82
    identifier_override: float = 0.75
    minimum_rerank: float | None = -1.0


def assess(questions: DataFrame, hits: DataFrame, reranked: DataFrame, config: GateConfig = GateConfig()) -> DataFrame:
    """One row per question (query_id, query): sufficient, reason and the signals behind it. Hits are those before capping."""
    title = F.coalesce(F.col("section_title"), F.lit(""))
    named = F.flatten(F.collect_set(identifiers(F.concat_ws("\n", title, F.col("text")))))
    signals = hits.groupBy("query_id").agg(
        F.max("score").alias("top_dense_score"),
        F.max(F.when(F.col("dense_rank_no") == 2, F.col("score"))).alias("_second"),
        F.countDistinct(document_key()).alias("source_count"),
        named.alias("_named"),
    )
    best = reranked.groupBy("query_id").agg(F.max("rerank_score").alias("top_rerank_score"))
    joined = questions.join(signals, "query_id", "left").join(best, "query_id", "left")
    match = F.coalesce(F.arrays_overlap(identifiers(F.col("query")), F.col("_named")), F.lit(False))
    top = F.col("top_dense_score")
    low = top < config.minimum_dense
    override = match & (top >= config.identifier_override)
    weak = F.lit(False) if config.minimum_rerank is None else F.coalesce(F.col("top_rerank_score") < config.minimum_rerank, F.lit(False))
    reason = (
        F.when(top.isNull(), "no_retrieved_evidence")
        .when(F.lit(not config.enabled), "gate_disabled")
        .when(low & ~override, "dense_score_below_experimental_threshold")
        .when(weak, "rerank_score_below_experimental_threshold")
        .when(low, "exact_identifier_override")
        .otherwise("sufficient")
    )
    return joined.select(
        *questions.columns,
        reason.isin("gate_disabled", "exact_identifier_override", "sufficient").alias("sufficient"),
        reason.alias("reason"),
        "top_dense_score",
        (top - F.col("_second")).alias("dense_margin"),
        "top_rerank_score",
        F.coalesce("source_count", F.lit(0)).alias("source_count"),
        match.alias("identifier_match"),
    )


def diagnostics() -> F.Column:
    """The gate's signals as one struct, with the retrieval strategy's name."""
    names = ("top_dense_score", "dense_margin", "top_rerank_score", "source_count", "identifier_match", "reason")
    return F.struct(F.lit("dense_plus_cross_encoder").alias("strategy"), *[F.col(n) for n in names])
