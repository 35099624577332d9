"""Filtered similarity search, per-document capping, reranking and evidence selection for batches of questions."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import all_of, first_filled
from citeloom.operators.index import shared_model

CAP_PER_DOCUMENT = 4
FILTER_KEYS = ("language", "document_type", "source", "document_id")
#: Questions up to this many are broadcast against the collection at once; more go in blocks of about this many.
BROADCAST_QUESTIONS = 10_000
#: What meets in one matrix product, and how many winners are broadcast to fetch what else they hold.
QUESTIONS_AT_ONCE, ROWS_AT_ONCE, BROADCAST_WINNERS = 256, 4096, 400_000


def metadata_filter(filters: dict[str, str | None] | None) -> Column:
    """Equality on the given keys; null and empty values ask for nothing."""
    wanted = {k: v for k, v in (filters or {}).items() if v not in (None, "")}
    unknown = set(wanted) - set(FILTER_KEYS)
    if unknown:
        raise ValueError(f"unknown filters: {sorted(unknown)}")
    return all_of([F.col(k) == F.lit(v) for k, v in sorted(wanted.items())])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def dense_topk(questions: DataFrame, collection: DataFrame, *, k: int = 20, filters: dict[str, str | None] | None = None, threshold: float | None = None, key: str = "chunk_id") -> DataFrame:
    """The k nearest chunks of each question (query_id, query_vector): adds score and dense_rank_no; ties by the key, which names one row of the collection.

    Both sides are scaled to unit length once. Only keys and vectors go to Python: blocks of them meet the questions as matrix products inside Arrow batches, and
    only rows that can be among a question's k best leave. The filter reaches the scan; the questions, which are few against the collection, are
    counted and broadcast; each task keeps k rows per question before the shuffle by question. What else a chunk holds is fetched at the end, for
    the winners alone. Vectors without a direction score null and come last.
    """
    blocks = -(-questions.count() // BROADCAST_QUESTIONS)
    if blocks > 1:
        block = F.pmod(F.xxhash64("query_id"), F.lit(2 * blocks))
        parts = [_topk_of_block(questions.where(block == b), collection, k, filters, threshold, key) for b in range(2 * blocks)]
        return reduce(DataFrame.union, parts)
    return _topk_of_block(questions, collection, k, filters, threshold, key)


def _topk_of_block(questions: DataFrame, collection: DataFrame, k: int, filters: dict[str, str | None] | None, threshold: float | None, key: str) -> DataFrame:
    kept = collection.where(metadata_filter(filters)) if filters else collection
    held = questions.toArrow()  # at most about BROADCAST_QUESTIONS rows
    asked = kept.sparkSession.sparkContext.broadcast((unit_rows(held.column("query_vector")), held.num_rows))
    numbered = questions.sparkSession.createDataFrame(held.append_column("_q", pa.array(range(held.num_rows), pa.int32())))
    least = -math.inf if threshold is None else threshold - 1e-9

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matrix, n = asked.value
        best = np.full((n, 0), 0.0)  # the k best scores that each question has met in this task
        for batch in batches:
            found = unit_rows(batch.column(1))
            for start in range(0, len(found), ROWS_AT_ONCE):
                some = found[start : start + ROWS_AT_ONCE]
                width = max(some.shape[1], matrix.shape[1])
                rows = np.pad(some, ((0, 0), (0, width - some.shape[1]))).T
                blind = ~some.any(axis=1)
                kept_best = []
                for first in range(0, n, QUESTIONS_AT_ONCE):
                    own, before = matrix[first : first + QUESTIONS_AT_ONCE], best[first : first + QUESTIONS_AT_ONCE]
                    scores = np.pad(own, ((0, 0), (0, width - own.shape[1]))) @ rows
                    scores[:, blind] = -2.0  # without a direction: behind all others
                    every = np.concatenate((before, scores), axis=1)
                    top = every if every.shape[1] <= k else -np.partition(-every, k - 1, axis=1)[:, :k]
                    kept_best.append(top)
                    # a little below the k-th best, so that rounding loses no tie
                    bar = np.maximum(top.min(axis=1) - 1e-9, least) if top.shape[1] == k else np.full(len(own), least)
                    question, row = np.nonzero(scores >= bar[:, None])
                    chosen = batch.slice(start, len(some)).take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([pa.array((question + first).astype(np.int32)), *chosen.columns], ["_q", "_key", "vector"])
                best = np.concatenate(kept_best) if kept_best else best

    narrow = kept.select(F.col(key).alias("_key"), "vector")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in narrow.schema)
    near = narrow.mapInArrow(score, "_q int, " + fields).join(F.broadcast(numbered.select("_q", "query_vector")), "_q")
    exact = near.withColumn("score", cosine(F.col("vector"), F.col("query_vector"))).drop("vector", "query_vector")
    if threshold is not None:
        exact = exact.where(F.col("score") >= threshold)
    order = Window.partitionBy("_q").orderBy(F.desc("score"), "_key")
    winners = exact.withColumn("dense_rank_no", F.row_number().over(order)).where(F.col("dense_rank_no") <= k)
    winners = winners.join(F.broadcast(numbered.drop("query_vector")), "_q").drop("_q")
    payload = kept.drop("vector")
    # k rows for each of a bounded number of questions
    winners = F.broadcast(winners) if k * held.num_rows <= BROADCAST_WINNERS else winners
    return payload.join(winners, payload[key] == winners["_key"]).drop("_key")


def unit_rows(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows of unit length, filled up with zeros; a null vector, or one of nothing but zeros, is a row of zeros."""
    held = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    widths = pc.unique(pc.list_value_length(held))
    if held.null_count == 0 and len(widths) == 1 and held.flatten().null_count == 0:
        out = held.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(held), -1)
    else:
        rows = [np.zeros(0) if v is None else np.asarray(v, dtype=np.float64) for v in held.to_pylist()]
        out = np.zeros((len(rows), max((len(r) for r in rows), default=0)))
        for to, row in zip(out, rows):
            to[: len(row)] = row
    return out / np.maximum(np.sqrt((out**2).sum(axis=1, keepdims=True)), 1e-300)


def with_text(hits: DataFrame, original: str = "original_text", normalized: str = "normalized_text") -> DataFrame:
    """The text of a hit: original, else normalised, else what an older payload calls ``text``, else empty."""
    parts = [F.col(c) for c in (original, normalized, "text") if c in hits.columns]
    return hits.withColumn("text", first_filled(*parts))


def project_hits(hits: DataFrame) -> DataFrame:
    """A hit's fields as answers use them, from whatever its table holds: chunk_id falls back to the point's id, ``page`` is the first page,
    fields that the table lacks are null, and the text is what with_text finds. Other columns are passed on."""
    ids = [F.col(c).cast("string" if c == "point_id" else hits.schema[c].dataType) for c in ("chunk_id", "point_id") if c in hits.columns]
    out = hits.withColumn("chunk_id", F.coalesce(*ids)) if len(ids) > 1 or "chunk_id" not in hits.columns else hits
    out = out if "document_id" in hits.columns else out.withColumn("document_id", F.lit(""))
    for name in ("source_file", "section_type", "section_title", "language", "document_type", "source"):
        out = out if name in out.columns else out.withColumn(name, F.lit(None).cast("string"))
    page = F.col("page_start") if "page_start" in hits.columns else F.lit(None).cast("int")
    return with_text(out if "page" in hits.columns else out.withColumn("page", page))


def fallback_texts(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Fills empty texts of hits from a chunk table in which a later row (``seq``) replaces an earlier one."""
    last = Window.partitionBy("chunk_id").orderBy(F.desc("seq"))
    texts = chunks.withColumn("_n", F.row_number().over(last)).where("_n = 1").select(F.col("chunk_id").alias("_id"), first_filled(F.col("original_text"), F.col("normalized_text")).alias("_text"))
    return hits.join(texts, hits["chunk_id"] == texts["_id"], "left").withColumn("text", first_filled(F.col("text"), F.col("_text"))).drop("_id", "_text")


def document_key() -> Column:
    return F.coalesce(F.nullif(F.col("document_id").cast("string"), F.lit("")), F.nullif(F.col("source_file").cast("string"), F.lit("")), F.col("chunk_id").cast("string"))


def diversify(hits: DataFrame, cap: int = CAP_PER_DOCUMENT) -> DataFrame:
    """At most ``cap`` hits of a document per question, the best ones, in score order."""
    order = Window.partitionBy("query_id", document_key()).orderBy(F.desc("score"), "chunk_id")
    return hits.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= cap).drop("_n")


def rerank(hits: DataFrame, score: Callable[[Column, Column], Column] | Column, n: int = 6) -> DataFrame:
    """The n best by a second score of (question, text); ties keep dense order. Adds rerank_score and rerank_no."""
    value = score if isinstance(score, Column) else score(F.col("query"), F.col("text"))
    order = Window.partitionBy("query_id").orderBy(F.desc("rerank_score"), "dense_rank_no")
    return hits.withColumn("rerank_score", value).withColumn("rerank_no", F.row_number().over(order)).where(F.col("rerank_no") <= n)


def batch_model(name: str, make: Callable[[], Callable[[list[tuple[str, str]]], Sequence[float]]], size: int = 32) -> Callable[[Column, Column], Column]:
    """A second score for ``rerank`` from a model of (question, text) pairs, such as a cross-encoder: loaded once per process under its name, and
    given ``size`` pairs at a time. It must give one number for each pair."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = shared_model(name, make)
        for queries, texts in batches:
            pairs, found = list(zip(queries.fillna(""), texts.fillna(""))), []
            for start in range(0, len(pairs), size):
                some = pairs[start : start + size]
                scores = [float(x) for x in model(some)]
                if len(scores) != len(some):
                    raise ValueError(f"the model {name} gave {len(scores)} scores for {len(some)} pairs")
                found += scores
            yield pd.Series(found, dtype=float)

    return lambda query, text: score(query, text)


def lexical_overlap(query: Column, text: Column) -> Column:
    """A deterministic stand-in for a cross-encoder: the share of the question's words that the text holds."""
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(c), r"(?U)\W+"), lambda w: w != ""))
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words(query), words(text))), F.size(words(query))), F.lit(0.0))


def select_evidence(hits: DataFrame, reranked: DataFrame, *, n: int = 2, max_drop: float = 0.02) -> DataFrame:
    """Evidence per question: the dense top first, reranked or not, then rerank order, skipping those whose dense score falls
    more than ``max_drop`` below the top's, until n. Adds evidence_no."""
    top = hits.where("dense_rank_no = 1")
    known = reranked.select("query_id", "chunk_id", "rerank_score", "rerank_no")
    missing = top.join(known, ["query_id", "chunk_id"], "left_anti").withColumn("rerank_score", F.lit(float("-inf"))).withColumn("rerank_no", F.lit(None).cast("int"))
    every = reranked.unionByName(missing, allowMissingColumns=True)
    whole = Window.partitionBy("query_id")
    first = F.min_by("score", "dense_rank_no").over(whole)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.col("dense_rank_no") == 1), "rerank_no")
    kept = every.withColumn("_top", first).where(F.col("_top") - F.col("score") <= max_drop)
    return kept.withColumn("evidence_no", F.row_number().over(order)).where(F.col("evidence_no") <= n).drop("_top")
