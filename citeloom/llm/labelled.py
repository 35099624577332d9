"""Labelled training samples and the scoring pass that the classifiers share."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(id_col: str, folds: int) -> Column:
    """crc32 of the id's text modulo ``folds``; null ids have fold null."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def held_out(id_col: str, folds: int, kept_out: int) -> Column:
    return F.coalesce(fold(id_col, folds) == kept_out, F.lit(False))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, *, folds: int, kept_out: int, most_per_class: int, extra: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> tuple[DataFrame, dict[int, float]]:
    """The training rows (text, y and ``extra`` columns), and each class's share among all labelled training rows.

    Per class at most ``most_per_class`` ids are taken, in the order of a hash of the id, so the sample's size is bounded whatever
    the corpus. A document with several labels counts with the least of them. Null labels and null ids are left out.
    """
    known = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(id_col, folds, kept_out))
    known = known.groupBy(F.col(id_col).cast("long").alias("_id")).agg(F.min(label).alias("y"))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = known.where("y = 0").orderBy(*order).limit(most_per_class).union(known.where("y = 1").orderBy(*order).limit(most_per_class))
    columns = [F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in extra or []]]
    # bounded by the sample's size
    rows = docs.select(*columns).join(F.broadcast(chosen), "_id").drop("_id")
    total = sum(counts.values())
    return rows, {y: counts.get(y, 0) / total if total else 0.5 for y in (0, 1)}


Scorer = Callable[[list[str | None], dict[str, list]], np.ndarray]


def with_scores(docs: DataFrame, make: Callable[[], Scorer], *, text_col: str = "text", extra: list[str] | None = None, id_col: str = "doc_id") -> DataFrame:
    """doc_id and score of every row. ``make`` builds the scorer once per task."""
    extra = extra or []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            found = score(batch.column(1).to_pylist(), {c: batch.column(2 + i).to_pylist() for i, c in enumerate(extra)})
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    columns = [F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(c) for c in extra]]
    return docs.select(*columns).mapInArrow(run, "doc_id bigint, score double")


def kept_by_score(docs: DataFrame, make: Callable[[], Scorer], keep: Callable[[np.ndarray], np.ndarray], *, text_col: str = "text", extra: list[str] | None = None) -> DataFrame:
    """The rows whose score passes ``keep``, with exactly the columns they came with."""
    extra, names = extra or [], docs.columns
    at, others = names.index(text_col), [names.index(c) for c in extra]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = make()
        for batch in batches:
            found = score(batch.column(at).to_pylist(), {c: batch.column(i).to_pylist() for c, i in zip(extra, others)})
            yield batch.filter(pa.array(keep(found)))

    return docs.mapInArrow(run, docs.schema)
