"""Embeddings and the vector table: deterministic hashing embedder, pluggable models, point construction, upsert."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import uuid5
from citeloom.operators.buckets import BucketTable, last_rows

POINT_PREFIX = "chunk:"


def word_components(text: str | None, dimension: int = 64) -> np.ndarray:
    """word_embedding in doubles.

    A vector without a model: each distinct word adds +1 or -1 to one component by the first 32 bits of its MD5; unit length."""
    words = {w for w in re.split(r"\W+", (text or "").lower()) if w}
    hashes = np.fromiter((int.from_bytes(hashlib.md5(w.encode()).digest()[:4]) for w in words), np.int64, len(words))
    out = np.bincount(hashes % dimension, np.where((hashes >> 16) % 2 == 0, 1.0, -1.0), dimension)
    norm = np.sqrt((out**2).sum())
    return out / norm if norm else out


def word_embedding(text: str | None, dimension: int = 64) -> np.ndarray:
    """word_components as vectors are stored."""
    return word_components(text, dimension).astype(np.float32)


def hash_embedding(text: Column, dimension: int = 64, double: bool = False) -> Column:
    """word_embedding in Arrow batches; with ``double`` the components before they are rounded to floats."""
    made = word_components if double else word_embedding

    @F.pandas_udf(T.ArrayType(T.DoubleType() if double else T.FloatType()))
    def encode(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: made(t, dimension))

    return encode(text)


def embed(chunks: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "normalized_text", prefix: str = "passage: ") -> DataFrame:
    """Adds ``vector`` by a model made once per task; vectors are scaled to unit length. A blank text is an error."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        held = model()
        for texts in batches:
            if any(t is None or not t.strip() for t in texts):
                raise ValueError("blank text cannot be embedded")
            found = np.asarray(held([prefix + t for t in texts]), dtype=np.float32)
            found /= np.maximum(np.linalg.norm(found, axis=1, keepdims=True), 1e-12)
            yield pd.Series(list(found))

    return chunks.withColumn("vector", encode(F.col(text)))


def embed_queries(questions: DataFrame, model: Callable[[], Callable[[list[str]], np.ndarray]], text: str = "query", prefix: str = "query: ") -> DataFrame:
    """Adds ``query_vector``: the stripped question with its own prefix, scaled to unit length."""
    stripped = questions.withColumn("_stripped", F.regexp_replace(F.col(text), r"(?U)^\s+|\s+$", ""))
    return embed(stripped, model, "_stripped", prefix).withColumnRenamed("vector", "query_vector").drop("_stripped")


def dimension(model: Callable[[], Callable[[list[str]], np.ndarray]]) -> int:
    """The dimension of a model's vectors, by one probe on the driver."""
    found = np.asarray(model()(["dimension probe"]))
    if found.ndim != 2 or not found.shape[1]:
        raise ValueError("a model gives one vector per text")
    return int(found.shape[1])


_MODELS: dict[str, object] = {}


def shared_model(name: str, make: Callable[[], object]) -> object:
    """A process's only instance of a named model, so that embedders and rerankers are loaded once however many tasks use them."""
    if name not in _MODELS:
        _MODELS[name] = make()
    return _MODELS[name]


def points(chunks: DataFrame, dimension: int) -> DataFrame:
    """Rows of the vector table: point_id, vector of the right dimension, all chunk columns."""
    sized = F.when(F.size("vector") != dimension, F.raise_error(F.lit(f"vector is not of dimension {dimension}")).cast("array<float>")).otherwise(F.col("vector").cast("array<float>"))
    return chunks.withColumn("point_id", uuid5(F.concat(F.lit(POINT_PREFIX), F.col("chunk_id").cast("string")))).withColumn("vector", sized)


def upsert(old: DataFrame, new: DataFrame, key: str = "point_id", order: Column | None = None) -> DataFrame:
    """old with new rows put in or in place of those with their key; of several new rows with a key the last stays (by ``order``, see last_rows)."""
    new = last_rows(new, key, order)
    return old.join(new.select(key), key, "left_anti").unionByName(new)


class VectorTable(BucketTable):
    """The points of a collection, in buckets by id. The vectors' dimension is fixed when the table is made."""

    def __init__(self, spark: SparkSession, path: str, dimension: int, buckets: int = 64):
        super().__init__(spark, path, "point_id", buckets, {"dimension": dimension})
        self.dimension = dimension

    def upsert(self, new: DataFrame, order: Column | None = None) -> int:
        """Puts chunks with vectors in, or in place of those with their id."""
        return super().upsert(points(new, self.dimension), order)
