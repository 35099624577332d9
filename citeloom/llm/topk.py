"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Vectors are quantised to integers. The index cuts the candidates into blocks, each one row of a written table; a posting is (dimension,
vector, value), and its impact level is the bit length of |value|. Segments are taken by descending impact. What the segments below a
level can still add to a score is at most the product of the query's norm and the norm of what the vector has left there (Cauchy-Schwarz), so after each
pass every candidate has an upper bound; one whose bound is below the query's k-th best score so far is proven out. A pass takes the next
level alone, but for the first one, which takes as many levels at once as a probe with a few queries found the proof to need: one product over
their postings costs less than one for each. Processing stops when the proof leaves few possible members, or at the last level. All possible
members are rescored with integers, so the result is exact whatever the order or the stop.

Queries are broadcast in groups of at most QUERIES (a bound in rows of a fixed width, whatever the collection). Each task streams its
blocks past the whole group and carries the k best of each query from block to block; only k rows per query and task are shuffled. The blocks are
written once and read once per group.

Defined results: vectors that are null or hold null or non-finite components take no part, as queries or as candidates; null ids take no
part. Rows with the query's own id are not its candidates. Vectors of different lengths are compared as if the shorter one ended
in zeros. Ties go to the smaller vec_id; repeated rows each count as a candidate. Products beyond 2^53 are summed as Python integers; one that no long
holds is an error.
"""

from __future__ import annotations

import pickle
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import Scratch

#: Vectors per index block, queries per broadcast group, queries compared at once, and queries of a probe.
BLOCK, QUERIES, CHUNK, PROBE = 8192, 65_536, 256, 16
#: Possible members, as a share of all, at which rescoring costs less than another pass.
FEW = 0.02
#: Whole numbers that doubles and floats hold exactly.
EXACT, EXACT_SMALL = float(1 << 53), float(1 << 24)


def quantised(vector: str, scale: int) -> Column:
    """Integers floor(scale x), or null for vectors that take no part."""
    x = F.transform(F.col(vector), lambda v: v.cast("double"))
    sound = F.col(vector).isNotNull() & F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(sound, F.transform(x, lambda v: F.floor(F.lit(float(scale)) * v).cast("long")))


def matrix(vectors: list[np.ndarray]) -> np.ndarray:
    """The vectors as rows, filled up with zeros, in the narrowest whole numbers."""
    width = max((len(v) for v in vectors), default=0)
    out = np.zeros((len(vectors), width), np.int64)
    for row, v in zip(out, vectors):
        row[: len(v)] = v
    peak = int(np.abs(out).max(initial=0))
    return out.astype(np.int8 if peak < 1 << 7 else np.int16 if peak < 1 << 15 else np.int32 if peak < 1 << 31 else np.int64)


class Block:
    """An index block: ids ascending, values, and each posting's impact level."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.values = ids[order], values[order]
        self.level = np.ceil(np.log2(np.abs(self.values.astype(np.float64)) + 1)).astype(np.int8)
        self.levels = sorted({int(v) for v in np.unique(self.level)} - {0}, reverse=True)
        self.passes: list[tuple[np.ndarray, np.ndarray]] = []

    def pack(self) -> bytes:
        return zlib.compress(pickle.dumps((self.ids, self.values, self.level, self.levels), 5), 1)

    @classmethod
    def unpack(cls, raw: bytes) -> Block:
        self = cls.__new__(cls)
        self.ids, self.values, self.level, self.levels = pickle.loads(zlib.decompress(raw))
        self.passes = []
        return self

    def plan(self, first: int, kind: type) -> None:
        """The passes: the first takes that many levels at once, each later one a level; with each, what vectors have left below."""
        self.passes = []
        upto = [self.levels[:first], *([at] for at in self.levels[first:])] if self.levels else [[]]
        for held in upto:
            lowest = held[-1] if held else 0
            postings = np.ascontiguousarray(np.where(np.isin(self.level, held), self.values, 0).T.astype(kind))
            left = np.where((self.level < lowest), self.values, 0).astype(np.float64)
            self.passes.append((postings, np.sqrt((left**2).sum(axis=1))))


class Group:
    """Queries and the best candidates that they have met so far."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, k: int):
        self.ids, self.values, self.k = ids, values, k
        self.norm = np.sqrt((values.astype(np.float64) ** 2).sum(axis=1))
        self.none = np.zeros(0, np.int64)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(self.none, self.none, self.none) for _ in range(0, len(ids), CHUNK)]
        self.bar = np.full(len(ids), -np.inf)

    def meet(self, block: Block) -> None:
        """Takes the block's candidates in."""
        width = max(self.values.shape[1], block.values.shape[1])
        q = np.pad(self.values, ((0, 0), (0, width - self.values.shape[1])))
        block.values = np.pad(block.values, ((0, 0), (0, width - block.values.shape[1])))
        block.level = np.pad(block.level, ((0, 0), (0, width - block.level.shape[1])))
        peak = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(block.values.astype(np.float64)).max(initial=0)) * max(1, width)
        if peak < EXACT:
            kind = np.float32 if peak < EXACT_SMALL else np.float64
            first = 1
            while first < len(block.levels):
                block.plan(first, kind)
                if self._possible(slice(0, PROBE), q, block, kind, passes=1).mean() <= FEW:
                    break
                first += 1
            block.plan(first, kind)
        for n, at in enumerate(range(0, len(q), CHUNK)):
            some = slice(at, at + CHUNK)
            maybe = self._possible(some, q, block, kind) if peak < EXACT else ~self._own(some, block)
            row, col = np.nonzero(maybe)
            parts = []
            for i in range(0, len(row), 1 << 18):
                a, b = q[some][row[i : i + (1 << 18)]], block.values[col[i : i + (1 << 18)]]
                if peak < EXACT:
                    parts.append(np.einsum("ij,ij->i", a.astype(np.float64), b.astype(np.float64)).astype(np.int64))
                else:
                    parts.append(np.array([sum(x * y for x, y in zip(u, v)) for u, v in zip(a.tolist(), b.tolist())], dtype=np.int64))
            score = np.concatenate(parts) if parts else self.none
            self._take(n, some, row, block.ids[col], score)

    def _own(self, some: slice, block: Block) -> np.ndarray:
        return self.ids[some, None] == block.ids[None, :]

    def _possible(self, some: slice, q: np.ndarray, block: Block, kind: type, passes: int | None = None) -> np.ndarray:
        """Which candidates can be among the k best: all that the bounds do not prove out."""
        own, bar, n = self._own(some, block), self.bar[some].astype(kind), len(block.ids)
        score = np.zeros((len(bar), n), kind)
        maybe = ~own
        for done, (postings, left) in enumerate(block.passes, 1):
            score += q[some].astype(kind) @ postings
            slack = (self.norm[some, None] * left[None, :] * (1 + 1e-5) + 4).astype(kind)
            if self.k <= n:
                # the k-th best lower bound here
                lower = np.where(own, -np.inf, score - slack) if np.isneginf(bar).any() else None
                if lower is not None:
                    bar = np.maximum(bar, np.partition(lower, n - self.k, axis=1)[:, n - self.k])
            maybe = ~own & (score + slack >= bar[:, None])
            if done == passes or maybe.mean() <= FEW:
                break
        return maybe

    def _take(self, n: int, some: slice, row: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        """The k best of those held and of those new, per query; ties go to the smaller id."""
        row, ids, score = (np.concatenate(pair) for pair in zip(self.held[n], (row, ids, score)))
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        start = np.searchsorted(row, row, side="left")
        rank = np.arange(len(row)) - start
        best = rank < self.k
        self.held[n] = row[best], ids[best], score[best]
        last = rank == self.k - 1
        self.bar[some.start + row[last]] = score[last]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for n, (row, ids, score) in enumerate(self.held):
            if len(row):
                yield pa.RecordBatch.from_arrays([pa.array(self.ids[n * CHUNK + row]), pa.array(ids), pa.array(score)], ["query_id", "vec_id", "score"])


def _packed(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Index blocks of a task's vectors."""
    ids: list[int] = []
    vectors: list[np.ndarray] = []

    def out() -> pa.RecordBatch:
        raw = Block(np.array(ids, np.int64), matrix(vectors)).pack()
        ids.clear()
        vectors.clear()
        return pa.RecordBatch.from_arrays([pa.array([raw], pa.binary())], ["block"])

    for batch in found:
        for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
            ids.append(i)
            vectors.append(v.values.to_numpy(zero_copy_only=False))
            if len(ids) == BLOCK:
                yield out()
    if ids:
        yield out()


def top_k(docs: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", is_query: Column | None = None, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of each query's k best among all other rows.

    ``is_query`` marks the query rows (ids divisible by 20, if None).
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "topk")
    query = (F.col("id") % 20 == 0) if is_query is None else is_query
    rows = docs.select(F.col(id_col).cast("long").alias("id"), quantised(vector_col, scale).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    rows = scratch.keep(rows.withColumn("is_query", query), "quantised")
    n, n_query = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    blocks, groups = max(1, -(-n // BLOCK)), max(1, -(-2 * n_query // QUERIES))
    # dealt evenly over tasks, once
    index = scratch.keep(scratch.again(rows).select("id", "v").repartition(blocks).mapInArrow(_packed, "block binary"), "index")
    asked = scratch.keep(scratch.again(rows).where("is_query").select(F.pmod(F.xxhash64("id", "v"), F.lit(groups)).alias("group"), "id", "v"), "queries")
    found = None
    for group in range(groups):
        # about QUERIES / 2 rows, dealt by hash
        held = asked.where(F.col("group") == group).select("id", "v").toArrow()
        vectors = [v.values.to_numpy(zero_copy_only=False) for v in held.column("v")]
        shared = spark.sparkContext.broadcast((held.column("id").to_numpy().astype(np.int64), matrix(vectors)))

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            mine = Group(*shared.value, k)
            for batch in batches:
                for raw in batch.column(0):
                    mine.meet(Block.unpack(raw.as_py()))
            yield from mine.rows()

        part = scratch.keep(index.mapInArrow(search, "query_id bigint, vec_id bigint, score bigint"), "found")
        found = part if found is None else found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("vec_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH q AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM q a JOIN q b ON a.vec_id <> b.vec_id
  WHERE a.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""
