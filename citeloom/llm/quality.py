"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The score is w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, through the sigmoid. The pairwise sum over all features
of a document costs linear time by the identity 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2).
Features share one table of 2^bits rows: distinct words by hash, each structure statistic by its bucket, and
metadata columns by name and bucketed value. The model is fitted on a bounded sample of labelled rows on the driver by Adagrad
and has a fixed size, which is what is broadcast.

Defined results: null and empty texts are scored from their statistics (zero words); null metadata is a value of its own;
without labels of both classes every score is the share of label 1 (or 0.5 with no labels at all). Repeated rows score alike, null
ids stay null, an empty table gives no rows, and columns other than the text, the id and the metadata are ignored (keep_quality passes them on).
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.labelled import held_out, kept_by_score, labelled_sample, with_scores
from citeloom.session import Scratch

BITS = 15
FACTORS = 8
#: Labelled rows per class that the model is fitted on, at most, and their features in all.
MOST_PER_CLASS, MOST_FEATURES = 6000, 8 << 20
#: The character classes that the statistics count.
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
SYMBOLS, DIGITS, MARKS = b"#*$%&|<>", b"0123456789", b"!?"


def statistics(raw: bytes, words: list[bytes]) -> list[float]:
    """Structure of a text as shares and logarithms, whatever its language."""
    n, size = len(words), len(raw)
    if not n:
        return [0.0, math.log1p(size)] + [0.0] * 12
    letters = size - sum(raw.count(c) for c in (b" ", b"\n"))
    counts = Counter(words)
    lines = raw.split(b"\n")
    full = [x for x in lines if x.strip()]
    upper = size - len(raw.translate(None, UPPER))
    lower = size - len(raw.translate(None, LOWER))
    repeats = sum(map(bytes.__eq__, words, words[1:]))
    return [
        math.log1p(n),
        math.log1p(size),
        letters / n / 20,
        (size - len(raw.translate(None, SYMBOLS))) / size,
        upper / max(1, upper + lower),
        (size - len(raw.translate(None, DIGITS))) / size,
        (size - len(raw.translate(None, MARKS))) / size,
        raw.count(b".") / n,
        raw.count(b",") / n,
        len(counts) / n,
        max(counts.values()) / n,
        repeats / n,
        1 - len(set(full)) / max(1, len(full)),
        len(full) / n,
    ]


def bucket(value: float) -> int:
    """Logarithms by halves; shares on a grid that is finer near nought and one."""
    if value > 1:
        return 40 + int(2 * value)
    return int(20 * math.sqrt(max(0.0, value)))


def features(text: str | None, meta: list[tuple[str, object]], bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Indexes and values of a document's features."""
    raw = (text or "").encode()
    words = raw.split()
    mask = (1 << bits) - 1
    stats = statistics(raw, words)
    tags = [b"s%d=%d" % (i, bucket(v)) for i, v in enumerate(stats)]
    tags += [f"m{name}={value.bit_length() if isinstance(value, int) else value}".encode() for name, value in meta]
    crc = zlib.crc32
    hashed = list({crc(w) & mask for w in set(raw.lower().split())})
    index = np.array([crc(t, 7) & mask for t in tags] + hashed, dtype=np.int32)
    values = np.full(len(index), 1.0 / math.sqrt(max(1, len(hashed))))
    values[: len(tags)] = 1.0 / math.sqrt(len(tags))
    return index, values


class FactorisationMachine:
    def __init__(self, bits: int = BITS, factors: int = FACTORS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.bias, self.bits = 0.0, bits
        self.w = np.zeros(1 << bits)
        self.v = rng.normal(0, 0.05, (1 << bits, factors))

    def margin(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        index = np.concatenate([r[0] for r in rows])
        x = np.concatenate([r[1] for r in rows])
        at = np.concatenate(([0], np.cumsum([len(r[0]) for r in rows])[:-1]))
        vx = self.v[index] * x[:, None]
        total = np.add.reduceat(vx, at, axis=0)
        pairs = 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), at))
        return self.bias + np.add.reduceat(self.w[index] * x, at) + pairs

    def probability(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        found = [1 / (1 + np.exp(-np.clip(self.margin(rows[i : i + 256]), -50, 50))) for i in range(0, len(rows), 256)]
        return np.concatenate(found) if found else np.array([])

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, epochs: int = 12, rate: float = 0.1, decay: float = 1e-5, seed: int = 7) -> None:
        """Weighted logistic loss by Adagrad over small batches."""
        rng = np.random.default_rng(seed)
        gw, gv, gb = np.full(len(self.w), 1e-2), np.full(len(self.w), 1e-2), 1e-2
        for _ in range(epochs):
            order = rng.permutation(len(rows))
            for start in range(0, len(order), 64):
                chosen = order[start : start + 64]
                some = [rows[i] for i in chosen]
                index = np.concatenate([r[0] for r in some])
                x = np.concatenate([r[1] for r in some])
                lengths = np.array([len(r[0]) for r in some])
                at = np.concatenate(([0], np.cumsum(lengths)[:-1]))
                row = np.repeat(np.arange(len(some)), lengths)
                vx = self.v[index] * x[:, None]
                total = np.add.reduceat(vx, at, axis=0)
                pairs = 0.5 * ((total**2).sum(axis=1) - np.add.reduceat((vx**2).sum(axis=1), at))
                margin = self.bias + np.add.reduceat(self.w[index] * x, at) + pairs
                error = (1 / (1 + np.exp(-np.clip(margin, -50, 50))) - y[chosen]) * weight[chosen]
                seen, place = np.unique(index, return_inverse=True)
                each = error[row] * x
                dw = np.bincount(place, each, len(seen)) + decay * self.w[seen]
                dv = np.empty((len(seen), self.v.shape[1]))
                pull = each[:, None] * (total[row] - vx)
                for f in range(dv.shape[1]):
                    dv[:, f] = np.bincount(place, pull[:, f], len(seen))
                dv += decay * self.v[seen]
                gw[seen] += dw**2
                gv[seen] += (dv**2).mean(axis=1)
                gb += error.sum() ** 2
                self.w[seen] -= rate * dw / np.sqrt(gw[seen])
                self.v[seen] -= 0.5 * rate * dv / np.sqrt(gv[seen])[:, None]
                self.bias -= rate * error.sum() / math.sqrt(gb)


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", meta: tuple[str, ...] = ("n_chars",), folds: int = 3, kept_out: int = 1, most_per_class: int = MOST_PER_CLASS) -> FactorisationMachine:
    """Fits on the labelled rows outside the held-out fold: at most ``most_per_class`` of each class, with at most MOST_FEATURES features,
    in the order of a hash of the features. What reaches the driver is bounded by that, whatever the texts' lengths."""
    scratch = Scratch(docs.sparkSession, "quality")
    sample, share = labelled_sample(docs, labels, label, folds=folds, kept_out=kept_out, most_per_class=most_per_class, extra=list(meta))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(n).to_pylist() for n in batch.schema.names}
            found = [features(t, [(m, columns[m][i]) for m in meta]) for i, t in enumerate(columns["text"])]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([f[0] for f in found], pa.list_(pa.int32())),
                    pa.array([float(f[1][-1]) for f in found], pa.float64()),
                    batch.column("y").cast(pa.int32()),
                ],
                ["idx", "value", "y"],
            )

    encoded = sample.mapInArrow(encode, "idx array<int>, value double, y int").withColumn("h", F.xxhash64("idx")).withColumn("no", F.monotonically_increasing_id())
    encoded = scratch.keep(encoded, "encoded")
    chosen = F.lit(False)
    for cls in (0, 1):
        # at most most_per_class rows of three numbers
        keys = encoded.where(F.col("y") == cls).orderBy("h", "no").select("h", "no", F.size("idx").alias("size")).limit(most_per_class).collect()
        within = [k for k, total in zip(keys, np.cumsum([k["size"] for k in keys])) if total <= MOST_FEATURES]
        if within:
            chosen = chosen | ((F.col("y") == cls) & ((F.col("h") < within[-1]["h"]) | ((F.col("h") == within[-1]["h"]) & (F.col("no") <= within[-1]["no"]))))
    rows = scratch.again(encoded).where(chosen).select("idx", "value", "y").toArrow()
    scratch.drop(encoded)
    model = FactorisationMachine()
    y = rows.column("y").to_numpy().astype(float)
    model.bias = math.log(max(share[1], 1e-3) / max(share[0], 1e-3)) if share[1] + share[0] else 0.0
    if len(set(y.tolist())) < 2:
        return model
    n_tags = 14 + len(meta)
    data = []
    for idx, value in zip(rows.column("idx"), rows.column("value").to_pylist()):
        index = idx.values.to_numpy()
        x = np.full(len(index), value)
        x[:n_tags] = 1.0 / math.sqrt(n_tags)
        data.append((index, x))
    # rows stand for their class's share of all labelled rows, so the score is a probability there
    ones = y.mean()
    weight = np.where(y == 1, share[1] / ones, share[0] / (1 - ones))
    order = np.lexsort((y, [int(d[0][:50].astype(np.int64).sum()) for d in data], [len(d[0]) for d in data]))
    data, y, weight = [data[i] for i in order], y[order], weight[order]
    model.fit(data, y, weight)
    return model


def scorer(model, meta: tuple[str, ...]):
    """``model``: a broadcast of the fitted machine."""

    def make():
        machine = model.value

        def score(texts: list[str | None], extra: dict[str, list]) -> np.ndarray:
            out = []
            for at in range(0, len(texts), 256):
                rows = [features(t, [(m, extra[m][i]) for m in meta]) for i, t in enumerate(texts[at : at + 256], at)]
                out.append(machine.probability(rows))
            return np.concatenate(out) if out else np.array([])

        return score

    return make


def score_quality(docs: DataFrame, labels: DataFrame, *, meta: tuple[str, ...] = ("n_chars",), folds: int = 3, kept_out: int = 1) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    meta = tuple(m for m in meta if m in docs.columns)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, meta=meta, folds=folds, kept_out=kept_out))
    scored = with_scores(docs, scorer(model, meta), extra=list(meta))
    return scored.select("doc_id", held_out("doc_id", folds, kept_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_quality(docs: DataFrame, labels: DataFrame, *, meta: tuple[str, ...] = ("n_chars",), folds: int = 3, kept_out: int = 1) -> DataFrame:
    """The documents that the classifier predicts to be of quality, with the columns they came with."""
    meta = tuple(m for m in meta if m in docs.columns)
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, meta=meta, folds=folds, kept_out=kept_out))
    return kept_by_score(docs, scorer(model, meta), lambda s: s >= 0.5, extra=list(meta))
