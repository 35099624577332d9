"""Toxicity by compression distance: zstandard dictionaries of ordinary and of toxic text, compared window by window.

Windows are runs of ``width`` words, lower-cased and without outer punctuation. Training on a bounded labelled sample:
the ordinary dictionary is trained on the windows that most ordinary documents hold; the toxic one has the same content
and, behind it, what is trained on the windows that toxic documents hold far more often than chance would have it. A window's gap is how
many bytes shorter the toxic dictionary compresses it; ordinary text gains nothing. A window is repeated within
its block so that even one word is worth coding. Ordinary windows that do show a gap in training are added to the
ordinary content (on both sides), which takes their gap away. The threshold on the gap and the probability for each count of
windows above it are calibrated on the sample; listed toxic windows count more than once. A document's score is the probability for its count.

Defined results: null and empty texts have no windows, hence the score of a count of nought; without toxic labels every
score is that of a count of nought. Repeated rows score alike, null ids stay null, an empty table gives no rows, other columns are
ignored (keep_ordinary passes them on).
"""

from __future__ import annotations

import math
import random
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.labelled import held_out, kept_by_score, labelled_sample, with_scores
from citeloom.session import Scratch

#: Labelled rows per class that training uses, at most.
MOST_PER_CLASS = 6000
#: Windows that each dictionary is trained on, at most, and the dictionaries' bytes.
ORDINARY_WINDOWS, TOXIC_WINDOWS, ORDINARY_BYTES, TOXIC_BYTES = 6000, 1000, 16384, 4096
#: Significance in standard deviations of a toxic window, at least, and of a sure one. No window is measured by another one.
SIGMA, SURE = 5.0, 15.0
REPEATS, TOP_COUNT = 6, 6
PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def windows(text: str | None, width: int) -> list[bytes]:
    words = [w for w in (x.strip(PUNCTUATION) for x in (text or "").encode().lower().split()) if w]
    return words if width == 1 else [b" ".join(words[i : i + width]) for i in range(0, len(words), width)]


def train_dictionary(found: list[tuple[bytes, int]], size: int, seed: int = 7) -> bytes:
    """Dictionary content for windows with weights: the windows themselves where all fit into ``size`` bytes, else what
    zstandard's training keeps of samples in which each window appears by its weight."""
    import zstandard

    listed = b"".join(b" " + w for w, _ in found) + b" "
    # the compressor finds nothing in a dictionary's last bytes
    if len(listed) + 16 <= size:
        return listed + bytes(16)
    pool = [w for w, n in found for _ in range(max(1, min(200, n)))]
    random.Random(seed).shuffle(pool)
    samples = [b" " + b" ".join(pool[i : i + 8]) + b" " for i in range(0, len(pool), 8)]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() + bytes(16)
    except zstandard.ZstdError:
        return listed[: size - 16] + bytes(16)


class Gap:
    """Compressed length under the ordinary dictionary minus that under the toxic one."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = self._compressor(ordinary), self._compressor(ordinary + toxic)

    @staticmethod
    def _compressor(content: bytes):
        import zstandard as z

        held = z.ZstdCompressionDict(content or b" ", dict_type=z.DICT_TYPE_RAWCONTENT)
        # greedy search deep enough that what a dictionary holds is found whatever else it holds
        setting = z.ZstdCompressionParameters(
            strategy=z.STRATEGY_GREEDY, window_log=17, hash_log=17, chain_log=17, search_log=5, min_match=5, target_length=16,
            write_content_size=False, write_checksum=False, write_dict_id=False, format=z.FORMAT_ZSTD1_MAGICLESS,
        )
        held.precompute_compress(compression_params=setting)
        return z.ZstdCompressor(dict_data=held, compression_params=setting).compress

    def __call__(self, window: bytes) -> int:
        block = (b" " + window) * REPEATS + b" "
        return len(self.ordinary(block)) - len(self.toxic(block))


class ToxicityModel:
    """What the scoring tasks need: two dictionaries, the threshold, and the probability by count. Its size is bounded."""

    def __init__(self, ordinary: bytes, toxic: bytes, width: int, threshold: int = 1 << 30, probability: list[float] | None = None, listed: dict[bytes, int] | None = None):
        self.ordinary, self.toxic, self.width, self.threshold, self.listed = ordinary, toxic, width, threshold, listed or {}
        self.probability = probability or [0.0] * (TOP_COUNT + 1)


class Counting:
    """Windows of a text above the threshold, through a bounded cache of windows already compared."""

    def __init__(self, model: ToxicityModel, most: int = 500_000):
        self.gap, self.model, self.most = Gap(model.ordinary, model.toxic), model, most
        self.seen: set[bytes] = set()
        self.above: dict[bytes, tuple[int, int]] = {}

    def gaps(self, text: str | None) -> list[tuple[int, int]]:
        """The gap of each window that shows one of 1 byte at least, and how much it counts: once, a listed window by its significance."""
        if self.model.width > 1:
            units = windows(text, self.model.width)
        else:
            units = (text or "").encode().lower().split()
        distinct = set(units)
        new = distinct.difference(self.seen)
        if len(self.seen) + len(new) > self.most:
            self.seen, self.above, new = set(), {}, distinct
        for unit in new:
            window = unit.strip(PUNCTUATION) if self.model.width == 1 else unit
            if window and (g := self.gap(window)) > 0:
                self.above[unit] = g, self.model.listed.get(window, 1)
        self.seen |= new
        if self.above.keys().isdisjoint(distinct):
            return []
        return [self.above[u] for u in units if u in self.above]

    def count(self, text: str | None) -> int:
        return min(TOP_COUNT, sum(k for g, k in self.gaps(text) if g >= self.model.threshold))


def _document_frequencies(sample: DataFrame, width: int) -> DataFrame:
    """window, toxic, ordinary: how many sampled documents of each class hold the window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            keys = list(held[0].keys() | held[1].keys())
            columns = [pa.array(keys, pa.binary())] + [pa.array([c[k] for k in keys], pa.int64()) for c in (held[1], held[0])]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(columns, ["window", "toxic", "ordinary"])

        for batch in batches:
            for text, y in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                held[y].update(set(windows(text, width)))
                if len(held[0]) + len(held[1]) > 200_000:
                    yield out()
        yield out()

    counted = sample.select("text", F.col("y").cast("int")).mapInArrow(run, "window binary, toxic bigint, ordinary bigint")
    return counted.groupBy("window").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", width: int = 1, folds: int = 4, kept_out: int = 2, most_per_class: int = MOST_PER_CLASS) -> ToxicityModel:
    """Learns from at most ``most_per_class`` labelled rows of each class outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    rows, share = labelled_sample(docs, labels, label, folds=folds, kept_out=kept_out, most_per_class=most_per_class)
    sample = scratch.keep(rows, "sample")
    n = {r["y"]: r["count"] for r in sample.groupBy("y").count().collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return ToxicityModel(b"", b"", width, probability=[share[1] if n1 + n0 else 0.0] * (TOP_COUNT + 1))
    seen = scratch.keep(_document_frequencies(sample, width), "windows")
    part = n1 / (n1 + n0)
    together = F.col("toxic") + F.col("ordinary")
    z = (F.col("toxic") - part * together) / F.sqrt(together * (part * (1 - part)))
    ranked = seen.where("toxic >= 3").select("window", "toxic", z.alias("z")).where(F.col("z") >= SIGMA)
    found = ranked.orderBy(F.desc("z"), "window").limit(TOXIC_WINDOWS).collect()
    toxic = [(bytes(r["window"]), r["toxic"]) for r in found]
    # a listed window counts twice as much as one that is only like it, a sure one four times
    chosen = {bytes(r["window"]): 4 if r["z"] >= SURE else 2 for r in found}
    common = seen.where("ordinary > 0").orderBy(F.desc("ordinary"), "window").limit(ORDINARY_WINDOWS).collect()
    ordinary = train_dictionary([(bytes(r["window"]), r["ordinary"]) for r in common if bytes(r["window"]) not in chosen], ORDINARY_BYTES)
    content = train_dictionary(toxic, TOXIC_BYTES) if toxic else b""
    for _ in range(2):
        alarms = _alarms(seen, ToxicityModel(ordinary, content, width), chosen)
        if not alarms:
            break
        ordinary = b" " + b" ".join(alarms) + ordinary
    model = ToxicityModel(ordinary, content, width, listed=chosen)
    return _calibrated(docs, sample, model, share, {0: n0, 1: n1})


def _alarms(seen: DataFrame, model: ToxicityModel, chosen: dict[bytes, int], most: int = 1000) -> list[bytes]:
    """The windows of ordinary documents that show a gap, the most frequent first."""
    held = seen.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gap = Gap(held.value.ordinary, held.value.toxic)
        for batch in batches:
            yield batch.filter(pa.array([w not in chosen and gap(w) >= 2 for w in batch.column(0).to_pylist()], pa.bool_()))

    found = seen.where("ordinary > 0 and toxic <= ordinary").mapInArrow(run, seen.schema)
    return [bytes(r["window"]) for r in found.orderBy(F.desc("ordinary"), "window").limit(most).collect()]


def _calibrated(docs: DataFrame, sample: DataFrame, model: ToxicityModel, share: dict[int, float], n: dict[int, int]) -> ToxicityModel:
    """Sets the threshold that tells the classes apart best, and the probability of each count, never falling."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    highest = 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counting = Counting(held.value)
        for batch in batches:
            y, t, c = [], [], []
            for text, label in zip(batch.column("text").to_pylist(), batch.column("y").to_pylist()):
                gaps = counting.gaps(text)
                for threshold in range(1, highest + 1):
                    y.append(label)
                    t.append(threshold)
                    c.append(min(TOP_COUNT, sum(k for g, k in gaps if g >= threshold)))
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int32()) for v in (y, t, c)], ["y", "t", "c"])

    counted = sample.select("text", F.col("y").cast("int")).mapInArrow(run, "y int, t int, c int").groupBy("y", "t", "c").count().collect()
    table = np.zeros((highest + 1, 2, TOP_COUNT + 1))
    for r in counted:  # at most 2 * highest * (TOP_COUNT + 1) rows
        table[r["t"], r["y"], r["c"]] = r["count"] * share[r["y"]] / n[r["y"]]
    best = (math.inf, highest, [0.0])
    for threshold in range(1, highest + 1):
        mass = table[threshold]
        scale = n[0] + n[1]
        p = (mass[1] * scale + share[1]) / (mass.sum(axis=0) * scale + 1)
        p = np.maximum.accumulate(np.where(mass.sum(axis=0) > 0, p, 0))
        q = np.clip(p, 1e-6, 1 - 1e-6)
        loss = -(mass[1] * np.log(q) + mass[0] * np.log(1 - q)).sum()
        if loss < best[0] - 1e-12:
            best = (loss, threshold, p.tolist())
    return ToxicityModel(model.ordinary, model.toxic, model.width, best[1], best[2], model.listed)


def scorer(model):
    """``model``: a broadcast of the trained model."""

    def make():
        counting = Counting(model.value)
        probability = np.array(model.value.probability)

        def score(texts: list[str | None], extra: dict[str, list]) -> np.ndarray:
            return probability[np.array([counting.count(t) for t in texts], dtype=int)]

        return score

    return make


def score_toxicity(docs: DataFrame, labels: DataFrame, *, width: int = 1, folds: int = 4, kept_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, width=width, folds=folds, kept_out=kept_out))
    scored = with_scores(docs, scorer(model))
    return scored.select("doc_id", held_out("doc_id", folds, kept_out).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_ordinary(docs: DataFrame, labels: DataFrame, *, width: int = 1, folds: int = 4, kept_out: int = 2, threshold: float = 0.3) -> DataFrame:
    """The documents that are not predicted to be toxic, with the columns they came with."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, width=width, folds=folds, kept_out=kept_out))
    return kept_by_score(docs, scorer(model), lambda s: s < threshold)
