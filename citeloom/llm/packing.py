"""Best-two-fit packing of tokenised documents into fixed-length sequences.

Documents are tokenised, cut into pieces of at most ``max_tokens`` and packed. A piece matters to the packing
only through its length, and there are at most ``max_tokens`` different lengths. So the packing is planned on
the histogram of lengths (at most ``max_tokens`` rows, whatever the corpus): the planner fills one bin greedily
with the largest lengths that fit, then tries to swap the bin's smallest document for two unpacked ones that fit the
expanded gap more tightly, and repeats the resulting pattern as often as the counts allow. Pieces then get a rank
among those of their length and read their sequence and offset from the plan.

Defined results: null text counts as empty (it is packed as the end id alone), repeated rows are packed as often
as they occur, null ids stay null, an empty table gives no rows, other columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citeloom.session import Scratch

PIECE_SCHEMA = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"
#: Pieces that share one rank window; larger length classes are split over several.
RANK_GROUP = 500


class Generations:
    """A bounded cache: when the young generation is full it becomes the old one, and what is used again moves back."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def missing(self, keys: set) -> set:
        """Those of the keys that neither generation holds; the others are in ``young`` afterwards."""
        new = keys.difference(self.young)
        if len(self.young) + len(new) > self.most:
            self.young, self.old = {}, self.young
            new = keys
        old = self.old
        again = {k: old[k] for k in new if k in old}
        self.young.update(again)
        return new.difference(again)


class WordTokenizer:
    """Token ids of whole texts as little-endian uint32 bytes, by word caches in front of the tokenizer.

    The tokenizer drops white space and never joins across it, so a text's ids are those of its words in turn; it ignores
    case, so ASCII letters are lower-cased first. Words are taken apart by the tokenizer's own pre-token
    pattern: pre-tokens repeat far more often than words with their punctuation.
    """

    #: Fixed value: the tokenizer file's pre-token pattern.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    PUNCTUATION = b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, path: str, most: int = 400_000):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.words, self.parts = Generations(most), Generations(most)
        self.find = regex.compile(self.PATTERN).findall

    def encode(self, text: str) -> bytes:
        words = text.encode().lower().split()
        if new := self.words.missing(set(words)):
            self._learn(new)
        return b"".join(map(self.words.young.__getitem__, words))

    def _learn(self, new: set[bytes]) -> None:
        split: dict[bytes, list[bytes]] = {}
        known = self.words.young
        for w in new:
            core = w.rstrip(self.PUNCTUATION)
            if core.isalpha():
                split[w] = [core, w[len(core) :]] if len(core) < len(w) else [core]
                continue
            text = w.decode()
            # below U+0250 composition changes nothing and lower-casing goes letter by letter
            if len(w) < 200 and (w.isascii() or max(text) < "ɐ"):
                split[w] = [p.encode() for p in self.find("".join(map(str.lower, text)))]
            else:
                known[w] = self._raw(self.tokenizer.encode(text, add_special_tokens=False).ids)
        missing = list(self.parts.missing({p for found in split.values() for p in found}))
        parts = self.parts.young
        if missing:
            coded = self.tokenizer.encode([p.decode() for p in missing], is_pretokenized=True, add_special_tokens=False)
            raw, at = self._raw(coded.ids), 0
            for p, n in zip(missing, np.bincount(np.array(coded.word_ids), minlength=len(missing)).tolist()):
                parts[p] = raw[at : at + 4 * n]
                at += 4 * n
        for w, found in split.items():
            known[w] = b"".join([parts[p] for p in found])

    @staticmethod
    def _raw(ids: list[int]) -> bytes:
        return np.array(ids, dtype="<u4").tobytes()


_CODERS: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One tokenizer per worker process, so that its caches outlive a task."""
    if path not in _CODERS:
        _CODERS[path] = WordTokenizer(path)
    return _CODERS[path]


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """One row per piece of each document: place, length and checksum of its ids, and the ids if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = word_tokenizer(tokenizer_path)
        end, width = int(end_id).to_bytes(4, "little"), 4 * max_tokens
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                raw = coder.encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(raw), width)):
                    cut = raw[at : at + width]
                    row = (doc, k, at // 4, len(cut) // 4, zlib.crc32(cut), np.frombuffer(cut, "<u4").astype("i4") if with_ids else None)
                    for column, value in zip(out, row):
                        column.append(value)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            n = 6 if with_ids else 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out[:n], types)], names[:n])

    return docs.mapInArrow(run, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths, each with how many bins it fills, that use up the histogram.

    Every pattern is repeated until one of its lengths runs short, so the number of patterns depends on the
    capacity and not on the number of documents.
    """
    left = {int(k): int(v) for k, v in counts.items() if v > 0}
    sizes = sorted(left)
    plan = []
    while sizes:
        taken: Counter[int] = Counter()

        def largest(gap: int) -> int:
            """The largest length of which one is left beside what this bin has taken; 0 if none fits."""
            i = bisect_right(sizes, gap) - 1
            while i >= 0 and left[sizes[i]] <= taken[sizes[i]]:
                i -= 1
            return sizes[i] if i >= 0 else 0

        gap = capacity
        while gap and (size := largest(gap)):
            n = min(left[size] - taken[size], gap // size)
            taken[size] += n
            gap -= n * size
        if gap and taken.total() > 1:
            smallest = min(taken)
            taken[smallest] -= 1
            room, best = gap + smallest, (smallest, 0, 0)
            top = bisect_right(sizes, room) - 1
            for i in range(top, -1, -1):
                first = sizes[i]
                if 2 * first <= best[0]:
                    break
                if left[first] <= taken[first]:
                    continue
                taken[first] += 1
                second = largest(min(room - first, first))
                taken[first] -= 1
                if second and first + second > best[0]:
                    best = (first + second, first, second)
                    if best[0] == room:
                        break
            taken.update(best[1:] if best[1] else [smallest])
            taken += Counter()
        times = min(left[s] // n for s, n in taken.items())
        plan.append((sorted(taken.elements(), reverse=True), times))
        for s, n in taken.items():
            left[s] -= times * n
            if not left[s]:
                sizes.remove(s)
    return plan


def plan_table(plan: list[tuple[list[int], int]]) -> dict[str, np.ndarray]:
    """The plan as intervals of ranks: pieces of a length with ranks from ``rank`` on go ``per`` to a bin."""
    used: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for size, per in Counter(pattern).items():
            rows.append((size, used[size], per, sequence, offset))
            used[size] += per * times
            offset += per * size
        sequence += times
    rows.sort()
    return {k: np.array([r[i] for r in rows], dtype=np.int64) for i, k in enumerate(("size", "rank", "per", "sequence", "offset"))}


def _rank_by_length(pieces: DataFrame, histogram: DataFrame) -> DataFrame:
    """Adds ``rank``, from 0, among the pieces of the same length.

    A length class is split into groups of about RANK_GROUP pieces by a hash, ranked inside them and shifted by the
    sizes of the groups before, so that no class, however large, meets in one task. The order is by value, so reruns agree.
    """
    groups = histogram.select(F.col("length").alias("_len"), F.ceil(F.col("n") / RANK_GROUP).cast("long").alias("_groups"))
    # at most max_tokens rows: one per length
    cut = pieces.join(F.broadcast(groups), F.col("length") == F.col("_len")).drop("_len")
    cut = cut.withColumn("_group", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.col("_groups"))).drop("_groups")
    before = Window.partitionBy("_l").orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut.groupBy(F.col("length").alias("_l"), F.col("_group").alias("_g")).agg(F.count(F.lit(1)).alias("_n"))
    shift = sizes.select("_l", "_g", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = Window.partitionBy("length", "_group").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_k", F.row_number().over(inside))
    return (
        ranked.join(shift, (F.col("length") == F.col("_l")) & (F.col("_group") == F.col("_g")))
        .withColumn("rank", F.col("_shift") + F.col("_k") - 1)
        .drop("_l", "_g", "_group", "_k", "_shift")
    )


def pack_documents(
    docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", max_tokens: int = 4096, end_id: int = 1, with_ids: bool = False
) -> DataFrame:
    """Packs every document; one row per piece with its sequence and its place there.

    Columns: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ids if ``with_ids``.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    pieces = scratch.keep(tokenize_pieces(source, tokenizer_path, max_tokens, end_id, with_ids), "pieces")
    histogram = scratch.keep(pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).coalesce(1), "lengths")
    counts = {r["length"]: r["n"] for r in histogram.collect()}  # at most max_tokens rows
    plan = spark.sparkContext.broadcast(plan_table(best_two_fit(counts, max_tokens)))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = plan.value
        key = (p["size"] << 44) + p["rank"]
        for batch in batches:
            rank = batch.column("rank").to_numpy()
            size = batch.column("length").to_numpy()
            at = np.searchsorted(key, (size << 44) + rank, side="right") - 1
            nth = rank - p["rank"][at]
            sequence = p["sequence"][at] + nth // p["per"][at]
            offset = p["offset"][at] + nth % p["per"][at] * size
            kept = batch.drop_columns(["rank"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(sequence), pa.array(offset)], [*kept.schema.names, "sequence_id", "offset"])

    ranked = _rank_by_length(pieces, histogram)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema if f.name != "rank")
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")
