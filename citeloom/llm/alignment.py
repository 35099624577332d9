"""Alignment of two tokenizers over whole texts, by segments that are tokenised once.

A text, with a space before it, is cut before each run of spaces that follows something other than white space. Neither tokenizer can join tokens across such
a place: ``can_cut`` verifies it on both vocabularies (no token has a space behind anything but white space, so no merge reaches over the cut; the first
tokenizer's own pre-tokens end there too). If a vocabulary fails, the text is one segment. So a text's tokens are those of its segments in
turn, groups and links never reach over a cut, and everything that is asked of a text is a sum, or a sequence, over its segments.

Documents are read in blocks of about BLOCK_BYTES of text. The different segments of each block are dealt to parts by their hash; in its part each different
segment of all blocks is tokenised and aligned once, and its alignment (ids, and the order in which tokens end) goes back to the blocks that hold it,
where the documents are composed from it. What is shuffled are texts, and what a block and a part have in common, packed into one row:
never single occurrences of a segment, and a segment that is in every document is met once in each block.

Links are counted by the documents that hold them. Up to BROADCAST_LINKS of these counts are broadcast; more are joined by a shuffle.

Defined results: null and empty texts, and those that a tokenizer does not give back as they were, have no tokens: zeros and an empty digest. Repeated rows are
documents of their own, null ids stay null, an empty table gives no rows, other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.session import Scratch

BLOCK_BYTES = 8 << 20
BROADCAST_LINKS = 4_000_000
_ODD = re.compile(r" (?<=\s )")
_CUT = re.compile(r"(?<=\S)(?= )(?! *\Z)")
_COUNTS = "n_a bigint, n_b bigint, n_groups bigint, n_links bigint"
#: Steps from one link to the next: a token of the first tokenizer ends, one of the second, both.
ENDS_A, ENDS_B, ENDS_BOTH = 0, 1, 2


def segments(text: str) -> list[str]:
    """The segments of space + text, each without the space that it begins with."""
    if text[0] == " " or text[-1] == " " or _ODD.search(text):
        return [s[1:] for s in _CUT.split(" " + text)]
    return text.split(" ")


def can_cut(tokens: list[bytes]) -> bool:
    """Whether no token has a space behind anything but white space. Bytes that are no whole character count as no white space."""

    def fine(token: bytes) -> bool:
        at = token.find(b" ", 1)
        while at > 0:
            before = token[:at].decode("utf-8", "replace")
            if not before[-1].isspace():
                return False
            at = token.find(b" ", at + 1)
        return True

    return all(b" " not in t[1:] or fine(t) for t in tokens)


class Pair:
    """Two tokenizers with the bytes of their tokens: a byte-level BPE file, and a sentencepiece model that puts a space before a text."""

    def __init__(self, path_a: str, path_b: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        self.bytes_a = {i: bytes(letters[c] for c in t) for t, i in self.a.get_vocab().items() if all(c in letters for c in t)}
        self.size_b = self.b.get_piece_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.size_b)]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.cut = can_cut(list(self.bytes_a.values())) and can_cut(self.bytes_b)

    def segments(self, text: str) -> list[str]:
        return segments(text) if self.cut else [text]

    def align(self, segment: str, ids_a: list[int], ids_b: list[int]) -> bytes:
        """The segment's alignment as 32-bit numbers: how many ids of both, the ids, and the steps from link to link. Empty if the tokens do not give it back."""
        raw = (" " + segment).encode()
        parts_a, parts_b = [self.bytes_a.get(i, b"") for i in ids_a], [self.bytes_b[i] for i in ids_b]
        if b"".join(parts_a) != raw or b"".join(parts_b) != raw:
            return b""
        if len(ids_a) == 1 or len(ids_b) == 1:
            steps = [ENDS_B if len(ids_a) == 1 else ENDS_A] * (max(len(ids_a), len(ids_b)) - 1)
        else:
            steps, i, j = [], 0, 0
            end_a, end_b = len(parts_a[0]), len(parts_b[0])
            while end_a < len(raw) or end_b < len(raw):
                step = ENDS_A if end_a < end_b else ENDS_B if end_b < end_a else ENDS_BOTH
                steps.append(step)
                if step != ENDS_B:
                    i += 1
                    end_a += len(parts_a[i])
                if step != ENDS_A:
                    j += 1
                    end_b += len(parts_b[j])
        return array("I", [len(ids_a), len(ids_b), *ids_a, *ids_b, *steps, ENDS_BOTH]).tobytes()

    def align_all(self, found: list[str]) -> list[bytes]:
        coded = self.a.encode_batch_fast([" " + s for s in found], add_special_tokens=False)
        return [self.align(s, x.ids, y) for s, x, y in zip(found, coded, self.b.encode(found, num_threads=1))]


def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in byte-level vocabularies: printable Latin-1 for itself, the others from U+0100 on in turn."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


_PAIRS: dict[tuple[str, str], Pair] = {}


def _pair(paths: tuple[str, str]) -> Pair:
    """One per worker process."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if paths not in _PAIRS:
        _PAIRS[paths] = Pair(*paths)
    return _PAIRS[paths]


def in_blocks(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """block, row, doc_id, text: rows as they are read, in runs of about ``size`` bytes of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        before, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            lengths = pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            upto = before + np.cumsum(lengths)
            blocks = first + np.concatenate(([before], upto[:-1])) // size
            before = int(upto[-1]) if len(upto) else before
            yield pa.RecordBatch.from_arrays([pa.array(blocks, pa.int64()), *batch.columns], ["block", "row", "doc_id", "text"])

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "block bigint, row bigint, doc_id bigint, text string")


def pack(values: list[bytes]) -> bytes:
    """Many short values as one: their lengths and then themselves, under zstandard."""
    lengths = np.fromiter(map(len, values), "<u4", len(values))
    raw = len(values).to_bytes(8, "little") + lengths.tobytes() + b"".join(values)
    return len(raw).to_bytes(8, "little") + pa.Codec("zstd").compress(raw, asbytes=True)


def unpack(packed: bytes) -> tuple[np.ndarray, bytes]:
    """(lengths, the values behind each other)."""
    raw = pa.Codec("zstd").decompress(packed[8:], decompressed_size=int.from_bytes(packed[:8], "little"), asbytes=True)
    n = int.from_bytes(raw[:8], "little")
    return np.frombuffer(raw, "<u4", n, 8).astype(np.int64), raw[8 + 4 * n :]


def unpack_texts(packed: bytes) -> list[str]:
    lengths, raw = unpack(packed)
    ends = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(ends.tobytes()), pa.py_buffer(raw)).to_pylist()


def block_segments(blocks: DataFrame, paths: tuple[str, str], parts: int) -> DataFrame:
    """(part, block, segments): the different segments of a block that fall in a part; a block that is read in pieces may give one more than once."""

    def given(block: int, held: set[str]) -> pa.RecordBatch:
        dealt: dict[int, list[bytes]] = {}
        for raw in sorted(s.encode() for s in held):
            dealt.setdefault(zlib.crc32(raw) % parts, []).append(raw)
        columns = [pa.array(list(dealt), pa.int64()), pa.array([block] * len(dealt), pa.int64()), pa.array(map(pack, dealt.values()), pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["part", "block", "segments"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, at, held = _pair(paths).segments, None, set()
        for batch in batches:
            for block, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                if block != at:
                    if held:
                        yield given(at, held)
                    at, held = block, set()
                if text := text.as_py():
                    held.update(cut(text))
        if held:
            yield given(at, held)

    return blocks.select("block", "text").mapInArrow(run, "part bigint, block bigint, segments binary")


def aligned_segments(met: DataFrame, paths: tuple[str, str]) -> DataFrame:
    """(block, segments, codes): what a part has aligned, each segment once, for each block that holds some of it."""

    def run(part: pa.Table) -> pa.Table:
        held = [unpack_texts(p) for p in part.column("segments").to_pylist()]
        pair, codes = _pair(paths), dict.fromkeys(s for some in held for s in some)
        every = list(codes)
        for start in range(0, len(every), 1000):
            some = every[start : start + 1000]
            codes.update(zip(some, pair.align_all(some)))
        packed = pa.array([pack([codes[s] for s in some]) for some in held], pa.binary())
        return pa.Table.from_arrays([part.column("block"), part.column("segments"), packed], ["block", "segments", "codes"])

    return met.groupBy("part").applyInArrow(run, "block bigint, segments binary, codes binary")


class Alignments:
    """The alignments of a block's segments as arrays."""

    def __init__(self, packed: list[tuple[bytes, bytes]], size_b: int):
        texts = [unpack_texts(segments) for segments, _ in packed]
        self.index = {s: k for k, s in enumerate(s for some in texts for s in some)}
        codes = [unpack(c) for _, c in packed]
        sizes = np.concatenate([lengths for lengths, _ in codes] or [np.zeros(0, np.int64)]) // 4
        self.sound = sizes > 0
        values = np.frombuffer(b"".join([raw for _, raw in codes]), np.uint32)
        at = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        at_sound = at[self.sound]
        self.n_a, self.n_b = np.zeros((2, len(sizes)), np.int64)
        self.n_a[self.sound], self.n_b[self.sound] = values[at_sound], values[at_sound + 1]
        first_a = at + 2
        first_b = first_a + self.n_a
        self.n_links = np.where(self.sound, sizes - 2 - self.n_a - self.n_b, 0)
        self.starts = np.concatenate(([0], np.cumsum(self.n_links)))
        # the links of all segments behind each other
        of = np.repeat(np.arange(len(sizes)), self.n_links)
        steps = values[_runs(first_b + self.n_b, self.n_links)]
        self.n_groups = np.bincount(of, steps == ENDS_BOTH, minlength=len(sizes)).astype(np.int64)
        places = [_inside(steps != other, self.starts[of]) for other in (ENDS_B, ENDS_A)]
        ids_a, ids_b = values[first_a[of] + places[0]], values[first_b[of] + places[1]]
        self.counts = np.stack((self.n_a, self.n_b, self.n_groups, self.n_links))
        # links as numbers of the block's different pairs
        self.pairs, links = np.unique(ids_a.astype(np.int64) * size_b + ids_b, return_inverse=True)
        self.links = links.astype(np.int32)
        self.groups = _group_texts(ids_a, ids_b, steps, self.starts.tolist(), self.n_links.tolist())

    def compose(self, found: list[str]) -> tuple:
        """(n_a, n_b, n_groups, n_links, digest, different pairs, how often each) of a text of these segments."""
        places = [self.index[s] for s in found]
        at = np.array(places)
        if not self.sound[at].all():
            return NO_TOKENS
        digest = hashlib.sha256(";".join([self.groups[k] for k in places]).encode()).hexdigest()
        links = self.links[_runs(self.starts[at], self.n_links[at])]
        if len(self.pairs) > 16 * len(links):
            some, times = np.unique(links, return_counts=True)
        else:
            times = np.bincount(links)
            some = np.flatnonzero(times)
            times = times[some]
        return (*self.counts[:, at].sum(axis=1).tolist(), digest, self.pairs[some], times)


NO_TOKENS: tuple = (0, 0, 0, 0, "", [], [])


def _runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each run, behind each other."""
    return np.repeat(starts - np.concatenate(([0], np.cumsum(lengths)))[:-1], lengths) + np.arange(lengths.sum())


def _inside(ends: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many tokens of the same segment have ended before each link."""
    before = np.concatenate(([0], np.cumsum(ends)))
    return before[:-1] - before[first]


def _group_texts(ids_a: np.ndarray, ids_b: np.ndarray, steps: np.ndarray, starts: list[int], lengths: list[int]) -> list[str]:
    """Each segment's groups as text, from its links."""
    named = [str(i) for i in range(1 + int(max(ids_a.max(initial=0), ids_b.max(initial=0))))]
    texts_a, texts_b, steps = [named[i] for i in ids_a.tolist()], [named[i] for i in ids_b.tolist()], steps.tolist()
    out = []
    for at, n in zip(starts, lengths):
        if n == 1:
            out.append(texts_a[at] + "|" + texts_b[at])
            continue
        groups, left, right = [], "", ""
        for a, b, step in zip(texts_a[at : at + n], texts_b[at : at + n], steps[at : at + n]):
            if step == ENDS_BOTH:
                groups.append(left + a + "|" + right + b)
                left = right = ""
            elif step == ENDS_A:
                left += a + ","
            else:
                right += b + ","
        out.append(";".join(groups))
    return out


def composed(blocks: DataFrame, aligned: DataFrame, paths: tuple[str, str], kind: pa.DataType) -> DataFrame:
    """Each document's counts and digest, its different linked pairs and how often it holds each."""
    kinds = [*[pa.int64()] * 4, pa.string(), pa.list_(kind), pa.list_(pa.int32())]
    names = ["row", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
    sql = "int" if kind == pa.int32() else "bigint"

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        pair = _pair(paths)
        held = Alignments(list(zip(right.column("segments").to_pylist(), right.column("codes").to_pylist())), pair.size_b)
        found = [held.compose(pair.segments(t)) if t else NO_TOKENS for t in left.column("text").to_pylist()]
        columns = [pa.array(c, t) for c, t in zip(zip(*found), kinds)] if found else [pa.array([], t) for t in kinds]
        return pa.Table.from_arrays([left.column("row"), left.column("doc_id"), *columns], names)

    return blocks.groupBy("block").cogroup(aligned.groupBy("block")).applyInArrow(run, f"row bigint, doc_id bigint, {_COUNTS}, groups_sha256 string, pairs array<{sql}>, times array<int>")


def with_link_counts(scratch: Scratch, documents: DataFrame, size_b: int) -> DataFrame:
    """Adds n_best and count_sum, and drops the pairs."""
    counted = scratch.keep(documents.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "counts")
    counted = counted.withColumn("a", F.expr(f"pair div {size_b}"))
    most = counted.groupBy("a").agg(F.max("n").alias("_most"))
    # one row per id of the first vocabulary
    counted = counted.join(F.broadcast(most), "a").select("pair", "n", (F.col("n") == F.col("_most")).alias("best"))
    plain = [c for c in documents.columns if c not in ("pairs", "times")]
    if counted.count() > BROADCAST_LINKS:
        held = documents.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("z")).select("row", F.col("z.pairs").alias("pair"), F.col("z.times").cast("long").alias("times"))
        sums = held.join(counted, "pair").groupBy(F.col("row").alias("_row")).agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
        out = documents.select(*plain).join(sums, F.col("row") == F.col("_row"), "left")
        return out.select(*plain, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_best", "count_sum")])
    table = counted.toArrow().sort_by("pair")
    known = documents.sparkSession.sparkContext.broadcast(tuple(table.column(c).to_numpy() for c in ("pair", "n", "best")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, best = known.value
        for batch in batches:
            lists = batch.column("pairs")
            at = np.searchsorted(keys, lists.flatten().to_numpy())
            times = batch.column("times").flatten().to_numpy().astype(np.int64)
            ends = np.diff(lists.offsets.to_numpy())
            sums = []
            for weights in (times * best[at], times * counts[at]):
                upto = np.concatenate(([0], np.cumsum(weights)))
                stop = np.cumsum(ends)
                sums.append(pa.array(upto[stop] - upto[stop - ends], pa.int64()))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in plain], *sums], [*plain, "n_best", "count_sum"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in documents.select(*plain).schema)
    return documents.mapInArrow(run, fields + ", n_best bigint, count_sum bigint")


def align_documents(docs: DataFrame, path_a: str, path_b: str, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    paths = (path_a, path_b)
    pair = _pair(paths)
    size_b = pair.size_b
    kind = pa.int32() if (1 + max(pair.bytes_a)) * size_b < 1 << 31 else pa.int64()
    scratch = Scratch(docs.sparkSession, "alignment")
    blocks = scratch.keep(in_blocks(docs, id_col, text_col, block_bytes), "blocks", compression="zstd")
    # as many parts as blocks, so that a part's size does not grow with the table
    parts = max(1, blocks.select("block").distinct().count())
    aligned = aligned_segments(block_segments(blocks, paths, parts), paths)
    documents = scratch.keep(composed(blocks, aligned, paths, kind), "composed", compression="zstd")
    scratch.drop(blocks)
    return with_link_counts(scratch, documents, size_b).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
