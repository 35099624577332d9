"""SimHash near-duplicate groups: pigeonhole blocks, Hamming verification, connected components.

A fingerprint is taken over the word shingles of the whole text. Documents with equal fingerprints are one node; nodes
within ``distance`` bits are linked, and groups are the connected components of these links.

Candidates: the 64 bits are cut into ``b`` blocks. Two fingerprints at most ``distance`` bits apart agree on at least
``b - distance`` blocks, so they share the key made of some choice of that many. ``b`` follows from the number of distinct
fingerprints: the more there are, the longer the keys, so that chance meetings per fingerprint stay few. Every choice of b finds
all links. Fingerprints of one key come sorted to one task, which compares them by breadth-first search over those not
reached yet and emits a spanning forest: groups of near copies cost a few passes and fewer links than members, never
all pairs. Keys with more than ``LARGE`` fingerprints are cut into parts, and each pair of parts is searched by itself.

Defined results: null text has no words, like an empty one: fingerprint zero, linked like any other. Repeated rows fall
in one group. Null ids never name a group: a group of null ids alone has a null component. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.skew import hot_bar, with_label
from citeloom.session import Scratch

SEED = 42
#: Fingerprints of one key that one task compares; above, the key is cut into parts of about this many.
LARGE = 50_000
#: Chance meetings a fingerprint may have on average before longer keys are taken.
MEETINGS = 4


def fingerprint(text: str | None, width: int = 4, seed: int = SEED) -> int:
    """Bit i is set if it is set in more than half of the hashes of the text's shingles; 0 without words."""
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - width + 1)
    last = ends[min(width, len(words)) - 1 :]
    hashes = np.fromiter((xxh64_intdigest(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), last.tolist())), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        bits = np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long)."""
    return _fingerprinted(docs, F.col(id_col).cast("long"), text_col, width).withColumnRenamed("own", "doc_id")


def _fingerprinted(docs: DataFrame, own: F.Column, text_col: str, width: int) -> DataFrame:
    """own (what tells the row), fp."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["own", "fp"])

    rows = docs.select(own.alias("own"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"own {rows.schema['own'].dataType.simpleString()}, fp bigint")


def block_layout(n: int, distance: int) -> tuple[list[int], list[tuple[int, ...]]]:
    """Block borders, and the choices of blocks that make the keys, for n distinct fingerprints."""
    for b in range(distance + 1, 65):
        share = b - distance
        bits = 64 * share // b
        choices = 1
        for i in range(share):
            choices = choices * (b - i) // (i + 1)
        if n * choices / 2.0**bits <= MEETINGS or choices > 200:
            break
    borders = [64 * i // b for i in range(b + 1)]
    return borders, list(combinations(range(b), share))


def _keys(fp: str, borders: list[int], choices: list[tuple[int, ...]]) -> F.Column:
    """An array of (choice, the bits of its blocks)."""
    masks = []
    for blocks in choices:
        mask = 0
        for i in blocks:
            mask |= ((1 << (borders[i + 1] - borders[i])) - 1) << borders[i]
        masks.append(mask - (1 << 64) if mask >> 63 else mask)
    entries = [F.struct(F.lit(i).alias("choice"), F.col(fp).bitwiseAND(F.lit(m).cast("long")).alias("bits")) for i, m in enumerate(masks)]
    return F.array(*entries)


def forest(values: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among distinct fingerprints: breadth-first, each step against the unreached only."""
    left = values
    a, b = [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= distance
            if near.any():
                found = left[near]
                a.append(np.full(len(found), at))
                b.append(found)
                queue.extend(found)
                left = left[~near]
    none = np.array([], dtype=np.uint64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links(scratch: Scratch, nodes: DataFrame, distance: int) -> DataFrame:
    """Links (a, b) among the distinct fingerprints ``nodes`` (fp) whose components are those of all links."""
    borders, choices = block_layout(nodes.count(), distance)
    keyed = nodes.select("fp", F.explode(_keys("fp", borders, choices)).alias("k")).select("fp", "k.choice", "k.bits")
    large = scratch.keep(keyed.groupBy("choice", "bits").count().where(F.col("count") > LARGE), "large_keys")
    if large.isEmpty():
        parted = keyed.select("fp", "choice", "bits", F.lit(0).alias("x"), F.lit(0).alias("y"))
    else:
        parts = large.select("choice", "bits", F.ceil(F.col("count") / LARGE).cast("int").alias("parts"))
        sized = keyed.join(parts, ["choice", "bits"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        mine = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("parts")).cast("int")
        sized = sized.withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        parted = sized.select("fp", "choice", "bits", F.least("mine", "other").alias("x"), F.greatest("mine", "other").alias("y"))
    key = ["choice", "bits", "x", "y"]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # of the key that the last batch ended in
        last: tuple | None = None

        def compared(parts: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            values = np.unique(np.concatenate(parts)) if parts else np.array([], np.uint64)
            if len(values) > 1:
                a, b = forest(values, distance)
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column(0).to_numpy().view(np.uint64)
            keys = np.stack([batch.column(i).to_numpy().astype(np.int64) for i in range(1, 5)])
            cuts = np.concatenate(([0], np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(axis=0)) + 1, [len(fp)]))
            first = tuple(keys[:, 0].tolist())
            if first != last:
                yield from compared(held)
                held = []
            held.append(fp[: cuts[1]])
            last = tuple(keys[:, -1].tolist())
            if len(cuts) > 2:
                yield from compared(held)
                held = [fp[cuts[-2] :]]
                inner = np.flatnonzero(np.diff(cuts)[1:-1] > 1) + 1
                for i in inner.tolist():
                    yield from compared([fp[cuts[i] : cuts[i + 1]]])
        yield from compared(held)

    return parted.repartition(*key).sortWithinPartitions(*key).mapInArrow(search, "a bigint, b bigint").distinct()


def components(scratch: Scratch, edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links (a, b): alternating large-star and small-star steps.

    A step moves each node's neighbours to the least of them by a min-aggregation and a join; the links become stars
    around the least node of their component in a number of steps that grows with the logarithm of their length.
    """
    edges = scratch.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct(), "links")
    before, total = None, edges.count()
    if not total:
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("v"), F.count_if(F.col("v") > F.col("u")).alias("_n")).select("u", F.least("u", "v").alias("m"), "_n")
        large = with_label(both.where("v > u"), least, "u", total).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = scratch.keep(large, "large_star")
        least_small = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n"))
        moved = with_label(large, least_small, "u", total)
        small = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").union(moved.select("u", F.col("m").alias("v"))).distinct()
        small = scratch.keep(small, "small_star")
        seen = small.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.bit_xor(F.xxhash64("v", "u", F.lit(1)))).first()
        scratch.drop(edges, large)
        edges, total = small, seen[0]
        if seen == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = seen


def _rooted(scratch: Scratch, nodes: DataFrame, distance: int) -> DataFrame:
    """nodes (one row per distinct fingerprint fp) with the root of each one's component."""
    stars = components(scratch, links(scratch, nodes.select("fp"), distance))
    return nodes.join(stars, nodes["fp"] == stars["node"], "left").withColumn("root", F.coalesce("root", "fp")).drop("node")


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the least doc_id of its group)."""
    scratch = Scratch(docs.sparkSession, "simhash")
    printed = scratch.keep(fingerprints(docs, id_col, text_col, width), "fingerprints")
    nodes = scratch.keep(printed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("copies")), "nodes")
    rooted = scratch.keep(_rooted(scratch, nodes, distance), "rooted")
    sizes = rooted.agg(F.count(F.lit(1)), F.sum("copies")).first()
    named = scratch.keep(rooted.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("_n")), "named")
    labels = with_label(rooted, named, "root", sizes[0]).select("fp", "component_id", F.col("copies").alias("_n"))
    labels = scratch.keep(labels, "labels")
    scratch.drop(nodes, rooted, named)
    return with_label(printed, labels, "fp", sizes[1] or 0).select("doc_id", "fp", "component_id")


def hex_fingerprint(fp: str = "fp") -> F.Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 4, distance: int = 4) -> DataFrame:
    """One row of each group, with the columns it came with: the row with the least id, then the least MD5 of its text.

    Rows are told apart by id and text, never by one of them alone: rows that share an id and differ in text are judged apart, rows without
    an id come after those with one. Of rows equal in both, one stays, whatever their other columns hold.
    """
    scratch = Scratch(docs.sparkSession, "keep_one")
    # a null text and an empty one are different rows
    own = F.struct(F.col(id_col).isNull().alias("no_id"), F.col(id_col).cast("long").alias("id"), F.col(text_col).isNull().alias("no_text"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("text"))
    printed = scratch.keep(_fingerprinted(docs, own, text_col, width), "printed")
    nodes = scratch.keep(printed.groupBy("fp").agg(F.min("own").alias("least")), "nodes")
    # a column that the documents do not have
    row = "_row"
    while row in docs.columns:
        row += "_"
    chosen = _rooted(scratch, nodes, distance).groupBy("root").agg(F.min("least").alias("least")).select(_row_key(F.col("least")).alias(row))
    chosen = scratch.keep(chosen, "chosen")
    repeated = printed.groupBy(_row_key(F.col("own")).alias(row)).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    repeated = scratch.keep(repeated, "repeated")
    rows = docs.withColumn(row, _row_key(own))
    # by a shuffle at every size: what is kept grows with the documents
    kept = rows.join(chosen.hint("merge"), row, "left_semi")
    if not repeated.isEmpty():
        # rows that very many others equal are at most 2,000: they are reduced where they lie
        hot = F.broadcast(repeated.where(F.col("_n") > hot_bar(printed.count())).select(row))
        kept = rows.join(hot, row, "left_anti").join(chosen.hint("merge"), row, "left_semi").dropDuplicates([row])
        kept = kept.unionByName(rows.join(F.broadcast(hot.join(chosen, row, "left_semi")), row, "left_semi").dropDuplicates([row]))
    return kept.select(*[F.col(f"`{c}`") for c in docs.columns])


def _row_key(own: F.Column) -> F.Column:
    """A row's id and text as one string."""
    return F.concat_ws("/", F.coalesce(own["id"].cast("string"), F.lit("-")), F.when(own["no_text"], "-").otherwise(own["text"]))
