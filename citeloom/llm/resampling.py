"""Importance resampling towards a target distribution, over hashed runs of words, with long texts cut into overlapping chunks.

Words are runs of letters, digits and all characters beyond ASCII, of the text with A-Z lower-cased. Features are all runs of one to ``n`` words, hashed
into buckets. A bucket's gain is the logarithm of how much more of the target than of the documents falls in it; a document's weight is the
mean gain of its features, and Gumbel noise made from its id turns the weights into a draw without replacement.

Long texts: a text is cut at word boundaries into chunks of about ``chunk_bytes``, each with the n - 1 words that follow it. A chunk owns the runs that begin
in it, so that every run is counted once, whatever the cuts; chunks are dealt out by a hash, so that one very long text is many tasks' work, and
their counts and sums of gains are added up by document. Only one count per bucket and task leaves the first pass.

Defined results: a null or empty text, and one without words, has no features, weight 0 and a score, and is never drawn. Repeated rows count and are
drawn as rows of their own; ties go to the smaller id, null ids last (their noise is that of an empty id). An empty table gives no rows; an empty
target gives gains from its empty counts. Other columns of the input are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citeloom.llm.ranking import numbered
from citeloom.session import Scratch

CHUNK_BYTES = 1 << 16
#: What is no part of a word becomes a space; A-Z become a-z.
_PLAIN = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def plain_words(text: str | None) -> bytes:
    """The text's words in lower case, with spaces for all else."""
    return (text or "").encode().translate(_PLAIN)


def overlapping_chunks(words: bytes, n: int, size: int) -> Iterator[tuple[bytes, bytes]]:
    """(own, carry): pieces that begin and end between words, and the n - 1 words after each."""
    at = 0
    while True:
        end = words.find(b" ", at + size)
        if end < 0:
            yield words[at:], b""
            return
        carry, to = [], end
        for _ in range(n - 1):
            while to < len(words) and words[to] == 0x20:
                to += 1
            stop = words.find(b" ", to)
            stop = len(words) if stop < 0 else stop
            if stop > to:
                carry.append(words[to:stop])
            to = stop
        yield words[at:end], b" ".join(carry)
        at = end


def chunk_buckets(own: bytes, carry: bytes, n: int, buckets: int) -> tuple[np.ndarray, int]:
    """The buckets of all runs that begin in ``own``, and how many words it has."""
    words = own.split()
    n_own = len(words)
    words += carry.split()
    sums = list(map(zlib.crc32, words[:n_own]))
    found = [np.array(sums, np.int64)]
    spaced = [b" " + w for w in words]
    for k in range(1, n):
        # a run's checksum goes on from that of the run without its last word
        sums = list(map(zlib.crc32, spaced[k:], sums))
        found.append(np.array(sums, np.int64))
    return np.concatenate(found) % buckets, n_own


def chunked(docs: DataFrame, id_col: str, text_col: str, n: int, size: int) -> DataFrame:
    """row, doc_id, chunk, own, carry; every document has a chunk 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ids, held, total = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [], 0
            for row, doc, text in zip(rows, ids, batch.column(2)):
                for k, (own, carry) in enumerate(overlapping_chunks(plain_words(text.as_py()), n, size)):
                    held.append((row, doc, k, own, carry))
                    total += len(own)
                    if total > 64 << 20:
                        yield _batch(held)
                        held, total = [], 0
            if held:
                yield _batch(held)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "row bigint, doc_id bigint, chunk int, own binary, carry binary")


def _batch(held: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], ["row", "doc_id", "chunk", "own", "carry"])


def bucket_counts(chunks: DataFrame, n: int, buckets: int) -> np.ndarray:
    """How many features fall in each bucket: a row per bucket and task is shuffled, and ``buckets`` rows reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for own, carry in zip(batch.column(0), batch.column(1)):
                counts += np.bincount(chunk_buckets(own.as_py(), carry.as_py(), n, buckets)[0], minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    summed = chunks.select("own", "carry").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in summed.collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """1000 times the logarithm of the smoothed ratio of the target's to the documents' share of each bucket, rounded down."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    ratios = [(t + 1.0) * s_all / ((s + 1.0) * t_all) for s, t in zip(source.tolist(), target.tolist())]
    return np.array([math.floor(1000 * math.log(r)) for r in ratios], np.int64)


def gumbel(id_col: Column, seed: int) -> Column:
    """Standard Gumbel noise times 1000, rounded down, from a hash of the id."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit(""))), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 2, buckets: int = 10_000, least_words: int = 20, percent: int = 25, seed: int = 7, chunk_bytes: int = CHUNK_BYTES
) -> DataFrame:
    """One row per document: doc_id, n_features, weight, score, rank (from 1, by falling score; null for those not drawn)."""
    scratch = Scratch(docs.sparkSession, "resample")
    cut = chunked(docs, id_col, text_col, n, chunk_bytes)
    chunks = scratch.keep(cut.repartition("row", "chunk"), "chunks")
    wanted = bucket_counts(chunked(target.select(F.lit(None).cast("long").alias("_id"), F.col("text").alias("_text")), "_id", "_text", n, chunk_bytes), n, buckets)
    held = docs.sparkSession.sparkContext.broadcast(gains(bucket_counts(chunks, n, buckets), wanted))  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = []
            for own, carry in zip(batch.column(2), batch.column(3)):
                at, words = chunk_buckets(own.as_py(), carry.as_py(), n, buckets)
                sums.append((len(at), words, int(held.value[at].sum())))
            columns = [pa.array(c, pa.int64()) for c in (zip(*sums) if sums else ([], [], []))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["row", "doc_id", "f", "w", "g"])

    summed = chunks.select("row", "doc_id", "own", "carry").mapInArrow(run, "row bigint, doc_id bigint, f bigint, w bigint, g bigint")
    by_document = summed.groupBy("row", "doc_id").agg(F.sum("f").alias("n_features"), F.sum("w").alias("n_words"), F.sum("g").alias("_g"))
    weight = F.when(F.col("n_features") == 0, F.lit(0).cast("long")).otherwise(F.expr("(_g - pmod(_g, n_features)) div n_features"))
    scored = by_document.withColumn("weight", weight).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = scratch.keep(scored.drop("_g"), "scored")
    scratch.drop(chunks)
    able = scored.where(F.col("n_words") >= least_words)
    drawn = able.count() * percent // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    ranked = numbered(scratch, able.select("row", "doc_id", "score"), order).where(F.col("number") <= drawn)
    ranks = ranked.select(F.col("row").alias("_row"), F.col("number").alias("rank"))
    return scored.join(ranks, scored["row"] == ranks["_row"], "left").select("doc_id", "n_features", "weight", "score", "rank")


RESAMPLING_SQL = r"""
WITH RECURSIVE bytes_ AS (SELECT range AS b FROM range(256)),
step AS (SELECT list(list_reduce([b] || range(8), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) ORDER BY b) AS crc_of FROM bytes_),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
runs AS (SELECT r, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM d),
wanted AS (SELECT unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM b),
df AS (SELECT r, f, count(*) AS n FROM runs GROUP BY r, f),
bf AS (SELECT f, count(*) AS n FROM wanted GROUP BY f),
every AS (SELECT f FROM df UNION SELECT f FROM bf),
coded AS (SELECT f, xor(list_reduce([4294967295] || list_transform(range(0, strlen(f)), lambda i: CAST('0x' || substr(hex(encode(f)), 2 * i + 1, 2) AS BIGINT)), lambda c, x: xor(c // 256, crc_of[xor(c, x) % 256 + 1])), 4294967295) % 10000 AS bucket FROM every, step),
s AS (SELECT bucket, sum(n) AS s FROM df JOIN coded USING (f) GROUP BY bucket),
t AS (SELECT bucket, sum(n) AS t FROM bf JOIN coded USING (f) GROUP BY bucket),
total AS (SELECT (SELECT coalesce(sum(s), 0) FROM s) AS s_all, (SELECT coalesce(sum(t), 0) FROM t) AS t_all),
gain AS (SELECT c.bucket, CAST(floor(1000 * ln((CAST(coalesce(t, 0) AS DOUBLE) + 1) * (CAST(s_all AS DOUBLE) + 10000) / ((CAST(coalesce(s, 0) AS DOUBLE) + 1) * (CAST(t_all AS DOUBLE) + 10000)))) AS BIGINT) AS gain
  FROM (SELECT DISTINCT bucket FROM coded) c LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket), total),
sums AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_features, CAST(sum(n * gain) AS BIGINT) AS g FROM df JOIN coded USING (f) JOIN gain USING (bucket) GROUP BY r),
scored AS (SELECT d.r, doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce((g - ((g % n_features) + n_features) % n_features) // n_features, 0) AS weight,
    CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS noise FROM d LEFT JOIN sums USING (r)),
ranked AS (SELECT r, row_number() OVER (ORDER BY weight + noise DESC, doc_id NULLS LAST, r) AS rank FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= (SELECT count(*) FROM ranked) * 25 // 100 THEN rank END AS rank FROM scored LEFT JOIN ranked USING (r)
"""
