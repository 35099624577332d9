"""Removal of byte strings that occur more than once, by merging Burrows-Wheeler transforms of shards.

Every window of ``width`` bytes has an anchor: of its runs of ``gram`` bytes the one with the least hash, the leftmost of equals. Equal windows have
equal anchors at equal places, so a window can occur twice only if its anchor does. Texts that are equal are one text with a number of copies; anchors
that occur once among the different texts go; what is left is each occurrence of the others with the ``width - gram`` bytes on both sides: a row. All
rows of an anchor have the same length and are aligned, so only suffixes that begin in the same column can be equal for ``width`` bytes.

* A shard (the rows that one task cuts out of its texts) is transformed anchor by anchor: column by column from the right, the symbols of the column in the
  order of the suffixes behind it, which is the positional Burrows-Wheeler transform of its rows. Only transforms are shuffled.
* The transforms of an anchor are merged without their texts and without sorting suffixes again: the interleave of the shards is refined from one column to
  the next by dealing the shards' symbols, in the order of the interleave so far, stably to blocks, while each shard's own place moves by its LF mapping.
  Along the way the column where neighbours first differ is kept as the least over the rows dealt between them (the common prefix). Neighbours
  that agree for ``width`` bytes are a repeated interval; each window in an interval of two or more is repeated.

An anchor with more than ``most`` occurrences does not meet in one task: its windows are counted by a 128-bit hash, in tasks dealt by that hash. That is the
exact way for what the bound leaves out, and nothing is dropped.

Matches never cross documents, strings are judged on the input, and overlapping ones all count. Defined results: a null text is empty; texts shorter
than ``width`` stay whole; of equal texts that are long enough nothing is left, in none of them; null ids and repeated rows are rows like others; an empty
table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.llm.skew import hot_bar, with_label
from citeloom.session import Scratch

WIDTH, GRAM = 200, 64
#: Occurrences of an anchor that meet in one task at most, and how many rows are merged at a time.
MOST, MERGED = 100_000, 32_768
#: Rows of a shard.
SHARD = 8_192
_BITS = 20
_BASE, _MIX = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93


# --- anchors -----------------------------------------------------------------------------------------------------------


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of every run of ``gram`` bytes (a power of two), from those of half the length."""
    out, power, size = data.astype(np.uint64) + np.uint64(1), _BASE, 1
    while size < gram:
        out = out[:-size] * np.uint64(power) + out[size:]
        power, size = power * power % (1 << 64), 2 * size
    out ^= out >> np.uint64(32)
    out *= np.uint64(_MIX)
    out ^= out >> np.uint64(29)
    return out


def sliding_least(values: np.ndarray, n: int) -> np.ndarray:
    """The least of each n neighbours."""
    size, out = 1, values
    while 2 * size <= n:
        out, size = np.minimum(out[:-size], out[size:]), 2 * size
    return np.minimum(out[: len(values) - n + 1], out[n - size :]) if size < n else out


def _crossing(ends: np.ndarray, start: int, stop: int, width: int) -> np.ndarray:
    """Which of the windows that begin in start..stop would cross the end of their text."""
    some = slice(np.searchsorted(ends, start, side="right"), np.searchsorted(ends, stop + width, side="left") + 1)
    ends_here, begins = ends[some], ends[some.start - 1 : some.start - 1 + len(ends[some])]
    over = np.zeros(stop - start + 1, np.int32)
    np.add.at(over, np.clip(np.maximum(begins, ends_here - width + 1) - start, 0, stop - start), 1)
    np.add.at(over, np.clip(ends_here - start, 0, stop - start), -1)
    return np.cumsum(over[:-1]) > 0


def anchors(data: np.ndarray, ends: np.ndarray, width: int, gram: int, piece: int = 1 << 18) -> tuple[np.ndarray, ...]:
    """(text number, place in the text, hash, first column, last column) of the anchors of texts that lie behind each other in ``data``.

    Column c of an anchor's row is the window that begins ``width - gram - c`` bytes before the anchor. ``ends`` begins with 0.
    """
    none = np.zeros(0, np.int64)
    windows = len(data) - width + 1
    if windows <= 0:
        return none, none, none, none, none
    reach = width - gram
    found = []
    for start in range(0, windows, piece):
        stop = min(windows, start + piece)
        hashes = gram_hashes(data[start : stop + width - 1], gram)
        low = np.uint64((1 << _BITS) - 1)
        least = sliding_least((hashes & ~low) | np.arange(len(hashes), dtype=np.uint64), reach + 1)
        at = (least & low).astype(np.int64)
        at[_crossing(ends, start, stop, width)] = -1
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        last = np.concatenate((first[1:], [len(at)])) - 1
        kept = at[first] >= 0
        first, last = first[kept], last[kept]
        place = at[first]
        found.append((place + start, hashes[place].view(np.int64), first - place + reach, last - place + reach))
    place, hashes, low_column, high_column = (np.concatenate(c) for c in zip(*found))
    text = np.searchsorted(ends, place, side="right") - 1
    return text, place - ends[text], hashes, low_column, high_column


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column behind each other, and where each ends (from 0)."""
    raw = [t.encode() for t in texts.to_pylist()]
    ends = np.concatenate(([0], np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)))))
    return np.frombuffer(b"".join(raw), np.uint8), ends


def _parts(batch: pa.RecordBatch, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows with about so many bytes of text (column 1)."""
    upto = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False).astype(np.int64))
    borders = [0, *(np.flatnonzero(np.diff(upto // size)) + 1).tolist(), batch.num_rows]
    return (batch.slice(a, b - a) for a, b in zip(borders, borders[1:]) if b > a)


def _anchor_rows(texts: DataFrame, width: int, gram: int) -> DataFrame:
    """tid, h, at (place, first and last column in one number)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            data, ends = text_bytes(batch.column(1))
            text, place, hashes, low, high = anchors(data, ends, width, gram)
            ids = batch.column(0).to_numpy()[text]
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(hashes), pa.array((place << 16) | (low << 8) | high)], ["tid", "h", "at"])

    return texts.mapInArrow(run, "tid bigint, h bigint, at bigint")


# --- transforms ---------------------------------------------------------------------------------------------------------


def dealt(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    """Stable order by symbol inside blocks (``first`` marks where they begin): which places change hands, and whose row each takes. None: no block moves."""
    falls = (symbols[1:] < symbols[:-1]) & ~first[1:]
    if not falls.any():
        return None
    block = np.cumsum(first) - 1
    moves = np.zeros(block[-1] + 1, bool)
    moves[block[1:][falls]] = True
    at = np.flatnonzero(moves[block])
    return at, at[np.argsort((block[at] << 8) | symbols[at], kind="stable")]


def transform(rows: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each block's positional transform, one column of symbols after the other: column c in the order of the suffixes from c + 1."""
    out, order = np.empty(rows.shape[::-1], np.uint8), np.arange(len(rows))
    for column in range(rows.shape[1] - 1, -1, -1):
        out[column] = rows[order, column]
        moved = dealt(out[column], first)
        if moved:
            order[moved[0]] = order[moved[1]]
    return out


def repeated_windows(symbols: np.ndarray, shard_first: np.ndarray, anchor_first: np.ndarray, low: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    """(column, row): whether the row's window from that column occurs in another row of its anchor.

    ``symbols`` holds the shards' transforms beside each other, those of an anchor together. ``low`` and ``high``: the columns in which a row has windows of
    its own; windows outside belong to other anchors, or cross the text's end.
    """
    columns, n = symbols.shape
    reach = columns - width
    marks = np.zeros((reach + 1, n), bool)
    # of each merged place: its row's place in the shard's own order; of each such place: the row
    own, row = np.arange(n), np.arange(n)
    first, differ = anchor_first.copy(), np.full(n, columns, np.int32)
    for column in range(columns - 1, -1, -1):
        # the interleave at the next column reads the shards' symbols in turn
        dealt_symbols = symbols[column][own]
        own_order = dealt(symbols[column], shard_first)
        if own_order:
            to = np.arange(n)
            to[own_order[1]] = own_order[0]  # the LF mapping
            row[own_order[0]] = row[own_order[1]]
            own = to[own]
        moved = dealt(dealt_symbols, first)
        if moved:
            at, source = moved
            place = np.arange(len(own))
            place[at] = source
            own, dealt_symbols = own[place], dealt_symbols[place]
            inner = at[~first[at]]
            before, here = place[inner - 1], place[inner]
            fresh = differ[here]  # neighbours that were neighbours
            apart = np.flatnonzero((here > before + 1) & (dealt_symbols[inner] == dealt_symbols[inner - 1]))
            if len(apart):
                spans = np.stack((before[apart] + 1, here[apart] + 1), axis=1).ravel()
                fresh[apart] = np.minimum.reduceat(np.append(differ, columns), spans)[::2]
            differ[inner] = fresh
        unlike = np.concatenate(([False], dealt_symbols[1:] != dealt_symbols[:-1]))
        differ[unlike] = column
        if column < width:
            # no window further left is equal over this column
            first |= unlike
        if column <= reach:
            found = row[own]
            valid = (low[found] <= column) & (column <= high[found])
            interval = np.cumsum(first | (differ < column + width)) - 1
            often = np.bincount(interval[valid], minlength=len(own)) >= 2
            marks[column, found[valid & often[interval]]] = True
        if column < width and column % 16 == 0:
            # rows alone in their block can repeat nothing any more
            alone = first & np.append(first[1:], True)
            if alone.any():
                kept = ~alone
                own, first, differ = own[kept], first[kept], differ[kept]
                if not len(own):
                    break
    return marks


def _shards(found: DataFrame, width: int, gram: int) -> DataFrame:
    """found: tid, text, marks (h, at). One row per anchor and shard: its transform, and its rows' texts and places."""
    reach = width - gram
    columns = width + reach

    def shard(data: np.ndarray, ends: np.ndarray, text: np.ndarray, ids: np.ndarray, h: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(h, kind="stable")
        text, ids, h, at = text[order], ids[order], h[order], at[order]
        places = (ends[text] + (at >> 16) - reach)[:, None] + np.arange(columns)
        rows = data[np.clip(places, 0, len(data) - 1)]
        rows[(places < ends[text][:, None]) | (places >= ends[text + 1][:, None])] = 0
        first = np.concatenate(([True], h[1:] != h[:-1]))
        begins = np.append(np.flatnonzero(first), len(h))
        several = np.diff(begins) > 1
        out = rows.reshape(-1)
        if several.any():
            inside = np.repeat(several, np.diff(begins))
            held, at_held = transform(rows[inside], first[inside]), 0
            for a, b in zip(begins[:-1][several].tolist(), begins[1:][several].tolist()):
                out[a * columns : b * columns] = held[:, at_held : at_held + b - a].ravel()
                at_held += b - a
        offsets = pa.array(begins, pa.int32())
        blobs = pa.Array.from_buffers(pa.binary(), len(begins) - 1, [None, pa.py_buffer((begins * columns).astype(np.int32).tobytes()), pa.py_buffer(out.tobytes())])
        lists = [pa.ListArray.from_arrays(offsets, pa.array(v)) for v in (ids, at)]
        return pa.RecordBatch.from_arrays([pa.array(h[begins[:-1]]), blobs, *lists], ["h", "transform", "tids", "ats"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in _parts(whole)):
            data, ends = text_bytes(batch.column(1))
            marks = batch.column(2)
            text = np.repeat(np.arange(batch.num_rows), np.diff(marks.offsets.to_numpy()))
            ids = batch.column(0).to_numpy()[text]
            h, at = (marks.flatten().field(k).to_numpy() for k in (0, 1))
            for k in range(0, len(h), SHARD):
                some = slice(k, k + SHARD)
                yield shard(data, ends, text[some], ids[some], h[some], at[some])

    return found.select("tid", "text", "marks").mapInArrow(run, "h bigint, transform binary, tids array<bigint>, ats array<bigint>")


def _merged(shards: DataFrame, width: int, gram: int) -> DataFrame:
    """tid, a, b: bytes of a text that repeated windows cover."""
    reach = width - gram
    columns = width + reach

    def merge(batch: pa.Table) -> pa.RecordBatch:
        h = batch.column("h").to_numpy()
        lists = batch.column("tids").combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        ids, at = lists.flatten().to_numpy(), batch.column("ats").combine_chunks().flatten().to_numpy()
        begins = np.concatenate(([0], np.cumsum(sizes)))
        symbols = np.empty((columns, begins[-1]), np.uint8)
        blobs = batch.column("transform").to_pylist()
        one = np.flatnonzero(sizes == 1)
        symbols[:, begins[:-1][one]] = np.frombuffer(b"".join([blobs[i] for i in one.tolist()]), np.uint8).reshape(len(one), columns).T
        for i in np.flatnonzero(sizes > 1).tolist():
            symbols[:, begins[i] : begins[i + 1]] = np.frombuffer(blobs[i], np.uint8).reshape(columns, -1)
        shard_first = np.zeros(begins[-1], bool)
        shard_first[begins[:-1]] = True
        anchor_first = shard_first.copy()
        anchor_first[begins[1:-1][h[1:] == h[:-1]]] = False
        marks = repeated_windows(symbols, shard_first, anchor_first, (at >> 8) & 255, at & 255, width)
        edges = np.diff(np.pad(marks.T.astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, start), (_, stop) = np.nonzero(edges == 1), np.nonzero(edges == -1)
        begin = (at[row] >> 16) - reach
        return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(begin + start), pa.array(begin + stop - 1 + width)], ["tid", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            h, sizes = batch.column(0).to_numpy(), np.diff(batch.column(2).offsets.to_numpy())
            start = 0
            # cut where an anchor ends and enough rows are held
            ends = np.append(np.flatnonzero(h[1:] != h[:-1]) + 1, len(h))
            total = np.concatenate(([0], np.cumsum(sizes)))
            if held and held[-1].column(0)[-1].as_py() != h[0] and rows >= MERGED:
                yield merge(pa.Table.from_batches(held))
                held, rows = [], 0
            for end in ends.tolist():
                if end < len(h) and rows + total[end] - total[start] >= MERGED:
                    yield merge(pa.Table.from_batches([*held, batch.slice(start, end - start)]))
                    held, rows, start = [], 0, end
            held.append(batch.slice(start))
            rows += int(total[-1] - total[start])
        if held:
            yield merge(pa.Table.from_batches(held))

    return shards.repartition("h").sortWithinPartitions("h").mapInArrow(run, "tid bigint, a bigint, b bigint")


# --- anchors that occur very often ----------------------------------------------------------------------------------------


def _windows(found: DataFrame, width: int, gram: int) -> DataFrame:
    """window (128-bit hash), tid, a: the windows of each occurrence in marks."""
    reach = width - gram

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest

        for batch in batches:
            for tid, text, marks in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
                raw = text.as_py().encode()
                starts = [(m["at"] >> 16) - reach + c for m in marks for c in range((m["at"] >> 8) & 255, (m["at"] & 255) + 1)]
                hashes = [xxh3_128_digest(raw[s : s + width]) for s in starts]
                yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), pa.array([tid] * len(starts), pa.int64()), pa.array(starts, pa.int64())], ["window", "tid", "a"])

    return found.select("tid", "text", "marks").mapInArrow(run, "window binary, tid bigint, a bigint")


def _counted(scratch: Scratch, found: DataFrame, width: int, gram: int) -> DataFrame:
    windows = scratch.keep(_windows(found, width, gram), "windows")
    often = windows.groupBy("window").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    covered = with_label(windows, often, "window", windows.count())
    return covered.select("tid", "a", (F.col("a") + width).alias("b"))


# --- documents -----------------------------------------------------------------------------------------------------------


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of spans as maximal runs in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def repeated_spans(scratch: Scratch, texts: DataFrame, width: int, gram: int, most: int) -> DataFrame:
    """tid, a, b: bytes of the different texts (tid, text) that are part of a string of ``width`` bytes found twice among them; spans may overlap."""
    long_ones = texts.where(F.octet_length("text") >= width).select("tid", "text")
    rows = scratch.keep(_anchor_rows(long_ones, width, gram), "anchors")
    often = scratch.keep(rows.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "often")
    marked = rows.join(often, "h")
    gather = lambda some: texts.select("tid", "text").join(some.groupBy("tid").agg(F.collect_list(F.struct("h", "at")).alias("marks")), "tid")
    spans = scratch.keep(_merged(_shards(gather(marked.where(F.col("n") <= most)), width, gram), width, gram), "spans")
    if not often.where(F.col("n") > most).isEmpty():
        spans = spans.unionByName(scratch.keep(_counted(scratch, gather(marked.where(F.col("n") > most)), width, gram), "more_spans"))
    scratch.drop(rows, often)
    return spans


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, gram: int = GRAM, most: int = MOST, with_text: bool = False) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256; ``kept`` (bytes) if ``with_text``."""
    if gram & (gram - 1) or not 0 < gram <= width <= gram + 254:
        raise ValueError("gram must be a power of two, at most width and at least width - 254")
    scratch = Scratch(docs.sparkSession, "repeats")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text")).withColumn("key", F.sha2("text", 256))
    texts = source.groupBy("key").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    texts = scratch.keep(texts.withColumn("tid", F.monotonically_increasing_id()), "texts", compression="zstd")
    spans = repeated_spans(scratch, texts, width, gram, most)
    # of texts that occur twice nothing is left; the others are cut
    whole = texts.where((F.col("copies") > 1) & (F.octet_length("text") >= width))
    gone = whole.select("key", F.octet_length("text").cast("long").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("sha"), F.lit(b"").alias("kept"), F.col("copies").alias("_n"))
    found = texts.where("copies = 1").join(spans.groupBy("tid").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "tid")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, held, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                raw, at, parts = held.as_py().encode(), 0, []
                runs = covered([(s["a"], s["b"]) for s in spans.as_py()])
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                kept = b"".join([*parts, raw[at:]])
                out.append((key, len(raw) - len(kept), len(runs), hashlib.sha256(kept).hexdigest(), kept if with_text else b""))
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out), kinds)] if out else [pa.array([], t) for t in kinds]
            yield pa.RecordBatch.from_arrays(columns, ["key", "n_removed", "n_spans", "sha", "kept"])

    changed = found.select("key", "text", "spans").mapInArrow(cut, "key string, n_removed bigint, n_spans bigint, sha string, kept binary")
    results = scratch.keep(gone.unionByName(changed.withColumn("_n", F.lit(1).cast("long"))), "results")
    total = texts.agg(F.sum("copies")).first()[0] or 0
    hot, rest = results.where(F.col("_n") > hot_bar(total)).drop("_n"), results.where(F.col("_n") <= hot_bar(total)).drop("_n")
    rows = source.select("doc_id", "key", F.octet_length("text").cast("long").alias("n_bytes"), *([F.encode("text", "UTF-8").alias("raw")] if with_text else []))
    # results of texts with very many copies are at most 2,000 rows without text
    joined = rows.join(F.broadcast(hot), "key").unionByName(rows.join(F.broadcast(hot.select("key")), "key", "left_anti").join(rest, "key", "left"))
    filled = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("n_removed", "n_spans")]
    return joined.select("doc_id", "n_bytes", *filled, F.coalesce("sha", "key").alias("kept_sha256"), *([F.coalesce("kept", "raw").alias("kept")] if with_text else []))


REPEATS_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
p AS (SELECT r, n, k, substr(x, 2000 * k + 1, 2398) AS y FROM (SELECT r, n, x, unnest(range(0, (n - 200) // 1000 + 1)) AS k FROM d WHERE n >= 200)),
w AS (SELECT r, 1000 * k + j AS i, md5(substr(y, 2 * j + 1, 400)) AS h FROM (SELECT r, k, y, unnest(range(0, least(1000, n - 199 - 1000 * k))) AS j FROM p)),
often AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
s AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 0 ELSE 1 END AS opens FROM w WHERE h IN (SELECT h FROM often)),
g AS (SELECT r, i, sum(opens) OVER (PARTITION BY r ORDER BY i) AS run FROM s),
runs AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY r, run),
parts AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS since FROM runs),
cut AS (SELECT r, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, max(b) AS upto, string_agg(substr(x, 2 * since + 1, 2 * (a - since)), '' ORDER BY a) AS kept FROM parts JOIN d USING (r) GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept || substr(x, 2 * upto + 1), x))) AS kept_sha256 FROM d LEFT JOIN cut USING (r)
"""
