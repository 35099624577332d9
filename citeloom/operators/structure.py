"""Structure of legal documents: lines, their kinds, and sections whose heading carries over pages."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from citeloom.functions.text import normalize_text, normalized, once
from citeloom.session import Scratch

# Heading and clause patterns, matched on the normalised line.
ARABIC_SECTION = r"(?U)^(الباب|الفصل|القسم|الكتاب|الجزء)\b"
ARABIC_ARTICLE = r"(?U)^(?:المادة|مادة)\s*(?:\([^)]{1,30}\)|\S{1,30})?"
ENGLISH_SECTION = r"(?iU)^(part|chapter|section)\b"
ENGLISH_ARTICLE = r"(?iU)^article\s*(?:\([^)]{1,30}\)|[0-9A-Za-z.-]{1,30})?"
CLAUSE = r"(?U)^(?:\(?[0-9٠-٩]+\)?|[أ-يA-Za-z])\s*[-–—.):]\s+"
#: What every heading, article and clause begins with.
POSSIBLE = r"(?iU)^(?:ال[بفقكج]|الم|ماد|part|chap|sect|arti|[(0-9٠-٩]|[أ-يA-Za-z]\s*[-–—.):])"
ARABIC_TYPES = {"الباب": "part", "الكتاب": "part", "الجزء": "part", "الفصل": "chapter", "القسم": "section"}
TITLE_LIMIT = 200
#: A line with its end mark.
LINES = r"([^\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]*+(?:\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}])|[^\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]++$)"
# End of fixed values.


def line_segments(records: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """One row per line with its end mark: line_no (from 1), start, end (code points), line. Empty texts give none."""
    own = [c for c in records.columns if c != text]
    fields = "".join(f"`{c}` {records.schema[c].dataType.simpleString()}, " for c in own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [split_lines(t.as_py() or "") for t in batch.column(0)]
            counts = np.fromiter(map(len, lines), np.int64, len(lines))
            for first, last in _slices(counts):
                some, n = lines[first:last], counts[first:last]
                flat = [x for found in some for x in found]
                row, number, start, end = running_lengths(n, flat)
                columns = [c.take(pa.array(row + first)) for c in batch.columns[1:]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(flat, pa.string()), *[pa.array(v.astype(np.int32)) for v in (number + 1, end, start)]], [*own, "line", "line_no", "end", "start"])

    return records.select(text, *own).mapInArrow(run, fields + "line string, line_no int, end int, start int")


def _slices(counts: np.ndarray, most: int = 100_000) -> Iterator[tuple[int, int]]:
    """Runs of rows that together have about so many lines."""
    group = (np.cumsum(counts) - counts) // most
    borders = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(counts)]
    return zip(borders, borders[1:])


def running_lengths(counts: np.ndarray, pieces: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, number in the row, start, end) of consecutive pieces, of which each row has so many; a sum over all of them, shifted by row."""
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    upto, first = np.concatenate(([0], np.cumsum(lengths))), np.cumsum(counts) - counts
    row = np.repeat(np.arange(len(counts)), counts)
    begin = upto[first[row]]
    return row, np.arange(len(pieces)) - first[row], upto[:-1] - begin, upto[1:] - begin


def split_lines(text: str) -> list[str]:
    """A text's lines with their end marks."""
    return _plain(LINES).findall(text)


@lru_cache
def _plain(pattern: str) -> re.Pattern:
    """A pattern above as Python spells it."""
    flags, body = re.match(r"(?:\(\?(\w+)\))?(.*)", pattern, re.S).groups()
    return re.compile(re.sub(r"\\x\{(\w+)\}", lambda m: f"\\u{int(m[1], 16):04x}", body), re.I if "i" in (flags or "") else 0)


def kind_of(line: str) -> tuple[str, str | None, str | None]:
    """classify of a line that is normalised and trimmed, for code that runs inside tasks."""
    if not _plain(POSSIBLE).match(line):
        return "paragraph", None, None
    if m := _plain(ARABIC_SECTION).match(line):
        return "heading", ARABIC_TYPES.get(m[1]), line[:TITLE_LIMIT]
    if m := _plain(ARABIC_ARTICLE).match(line):
        return "article", "article", m[0].strip()[:TITLE_LIMIT]
    if m := _plain(ENGLISH_SECTION).match(line):
        return "heading", m[1].lower(), line[:TITLE_LIMIT]
    if m := _plain(ENGLISH_ARTICLE).match(line):
        return "article", "article", m[0].strip()[:TITLE_LIMIT]
    return ("clause" if _plain(CLAUSE).match(line) else "paragraph"), None, None


def classify(line: Column, compose: bool = True) -> Column:
    """struct(kind, section_type, title) of a line; the first rule that matches wins."""
    return once(F.trim(normalize_text(line, compose=compose)), classify_normalized)


def classify_normalized(text: Column) -> Column:
    """The same of a line that is normalised and trimmed. Its column is used many times: it should be one that is computed once."""
    label = F.regexp_extract(text, ARABIC_SECTION, 1)
    types = F.create_map(*[F.lit(x) for pair in ARABIC_TYPES.items() for x in pair])
    nothing = F.lit(None).cast("string")

    def of(kind: str, section: Column = nothing, title: Column = nothing) -> Column:
        return F.struct(F.lit(kind).alias("kind"), section.alias("section_type"), title.alias("title"))

    head = F.substring(text, 1, TITLE_LIMIT)
    article = lambda p: of("article", F.lit("article"), F.substring(F.trim(F.regexp_extract(text, p, 0)), 1, TITLE_LIMIT))
    return (
        F.when(text == "", of("paragraph"))
        .when(text.rlike(ARABIC_SECTION), of("heading", F.try_element_at(types, label), head))
        .when(text.rlike(ARABIC_ARTICLE), article(ARABIC_ARTICLE))
        .when(text.rlike(ENGLISH_SECTION), of("heading", F.lower(F.regexp_extract(text, ENGLISH_SECTION, 1)), head))
        .when(text.rlike(ENGLISH_ARTICLE), article(ENGLISH_ARTICLE))
        .when(text.rlike(CLAUSE), of("clause"))
        .otherwise(of("paragraph"))
    )


def detect_page(records: DataFrame, **options) -> DataFrame:
    """detect_sections by its older name."""
    return detect_sections(records, **options)


SECTIONS = "array<struct<section_no:int,start_char:int,end_char:int,section_type:string,section_title:string,preferred_breaks:array<int>>>"
HEAD = "struct<section_type:string,title:string>"


def sections_of(text: str, compose: bool = True) -> tuple[list[dict], dict | None]:
    """A record's sections, those before its first heading without a type, and its last heading. Sections of blank lines only are left out."""
    found, head, at, number = [], None, 0, 0
    new = lambda: {"section_no": number, "start_char": at, "end_char": at, "section_type": head and head["section_type"], "section_title": head and head["title"], "preferred_breaks": []}
    section, seen = new(), False
    for line in split_lines(text):
        blank = not line.strip()
        kind, section_type, title = ("paragraph", None, None) if blank else kind_of(normalized(line, compose=compose).strip())
        if kind in ("heading", "article"):
            if seen:
                found.append(section)
            head, number = {"section_type": section_type, "title": title}, number + 1
            section, seen = new(), False
        end = at + len(line)
        if kind == "clause":
            section["preferred_breaks"].append(at)
        elif blank:
            section["preferred_breaks"].append(end)
        section["end_char"], seen, at = end, seen or not blank, end
    if seen:
        found.append(section)
    return found, head


def carry_last(rows: DataFrame, document: str, order: str, value: str, name: str, block: int = 1000) -> DataFrame:
    """Adds ``name``: the last value that is not null among the earlier rows of the document, by the whole number ``order``.

    A scan in two levels: inside blocks of ``block`` numbers, and over the last values of the blocks, of which a document has that many fewer. So a document's rows
    are dealt to many tasks.
    """
    held = rows.withColumn("_block", F.floor(F.col(order) / block))
    lasts = held.where(F.col(value).isNotNull()).groupBy(document, "_block").agg(F.max_by(value, order).alias("_own"))
    every = held.select(document, "_block").distinct().join(lasts, [document, "_block"], "left")
    before = Window.partitionBy(document).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = every.withColumn("_before", F.last("_own", ignorenulls=True).over(before)).drop("_own")
    inside = Window.partitionBy(document, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = held.withColumn("_inside", F.last(value, ignorenulls=True).over(inside))
    return scanned.join(carried, [document, "_block"]).withColumn(name, F.coalesce("_inside", "_before")).drop("_block", "_inside", "_before")


def running_before(rows: DataFrame, document: str, order: str, value: str, name: str, block: int = 1000) -> DataFrame:
    """Adds ``name``: the sum of the values of the document's earlier rows, by the whole number ``order``; in two levels like carry_last."""
    held = rows.withColumn("_block", F.floor(F.col(order) / block))
    sums = held.groupBy(document, "_block").agg(F.sum(value).alias("_own"))
    before = Window.partitionBy(document).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carried = sums.withColumn("_before", F.coalesce(F.sum("_own").over(before), F.lit(0))).drop("_own")
    inside = Window.partitionBy(document, "_block").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    scanned = held.withColumn("_inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return scanned.join(carried, [document, "_block"]).withColumn(name, F.col("_before") + F.col("_inside")).drop("_block", "_inside", "_before")


def cut_records(held: DataFrame, document: str, record: str, compose: bool = True) -> DataFrame:
    """(document, record, sections, _head): each record (document, record, text) cut by itself, where it lies; its sections and its last heading."""
    kinds = [held.schema[c].dataType.simpleString() for c in (document, record)]
    section = pa.struct([("section_no", pa.int32()), ("start_char", pa.int32()), ("end_char", pa.int32()), ("section_type", pa.string()), ("section_title", pa.string()), ("preferred_breaks", pa.list_(pa.int32()))])
    head = pa.struct([("section_type", pa.string()), ("title", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sections_of(t.as_py(), compose) for t in batch.column(2)]
            columns = [pa.array([f[0] for f in found], pa.list_(section)), pa.array([f[1] for f in found], head)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], [document, record, "sections", "_head"])

    return held.mapInArrow(run, f"`{document}` {kinds[0]}, `{record}` {kinds[1]}, sections {SECTIONS}, _head {HEAD}")


def record_sections(records: DataFrame, *, document: str = "doc_id", record: str = "record_no", text: str = "text", failed: str | None = None, compose: bool = True, block: int = 1000) -> DataFrame:
    """(document, record, sections): a row per record that is not blank, with its sections in order.

    Each record is cut by itself, where it lies; only its sections and last heading are dealt by document, to carry headings to later records.
    """
    seen = F.coalesce(F.col(text).rlike(r"(?U)\S"), F.lit(False))
    held = records.where(seen & ~F.col(failed) if failed else seen).select(document, record, text)
    # read three times by the scan: written once
    cut = Scratch(records.sparkSession, "sections").keep(cut_records(held, document, record, compose), "cut")
    carried = carry_last(cut, document, record, "_head", "_carried", block)

    def filled(s: Column) -> Column:
        opened = s["section_no"] > 0
        kind = F.when(opened, s["section_type"]).otherwise(F.col("_carried.section_type"))
        title = F.when(opened, s["section_title"]).otherwise(F.col("_carried.title"))
        return F.struct(s["section_no"].alias("section_no"), s["start_char"].alias("start_char"), s["end_char"].alias("end_char"), F.coalesce(kind, F.lit("document")).alias("section_type"), title.alias("section_title"), s["preferred_breaks"].alias("preferred_breaks"))

    return carried.select(document, record, F.transform("sections", filled).alias("sections"))


def detect_sections(records: DataFrame, **options) -> DataFrame:
    """Sections (document, record, section_no, start_char, end_char, section_type, section_title, preferred_breaks); options as in record_sections.

    A heading or article line opens a section; the last heading holds for later records of the document until another comes. Failed
    and blank records give nothing and keep the heading. A section of blank lines only gives nothing.
    """
    found = record_sections(records, **options)
    return found.select(*found.columns[:2], F.inline("sections"))
