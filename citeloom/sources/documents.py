"""Document sources: files to validated rows and source records, chunk files, manifests.

Text and Word documents are read with Spark and the standard library; a PDF reader and an OCR engine are passed in.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce
from xml.etree import ElementTree

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.functions.text import language_of, normalize_text, normalized, quality_of, requires_ocr, resolve_language, text_quality
from citeloom.functions.text import needs_ocr as ocr_needed
from citeloom.operators.structure import running_lengths, split_lines

SUFFIXES = ("pdf", "docx", "txt")
SIZE_LIMIT = 100 << 20
WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"

CHUNK_SCHEMA = (
    "chunk_id string, document_id string, document_version int, chunk_index int, original_text string, normalized_text string, section_type string, section_title string, "
    "page_start int, page_end int, source_format string, locator_type string, locator_start int, locator_end int, language string, document_type string, source string, "
    "source_file string, file_hash string, extraction_methods array<string>, original_start_char int, original_end_char int, token_count int, tokenizer_name string, pipeline_version string"
)
# What the fields of a chunk may hold.
SECTION_TYPES = ("document", "part", "chapter", "section", "article")
EXTRACTION_METHODS = ("native", "ocr", "failed", "docx", "txt")
KNOWN_VALUES = {"section_type": SECTION_TYPES, "source_format": ("pdf", "docx", "txt"), "locator_type": ("page", "block", "line")}
# End of fixed values.


@dataclass
class Page:
    """A page as a PDF reader gives it. ``glyphs``: per line its characters with their horizontal places, in storage order."""

    text: str = ""
    glyphs: list[list[tuple[str, float]]] = field(default_factory=list)


#: Gives the first pages of a PDF (all for None), as Pages or as texts; raises for files that it cannot read.
Reader = Callable[[bytes, int | None], list]
OPTIONAL = ("section_title", "page_start", "page_end")


def scan_files(spark: SparkSession, *inputs: str) -> DataFrame:
    """Documents as bytes: path, source_format, length, content, document_id; order by path where order matters.

    A folder gives its text, Word and PDF files (not those of folders below); a file that is named itself comes whatever its suffix.
    Spark's file scan passes over files of no bytes."""
    system = spark.sparkContext._jvm.org.apache.hadoop.fs
    files = []
    for given in inputs:
        path = system.Path(given)
        plain = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).isFile(path)
        rows = spark.read.format("binaryFile").load(given)
        suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
        rows = rows.withColumn("source_format", suffix)
        files.append(rows if plain else rows.where(suffix.isin(*SUFFIXES)))
    return reduce(DataFrame.union, files).withColumn("document_id", F.sha2("content", 256)).drop("modificationTime")


def validate(files: DataFrame, limit: int = SIZE_LIMIT, reader: Reader | None = None) -> DataFrame:
    """Adds error: null for sound files, else the first check that fails, in the order size, form, content.

    A PDF is sound if ``reader`` gives at least a page of it; without a reader none is.
    """
    if limit <= 0:
        raise ValueError("the size limit must be positive")
    text = F.decode(F.when(F.is_valid_utf8(F.col("content")), F.col("content")), "UTF-8")
    txt = F.when(~F.is_valid_utf8(F.col("content")), "text is not UTF-8").when(text.contains("\0"), "text holds NUL").when(~text.rlike(r"(?U)\S"), "text is blank")
    pdf = F.when(F.substring("content", 1, 5) != F.lit(b"%PDF-"), "no PDF header").otherwise(_pdf_error(reader)(F.when(F.col("source_format") == "pdf", F.col("content"))) if reader else F.lit("no PDF reader is given"))
    common = F.when(~F.col("source_format").isin(*SUFFIXES), "unsupported format").when(F.col("length") == 0, "file is empty").when(F.col("length") > limit, "file is too large")
    docx = _docx_error(F.when(F.col("source_format") == "docx", F.col("content")), F.lit(limit))
    own = F.when(F.col("source_format") == "txt", txt).when(F.col("source_format") == "pdf", pdf).when(F.col("source_format") == "docx", docx)
    return files.withColumn("error", F.coalesce(common, own))


@F.pandas_udf(T.StringType())
def _docx_error(contents: pd.Series, limits: pd.Series) -> pd.Series:
    return pd.Series([None if c is None else docx_error(bytes(c), int(n)) for c, n in zip(contents, limits)], dtype=object)


def _pdf_error(reader: Reader) -> Callable[[Column], Column]:
    def fault(content: bytes) -> str | None:
        try:
            return None if reader(content, 1) else "PDF has no pages"
        except Exception as error:  # whatever a reader raises is this file's fault
            return str(error) or type(error).__name__

    @F.pandas_udf(T.StringType())
    def check(contents: pd.Series) -> pd.Series:
        return pd.Series([None if c is None or bytes(c[:5]) != b"%PDF-" else fault(bytes(c)) for c in contents], dtype=object)

    return check


def docx_error(content: bytes, limit: int) -> str | None:
    """What is wrong with a Word file: not a zip, parts missing, encrypted members, or too large when unpacked."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as held:
            members = held.infolist()
    except zipfile.BadZipFile:
        return "not a Word file"
    names = {m.filename for m in members}
    if not {"[Content_Types].xml", "word/document.xml"} <= names:
        return "Word parts are missing"
    if any(m.flag_bits & 1 for m in members):
        return "Word file is encrypted"
    if sum(m.file_size for m in members) > limit:
        return "Word file is too large when unpacked"
    return None


def docx_blocks(content: bytes, limit: int = SIZE_LIMIT) -> list[tuple[str, str]]:
    """(text, kind) of body paragraphs and table rows in order; cells are joined by tabs.

    A file that fails its checks gives none: Spark may evaluate this before it filters such files out.
    """
    if docx_error(content, limit):
        return []
    with zipfile.ZipFile(io.BytesIO(content)) as held:
        body = ElementTree.fromstring(held.read("word/document.xml")).find(f"{WORD}body")

    def text(node: ElementTree.Element) -> str:
        marks = {f"{WORD}tab": "\t", f"{WORD}br": "\n", f"{WORD}cr": "\n"}
        return "".join(x.text or "" if x.tag == f"{WORD}t" else marks.get(x.tag, "") for x in node.iter())

    out = []
    for node in body if body is not None else ():
        if node.tag == f"{WORD}p":
            out.append((text(node), "paragraph"))
        elif node.tag == f"{WORD}tbl":
            for row in node.findall(f"{WORD}tr"):
                cells = ["\n".join(text(p) for p in cell.iter(f"{WORD}p")) for cell in row.findall(f"{WORD}tc")]
                out.append(("\t".join(cells), "table_row"))
    return out


def _docx_blocks(limit: int) -> Callable[[Column], Column]:
    def blocks(content):
        try:
            return None if content is None else [{"text": t, "kind": k} for t, k in docx_blocks(bytes(content), limit)]
        except (ElementTree.ParseError, zipfile.BadZipFile, KeyError, zlib.error):  # this file's fault alone: no blocks
            return []

    @F.pandas_udf(T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("kind", T.StringType())])))
    def read(contents: pd.Series) -> pd.Series:
        return contents.map(blocks)

    return read


SEGMENTS = "array<struct<start_char:int,end_char:int,locator_start:int,locator_end:int,kind:string>>"
_SEGMENTS = T.ArrayType(T.StructType([T.StructField(n, T.IntegerType()) for n in ("start_char", "end_char", "locator_start", "locator_end")] + [T.StructField("kind", T.StringType())]))
_SEGMENT = pa.struct([("start_char", pa.int32()), ("end_char", pa.int32()), ("locator_start", pa.int32()), ("locator_end", pa.int32()), ("kind", pa.string())])


def _consecutive(pieces: list[list[str]], kinds: list[list[str]] | str) -> pa.Array:
    """Consecutive source segments of each row with running offsets and locators from 1, by one running sum over all rows."""
    counts = np.fromiter(map(len, pieces), np.int64, len(pieces))
    row, number, start, end = running_lengths(counts, [p for some in pieces for p in some])
    named = [kinds] * len(row) if isinstance(kinds, str) else [k for some in kinds for k in some]
    columns = [pa.array(v.astype(np.int32)) for v in (start, end, number + 1, number + 1)]
    segments = pa.StructArray.from_arrays([*columns, pa.array(named, pa.string())], fields=list(_SEGMENT))
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32)), segments)


@F.arrow_udf(_SEGMENTS)
def line_places(texts: pa.Array) -> pa.Array:
    """The lines of texts as source segments."""
    return _consecutive([split_lines(t or "") for t in texts.to_pylist()], "line")


@F.arrow_udf(_SEGMENTS)
def _block_places(blocks: pa.Array) -> pa.Array:
    """Blocks (text, kind), each closed by a line end, as source segments."""
    held = [b or [] for b in blocks.to_pylist()]
    return _consecutive([[x["text"] + "\n" for x in b] for b in held], [[x["kind"] for x in b] for b in held])


def _record(frame: DataFrame, method: str, locator: str, expected: str) -> DataFrame:
    return (
        frame.withColumn("extraction_method", F.lit(method))
        .withColumn("native_text", F.col("original_text"))
        .withColumn("normalized_text", normalize_text(F.col("original_text")))
        .withColumn("native_quality", text_quality(F.col("original_text")))
        .withColumn("selected_quality", text_quality(F.col("normalized_text")))
        .withColumn("language", resolve_language(F.col("selected_quality"), expected))
        .withColumn("locator_type", F.lit(locator))
        .withColumn("locator_start", F.lit(1))
        .withColumn("locator_end", F.greatest(F.size("source_segments"), F.lit(1)))
        .withColumn("page_number", F.lit(None).cast("int"))
        .withColumn("ocr_mean_confidence", F.lit(None).cast("double"))
        .withColumn("error", F.lit(None).cast("string"))
        .withColumn("native_rtl_digit_correction_applied", F.lit(False))
    )


def text_records(files: DataFrame, expected: str = "auto") -> DataFrame:
    """One source record per plain text document; the byte order mark goes, lines are the segments."""
    text = F.regexp_replace(F.decode("content", "UTF-8"), r"^\x{FEFF}", "")
    held = files.where("source_format = 'txt'").select("document_id", F.col("path").alias("source_file"), "source_format", text.alias("original_text"))
    return _record(held.withColumn("source_segments", line_places("original_text")), "txt", "line", expected)


def word_records(files: DataFrame, expected: str = "auto", limit: int = SIZE_LIMIT) -> DataFrame:
    """One source record per Word document of at most ``limit`` bytes unpacked: body paragraphs and table rows, each closed by a line end."""
    held = files.where("source_format = 'docx'").select("document_id", F.col("path").alias("source_file"), "source_format", _docx_blocks(limit)(F.when(F.col("source_format") == "docx", F.col("content"))).alias("_b"))
    line = lambda p: F.concat(p["text"], F.lit("\n"))
    held = held.withColumn("original_text", F.array_join(F.transform("_b", line), ""))
    return _record(held.withColumn("source_segments", _block_places("_b")).drop("_b"), "docx", "block", expected)


def rtl_digit_storage(glyphs: list[list[tuple[str, float]]]) -> bool:
    """Whether more neighbouring Arabic digits of a line run leftwards than rightwards."""
    digit = lambda c: "\u0660" <= c <= "\u0669" or "\u06f0" <= c <= "\u06f9"
    steps = [b[1] - a[1] for line in glyphs for a, b in zip(line, line[1:]) if digit(a[0]) and digit(b[0])]
    return sum(x < 0 for x in steps) > sum(x > 0 for x in steps)


def page_records(files: DataFrame, reader: Reader, *, page_limit: int | None = None, expected: str = "auto") -> DataFrame:
    """One row per PDF page: document_id, source_file, page_number, native_text, rtl_digits, page_error, native_quality, needs_ocr.

    ``reader`` runs on the executors. A file that it fails on is one row without a page number, with its error.
    """
    if page_limit is not None and page_limit <= 0:
        raise ValueError("the page limit must be positive")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for document, path, content in frame.itertuples(index=False):
                try:
                    pages = reader(bytes(content), page_limit)[:page_limit]
                except Exception as error:  # one file's failure is a row, not the job's end
                    rows.append((document, path, None, "", False, f"{type(error).__name__}: {error}"))
                    continue
                for number, page in enumerate(pages, 1):
                    text, glyphs = (page, []) if isinstance(page, str) else (page.text, page.glyphs)
                    rows.append((document, path, number, text, rtl_digit_storage(glyphs), None))
            yield pd.DataFrame(rows, columns=["document_id", "source_file", "page_number", "native_text", "rtl_digits", "page_error"]).astype({"page_number": "Int32"})

    fields = "document_id string, source_file string, page_number int, native_text string, rtl_digits boolean, page_error string"
    pages = files.where("source_format = 'pdf'").select("document_id", "path", "content").mapInPandas(run, fields)
    return pages.withColumn("native_quality", text_quality(F.col("native_text"))).withColumn("needs_ocr", requires_ocr(F.col("native_quality"), expected))


@dataclass(frozen=True)
class OcrSettings:
    """How pages are rendered for an engine and which of its lines count."""

    dpi: int = 220
    minimum_confidence: float = 0.35


def ocr_text(lines: list[tuple[str, float]], settings: OcrSettings = OcrSettings()) -> tuple[str, float | None]:
    """An engine's lines as text: those of too little confidence and blank ones go; and the mean confidence of the rest."""
    kept = [(t.strip(), c) for t, c in lines if c >= settings.minimum_confidence and t.strip()]
    return "\n".join(t for t, _ in kept), sum(c for _, c in kept) / len(kept) if kept else None


def line_engine(read: Callable[[str, int, str, int], list[tuple[str, float]]], settings: OcrSettings = OcrSettings()) -> Callable[[str, int, str], tuple[str, float | None]]:
    """An engine for choose_ocr from a function that reads the lines of (document, page, language) rendered at a resolution."""
    return lambda document, page, language: ocr_text(read(document, page, language, settings.dpi), settings)


def read_page(document: str, page: int, native: str | None, needed: bool, engine: Callable[[str, int, str], tuple[str, float | None]] | None, expected: str, remembered: str | None) -> tuple:
    """(text, method, confidence, error, language to remember) of one page, see choose_ocr."""
    if not needed:
        return native, "native", None, None, remembered

    def attempt(language: str) -> tuple | None:
        if engine is None:
            raise RuntimeError("no OCR engine")
        text, confidence = engine(document, page, language)
        quality = quality_of(normalized(text))
        share = quality["arabic_ratio" if language == "ar" else "latin_ratio"]
        return None if ocr_needed(quality, language) else (share, confidence or 0.0, quality["character_count"], text, confidence, language)

    try:
        if expected != "auto":
            found = [attempt(expected)]
        else:
            own = language_of(quality_of(native or ""))
            first = own if own in ("ar", "en") else remembered
            if first:
                found = [attempt(first)]
                found = found if found[0] else [attempt("en" if first == "ar" else "ar")]
            else:
                found = [attempt("ar"), attempt("en")]
        found = [f for f in found if f]
        if not found:
            raise RuntimeError("OCR text failed its quality checks")
        best = max(found, key=lambda f: f[:3])
        return best[3], "ocr", best[4], None, best[5]
    except Exception as error:  # one page's failure is a row, not the job's end
        return "", "failed", None, f"{type(error).__name__}: {error}", remembered


def choose_ocr(pages: DataFrame, engine: Callable[[str, int, str], tuple[str, float | None]] | None, expected: str = "auto") -> DataFrame:
    """Reads pages that need OCR: adds original_text, extraction_method, ocr_mean_confidence, error.

    With ``auto`` a document's pages go in order. The language of the native text, else the one that last won, is tried first, then the other;
    the first whose text passes its checks wins. Where neither is known, both are tried and the better one by script share, confidence and length
    wins of those that pass. An engine's failure, and a text that does not pass, marks the page and nothing else. ``engine`` is called with
    the document, the page and the language; without one, pages that need it fail.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema) + ", original_text string, extraction_method string, ocr_mean_confidence double, error string"

    def read(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("page_number").reset_index(drop=True)
        remembered, out = None, []
        for row in frame.itertuples(index=False):
            *found, remembered = read_page(row.document_id, row.page_number, row.native_text, row.needs_ocr, engine, expected, remembered)
            out.append(found)
        frame[["original_text", "extraction_method", "ocr_mean_confidence", "error"]] = pd.DataFrame(out, index=frame.index).values
        frame["ocr_mean_confidence"] = frame["ocr_mean_confidence"].astype(float)
        return frame

    return pages.groupBy("document_id").applyInPandas(lambda f: read(f), fields)


def pdf_records(files: DataFrame, reader: Reader, engine: Callable[[str, int, str], tuple[str, float | None]] | None = None, *, page_limit: int | None = None, expected: str = "auto") -> DataFrame:
    """One source record per PDF page. Pages of good native text go past the grouped stage that asks the engine.

    A file that cannot be read is one record without a page number, of method ``failed``.
    """
    pages = page_records(files, reader, page_limit=page_limit, expected=expected)
    native = F.col("native_text").alias("original_text"), F.lit("native").alias("extraction_method"), F.lit(None).cast("double").alias("ocr_mean_confidence"), F.lit(None).cast("string").alias("error")
    fine = pages.where("page_error IS NULL AND NOT needs_ocr").select("*", *native)
    read = choose_ocr(pages.where("page_error IS NULL AND needs_ocr"), engine, expected).unionByName(fine)
    broken = pages.where("page_error IS NOT NULL").select("*", F.lit("").alias("original_text"), F.lit("failed").alias("extraction_method"), F.lit(None).cast("double").alias("ocr_mean_confidence"), F.col("page_error").alias("error"))
    every = read.unionByName(broken)
    turned = (F.col("extraction_method") == "native") & F.col("rtl_digits")
    made = every.withColumn("native_rtl_digit_correction_applied", turned).withColumn("normalized_text", normalize_text(F.col("original_text"), F.col("native_rtl_digit_correction_applied")))
    made = made.withColumn("selected_quality", text_quality(F.col("normalized_text")))
    language = F.when(F.col("extraction_method") == "failed", resolve_language(F.col("native_quality"), expected)).otherwise(resolve_language(F.col("selected_quality"), expected))
    return made.select(
        "document_id", "source_file", F.lit("pdf").alias("source_format"), "original_text", F.array().cast(SEGMENTS).alias("source_segments"), "extraction_method", "native_text", "normalized_text", "native_quality", "selected_quality",
        language.alias("language"), F.lit("page").alias("locator_type"), F.coalesce("page_number", F.lit(1)).alias("locator_start"), F.coalesce("page_number", F.lit(1)).alias("locator_end"), "page_number", "ocr_mean_confidence", "error", "native_rtl_digit_correction_applied",
    )


def numbered_lines(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """file, line_no (from 1), value: the lines of text files, each with its number in the file.

    Spark cuts files into splits. A line's number is its place in the split, and how many lines the file's earlier splits hold: one row for each split is
    counted and summed, and no file is read by one task for its numbers.
    """
    text = spark.read.option("pathGlobFilter", pattern).text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, n = None, 0
        for batch in batches:
            places = []
            for place in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                at, n = place, n + 1 if place == at else 1
                places.append(n)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places, pa.int64())], ["value", "file", "split", "place"])

    placed = text.mapInArrow(run, "value string, file string, split bigint, place bigint")
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    sizes = text.groupBy("file", "split").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    # one row for each split
    return placed.join(F.broadcast(sizes), ["file", "split"]).select("file", (F.col("_before") + F.col("place")).alias("line_no"), "value")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Chunk files (``*.chunks.jsonl``), one object a line; blank lines are passed over.

    A line that is no JSON object, lacks a field, or holds a value that its field does not know is an error that names the file and the line.
    """
    lines = numbered_lines(spark, path, "*.chunks.jsonl").where(F.col("value").rlike(r"(?U)\S"))
    # each line is parsed once, for its fields and for the names it gives
    parsed = lines.withColumn("_names", F.json_object_keys("value")).withColumn("_c", F.from_json("value", CHUNK_SCHEMA + ", _bad string", {"columnNameOfCorruptRecord": "_bad"}))
    fields = [f.name for f in spark.createDataFrame([], CHUNK_SCHEMA).schema]
    lacks = F.array_except(F.array(*[F.lit(f) for f in fields]), F.col("_names"))
    nulls = F.filter(F.array(*[F.when(F.col(f"_c.{f}").isNull(), F.lit(f)) for f in fields if f not in OPTIONAL]), lambda n: n.isNotNull())
    unknown = F.concat_ws("; ", *[F.when(~F.col(f"_c.{f}").isin(*known), F.concat(F.lit(f"unknown {f.replace('_', ' ')} "), F.col(f"_c.{f}"))) for f, known in KNOWN_VALUES.items()])
    methods = F.array_except("_c.extraction_methods", F.array(*[F.lit(m) for m in EXTRACTION_METHODS]))
    fault = (
        F.when(F.col("_names").isNull() | F.col("_c._bad").isNotNull(), "no JSON object of a chunk")
        .when(F.size(lacks) > 0, F.concat(F.lit("chunk lacks "), F.array_join(lacks, ", ")))
        .when(F.size(nulls) > 0, F.concat(F.lit("chunk lacks "), F.array_join(nulls, ", ")))
        .when(unknown != "", unknown)
        .when(F.size(methods) > 0, F.concat(F.lit("unknown extraction method "), F.array_join(methods, ", ")))
    )
    where = F.concat(fault, F.lit(" on line "), F.col("line_no"), F.lit(" of "), F.col("file"))
    checked = F.when(fault.isNotNull(), F.raise_error(where).cast("string")).otherwise(F.col("_c.chunk_id"))
    return parsed.select(checked.alias("chunk_id"), *[F.col(f"_c.{f}").alias(f) for f in fields if f != "chunk_id"])


def idempotency(inputs: DataFrame, manifest: DataFrame, key: str = "artifact") -> DataFrame:
    """Adds decision to each input: new, reprocess, conflict or duplicate. In this order: no report: new; another configuration, a report that is not
    sound or is of another document: reprocess; other metadata: conflict; a missing artifact: reprocess.

    Both sides have the key, document_id, configuration and metadata (of any type that compares); the manifest also has sound and
    complete (all artifacts there).
    """
    kept = manifest.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in ("document_id", "configuration", "metadata", "sound", "complete")])
    decision = (
        F.when(F.col("_key").isNull(), "new")
        .when(~F.coalesce(F.col("_sound"), F.lit(False)) | ~F.col("configuration").eqNullSafe(F.col("_configuration")), "reprocess")
        .when(~F.col("document_id").eqNullSafe(F.col("_document_id")), "reprocess")
        .when(~F.col("metadata").eqNullSafe(F.col("_metadata")), "conflict")
        .when(~F.coalesce(F.col("_complete"), F.lit(False)), "reprocess")
        .otherwise("duplicate")
    )
    joined = inputs.join(kept, inputs[key] == F.col("_key"), "left")
    return joined.withColumn("decision", decision).select(*inputs.columns, "decision")
