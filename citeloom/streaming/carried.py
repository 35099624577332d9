"""What is remembered from page to page, as state of a stream: the last heading of a document, and the language that its OCR last found."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from citeloom.operators.structure import cut_records
from citeloom.sources.documents import read_page

#: The state store that keeps values of processors.
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SECTION_ROW = "document string, record_no int, section_no int, start_char int, end_char int, section_type string, section_title string, preferred_breaks array<int>"
PAGE_ROW = "document_id string, page_number int, original_text string, extraction_method string, ocr_mean_confidence double, error string"
SECTION, PAGE = (Row(*[f.split()[0] for f in fields.split(", ")]) for fields in (SECTION_ROW, PAGE_ROW))


def use_state_store(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)


class CarriedHeadings(StatefulProcessor):
    """Headings of a document's records as they come, already cut; its last heading is kept from batch to batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "section_type string, title string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = head = self.head.get() or (None, None)
        for record, sections, last in sorted(((r.record_no, r.sections, r.last) for r in rows), key=lambda r: r[0]):
            for s in sections:
                own = (s["section_type"], s["section_title"]) if s["section_no"] else (head[0] or "document", head[1])
                yield SECTION(key[0], record, s["section_no"], s["start_char"], s["end_char"], *own, s["preferred_breaks"])
            head = (last["section_type"], last["title"]) if last else head
        if tuple(head) != tuple(before):
            self.head.update(tuple(head))

    def close(self) -> None:
        pass


class RememberedLanguage(StatefulProcessor):
    """Pages that need OCR as they come; the language that last won is tried first, also when it won in an earlier batch."""

    def __init__(self, engine: Callable[[str, int, str], tuple[str, float | None]] | None, expected: str = "auto"):
        self.engine, self.expected = engine, expected

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.language = handle.getValueState("language", "language string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        before = remembered = (self.language.get() or (None,))[0]
        for page, native, needed in sorted(((r.page_number, r.native_text, bool(r.needs_ocr)) for r in rows), key=lambda r: r[0]):
            text, method, confidence, error, remembered = read_page(key[0], page, native, needed, self.engine, self.expected, remembered)
            yield PAGE(key[0], page, text, method, None if confidence is None else float(confidence), error)
        if remembered != before:
            self.language.update((remembered,))

    def close(self) -> None:
        pass


def stream_sections(records: DataFrame) -> DataFrame:
    """SECTION_ROW of a stream of records (document, record_no, text), which must come in order of their numbers; within a batch any order will do.

    Records are cut where they lie; only sections and last headings are dealt by document.
    """
    seen = records.where(F.col("text").rlike(r"(?U)\S")).select("document", "record_no", "text")
    cut = cut_records(seen, "document", "record_no").withColumnRenamed("_head", "last")
    return cut.groupBy("document").transformWithState(statefulProcessor=CarriedHeadings(), outputStructType=SECTION_ROW, outputMode="Append", timeMode="None")


def stream_ocr(pages: DataFrame, engine: Callable[[str, int, str], tuple[str, float | None]] | None, expected: str = "auto") -> DataFrame:
    """PAGE_ROW of a stream of pages (document_id, page_number, native_text, needs_ocr), as choose_ocr reads them; pages must come in order.

    Only pages that need OCR meet the state.
    """
    needed = F.coalesce("needs_ocr", F.lit(False))
    read = pages.where(needed).groupBy("document_id").transformWithState(statefulProcessor=RememberedLanguage(engine, expected), outputStructType=PAGE_ROW, outputMode="Append", timeMode="None")
    # native text neither asks nor changes the language
    null = lambda kind: F.lit(None).cast(kind)
    native = pages.where(~needed).select("document_id", "page_number", F.col("native_text").alias("original_text"), F.lit("native").alias("extraction_method"), null("double").alias("ocr_mean_confidence"), null("string").alias("error"))
    return read.unionByName(native)
