"""Sections and chunks as table functions of SQL: ``SELECT * FROM citeloom_sections(TABLE(t) PARTITION BY document ORDER BY page)``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from citeloom.operators.chunking import ChunkingConfig, task_walks, word_counter
from citeloom.operators.structure import sections_of

TEXT = "text"


def _passed_on(table: AnalyzeArgument) -> list[T.StructField]:
    """The table's columns but its text."""
    if not table.isTable:
        raise ValueError("the first argument is a table: TABLE(name)")
    if TEXT not in table.dataType.names:
        raise ValueError(f"the table needs a column {TEXT}")
    return [f for f in table.dataType.fields if f.name != TEXT]


def _field(name: str, kind: T.DataType) -> T.StructField:
    return T.StructField(name, kind)


class Sections:
    """A row per section of each row's text, with the row's other columns. Within a partition rows are a document's records in order, and headings carry over."""

    @staticmethod
    def analyze(table: AnalyzeArgument) -> AnalyzeResult:
        own = [_field(n, T.IntegerType()) for n in ("section_no", "start_char", "end_char")] + [_field(n, T.StringType()) for n in ("section_type", "section_title")]
        return AnalyzeResult(T.StructType([*_passed_on(table), *own, _field("preferred_breaks", T.ArrayType(T.IntegerType()))]))

    def __init__(self) -> None:
        self.head: dict | None = None

    def eval(self, row: Row) -> Iterator[tuple]:
        if not row[TEXT] or not row[TEXT].strip():
            return
        sections, last = sections_of(row[TEXT])
        passed = [row[n] for n in row.__fields__ if n != TEXT]
        for s in sections:
            head = self.head or {"section_type": None, "title": None}
            kind, title = (s["section_type"], s["section_title"]) if s["section_no"] else (head["section_type"] or "document", head["title"])
            yield (*passed, s["section_no"], s["start_char"], s["end_char"], kind, title, s["preferred_breaks"])
        self.head = last or self.head


class Chunks:
    """A row per chunk of each row's text, by the word counter and perhaps other token limits, with the row's other columns."""

    @staticmethod
    def analyze(table: AnalyzeArgument, target: AnalyzeArgument | None = None, overlap: AnalyzeArgument | None = None, maximum: AnalyzeArgument | None = None) -> AnalyzeResult:
        _limits(*[a.value if a is not None else None for a in (target, overlap, maximum)])
        own = [_field(n, T.IntegerType()) for n in ("chunk_index", "chunk_start", "chunk_end", "token_count")]
        return AnalyzeResult(T.StructType([*_passed_on(table), *own, _field("chunk_text", T.StringType())]))

    def __init__(self) -> None:
        # made once a partition for each set of limits
        self.walk = lru_cache(lambda *limits: task_walks(word_counter, _limits(*limits))[0])

    def eval(self, row: Row, target: int | None = None, overlap: int | None = None, maximum: int | None = None) -> Iterator[tuple]:
        text = row[TEXT] or ""
        passed = [row[n] for n in row.__fields__ if n != TEXT]
        for k, (a, b, _, tokens) in enumerate(self.walk(target, overlap, maximum).spans(text, 0, len(text), [])):
            yield (*passed, k, a, b, tokens, text[a:b])


def _limits(target: int | None, overlap: int | None, maximum: int | None) -> ChunkingConfig:
    given = {"target": target, "overlap": overlap, "maximum": maximum}
    return ChunkingConfig(**{k: v for k, v in given.items() if v is not None})


def register(spark: SparkSession) -> None:
    """Makes citeloom_sections and citeloom_chunks known to a session's SQL."""
    spark.udtf.register("citeloom_sections", udtf(Sections))
    spark.udtf.register("citeloom_chunks", udtf(Chunks))
