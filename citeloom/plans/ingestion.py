"""Ingestion that finishes: files to source records, chunks and a report that is written last and alone marks a document as done.

Below one folder are source records and chunks, each in generations of files (sources/artifacts.py), and the reports: a table in buckets by artifact, whose
row names the generation that holds the artifact's rows. A run writes its generation, and then the reports as one version of their table; until that
is published readers see what was there before, and afterwards what the run has made, also where that is nothing. The reports of incoming files
are looked up by bucket and Bloom filter, so that what is stored besides is not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators import chunking, index
from citeloom.operators.buckets import BucketTable
from citeloom.plans.pipeline import chunk_records
from citeloom.session import Scratch
from citeloom.sources import artifacts, documents

LANGUAGES = ("ar", "en", "auto")
COUNTS = ("processed_records", "direct_records", "ocr_records", "failed_records", "chunks")
REPORT = (
    "status string, document struct<document_id:string,document_version:int,document_type:string,source:string,source_file:string,file_hash:string,file_size_bytes:bigint,source_format:string>, "
    "configuration struct<pipeline_version:string,expected_language:string,page_limit:int,source_format:string,tokenizer_name:string,chunking:struct<target_tokens:int,overlap_tokens:int,maximum_tokens:int>>, "
    "counts struct<processed_records:int,direct_records:int,ocr_records:int,failed_records:int,chunks:int>, outputs struct<sources:string,chunks:string,report:string>, artifact string, generation string"
)
RECORD_FIELDS = (
    "source_file", "document_id", "document_version", "file_hash", "extraction_method", "native_text", "original_text", "normalized_text", "native_quality", "selected_quality", "language", "source_format", "locator_type",
    "locator_start", "locator_end", "page_number", "source_segments", "ocr_mean_confidence", "error", "native_rtl_digit_correction_applied",
)


@dataclass(frozen=True)
class Ingestion:
    """What an ingestion is asked for. Blank metadata and numbers below one are refused."""

    expected_language: str = "auto"
    page_limit: int | None = None
    document_version: int = 1
    document_type: str = "unknown"
    source: str = "unknown"
    limits: chunking.ChunkingConfig = field(default_factory=chunking.ChunkingConfig)
    size_limit: int = documents.SIZE_LIMIT
    counter: Callable = chunking.word_counter
    reader: documents.Reader | None = None
    engine: Callable[[str, int, str], tuple[str, float | None]] | None = None

    def __post_init__(self) -> None:
        faults = {
            "the page limit must be positive": self.page_limit is None or self.page_limit > 0,
            "the document version must be positive": self.document_version > 0,
            "document type and source must not be blank": bool(self.document_type.strip() and self.source.strip()),
            f"the language must be one of {', '.join(LANGUAGES)}": self.expected_language in LANGUAGES,
        }
        failed = [text for text, fine in faults.items() if not fine]
        if failed:
            raise ValueError("; ".join(failed))

    def configuration(self) -> Column:
        """Everything that changes what ingestion gives, as the report states it."""
        held = asdict(self.limits)
        sizes = F.struct(*[F.lit(held[k]).alias(f"{k}_tokens") for k in ("target", "overlap", "maximum")])
        return F.struct(
            F.lit(chunking.PIPELINE_VERSION).alias("pipeline_version"), F.lit(self.expected_language).alias("expected_language"), F.lit(self.page_limit).cast("int").alias("page_limit"), F.col("source_format").alias("source_format"),
            F.lit(chunking.counter_name(self.counter)).alias("tokenizer_name"), sizes.alias("chunking"),
        )


def artifact(document_id: Column, page_limit: int | None) -> Column:
    """A document's artifact name, by its hash and the page limit."""
    return F.concat(F.lit("document-"), F.substring(document_id, 1, 20), F.lit("" if page_limit is None else f"-first-{page_limit}"))


def reports_table(spark: SparkSession, folder: str) -> BucketTable:
    """The reports of a folder, by artifact."""
    return BucketTable(spark, f"{folder}/reports", "artifact")


def read_reports(spark: SparkSession, folder: str, artifacts: DataFrame | None = None) -> DataFrame:
    """The reports of a folder (of ``artifacts`` only, if given), one row per artifact; ``sound`` is false for a row that lacks a part. No folder gives no rows."""
    table = reports_table(spark, folder)
    if not table.version():
        rows = None
    elif artifacts is None:
        rows = table.read()
    else:
        rows = table.lookup(artifacts)
    if rows is None:
        rows = spark.createDataFrame([], REPORT)
    sound = F.col("document.document_id").isNotNull() & F.col("configuration").isNotNull() & F.col("counts").isNotNull()
    return rows.withColumn("sound", sound)


def report_texts(spark: SparkSession, folder: str) -> DataFrame:
    """artifact, report: the sound reports as indented JSON."""
    rows = read_reports(spark, folder).where("sound")
    return rows.select("artifact", F.to_json(F.struct("status", "document", "configuration", "counts", "outputs"), {"pretty": "true", "ignoreNullFields": "false"}).alias("report"))


def decide(spark: SparkSession, files: DataFrame, folder: str, asked: Ingestion) -> DataFrame:
    """Adds artifact, the stored counts, and the decision of documents.idempotency to the rows of files. Only the reports of these files are looked up."""
    metadata = lambda version, kind, source: F.struct(version.cast("int").alias("version"), kind.alias("type"), source.alias("source"))
    wanted = metadata(F.lit(asked.document_version), F.lit(asked.document_type), F.lit(asked.source))
    named = files.withColumn("artifact", artifact(F.col("document_id"), asked.page_limit)).withColumn("configuration", asked.configuration()).withColumn("metadata", wanted)
    held = Scratch(spark, "decide").keep(read_reports(spark, folder, named.select("artifact")), "reports")
    lost = artifacts.lost_artifacts(spark, f"{folder}/sources", held).unionByName(artifacts.lost_artifacts(spark, f"{folder}/chunks", held))
    complete = held.join(lost.select("artifact").distinct().withColumn("_lost", F.lit(True)), "artifact", "left")
    manifest = complete.select(
        "artifact", "sound", "counts", F.col("document.document_id").alias("document_id"), "configuration", F.col("_lost").isNull().alias("complete"),
        metadata(F.col("document.document_version"), F.col("document.document_type"), F.col("document.source")).alias("metadata"),
    )
    decided = documents.idempotency(named, manifest).drop("configuration", "metadata")
    return decided.join(manifest.select("artifact", "counts"), "artifact", "left")


def extract(files: DataFrame, asked: Ingestion, listed: DataFrame | None = None) -> DataFrame:
    """Source records of sound files, each format by its own reader. A page limit is for PDF alone. ``listed``: the files without their bytes."""
    if asked.page_limit is not None and not (files if listed is None else listed).where("source_format != 'pdf'").isEmpty():
        raise ValueError("a page limit is for PDF files only")
    expected = asked.expected_language
    records = documents.text_records(files, expected).unionByName(documents.word_records(files, expected, asked.size_limit))
    if asked.reader:
        records = records.unionByName(documents.pdf_records(files, asked.reader, asked.engine, page_limit=asked.page_limit, expected=expected))
    return records.withColumn("document_version", F.lit(asked.document_version)).withColumn("file_hash", F.col("document_id")).withColumn("source_file", F.element_at(F.split("source_file", "/"), -1))


def record_counts(records: DataFrame) -> DataFrame:
    """How many records of each document were processed: in all, directly, by OCR, and in vain."""
    method = F.col("extraction_method")
    counts = {"processed_records": F.count(F.lit(1)), "direct_records": F.count_if(~method.isin("ocr", "failed")), "ocr_records": F.count_if(method == "ocr"), "failed_records": F.count_if(method == "failed")}
    return records.groupBy("document_id").agg(*[c.cast("int").alias(n) for n, c in counts.items()])


def with_page_names(summary: DataFrame) -> DataFrame:
    """A summary with the counts also by the names they had when records were pages."""
    older = {"processed_pages": "processed_records", "native_pages": "direct_records", "ocr_pages": "ocr_records", "failed_pages": "failed_records"}
    return summary.withColumns({name: F.col(c) for name, c in older.items()})


def ingest(spark: SparkSession, inputs: str | Sequence[str], output: str, asked: Ingestion = Ingestion()) -> DataFrame:
    """Ingests the files of folders, and single files; gives a row per file: path, document_id, artifact, status, error and the five counts.

    Status: processed, duplicate (the stored counts are given again) or failed. A file's fault fails that file and no other: its checks, its
    reader, other metadata than it was stored with, or a section that cannot be cut. Files of the same bytes are one document.
    """
    scratch, inputs = Scratch(spark, "ingest"), [inputs] if isinstance(inputs, str) else list(inputs)
    checked = scratch.keep(documents.validate(documents.scan_files(spark, *inputs), asked.size_limit, asked.reader).drop("content"), "files")
    distinct = checked.where("error IS NULL").groupBy("document_id", "source_format").agg(F.min("path").alias("path"), F.first("length").alias("length"))
    decided = scratch.keep(decide(spark, distinct, output, asked), "decided")
    work = decided.where("decision IN ('new', 'reprocess')")
    # the bytes are read again for the files that need it, not written in between
    todo = documents.scan_files(spark, *inputs).join(work.select("path"), "path", "left_semi").select("path", "source_format", "content", "document_id")
    records = scratch.keep(extract(todo, asked, work), "records")
    chunks = chunk_records(
        records.withColumn("document_type", F.lit(asked.document_type)).withColumn("source", F.lit(asked.source)), config=asked.limits, counter=asked.counter, version=asked.document_version
    )
    chunks = scratch.keep(chunks, "chunks")
    broken = chunks.where("chunk_error IS NOT NULL").groupBy("document_id").agg(F.min("chunk_error").alias("fault"))
    unread = scratch.again(records).where("source_format = 'pdf' AND page_number IS NULL").select("document_id", F.col("error").alias("fault"))
    empty = scratch.again(records).where("source_format = 'docx' AND size(source_segments) = 0").select("document_id", F.lit("Word file holds no text").alias("fault"))
    faults = scratch.keep(broken.unionByName(unread).unionByName(empty).groupBy("document_id").agg(F.min("fault").alias("fault")), "faults")
    names = work.select("document_id", "artifact").join(faults.select("document_id"), "document_id", "left_anti")
    counted = record_counts(scratch.again(records))
    cut = scratch.again(chunks).where("chunk_error IS NULL").groupBy("document_id").agg(F.count(F.lit(1)).cast("int").alias("chunks"))
    done = names.join(counted, "document_id").join(cut, "document_id", "left").withColumn("chunks", F.coalesce("chunks", F.lit(0)))
    done = scratch.keep(done, "done")
    generation = uuid.uuid4().hex
    place = scratch.again(done).select("document_id", "artifact")
    artifacts.write_generation(scratch.again(records).join(place, "document_id").select(*RECORD_FIELDS, "artifact"), f"{output}/sources", generation, ["locator_start"])
    contract = [f.split()[0] for f in documents.CHUNK_SCHEMA.split(", ")]
    artifacts.write_generation(scratch.again(chunks).where("chunk_error IS NULL").join(place, "document_id").select(*contract, "artifact"), f"{output}/chunks", generation, ["chunk_index"])
    reports_table(spark, output).upsert(_reports(scratch.again(done), work, asked).withColumn("generation", F.lit(generation)))
    of = decided.join(faults, "document_id", "left").join(scratch.again(done).drop("artifact"), "document_id", "left")
    fault = F.when(F.col("decision") == "conflict", "the document is stored with other metadata").otherwise(F.col("fault"))
    of = of.select("document_id", "artifact", F.when(fault.isNotNull(), "failed").when(F.col("decision") == "duplicate", "duplicate").otherwise("processed").alias("status"), fault.alias("fault"), *[F.coalesce(F.col(c), F.col(f"counts.{c}"), F.lit(0)).alias(c) for c in COUNTS])
    rows = scratch.again(checked).select("path", "document_id", "error").join(of, "document_id", "left")
    out = rows.select("path", "document_id", "artifact", F.coalesce("status", F.lit("failed")).alias("status"), F.coalesce("error", "fault").alias("error"), *[F.coalesce(c, F.lit(0)).alias(c) for c in COUNTS])
    return scratch.keep(out.orderBy("path"), "summary")


def _reports(done: DataFrame, work: DataFrame, asked: Ingestion) -> DataFrame:
    rows = done.join(work.select("document_id", "path", "source_format", "length"), "document_id")
    document = F.struct(
        "document_id", F.lit(asked.document_version).alias("document_version"), F.lit(asked.document_type).alias("document_type"), F.lit(asked.source).alias("source"), F.element_at(F.split("path", "/"), -1).alias("source_file"),
        F.col("document_id").alias("file_hash"), F.col("length").alias("file_size_bytes"), "source_format",
    )
    outputs = F.struct(*[F.concat(F.col("artifact"), F.lit(end)).alias(name) for name, end in (("sources", ".sources.jsonl"), ("chunks", ".chunks.jsonl"), ("report", ".ingestion.json"))])
    return rows.select(F.lit("processed").alias("status"), document.alias("document"), asked.configuration().alias("configuration"), F.struct(*COUNTS).alias("counts"), outputs.alias("outputs"), "artifact")


def stored_chunks(spark: SparkSession, output: str, wanted: DataFrame | None = None) -> DataFrame:
    """Chunks of the documents that have a sound report (of the artifacts in ``wanted`` only, if given)."""
    named = Scratch(spark, "stored").keep(read_reports(spark, output, wanted).where("sound").select("artifact", "generation"), "named")
    return artifacts.read_generations(spark, f"{output}/chunks", documents.CHUNK_SCHEMA, named).drop("artifact")


def vacuum(spark: SparkSession, output: str) -> int:
    """Removes generations that no report names any more; gives how many files' folders went. Not while a run is at work."""
    table = reports_table(spark, output)
    table.vacuum(1)
    used = read_reports(spark, output).select("generation")
    return sum(artifacts.remove_generations(spark, f"{output}/{part}", used) for part in ("sources", "chunks"))


def index_chunks(table: index.VectorTable, chunks: DataFrame, embedder: Callable[[DataFrame], DataFrame]) -> int:
    """Embeds chunks and puts them into the vector table; gives how many there are."""
    chunks = Scratch(table.spark, "index").keep(embedder(chunks), "embedded")
    table.upsert(chunks)
    return chunks.count()
