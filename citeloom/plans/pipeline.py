"""End-to-end plans: documents to chunks with vectors, questions to cited answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citeloom.functions.text import detect_language, text_quality
from citeloom.operators import answers, chunking, gate, index, retrieval, structure
from citeloom.session import Scratch
from citeloom.sources.settings import Settings


def chunk_records(
    records: DataFrame, *, config: chunking.ChunkingConfig = chunking.ChunkingConfig(), counter: Callable = chunking.word_counter, version: int = 1
) -> DataFrame:
    """Chunks of source records (document_id, source_format, locator_type, locator_start, locator_end, original_text, source_segments,
    language, and any metadata columns): sections, the token walk, locators, ids and the language of each chunk.

    A section that cannot be cut is one row with chunk_error. Records of a document are ordered by their first locator; record columns that a
    chunk has of its own give way to these.
    """
    given = set(records.columns)
    numbered = records.withColumn("record_no", F.col("locator_start"))
    for name, value in (("native_rtl_digit_correction_applied", F.lit(False)), ("page_number", F.lit(None).cast("int")), ("extraction_method", F.lit(None).cast("string"))):
        numbered = numbered if name in given else numbered.withColumn(name, value)
    found = structure.record_sections(numbered, document="document_id", text="original_text")
    places = [F.col(f"source_segments.{c}").alias(name) for c, name in (("start_char", "segment_starts"), ("end_char", "segment_ends"))]
    whole = numbered.select("document_id", "record_no", "original_text", "locator_start", "locator_end", *places, F.col("native_rtl_digit_correction_applied").alias("reversed_runs"))
    scratch = Scratch(records.sparkSession, "chunks")
    chunks = scratch.keep(chunking.chunk_record_sections(whole.join(found, ["document_id", "record_no"]), counter, config), "cut")
    # what records have besides their texts
    texts = ("original_text", "source_segments", "native_text", "normalized_text", "native_quality", "selected_quality", "ocr_mean_confidence", "native_rtl_digit_correction_applied", "error")
    own = {"section_type", "section_title", "chunk_start", "chunk_end", "locator_start", "locator_end", "token_count", "chunk_error", "chunk_no"}
    chunks = chunks.join(numbered.select(*[c for c in numbered.columns if c not in texts and c not in own]), ["document_id", "record_no"])
    ident = chunking.stable_chunk_id(
        F.col("document_id"), F.lit(version), F.col("source_format"), F.col("locator_type"), F.col("locator_start"), F.col("locator_end"), F.col("chunk_start"), F.col("chunk_end"), F.col("section_type"), F.col("section_title")
    )
    chunks = _document_numbers(chunks)
    language = F.when(F.col("language").isin("mixed", "unknown"), detect_language(text_quality(F.col("normalized_text")))).otherwise(F.col("language"))
    chunks = chunks.withColumn("chunk_id", ident).withColumn("language", language).withColumn("page_start", F.col("page_number")).withColumn("page_end", F.col("page_number"))
    chunks = chunks.withColumn("original_start_char", F.col("chunk_start")).withColumn("original_end_char", F.col("chunk_end")).withColumn("document_version", F.lit(version))
    chunks = chunks.withColumn("extraction_methods", F.array("extraction_method")).withColumn("tokenizer_name", F.lit(chunking.counter_name(counter))).withColumn("pipeline_version", F.lit(chunking.PIPELINE_VERSION))
    return chunks.drop("page_number", "extraction_method", "chunk_no")


def _document_numbers(chunks: DataFrame) -> DataFrame:
    """Adds chunk_index, from 0 in the document's order: the chunk's place in its record, and how many the records before hold."""
    sizes = chunks.groupBy("document_id", "record_no").agg(F.count(F.lit(1)).alias("_size"))
    shifts = structure.running_before(sizes, "document_id", "record_no", "_size", "_shift").drop("_size")
    return chunks.join(shifts, ["document_id", "record_no"]).withColumn("chunk_index", (F.col("_shift") + F.col("chunk_no")).cast("int")).drop("_shift")


def ingest(records: DataFrame, *, dimension: int = 64, **options) -> DataFrame:
    """Chunks with vectors of the hashing embedder from source records; a section that cannot be cut is an error."""
    chunks = chunk_records(records, **options)
    failed = F.when(F.col("chunk_error").isNotNull(), F.raise_error(F.col("chunk_error")).cast("string")).otherwise(F.col("chunk_id"))
    return chunks.withColumn("chunk_id", failed).drop("chunk_error").withColumn("vector", index.hash_embedding(F.col("normalized_text"), dimension))


def answer(questions: DataFrame, collection: DataFrame, settings: Settings = Settings(), filters: dict[str, str | None] | None = None, client: Callable | None = None) -> DataFrame:
    """Cited answers for questions (query_id, query, query_vector, language) from a vector table: retrieval, cap, rerank, gate,
    evidence, prompt, generation, validation. ``diagnostics`` holds the gate's signals.

    ``client`` makes a generator (answers.http_client); it is asked only for questions that the gate lets through. Without one a
    deterministic extractive generator answers.
    """
    hits = retrieval.project_hits(retrieval.dense_topk(questions.select("query_id", "query", "query_vector"), collection, k=settings.retrieve_top_k, filters=filters))
    reranked = retrieval.rerank(retrieval.diversify(hits), retrieval.lexical_overlap, settings.rerank_top_n)
    limits = gate.GateConfig(True, settings.minimum_dense_score, settings.identifier_override_score, settings.minimum_rerank_score)
    gated = gate.assess(questions.select("query_id", "query", "language"), hits, reranked, limits)
    evidence = retrieval.select_evidence(hits, reranked, n=settings.evidence_top_n, max_drop=settings.maximum_dense_drop)
    prompted = answers.prompts(questions.select("query_id", "query", "language"), answers.bounded_evidence(evidence, settings.context_characters))
    if client is None:
        prompted = prompted.withColumn("attempts", F.array(answers.extractive_attempt(F.col("evidence"), F.col("language"))))
    else:
        open_ = prompted.join(gated.where("sufficient").select("query_id"), "query_id", "left_semi")
        prompted = answers.generate(open_, client, settings.generation_retries + 1)
    return answers.assemble(gated.select("query_id", "query", "language", "sufficient", "reason", gate.diagnostics().alias("diagnostics")), prompted)
