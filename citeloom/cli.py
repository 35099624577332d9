"""Console programs: ``ingest`` files into a vector table, ``ask`` a question of it, ``health`` of an installation."""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable
from importlib import import_module
from urllib.error import URLError
from urllib.request import urlopen

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.answers import http_client
from citeloom.operators.chunking import ChunkingConfig
from citeloom.operators.index import VectorTable, word_embedding, hash_embedding
from citeloom.plans import ingestion, pipeline
from citeloom.session import build_session
from citeloom.sources.settings import Settings, load_settings

DIMENSION = 64


def build_indexer(spark: SparkSession, settings: Settings) -> tuple[VectorTable, Callable[[DataFrame], DataFrame]]:
    """The vector table of the settings, made if it is not there, and the embedder of its chunks."""
    table = VectorTable(spark, settings.index_path, DIMENSION)
    table.create()
    return table, lambda chunks: chunks.withColumn("vector", hash_embedding(F.col("normalized_text"), DIMENSION))


def ingest_folder(spark: SparkSession, inputs: str | list[str], output: str, settings: Settings, asked: ingestion.Ingestion = ingestion.Ingestion()) -> DataFrame:
    """Ingests folders and files and indexes the chunks of its documents, also of those that were done before; gives ingestion.ingest's rows."""
    table, embedder = build_indexer(spark, settings)
    rows = ingestion.ingest(spark, inputs, output, asked)
    wanted = rows.where("status != 'failed' AND chunks > 0").select("artifact")
    if not wanted.isEmpty():
        ingestion.index_chunks(table, ingestion.stored_chunks(spark, output, wanted), embedder)
    return rows


def ask(spark: SparkSession, question: str, settings: Settings, language: str = "mixed", filters: dict[str, str | None] | None = None, model: bool = False) -> DataFrame:
    """One answer row; ``language`` is that of the answer and filters nothing. With ``model`` the generator of the settings answers."""
    vector = [float(x) for x in word_embedding(question.strip(), DIMENSION)]
    asked = spark.createDataFrame([(1, question.strip(), vector, language)], "query_id int, query string, query_vector array<float>, language string")
    client = http_client(settings.generator_url, settings.generation_model, timeout=settings.generation_timeout, temperature=settings.temperature) if model else None
    return pipeline.answer(asked, VectorTable(spark, settings.index_path, DIMENSION).read(), settings, filters, client)


def health(spark: SparkSession, settings: Settings) -> list[tuple[str, bool, str]]:
    """(part, fine, detail): whether the vector table can be read, and whether the generator lists the model of the settings."""
    version = VectorTable(spark, settings.index_path, DIMENSION).version()
    out = [("vector table", version > 0, f"version {version}" if version else "no table")]
    try:
        with urlopen(f"{settings.generator_url}/api/tags", timeout=settings.health_timeout) as reply:
            listed = json.load(reply)["models"]
        names = {m.get(k) for m in listed for k in ("name", "model")}
        fine = settings.generation_model in names
        out.append(("generator", fine, f"{settings.generation_model} {'is listed' if fine else 'is not among the listed models'}"))
    except (URLError, OSError, ValueError, KeyError, TypeError, AttributeError) as error:
        out.append(("generator", False, f"{type(error).__name__}: {error}"))
    return out


def _named(place: str) -> Callable:
    """The function that ``module:function`` names."""
    module, _, name = place.partition(":")
    try:
        return getattr(import_module(module), name)
    except (ImportError, AttributeError, ValueError) as error:
        raise argparse.ArgumentTypeError(f"{place} cannot be imported") from error


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="citeloom")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest")
    one.add_argument("documents", nargs="+", help="folders and files")
    one.add_argument("--output", default="processed", help="folder for source records, chunks and reports")
    one.add_argument("--pdf-reader", type=_named, help="module:function that gives the pages of a PDF's bytes; without one PDF files fail")
    one.add_argument("--document-type", default="unknown")
    one.add_argument("--source", default="unknown")
    one.add_argument("--document-version", type=int, default=1)
    one.add_argument("--pages", type=int, help="first pages only (PDF)")
    one.add_argument("--language", choices=ingestion.LANGUAGES, default="auto")
    one.add_argument("--target-tokens", type=int, default=400)
    one.add_argument("--overlap-tokens", type=int, default=60)
    one.add_argument("--maximum-tokens", type=int, default=480)
    one.add_argument("--maximum-document-mb", type=int, default=100)
    two = commands.add_parser("ask")
    two.add_argument("question")
    two.add_argument("--language", choices=("ar", "en", "mixed"), default="mixed")
    two.add_argument("--document-type")
    two.add_argument("--source")
    two.add_argument("--model", action="store_true", help="answer by the generator, not by quoting")
    two.add_argument("--retrieve-top-k", type=int, default=0)
    two.add_argument("--rerank-top-n", type=int, default=0)
    commands.add_parser("health")
    return parser


def main(argv: list[str] | None = None) -> int:
    """0 if all went well, 1 if a part failed, 2 if the settings or arguments are unsound."""
    given = _parser().parse_args(argv)
    try:
        settings = load_settings()
        if given.command == "ask":
            # nought stands for the setting
            more = {k: getattr(given, k) for k in ("retrieve_top_k", "rerank_top_n") if getattr(given, k)}
            settings = Settings(**(vars(settings) | more))
        if given.command == "ingest":
            limits = ChunkingConfig(given.target_tokens, given.overlap_tokens, given.maximum_tokens)
            asked = ingestion.Ingestion(given.language, given.pages, given.document_version, given.document_type, given.source, limits, given.maximum_document_mb << 20, reader=given.pdf_reader)
    except ValueError as error:
        print(f"configuration error: {error}")
        return 2
    spark = SparkSession.getActiveSession() or build_session()
    if given.command == "ingest":
        rows = ingest_folder(spark, given.documents, given.output, settings, asked).collect()
        for row in rows:
            counts = f"{row.processed_records} records ({row.direct_records} direct, {row.ocr_records} by OCR, {row.failed_records} failed), {row.chunks} chunks"
            print(f"{row.status:9} {row.path}: {counts}" + (f"  ({row.error})" if row.error else ""))
        print(f"{len(rows)} documents, {sum(r.chunks for r in rows)} chunks, {sum(r.status == 'failed' for r in rows)} failed")
        return int(not rows or any(row.status == "failed" or row.failed_records for row in rows))
    if given.command == "ask":
        row = ask(spark, given.question, settings, given.language, {"document_type": given.document_type, "source": given.source}, given.model).first()
        print(row.answer)
        for cited, excerpt in zip(row.citations, row.excerpts):
            print(f"{cited.marker} {excerpt}")
        print(f"({row.reason}, {row.used_evidence} evidence)")
        for name, value in row.diagnostics.asDict().items():
            print(f"  {name}: {'none' if value is None else f'{value:.4f}' if isinstance(value, float) else value}")
        return 0
    found = health(spark, settings)
    for part, fine, detail in found:
        print(f"{'ok' if fine else 'failed':6} {part}: {detail}")
    return 0 if all(f for _, f, _ in found) else 1


if __name__ == "__main__":
    sys.exit(main())
