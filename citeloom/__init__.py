"""citeloom: a Spark-native engine for citation-grounded document retrieval."""

from __future__ import annotations

__version__ = "0.1.0"
__all__ = ["Ingestion", "VectorTable", "answer", "build_session", "ingest"]
_PLACES = {"Ingestion": "plans.ingestion", "ingest": "plans.ingestion", "answer": "plans.pipeline", "VectorTable": "operators.index", "build_session": "session"}


def __getattr__(name: str):
    """The package's names, imported when they are first used."""
    if name not in _PLACES:
        raise AttributeError(name)
    from importlib import import_module

    return getattr(import_module(f"citeloom.{_PLACES[name]}"), name)
