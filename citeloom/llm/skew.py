"""Joins whose keys may be hot: a label for each of many rows, without dealing a hot key's rows to one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Labels that are broadcast, at most, and how many rows a key holds at least before its label is one of them.
MOST_HOT, FEW = 2000, 64


def hot_bar(total: int) -> int:
    """Rows that a key must exceed to be hot: at most MOST_HOT keys can, whatever the table."""
    return max(FEW, -(-total // MOST_HOT))


def with_label(rows: DataFrame, labels: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with labels on ``key``. labels has a row per key, and ``_n``: how many of the ``total`` rows hold it.

    Keys that more than one in MOST_HOT rows hold (and more than FEW) are at most MOST_HOT, whatever the table: these labels are broadcast,
    so that their rows stay where they are. All others meet by a shuffle. Rows without a label, and null keys, are left out.
    """
    bar = hot_bar(total)
    hot, cold = labels.where(F.col("_n") > bar).drop("_n"), labels.where(F.col("_n") <= bar).drop("_n")
    return rows.join(F.broadcast(hot), key).unionByName(rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))
