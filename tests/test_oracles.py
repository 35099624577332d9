"""Every query with SQL gives the rows that DuckDB gives."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest

from citeloom.plans import catalog


def rows(frame):
    columns = sorted(frame.columns)
    shown = [tuple(f"{v:.6g}" if isinstance(v, float) else str(v) for v in r) for r in frame[columns].itertuples(index=False)]
    return columns, sorted(shown)


@pytest.fixture(scope="module")
def duck(small):
    held = duckdb.connect()
    for path in Path(small).glob("*.parquet"):
        held.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return held


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_sql(spark, small, duck, name):
    found = catalog.queries()[name](spark, small).toPandas()
    assert rows(found) == rows(duck.execute(catalog.oracle_sql()[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, small, name):
    assert catalog.queries()[name](spark, small).count() > 0


def test_entry_points_import_without_a_session():
    import __spark_entry__ as entry

    assert "dense_topk" in entry.queries()
    assert set(entry.oracle_sql()) <= set(entry.queries())
