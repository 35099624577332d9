"""Bucket tables: writers that die at any step, writers at once, look-ups that read what they touch."""

from __future__ import annotations

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from citeloom.operators import buckets, index


def rows(spark, pairs):
    return spark.createDataFrame(pairs, "k string, v int")


def held(table):
    return sorted((r.k, r.v) for r in table.read().collect())


class Killed(BaseException):
    pass


@pytest.mark.parametrize("step", ["rows written", "filters written", "draft written", "number taken by a dead writer", "half a description"])
def test_a_dead_writer_leaves_a_table_that_the_next_upsert_completes(spark, tmp_path, monkeypatch, step):
    path = str(tmp_path / "t")
    buckets.BucketTable(spark, path, "k", 4).upsert(rows(spark, [("a", 1), ("b", 1)]))
    table = buckets.BucketTable(spark, path, "k", 4)

    def die(*args, **options):
        raise Killed

    with monkeypatch.context() as patched:
        if step == "rows written":
            patched.setattr(buckets, "bloom_places", die)
            patched.setattr(buckets.BucketTable, "_hashes", die)
        elif step == "filters written":
            patched.setattr(buckets.VersionLog, "publish", die)
        elif step == "draft written":
            patched.setattr(os, "link", die)
        if step in ("rows written", "filters written", "draft written"):
            with pytest.raises(Killed):
                table.upsert(rows(spark, [("b", 2), ("c", 2)]))
    if step == "number taken by a dead writer":
        (tmp_path / "t" / "_versions" / "2.json").touch()
    if step == "half a description":
        (tmp_path / "t" / "_versions" / "2.json").write_text('{"schema": nul')
    assert held(table) == [("a", 1), ("b", 1)] and table.version() == 1
    table.upsert(rows(spark, [("b", 3), ("d", 3)]))
    assert held(table) == [("a", 1), ("b", 3), ("d", 3)]
    table.vacuum(1)
    assert held(table) == [("a", 1), ("b", 3), ("d", 3)] and not list((tmp_path / "t" / "_versions").glob("*.draft"))
    named = {f.split("/")[1] for f in table.log.load(table.version())["folders"].values()}
    assert {p.name for p in (tmp_path / "t" / "data").iterdir() if not p.name.startswith(".")} == named


@pytest.mark.parametrize("same", [True, False])
def test_a_writer_that_comes_second_keeps_both(spark, tmp_path, monkeypatch, same):
    path = str(tmp_path / "t")
    make = lambda: buckets.BucketTable(spark, path, "k", 8)
    make().upsert(rows(spark, [(c, 0) for c in "abcdefgh"]))
    of = {r.k: r.b for r in rows(spark, [(c, 0) for c in "abcdefgh"]).select("k", make()._bucket().alias("b")).collect()}
    other = next(c for c in "bcdefgh" if (of[c] == of["a"]) == same)
    publish, merges = buckets.VersionLog.publish, []
    merge = buckets.BucketTable._merge

    def overtaken(self, number, description):
        monkeypatch.setattr(buckets.VersionLog, "publish", publish)
        make().upsert(rows(spark, [(other, 5)]))
        merges.clear()
        return publish(self, number, description)

    monkeypatch.setattr(buckets.VersionLog, "publish", overtaken)
    monkeypatch.setattr(buckets.BucketTable, "_merge", lambda self, *a: merges.append(a[2]) or merge(self, *a))
    make().upsert(rows(spark, [("a", 9)]))
    assert dict(held(make())) == {c: 0 for c in "abcdefgh"} | {other: 5, "a": 9}
    # only what both have changed is written again
    assert bool(merges) == same


def test_endless_rivals_end_with_an_error(spark, tmp_path, monkeypatch):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), "k", 2)
    monkeypatch.setattr(buckets, "RETRIES", 2)
    monkeypatch.setattr(buckets.VersionLog, "publish", lambda *a: False)
    with pytest.raises(RuntimeError, match="other writers"):
        table.upsert(rows(spark, [("a", 1)]))
    assert not list(Path(tmp_path, "t", "data").glob("[!.]*"))


def test_lookups_read_the_buckets_they_touch(spark, tmp_path):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), "k", 16)
    assert table.lookup(rows(spark, [("a", 1)])) is None
    table.upsert(rows(spark, [(f"k{i}", i) for i in range(400)]))
    found = table.lookup(rows(spark, [("k7", 0), ("k7", 0), ("none", 0)]))
    assert [(r.k, r.v) for r in found.collect()] == [("k7", 7)]
    own = {r.b for r in rows(spark, [("k7", 0)]).select(table._bucket().alias("b")).collect()}
    assert {f.split("_bucket=")[1].split("/")[0] for f in found.inputFiles() if "_bucket=" in f} == own
    # keys that no filter lets through read nothing
    nothing = table.lookup(rows(spark, [(f"other{i}", 0) for i in range(5)]))
    assert nothing.count() == 0 and sum("_bucket=" in f for f in nothing.inputFiles()) <= 1
    # every key that is there passes its filter
    assert table.lookup(table.read()).count() == 400
    one = table.log.load(table.version())
    table.upsert(rows(spark, [("k7", 8)]))
    two = table.log.load(table.version())
    assert sum(one["folders"][b] != f for b, f in two["folders"].items()) == 1


def test_false_answers_of_filters_are_few():
    import numpy as np

    rng = np.random.default_rng(1)
    h, g = (rng.integers(-(2**63), 2**63, 20_000) for _ in range(2))
    n = 1 << (16 * 5000 - 1).bit_length()
    bits = np.zeros(n, bool)
    bits[buckets.bloom_places(h[:5000], g[:5000], n)] = True
    assert bits[buckets.bloom_places(h[:5000], g[:5000], n)].all()
    assert bits[buckets.bloom_places(h[5000:], g[5000:], n)].all(axis=1).mean() < 0.001


def test_the_last_of_equal_keys_does_not_depend_on_arrival(spark):
    pairs = [("a", 1), ("a", 3), ("a", 2), ("b", None)]
    for given in (pairs, pairs[::-1]):
        for parts in (1, 3):
            found = buckets.last_rows(rows(spark, given).repartition(parts), "k").collect()
            assert sorted(map(tuple, found), key=str) == [("a", 3), ("b", None)]


def test_columns_may_come_later(spark, tmp_path):
    table = buckets.BucketTable(spark, str(tmp_path / "t"), "k", 2)
    table.upsert(rows(spark, [("a", 1)]))
    table.upsert(spark.createDataFrame([("b", 1.5)], "k string, w double"))
    assert sorted(map(tuple, table.read().select("k", "v", "w").collect())) == [("a", 1, None), ("b", None, 1.5)]


def test_vector_tables_check_their_dimension(spark, tmp_path):
    table = index.VectorTable(spark, str(tmp_path / "t"), 2)
    assert table.create() == 1 and table.create() == 1
    with pytest.raises(ValueError, match="no rows"):
        table.read()
    table.upsert(spark.createDataFrame([("c1", [0.0, 1.0])], "chunk_id string, vector array<double>"))
    assert table.read().count() == 1
    with pytest.raises(ValueError, match="dimension 2"):
        index.VectorTable(spark, str(tmp_path / "t"), 3).upsert(spark.createDataFrame([("c1", [0.0])], "chunk_id string, vector array<double>"))
    assert table.lookup(table.read().select(F.col("point_id"))).count() == 1
