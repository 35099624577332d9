"""Importance resampling against plain Python: whole texts, chunks of a few bytes, awkward rows."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from citeloom.llm import resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text, n):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def brute(rows, target, n, buckets, least, percent):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    source = Counter(bucket(f) for _, t in rows for f in features(t, n)[1])
    wanted = Counter(bucket(f) for t in target for f in features(t, n)[1])
    s_all, t_all = sum(source.values()), sum(wanted.values())
    gain = lambda b: math.floor(1000 * math.log((wanted[b] + 1) * (s_all + buckets) / ((source[b] + 1) * (t_all + buckets))))
    out = []
    for doc, text in rows:
        words, found = features(text, n)
        weight = sum(gain(bucket(f)) for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(able[: len(able) * percent // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


@pytest.mark.parametrize(("n", "size"), [(2, 1 << 16), (2, 7), (3, 40)])
def test_resampling_matches_plain_python(spark, docs, empty, pairs, n, size):
    target = docs.where("doc_id % 4 = 1").select(F.lit(0).alias("item_id"), "text", F.lit("x").alias("score"))
    wanted = brute(pairs, [t for d, t in pairs if d is not None and d % 4 == 1], n, 500, 20, 25)
    found = resampling.resample(docs, target, n=n, buckets=500, chunk_bytes=size)
    assert sorted((tuple(r) for r in found.collect()), key=str) == wanted
    assert found.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert resampling.resample(empty, target).count() == 0
    assert resampling.resample(docs, target.limit(0), n=n).count() == len(pairs)


@pytest.mark.parametrize("n", [1, 2, 3])
@pytest.mark.parametrize("size", [1, 5, 64])
def test_chunks_own_each_run_once(n, size):
    words = resampling.plain_words("One  two, three-four 5 six " * 9 + "é" * 90 + " end")
    cut = list(resampling.overlapping_chunks(words, n, size))
    assert b"".join(own for own, _ in cut) == words
    whole = Counter(resampling.chunk_buckets(words, b"", n, 997)[0].tolist())
    assert sum((Counter(resampling.chunk_buckets(own, carry, n, 997)[0].tolist()) for own, carry in cut), Counter()) == whole


def test_a_long_text_is_many_rows(spark):
    docs = spark.createDataFrame([(1, "alpha beta " * 4000), (2, "gamma " * 30)], "doc_id long, text string")
    chunks = resampling.chunked(docs, "doc_id", "text", 2, 1000).groupBy("doc_id").count().collect()
    assert dict(map(tuple, chunks)) == {1: 44, 2: 1}


def test_numbers_follow_the_order_with_ties(spark):
    from citeloom.llm.ranking import numbered
    from citeloom.session import Scratch

    rows = spark.range(1000).select((F.col("id") % 7).alias("score"), F.when(F.col("id") % 5 == 0, None).otherwise(F.col("id") % 11).alias("doc_id"), "id")
    found = numbered(Scratch(spark, "t"), rows, [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("id")]).orderBy("number").collect()
    assert [r.number for r in found] == list(range(1, 1001))
    keys = [(-r.score, r.doc_id is None, r.doc_id or 0, r.id) for r in found]
    assert keys == sorted(keys)


def test_repeated_rows_are_drawn_as_rows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(5, text)] * 8, "doc_id long, text string")
    found = resampling.resample(docs, docs.select("text")).collect()
    assert len(found) == 8 and sorted(r["rank"] for r in found if r["rank"]) == [1, 2]


def test_sql_gives_the_same(spark, small):
    import duckdb

    from citeloom.llm.registry import op13_importance_resampling

    held = duckdb.connect()
    for name in ("documents", "benchmark"):
        held.execute(f"CREATE VIEW {name} AS SELECT * FROM '{small}/{name}.parquet'")
    wanted = held.execute(resampling.RESAMPLING_SQL).fetchall()
    assert sorted(map(str, wanted)) == sorted(str(tuple(r)) for r in op13_importance_resampling(spark, small).collect())
