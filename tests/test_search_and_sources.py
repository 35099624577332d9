"""What similarity search reads, batch rerankers, faults of chunk files by line, table functions."""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from citeloom.operators import retrieval
from citeloom.plans import sql_functions
from citeloom.sources import documents


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("c") / "t")
    rows = spark.range(600).select(
        F.col("id").cast("string").alias("chunk_id"), F.array(F.sin("id"), F.cos("id"), F.lit(0.3)).alias("vector"), F.when(F.col("id") % 2 == 0, "en").otherwise("ar").alias("language"),
        F.concat(F.lit("text of "), "id").alias("original_text"), F.lit("f").alias("source_file"),
    )
    rows.write.parquet(path)
    return spark.read.parquet(path)


def asked(spark, n):
    return spark.range(n).select(F.col("id").alias("query_id"), F.array(F.cos("id"), F.sin("id"), F.lit(0.1)).alias("query_vector"), F.lit("q").alias("query"))


def test_only_keys_and_vectors_go_to_python(spark, stored):
    found = retrieval.dense_topk(asked(spark, 5), stored, k=3, filters={"language": "en"})
    plan = found._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    narrow = [line for line in scans if "original_text" not in line]
    assert len(scans) == 2 and len(narrow) == 1 and "chunk_id:string,vector:array<double>,language:string" in narrow[0].replace("<", "<") and "EqualTo(language,en)" in narrow[0]
    rows = found.orderBy("query_id", "dense_rank_no").collect()
    assert len(rows) == 15 and all(r.original_text == f"text of {r.chunk_id}" and r.language == "en" and r.query == "q" for r in rows)


@pytest.mark.parametrize("sizes", [(2, 50), (256, 4096)])
def test_search_in_pieces_finds_the_same(spark, stored, monkeypatch, sizes):
    monkeypatch.setattr(retrieval, "QUESTIONS_AT_ONCE", sizes[0])
    monkeypatch.setattr(retrieval, "ROWS_AT_ONCE", sizes[1])
    monkeypatch.setattr(retrieval, "BROADCAST_WINNERS", sizes[0])
    found = sorted((r.query_id, r.dense_rank_no, r.chunk_id) for r in retrieval.dense_topk(asked(spark, 7), stored, k=4).collect())
    vectors = np.array([[np.sin(i), np.cos(i), 0.3] for i in range(600)])
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    for q in range(7):
        own = np.array([np.cos(q), np.sin(q), 0.1])
        best = np.argsort(-(vectors @ own), kind="stable")[:4]
        assert [c for i, _, c in found if i == q] == [str(b) for b in best]


def test_unit_rows_take_ragged_and_even_vectors():
    even = retrieval.unit_rows(pa.array([[3.0, 4.0], [0.0, 0.0]]))
    ragged = retrieval.unit_rows(pa.chunked_array([pa.array([[3.0, 4.0], None]), pa.array([[0.0, 0.0, 2.0]])]))
    assert even.tolist() == [[0.6, 0.8], [0, 0]] and ragged.tolist() == [[0.6, 0.8, 0], [0, 0, 0], [0, 0, 1]]


def test_batch_rerankers(spark):
    hits = spark.createDataFrame([(1, "c1", "q", "aaa", 0.9, 1), (1, "c2", "q", "a", 0.8, 2), (1, "c3", "q", None, 0.7, 3)], "query_id int, chunk_id string, query string, text string, score double, dense_rank_no int")
    loaded = spark.sparkContext.accumulator(0)

    def make():
        loaded.add(1)
        return lambda pairs: [-float(len(t)) for _, t in pairs]

    found = retrieval.rerank(hits.coalesce(1), retrieval.batch_model("lengths", make, size=2), n=2).orderBy("rerank_no").collect()
    assert [(r.chunk_id, r.rerank_score) for r in found] == [("c3", 0.0), ("c2", -1.0)] and loaded.value == 1
    with pytest.raises(Exception, match="gave 1 scores"):
        retrieval.rerank(hits.coalesce(1), retrieval.batch_model("short", lambda: lambda pairs: [1.0])).collect()


def chunk(**changed):
    row = {f.split()[0]: "x" if "string" in f and "array" not in f else ["native"] if "array" in f else 1 for f in documents.CHUNK_SCHEMA.split(", ")}
    return row | {"section_type": "article", "source_format": "pdf", "locator_type": "page"} | changed


@pytest.mark.parametrize(
    ("bad", "said"),
    [
        ("{broken", "no JSON object"), ("[1]", "no JSON object"), ('"text"', "no JSON object"), (json.dumps(chunk(token_count="many")), "no JSON object"), (json.dumps({k: v for k, v in chunk().items() if k != "source"}), "chunk lacks source"),
        (json.dumps({k: v for k, v in chunk().items() if k != "section_title"}), "chunk lacks section_title"), (json.dumps(chunk(language=None)), "chunk lacks language"), (json.dumps(chunk(section_type="verse")), "unknown section type verse"),
        (json.dumps(chunk(source_format="rtf")), "unknown source format rtf"), (json.dumps(chunk(locator_type="byte")), "unknown locator type byte"), (json.dumps(chunk(extraction_methods=["native", "guess"])), "unknown extraction method guess"),
    ],
)
def test_faults_name_file_and_line(spark, tmp_path, bad, said):
    fine = json.dumps(chunk(section_title=None))
    (tmp_path / "a.chunks.jsonl").write_text(fine + "\n\n" + fine + "\n")
    (tmp_path / "b.chunks.jsonl").write_text("\n".join([fine, "", fine, bad, fine]) + "\n")
    (tmp_path / "other.jsonl").write_text("{no chunk file")
    with pytest.raises(Exception, match=rf"{said}.* on line 4 of .*b\.chunks\.jsonl"):
        documents.read_chunks(spark, str(tmp_path)).collect()
    (tmp_path / "b.chunks.jsonl").unlink()
    rows = documents.read_chunks(spark, str(tmp_path)).collect()
    assert len(rows) == 2 and rows[0].extraction_methods == ["native"] and rows[0].section_title is None


def test_lines_are_numbered_over_splits(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"line {i} {'x' * (i % 50)}\n" for i in range(1, 3001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "7000")
    try:
        rows = documents.numbered_lines(spark, str(tmp_path), "*.txt")
        assert rows.rdd.getNumPartitions() > 5
        assert sorted((r.line_no, int(r.value.split()[1])) for r in rows.collect()) == [(i, i) for i in range(1, 3001)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_table_functions_check_their_arguments(spark):
    sql_functions.register(spark)
    spark.createDataFrame([(1, "one two three four")], "k int, text string").createOrReplaceTempView("some_texts")
    rows = spark.sql("SELECT k, chunk_index, chunk_text FROM citeloom_chunks(TABLE(some_texts), 5, 0, 5)").collect()
    assert [tuple(r) for r in rows] == [(1, 0, "one two"), (1, 1, "three four")]
    with pytest.raises(Exception, match="overlap"):
        spark.sql("SELECT * FROM citeloom_chunks(TABLE(some_texts), 5, 5, 5)").collect()
    with pytest.raises(Exception, match="needs a column text"):
        spark.sql("SELECT * FROM citeloom_sections(TABLE(SELECT 1 AS k))").collect()
