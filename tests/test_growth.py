"""What made queries slow or inexact on large tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from citeloom.functions import text
from citeloom.operators import index


def test_hashed_components_in_doubles(spark):
    # with these words rounding to floats moves a component across a half
    source = " ".join(f"w{i}" for i in range(2813))
    found = spark.createDataFrame([(source,)], "t string").select(index.hash_embedding(F.col("t"), double=True), index.hash_embedding(F.col("t"))).first()
    shown = [np.floor(np.array(v, np.float64) * 10000 + 0.5).tolist() for v in found]
    assert found[0] == index.word_components(source).tolist() and shown[0] != shown[1]


def test_an_expression_is_computed_once_before_python_and_once_after(spark):
    costly = F.regexp_replace("t", "[^a-zé .]+", "")
    frame = spark.createDataFrame([("CHAPTER é\n two",), (None,), ("",)] * 70, "t string")
    for compose, most in ((True, 2), (False, 1)):
        made = frame.select(text.normalize_text(costly, compose=compose).alias("n"))
        assert made._jdf.queryExecution().optimizedPlan().toString().count("[^a-zé .]+") <= most
        assert {r.n for r in made.collect()} == {"é two", None, ""}


def test_a_stream_takes_a_number_as_one_batch_however_many_files(spark):
    from citeloom.plans import catalog
    from citeloom.session import Scratch
    from citeloom.streaming import carried

    carried.use_state_store(spark)
    rows = [(f"d{d}", k, f"PART {d}\nbody\n" if k == 1 and d % 2 else "more words\n") for d in range(12) for k in (1, 2)] + [("d1", 2, None), ("d2", 1, "  ")]
    records = spark.createDataFrame(rows, "document string, record_no int, text string").repartition(6)
    scratch = Scratch(spark, "turns")
    catalog.in_turn(scratch, records, "record_no", (1, 2), carried.stream_sections, f"{scratch.base}/out")
    batches = spark.read.format("binaryFile").load(f"{scratch.base}/state/commits").where(~F.col("path").endswith(".crc")).count()
    found = spark.read.parquet(f"{scratch.base}/out").where("record_no = 2").collect()
    assert batches == 2
    assert {(r.document, r.section_title) for r in found} == {(f"d{d}", f"PART {d}" if d % 2 else None) for d in range(12)}


def test_native_pages_pass_by_the_state(spark, tmp_path):
    from citeloom.streaming import carried

    pages = spark.createDataFrame([("1", 1, "native", False), ("1", 2, "", None)], "document_id string, page_number int, native_text string, needs_ocr boolean")
    plan = carried.stream_ocr(spark.readStream.schema(pages.schema).parquet(str(tmp_path)), None)._jdf.queryExecution().logical().toString()
    assert "Union" in plan and plan.count("TransformWithState") == 1
