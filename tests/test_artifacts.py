"""The artifact store: two-phase writes, reruns, aborted runs, and what a run reads."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from citeloom.plans import ingestion
from citeloom.sources import artifacts

SCHEMA = "n int, text string"


def some(spark, rows):
    return spark.createDataFrame(rows, "artifact string, n int, text string")


def wanted(spark, rows):
    return spark.createDataFrame(rows, "artifact string, generation string")


def found(spark, path, rows):
    return sorted((r.artifact, r.n, r.text) for r in artifacts.read_generations(spark, path, SCHEMA, wanted(spark, rows)).collect())


def test_readers_follow_the_list(spark, tmp_path):
    path = str(tmp_path / "s")
    artifacts.write_generation(some(spark, [("a", 2, "x\ny"), ("a", 1, None), ("b", 1, "é")]), path, "g1", ["n"])
    artifacts.write_generation(some(spark, [("a", 9, "new")]), path, "g2", ["n"])
    # what a failed task has left is named nowhere
    (tmp_path / "s" / "data" / "g=g1" / "part-stray.jsonl").write_text('{"artifact":"a","n":7,"text":"stray"}\n')
    assert found(spark, path, [("a", "g1"), ("b", "g1")]) == [("a", 1, None), ("a", 2, "x\ny"), ("b", 1, "é")]
    assert found(spark, path, [("a", "g2"), ("b", "g1")]) == [("a", 9, "new"), ("b", 1, "é")]
    assert found(spark, path, [("a", "none")]) == []
    only = artifacts.read_generations(spark, path, SCHEMA, wanted(spark, [("a", "g2")]))
    assert all("g=g2" in f for f in only.inputFiles())
    lines = [line for p in (tmp_path / "s" / "data" / "g=g1").glob("part-*.jsonl") if "stray" not in p.name for line in p.read_text().splitlines() if '"a"' in line]
    assert ['"n":1' in line for line in lines] == [True, False]


def test_an_empty_generation_is_published(spark, tmp_path):
    path = str(tmp_path / "s")
    artifacts.write_generation(some(spark, []), path, "g1", ["n"])
    assert (tmp_path / "s" / "generations" / "g1.json").exists() and found(spark, path, [("a", "g1")]) == []
    assert artifacts.lost_artifacts(spark, path, wanted(spark, [("a", "g1")])).count() == 0


def test_an_aborted_write_publishes_nothing(spark, tmp_path):
    path = str(tmp_path / "s")
    artifacts.write_generation(some(spark, [("a", 1, "old")]), path, "g1", ["n"])
    broken = F.when(F.col("n") == 3, F.raise_error(F.lit("broken row")).cast("string")).otherwise(F.col("text"))
    rows = some(spark, [(f"k{i}", i, "t") for i in range(8)]).withColumn("text", broken)
    with pytest.raises(Exception, match="broken row"):
        artifacts.write_generation(rows, path, "g2", ["n"])
    assert not (tmp_path / "s" / "generations" / "g2.json").exists()
    assert found(spark, path, [("a", "g1")]) == [("a", 1, "old")]
    lost = artifacts.lost_artifacts(spark, path, wanted(spark, [("a", "g1"), ("k1", "g2")]))
    assert [tuple(r) for r in lost.select("artifact", "generation").collect()] == [("k1", "g2")]


def test_commit_and_abort_by_themselves(tmp_path):
    import pyarrow as pa

    writer = artifacts.ArtifactWriter(str(tmp_path), "g1")
    batch = pa.RecordBatch.from_pydict({"artifact": ["a", "b"], "line": ['{"artifact":"a"}', '{"artifact":"b"}']})
    one, two = writer.write(iter([batch])), writer.write(iter([batch]))
    assert writer.write(iter([])).file == "" and one.rows == 2
    writer.abort([one, None])
    assert len(list(tmp_path.glob("data/g=g1/*"))) == 2
    writer.commit([two, None])
    assert [p.name for p in (tmp_path / "generations").iterdir()] == ["g1.json"]


def test_files_that_are_gone_are_found(spark, tmp_path):
    path = str(tmp_path / "s")
    artifacts.write_generation(some(spark, [(f"k{i}", i, "t") for i in range(40)]).repartition(4), path, "g1", ["n"])
    files = sorted((tmp_path / "s" / "data" / "g=g1").glob("*.jsonl"))
    inside = {f"k{i}" for i in range(40) if f'"k{i}"' in files[0].read_text()}
    files[0].unlink()
    every = wanted(spark, [(f"k{i}", "g1") for i in range(40)])
    assert {r.artifact for r in artifacts.lost_artifacts(spark, path, every).collect()} == inside
    files[0].with_suffix(".list").unlink()
    assert artifacts.lost_artifacts(spark, path, every).count() == 40


def test_a_rerun_without_chunks_leaves_none(spark, tmp_path):
    """A page that is read as English fails as Arabic: its old chunk must not be served."""
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "p.pdf").write_bytes(b"%PDF-1.4 page")
    (folder / "n.txt").write_text("Article 1 neighbour that stays as it is, with some words")
    reader = lambda content, limit: ["Article 5 Terms of a page in English that holds enough letters to be read"]
    run = lambda language, what: {r.path.rsplit("/", 1)[1]: r for r in ingestion.ingest(spark, what, out, ingestion.Ingestion(expected_language=language, reader=reader)).collect()}
    assert run("en", [str(folder / "p.pdf"), str(folder / "n.txt")])["p.pdf"].chunks == 1
    assert ingestion.stored_chunks(spark, out).count() == 2
    again = run("ar", [str(folder / "p.pdf")])["p.pdf"]
    assert (again.status, again.chunks, again.failed_records) == ("processed", 0, 1)
    assert [r.source_format for r in ingestion.stored_chunks(spark, out).collect()] == ["txt"]
    assert run("ar", [str(folder / "p.pdf")])["p.pdf"].status == "duplicate"
    report = ingestion.report_texts(spark, out).where(F.col("artifact") == again.artifact).first().report
    assert '"status" : "processed"' in report and '"chunks" : 0' in report
    # a run that dies before its reports are published shows what was there before
    with pytest.MonkeyPatch.context() as patched:
        patched.setattr(ingestion, "_reports", lambda *a: (_ for _ in ()).throw(KeyboardInterrupt()))
        with pytest.raises(KeyboardInterrupt):
            run("en", [str(folder / "p.pdf")])
    assert [r.source_format for r in ingestion.stored_chunks(spark, out).collect()] == ["txt"]
    assert ingestion.vacuum(spark, out) >= 2 and ingestion.stored_chunks(spark, out).count() == 1


def test_decisions_read_the_reports_they_need(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(200).select(F.concat(F.lit("document-"), F.sha2(F.col("id").cast("string"), 256).substr(1, 20)).alias("artifact"), F.lit("processed").alias("status"), F.lit("g").alias("generation"))
    for f in spark.createDataFrame([], ingestion.REPORT).schema:
        rows = rows if f.name in rows.columns else rows.withColumn(f.name, F.lit(None).cast(f.dataType))
    ingestion.reports_table(spark, out).upsert(rows)
    asked = rows.limit(1).select("artifact")
    read = ingestion.read_reports(spark, out, asked)
    assert read.count() == 1
    buckets = {f.split("_bucket=")[1].split("/")[0] for f in read.inputFiles() if "_bucket=" in f}
    assert len(buckets) <= 1
    assert len({f.split("_bucket=")[1].split("/")[0] for f in ingestion.read_reports(spark, out).inputFiles()}) > 40
