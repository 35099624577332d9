"""Artifact rows in generations, written in two phases: tasks write files and report them, the commit publishes the list, readers follow it."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from citeloom.session import hadoop_json, hadoop_missing

FORMAT = "citeloom_artifacts"


@dataclass
class Written(WriterCommitMessage):
    """A task's file, without folder, and how many rows and artifacts it holds; no name for a task without rows."""

    file: str
    rows: int
    artifacts: int


class ArtifactFiles(DataSource):
    """Sink for rows (artifact, line): ``path`` names the store, ``generation`` the run. Each task writes one file of lines and, beside it, a list of its
    artifacts; only ``commit`` names the files. What failed or repeated tasks have written is named nowhere."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "artifact string, line string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return ArtifactWriter(self.options["path"], self.options["generation"])


class ArtifactWriter(DataSourceArrowWriter):
    def __init__(self, path: str, generation: str):
        self.path, self.generation = path.rstrip("/"), generation

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def _files(self, file: str) -> tuple[str, str]:
        return f"data/g={self.generation}/{file}.jsonl", f"data/g={self.generation}/{file}.list"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, root = self._open()
        file, out, rows = f"part-{uuid.uuid4().hex}", None, 0
        counts: dict[str, int] = {}
        for batch in batches:
            if batch.num_rows and out is None:
                system.create_dir(f"{root}/data/g={self.generation}", recursive=True)
                out = system.open_output_stream(f"{root}/{self._files(file)[0]}")
            for artifact, line in zip(batch.column(0).to_pylist(), batch.column(1)):
                out.write(line.as_py().encode() + b"\n")
                counts[artifact] = counts.get(artifact, 0) + 1
                rows += 1
        if out is None:
            return Written("", 0, 0)
        out.close()
        with system.open_output_stream(f"{root}/{self._files(file)[1]}") as listed:
            for artifact, n in counts.items():
                listed.write(json.dumps({"artifact": artifact, "rows": n}).encode() + b"\n")
        return Written(file, rows, len(counts))

    def commit(self, messages: list[Written | None]) -> None:
        """Publishes the generation: its description appears whole, by a rename, or not at all."""
        system, root = self._open()
        found = [m for m in messages if m is not None and m.file]
        held = {"files": [m.file for m in found], "rows": sum(m.rows for m in found)}
        system.create_dir(f"{root}/generations", recursive=True)
        draft = f"{root}/generations/.{uuid.uuid4().hex}.draft"
        with system.open_output_stream(draft) as out:
            out.write(json.dumps(held).encode())
        system.move(draft, f"{root}/generations/{self.generation}.json")

    def abort(self, messages: list[Written | None]) -> None:
        system, root = self._open()
        for m in messages:
            for file in self._files(m.file) if m is not None and m.file else ():
                if system.get_file_info(f"{root}/{file}").type != fs.FileType.NotFound:
                    system.delete_file(f"{root}/{file}")


def write_generation(rows: DataFrame, path: str, generation: str, order: list[str]) -> None:
    """Writes rows (with a column ``artifact``) as JSON lines, those of an artifact together and in order, as one generation of a store."""
    rows.sparkSession.dataSource.register(ArtifactFiles)
    lines = rows.repartition("artifact").sortWithinPartitions("artifact", *order)
    text = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    lines.select("artifact", text.alias("line")).write.format(FORMAT).mode("append").option("generation", generation).save(path)


def read_generations(spark: SparkSession, path: str, schema: str, wanted: DataFrame) -> DataFrame:
    """The rows of artifacts in the generations that ``wanted`` (artifact, generation) names, and of no others.

    The generations, one per run, and their files are listed on the driver, as Spark does with any table's files; only these files are read.
    """
    named = [r[0] for r in wanted.select("generation").distinct().collect()]
    files = [f"{path}/data/g={g}/{f}.jsonl" for g in named for f in (hadoop_json(spark, f"{path}/generations/{g}.json") or {"files": []})["files"]]
    if not files:
        return spark.createDataFrame([], schema + ", artifact string")
    rows = spark.read.schema(schema + ", artifact string").json(files)
    own = rows.withColumn("generation", F.regexp_extract(F.col("_metadata.file_path"), "/g=([^/]+)/", 1))
    return own.join(wanted.select("artifact", "generation").distinct(), ["artifact", "generation"], "left_semi").drop("generation")


def lost_artifacts(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """(artifact, generation) of ``wanted`` that are not whole: the generation was not published, or a file that holds rows of the artifact is gone."""
    unpublished, lists = [], []
    for g in [r[0] for r in wanted.select("generation").distinct().collect()]:  # one per run
        held = hadoop_json(spark, f"{path}/generations/{g}.json")
        if held is None:
            unpublished.append(g)
            continue
        for file in held["files"]:
            if hadoop_missing(spark, f"{path}/data/g={g}/{file}.jsonl"):
                if hadoop_missing(spark, f"{path}/data/g={g}/{file}.list"):
                    unpublished.append(g)
                else:
                    lists.append(f"{path}/data/g={g}/{file}.list")
    gone = wanted.where(F.col("generation").isin(unpublished)).select("artifact", "generation")
    if lists:
        named = spark.read.schema("artifact string").json(lists).withColumn("generation", F.regexp_extract(F.col("_metadata.file_path"), "/g=([^/]+)/", 1))
        gone = gone.unionByName(wanted.select("artifact", "generation").join(named, ["artifact", "generation"], "left_semi")).distinct()
    return gone


def remove_generations(spark: SparkSession, path: str, used: DataFrame) -> int:
    """Removes the files of generations that ``used`` does not name; gives how many went. Not while a run is at work."""
    kept = {r[0] for r in used.select("generation").distinct().collect()}
    system, root = fs.FileSystem.from_uri(path)
    gone = 0
    for info in system.get_file_info(fs.FileSelector(f"{root}/data", allow_not_found=True)):
        name = info.base_name.removeprefix("g=")
        if info.type == fs.FileType.Directory and name not in kept:
            if system.get_file_info(f"{root}/generations/{name}.json").type != fs.FileType.NotFound:
                system.delete_file(f"{root}/generations/{name}.json")
            system.delete_dir(info.path)
            gone += 1
    return gone
