"""Session helpers: a builder with the engine's defaults and the shared scratch area."""

from __future__ import annotations

import atexit
import json
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "citeloom", cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with adaptive execution on and UTC time; clusters bring their own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    return builder.getOrCreate()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir.

    Only where a session names none (tests, one machine) a local folder is made and set.
    """
    root = spark.conf.get(CHECKPOINT_KEY, None) or spark.sparkContext.getConf().get(CHECKPOINT_KEY)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CHECKPOINT_KEY} must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="citeloom-")
        spark.conf.set(CHECKPOINT_KEY, root)
        atexit.register(_remove_local, root)
    return root.rstrip("/")


def _remove_local(root: str) -> None:
    import shutil

    shutil.rmtree(root.removeprefix("file://"), ignore_errors=True)


class Scratch:
    """Written intermediate tables of one query.

    Each table is Parquet in the shared folder, so later stages neither recompute what came before nor
    depend on the executor that produced it. ``drop`` removes the tables that are no longer read.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/citeloom/{label}-{os.getpid()}-{uuid.uuid4().hex[:12]}"
        self._n = 0
        _WRITTEN.append(self.base)

    def keep(self, df: DataFrame, name: str = "t", partition_by: str | None = None, compression: str = "snappy") -> DataFrame:
        """Write df, in folders by a column if one is named, and read it back."""
        self._n += 1
        path = f"{self.base}/{self._n:03d}-{name}"
        (df.write.partitionBy(partition_by) if partition_by else df.write).option("compression", compression).parquet(path)
        return self._read(path, df)

    def again(self, table: DataFrame) -> DataFrame:
        """A second reading of a written table, for plans that join it with itself."""
        return self._read(table._scratch_path, table)

    def _read(self, path: str, like: DataFrame) -> DataFrame:
        out = self.spark.read.schema(like.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Remove written tables; a missing one is no error."""
        for df in tables:
            path = getattr(df, "_scratch_path", None)
            if path:
                hadoop_delete(self.spark, path)


#: Folders that this process has written tables to.
_WRITTEN: list[str] = []


def remove_scratch(spark: SparkSession) -> int:
    """Removes all tables that this process has written so far, once the frames that read them are done with; gives how many folders went."""
    gone = 0
    while _WRITTEN:
        gone += bool(hadoop_delete(spark, _WRITTEN.pop()))
    return gone


def hadoop_delete(spark: SparkSession, path: str) -> bool:
    """Removes a folder; false if there is none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def hadoop_json(spark: SparkSession, path: str) -> dict | None:
    """A small JSON file, or None if it is not there or cannot be read as JSON."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(target):
        return None
    stream = system.open(target)
    try:
        return json.loads(bytes(stream.readNBytes(int(system.getFileStatus(target).getLen()))))
    except ValueError:
        return None
    finally:
        stream.close()


def hadoop_missing(spark: SparkSession, path: str) -> bool:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
