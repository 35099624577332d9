"""Versioned tables in buckets by a key, whose commits survive writers that die, and whose look-ups read only the buckets they touch."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.session import Scratch, hadoop_json

#: Bits of a Bloom filter for each key, and how many of them a key sets: about one false answer in 2,000.
BLOOM_BITS, BLOOM_HASHES = 16, 11
RETRIES = 20


class VersionLog:
    """Numbered descriptions in a folder. Each appears whole or not at all, and each number is given once.

    A description is written under a name of its own and then renamed without replacing another: a writer that dies before that has changed nothing, so there
    is no claim that others would have to wait for. A file that is there but cannot be read is nobody's: the next number passes over it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *parts: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path("/".join((self.folder, *parts)))
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def numbers(self) -> list[int]:
        path, system = self._path()
        if not system.exists(path):
            return []
        names = [s.getPath().getName() for s in system.listStatus(path)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def load(self, number: int) -> dict | None:
        """None for a number that is not given or whose file cannot be read."""
        return hadoop_json(self.spark, f"{self.folder}/{number}.json")

    def latest(self) -> tuple[int, dict | None, int]:
        """(the newest readable version or 0, its description, the number that comes after all)."""
        numbers = self.numbers()
        for n in reversed(numbers):
            held = self.load(n)
            if held is not None:
                return n, held, numbers[-1] + 1
        return 0, None, numbers[-1] + 1 if numbers else 1

    def publish(self, number: int, held: dict) -> bool:
        """False if another writer has taken the number."""
        draft, system = self._path(f".{uuid.uuid4().hex}.draft")
        final, _ = self._path(f"{number}.json")
        raw = json.dumps(held).encode()
        if system.getScheme() == "file":
            # a hard link is made or refused in one step
            draft, final = draft.toUri().getPath(), final.toUri().getPath()
            os.makedirs(os.path.dirname(draft), exist_ok=True)
            with open(draft, "xb") as out:
                out.write(raw)
            try:
                os.link(draft, final)
            except FileExistsError:
                return False
            finally:
                os.unlink(draft)
            return True
        stream = system.create(draft, False)
        stream.write(bytearray(raw))
        stream.close()
        jvm = self.spark.sparkContext._jvm
        keep = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        keep[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
        try:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(final.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, keep)
        except Exception as error:
            system.delete(draft, False)
            if "AlreadyExists" in str(error):
                return False
            raise
        return True

    def remove(self, number: int) -> None:
        path, system = self._path(f"{number}.json")
        system.delete(path, False)


def last_rows(new: DataFrame, key: str, order: Column | None = None) -> DataFrame:
    """One row per key: the last by ``order``; without one, or where it ties, the one whose JSON text is greatest, so that retries choose alike."""
    content = F.to_json(F.struct(*[F.col(f"`{c}`") for c in new.columns]), {"ignoreNullFields": "false"})
    last = Window.partitionBy(key).orderBy(*([order.desc()] if order is not None else []), content.desc())
    return new.withColumn("_n", F.row_number().over(last)).where("_n = 1").drop("_n")


class BucketTable:
    """Parquet in buckets by a hash of ``key``, in versions.

    A version lists the folder of each bucket and of its Bloom filter. An upsert writes the buckets that its rows fall in anew, and no others, and then publishes
    the next version. If another writer was first, only those of its buckets that the other has changed as well are written again. What a writer
    leaves behind when it dies is listed nowhere; ``vacuum`` removes it. Readers see whole versions only.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64, properties: dict | None = None):
        self.spark, self.path, self.key, self.buckets, self.properties = spark, path.rstrip("/"), key, buckets, properties or {}
        self.log = VersionLog(spark, f"{self.path}/_versions")

    def version(self) -> int:
        return self.log.latest()[0]

    def create(self) -> int:
        """Makes the table if it is not there, without rows. Other properties than those it was made with are an error."""
        at, held, following = self.log.latest()
        while held is None:
            self.log.publish(following, self._description(None, {}))
            at, held, following = self.log.latest()
        unlike = {k: v for k, v in held["properties"].items() if self.properties.get(k, v) != v}
        if unlike:
            raise ValueError("the table was made with " + ", ".join(f"{k} {v}" for k, v in unlike.items()))
        self.buckets = held["buckets"]
        return at

    def _description(self, schema: dict | None, folders: dict) -> dict:
        return {"properties": self.properties, "buckets": self.buckets, "schema": schema, "folders": folders}

    def _hashes(self) -> list[Column]:
        return [F.xxhash64(self.key).alias("_h"), F.xxhash64(F.lit(1), F.col(self.key)).alias("_g")]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("string")

    def read(self) -> DataFrame:
        """The rows of the newest version; without any, an error."""
        _, held, _ = self.log.latest()
        if not held or not held["schema"]:
            raise ValueError("the table holds no rows yet")
        return self._read(held, held["folders"])

    def _read(self, held: dict, buckets: Iterable[str]) -> DataFrame:
        schema = T.StructType.fromJson(held["schema"])
        folders = [f"{self.path}/{held['folders'][b]}/_bucket={b}" for b in buckets if b in held["folders"]]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def lookup(self, keys: DataFrame) -> DataFrame | None:
        """The rows with one of the keys (a column named as the table's key); None if the table has no rows yet.

        Only buckets that a key falls in are considered, of these only their Bloom filters are read, and only buckets that a filter lets a key through to are
        scanned. What reaches the driver are bucket numbers.
        """
        _, held, _ = self.log.latest()
        if not held or not held["schema"]:
            return None
        self.buckets = held["buckets"]
        scratch = Scratch(self.spark, "lookup")
        wanted = scratch.keep(keys.select(self.key).distinct().select(self.key, *self._hashes(), self._bucket().alias("_bucket")), "keys")
        touched = sorted({r[0] for r in wanted.select("_bucket").distinct().collect()} & set(held["folders"]))  # at most as many as buckets
        filters = [f"{self.path}/{held['folders'][b]}/_filter={b}" for b in touched]
        if not filters:
            return self._read(held, [])
        blooms = self.spark.read.schema("_bucket string, bits binary").parquet(*filters)

        def passed(left: pa.Table, right: pa.Table) -> pa.Table:
            if not left.num_rows or not right.num_rows:
                return left.select([key]).slice(0, 0).append_column("_bucket", pa.array([], pa.string()))
            bits = np.frombuffer(right.column("bits")[0].as_py(), np.uint8)
            at = bloom_places(left.column("_h").to_numpy(), left.column("_g").to_numpy(), 8 * len(bits))
            fine = ((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(axis=1)
            return left.select([key, "_bucket"]).filter(pa.array(fine))

        key = self.key
        kind = wanted.schema[key].dataType.simpleString()
        possible = scratch.keep(wanted.groupBy("_bucket").cogroup(blooms.groupBy("_bucket")).applyInArrow(passed, f"`{key}` {kind}, _bucket string"), "possible")
        there = sorted({r[0] for r in possible.select("_bucket").distinct().collect()})
        return self._read(held, there).join(possible.select(key), key, "left_semi")

    def upsert(self, new: DataFrame, order: Column | None = None) -> int:
        """The newest version's number afterwards; without rows nothing is written. One row stays per key, see last_rows."""
        if self.version():
            self.create()
        scratch = Scratch(self.spark, "upsert")
        rows = scratch.keep(last_rows(new, self.key, order).withColumn("_bucket", self._bucket()), "new", partition_by="_bucket")
        touched = sorted(str(r[0]) for r in rows.select("_bucket").distinct().collect())  # at most as many as buckets
        mine: dict[str, tuple[str | None, str]] = {}
        for _ in range(RETRIES if touched else 0):
            at, held, following = self.log.latest()
            held = held or self._description(None, {})
            stale = [b for b in touched if b not in mine or mine[b][0] != held["folders"].get(b)]
            if stale:
                folder = f"data/{uuid.uuid4().hex}"
                schema = self._merge(held, rows, stale, folder)
                mine |= {b: (held["folders"].get(b), folder) for b in stale}
            fields = {f["name"]: f for s in (held["schema"], schema) if s for f in s["fields"]}
            folders = held["folders"] | {b: f for b, (_, f) in mine.items()}
            if self.log.publish(following, self._description({"type": "struct", "fields": list(fields.values())}, folders)):
                break
        else:
            if touched:
                self._drop({f for _, f in mine.values()})
                raise RuntimeError(f"{RETRIES} other writers were first")
        scratch.drop(rows)
        return self.version()

    def _merge(self, held: dict, rows: DataFrame, buckets: list[str], folder: str) -> dict:
        """Writes old and new rows of some buckets, and their Bloom filters, to a folder; gives the schema."""
        merged = rows.where(F.col("_bucket").cast("string").isin(buckets)).withColumn("_bucket", self._bucket())
        if held["schema"]:
            old = self._read(held, buckets).withColumn("_bucket", self._bucket())
            merged = old.join(merged.select(self.key, "_bucket"), [self.key, "_bucket"], "left_anti").unionByName(merged, allowMissingColumns=True)
        path = f"{self.path}/{folder}"
        merged.repartition("_bucket").sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(path)
        schema = merged.drop("_bucket").schema

        def fill(part: pa.Table) -> pa.Table:
            n = 1 << max(6, (BLOOM_BITS * part.num_rows - 1).bit_length())
            bits = np.zeros(n, np.uint8)
            bits[bloom_places(part.column("_h").to_numpy(), part.column("_g").to_numpy(), n).ravel()] = 1
            raw = np.packbits(bits, bitorder="little").tobytes()
            return pa.table({"_filter": [part.column("_filter")[0].as_py()], "_bucket": [part.column("_filter")[0].as_py()], "bits": pa.array([raw], pa.binary())})

        keys = self.spark.read.schema(schema).parquet(*[f"{path}/_bucket={b}" for b in buckets]).select(*self._hashes(), self._bucket().alias("_filter"))
        blooms = keys.groupBy("_filter").applyInArrow(fill, "_filter string, _bucket string, bits binary")
        blooms.write.mode("append").partitionBy("_filter").parquet(path)
        return schema.jsonValue()

    def _drop(self, folders: Iterable[str]) -> int:
        gone = 0
        for folder in folders:
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{folder}")
            gone += bool(path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
        return gone

    def vacuum(self, keep: int = 2, older_than: float = 0.0) -> int:
        """Removes versions but the last ``keep``, and the folders and drafts that no other names, if they are older than so many seconds (writers at work
        need theirs); gives how many folders went."""
        readable = [n for n in self.log.numbers() if self.log.load(n) is not None]
        used = {f for n in readable[-keep:] for f in self.log.load(n)["folders"].values()}
        limit = (time.time() - older_than) * 1000
        gone = 0
        for part, match in (("data", lambda n: f"data/{n}" not in used), ("_versions", lambda n: n.endswith(".draft"))):
            path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{part}")
            system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for status in system.listStatus(path) if system.exists(path) else ():
                if match(status.getPath().getName()) and status.getModificationTime() <= limit:
                    gone += bool(system.delete(status.getPath(), True)) and part == "data"
        for n in set(self.log.numbers()) - set(readable[-keep:]):
            if not readable or n < readable[-1]:
                self.log.remove(n)
        return gone


def bloom_places(h: np.ndarray, g: np.ndarray, n: int) -> np.ndarray:
    """(key, hash): the bits of n, a power of two, that keys with two hashes set."""
    steps = np.arange(BLOOM_HASHES, dtype=np.uint64)
    return ((h.view(np.uint64)[:, None] + steps * (g.view(np.uint64)[:, None] | np.uint64(1))) & np.uint64(n - 1)).astype(np.int64)
