"""Tables of Parquet files in which each version is a list of files: only buckets that a write touches are rewritten.

A version is a small JSON file ``versions/000…n.json`` with the files of each bucket. Writing version n+1 first writes its
data files, which no reader knows yet, then publishes the list by a rename that fails where another writer has published that version:
the later writer gets ``Conflict`` and can begin anew from the new latest version. Readers name a version's files, so they see one
version whole, the latest or any that is kept. Rows are put in buckets by a hash of the key, so an upsert or delete reads and rewrites
only the buckets of the keys it names; an append rewrites none. ``vacuum`` deletes what no kept version names.

The driver handles names of buckets and files, at most a few for each bucket; rows stay in the executors.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "__bucket"


class Conflict(RuntimeError):
    """Another writer has published the version that this one was about to."""


class Folder:
    """A folder on any file system that Spark can reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.path, self._jvm = path.rstrip("/"), spark._jvm
        self._conf = spark._jsc.hadoopConfiguration()
        self._fs = self._at("").getFileSystem(self._conf)

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def files(self, name: str = "") -> dict[str, tuple[int, int]]:
        """Paths below the folder of all files in a subfolder and its subfolders: size, and time of change in ms."""
        out, top = {}, self._at(name)
        if self._fs.exists(top):
            base = self._fs.makeQualified(self._at("")).toString()
            walk = self._fs.listFiles(top, True)
            while walk.hasNext():
                f = walk.next()
                out[f.getPath().toString()[len(base) + 1 :]] = (f.getLen(), f.getModificationTime())
        return out

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def publish(self, name: str, text: str) -> None:
        """Create a file whole or not at all; FileExistsError if it is there."""
        temp, hadoop = f"{name}.{uuid.uuid4().hex}.tmp", self._jvm.org.apache.hadoop.fs
        out = self._fs.create(self._at(temp), False)
        out.write(bytearray(text.encode()))
        out.close()
        context = hadoop.FileContext.getFileContext(self._fs.makeQualified(self._at("")).toUri(), self._conf)
        options = self._jvm.java.lang.reflect.Array.newInstance(self._jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
        try:
            context.rename(self._fs.makeQualified(self._at(temp)), self._fs.makeQualified(self._at(name)), options)
        except Exception as e:
            self.delete(temp)
            if "FileAlreadyExists" in str(e):
                raise FileExistsError(name) from e
            raise

    def delete(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


class Versions:
    """Numbered JSON documents, each published once."""

    def __init__(self, folder: Folder):
        self.folder = folder

    def numbers(self) -> list[int]:
        names = [f.rsplit("/", 1)[1] for f in self.folder.files("versions") if f.endswith(".json")]
        return sorted(int(n[:-5]) for n in names)

    def read(self, n: int) -> dict:
        return json.loads(self.folder.read(f"versions/{n:012d}.json"))

    def publish(self, n: int, content: dict) -> None:
        try:
            self.folder.publish(f"versions/{n:012d}.json", json.dumps(content))
        except FileExistsError as e:
            raise Conflict(f"version {n} of {self.folder.path} is there") from e

    def delete(self, n: int) -> None:
        self.folder.delete(f"versions/{n:012d}.json")


@dataclass
class Version:
    number: int = -1
    schema: str | None = None
    buckets: int = 0
    #: Files of each bucket.
    files: dict[str, list[str]] = field(default_factory=dict)
    #: The last batch of each stream that writes here.
    streams: dict[str, int] = field(default_factory=dict)
    what: str = ""
    #: Milliseconds.
    at: int = 0


class VersionedTable:
    """Rows in buckets by a hash of ``key``; null keys are a key of their own."""

    def __init__(self, spark: SparkSession, path: str, key: str = "source", buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.folder = Folder(spark, self.path)
        self.versions = Versions(self.folder)

    def version(self, n: int | None = None) -> Version:
        """The latest version, or version n."""
        if n is None:
            numbers = self.versions.numbers()
            if not numbers:
                return Version(buckets=self.buckets)
            n = numbers[-1]
        return Version(**self.versions.read(n))

    def history(self) -> DataFrame:
        """version, what, at, n_files of every version that is kept."""
        rows = [(v.number, v.what, v.at, sum(map(len, v.files.values()))) for v in map(self.version, self.versions.numbers())]
        return self.spark.createDataFrame(rows, "version long, what string, at long, n_files long").withColumn("at", F.timestamp_millis("at"))

    def read(self, n: int | None = None) -> DataFrame | None:
        """The rows of the latest version or of version n; None before the first."""
        v = self.version(n)
        return None if v.schema is None else self.rows(v, list(v.files))

    def rows(self, v: Version, buckets: list[str]) -> DataFrame:
        """What a version has in some buckets."""
        schema = StructType.fromJson(json.loads(v.schema))
        paths = [f"{self.path}/{f}" for b in buckets for f in v.files.get(b, [])]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _bucket(self, v: Version):
        return F.pmod(F.xxhash64(F.col(f"`{self.key}`")), F.lit(v.buckets)).cast("int")

    def _written(self, v: Version, rows: DataFrame) -> dict[str, list[str]]:
        """Write rows as new files; a bucket that holds much is split over tasks and files, small ones share a task."""
        name = f"data/{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self._bucket(v)).hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        out: dict[str, list[str]] = {}
        for f in sorted(self.folder.files(name)):
            if f.endswith(".parquet"):
                out.setdefault(f.rsplit("/", 2)[1].split("=")[1], []).append(f)
        return out

    def _touched(self, v: Version, keys: DataFrame) -> list[str]:
        return [str(r[0]) for r in keys.select(self._bucket(v).alias("b")).distinct().collect()]

    def _publish(self, v: Version, files: dict[str, list[str]], schema: StructType, what: str, stream: tuple[str, int] | None) -> int:
        streams = v.streams | ({stream[0]: stream[1]} if stream else {})
        new = Version(v.number + 1, json.dumps(schema.jsonValue()), v.buckets, {b: f for b, f in files.items() if f}, streams, what, int(time.time() * 1000))
        self.versions.publish(new.number, new.__dict__)
        return new.number

    def _schema(self, v: Version, new: DataFrame) -> StructType:
        """The stored columns and then those that new rows add."""
        if v.schema is None:
            return new.schema
        old = StructType.fromJson(json.loads(v.schema))
        return StructType(old.fields + [f for f in new.schema.fields if f.name not in old.names])

    def upsert(self, new: DataFrame, stream: tuple[str, int] | None = None, base: Version | None = None) -> int:
        """All rows of each key in ``new`` are replaced by its rows there. Returns the version."""
        v = base or self.version()
        touched = self._touched(v, new)
        rows = new
        if v.schema is not None:
            old = self.rows(v, touched)
            same = F.col("o.k").eqNullSafe(F.col("n.k"))
            keys = new.select(F.col(f"`{self.key}`").alias("k")).distinct()
            kept = old.withColumn("k", F.col(f"`{self.key}`")).alias("o").join(keys.alias("n"), same, "left_anti").drop("k")
            rows = kept.unionByName(new, allowMissingColumns=True)
        files = {b: f for b, f in v.files.items() if b not in touched} | self._written(v, rows)
        return self._publish(v, files, self._schema(v, new), "upsert", stream)

    def append(self, new: DataFrame, stream: tuple[str, int] | None = None, base: Version | None = None) -> int:
        """Add rows; nothing is rewritten."""
        v = base or self.version()
        files = dict(v.files)
        for b, f in self._written(v, new).items():
            files[b] = files.get(b, []) + f
        return self._publish(v, files, self._schema(v, new), "append", stream)

    def delete(self, keys: DataFrame, base: Version | None = None) -> int:
        """Remove all rows of the keys (a column named as the table's key)."""
        v = base or self.version()
        if v.schema is None:
            return v.number
        touched = self._touched(v, keys)
        old, k = self.rows(v, touched), keys.select(F.col(f"`{self.key}`").alias("k")).distinct()
        kept = old.alias("o").join(k.alias("n"), F.col(f"o.`{self.key}`").eqNullSafe(F.col("n.k")), "left_anti")
        files = {b: f for b, f in v.files.items() if b not in touched} | self._written(v, kept)
        return self._publish(v, files, old.schema, "delete", None)

    def clear(self, base: Version | None = None) -> int:
        """A version without rows; earlier ones can still be read."""
        v = base or self.version()
        return v.number if v.schema is None else self._publish(v, {}, StructType.fromJson(json.loads(v.schema)), "clear", None)

    def has(self, stream: str, batch: int) -> bool:
        """Whether a stream's batch is in the table."""
        return self.version().streams.get(stream, -1) >= batch

    def vacuum(self, keep: int = 1, older_ms: int = 7 * 24 * 3600 * 1000, now_ms: int | None = None) -> dict[str, int]:
        """Delete versions, but for the last ``keep`` and those published in the last ``older_ms``, and files that no version left names.

        Files that no version names yet may belong to a write under way, so they stay until they are older, too.
        """
        limit = (int(time.time() * 1000) if now_ms is None else now_ms) - older_ms
        numbers = self.versions.numbers()
        kept = [self.version(n) for n in numbers]
        gone = [v for v in kept[: max(0, len(kept) - max(1, keep))] if v.at < limit]
        for v in gone:
            self.versions.delete(v.number)
        ended = {v.number for v in gone}
        named = {f for v in kept if v.number not in ended for fs in v.files.values() for f in fs}
        dropped = {f for v in gone for fs in v.files.values() for f in fs} - named
        there = self.folder.files("data")
        out = {"versions": len(gone), "files": 0, "bytes_before": sum(s for s, _ in there.values())}
        for f, (_, changed) in there.items():
            if f.endswith(".parquet") and f not in named and (f in dropped or changed < limit):
                self.folder.delete(f)
                out["files"] += 1
        return out | {"bytes_after": sum(s for s, _ in self.folder.files("data").values())}
