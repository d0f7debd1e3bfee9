"""Mutable tables in buckets: an update writes anew only the buckets that hold its keys.

A table's rows lie in buckets by the hash of their key.  A version is one small
file that names the folder of every bucket.  An update reads the buckets of its
keys, writes their new rows to a new folder and then puts the next version's
file in place, which fails if another writer has done so first.  Then the
update starts over from the new version, or, if the other one touched other
buckets only, just adds its own to it.  What is written thus grows with the
update, not with the table; a crash before the last step leaves the table as it
was, and readers keep the version they opened until it is vacuumed.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class ConflictError(RuntimeError):
    """Other writers came first at every attempt."""


@dataclass(frozen=True)
class Manifest:
    """One version: schema, key columns, number of buckets, the folder of each bucket that has rows, and the last batch of each writer."""

    schema: dict
    keys: tuple[str, ...]
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)
    batches: dict[str, int] = field(default_factory=dict)

    def dump(self) -> str:
        return json.dumps({"schema": self.schema, "keys": self.keys, "buckets": self.buckets, "folders": self.folders, "batches": self.batches})

    @classmethod
    def load(cls, text: str) -> Manifest:
        d = json.loads(text)
        return cls(d["schema"], tuple(d["keys"]), d["buckets"], {int(k): v for k, v in d["folders"].items()}, d["batches"])


class BucketStore:
    """Bucketed tables under one folder: ``<root>/<table>/versions/<n>`` and ``<root>/<table>/data/<folder>/_bucket=<b>``."""

    def __init__(self, spark: SparkSession, root: str, attempts: int = 8) -> None:
        self.spark, self.root, self.attempts = spark, root.rstrip("/"), attempts
        self._hadoop = spark._jvm.org.apache.hadoop.fs

    # --- files ---

    def _path(self, *parts: str):
        return self._hadoop.Path("/".join((self.root, *parts)))

    def _fs(self):
        return self._path("x").getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self, table: str) -> list[int]:
        path, fs = self._path(table, "versions"), self._fs()
        return sorted(int(f.getPath().getName()) for f in fs.listStatus(path) if f.getPath().getName().isdigit()) if fs.exists(path) else []

    def version(self, table: str) -> int | None:
        return max(self.versions(table), default=None)

    def manifest(self, table: str, version: int | None = None) -> Manifest:
        v = self.version(table) if version is None else version
        if v is None:
            raise FileNotFoundError(f"{table} has no version in {self.root}")
        stream = self._fs().open(self._path(table, "versions", str(v)))
        try:
            return Manifest.load(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, table: str, version: int, manifest: Manifest) -> bool:
        """Put a version's file in place, whole or not at all; False if the version exists."""
        fs, part = self._fs(), self._path(table, "versions", f".{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        stream.write(bytearray(manifest.dump().encode()))
        stream.close()
        target = self._path(table, "versions", str(version))
        no_options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)
        try:
            self._hadoop.FileContext.getFileContext(target.toUri(), self.spark._jsc.hadoopConfiguration()).rename(part, target, no_options)
            return True
        except Py4JJavaError as e:
            fs.delete(part, False)
            if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()):
                return False
            raise

    def remove(self, path: str) -> None:
        """Delete a folder of the store that nothing reads any more."""
        self._fs().delete(self._hadoop.Path(path), True)

    # --- tables ---

    def bucket_of(self, manifest: Manifest, column: Callable[[str], Column] = F.col) -> Column:
        return F.pmod(F.xxhash64(*[column(k) for k in manifest.keys]), F.lit(manifest.buckets)).cast("int")

    def _written(self, table: str, rows: DataFrame, manifest: Manifest) -> dict[int, str]:
        folder = uuid.uuid4().hex
        path = f"{self.root}/{table}/data/{folder}"
        rows.withColumn(BUCKET, self.bucket_of(manifest)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(path)
        found = [f.getPath().getName() for f in self._fs().listStatus(self._path(table, "data", folder))]
        return {int(name.removeprefix(f"{BUCKET}=")): f"{folder}/{name}" for name in found if name.startswith(f"{BUCKET}=")}

    def create(self, table: str, rows: DataFrame, keys: Iterable[str], buckets: int = 64) -> int:
        """Version 1 of a table; fails if it exists.  Choose buckets so that one fits a task."""
        manifest = Manifest(json.loads(rows.schema.json()), tuple(keys), buckets)
        if not self._commit(table, 1, replace(manifest, folders=self._written(table, rows, manifest))):
            raise FileExistsError(f"{table} exists in {self.root}")
        return 1

    def read(self, table: str, version: int | None = None, only: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, of all buckets or of some."""
        m = self.manifest(table, version)
        wanted = m.folders if only is None else {b: m.folders[b] for b in only if b in m.folders}
        schema = StructType.fromJson(m.schema)
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/{table}/data/{f}" for f in wanted.values()])

    def update(self, table: str, keys: DataFrame, merge: Callable[[DataFrame], DataFrame], writer: str | None = None, batch: int | None = None) -> int:
        """Replace the buckets of ``keys`` by what ``merge`` makes of their rows; returns the version that holds the update.

        ``merge`` gets all rows of these buckets and returns all their new
        rows; it may run several times, so it has to depend on its argument and
        on written frames only.  A ``batch`` of a ``writer`` that is already in
        the table changes nothing, so a stream may deliver it again.
        """
        version = self.version(table)
        base = self.manifest(table, version)
        touched = sorted(r[0] for r in keys.select(self.bucket_of(base)).distinct().collect())  # at most one row per bucket
        for _ in range(self.attempts):
            if writer is not None and base.batches.get(writer, -1) >= batch:
                return version
            merged = merge(self.read(table, version, touched)).select(*StructType.fromJson(base.schema).names)
            made = self._written(table, merged, base) if touched else {}
            if not set(made) <= set(touched):
                raise ValueError("the merge made rows of buckets that the update's keys do not lie in")
            while True:
                kept = {b: f for b, f in base.folders.items() if b not in set(touched)}
                batches = base.batches if writer is None else base.batches | {writer: batch}
                if self._commit(table, version + 1, replace(base, folders=kept | made, batches=batches)):
                    return version + 1
                seen, version = base, self.version(table)
                base = self.manifest(table, version)
                if any(seen.folders.get(b) != base.folders.get(b) for b in touched) or (writer is not None and base.batches.get(writer, -1) >= batch):
                    break  # the other writer changed what this update has read
        raise ConflictError(f"{table}: no update in {self.attempts} attempts")

    def upsert(self, table: str, updates: DataFrame, rules: dict, **options: object) -> int:
        """Rows merged on the table's keys by the rules of :func:`matchloom.operators.store.upsert`; ``updates`` is read twice."""
        from matchloom.operators.store import upsert

        keys = list(self.manifest(table).keys)
        return self.update(table, updates.select(*keys), lambda current: upsert(current, updates, keys, rules, **options))

    def vacuum(self, table: str, keep: int = 2, grace_s: float = 3600.0) -> int:
        """Drop all but the last ``keep`` versions and the folders that only they name; returns how many folders went.

        Folders younger than ``grace_s`` seconds stay, as their writer may be
        about to publish them.
        """
        fs = self._fs()
        for v in self.versions(table)[:-keep]:
            fs.delete(self._path(table, "versions", str(v)), False)
        used = {f.split("/")[0]: set() for v in self.versions(table) for f in self.manifest(table, v).folders.values()}
        for v in self.versions(table):
            for f in self.manifest(table, v).folders.values():
                used[f.split("/")[0]].add(f)
        dropped, oldest = 0, 1000 * (time.time() - grace_s)
        data = self._path(table, "data")
        for folder in fs.listStatus(data) if fs.exists(data) else ():
            name = folder.getPath().getName()
            if folder.getModificationTime() > oldest:
                continue
            if name not in used:
                fs.delete(folder.getPath(), True)
                dropped += 1
                continue
            for part in fs.listStatus(folder.getPath()):
                if part.isDirectory() and f"{name}/{part.getPath().getName()}" not in used[name]:
                    fs.delete(part.getPath(), True)
                    dropped += 1
        return dropped


__all__ = ["BucketStore", "ConflictError", "Manifest"]
