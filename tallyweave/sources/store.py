"""A folder of committed snapshots in any file system that Spark writes: versions, a manifest for each, a lock.

Layout below the root: ``versions/<name>/<table>`` holds tables, ``manifests/<number>.json`` names the folder of a committed
version, ``lock`` the run that may write. A manifest is written under another name and renamed at last, which either happens or
doesn't, so readers see a version whole or not at all. What a broken run leaves has no manifest and is cleared by ``recover``."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from tallyweave.model import ReconcileError, Snapshot

#: Tables of a version that make up its snapshot; those after the first four may be missing.
SNAPSHOT = ("objects", "refs", "props", "custom_fields", "residue", "outbox")
NEEDED = SNAPSHOT[:4]


class Store:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path("").getFileSystem(self._conf)

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def _names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(path)) if self._fs.exists(path) else []

    def _create(self, name: str, text: str) -> None:
        """Write a new file; one that exists is an error."""
        out = self._fs.create(self._path(name), False)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _text(self, name: str) -> str:
        source = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(source)).decode()
        finally:
            source.close()

    def _rename(self, old: str, new: str) -> bool:
        """Whether ``old`` has become ``new``; it doesn't if ``new`` is there."""
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path("").toUri(), self._conf)
        options = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._path(old), self._path(new), options)
        except Exception as e:
            if self._fs.exists(self._path(new)):
                return False
            raise ReconcileError(f"can't rename to {new}") from e
        return True

    def versions(self) -> list[int]:
        """Numbers of the committed versions, oldest first."""
        return sorted(int(n.removesuffix(".json")) for n in self._names("manifests") if n.removesuffix(".json").isdigit())

    def manifest(self, version: int) -> dict:
        return json.loads(self._text(f"manifests/{version:010d}.json"))

    def table(self, name: str, version: int | None = None) -> DataFrame:
        """A table of a version, by default the last one."""
        version = self._last() if version is None else version
        m = self.manifest(version)
        if name not in m["tables"]:
            raise ReconcileError(f"version {version} has no table {name}")
        return self.spark.read.schema(m["tables"][name]).parquet(f"{self.root}/{m['folder']}/{name}")

    def read(self, version: int | None = None) -> Snapshot:
        """The snapshot of a version, by default the last one. It doesn't change when others are committed."""
        version = self._last() if version is None else version
        there = self.manifest(version)["tables"]
        tables = {n: self.table(n, version) for n in SNAPSHOT if n in there}
        return Snapshot(**tables, version=f"{self.root}#{version}")

    def _last(self) -> int:
        if not (known := self.versions()):
            raise ReconcileError(f"no snapshot is committed in {self.root}")
        return known[-1]

    def publish(self, tables: dict[str, DataFrame], run_id: str, base: int | None) -> int:
        """Commit tables as the version after ``base`` (None: as the first one) and give its number.

        All tables are written to a new folder before its manifest is. If any write fails, or someone else has committed after
        ``base``, nothing changes for readers."""
        if missing := [n for n in NEEDED if n not in tables]:
            raise ReconcileError(f"a snapshot needs {missing}")
        number = 0 if base is None else base + 1
        folder = f"versions/{number:010d}-{uuid.uuid4().hex}"
        for name, df in tables.items():
            df.write.mode("error").parquet(f"{self.root}/{folder}/{name}")
        text = json.dumps({"run_id": run_id, "base": base, "folder": folder, "tables": {n: df.schema.toDDL() for n, df in tables.items()}})
        self._fs.mkdirs(self._path("manifests"))
        draft = f"manifests/.{uuid.uuid4().hex}"
        self._create(draft, text)
        if not self._rename(draft, f"manifests/{number:010d}.json"):
            self._fs.delete(self._path(draft), False)
            raise ReconcileError(f"version {number} was committed by another run")
        return number

    def recover(self) -> list[str]:
        """Remove what runs that broke off have left: folders without a manifest, drafts. To be called while nobody writes, for
        instance under the lock; gives the folders' names."""
        named = {self.manifest(v)["folder"] for v in self.versions()}
        left = [n for n in self._names("versions") if f"versions/{n}" not in named]
        for n in left:
            self._fs.delete(self._path(f"versions/{n}"), True)
        for n in self._names("manifests"):
            if n.startswith("."):
                self._fs.delete(self._path(f"manifests/{n}"), False)
        return left

    @contextmanager
    def locked(self, run_id: str) -> Iterator[None]:
        """The right to write, for one run at a time; a lock that another run holds is an error that names it."""
        try:
            self._create("lock", run_id)
        except Exception as e:
            if self._fs.exists(self._path("lock")):
                raise ReconcileError(f"the target is locked by {self._text('lock')}") from e
            raise
        try:
            yield
        finally:
            self._fs.delete(self._path("lock"), False)

    def unlock(self, run_id: str) -> None:
        """Take away the lock of a run that is known to have died."""
        if self._fs.exists(self._path("lock")) and self._text("lock") == run_id:
            self._fs.delete(self._path("lock"), False)
