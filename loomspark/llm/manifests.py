"""Versioned manifests: small JSON files whose commit is one rename.

A version's file is written under another name and renamed into place, which fails if that
version exists, so of two writers one wins and the other starts again.  Readers go by a
manifest only; files that none names don't count.  The rename must be atomic, as it is on
HDFS and local file systems; on an object store, keep manifests where it is.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession


class Conflict(Exception):
    """Another writer has committed this version."""


class Manifests:
    """The manifests ``v00000001.json`` and so on in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self.path_of = jvm.org.apache.hadoop.fs.Path
        conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path_of(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._no_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._no_overwrite[0] = rename.NONE
        self.fs.mkdirs(self.path_of(self.path))

    def _file(self, version: int):
        return self.path_of(f"{self.path}/v{version:08d}.json")

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self.fs.listStatus(self.path_of(self.path)))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The newest version; 0 if there is none."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> dict:
        """The body of a version, the newest by default; empty for version 0."""
        version = self.version() if version is None else version
        if not version:
            return {"version": 0}
        stream = self.fs.open(self._file(version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: int, body: dict) -> int:
        """Make ``body`` the version after ``base``; Conflict if another writer has made one."""
        version = base + 1
        temporary = self.path_of(f"{self.path}/tmp-{uuid.uuid4().hex}")
        out = self.fs.create(temporary, False)
        out.write(bytearray(json.dumps({"version": version} | body).encode()))
        out.close()
        try:
            self._context.rename(temporary, self._file(version), self._no_overwrite)
        except Exception as e:
            self.fs.delete(temporary, False)
            if self.fs.exists(self._file(version)):
                raise Conflict(f"version {version} is taken") from e
            raise
        return version

    def drop_before(self, version: int) -> None:
        """Delete the manifests of older versions, the oldest first."""
        for v in self.versions():
            if v < version:
                self.fs.delete(self._file(v), False)
