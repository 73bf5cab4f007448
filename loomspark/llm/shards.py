"""A store of immutable shards with size-tiered compaction and versioned manifests.

Arrivals are appended as small runs.  When enough runs are of like size, they are merged
into one run of target-sized files.  Each change is a new manifest version; readers go by the
newest one, and files that it doesn't name don't count.  Only DataFrame operations touch the
rows.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.llm._shared import hashable
from loomspark.llm.manifests import Conflict, Manifests

#: Size of a merged file.
TARGET_BYTES = 128 << 20
#: So many runs of a tier are merged into one; tiers are powers of it.
FAN_IN = 4
#: Runs up to this size are the lowest tier.
LEAST_BYTES = 4 << 20

_PART = "_part"


@dataclass(frozen=True)
class Run:
    name: str
    bytes: int
    files: int
    rows: int


class ShardStore:
    """Shards and manifests under one folder of a file system that Spark can write.

    Rows keep their number, repeats and nulls; every run has the store's columns, whatever
    their names.  An empty arrival gives the store its columns and no run.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        target_bytes: int = TARGET_BYTES,
        fan_in: int = FAN_IN,
        least_bytes: int = LEAST_BYTES,
    ):
        self.spark, self.path = spark, path.rstrip("/")
        self.target_bytes, self.fan_in, self.least_bytes = target_bytes, fan_in, least_bytes
        self.manifests = Manifests(spark, f"{self.path}/manifests")
        self._path, self._fs = self.manifests.path_of, self.manifests.fs

    # -- manifests
    def version(self) -> int:
        return self.manifests.version()

    def manifest(self, version: int | None = None) -> dict:
        """``schema`` and ``runs`` of a version, the newest by default."""
        return {"schema": None, "runs": []} | self.manifests.read(version)

    def runs(self, version: int | None = None) -> list[Run]:
        return [Run(**r) for r in self.manifest(version)["runs"]]

    def _commit(self, base: int, schema: str, runs: list[Run]) -> int:
        return self.manifests.commit(base, {"schema": schema, "runs": [asdict(r) for r in runs]})

    # -- runs
    def _run(self, name: str, schema: StructType) -> Run:
        """What a written run holds; rows are counted from footers."""
        sizes = [
            s.getLen()
            for s in self._fs.listStatus(self._path(f"{self.path}/shards/{name}"))
            if s.getPath().getName().endswith(".parquet")
        ]
        rows = self.spark.read.schema(schema).parquet(f"{self.path}/shards/{name}").count()
        return Run(name, sum(sizes), len(sizes), rows)

    def _write_run(self, df: DataFrame) -> Run:
        name = uuid.uuid4().hex
        df.write.parquet(f"{self.path}/shards/{name}")
        return self._run(name, df.schema)

    def _write_parts(self, df: DataFrame, part: Column) -> list[Run]:
        """A run for each value of ``part``, all written in one pass over the rows."""
        folder, name = uuid.uuid4().hex, _PART
        while name in df.columns:
            name += "_"
        df.withColumn(name, part).write.partitionBy(name).parquet(f"{self.path}/shards/{folder}")
        statuses = self._fs.listStatus(self._path(f"{self.path}/shards/{folder}"))
        names = sorted(s.getPath().getName() for s in statuses if s.isDirectory())
        return [self._run(f"{folder}/{n}", df.schema) for n in names]

    def _read_runs(self, runs: list[Run], schema: str) -> DataFrame:
        struct = StructType.fromJson(json.loads(schema))
        if not runs:
            return self.spark.createDataFrame([], struct)
        return self.spark.read.schema(struct).parquet(*(f"{self.path}/shards/{r.name}" for r in runs))

    def _check_columns(self, df: DataFrame) -> None:
        if self.version() and [(f.name, f.dataType) for f in self.read().schema] != [(f.name, f.dataType) for f in df.schema]:
            raise ValueError("columns differ from the store's")

    def _add(self, run: Run | None, schema: StructType) -> int:
        while True:
            now = self.manifest()
            if run is None and now["schema"]:
                return now["version"]
            try:
                return self._commit(
                    now["version"], now["schema"] or schema.json(), [Run(**r) for r in now["runs"]] + [run] * (run is not None)
                )
            except Conflict:
                continue

    def append(self, df: DataFrame) -> int:
        """Add rows as a new run and commit; an arrival without rows changes nothing."""
        self._check_columns(df)
        run = self._write_run(df)
        return self._add(run if run.rows else None, df.schema)

    def append_arrivals(self, df: DataFrame, arrival: Column) -> int:
        """Add rows as one run for each value of ``arrival``, each committed on its own and
        followed by compaction.  The rows are read once."""
        self._check_columns(df)
        runs = self._write_parts(df, arrival)
        for run in runs or [None]:
            self._add(run, df.schema)
            self.compact()
        return self.version()

    def tier(self, run: Run) -> int:
        tier, size = 0, self.least_bytes
        while run.bytes > size:
            tier, size = tier + 1, size * self.fan_in
        return tier

    def due(self) -> list[Run]:
        """Runs to merge next: the lowest tier that has ``fan_in`` of them."""
        tiers: dict[int, list[Run]] = {}
        for run in self.runs():
            tiers.setdefault(self.tier(run), []).append(run)
        return next((tiers[t] for t in sorted(tiers) if len(tiers[t]) >= self.fan_in), [])

    def compact(self) -> int:
        """Merge runs of like size until no tier is full; returns the version."""
        while merge := self.due():
            now = self.manifest()
            size = sum(r.bytes for r in merge)
            rows = self._read_runs(merge, now["schema"])
            # fewer tasks, no shuffle: each writes a file of about the target size
            run = self._write_run(rows.coalesce(max(1, round(size / self.target_bytes))))
            while True:
                now = self.manifest()
                there = [Run(**r) for r in now["runs"]]
                if not set(merge) <= set(there):
                    break  # another writer has merged them
                try:
                    self._commit(now["version"], now["schema"], [r for r in there if r not in merge] + [run])
                    break
                except Conflict:
                    continue
        return self.version()

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of a version."""
        now = self.manifest(version)
        if not now["schema"]:
            raise ValueError("the store is empty")
        return self._read_runs([Run(**r) for r in now["runs"]], now["schema"])

    def vacuum(self, keep_versions: int = 1) -> int:
        """Delete versions but the newest, and runs that none of those names; returns how many
        runs went.  An older version can't be read any more then.

        Call it when no writer is at work: a run that isn't committed yet has no name either.
        """
        oldest = max(1, self.version() - keep_versions + 1)
        self.manifests.drop_before(oldest)
        named = {r.name for v in self.manifests.versions() for r in self.runs(v)}
        gone = 0
        for status in self._fs.listStatus(self._path(f"{self.path}/shards")):
            name = status.getPath().getName()
            parts = [s.getPath().getName() for s in self._fs.listStatus(status.getPath()) if s.isDirectory()]
            runs = [f"{name}/{p}" for p in parts] or [name]
            dead = [r for r in runs if r not in named]
            for run in [name] if len(dead) == len(runs) else dead:
                self._fs.delete(self._path(f"{self.path}/shards/{run}"), True)
            gone += len(dead)
        return gone


def row_batches(df: DataFrame, batches: int) -> Column:
    """A number from 0 to ``batches - 1`` for each row, by a hash of all its columns but maps."""
    return F.pmod(F.xxhash64(F.lit("row"), *(F.col(f"`{c}`") for c in hashable(df))), F.lit(batches)).cast("int")
