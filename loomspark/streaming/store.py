"""Keyed tables that change together, batch by batch.

A store holds several tables under a path.  A batch adds one segment of files to each table that it
changes, cut by buckets of the key, and is there when one manifest names all of them: readers see
every table as of one version, and what no manifest names doesn't count.  So bytes written follow
the batch, not the table.  Rows of a key are folded when they are read, in the order of their
segments; a bucket in which segments pile up is written anew by ``compact``, and no other is.

A manifest is written under another name and renamed, which fails if its version is there: of two
writers one goes on from what the other has added.  Folding needs no look at what is stored, so a
writer that comes second commits the files that it has.  The rename must be atomic, as on HDFS and
local file systems.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType, StructType

from loomspark.operators.upsert import first_by


@dataclass(frozen=True)
class TableSpec:
    """What a table's rows are and how rows of one key fold.

    A key keeps the columns of its first row, but for ``update``, which are its last row's; with
    ``greatest`` these are the greatest that came instead (as a tuple, leaving out those that start
    with null).
    """

    schema: StructType
    keys: tuple[str, ...]
    update: tuple[str, ...]
    greatest: bool = False


class Conflict(Exception):
    """Another writer has committed this version."""


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, which ``spark.checkpoint.dir`` names;
    only a local session without that setting gets a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


class Store:
    """Versions of several keyed tables; version 0 is empty.

    A new store takes the number of ``buckets``; one that is there keeps its own.
    """

    def __init__(self, spark: SparkSession, path: str, tables: Mapping[str, TableSpec], buckets: int = 64):
        self.spark, self.path, self.tables = spark, path.rstrip("/"), dict(tables)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), conf)
        rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
        self._no_overwrite = spark.sparkContext._gateway.new_array(rename, 1)
        self._no_overwrite[0] = rename.NONE
        self._files.mkdirs(self._path(f"{self.path}/manifests"))
        self.buckets = self.manifest().get("buckets", buckets)

    # ---- manifests ---------------------------------------------------------------------
    def _manifest_path(self, version: int):
        return self._path(f"{self.path}/manifests/v{version:010d}.json")

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.path}/manifests")))
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if not version:
            return {"version": 0, "tables": {}, "sources": {}}
        stream = self._files.open(self._manifest_path(version))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Make the manifest that of its version; Conflict if there is one."""
        there = self._manifest_path(manifest["version"])
        new = self._path(f"{self.path}/manifests/new-{uuid.uuid4().hex}")
        out = self._files.create(new, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        try:
            self._context.rename(new, there, self._no_overwrite)
        except Exception as e:
            self._files.delete(new, False)
            if self._files.exists(there):
                raise Conflict(f"version {manifest['version']} is taken") from e
            raise

    # ---- reading -----------------------------------------------------------------------
    def _rows(self, name: str, buckets: Mapping[str, Sequence[str]]) -> DataFrame:
        """The rows of some segments of some buckets, with ``_segment`` and ``_bucket``."""
        schema = StructType([*self.tables[name].schema.fields]).add("_segment", StringType()).add("_bucket", IntegerType())
        paths = [f"{self.path}/{name}/_segment={s}/_bucket={b}" for b, segments in buckets.items() for s in segments]
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{name}").parquet(*paths)

    def _folded(self, name: str, buckets: Mapping[str, Sequence[str]]) -> DataFrame:
        """One row a key from the segments of each bucket, in the order in which they came."""
        spec = self.tables[name]
        order = list(dict.fromkeys(s for segments in buckets.values() for s in segments))
        place = F.create_map(*(F.lit(x) for k, s in enumerate(order) for x in (s, k)))[F.col("_segment")]
        fixed = [c for c in spec.schema.names if c not in (*spec.keys, *spec.update)]
        new: Column = F.struct(*spec.update)
        if spec.greatest:
            last = F.max(F.when(F.col(spec.update[0]).isNotNull(), new))
        else:
            last = F.max_by(new, place)
        parts = ([F.min_by(F.struct(*fixed), place).alias("_first")] if fixed else []) + ([last.alias("_last")] if spec.update else [])
        rows = self._rows(name, buckets).groupBy(*spec.keys).agg(*(parts or [F.count("*")]))
        return rows.select(*(
            c if c in spec.keys else F.col(f"_last.{c}" if c in spec.update else f"_first.{c}").alias(c) for c in spec.schema.names
        ))

    def read(self, name: str, version: int | None = None) -> DataFrame:
        """A table as of a version.  Buckets that are one segment are read as they are; only the others
        are grouped by key."""
        held = self.manifest(version)["tables"].get(name, {})
        whole = self._rows(name, {b: x for b, x in held.items() if len(x) == 1}).select(*self.tables[name].schema.names)
        open_ = {b: x for b, x in held.items() if len(x) > 1}
        return whole.unionByName(self._folded(name, open_)) if open_ else whole

    # ---- writing -----------------------------------------------------------------------
    def _write(self, name: str, rows: DataFrame) -> tuple[str, list[str]]:
        """A new segment, of which no manifest knows, and its buckets."""
        spec, segment = self.tables[name], uuid.uuid4().hex
        bucket = F.pmod(F.hash(*spec.keys), F.lit(self.buckets)).alias("_bucket")
        root = f"{self.path}/{name}/_segment={segment}"
        rows.select(*spec.schema.names, bucket).write.partitionBy("_bucket").parquet(root)
        found = self._files.globStatus(self._path(f"{root}/_bucket=*")) or []
        return segment, [s.getPath().getName().partition("=")[2] for s in found]

    def merge(self, batch: Mapping[str, DataFrame], source: str, number: int, order: Mapping[str, Sequence[Column | str]] | None = None) -> int:
        """Add a batch to several tables at once; returns the version in which it is there.

        Batches of a ``source`` are numbered; one whose number isn't beyond the last that counts is
        there already and changes nothing.  Of a key's rows in a batch the first by ``order`` (of the
        table) counts.  A crash before the manifest leaves all tables as they were.
        """
        if done := self._done(self.manifest(), source, number):
            return done
        added = {}
        for name, rows in batch.items():
            spec = self.tables[name]
            by = [F.desc_nulls_last(c) for c in spec.update] if spec.greatest else (order or {}).get(name) or rows.columns
            rows = first_by(rows, spec.keys, *by)
            added[name] = self._write(name, rows)
        while True:
            manifest = self.manifest()
            if done := self._done(manifest, source, number):
                return done
            tables = {k: dict(v) for k, v in manifest["tables"].items()}
            for name, (segment, buckets) in added.items():
                held = tables.setdefault(name, {})
                for b in buckets:
                    held[b] = [*held.get(b, []), segment]
            version = manifest["version"] + 1
            sources = manifest["sources"] | {source: [number, version]}
            try:
                self._commit({"version": version, "buckets": self.buckets, "tables": tables, "sources": sources})
                return version
            except Conflict:  # the files stay; they are named after the other's
                continue

    @staticmethod
    def _done(manifest: dict, source: str, number: int) -> int:
        last, version = manifest["sources"].get(source, (-1, 0))
        return version if number <= last else 0

    def compact(self, name: str, least: int = 8) -> int:
        """Write anew the buckets of a table that have ``least`` segments or more; returns the version.
        What other writers add meanwhile stays after it."""
        while True:
            manifest = self.manifest()
            full = {b: x for b, x in manifest["tables"].get(name, {}).items() if len(x) >= max(2, least)}
            if not full:
                return manifest["version"]
            segment, _ = self._write(name, self._folded(name, full))
            while True:
                now = self.manifest()
                held = dict(now["tables"][name])
                if any(held.get(b, [])[: len(x)] != x for b, x in full.items()):
                    break  # another writer has compacted one of them
                held |= {b: [segment, *held[b][len(x) :]] for b, x in full.items()}
                new = now | {"version": now["version"] + 1, "tables": now["tables"] | {name: held}}
                try:
                    self._commit(new)
                    return new["version"]
                except Conflict:
                    continue

    def vacuum(self, keep: int = 1) -> None:
        """Delete all but the newest ``keep`` versions and the segments that none of them names, those
        of writers that failed among them.  Not while another writes."""
        versions = self.versions()
        for v in versions[: max(0, len(versions) - keep)]:
            self._files.delete(self._manifest_path(v), False)
        kept = [self.manifest(v)["tables"] for v in self.versions()]
        for name in self.tables:
            named = {s for t in kept for x in t.get(name, {}).values() for s in x}
            for status in self._files.globStatus(self._path(f"{self.path}/{name}/_segment=*")) or []:
                if status.getPath().getName().partition("=")[2] not in named:
                    self._files.delete(status.getPath(), True)


class Pages:
    """Pages of a feed, stored as one transaction each: conversations, messages and the cursor.

    Conversations keep their workflow state, messages their first time; counts are taken from the
    messages stored when conversations are read, so they agree in every version.  The cursor only
    moves forward.
    """

    def __init__(self, spark: SparkSession, path: str, conversations: StructType, messages: StructType, buckets: int = 64):
        thread, identity = ("threading_rule_version", "thread_key"), ("marketplace", "source_pk")
        fixed = {*thread, "workflow_state"}
        cursors = StructType().add("feed_key", StringType()).add("ts", messages["source_ts"].dataType).add("pk", "long")
        self.store = Store(
            spark,
            path,
            {
                "conversations": TableSpec(conversations, thread, tuple(c for c in conversations.names if c not in fixed)),
                "messages": TableSpec(messages, identity, tuple(c for c in messages.names if c not in (*identity, "source_ts"))),
                "cursors": TableSpec(cursors, ("feed_key",), ("ts", "pk"), greatest=True),
            },
            buckets,
        )

    def persist(self, outcome, feed_key: str, number: int) -> int:
        """Store a page, all of it or nothing; a page that is stored already changes nothing.  Of rows
        of one message in a page the newest counts, then the least by the other columns."""
        from loomspark.operators.upsert import highest_cursor

        spec = {name: s.schema.names for name, s in self.store.tables.items()}
        newest = [F.desc("source_ts"), *(c for c in spec["messages"] if c != "source_ts")]
        page = {
            "messages": outcome.messages.select(*spec["messages"]),
            "conversations": outcome.conversations.withColumn("workflow_state", F.lit("received")).select(*spec["conversations"]),
            "cursors": highest_cursor(outcome.messages).select(F.lit(feed_key).alias("feed_key"), "ts", "pk"),
        }
        return self.store.merge(page, feed_key, number, {"messages": newest})

    def messages(self, version: int | None = None) -> DataFrame:
        return self.store.read("messages", version)

    def cursors(self, version: int | None = None) -> DataFrame:
        return self.store.read("cursors", version)

    def conversations(self, version: int | None = None) -> DataFrame:
        """Conversations with the counts of the messages that are stored in the same version."""
        from loomspark.operators.upsert import recounted

        version = self.store.version() if version is None else version
        out = self.store.read("conversations", version)
        return recounted(out, self.messages(version)).select(*self.store.tables["conversations"].schema.names)


def counted(rows: DataFrame, then: Callable[[DataFrame], object]) -> int:
    """How many rows ``then`` has worked on, counted while it did: rows are made once."""
    from pyspark.sql import Observation

    seen = Observation()
    then(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return seen.get["n"]
