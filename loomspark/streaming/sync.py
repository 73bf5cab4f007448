"""Incremental runs: files of messages to keyed snapshots by Structured Streaming.

A checkpoint remembers which files are done, and every batch is merged by key, so a batch
that runs again after a failure changes nothing.  Each batch adds its rows to a store, whose
manifest says which batches count.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.streaming.store import Store, TableSpec, counted


class Snapshots:
    """Versions of one keyed table under a path, numbered from 0; the newest counts.

    Versions are numbered on whatever batch they come from, so runs with other checkpoints go on
    from them.  Several writers may add at once, and each adds its batch only (see ``store``);
    buckets in which ``COMPACT`` batches have piled up are then written anew.
    """

    COMPACT = 16

    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], update: Sequence[str]):
        self.store = Store(spark, path, {"rows": TableSpec(schema, tuple(keys), tuple(update))})
        self.schema = schema

    def version(self) -> int:
        """The newest version that counts; -1 if there is none."""
        return self.store.version() - 1

    def read(self, version: int | None = None) -> DataFrame:
        return self.store.read("rows", None if version is None else max(0, version + 1))

    def merge(self, batch: DataFrame, batch_id: str, order: Sequence[str]) -> int:
        """Add a batch to the newest version; of a key's rows in the batch the last by ``order``
        counts.  A batch that is merged already changes nothing.  Returns its version."""
        source, _, number = batch_id.rpartition("#")
        number = int(number) if source and number.isdigit() else 0
        out = self.store.merge({"rows": batch}, source or batch_id, number, {"rows": [F.desc(c) for c in order]})
        if out == self.store.version():
            self.store.compact("rows", self.COMPACT)
        return out - 1


@dataclass(frozen=True)
class RunOutcome:
    """Batches and prepared rows of a run, and whether the source has more than it took."""

    batches: int
    rows: int
    more_available: bool


class _Enough(Exception):
    """A run has taken its share; the batch that comes next isn't begun."""


def run_available(
    spark: SparkSession,
    source: str,
    schema: StructType,
    prepare: Callable[[DataFrame], DataFrame],
    snapshots: Snapshots,
    checkpoint: str,
    order: Sequence[str],
    files_per_batch: int = 1000,
    max_batches: int | None = None,
    dry_run: bool = False,
) -> RunOutcome:
    """Merge the files that have come since the last run, in ``max_batches`` batches at most.

    A dry run says what would be merged: it reads new files only, prepares whole rows, and leaves
    snapshots and checkpoint as they are.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    files = path(checkpoint).getFileSystem(conf)
    used = f"{checkpoint.rstrip('/')}-dry-{uuid.uuid4().hex}" if dry_run else checkpoint
    if dry_run and files.exists(path(checkpoint)):
        spark._jvm.org.apache.hadoop.fs.FileUtil.copy(files, path(checkpoint), files, path(used), False, conf)
    batches, rows, more = 0, 0, False

    def take(batch: DataFrame, number: int) -> None:
        nonlocal batches, rows, more
        if max_batches is not None and batches >= max_batches:
            more = True
            raise _Enough  # the checkpoint doesn't count this batch, so the next run begins with it
        ready = prepare(batch)
        if dry_run:
            seen = counted(ready, lambda df: df.write.format("noop").mode("overwrite").save())
        else:
            seen = counted(ready, lambda df: snapshots.merge(df, f"{checkpoint}#{number}", order))
        batches, rows = batches + 1, rows + seen

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    query = stream.writeStream.foreachBatch(take).option("checkpointLocation", used).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    except Exception:
        if not more:
            raise
    finally:
        if dry_run:
            files.delete(path(used), True)
    return RunOutcome(batches, rows, more)


def gap_windows(rows: DataFrame, ts: str, keys: Sequence[str], gap: str, lateness: str) -> DataFrame:
    """Sessions of a stream, by a session window; rows later than ``lateness`` are dropped."""
    counted = rows.withWatermark(ts, lateness).groupBy(*keys, F.session_window(ts, gap).alias("session")).agg(
        F.count("*").alias("message_count"), F.max(ts).alias("last_ts")
    )
    return counted.select(*keys, F.col("session.start").alias("first_ts"), "last_ts", "message_count")
