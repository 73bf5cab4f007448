"""Sessions of a stream that equal those of the batch, in whatever order rows arrive.

A session window drops what comes late and knows no ordinals.  Here each key's sessions are state:
a row goes into the session that it is near enough to, makes one of its own, or joins two that it
lies between, and a key's sessions are numbered again whenever it changes.  State is one entry a
session, not a row; nothing is dropped, so nothing needs a watermark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import LongType, StructType

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_STATE = StructType().add("first", LongType()).add("last", LongType()).add("n", LongType())


def joined(sessions: Iterable[tuple[int, int, int]], gap_ms: int) -> list[tuple[int, int, int]]:
    """``(first, last, n)`` of the sessions that these make up: times in microseconds, of which those
    within ``gap_ms``, counted to the millisecond, belong together."""
    out: list[tuple[int, int, int]] = []
    for first, last, n in sorted(sessions):
        if out and first // 1000 - out[-1][1] // 1000 <= gap_ms:
            out[-1] = (out[-1][0], max(out[-1][1], last), out[-1][2] + n)
        else:
            out.append((first, last, n))
    return out


class GapSessions(StatefulProcessor):
    """Holds the sessions of a key and gives all of them, numbered, when one changes."""

    def __init__(self, gap_ms: int, names: Sequence[str]):
        self.gap_ms, self.names = gap_ms, list(names)

    def init(self, handle) -> None:
        self.sessions = handle.getListState("sessions", _STATE)
        self.revision = handle.getValueState("revision", StructType().add("n", LongType()))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        known = [tuple(s) for s in self.sessions.get()]
        # rows of a batch come down to sessions first, so a burst is no burden on the state
        found = joined([*known, *joined(((r["us"], r["us"], 1) for r in rows), self.gap_ms)], self.gap_ms)
        revision = (self.revision.get()[0] if self.revision.exists() else 0) + 1
        self.sessions.put(found)
        self.revision.update((revision,))
        for segment, (first, last, n) in enumerate(found):
            yield Row(**dict(zip(self.names, (*key, segment, first, last, n, revision, len(found)))))

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """This kind of state needs the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def gap_sessions(rows: DataFrame, keys: Sequence[str], ts: str, gap_ms: int) -> DataFrame:
    """``keys, segment, first_us, last_us, message_count, revision, sessions`` of a stream, in update mode.

    A key that changes gives all its sessions with the next ``revision``; ``newest`` keeps those that
    hold.  Rows without a time belong to no session.
    """
    use_rocksdb(rows.sparkSession)
    us = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts).cast("timestamp_ntz"))
    timed = rows.where(F.col(ts).isNotNull()).select(*keys, us.alias("us"))
    out = StructType([timed.schema[k] for k in keys])
    for c in ("segment", "first_us", "last_us", "message_count", "revision", "sessions"):
        out = out.add(c, LongType())
    return timed.groupBy(*keys).transformWithState(GapSessions(gap_ms, out.names), out, "Update", "None")


def newest(found: DataFrame, keys: Sequence[str], ts: str = "ts") -> DataFrame:
    """The sessions that hold, of all that a stream has given: of each key and ordinal the last
    revision, up to the number of sessions that the key's last revision has."""
    start = F.lit("1970-01-01").cast("timestamp_ntz")
    last = found.groupBy(*keys).agg(F.max("revision").alias("_revision"))
    same = [found[k].eqNullSafe(last[k]) for k in keys] + [found["revision"] == last["_revision"]]
    kept = found.join(last, same, "left_semi")
    times = (F.timestamp_add("MICROSECOND", F.col(f"{x}_us"), start).alias(f"{x}_{ts}") for x in ("first", "last"))
    return kept.select(*keys, "segment", *times, "message_count")
