"""Pages of a table as a stream whose offset is a place ``(ts, pk)`` in source order.

A page is what a bounded scan after the last place gives: the first ``limit`` rows by time and key, so
a page may end among rows of one instant and the next goes on behind it.  Where a page ends is found
from the files' statistics: only row groups that can hold rows of the page are looked into, in order of
their first time, and of them two columns are read, so memory is one row group's times and keys.  The
rows are then read in tasks, a row group each.  Sources whose files follow time, as those of appended
tables do, are cheap; in others a page looks into every row group that spans its times.

A reader isn't told where its stream stands when it is asked for the next place, so it keeps the end of
the last page that was planned beside the checkpoint.  A batch that runs again after a crash is planned
again with the places in the checkpoint, before the next page is asked for.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import datetime, timezone
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from loomspark.sources.scans import After, Everything, Since, fetch_limit

_LEAST, _MOST = -(2**63), 2**63 - 1
# readers run in processes that may not have this package on their path
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of what Spark calls ``path``."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(quote(path, safe=":/@")) if "://" in path else (fs.LocalFileSystem(), path)


def micros_of(at: datetime) -> int:
    """Microseconds since 1970; naive times as they are."""
    zone = at.replace(tzinfo=timezone.utc) if at.tzinfo is None else at
    passed = zone - datetime(1970, 1, 1, tzinfo=timezone.utc)
    return (passed.days * 86_400 + passed.seconds) * 1_000_000 + passed.microseconds


def first_place(window: After | Since | Everything) -> tuple[int, int]:
    """The place that a window's rows lie strictly behind."""
    if isinstance(window, After):
        return micros_of(window.ts), window.pk
    if isinstance(window, Since):
        return micros_of(window.ts) - 1, _MOST
    if isinstance(window, Everything):
        return _LEAST, _LEAST
    raise ValueError(f"unknown window {window!r}")


@dataclass(frozen=True)
class Group(InputPartition):
    """A row group with the least and greatest time that it can hold, and a page's bounds."""

    path: str
    number: int
    least: int
    most: int
    start: tuple[int, int] = (_LEAST, _LEAST)
    end: tuple[int, int] = (_MOST, _MOST)


def _places(batch: pa.RecordBatch | pa.Table, ts: str, pk: str) -> tuple[pa.Array, pa.Array]:
    at = batch.column(ts)
    at = pc.cast(at, pa.timestamp("us", at.type.tz), safe=False)
    return pc.cast(at, pa.int64()), pc.cast(batch.column(pk), pa.int64())


def _between(at, key, start: tuple[int, int], end: tuple[int, int]):
    """Whether places lie behind ``start`` and not behind ``end``; not, where one part is null."""
    behind = pc.or_kleene(pc.greater(at, start[0]), pc.and_kleene(pc.equal(at, start[0]), pc.greater(key, start[1])))
    within = pc.or_kleene(pc.less(at, end[0]), pc.and_kleene(pc.equal(at, end[0]), pc.less_equal(key, end[1])))
    there = pc.and_(pc.is_valid(at), pc.is_valid(key))
    return pc.and_(there, pc.fill_null(pc.and_kleene(behind, within), False))


class PageReader(DataSourceStreamReader):
    BATCH = 10_000

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.ts, self.pk = options["path"], options["ts"], options["pk"]
        self.limit, self.position = int(options["limit"]), options["position"]
        self.begin = (int(options["startTs"]), int(options["startPk"]))
        self.columns, self.shape = schema.names, to_arrow_schema(schema)
        self.at: tuple[int, int] | None = None
        self.known: dict[str, tuple[tuple, list[Group]]] = {}

    # ---- places ------------------------------------------------------------------------
    def _stored(self) -> tuple[int, int] | None:
        files, name = opened(self.position)
        if files.get_file_info(name).type == fs.FileType.NotFound:
            return None
        with files.open_input_stream(name) as file:
            found = json.loads(file.read())
        return found["ts"], found["pk"]

    def _store(self, at: tuple[int, int]) -> None:
        files, name = opened(self.position)
        files.create_dir(name.rpartition("/")[0], recursive=True)
        with files.open_output_stream(f"{name}.new") as file:
            file.write(json.dumps(self._offset(at)).encode())
        files.move(f"{name}.new", name)

    @staticmethod
    def _offset(at: tuple[int, int]) -> dict[str, int]:
        return {"ts": at[0], "pk": at[1]}

    def initialOffset(self) -> dict[str, int]:
        return self._offset(self.begin)

    def latestOffset(self) -> dict[str, int]:
        """Where the page after the last one that was planned ends: where that did, if there's nothing new."""
        if self.at is None:
            self.at = self._stored() or self.begin
        return self._offset(self.page_end(self.at))

    def page_end(self, start: tuple[int, int]) -> tuple[int, int]:
        best = np.empty((0, 2), np.int64)
        for group in sorted(self._groups(start, (_MOST, _MOST)), key=lambda g: g.least):
            if len(best) == self.limit and group.least > best[-1, 0]:
                break  # groups from here on hold later rows only
            files, name = opened(group.path)
            with files.open_input_file(name) as file:
                rows = pq.ParquetFile(file).read_row_group(group.number, columns=[self.ts, self.pk])
            at, key = (c.combine_chunks() for c in _places(rows, self.ts, self.pk))
            keep = _between(at, key, start, (_MOST, _MOST))
            came = np.column_stack([at.filter(keep).to_numpy(zero_copy_only=False), key.filter(keep).to_numpy(zero_copy_only=False)])
            # one place is one row, however often it is there: a page takes all rows at its end
            best = np.unique(np.concatenate([best, came.astype(np.int64)]), axis=0)[: self.limit]
        return tuple(map(int, best[-1])) if len(best) else start

    def _groups(self, start: tuple[int, int], end: tuple[int, int]) -> list[Group]:
        """Row groups whose times can lie between two places; footers are read once a file."""
        files, name = opened(self.path)
        found = files.get_file_info(name)
        if found.type == fs.FileType.Directory:
            found = files.get_file_info(fs.FileSelector(name, recursive=True))
        else:
            found = [found]
        now: dict[str, tuple[tuple, list[Group]]] = {}
        scheme = self.path[: -len(name)] if self.path.endswith(name) else ""
        for info in found:
            parts = info.path[len(name):].split("/")
            if info.type != fs.FileType.File or any(p.startswith(("_", ".")) for p in parts) or not info.path.endswith(".parquet"):
                continue
            mark = (info.size, info.mtime_ns)
            old = self.known.get(info.path)
            now[info.path] = old if old and old[0] == mark else (mark, self._footer(files, info.path, scheme))
        self.known = now
        return [g for _, groups in now.values() for g in groups if g.most >= start[0] and g.least <= end[0]]

    def _footer(self, files: fs.FileSystem, name: str, scheme: str) -> list[Group]:
        with files.open_input_file(name) as file:
            meta = pq.ParquetFile(file).metadata
            out = []
            for k in range(meta.num_row_groups):
                group = meta.row_group(k)
                columns = (group.column(c) for c in range(group.num_columns))
                stats = next(c.statistics for c in columns if c.path_in_schema == self.ts)
                known = stats is not None and stats.has_min_max and isinstance(stats.min, datetime)
                least, most = (micros_of(stats.min), micros_of(stats.max)) if known else (_LEAST, _MOST)
                out.append(Group(f"{scheme}{name}", k, least, most))
            return out

    # ---- rows --------------------------------------------------------------------------
    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[Group]:
        begin, stop = (start["ts"], start["pk"]), (end["ts"], end["pk"])
        if stop < begin:
            raise ValueError(f"the place kept in {self.position} is before the checkpoint's")
        self._store(stop)
        self.at = stop
        return [Group(g.path, g.number, g.least, g.most, begin, stop) for g in self._groups(begin, stop)] if begin < stop else []

    def read(self, group: Group) -> Iterator[pa.RecordBatch]:
        files, name = opened(group.path)
        columns = list(dict.fromkeys([*self.columns, self.ts, self.pk]))
        with files.open_input_file(name) as file:
            for batch in pq.ParquetFile(file).iter_batches(self.BATCH, row_groups=[group.number], columns=columns):
                keep = batch.filter(_between(*_places(batch, self.ts, self.pk), group.start, group.end))
                if keep.num_rows:
                    arrays = [pc.cast(keep.column(f.name), f.type) for f in self.shape]
                    yield pa.RecordBatch.from_arrays(arrays, schema=self.shape)


class PageSource(DataSource):
    """Stream of the rows of Parquet files in pages by place; see ``read_pages`` for its options."""

    @classmethod
    def name(cls) -> str:
        return "pages_by_place"

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return PageReader(self.options, schema)


def read_pages(
    spark: SparkSession, path: str, schema: StructType, ts: str, pk: str, window, checkpoint: str, limit: int | None = None
) -> DataFrame:
    """The Parquet files under ``path`` as a stream; a batch is a page of ``limit`` places.

    A new ``checkpoint``, which must be the query's own, begins with ``window``.  Rows without time or key
    are in no page, nor are those that come with a place that the stream has passed, as in scans by
    place.  Rows that repeat a place come with it.
    """
    spark.dataSource.register(PageSource)
    begin = first_place(window)
    options = {
        "path": path, "ts": ts, "pk": pk, "limit": fetch_limit(limit), "position": f"{checkpoint.rstrip('/')}/place/last.json",
        "startTs": begin[0], "startPk": begin[1],
    }
    return spark.readStream.format(PageSource.name()).schema(schema).options(**options).load()


@dataclass(frozen=True)
class PagesOutcome:
    """Pages with rows and rows of a run, and whether the source has more than it took."""

    pages: int
    rows: int
    more_available: bool


class _Enough(Exception):
    """A run has taken its share; the page that comes next isn't begun."""


def run_pages(pages: DataFrame, checkpoint: str, take: Callable[[DataFrame, int], int], max_pages: int | None = None) -> PagesOutcome:
    """Give the pages that are there to ``take`` (page and number; gives its rows back), ``max_pages`` at most.

    A page that failed is given again, under the same number and with the same bounds, so ``take`` should
    go by number or key.
    """
    done, rows, more = 0, 0, False

    def each(page: DataFrame, number: int) -> None:
        nonlocal done, rows, more
        if max_pages is not None and done >= max_pages:
            more = True
            raise _Enough  # the checkpoint doesn't count this page, so the next run begins with it
        seen = take(page, number)
        done, rows = done + (seen > 0), rows + seen  # a source without rows gives one page without rows

    query = pages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).start()
    try:
        query.processAllAvailable()
    except Exception:
        if not more:
            raise
    finally:
        query.stop()
    return PagesOutcome(done, rows, more)
