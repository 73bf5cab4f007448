from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from loomspark.sources import scans
from loomspark.streaming import cursors
from pyspark.sql.types import LongType, StringType, StructType, TimestampNTZType

SCHEMA = StructType().add("pk", LongType()).add("ts", TimestampNTZType()).add("word", StringType())
T0 = datetime(2024, 3, 1)


def put(folder, name, rows, group=4):
    folder.mkdir(exist_ok=True)
    ks, at = [r[0] for r in rows], [r[1] and T0 + timedelta(minutes=r[1]) if r[1] is not None else None for r in rows]
    words = [f"w{k}" for k in ks]
    pq.write_table(pa.table({"word": words, "ts": pa.array(at, pa.timestamp("us")), "pk": pa.array(ks, pa.int64()), "more": words}), folder / name, row_group_size=group)


def taken(spark, folder, checkpoint, window, limit, max_pages=None, fail_at=None):
    pages = []

    def take(page, number):
        assert page.columns == SCHEMA.names
        found = sorted((r["ts"], r["pk"]) for r in page.collect())
        if number == fail_at:
            raise RuntimeError("lost")
        pages.append((number, found))
        return len(found)

    stream = cursors.read_pages(spark, str(folder), SCHEMA, "ts", "pk", window, str(checkpoint), limit)
    return pages, cursors.run_pages(stream, str(checkpoint), take, max_pages)


def scanned(spark, folder, window, limit):
    """The same pages by bounded scans, one after another."""
    table, out = spark.read.parquet(str(folder)), []
    while rows := scans.scan(table, SCHEMA.names, "ts", "pk", window, limit).collect():
        out.append(sorted((r["ts"], r["pk"]) for r in rows))
        window = scans.After(*out[-1][-1])
    return out


def test_pages_equal_scans_and_go_on_within_an_instant(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "a.parquet", [(k, k // 6) for k in range(20)])  # six rows an instant, five a page
    put(folder, "b.parquet", [(k, 1 + k % 3) for k in range(100, 110)])  # overlaps the first in time
    want = scanned(spark, folder, scans.Everything(), 5)
    found, outcome = taken(spark, folder, tmp_path / "c", scans.Everything(), 5, max_pages=2)
    assert [p for _, p in found] == want[:2] and outcome == cursors.PagesOutcome(2, 10, True)
    # another run goes on from there; a page that fails comes again as it was
    with pytest.raises(Exception, match="lost"):
        taken(spark, folder, tmp_path / "c", scans.Everything(), 5, fail_at=3)
    put(folder, "c.parquet", [(500, 90), (501, 91)])
    found, outcome = taken(spark, folder, tmp_path / "c", scans.Everything(), 5)
    assert [n for n, _ in found] == list(range(3, 3 + len(found))) and not outcome.more_available
    assert [p for _, p in found] == scanned(spark, folder, scans.Everything(), 5)[3:]
    # nothing new, then rows after the last place
    assert taken(spark, folder, tmp_path / "c", scans.Everything(), 5)[1] == cursors.PagesOutcome(0, 0, False)
    put(folder, "d.parquet", [(502, 91), (7, 80)])
    assert taken(spark, folder, tmp_path / "c", scans.Everything(), 5)[0][0][1] == [(T0 + timedelta(minutes=91), 502)]


def test_windows_nulls_and_repeated_places(spark, tmp_path):
    folder = tmp_path / "in"
    put(folder, "a.parquet", [(1, 5), (2, 5), (2, 5), (2, 5), (3, 5), (9, None), (4, 6)])
    at = T0 + timedelta(minutes=5)
    for n, window in enumerate((scans.After(at, 1), scans.Since(at), scans.Everything())):
        found, outcome = taken(spark, folder, tmp_path / f"c{n}", window, 1)
        keys = [k for _, p in found for _, k in p]
        assert keys == [1, 2, 2, 2, 3, 4][n == 0 :] and outcome.pages == (3 if n == 0 else 4)
    (tmp_path / "none").mkdir()
    assert taken(spark, tmp_path / "none", tmp_path / "e", scans.Everything(), 1)[1] == cursors.PagesOutcome(0, 0, False)


def test_only_row_groups_of_a_page_are_looked_into(tmp_path, monkeypatch):
    folder = tmp_path / "in"
    put(folder, "a.parquet", [(k, k) for k in range(1000)], group=10)
    begin = cursors.first_place(scans.After(T0 + timedelta(minutes=500), 500))
    options = {"path": str(folder), "ts": "ts", "pk": "pk", "limit": "15", "position": str(tmp_path / "p"), "startTs": str(begin[0]), "startPk": str(begin[1])}
    reader, read = cursors.PageReader(options, SCHEMA), []
    whole = pq.ParquetFile.read_row_group
    monkeypatch.setattr(pq.ParquetFile, "read_row_group", lambda f, k, **o: read.append(k) or whole(f, k, **o))
    end = reader.latestOffset()
    assert end == {"ts": cursors.micros_of(T0 + timedelta(minutes=515)), "pk": 515}
    assert read == [50, 51]
    parts = reader.partitions(reader.initialOffset(), end)
    assert [p.number for p in parts] == [50, 51] and sum(b.num_rows for p in parts for b in reader.read(p)) == 15
    with pytest.raises(ValueError, match="before the checkpoint"):
        reader.partitions(end, reader.initialOffset())
