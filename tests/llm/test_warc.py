import gzip
import hashlib

import pytest
from loomspark.llm import queries, warc
from loomspark.llm._shared import shared_dir
from pyarrow import fs
from pyspark.sql import functions as F

BIG = "ä" * 600
ROWS = [
    (1, "http://a/1", BIG), (2, "http://a/2", BIG), (5, "http://a/5", BIG), (5, "http://a/5", BIG), (3, "http://b", "small"),
    (4, "http://c", "small"), (6, None, None), (7, "http://e/\r\nX: y z", ""), (None, "http://f", BIG), (None, None, "x"),
    (8, "http://g", "body\r\n\r\nWARC/1.1\r\n\r\n" * 100), (9, "http://h", BIG + "x"),
]
SCHEMA = "page_id bigint, url string, html string, shard int, copies int, record_type string, payload_key string"


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(*r, 0, 0, "x", "y") for r in ROWS], SCHEMA).repartition(3).cache()


def brute(rows):
    out = []
    for page_id, _, html in rows:
        payload = (html or "").encode()
        ids = [r[0] for r in rows if (r[2] or "") == (html or "") and r[0] is not None]
        revisit = len(payload) >= 1000 and bool(ids) and page_id != max(ids)
        digest = hashlib.sha1(payload).hexdigest()
        out.append((page_id, len(payload), digest, "revisit" if revisit else "response", max(ids) if revisit else None))
    return sorted(out, key=str)


def contents(folder):
    store, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
    infos = store.get_file_info(fs.FileSelector(root, recursive=True))
    return {i.base_name: store.open_input_stream(i.path, compression=None).read() for i in infos if i.path.endswith(".warc.gz")}


def test_round_trip(spark, pages):
    folder = shared_dir(spark, "warc")
    manifest = warc.archive_pages(pages, folder, shards=3, roll_bytes=600).collect()
    assert sorted(map(tuple, warc.read_archives(spark, folder).collect()), key=str) == brute(ROWS)
    files = contents(folder)
    assert set(files) == {m["file"] for m in manifest} and len(files) > 3
    assert sum(m["records"] for m in manifest) == len(ROWS)
    for m in manifest:
        assert len(files[m["file"]]) == m["bytes"] and hashlib.sha256(files[m["file"]]).hexdigest() == m["sha256"]
        assert gzip.decompress(files[m["file"]]).startswith(b"WARC/1.1\r\n")
    ids, record_ids = [], set()
    for m in sorted(manifest, key=lambda m: m["file"]):
        import io

        for headers, block in warc.read_records(io.BytesIO(gzip.decompress(files[m["file"]]))):
            ids.append(warc.parse_record(headers, block)[0])
            record_ids.add(headers["warc-record-id"])
    assert len(record_ids) == len(ROWS)  # also of repeated rows and rows without an id
    assert [x for x in ids if x is not None] == sorted(x for x in ids if x is not None)


def test_reruns_agree(spark, pages):
    one, two = shared_dir(spark, "warc"), shared_dir(spark, "warc")
    warc.archive_pages(pages, one, shards=3)
    warc.archive_pages(pages.repartition(5), two, shards=3)
    assert contents(one) == contents(two)


def test_damage_is_noticed(spark):
    record = warc.warc_record(1, "http://a", b"payload", "response", None)
    (headers, block), = warc.read_records(__import__("io").BytesIO(record))
    assert warc.parse_record(headers, block)[1] == 7
    with pytest.raises(ValueError):
        warc.parse_record(headers, block.replace(b"payload", b"paYload"))


def test_empty_and_query(spark, pages, sf_dir):
    folder = shared_dir(spark, "warc")
    warc.archive_pages(spark.createDataFrame([], pages.schema), folder)
    assert warc.read_archives(spark, folder).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert sorted(map(tuple, queries.op9_warc(spark, sf_dir).collect()), key=str) == brute(rows)


def test_place_among_bounds(spark):
    for bounds in ([], [5], [3, 9], list(range(0, 300, 7))):
        rows = spark.range(-3, 320).select("id", warc.place_among(bounds, "id").alias("at")).collect()
        assert [r["at"] for r in rows] == [sum(b <= r["id"] for b in bounds) for r in rows]


def test_bounds_are_quantiles(spark):
    rows = spark.range(5000).select((F.col("id") * F.col("id")).alias("page_id"))
    bounds = warc.shard_bounds(rows, 40)
    assert bounds == warc.shard_bounds(rows.repartition(5), 40) and len(bounds) == 39
    sizes = rows.groupBy(warc.place_among(bounds, "page_id")).count().collect()
    assert max(r["count"] for r in sizes) <= 3 * 5000 / 40


def test_bounds_are_quantiles_of_the_keys(spark):
    """Ranks counted by ranges give the bounds that a sort of all keys would."""
    from loomspark.llm import warc

    keys = sorted({(k * 7919) % 4001 for k in range(2500)})
    rows = spark.createDataFrame([(k,) for k in keys + keys[:50]] + [(None,)], "page_id bigint").repartition(7)
    place = [k * 9 // (len(keys) - 1) for k in range(len(keys))]
    want = [min(k for k, p in zip(keys, place) if p == shard) for shard in range(1, 9)]
    assert warc.shard_bounds(rows, 9, sample_keys=10_000) == want
    assert warc.shard_bounds(rows.limit(0), 9) == [] and warc.shard_bounds(rows.where("page_id = 7919 % 4001"), 3) == []
    bounds = warc.shard_bounds(rows, 40, sample_keys=10)
    assert bounds == warc.shard_bounds(rows.repartition(3), 40, sample_keys=10) == sorted(set(bounds)) and len(bounds) > 20
