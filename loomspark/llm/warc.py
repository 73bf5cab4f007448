"""Deterministic sharded WARC archives.

Records are range-sorted by page id and cut into shards at quantiles of a hash-picked
sample, so the same rows always give the same shards.  A task writes its shard as files
that roll at a compressed size, each record a gzip member of its own, under temporary
names; the names that count are those in the job's committed output.  Those files are then
renamed, and the manifest that lists them is written last: readers go by the manifest only,
so an archive is there as a whole or not at all, whatever tasks failed or ran twice.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._shared import arrow_filesystem, shuffle_partitions, spread_join, written
from loomspark.llm.mix import ranked

#: Equal payloads from this size on are written once and then revisited.
REVISIT_BYTES = 1000
#: A file is closed when it has so many compressed bytes.
ROLL_BYTES = 256 << 20
#: Payload bytes meant for a shard.
SHARD_BYTES = 512 << 20
#: Keys from which the shards' bounds are taken, about, for each shard.
SAMPLE_KEYS = 200
#: Fixed date of all records, since pages carry none and reruns must agree.
DATE = "2024-01-01T00:00:00Z"

_ID = "urn:x-page:"
_MANIFEST = "file string, shard int, seq int, bytes bigint, records bigint, sha256 string"
_FILE_TYPES = pa.schema(
    {"file": pa.string(), "shard": pa.int32(), "seq": pa.int32(), "bytes": pa.int64(), "records": pa.int64(), "sha256": pa.string()}
)
_RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
_RECORD_TYPES = pa.schema(
    {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64()}
)


# ---- which records are revisits --------------------------------------------------------
def payload_rows(pages: DataFrame) -> DataFrame:
    """``page_id, payload_key, payload_bytes`` of every row, written once."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    return written(
        pages.select(
            "page_id", F.sha2(payload, 256).alias("payload_key"), F.octet_length(payload).cast("long").alias("payload_bytes")
        ),
        "payloads",
    )


def page_records(pages: DataFrame, rows: DataFrame) -> DataFrame:
    """``page_id, url, html`` with ``record_type`` and ``refers_to`` of each record.

    ``rows`` are the ``payload_rows`` of ``pages``.  Of rows with equal payloads of at least
    REVISIT_BYTES bytes the largest ``page_id`` is the response (all of them, if the row
    repeats), and the others refer to it.
    """
    equal = written(
        rows.where(F.col("payload_bytes") >= REVISIT_BYTES)
        .groupBy("payload_key")
        .agg(F.max("page_id").alias("first_id"), F.count("*").alias("copies"))
        .where(F.col("copies") > 1),
        "equal-payloads",
    )
    payload = F.coalesce("html", F.lit("")).cast("binary")
    out = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("payload_key"))
    out = spread_join(out, equal, "payload_key", F.struct("page_id", "url"), "copies", rows.count())
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return out.select(
        "page_id",
        "url",
        "html",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first_id")).alias("refers_to"),
    )


# ---- records as bytes ------------------------------------------------------------------
def _line(value: object) -> str:
    """A header's value: white space and control characters would end or break the line."""
    return "".join(c if c.isprintable() and c != " " else f"%{ord(c):02X}" for c in str(value))


def warc_record(
    page_id: int | None, url: str | None, payload: bytes, kind: str, refers_to: int | None, repeat: str = ""
) -> bytes:
    """One record, headers regenerated; a revisit has the HTTP header but no payload.

    ``repeat`` tells records of one page apart, or of pages without an id; the first record of a
    page has none, so that others can refer to it."""
    digest = hashlib.sha1(payload).hexdigest()
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http + (payload if kind == "response" else b"")
    headers = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}{repeat and ':' + repeat}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_line(url or 'about:blank')}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
    ]
    if kind == "revisit":
        headers += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <{_ID}{refers_to}>",
        ]
    headers += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(headers).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed WARC stream."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name.lower()] = value.strip()
        block = stream.read(int(headers["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("record of another length than its header says")
        yield headers, block


def parse_record(headers: dict[str, str], block: bytes) -> tuple:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to``, checked by digest."""

    def id_of(value: str | None) -> int | None:
        text = (value or "").strip("<>").removeprefix(_ID).partition(":")[0]
        return int(text) if text else None

    head, _, payload = block.partition(b"\r\n\r\n")
    kind = headers["warc-type"]
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if hashlib.sha1(block).hexdigest() != headers["warc-block-digest"].removeprefix("sha1:"):
        raise ValueError("block digest differs")
    if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("payload digest differs")
    size = next(int(x[15:]) for x in head.decode().split("\r\n") if x.lower().startswith("content-length:"))
    return id_of(headers["warc-record-id"]), size, digest, kind, id_of(headers.get("warc-refers-to"))


# ---- writing ---------------------------------------------------------------------------
def place_among(bounds: list, key: str) -> Column:
    """How many of the sorted ``bounds`` a key isn't below, by halving: some twenty comparisons
    a row, however many there are."""
    if not bounds:
        return F.lit(0)
    top = len(bounds).bit_length() - 1
    jump = f"shiftleft(1, {top} - i)"
    array = "array(" + ", ".join(f"{int(b)}L" for b in bounds) + ")"
    step = f"(n, i) -> if(coalesce(get({array}, n + {jump} - 1) <= {key}, false), n + {jump}, n)"
    return F.expr(f"aggregate(sequence(0, {top}), 0, {step})")


def shard_bounds(rows: DataFrame, shards: int, sample_keys: int = SAMPLE_KEYS) -> list:
    """Keys at which a new shard starts: quantiles of keys that a hash picks, so reruns agree."""
    keys = rows.select("page_id").where(F.col("page_id").isNotNull())
    n, most = keys.count(), sample_keys * shards
    if n > most:
        keys = keys.where(F.pmod(F.xxhash64("page_id", F.lit("shard")), F.lit(n)) < most)
    # about so many keys, whatever n is, ranked by counted ranges; of each shard one comes to the driver
    found = ranked(keys.distinct(), "page_id")
    last = found.agg(F.max("rank")).first()[0] or 1
    place = F.floor(F.col("rank") / F.lit(last) * shards)
    starts = found.withColumn("at", place).groupBy("at").agg(F.min("page_id").alias("first")).where(F.col("at").between(1, shards - 1))
    return sorted(r["first"] for r in starts.collect())


class _Rolling:
    """Writes records to files that roll by compressed size; reports each file."""

    def __init__(self, folder: str, roll_bytes: int, attempt: str):
        self.fs, self.root = arrow_filesystem(folder)
        self.roll_bytes, self.attempt = roll_bytes, attempt
        self.out, self.shard, self.seq, self.files = None, -1, 0, []

    def write(self, shard: int, record: bytes) -> None:
        if self.out and (shard != self.shard or self.size >= self.roll_bytes):
            self.close()
        if not self.out:
            self.seq = self.seq + 1 if shard == self.shard else 0
            self.shard, self.size, self.records, self.sha = shard, 0, 0, hashlib.sha256()
            self.out = self.fs.open_output_stream(f"{self.root}/{self.temporary()}", compression=None)
        member = gzip.compress(record, 6, mtime=0)
        self.out.write(member)
        self.size, self.records = self.size + len(member), self.records + 1
        self.sha.update(member)

    def temporary(self) -> str:
        return f"tmp/{self.attempt}-{self.shard:05d}-{self.seq:05d}.warc.gz"

    def close(self) -> None:
        if self.out:
            self.out.close()
            self.files.append((self.temporary(), self.shard, self.seq, self.size, self.records, self.sha.hexdigest()))
            self.out = None


def write_archives(
    records: DataFrame,
    rows: DataFrame,
    folder: str,
    roll_bytes: int = ROLL_BYTES,
    shard_bytes: int = SHARD_BYTES,
    shards: int | None = None,
) -> DataFrame:
    """Write ``records`` to ``folder`` and return the manifest.

    ``records`` are as ``page_records`` gives them and ``rows`` their ``payload_rows``, from
    which shards are planned without reading payloads again.  Files are ``<shard>-<seq>.warc.gz``; ``manifest`` lists each with its size, number of
    records and SHA-256.  Rows are sorted by ``page_id`` (null first), then by the other
    columns, so equal inputs give equal files.
    """
    spark = records.sparkSession
    if shards is None:
        total = rows.agg(F.sum("payload_bytes")).first()[0] or 0
        shards = max(shuffle_partitions(spark), -(-total // shard_bytes))
    bounds = shard_bounds(rows, shards)
    # rows without an id go to all shards
    anywhere = F.pmod(F.xxhash64("url", "html"), F.lit(len(bounds) + 1))
    at = F.when(F.col("page_id").isNull(), anywhere).otherwise(place_among(bounds, "page_id"))
    placed = records.withColumn("shard", at.cast("int"))
    placed = placed.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions(
        "shard", "page_id", "url", "record_type", "refers_to", "html"
    )
    files, root = arrow_filesystem(folder)
    files.create_dir(f"{root}/tmp", recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        out = _Rolling(folder, roll_bytes, f"{task.partitionId()}-{task.taskAttemptId()}-{uuid.uuid4().hex}")
        before, n = (), 0
        for batch in batches:
            for page_id, url, html, kind, refers_to, shard in zip(*(c.to_pylist() for c in batch.columns)):
                n = n + 1 if before == (shard, page_id) else 1
                before = (shard, page_id)
                repeat = f"{shard}-{n}" if page_id is None else str(n) if n > 1 else ""
                out.write(shard, warc_record(page_id, url, (html or "").encode(), kind, refers_to, repeat))
        out.close()
        yield pa.RecordBatch.from_pylist([dict(zip(_FILE_TYPES.names, f)) for f in out.files], _FILE_TYPES)

    # the committed output of this job says which attempt's files count
    done = written(placed.mapInArrow(write, _MANIFEST), "warc-files")

    def rename(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = arrow_filesystem(folder)
        for batch in batches:
            names = []
            for old, shard, seq in zip(*(batch.column(k).to_pylist() for k in range(3))):
                names.append(f"{shard:05d}-{seq:05d}.warc.gz")
                old, new = f"{root}/{old}", f"{root}/{names[-1]}"
                if files.get_file_info(old).type != fs.FileType.NotFound:  # else an earlier attempt moved it
                    files.move(old, new)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *batch.columns[1:]], names=batch.schema.names)

    done.mapInArrow(rename, _MANIFEST).write.parquet(f"{folder}/manifest-new")
    files.move(f"{root}/manifest-new", f"{root}/manifest")
    files.delete_dir(f"{root}/tmp")  # what is left there is of failed attempts
    return read_manifest(spark, folder)


def read_manifest(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{folder}/manifest")


def archive_pages(pages: DataFrame, folder: str, **options) -> DataFrame:
    """Write a record of every row of ``pages`` (``page_id, url, html``); returns the manifest.

    A null ``html`` is an empty payload, a null ``url`` the target ``about:blank``; rows
    without an id are records whose id has no number.  Repeated rows are written as often
    as they come.  Other columns are ignored.  An empty table gives an empty archive.
    """
    rows = payload_rows(pages)
    return write_archives(page_records(pages, rows), rows, folder, **options)


# ---- reading ---------------------------------------------------------------------------
def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every record
    of the archives that the manifest lists.  Digests are checked; a record that is damaged
    is an error."""
    listed = read_manifest(spark, folder).select("file", "shard")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = arrow_filesystem(folder)

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([dict(zip(_RECORD_TYPES.names, r)) for r in rows], _RECORD_TYPES)

        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[tuple] = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for headers, block in read_records(gzip.GzipFile(fileobj=stream)):
                        rows.append(parse_record(headers, block))
                        if len(rows) >= 10_000:
                            yield flush(rows)
                            rows = []
                if rows:
                    yield flush(rows)

    files = listed.count()
    spread = listed.repartition(max(1, min(files, 4 * shuffle_partitions(spark))), "file")
    return spread.mapInArrow(read, _RECORD)
