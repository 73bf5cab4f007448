"""What several operators of this subpackage need: shared folders and skew-proof joins."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words, as a regular-expression class body.
SPACE_CLASS = r"\x20\x09-\x0D"
#: The same characters, for ``translate``.
SPACE_CHARS = " \t\n\x0b\f\r"

#: A group with more than 1/HOT_SHARE of all rows is hot, so at most HOT_SHARE groups are.
HOT_SHARE = 1000

#: Bitmaps of a sieve: 4 MB together.
SIEVE_MAPS = 1024

#: Bytes of a batch sent to Python, and of the texts that are Python strings at a time.
BATCH_BYTES = 4 << 20
SLICE_BYTES = 2 << 20

_own_dirs: dict[str, str] = {}
#: Folders of the tables written since the innermost ``intermediates`` began.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the folder that driver and executors share.

    The folder is the session's ``spark.checkpoint.dir``.  Only a local session
    without that setting gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _own_dirs:
            _own_dirs[app] = tempfile.mkdtemp(prefix="spark-")
            spark.sparkContext.setCheckpointDir(_own_dirs[app])
        base = _own_dirs[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def arrow_filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a path as Spark writes it (``s3a://`` and ``abfss://`` are Hadoop's names)."""
    if "://" not in path and path.startswith("file:"):
        path = path.removeprefix("file:")
    for spark, arrow in (("s3a://", "s3://"), ("s3n://", "s3://"), ("abfss://", "abfs://")):
        if path.startswith(spark):
            path = arrow + path.removeprefix(spark)
    return fs.FileSystem.from_uri(path)


def passing_dir(spark: SparkSession, name: str) -> str:
    """A ``shared_dir`` whose files go with the tables of the innermost ``intermediates``, if any."""
    path = shared_dir(spark, name)
    if _open:
        _open[-1].append(path)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: later steps read it and its lineage ends there."""
    path = passing_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes, in the end, the tables that ``written`` has made inside.

    For work whose result is itself stored inside another block, or elsewhere: what still reads
    the tables can't be used any more.
    """
    _open.append([])
    try:
        yield
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path
        for folder in _open.pop():
            folder = path(folder)
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def stored(make: Callable[[], DataFrame], spark: SparkSession, name: str) -> DataFrame:
    """What ``make`` gives, as a table of its own; the tables that it took on the way are gone."""
    path = shared_dir(spark, name)
    with intermediates(spark):
        df = make()
        df.write.parquet(path)
    if _open:
        _open[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bounded_batches(spark: SparkSession) -> None:
    """Batches to Python hold BATCH_BYTES at most (but one row at least), unless the session says otherwise."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if not spark._jsparkSession.sessionState().conf().contains(name):
        spark.conf.set(name, str(BATCH_BYTES))


def sliced(batches: Iterator[pa.RecordBatch], column: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches in parts whose ``column`` has ``size`` bytes at most, or that are one row."""
    for batch in batches:
        first, held = 0, 0
        for k, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
            if k > first and held + n > size:
                yield batch.slice(first, k - first)
                first, held = k, 0
            held += n
        if batch.num_rows > first:
            yield batch.slice(first)


def tidy(work: Callable) -> Callable:
    """``work`` for ``mapInArrow`` and the like, which gives memory back to the system when a task
    ends: Python workers are used again by other tasks, also of other stages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            trim()

    return run


def trim() -> None:
    """Give free memory of this process back to the system, where that can be asked for."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def hashable(df: DataFrame) -> list[str]:
    """The columns that can be hashed: those that hold no map, at any depth."""
    return [f.name for f in df.schema if "map<" not in f.dataType.simpleString()]


def code_points(text: Column) -> Column:
    return F.char_length(F.coalesce(text, F.lit("")))


def word_count(text: Column) -> Column:
    """Number of maximal runs of other characters than white space; 0 for null."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"[^{SPACE_CLASS}]+")).cast("long")


def spread_join(
    rows: DataFrame, groups: DataFrame, key: str, row_id: Column, size: str, total: int
) -> DataFrame:
    """Left-join ``rows`` to ``groups`` (one row per ``key``), however uneven the groups are.

    ``size`` names the column of ``groups`` with the number of rows of each group and
    ``total`` is the sum of them.  Groups with over ``total / HOT_SHARE`` rows are at most
    HOT_SHARE in number, so broadcasting them is bounded; their rows get a salt in the
    shuffle join that serves all other groups, where they find nothing.  That join is a
    sort-merge join at every size.  ``key`` is never null.  Columns of ``groups`` besides the key must not clash with those of ``rows``.
    """
    hot_from = max(2, total // HOT_SHARE)
    values = [c for c in groups.columns if c != key]
    hot = groups.where(F.col(size) > hot_from).select(key, *(F.col(c).alias(f"_hot_{c}") for c in values))
    # key and salt in one value: a salt column of its own that is always 0 on one side would be
    # folded away, and the rows dealt by the key alone
    no_salt = F.lit(0).cast("long")
    cold = groups.where(F.col(size) <= hot_from).select(
        F.struct(F.col(key).alias("key"), no_salt.alias("salt")).alias("_at"), *values
    )
    salt = F.when(F.col(f"_hot_{size}").isNotNull(), F.abs(F.xxhash64(row_id) % 1_000_003) + 1).otherwise(no_salt)
    return (
        rows.join(F.broadcast(hot), key, "left")
        .withColumn("_at", F.struct(F.col(key).alias("key"), salt.alias("salt")))
        .join(cold.hint("merge"), "_at", "left")
        .select(
            *(F.col(c) for c in rows.columns),
            *(F.coalesce(F.col(f"_hot_{c}"), F.col(c)).alias(c) for c in values),
        )
    )


def marked(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column, mark: str) -> DataFrame:
    """``rows`` with ``mark``: true if the key is among ``wanted``'s keys, and for a few others.

    A sieve to go before a shuffle join: keys are hashed to the bits of SIEVE_MAPS bitmaps
    of 4 KB, which are broadcast, so what is sent has a fixed bound; the more keys there
    are, the more other rows are marked.  Null keys are keys as others are.
    """
    bits = 32_768

    def place(key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(SIEVE_MAPS * bits))

    maps = wanted.select(place(wanted_key).alias("p")).groupBy((F.col("p") / bits).cast("int").alias("_map"))
    maps = maps.agg(F.bitmap_construct_agg(F.col("p") % bits).alias("_bits"))
    at = F.col("_place") % bits
    byte = F.conv(F.hex(F.expr("substring(_bits, int(_place % 32768 div 8) + 1, 1)")), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))
    return (
        rows.withColumn("_place", place(key))
        .withColumn("_map", (F.col("_place") / bits).cast("int"))
        .join(F.broadcast(maps), "_map", "left")
        .select(*(F.col(f"`{c}`") for c in rows.columns), hit.alias(mark))
    )


def sifted(rows: DataFrame, key: Column, wanted: DataFrame, wanted_key: Column) -> DataFrame:
    """The ``rows`` whose key is among ``wanted``'s keys, and a few others: see ``marked``."""
    return marked(rows, key, wanted, wanted_key, "_hit").where("_hit").drop("_hit")


def one_row_each(docs: DataFrame, text_key: Column, dropped: DataFrame, repeated: DataFrame) -> DataFrame:
    """``docs`` without ``dropped`` rows, and with one row for each of ``repeated``.

    Both have ``text_key`` and ``doc_id``, distinct pairs that tell rows apart, whether or not
    an id repeats or is null; ``text_key`` is the key of a row of ``docs`` and never null.  Of
    repeated rows the longest text stays.  Only rows that a sieve of these pairs marks are
    joined with them, so most texts aren't shuffled.
    """
    id_type = docs.schema["doc_id"].dataType
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"), text_key.alias("_key"))
    repeated = repeated.select(F.col("text_key").alias("_of"), F.col("doc_id").cast(id_type).alias("_with"))
    gone = dropped.select(F.col("text_key").alias("_of"), F.col("doc_id").cast(id_type).alias("_with")).union(repeated)
    both = marked(rows, F.struct("_key", "_row.doc_id"), gone, F.struct("_of", "_with"), "_hit")
    clear, hit = both.where("NOT _hit").select("_row"), written(both.where("_hit").drop("_hit"), "hit")
    same = (F.col("_key") == F.col("_of")) & F.col("_row.doc_id").eqNullSafe(F.col("_with"))
    single = hit.join(gone, same, "left_anti").select("_row")
    # repeats come down to one row before they are shuffled, so a hot one is no burden
    order = F.struct((-code_points(F.col("_row.text"))).alias("less"), F.to_json("_row").alias("all"))
    again = sifted(hit, F.struct("_key", "_row.doc_id"), repeated, F.struct("_of", "_with"))
    again = again.groupBy("_key", F.col("_row.doc_id").alias("_id")).agg(F.min_by("_row", order).alias("_row"))
    again = again.join(repeated, (F.col("_key") == F.col("_of")) & F.col("_id").eqNullSafe(F.col("_with"))).select("_row")
    return clear.union(single).union(again).select("_row.*")


def min_label_components(edges: DataFrame, name: str) -> DataFrame:
    """Connected components of an undirected graph, as rows ``(node, root)``.

    ``edges`` has columns ``a`` and ``b`` of one orderable type; ``root`` is the smallest
    node of the component, and every node of an edge gets one row.  Alternates the
    large-star and small-star steps of Kiveris et al. (2014) until nothing changes; every
    round is written to the shared folder, so lineage stays short and nothing is collected
    but two numbers.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        else:  # each edge from its larger end to its smaller one
            both = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count("*").alias("ends"))
        least = written(least, f"{name}-least")
        # a hub can have a third of all edges
        joined = spread_join(both, least, "a", F.col("b"), "ends", least.agg(F.sum("ends")).first()[0] or 0)
        if large:
            moved = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        else:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
                joined.select("a", F.col("m").alias("b"))
            )
        return moved.where(F.col("a") != F.col("b")).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now = written(edges.select("a", "b").where(F.col("a") != F.col("b")).distinct(), name)
    seen = mark(now)
    while True:
        now = written(star(star(now, True), False), name)
        if (after := mark(now)) == seen:
            break
        seen = after
    # now a star for each component: every node but the root points to the root
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
