"""Exact deduplication with a persistent index of text digests.

The index is a table bucketed and sorted by digest, so it is never shuffled again: a batch
of rows is shuffled once to its buckets, and a sort-merge anti-join tells which digests are
new.  What is known of the others grows by appended rows, too.  Only DataFrame operations
are used.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm._shared import SPACE_CHARS, code_points, one_row_each, passing_dir, shuffle_partitions, spread_join, stored, written
from loomspark.llm.manifests import Conflict, Manifests

#: Appends in which a table comes to a new index.
BATCHES = 3


def text_digest(text: Column) -> Column:
    """Lower-case hex SHA-256 of the text without white space; null counts as empty."""
    return F.sha2(F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, "").cast("binary"), 256)


class DigestIndex:
    """Digests of all texts seen so far, with the document that stands for each.

    ``path`` holds the files and all that is needed to read them: the number of buckets and the
    type of the ids, which an index keeps for good, and manifests that list the segments that
    count.  The catalog's table is only a view of them that each session makes for itself.  Each
    append is a segment: a row for each digest of the batch, marked ``first`` if the index didn't
    hold it.  So an append is there as a whole or not at all, and of two writers one starts again
    on what the other has added.

    A new index takes ``buckets`` (by default as many as a shuffle has partitions) and ``id_type``;
    for one that is there, other values than its own are an error.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None, id_type: str | None = None):
        self.spark, self.path = spark, path.rstrip("/")
        self.manifests = Manifests(spark, f"{self.path}/manifests")
        layout = Manifests(spark, f"{self.path}/layout")
        if layout.version() == 0:
            try:
                layout.commit(0, {"buckets": buckets or shuffle_partitions(spark), "id_type": id_type or "bigint"})
            except Conflict:  # another writer has made it meanwhile
                pass
        there = layout.read()
        self.buckets, self.id_type = there["buckets"], there["id_type"]
        if buckets not in (None, self.buckets) or id_type not in (None, self.id_type):
            raise ValueError(f"this index has {self.buckets} buckets and ids of type {self.id_type}")
        self.table = "digest_index_" + hashlib.sha1(self.path.encode()).hexdigest()
        if spark.catalog.tableExists(self.table):  # a lasting catalog may know an index that was here before
            said = {r["col_name"]: r["data_type"] for r in spark.sql(f"DESCRIBE TABLE EXTENDED {self.table}").collect()}
            if (said.get("Num Buckets"), said.get("keep_id")) != (str(self.buckets), self.id_type):
                self.close()
        self._create()

    def _create(self) -> None:
        self.spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} "
            f"(digest STRING, first BOOLEAN, chars BIGINT, keep_id {self.id_type}, group_size BIGINT, segment STRING) USING parquet "
            f"PARTITIONED BY (segment) CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{self.path}/segments'"
        )

    def close(self) -> None:
        """Take the table out of the catalog; the index itself stays."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def entries(self, version: int | None = None) -> DataFrame:
        """The rows of a version's segments, the newest version's by default."""
        segments = self.manifests.read(version).get("segments", [])
        if segments:  # the catalog may not know those of other sessions and writers
            parts = " ".join(f"PARTITION (segment='{s}')" for s in segments)
            self.spark.sql(f"ALTER TABLE {self.table} ADD IF NOT EXISTS {parts}")
        return self.spark.table(self.table).where(F.col("segment").isin(segments)).drop("segment")

    def rows(self, version: int | None = None) -> DataFrame:
        """``digest, keep_id, group_size`` of every digest; grouped in its buckets, without a shuffle."""
        best = F.min(F.struct((-F.col("chars")).alias("less"), F.col("keep_id").isNull().alias("no_id"), "keep_id"))
        rows = self.entries(version).groupBy("digest").agg(best.alias("best"), F.sum("group_size").alias("group_size"))
        return rows.select("digest", F.col("best.keep_id").alias("keep_id"), "group_size")

    def _write(self, rows: DataFrame) -> str:
        segment = uuid.uuid4().hex
        rows = rows.select("digest", "first", "chars", "keep_id", "group_size", F.lit(segment).alias("segment"))
        rows.repartition(self.buckets, "digest").write.insertInto(self.table)  # one file for each bucket
        self.spark.catalog.refreshTable(self.table)
        return segment

    def append(self, digests: DataFrame) -> int:
        """Add a batch and return the version.

        ``digests`` has ``digest``, ``doc_id`` and ``chars``.  Of rows with one digest, in this
        batch or others, the one with the most characters, then the smallest id, stands for
        all; a null id comes last.
        """
        best = F.struct(
            (-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id")
        )
        # written, or the optimiser joins before it groups and shuffles every row
        fresh = written(digests.groupBy("digest").agg(F.min(best).alias("best"), F.count("*").alias("group_size")), "fresh")
        fresh = fresh.select(
            "digest", (-F.col("best.less")).cast("bigint").alias("chars"), F.col("best.id").alias("keep_id"), "group_size"
        )
        while True:
            base = self.manifests.version()
            there = self.entries(base).where("first").select("digest").hint("merge")
            new = fresh.join(there, "digest", "left_anti").withColumn("first", F.lit(True))
            again = fresh.join(there, "digest", "left_semi").withColumn("first", F.lit(False))
            segment = self._write(new.unionByName(again))
            try:
                return self.manifests.commit(base, {"segments": [*self.manifests.read(base).get("segments", []), segment]})
            except Conflict:
                continue

    def compact(self) -> int:
        """Merge all segments into one, as rows of one batch; returns the version."""
        while True:
            base = self.manifests.version()
            whole = self.entries(base).groupBy("digest").agg(
                F.min(F.struct((-F.col("chars")).alias("less"), F.col("keep_id").isNull().alias("no_id"), "keep_id")).alias("b"),
                F.sum("group_size").alias("group_size"),
            )
            rows = whole.select(
                "digest", F.lit(True).alias("first"), (-F.col("b.less")).alias("chars"), F.col("b.keep_id").alias("keep_id"), "group_size"
            )
            try:
                return self.manifests.commit(base, {"segments": [self._write(rows)]})
            except Conflict:
                continue

    def vacuum(self, before: int | None = None) -> None:
        """Delete the manifests of versions older than ``before`` (by default, than the newest), and
        the segments that no manifest names then, those of appends that failed among them.  Not while
        another writer appends: its segment isn't named yet."""
        self.manifests.drop_before(self.manifests.version() if before is None else before)
        named = {s for v in self.manifests.versions() for s in self.manifests.read(v).get("segments", [])}
        files, path_of = self.manifests.fs, self.manifests.path_of
        root = path_of(f"{self.path}/segments")
        for status in files.listStatus(root) if files.exists(root) else ():
            segment = status.getPath().getName().partition("segment=")[2]
            if segment and segment not in named:
                self.spark.sql(f"ALTER TABLE {self.table} DROP IF EXISTS PARTITION (segment='{segment}')")
                files.delete(status.getPath(), True)

    def unseen(self, digests: DataFrame) -> DataFrame:
        """The rows whose digest the index doesn't hold."""
        return digests.join(self.entries().where("first").select("digest").hint("merge"), "digest", "left_anti")


def digest_rows(docs: DataFrame) -> DataFrame:
    """``(doc_id, chars, digest)`` of every row, written once so that texts are read once."""
    return written(
        docs.select("doc_id", code_points(F.col("text")).alias("chars"), text_digest(F.col("text")).alias("digest")),
        "digests",
    )


def exact_duplicates(docs: DataFrame, batches: int = BATCHES) -> DataFrame:
    """Which document stays of each group of equal texts.

    The rows come to a new index in ``batches`` appends, dealt by a hash of the id; the result
    doesn't depend on them.

    Returns ``doc_id, keep_id, group_size, kept, text_sha256`` for every row of ``docs``
    (columns ``doc_id`` and ``text``; others are ignored).  Texts are equal when they are
    identical without white space; a null text is an empty one, and empty texts are equal.
    The longest original text stays, then the smallest ``doc_id``; rows without an id
    stay only if no equal text has one.  Rows that repeat both id and text count in
    ``group_size`` and stay or go together.  An empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = digest_rows(docs)
    index = DigestIndex(spark, passing_dir(spark, "index"), id_type=dict(rows.dtypes)["doc_id"])
    batch = F.pmod(F.xxhash64("doc_id", F.lit("batch")), F.lit(batches))
    for k in range(batches):
        index.append(rows.where(batch == k))
    groups = written(index.rows().where(F.col("group_size") > 1), "groups")
    index.close()
    total = rows.count()
    row_id = F.struct("doc_id", "chars")
    found = spread_join(rows, groups, "digest", row_id, "group_size", total)
    alone = F.col("group_size").isNull()
    keep = F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id"))
    return found.select(
        "doc_id",
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def one_of_each_text(docs: DataFrame) -> DataFrame:
    """One row of each group of equal texts, with all its columns.

    It is the row that ``exact_duplicates`` keeps.  Rows are told apart by id and text, so an
    id that has several texts keeps those that stay, and of rows that repeat id and text, or
    of equal texts without ids, one stays.
    """

    def copies() -> DataFrame:
        rows = exact_duplicates(docs).where(F.col("group_size") > 1)
        return rows.groupBy(F.col("text_sha256").alias("text_key"), "doc_id", "kept").agg(F.count("*").alias("rows"))

    keys = stored(copies, docs.sparkSession, "copies")
    repeated = keys.where(F.col("kept") & (F.col("rows") > 1))
    return one_row_each(docs, text_digest(F.col("text")), keys.where(~F.col("kept")), repeated)
