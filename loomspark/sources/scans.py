"""Bounded scans of source tables in windows, and replays of JSON files."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass(frozen=True)
class After:
    """Rows strictly after ``(ts, pk)``."""

    ts: datetime
    pk: int


@dataclass(frozen=True)
class Since:
    """Rows from ``ts`` on."""

    ts: datetime


@dataclass(frozen=True)
class Everything:
    """All rows; must be asked for."""


def after_cursor(ts: Column, pk: Column, cursor: After) -> Column:
    """``(ts, pk) > cursor`` in a form whose first part is pushed to the file reader."""
    at = F.lit(cursor.ts).cast("timestamp_ntz")
    return (ts >= at) & ((ts > at) | (pk > cursor.pk))


def in_window(ts: Column, pk: Column, window: After | Since | Everything) -> Column:
    if isinstance(window, After):
        return after_cursor(ts, pk, window)
    if isinstance(window, Since):
        return ts >= F.lit(window.ts).cast("timestamp_ntz")
    if isinstance(window, Everything):
        return F.lit(True)
    raise ValueError(f"unknown window {window!r}")


def micros(rows: DataFrame, ts: str) -> Column:
    """A time column of ``rows`` as microseconds, naive times as they are."""
    if rows.schema[ts].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(ts))
    return F.unix_micros(F.col(ts).cast("timestamp"))


def fetch_limit(asked: int | None, default: int = 200, most: int = 5000) -> int:
    """Limit of an ingestion scan; one that isn't a positive whole number is an error."""
    if asked is None:
        return default
    if isinstance(asked, bool) or not isinstance(asked, int) or asked < 1:
        raise ValueError("limit must be a positive whole number")
    return min(asked, most)


def read_limit(asked: int | None, default: int = 100, most: int = 200) -> int:
    """Limit of a read model; an unusable one becomes the default."""
    if isinstance(asked, bool) or not isinstance(asked, int) or asked < 1:
        return default
    return min(asked, most)


def scan(table: DataFrame, columns: list[str | Column], ts: str, pk: str, window, limit: int | None = None, most: int = 5000) -> DataFrame:
    """Columns of the rows in a window; with a limit (``most`` at most), the first in source order."""
    rows = table.where(in_window(F.col(ts), F.col(pk), window))
    return (rows if limit is None else rows.orderBy(ts, pk).limit(fetch_limit(limit, most=most))).select(*columns)


# ---- fixed values ----------------------------------------------------------------------
#: What is read of each source, by name; its key and time are the first column and SOURCE_TIMES'.
SOURCE_COLUMNS = {
    "ebay": ("id", "ext_message_id", "message_id", "sub_source", "item_id", "folder_id", "message_type", "sender_id", "receiver_id", "receive_date"),
    "amazon": ("id", "message_id", "sub_source", "from_msg", "from_name", "message_type", "order_id", "asin", "message_date", "message_content"),
    "shopify": ("id", "message_id", "sub_source", "from_msg", "to_msg", "subject", "order_id", "message_date", "message_content"),
    "bandq": ("id", "message_id", "sub_source", "message_type", "order_id", "message_date", "message_content"),
    "temu": ("id", "message_id", "sub_source", "message_type", "order_id", "message_date", "message_content"),
}
SOURCE_TIMES = {"ebay": "receive_date"}
#: Columns given as text, so that large ids and times come through as they are.
AS_TEXT = ("id", "ext_message_id", "item_id", "receive_date", "message_date")
#: Most rows of a scan of headers; other sources have the common cap.
SOURCE_CAPS = {"ebay": 1000}
# ----------------------------------------------------------------------------------------


def source_scan(source: str, table: DataFrame, window, limit: int | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """What is read of a source in a window, ids and times as text; headers with their bodies.

    Rows are chosen and put in order by key and time before these become text, and headers are
    bounded before they meet their bodies.
    """
    ts = SOURCE_TIMES.get(source, "message_date")
    rows = scan(table, list(SOURCE_COLUMNS[source]), ts, "id", window, limit, SOURCE_CAPS.get(source, 5000))
    if bodies is not None:
        rows = with_bodies(rows, bodies)
    return rows.select(*(F.col(c).cast("string").alias(c) if c in AS_TEXT else F.col(c) for c in rows.columns))


def with_bodies(headers: DataFrame, bodies: DataFrame) -> DataFrame:
    """Headers with the body of their external id, which is unique; headers without one stay."""
    bodies = bodies.select(F.col("message_id").alias("_body_id"), F.col("message").alias("body_raw"))
    return headers.join(bodies, F.col("ext_message_id") == F.col("_body_id"), "left").drop("_body_id")


def replay_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Rows of files that hold a JSON array each; a row that doesn't fit the schema is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def check_columns(table: DataFrame, schema: StructType) -> DataFrame:
    """The columns of a contract; one that is missing or of another type is an error."""
    have = {f.name: f.dataType for f in table.schema}
    wrong = [f.name for f in schema if have.get(f.name) != f.dataType]
    if wrong:
        raise ValueError(f"columns differ from the contract: {', '.join(wrong)}")
    return table.select(*schema.names)
