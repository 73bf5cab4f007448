"""Threads: gap sessions, reference groups and the facts of a conversation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.sources import scans


def gap_segments(rows: DataFrame, keys: list[str], ts: str, pk: str, gap: str = "30 days", out: str = "segment") -> DataFrame:
    """Number, from 0, of each row's session: a new one starts after more than ``gap``.

    Times count to the millisecond.  A grouping by the same keys needs no further shuffle.
    """
    ordered = Window.partitionBy(*keys).orderBy(ts, pk)
    now = F.date_trunc("MILLISECOND", F.col(ts)).cast("timestamp_ntz")
    new = F.coalesce((now - F.lag(now).over(ordered)) > F.expr(f"interval {gap}"), F.lit(False))
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_new", new.cast("int")).withColumn(out, F.sum("_new").over(running)).drop("_new")


def _piece(bounds: dict[int, np.ndarray]):
    """A function of columns: number of a hot key (-1: none), time and hash to the number of a piece.

    That is how many of the key's sorted bounds are before the time, and of the pieces that begin
    with the time itself the hash chooses one.
    """

    @F.pandas_udf("int")
    def piece(key: pd.Series, at: pd.Series, tie: pd.Series) -> pd.Series:
        key, at, tie = key.to_numpy(), at.to_numpy(), tie.to_numpy()
        out = np.zeros(len(key), "int32")
        order = np.argsort(key, kind="stable")
        for mine in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            if len(mine) and key[mine[0]] in bounds:
                edges = bounds[key[mine[0]]]
                below = np.searchsorted(edges, at[mine], "left")
                same = np.searchsorted(edges, at[mine], "right") - below
                out[mine] = below + np.where(same > 0, 1 + tie[mine] % np.maximum(same, 1), 0)
        return pd.Series(out)

    return piece


def spread_gap_segments(
    rows: DataFrame, keys: list[str], ts: str, pk: str, gap: str = "30 days", out: str = "segment", most: int = 1_000_000
) -> DataFrame:
    """``gap_segments`` where a key may have more rows than a task should take.

    Keys with over ``most`` rows are cut into pieces of about ``most`` rows by quantiles of their
    times; many rows of one instant are dealt to several pieces, since none of them can start a
    session after another.  Each piece is scanned on its own and told by its first and last time and
    the breaks within; a second scan, over one row a piece, adds the breaks between pieces and sums
    up.  Rows are shuffled once.  Hot keys are ``rows / most`` at most, and only they are sent about;
    their bounds, a number a piece, are sent to all tasks and searched there by halving.
    """
    name = "_key"
    keyed = rows.withColumn(name, F.struct(*keys))
    counts = keyed.groupBy(name).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    largest = counts.agg(F.max("_n")).first()[0]
    if largest is None:
        return gap_segments(rows, keys, ts, pk, gap, out)
    cuts = -(-largest // most)
    micros = F.coalesce(scans.micros(rows, ts), F.lit(-(2**63)))  # rows without a time come first
    # all hot keys are cut as finely as the largest; of their bounds every so manyth is kept
    step = F.expr(f"{cuts} div ((_n + {most} - 1) div {most})")
    number = F.row_number().over(Window.orderBy(name)) - 1
    hot = F.broadcast(counts.select(name, number.alias("_hot"), step.alias("_step")))
    wanted = F.array(*(F.lit(k / cuts) for k in range(1, cuts)))
    bounds = keyed.join(hot, name).groupBy("_hot", "_step").agg(F.percentile_approx(micros, wanted, 10 * max(1000, cuts)).alias("all"))
    bounds = bounds.select("_hot", F.filter("all", lambda b, place: (place + 1) % F.col("_step") == 0).alias("kept"))
    piece = _piece({r["_hot"]: np.array(r["kept"], "int64") for r in bounds.collect()})
    cut = keyed.join(hot, name, "left")
    cut = cut.withColumn("_piece", piece(F.coalesce("_hot", F.lit(-1)), micros, F.xxhash64(pk))).drop("_hot", "_step")

    now = F.date_trunc("MILLISECOND", F.col(ts)).cast("timestamp_ntz")
    pause = F.expr(f"interval {gap}")
    within = Window.partitionBy(name, "_piece").orderBy(ts, pk)
    scanned = cut.withColumn("_now", now)
    scanned = scanned.withColumn("_new", F.coalesce((F.col("_now") - F.lag("_now").over(within)) > pause, F.lit(False)).cast("long"))
    scanned = scanned.withColumn("_local", F.sum("_new").over(within.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    pieces = scanned.groupBy(name, "_piece").agg(F.min("_now").alias("_first"), F.max("_now").alias("_last"), F.sum("_new").alias("_breaks"))
    across = Window.partitionBy(name).orderBy("_piece")
    starts = F.coalesce((F.col("_first") - F.lag("_last").over(across)) > pause, F.lit(False)).cast("long")
    pieces = pieces.withColumn("_starts", starts)
    before = F.sum(F.col("_starts") + F.col("_breaks")).over(across.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_breaks")
    offsets = pieces.select(name, "_piece", before.alias("_offset"))
    found = scanned.join(offsets.hint("merge"), [name, "_piece"])
    return found.select(*rows.columns, (F.col("_local") + F.col("_offset")).alias(out))


@dataclass(frozen=True)
class ThreadingRule:
    """How messages of a marketplace hang together.

    ``by_item`` groups by listing and counterparty with gaps; else by order reference, and a
    message without one is a thread of its own.
    """

    version: str
    lone_version: str
    by_item: bool = False
    needs_context: bool = True
    gap: str = "30 days"


#: The rules by marketplace.
RULES = {
    "ebay": ThreadingRule("ebay-item-counterparty-gap-v1", "ebay-counterparty-gap-v1", True, False),
    "amazon": ThreadingRule("amazon-order-thread-v1", "amazon-unresolved-singleton-v1", False, False),
    "bandq": ThreadingRule("bandq-source-order-thread-v1", "bandq-unresolved-singleton-v1"),
    "shopify": ThreadingRule("shopify-order-thread-v1", "shopify-unresolved-singleton-v1"),
    "temu": ThreadingRule("temu-unresolved-singleton-v1", "temu-unresolved-singleton-v1"),
}


def threaded(messages: DataFrame, rule: ThreadingRule) -> DataFrame:
    """Messages with ``threading_rule_version``, ``threading_strategy``, ``needs_context``,
    ``segment`` and ``thread_key``."""
    if rule.by_item:
        lone = F.col("listing_item_ref").isNull()
        keys = ["sub_source_id", "listing_item_ref", "counterparty_ref"]
        rows = gap_segments(messages, keys, "source_ts", "source_pk", rule.gap)
    else:
        lone = T.is_unresolved_reference(F.col("counterparty_ref"))
        rows = messages.withColumn("segment", F.lit(0).cast("long"))
    strategy = F.when(F.lit(rule.by_item) & ~lone, "item_linked").otherwise("no_item")
    rows = rows.withColumns(
        {
            "threading_rule_version": F.when(lone, rule.lone_version).otherwise(rule.version),
            "threading_strategy": strategy,
            "needs_context": lone | F.lit(rule.needs_context),
        }
    )
    key = T.thread_key(*(F.col(c) for c in (
        "threading_rule_version", "threading_strategy", "sub_source_id", "listing_item_ref", "counterparty_ref", "segment",
    )))
    return rows.withColumn("thread_key", key)


def agreed(value: str) -> Column:
    """The value that all rows of a group agree on, null being one; else null."""
    x = F.col(value)
    return F.when((F.min(x) == F.max(x)) & (F.count(x) == F.count(F.lit(1))), F.min(x))


def conversations(messages: DataFrame, rule: ThreadingRule) -> DataFrame:
    """One row for each thread, with its first and last time, counts and inbox placement.

    A thread is filtered if each of its messages has a reason, which is then its first
    message's; else it is in the reply inbox if a message came in.  Messages are grouped by what
    ``threaded`` told them apart by, so sessions need no second shuffle, and the key is written
    out once a thread.
    """
    keys = ["marketplace", "threading_rule_version", "threading_strategy", "sub_source_id", "counterparty_ref", "segment"]
    if rule.by_item:
        keys.append("listing_item_ref")
        listing, parts = F.col("listing_item_ref"), []
    else:
        listing, parts = F.lit(None).cast("string"), [agreed("listing_item_ref").alias("listing_item_ref")]
    facts = messages.groupBy(*keys).agg(
        *parts,
        F.min("source_ts").alias("first_source_ts"),
        F.max("source_ts").alias("last_source_ts"),
        F.count("*").alias("message_count"),
        F.count_if(F.col("direction") == "inbound").alias("inbound_count"),
        F.count_if(F.col("direction") == "outbound").alias("outbound_count"),
        F.bool_or("needs_context").alias("needs_context"),
        F.bool_and(F.col("filter_reason").isNotNull()).alias("_all"),
        F.min_by("filter_reason", F.struct("source_ts", "source_pk")).alias("_reason"),
    )
    placement = F.when(F.col("_all"), "filtered").when(F.col("inbound_count") > 0, "reply_inbox").otherwise("outbound_only")
    identity = ("threading_rule_version", "threading_strategy", "sub_source_id")
    key = T.thread_key(*(F.col(c) for c in identity), listing, F.col("counterparty_ref"), F.col("segment"))
    return facts.withColumns(
        {"thread_key": key, "inbox_placement": placement, "inbox_filter_reason": F.when(F.col("_all"), F.col("_reason"))}
    ).drop("_all", "_reason", "segment")


def in_thread_order(threads: DataFrame) -> DataFrame:
    """Threads by the time they began, then by key."""
    return threads.orderBy("first_source_ts", "thread_key")


def of_marketplace(messages: DataFrame, marketplace: str) -> tuple[DataFrame, DataFrame]:
    """A marketplace's messages, and one row ``excluded_unusable``: how many were another's, which
    no thread may take in."""
    own = F.coalesce(F.col("marketplace") == marketplace, F.lit(False))
    return messages.where(own), messages.agg(F.count_if(~own).alias("excluded_unusable"))


def thread_problems(messages: DataFrame, threads: DataFrame) -> DataFrame:
    """Threads that lack messages or have some too many; none, if all is well."""
    counted = messages.groupBy("thread_key").agg(F.count("*").alias("there"))
    both = counted.join(threads.select("thread_key", "message_count"), "thread_key", "full")
    return both.where(~F.col("there").eqNullSafe(F.col("message_count")))
