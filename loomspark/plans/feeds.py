"""From raw source rows to messages, threads and conversations, for each feed."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.operators import classify, threads, upsert
from loomspark.sources import scans


@dataclass(frozen=True)
class Feed:
    """What tells one source from another: how rows become messages, and threads."""

    marketplace: str
    messages: Callable[[DataFrame], DataFrame]
    rule: threads.ThreadingRule


def feeds(company_domains: list[str]) -> dict[str, Feed]:
    sources = {
        "ebay": classify.header_body_messages,
        "amazon": classify.relay_messages,
        "shopify": lambda rows: classify.mailbox_messages(rows, company_domains),
        "bandq": lambda rows: classify.inbound_messages(rows, "bandq", True),
        "temu": lambda rows: classify.inbound_messages(rows, "temu", False),
    }
    return {name: Feed(name, f, threads.RULES[name]) for name, f in sources.items()}


@dataclass(frozen=True)
class Outcome:
    """The lazy tables of a run; nothing runs until one is used."""

    counts: DataFrame
    messages: DataFrame
    unresolved: DataFrame
    conversations: DataFrame
    excluded: DataFrame | None = None


def derive(feed: Feed, raw: DataFrame) -> Outcome:
    """Messages of another marketplace, which a reader of rows from several may give, are in no
    thread; ``excluded`` counts them."""
    rows = feed.messages(raw)
    own, excluded = threads.of_marketplace(rows.where(F.col("row_class") == "message"), feed.marketplace)
    messages = threads.threaded(own, feed.rule)
    return Outcome(
        classify.class_counts(rows), messages, rows.where(F.col("row_class") == "ambiguous"), threads.conversations(messages, feed.rule), excluded
    )


def run_all(
    known: Mapping[str, Feed], raw: Mapping[str, DataFrame], write: Callable[[str, Outcome], None]
) -> tuple[list[str], dict[str, str]]:
    """Derive each feed and ``write`` its outcome, feed by feed; names of those that were written,
    and what was wrong with the others.  A feed that fails while it runs doesn't stop another."""
    done, failed = [], {}
    for name, rows in raw.items():
        try:
            write(name, derive(known[name], rows))
            done.append(name)
        except Exception as e:
            failed[name] = str(e)
    return done, failed


def derive_all(known: Mapping[str, Feed], raw: Mapping[str, DataFrame]) -> tuple[dict[str, Outcome], dict[str, str]]:
    """Lazy outcomes by feed, and what was wrong with those that can't be planned.  What fails only
    when it runs is told by ``run_all``."""
    done, failed = {}, {}
    for name, rows in raw.items():
        try:
            done[name] = derive(known[name], rows)
        except Exception as e:
            failed[name] = str(e)
    return done, failed


def all_conversations(outcomes: Mapping[str, Outcome]) -> DataFrame:
    tables = [o.conversations for o in outcomes.values()]
    out = tables[0]
    for more in tables[1:]:
        out = out.unionByName(more)
    return out


def total_counts(outcomes: Mapping[str, Outcome]) -> DataFrame:
    """A row for each feed with the rows examined and the classes they fell in."""
    out = None
    for name, o in outcomes.items():
        row = o.counts.select(F.lit(name).alias("feed_key"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def resume_window(cursor: tuple | None, start) -> scans.After | scans.Since:
    """Where a run goes on; one without a cursor starts at a time that somebody chose."""
    return scans.Since(start) if cursor is None or None in cursor else scans.After(*cursor)


@dataclass(frozen=True)
class Stored:
    """The tables that a run keeps; each run makes the next version of all three."""

    conversations: DataFrame
    messages: DataFrame
    cursors: DataFrame


IDENTITY = ["marketplace", "source_pk"]
THREAD = ["threading_rule_version", "thread_key"]
_COUNTS = ("message_count", "inbound_count")


#: What tells an unresolved message from others, and what a later run may change of it.
SOURCE_IDENTITY = ["source_database", "source_schema", "source_table", "source_pk"]
_UNRESOLVED_UPDATE = ("body_text", "body_decode_status", "source_reference")


def unresolved_upserted(stored: DataFrame, came: DataFrame) -> DataFrame:
    """The next version of the unresolved messages, with ``merge_action`` (see ``merge_counts``).

    Keyed by the full identity in the source: rows of two tables with one id are two messages.
    A message that comes again has its body, status and reference brought up to date; its time and
    all else stay.  Of rows of one identity in a batch the newest counts.
    """
    once = upsert.first_by(came, SOURCE_IDENTITY, F.desc_nulls_last("source_ts"), *(F.col(c) for c in _UNRESOLVED_UPDATE))
    return upsert.merged(stored, once.select(*stored.columns), SOURCE_IDENTITY, list(_UNRESOLVED_UPDATE))


def merge_counts(merged: DataFrame) -> DataFrame:
    """One row ``inserted, updated, kept`` of a merge."""
    return merged.agg(*(F.count_if(F.col("merge_action") == a).alias(a) for a in ("inserted", "updated", "kept")))


def persisted(
    stored: Stored, outcome: Outcome, feed_key: str, write: Callable[[str, DataFrame], DataFrame] = lambda name, df: df
) -> Stored:
    """Stored tables with an outcome merged in.

    Conversations are updated but for their counts and workflow state, and new ones are
    ``received``; messages keep their first time, and of rows of one message the newest counts;
    counts are taken anew from the messages stored; the cursor only moves forward.  The same
    outcome twice changes nothing.  ``write`` stores the messages and gives them back as read, so
    that they are merged once though two tables use them.
    """
    fresh = outcome.conversations.withColumn("workflow_state", F.lit("received")).select(*stored.conversations.columns)
    kept = {*THREAD, *_COUNTS, "workflow_state"}
    conversations = upsert.merged(stored.conversations, fresh, THREAD, [c for c in fresh.columns if c not in kept])
    came = outcome.messages.select(*stored.messages.columns)
    # of rows of one message and time the least by the other columns, so that reruns agree
    ties = [c for c in came.columns if c not in (*IDENTITY, "source_ts")]
    came = upsert.first_by(came, IDENTITY, F.desc("source_ts"), *ties)
    messages = upsert.merged(stored.messages, came, IDENTITY, [c for c in came.columns if c not in (*IDENTITY, "source_ts")])
    messages = write("messages", messages.drop("merge_action"))
    conversations = upsert.recounted(conversations.drop("merge_action"), messages).select(*stored.conversations.columns)
    batch = upsert.highest_cursor(outcome.messages).select(F.lit(feed_key).alias("feed_key"), "ts", "pk")
    return Stored(conversations, messages, upsert.advanced_cursors(stored.cursors, batch))
