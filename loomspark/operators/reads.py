"""Read models: inbox, threads, feeds, histories, usage and orders."""

from __future__ import annotations

import re
from collections.abc import Sequence
from decimal import Decimal

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators.upsert import first_by
from loomspark.sources.scans import micros, read_limit

# Order statuses by what they mean.
ACTIVE_ORDER_STATUSES = ("Completed", "Refunded", "Inprogress", "New", "Hold")
TERMINATED_ORDER_STATUSES = ("Deleted", "Cancelled")


def newest(rows: DataFrame, ts: str, tie: str, limit: int | None = None, where: Column | None = None) -> DataFrame:
    """The newest rows first, larger ``tie`` first among equals: the inbox and the feed."""
    rows = rows if where is None else rows.where(where)
    return rows.orderBy(F.desc(ts), F.desc(tie)).limit(read_limit(limit))


def conversation_id(asked: str) -> int | None:
    """The number of an id that comes from outside; None if it is none."""
    return int(asked) if re.fullmatch("[1-9][0-9]{0,18}", asked, re.ASCII) else None


def marketplace(asked: str | None, known: Sequence[str]) -> str | None:
    """A name from outside, if it is a known one."""
    return asked if asked in known else None


def conversation_detail(
    conversations: DataFrame, messages: DataFrame, id: int, marketplace: str | None = None, key: str = "conversation_id"
) -> tuple[DataFrame, DataFrame]:
    """A conversation and its messages in order; both empty if it is another marketplace's."""
    one = conversations.where(F.col(key) == id)
    one = one if marketplace is None else one.where(F.col("marketplace") == marketplace)
    mine = messages.where(F.col(key) == id).join(one.select(key), key, "left_semi")
    return one, mine.orderBy("source_ts", F.col("source_pk").cast("bigint"))


def row_at(rows: DataFrame, offset: int, *order: str) -> DataFrame:
    """The row at a place of an order, counted from 0: where a page begins."""
    return rows.orderBy(*order).offset(offset).limit(1)


def page_starts(rows: DataFrame, size: int, ts: str, pk: str, most: int = 1_000_000) -> DataFrame:
    """``page, ts, pk`` of the row that begins each page of ``size`` rows, in the order of both.

    Rows are cut by quantiles of their times into ranges of about ``most`` rows, which are counted
    and sorted each on its own; a row's place is its place within and the rows of the ranges before.
    Rows of one instant are one range.  A time finds its range by binary search, and not by a
    function over an array of bounds, from which Spark infers a filter that it can't run.
    """
    at = micros(rows, ts)
    cuts = -(-rows.count() // most)
    bounds = []
    if cuts > 1:
        wanted = F.array(*(F.lit(k / cuts) for k in range(1, cuts)))
        bounds = sorted(set(rows.agg(F.percentile_approx(at, wanted, 10 * max(1000, cuts))).first()[0] or []))
    first = float("-inf")  # the place of rows without a time
    cut = rows.select(F.col(ts).alias("ts"), F.col(pk).alias("pk"), F.coalesce(at.cast("double"), F.lit(first)).alias("_at"))
    if bounds:
        cut = Bucketizer(splits=[first, *map(float, bounds), float("inf")], inputCol="_at", outputCol="_range").transform(cut)
    else:
        cut = cut.withColumn("_range", F.lit(0.0))
    cut = cut.select("ts", "pk", F.col("_range").cast("int").alias("_range"))
    before = F.sum("n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))  # a row a range
    counts = cut.groupBy("_range").agg(F.count("*").alias("n")).select("_range", F.coalesce(before, F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("ts", "pk"))
    place = cut.withColumn("_place", within).join(F.broadcast(counts), "_range").withColumn("_place", F.col("_before") + F.col("_place") - 1)
    return place.where(F.col("_place") % size == 0).select(F.expr(f"_place div {int(size)}").alias("page"), "ts", "pk")


def message_summary(rows: DataFrame) -> DataFrame:
    """One row on classified rows: how many of each class, and what the messages are like."""
    message = F.col("row_class") == "message"
    kinds = (F.count_if(F.col("row_class") == k).alias(k) for k in ("message", "notice", "ambiguous", "unusable"))
    sides = (F.count_if(message & (F.col("direction") == d)).alias(d) for d in ("inbound", "outbound"))
    bodies = (F.count_if(message & (F.col("body_decode_status") == b)).alias(f"body_{b}") for b in ("decoded", "empty", "failed"))
    return rows.agg(
        F.count("*").alias("examined"), *kinds, *sides, F.count_if(message & F.col("listing_item_ref").isNotNull()).alias("with_item"),
        *bodies, F.min(F.when(message, F.col("source_ts"))).alias("oldest"), F.max(F.when(message, F.col("source_ts"))).alias("newest"),
    )


def thread_summary(conversations: DataFrame) -> DataFrame:
    """A row for each threading rule: conversations, those that need context or a reply, the largest."""
    return conversations.groupBy("threading_rule_version").agg(
        F.count("*").alias("conversations"), F.count_if("needs_context").alias("needs_context"),
        F.count_if(F.col("inbox_placement") == "reply_inbox").alias("reply_inbox"), F.max("message_count").alias("largest"),
    )


def repeated_ids(rows: DataFrame, pk: str) -> DataFrame:
    """One row: how many rows there are, and how many of them repeat an id."""
    per = rows.groupBy(pk).agg(F.count("*").alias("_n"))
    n = F.coalesce(F.sum("_n"), F.lit(0))
    return per.agg(n.alias("rows"), (n - F.count("*")).alias("repeated"))


def context_flags(conversations: DataFrame, by: str = "marketplace") -> DataFrame:
    return conversations.groupBy(by).agg(F.bool_and("needs_context").alias("all_need_context"))


def latest_usage(usage: DataFrame, key: str = "draft_revision_id") -> DataFrame:
    """The last call for each revision; one that isn't for a revision doesn't count."""
    return first_by(usage.where(F.col(key).isNotNull()), [key], F.desc("created_at"), "provider", "model")


def missing_attachments(messages: DataFrame, sources: DataFrame, pk: str = "source_pk") -> DataFrame:
    """``pk, attachments``: addresses that the sources have and the stored messages lack or
    have otherwise.  Lists are JSON, so they compare as text."""
    urls = F.to_json(T.usable_urls(F.col("attachments")))
    new = sources.where(F.col("attachments").isNotNull()).select(pk, urls.alias("_urls")).where(F.col("_urls") != "[]")
    both = messages.select(pk, "attachments").join(new, pk)
    return both.where(~F.col("attachments").eqNullSafe(F.col("_urls"))).select(pk, F.col("_urls").alias("attachments"))


def messages_of(messages: DataFrame, conversations: DataFrame, marketplace: str, source_table: str) -> DataFrame:
    """Messages of one table of a source whose conversation is of a marketplace: those that a
    backfill goes over."""
    own = conversations.where(F.col("marketplace") == marketplace).select("conversation_id")
    return messages.where(F.col("source_table") == source_table).join(own, "conversation_id", "left_semi")


def thread_in_order(messages: DataFrame, thread: Column, ts: str = "source_ts", pk: str = "source_pk") -> DataFrame:
    return messages.where(thread).orderBy(ts, F.col(pk).cast("bigint"))


def usage_summary(usage: DataFrame, as_of: Column) -> DataFrame:
    """One row, for an empty log too: calls, tokens, cost, calls without a cost or in the last day."""
    tokens = ("input_tokens", "output_tokens", "total_tokens")
    return usage.agg(
        F.count("*").alias("calls"),
        *(F.coalesce(F.sum(t), F.lit(0)).alias(t) for t in tokens),
        F.sum("estimated_cost_usd").alias("cost"),
        F.count_if(F.col("estimated_cost_usd").isNull()).alias("calls_without_cost"),
        F.count_if(F.col("created_at") > as_of - F.expr("interval 24 hours")).alias("calls_last_day"),
        F.max("created_at").alias("last_call"),
    )


def usage_by_model(usage: DataFrame) -> DataFrame:
    out = usage.groupBy("provider", "model").agg(
        F.count("*").alias("calls"), F.coalesce(F.sum("total_tokens"), F.lit(0)).alias("total_tokens"),
        F.sum("estimated_cost_usd").alias("cost"),
    )
    return out.orderBy(F.desc("calls"), "provider", "model")


def nested(parents: DataFrame, children: DataFrame, keys: Sequence[str], fields: Sequence[str], out: str) -> DataFrame:
    """Each parent with the ordered list of its children, empty where it has none."""
    lists = children.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("_list"))
    empty = F.array().cast(lists.schema["_list"].dataType)
    return parents.join(lists, list(keys), "left").withColumn(out, F.coalesce("_list", empty)).drop("_list")


def draft_history(drafts: DataFrame, revisions: DataFrame, citations: DataFrame) -> DataFrame:
    """Revisions of each draft, the newest first, with their citations; the first is current."""
    rows = drafts.select("draft_id", "conversation_id").join(revisions, "draft_id")
    rows = nested(rows, citations, ["revision_id"], ["kind", "ref", "label"], "sources")
    last = rows.groupBy("draft_id").agg(F.max("revision").alias("_last"))
    rows = rows.join(last, "draft_id").withColumn("is_current", F.col("revision") == F.col("_last")).drop("_last")
    return rows.orderBy("conversation_id", F.desc("revision"))


def reusable_drafts(revisions: DataFrame, messages: DataFrame) -> DataFrame:
    """``conversation_id, reusable``: the newest generated draft is younger than the newest
    message that came in.  Both are naive times, read as UTC."""
    made = revisions.where(F.col("origin") == "generated").groupBy("conversation_id").agg(F.max("created_at").alias("made"))
    came = messages.where(F.col("direction") == "inbound").groupBy("conversation_id").agg(F.max("source_ts").alias("came"))
    fresh = F.coalesce(F.col("came").isNull() | (F.col("made") > F.col("came")), F.lit(False))
    return made.join(came, "conversation_id", "left").select("conversation_id", fresh.alias("reusable"))


def last_inbound(messages: DataFrame, key: str = "conversation_id") -> DataFrame:
    return first_by(messages.where(F.col("direction") == "inbound"), [key], F.desc("source_ts"), F.desc("source_pk"))


def order_class(status: Column) -> Column:
    return F.when(status.isin(*ACTIVE_ORDER_STATUSES), "active").when(status.isin(*TERMINATED_ORDER_STATUSES), "terminated").otherwise("unknown")


def may_use_order_facts(resolution: Column) -> Column:
    """Whether facts of an order may ground a draft: only if a single one was found."""
    return F.coalesce(resolution == "single_order", F.lit(False))


def logical_orders(rows: DataFrame, active: Column, keys: Sequence[str], item: str) -> DataFrame:
    """Physical rows of an order as one: distinct items of its active rows, and how many there are."""
    return rows.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(active).alias("active_rows"),
        F.array_sort(F.collect_set(F.when(active, F.col(item)))).alias("items"),
    )


def tie_mates(rows: DataFrame, ts: str, pk: str) -> DataFrame:
    """``ts, pk, next_mate, mates`` of each row that another row of its instant follows: the
    next larger id and how many are larger.  Pairs are counted, never listed."""
    instant = Window.partitionBy("ts")
    up, down = instant.orderBy("pk"), instant.orderBy(F.desc("pk"))
    out = rows.select(F.col(ts).alias("ts"), F.col(pk).alias("pk"))
    out = out.withColumns({"next_mate": F.lead("pk").over(up), "mates": (F.row_number().over(down) - 1).cast("long")})
    return out.where(F.col("mates") > 0)


def longest_prefix(rows: DataFrame, rates: DataFrame, model: str) -> DataFrame:
    """Rows with the rate of the longest prefix of their model, outer blanks and case aside.

    ``rates`` is a small table (``prefix, input_rate, output_rate``) that the caller writes out.
    A name meets prefixes by equality, one of its own for each length that a prefix has.
    """
    name = F.lower(F.trim(F.col("_model")))
    names = rows.select(F.col(model).alias("_model")).distinct()
    rates = rates.withColumn("_prefix", F.lower("prefix"))
    lengths = [r[0] for r in rates.select(F.length("_prefix")).distinct().collect()]  # a few
    cuts = F.array_distinct(F.array(*(F.left(name, F.lit(n)) for n in sorted(lengths)))) if lengths else F.array().cast("array<string>")
    found = names.withColumn("_prefix", F.explode(cuts)).join(rates, "_prefix")
    best = found.groupBy("_model").agg(
        F.max_by(F.struct("prefix", "input_rate", "output_rate"), F.length("prefix")).alias("_rate")
    )
    return rows.join(best, F.col(model) == F.col("_model"), "left").select(*rows.columns, "_rate.*")


def estimated_cost(tokens_in: Column, tokens_out: Column) -> Column:
    """Cost of a call at ``input_rate`` and ``output_rate`` a million tokens, six places; null
    for an unknown model or a call without any count."""
    million = F.lit(Decimal(1_000_000))
    cost = (
        F.coalesce(tokens_in, F.lit(0)).cast("decimal(18,0)") * F.col("input_rate")
        + F.coalesce(tokens_out, F.lit(0)).cast("decimal(18,0)") * F.col("output_rate")
    ) / million
    return F.when(tokens_in.isNotNull() | tokens_out.isNotNull(), cost).cast("decimal(12,6)")
