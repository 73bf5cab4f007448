"""The registered queries over the driver's tables, and SQL that gives the same rows.

The tables stand for messages: ``events`` for items with gaps, ``conversations`` for threads by
reference, ``orders`` and ``lineitem`` for drafts with citations.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomspark.functions import text as T
from loomspark.operators import classify, reads, rules, threads, upsert, usage
from loomspark.plans import feeds
from loomspark.sources import scans
from loomspark.streaming import cursors, store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Day gap of sessions on ``events``, which cover a month.
EVENT_RULE = threads.ThreadingRule("item-v1", "lone-v1", True, False, "1 day")
REFERENCE_RULE = threads.ThreadingRule("order-v1", "single-v1")


def query(sql: str | None = None):
    def register(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as messages: errors have no item, purchases go out."""
    return table(spark, sf_dir, "events").select(
        F.lit("events").alias("marketplace"), F.col("event_id").alias("source_pk"), F.lit(1).alias("sub_source_id"),
        F.when(F.col("event_type") != "error", F.col("event_type")).alias("listing_item_ref"),
        F.col("user_id").cast("string").alias("counterparty_ref"),
        F.when(F.col("event_type") == "purchase", "outbound").otherwise("inbound").alias("direction"),
        F.col("ts").alias("source_ts"), F.when(F.col("value") < 5, "small").alias("filter_reason"),
    )


def turn_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of conversations as messages of an order each; system turns have no order."""
    start = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz")
    order = F.when(F.col("role") != "system", F.col("conv_id").cast("string"))
    pk = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        F.lit("turns").alias("marketplace"), pk.alias("source_pk"), F.lit(1).alias("sub_source_id"),
        F.lit(None).cast("string").alias("listing_item_ref"),
        F.coalesce(order, T.unresolved_reference(pk)).alias("counterparty_ref"),
        F.when(F.col("role") == "assistant", "outbound").otherwise("inbound").alias("direction"),
        (start + F.make_dt_interval(mins=F.col("turn").cast("int"))).alias("source_ts"),
        F.lit(None).cast("string").alias("filter_reason"), F.col("conv_id").alias("conversation_id"),
        F.col("text").alias("body_text"),
    )


_FACTS = """
    SELECT marketplace, threading_rule_version, thread_key, threading_strategy, sub_source_id, counterparty_ref,
           CASE WHEN min(listing_item_ref) = max(listing_item_ref) AND count(listing_item_ref) = count(*)
                THEN min(listing_item_ref) END AS listing_item_ref,
           min(source_ts) AS first_source_ts, max(source_ts) AS last_source_ts, count(*) AS message_count,
           count(*) FILTER (direction = 'inbound') AS inbound_count, count(*) FILTER (direction = 'outbound') AS outbound_count,
           bool_or(needs_context) AS needs_context,
           CASE WHEN bool_and(filter_reason IS NOT NULL) THEN 'filtered'
                WHEN count(*) FILTER (direction = 'inbound') > 0 THEN 'reply_inbox' ELSE 'outbound_only' END AS inbox_placement,
           CASE WHEN bool_and(filter_reason IS NOT NULL) THEN arg_min(filter_reason, source_pk) END AS inbox_filter_reason
    FROM threaded GROUP BY 1, 2, 3, 4, 5, 6"""
_EVENT_THREADS = """
    WITH m AS (
      SELECT 'events' AS marketplace, event_id AS source_pk, 1 AS sub_source_id,
             CASE WHEN event_type <> 'error' THEN event_type END AS listing_item_ref, CAST(user_id AS VARCHAR) AS counterparty_ref,
             CASE WHEN event_type = 'purchase' THEN 'outbound' ELSE 'inbound' END AS direction, ts AS source_ts,
             CASE WHEN value < 5 THEN 'small' END AS filter_reason FROM events),
    flagged AS (
      SELECT *, CASE WHEN date_trunc('millisecond', source_ts) - lag(date_trunc('millisecond', source_ts)) OVER w > INTERVAL 1 DAY
                     THEN 1 ELSE 0 END AS starts
      FROM m WINDOW w AS (PARTITION BY sub_source_id, listing_item_ref, counterparty_ref ORDER BY source_ts, source_pk)),
    segmented AS (
      SELECT *, CAST(sum(starts) OVER (PARTITION BY sub_source_id, listing_item_ref, counterparty_ref
                                       ORDER BY source_ts, source_pk ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM flagged),
    named AS (
      SELECT * EXCLUDE (starts), listing_item_ref IS NULL AS lone FROM segmented),
    threaded AS (
      SELECT * EXCLUDE (lone), CASE WHEN lone THEN 'lone-v1' ELSE 'item-v1' END AS threading_rule_version,
             CASE WHEN lone THEN 'no_item' ELSE 'item_linked' END AS threading_strategy, lone AS needs_context,
             CAST(json_array(CASE WHEN lone THEN 'lone-v1' ELSE 'item-v1' END, CASE WHEN lone THEN 'no_item' ELSE 'item_linked' END,
                             sub_source_id, listing_item_ref, counterparty_ref, segment) AS VARCHAR) AS thread_key FROM named)"""
_TURNS = """
    m AS (
      SELECT 'turns' AS marketplace, conv_id * 1000 + turn AS source_pk, 1 AS sub_source_id, CAST(NULL AS VARCHAR) AS listing_item_ref,
             CASE WHEN role <> 'system' THEN CAST(conv_id AS VARCHAR)
                  ELSE 'unresolved:' || CAST(conv_id * 1000 + turn AS VARCHAR) END AS counterparty_ref,
             CASE WHEN role = 'assistant' THEN 'outbound' ELSE 'inbound' END AS direction,
             TIMESTAMP '2024-01-01' + to_minutes(CAST(turn AS INTEGER)) AS source_ts, CAST(NULL AS VARCHAR) AS filter_reason,
             conv_id AS conversation_id, text AS body_text FROM conversations)"""
_TURN_THREADS = f"""
    WITH {_TURNS},
    named AS (SELECT *, counterparty_ref LIKE 'unresolved:%' AS lone FROM m),
    threaded AS (
      SELECT * EXCLUDE (lone), CASE WHEN lone THEN 'single-v1' ELSE 'order-v1' END AS threading_rule_version,
             'no_item' AS threading_strategy, true AS needs_context,
             CAST(json_array(CASE WHEN lone THEN 'single-v1' ELSE 'order-v1' END, 'no_item', 1, NULL, counterparty_ref, 0) AS VARCHAR)
               AS thread_key FROM named)"""


# ---- scans -----------------------------------------------------------------------------
@query("""SELECT event_id, ts, user_id FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-15', 0)
          ORDER BY ts, event_id LIMIT 500""")
def after_watermark_scan(spark, sf_dir):
    window = scans.After(datetime(2024, 1, 15), 0)
    return scans.scan(table(spark, sf_dir, "events"), ["event_id", "ts", "user_id"], "ts", "event_id", window, 500)


@query("SELECT event_id, ts, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-20'")
def bootstrap_scan(spark, sf_dir):
    window = scans.Since(datetime(2024, 1, 20))
    return scans.scan(table(spark, sf_dir, "events"), ["event_id", "ts", "user_id", "value"], "ts", "event_id", window)


@query("""SELECT d.doc_id, d.source, CAST(l.quality AS VARCHAR) AS body_raw FROM documents d LEFT JOIN labels l USING (doc_id)""")
def left_join_bodies(spark, sf_dir):
    headers = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").alias("ext_message_id"))
    bodies = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("message_id"), F.col("quality").cast("string").alias("message"))
    return scans.with_bodies(headers, bodies).drop("ext_message_id")


# ---- classification --------------------------------------------------------------------
@query("""
    SELECT count(*) AS examined, count(*) FILTER (event_type NOT IN ('error', 'signup') AND value >= 10) AS message,
           count(*) FILTER (event_type = 'error') AS notice, count(*) FILTER (event_type = 'signup') AS ambiguous,
           count(*) FILTER (event_type NOT IN ('error', 'signup') AND value < 10) AS unusable FROM events""")
def row_classification_counts(spark, sf_dir):
    kind = F.when(F.col("event_type") == "error", "notice").when(F.col("event_type") == "signup", "ambiguous")
    kind = kind.when(F.col("value") < 10, "unusable").otherwise("message")
    return classify.class_counts(table(spark, sf_dir, "events").withColumn("row_class", kind))


@query("""
    WITH rows AS (SELECT event_id, user_id % 3 AS folder, user_id, event_type, value FROM events)
    SELECT event_id AS source_pk, CASE folder WHEN 0 THEN 'inbound' WHEN 1 THEN 'outbound' END AS direction,
           CASE folder WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN 'shop' END AS counterparty_ref,
           CASE WHEN event_type <> 'view' THEN event_type END AS listing_item_ref,
           'failed' AS body_decode_status,
           CASE WHEN event_type = 'error' AND value < 100 THEN 'notice' WHEN folder < 2 THEN 'message' ELSE 'unusable' END AS row_class
    FROM rows""")
def header_body_classes(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    error = F.col("event_type") == "error"
    rows = e.select(
        F.col("event_id").alias("id"), F.col("event_id").cast("string").alias("message_id"),
        F.when(~(error & (F.col("value") < 100)), F.col("event_id")).alias("ext_message_id"),
        F.when(~error, F.col("event_type")).alias("message_type"), F.lit(1).alias("sub_source"),
        F.when(F.col("event_type") == "view", "0").otherwise(F.col("event_type")).alias("item_id"),
        (F.col("user_id") % 3).alias("folder_id"), F.col("user_id").cast("string").alias("sender_id"),
        F.lit("shop").alias("receiver_id"), F.col("ts").alias("receive_date"), F.col("props").alias("body_raw"),
    )
    found = classify.header_body_messages(rows)
    return found.select("source_pk", "direction", "counterparty_ref", "listing_item_ref", "body_decode_status", "row_class")


@query(r"""
    WITH rows AS (SELECT page_id, lower(regexp_extract(url, '://([^/:?#]+)', 1)) AS host FROM pages)
    SELECT page_id, nullif(host, '') AS domain,
           CASE WHEN NOT regexp_matches(host, '^(co\.uk|org\.uk|com\.au)$')
                THEN coalesce(nullif(regexp_extract(host, '(^|\.)([^.]+)\.(co\.uk|org\.uk|com\.au)$', 2), ''),
                              nullif(regexp_extract(host, '(^|\.)([^.]+)\.[^.]+$', 2), '')) END AS organisation
    FROM rows""")
def domains_and_organisations(spark, sf_dir):
    host = F.lower(F.regexp_extract("url", "://([^/:?#]+)", 1))
    domain = T.domain_of(F.concat(F.lit("someone@"), host, F.lit(">")))
    return table(spark, sf_dir, "pages").select("page_id", domain.alias("domain"), T.organisation_label(domain).alias("organisation"))


@query(r"""
    WITH rows AS (
      SELECT doc_id, doc_id % 7 AS k, list_extract(['gmail.com', 'dpd.co.uk', 'mail.shopify.com', 'etsy.com', 'studio.example', 'shop.test', NULL],
                                     CAST(doc_id % 7 AS INTEGER) + 1) AS domain, doc_id % 5 AS s FROM documents)
    SELECT doc_id, CASE WHEN domain = 'shop.test' THEN NULL WHEN s = 1 THEN 'bounce' WHEN domain IS NULL THEN NULL
                        WHEN k = 1 THEN 'courier' WHEN k = 2 THEN 'platform' WHEN k = 3 THEN 'marketplace' WHEN k = 0 THEN NULL
                        WHEN s IN (2, 3) THEN NULL ELSE 'unsolicited' END AS reason FROM rows""")
def inbox_filter(spark, sf_dir):
    domains = F.array(*map(F.lit, ["gmail.com", "dpd.co.uk", "mail.shopify.com", "etsy.com", "studio.example", "shop.test", None]))
    subjects = F.array(*map(F.lit, ["News", "Undeliverable: x", "Re: hello", "An enquiry", "Offer"]))
    rows = table(spark, sf_dir, "documents").select(
        "doc_id", F.concat(F.lit("a@"), F.element_at(domains, (F.col("doc_id") % 7 + 1).cast("int"))).alias("from_msg"),
        F.element_at(subjects, (F.col("doc_id") % 5 + 1).cast("int")).alias("subject"), F.lit(" ").alias("order_id"),
    )
    return rows.select("doc_id", classify.inbox_filter_reason(["shop.test"]).alias("reason"))


@query(r"""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'active' WHEN 'O' THEN 'terminated' ELSE 'unknown' END AS status_class FROM orders""")
def order_status_classes(spark, sf_dir):
    names = F.when(F.col("o_orderstatus") == "F", "Completed").when(F.col("o_orderstatus") == "O", "Cancelled").otherwise("Pending")
    return table(spark, sf_dir, "orders").select("o_orderkey", reads.order_class(names).alias("status_class"))


@query(r"""
    SELECT doc_id FROM documents
    WHERE NOT coalesce(regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}')
                       OR regexp_matches(text, '(^|[^0-9])[0-9]{2}-[0-9]{5}-[0-9]{5}([^0-9]|$)'), false)""")
def pii_scrub(spark, sf_dir):
    return rules.scrubbed(table(spark, sf_dir, "documents").select("doc_id", "text"), ["text"]).select("doc_id")


# ---- threads ---------------------------------------------------------------------------
@query(_EVENT_THREADS + _FACTS)
def gap_sessions(spark, sf_dir):
    return threads.conversations(threads.threaded(event_messages(spark, sf_dir), EVENT_RULE), EVENT_RULE)


@query(_EVENT_THREADS + "SELECT source_pk, thread_key, segment FROM threaded")
def thread_keys(spark, sf_dir):
    return threads.threaded(event_messages(spark, sf_dir), EVENT_RULE).select("source_pk", "thread_key", "segment")


@query("""
    WITH flagged AS (
      SELECT user_id, ts, event_id, CASE WHEN date_trunc('millisecond', ts) - lag(date_trunc('millisecond', ts)) OVER w > INTERVAL 3 HOURS
                                         THEN 1 ELSE 0 END AS starts
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
    segmented AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
                  FROM flagged)
    SELECT user_id, segment, count(*) AS message_count, min(ts) AS first_ts, max(ts) AS last_ts FROM segmented GROUP BY 1, 2""")
def gap_sessions_no_item(spark, sf_dir):
    rows = threads.gap_segments(table(spark, sf_dir, "events").select("user_id", "ts", "event_id"), ["user_id"], "ts", "event_id", "3 hours")
    return rows.groupBy("user_id", "segment").agg(
        F.count("*").alias("message_count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )


@query(_TURN_THREADS + _FACTS)
def reference_threads(spark, sf_dir):
    return threads.conversations(threads.threaded(turn_messages(spark, sf_dir), REFERENCE_RULE), REFERENCE_RULE)


@query(_TURN_THREADS + """
    , whole AS (SELECT thread_key, count(*) AS there FROM threaded GROUP BY 1),
    part AS (SELECT thread_key, count(*) AS message_count FROM threaded WHERE source_pk % 1000 < 3 GROUP BY 1)
    SELECT thread_key, there, message_count FROM whole FULL JOIN part USING (thread_key) WHERE there IS DISTINCT FROM message_count""")
def thread_problems(spark, sf_dir):
    messages = threads.threaded(turn_messages(spark, sf_dir), REFERENCE_RULE)
    short = threads.conversations(messages.where(F.col("source_pk") % 1000 < 3), REFERENCE_RULE)
    return threads.thread_problems(messages, short)


@query(_EVENT_THREADS + f", facts AS ({_FACTS}) SELECT thread_key, first_source_ts FROM facts ORDER BY first_source_ts, thread_key LIMIT 1 OFFSET 100")
def thread_order(spark, sf_dir):
    facts = threads.conversations(threads.threaded(event_messages(spark, sf_dir), EVENT_RULE), EVENT_RULE)
    return threads.in_thread_order(facts.select("thread_key", "first_source_ts")).offset(100).limit(1)


@query("SELECT count(*) FILTER (o_orderpriority <> '1-URGENT') AS excluded_unusable FROM orders")
def foreign_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("marketplace"))
    return threads.of_marketplace(rows, "1-URGENT")[1]


@query("""SELECT l_orderkey, count(*) AS lines, CASE WHEN min(l_returnflag) = max(l_returnflag) THEN min(l_returnflag) END AS returnflag
          FROM lineitem GROUP BY 1""")
def agreed_ref(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("lines"), threads.agreed("l_returnflag").alias("returnflag")
    )


# ---- read models -----------------------------------------------------------------------
@query(_EVENT_THREADS + f", facts AS ({_FACTS}) SELECT thread_key, last_source_ts, message_count, inbound_count FROM facts "
       "WHERE inbox_placement = 'reply_inbox' ORDER BY last_source_ts DESC, thread_key DESC LIMIT 100")
def inbox_topn(spark, sf_dir):
    facts = threads.conversations(threads.threaded(event_messages(spark, sf_dir), EVENT_RULE), EVENT_RULE)
    top = reads.newest(facts, "last_source_ts", "thread_key", where=F.col("inbox_placement") == "reply_inbox")
    return top.select("thread_key", "last_source_ts", "message_count", "inbound_count")


@query("SELECT o_orderkey, o_orderdate, o_orderpriority FROM orders WHERE o_custkey = 42 ORDER BY o_orderdate, o_orderkey")
def thread_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority", "o_custkey")
    return reads.thread_in_order(rows, F.col("o_custkey") == 42, "o_orderdate", "o_orderkey").drop("o_custkey")


@query("SELECT event_id, ts, event_type FROM events WHERE event_type = 'signup' ORDER BY ts DESC, event_id DESC LIMIT 200")
def unresolved_feed(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return reads.newest(rows, "ts", "event_id", 1000, F.col("event_type") == "signup")


_USAGE = """usage AS (
      SELECT event_type AS provider, CAST(user_id % 4 AS VARCHAR) AS model, CAST(floor(value) AS BIGINT) AS input_tokens,
             CASE WHEN event_id % 3 > 0 THEN user_id END AS output_tokens, user_id AS total_tokens,
             CASE WHEN event_id % 5 > 0 THEN CAST(user_id AS DECIMAL(12, 6)) END AS cost, ts AS created_at FROM events)"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("provider"), (F.col("user_id") % 4).cast("string").alias("model"),
        F.floor("value").alias("input_tokens"), F.when(F.col("event_id") % 3 > 0, F.col("user_id")).alias("output_tokens"),
        F.col("user_id").alias("total_tokens"),
        F.when(F.col("event_id") % 5 > 0, F.col("user_id").cast("decimal(12,6)")).alias("estimated_cost_usd"),
        F.col("ts").alias("created_at"),
    )


@query(f"""
    WITH {_USAGE} SELECT count(*) AS calls, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
           CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
           CAST(sum(cost) AS DOUBLE) AS cost, count(*) FILTER (cost IS NULL) AS calls_without_cost,
           count(*) FILTER (created_at > TIMESTAMP '2024-01-30' - INTERVAL 24 HOURS) AS calls_last_day, max(created_at) AS last_call FROM usage""")
def usage_summary(spark, sf_dir):
    as_of = F.lit(datetime(2024, 1, 30)).cast("timestamp_ntz")
    return reads.usage_summary(_usage(spark, sf_dir), as_of).withColumn("cost", F.col("cost").cast("double"))


@query(f"""
    WITH {_USAGE} SELECT provider, model, count(*) AS calls, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens,
           CAST(sum(cost) AS DOUBLE) AS cost FROM usage GROUP BY 1, 2""")
def usage_by_model(spark, sf_dir):
    return reads.usage_by_model(_usage(spark, sf_dir)).withColumn("cost", F.col("cost").cast("double"))


@query("""
    SELECT o_orderkey, CASE WHEN count(l_orderkey) = 0 THEN '[]' ELSE
             '[' || string_agg('{"l_linenumber":' || l_linenumber || ',"l_returnflag":"' || l_returnflag || '","l_partkey":' || l_partkey || '}',
                               ',' ORDER BY l_linenumber, l_returnflag, l_partkey) || ']' END AS lines
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def nested_history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    out = reads.nested(orders, table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_returnflag", "l_partkey"], "lines")
    return out.select(F.col("l_orderkey").alias("o_orderkey"), F.to_json("lines").alias("lines"))


@query("""SELECT o_custkey, o_orderkey, o_orderdate FROM orders
          QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1""")
def latest_per_key(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    return upsert.first_by(rows, ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey"))


@query("""SELECT o_orderdate AS ts, o_orderkey AS pk, lead(o_orderkey) OVER w AS next_mate,
                 count(*) OVER (PARTITION BY o_orderdate ORDER BY o_orderkey ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS mates
          FROM orders WINDOW w AS (PARTITION BY o_orderdate ORDER BY o_orderkey) QUALIFY mates > 0""")
def tie_mates(spark, sf_dir):
    return reads.tie_mates(table(spark, sf_dir, "orders"), "o_orderdate", "o_orderkey")


@query("""
    SELECT l_orderkey, count(*) AS rows, count(*) FILTER (l_linestatus = 'O') AS active_rows,
           coalesce(array_to_string(list_sort(list_distinct(list(l_partkey) FILTER (l_linestatus = 'O'))), ','), '') AS items
    FROM lineitem GROUP BY 1""")
def logical_orders(spark, sf_dir):
    out = reads.logical_orders(table(spark, sf_dir, "lineitem"), F.col("l_linestatus") == "O", ["l_orderkey"], "l_partkey")
    return out.withColumn("items", F.array_join("items", ","))


@query("""
    WITH rates(prefix, rate_in, rate_out) AS (VALUES ('E', 1.0, 2.0), ('ECON', 0.5, 1.0), ('STAND', 0.25, 4.0), ('S', 3.0, 3.0)),
    best AS (SELECT p_partkey, p_size, arg_max(rate_in, length(prefix)) AS i, arg_max(rate_out, length(prefix)) AS o,
                    arg_max(prefix, length(prefix)) AS prefix
             FROM part LEFT JOIN rates ON starts_with(p_type, prefix) GROUP BY 1, 2)
    SELECT p_partkey, prefix, CAST(CASE WHEN prefix IS NOT NULL THEN (p_size * 1000 * i + p_partkey * o) / 1000000 END AS DOUBLE) AS cost FROM best""")
def longest_prefix_rate(spark, sf_dir):
    rates = spark.createDataFrame(
        [("E", "1.0", "2.0"), ("ECON", "0.5", "1.0"), ("STAND", "0.25", "4.0"), ("S", "3.0", "3.0")], "prefix string, i string, o string"
    ).select("prefix", F.col("i").cast("decimal(10,4)").alias("input_rate"), F.col("o").cast("decimal(10,4)").alias("output_rate"))
    # names come in any case, with blanks around them
    parts = table(spark, sf_dir, "part").withColumn("model", F.concat(F.lit(" "), F.lower("p_type"), F.lit(" ")))
    rated = reads.longest_prefix(parts, rates, "model")
    cost = reads.estimated_cost(F.col("p_size") * 1000, F.col("p_partkey"))
    return rated.select("p_partkey", "prefix", cost.cast("double").alias("cost"))


@query(f"""
    WITH {_TURNS}, c AS (SELECT conversation_id, max(source_ts) FILTER (direction = 'inbound') AS came,
                                max(source_ts) FILTER (direction = 'outbound') AS made FROM m GROUP BY 1)
    SELECT conversation_id, coalesce(came IS NULL OR made > came, false) AS reusable FROM c WHERE made IS NOT NULL""")
def reusable_drafts(spark, sf_dir):
    messages = turn_messages(spark, sf_dir)
    drafts = messages.where("direction = 'outbound'").select(
        "conversation_id", F.col("source_ts").alias("created_at"), F.lit("generated").alias("origin")
    )
    return reads.reusable_drafts(drafts, messages)


@query(f"""WITH {_TURNS} SELECT conversation_id, source_pk, body_text FROM m WHERE direction = 'inbound'
           QUALIFY row_number() OVER (PARTITION BY conversation_id ORDER BY source_ts DESC, source_pk DESC) = 1""")
def last_inbound(spark, sf_dir):
    return reads.last_inbound(turn_messages(spark, sf_dir)).select("conversation_id", "source_pk", "body_text")


# ---- snapshots -------------------------------------------------------------------------
@query("""
    SELECT event_id, CASE WHEN event_id % 10 >= 4 THEN ts + INTERVAL 1 DAY ELSE ts END AS ts_first,
           CASE WHEN event_id % 10 >= 4 THEN event_type || '!' ELSE event_type END AS event_type,
           CASE WHEN event_id % 10 >= 6 THEN 'inserted' WHEN event_id % 10 >= 4 THEN 'updated' ELSE 'kept' END AS merge_action
    FROM events WHERE event_id % 10 < 4 OR event_id % 10 >= 6
    UNION ALL SELECT event_id, ts, event_type || '!', 'updated' FROM events WHERE event_id % 10 IN (4, 5)""")
def merge_upsert(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    old = e.where(F.col("event_id") % 10 < 6).select("event_id", F.col("ts").alias("ts_first"), "event_type")
    new = e.where(F.col("event_id") % 10 >= 4).select(
        "event_id", (F.col("ts") + F.expr("interval 1 day")).alias("ts_first"), F.concat("event_type", F.lit("!")).alias("event_type")
    )
    return upsert.merged(old, new, ["event_id"], ["event_type"])


@query("SELECT event_id, user_id, event_type FROM events")
def merge_idempotent(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    first, second = e.where(F.col("event_id") % 10 < 6), e.where(F.col("event_id") % 10 >= 4)
    once = upsert.merged(first, second, ["event_id"], ["event_type"]).drop("merge_action")
    return upsert.merged(once, second, ["event_id"], ["event_type"]).drop("merge_action")


@query("""SELECT event_type AS feed_key, arg_max(ts, (ts, event_id)) AS ts, arg_max(event_id, (ts, event_id)) AS pk FROM events GROUP BY 1""")
def cursor_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("feed_key"), "ts", F.col("event_id").alias("pk"))
    stored = upsert.first_by(rows.where(F.col("pk") % 2 == 0), ["feed_key"], F.desc("ts"), F.desc("pk"))
    return upsert.advanced_cursors(stored, rows.where(F.col("pk") % 2 == 1))


@query("""SELECT c.conv_id AS thread_key, count(c.conv_id) AS message_count, count(*) FILTER (role = 'user') AS inbound_count
          FROM conversations c GROUP BY 1""")
def recount(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("thread_key"), F.when(F.col("role") == "user", "inbound").otherwise("outbound").alias("direction")
    )
    stale = rows.select("thread_key").distinct().withColumns({"message_count": F.lit(0), "inbound_count": F.lit(0)})
    return upsert.recounted(stale, rows)


@query("""
    WITH last AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
    SELECT o.o_orderkey, o.o_custkey, coalesce(n, 0) + row_number() OVER (PARTITION BY o.o_custkey ORDER BY o.o_orderdate, o.o_orderkey) AS revision
    FROM orders o LEFT JOIN last USING (o_custkey) WHERE o.o_orderstatus <> 'F'""")
def next_revisions(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_orderstatus")
    numbered = upsert.next_revisions(
        o.select("o_custkey", F.lit(0).alias("revision")).limit(0), o.where("o_orderstatus = 'F'"), "o_custkey", "o_orderdate", "o_orderkey"
    )
    more = upsert.next_revisions(numbered, o.where("o_orderstatus <> 'F'"), "o_custkey", "o_orderdate", "o_orderkey")
    return more.select("o_orderkey", "o_custkey", F.col("revision").cast("long").alias("revision"))


@query("""SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R'
          AND (l_partkey, l_suppkey) NOT IN (SELECT (l_partkey, l_suppkey) FROM lineitem WHERE l_returnflag = 'A')""")
def inserted_once(spark, sf_dir):
    keys = ["l_partkey", "l_suppkey"]
    rows = table(spark, sf_dir, "lineitem").select(*keys, "l_returnflag")
    there = rows.where("l_returnflag = 'A'").drop("l_returnflag").distinct()
    return upsert.inserted_once(there, rows.where("l_returnflag = 'R'").drop("l_returnflag"), keys)


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'new' WHEN p_partkey % 3 = 1 THEN 'changed' ELSE 'unchanged' END AS import_action FROM part""")
def import_status(spark, sf_dir):
    part = table(spark, sf_dir, "part").select("p_partkey", T.row_checksum(F.array("p_name", "p_type")).alias("content_checksum"))
    other = F.when(F.col("p_partkey") % 3 == 1, F.lit("")).otherwise(F.col("content_checksum"))
    known = part.where("p_partkey % 3 > 0").withColumn("content_checksum", other)
    return upsert.import_status(known, part, ["p_partkey"]).select("p_partkey", "import_action")


@query("""
    SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'O') THEN 'drafting' ELSE 'reviewed' END AS state, o_orderstatus IN ('F', 'O') AS moved
    FROM orders""")
def workflow_moves(spark, sf_dir):
    state = F.when(F.col("o_orderstatus") == "F", "received").when(F.col("o_orderstatus") == "O", "pending_review").otherwise("reviewed")
    states = table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"))
    wishes = states.select("o_orderkey", F.col("state").alias("expected"), F.lit("drafting").alias("wanted"))
    return upsert.moved_states(states, wishes, "o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE 'none' END AS o_orderpriority
          FROM orders WHERE o_orderkey % 2 = 1 AND o_orderpriority <> 'none'""")
def changed_only(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    new = o.withColumn("o_orderpriority", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).otherwise("none"))
    return upsert.changed_only(o, new, ["o_orderkey"], "o_orderpriority")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0
          UNION ALL SELECT DISTINCT l_orderkey, 0 FROM lineitem WHERE l_orderkey % 2 = 1""")
def replaced_children(spark, sf_dir):
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    fresh = lines.where("l_orderkey % 2 = 1").select("l_orderkey").distinct().withColumn("l_linenumber", F.lit(0))
    return upsert.replaced_children(lines, fresh.select("l_orderkey", F.col("l_linenumber").cast(lines.schema["l_linenumber"].dataType)), "l_orderkey")


# ---- texts -----------------------------------------------------------------------------
@query(r"""
    WITH flat AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations)
    SELECT conv_id, turn, CASE WHEN coalesce(t, '') = '' THEN 'Message content unavailable' WHEN length(t) <= 90 THEN t
                               ELSE substr(t, 1, 89) || '…' END AS preview FROM flat""")
def previews(spark, sf_dir):
    body = T.plain_body(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.preview(body["text"], body["status"]).alias("preview"))


def _claims_in(reply: str, facts: str) -> str:
    """SQL for the claims of a reply, by the same patterns."""
    parts = (
        f"CASE WHEN regexp_matches({reply}, '{pattern.replace(chr(39), chr(39) * 2)}') AND NOT contains('{facts}', '{claim.split()[0]}') "
        f"THEN '{claim}' END" for claim, pattern in T.CLAIMS.items()
    )
    return f"concat_ws(',', {', '.join(parts)})"


@query(f"""
    WITH r AS (SELECT doc_id, coalesce(text, '') || CASE doc_id % 3 WHEN 0 THEN ' Your refund has been sent.' WHEN 1 THEN ' Tracking no.: AB1.'
                                                                    ELSE ' It will be delivered by Monday.' END AS reply FROM documents)
    SELECT doc_id, {_claims_in("reply", "delivery date: monday")} AS claims FROM r""")
def claim_scan(spark, sf_dir):
    said = F.when(F.col("doc_id") % 3 == 0, " Your refund has been sent.").when(F.col("doc_id") % 3 == 1, " Tracking no.: AB1.")
    reply = F.concat(F.coalesce("text", F.lit("")), F.coalesce(said, F.lit(" It will be delivered by Monday.")))
    facts = F.lit("delivery date: Monday")
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.ungrounded_claims(reply, facts), ",").alias("claims"))


@query(r"""SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'Anna Weber' END AS sender_name FROM conversations""")
def signature_names(spark, sf_dir):
    signed = F.when(F.col("turn") % 2 == 0, "\n\nKind regards,\n\nAnna Weber\nShop").otherwise("\n\nMany thanks\nSales Team")
    body = F.concat(F.coalesce("text", F.lit("")), signed)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.sender_name(body).alias("sender_name"))


@query(r"""
    WITH codes AS (SELECT n_nationkey, n_name, list_reduce(list_prepend(CAST(0 AS BIGINT), list_transform(string_split(n_name, ''), lambda c: CAST(ord(c) AS BIGINT))),
                                   lambda a, b: (a * 31 + b) & 4294967295) AS h FROM nation)
    SELECT n_nationkey, substr(list_aggregate(list_transform(string_split(regexp_replace(n_name, '[^A-Za-z ]', '', 'g'), ' '),
                               lambda w: upper(substr(w, 1, 3))), 'string_agg', ''), 1, 6) || '-' ||
           lpad(right(upper(to_base(h, 36)), 3), 3, '0') || '-' || n_nationkey AS ref
    FROM codes""")
def rule_refs(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select("n_nationkey", T.rule_ref(F.col("n_name"), F.col("n_name"), F.col("n_nationkey")).alias("ref"))


@query("""
    SELECT o_orderkey, CAST(unnest([0, 1, 2]) AS INTEGER) AS place, unnest(['P-1-' || o_custkey % 50, 'GONE-' || o_orderkey, 'general']) AS ref,
           unnest([CASE WHEN o_custkey % 50 < 25 THEN 'cited' ELSE 'unresolved' END, 'unresolved', 'legacy']) AS state FROM orders""")
def resolved_citations(spark, sf_dir):
    known = spark.range(25).select(F.concat(F.lit("P-1-"), "id").alias("ref"), F.lit("t").alias("title"), F.lit("x").alias("text"))
    first = F.concat(F.lit("P-1-"), F.col("o_custkey") % 50)
    refs = F.array(F.concat(F.lit(" [["), first, F.lit("]")), first, F.concat(F.lit("GONE-"), "o_orderkey"), F.lit("general"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", refs.alias("refs"))
    return rules.resolved_citations(rows, known, "o_orderkey").select("o_orderkey", "place", "ref", "state")


@query(f"""WITH {_TURNS} SELECT conversation_id, string_agg(direction || ': ' || coalesce(body_text, ''), chr(10) ORDER BY source_ts, source_pk) AS prompt
           FROM m GROUP BY 1""")
def thread_prompts(spark, sf_dir):
    return rules.thread_prompt(turn_messages(spark, sf_dir))


_PART_RULES = """
    SELECT p_partkey, p_name AS title, CASE WHEN p_size % 2 = 0 THEN p_name || chr(10) || 'DO: ' || p_type
           ELSE 'KEY RULE / ACTION: ' || p_name || chr(10) || 'NEVER SAY: ' || p_brand || chr(10) || 'ESCALATE.' END AS text FROM part"""


@query(_PART_RULES)
def rule_texts(spark, sf_dir):
    even = F.col("p_size") % 2 == 0
    none = F.lit(None).cast("string")
    text = rules.rule_text(
        F.when(even, F.col("p_name")), F.col("p_name"), F.upper("p_name"), F.when(even, F.col("p_type")), none,
        F.when(~even, F.col("p_brand")), none, ~even,
    )
    return table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("title"), text.alias("text"))


_PART_CORPUS = """corpus AS (SELECT p_type AS category, p_name AS title, p_brand AS text, p_partkey AS n, 'R-' || p_partkey AS ref FROM part)"""


def _part_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_type").alias("category"), F.col("p_name").alias("title"), F.col("p_brand").alias("text"), F.lit("f").alias("source_file"),
        F.col("p_brand").alias("source_sheet"), F.col("p_partkey").alias("source_row"), F.concat(F.lit("R-"), "p_partkey").alias("ref"),
    )


@query(f"""
    WITH {_PART_CORPUS} SELECT category AS area, category || '.md' AS name, count(*) AS rules,
           '# CST rules — ' || category || chr(10) || chr(10) || 'Approved CST knowledge. ' || count(*) || ' rules.' || chr(10) || chr(10) ||
           string_agg('## [' || ref || '] ' || title || chr(10) || chr(10) || '_Source: f › ' || text || ' › row ' || n || '_' || chr(10) || chr(10)
                      || text, chr(10) || chr(10) ORDER BY text, n) || chr(10) AS document
    FROM corpus GROUP BY category""")
def area_documents(spark, sf_dir):
    return rules.area_documents(_part_corpus(spark, sf_dir))


@query(f"""
    WITH {_PART_CORPUS} SELECT category AS area, '## ' || category || chr(10) || chr(10) ||
           string_agg('[' || ref || '] ' || title || chr(10) || text, chr(10) || chr(10) ORDER BY text, n) AS section FROM corpus GROUP BY category""")
def rule_prompts(spark, sf_dir):
    return rules.prompt_sections(_part_corpus(spark, sf_dir))


@query("""
    SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'About ' || p_brand ELSE p_type END AS title,
           CASE WHEN p_partkey % 3 = 0 THEN p_type ELSE p_brand END AS condition FROM part""")
def rule_titles(spark, sf_dir):
    title = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("About "), "p_brand")).otherwise(F.concat(F.lit("EB"), "p_partkey"))
    text = F.concat(F.lit("KEY RULE: "), "p_type", F.lit("\nACTION: "), "p_brand")
    shown = T.display_title(title, text, F.lit(None).cast("string"))
    return table(spark, sf_dir, "part").select("p_partkey", shown.alias("title"), T.condition_of(text, shown).alias("condition"))


@query("""
    SELECT o_orderkey, CASE WHEN o_custkey % 50 < 25 THEN '[{"area":"A","title":"Rule number ' || o_custkey % 50 || '","condition":"Do ' || o_custkey % 50
             || '","rule_text":"ACTION: Do ' || o_custkey % 50 || '","ref":"P-1-' || o_custkey % 50 || '","source_file":"f","source_sheet":"s","source_row":'
             || o_custkey % 50 || '}]' ELSE '[]' END AS matched,
           CASE WHEN o_custkey % 50 < 25 THEN '' ELSE 'P-1-' || o_custkey % 50 || ',' END || 'GONE-' || o_orderkey AS unresolved, 'general' AS legacy,
           CASE WHEN o_custkey % 50 < 25 THEN 'f' ELSE '' END AS documents, o_custkey % 50 >= 25 AS none_matched FROM orders""")
def cited_evidence(spark, sf_dir):
    n = F.col("id").cast("string")
    known = spark.range(25).select(
        F.concat(F.lit("P-1-"), n).alias("ref"), F.concat(F.lit("Rule number "), n).alias("title"), F.concat(F.lit("ACTION: Do "), n).alias("text"),
        F.lit("A").alias("category"), F.lit("f").alias("source_file"), F.lit("s").alias("source_sheet"), F.col("id").alias("source_row"),
    )
    refs = F.array(F.concat(F.lit("[P-1-"), F.col("o_custkey") % 50, F.lit("]")), F.concat(F.lit("GONE-"), "o_orderkey"), F.lit("general"))
    out = rules.evidence(table(spark, sf_dir, "orders").select("o_orderkey", refs.alias("refs")), known, "o_orderkey")
    return out.withColumns({c: F.array_join(c, ",") for c in ("unresolved", "legacy", "documents")})


@query("""
    SELECT n_name AS name, CASE WHEN n_nationkey < 10 THEN 'missing' ELSE 'withheld' END AS state FROM nation WHERE n_nationkey < 10 OR n_nationkey >= 15""")
def withheld_files(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.col("n_name").alias("name"))
    present = n.where("n_nationkey >= 10").withColumn("name", F.when(F.col("n_nationkey") < 15, F.concat(F.lit(" "), F.lower("name"))).otherwise(F.col("name")))
    return rules.withheld(n.where("n_nationkey < 15").select("name"), present.select("name"))


@query("""SELECT page_id, url || '.PNG' AS first_url, CASE WHEN page_id % 2 = 0 THEN 2 ELSE 1 END AS n,
                 CASE WHEN page_id % 2 = 0 THEN 'image,document' ELSE 'image' END AS kinds, parse_filename(url) || '.PNG' AS first_label FROM
          (SELECT page_id, regexp_replace(split_part(url, '?', 1), '^http:', 'https:') AS url FROM pages)""")
def attachment_lists(spark, sf_dir):
    url = F.concat(F.regexp_replace(F.substring_index("url", "?", 1), "^http:", "https:"), F.lit(".PNG"))
    other = F.when(F.col("page_id") % 2 == 0, F.lit("HTTPS://x.test/a%20b.pdf")).otherwise(F.lit("ftp://x.test/a"))
    found = T.attachments(F.to_json(F.array(url, other, url)))
    return table(spark, sf_dir, "pages").select(
        "page_id", F.element_at(found, 1)["url"].alias("first_url"), F.size(found).alias("n"),
        F.array_join(F.transform(found, lambda x: x["kind"]), ",").alias("kinds"), F.element_at(found, 1)["label"].alias("first_label"),
    )


@query("""
    WITH raw AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'null' WHEN 1 THEN CAST(to_json(coalesce(text, '')) AS VARCHAR) WHEN 2 THEN '[1, 2]'
                                                ELSE '"x" y' END AS raw FROM documents),
    typed AS (SELECT doc_id, raw, CASE WHEN json_valid(raw) THEN json_type(raw) END AS kind FROM raw)
    SELECT doc_id, CASE kind WHEN 'NULL' THEN 'empty' WHEN 'VARCHAR' THEN 'decoded' ELSE 'failed' END AS status,
           CASE WHEN kind = 'VARCHAR' THEN json_extract_string(raw, '$') END AS body FROM typed""")
def decoded_bodies(spark, sf_dir):
    k, text = F.col("doc_id") % 4, F.coalesce("text", F.lit(""))
    quoted = F.to_json(F.array(text))
    raw = F.when(k == 0, "null").when(k == 1, F.substring(quoted, F.lit(2), F.length(quoted) - 2)).when(k == 2, "[1, 2]").otherwise('"x" y')
    body = T.decoded_body(raw)
    return table(spark, sf_dir, "documents").select("doc_id", body["status"].alias("status"), body["text"].alias("body"))


@query("""
    SELECT o_orderkey, o_custkey || ':' || o_orderkey AS order_key, CASE o_orderstatus WHEN 'F' THEN 'New' WHEN 'O' THEN 'Awaiting review' END AS label,
           CASE o_orderkey % 4 WHEN 0 THEN 'c' || o_custkey WHEN 1 THEN 'Amazon Order c' || o_custkey WHEN 2 THEN 'Temu enquiry'
                               ELSE 'B&Q Order c' || o_custkey END AS title FROM orders""")
def conversation_titles(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    ref = F.when(k == 2, T.unresolved_reference(F.col("o_orderkey"))).otherwise(F.concat(F.lit("c"), "o_custkey"))
    state = F.when(F.col("o_orderstatus") == "F", "received").when(F.col("o_orderstatus") == "O", "pending_review")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey", T.order_key(F.col("o_custkey"), F.col("o_orderkey").cast("string")).alias("order_key"), T.workflow_label(state).alias("label"),
        F.when(k == 0, "ebay").when(k == 1, "amazon").when(k == 2, "temu").otherwise("bandq").alias("marketplace"), ref.alias("counterparty_ref"),
    )
    return classify.titled(rows.withColumnRenamed("label", "state_label")).select("o_orderkey", "order_key", F.col("state_label").alias("label"), "title")


@query("""
    SELECT conv_id, turn, CASE WHEN trim(coalesce(text, '')) <> '' AND turn % 2 = 0 THEN 'Anna Weber' ELSE 'Temu message' END AS title FROM conversations""")
def unresolved_titles(spark, sf_dir):
    text = F.col("text")
    signed = F.when((F.col("turn") % 2 == 0) & (F.trim(text) != ""), F.concat(text, F.lit("\n\nKind regards,\nAnna Weber"))).otherwise(text)
    body = T.plain_body(signed)
    title = T.unresolved_title(body["text"], body["status"], F.lit("Temu"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", title.alias("title"))


@query("""
    WITH raw AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN p_brand || '+e' || chr(769) WHEN 1 THEN p_brand || '+é' ELSE p_brand END AS sku FROM part)
    SELECT p_partkey, CASE WHEN sku <> '' AND nfc_normalize(sku) = sku THEN sku END AS sku, contains(sku, '+') AS combo FROM raw""")
def exact_skus(spark, sf_dir):
    k = F.col("p_partkey") % 3
    raw = F.when(k == 0, F.concat("p_brand", F.lit("+e\u0301"))).when(k == 1, F.concat("p_brand", F.lit("+\u00e9"))).otherwise(F.col("p_brand"))
    return table(spark, sf_dir, "part").select("p_partkey", T.exact_sku(raw).alias("sku"), T.looks_like_combo(raw).alias("combo"))


# ---- lookups and summaries -------------------------------------------------------------
@query(f"WITH {_TURNS} SELECT source_pk, direction, body_text FROM m WHERE conversation_id = 7")
def point_lookup(spark, sf_dir):
    messages = turn_messages(spark, sf_dir)
    heads = messages.select("conversation_id", "marketplace").distinct()
    _, found = reads.conversation_detail(heads, messages, reads.conversation_id("7"), "turns")
    return found.select("source_pk", "direction", "body_text")


@query("SELECT event_id, ts FROM events ORDER BY ts, event_id LIMIT 1 OFFSET 99")
def page_boundary(spark, sf_dir):
    return reads.row_at(table(spark, sf_dir, "events").select("event_id", "ts"), 99, "ts", "event_id")


@query("""
    SELECT user_id AS feed_key, CASE WHEN user_id % 3 = 0 THEN first_ts ELSE last_ts END AS ts,
           CASE WHEN user_id % 3 = 0 THEN first_id ELSE last_id END AS pk, CASE WHEN user_id % 3 = 0 THEN 'failed' ELSE 'ok' END AS last_status,
           CASE WHEN user_id % 3 = 0 THEN 'lost' END AS last_error, user_id % 3 <> 0 AS renewed
    FROM (SELECT user_id, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS first_id, max(ts) AS last_ts, arg_max(event_id, (ts, event_id)) AS last_id
          FROM events GROUP BY user_id)""")
def run_states(spark, sf_dir):
    """Each user's events as a feed that has run to its first event and runs again to its last."""
    events = table(spark, sf_dir, "events")
    at = F.struct("ts", F.col("event_id").alias("pk"))
    ends = events.groupBy(F.col("user_id").alias("feed_key")).agg(F.min(at).alias("a"), F.max(at).alias("b"))
    then, now = (F.lit(datetime(2020 + k, 1, 1)).cast("timestamp_ntz") for k in range(2))
    states = ends.select("feed_key", "a.ts", "a.pk", then.alias("last_run_at"), then.alias("last_success_at"), F.lit("ok").alias("last_status"),
                         F.lit(None).cast("string").alias("last_error"))
    runs = ends.select("feed_key", "b.ts", "b.pk", F.when(F.col("feed_key") % 3 == 0, "lost").alias("error"))
    out = upsert.run_states(states, runs, now)
    return out.select("feed_key", "ts", "pk", "last_status", "last_error", (F.col("last_success_at") == now).alias("renewed"))


@query("""SELECT (n - 1) // 50 AS page, ts, event_id AS pk FROM (SELECT *, row_number() OVER (ORDER BY ts, event_id) AS n FROM events)
          WHERE (n - 1) % 50 = 0""")
def page_starts(spark, sf_dir):
    return reads.page_starts(table(spark, sf_dir, "events"), 50, "ts", "event_id")


@query("""
    WITH RECURSIVE wishes AS (
      SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
             CASE event_type WHEN 'click' THEN 'drafting' WHEN 'purchase' THEN 'reviewed' WHEN 'error' THEN 'received' ELSE 'pending_review' END AS wanted
      FROM events),
    replay AS (
      SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS event_id, CAST(NULL AS VARCHAR) AS wanted,
             CAST(NULL AS VARCHAR) AS came_from, 'received' AS now, false AS moved FROM events
      UNION ALL
      SELECT user_id, n, event_id, wanted, was, CASE WHEN ok THEN wanted ELSE was END, ok FROM (
        SELECT w.*, r.now AS was, (r.now, w.wanted) IN (('received', 'drafting'), ('drafting', 'pending_review'),
               ('pending_review', 'drafting'), ('pending_review', 'reviewed')) AS ok
        FROM replay r JOIN wishes w ON w.user_id = r.user_id AND w.n = r.n + 1))
    SELECT user_id, event_id, wanted, came_from, moved FROM replay WHERE n > 0""")
def workflow_replay(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    kind = F.col("event_type")
    wanted = F.when(kind == "click", "drafting").when(kind == "purchase", "reviewed").when(kind == "error", "received")
    wishes = events.select("user_id", "ts", "event_id", wanted.otherwise("pending_review").alias("wanted"))
    states = events.select("user_id").distinct().withColumn("state", F.lit("received"))
    return upsert.replayed_states(states, wishes, "user_id", "ts", "event_id").drop("ts")


@query("""
    WITH rows AS (SELECT *, CASE WHEN event_type = 'error' THEN 'notice' WHEN value < 10 THEN 'unusable' ELSE 'message' END AS c FROM events)
    SELECT count(*) AS examined, count(*) FILTER (c = 'message') AS message, count(*) FILTER (c = 'notice') AS notice, CAST(0 AS BIGINT) AS ambiguous,
           count(*) FILTER (c = 'unusable') AS unusable, count(*) FILTER (c = 'message' AND event_type <> 'purchase') AS inbound,
           count(*) FILTER (c = 'message' AND event_type = 'purchase') AS outbound, count(*) FILTER (c = 'message') AS with_item,
           count(*) FILTER (c = 'message' AND event_id % 4 > 0) AS body_decoded, count(*) FILTER (c = 'message' AND event_id % 4 = 0) AS body_empty,
           CAST(0 AS BIGINT) AS body_failed, min(ts) FILTER (c = 'message') AS oldest, max(ts) FILTER (c = 'message') AS newest FROM rows""")
def message_summary(spark, sf_dir):
    kinds = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("source_pk"),
        F.when(F.col("event_type") == "error", "notice").when(F.col("value") < 10, "unusable").otherwise("message").alias("row_class"),
        F.when(F.col("event_id") % 4 > 0, "decoded").otherwise("empty").alias("body_decode_status"),
    )
    return reads.message_summary(event_messages(spark, sf_dir).join(kinds, "source_pk"))


@query(_EVENT_THREADS + f""", facts AS ({_FACTS})
    SELECT threading_rule_version, count(*) AS conversations, count(*) FILTER (needs_context) AS needs_context,
           count(*) FILTER (inbox_placement = 'reply_inbox') AS reply_inbox, max(message_count) AS largest FROM facts GROUP BY 1""")
def thread_summary(spark, sf_dir):
    return reads.thread_summary(threads.conversations(threads.threaded(event_messages(spark, sf_dir), EVENT_RULE), EVENT_RULE))


@query("SELECT count(*) AS rows, count(*) - count(DISTINCT l_orderkey) AS repeated FROM lineitem")
def repeated_ids(spark, sf_dir):
    return reads.repeated_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query(_EVENT_THREADS + f", facts AS ({_FACTS}) SELECT counterparty_ref, bool_and(needs_context) AS all_need_context FROM facts GROUP BY 1")
def context_flags(spark, sf_dir):
    return reads.context_flags(threads.conversations(threads.threaded(event_messages(spark, sf_dir), EVENT_RULE), EVENT_RULE), "counterparty_ref")


@query(f"""WITH {_USAGE} SELECT output_tokens AS draft_revision_id, provider, model, created_at FROM usage WHERE output_tokens IS NOT NULL
           QUALIFY row_number() OVER (PARTITION BY output_tokens ORDER BY created_at DESC, provider, model) = 1""")
def latest_usage(spark, sf_dir):
    rows = _usage(spark, sf_dir).select(F.col("output_tokens").alias("draft_revision_id"), "provider", "model", "created_at")
    return reads.latest_usage(rows)


@query("""SELECT page_id AS source_pk, '["https://x.test/' || page_id || '.png"]' AS attachments FROM pages WHERE page_id % 3 = 1""")
def missing_attachments(spark, sf_dir):
    k, url = F.col("page_id") % 3, F.concat(F.lit("https://x.test/"), "page_id", F.lit(".png"))
    pages = table(spark, sf_dir, "pages")
    stored = pages.select(F.col("page_id").alias("source_pk"), F.when(k == 0, F.to_json(F.array(url))).alias("attachments"))
    sources = pages.select(F.col("page_id").alias("source_pk"), F.when(k < 2, F.to_json(F.array(url, F.lit("ftp://x.test"), url))).alias("attachments"))
    return reads.missing_attachments(stored, sources)


@query(_TURN_THREADS + f", facts AS ({_FACTS}) SELECT *, 'received' AS workflow_state FROM facts")
def persisted_conversations(spark, sf_dir):
    def outcome(messages: DataFrame) -> feeds.Outcome:
        rows = threads.threaded(messages, REFERENCE_RULE)
        return feeds.Outcome(rows.limit(0), rows, rows.limit(0), threads.conversations(rows, REFERENCE_RULE))

    every = turn_messages(spark, sf_dir)
    first, then = outcome(every.where(F.col("source_pk") % 1000 < 3)), outcome(every)
    empty = feeds.Stored(
        first.conversations.withColumn("workflow_state", F.lit("received")).limit(0), first.messages.limit(0),
        spark.createDataFrame([], "feed_key string, ts timestamp_ntz, pk bigint"),
    )
    return feeds.persisted(feeds.persisted(empty, first, "turns"), then, "turns").conversations


# ---- states that are written -----------------------------------------------------------
@query("""
    WITH came AS (SELECT conv_id * 1000 + turn AS source_pk, coalesce(text, '') AS body, turn FROM conversations WHERE role <> 'assistant'),
    first AS (SELECT source_pk, body FROM came WHERE turn < 3),
    then AS (SELECT source_pk, body || '!' AS body FROM came WHERE turn > 1)
    SELECT coalesce(f.source_pk, t.source_pk) AS source_pk, coalesce(t.body, f.body) AS body_text,
           CASE WHEN f.source_pk IS NULL THEN 'inserted' WHEN t.source_pk IS NULL THEN 'kept' ELSE 'updated' END AS merge_action
    FROM first f FULL JOIN "then" t ON f.source_pk = t.source_pk""".replace("then AS", '"then" AS'))
def unresolved_upsert(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role <> 'assistant'").select(
        F.lit("app").alias("source_database"), F.lit("public").alias("source_schema"), F.lit("turns").alias("source_table"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("source_pk"), F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("source_ts"),
        F.coalesce("text", F.lit("")).alias("body_text"), F.lit("decoded").alias("body_decode_status"),
        F.lit(None).cast("string").alias("source_reference"), "turn",
    )
    stored = feeds.unresolved_upserted(rows.limit(0), rows.where("turn < 3")).drop("merge_action")
    came = rows.where("turn > 1").withColumn("body_text", F.concat("body_text", F.lit("!")))
    return feeds.unresolved_upserted(stored, came).select("source_pk", "body_text", "merge_action")


@query("""
    WITH d AS (SELECT c_custkey AS conversation_id, TIMESTAMP '2024-01-01' AS t FROM customer WHERE c_custkey % 2 = 0),
    asked AS (SELECT DISTINCT o_custkey AS conversation_id FROM orders),
    r AS (SELECT o_custkey AS conversation_id, CAST(count(*) AS INTEGER) AS last FROM orders GROUP BY 1)
    SELECT coalesce(d.conversation_id, a.conversation_id) AS conversation_id, r.last AS current_revision,
           coalesce(d.t, TIMESTAMP '2024-02-01') AS created_at,
           CASE WHEN a.conversation_id IS NOT NULL THEN TIMESTAMP '2024-02-01' ELSE d.t END AS updated_at
    FROM d FULL JOIN asked a ON d.conversation_id = a.conversation_id LEFT JOIN r ON r.conversation_id = coalesce(d.conversation_id, a.conversation_id)""")
def touched_drafts(spark, sf_dir):
    then, now = (F.lit(datetime(2024, m, 1)).cast("timestamp_ntz") for m in (1, 2))
    drafts = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(
        F.col("c_custkey").alias("conversation_id"), F.lit(None).cast("int").alias("current_revision"), then.alias("created_at"), then.alias("updated_at")
    )
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("conversation_id"))
    revisions = orders.groupBy("conversation_id").agg(F.count("*").cast("int").alias("revision"))
    return upsert.pointed(upsert.touched(drafts, orders, "conversation_id", now), revisions, "conversation_id", now)


@query("""
    SELECT o_orderkey, o_orderstatus = 'F' AS may_use,
           CASE o_orderkey % 7
             WHEN 0 THEN 'The draft service has reached its usage limit. Try again in about ' || o_custkey || ' seconds.'
             WHEN 1 THEN 'The draft service has reached its usage limit. Try again shortly.'
             WHEN 2 THEN 'The draft service refused the API key. Check the server configuration.'
             WHEN 3 THEN 'The configured model is not available. Check the server configuration.'
             WHEN 4 THEN 'The draft service rejected the request as malformed.'
             WHEN 5 THEN 'The draft service is temporarily unavailable. Try again shortly.'
             ELSE 'The draft service rejected the request.' END AS told FROM orders""")
def failure_texts(spark, sf_dir):
    k = F.col("o_orderkey") % 7
    status = F.element_at(F.array(*map(F.lit, (429, 429, 403, 404, 400, 503, 418))), (k + 1).cast("int"))
    said = F.when(k == 0, F.concat(F.lit("Quota is used up. Please retry in "), "o_custkey", F.lit("s")))
    single = F.when(F.col("o_orderstatus") == "F", "single_order").when(F.col("o_orderstatus") == "O", "several_orders")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", reads.may_use_order_facts(single).alias("may_use"), T.failure_text(status, said).alias("told")
    )


@query("""
    SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'left' ELSE 'right' END AS side, strftime(o_orderdate, '%Y-%m-%d') AS day,
           'app.public.' || o_orderkey AS message_key, o_orderkey % 5 = 0 OR o_orderkey % 3 = 0 AS review,
           lower(o_orderpriority) = lower('2-high') AS same, length(trim(o_comment_like)) > 0 AS has_text
    FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN '   ' ELSE o_clerk END AS o_comment_like FROM (SELECT *, o_orderpriority AS o_clerk FROM orders))""")
def message_details(spark, sf_dir):
    key = F.col("o_orderkey")
    some, none = F.array(F.lit("x")), F.array().cast("array<string>")
    blank = T.none_if_blank(F.when(key % 4 == 0, "   ").otherwise(F.col("o_orderpriority")))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", T.message_side(F.when(key % 2 == 0, "inbound").otherwise("outbound")).alias("side"),
        T.timestamp_parts(F.col("o_orderdate").cast("timestamp_ntz"))["date"].alias("day"),
        T.message_key(F.lit("app"), F.lit("public"), key.cast("string")).alias("message_key"),
        T.needs_review(key % 5 == 0, F.when(key % 3 == 0, some).otherwise(none), some, none).alias("review"),
        T.same_text(F.concat(F.lit("  "), F.upper("o_orderpriority")), F.lit("2-high")).alias("same"),
        blank.isNotNull().alias("has_text"),
    )


# ---- rules from sheets -----------------------------------------------------------------
#: Half of the brands' files have a category.
_CATEGORIES = {f"Brand#{k}.xlsx": f"Area {k % 4}" for k in range(1, 26, 2)}
_SHEET_ROWS = """
    sheets AS (
      SELECT p_brand || '.xlsx' AS file, CAST(substr(p_brand, 7) AS INTEGER) AS k, CASE WHEN p_size % 5 = 0 THEN 'Terms' ELSE 'Rules' END AS sheet,
             p_partkey, p_name, p_type FROM part),
    numbered AS (SELECT *, CAST(row_number() OVER (PARTITION BY file, sheet ORDER BY p_partkey) AS INTEGER) + 2 AS source_row FROM sheets),
    rules AS (SELECT *, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_name || ' ' || p_type END AS text, p_partkey % 2 = 0 AS forbids
              FROM numbered WHERE sheet = 'Rules' AND k % 2 = 1)"""


def _sheet_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as rows of rules: a sheet ``Rules`` for each brand, below a title and a header, and a
    sheet ``Terms`` of no known layout.  Every third row has no text."""
    sheet = F.when(F.col("p_size") % 5 == 0, "Terms").otherwise("Rules")
    parts = table(spark, sf_dir, "part").select(F.concat("p_brand", F.lit(".xlsx")).alias("file"), sheet.alias("sheet"), "p_partkey", "p_name", "p_type")
    place = F.row_number().over(Window.partitionBy("file", "sheet").orderBy("p_partkey")) + 2
    text = F.when(F.col("p_partkey") % 3 != 0, F.concat_ws(" ", "p_name", "p_type"))
    flag = F.when(F.col("p_partkey") % 2 == 0, "🔴 DON'T").otherwise("🟢 DO")

    def cells(row, values):
        pairs = F.array(*(F.struct(F.lit(k).alias("col"), v.alias("value")) for k, v in enumerate(values)))
        return F.struct(row.cast("int").alias("row"), F.filter(pairs, lambda p: p["value"].isNotNull()).alias("cells"))

    rows = parts.select("file", "sheet", cells(place, (F.col("p_partkey").cast("string"), F.lit("Tone"), text, flag)).alias("x"))
    names = F.when(F.col("sheet") == "Rules", F.array(*map(F.lit, ("#", "Category", "📏 Rule /\nRequirement", "DO or DON'T"))))
    names = F.coalesce(names, F.array(*map(F.lit, ("#", "Term", "Meaning", "Used in"))))
    heads = parts.select("file", "sheet").distinct().withColumn("n", names)
    title = heads.select("file", "sheet", cells(F.lit(1), (F.lit("ALL OF THEM"),)).alias("x"))
    heads = heads.select("file", "sheet", cells(F.lit(2), [F.col("n")[k] for k in range(4)]).alias("x"))
    every = rows.unionByName(title).unionByName(heads).select("file", "sheet", "x.row", F.explode("x.cells").alias("c"))
    return every.select("file", "sheet", "row", "c.col", "c.value")


@query(f"""
    WITH {_SHEET_ROWS} SELECT file AS source_file, source_row, 'Area ' || k % 4 AS category_name, text AS rule_name,
           CASE WHEN NOT forbids THEN text END AS do_instruction, CASE WHEN forbids THEN text END AS dont_instruction
    FROM rules WHERE text IS NOT NULL""")
def sheet_rules(spark, sf_dir):
    found = rules.extracted_rules(_sheet_cells(spark, sf_dir), _CATEGORIES)
    return found.select("source_file", "source_row", "category_name", "rule_name", "do_instruction", "dont_instruction")


@query(f"""
    WITH {_SHEET_ROWS} SELECT DISTINCT file, CASE WHEN k % 2 = 1 THEN sheet END AS sheet,
           CASE WHEN k % 5 = 0 THEN 'kept out' WHEN k % 2 = 0 THEN 'no category mapping' ELSE 'no recognised rule-table layout' END AS reason
    FROM (SELECT file, k, CASE WHEN k % 5 = 0 THEN NULL ELSE sheet END AS sheet FROM sheets) WHERE k % 5 = 0 OR k % 2 = 0 OR sheet = 'Terms'""")
def skipped_sheets(spark, sf_dir):
    return rules.skipped_sheets(_sheet_cells(spark, sf_dir), _CATEGORIES, {f"Brand#{k}.xlsx": "kept out" for k in range(5, 26, 5)})


@query(f"""
    WITH {_SHEET_ROWS}, known AS (SELECT *, source_row % 2 = 0 AS same FROM rules WHERE text IS NOT NULL AND source_row % 3 > 0)
    SELECT r.file AS source_file, r.source_row, CASE WHEN n.file IS NULL THEN 'new' ELSE 'changed' END AS import_action,
           CASE WHEN n.file IS NULL THEN 'draft' END AS state, CASE WHEN n.file IS NULL THEN false END AS active
    FROM rules r LEFT JOIN known n ON n.file = r.file AND n.source_row = r.source_row WHERE r.text IS NOT NULL AND n.same IS DISTINCT FROM true""")
def imported_sources(spark, sf_dir):
    came = rules.unique_rules(rules.extracted_rules(_sheet_cells(spark, sf_dir), _CATEGORIES))
    keys = ["source_file", "source_sheet", "source_row"]
    checksum = F.when(F.col("source_row") % 2 == 0, F.col("content_checksum")).otherwise("older")
    known = came.where("source_row % 3 > 0").select(*keys, checksum.alias("content_checksum"))
    return rules.import_plan(known, came, keys)["sources"].select("source_file", "source_row", "import_action", "state", "active")


@query("""
    SELECT o_orderkey, o_orderkey % 5 <> 3 AND o_orderkey % 5 <> 4 AS valid, NOT (o_orderkey % 5 = 0) AS requires_review,
           CASE WHEN o_orderkey % 5 = 2 THEN 'refund decision' ELSE '' END AS claims FROM orders""")
def checked_drafts(spark, sf_dir):
    k, key = F.col("o_orderkey") % 5, F.col("o_orderkey").cast("string")
    body = F.when(k == 2, "Your refund has been sent for ").otherwise("Thanks for order ")
    reply = F.concat(F.lit('{"draft_reply": "'), body, key, F.lit('", "sources_used": [{"kind": "rule", "ref": "A-1"}], "missing_information": ['))
    reply = F.concat(reply, F.when(k == 1, '"address"').otherwise(""), F.lit('], "requires_review": false}'))
    response = F.when(k == 3, F.concat(F.lit("Sorry, "), key)).when(k == 4, '{"draft_reply": " "}').otherwise(reply)
    rows = table(spark, sf_dir, "orders").select("o_orderkey", response.alias("response"), F.lit("").alias("facts_text"))
    return rules.checked_drafts(rows).select("o_orderkey", "valid", "requires_review", F.array_join("claims", ",").alias("claims"))


@query("""SELECT l_orderkey, l_linenumber, l_returnflag AS kind, 'P-' || l_partkey AS ref FROM lineitem
          WHERE l_returnflag <> 'R' OR l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25)""")
def known_citations(spark, sf_dir):
    ref = F.concat(F.lit("P-"), "l_partkey")
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("kind"), ref.alias("ref"))
    known = table(spark, sf_dir, "part").where("p_size < 25").select(F.concat(F.lit("P-"), "p_partkey").alias("ref"))
    return rules.known_citations(rows, known, "R")


@query("""
    SELECT o_custkey AS draft_id, o_orderkey AS revision_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS revision,
           row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1 AS is_current,
           coalesce((SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey), 0) AS sources FROM orders""")
def draft_history(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    drafts = orders.select(F.col("o_custkey").alias("draft_id"), F.col("o_custkey").alias("conversation_id")).distinct()
    rows = orders.select(F.col("o_custkey").alias("draft_id"), F.col("o_orderkey").alias("revision_id"), "o_orderdate")
    none = spark.createDataFrame([], "draft_id bigint, revision bigint")
    revisions = upsert.next_revisions(none, rows, "draft_id", "o_orderdate", "revision_id").drop("o_orderdate")
    cited = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("revision_id"), F.col("l_returnflag").alias("kind"), F.col("l_partkey").alias("ref"), F.col("l_linenumber").alias("label")
    )
    out = reads.draft_history(drafts, revisions, cited)
    return out.select("draft_id", "revision_id", "revision", "is_current", F.size("sources").cast("long").alias("sources"))


# ---- feeds of mail ---------------------------------------------------------------------
_MAIL = """
    mail AS (
      SELECT o_orderkey AS id, CASE WHEN o_orderkey % 6 > 0 THEN 1 END AS sub_source,
             CASE o_orderkey % 5 WHEN 0 THEN 'shop.test' WHEN 1 THEN 'gmail.com' WHEN 2 THEN 'sub.shop.test' WHEN 4 THEN 'dpd.co.uk' END AS sender,
             CASE o_custkey % 3 WHEN 0 THEN 'shop.test' WHEN 1 THEN 'other.com' END AS receiver,
             CASE WHEN o_custkey % 2 = 0 THEN CAST(o_orderkey AS VARCHAR) END AS order_ref FROM orders),
    sided AS (
      SELECT *, CASE WHEN sender LIKE '%shop.test' AND receiver NOT LIKE '%shop.test' THEN 'outbound'
                     WHEN sender NOT LIKE '%shop.test' AND receiver LIKE '%shop.test' THEN 'inbound' END AS direction FROM mail),
    boxed AS (SELECT *, CASE WHEN direction IS NULL THEN 'ambiguous' WHEN sub_source IS NULL THEN 'unusable' ELSE 'message' END AS row_class FROM sided)"""


def _mail(spark: SparkSession, sf_dir: str, relayed: bool = False) -> DataFrame:
    """Orders as mail: to and from the shop, strangers, a courier and nobody; or as relayed mail."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    sender = F.when(k % 5 == 0, "Shop <a@SHOP.test>").when(k % 5 == 1, "b@gmail.com").when(k % 5 == 2, "c@sub.shop.test").when(k % 5 == 4, "d@dpd.co.uk")
    if relayed:
        sender = F.when(k % 3 == 0, "q1@marketplace.amazon.co.uk").otherwise("relay@amazon.com")
    name = F.when(k % 3 == 1, " Amazon.co.uk ").otherwise("Seller Central Team")
    return table(spark, sf_dir, "orders").select(
        k.alias("id"), k.cast("string").alias("message_id"), F.when(k % 6 > 0, 1).alias("sub_source"), sender.alias("from_msg"),
        F.when(c % 3 == 0, "info@shop.test").when(c % 3 == 1, "z@other.com").alias("to_msg"), name.alias("from_name"),
        F.lit("Hello").alias("subject"), F.when(c % 2 == 0, k.cast("string")).otherwise(" ").alias("order_id"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("message_date"), F.col("o_orderpriority").alias("message_content"),
    )


@query(f"""
    WITH {_MAIL} SELECT id, row_class, direction, coalesce(order_ref, 'unresolved:' || id) AS counterparty_ref,
           CASE WHEN sender = 'dpd.co.uk' THEN 'courier' END AS filter_reason FROM boxed""")
def mailbox_classes(spark, sf_dir):
    out = classify.mailbox_messages(_mail(spark, sf_dir), ["shop.test"])
    return out.select(F.col("source_pk").alias("id"), "row_class", "direction", "counterparty_ref", "filter_reason")


@query(f"""
    WITH {_MAIL}, classed AS (
      SELECT 'shopify' AS feed_key, row_class FROM boxed
      UNION ALL SELECT 'amazon', CASE WHEN id % 3 = 2 THEN 'notice' WHEN sub_source IS NULL THEN 'unusable' ELSE 'message' END FROM mail
      UNION ALL SELECT unnest(['bandq', 'temu']), CASE WHEN sub_source IS NULL THEN 'unusable' ELSE 'message' END FROM mail)
    SELECT feed_key, count(*) AS examined, count(*) FILTER (row_class = 'message') AS message, count(*) FILTER (row_class = 'notice') AS notice,
           count(*) FILTER (row_class = 'ambiguous') AS ambiguous, count(*) FILTER (row_class = 'unusable') AS unusable FROM classed GROUP BY 1""")
def feed_counts(spark, sf_dir):
    mail = _mail(spark, sf_dir)
    raw = {"shopify": mail, "amazon": _mail(spark, sf_dir, True), "bandq": mail, "temu": mail}
    done, _ = feeds.derive_all(feeds.feeds(["shop.test"]), raw)
    return feeds.total_counts(done)


@query(f"""
    WITH {_MAIL}, m AS (SELECT *, order_ref IS NULL AS lone FROM mail WHERE sub_source IS NOT NULL)
    SELECT CASE WHEN lone THEN 'bandq-unresolved-singleton-v1' ELSE 'bandq-source-order-thread-v1' END AS threading_rule_version,
           coalesce(order_ref, 'unresolved:' || id) AS counterparty_ref, count(*) AS message_count FROM m GROUP BY 1, 2""")
def order_threads(spark, sf_dir):
    feed = feeds.feeds([])["bandq"]
    return feeds.derive(feed, _mail(spark, sf_dir)).conversations.select("threading_rule_version", "counterparty_ref", "message_count")


# ---- keys that hold much, and tables that change together ------------------------------
@query("""
    WITH flagged AS (
      SELECT event_type, ts, event_id, CASE WHEN date_trunc('millisecond', ts) - lag(date_trunc('millisecond', ts)) OVER w > INTERVAL 10 MINUTES
                                            THEN 1 ELSE 0 END AS starts
      FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
    SELECT event_type, event_id, CAST(sum(starts) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment
    FROM flagged""")
def hot_gap_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", "ts", "event_id")
    found = threads.spread_gap_segments(rows, ["event_type"], "ts", "event_id", "10 minutes", most=500)
    return found.select("event_type", "event_id", "segment")


def _stored_turns(spark: SparkSession, sf_dir: str) -> store.Pages:
    """All turns, stored in three pages of which the second comes twice."""

    def outcome(messages: DataFrame) -> feeds.Outcome:
        rows = threads.threaded(messages, REFERENCE_RULE)
        return feeds.Outcome(rows.limit(0), rows, rows.limit(0), threads.conversations(rows, REFERENCE_RULE))

    every = turn_messages(spark, sf_dir)
    pages = [outcome(every.where(F.col("source_pk") % 1000 < n)) for n in (2, 3)] + [outcome(every)]
    kept = pages[0].conversations.withColumn("workflow_state", F.lit("received"))
    out = store.Pages(spark, store.scratch(spark, "pages"), kept.schema, pages[0].messages.schema, buckets=8)
    for number in (0, 1, 1, 2):
        out.persist(pages[number], "turns", number)
    out.store.compact("messages", 2)
    return out


@query(_TURN_THREADS + f", facts AS ({_FACTS}) SELECT *, 'received' AS workflow_state FROM facts")
def stored_pages(spark, sf_dir):
    return _stored_turns(spark, sf_dir).conversations()


@query("SELECT 'turns' AS feed_key, max(TIMESTAMP '2024-01-01' + turn * INTERVAL 1 MINUTE) AS ts, "
       "arg_max(conv_id * 1000 + turn, (turn, conv_id)) AS pk FROM conversations")
def stored_cursors(spark, sf_dir):
    return _stored_turns(spark, sf_dir).cursors()


@query("""
    WITH known AS (
      SELECT 'P-' || (p_partkey % 40) AS ref, p_name AS title, p_partkey AS row FROM part
      QUALIFY row_number() OVER (PARTITION BY p_partkey % 40 ORDER BY p_brand DESC, p_partkey DESC) = 1)
    SELECT o_orderkey, CASE WHEN title IS NULL THEN 'unresolved' ELSE 'cited' END AS state, title
    FROM (SELECT o_orderkey, 'P-' || (o_custkey % 50) AS ref FROM orders) LEFT JOIN known USING (ref)""")
def clashing_refs(spark, sf_dir):
    known = table(spark, sf_dir, "part").select(
        F.concat(F.lit("[P-"), F.col("p_partkey") % 40, F.lit("]")).alias("ref"), F.col("p_name").alias("title"), F.lit("t").alias("text"),
        F.lit("A").alias("category"), F.col("p_brand").alias("source_sheet"), F.col("p_partkey").alias("source_row"),
    )
    cites = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.concat(F.lit("P-"), F.col("o_custkey") % 50)).alias("refs"))
    return rules.resolved_citations(cites, known, "o_orderkey").select("o_orderkey", "state", "title")


# ---- sources by name, pages of a stream, usage rows ------------------------------------
@query("""
    SELECT CAST(event_id AS VARCHAR) AS id, CAST(event_id * 3 AS VARCHAR) AS ext_message_id, 'm' || event_id AS message_id, 1 AS sub_source,
           CAST(user_id AS VARCHAR) AS item_id, event_id % 2 AS folder_id, event_type AS message_type, 'c' || user_id AS sender_id,
           'us' AS receiver_id, strftime(ts, '%Y-%m-%d %H:%M') AS received, o_orderpriority AS body_raw
    FROM events LEFT JOIN orders ON o_orderkey = event_id * 3 WHERE ts >= TIMESTAMP '2024-01-10'""")
def header_body_scan(spark, sf_dir):
    """Events as headers, orders as bodies of those whose number is theirs."""
    headers = table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), (F.col("event_id") * 3).alias("ext_message_id"), F.concat(F.lit("m"), "event_id").alias("message_id"),
        F.lit(1).alias("sub_source"), F.col("user_id").alias("item_id"), (F.col("event_id") % 2).alias("folder_id"),
        F.col("event_type").alias("message_type"), F.concat(F.lit("c"), "user_id").alias("sender_id"), F.lit("us").alias("receiver_id"),
        F.col("ts").alias("receive_date"), F.col("props").alias("unread"),
    )
    bodies = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("message_id"), F.col("o_orderpriority").alias("message"))
    out = scans.source_scan("ebay", headers, scans.Since(datetime(2024, 1, 10)), bodies=bodies)
    return out.withColumn("received", F.left("receive_date", F.lit(16))).drop("receive_date")


@query("""SELECT event_id, user_id, event_type FROM events WHERE (ts, event_id) > (TIMESTAMP '2024-01-09 12:00:00', 17)
          ORDER BY ts, event_id LIMIT 5000""")
def streamed_page(spark, sf_dir):
    """The first page of a stream that begins behind a place."""
    base = store.scratch(spark, "page")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    window = scans.After(datetime(2024, 1, 9, 12), 17)
    pages = cursors.read_pages(spark, f"{sf_dir}/events.parquet", rows.schema, "ts", "event_id", window, f"{base}/check", 5000)

    def take(page: DataFrame, number: int) -> int:
        return store.counted(page, lambda df: df.write.mode("overwrite").parquet(f"{base}/page={number}"))

    cursors.run_pages(pages, f"{base}/check", take, max_pages=1)
    return spark.read.schema(rows.schema).parquet(f"{base}/page=0").drop("ts")


@query("""
    SELECT o_orderkey AS conversation_id, CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey * 10 END AS draft_revision_id,
           CAST(CASE WHEN o_orderpriority LIKE '1%' THEN o_custkey * 3 + o_orderkey * 9
                     WHEN o_orderpriority LIKE '5%' THEN round(o_custkey * 0.25 + o_orderkey * 1.5) END AS DOUBLE) / 1000000 AS cost, 'ok' AS outcome FROM orders""")
def recorded_usage(spark, sf_dir):
    """Orders as calls, written to a log and read from it; a write that fails leaves it as it is."""
    path = store.scratch(spark, "usage")
    rates = spark.createDataFrame([("1-", "3", "9"), ("5-", "0.25", "1.5")], "prefix string, i string, o string").select(
        "prefix", F.col("i").cast("decimal(10,4)").alias("input_rate"), F.col("o").cast("decimal(10,4)").alias("output_rate")
    )
    calls = table(spark, sf_dir, "orders").select(
        F.lit("p").alias("provider"), F.col("o_orderpriority").alias("model"), F.col("o_orderkey").alias("conversation_id"),
        F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderkey") * 10).alias("draft_revision_id"), F.col("o_custkey").alias("input_tokens"),
        F.col("o_orderkey").alias("output_tokens"), (F.col("o_custkey") + F.col("o_orderkey")).alias("total_tokens"),
        F.lit("ok").alias("outcome"), F.col("o_orderdate").alias("created_at"),
    )
    usage.record_usage(calls.drop("outcome"), rates, path, log=lambda said: None)
    usage.record_usage(calls, rates, path)
    found = spark.read.schema(calls.select(*(c for c in usage.USAGE_COLUMNS if c in calls.columns)).schema.add("estimated_cost_usd", "decimal(12,6)"))
    return found.parquet(path).select("conversation_id", "draft_revision_id", F.col("estimated_cost_usd").cast("double").alias("cost"), "outcome")


@query("""SELECT l_orderkey, l_linenumber FROM lineitem JOIN orders ON o_orderkey = l_orderkey
          WHERE o_orderpriority = '2-HIGH' AND l_returnflag = 'N'""")
def backfill_scope(spark, sf_dir):
    """Lines as messages of orders, priorities as marketplaces, flags as tables."""
    messages = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("conversation_id"), "l_linenumber", F.col("l_returnflag").alias("source_table"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conversation_id"), F.col("o_orderpriority").alias("marketplace"))
    out = reads.messages_of(messages, orders, "2-HIGH", "N")
    return out.select(F.col("conversation_id").alias("l_orderkey"), "l_linenumber")


# ---- reports of rules, and what drafts are given and checked by ------------------------
@query(f"""
    WITH {_SHEET_ROWS},
    dup AS (SELECT *, count(*) OVER (PARTITION BY file) AS n FROM rules WHERE text IS NOT NULL),
    one AS (SELECT file, 'Area ' || k % 4 AS area, forbids FROM dup),
    part AS (
      SELECT 'file' AS part, file AS name, count(*) AS rules, count(*) AS dropped FROM one GROUP BY 2
      UNION ALL SELECT 'type', 'do_dont', count(*), NULL FROM one
      UNION ALL SELECT 'category', area, count(*), NULL FROM one GROUP BY 2
      UNION ALL SELECT 'total', NULL, count(*), count(*) FROM one
      UNION ALL SELECT 'scrubbed', NULL, count(*), NULL FROM part WHERE p_partkey % 7 = 0
      UNION ALL SELECT 'skipped', NULL, count(DISTINCT file || sheet) FILTER (k % 2 = 1 AND sheet = 'Terms') + count(DISTINCT file) FILTER (k % 2 = 0), NULL FROM sheets)
    SELECT * FROM part""")
def import_totals(spark, sf_dir):
    """A corpus that comes twice, so that each rule is dropped once."""
    cells = _sheet_cells(spark, sf_dir)
    found = rules.extracted_rules(cells, _CATEGORIES)
    scrubbed = table(spark, sf_dir, "part").where("p_partkey % 7 = 0")
    out = rules.import_totals(found.unionByName(found), rules.unique_rules(found), rules.skipped_sheets(cells, _CATEGORIES), scrubbed)
    return out.select("part", "name", "rules", "dropped")


@query("""
    WITH placed AS (SELECT p_brand AS area, min((p_size, p_partkey)) AS first, count(*) AS rules, string_agg('P-' || p_partkey, ',' ORDER BY p_size, p_partkey) AS refs
                    FROM part GROUP BY 1)
    SELECT area, row_number() OVER (ORDER BY first, area) AS place, rules, refs FROM placed""")
def rule_areas(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select(F.col("p_brand").alias("category"), "p_size", "p_partkey", F.concat(F.lit("P-"), "p_partkey").alias("ref"))
    return rules.areas_in_order(parts, "p_size", "p_partkey").withColumn("refs", F.array_join("refs", ","))


@query("""
    WITH facts AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'R' THEN 'Refund ' ELSE 'colour ' END || l_linenumber AS name,
                          '- ' || CASE WHEN l_returnflag = 'R' THEN 'Refund ' ELSE 'colour ' END || l_linenumber || ': ' || l_linestatus AS line FROM lineitem)
    SELECT o_orderkey AS conversation_id,
           'ORDER:' || chr(10) || coalesce(string_agg(line, chr(10) ORDER BY l_linenumber, line) FILTER (name LIKE 'Refund%'), 'nothing is known') AS order_block,
           'PRODUCT:' || chr(10) || coalesce(nullif(concat_ws(chr(10), CASE WHEN o_orderkey % 2 = 0 THEN '- listing: L' || o_orderkey END,
             string_agg(line, chr(10) ORDER BY l_linenumber, line) FILTER (name LIKE 'colour%')), ''), 'nothing is known') AS product_block
    FROM orders LEFT JOIN facts ON l_orderkey = o_orderkey GROUP BY o_orderkey""")
def context_blocks(spark, sf_dir):
    name = F.concat(F.when(F.col("l_returnflag") == "R", "Refund ").otherwise("colour "), "l_linenumber")
    facts = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("conversation_id"), F.col("l_linenumber").alias("place"), name.alias("name"), F.col("l_linestatus").alias("value")
    )
    listing = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("L"), "o_orderkey"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("conversation_id"), listing.alias("listing_item_ref"))
    return rules.context_blocks(orders, facts)


@query("""
    SELECT o_orderkey AS revision_id, concat_ws(',', CASE WHEN p_size < 25 THEN 'P-' || p_partkey END, CASE WHEN o_orderkey % 3 = 0 THEN 'total' END) AS cited,
           NOT (coalesce(p_size < 25, false) OR o_orderkey % 3 = 0) AS requires_review
    FROM orders LEFT JOIN part ON p_partkey = o_custkey""")
def cited_drafts(spark, sf_dir):
    """Drafts that cite a part in brackets and a fact; only small parts are rules, and a third know the fact."""
    key = F.col("o_orderkey")
    cites = F.concat(
        F.lit('[{"kind": "cst_document", "ref": "[P-'), "o_custkey", F.lit(']"}, {"kind": "fact", "ref": "total"}, {"kind": "cst_document", "ref": " "}]')
    )
    response = F.concat(F.lit('{"draft_reply": "Thank you", "missing_information": [], "requires_review": false, "sources_used": '), cites, F.lit("}"))
    names = F.when(key % 3 == 0, F.array(F.lit("total"))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, sf_dir, "orders").select(key.alias("revision_id"), response.alias("response"), F.lit("").alias("facts_text"), names.alias("names"))
    known = table(spark, sf_dir, "part").where("p_size < 25").select(F.concat(F.lit("P-"), "p_partkey").alias("ref"))
    out = rules.checked_drafts(rows, fact_names="names", known=known)
    cited = F.array_join(F.transform("sources", lambda x: x["ref"]), ",")
    return out.select("revision_id", cited.alias("cited"), "requires_review")
