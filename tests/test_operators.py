import random
from datetime import datetime, timedelta

import pytest
from loomspark.operators import classify, reads, rules, threads, upsert, usage
from loomspark.plans import feeds
from loomspark.sources import scans
from pyspark.sql import functions as F

DAY = datetime(2026, 8, 1, 10)
HEADERS = (
    "id bigint, message_id string, ext_message_id bigint, message_type string, sub_source int, item_id string, folder_id int, "
    "sender_id string, receiver_id string, receive_date timestamp_ntz, body_raw string"
)
MAIL = (
    "id bigint, message_id string, sub_source int, from_msg string, to_msg string, from_name string, subject string, order_id string, "
    "message_date timestamp_ntz, message_content string"
)


def header(id, ts=DAY, folder=0, item="555", sub=1, kind="Ask", ext=1, sender="buyer", body='"hello"'):
    return (id, str(id), ext, kind, sub, item, folder, sender, "seller", ts, body)


def mail(id, frm="b@gmail.com", to="s@shop.test", sub=1, name=None, subject="Hi", order=None, body="text"):
    return (id, str(id), sub, frm, to, name, subject, order, DAY + timedelta(minutes=id), body)


def test_gap_boundary_and_ties(spark):
    rows = [header(k, DAY + timedelta(days=d, seconds=s)) for k, d, s in [(1, 0, 0), (2, 30, 0), (3, 60, 1), (10, 60, 1), (9, 60, 1)]]
    feed = feeds.feeds([])["ebay"]
    out = feeds.derive(feed, spark.createDataFrame(rows, HEADERS))
    got = {r["source_pk"]: r["segment"] for r in out.messages.collect()}
    assert got == {1: 0, 2: 0, 3: 1, 9: 1, 10: 1}
    facts = sorted(out.conversations.collect(), key=lambda r: r["first_source_ts"])
    assert [r["message_count"] for r in facts] == [2, 3]
    assert {r["threading_strategy"] for r in facts} == {"item_linked"} and not facts[0]["needs_context"]
    assert threads.thread_problems(out.messages, out.conversations).count() == 0
    ordered = reads.thread_in_order(out.messages, F.col("segment") == 1).select("source_pk").collect()
    assert [r[0] for r in ordered] == [3, 9, 10]


def test_header_classes(spark):
    rows = [
        header(1), header(2, kind=None, ext=None, folder=7), header(3, folder=5), header(4, sub=None), header(5, sender=""),
        header(6, item="0"), header(7, folder=1, kind=None),
    ]
    out = classify.header_body_messages(spark.createDataFrame(rows, HEADERS))
    kinds = {r["source_pk"]: r["row_class"] for r in out.collect()}
    assert kinds == {1: "message", 2: "notice", 3: "unusable", 4: "unusable", 5: "unusable", 6: "message", 7: "message"}
    counts = classify.class_counts(out).first()
    assert counts["examined"] == sum(counts[k] for k in ("message", "notice", "ambiguous", "unusable"))
    lone = threads.threaded(out.where("source_pk = 6"), threads.RULES["ebay"]).first()
    assert lone["threading_strategy"] == "no_item" and lone["needs_context"] and lone["listing_item_ref"] is None


def test_mailbox(spark):
    rows = [
        mail(1), mail(2, "s@shop.test", "b@gmail.com", order=" A1"), mail(3, "x@a.test", "y@b.test", sub=None), mail(4, sub=None),
        mail(5, "n@mail.dpd.co.uk"), mail(6, "n@firm.example", subject="Offer"), mail(7, "n@firm.example", subject="Re: order"),
        mail(8, "x@notshop.test", "s@mail.shop.test"), mail(9, subject="Undeliverable: x"), mail(10, None),
    ]
    out = {r["source_pk"]: r for r in classify.mailbox_messages(spark.createDataFrame(rows, MAIL), ["shop.test"]).collect()}
    kinds = [out[k]["row_class"] for k in range(1, 11)]
    assert kinds == ["message", "message", "ambiguous", "unusable", "message", "message", "message", "message", "message", "ambiguous"]
    assert [out[k]["filter_reason"] for k in (1, 5, 6, 7, 9)] == [None, "courier", "unsolicited", None, "bounce"]
    assert out[2]["direction"] == "outbound" and out[2]["counterparty_ref"] == " A1" and out[1]["counterparty_ref"] == "unresolved:1"


def test_relay(spark):
    rows = [
        mail(1, "a@marketplace.amazon.co.uk"), mail(2, "r@amazon.com", name=" Amazon.co.uk "),
        mail(3, "n@amazon.com", name="Seller Central", sub=None), mail(4, "x@y.test"),
    ]
    out = classify.relay_messages(spark.createDataFrame(rows, MAIL)).orderBy("source_pk").collect()
    assert [(r["row_class"], r["direction"]) for r in out] == [
        ("message", "inbound"), ("message", "outbound"), ("notice", None), ("unusable", None),
    ]


def test_feeds_stand_alone(spark):
    known = feeds.feeds(["shop.test"])
    raw = {"temu": spark.createDataFrame([mail(1), mail(2)], MAIL), "bandq": spark.range(1), "shopify": spark.createDataFrame([mail(3)], MAIL)}
    done, failed = feeds.derive_all(known, raw)
    assert set(done) == {"temu", "shopify"} and set(failed) == {"bandq"}
    assert feeds.all_conversations(done).count() == 3


def test_a_feed_that_fails_while_it_runs(spark):
    known = feeds.feeds(["shop.test"])
    bad = spark.createDataFrame([mail(3)], MAIL).withColumn("message_content", F.raise_error(F.lit("damaged file")).cast("string"))
    raw = {"shopify": bad, "temu": spark.createDataFrame([mail(1), mail(2)], MAIL)}
    written = {}

    def write(name, outcome):
        written[name] = outcome.messages.unionByName(outcome.unresolved, True).collect()

    done, failed = feeds.run_all(known, raw, write)
    assert done == ["temu"] and set(failed) == {"shopify"} and "damaged file" in failed["shopify"] and len(written["temu"]) == 2


UNRESOLVED = "source_database string, source_schema string, source_table string, source_pk bigint, source_ts timestamp_ntz, " \
    "body_text string, body_decode_status string, source_reference string, sub_source_id int"


def test_unresolved_messages_are_stored_by_full_identity(spark):
    table = lambda *rows: spark.createDataFrame(rows, UNRESOLVED)
    first = table(("d", "s", "t", 1, DAY, "a", "decoded", None, 1), ("d", "s", "u", 1, DAY, "b", "decoded", None, 1))
    stored = feeds.unresolved_upserted(first.limit(0), first)
    assert tuple(feeds.merge_counts(stored).first()) == (2, 0, 0)
    stored = stored.drop("merge_action")
    later = DAY + timedelta(1)
    came = table(("d", "s", "t", 1, later, "c", "failed", "r", 9), ("d", "s", "t", 1, DAY, "old", "decoded", None, 9), ("d", "s", "t", 2, DAY, "n", "decoded", None, 1))
    again = feeds.unresolved_upserted(stored, came)
    assert tuple(feeds.merge_counts(again).first()) == (1, 1, 1)
    one = again.where("source_table = 't' and source_pk = 1").first()
    # the time of the source and what isn't the body's never change
    assert (one["body_text"], one["body_decode_status"], one["source_reference"], one["source_ts"], one["sub_source_id"]) == ("c", "failed", "r", DAY, 1)
    twice = feeds.unresolved_upserted(again.drop("merge_action"), came)
    assert sorted(map(str, twice.drop("merge_action").collect())) == sorted(map(str, again.drop("merge_action").collect()))


def test_sessions_take_one_shuffle(spark, sf_dir):
    from loomspark import catalogue

    plan = catalogue.QUERIES["gap_sessions"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    rates = catalogue.QUERIES["longest_prefix_rate"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in rates and "CartesianProduct" not in rates


def test_drafts_are_touched_and_pointed(spark):
    now, old = F.lit(DAY).cast("timestamp_ntz"), DAY - timedelta(3)
    drafts = spark.createDataFrame([(1, 2, old, old), (2, 1, old, old)], "conversation_id int, current_revision int, created_at timestamp_ntz, updated_at timestamp_ntz")
    out = upsert.touched(drafts, spark.createDataFrame([(2,), (3,), (3,)], "conversation_id int"), "conversation_id", now)
    assert sorted(map(tuple, out.collect())) == [(1, 2, old, old), (2, 1, old, DAY), (3, None, DAY, DAY)]
    revisions = spark.createDataFrame([(1, 1), (1, 2), (2, 1), (2, 2), (3, 1)], "conversation_id int, revision int")
    out = upsert.pointed(out, revisions, "conversation_id", now)
    assert sorted(map(tuple, out.collect())) == [(1, 2, old, old), (2, 2, old, DAY), (3, 1, DAY, DAY)]
    said = []
    assert upsert.recorded(lambda: None) == {"recorded": True}
    assert upsert.recorded(lambda: 1 / 0, said.append) == {"recorded": False} and said


def test_citations_of_unknown_rules_go(spark):
    rows = spark.createDataFrame([("rule", "a"), ("rule", "b"), ("order", "c"), (None, "d")], "kind string, ref string")
    known = spark.createDataFrame([("a",), ("a",)], "ref string")
    assert sorted(r["ref"] for r in rules.known_citations(rows, known, "rule").collect()) == ["a", "c", "d"]
    assert rules.known_citations(rows, None, "rule").count() == 4


def test_evidence_export(spark):
    evidence = spark.createDataFrame([(1, '[{"ref":"A-1"},{"ref":"B-2"}]', ["x-1"], []), (2, "[]", [], [])], "revision_id int, matched string, unresolved array<string>, legacy array<string>")
    usage = spark.createDataFrame([(1, "p", "m", 10, 0.5, 1300)], "revision_id int, provider string, model string, total_tokens int, estimated_cost_usd double, rules_supplied int")
    messages = spark.createDataFrame([(1, "inbound", DAY), (1, "outbound", DAY + timedelta(1))], "revision_id int, direction string, source_ts timestamp_ntz")
    out = {r["revision_id"]: r for r in rules.evidence_export(evidence, usage, messages).collect()}
    assert (out[1]["cited_rules"], out[1]["unmatched_refs"], out[1]["rules_supplied"], out[1]["last_customer_ts"]) == (2, 1, 1300, DAY)
    assert (out[2]["cited_rules"], out[2]["provider"]) == (0, None)


def test_windows_and_limits(spark):
    rows = spark.createDataFrame([(k, DAY) for k in (1, 2, 10)] + [(3, DAY - timedelta(1))], "pk bigint, ts timestamp_ntz")
    found = scans.scan(rows, ["pk"], "ts", "pk", scans.After(DAY, 1))
    assert sorted(r[0] for r in found.collect()) == [2, 10]
    assert scans.scan(rows, ["pk"], "ts", "pk", scans.Everything(), 2).collect()[0][0] == 3
    with pytest.raises(ValueError):
        scans.in_window(F.col("ts"), F.col("pk"), None)
    assert [scans.fetch_limit(x) for x in (None, 7, 9999)] == [200, 7, 5000]
    for wrong in (0, -1, 1.5, True):
        with pytest.raises(ValueError):
            scans.fetch_limit(wrong)
    assert [scans.read_limit(x) for x in (None, 0, 7, 999)] == [100, 100, 7, 200]


def test_cursor_predicate_is_pushed(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    plan = events.where(scans.after_cursor(F.col("ts"), F.col("event_id"), scans.After(datetime(2024, 1, 15), 3)))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts" in text


def test_merges_are_idempotent(spark):
    a = spark.createDataFrame([(1, "x", "t1"), (2, "y", "t1")], "k int, body string, first string")
    b = spark.createDataFrame([(2, "z", "t2"), (3, None, "t2")], "k int, body string, first string")
    once = upsert.merged(a, b, ["k"], ["body"])
    assert sorted(map(tuple, once.collect())) == [(1, "x", "t1", "kept"), (2, "z", "t1", "updated"), (3, None, "t2", "inserted")]
    twice = upsert.merged(once.drop("merge_action"), b, ["k"], ["body"])
    assert sorted(map(tuple, twice.drop("merge_action").collect())) == sorted(map(tuple, once.drop("merge_action").collect()))


def test_cursors(spark):
    m = spark.createDataFrame([(DAY, "9"), (DAY, "10"), (DAY - timedelta(1), "99")], "source_ts timestamp_ntz, source_pk string")
    assert tuple(upsert.highest_cursor(m).first()) == (DAY, 10)
    assert tuple(upsert.highest_cursor(m.limit(0)).first()) == (None, None)
    schema = "feed_key string, ts timestamp_ntz, pk bigint"
    old = spark.createDataFrame([("a", DAY, 5), ("b", None, None)], schema)
    new = spark.createDataFrame([("a", DAY - timedelta(1), 50), ("b", DAY, 1)], schema)
    assert sorted(map(tuple, upsert.advanced_cursors(old, new).collect())) == [("a", DAY, 5), ("b", DAY, 1)]


def test_workflow(spark):
    states = spark.createDataFrame([(1, "received"), (2, "reviewed"), (3, "drafting")], "k int, state string")
    wishes = spark.createDataFrame([(1, "received", "drafting"), (2, "reviewed", "drafting"), (3, "received", "drafting")],
                                   "k int, expected string, wanted string")
    out = sorted(map(tuple, upsert.moved_states(states, wishes, "k").collect()))
    assert out == [(1, "drafting", True), (2, "reviewed", False), (3, "drafting", False)]


def test_usage_of_empty_log(spark):
    schema = "provider string, model string, input_tokens int, output_tokens int, total_tokens int, estimated_cost_usd decimal(12,6), created_at timestamp_ntz"
    row = reads.usage_summary(spark.createDataFrame([], schema), F.lit(DAY).cast("timestamp_ntz")).first()
    assert row["calls"] == 0 and row["total_tokens"] == 0 and row["cost"] is None


def test_costs(spark):
    from decimal import Decimal

    rates = spark.createDataFrame([("m", Decimal(2), Decimal(8)), ("m-mini", Decimal("0.4"), Decimal("1.6"))],
                                  "prefix string, input_rate decimal(10,4), output_rate decimal(10,4)")
    calls = spark.createDataFrame([("m-1", 10**6, None), ("m-mini-2", 10**6, 0), ("x", 1, 1), ("m", None, None)], "model string, i int, o int")
    out = reads.longest_prefix(calls, rates, "model").withColumn("cost", reads.estimated_cost(F.col("i"), F.col("o")))
    got = {r["model"]: r["cost"] for r in out.collect()}
    assert got == {"m-1": Decimal("2.000000"), "m-mini-2": Decimal("0.400000"), "x": None, "m": None}


def test_draft_history(spark):
    drafts = spark.createDataFrame([(1, 7)], "draft_id int, conversation_id int")
    revisions = spark.createDataFrame([(10, 1, 1), (11, 1, 2)], "revision_id int, draft_id int, revision int")
    cites = spark.createDataFrame([(10, "b", "r", None), (10, "a", "z", "l")], "revision_id int, kind string, ref string, label string")
    out = reads.draft_history(drafts, revisions, cites).collect()
    assert [(r["revision"], r["is_current"], [tuple(s) for s in r["sources"]]) for r in out] == [
        (2, True, []), (1, False, [("a", "z", "l"), ("b", "r", None)]),
    ]


def test_lookups(spark):
    assert [reads.conversation_id(x) for x in ("7", "07", "x", "1" * 20, "7\n")] == [7, None, None, None, None]
    assert [reads.marketplace(x, ["ebay"]) for x in ("ebay", "EBAY", None)] == ["ebay", None, None]
    feed = feeds.feeds([])["temu"]
    out = feeds.derive(feed, spark.createDataFrame([mail(2), mail(1)], MAIL))
    heads = out.conversations.withColumn("conversation_id", F.lit(1)).limit(1)
    messages = out.messages.withColumn("conversation_id", F.lit(1))
    one, found = reads.conversation_detail(heads, messages, 1, "temu")
    assert one.count() == 1 and [r["source_pk"] for r in found.collect()] == [1, 2]
    assert [x.count() for x in reads.conversation_detail(heads, messages, 1, "ebay")] == [0, 0]
    assert reads.repeated_ids(messages.limit(0), "source_pk").first()["rows"] == 0
    assert feeds.total_counts({"temu": out}).first()["examined"] == 2
    assert feeds.resume_window(None, DAY) == scans.Since(DAY) and feeds.resume_window((DAY, 3), DAY) == scans.After(DAY, 3)


def test_persisting_twice_changes_nothing(spark):
    feed = feeds.feeds([])["bandq"]
    early = feeds.derive(feed, spark.createDataFrame([mail(1, order="A"), mail(2)], MAIL))
    both = feeds.derive(feed, spark.createDataFrame([mail(1, order="A", body="new"), mail(2), mail(3, order="A")], MAIL))
    empty = feeds.Stored(
        early.conversations.withColumn("workflow_state", F.lit("")).limit(0), early.messages.limit(0),
        spark.createDataFrame([], "feed_key string, ts timestamp_ntz, pk bigint"),
    )
    stored = feeds.persisted(empty, early, "b")
    moved = feeds.Stored(stored.conversations.withColumn("workflow_state", F.lit("drafting")), stored.messages, stored.cursors)
    once = feeds.persisted(moved, both, "b")
    rows = {r["counterparty_ref"]: r for r in once.conversations.collect()}
    assert rows["A"]["message_count"] == 2 and rows["A"]["workflow_state"] == "drafting" and len(rows) == 2
    assert {r["source_pk"]: r["body_text"] for r in once.messages.collect()} == {1: "new", 2: "text", 3: "text"}
    assert once.cursors.first()["pk"] == 3
    again = feeds.persisted(once, both, "b")
    for name in ("conversations", "messages", "cursors"):
        a, b = getattr(once, name), getattr(again, name)
        assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect()))


def test_hot_keys_are_cut_into_pieces(spark):
    """Equal to the plain scan: many rows of one instant, gaps at the edges of pieces, null keys, late rows."""
    import datetime as dt
    import random

    from loomspark.operators import threads

    rng, start = random.Random(5), dt.datetime(2024, 1, 1)
    rows = [("hot", None, start + dt.timedelta(minutes=rng.choice([0, 0, 1, 7, 300]) * rng.randrange(60), microseconds=rng.randrange(900)), k) for k in range(900)]
    rows += [("hot", None, start + dt.timedelta(days=40), 1000 + k) for k in range(300)]  # one instant
    rows += [(None, "x", start + dt.timedelta(hours=k * k), 2000 + k) for k in range(150)]
    rows += [(f"c{k % 9}", "y", start + dt.timedelta(hours=k), 3000 + k) for k in range(60)] + [("n", "z", None, 5000), ("n", "z", start, 5001)]
    df = spark.createDataFrame(rows, "a string, b string, ts timestamp_ntz, pk bigint")
    for gap in ("10 minutes", "1 day"):
        want = sorted(map(tuple, threads.gap_segments(df, ["a", "b"], "ts", "pk", gap).collect()), key=str)
        for most in (40, 200, 10_000):
            got = threads.spread_gap_segments(df, ["a", "b"], "ts", "pk", gap, most=most)
            assert sorted(map(tuple, got.collect()), key=str) == want
    found = threads.spread_gap_segments(df, ["a", "b"], "ts", "pk", "1 day", most=100)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_pieces_of_hot_keys_cost_no_more_than_their_rows(spark, monkeypatch):
    """One key far above others that are just hot: rows meet no array of bounds, and bounds are about one a piece."""
    start = datetime(2024, 1, 1)
    rows = [("large", start + timedelta(minutes=7 * k % 9001), k) for k in range(3000)] + [("large", None, 9000 + k) for k in range(60)]
    rows += [(f"k{k % 40}", start + timedelta(minutes=k * k % 5003), 10_000 + k) for k in range(40 * 11)] + [(None, start, 20_000)]
    df = spark.createDataFrame(rows, "a string, ts timestamp_ntz, pk bigint")
    kept, make = [], getattr(threads, "_piece", None)
    monkeypatch.setattr(threads, "_piece", lambda bounds: kept.append(bounds) or make(bounds), raising=False)
    got = threads.spread_gap_segments(df, ["a"], "ts", "pk", "3 minutes", most=10)
    assert "lambda" not in got._jdf.queryExecution().optimizedPlan().toString()
    want = threads.gap_segments(df, ["a"], "ts", "pk", "3 minutes").collect()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want), key=str)
    assert len(kept[0]) == 41 and sum(map(len, kept[0].values())) <= 2 * len(rows) / 10


def test_page_starts_of_a_table_as_it_is_read(spark, sf_dir):
    """Ranges of a time column that comes straight from the files, to which Spark may infer filters."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = sorted((r["ts"], r["event_id"]) for r in events.collect())
    want = [(k // 7, *rows[k]) for k in range(0, len(rows), 7)]
    for most in (40, 100, 500):
        assert sorted(map(tuple, reads.page_starts(events, 7, "ts", "event_id", most).collect())) == want


def test_page_starts_in_ranges(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", F.date_trunc("DAY", "ts").cast("timestamp_ntz").alias("ts"))
    rows = sorted((r["ts"], r["event_id"]) for r in events.collect())
    want = [(k // 7, *rows[k]) for k in range(0, len(rows), 7)]
    for most in (40, 10**6):  # many rows of one instant, and one range
        assert sorted(map(tuple, reads.page_starts(events, 7, "ts", "event_id", most).collect())) == want
    assert reads.page_starts(events.limit(0), 7, "ts", "event_id").count() == 0


def test_wishes_are_replayed_in_pieces(spark):
    """Equal to granting them one by one, with a key that has many wishes and keys without a state."""
    rng = random.Random(4)
    names = [*upsert.TRANSITIONS, "unknown", None]
    start = datetime(2024, 1, 1)
    rows = [(rng.choice([1, 1, 1, 2, 3, 4]), start + timedelta(hours=rng.randrange(300)), n, rng.choice(names)) for n in range(1500)]
    states = {1: "received", 2: "reviewed", 3: "elsewhere"}
    now, want = dict(states), {}
    for key, _, pk, wanted in sorted(rows, key=lambda r: r[1:3]):
        was = now.get(key)
        moved = wanted in upsert.TRANSITIONS.get(was, ())
        want[pk] = (was, moved)
        if moved:
            now[key] = wanted
    wishes = spark.createDataFrame(rows, "k bigint, ts timestamp_ntz, pk bigint, wanted string").repartition(5)
    known = spark.createDataFrame(list(states.items()), "k bigint, state string")
    # reviewed ends it, so without it the long key moves to its end
    for some in (wishes, wishes.where("wanted <> 'reviewed'")):
        kept = {r["pk"] for r in some.collect()}
        if len(kept) < len(rows):
            now, want = dict(states), {}
            for key, _, pk, wanted in sorted((r for r in rows if r[2] in kept), key=lambda r: r[1:3]):
                was = now.get(key)
                want[pk] = (was, wanted in upsert.TRANSITIONS.get(was, ()))
                now[key] = wanted if want[pk][1] else was
        for most in (50, 10**6):
            out = upsert.replayed_states(known, some, "k", "ts", "pk", most).collect()
            assert len(out) == len(kept) and {r["pk"]: (r["came_from"], r["moved"]) for r in out} == want
    assert upsert.replayed_states(known, wishes.limit(0), "k", "ts", "pk").count() == 0


def test_states_of_runs(spark):
    fields = "feed_key string, ts timestamp_ntz, pk bigint, last_run_at timestamp_ntz, last_success_at timestamp_ntz, last_status string, last_error string"
    a, b, now = DAY, DAY + timedelta(days=1), DAY + timedelta(days=9)
    states = spark.createDataFrame([
        ("on", a, 9, a, a, "ok", None), ("back", b, 5, a, a, "failed", "x"), ("fails", a, 1, a, a, "ok", None), ("rests", a, 1, a, a, "ok", None),
        ("first", None, None, None, None, None, None),
    ], fields)
    runs = spark.createDataFrame(
        [("on", a, 10, None), ("back", a, 99, None), ("fails", b, 7, "no route"), ("first", b, 2, None), ("new", None, None, None)],
        "feed_key string, ts timestamp_ntz, pk bigint, error string",
    )
    out = {r["feed_key"]: tuple(r)[1:] for r in upsert.run_states(states, runs, F.lit(now).cast("timestamp_ntz")).collect()}
    assert out == {
        "on": (a, 10, now, now, "ok", None), "back": (b, 5, now, now, "ok", None), "fails": (a, 1, now, a, "failed", "no route"),
        "rests": (a, 1, a, a, "ok", None), "first": (b, 2, now, now, "ok", None), "new": (None, None, now, now, "ok", None),
    }


def test_sources_have_their_columns_and_caps(spark):
    shape = "id bigint, ext_message_id bigint, message_id string, sub_source int, item_id bigint, folder_id int, message_type string, sender_id string, receiver_id string"
    rows = [(2**60 + k, k, f"m{k}", 1, k, 0, "in", "a", "b", datetime(2024, 1, 1, 0, k // 100)) for k in range(1200)]
    headers = spark.createDataFrame(rows, f"{shape}, receive_date timestamp_ntz").withColumn("unread", F.lit(True))
    bodies = spark.createDataFrame([(k, f"b{k}") for k in range(0, 1200, 2)], "message_id bigint, message string")
    out = scans.source_scan("ebay", headers, scans.Everything(), 4000, bodies)
    assert out.columns == [*scans.SOURCE_COLUMNS["ebay"], "body_raw"] and out.count() == 1000  # the cap of headers
    first = out.orderBy("receive_date", "id").first()
    assert (first["id"], first["body_raw"], first["receive_date"]) == (str(2**60), "b0", "2024-01-01 00:00:00")
    temu = spark.range(2).select("id", *(F.lit("x").alias(c) for c in scans.SOURCE_COLUMNS["temu"][1:] if c != "message_date"), F.lit(datetime(2024, 1, 1)).alias("message_date"))
    assert scans.source_scan("temu", temu, scans.Everything(), 10_000).count() == 2
    assert scans.source_scan("temu", temu.limit(0), scans.Everything()).count() == 0


def test_rows_of_another_marketplace_are_in_no_thread(spark):
    rows = [("one", "message", k, f"c{k % 2}") for k in range(6)] + [("two", "message", 6, "c0"), (None, "message", 7, "c0"), ("two", "empty", 8, "c0")]
    shape = "marketplace string, row_class string, source_pk bigint, counterparty_ref string"
    messages = spark.createDataFrame(rows, shape).select(
        "*", F.lit(1).alias("sub_source_id"), F.lit(None).cast("string").alias("listing_item_ref"), F.lit("inbound").alias("direction"),
        F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz").alias("source_ts"), F.lit(None).cast("string").alias("filter_reason"),
        F.lit(None).cast("string").alias("skip_reason"),
    )
    out = feeds.derive(feeds.Feed("one", lambda raw: raw, threads.ThreadingRule("order-v1", "single-v1")), messages)
    assert out.messages.count() == 6 and out.excluded.first()["excluded_unusable"] == 2
    assert sorted((r["counterparty_ref"], r["message_count"]) for r in out.conversations.collect()) == [("c0", 3), ("c1", 3)]


def test_usage_rows_are_best_effort(spark, tmp_path):
    calls = spark.createDataFrame(
        [("p", "big-1", 1, 10, 1_000_000, 0, 1_000_000, "ok"), ("p", "other", 2, None, None, None, None, "failed")],
        "provider string, model string, conversation_id bigint, draft_revision_id bigint, input_tokens bigint, output_tokens bigint, total_tokens bigint, outcome string",
    ).withColumn("created_at", F.lit(datetime(2024, 1, 1)))
    rates = spark.sql("SELECT 'big' AS prefix, CAST(2.5 AS DECIMAL(10,4)) AS input_rate, CAST(4 AS DECIMAL(10,4)) AS output_rate")
    said, path = [], str(tmp_path / "usage")
    assert usage.record_usage(calls, rates, path, said.append) == {"recorded": True} and not said
    assert usage.record_usage(calls.drop("model"), rates, path, said.append) == {"recorded": False} and len(said) == 1
    found = {r["conversation_id"]: r["estimated_cost_usd"] for r in spark.read.parquet(path).collect()}
    assert found[1] == 2.5 and found[2] is None and len(found) == 2
