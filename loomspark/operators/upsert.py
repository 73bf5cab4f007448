"""Keyed snapshots: idempotent merges, cursors, revisions and guarded state changes.

A merge makes the next snapshot from the last one and a batch by one join on the key; the
caller writes it.  Running a batch twice changes nothing the second time.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from loomspark.sources.scans import micros

#: Allowed changes of the workflow state.
TRANSITIONS = {
    "received": ("drafting",),
    "drafting": ("pending_review",),
    "pending_review": ("drafting", "reviewed"),
    "reviewed": (),
}


def first_by(rows: DataFrame, keys: Sequence[str], *order: Column | str) -> DataFrame:
    """The first row of each key in an order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_place", place).where(F.col("_place") == 1).drop("_place")


def merged(target: DataFrame, batch: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """The next snapshot, with ``merge_action``: ``kept``, ``updated`` or ``inserted``.

    Rows of ``batch`` (one for each key) update the columns ``update`` of the row with their
    key, whose other columns stay, or come in as new rows.
    """
    new = batch.select(*keys, *(F.col(c).alias(f"_new_{c}") for c in target.columns if c not in keys), F.lit(True).alias("_in"))
    both = target.withColumn("_there", F.lit(True)).join(new, list(keys), "full")
    there, came = F.col("_there").isNotNull(), F.col("_in").isNotNull()

    def value(c: str) -> Column:
        if c in keys:
            return F.col(c)
        old, fresh = F.col(c), F.col(f"_new_{c}")
        return F.when(came if c in update else ~there, fresh).otherwise(old).alias(c)

    action = F.when(~there, "inserted").when(came, "updated").otherwise("kept")
    return both.select(*(value(c) for c in target.columns), action.alias("merge_action"))


def highest_cursor(messages: DataFrame, ts: str = "source_ts", pk: str = "source_pk") -> DataFrame:
    """One row ``ts, pk``: the largest pair, times first, ids as numbers; nulls if there is none."""
    return messages.agg(F.max(F.struct(F.col(ts).alias("ts"), F.col(pk).cast("bigint").alias("pk"))).alias("c")).select("c.ts", "c.pk")


def advanced_cursors(cursors: DataFrame, batch: DataFrame, feed: str = "feed_key") -> DataFrame:
    """Cursors that only move forward: of the stored one and the batch's the larger, by feed."""
    pairs = cursors.select(feed, "ts", "pk").unionByName(batch.select(feed, "ts", "pk"))
    pairs = pairs.groupBy(feed).agg(F.max(F.when(F.col("ts").isNotNull(), F.struct("ts", "pk"))).alias("c"))
    return pairs.select(feed, "c.ts", "c.pk")


def run_states(states: DataFrame, runs: DataFrame, now: Column, feed: str = "feed_key") -> DataFrame:
    """``feed, ts, pk, last_run_at, last_success_at, last_status, last_error`` after some runs.

    ``runs`` has ``feed, ts, pk, error``, one row a feed.  One without an error is ``ok``: its cursor moves
    forward, if it does, and an older error goes.  One with an error is ``failed`` and leaves the
    cursor and the time of the last success.  Feeds that didn't run stay as they are.
    """
    new = runs.select(feed, F.struct("ts", F.col("pk").cast("bigint").alias("pk")).alias("_cursor"), F.col("error").alias("_error"), F.lit(True).alias("_ran"))
    both = states.join(new, feed, "full")
    ran, failed = F.col("_ran").isNotNull(), F.col("_error").isNotNull()
    old = F.when(F.col("ts").isNotNull(), F.struct("ts", F.col("pk").cast("bigint").alias("pk")))
    came = F.when(ran & ~failed & F.col("_cursor.ts").isNotNull(), F.col("_cursor"))
    best = F.greatest(old, came)  # of which null is none
    return both.select(
        feed, best["ts"].alias("ts"), best["pk"].alias("pk"),
        F.when(ran, now).otherwise(F.col("last_run_at")).alias("last_run_at"),
        F.when(ran & ~failed, now).otherwise(F.col("last_success_at")).alias("last_success_at"),
        F.when(ran, F.when(failed, "failed").otherwise("ok")).otherwise(F.col("last_status")).alias("last_status"),
        F.when(ran, F.col("_error")).otherwise(F.col("last_error")).alias("last_error"),
    )


def recounted(threads: DataFrame, messages: DataFrame, key: str = "thread_key") -> DataFrame:
    """Threads with counts taken anew from the messages that are stored."""
    counts = messages.groupBy(key).agg(
        F.count("*").alias("_n"), F.count_if(F.col("direction") == "inbound").alias("_in")
    )
    return threads.join(counts, key, "left").select(
        *(c for c in threads.columns if c not in ("message_count", "inbound_count")),
        F.coalesce("_n", F.lit(0)).alias("message_count"), F.coalesce("_in", F.lit(0)).alias("inbound_count"),
    )


def next_revisions(revisions: DataFrame, drafts: DataFrame, key: str, *order: str) -> DataFrame:
    """``drafts`` numbered on from the last revision of their key."""
    last = revisions.groupBy(key).agg(F.max("revision").alias("_last"))
    place = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return drafts.join(last, key, "left").withColumn("revision", F.coalesce("_last", F.lit(0)) + place).drop("_last")


def touched(drafts: DataFrame, asked: DataFrame, key: str, now: Column) -> DataFrame:
    """Drafts with one for each ``key`` of ``asked``: made if there is none, else its time renewed."""
    new = asked.select(key).distinct().withColumn("_asked", F.lit(True))
    both = drafts.withColumn("_there", F.lit(True)).join(new, key, "full")
    made = F.when(F.col("_there").isNull(), now).otherwise(F.col("created_at"))
    renewed = F.when(F.col("_asked").isNotNull(), now).otherwise(F.col("updated_at"))
    return both.select(*(
        {"created_at": made.alias("created_at"), "updated_at": renewed.alias("updated_at")}.get(c, F.col(c)) for c in drafts.columns
    ))


def pointed(drafts: DataFrame, revisions: DataFrame, key: str, now: Column) -> DataFrame:
    """Drafts whose ``current_revision`` is their newest one; those that it changes are renewed."""
    last = revisions.groupBy(key).agg(F.max("revision").alias("_last"))
    both = drafts.join(last, key, "left")
    moved = F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("current_revision"))
    return both.select(*(
        {
            "current_revision": F.coalesce("_last", "current_revision").alias("current_revision"),
            "updated_at": F.when(moved, now).otherwise(F.col("updated_at")).alias("updated_at"),
        }.get(c, F.col(c)) for c in drafts.columns
    ))


def recorded(write: Callable[[], None], log: Callable[[str], None] = print) -> dict[str, bool]:
    """Best effort: whether ``write`` (a call's usage row) came through.  What went wrong is logged,
    since a draft must not fail for its accounting."""
    try:
        write()
    except Exception as e:
        log(f"could not record usage: {e}")
        return {"recorded": False}
    return {"recorded": True}


def inserted_once(target: DataFrame, batch: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of ``batch`` whose key the target lacks, one for each key (the least by all columns)."""
    order = [c for c in batch.columns if c not in keys] or list(keys)
    return first_by(batch, keys, *order).join(target.select(*keys), list(keys), "left_anti").select(*batch.columns)


def replaced_children(children: DataFrame, fresh: DataFrame, parent: str) -> DataFrame:
    """All children of the parents that ``fresh`` names are replaced by it."""
    return children.join(fresh.select(parent).distinct(), parent, "left_anti").select(*children.columns).unionByName(fresh)


def changed_only(target: DataFrame, batch: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Keys of the target whose ``column`` differs from the batch's, with the new value."""
    new = batch.select(*keys, F.col(column).alias("_new"))
    both = target.select(*keys, column).join(new, list(keys))
    return both.where(~F.col(column).eqNullSafe(F.col("_new"))).select(*keys, F.col("_new").alias(column))


def import_status(known: DataFrame, came: DataFrame, keys: Sequence[str], checksum: str = "content_checksum") -> DataFrame:
    """``came`` with ``import_action``: ``new``, ``changed`` or ``unchanged`` by the row's checksum."""
    old = known.select(*keys, F.col(checksum).alias("_old"), F.lit(True).alias("_there"))
    action = F.when(F.col("_there").isNull(), "new").when(F.col("_old").eqNullSafe(F.col(checksum)), "unchanged")
    return came.join(old, list(keys), "left").withColumn("import_action", action.otherwise("changed")).drop("_old", "_there")


def moved_states(states: DataFrame, wishes: DataFrame, key: str) -> DataFrame:
    """``key, state, moved``: a wish (``expected``, ``wanted``; one a key) is granted if the state
    is the expected one and may change so."""
    table = F.create_map(*(x for k, v in TRANSITIONS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    ok = (F.col("state") == F.col("expected")) & F.array_contains(F.try_element_at(table, F.col("state")), F.col("wanted"))
    both = states.join(wishes.select(key, "expected", "wanted"), key, "left")
    moved = F.coalesce(ok, F.lit(False))
    return both.select(key, F.when(moved, F.col("wanted")).otherwise(F.col("state")).alias("state"), moved.alias("moved"))


#: States by number, and for each wanted state what the others become; the last number is any other state.
_STATES = tuple(TRANSITIONS)
_MOVES = {w: [_STATES.index(w) if w in TRANSITIONS[s] else k for k, s in enumerate(_STATES)] + [len(_STATES)] for w in _STATES}
_IDENTITY = list(range(len(_STATES) + 1))


def _scanned(rows: DataFrame, group: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """Rows with ``_before``: what their group's ``_start`` has become by the moves ``_f`` before theirs; or
    with ``last`` one row a group and what it has become after all.

    Groups are read in order, a batch at a time, so none has to fit in memory.
    """
    name = F.to_json(F.struct(*group))
    ready = rows.repartition(*group).sortWithinPartitions(*group, *order).withColumn("_group", name)
    ready = ready.select(*group, "_start", "_f", "_group") if last else ready

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, now, row = None, None, None
        for batch in batches:
            before, done = [], []
            for k, (g, start, f) in enumerate(zip(*(batch[c].to_pylist() for c in ("_group", "_start", "_f")))):
                if g != at:
                    if last and at is not None:
                        done.append((row, now))
                    at, now, row = g, start, batch.slice(k, 1).select(list(group))
                before.append(now)
                now = [f[s] for s in now]
            if not last:
                out = batch.drop_columns(["_group"])
                yield out.append_column("_before", pa.array(before, pa.list_(pa.int32())))
            for one, after in done:
                yield one.append_column("_f", pa.array([after], pa.list_(pa.int32())))
        if last and at is not None:
            yield row.append_column("_f", pa.array([now], pa.list_(pa.int32())))

    shape = rows.select(*group).schema if last else rows.schema
    return ready.mapInArrow(scan, shape.add("_f" if last else "_before", ArrayType(IntegerType())))


def replayed_states(states: DataFrame, wishes: DataFrame, key: str, ts: str, pk: str, most: int = 1_000_000) -> DataFrame:
    """``wishes`` (``key, ts, pk, wanted``) with ``came_from`` and ``moved``: each key's wishes are granted one
    after another, if the state that it has by then may change so.

    A wish of a key without a state isn't granted and comes from null.  Keys with over ``most`` wishes
    are cut into pieces of about as many by quantiles of time: a piece is composed to what it makes
    of each state, a scan over one row a piece gives the state that each begins with, and pieces are
    replayed on their own.  Wishes of one key and instant are one piece.
    """
    f = F.coalesce(
        F.try_element_at(F.create_map(*(x for w, m in _MOVES.items() for x in (F.lit(w), F.array(*map(F.lit, m))))), F.col("wanted")),
        F.array(*map(F.lit, _IDENTITY)),
    )
    number = F.coalesce(F.array_position(F.array(*map(F.lit, _STATES)), F.col("state")) - 1, F.lit(-1)).cast("int")
    number = F.when(number < 0, len(_STATES)).otherwise(number)
    identity = F.array(*map(F.lit, _IDENTITY))
    rows = wishes.select(key, ts, pk, "wanted").withColumn("_f", f)
    begin = states.select(key, "state", F.array(number).alias("_start"))
    hot = rows.groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > most)
    largest = hot.agg(F.max("_n")).first()[0]
    first = rows.withColumn("_piece", F.lit(0)).join(begin, key, "left")
    if largest is not None:
        cuts = -(-largest // most)
        at = F.array(*(F.lit(k / cuts) for k in range(1, cuts)))
        # hot keys are wishes / most at most
        bounds = rows.withColumn("_us", micros(rows, ts)).join(F.broadcast(hot.select(key)), key).groupBy(key)
        bounds = bounds.agg(F.percentile_approx("_us", at, 10 * max(1000, cuts)).alias("_bounds"))
        piece = F.coalesce(F.size(F.filter("_bounds", lambda b: b < F.col("_us"))), F.lit(0))
        cut = rows.withColumn("_us", micros(rows, ts)).join(F.broadcast(bounds), key, "left")
        cut = cut.withColumn("_piece", F.when(F.col("_bounds").isNull(), 0).otherwise(piece)).withColumn("_hot", F.col("_bounds").isNotNull()).drop("_us", "_bounds")
        pieces = _scanned(cut.where("_hot").withColumn("_start", identity), [key, "_piece"], [ts, pk], last=True)
        starts = _scanned(pieces.join(begin.drop("state"), key, "left").withColumn("_start", _known("_start")), [key], ["_piece"], last=False)
        starts = starts.select(key, "_piece", F.col("_before").alias("_begin"))
        first = cut.drop("_hot").join(starts.hint("merge"), [key, "_piece"], "left").join(begin, key, "left")
        first = first.withColumn("_start", F.coalesce("_begin", "_start")).drop("_begin")
    first = first.withColumn("_start", _known("_start"))
    found = _scanned(first, [key, "_piece"], [ts, pk], last=False).withColumn("_s", F.col("_before")[0])
    moved = F.coalesce(F.get("_f", F.col("_s")) != F.col("_s"), F.lit(False))
    came_from = F.coalesce(F.get(F.array(*map(F.lit, _STATES)), F.col("_s")), F.col("state"))
    return found.select(key, ts, pk, "wanted", came_from.alias("came_from"), moved.alias("moved"))


def _known(start: str) -> Column:
    return F.coalesce(F.col(start), F.array(F.lit(len(_STATES))))
