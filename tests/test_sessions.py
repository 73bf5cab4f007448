import random

from hypothesis import given
from hypothesis import strategies as st
from loomspark.operators.threads import gap_segments
from loomspark.streaming import sessions
from pyspark.sql import functions as F

DAY = 86_400_000


@given(st.lists(st.integers(-5_000_000, 5_000_000), max_size=30), st.randoms())
def test_arrival_order_does_not_matter(times, rng):
    whole = sessions.joined([(t, t, 1) for t in times], 700)
    held = []
    shuffled = times[:]
    rng.shuffle(shuffled)
    for t in shuffled:
        held = sessions.joined([*held, (t, t, 1)], 700)
    assert held == whole and sum(n for *_, n in whole) == len(times)


def test_stream_equals_batch(spark, sf_dir, tmp_path):
    """Files that arrive out of order, late rows that join two sessions among them."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id % 7 = 0").select("user_id", "ts", "event_id")
    schema = events.schema
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    parts = [0, 1, 2, 3]
    random.Random(3).shuffle(parts)
    events.limit(0).write.parquet(source)
    stream = sessions.gap_sessions(spark.readStream.schema(schema).parquet(source), ["user_id"], "ts", DAY)

    def keep(batch, number):
        batch.write.mode("append").parquet(out)

    for part in parts:  # an event's part is by its id's hash, so each brings rows of all times
        events.where(F.pmod(F.hash("event_id"), F.lit(4)) == part).coalesce(1).write.mode("append").parquet(source)
        query = stream.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "check"))
        query.trigger(availableNow=True).start().awaitTermination()
    found = sessions.newest(spark.read.parquet(out), ["user_id"])
    want = gap_segments(events, ["user_id"], "ts", "event_id", "1 day").groupBy("user_id", "segment")
    want = want.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count("*").alias("message_count"))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))
    assert spark.read.parquet(out).agg(F.max("revision")).first()[0] > 1
