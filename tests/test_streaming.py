from loomspark.streaming import sync
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructType, TimestampNTZType

SCHEMA = StructType().add("event_id", LongType()).add("user_id", LongType()).add("event_type", StringType()).add("ts", TimestampNTZType())


def test_incremental_runs_equal_one_merge(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select(*SCHEMA.names)
    source, path, checkpoint = (str(tmp_path / x) for x in ("in", "out", "check"))
    store = sync.Snapshots(spark, path, SCHEMA, ["event_id"], ["event_type"])
    assert store.read().count() == 0

    def run(**options):
        return sync.run_available(spark, source, SCHEMA, lambda df: df.where("event_type <> 'error'"), store, checkpoint, ["ts"], **options)

    events.where("event_id % 10 < 6").write.parquet(source)
    ready = events.where("event_id % 10 < 6 and event_type <> 'error'").count()
    for _ in range(2):  # a dry run tells what would come, and leaves all as it is
        assert run(dry_run=True) == sync.RunOutcome(1, ready, False)
    assert store.version() == -1
    assert run() == sync.RunOutcome(1, ready, False)
    assert run(dry_run=True).rows == 0
    again = events.where("event_id % 10 >= 4").withColumn("event_type", F.concat("event_type", F.lit("!")))
    again.write.mode("append").parquet(source)
    assert run(dry_run=True).rows == again.count() and store.version() == 0
    run()
    run()
    out = {r["event_id"]: r["event_type"] for r in store.read().collect()}
    want = {r["event_id"]: r["event_type"] for r in events.where("event_id % 10 < 6 and event_type <> 'error'").collect()}
    want |= {r["event_id"]: r["event_type"] for r in again.where("event_type <> 'error'").collect()}
    assert out == want
    last = store.version()
    store.merge(again.where("event_type <> 'error'"), "again", ["ts"])  # a batch that runs again
    assert store.merge(again.limit(1), "again", ["ts"]) == last + 1 == store.version()
    assert {r["event_id"]: r["event_type"] for r in store.read().collect()} == want


def test_other_checkpoints_go_on(spark, tmp_path):
    """A run under a new checkpoint adds to what others have stored; no version is written over."""
    rows = lambda *ids: spark.createDataFrame([(k, k, "a", None) for k in ids], SCHEMA)
    source, path = str(tmp_path / "in"), str(tmp_path / "out")
    store = sync.Snapshots(spark, path, SCHEMA, ["event_id"], ["event_type"])

    def run(checkpoint, **options):
        return sync.run_available(spark, source, SCHEMA, lambda df: df, store, str(tmp_path / checkpoint), ["ts"], **options)

    for k in range(4):
        rows(k).coalesce(1).write.mode("append").parquet(source)
    assert run("one", files_per_batch=1, max_batches=3) == sync.RunOutcome(3, 3, True)
    assert store.version() == 2 and store.read().count() == 3
    assert run("one", files_per_batch=1, max_batches=3) == sync.RunOutcome(1, 1, False)
    rows(99).write.mode("append").parquet(source)
    run("two")
    assert store.version() == 4 and sorted(r["event_id"] for r in store.read().collect()) == [0, 1, 2, 3, 99]
    assert store.read(2).count() == 3


def test_a_half_written_version_does_not_count(spark, tmp_path):
    store = sync.Snapshots(spark, str(tmp_path / "out"), SCHEMA, ["event_id"], ["event_type"])
    batch = spark.createDataFrame([(1, 1, "a", None)], SCHEMA)
    batch.limit(0).write.parquet(str(tmp_path / "out" / "v=0"))
    assert store.version() == -1
    store.merge(batch, "x", ["ts"])
    assert store.version() == 0 and store.read().count() == 1


def test_session_windows(spark, sf_dir, tmp_path):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    source = str(tmp_path / "in")
    events.withColumn("ts", F.col("ts").cast("timestamp")).select("user_id", "ts").write.parquet(source)
    stream = spark.readStream.schema("user_id bigint, ts timestamp").parquet(source)
    found = sync.gap_windows(stream, "ts", ["user_id"], "1 day", "1 hour")
    query = found.writeStream.format("memory").queryName("sessions").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    from loomspark.operators.threads import gap_segments

    want = gap_segments(events, ["user_id"], "ts", "event_id", "1 day").groupBy("user_id", "segment").count()
    assert spark.table("sessions").count() == want.count()
    assert spark.table("sessions").agg(F.sum("message_count")).first()[0] == events.count()
