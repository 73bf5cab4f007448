import os

import pytest
from loomspark.streaming import store
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ROWS = StructType().add("k", "long").add("born", "long").add("v", "string")
SPEC = {"a": store.TableSpec(ROWS, ("k",), ("v",)), "b": store.TableSpec(ROWS, ("k",), ("born", "v"), greatest=True)}


@pytest.fixture
def tables(spark, tmp_path):
    return store.Store(spark, str(tmp_path / "s"), SPEC, buckets=4)


def rows(spark, *values):
    return spark.createDataFrame(list(values), ROWS)


def content(df):
    return sorted(map(tuple, df.collect()))


def size(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


def test_rows_of_a_key_fold(spark, tables):
    tables.merge({"a": rows(spark, (1, 10, "x"), (2, 10, "x"), (1, 11, "w"))}, "s", 0, {"a": [F.desc("born")]})
    assert content(tables.read("a")) == [(1, 11, "w"), (2, 10, "x")]
    tables.merge({"a": rows(spark, (1, 12, "y"), (3, 12, None)), "b": rows(spark, (1, 5, "p"), (1, 7, "o"), (2, None, "q"))}, "s", 1)
    tables.merge({"b": rows(spark, (1, 6, "z"), (2, 1, "r"))}, "s", 2)
    # what came first stays but for the columns that are brought up to date; the greatest moves forward only
    assert content(tables.read("a")) == [(1, 11, "y"), (2, 10, "x"), (3, 12, None)]
    assert content(tables.read("b")) == [(1, 7, "o"), (2, 1, "r")]
    assert content(tables.read("a", 1)) == [(1, 11, "w"), (2, 10, "x")] and tables.read("a", 0).count() == 0


def test_a_batch_counts_once(spark, tables):
    assert tables.merge({"a": rows(spark, (1, 1, "x"))}, "s", 4) == 1
    assert tables.merge({"a": rows(spark, (1, 1, "lost"))}, "s", 4) == 1 == tables.version()
    assert tables.merge({"a": rows(spark, (1, 1, "y"))}, "t", 4) == 2
    assert content(tables.read("a")) == [(1, 1, "y")]


def test_a_crash_between_tables_leaves_none(spark, tables):
    tables.merge({"a": rows(spark, (1, 1, "x")), "b": rows(spark, (1, 1, "x"))}, "s", 0)
    write = tables._write

    def failing(name, df):
        if name == "b":
            raise RuntimeError("lost")
        return write(name, df)

    tables._write = failing
    page = {"a": rows(spark, (1, 1, "y"), (2, 2, "y")), "b": rows(spark, (1, 2, "y"))}
    with pytest.raises(RuntimeError):
        tables.merge(page, "s", 1)
    assert content(tables.read("a")) == content(tables.read("b")) == [(1, 1, "x")] and tables.version() == 1
    tables._write = write
    assert tables.merge(page, "s", 1) == 2 and content(tables.read("b")) == [(1, 2, "y")]
    tables.vacuum()
    named = {s for x in tables.manifest()["tables"]["a"].values() for s in x}
    assert {d.partition("=")[2] for d in os.listdir(f"{tables.path}/a")} == named
    assert content(tables.read("a")) == [(1, 1, "y"), (2, 2, "y")]


def test_two_writers_leave_one_version_of_both(spark, tables):
    other = store.Store(spark, tables.path, SPEC)
    assert other.buckets == 4 or other.version() == 0
    commit, taken = tables._commit, []

    def late(manifest):
        if not taken:  # the other writer is quicker by a whole page
            taken.append(other.merge({"a": rows(spark, (2, 2, "o")), "b": rows(spark, (1, 9, "o"))}, "t", 0))
        commit(manifest)

    tables.buckets = other.buckets = 4
    tables._commit = late
    assert tables.merge({"a": rows(spark, (1, 1, "m"), (2, 1, "m")), "b": rows(spark, (1, 3, "m"))}, "s", 0) == 2 and taken == [1]
    assert content(other.read("a")) == [(1, 1, "m"), (2, 2, "m")] and content(other.read("b")) == [(1, 9, "o")]
    assert content(other.read("a", 1)) == [(2, 2, "o")]
    assert store.Store(spark, tables.path, SPEC, buckets=99).buckets == 4


def test_bytes_follow_the_batch(spark, tmp_path):
    tables = store.Store(spark, str(tmp_path / "s"), SPEC, buckets=8)
    many = spark.range(40_000).select(F.col("id").alias("k"), F.lit(1).cast("long").alias("born"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    tables.merge({"a": many}, "s", 0)
    whole = size(tables.path)
    tables.merge({"a": rows(spark, (5, 2, "new"))}, "s", 1)
    assert size(tables.path) - whole < whole / 100
    # one bucket is grouped, the others are read as they are; only that one is written anew
    before = tables.manifest()["tables"]["a"]
    tables.compact("a", 2)
    after = tables.manifest()["tables"]["a"]
    assert sum(before[b] != after[b] for b in before) == 1 and all(len(x) == 1 for x in after.values())
    assert size(tables.path) - whole < whole / 4
    assert tables.read("a").where("v = 'new'").count() == 1 and tables.read("a").count() == 40_000


def test_compaction_meets_another_writer(spark, tables):
    for n in range(3):
        tables.merge({"a": rows(spark, (1, n, f"v{n}"), (2, n, "x"))}, "s", n)
    other = store.Store(spark, tables.path, SPEC)
    write = tables._write
    tables._write = lambda name, df: (write(name, df), other.merge({"a": rows(spark, (1, 9, "late"))}, "t", 0))[0]
    tables.compact("a", 2)
    assert content(tables.read("a")) == [(1, 0, "late"), (2, 0, "x")]
    tables._write = write
    tables.compact("a", 2)
    assert content(tables.read("a")) == [(1, 0, "late"), (2, 0, "x")]
    assert all(len(x) == 1 for x in tables.manifest()["tables"]["a"].values())


def test_rows_are_counted_while_they_are_written(spark, tables):
    made = spark.sparkContext.accumulator(0)
    seen = F.udf(lambda k: (made.add(1), k)[1], "long").asNondeterministic()
    batch = spark.range(50).select(seen("id").alias("k"), F.lit(0).cast("long").alias("born"), F.lit("x").alias("v"))
    assert store.counted(batch, lambda df: tables.merge({"a": df}, "s", 0)) == 50
    assert made.value == 50 and tables.read("a").count() == 50
