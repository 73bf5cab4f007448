import pytest
from loomspark.llm import queries, shards
from loomspark.llm._shared import shared_dir
from loomspark.llm.manifests import Conflict
from pyspark.sql import functions as F


def store_of(spark, **options):
    return shards.ShardStore(spark, shared_dir(spark, "shards"), **options)


def same(a, b):
    return sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_compaction_keeps_rows(spark, docs):
    store = store_of(spark, fan_in=3, least_bytes=40_000, target_bytes=150_000)
    parts = docs.repartition(7, "doc_id").randomSplit([1.0] * 7, seed=1)
    fresh = set()  # an arrival's run keeps the files it came in
    for part in parts:
        store.append(part)
        fresh.add(store.runs()[-1].name)
        store.compact()
    assert same(store.read(), docs)
    tiers = [store.tier(r) for r in store.runs()]
    assert all(tiers.count(t) < 3 for t in tiers) and len(tiers) < 7
    assert all(r.files <= max(1, round(r.bytes / 150_000)) + 1 for r in store.runs() if r.name not in fresh)
    assert not {r.name for r in store.runs()} <= fresh
    assert sum(r.rows for r in store.runs()) == docs.count()


def test_versions_and_vacuum(spark, docs):
    store = store_of(spark, fan_in=2)
    store.append(docs.where("doc_id < 50"))
    store.append(docs.where("doc_id >= 50"))
    assert store.read(1).count() == docs.where("doc_id < 50").count()
    store.compact()
    assert store.version() == 3 and len(store.runs()) == 1 and same(store.read(2), docs)
    assert store.vacuum() == 2 and same(store.read(), docs)
    assert store.manifests.versions() == [3]  # what can't be read any more isn't offered


def test_arrivals_of_one_file(spark, docs):
    """A table in one file arrives in several runs, in one pass, and is compacted."""
    store = store_of(spark)
    store.append_arrivals(docs, shards.row_batches(docs, 8))
    assert store.version() >= 8 + 2 and len(store.runs(4)) == 4 and len(store.runs(5)) == 1
    assert len(store.runs()) < 4 and same(store.read(), docs)
    assert store.vacuum() >= 8 and same(store.read(), docs)
    odd = docs.select("doc_id", docs["source"].alias("_part"), docs["lang"].alias("_part_"))  # names of its own
    other = store_of(spark)
    other.append_arrivals(odd, shards.row_batches(odd, 3))
    assert same(other.read(), odd)
    rows = queries.op2_sharding(spark, "/root/testdata/sf0.001")
    assert rows.count() == docs.count()


def test_two_compactions_at_once(spark, docs):
    """Another writer merges the same runs first: its run counts, and rows stay once."""
    store = store_of(spark, fan_in=2)
    store.append(docs.where("doc_id < 50"))
    store.append(docs.where("doc_id >= 50"))
    other = shards.ShardStore(spark, store.path, fan_in=2)
    write = store._write_run
    store._write_run = lambda df: (other.compact(), write(df))[1]
    store.compact()
    assert store.version() == 3 and len(store.runs()) == 1 and same(store.read(), docs)
    assert store.vacuum() == 3


def test_one_writer_wins(spark, docs):
    store = store_of(spark)
    store.append(docs.limit(3))
    with pytest.raises(Conflict):
        store._commit(0, docs.schema.json(), [])
    assert store.version() == 1 and store.read().count() == 3
    other = shards.ShardStore(spark, store.path)
    other.append(docs.limit(2))
    assert store.read().count() == 5


def test_edges(spark, edge, none):
    store = store_of(spark)
    with pytest.raises(ValueError):
        store.read()
    store.append(none)
    assert store.read().count() == 0 and store.read().columns == edge.columns
    store.append(edge)
    store.append(none)
    store.compact()
    assert same(store.read(), edge)
    with pytest.raises(ValueError):
        store.append(edge.select("doc_id"))


def test_columns_of_maps(spark, docs):
    store = store_of(spark)
    mapped = docs.withColumn("meta", F.create_map(F.lit("a"), F.array("source")))
    store.append_arrivals(mapped, shards.row_batches(mapped, 8))
    assert same(store.read().drop("meta"), docs) and store.read().where("meta['a'][0] <=> source").count() == docs.count()
