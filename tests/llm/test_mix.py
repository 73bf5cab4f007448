import collections
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from loomspark.llm import mix
from pyspark.sql import functions as F


def brute_targets(sizes, weights=(1, 2, 3), most=3):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(most * sizes[s] for s in capped)
        w = sum(weight[s] for s in names if s not in capped)
        out = {s: most * sizes[s] if s in capped else left * weight[s] / w for s in names}
        above = {s for s in names if s not in capped and out[s] > most * sizes[s]}
        if not above:
            return out
        capped |= above


def check(table, **options):
    rows = mix.mix_sources(table, **options).collect()
    assert len(rows) == table.count()
    sizes, taken, largest = collections.Counter(), collections.Counter(), collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        largest[r["source"]] = max(largest[r["source"]], r["size"])
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 3
    want = brute_targets(dict(sizes))
    for r in rows:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) <= 1e-6 * max(1, want[r["source"]])
    return rows, want, taken, largest


def test_targets_and_totals(docs):
    rows, want, taken, largest = check(docs)
    for source, target in want.items():
        assert abs(taken[source] - target) <= 0.01 * target + 5
    again = mix.mix_sources(docs.repartition(7)).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_many_blocks(spark):
    table = spark.range(6000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 5)).alias("source"),
        F.repeat(F.lit("w "), (F.pmod(F.xxhash64("id"), F.lit(40)) + 1).cast("int")).alias("text"),
    )
    _, want, taken, _ = check(table, block=100)
    assert all(abs(taken[s] - want[s]) <= 0.01 * want[s] for s in want)


def test_edges(edge, none):
    check(edge)
    assert mix.mix_sources(none).count() == 0
    mixed = mix.mixed_documents(edge)
    assert mixed.columns == edge.columns
    copies = collections.Counter()
    for r in mix.mix_sources(edge).collect():
        copies[str(r["doc_id"])] += r["copies"]
    got = collections.Counter(str(r["doc_id"]) for r in mixed.collect())
    assert got == +copies


def test_units_without_ids(spark):
    """Rows without an id go by their text, apart from an id that is written like a mark."""
    rows = [(None, f"{'w ' * (k % 9 + 1)}{k % 60}", "s") for k in range(300)] + [("?", "a b c", "s"), ("#1", "a b", "t")]
    table = spark.createDataFrame(rows, "doc_id string, text string, source string")
    got, want, taken, _ = check(table)
    assert all(abs(taken[s] - want[s]) <= 0.02 * want[s] + 3 for s in want)
    copies = collections.Counter()
    for r in mix._planned(table).collect():
        copies[r["unit"]] += r["copies"]
    mixed = mix.mixed_documents(table).select(mix.unit_of(F.col("doc_id"), F.col("text")).alias("unit")).collect()
    assert collections.Counter(r["unit"] for r in mixed) == +copies


def test_landing_is_the_best_of_all():
    rng = random.Random(4)
    for _ in range(50):
        size = [float(rng.randint(0, 90)) for _ in range(9)]
        pi = [rng.choice([0.0, 1.0, 0.3, 0.7]) for _ in range(9)]
        out = mix.landing(list(pi), size)
        assert all(o == p for o, p in zip(out, pi) if p in (0.0, 1.0))
        want = sum(p * s for p, s in zip(pi, size))
        open_ = [k for k in range(9) if 0 < pi[k] < 1]
        fixed = sum(s for s, p in zip(size, pi) if p == 1)
        ways = (fixed + sum(s for k, s in zip(open_, (size[k] for k in open_)) if m >> open_.index(k) & 1) for m in range(1 << len(open_)))
        assert abs(sum(o * s for o, s in zip(out, size)) - want) <= min(abs(w - want) for w in ways) + 1e-5


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(0, 50)), max_size=30), st.integers())
def test_flight_keeps_totals(units, seed):
    pi, size = [u[0] for u in units], [float(u[1]) for u in units]
    out = mix.flight(list(pi), size, random.Random(seed))
    assert sum(0 < p < 1 for p in out) <= 2
    assert abs(sum(out) - sum(pi)) < 1e-5
    assert abs(sum(p * s for p, s in zip(out, size)) - sum(p * s for p, s in zip(pi, size))) < 1e-3


def test_inclusion_probabilities():
    size = [float(k % 7 + 1) for k in range(20)]
    count = [0.0] * 20
    for seed in range(2000):
        for k, p in enumerate(mix.flight([0.3] * 20, size, random.Random(seed))):
            count[k] += p
    assert all(abs(c / 2000 - 0.3) < 0.05 for c in count)


def test_columns_of_maps(spark, docs):
    """Tables with a column of maps, which can't be hashed, are mixed as others are."""
    want = mix.mixed_documents(docs).groupBy("doc_id").count()
    mapped = mix.mixed_documents(docs.withColumn("meta", F.create_map(F.lit("a"), F.array("source")))).groupBy("doc_id").count()
    assert sorted(map(tuple, mapped.collect())) == sorted(map(tuple, want.collect()))
