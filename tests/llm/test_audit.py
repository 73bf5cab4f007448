import collections
import re
from itertools import permutations

import duckdb
import pytest
from loomspark.llm import audit, queries
from pyspark.sql import functions as F


def brute(rows, labels):
    """``rows``: (doc_id, text, source); ``labels``: (doc_id, quality, toxic)."""
    first = {}
    for doc_id, text, _ in rows:
        text = text or ""
        if doc_id is not None and (text not in first or doc_id < first[text]):
            first[text] = doc_id
    good = {d for d, q, _ in labels if q == 1 and d is not None}
    toxic = {d for d, _, t in labels if t == 1 and d is not None}
    docs = collections.defaultdict(list)
    for doc_id, text, source in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text),
            "D": bool(re.search("[#$%&*|]", text)),
            "E": text in first and (doc_id is None or first[text] < doc_id),
        }
        docs[source or ""].append(({f for f, x in fails.items() if x}, doc_id in good, doc_id in toxic))
    out = []
    for part, members in docs.items():
        shapley = collections.Counter()
        found = []
        for order in permutations("ABCDE"):
            left = list(members)
            for step, own in enumerate(order, 1):
                gone = [m for m in left if own in m[0]]
                left = [m for m in left if own not in m[0]]
                all_failing = [m for m in members if own in m[0]]
                shapley[own] += len(gone)
                found.append(
                    (part, "".join(order), step, len(left), len(gone), len(all_failing) - len(gone),
                     sum(m[0] == {own} for m in members), sum(m[1] for m in gone), sum(m[2] for m in gone))
                )
        out += [(*r, shapley[r[1][r[2] - 1]]) for r in found]
    return sorted(out)


def got(found):
    return sorted(tuple(r) for r in found.collect())


def test_query_equals_brute_force_and_sql(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    found = got(queries.op12_filter_audit(spark, sf_dir))
    assert found == brute(rows, labels)
    for name in ("documents", "labels"):
        duckdb.sql(f"CREATE OR REPLACE VIEW {name} AS FROM '{sf_dir}/{name}.parquet'")
    assert sorted(duckdb.sql(queries.ORACLE_SQL["op12_filter_audit"]).fetchall()) == found


LABELS = [(1, 1, 0), (1, 0, 1), (2, None, None), (9, 1, 1), (None, 1, 1), (77, 1, 0)]


def test_edge_cases(spark, edge, none):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in edge.collect()]
    assert got(audit.filter_audit(edge, labels)) == brute(rows, LABELS)
    assert audit.filter_audit(none, labels).count() == 0
    assert got(audit.filter_audit(edge, labels.limit(0))) == brute(rows, [])


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_copies_across_boundaries(spark, partitions):
    """One text is most of the table, its ids repeat and are null, so it spans whole partitions."""
    texts = ["hot"] * 300 + ["warm"] * 40 + [None, "", "cold"] * 3
    rows = [(None if k % 50 == 49 else k % 120 // 3, t, f"s{k % 3}") for k, t in enumerate(texts)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        masks = audit.failure_masks(table)
        assert masks.count() == len(rows)
        labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int, toxic int")
        assert got(audit.filter_audit(table, labels)) == brute(rows, LABELS)
        if partitions == 40:  # the case is met: a partition that is one text throughout
            assert masks.where(F.col("mask") >= 16).count() > 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", was[1])
