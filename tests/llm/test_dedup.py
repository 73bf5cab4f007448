import collections
import hashlib
import os
import re
import subprocess
import sys

import numpy as np
import pytest
from loomspark.llm import digests, jaccard
from loomspark.llm._shared import min_label_components, shared_dir, spread_join
from pyspark.sql import functions as F


def brute_exact(rows):
    groups = collections.defaultdict(list)
    for doc_id, text in rows:
        key = re.sub(r"[\x20\x09-\x0D]", "", text or "")
        groups[key].append((-len(text or ""), doc_id is None, doc_id))
    out = []
    for key, members in groups.items():
        keep = min(members, key=lambda m: (m[0], m[1], m[2] or 0))[2]
        sha = hashlib.sha256(key.encode()).hexdigest()
        out += [(m[2], keep, len(members), m[2] == keep, sha) for m in members]
    return out


def test_exact(edge, none, docs):
    for table in (edge, docs):
        got = [tuple(r) for r in digests.exact_duplicates(table).collect()]
        want = brute_exact([(r["doc_id"], r["text"]) for r in table.collect()])
        assert sorted(got, key=str) == sorted(want, key=str)
    assert digests.exact_duplicates(none).count() == 0
    kept = digests.one_of_each_text(edge)
    assert kept.columns == edge.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(["3", "6", "7", "8", "9", "10", "None", "11", "12"])


def test_rows_that_share_an_id(spark):
    """An id with several texts keeps each text that stays; no text is lost, and each stays once."""
    rows = [(5, "unique text of five"), (5, "a copy"), (3, "a copy"), (None, "a copy"), (None, "lone"), (None, "lone"), (7, "a  copy")]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = [tuple(r) for r in digests.one_of_each_text(table).collect()]
    assert sorted(kept, key=str) == sorted([(5, "unique text of five"), (None, "lone"), (7, "a  copy")], key=str)
    words = "one two three four five six seven eight nine ten eleven twelve"
    near = [(5, "quite another text of its own here"), (5, words), (3, words + " more"), (None, words), (9, words + " more")]
    kept = [tuple(r) for r in jaccard.one_of_each_class(spark.createDataFrame(near, "doc_id bigint, text string")).collect()]
    assert sorted(kept, key=str) == sorted([near[0], near[2]], key=str)


def test_appends_agree_with_one(spark, docs):
    """However rows are dealt to appends: the longest text, then the smallest id, and all rows counted."""
    want = sorted(brute_exact([(r["doc_id"], r["text"]) for r in docs.collect()]), key=str)
    for batches in (1, 5):
        assert sorted(map(tuple, digests.exact_duplicates(docs, batches).collect()), key=str) == want
    index = digests.DigestIndex(spark, shared_dir(spark, "index"), 4)
    for row in ((1, 5, "x"), (2, 9, "x"), (3, 9, "x"), (4, 1, "y")):
        index.append(spark.createDataFrame([row], "doc_id bigint, chars bigint, digest string"))
    for _ in range(2):
        assert sorted(map(tuple, index.rows().collect())) == [("x", 2, 3), ("y", 4, 1)]
        index.compact()
    assert sorted(map(tuple, index.rows(2).collect())) == [("x", 2, 2)]
    assert "Exchange" not in index.rows()._jdf.queryExecution().executedPlan().toString()


def test_two_writers_of_an_index(spark):
    path = shared_dir(spark, "index")
    one, two = (digests.DigestIndex(spark, path, 4) for _ in range(2))
    batch = spark.createDataFrame([(1, 5, "x"), (2, 9, "y")], "doc_id bigint, chars bigint, digest string")
    write = one._write
    one._write = lambda rows: (setattr(one, "_write", write), two.append(batch), write(rows))[2]
    one.append(batch)
    assert sorted(map(tuple, one.rows().collect())) == [("x", 1, 2), ("y", 2, 2)]
    assert one.entries().where("first").count() == 2


def test_indexes_of_one_name(spark):
    batch = spark.createDataFrame([(1, 5, "x")], "doc_id bigint, chars bigint, digest string")
    one, two = (digests.DigestIndex(spark, f"{shared_dir(spark, d)}/index", 4) for d in "ab")
    one.append(batch)
    assert one.rows().count() == 1 and two.rows().count() == 0


def test_index_persists_and_grows(spark):
    path = shared_dir(spark, "index")
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("chars"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    digests.DigestIndex(spark, path, 4).append(rows.where("doc_id < 60"))
    again = digests.DigestIndex(spark, path, 4)
    assert again.unseen(rows).count() == 40
    again.append(rows)
    assert again.rows().count() == 100 and again.unseen(rows).count() == 0 and again.entries().where('first').count() == 100
    plan = again.unseen(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" in plan  # the index isn't shuffled


_OTHER_SESSION = """
import sys
from pyspark.sql import SparkSession, functions as F
from loomspark.llm.digests import DigestIndex
path, base = sys.argv[1:]
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.warehouse.dir", base).config(
    "spark.sql.shuffle.partitions", "3").getOrCreate()
index = DigestIndex(spark, path)
rows = spark.range(200).select(F.col("id").alias("doc_id"), F.lit(1).alias("chars"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
unseen = index.unseen(rows).count()
index.append(rows)
print("FOUND", index.buckets, unseen, index.rows().count(), index.rows().agg(F.sum("group_size")).first()[0])
"""


def test_index_outlives_its_session(spark, tmp_path):
    """Another process, with another number of shuffle partitions, reads the index and adds to it; this
    one sees what it has added."""
    path = shared_dir(spark, "index")
    rows = spark.range(120).select(F.col("id").alias("doc_id"), F.lit(1).alias("chars"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    index = digests.DigestIndex(spark, path, 5)
    index.append(rows)
    env = os.environ | {"PYTHONPATH": os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))}
    done = subprocess.run([sys.executable, "-c", _OTHER_SESSION, path, str(tmp_path)], env=env, capture_output=True, text=True, timeout=300)
    assert "FOUND 5 80 200 320" in done.stdout, done.stderr[-2000:]
    assert index.rows().count() == 200 and index.unseen(rows).count() == 0
    index.close()  # the catalog forgets it, the files stay
    assert digests.DigestIndex(spark, path).rows().count() == 200
    for wrong in ({"buckets": 4}, {"id_type": "string"}):
        with pytest.raises(ValueError):
            digests.DigestIndex(spark, path, **wrong)


def test_index_is_vacuumed(spark):
    index = digests.DigestIndex(spark, shared_dir(spark, "index"), 2)
    row = lambda k, d: spark.createDataFrame([(k, 1, d)], "doc_id bigint, chars bigint, digest string")
    index.append(row(1, "x"))
    index._write(index.entries())  # an append that didn't come to its commit
    index.append(row(2, "x"))
    index.compact()
    segments = lambda: len(index.manifests.fs.globStatus(index.manifests.path_of(f"{index.path}/segments/segment=*")))
    assert segments() == 4
    index.vacuum()
    assert segments() == 1 and sorted(map(tuple, index.rows().collect())) == [("x", 1, 2)]


def test_rows_without_ids_are_compared_apart(spark):
    """Many rows without ids whose texts differ: near copies among them are found."""
    base = [" ".join(f"w{k}x{j}" for j in range(40)) for k in range(60)]
    rows = [(None, t) for t in base] + [(None, base[3] + " more"), (7, base[9] + " more"), (7, base[11])]
    got = jaccard.similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert sorted((r["doc_id"] or -1, r["n_links"]) for r in got.collect()) == [(-1, 0)] * 57 + [(-1, 1)] * 4 + [(7, 1)] * 2


def test_spread_join(spark):
    rows = spark.range(3000).selectExpr("id", "if(id < 2000, 'hot', concat('k', id % 50)) AS key")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.min("id").alias("least"))
    got = spread_join(rows, groups, "key", F.col("id"), "n", 3000)
    want = rows.join(groups, "key").select("id", "key", "n", "least")
    assert sorted(got.collect()) == sorted(want.collect())


def test_components(spark):
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(k, k + 1) for k in range(500, 540)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = sorted((x, find(x)) for e in edges if e[0] != e[1] for x in e)
    got = min_label_components(spark.createDataFrame(edges, "a bigint, b bigint"), "test")
    assert sorted(map(tuple, got.collect())) == sorted(set(want))


def brute_links(rows, threshold=0.8, n=5):
    sets = []
    for _, text in rows:
        words = [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]
        sets.append({tuple(words[k : k + n]) for k in range(max(1, len(words) - n + 1))} if words else set())
    links = np.zeros((len(rows), len(rows)), bool)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and min(len(a), len(b)) >= threshold * max(len(a), len(b)):
                both = len(a & b)
                links[i, j] = links[j, i] = both >= threshold * (len(a) + len(b) - both)
    root = jaccard.local_roots(links)
    out = []
    for k, (doc_id, _) in enumerate(rows):
        ids = [rows[j][0] for j in np.flatnonzero(root == root[k]) if rows[j][0] is not None]
        out.append((doc_id, min(ids, default=None) if links[k].any() else doc_id, int(links[k].sum())))
    return out


def test_similarity_classes(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    got = [tuple(r) for r in jaccard.similarity_classes(docs).collect()]
    assert sorted(got) == sorted(brute_links(rows))
    assert any(r[2] for r in got)


def test_units_that_outgrow_a_task(spark):
    rng = np.random.default_rng(5)
    base = [f"w{k}" for k in range(80)]
    rows = []
    for k in range(120):
        words = list(base)
        for at in rng.integers(0, 80, rng.integers(1, 5)):
            words[at] = f"x{rng.integers(0, 1000)}"
        rows.append((k, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = sorted(brute_links(rows))
    for limits in ({"unit_texts": 25}, {"unit_shingles": 900}, {}):
        assert sorted(map(tuple, jaccard.similarity_classes(table, **limits).collect())) == want


def test_similarity_edges(edge, none):
    got = sorted(map(tuple, jaccard.similarity_classes(edge).collect()), key=str)
    assert got == sorted(brute_links([(r["doc_id"], r["text"]) for r in edge.collect()]), key=str)
    assert jaccard.similarity_classes(none).count() == 0
    kept = jaccard.one_of_each_class(edge)
    assert kept.columns == edge.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 4, 5, 6, 7, 8, 9, 10, 11, 12, None}


def test_depths_are_chosen_by_text():
    """Prefixes stay long where branches are crowded, and the recall is met all the same."""
    shortest = jaccard.shortest_prefix(20, 8, 0.8, 0.9995)
    assert shortest == 4

    def recall(depths, s=0.8):
        return 1 - np.prod([1 - s ** depths.get(t, shortest) for t in range(20)])

    crowded = {t: [5000, 4000, 2000, 900, 3] if t % 3 == 0 else [3, 3, 2, 1, 1] for t in range(20)}
    got = jaccard.chosen_depths(crowded, 100, 20, 8, shortest, 0.8, 0.9995)
    assert recall(got) >= 0.9995
    assert min(got[t] for t in got if t % 3 == 0) > max(got[t] for t in got if t % 3)
    assert all(got[t] == 4 for t in got if t % 3)
    few = jaccard.chosen_depths({0: [900, 60, 1, 1, 1], 1: [9, 1, 1, 1, 1]}, 100, 20, 8, shortest, 0.8, 0.9995)
    assert few == {0: 5, 1: 4}
    assert jaccard.least_similarity(3, 0.8) == 1 and jaccard.least_similarity(6, 0.8) == 5 / 6
    assert jaccard.chosen_depths({4: [700] * 5}, 3, 20, 8, shortest, 0.8, 0.9995) == {4: 8}


def test_recall_of_crowded_branches(spark):
    """Pairs at the threshold among texts that share a long passage: few links may be lost."""
    rng = np.random.default_rng(8)
    shared = [f"s{k}" for k in range(60)]
    rows = []
    for k in range(150):  # pairs of texts, each pair with a passage of its own behind the shared one
        own = [f"p{k}_{j}" for j in range(60)]
        for half in range(2):
            words = shared + own
            at = int(rng.integers(70, 110))
            words[at : at + 2] = [f"q{k}_{half}_{j}" for j in range(2)]
            rows.append((2 * k + half, " ".join(words)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {r[0]: r[2] for r in brute_links(rows)}
    got = {r["doc_id"]: r["n_links"] for r in jaccard.similarity_classes(table).collect()}
    assert all(got[k] <= want[k] for k in want) and sum(want.values()) > 150
    assert sum(got.values()) >= 0.99 * sum(want.values())
