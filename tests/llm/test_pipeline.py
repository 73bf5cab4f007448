import collections
import hashlib
import os
import re

import __spark_entry__
import corpus_pipeline
import numpy as np
from loomspark.llm import pieces
from loomspark.llm._shared import stored, written
from loomspark.llm.queries import piece_model
from test_dedup import brute_links
from test_mix import brute_targets

SPACE = re.compile(r"[\x20\x09-\x0D]+")


def test_stages_on_edges(spark, edge, none, sf_dir):
    for table in (edge, none):
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, table, sf_dir)
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == table.columns
            out.count()


def test_one_row_of_each_group(spark, sf_dir):
    """Ids that have several texts, repeated rows and rows without ids: copies go row by row."""
    word = iter(range(10_000))
    new = lambda: " ".join(f"w{next(word)}" for _ in range(60))
    a, b, c, d, e, f, g, h, k = (new() for _ in range(9))
    near = lambda text: text + " more"
    rows = [
        (1, a), (2, a), (2, b), (0, c), (1, c), (3, d), (3, d), (None, e), (None, e), (None, f), (5, f),
        (4, d[:-1] + "0"), (6, g), (6, g + " "), (None, h), (None, near(h)), (7, k), (7, near(k)), (None, near(near(k))),
        (8, "w"), (8, "v"), (9, "v"),
    ]
    table = spark.createDataFrame([(*r, "s") for r in rows], "doc_id bigint, text string, source string").repartition(4)
    exact = corpus_pipeline.drop_exact_copies(spark, table, sf_dir)
    want = [
        (1, a), (2, b), (0, c), (3, d), (None, e), (5, f), (4, d[:-1] + "0"), (6, g + " "), (None, h), (None, near(h)),
        (7, k), (7, near(k)), (None, near(near(k))), (8, "w"), (8, "v"),
    ]
    got = [(r["doc_id"], r["text"]) for r in exact.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)

    # one of each near group, whether its rows have ids or not
    group = {text: base for base in (a, b, c, d, e, f, g, h, k) for text in (base, base + " ", near(base), near(near(base)))}
    group[d[:-1] + "0"] = d
    for stage_input in (exact, table):
        got = [(r["doc_id"], r["text"]) for r in corpus_pipeline.drop_near_copies(spark, stage_input, sf_dir).collect()]
        least = {}
        for i, text in (r for r in rows):
            least.setdefault(group.get(text, text), []).append(i)
        assert collections.Counter(group.get(text, text) for _, text in got) == collections.Counter(least.keys())
        for i, text in got:
            assert i == min((x for x in least[group.get(text, text)] if x is not None), default=None)


def brute_kept(rows):
    """The documents that the first three stages keep: rows with letters, one of equal texts
    and one of each near group."""
    rows = [r for r in rows if any(map(str.isalpha, r["text"] or ""))]
    best = {}
    for r in sorted(rows, key=lambda r: (-len(r["text"]), r["doc_id"])):
        best.setdefault(SPACE.sub("", r["text"]), r)
    rows = list(best.values())
    return [r for r, (id, of, _) in zip(rows, brute_links([(r["doc_id"], r["text"]) for r in rows])) if id == of]


def test_run_equals_brute_force(spark, docs, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir).collect()
    kept = {r["doc_id"]: r for r in brute_kept(docs.collect())}
    words = {k: len([w for w in SPACE.split(r["text"]) if w]) for k, r in kept.items()}
    copies = collections.Counter(r["doc_id"] for r in out)
    assert set(copies) <= set(kept) and max(copies.values()) <= 3
    sizes, taken = collections.Counter(), collections.Counter()
    for k, r in kept.items():
        sizes[r["source"]] += words[k]
        taken[r["source"]] += copies[k] * words[k]
    for source, target in brute_targets(dict(sizes)).items():
        assert abs(taken[source] - target) <= 0.02 * target + 20
        # every document is taken as often as the rate says, rounded down or up
        rate = target / sizes[source]
        assert all(int(rate) <= copies[k] <= int(np.ceil(rate - 1e-9)) for k, r in kept.items() if r["source"] == source)
    model = pieces.load_model(piece_model())
    for r in out:
        ids = model.encode(kept[r["doc_id"]]["text"], add_bos=True, add_eos=True)
        assert r["ids"] == ids and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_tables_on_the_way_are_deleted(spark):
    folder = spark.conf.get("spark.checkpoint.dir").removeprefix("file:")

    def make():
        inner = written(spark.range(10), "inner")
        return stored(lambda: written(inner.where("id > 3"), "deep"), spark, "outer")

    before = set(os.listdir(folder))
    out = stored(make, spark, "whole")
    left = {name.rpartition("-")[0] for name in set(os.listdir(folder)) - before}
    assert sorted(r["id"] for r in out.collect()) == list(range(4, 10)) and left == {"whole"}


def test_registered():
    names = __spark_entry__.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))
    assert set(__spark_entry__.oracle_sql()) <= set(names)
