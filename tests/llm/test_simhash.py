import collections
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from loomspark.llm import queries, simhash
from pyspark.sql import functions as F


def brute_fingerprint(text, n=3):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[k : k + n]) for k in range(len(words) - n + 1)] or [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(prints, radius=2):
    """Root fingerprint of each, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    known = sorted(root)
    for k, a in enumerate(known):
        for b in known[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                root[find(a)] = find(b)
    return {p: find(p) for p in known}


def brute(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = brute_components(prints)
    ids = collections.defaultdict(list)
    for (doc_id, _), p in zip(rows, prints):
        if doc_id is not None:
            ids[root[p]].append(doc_id)
    return [(doc_id, f"{p:016x}", min(ids[root[p]], default=None)) for (doc_id, _), p in zip(rows, prints)]


@given(st.text(alphabet=st.sampled_from("aAbZé \t\x0b\xa0 "), max_size=60))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_built_in_hash_is_the_same(spark):
    text = "der schnelle fuchs"
    row = spark.range(1).select(F.xxhash64(F.lit(text)).alias("h")).first()
    assert simhash.shingle_hashes(text.encode()).view("int64").tolist() == [row["h"]]


def test_query_equals_brute_force(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    got = [tuple(r) for r in queries.op11_simhash(spark, sf_dir).collect()]
    assert sorted(got) == sorted(brute(rows))


def test_edge_cases(edge, none):
    rows = [(r["doc_id"], r["text"]) for r in edge.collect()]
    found = simhash.near_duplicates(edge)
    got = [(r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in found.collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("radius", [1, 2])
def test_links_hold_together_what_brute_force_does(spark, radius):
    """Chains, balls and their rims, the sign bit included; every link is within the radius."""
    import random

    rng = random.Random(7)
    prints = {0, 1, 3, 7, 2**63, 2**63 + 1, 2**64 - 1}
    for _ in range(60):
        p = rng.getrandbits(64)
        prints.add(p)
        for _ in range(rng.randrange(6)):  # a walk
            p ^= 1 << rng.randrange(64)
            p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints |= {1 << k for k in range(64)}  # the ball of 0, all members at two bits from each other
    signed = [(p - 2**64 if p >= 2**63 else p,) for p in prints]
    links = simhash.ball_links(spark.createDataFrame(signed, "fp bigint"), radius)
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p

    for a, b in links.collect():
        a, b = a % 2**64, b % 2**64
        assert 0 < (a ^ b).bit_count() <= radius
        root[find(a)] = find(b)
    want = collections.defaultdict(set)
    for p, r in brute_components(prints, radius).items():
        want[r].add(p)
    got = collections.defaultdict(set)
    for p in prints:
        got[find(p)].add(p)
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))


def test_other_radius_is_an_error(spark):
    with pytest.raises(ValueError):
        simhash.ball_links(spark.range(0).withColumnRenamed("id", "fp"), 3)
