"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Fingerprints that differ in two bits at most have a value between them that is one bit or
less from both.  So every distinct fingerprint emits all values of its own ball of half the
radius (itself and one for each flipped bit); grouped by value, those that meet are linked.
A value's group is a ball, too: a mask of 64 flipped bits holds it, so no group grows with
the data, and copies were brought down to one fingerprint before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._shared import bounded_batches, min_label_components, sliced, spread_join, tidy, written

WORDS = 3
RADIUS = 2
SEED = 42
BITS = 64
#: Hashes that are counted bit by bit at once.
_COUNT = 8192

_LOWER = bytes(range(256)).lower()


def shingle_hashes(text: bytes, words: int = WORDS) -> np.ndarray:
    """XXH64 of each run of ``words`` words in UTF-8, repeats included: A-Z lowered, one space
    between words; of all words where there are fewer."""
    parts = text.translate(_LOWER).split()  # bytes are split at ASCII white space only
    if not parts:
        return np.empty(0, np.uint64)
    n = min(words, len(parts))
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: len(parts) - n + 1]
    joined = memoryview(b" ".join(parts))
    digest = xxhash.xxh64_intdigest
    spans = zip(starts.tolist(), ends[n - 1 :].tolist())
    return np.fromiter((digest(joined[a:b], SEED) for a, b in spans), np.uint64, len(starts))


def fingerprint(text: bytes, words: int = WORDS) -> int:
    """64 bits, each 1 if it is set in over half the shingles' hashes; 0 without words."""
    hashes = shingle_hashes(text, words)
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), _COUNT):
        bits = np.unpackbits(hashes[k : k + _COUNT].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """``doc_id, fp`` of every row, the fingerprint as a signed number; null texts have no words."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, 1):
            found = (fingerprint(t or b"", words) for t in part.column(1).to_pylist())
            fp = np.fromiter(found, np.uint64, part.num_rows).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(tidy(make), f"doc_id {id_type}, fp bigint")


def ball_links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that hold together all fingerprints ``fp`` at ``radius`` bits or fewer.

    In each value's group every fingerprint is linked to one of them, so nothing grows with the
    square of a group; a pair that differs in more bits than the radius is dropped.
    """
    if radius not in (1, 2):
        raise ValueError("balls of one bit serve a radius of 1 or 2")
    ball = distinct.select("fp", F.explode(F.sequence(F.lit(-1), F.lit(BITS - 1))).alias("p"))
    flip = F.when(F.col("p") < 0, F.lit(0).cast("long")).otherwise(F.expr("shiftleft(1L, p)"))
    ball = ball.select(F.col("fp").bitwiseXOR(flip).alias("value"), flip.alias("flip"))
    met = ball.groupBy("value").agg(F.bit_or("flip").alias("flips"), F.count_if(F.col("flip") == 0).alias("own"))
    met = met.where(F.bit_count("flips") + F.col("own") > 1)
    members = F.expr(f"transform(filter(sequence(0, {BITS - 1}), k -> getbit(flips, k) = 1), k -> value ^ shiftleft(1L, k))")
    hub = F.when(F.col("own") > 0, F.col("value")).otherwise(F.col("members")[0])
    links = met.withColumn("members", members).select(hub.alias("a"), F.explode("members").alias("b"))
    links = links.where("a <> b").distinct()
    return links.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius)


def near_duplicates(docs: DataFrame, words: int = WORDS, radius: int = RADIUS) -> DataFrame:
    """``doc_id, fp, component_id`` of every row of ``docs``.

    ``component_id`` is the smallest id that links lead to, the row's own included.  Null and
    empty texts have the fingerprint 0, which is linked as others are.  Rows without an id take
    part; a component of such rows only has a null ``component_id``.  Repeated rows are rows of
    one fingerprint; other columns are ignored; an empty table gives no rows.
    """
    signed = written(fingerprints(docs, words), "fingerprints")
    distinct = written(signed.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("copies")), "distinct")
    found = min_label_components(ball_links(distinct, radius), "near")
    nodes = written(found.join(distinct.select(F.col("fp").alias("node"), "least"), "node"), "nodes")
    # a chain of near copies can be a large component: the smallest ids are found before the shuffle,
    # and what comes back is spread
    roots = written(nodes.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("ends")), "roots")
    named = spread_join(nodes, roots, "root", F.col("node"), "ends", nodes.count())
    groups = distinct.join(named.select(F.col("node").alias("fp"), "component_id", "ends"), "fp", "left")
    groups = groups.where((F.col("copies") > 1) | F.col("ends").isNotNull())
    groups = groups.select("fp", "copies", F.coalesce("component_id", "least").alias("component_id"))
    out = spread_join(signed, written(groups, "groups"), "fp", F.struct("doc_id"), "copies", signed.count())
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))
