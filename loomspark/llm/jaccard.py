"""Similarity self-join of documents on word n-grams: MinHash LSH forest, then exact check.

Each text has a label of ``depth`` MinHash values in each of ``trees`` tries.  A node of a trie
is a prefix of labels and holds the texts that share it; nodes of all depths are found by one
grouping of hashed prefixes.  A text starts with its whole labels and shortens them one by one,
first where nodes stay small, then where the fewest further texts come in for what the recall
gains, until pairs at the threshold are met with the target probability; so labels stay long
in crowded branches only.
Texts are candidates if they meet in a node that one of them has come to.

Candidates that hang together form one unit of exact checking, so the shingles of a text
are sent once.  Units that outgrow a task are replaced by the forest's own nodes, and
those by pairs of blocks; inside a task all pairs are compared at once, and only the number
of links and one edge for each text come out, never the pairs.
"""

from __future__ import annotations

import hashlib
import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._shared import (
    SPACE_CHARS,
    SPACE_CLASS,
    bounded_batches,
    min_label_components,
    one_row_each,
    sifted,
    sliced,
    spread_join,
    stored,
    tidy,
    trim,
    written,
)

THRESHOLD = 0.8
WORDS = 5
TREES = 20
DEPTH = 8
RECALL = 0.9995
#: Texts, and shingles of all its texts, that one task compares with each other at once.
UNIT_TEXTS = 1024
UNIT_SHINGLES = 1_000_000

#: Texts that a node can hold before a prefix stays longer.
CROWD = 64
#: Words whose hashes a task remembers before it starts afresh, and characters of the longest.
CACHE_WORDS = 100_000
CACHE_CHARS = 64

_HEAVY = 32
#: Bytes of a label that a MinHash value takes.
_VALUE = 2
_SEPARATORS = {ord(c): " " for c in SPACE_CHARS}


# ---- shingles and labels ---------------------------------------------------------------
class WordHashes(dict):
    """64-bit hash of each word; starts afresh when it holds too many, and keeps no long ones."""

    def __missing__(self, word: str) -> int:
        out = xxhash.xxh64_intdigest(word.encode())
        if len(word) <= CACHE_CHARS:
            if len(self) >= CACHE_WORDS:
                self.clear()
            self[word] = out
        return out


def split_words(text: str | None) -> list[str]:
    return [w for w in (text or "").translate(_SEPARATORS).split(" ") if w]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingles(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``n`` words; of all words where there are fewer."""
    if not len(words):
        return words
    n = min(n, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + words[k : len(words) - n + 1 + k])
    return np.unique(out)


# ---- the forest ------------------------------------------------------------------------
def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20_240_511)
    a = rng.integers(0, 2**31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    return a, rng.integers(0, 2**32, n, dtype=np.uint32)


def labels(hashes: np.ndarray, trees: int, depth: int) -> bytes:
    """The labels of all trees, one after the other: ``depth`` MinHash values each, cut to 16 bits."""
    a, b = _permutations(trees * depth)
    least = np.full(trees * depth, np.iinfo(np.uint32).max, np.uint32)
    values = (hashes >> np.uint64(32)).astype(np.uint32)
    for since in range(0, len(values), 1024):
        np.minimum(least, (values[since : since + 1024, None] * a + b).min(axis=0), out=least)
    return _mixed(least.astype(np.uint64)).astype("<u2").tobytes()


def shortest_prefix(trees: int, depth: int, threshold: float, recall: float) -> int:
    """Length to which prefixes are shortened at most: one less than would do for all trees, so
    that some can stay longer."""
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return max(1, depth - 1)


def least_similarity(n: int, threshold: float) -> float:
    """Smallest Jaccard similarity from the threshold on that a set of ``n`` can have at all."""
    if n > 20 / threshold:
        return threshold
    sizes = range(n, math.floor(n / threshold + 1e-9) + 1)  # of unions
    return min((math.ceil(threshold * u - 1e-9) / u for u in sizes), default=1.0)


def chosen_depths(
    met: dict[int, list[int]], n: int, trees: int, depth: int, shortest: int, threshold: float, recall: float
) -> dict[int, int]:
    """Length of the prefix that a text goes by in each tree.

    ``met`` has, for each tree where the text meets another, the number of texts in its nodes of
    lengths ``shortest`` to ``depth``.  Where it meets none, the shortest prefix costs nothing.
    """
    s = least_similarity(n, threshold)
    if s >= 1:
        return {tree: depth for tree in met}  # equal sets have equal labels

    def miss(d: int) -> float:
        return math.log(1 - s**d)

    out = {tree: next((d for d in range(shortest, depth) if sizes[d - shortest] <= CROWD), depth) for tree, sizes in met.items()}
    now = (trees - len(met)) * miss(shortest) + sum(miss(d) for d in out.values())

    def step(tree: int, d: int) -> tuple[float, int, int]:
        sizes = met[tree]
        more = sizes[d - 1 - shortest] - sizes[d - shortest]
        return more / (miss(d) - miss(d - 1)), -d, tree

    steps = [step(tree, d) for tree, d in out.items() if d > shortest]
    heapq.heapify(steps)
    while steps and now > math.log(1 - recall):
        _, d, tree = heapq.heappop(steps)
        d = -d
        now += miss(d - 1) - miss(d)
        out[tree] = d - 1
        if d - 1 > shortest:
            heapq.heappush(steps, step(tree, d - 1))
    return out


def _choose(trees: int, depth: int, shortest: int, threshold: float, recall: float):
    """From each text's walks down the tries, the nodes that it has come to."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, walks = [], batch.column(1)
            # as numbers, not as a dictionary for each step of each text
            steps = {f: walks.flatten().field(f).to_numpy() for f in ("tree", "d", "key", "texts")}
            at = 0
            for n, length in zip(batch.column(0).to_pylist(), pc.list_value_length(walks).to_pylist()):
                tree, d, key, texts = (steps[f][at : at + length].tolist() for f in ("tree", "d", "key", "texts"))
                at += length
                met: dict[int, list[int]] = {}
                for t, depth_, count in zip(tree, d, texts):
                    met.setdefault(t, [1] * (depth - shortest + 1))[depth_ - shortest] = count
                depths = chosen_depths(met, n, trees, depth, shortest, threshold, recall)
                keys += [k for t, depth_, k in zip(tree, d, key) if depth_ == depths[t]]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64())], names=["key"])

    return choose


def _signed(docs: DataFrame, trees: int, depth: int, n: int) -> DataFrame:
    """``doc_id``, digest of the words, number of shingles and labels of every row."""
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        number = table.__getitem__
        for part in sliced(batches, 1):
            digests, sizes, found_labels = [], [], []
            for text in part.column(1).to_pylist():
                words = split_words(text)
                found = shingles(np.fromiter(map(number, words), np.uint64, len(words)), n)
                digests.append(hashlib.md5("\x20".join(words).encode()).digest())
                sizes.append(len(found))
                found_labels.append(labels(found, trees, depth) if words else b"")
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(digests, pa.binary()),
                    pa.array(sizes, pa.int64()),
                    pa.array(found_labels, pa.binary()),
                ],
                names=["doc_id", "digest", "n", "labels"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(sign), f"doc_id {id_type}, digest binary, n bigint, labels binary")


def _shingled(docs: DataFrame, n: int) -> DataFrame:
    """Digest and shingle set, as bytes, of every row."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = WordHashes()
        number = table.__getitem__
        for part in sliced(batches, 0):
            digests, sets = [], []
            for text in part.column(0).to_pylist():
                words = split_words(text)
                digests.append(hashlib.md5("\x20".join(words).encode()).digest())
                sets.append(shingles(np.fromiter(map(number, words), np.uint64, len(words)), n).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(digests, pa.binary()), pa.array(sets, pa.binary())], names=["digest", "shingles"]
            )

    return docs.select("text").mapInArrow(tidy(cut), "digest binary, shingles binary")


# ---- exact comparison ------------------------------------------------------------------
def intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of the sizes of all pairwise intersections."""
    m = len(sets)
    row = np.repeat(np.arange(m), [len(s) for s in sets])
    _, column, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    out = np.zeros(m * m, np.int64)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    often = count[column] >= _HEAVY
    # shingles in many texts: products of dense 0/1 matrices
    heavy_row, heavy = row[often], np.cumsum(np.diff(column[often], prepend=-1) != 0) - 1
    square = np.zeros((m, m), np.float64)
    for since in range(0, (int(heavy[-1]) + 1) if len(heavy) else 0, 2048):
        lo, hi = np.searchsorted(heavy, [since, since + 2048])
        dense = np.zeros((m, 2048), np.float32)
        dense[heavy_row[lo:hi], heavy[lo:hi] - since] = 1
        square += dense @ dense.T
    # the others: pairs of their few entries
    row, column = row[~often], column[~often]
    for shift in range(1, _HEAVY):
        same = np.flatnonzero(column[shift:] == column[:-shift]) if len(column) > shift else []
        if not len(same):
            break
        out += np.bincount(row[same] * m + row[same + shift], minlength=m * m)
    out = out.reshape(m, m)
    return out + out.T + np.rint(square).astype(np.int64)


def linked(sets: list[np.ndarray], threshold: float) -> np.ndarray:
    """Whether each pair of sets has at least the threshold's Jaccard similarity."""
    both = intersections(sets)
    size = np.array([len(s) for s in sets], np.int64)
    out = both >= threshold * (size[:, None] + size[None, :] - both) - 1e-9
    np.fill_diagonal(out, False)
    return out


def local_roots(links: np.ndarray) -> np.ndarray:
    """Smallest index of the connected component of each index."""
    m = len(links)
    root = np.arange(m)
    while True:
        least = np.where(links, root[None, :], m).min(axis=1, initial=m)
        new = np.minimum(root, least)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(threshold: float):
    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by("digest")
        digests = table["digest"].to_pylist()
        sets = [np.frombuffer(b, np.uint64) for b in table["shingles"].to_pylist()]
        links = linked(sets, threshold)
        side, part_a, part_b = (table[c].to_numpy() for c in ("own", "part_a", "part_b"))
        if part_a[0] != part_b[0]:  # pairs within a block belong to that block's own task
            links &= side[:, None] != side[None, :]
        tree = int(table["tree"][0].as_py())
        if tree > 0:  # pairs that met in an earlier tree are counted there
            keys = np.array(table["keys"].to_pylist(), np.int64)
            for k in range(tree):
                links &= (keys[:, k][:, None] != keys[:, k][None, :]) | (keys[:, k] == 0)
        copies = table["copies"].to_numpy()
        number = links.astype(np.int64) @ copies
        has = np.flatnonzero(number)
        root = local_roots(links)
        if sum(map(len, sets)) > UNIT_SHINGLES // 10:
            trim()
        return pa.table(
            {
                "a": pa.array([digests[k] for k in has], pa.binary()),
                "b": pa.array([digests[root[k]] for k in has], pa.binary()),
                "links": pa.array(number[has], pa.int64()),
            }
        )

    return compare


def forest_nodes(reps: DataFrame, trees: int, depth: int, threshold: float, recall: float) -> DataFrame:
    """``digest, n, tree, key, texts, shingles, hub``: the nodes in which texts are candidates.

    ``reps`` has ``digest``, ``n`` and ``labels`` of each text.  A text has one node in a tree
    at most: the shortest of its prefixes that any text has come to.
    """
    shortest = shortest_prefix(trees, depth, threshold, recall)

    def node(d) -> str:
        # the tree's number keeps equal labels of different trees apart
        return f"xxhash64(tree, substring(labels, int(tree * {depth * _VALUE} + 1), int({_VALUE} * {d})))"

    entries = reps.withColumn("tree", F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))).withColumn("key", F.expr(node(shortest)))
    met = entries.groupBy("key").agg(F.count("*").alias("texts")).where(F.col("texts") > 1)
    # only texts that meet another in the shortest prefix go on
    paths = sifted(entries, F.col("key"), written(met, "met"), F.col("key"))
    nodes = F.expr(f"transform(sequence({shortest}, {depth}), d -> struct(d, {node('d')} AS key))")
    paths = paths.select("digest", "n", "tree", F.explode(nodes).alias("x")).select("digest", "n", "tree", "x.d", "x.key")
    paths = written(paths, "paths")
    sizes = paths.groupBy("key").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles"), F.min("digest").alias("hub"))
    sizes = written(sizes.where(F.col("texts") > 1), "nodes")
    total = sizes.agg(F.sum("texts")).first()[0] or 0
    walks = spread_join(paths, sizes, "key", F.col("digest"), "texts", total).where(F.col("texts").isNotNull())
    walks = written(walks, "walks")
    # at most trees x depth entries a text
    walk = F.collect_list(F.struct("tree", "d", "key", "texts"))
    chosen = walks.groupBy("digest").agg(F.first("n").alias("n"), walk.alias("walk")).select("n", "walk")
    chosen = chosen.mapInArrow(tidy(_choose(trees, depth, shortest, threshold, recall)), "key bigint")
    reached = written(chosen.distinct().join(sizes.select("key", F.col("texts").alias("members")), "key"), "reached")
    there = spread_join(walks, reached, "key", F.col("digest"), "members", total).where(F.col("members").isNotNull())
    top = F.min_by(F.struct("key", "texts", "shingles", "hub"), "d")
    return there.groupBy("digest", "tree").agg(F.first("n").alias("n"), top.alias("x")).select("digest", "n", "tree", "x.*")


def _units(met: DataFrame, reps: DataFrame, unit_texts: int, unit_shingles: int) -> DataFrame:
    """``digest, unit, tree, part_a, part_b, own``: which texts are compared together."""
    edges = met.select(F.col("hub").alias("a"), F.col("digest").alias("b"))
    candidates = written(
        min_label_components(edges, "candidates")
        .select(F.col("node").alias("digest"), "root")
        .join(reps.select("digest", "n"), "digest"),
        "candidate-texts",
    )
    sizes = written(
        candidates.groupBy("root").agg(F.count("*").alias("texts"), F.sum("n").alias("shingles")), "unit-sizes"
    )
    fits = (F.col("texts") <= unit_texts) & (F.col("shingles") <= unit_shingles)
    rooted = candidates.join(sizes.withColumn("fits", fits).select("root", "fits"), "root")
    small = rooted.where("fits").select("digest", F.hex("root").alias("unit"), F.lit(-1).alias("tree"), F.lit(1).alias("parts"))
    parts = F.greatest(
        F.lit(1),
        F.ceil(2 * F.col("texts") / unit_texts) * (F.col("texts") > unit_texts).cast("int"),
        F.ceil(2 * F.col("shingles") / unit_shingles) * (F.col("shingles") > unit_shingles).cast("int"),
    ).cast("int")
    large = met.join(rooted.where(~F.col("fits")).select("digest"), "digest").select(
        "digest", F.concat_ws(":", "tree", "key").alias("unit"), "tree", parts.alias("parts")
    )
    own = F.pmod(F.xxhash64("digest"), F.col("parts")).cast("int")
    rows = small.unionByName(large).withColumn("own", own)
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return rows.select(
        "digest", "unit", "tree", "own",
        F.least("own", "other").alias("part_a"), F.greatest("own", "other").alias("part_b"),
    )


def similarity_classes(docs: DataFrame, **options) -> DataFrame:
    """Class and number of links of every document.

    Two documents are linked when the Jaccard similarity of their sets of ``words``-word
    shingles is ``threshold`` or more; texts of fewer words have one shingle of all their
    words, and words are the runs between white space as they are written.  Returns
    ``doc_id, class_id, n_links`` for every row: the smallest ``doc_id`` that can be
    reached over links, and the number of other rows that it is linked to (copies
    included).  Documents without words have no links and are classes of their own; rows
    without an id take part, and a class of such rows only has a null ``class_id``.
    ``options`` are those of ``_classed``.
    """
    return _classed(docs, **options).select("doc_id", "class_id", "n_links")


def _classed(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    words: int = WORDS,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
    unit_texts: int = UNIT_TEXTS,
    unit_shingles: int = UNIT_SHINGLES,
) -> DataFrame:
    """``similarity_classes`` with ``text_key`` and ``stays``, whether it is the row, or a repeat
    of the row, that stands for its class: of the texts with the smallest id, one."""
    signed = written(_signed(docs, trees, depth, words), "signed")

    def classes_of_texts() -> DataFrame:
        reps = written(
            signed.where(F.col("n") > 0)
            .groupBy("digest")
            .agg(
                F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("labels").alias("labels")
            ),
            "texts",
        )
        met = written(forest_nodes(reps.select("digest", "n", "labels"), trees, depth, threshold, recall), "forest")
        units = written(_units(met, reps, unit_texts, unit_shingles), "units")
        # the node in each tree, 0 where there is none
        keys = F.expr(f"transform(sequence(0, {trees - 1}), t -> coalesce(element_at(keys, t), 0L))").alias("keys")
        keyed = met.groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("tree", "key"))).alias("keys"))
        wanted = keyed.select("digest", keys).join(reps.select("digest", "rep", "copies"), "digest")
        wanted = written(wanted, "wanted")
        # the sieve first: few texts are candidates, and whole texts are what a shuffle costs most
        # for; an inner join, since the optimiser would move a semi-join to before the sieve.  The
        # join goes by id and words, so ids that repeat, or rows without one, don't meet in a task
        texts = sifted(docs.select("doc_id", "text"), F.col("doc_id"), wanted, F.col("rep"))
        row = F.xxhash64("doc_id", F.unhex(F.md5(_one_spaced(F.col("text")))))
        rows = wanted.select(F.xxhash64("rep", "digest").alias("_row")).distinct()
        texts = texts.withColumn("_row", row).join(rows, "_row")
        sets = _shingled(texts, words).groupBy("digest").agg(F.first("shingles").alias("shingles"))
        payload = written(wanted.drop("rep").join(sets, "digest"), "shingles")
        found = written(
            units.join(payload, "digest")
            .groupBy("unit", "part_a", "part_b")
            .applyInArrow(_compare(threshold), "a binary, b binary, links bigint"),
            "links",
        )
        links = found.groupBy(F.col("a").alias("digest")).agg(F.sum("links").alias("links"))
        classes = min_label_components(found.select("a", "b"), "classes").withColumnRenamed("node", "digest")
        classes = written(classes.join(reps.select("digest", "rep"), "digest"), "class-texts")
        first = F.min(F.struct(F.col("rep").isNull().alias("no_id"), "rep", "digest"))
        roots = classes.groupBy("root").agg(F.min("rep").alias("class_rep"), first["digest"].alias("first"))
        named = classes.join(roots, "root").select("digest", "class_rep", (F.col("digest") == F.col("first")).alias("leads"))
        named = named.join(links, "digest", "left")
        groups = reps.select("digest", "rep", "copies").join(named, "digest", "left")
        return groups.select(
            F.hex("digest").alias("text_key"),
            F.coalesce("class_rep", "rep").alias("class_id"),
            F.coalesce("leads", F.lit(True)).alias("leads"),
            (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
            "copies",
        )

    # what it took on the way is deleted when the classes are there
    groups = stored(classes_of_texts, docs.sparkSession, "classed").where(F.col("n_links") > 0)
    rows = signed.select("doc_id", F.hex("digest").alias("text_key"), (F.col("n") > 0).alias("worded"))
    out = spread_join(rows, groups, "text_key", F.struct("doc_id"), "copies", signed.count())
    has = F.col("worded") & F.col("n_links").isNotNull()
    return out.select(
        "doc_id",
        F.when(has, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(has, F.col("n_links")).otherwise(0).cast("long").alias("n_links"),
        "text_key",
        (~has | (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("class_id")))).alias("stays"),
    )


def _one_spaced(text: Column) -> Column:
    """The words with one space between, in UTF-8: what ``_signed`` takes the digest of."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), f"[{SPACE_CLASS}]++", " ")).cast("binary")


def one_of_each_class(docs: DataFrame, **options) -> DataFrame:
    """One row of each class, with the smallest id of it, with all its columns.

    Rows are told apart by id and words, so an id with several texts keeps those that stay;
    of rows that repeat both, and of classes without ids, one stays, too.
    """

    def copies() -> DataFrame:
        rows = _classed(docs, **options).where(F.col("n_links") > 0)
        return rows.groupBy("text_key", "doc_id", "stays").agg(F.count("*").alias("rows"))

    keys = stored(copies, docs.sparkSession, "class-rows")
    repeated = keys.where(F.col("stays") & (F.col("rows") > 1))
    return one_row_each(docs, F.upper(F.md5(_one_spaced(F.col("text")))), keys.where(~F.col("stays")), repeated)
