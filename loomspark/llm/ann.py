"""Approximate nearest neighbours by inner product with balanced posting lists.

Vectors are cut into posting lists around centroids that are fitted on a bounded sample by
repeated balanced splits, so lists have like lengths; a vector near a boundary is put in
several lists.  All centroids stay in memory as a neighbour graph, in which a beam search
finds the lists near a vector.  A query always reads its few nearest lists, and on until they
hold several times the vectors it wants; past them it reads the lists whose distance is within
a ratio of the farthest of these.  (Chen et al., SPANN, 2021.)

Only so many centroids fit in memory.  Lists that stay long are split again where they lie, by
centroids of their own, which no machine holds together: vectors and queries that come to such
a list are dealt on to its parts, as often as it takes.  After each level a query's lists, parts
and short ones together, are cut once by distance to the number that it may read, which grows
with the root of the number of lists and ends at MOST_PROBES.  So lists don't grow with the table,
and the lists of a query don't multiply by levels.

Largest inner product becomes smallest distance by one more coordinate, which brings all
vectors to one norm and is 0 for queries.  Equal vectors are indexed once with their
smallest ids, which are all that can be among the nearest.  Lists and queries meet by a
shuffle on the list; scores are exact inner products in double precision.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._shared import spread_join, written

#: Vectors that the centroids are fitted on, about.
FIT_VECTORS = 50_000
#: Distinct vectors meant for a list, and centroids kept in memory at most.
LIST_VECTORS = 200
MAX_LISTS = 20_000
#: A vector also goes to lists up to this much farther than its nearest, in so many lists at most.
BOUNDARY = 1.15
REPLICAS = 4
#: A query always reads so many nearest lists, and on until they hold COVER times the vectors
#: wanted (replicas not counted), whatever their distances.
LEAST_PROBES = 8
COVER = 4
#: Besides, it reads lists up to this much farther than the last of those, so many at most: PROBES,
#: or PROBE_ROOTS times the square root of the number of all lists if that is more.
PROBE_RATIO = 1.6
PROBES = 32
PROBE_ROOTS = 6
#: That number ends here, however many lists there are.
MOST_PROBES = 850
#: A list with more than so many times LIST_VECTORS is split, into so many lists at most, by
#: centroids of about so many of its vectors; splits go on for so many levels.
LONG_LIST = 10
SPLIT_LISTS = 256
SPLIT_FIT = 4096
SPLIT_LEVELS = 6
#: Neighbours of a centroid in the graph, and length of the search's beam.
DEGREE = 16
BEAM = 48
#: Rows of a list, and queries, that one task compares at once.
PART_VECTORS = 20_000
PART_QUERIES = 2_000


# ---- centroids -------------------------------------------------------------------------
def balanced_centroids(x: np.ndarray, lists: int, rng: np.random.Generator) -> np.ndarray:
    """Centroids by splitting in two, by halves along the main direction, down to equal sizes."""
    parts = [(-len(x), 0, np.arange(len(x)))]
    while len(parts) < lists and parts[0][0] < -1:
        _, _, part = heapq.heappop(parts)
        own = x[part] - x[part].mean(axis=0)
        direction = own[rng.integers(len(own))]
        for _ in range(8):  # power iteration
            direction = own.T @ (own @ direction)
            norm = np.linalg.norm(direction)
            if norm == 0:
                break
            direction /= norm
        order = np.argsort(own @ direction, kind="stable")
        for half in (part[order[: len(part) // 2]], part[order[len(part) // 2 :]]):
            heapq.heappush(parts, (-len(half), int(half[0]), half))
    centroids = np.array([x[p].mean(axis=0) for _, _, p in parts])
    for _ in range(3):  # a few rounds of assignment, so that cells are round
        nearest = _nearest_exact(x, centroids)
        count = np.bincount(nearest, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, x)
        centroids = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centroids)
    return centroids


def _nearest_exact(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    half = (centroids**2).sum(axis=1) / 2
    return np.concatenate([(half - x[i : i + 2048] @ centroids.T).argmin(axis=1) for i in range(0, len(x), 2048)])


@dataclass
class CentroidGraph:
    """Centroids with their nearest neighbours, and a few of them to start a search from."""

    centroids: np.ndarray
    neighbours: np.ndarray
    starts: np.ndarray

    @classmethod
    def build(cls, centroids: np.ndarray, degree: int, rng: np.random.Generator) -> CentroidGraph:
        n = len(centroids)
        degree = min(degree, max(1, n - 1))
        near = np.empty((n, degree), np.int32)
        half = (centroids**2).sum(axis=1) / 2
        for i in range(0, n, 1024):
            d = half - centroids[i : i + 1024] @ centroids.T
            d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
            near[i : i + 1024] = np.argpartition(d, degree - 1, axis=1)[:, :degree] if n > 1 else 0
        far = rng.integers(0, n, (n, 2), dtype=np.int32)  # long links keep the graph in one piece
        starts = rng.permutation(n)[: max(1, int(4 * np.sqrt(n)))]
        return cls(centroids.astype(np.float64), np.hstack([near, far]), starts)

    def search(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the nearest centroids found for each row, nearest first.

        All rows move at once: a beam is replaced by the best of itself and its neighbours
        until no row's beam changes.
        """
        beam = min(beam, len(self.centroids))
        half = (self.centroids**2).sum(axis=1) / 2
        square = (x**2).sum(axis=1)

        def best(ids: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            order = np.argsort(ids, axis=1, kind="stable")
            ids, d = np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)
            d[:, 1:][ids[:, 1:] == ids[:, :-1]] = np.inf  # each number once
            order = np.argsort(d, axis=1, kind="stable")[:, :beam]
            return np.take_along_axis(ids, order, 1), np.take_along_axis(d, order, 1)

        # one number at least for each place of the beam, from the starts on
        first = np.concatenate([self.starts, np.setdiff1d(np.arange(len(half)), self.starts)])
        first = first[: max(len(self.starts), beam)]
        ids = np.repeat(first[None, :], len(x), axis=0)
        ids, d = best(ids, half[first] - x @ self.centroids[first].T)
        live = np.arange(len(x))
        while len(live):
            around = self.neighbours[ids[live, : max(4, beam // 4)]].reshape(len(live), -1)
            gap = half[around] - np.einsum("ij,ikj->ik", x[live], self.centroids[around])
            new_ids, new_d = best(np.hstack([ids[live], around]), np.hstack([d[live], gap]))
            moved = (new_ids[:, : max(4, beam // 4)] != ids[live, : max(4, beam // 4)]).any(axis=1)
            ids[live], d[live] = new_ids, new_d
            live = live[moved]
        return ids, np.sqrt(np.maximum(2 * d + square[:, None], 0))


# ---- vectors ---------------------------------------------------------------------------
def usable(embedding: Column) -> Column:
    """Whether a vector takes part: not null or empty, all components finite, not all zero."""
    finite = F.forall(embedding, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    return F.coalesce(finite & F.exists(embedding, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    # flattened, since ``values`` would also have what a sliced column leaves out
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def _augmented(x: np.ndarray, top: float) -> np.ndarray:
    return np.hstack([x, np.sqrt(np.maximum(top - (x**2).sum(axis=1), 0))[:, None]])


def _assign(graph_box, mode: str, top: float, boundary: float, most: int, lengths_box=None, cover: int = 0):
    """For each row its lists: replicas of an indexed vector with the vector, or the lists a query
    reads with their distances ``d`` and lengths.

    ``lengths_box`` has the length of each list, and ``cover`` the sum of lengths that a query
    reads at least, or else all lists.
    """

    def lists_of(x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        graph: CentroidGraph = graph_box.value
        for i in range(0, len(x), 512):
            part = x[i : i + 512]
            query = np.hstack([part, np.zeros((len(part), 1))]) if mode == "query" else _augmented(part, top)
            ids, d = graph.search(query, max(BEAM, most + most // 2))
            ids, d = ids[:, :most], d[:, :most]
            there = np.isfinite(d)
            if mode == "query":
                own = lengths_box.value[ids] * there
                held = own.cumsum(axis=1)
                needed = there & ((held - own < cover) | (np.arange(ids.shape[1]) < LEAST_PROBES))
                reach = np.where(needed, d, 0).max(axis=1, keepdims=True)
                fits = there & (needed | (d <= boundary * reach + 1e-12))
            else:
                fits = there & (d <= boundary * d[:, :1] + 1e-12)
            for k in range(len(part)):
                found, far = ids[k, fits[k]], d[k, fits[k]]
                if mode == "query" and held[k, -1] < cover:
                    # too few vectors there: all lists in order, as far as it takes
                    gap = (graph.centroids**2).sum(axis=1) / 2 - graph.centroids @ query[k]
                    order = np.argsort(gap, kind="stable")
                    order = order[: np.searchsorted(lengths_box.value[order].cumsum(), cover) + 1]
                    found = np.union1d(found, order)
                    far = np.sqrt(np.maximum(2 * gap[found] + (query[k] ** 2).sum(), 0))
                if mode == "index" and len(found) > 1:
                    # skip a list that an already chosen one is nearer to than the vector is
                    kept = [0]
                    c = graph.centroids[found]
                    for j in range(1, len(found)):
                        if np.sqrt(((c[kept] - c[j]) ** 2).sum(axis=1)).min() > d[k, j]:
                            kept.append(j)
                    found = found[kept]
                yield found, far

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found, far = zip(*lists_of(_matrix(batch["v"]).astype(np.float64)))
                rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
                to = np.concatenate(found).astype(np.int64)
                if mode == "index":
                    out = batch.take(rows)
                    yield pa.RecordBatch.from_arrays([*out.columns, pa.array(to)], names=[*batch.schema.names, "list"])
                else:
                    out = [batch["qid"].take(rows), pa.array(to), pa.array(np.concatenate(far)), pa.array(lengths_box.value[to])]
                    yield pa.RecordBatch.from_arrays(out, names=["qid", "list", "d", "length"])

    return assign


# ---- lists that stay long --------------------------------------------------------------
def _fit_split(top: float, list_vectors: int, seed: int):
    """Centroids of one long list from a sample of it; ``n`` is its length."""

    def fit(key: tuple, sample: pa.Table) -> pa.Table:
        sample = sample.sort_by("cid")
        x = _augmented(_matrix(sample["v"].combine_chunks()).astype(np.float64), top)
        lists = int(max(1, min(SPLIT_LISTS, -(-sample["n"][0].as_py() // list_vectors), len(x) // 4)))
        c = balanced_centroids(x, lists, np.random.default_rng(seed))
        parent = key[0].as_py()
        return pa.table(
            {
                "list": pa.array([parent] * len(c), pa.int64()),
                "sub": pa.array(np.arange(len(c)), pa.int64()),
                "c": pa.array(list(c), pa.list_(pa.float64())),
            }
        )

    return fit


def _deal(mode: str, top: float, cover: int, most: int):
    """Rows of a long list to the nearest of its parts, as ``_assign`` does with all lists.  What a
    query reads of all its lists is among the parts that it would read of this one alone."""

    def deal(key: tuple, rows: pa.Table, parts: pa.Table) -> pa.Table:
        out = rows.drop_columns(["list"] if mode == "index" else ["list", "v"])
        if not rows.num_rows or not parts.num_rows:
            names = ("list",) if mode == "index" else ("list", "d", "length")
            for name in names:
                out = out.slice(0, 0).append_column(name, pa.array([], pa.float64() if name == "d" else pa.int64()))
            return out
        c = _matrix(parts["c"].combine_chunks()).astype(np.float64)
        name = parts["sub"].to_numpy()
        length = parts["length"].to_numpy() if mode == "query" else None
        x = _matrix(rows["v"].combine_chunks()).astype(np.float64)
        x = _augmented(x, top) if mode == "index" else np.hstack([x, np.zeros((len(x), 1))])
        at, to, far, held_by = [], [], [], []
        for i in range(0, len(x), 1024):
            part = x[i : i + 1024]
            d = np.sqrt(np.maximum((part**2).sum(axis=1)[:, None] + (c**2).sum(axis=1) - 2 * part @ c.T, 0))
            ids = np.argsort(d, axis=1, kind="stable")
            d = np.take_along_axis(d, ids, 1)
            if mode == "index":
                fits = (d <= BOUNDARY * d[:, :1] + 1e-12) & (np.arange(len(c)) < 2)
            else:
                held = length[ids].cumsum(axis=1)
                needed = (held - length[ids] < cover) | (np.arange(len(c)) < LEAST_PROBES)
                reach = np.where(needed, d, 0).max(axis=1, keepdims=True)
                fits = needed | ((d <= PROBE_RATIO * reach + 1e-12) & (np.arange(len(c)) < most))
            row, col = np.nonzero(fits)
            at.append(i + row)
            to.append(name[ids[row, col]])
            if mode == "query":
                far.append(d[row, col])
                held_by.append(length[ids[row, col]])
        out = out.take(pa.array(np.concatenate(at))).append_column("list", pa.array(np.concatenate(to), pa.int64()))
        if mode == "query":
            out = out.append_column("d", pa.array(np.concatenate(far)))
            out = out.append_column("length", pa.array(np.concatenate(held_by), pa.int64()))
        return out

    return deal


def _most(lists: int) -> int:
    """Lists that a query may read of so many, besides those that it needs."""
    return max(PROBES, min(MOST_PROBES, int(PROBE_ROOTS * np.sqrt(lists))))


def _cut(reads: DataFrame, cover: int, most: int) -> DataFrame:
    """``qid, list, d, length`` cut to what each query reads of all its lists: the nearest until they
    hold ``cover`` vectors and are LEAST_PROBES, and those within the ratio among the nearest ``most``.

    A query comes with ``most`` short lists, or parts of long ones, for each list at most.
    """
    near = Window.partitionBy("qid").orderBy("d", "list")
    before = F.coalesce(F.sum("length").over(near.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reads = reads.withColumns({"_place": F.row_number().over(near), "_before": before})
    reads = reads.withColumn("_needed", (F.col("_before") < cover) | (F.col("_place") <= LEAST_PROBES))
    reach = F.max(F.when(F.col("_needed"), F.col("d"))).over(Window.partitionBy("qid"))
    close = (F.col("d") <= PROBE_RATIO * reach + 1e-12) & (F.col("_place") <= most)
    reads = reads.withColumn("_close", close).where(F.col("_needed") | F.col("_close"))
    return reads.select("qid", "list", "d", "length").dropDuplicates(["qid", "list"])


def _split(
    posted: DataFrame, reads: DataFrame, asked: DataFrame, lists: DataFrame, top: float, cover: int, list_vectors: int, level: int
):
    """Posted vectors and reads with the long lists among ``lists`` (``list, n``) split; ``asked`` has
    the query vectors."""
    long = written(lists.where(F.col("n") > LONG_LIST * list_vectors), "long-lists")
    total, split = long.agg(F.sum("n"), F.count("*")).first()

    def there(rows: DataFrame, id: str) -> tuple[DataFrame, DataFrame]:
        rows = spread_join(rows, long, "list", F.col(id), "n", total)
        return rows.where(F.col("n").isNull()).drop("n"), rows.where(F.col("n").isNotNull())

    short, deep = there(posted, "cid")
    deep = written(deep, "deep-vectors")
    sample = deep.where(F.pmod(F.xxhash64("cid", F.lit(level)), F.col("n")) < SPLIT_FIT)
    cents = sample.groupBy("list").applyInArrow(_fit_split(top, list_vectors, level), "list bigint, sub bigint, c array<double>")
    # a name for each part; equal names, if there are any, only make one list of two
    cents = written(cents.withColumn("sub", F.xxhash64("list", "sub", F.lit(level))), "split-centroids")
    most = _most(lists.count() - split + cents.count())

    def dealt(rows: DataFrame, id: str, parts: DataFrame, mode: str, size: int) -> DataFrame:
        # of a hot list, many tasks have the centroids and a share of its rows each
        shares = rows.groupBy("list").agg(F.ceil(F.count("*") / size).alias("shares"))
        shares = written(shares, "shares")
        rows = spread_join(rows.drop("n"), shares.join(long, "list"), "list", F.col(id), "n", total)
        rows = rows.withColumn("share", F.pmod(F.xxhash64(id), F.col("shares"))).select(id, "v", "list", "share")
        parts = parts.join(shares, "list").withColumn("share", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)))
        groups = rows.groupBy("list", "share").cogroup(parts.drop("shares").groupBy("list", "share"))
        shape = f"{id} bigint, " + ("v array<double>, list bigint" if mode == "index" else "list bigint, d double, length bigint")
        return groups.applyInArrow(_without_share(_deal(mode, top, cover, most)), shape)

    vectors = written(dealt(deep, "cid", cents, "index", PART_VECTORS), "dealt-vectors")
    lengths = vectors.groupBy(F.col("list").alias("sub")).agg(F.count("*").alias("length"))
    parts = written(cents.join(lengths, "sub"), "split-parts")
    calm, deep_reads = there(reads, "qid")
    deep_reads = deep_reads.select("qid", "list", "n").join(asked.select("qid", "v"), "qid")
    queries = dealt(written(deep_reads, "deep-reads"), "qid", parts, "query", PART_QUERIES)
    return (
        written(short.unionByName(vectors), "posting-lists"),
        written(_cut(calm.unionByName(queries), cover, most), "probes"),
    )


def _without_share(deal):
    return lambda key, rows, parts: deal(key, rows.drop_columns(["share"]), parts)


#: Of a product's rounding, a few units in the last place for each component.
_ROUNDING = 4 * float(np.finfo(np.float64).eps)


def _search_lists(k: int):
    """Best ``k`` vectors of a part of a list for each of some queries, by exact scores."""

    def search(key: tuple, vectors: pa.Table, queries: pa.Table) -> pa.Table:
        schema = pa.schema({"qid": pa.int64(), "cid": pa.int64(), "score": pa.float64()})
        if not vectors.num_rows or not queries.num_rows:
            return schema.empty_table()
        x = _matrix(vectors["v"].combine_chunks()).astype(np.float64)
        q = _matrix(queries["v"].combine_chunks()).astype(np.float64)
        cid, qid = vectors["cid"].to_numpy(), queries["qid"].to_numpy()
        # how far two roundings of one inner product can lie apart
        slack = _ROUNDING * x.shape[1] * np.linalg.norm(q, axis=1) * np.linalg.norm(x, axis=1).max()
        out = []
        for i in range(0, len(q), 256):
            s = q[i : i + 256] @ x.T
            kept = min(k, s.shape[1])
            if kept < s.shape[1]:
                # all that reach the k-th score, so that ties are not cut at random
                least = np.partition(s, s.shape[1] - kept, axis=1)[:, s.shape[1] - kept]
                row, col = np.nonzero(s >= (least - slack[i : i + 256])[:, None])
            else:
                row, col = np.nonzero(np.ones_like(s, bool))
            out.append((qid[i + row], cid[col], s[row, col]))
        return pa.Table.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], schema=schema)

    return search


def nearest_neighbours(
    embeddings: DataFrame,
    query: Column,
    k: int = 20,
    list_vectors: int = LIST_VECTORS,
    fit_vectors: int = FIT_VECTORS,
    seed: int = 7,
    max_lists: int = MAX_LISTS,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest vectors found for each query.

    ``embeddings`` has ``vec_id`` and ``embedding``; ``query`` tells which rows are queries;
    all other rows are candidates of each.  Nearness is the inner product of the vectors as
    they are, in double precision; ties go to the smaller id.  Vectors that are null, zero
    or not finite take no part, nor do those of another length than most have, nor rows
    without an id; rows that repeat an id and vector count once.
    """
    spark = embeddings.sparkSession
    good = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("v"), query.alias("is_query"))
    good = good.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    width = good.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if width is None:
        return spark.createDataFrame([], schema)
    good = written(good.where(F.size("v") == width["n"]), "vectors")

    # equal vectors become one, with the ids that can be among the nearest k (or k + 1, as a
    # query isn't its own neighbour); a rank limit goes before the shuffle
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    once = written(good.groupBy("v", "vec_id").agg(F.max("is_query").alias("is_query")), "vectors-once")
    ids = once.withColumn("place", place).where(F.col("place") <= k + 1)
    cid = F.min("vec_id")
    distinct = written(
        ids.groupBy("v").agg(cid.alias("cid"), F.sort_array(F.collect_list("vec_id")).alias("ids")), "distinct-vectors"
    )
    n, top = distinct.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b))).first()

    # centroids from a bounded sample
    sample = distinct.select("cid", "v")
    if n > fit_vectors:
        sample = sample.where(F.pmod(F.xxhash64("cid", F.lit(seed)), F.lit(n)) < fit_vectors)
    sample = sample.limit(2 * fit_vectors).orderBy("cid").toArrow()["v"].combine_chunks()
    rng = np.random.default_rng(seed)
    x = _augmented(_matrix(sample).astype(np.float64), top)
    lists = int(max(1, min(max_lists, n // list_vectors, len(x) // 4)))
    graph = CentroidGraph.build(balanced_centroids(x, lists, rng), DEGREE, rng)
    box = spark.sparkContext.broadcast(graph)  # MAX_LISTS centroids at most

    vectors = distinct.select("cid", "v")
    posted = written(
        vectors.mapInArrow(_assign(box, "index", top, BOUNDARY, REPLICAS), "cid bigint, v array<double>, list bigint"),
        "posting-lists",
    )
    lengths = np.zeros(lists, np.int64)
    for row in posted.groupBy("list").count().collect():  # MAX_LISTS rows at most
        lengths[row["list"]] = row["count"]
    lengths_box = spark.sparkContext.broadcast(lengths)
    most = _most(lists)
    # a vector counts once in each list that it was put in
    cover = COVER * REPLICAS * (k + 1)
    # queries with one vector are one search
    asked = once.where("is_query").groupBy("v").agg(cid.alias("qid"), F.count("*").alias("queries"))
    asked = written(asked, "query-vectors")
    reads = written(
        asked.select("qid", "v").mapInArrow(
            _assign(box, "query", top, PROBE_RATIO, most, lengths_box, cover), "qid bigint, list bigint, d double, length bigint"
        ),
        "probes",
    )
    longest = lengths.max(initial=0)
    for level in range(SPLIT_LEVELS):
        if longest <= LONG_LIST * list_vectors:
            break
        sizes = written(posted.groupBy("list").agg(F.count("*").alias("n")), "list-lengths")
        posted, reads = _split(posted, reads, asked, sizes, top, cover, list_vectors, level)
        longest = posted.groupBy("list").count().agg(F.max("count")).first()[0] or 0
    # a list or its queries can outgrow a task: parts of it, each pair of parts once
    length = posted.groupBy("list").agg(F.ceil(F.count("*") / PART_VECTORS).alias("parts"))
    wanted = reads.groupBy("list").agg(F.ceil(F.count("*") / PART_QUERIES).alias("shares"))
    plan = written(length.join(wanted, "list").withColumn("size", F.col("parts") * PART_VECTORS), "parts")
    number, in_lists = plan.agg(F.count("*"), F.sum("size")).first()

    def planned(rows: DataFrame, id: str) -> DataFrame:
        if number <= max_lists:  # checked, so that the broadcast is bounded
            return rows.join(F.broadcast(plan), "list")
        return spread_join(rows, plan, "list", F.col(id), "size", in_lists).where(F.col("parts").isNotNull())

    each = planned(posted, "cid").select(
        "cid", "v", "list",
        F.pmod(F.xxhash64("cid"), F.col("parts")).alias("part"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"),
    )
    every = planned(reads.select("qid", "list").join(asked.select("qid", "v"), "qid"), "qid").select(
        "qid", "v", "list",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"),
        F.pmod(F.xxhash64("qid"), F.col("shares")).alias("share"),
    )
    key = ["list", "part", "share"]
    hits = (
        each.groupBy(*key)
        .cogroup(every.groupBy(*key))
        .applyInArrow(_search_lists(k + 1), "qid bigint, cid bigint, score double")
    )
    # replicas give one pair from several lists
    hits = hits.groupBy("qid", "cid").agg(F.max("score").alias("near"))
    close = Window.partitionBy("qid").orderBy(F.desc("near"), "cid")
    least = F.min(F.when(F.col("_n") <= k + 1, F.col("near"))).over(Window.partitionBy("qid"))
    hits = hits.withColumn("_n", F.row_number().over(close)).withColumn("_least", least).join(
        asked.select("qid", F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, b: a + b * b)).alias("_norm")), "qid"
    )
    # all that rounding may have put below the last place; scores that are equal are told apart later
    slack = _ROUNDING * width["n"] * float(np.sqrt(top)) * F.col("_norm")
    hits = written(hits.where(F.col("near") >= F.col("_least") - slack).select("qid", "cid"), "hits")
    q = asked.select("qid", F.col("v").alias("qv"))
    product = F.aggregate(F.zip_with("qv", "v", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    scored = hits.join(q, "qid").join(distinct, "cid").select("qid", "ids", product.alias("score"))
    by_vector = scored.select("qid", "score", F.explode("ids").alias("vec_id"))
    first = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id"))
    by_vector = written(by_vector.withColumn("_n", first).where(F.col("_n") <= k + 1).drop("_n"), "nearest")

    # back from query vectors to queries, of which a hot vector can have many
    results = by_vector.groupBy("qid").agg(
        F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id"))).alias("near")
    )
    vector_key = F.md5(F.col("v").cast("string"))
    results = results.join(asked, "qid").select(vector_key.alias("vector_key"), "near", "queries")
    queries = once.where("is_query").select(F.col("vec_id").alias("query_id"), vector_key.alias("vector_key"))
    own = spread_join(queries, written(results, "results"), "vector_key", F.col("query_id"), "queries", queries.count())
    others = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    return own.select("query_id", F.posexplode(others).alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.less")).alias("score")
    )
