"""Mixing sources to target weights by balanced sampling (the cube method).

A source's target may be any multiple of its size up to a cap, so each document is taken
``floor(rate)`` times for certain and once more with probability ``rate - floor(rate)``.
Those fractions are rounded by the cube method of Deville and Tillé: the vector of
probabilities moves through the null space of the balancing constraints (here the number
of documents and of words of the source) until all but a few entries are 0 or 1.  Blocks of
a source move in parallel; what they leave undecided moves again in fewer blocks, so one
task never holds more than a block and only a small landing problem remains in the end.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspark.llm._shared import hashable, spread_join, stored, word_count, written

#: A source is taken this many times at most.
MAX_REPEATS = 3
#: Weights by the rank of the source's name, repeating.
WEIGHTS = (1, 2, 3)
#: Documents in a block of the flight phase.
BLOCK = 1024
#: Undecided documents of a source that are left to the landing.
LANDING = 12
#: Sources up to this number are broadcast to the documents; more are joined by shuffle.
BROADCAST_SOURCES = 20_000

_EPS = 1e-9


# ---- targets ---------------------------------------------------------------------------
def ranked(names: DataFrame, column: str) -> DataFrame:
    """``names`` (distinct) with ``rank`` from 0 in code-point order, null last."""
    parts = written(
        names.repartitionByRange(F.col(column).isNull(), F.col(column))
        .withColumn("_part", F.spark_partition_id()),
        "ranked",
    )
    counts = parts.groupBy("_part").count()  # one row for each shuffle partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_part").orderBy(F.col(column).asc_nulls_last())
    return (
        parts.join(F.broadcast(offsets), "_part")
        .withColumn("rank", F.col("_before") + F.row_number().over(within) - 1)
        .drop("_part", "_before")
    )


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = 1.0, max_repeats: int = MAX_REPEATS
) -> DataFrame:
    """``source, source_size, docs, rank, target`` for each source of ``sizes``.

    The targets share ``share`` of all sizes by weight.  One that would exceed
    ``max_repeats`` times its source's size stops there, and the excess goes to the others
    by weight until none is above.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = written(ranked(sources, "source").withColumn("weight", w), "sources")
    total = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    most = F.col("source_size") * float(max_repeats)
    level, n_capped = None, -1  # words for one unit of weight
    while True:
        above = F.lit(False) if level is None else F.col("weight") * level > most
        capped, used, left = sources.agg(
            F.count_if(above),
            F.coalesce(F.sum(F.when(above, most)), F.lit(0.0)),
            F.coalesce(F.sum(F.when(~above, F.col("weight"))), F.lit(0.0)),
        ).first()
        if capped == n_capped or not left:
            break
        level, n_capped = (total - used) / left, capped
    target = F.least(F.col("weight") * (level or 0.0), most)
    return sources.select("source", "source_size", "docs", "rank", target.alias("target"))


# ---- the cube method -------------------------------------------------------------------
def flight(pi: Sequence[float], size: Sequence[float], draw: random.Random, stop: int = 2) -> list[float]:
    """Move ``pi`` until ``stop`` entries at most lie strictly between 0 and 1.

    Keeps the sums of ``pi`` and of ``pi * size``.  Each move goes along the first undecided
    entry's axis, projected on the null space of the two constraints: that entry moves most and
    the others make up for it.  With entries in descending size, small ones are left in the end.
    """
    pi = np.array(pi, float)
    pi[pi < _EPS], pi[pi > 1 - _EPS] = 0, 1
    size = np.array(size, float)
    size /= max(1.0, size.max(initial=0))
    open_ = np.flatnonzero((pi > 0) & (pi < 1))
    while len(open_) > max(2, stop):
        p, x = pi[open_], size[open_] - size[open_].mean()
        spread = x @ x
        u = -(1 / len(x) + (x[0] / spread * x if spread > _EPS else np.zeros(len(x))))
        u[0] += 1
        if not np.abs(u).max() > _EPS:  # the first alone makes the sizes uneven: it can't move
            open_ = np.append(open_[1:], open_[0])
            x = size[open_] - size[open_].mean()
            p, u = pi[open_], np.where(np.arange(len(x)) < 2, [1.0, -1.0] + [0.0] * (len(x) - 2), 0.0)
        rises, falls = u > 1e-12, u < -1e-12
        up = min(((1 - p[rises]) / u[rises]).min(initial=np.inf), (p[falls] / -u[falls]).min(initial=np.inf))
        down = min((p[rises] / u[rises]).min(initial=np.inf), ((1 - p[falls]) / -u[falls]).min(initial=np.inf))
        p = p + (up if draw.random() * (up + down) < down else -down) * u
        p[p < _EPS], p[p > 1 - _EPS] = 0, 1
        pi[open_] = p
        open_ = open_[(p > 0) & (p < 1)]
    return pi.tolist()


def landing(pi: list[float], size: list[float]) -> list[float]:
    """Round the few entries that ``flight`` left undecided: of all ways, the one closest to
    their sum of sizes, then to their number."""
    open_ = [k for k, p in enumerate(pi) if 0 < p < 1]
    ways = np.array(list(product((0.0, 1.0), repeat=len(open_))))
    gap = np.abs(ways @ [size[k] for k in open_] - sum(pi[k] * size[k] for k in open_)).round(6)
    number = np.abs(ways.sum(axis=1) - sum(pi[k] for k in open_)).round(6)
    for k, x in zip(open_, ways[np.lexsort((number, gap))[0]].tolist()):
        pi[k] = x
    return pi


def _fly(seed: int, round_: int):
    def fly(key: tuple, block: pd.DataFrame) -> pd.DataFrame:
        rank, part, land = key
        block = block.sort_values(["size", "order", "unit"], ascending=[False, True, True], ignore_index=True)
        pi, size = block["pi"].tolist(), [float(x) for x in block["size"]]
        pi = flight(pi, size, random.Random(f"{seed}/{round_}/{rank}/{part}"), LANDING if land else 2)
        return block[["unit", "rank", "size", "order"]].assign(pi=landing(pi, size) if land else pi)

    return fly


def balanced_sample(units: DataFrame, seed: int = 17, block: int = BLOCK) -> DataFrame:
    """Round the probabilities of ``units`` by the cube method, source by source.

    ``units`` has ``unit`` (a string that tells units of a source apart), ``rank`` (of the
    source), ``size`` and ``pi``.  Returns ``unit, rank, chosen``.
    """
    open_ = units.select("unit", "rank", "size", F.xxhash64("unit", F.lit(seed)).alias("order"), "pi")
    decided = []
    round_ = 0
    while True:  # a round leaves two units of a block undecided at most
        n = open_.groupBy("rank").agg(F.count("*").alias("_n"))
        n = written(n.select("rank", F.ceil(F.col("_n") / block).alias("_blocks")), "blocks")
        most = n.agg(F.max("_blocks")).first()[0] or 0
        # number of sources checked against the limit before a broadcast
        n = F.broadcast(n) if n.count() <= BROADCAST_SOURCES else n
        part = F.when(F.col("_blocks") == 1, F.lit(0)).otherwise(
            F.pmod(F.xxhash64("unit", F.lit(seed + 1 + round_)), F.col("_blocks"))
        )
        blocks = open_.join(n, "rank").withColumn("_block", part)
        groups = blocks.groupBy("rank", "_block", (F.col("_blocks") == 1).alias("_land"))
        done = written(groups.applyInPandas(_fly(seed, round_), open_.schema), "flight")
        decided.append(done.where(F.col("pi").isin(0.0, 1.0)))
        if most <= 1:
            break
        open_ = done.where(~F.col("pi").isin(0.0, 1.0))
        round_ += 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    return out.select("unit", "rank", (F.col("pi") == 1.0).alias("chosen"))


def mix_sources(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    max_repeats: int = MAX_REPEATS,
    seed: int = 17,
    block: int = BLOCK,
) -> DataFrame:
    """How often the mix takes each document.

    Returns ``doc_id, source, size, source_size, target, copies, taken`` for every row of
    ``docs`` (columns ``doc_id``, ``text``, ``source``).  ``size`` counts words (0 for a
    null or empty text), ``taken`` is ``copies * size`` with ``copies`` from 0 to
    ``max_repeats``.  A null source is a source of its own, ranked last.  Rows with one id
    and source are one unit and get the same ``copies``, and so do rows without an id that have
    one text and source.  Sources without words get target 0.  Runs with one seed agree.
    """
    return _planned(docs, weights, share, max_repeats, seed, block).drop("unit")


def unit_of(doc_id: Column, text: Column) -> Column:
    """What tells units of a source apart: the id, or the text of a row without one."""
    return F.coalesce(F.concat(F.lit("#"), doc_id.cast("string")), F.concat(F.lit("?"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def _planned(
    docs: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = 1.0,
    max_repeats: int = MAX_REPEATS,
    seed: int = 17,
    block: int = BLOCK,
) -> DataFrame:
    """``mix_sources`` with the ``unit`` of each row."""
    unit = unit_of(F.col("doc_id"), F.col("text")).alias("unit")
    sizes = written(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), unit), "sizes")
    targets = written(source_targets(sizes, weights, share, max_repeats), "targets")
    if targets.count() <= BROADCAST_SOURCES:
        targets = F.broadcast(targets)
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_repeats))))
    rate = F.coalesce(rate, F.lit(0.0))
    named = targets.withColumnRenamed("source", "_source")
    rows = sizes.join(named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_rate", rate)
    part = F.col("_rate") - F.floor("_rate")
    units = rows.groupBy("unit", "rank").agg(F.sum("size").alias("size"), F.first(part).alias("pi"))
    units = written(units.where(F.col("pi") > 0), "units")
    chosen = balanced_sample(units, seed, block).where("chosen").select("unit", "rank", F.lit(1).alias("_more"))
    copies = (F.floor("_rate") + F.coalesce("_more", F.lit(0))).cast("int")
    out = rows.join(chosen, ["unit", "rank"], "left").withColumn("copies", copies)
    return out.select(
        "doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "unit"
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with all their columns: one row for each time one is taken.

    Rows that ``mix_sources`` takes for one unit are taken alike, also where a unit has very many.
    """
    key = F.to_json(F.struct("source", "unit"))

    def units() -> DataFrame:
        taken = _planned(docs, **options).where(F.col("copies") > 0).groupBy(key.alias("_unit"))
        return taken.agg(F.max("copies").alias("copies"), F.count("*").alias("rows"))

    plan = stored(units, docs.sparkSession, "mix")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))  # whatever names its columns have
    unit = F.struct(F.col("row.source").alias("source"), unit_of(F.col("row.doc_id"), F.col("row.text")).alias("unit"))
    rows = rows.withColumn("_unit", F.to_json(unit))
    total = plan.agg(F.sum("rows")).first()[0] or 0
    whole = F.struct(*(F.col(f"row.`{c}`") for c in hashable(docs)))
    taken = spread_join(rows, plan, "_unit", whole, "rows", total).where(F.col("copies").isNotNull())
    return taken.select("row", F.explode(F.sequence(F.lit(1), "copies"))).select("row.*")
