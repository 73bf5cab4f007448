"""How filters act on each other, in every order that they can be applied in.

Each document gets a mask of the filters that it fails.  Only the filter of copies looks beyond
the document: rows are sorted by ranges of text fingerprint, full text and id, so equal texts lie
side by side, however many there are, and each row is compared with the one before it.  Where a
partition starts, a text may go on from the partition before: rows at such a start wait for the
first row of their text, which is among the first or last rows of some partition.  Masks are then
counted by part, and every order's figures are sums of those counts.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._shared import SPACE_CLASS, bounded_batches, tidy, written

COPIES = "E"
FILTERS = "ABCD" + COPIES


def text_failures(text: Column) -> dict[str, Column]:
    """What the filters that look at one text hold against it."""
    words = F.filter(F.split(text, f"[{SPACE_CLASS}]+"), lambda w: w != "")
    capitals = F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)).cast("long") < 50 * F.size(words).cast("long"),
        "C": 100 * capitals.cast("long") > 2 * F.char_length(text).cast("long"),
        "D": F.char_length(text) > F.char_length(F.translate(text, "#$%&*|", "")),
    }


_ROWS = "place int, kind int, digest binary, id {id}, part string, mask int"
#: What a row of the sorted pass is: one whose mask is whole, one at the start of a partition that
#: waits, or the first row of the first or last text of a partition.
_WHOLE, _WAITS, _EDGE = range(3)


def _compare(bit: int, id_type: pa.DataType):
    """Marks rows that have a smaller id before them among the rows of their text."""
    schema = pa.schema(
        [("place", pa.int32()), ("kind", pa.int32()), ("digest", pa.binary()), ("id", id_type), ("part", pa.string()), ("mask", pa.int32())]
    )

    def rows(place: int, kind: np.ndarray, batch: pa.RecordBatch, mask: np.ndarray) -> pa.RecordBatch:
        # digests are wanted where a text may go on elsewhere only
        digest = pa.array(batch.column("digest").to_pylist(), pa.binary(), mask=kind == _WHOLE)
        place = pa.array(np.full(len(kind), place, np.int32))
        return pa.RecordBatch.from_arrays(
            [place, pa.array(kind.astype(np.int32)), digest, batch.column("doc_id"), batch.column("part"), pa.array(mask.astype(np.int32))],
            schema=schema,
        )

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = TaskContext.get().partitionId()
        head = None  # the first row of the text that the last batch ended with
        at_start = True  # so far all rows are of the partition's first text and id
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            digests = batch.column("digest").to_pylist()
            ids = batch.column("doc_id").to_pylist()
            mask = batch.column("mask").to_numpy().copy()
            kind = np.full(n, _WHOLE)
            for k in range(n):
                if head is None or digests[k] != head[0]:
                    at_start = head is None
                    head = (digests[k], ids[k], batch.slice(k, 1))
                    if at_start:
                        yield rows(place, np.array([_EDGE]), head[2], np.zeros(1))
                elif ids[k] != head[1]:
                    at_start = False
                    mask[k] |= bit
                if at_start:
                    kind[k] = _WAITS
            yield rows(place, kind, batch, mask)
        if head is not None:
            yield rows(place, np.array([_EDGE]), head[2], np.zeros(1))

    return compare


def failure_masks(docs: DataFrame) -> DataFrame:
    """``doc_id, part, mask`` of every row: bit k is set if it fails ``FILTERS[k]``.

    A null text is an empty one and a null source the part ''.  A row without an id comes after all
    that have one, so it is a copy of any row with an id; rows that repeat id and text aren't
    copies of each other.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    id_type = docs.schema["doc_id"].dataType
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), text.alias("text"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    # ranges are told by fingerprint and id: bounds come to the driver, and texts would be too large
    by_id = [F.col("doc_id").isNull(), F.col("doc_id")]
    rows = rows.repartitionByRange("digest", *by_id).sortWithinPartitions("digest", "text", *by_id)
    # masks are made after the shuffle: what goes before it is also run to find the ranges
    failed = text_failures(F.col("text"))
    mask = sum((F.shiftleft(failed[f].cast("int"), k) for k, f in enumerate(FILTERS) if f != COPIES), F.lit(0))
    rows = rows.select("doc_id", "part", "digest", mask.alias("mask"))
    bit = 1 << FILTERS.index(COPIES)
    compared = rows.mapInArrow(tidy(_compare(bit, _arrow(id_type))), _ROWS.format(id=id_type.simpleString()))
    compared = written(compared, "compared")
    # two rows a partition: where a text goes on from there, its first row is among them
    edges = compared.where(F.col("kind") == _EDGE)
    edges = edges.groupBy("digest").agg(F.min("id").alias("least"))
    waits = compared.where(F.col("kind") == _WAITS).join(edges, "digest", "left")
    copied = F.coalesce(F.col("least") < F.col("id"), F.col("id").isNull() & F.col("least").isNotNull())
    waits = waits.select("id", "part", (F.col("mask") + F.when(copied, bit).otherwise(0)).alias("mask"))
    whole = compared.where(F.col("kind") == _WHOLE).select("id", "part", "mask")
    return whole.unionByName(waits).withColumnRenamed("id", "doc_id")


def _arrow(kind) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def mask_counts(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, mask, n, good, toxic``: documents of each mask, and those labelled good or toxic.

    An id that has several labels counts as good if one says so, and likewise as toxic; labels
    without an id count for nothing.
    """
    plain = masks.groupBy("part", "mask").agg(F.count("*").alias("n"))
    said = labels.groupBy("doc_id").agg(
        F.bool_or(F.col("quality") == 1).cast("int").alias("good"), F.bool_or(F.col("toxic") == 1).cast("int").alias("toxic")
    )
    said = said.where((F.col("good") == 1) | (F.col("toxic") == 1))
    # narrow rows, and an id that comes very often is split as Spark splits skewed joins
    labelled = masks.join(said, "doc_id").groupBy("part", "mask")
    labelled = labelled.agg(*(F.sum(c).alias(c) for c in ("good", "toxic")))
    both = plain.join(labelled, ["part", "mask"], "left")
    return both.select("part", "mask", "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))


def order_figures(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Figures of every step of every order of the filters, for each part: one row a part holds the
    counts of all masks, from which they are sums."""
    masks = range(1 << len(filters))
    by_mask = [
        F.array(*(F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)) for m in masks)).alias(c)
        for c in ("n", "good", "toxic")
    ]
    parts = counts.groupBy("part").agg(*by_mask)

    def total(column: str, mask_test: str) -> Column:
        return F.expr(f"aggregate(filter(sequence(0, {len(masks) - 1}), m -> {mask_test}), 0L, (s, m) -> s + {column}[m])")

    orders = ["".join(order) for order in permutations(filters)]
    rows = parts.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ",")))
    rows = rows.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))))
    bit = f"shiftleft(1, instr('{filters}', substring(filter_order, %s, 1)) - 1)"
    rows = rows.withColumns({"own": F.expr(bit % "step"), "gone": F.expr(
        f"aggregate(filter(sequence(1, {len(filters)}), k -> k < step), 0, (s, k) -> s | {bit % 'k'})"
    )})
    removed = "(m & own) != 0 and (m & gone) = 0"
    # of the orders, those in which a filter comes before the others that a document fails
    turns = " + ".join(f"({len(orders)} div bit_count(m)) * int(bit_count(m) = {k})" for k in range(1, len(filters) + 1))
    shapley = F.expr(
        f"aggregate(filter(sequence(1, {len(masks) - 1}), m -> (m & own) != 0), 0L, (s, m) -> s + n[m] * ({turns}))"
    )
    return rows.select(
        "part", "filter_order", "step",
        total("n", "(m & (own | gone)) = 0").alias("kept"),
        total("n", removed).alias("removed"),
        total("n", "(m & own) != 0 and (m & gone) != 0").alias("redundant"),
        F.expr("n[own]").alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    shapley``: one row for each part, order of the filters and step.

    ``docs`` has ``doc_id, text, source`` and ``labels`` ``doc_id, quality, toxic``; other columns
    are ignored.  An empty table of documents gives no rows, an empty table of labels no losses.
    ``failure_masks`` and ``mask_counts`` say how nulls, ties and repeats count.
    """
    return order_figures(mask_counts(failure_masks(docs), labels))
