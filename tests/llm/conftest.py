import pytest
from pyspark.sql import types as T

LONG = " ".join(f"word{k % 977} und{k % 13}" for k in range(60_000))

#: Nulls, empty and very long texts, ties, repeated rows, rows without an id.
ROWS = [
    (1, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "a"),
    (2, "The quick brown fox jumps over the lazy dog near the river bank today", "en", "b"),
    (3, "The  quick brown fox jumps over\tthe lazy dog near the river bank today ", "en", None),
    (4, None, "en", "a"),
    (5, "", None, "a"),
    (6, " \t\n\x0b\f\r", "de", "b"),
    (7, "12345 !!! ...", "de", None),
    (8, LONG, "de", "c"),
    (9, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
    (9, "Der schnelle braune Fuchs springt über den faulen Hund", "de", "b"),
    (10, "kurz", None, "c"),
    (None, "ein Text ohne Nummer, der sonst nichts hat", "de", "b"),
    (None, None, None, None),
    (11, "mail a@b.co or c_d@e.f.g, ip 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111, call +1 (555) 123-4567", "en", "a"),
    (12, "Straße über 𝔘nicode 😀 a@b.co 😀 +49 30 1234567890", "de", "a"),
]
EXTRA = (
    "size", "digest", "keep_id", "score", "n", "keys", "copies", "unit", "rank", "target", "base", "chars", "total",
    "kept", "spans", "class_id", "group_size", "block", "pi", "t", "value", "_id", "_copies", "row", "col",
)


@pytest.fixture(scope="session")
def edge(spark):
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in ("text", "lang", "source")]
        + [T.StructField("n_chars", T.LongType())]
        + [T.StructField(c, T.StringType()) for c in EXTRA]
    )
    rows = [(*r, len(r[1] or ""), *("x" for _ in EXTRA)) for r in ROWS]
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def none(spark, edge):
    return spark.createDataFrame([], edge.schema)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
