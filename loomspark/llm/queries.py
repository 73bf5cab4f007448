"""The registered queries of this subpackage's operators, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import alignment, ann, audit, digests, jaccard, langid, mix, pieces, pii, shards, simhash, warc, wordpiece
from loomspark.llm._shared import shared_dir

#: Arrivals that the documents are appended in.
ARRIVALS = 8


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def piece_model() -> bytes:
    """The SentencePiece model of the queries, read on the driver and shipped to the tasks."""
    import public_tokenizers

    return Path(public_tokenizers.path("piece_bpe_32k.model")).read_bytes()


def byte_tokenizer() -> str:
    """The byte-level BPE of the queries."""
    import public_tokenizers

    return Path(public_tokenizers.path("byte_bpe_50k.json")).read_text()


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    found = langid.identify_languages(docs, langid.fit_on_documents(docs))
    return found.select(
        "doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score",
        F.size("spans").cast("long").alias("n_spans"),
    )


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = shards.ShardStore(spark, shared_dir(spark, "shards"))
    docs = _table(spark, sf_dir, "documents")
    store.append_arrivals(docs, shards.row_batches(docs, ARRIVALS))
    store.vacuum()
    text = F.coalesce("text", F.lit("")).cast("binary")
    return store.read().select("doc_id", "lang", "source", "n_chars", F.sha2(text, 256).alias("text_sha256"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pieces.encode_documents(_table(spark, sf_dir, "documents"), piece_model())
    return done.select(
        "doc_id", "n_tokens", "ids_sha256", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similarity_classes(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, later = wordpiece.vocabulary_of(pieces.load_model(piece_model()))
    return wordpiece.token_counts(_table(spark, sf_dir, "documents"), first, later)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(_table(spark, sf_dir, "documents"))
    counts = (
        F.expr(f"bigint(size(filter(base, x -> x.k = {n})))").alias(f"n_{kind}") for n, kind in enumerate(pii.KINDS)
    )
    return found.select(
        "doc_id",
        *counts,
        F.sha2(F.expr(pii.span_text("base")).cast("binary"), 256).alias("base_sha256"),
        F.expr(pii.span_text("array_sort(concat(base, added))")).alias("spans"),
    )


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    warc.archive_pages(_table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder)


def op10_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest_neighbours(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_audit(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.align_tokens(_table(spark, sf_dir, "documents"), byte_tokenizer(), piece_model())
    digest = F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")
    return found.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256")
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_language_id,
        op2_sharding,
        op3_sentencepiece,
        op4_ngram_jaccard,
        op5_mixing,
        op6_token_counts,
        op7_pii,
        op8_exact_dedup,
        op9_warc,
        op10_nearest,
        op11_simhash,
        op12_filter_audit,
        op13_alignment,
    )
}

_SPACES = r"[\x20\x09-\x0D]"

ORACLE_SQL: dict[str, str] = {
    "op2_sharding": """
        SELECT doc_id, lang, source, n_chars, sha256(coalesce(text, '')) AS text_sha256 FROM documents""",
    "op8_exact_dedup": f"""
        WITH rows AS (
          SELECT doc_id, length(coalesce(text, '')) AS chars,
                 sha256(regexp_replace(coalesce(text, ''), '{_SPACES}', '', 'g')) AS text_sha256
          FROM documents),
        kept AS (
          SELECT *, first_value(doc_id) OVER (
                      PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
                 count(*) OVER (PARTITION BY text_sha256) AS group_size
          FROM rows)
        SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM kept""",
    "op9_warc": """
        WITH rows AS (
          SELECT page_id, coalesce(html, '') AS html,
                 octet_length(encode(coalesce(html, ''))) AS payload_bytes FROM pages),
        marked AS (
          SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS first_id
          FROM rows)
        SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
        FROM marked""",
    "op12_filter_audit": f"""
        WITH RECURSIVE docs AS (
          SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
        words AS (SELECT *, regexp_extract_all(text, '[^{_SPACES[1:-1]}]+') AS words FROM docs),
        said AS (
          SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY doc_id),
        failed AS (
          SELECT words.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
            list_filter(['A', 'B', 'C', 'D', 'E'], lambda f, i: [
              len(words) < 200,
              100 * len(list_distinct(words)) < 50 * len(words),
              100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 2 * length(text),
              regexp_matches(text, '[#$%&*|]'),
              coalesce(words.doc_id > min(words.doc_id) OVER (PARTITION BY text),
                       words.doc_id IS NULL AND min(words.doc_id) OVER (PARTITION BY text) IS NOT NULL)][i]) AS fails
          FROM words LEFT JOIN said USING (doc_id)),
        orders AS (
          SELECT '' AS filter_order
          UNION ALL
          SELECT filter_order || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f)
          WHERE NOT contains(filter_order, f)),
        steps AS (
          SELECT filter_order, CAST(step AS INT) AS step, filter_order[step] AS own, string_split(left(filter_order, step - 1), '') AS before
          FROM orders, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
        kinds AS (
          SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM failed GROUP BY part, fails),
        figures AS (
          SELECT part, filter_order, step, own,
            sum(n) FILTER (NOT list_contains(fails, own) AND NOT list_has_any(fails, before)) AS kept,
            sum(n) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)) AS removed,
            sum(n) FILTER (list_contains(fails, own) AND list_has_any(fails, before)) AS redundant,
            sum(n) FILTER (fails = [own]) AS unique_fails,
            sum(good) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)) AS good_lost,
            sum(toxic) FILTER (list_contains(fails, own) AND NOT list_has_any(fails, before)) AS toxic_lost
          FROM kinds, steps GROUP BY ALL)
        SELECT part, filter_order, step,
          {", ".join(f"CAST(coalesce({c}, 0) AS BIGINT) AS {c}" for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))},
          CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
        FROM figures""",
}
