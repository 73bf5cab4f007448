import collections
import gc
import hashlib
import json
import tracemalloc

import numpy as np
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st
from loomspark.llm import alignment, queries
from pyspark.sql import functions as F
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def models():
    return queries.byte_tokenizer(), queries.piece_model()


@pytest.fixture(scope="module")
def pair(models):
    return alignment.Pair(*models)


@pytest.fixture(scope="module")
def library(models):
    """A as the library of its file runs it."""
    a = Tokenizer.from_str(models[0])
    a.encode_special_tokens = True
    return a


@pytest.fixture(autouse=True)
def _library(library, pair):
    pair.a = library


def brute_tokens(pair, text):
    """Ids and ends of both tokenizers over the whole text at once; none if the bytes differ."""
    raw = f" {text}".encode() if text else b""
    if not raw:
        return None
    a = pair.a.encode(f" {text}", add_special_tokens=False).ids
    b = pair.b.encode(text)
    if b"".join(pair.a_bytes[k] for k in a) != raw or b"".join(pair.b_bytes[k] for k in b) != raw:
        return None
    ends = [np.cumsum([len(sizes[k]) for k in ids]).tolist() for ids, sizes in ((a, pair.a_bytes), (b, pair.b_bytes))]
    return a, b, *ends


def brute_document(pair, text):
    """Groups as text, and the links as pairs of ids, by going over both lists of tokens."""
    if (found := brute_tokens(pair, text)) is None:
        return 0, 0, [], []
    a, b, a_ends, b_ends = found
    # the tokens that hold each byte; a pair of tokens is linked once
    held = zip(*(np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0)).tolist() for ends in (a_ends, b_ends)))
    links = [(a[x], b[y]) for x, y in dict.fromkeys(held)]
    groups, cuts = [], sorted(set(a_ends) & set(b_ends))
    at = [0, 0]
    for to in cuts:
        since, at = at, [ends.index(to, k) + 1 for ends, k in zip((a_ends, b_ends), at)]
        mine = [",".join(map(str, ids[s:e])) for ids, s, e in zip((a, b), since, at)]
        groups.append("|".join(mine))
    return len(a), len(b), groups, links


def brute(pair, rows):
    docs = [(doc_id, *brute_document(pair, text)) for doc_id, text in rows]
    count = collections.Counter(link for *_, links in docs for link in links)
    best = collections.Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (doc_id, n_a, n_b, len(groups), len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), ";".join(groups))
        for doc_id, n_a, n_b, groups, links in docs
    ]


ODD = [
    "<|endoftext|> <s> </s> <unk> <0x41>", "a\n b \t c  d   ", "  \n  ", " ", "\x00 a\x00b", "▁ mark ▁▁", "ﬁ Á ﷺ 　x　 y", "\xa0 z\xa0",
    "don't  I'll 123 4567!!! ???", "\x1c a \x1c b\x85 c", "😀😀 𝔘nicode Straße", "x" * 3000, "\r\n\r\n  a\r\n b", "日本語 の テスト",
]


@given(st.text(alphabet=st.sampled_from("ab é\n\t ▁　\xa0'1!<>|日😀\x00\x1c\x85"), max_size=40))
@example("".join(ODD))
@settings(max_examples=300, deadline=None)
def test_chunks_are_encoded_as_whole_texts_are(pair, text):
    """Ids and cuts from the table of chunks equal those of the libraries on the text."""
    counts = alignment.Counts([], [], np.empty(0, np.int64), np.zeros(40_000, np.int64))
    table = alignment.Chunks(pair, counts)
    numbers, ends, has = table.numbered([text.encode()])
    n_a, n_b, groups, links = brute_document(pair, text)
    assert has[0] == (n_a > 0)
    if has[0]:
        assert ";".join(table.groups[k] for k in numbers) == ";".join(groups)
        assert table.figures[numbers].sum(axis=0)[:4].tolist() == [n_a, n_b, len(groups), len(links)]


def test_query_equals_brute_force(spark, sf_dir, pair):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:-1], hashlib.sha256(r[-1].encode()).hexdigest() if r[1] else "") for r in brute(pair, rows)]
    assert sorted(tuple(r) for r in queries.op13_alignment(spark, sf_dir).collect()) == sorted(want)


def test_edge_cases(spark, edge, none, models, pair):
    keep = edge.where("doc_id is null or doc_id <> 8")
    odd = spark.createDataFrame([(100 + k, t) for k, t in enumerate(ODD)], "doc_id bigint, text string")
    table = keep.select("doc_id", "text", "size", "n", F.lit("x").alias("groups")).unionByName(odd, allowMissingColumns=True)
    rows = [(r["doc_id"], r["text"]) for r in table.collect()]
    for block_keys in (alignment.BLOCK_KEYS, 3):
        got = [tuple(r) for r in alignment.align_tokens(table, *models, block_keys=block_keys).collect()]
        assert sorted(got, key=str) == sorted(brute(pair, rows), key=str)
    assert alignment.align_tokens(none, *models).count() == 0
    broken = spark.sql("SELECT 1L AS doc_id, CAST(X'61FF62' AS STRING) AS text")
    assert alignment.align_tokens(broken, *models).collect()[0][1:] == (0, 0, 0, 0, 0, 0, "")
    # one very long text of many words
    long = edge.where("doc_id = 8")
    r = alignment.align_tokens(long, *models).first()
    whole = pair.b.encode(long.first()["text"])
    assert r["n_b"] == len(whole) and r["n_a"] == len(pair.a.encode(" " + long.first()["text"]).ids)


def test_small_tables_and_kept_blocks(spark, docs, models, monkeypatch):
    """Tables of chunks that start afresh, and files that can't be mapped, change nothing."""
    few = docs.where("doc_id % 5 = 0")
    table = alignment.Chunks(alignment.load_pair(*models))
    texts = [r["text"].encode() for r in few.where("text is not null").select("text").collect()]
    table.count(texts)
    keys, n = table.partial_counts()
    counts = alignment.stored_counts(spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys, n)] * 2, "key bigint, n bigint"), 32_000, 50)
    assert len(counts.firsts) > 4 and (np.diff(counts.firsts) > 0).all()
    found, best = counts.of(keys)
    assert (found == 2 * n).all() and best.any()
    assert counts.of(np.array([(31_999 << 32) + 1]))[0].tolist() == [0]

    class Remote:
        type_name = "remote"

        def __init__(self, files):
            self.open_input_file = files.open_input_file

    real = alignment.arrow_filesystem
    monkeypatch.setattr(alignment, "arrow_filesystem", lambda p: (Remote(real(p)[0]), real(p)[1]))
    assert (counts.of(keys)[0] == found).all() and len(counts._kept) <= alignment.KEPT_BLOCKS
    monkeypatch.undo()
    # tables that start afresh after each text count the same
    pieces = collections.Counter()
    for text in texts:
        table.reset()
        table.count([text])
        pieces.update(dict(zip(*(x.tolist() for x in table.partial_counts()))))
    assert pieces == dict(zip(keys.tolist(), n.tolist()))


def test_model_that_crosses_marks_is_an_error(spark, none, models, monkeypatch):
    monkeypatch.setattr(alignment, "splits_at_marks", lambda p: False)
    with pytest.raises(ValueError):
        alignment.align_tokens(none, *models)


def test_other_merges_are_run_by_the_library(models, pair):
    """A vocabulary whose merges come in another order than their ids is encoded by ``tokenizers``."""
    parts = json.loads(models[0])
    merges = parts["model"]["merges"]
    merges[0], merges[1] = merges[1], merges[0]
    other = alignment.Pair(json.dumps(parts), models[1])
    text = " the  quick <|endoftext|> fox's\n"
    assert pair.encode_a.__self__.__class__.__name__ == "Encoding" and other.encode_a.__name__ == "<lambda>"
    assert b"".join(other.a_bytes[k] for k in other.encode_a(text)) == text.encode()


def test_a_table_that_starts_afresh_holds_nothing_of_before(pair):
    """Ids of chunks go with their table, not only when Python looks for cycles: memory of a task
    doesn't grow with its texts."""
    table = alignment.Chunks(pair)
    held = []
    gc.collect()
    gc.disable()
    tracemalloc.start()
    try:
        for k in range(5):
            table.count([" ".join(f"word{k}x{i}" for i in range(5000)).encode(), "a b\x00 ▁c ﬁ \t".encode()])
            assert table.partial_counts()[1].sum() > 5000
            table.reset()
            held.append(tracemalloc.get_traced_memory()[0])
    finally:
        tracemalloc.stop()
        gc.enable()
    assert held[-1] - held[0] < 100_000
