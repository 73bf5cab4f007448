import hashlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from loomspark.llm import pieces, queries, wordpiece


@pytest.fixture(scope="module")
def processor():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def expected(processor, text):
    ids = processor.encode(text or "", add_bos=True, add_eos=True)
    return ids, processor.decode(ids)


def test_same_as_library(docs, processor):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in pieces.encode_documents(docs, queries.piece_model()).collect():
        ids, decoded = expected(processor, texts[r["doc_id"]])
        assert r["ids"] == ids and r["decoded"] == decoded and r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" ▁\n\tab.é漢😀"), st.characters(codec="utf-8")), max_size=40), max_size=5))
def test_any_texts(texts):
    processor = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    table = pieces.ChunkTable(processor, limit=3)
    for text, (ids, decoded) in zip(texts, pieces.encode_slice(texts, table, [1], [2])):
        assert (ids.tolist(), decoded) == expected(processor, text)


def test_edges(edge, none, processor):
    rows = pieces.encode_documents(edge, queries.piece_model()).collect()
    texts = [(r["doc_id"], r["text"]) for r in edge.collect()]
    got = sorted((str(r["doc_id"]), r["n_tokens"], r["decoded"]) for r in rows)
    want = sorted((str(i), len(expected(processor, t)[0]), expected(processor, t)[1]) for i, t in texts)
    assert got == want
    assert pieces.encode_documents(none, queries.piece_model()).count() == 0


def test_word_pieces_same_as_library(docs, edge, none, processor):
    from tokenizers import Tokenizer, models, pre_tokenizers

    first, later = wordpiece.vocabulary_of(processor)
    vocabulary = dict.fromkeys(["[UNK]", *first, *("##" + p for p in later)])
    vocabulary = {p: k for k, p in enumerate(vocabulary)}
    reference = Tokenizer(models.WordPiece(vocabulary, unk_token="[UNK]", max_input_chars_per_word=10**9))
    reference.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    for table in (docs, edge.where("doc_id is not null")):
        texts = {r["doc_id"]: r["text"] or "" for r in table.collect()}
        for r in wordpiece.token_counts(table, first, later).collect():
            out = reference.encode(texts[r["doc_id"]], add_special_tokens=False)
            unknown = sum(t == "[UNK]" for t in out.tokens)
            assert (r["n_tokens"], r["n_unknown"]) == (len(out.ids), unknown)
    assert wordpiece.token_counts(none, first, later).count() == 0


@settings(max_examples=300, deadline=None)
@given(
    st.sets(st.text("abc", min_size=1, max_size=4), max_size=8),
    st.sets(st.text("abc", min_size=1, max_size=4), max_size=8),
    st.text("abcd", max_size=12),
)
def test_automaton_is_greedy_longest_match(first, later, word):
    at, count, pieces_ = 0, 0, first
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces_), None)
        if end is None:
            count = -1
            break
        at, count, pieces_ = end, count + 1, later
    assert wordpiece.WordPieceCounter(first, later)[word] == count
