import zlib

import numpy as np
from pyspark.sql import functions as F
from loomspark.llm import langid


def best_path(emission, penalty):
    """All paths of one text, by plain dynamic programming."""
    state = [(0.0, ())] * emission.shape[1]
    for e in emission:
        new = []
        for b in range(len(state)):
            score, path = max(((s - penalty * (a != b and bool(p)), p) for a, (s, p) in enumerate(state)), key=lambda x: x[0])
            new.append((score + e[b], (*path, b)))
        state = new
    return max(x[0] for x in state)


def path_score(emission, label, penalty):
    return emission[np.arange(len(label)), label].sum() - penalty * (np.diff(label) != 0).sum()


def test_viterbi_finds_best_paths():
    rng = np.random.default_rng(1)
    length = rng.integers(1, 9, 40)
    first = np.cumsum(length) - length
    emission = rng.normal(0, 3, (length.sum(), 3)).astype(np.float32)
    label = langid.viterbi(emission, first, length, 2.0)
    for a, n in zip(first, length):
        own = emission[a : a + n].astype(float)
        assert abs(path_score(own, label[a : a + n].astype(int), 2.0) - best_path(own, 2.0)) < 1e-3


def test_held_out_accuracy(spark, docs):
    model = langid.fit_on_documents(docs)
    found = {r["doc_id"]: r for r in langid.identify_languages(docs, model).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    held = [r for r in rows if zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1]
    flags = {r[0]: r[1] for r in docs.select("doc_id", langid.held_out(docs.doc_id)).collect()}
    assert {k for k, v in flags.items() if v} == {r["doc_id"] for r in held}
    right = sum(found[r["doc_id"]]["lang_pred"] == r["lang"] for r in held)
    assert right / len(held) > 0.97
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_spans_of_mixed_text(spark, docs):
    model = langid.fit_on_documents(docs)
    en, fr = (
        next(r["text"] for r in docs.where(f"lang = '{x}' and n_chars between 300 and 3000").orderBy("doc_id").collect())[:300]
        for x in ("en", "fr")
    )
    mixed = spark.createDataFrame([(1, f"{en} {fr}")], "doc_id bigint, text string")
    (row,) = langid.identify_languages(mixed, model).collect()
    assert [s["lang"] for s in row["spans"]] == ["en", "fr"]
    assert abs(row["spans"][1]["start"] - 300) < 20
    assert 0.4 < row["score"] < 0.6


def test_scripts_narrow_candidates(spark):
    rows = [(k, "это простой русский текст", "ru") for k in range(5)] + [(k + 5, "this is plain text", "en") for k in range(5)]
    model = langid.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"))
    texts = spark.createDataFrame([(1, "ъъъ жжж"), (2, "zzz qqq"), (3, "漢字")], "doc_id bigint, text string")
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(texts, model).collect()}
    assert found[1] == "ru" and found[2] == "en" and found[3] in ("en", "ru")


def test_edges(edge, none):
    model = langid.fit_on_documents(edge)
    rows = langid.identify_languages(edge, model).collect()
    assert len(rows) == edge.count()
    by = {r["doc_id"]: r for r in rows}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (4, 5, 6, 7))
    assert by[9]["lang_pred"] == "de"
    kept = langid.drop_unidentified(edge)
    assert kept.columns == edge.columns
    assert {r["doc_id"] for r in kept.collect()} == {1, 2, 3, 8, 9, 10, 11, 12, None}
    assert langid.identify_languages(none, langid.fit_on_documents(none)).count() == 0
    unknown = langid.identify_languages(edge, langid.fit_on_documents(none)).collect()
    assert {r["lang_pred"] for r in unknown} == {"und"}


def test_rare_and_unnamed_languages(spark):
    """A language with few rows is learned beside one with very many, and so is one whose name is empty."""
    rows = [(k, f"the house of the river number and then {k}", "en") for k in range(3000)]
    rows += [(5000 + k, "yksi kaksi kolme neljä viisi kuusi seitsemän", "fi") for k in range(4)]
    rows += [(6000 + k, "ένα δύο τρία τέσσερα", "") for k in range(4)] + [(7000, "the river and the house", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    model = langid.fit(table, rows=200)
    assert model.languages == ["", "en", "fi"]
    found = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(table, model).collect()}
    assert found[5001] == "fi" and found[6001] == "" and found[7000] == "en"


def test_long_texts_go_by_slices(spark, monkeypatch):
    model = langid.fit(spark.createDataFrame([(1, "the river bank", "en"), (2, "der braune Fuchs", "de")], "doc_id long, text string, lang string"))
    texts = ["the river " * 300 + "der braune Fuchs " * 200, "bank", "", "Fuchs der"]
    whole = langid.label_texts(texts, model)
    monkeypatch.setattr(langid, "SLICE_WORDS", 7)
    assert all((a == b).all() for a, b in zip(whole, langid.label_texts(texts, model)))


def test_documents_without_a_language_go(spark):
    rows = [(1, "the house of the river", "en"), (2, None, "en"), (3, "123 !", None), (4, "the river", None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert sorted(r["doc_id"] for r in langid.drop_unidentified(table).collect()) == [1, 4]
    bare = table.withColumn("lang", F.lit(None).cast("string"))
    assert sorted(r["doc_id"] for r in langid.drop_unidentified(bare).collect()) == [1, 4]
