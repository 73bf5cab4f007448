"""Language identification of mixed-language text.

The script of a word narrows the languages it can be of; each of those gets a score from
the word's letter trigrams; and the Viterbi path over a text's words, with a penalty for
each switch, labels its spans.  A text's language is the one with most letters in its spans.

The model is learned from labelled rows: counts of letter trigrams by language, hashed
into a table of fixed size, and counts of letters by script.  Spark sums the counts; the
fitted model is a few arrays whose size depends on the number of languages only.
"""

from __future__ import annotations

import functools
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm._shared import bounded_batches, sliced, tidy

#: Rows of each language that the model is fitted on, about: a hash of the id picks them.
FIT_ROWS = 2000
#: Trigram counts are kept in this many hashed cells a language.
CELLS = 1 << 16
#: A text counts a trigram by the square root of its number, so that one long text with few
#: words doesn't stand for its language; kept as whole numbers, whose sums don't depend on order.
COUNT_UNIT = 16
#: Languages that a model can tell apart, which bounds its size.
MAX_LANGUAGES = 200
#: What a switch of language costs on the path, in nats.
SWITCH_PENALTY = 8.0
#: A language is a candidate for words of a script if it has this share of its letters.
SCRIPT_SHARE = 1e-4
#: Letters that are labelled at a time.
SLICE_CHARS = 1_000_000

#: Words whose letters are scored at a time; a text longer than SLICE_CHARS goes through by them.
SLICE_WORDS = 20_000
#: A document has a language if that has this share of its letters.
LEAST_SHARE = 0.5

UNDETERMINED = "und"

#: First and last code point of the ranges of scripts.
SCRIPT_RANGES = (
    ("latin", 0x0041, 0x024F),
    ("greek", 0x0370, 0x03FF),
    ("cyrillic", 0x0400, 0x052F),
    ("armenian", 0x0530, 0x058F),
    ("hebrew", 0x0590, 0x05FF),
    ("arabic", 0x0600, 0x06FF),
    ("devanagari", 0x0900, 0x097F),
    ("bengali", 0x0980, 0x09FF),
    ("tamil", 0x0B80, 0x0BFF),
    ("thai", 0x0E00, 0x0E7F),
    ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF),
    ("latin", 0x1E00, 0x1EFF),
    ("greek", 0x1F00, 0x1FFF),
    ("kana", 0x3040, 0x30FF),
    ("han", 0x3400, 0x9FFF),
    ("hangul", 0xAC00, 0xD7AF),
    ("han", 0x20000, 0x323AF),
)
SCRIPTS = ("other", *dict.fromkeys(name for name, _, _ in SCRIPT_RANGES))


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case, or 0 where it is no letter; its script."""
    lower = np.zeros(sys.maxunicode + 1, np.uint32)
    for k in range(sys.maxunicode + 1):
        if (c := chr(k)).isalpha():
            low = c.lower()
            lower[k] = ord(low) if len(low) == 1 else k
    script = np.zeros(sys.maxunicode + 1, np.uint8)
    for name, first, last in SCRIPT_RANGES:
        script[first : last + 1] = SCRIPTS.index(name)
    return lower, script


def _hashed(before: np.ndarray, at: np.ndarray, after: np.ndarray, cells: int) -> np.ndarray:
    x = before * np.uint32(0x9E3779B1) + at * np.uint32(0x85EBCA77) + after * np.uint32(0xC2B2AE3D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x2C1B3C6D)
    x ^= x >> np.uint32(13)
    return x & np.uint32(cells - 1)


@dataclass
class Letters:
    """The letters of some texts, joined: trigram cell and code point of each, and their words."""

    cell: np.ndarray
    code: np.ndarray  # as written
    place: np.ndarray  # of each letter in its text
    word_first: np.ndarray  # number of each word's first letter
    word_text: np.ndarray  # number of each word's text


def letters_of(texts: list[str], cells: int = CELLS) -> Letters:
    lower, _ = _tables()
    raw = np.frombuffer("\0".join(texts).encode("utf-32-le"), np.uint32)
    low = lower[raw]
    padded = np.concatenate([np.zeros(1, np.uint32), low, np.zeros(1, np.uint32)])
    where = np.flatnonzero(low)
    cell = _hashed(padded[where], low[where], padded[where + 2], cells)
    first = np.flatnonzero(padded[where] == 0)  # nothing, or no letter, before it
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    begins = np.cumsum(lengths) - lengths
    text = np.searchsorted(begins, where, side="right") - 1
    return Letters(cell, raw[where], where - begins[text], first, text[first])


@dataclass
class Model:
    languages: list[str]
    score: np.ndarray  # cells x languages: log probability of a trigram
    allowed: np.ndarray  # scripts x languages
    prior: np.ndarray


# ---- fitting ---------------------------------------------------------------------------
def fit(labelled: DataFrame, rows: int = FIT_ROWS, cells: int = CELLS) -> Model:
    """Learn from ``text`` and ``lang`` of about ``rows`` rows of each language.

    A hash of the id takes them, so that reruns agree; where a language has fewer, all are
    used.  Rows whose language is null are left out.  More than MAX_LANGUAGES languages are an
    error.
    """
    bounded_batches(labelled.sparkSession)
    known = labelled.where(F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    counts = known.groupBy("lang").count().orderBy("lang").limit(MAX_LANGUAGES + 1).collect()
    languages = [r["lang"] for r in counts]
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = {r["lang"]: int(1_000_000 * rows / r["count"]) for r in counts if r["count"] > rows}
    if share:
        most = F.create_map(*(F.lit(x) for pair in share.items() for x in pair))[F.col("lang")]
        part = F.pmod(F.xxhash64("doc_id", "text", F.lit("fit")), F.lit(1_000_000))
        known = known.where(most.isNull() | (part < most))
    index = {x: k for k, x in enumerate(languages)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, script = _tables()
        grams = np.zeros((len(languages), cells), np.int64)
        scripts = np.zeros((len(languages), len(SCRIPTS)), np.int64)
        docs = np.zeros(len(languages), np.int64)
        for part in sliced(batches, 0):
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                found = letters_of([text or ""], cells)
                own, n = np.unique(found.cell, return_counts=True)
                grams[index[lang], own] += np.rint(COUNT_UNIT * np.sqrt(n)).astype(np.int64)
                scripts[index[lang]] += np.bincount(script[found.code], minlength=len(SCRIPTS))
                docs[index[lang]] += 1
        for kind, table in (("g", grams), ("s", scripts), ("d", docs[:, None])):
            lang, cell = np.nonzero(table)
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind] * len(lang), pa.string()), pa.array(lang), pa.array(cell), pa.array(table[lang, cell])],
                names=["kind", "lang", "cell", "n"],
            )

    counted = known.select("text", "lang").mapInArrow(tidy(count), "kind string, lang bigint, cell bigint, n bigint")
    # at most languages x (cells + scripts + 1) sums
    sums = counted.groupBy("kind", "lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    kind = sums["kind"].to_numpy(zero_copy_only=False)
    tables = {}
    for k, width in (("g", cells), ("s", len(SCRIPTS)), ("d", 1)):
        tables[k] = np.zeros((len(languages), width))
        own = kind == k
        tables[k][sums["lang"].to_numpy()[own], sums["cell"].to_numpy()[own]] = sums["n"].to_numpy()[own]
    grams = tables["g"] / COUNT_UNIT + 0.1
    share = tables["s"] / np.maximum(tables["s"].sum(axis=1, keepdims=True), 1)
    allowed = (share >= SCRIPT_SHARE).T
    allowed |= ~allowed.any(axis=1, keepdims=True)  # an unknown script excludes none
    return Model(
        languages,
        np.log(grams / grams.sum(axis=1, keepdims=True)).T.astype(np.float32),
        allowed,
        (tables["d"][:, 0] + 1) / (tables["d"].sum() + len(languages)) if languages else np.empty(0),
    )


# ---- labelling -------------------------------------------------------------------------
def viterbi(emission: np.ndarray, first: np.ndarray, length: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of each word, of many texts at once.

    Text ``k`` has words ``first[k]`` to ``first[k] + length[k]``; a path gains the
    emission of each word's label and loses ``penalty`` for each change of label.  The texts
    move on together, longest first, so that those that have ended drop off the end.
    """
    n, labels = emission.shape
    order = np.argsort(-length, kind="stable")
    first, length = first[order], length[order]
    from_ = np.empty((n, labels), np.uint8)
    own = np.arange(labels, dtype=np.uint8)
    running = np.searchsorted(-length, -np.arange(length[0] if len(length) else 0), side="left")
    state = np.zeros((len(first), labels), np.float32)
    for t, active in enumerate(running):
        at = first[:active] + t
        now = state[:active]
        best = now.argmax(axis=1)
        top = now[np.arange(active), best] - penalty
        switch = now < top[:, None]
        from_[at] = np.where(switch, best[:, None].astype(np.uint8), own)
        state[:active] = np.where(switch, top[:, None], now) + emission[at]
    label = np.empty(n, np.uint8)
    here = state.argmax(axis=1)
    for t in range(len(running) - 1, -1, -1):
        active = running[t]
        at = first[:active] + t
        label[at] = here[:active]
        here[:active] = from_[at, here[:active]]
    return label


def label_texts(texts: list[str], model: Model, penalty: float = SWITCH_PENALTY) -> tuple:
    """Words' text, first letter's place, end, number of letters and label."""
    _, script = _tables()
    found = letters_of(texts, len(model.score))
    words = len(found.word_first)
    if not words:
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    # a bounded number of words at a time: letters have as many scores as there are languages
    bounds = np.append(found.word_first, len(found.cell))
    emission = np.empty((words, len(model.languages)), np.float32)
    for i in range(0, words, SLICE_WORDS):
        since, to = bounds[i], bounds[min(i + SLICE_WORDS, words)]
        starts = bounds[i : min(i + SLICE_WORDS, words)] - since
        emission[i : i + SLICE_WORDS] = np.add.reduceat(model.score[found.cell[since:to]], starts, axis=0)
    # a word says no more than so much against a language, however long it is
    emission = np.maximum(emission - emission.max(axis=1, keepdims=True), -20)
    emission[~model.allowed[script[found.code[found.word_first]]]] = -60
    n_letters = np.diff(found.word_first, append=len(found.code))
    text, since, count = np.unique(found.word_text, return_index=True, return_counts=True)
    label = viterbi(emission, since, count, penalty)
    begin = found.place[found.word_first]
    return found.word_text, begin, begin + n_letters, n_letters, label


def _by_length(texts: list[str], chars: int) -> Iterator[np.ndarray]:
    """Numbers of texts of like length, in slices of about so many characters."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(lengths, kind="stable")
    slice_ = np.cumsum(lengths[order] + 1) // chars
    return iter(np.split(order, np.flatnonzero(np.diff(slice_)) + 1))


def predict(texts: list[str], model: Model, penalty: float = SWITCH_PENALTY) -> tuple:
    """Number of each text's language (-1: none), its share of the letters, and the spans."""
    languages = len(model.languages)
    pred, score = np.full(len(texts), -1), np.zeros(len(texts))
    spans: list[list[dict]] = [[] for _ in texts]
    ranked = np.argsort(-model.prior, kind="stable")
    chars = SLICE_CHARS * 8 // max(8, languages)
    for numbers in _by_length(texts, chars) if languages and texts else ():
        text, begin, end, letters, label = label_texts([texts[k] for k in numbers], model, penalty)
        votes = np.bincount(text * languages + label, letters, len(numbers) * languages)
        votes = votes.reshape(len(numbers), languages)
        total = votes.sum(axis=1)
        top = ranked[votes[:, ranked].argmax(axis=1)]
        has = total > 0
        pred[numbers[has]] = top[has]
        score[numbers[has]] = (votes[np.arange(len(numbers)), top] / np.maximum(total, 1))[has]
        new = (np.diff(text, prepend=-1) != 0) | (np.diff(label.astype(np.int64), prepend=-1) != 0)
        starts = np.flatnonzero(new)
        stops = np.append(starts[1:], len(text)) - 1
        for a, b in zip(starts.tolist(), stops.tolist()):
            lang = model.languages[label[a]]
            spans[numbers[text[a]]].append({"start": int(begin[a]), "end": int(end[b]), "lang": lang})
    return pred, score, spans


def identify_languages(docs: DataFrame, model: Model, penalty: float = SWITCH_PENALTY) -> DataFrame:
    """Language and labelled spans of every text.

    Returns ``doc_id, lang_pred, score, spans`` for every row (columns ``doc_id`` and
    ``text``; others are ignored).  ``score`` is the share of the text's letters in spans
    of its language; ties go to the language with more training rows, then by name.
    ``spans`` are (start, end, lang) from the first to behind the last letter, in code
    points.  A text that is null or has no letter, or any text where the model knows no
    language, is ``und`` with score 0 and no spans.
    """
    bounded_batches(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    box = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))

    def identify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [*box.value.languages, UNDETERMINED]
        for part in sliced(batches, 1):
            pred, score, spans = predict([t or "" for t in part.column(1).to_pylist()], box.value, penalty)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([names[k] for k in pred], pa.string()), pa.array(score), pa.array(spans, span_type)],
                names=["doc_id", "lang_pred", "score", "spans"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        tidy(identify),
        f"doc_id {id_type}, lang_pred string, score double, spans array<struct<start:int,end:int,lang:string>>",
    )


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training: by the CRC of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on_documents(docs: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learn from the documents that aren't held out."""
    return fit(docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"), rows)


def drop_unidentified(docs: DataFrame, penalty: float = SWITCH_PENALTY, least_share: float = LEAST_SHARE) -> DataFrame:
    """The documents whose text has a language, with all their columns.

    The labels serve to learn from only.  A document goes if its text is null or has no
    letter, or if no language has ``least_share`` of its letters on the labelled path.  Where no
    row has a label there is no language to tell, and only texts without letters go.
    """
    model = fit_on_documents(docs)
    if not model.languages:
        return docs.where(F.coalesce(F.col("text"), F.lit("")).rlike(r"\p{L}"))
    box = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in sliced(batches, at):
            pred, score, _ = predict([t or "" for t in part.column(at).to_pylist()], box.value, penalty)
            yield part.filter(pa.array((pred >= 0) & (score >= least_share)))

    return docs.mapInArrow(tidy(keep), docs.schema)
