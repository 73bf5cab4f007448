"""Word-piece token counts by a linear longest-match automaton.

Greedy longest-match-first segmentation in one pass over a word: a trie of the vocabulary
with, for each node, a failure link and the number of pieces that are complete when the
link is taken (Song et al., "Fast WordPiece Tokenization", 2021).  Only these numbers are
needed to count, so no piece is ever built.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomspark.llm._shared import SPACE_CLASS

#: Words whose counts a task remembers before it starts afresh, and characters of the longest.
CACHE_WORDS = 400_000
CACHE_CHARS = 64


class WordPieceCounter(dict):
    """Counts of words; the word's text is looked up, and run through the automaton if new.

    A word that the vocabulary can't spell to its end is one unknown piece; its count is
    kept as -1.
    """

    def __init__(self, first: Iterable[str], later: Iterable[str], limit: int = CACHE_WORDS):
        super().__init__()
        self.limit = limit
        # node 0 starts a word, node 1 goes on after a piece
        goto: list[dict[str, int]] = [{}, {}]
        whole = [False, False]
        for root, vocabulary in ((0, first), (1, later)):
            for piece in vocabulary:
                node = root
                for c in piece:
                    if (to := goto[node].get(c)) is None:
                        to = goto[node][c] = len(goto)
                        goto.append({})
                        whole.append(False)
                    node = to
                whole[node] = node > 1
        fail, popped = [-1] * len(goto), [0] * len(goto)
        queue = deque([0, 1])
        while queue:
            node = queue.popleft()
            for c, child in goto[node].items():
                queue.append(child)
                if whole[child]:
                    fail[child], popped[child] = 1, 1
                    continue
                at, n = fail[node], popped[node]
                while at >= 0 and c not in goto[at]:
                    at, n = fail[at], n + popped[at]
                if at >= 0:
                    fail[child], popped[child] = goto[at][c], n
        self.goto, self.fail, self.popped = goto, fail, popped

    def __missing__(self, word: str) -> int:
        goto, fail, popped = self.goto, self.fail, self.popped
        node = count = 0
        for c in word:
            while (to := goto[node].get(c)) is None:
                count += popped[node]
                node = fail[node]
                if node < 0:
                    break
            if node < 0:
                break
            node = to
        while node > 1:  # what is still open when the word ends
            count += popped[node]
            node = fail[node]
        out = count if node >= 0 else -1
        if len(word) <= CACHE_CHARS:
            if len(self) >= self.limit:
                self.clear()
            self[word] = out
        return out


def vocabulary_of(processor, mark: str = "▁") -> tuple[list[str], list[str]]:
    """Pieces that start a word, and that go on, of a SentencePiece model, as word pieces."""
    plain = (
        processor.id_to_piece(k)
        for k in range(processor.get_piece_size())
        if not (processor.is_control(k) or processor.is_unknown(k) or processor.is_byte(k))
    )
    plain = list(plain)
    return (
        [p[len(mark) :] for p in plain if p.startswith(mark) and mark not in p[len(mark) :] and len(p) > len(mark)],
        [p for p in plain if p and mark not in p],
    )


def token_counts(docs: DataFrame, first: list[str], later: list[str], text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_unknown, n_tokens`` of every text.

    Words are the runs between white space, of any length.  ``first`` are the pieces that
    can start a word and ``later`` those that can follow; the longest that fits is taken
    each time.  A word that can't be spelt out counts as one unknown token.  A null or
    empty text has none.  Other columns than ``doc_id`` and the text's are ignored.
    """
    rows = docs.select("doc_id", docs[text_col].alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    words = re.compile(f"[^{SPACE_CLASS}]+").findall

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = WordPieceCounter(first, later)
        number = counter.__getitem__
        for batch in batches:
            out = np.zeros((batch.num_rows, 3), np.int64)
            for k, text in enumerate(batch.column(1).to_pylist()):
                found = words(text or "")
                pieces = np.fromiter(map(number, found), np.int64, len(found))
                unknown = int((pieces < 0).sum())
                out[k] = len(found), unknown, int(pieces.sum()) + 2 * unknown
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(out[:, j]) for j in range(3))],
                names=["doc_id", "n_words", "n_unknown", "n_tokens"],
            )

    return rows.mapInArrow(count, f"doc_id {id_type}, n_words bigint, n_unknown bigint, n_tokens bigint")
