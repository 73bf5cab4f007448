"""SentencePiece encoding and decoding with a table of distinct chunks.

Where no piece of a model goes on behind a white-space marker, no merge crosses the start
of a marked word, so a text is encoded chunk by chunk: a chunk is a run of markers and the
characters up to the next marker.  Each task keeps a table of the distinct chunks that it
has met; a chunk is segmented and decoded by the library once, and the texts' ids are put
together from the table by position.  Nothing is shuffled, and the table is bounded: one
table for the whole corpus would have to shuffle every occurrence of every word, more than
the texts themselves, to save tasks from segmenting words that others have met, too.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from loomspark.llm._shared import bounded_batches, sliced, tidy

MARK = "▁"
#: Distinct chunks, and characters of all of them, that a task's table holds before it starts
#: afresh.  It is looked at after each slice of texts.
TABLE_CHUNKS = 80_000
TABLE_CHARS = 4_000_000
#: Bytes of texts that are put together at a time.
SLICE_BYTES = 2 << 20


def load_model(model: bytes) -> sentencepiece.SentencePieceProcessor:
    return sentencepiece.SentencePieceProcessor(model_proto=model)


def splits_at_marks(processor: sentencepiece.SentencePieceProcessor) -> bool:
    """Whether words can be segmented apart: marks only start pieces and texts keep their characters."""
    pieces = (processor.id_to_piece(k) for k in range(processor.get_piece_size()))
    if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
        return False
    # as it is, with one mark before it
    probe = " ﬁ Á  　x "
    return processor.normalize(probe) == MARK + probe.replace(" ", MARK)


class ChunkTable(dict):
    """Number of each distinct chunk; its ids and its decoded text are kept by number."""

    def __init__(self, processor: sentencepiece.SentencePieceProcessor, limit: int = TABLE_CHUNKS):
        super().__init__()
        self.processor, self.limit = processor, limit
        self.mark = processor.piece_to_id(MARK)
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.chars = 0
        self.new: list[str] = []
        self.ids = np.empty(1 << 16, np.int32)
        self.used = 0
        self.start = np.empty(0, np.int64)
        self.length = np.empty(0, np.int64)
        self.plain = np.empty(0, bool)
        self.odd: dict[int, str] = {}

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.chars += len(chunk)
        self.new.append(chunk)
        return n

    def segment_new(self) -> None:
        """Let the library encode and decode the chunks that came since the last call."""
        if not self.new:
            return
        surfaces = [c[1:].replace(MARK, " ") for c in self.new]  # the encoder sets the first mark
        ids = self.processor.encode(surfaces, num_threads=1)
        ids = [x or [self.mark] for x in ids]  # of a lone mark
        decoded = self.processor.decode(ids)
        first = len(self.length)
        plain = np.fromiter((a == b for a, b in zip(surfaces, decoded)), bool, len(ids))
        for k in np.flatnonzero(~plain):
            self.odd[first + int(k)] = decoded[k]
        length = np.fromiter(map(len, ids), np.int64, len(ids))
        flat = np.fromiter((i for x in ids for i in x), np.int32, int(length.sum()))
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.empty(self.used + len(flat), np.int32)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.plain = np.concatenate([self.plain, plain])
        self.used += len(flat)
        self.new = []

    def joined(self, numbers: np.ndarray) -> np.ndarray:
        """The ids of the numbered chunks, one after the other."""
        length = self.length[numbers]
        ends = np.cumsum(length)
        at = np.repeat(self.start[numbers] - ends + length, length)
        return self.ids[at + np.arange(len(at))]


_chunks = re.compile(f"{MARK}+[^{MARK}]*").findall


def encode_slice(
    texts: list[str], table: ChunkTable, begin: list[int], end: list[int]
) -> Iterator[tuple[np.ndarray, str]]:
    """Ids and decoded text of each text."""
    marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
    lists = [_chunks(m) for m in marked]
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    number = table.__getitem__
    numbers = np.fromiter((number(c) for x in lists for c in x), np.int64, int(counts.sum()))
    table.segment_new()
    ids = table.joined(numbers)
    chunk_ends = np.cumsum(counts)
    id_ends = np.concatenate([[0], np.cumsum(table.length[numbers])])
    plain = table.plain[numbers]
    for k, m in enumerate(marked):
        to = chunk_ends[k]
        since = to - counts[k]
        own = np.concatenate([begin, ids[id_ends[since] : id_ends[to]], end]).astype(np.int32)
        if plain[since:to].all():
            text = m[1:].replace(MARK, " ")
        else:
            parts = zip(numbers[since:to].tolist(), lists[k])
            text = "".join(" " + table.odd.get(n, c[1:].replace(MARK, " ")) for n, c in parts)[1:]
        yield own, text
    if len(table) > table.limit or table.chars > TABLE_CHARS:
        table.reset()


def encode_documents(
    docs: DataFrame, model: bytes, bos: bool = True, eos: bool = True, text_col: str = "text"
) -> DataFrame:
    """``doc_id, n_tokens, ids, ids_sha256, decoded`` of every text, as the library gives them.

    ``model`` is the content of a SentencePiece model whose pieces don't cross marks (else
    ValueError).  ``ids`` has the begin and end ids that are asked for; ``decoded`` is what
    decoding the ids gives; ``ids_sha256`` is the hex digest of the ids as little-endian
    unsigned 32-bit integers.  A null text is encoded as an empty one.  Other columns than
    ``doc_id`` and the text's are ignored; rows keep their number and repeats.
    """
    if not splits_at_marks(processor := load_model(model)):
        raise ValueError("pieces of this model cross white-space marks or it changes characters")
    begin = [processor.bos_id()] * bos
    end = [processor.eos_id()] * eos
    bounded_batches(docs.sparkSession)
    rows = docs.select("doc_id", docs[text_col].alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(load_model(model))
        for part in sliced(batches, 1, SLICE_BYTES):
            done = list(encode_slice([t or "" for t in part.column(1).to_pylist()], table, begin, end))
            lengths = np.fromiter((len(i) for i, _ in done), np.int64, len(done))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([i for i, _ in done])))
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(lengths),
                    ids,
                    pa.array([hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i, _ in done]),
                    pa.array([t for _, t in done]),
                ],
                names=["doc_id", "n_tokens", "ids", "ids_sha256", "decoded"],
            )

    return rows.mapInArrow(
        tidy(encode), f"doc_id {id_type}, n_tokens bigint, ids array<int>, ids_sha256 string, decoded string"
    )
