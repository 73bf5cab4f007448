"""Alignment of two tokenizers' tokens over a corpus, with corpus-wide counts of linked ids.

A byte-level BPE (A) and a SentencePiece model (B) encode the same bytes; tokens whose byte
ranges overlap are linked, and bytes where both end a token cut them into groups.

Both tokenizers start afresh at a space after another character than white space, so a text is
cut there into chunks, and each task encodes and aligns every distinct chunk once.  A task's links
are brought down to counts of packed keys (the B id above, the A id below) by ``np.unique``.  The
counts are sorted by key ranges over the whole corpus, equal keys are summed as runs, and each
range is stored as a file of blocks in the shared folder.  The second pass maps those files into
memory and finds its keys by ``searchsorted``; they are read by need, never loaded whole.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspark.llm._shared import arrow_filesystem, bounded_batches, shared_dir, sliced, tidy, written
from loomspark.llm.pieces import MARK, load_model, splits_at_marks

#: Distinct chunks, and characters of all of them, that a task holds before it starts afresh.
TABLE_CHUNKS = 200_000
TABLE_CHARS = 8_000_000
#: Keys of a block of a stored range: 16 bytes each.
BLOCK_KEYS = 1_000_000
#: Blocks that a task keeps where files can't be mapped into memory.
KEPT_BLOCKS = 4
#: Bytes of texts that are put together at a time.
SLICE_BYTES = 2 << 20
#: Characters of chunks that are encoded at a time.
RUN_CHARS = 32_000
#: Rows of a batch of counts.
_ROWS = 100_000

_FIGURES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
#: Fixed value: the pattern by which a byte-level BPE splits texts.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_chunks = re.compile(r" +[^ ]*(?:(?<=\s) +[^ ]*)*").findall


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable Latin-1 letters
    stand for themselves, the others, in order, for the bytes that are left."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Pair:
    """The two tokenizers, and the bytes of each of their tokens.

    Where a byte-level BPE gives its merges ids in their order, as usual, the order of the ids says
    all and A is run by ``tiktoken``, several times as fast; else by ``tokenizers``.
    """

    def __init__(self, byte_json: str, model: bytes):
        parts = json.loads(byte_json)
        letters = byte_of_letter()
        vocab = parts["model"]["vocab"]
        self.a_bytes = [b""] * (max(vocab.values()) + 1)
        special = {t["content"] for t in parts.get("added_tokens", []) if t.get("special")}
        for token, k in vocab.items():
            if token not in special:
                self.a_bytes[k] = bytes(letters[c] for c in token)
        merges = (m.split(" ") if isinstance(m, str) else m for m in parts["model"]["merges"])
        ids = [vocab[x + y] for x, y in merges]
        splitter = parts["pre_tokenizer"]
        plain = not parts.get("normalizer") and splitter["type"] == "ByteLevel" and splitter["use_regex"] and not splitter["add_prefix_space"]
        if plain and ids == sorted(set(ids)) and len(ids) + 256 + len(special & vocab.keys()) == len(vocab):
            import tiktoken

            ranks = {t: k for k, t in enumerate(self.a_bytes) if t}
            self.encode_a = tiktoken.Encoding("own", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        else:
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            a = Tokenizer.from_str(byte_json)
            a.encode_special_tokens = True  # their strings in a text are plain text
            self.encode_a = lambda text: a.encode(text, add_special_tokens=False).ids
        self.b = load_model(model)
        pieces = (self.b.id_to_piece(k) for k in range(self.b.get_piece_size()))
        self.b_bytes = [bytes.fromhex(p[3:5]) if self.b.is_byte(k) else p.replace(MARK, " ").encode() for k, p in enumerate(pieces)]
        self.mark = self.b.piece_to_id(MARK)
        self.a_length, self.b_length = (np.array([len(t) for t in x], np.int64) for x in (self.a_bytes, self.b_bytes))
        #: Each id as text with what may follow it.
        self.a_text = {c: np.array([f"{k}{c}" for k in range(len(self.a_bytes))], object) for c in ",|"}
        self.b_text = {c: np.array([f"{k}{c}" for k in range(len(self.b_bytes))], object) for c in ",;"}

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """Ids of both for a text that begins with the space that B adds by itself; nothing where
        either's bytes aren't the text's."""
        a, b, raw = self.encode_a(text), self.b.encode(text[1:]) or [self.mark], text.encode()
        if b"".join([self.a_bytes[k] for k in a]) == raw == b"".join([self.b_bytes[k] for k in b]):
            return a, b
        return None

    def encode_chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of both for the chunks whose bytes both keep, one after the other, and which those are.

        Chunks are encoded many at a time: both start afresh at the space that each begins with, if
        what is before it is no white space.
        """
        good = np.zeros(len(chunks), bool)
        a, b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]

        def take(since: int, to: int) -> None:
            """Encode a run, by halves where its bytes aren't kept.  They are put on a list: a function
            that calls itself is a cycle, which would hold the ids until Python looks for cycles."""
            left = [(since, to)]
            while left:
                since, to = left.pop()
                if (found := self.encode("".join(chunks[since:to]))) is not None:
                    good[since:to] = True
                    for x, ids in zip((a, b), found):
                        x.append(np.array(ids, np.int64))
                elif to - since > 1:
                    left += [((since + to) // 2, to), (since, (since + to) // 2)]

        since, chars = 0, 0
        for k, chunk in enumerate(chunks):
            chars += len(chunk)
            if chars > RUN_CHARS or chunk[-1].isspace():
                take(since, k + 1)
                since, chars = k + 1, 0
        if since < len(chunks):
            take(since, len(chunks))
        return np.concatenate(a), np.concatenate(b), good


@lru_cache(maxsize=1)
def load_pair(byte_json: str, model: bytes) -> Pair:
    return Pair(byte_json, model)


class Chunks(dict):
    """Number of each distinct chunk; what is known of chunks is kept by number."""

    def __init__(self, pair: Pair, counts: Counts | None = None):
        super().__init__()
        self.pair, self.counts = pair, counts
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.chars = 0
        self.new: list[str] = []
        self.groups: list[str] = []
        self.keys: list[np.ndarray] = []
        self.good = np.empty(0, bool)
        self.times = np.empty(0, np.int64)
        self.figures = np.empty((0, len(_FIGURES)), np.int64)

    def __missing__(self, chunk: str) -> int:
        n = self[chunk] = len(self)
        self.chars += len(chunk)
        self.new.append(chunk)
        return n

    def full(self) -> bool:
        return len(self) > TABLE_CHUNKS or self.chars > TABLE_CHARS

    def align_new(self) -> None:
        """Encode and align the chunks that came since the last call, all at once: their bytes are
        laid end to end."""
        if not self.new:
            return
        pair = self.pair
        a_ids, b_ids, good = pair.encode_chunks(self.new)
        kept = np.flatnonzero(good)
        chunk_ends = np.cumsum(np.fromiter((len(c.encode()) for c in self.new), np.int64, len(good))[kept])
        a_ends, b_ends = np.cumsum(pair.a_length[a_ids]), np.cumsum(pair.b_length[b_ids])
        ends = np.union1d(a_ends, b_ends)  # every stretch between two of them is one link
        keys = b_ids[np.searchsorted(b_ends, ends)] << 32 | a_ids[np.searchsorted(a_ends, ends)]
        both = np.intersect1d(a_ends, b_ends, assume_unique=True)
        till = [np.searchsorted(x, chunk_ends, "right") for x in (a_ends, b_ends, both, ends)]
        figures = np.zeros((len(good), len(_FIGURES)), np.int64)
        for c, t in enumerate(till):
            figures[kept, c] = np.diff(t, prepend=0)
        if self.counts is None:
            self.keys.append(keys)
        else:
            n, best = self.counts.of(keys)
            for c, values in ((4, best), (5, n)):
                figures[kept, c] = np.diff(np.concatenate([[0], np.cumsum(values)])[till[3]], prepend=0)
            texts = self._spelt(a_ids, b_ids, a_ends, b_ends, both)
            groups = [""] * len(good)
            since = 0
            for k, to in zip(kept.tolist(), (till[0] + till[1]).tolist()):
                groups[k] = "".join(texts[since:to])[:-1]
                since = to
            self.groups += groups
        self.good = np.concatenate([self.good, good])
        self.figures = np.concatenate([self.figures, figures])
        self.times = np.concatenate([self.times, np.zeros(len(good), np.int64)])
        self.new = []

    def _spelt(self, a: np.ndarray, b: np.ndarray, a_ends: np.ndarray, b_ends: np.ndarray, both: np.ndarray) -> list[str]:
        """Every id with what follows it, in the order of ``a1,a2|b1;a3|b2,b3``: of each group the A ids,
        then the B ids."""
        a_group, b_group = np.searchsorted(both, a_ends), np.searchsorted(both, b_ends)
        a_till, b_till = np.searchsorted(a_ends, both, "right"), np.searchsorted(b_ends, both, "right")
        out = np.empty(len(a) + len(b), object)
        if len(both):
            for ids, ends, group, before, text, end in (
                (a, a_ends, a_group, np.concatenate([[0], b_till[:-1]]), self.pair.a_text, "|"),
                (b, b_ends, b_group, a_till, self.pair.b_text, ";"),
            ):
                last = both[group] == ends
                out[np.arange(len(ids)) + before[group]] = np.where(last, text[end][ids], text[","][ids])
        return out.tolist()

    def numbered(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the chunks of all texts, where each text's end, and which texts have tokens."""
        lists = [_chunks(f" {t}") if t else [] for t in map(_decoded, texts)]
        ends = np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)))
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(lists)), np.int64, int(ends[-1]) if len(ends) else 0)
        self.align_new()
        bad = np.concatenate([[0], np.cumsum(~self.good[numbers])])
        starts = np.concatenate([[0], ends[:-1]])
        return numbers, ends, (ends > starts) & (bad[ends] == bad[starts])

    def count(self, texts: list[bytes | None]) -> None:
        """Count the chunks of texts that have tokens."""
        numbers, ends, has = self.numbered(texts)
        of = np.repeat(has, np.diff(ends, prepend=0))
        self.times += np.bincount(numbers[of], minlength=len(self.times))

    def partial_counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct keys of what was counted, and how often each is linked."""
        if not self.keys:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        times = np.repeat(self.times, self.figures[:, 3])
        keys, place = np.unique(np.concatenate(self.keys), return_inverse=True)
        n = np.zeros(len(keys), np.int64)
        np.add.at(n, place, times)
        return keys[n > 0], n[n > 0]


def _decoded(text: bytes | None) -> str | None:
    try:
        return text and text.decode()
    except UnicodeDecodeError:
        return None


def _text(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("text").cast("binary").alias("text"))


def pair_counts(docs: DataFrame, byte_json: str, model: bytes) -> DataFrame:
    """``key, n``: counts of linked ids, of each task's texts; a key is B's id * 2^32 + A's id."""
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Chunks(load_pair(byte_json, model))

        def rows() -> Iterator[pa.RecordBatch]:
            keys, n = table.partial_counts()
            for k in range(0, len(keys), _ROWS):
                yield pa.RecordBatch.from_arrays([pa.array(keys[k : k + _ROWS]), pa.array(n[k : k + _ROWS])], names=["key", "n"])
            table.reset()

        for part in sliced(batches, 1, SLICE_BYTES):
            table.count(part.column(1).to_pylist())
            if table.full():
                yield from rows()
        yield from rows()

    return _text(docs).mapInArrow(tidy(count), "key bigint, n bigint")


# ---- stored counts ---------------------------------------------------------------------
_BLOCK = pa.schema([("key", pa.int64()), ("n", pa.int64())])


@dataclass
class Counts:
    """Corpus-wide counts, as blocks of sorted keys in files.

    ``files`` and ``blocks`` say where each block is and ``firsts`` with which key it begins, in
    order; ``best`` has each B id's highest count.  Their sizes are bounded by the vocabularies.
    """

    files: list[str]
    blocks: list[int]
    firsts: np.ndarray
    best: np.ndarray

    def __post_init__(self):
        self._kept: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._mapped: dict[str, pa.ipc.RecordBatchFileReader] = {}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def block(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of a block: mapped into memory where the file system is a local or mounted
        one, else read, of which only the last few are kept."""
        files, path = arrow_filesystem(self.files[k])
        if files.type_name == "local":
            if path not in self._mapped:
                self._mapped[path] = pa.ipc.open_file(pa.memory_map(path))
            batch = self._mapped[path].get_batch(self.blocks[k])
            return batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if k not in self._kept:
            while len(self._kept) >= KEPT_BLOCKS:
                del self._kept[next(iter(self._kept))]
            with files.open_input_file(path) as source:
                batch = pa.ipc.open_file(source).get_batch(self.blocks[k])
            self._kept[k] = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        return self._kept[k]

    def of(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Count of each key (0 if there is none), and whether it is its B id's highest."""
        asked, place = np.unique(keys, return_inverse=True)
        found = np.zeros(len(asked), np.int64)
        at = np.searchsorted(self.firsts, asked, "right") - 1
        for k in np.unique(at[at >= 0]):
            lo, hi = np.searchsorted(at, [k, k + 1])
            known, n = self.block(int(k))
            spot = np.minimum(np.searchsorted(known, asked[lo:hi]), len(known) - 1)
            found[lo:hi] = np.where(known[spot] == asked[lo:hi], n[spot], 0)
        n = found[place]
        return n, (n > 0) & (n == self.best[keys >> 32])


def stored_counts(counts: DataFrame, pieces: int, block_keys: int = BLOCK_KEYS) -> Counts:
    """Sort partial counts (``key, n``) by ranges, sum the runs of equal keys and store each range
    as a file under the shared folder.  ``pieces`` is the size of B's vocabulary.

    What comes to the driver is one row a block and one a B id.  A task that runs again writes a
    file of another name; those count that the committed list names.
    """
    spark = counts.sparkSession
    folder = shared_dir(spark, "pair-counts")
    files, root = arrow_filesystem(folder)
    files.create_dir(root, recursive=True)
    ranged = counts.repartitionByRange("key").sortWithinPartitions("key")

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = arrow_filesystem(folder)
        name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.arrow"
        out, block, firsts = None, 0, []
        best: dict[int, int] = {}
        keys, n = np.empty(0, np.int64), np.empty(0, np.int64)

        def put(last: bool) -> None:
            """Write whole blocks, and at last what is left."""
            nonlocal out, block, keys, n
            while len(keys) > block_keys or (last and len(keys)):
                if out is None:
                    sink = files.open_output_stream(f"{root}/{name}", compression=None)
                    out = sink, pa.ipc.new_file(sink, _BLOCK)
                k, v = keys[:block_keys], n[:block_keys]
                out[1].write_batch(pa.RecordBatch.from_arrays([pa.array(k), pa.array(v)], schema=_BLOCK))
                firsts.append(int(k[0]))
                ids, starts = np.unique(k >> 32, return_index=True)
                for b, most in zip(ids.tolist(), np.maximum.reduceat(v, starts).tolist()):
                    best[b] = max(best.get(b, 0), most)
                block, keys, n = block + 1, keys[block_keys:], n[block_keys:]

        came: list[pa.RecordBatch] = []

        def merge() -> None:
            """Sum the runs of equal keys of what came; the last key may go on, so it stays with what
            comes."""
            nonlocal keys, n
            k = np.concatenate([keys, *(x.column(0).to_numpy() for x in came)])
            starts = np.flatnonzero(np.diff(k, prepend=k[0] - 1)) if len(k) else np.empty(0, np.int64)
            if len(k):
                n = np.add.reduceat(np.concatenate([n, *(x.column(1).to_numpy() for x in came)]), starts)
                keys = k[starts]
            came.clear()

        for batch in batches:
            came.append(batch)
            if sum(x.num_rows for x in came) > block_keys:
                merge()
                put(False)
        merge()
        put(True)
        if out:
            out[1].close()
            out[0].close()
        rows = [(name, b, first, None) for b, first in enumerate(firsts)] + [(None, None, b, most) for b, most in best.items()]
        types = pa.schema([("file", pa.string()), ("block", pa.int32()), ("key", pa.int64()), ("most", pa.int64())])
        yield pa.RecordBatch.from_pylist([dict(zip(types.names, r)) for r in rows], types)

    listed = written(ranged.mapInArrow(tidy(store), "file string, block int, key bigint, most bigint"), "pair-blocks")
    blocks = sorted(listed.where("file IS NOT NULL").select("key", "file", "block").collect())
    best = np.zeros(pieces, np.int64)
    for b, most in listed.where("file IS NULL").groupBy("key").agg(F.max("most")).collect():
        best[b] = most
    return Counts([f"{folder}/{f}" for _, f, _ in blocks], [b for *_, b in blocks], np.array([k for k, *_ in blocks], np.int64), best)


def align_tokens(docs: DataFrame, byte_json: str, model: bytes, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups`` of every document.

    ``byte_json`` is a byte-level BPE of the ``tokenizers`` library (A), ``model`` the content of a
    SentencePiece model whose pieces don't cross marks (B; else ValueError).  A encodes a space and
    the text, B the text, to which it adds the space; special tokens' strings are plain text.
    ``n_links`` counts the pairs of an A and a B token whose bytes overlap.  A pair of ids counts
    as often as it is linked in the whole corpus: ``count_sum`` adds the counts of a document's
    links, and ``n_best`` counts the links whose count is their B id's highest.  ``groups`` spells
    the ids as ``a1,a2|b1;a3|b2,b3``.

    A text that is null, empty, no UTF-8, or of which either tokenizer's bytes aren't a space and
    the text, has no tokens: zeros, and ``groups`` is ''.  Rows keep their number and repeats, each
    repeat counts, and other columns are ignored.
    """
    processor = load_model(model)
    if not splits_at_marks(processor):
        raise ValueError("pieces of this model cross white-space marks or it changes characters")
    partial = written(pair_counts(docs, byte_json, model), "pair-partials")
    counts = stored_counts(partial, processor.get_piece_size(), block_keys)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Chunks(load_pair(byte_json, model), counts)
        for part in sliced(batches, 1, SLICE_BYTES):
            numbers, ends, has = table.numbered(part.column(1).to_pylist())
            sums = np.concatenate([np.zeros((1, len(_FIGURES)), np.int64), np.cumsum(table.figures[numbers], axis=0)])
            figures = np.diff(sums[ends], axis=0, prepend=sums[:1]) * has[:, None]
            groups, first, known = [], 0, table.groups
            for to, has_tokens in zip(ends.tolist(), has.tolist()):
                groups.append(";".join([known[k] for k in numbers[first:to].tolist()]) if has_tokens else "")
                first = to
            yield pa.RecordBatch.from_arrays(
                [part.column(0), *(pa.array(np.ascontiguousarray(c)) for c in figures.T), pa.array(groups, pa.string())],
                names=["doc_id", *_FIGURES, "groups"],
            )
            if table.full():
                table.reset()

    types = ", ".join(f"{c} bigint" for c in _FIGURES)
    return _text(docs).mapInArrow(tidy(align), f"doc_id {id_type}, {types}, groups string")
