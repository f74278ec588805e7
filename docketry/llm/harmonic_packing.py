"""Packing by harmonic classes: class k holds pieces of at most 1/k of a sequence, k to a bin.

Each worker tokenizes its documents, cuts them, and fills bins of its own, with no exchange of
rows: a bin of class k is closed when it holds k pieces. Documents are cut so that pieces come out
just under a class's size: full sequences first, then, from a rest that would fill its class badly,
a piece of exactly the next class's size. What a worker's open bins hold at the end is joined end to
end and cut into full sequences, and the last of these into power-of-two lengths, which need no
padding.

Texts are encoded by distinct space-separated word: the tokenizer drops white space before it looks
for words, so a text's ids are those of its words in order.

Defined results: a null or empty text is the closing id alone; repeated rows are packed each for
itself; an empty table gives an empty result. Extra columns are ignored. Sequence ids join the
task's number and the bin's number in it, so a task that runs again gives the same ids.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._words import Buffer, Remembered, buffer_of, row_groups, words_of

CAPACITY, CLOSING_ID = 4096, 2
#: A rest is cut until the bins of its class stay unfilled by at most 1 / FINEST.
FINEST = 64
#: Distinct words whose ids a worker remembers.
REMEMBERED = 400_000

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordCodes:
    """A tokenizer that remembers the ids of words, for one task: a worker serves other stages after it."""

    def __init__(self, tokenizer_path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.words = Remembered(REMEMBERED)

    def encode(self, buf: Buffer, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of the rows in order, number of ids of each row)."""
        n = rows.stop - rows.start
        w = words_of(buf, rows)
        if not len(w):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)

        def learn(places: np.ndarray) -> list[list[int]]:
            base = int(w.start[0])
            data = buf.data[base : int(w.end[-1])].tobytes()
            texts = [data[s:e].decode("utf-8", "replace") for s, e in zip((w.start[places] - base).tolist(), (w.end[places] - base).tolist(), strict=True)]
            return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

        ids, count = self.words.take(w.hash, learn)
        return ids, np.bincount(w.row - rows.start, weights=count, minlength=n).astype(np.int64)


def cut_lengths(n: int, capacity: int = CAPACITY, finest: int = FINEST) -> list[int]:
    """Lengths of a document's pieces: whole sequences, then pieces at the sizes of harmonic classes."""
    cuts = [capacity] * (n // capacity)
    rest = n % capacity
    while rest:
        k = capacity // rest
        exact = capacity // (k + 1)
        if k >= finest or k * rest >= capacity - capacity // finest:
            cuts.append(rest)
            break
        cuts.append(exact)
        rest -= exact
    return cuts


class Bins:
    """Open bins of one worker, at most one a class, and the rows of those that have closed."""

    def __init__(self, worker: int, capacity: int = CAPACITY, finest: int = FINEST):
        self.capacity, self.finest = capacity, finest
        self.open: dict[int, list[tuple]] = {}
        self.base, self.closed = worker << 36, 0
        self.rows: list[tuple] = []

    def _emit(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.base + self.closed, at))
            at += len(ids)
        self.closed += 1

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        start = 0
        for n in cut_lengths(len(ids), self.capacity, self.finest):
            k = self.capacity // n
            room = self.open.setdefault(k, [])
            room.append((doc, start, ids[start : start + n] if k == 1 else ids[start : start + n].copy(), len(ids)))
            if len(room) == k:
                self._emit(self.open.pop(k))
            start += n

    def finish(self) -> None:
        """Joins what open bins hold and cuts it at full sequences, then at powers of two."""
        pieces = [p for k in sorted(self.open) for p in self.open[k]]
        self.open = {}
        left = sum(len(p[2]) for p in pieces)
        room: list[tuple] = []
        while left:
            want = self.capacity if left >= self.capacity else 1 << (left.bit_length() - 1)
            left -= want
            room = []
            while want:
                doc, start, ids, total = pieces.pop(0)
                if len(ids) > want:
                    pieces.insert(0, (doc, start + want, ids[want:], total))
                    ids = ids[:want]
                room.append((doc, start, ids, total))
                want -= len(ids)
            self._emit(room)

    def take(self) -> pa.RecordBatch:
        names = [x.split()[0] for x in PIECE_SCHEMA.split(", ")]
        cols = list(zip(*self.rows, strict=True)) or [()] * len(names)
        self.rows = []
        return pa.RecordBatch.from_pydict({k: pa.array(v, pa.int64()) for k, v in zip(names, cols, strict=True)})


def packed_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, finest: int = FINEST) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = WordCodes(tokenizer_path)
        bins = Bins(TaskContext.get().partitionId(), capacity, finest)
        for b in batches:
            buf, names = buffer_of(b.column("text")), b.column("doc_id").to_pylist()
            for rows in row_groups(buf):
                ids, counts = codes.encode(buf, rows)
                ends = np.cumsum(counts)
                for doc, end, n in zip(names[rows], ends.tolist(), counts.tolist(), strict=True):
                    bins.add(doc, np.append(ids[end - n : end], np.uint32(CLOSING_ID)))
                if len(bins.rows) > 20_000:
                    yield bins.take()
        bins.finish()
        yield bins.take()

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(pack, PIECE_SCHEMA)
