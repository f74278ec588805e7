"""SentencePiece encoding and decoding with a public model's pieces, by batched Viterbi in numpy.

A text becomes words: a run of spaces with what follows it, and, where the model has no piece that
crosses them, single line breaks and tabs. No piece of such a model spans two words, so a text's
ids are its words' ids in order, and each distinct word is segmented once. Words of about one
length advance together, a character a step: hashes of the substrings that end there probe the
sorted keys of the pieces, and per word the best candidate becomes the backpointer.

What "best" means is the model's own. A unigram model adds the pieces' scores. A BPE model merges
by rank; the segmentation it reaches is the only one whose neighbours could not have merged
otherwise, so there a candidate is admitted if it fits the piece before it, and the maximum picks
the admitted one. Characters without a piece become byte pieces.

Defined results: a null or empty text has no ids. Decoding turns the mark U+2581 into a space and
drops the one space that encoding puts first, so a text that holds the mark itself does not come
back as it was. Repeated rows are encoded alike. An empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketry.llm._words import Buffer, Remembered, buffer_of, mix, range_hashes, row_groups

MARK = "▁"
#: Distinct words whose ids a worker remembers.
REMEMBERED = 1_000_000
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)


def _char_codes(chars: np.ndarray) -> np.ndarray:
    return mix(chars.astype(np.uint64) + np.uint64(0x51ED2701))


def _text_key(text: str) -> int:
    h = np.zeros(1, np.uint64)
    for c in _char_codes(np.array([ord(x) for x in text], np.uint32)):
        h = h * _BASE + c
    return int(mix(h + np.uint64(len(text)) * np.uint64(0xD6E8FEB86659FD93))[0])


@dataclass
class Model:
    """A model's pieces as sorted arrays.

    keys, ids: hashes of the text pieces and their ids; score: by id; rank, left, right: by id, the
    order of merges and the two parts of a piece's last merge; pair_keys, pair_rank: what two
    neighbours merge into; reachable: whether the piece's own text is encoded as the piece.
    """

    unigram: bool
    keys: np.ndarray
    ids: np.ndarray
    score: np.ndarray
    rank: np.ndarray
    left: np.ndarray
    right: np.ndarray
    pair_keys: np.ndarray
    pair_rank: np.ndarray
    reachable: np.ndarray
    byte_ids: np.ndarray
    longest: int
    breaks: np.ndarray
    piece_bytes: np.ndarray
    piece_start: np.ndarray

    @property
    def size(self) -> int:
        return len(self.score)


def _merged(chars: list[int], text: list[str], by_text: dict[str, int], rank: dict[int, int]) -> tuple[list[int], tuple[int, int]]:
    """Merges by rank, leftmost first; the pieces left and the parts of the last merge."""
    last = (-1, -1)
    while len(chars) > 1:
        best = min(((rank[m], k, m) for k in range(len(chars) - 1) if (m := by_text.get(text[k] + text[k + 1])) is not None), default=None)
        if best is None:
            break
        _, k, m = best
        last = (chars[k], chars[k + 1])
        chars[k : k + 2], text[k : k + 2] = [m], [text[k] + text[k + 1]]
    return chars, last


def load_model(path: str, unigram: bool = False) -> Model:
    """Reads the pieces once, on the driver; the arrays go to the workers with the task."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    plain = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    piece = {i: sp.id_to_piece(i) for i in plain}
    by_text = {p: i for i, p in piece.items()}
    score = np.array([sp.get_score(i) for i in range(n)])
    rank_of = {i: r for r, i in enumerate(sorted(plain, key=lambda i: -score[i]), 1)}
    rank, left, right = np.zeros(n, np.int64), np.arange(n), np.arange(n)
    reachable = np.zeros(n, dtype=bool)
    pairs: dict[int, int] = {}
    for i in plain:
        p = piece[i]
        if len(p) == 1:
            reachable[i] = True
            continue
        rank[i] = rank_of[i]
        if not unigram:
            singles = [by_text.get(c, -1) for c in p]
            got, last = _merged(singles, list(p), by_text, rank_of)
            reachable[i] = got == [i] and min(last) >= 0
            if reachable[i]:
                left[i], right[i] = last
            for k in range(1, len(p)):
                a, b = by_text.get(p[:k]), by_text.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * n + b] = rank_of[i]
        else:
            reachable[i] = True
    text_ids = [i for i in plain if reachable[i]]
    keys = np.array([_text_key(piece[i]) for i in text_ids], np.uint64)
    order = np.argsort(keys)
    pair_keys = np.array(sorted(pairs), np.int64)
    raw = [b"\xef\xbf\xbd"] * n
    for i in range(n):
        if sp.is_byte(i):
            raw[i] = bytes([int(sp.id_to_piece(i)[3:-1], 16)])
        elif i in piece:
            raw[i] = piece[i].replace(MARK, " ").encode()
        elif sp.is_control(i):
            raw[i] = b""
    inside = {c for p in by_text if len(p) > 1 for c in p}
    return Model(
        unigram, keys[order], np.array(text_ids)[order], score, rank, left, right, pair_keys, np.array([pairs[k] for k in pair_keys.tolist()], np.int64), reachable,
        np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]), max(map(len, by_text)), np.array([ord(c) for c in "\n\t\r" if c not in inside], np.uint8),
        np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]),
    )


def _fits(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether merging by rank leaves piece b right of piece a; -1 stands for a character without piece.

    Both pieces' merges are undone, the later one first; the pair fails where the parts that then
    meet would have merged before the merge that was undone.
    """
    ok = np.ones(len(a), dtype=bool)
    live = np.flatnonzero((a >= 0) & (b >= 0))
    x, y = a[live].copy(), b[live].copy()
    limit = np.full(len(live), np.iinfo(np.int64).max)
    while len(live):
        key = x * model.size + y
        at = np.searchsorted(model.pair_keys, key)
        at[at == len(model.pair_keys)] = 0
        meet = np.where(model.pair_keys[at] == key, model.pair_rank[at], np.iinfo(np.int64).max) if len(model.pair_keys) else np.full(len(key), np.iinfo(np.int64).max)
        rx, ry = model.rank[x], model.rank[y]
        bad = meet < limit
        ok[live[bad]] = False
        whole = (rx == 0) & (ry == 0)
        go = ~bad & ~whole
        live, x, y, rx, ry = live[go], x[go], y[go], rx[go], ry[go]
        first = rx > ry  # of equal ranks the right one formed later
        limit = np.where(first, rx, ry + 1)
        x, y = np.where(first, model.right[x], x), np.where(first, y, model.left[y])
    return ok


_few: dict[tuple[int, int, int], bool] = {}


def _fits_few(model: Model, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The same for a few pairs, whose verdicts are remembered: for very long words, which advance alone."""
    if len(_few) > 1_000_000:
        _few.clear()
    out = []
    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        if (known := _few.get((model.size, x, y))) is None:
            known = _few[(model.size, x, y)] = bool(_fits(model, np.array([x]), np.array([y]))[0])
        out.append(known)
    return np.array(out, dtype=bool)


def segment(model: Model, words: list[str]) -> list[list[int]]:
    """Ids of each word; words of about one length advance together."""
    out: list[list[int]] = [[] for _ in words]
    groups: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        if w:
            groups.setdefault(len(w) if len(w) <= 24 else -(-len(w) // 32) * 32, []).append(k)
    for width, members in groups.items():
        most = max(1, 400_000 // (width + 1))
        for a in range(0, len(members), most):
            part = members[a : a + most]
            for k, ids in zip(part, _segment_width(model, [words[k] for k in part], width), strict=True):
                out[k] = ids
    return out


def _segment_width(model: Model, words: list[str], width: int) -> list[list[int]]:
    m = len(words)
    chars = np.zeros((m, width), np.uint32)
    for k, w in enumerate(words):
        got = np.frombuffer(w.encode("utf-32-le", "surrogatepass"), np.uint32)
        chars[k, : len(got)] = got
    code = _char_codes(chars)
    sums = np.zeros((m, width + 1), np.uint64)
    for t in range(width):
        sums[:, t + 1] = sums[:, t] * _BASE + code[:, t]
    powers = np.ones(model.longest + 1, np.uint64)
    for k in range(model.longest):
        powers[k + 1] = powers[k] * _BASE
    best = np.full((m, width + 1), -np.inf)
    best[:, 0] = 0
    piece = np.full((m, width + 1), -1, np.int64)
    length = np.zeros((m, width + 1), np.int64)
    worst = float(model.score[model.ids].min()) - 10.0 if len(model.ids) else -10.0
    found: list[np.ndarray] = []  # by length: the piece that begins at each place, or -1
    for n in range(1, min(model.longest, width) + 1):
        key = mix(sums[:, n:] - sums[:, :-n] * powers[n] + np.uint64(n) * np.uint64(0xD6E8FEB86659FD93))
        at = np.searchsorted(model.keys, key.ravel()).reshape(key.shape)
        at[at == len(model.keys)] = 0
        found.append(np.where(model.keys[at] == key, model.ids[at], -1))
    able = [(f >= 0).any(axis=0) for f in found]
    for t in range(1, width + 1):
        known = np.zeros(m, dtype=bool)
        for n in range(1, min(model.longest, t) + 1):
            if not able[n - 1][t - n]:
                continue
            ids = found[n - 1][:, t - n]
            hit = np.flatnonzero((ids >= 0) & (best[:, t - n] > -np.inf))
            if not len(hit):
                continue
            ids = ids[hit]
            if n == 1:
                known[hit] = True
            if model.unigram:
                merit = best[hit, t - n] + model.score[ids]
            else:
                before = piece[hit, t - n]
                merit = np.where((t - n == 0) | (_fits(model, before, ids) if m > 4 else _fits_few(model, before, ids)), 0.0, -np.inf)
            better = merit > best[hit, t]
            hit, ids, merit = hit[better], ids[better], merit[better]
            best[hit, t], piece[hit, t], length[hit, t] = merit, ids, n
        lone = np.flatnonzero(~known & (best[:, t - 1] > -np.inf))
        merit = best[lone, t - 1] + worst if model.unigram else np.zeros(len(lone))
        better = merit > best[lone, t]
        lone = lone[better]
        best[lone, t], piece[lone, t], length[lone, t] = merit[better], -1, 1
    out = []
    for k, w in enumerate(words):
        t, ids = len(w), []
        while t:
            n = int(length[k, t])
            if n == 0:
                raise ValueError(f"no segmentation of {w!r}")
            i = int(piece[k, t])
            ids += [i] if i >= 0 else [int(x) for x in model.byte_ids[list(w[t - 1].encode("utf-8", "surrogatepass"))][::-1]]
            t -= n
        out.append(ids[::-1])
    return out


def word_bounds(model: Model, buf: Buffer, rows: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, row) of the words of a run of rows."""
    lo, hi = int(buf.start[rows.start]), int(buf.end[rows.stop - 1])
    data = buf.data[lo:hi]
    space = data == 32
    mark = np.flatnonzero((data[:-2] == 0xE2) & (data[1:-1] == 0x96) & (data[2:] == 0x81)) if hi - lo > 2 else ()
    for k in range(3):
        space[mark + k if len(mark) else []] = True  # the mark itself stands for a space
    alone = np.isin(data, model.breaks)
    first = np.zeros(hi - lo + 1, dtype=bool)
    first[1:-1] = (space[1:] & ~space[:-1]) | alone[1:] | alone[:-1]
    filled = np.flatnonzero(buf.end[rows] > buf.start[rows]) + rows.start
    first[buf.start[filled] - lo] = True
    first[hi - lo] = False
    start = np.flatnonzero(first) + lo
    row = filled[np.searchsorted(buf.start[filled], start, side="right") - 1] if len(filled) else np.zeros(0, np.int64)
    inside = start < buf.end[row]
    start, row = start[inside], row[inside]
    end = np.minimum(np.append(start[1:], hi), buf.end[row])
    return start, end, row


class Codec:
    """Encodes and decodes runs of texts; remembers the ids of distinct words."""

    def __init__(self, model: Model):
        self.model = model
        self.words = Remembered(REMEMBERED)

    def encode(self, buf: Buffer, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the rows' texts in order, number of ids of each row)."""
        n = rows.stop - rows.start
        start, end, row = word_bounds(self.model, buf, rows)
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(n, np.int64)
        leads = start == buf.start[row]
        keys = np.zeros(len(start), np.uint64)
        block = (start - start[0]) // (4 << 20)
        for b in range(int(block[-1]) + 1):
            at = slice(*np.searchsorted(block, [b, b + 1]))
            keys[at] = range_hashes(buf.data, start[at], end[at])
        keys[leads] = mix(keys[leads] + np.uint64(1))

        def learn(places: np.ndarray) -> list[list[int]]:
            words = [(" " if leads[k] else "") + buf.data[start[k] : end[k]].tobytes().decode("utf-8", "replace") for k in places.tolist()]
            return segment(self.model, [w.replace(" ", MARK) for w in words])

        ids, count = self.words.take(keys, learn)
        return ids, np.bincount(row - rows.start, weights=count, minlength=n).astype(np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[bytes]:
        """The texts of runs of ids: pieces end to end, without the space that encoding put first."""
        size = self.model.piece_start[ids + 1] - self.model.piece_start[ids]
        total = np.cumsum(size)
        take = np.repeat(self.model.piece_start[ids] - (total - size), size) + np.arange(int(total[-1]) if len(ids) else 0)
        raw = self.model.piece_bytes[take].tobytes()
        ends = np.concatenate([[0], total])[np.cumsum(counts)]
        starts = np.concatenate([[0], ends[:-1]])
        return [raw[s + (raw[s : s + 1] == b" ") : e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]


_codecs: dict[bytes, Codec] = {}


def _codec(model: Model) -> Codec:
    """The worker's codec of this model: what one task has learnt serves the next."""
    name = model.keys[:64].tobytes() + bytes([model.unigram])
    return _codecs.get(name) or _codecs.setdefault(name, Codec(model))


def encoded(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, ids: the ids of every whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            buf = buffer_of(b.column("text"))
            for rows in row_groups(buf):
                ids, counts = codec.encode(buf, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(rows.start, rows.stop - rows.start), lists], names=["doc_id", "ids"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, ids array<int>")


def decoded(table: DataFrame, model: Model) -> DataFrame:
    """doc_id, text: the texts of a table of ids; null ids give an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            lists = [np.array(x or (), np.int64) for x in b.column("ids").to_pylist()]
            texts = codec.decode(np.concatenate([*lists, np.zeros(0, np.int64)]).astype(np.int64), np.array([len(x) for x in lists], np.int64)) if lists else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([t.decode("utf-8", "replace") for t in texts], pa.string())], names=["doc_id", "text"])

    return table.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trips(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_ids, ids_crc32, decoded_crc32, same: digests of every text's ids and of what they decode to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model)
        for b in batches:
            buf = buffer_of(b.column("text"))
            for rows in row_groups(buf):
                ids, counts = codec.encode(buf, rows)
                ends = np.cumsum(counts)
                texts = codec.decode(ids, counts)
                cuts = zip(texts, buf.start[rows].tolist(), buf.end[rows].tolist(), strict=True)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": b.column("doc_id").slice(rows.start, rows.stop - rows.start),
                        "n_ids": pa.array(counts),
                        "ids_crc32": pa.array([zlib.crc32(ids[e - n : e].astype("<u4").tobytes()) for e, n in zip(ends.tolist(), counts.tolist(), strict=True)], pa.int64()),
                        "decoded_crc32": pa.array([zlib.crc32(t) for t in texts], pa.int64()),
                        "same": pa.array([t == buf.data[s:e].tobytes() for t, s, e in cuts], pa.bool_()),
                    }
                )

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, decoded_crc32 long, same boolean")
