"""Packing of token pieces into training sequences by bounded-space best fit.

Each task keeps at most ``OPEN`` windows open. A piece goes to the fullest window that has
room for it. When none has and no further window may be opened, the fullest is emitted;
if it would leave more than ``GAP`` tokens empty, the piece is cut and its head fills the
window first. Full windows' worth of a long document are emitted straight away. What is
still open at the end of the tasks is merged: tasks' leftovers meet in groups of
``MERGED`` tasks, whose pieces are packed anew, largest first, level by level until one
group is left, so no task ever holds more than MERGED * OPEN windows.

Defined results: a null text counts as empty; an empty document has one token, the end
id; each input row, repeated or not, is a document of its own; no rows give no pieces;
extra columns are left out. doc_id may be null and is carried along.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store

LENGTH = 2048
OPEN = 32
GAP = 16
MERGED = 64
END = 1
#: Words that a worker process keeps, some 200 bytes each: none longer than ``LONGEST``
#: characters, as those hardly come again and have no bound.
REMEMBERED, LONGEST = 900_000, 32

PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
SCHEMA = f"{PIECE}, part bigint, window bigint, offset bigint, closed boolean"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]
TYPES = [pa.int64()] * 8 + [pa.bool_()]


class Words:
    """Ids of a text by a ``tokenizers`` file that lower-cases and whose pre-tokenizer
    parts letters, digits, the rest and white space.

    Texts are taken some megabytes at a time: Arrow parts them at white space and finds their
    distinct runs. A run of plain Latin letters, with or without punctuation behind, is put
    together from its parts; lower-cased words are remembered, and new ones encoded many at
    a time, as one text in which each ends where a word-end token does. Any other run is
    encoded by itself and remembered too.
    """

    ODD = re.compile("[\x1c-\x1f]")
    SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
    MARKS = "!#$%&*+,-./:;<=>?@^_`{|}~()[]\"\\"
    PLAIN = re.compile("[A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u012f\u0131-\u024f]+")
    LETTERS = "".join(filter(PLAIN.fullmatch, map(chr, range(0x250))))
    AT_ONCE, BYTES = 256, 4 << 20

    def __init__(self, spec: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        vocabulary = self.tokenizer.get_vocab()
        self.ending = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ending[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.seen: dict[str, bytes] = {}
        self.plain: dict[str, bytes] = {}

    def _one(self, word: str) -> bytes:
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, "<u4").tobytes()

    def _others(self, words: list[str]) -> list[bytes]:
        out = []
        for word in words:
            ids = self.seen.get(word)
            if ids is None:
                ids = self._one(word)
                if len(word) <= LONGEST:
                    self.seen[word] = ids
            out.append(ids)
        return out

    def _plains(self, words: list[str]) -> list[bytes]:
        """Of distinct lower-cased words of letters."""
        out = list(map(self.plain.get, words))
        missing = [i for i, ids in enumerate(out) if ids is None]
        for at in range(0, len(missing), self.AT_ONCE):
            places = missing[at : at + self.AT_ONCE]
            fresh = [words[i] for i in places]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
            ends = (np.flatnonzero(self.ending[ids]) + 1).tolist()
            if len(ends) == len(fresh):
                data = ids.tobytes()
                found = [data[4 * a : 4 * b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            else:
                found = list(map(self._one, fresh))
            for i, word, ids in zip(places, fresh, found, strict=True):
                out[i] = ids
                if len(word) <= LONGEST:
                    self.plain[word] = ids
        return out

    def _runs(self, runs: pa.Array) -> pa.Array:
        """Of distinct runs without white space."""
        if len(self.seen) + len(self.plain) > REMEMBERED:
            self.seen.clear()
            self.plain.clear()

        def of(words: pa.Array, learn: Callable[[list[str]], list[bytes]]) -> pa.Array:
            held = words.dictionary_encode()
            ids = learn(held.dictionary.to_numpy(zero_copy_only=False).tolist())
            return pa.array(ids, pa.large_binary()).take(held.indices)

        core = pc.utf8_rtrim(runs, self.MARKS)
        plain = pc.match_substring_regex(core, f"^(?:{self.PLAIN.pattern})$")
        words = of(pc.utf8_lower(core.filter(plain)), self._plains)
        tails = of(pc.utf8_ltrim(runs.filter(plain), self.LETTERS), self._others)
        whole = pc.binary_join_element_wise(words, tails, pa.scalar(b"", pa.large_binary()))
        other = of(runs.filter(pc.invert(plain)), self._others)
        first = plain.to_numpy(zero_copy_only=False)
        places = np.where(first, np.cumsum(first), len(whole) + np.cumsum(~first)) - 1
        return pa.concat_arrays([whole, other]).take(pa.array(places))

    def each(self, texts: pa.Array) -> Iterator[bytes]:
        """The ids of every text (null: empty) as little-endian unsigned 32-bit numbers."""
        texts = pc.fill_null(texts, "")
        part = np.cumsum(pc.binary_length(texts).to_numpy().astype("i8")) // self.BYTES
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(texts)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            some = texts.slice(a, b - a)
            if pc.any(pc.match_substring_regex(some, self.ODD.pattern)).as_py():
                split = [self.SPACE.split(t) if self.ODD.search(t) else t.split() for t in some.to_pylist()]
                lists = pa.array(split, pa.list_(pa.large_string()))
            else:
                lists = pc.utf8_split_whitespace(some)
            runs = lists.flatten().dictionary_encode()
            ids = self._runs(runs.dictionary).take(runs.indices)
            _, offsets, data = ids.buffers()
            ends = np.frombuffer(offsets, "i8")[lists.offsets.to_numpy()].tolist() if len(ids) else [0] * (b - a + 1)
            held = memoryview(data) if data else b""
            for at, end in zip(ends[:-1], ends[1:], strict=True):
                yield bytes(held[at:end])

    def __call__(self, text: str) -> bytes:
        return next(self.each(pa.array([text])))


_words: dict[str, Words] = {}


def _tokenizer(spec: str) -> Words:
    """One per worker process, kept between tasks."""
    if spec not in _words:
        _words.clear()
        _words[spec] = Words(spec)
    return _words[spec]


class Packer:
    """The open windows of one task. ``out`` gets rows (piece..., window, offset, closed)."""

    def __init__(self, length: int = LENGTH, open_windows: int = OPEN, gap: int = GAP) -> None:
        self.length, self.most, self.gap = length, open_windows, gap
        self.fills: list[tuple[int, int]] = []  # (room left, window), ascending: the fullest first
        self.pieces: dict[int, list[tuple]] = {}
        self.next = 0
        self.out: list[tuple] = []

    def _emit(self, window: int, closed: bool) -> None:
        at = 0
        for piece in self.pieces.pop(window):
            self.out.append((*piece, window, at, closed))
            at += piece[2]

    def _put(self, window: int, room: int, piece: tuple) -> None:
        self.pieces[window].append(piece)
        if room > piece[2]:
            insort(self.fills, (room - piece[2], window))
        else:
            self._emit(window, True)

    def _new(self, piece: tuple) -> None:
        self.pieces[self.next] = []
        self.next += 1
        self._put(self.next - 1, self.length, piece)

    def add(self, doc_id: int, ids: bytes) -> None:
        total = len(ids) // 4

        def piece(start: int, length: int) -> tuple:
            return doc_id, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total

        start = 0
        while total - start >= self.length:
            self._new(piece(start, self.length))
            start += self.length
        while start < total:
            left = total - start
            i = bisect_left(self.fills, (left, -1))
            if i < len(self.fills):
                room, window = self.fills.pop(i)
                self._put(window, room, piece(start, left))
            elif len(self.fills) < self.most:
                self._new(piece(start, left))
            else:
                room, window = self.fills.pop(0)
                if room <= self.gap:
                    self._emit(window, True)
                    continue
                self._put(window, room, piece(start, room))
                start += room
                continue
            break

    def close(self) -> None:
        for _, window in self.fills:
            self._emit(window, False)
        self.fills = []

    def taken(self) -> list[tuple]:
        out, self.out = self.out, []
        return out


def refit(pieces: Iterable[tuple], length: int) -> list[list[tuple]]:
    """Windows for whole ``pieces``: largest first, each to the fullest window with room."""
    rooms: list[tuple[int, int]] = []
    windows: list[list[tuple]] = []
    for piece in sorted(pieces, key=lambda x: (-x[2], x[0] is None, x[0] or 0, x[1])):
        i = bisect_left(rooms, (piece[2], -1))
        if i < len(rooms):
            room, w = rooms.pop(i)
        else:
            room, w = length, len(windows)
            windows.append([])
        windows[w].append(piece)
        insort(rooms, (room - piece[2], w))
    return windows


def _merger(length: int, gap: int, level: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        group, out = int(rows["part"].iloc[0]) // MERGED, []
        ids = [None if pd.isna(x) else int(x) for x in rows["doc_id"]]
        pieces = zip(ids, *(rows[c].tolist() for c in NAMES[1:5]), strict=True)
        for w, window in enumerate(refit(pieces, length)):
            closed, at = last or sum(x[2] for x in window) >= length - gap, 0
            for piece in window:
                out.append((*piece, group, -1 - (w * 64 + level), at, closed))
                at += piece[2]
        return pd.DataFrame(out, columns=NAMES).astype({"doc_id": "Int64"})

    return merge


def pack(documents: DataFrame, tokenizer: str, length: int = LENGTH, open_windows: int = OPEN, gap: int = GAP) -> DataFrame:
    """Pieces of all ``documents`` (doc_id, text) in sequences of at most ``length`` tokens
    of the tokenizer file at ``tokenizer``, an end id after each document."""
    spark = documents.sparkSession
    with open(tokenizer, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = _tokenizer(spec.value), Packer(length, open_windows, gap)
        part = TaskContext.get().partitionId()

        def made() -> pa.RecordBatch:
            rows = [(*x[:5], part, *x[5:]) for x in packer.taken()]
            columns = zip(*rows, strict=True) if rows else [[]] * len(NAMES)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, TYPES, strict=True)], NAMES)

        for batch in batches:
            for doc_id, ids in zip(batch.column("doc_id"), words.each(batch.column("text")), strict=True):
                packer.add(doc_id.as_py(), ids + end)
            yield made()
        packer.close()
        yield made()

    packed = store(documents.select("doc_id", "text").mapInArrow(run, SCHEMA), "packed")
    done, rest = [packed.where("closed")], packed.where("NOT closed")
    parts = (packed.agg(F.max("part")).first()[0] or 0) + 1
    level = 0
    while True:
        level, last = level + 1, parts <= MERGED
        merged = rest.groupBy(F.floor(F.col("part") / MERGED).alias("_group")).applyInPandas(_merger(length, gap, level, last), SCHEMA)
        if last:
            done.append(merged)
            break
        merged = store(merged, "merged")
        done.append(merged.where("closed"))
        rest, parts = merged.where("NOT closed"), -(-parts // MERGED)
    whole = done[0]
    for more in done[1:]:
        whole = whole.unionByName(more)
    # Windows of the merging levels are numbered below zero, those of tasks from zero.
    number = F.shiftleft(F.col("part"), 40) + F.when(F.col("window") >= 0, F.col("window") * 2).otherwise(F.col("window") * -2 - 1)
    return whole.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", number.alias("sequence_id"), "offset")
