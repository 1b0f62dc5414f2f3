"""Byte-level BPE, encoding and decoding, with two tiers.

A text is cut into pre-tokens by the vocabulary's pattern. Tier one is a minimal perfect
hash over the vocabulary: a pre-token that is a vocabulary entry as a whole is resolved by
one probe. Tier two takes the misses: the bytes form a linked list and a heap holds the
ranks of neighbouring pairs; the lowest rank (leftmost first) is joined until none is left.

The vocabulary, of a size given by its file, is read once on the driver and broadcast.
Workers keep the results of pre-tokens that they have seen, up to ``REMEMBERED``.

Defined results: a null text counts as empty and gives no ids (its digests are those of
empty strings); every other text is encoded to its end; each input row, repeated or not,
gives one row; an empty table gives none; extra input columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

#: Pre-tokens that a worker process keeps, some 200 bytes each: none longer than ``LONGEST``
#: characters, as those hardly come again and have no bound.
REMEMBERED, LONGEST = 700_000, 32
PRIME = (1 << 61) - 1


class PerfectHash:
    """Minimal perfect hash by hash and displace: n keys in n slots.

    Keys go to buckets; starting with the largest bucket, each finds a displacement that
    sends its keys to free slots. Buckets of one key name their slot outright, stored as
    -1 - slot.
    """

    PER_BUCKET = 3

    def __init__(self, keys: list[bytes]) -> None:
        self.n = n = len(keys)
        self.buckets = max(1, n // self.PER_BUCKET)
        self.shifts = [0] * self.buckets
        groups: list[list[tuple[int, int, int]]] = [[] for _ in range(self.buckets)]
        for i, key in enumerate(keys):
            b, first, step = self._parts(key)
            groups[b].append((i, first, step))
        self.slots: list[int] = [-1] * n  # slot -> key number
        order = sorted(range(self.buckets), key=lambda b: -len(groups[b]))
        free = None
        for b in order:
            members = groups[b]
            if not members:
                break
            if len(members) == 1:
                if free is None:
                    free = [s for s in range(n) if self.slots[s] < 0]
                slot = free.pop()
                self.slots[slot] = members[0][0]
                self.shifts[b] = -1 - slot
                continue
            shift = 0
            while True:
                places = {(first + shift * step) % PRIME % n for _, first, step in members}
                if len(places) == len(members) and all(self.slots[p] < 0 for p in places):
                    break
                shift += 1
            for i, first, step in members:
                self.slots[(first + shift * step) % PRIME % n] = i
            self.shifts[b] = shift

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, h >> 32 & 0xFFFFFFFFFFFF, 1 + (h >> 80)

    def slot(self, key: bytes) -> int:
        """The only slot where ``key`` can be; the caller compares the key kept there."""
        b, first, step = self._parts(key)
        shift = self.shifts[b]
        return -1 - shift if shift < 0 else (first + shift * step) % PRIME % self.n


class Bpe:
    """Encoder and decoder over ``ranks`` (bytes to id) and a pre-token ``pattern``."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.pattern = ranks, pattern
        keys = list(ranks)
        self.hash = PerfectHash(keys)
        self.keys = [keys[i] for i in self.hash.slots]
        self.ids = [ranks[k] for k in self.keys]
        self.bytes = {i: k for k, i in ranks.items()}
        self._ready()

    def _ready(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.names = {i: str(i) for i in self.bytes}
        self.seen: dict[str, tuple[int, ...]] = {}

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("find", "names", "seen")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._ready()

    @classmethod
    def load(cls, path: str, pattern: str) -> Bpe:
        with open(path, "rb") as lines:
            pairs = (line.split() for line in lines if line.strip())
            return cls({base64.b64decode(token): int(rank) for token, rank in pairs}, pattern)

    def piece(self, data: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        slot = self.hash.slot(data)
        if self.keys[slot] == data:
            return (self.ids[slot],)
        return self.merged(data)

    def merged(self, data: bytes) -> tuple[int, ...]:
        ranks, n = self.ranks, len(data)
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        ends = after[:]  # the part that starts at i ends here; 0: taken up by another
        heap = [(r, i) for i in range(n - 1) if (r := ranks.get(data[i : i + 2])) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i]
            if not ends[i] or j >= n or ranks.get(data[i : ends[j]]) != rank:
                continue
            ends[i], ends[j] = ends[j], 0
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks.get(data[i : ends[k]])) is not None:
                    heappush(heap, (r, i))
            p = before[i]
            if p >= 0 and (r := ranks.get(data[p : ends[i]])) is not None:
                heappush(heap, (r, p))
        out, i = [], 0
        while i < n:
            out.append(ranks[data[i : ends[i]]])
            i = after[i]
        return tuple(out)

    def encode(self, text: str) -> list[int]:
        tokens = self.find(text)
        seen = self.seen
        if missing := [t for t in tokens if t not in seen]:
            if len(seen) > REMEMBERED:
                seen.clear()
                missing = tokens
            fresh = {token: self.piece(token.encode()) for token in set(missing)}
            seen.update((t, ids) for t, ids in fresh.items() if len(t) <= LONGEST)
            return list(chain.from_iterable(fresh[t] if t in fresh else seen[t] for t in tokens))
        return list(chain.from_iterable(map(seen.__getitem__, tokens)))

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))


SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"


def encode_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array) of every row of ``documents`` (doc_id, text)."""
    shared = documents.sparkSession.sparkContext.broadcast(Bpe.load(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            for rows in _bounded(batch):
                ids = [bpe.encode(t or "") for t in rows.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id bigint, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data (binary) of rows (doc_id, ids)."""
    shared = encoded.sparkSession.sparkContext.broadcast(Bpe.load(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        for batch in batches:
            data = [bpe.decode(x or ()) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id bigint, data binary")


def digest_documents(documents: DataFrame, path: str, pattern: str) -> DataFrame:
    """Both ways in one pass, so that ids needn't travel: per row the count of ids, the
    SHA-256 of the ids in decimal joined by commas, and that of the bytes decoded from them."""
    shared = documents.sparkSession.sparkContext.broadcast(Bpe.load(path, pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = shared.value
        name = bpe.names.__getitem__
        for batch in batches:
            counts, hashes, decoded = [], [], []
            for text in batch.column("text"):
                ids = bpe.encode(text.as_py() or "")
                counts.append(len(ids))
                hashes.append(hashlib.sha256(",".join(map(name, ids)).encode()).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(hashes, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return documents.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _bounded(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Short runs of a batch, so that what is built from them stays small."""
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)
