"""Byte-level BPE: a minimal perfect hash over the vocabulary, a heap over linked bytes for everything else."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from hirelake.llm.common import binary, bounded, documents, reachable

#: Mean keys per bucket of the perfect hash.
PER_BUCKET = 3
#: Pre-tokens whose ids a Python worker remembers; longer ones than LONGEST octets are not kept.
REMEMBERED, LONGEST = 1 << 19, 64


class PerfectHash:
    """Minimal perfect hash of a fixed set of byte strings by hash and displace: n keys, n slots, no empty slot.

    A key's hash picks a bucket and two numbers f, g; the bucket's displacement d puts it in slot
    (f + d * g + d // 64) mod n. Buckets are placed largest first, each with the first displacement that meets only
    free slots; a bucket of one key names its slot s directly, as -1 - s.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = -(-self.n // PER_BUCKET) or 1
        by_bucket: dict[int, list[int]] = {}
        parts = [self._parts(key) for key in keys]
        for i, (bucket, _, _) in enumerate(parts):
            by_bucket.setdefault(bucket, []).append(i)
        self.displacement = [0] * self.buckets
        self.slots: list[int] = [-1] * self.n
        ordered = sorted(by_bucket.items(), key=lambda x: -len(x[1]))
        for bucket, members in ordered:
            if len(members) == 1:
                break
            d = 0
            while True:
                at = [(parts[i][1] + d * parts[i][2] + d // 64) % self.n for i in members]
                if len(set(at)) == len(at) and all(self.slots[a] < 0 for a in at):
                    break
                d += 1
            self.displacement[bucket] = d
            for a, i in zip(at, members):
                self.slots[a] = i
        free = (a for a in range(self.n) if self.slots[a] < 0)
        for (bucket, (i,)), a in zip((x for x in ordered if len(x[1]) == 1), list(free)):
            self.displacement[bucket] = -1 - a
            self.slots[a] = i

    def _parts(self, key: bytes) -> tuple[int, int, int]:
        h = xxhash.xxh3_128_intdigest(key)
        return (h & 0xFFFFFFFF) % self.buckets, (h >> 32 & 0xFFFFFFFF) % self.n, 1 + (h >> 64 & 0xFFFFFFFF) % max(1, self.n - 1)

    def find(self, key: bytes) -> int:
        """Index of the only key that can be equal to ``key``."""
        bucket, f, g = self._parts(key)
        d = self.displacement[bucket]
        return self.slots[-1 - d if d < 0 else (f + d * g + d // 64) % self.n]


class Codec:
    """Encoder and decoder of one vocabulary of ranked byte strings and one pre-token pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.tokens = sorted(ranks, key=ranks.__getitem__)
        self.ids = [ranks[t] for t in self.tokens]
        self.ranks, self.pattern = ranks, pattern
        self.hash = PerfectHash(self.tokens)
        self.octets = {i: t for t, i in ranks.items()}
        self.digits = {i: str(i) for i in ranks.values()}
        self.known = _Known(self)
        self.split = regex.compile(pattern).findall

    def __reduce__(self):  # the split function is made anew on each worker
        return _rebuilt, (self.tokens, self.ids, self.pattern, self.hash)

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: the perfect hash if it is in the vocabulary, else merges."""
        i = self.hash.find(piece)
        return (self.ids[i],) if self.tokens[i] == piece else self.merge(piece)

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Lowest rank first, leftmost among equals. Parts are linked; a heap entry whose parts have changed is passed over."""
        n, rank_of, push, pop = len(piece), self.ranks.get, heapq.heappush, heapq.heappop
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))  # start of the next part, of the part before
        wide = n.bit_length()  # an entry is one integer: rank, start and end side by side
        low = (1 << wide) - 1
        heap = [rank << 2 * wide | i << wide | i + 2 for i in range(n - 1) if (rank := rank_of(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            start, end = entry >> wide & low, entry & low
            middle = after[start]
            if not 0 <= middle < end or after[middle] != end:
                continue
            after[start], after[middle] = end, -1
            if end < n:
                before[end] = start
                if (rank := rank_of(piece[start:after[end]])) is not None:
                    push(heap, rank << 2 * wide | start << wide | after[end])
            left = before[start]
            if left >= 0 and (rank := rank_of(piece[left:end])) is not None:
                push(heap, rank << 2 * wide | left << wide | end)
        ids, start = [], 0
        while start < n:
            ids.append(self.ranks[piece[start:after[start]]])
            start = after[start]
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(map(self.known.__getitem__, self.split(text))))

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.octets.__getitem__, ids))


class _Known(dict):
    """Ids of the pre-tokens met lately."""

    def __init__(self, codec: Codec):
        self.codec = codec

    def __missing__(self, piece: str) -> tuple[int, ...]:
        octets = piece.encode()
        ids = self.codec.encode_piece(octets)
        if len(octets) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = ids
        return ids


def _rebuilt(tokens: list[bytes], ids: list[int], pattern: str, perfect: PerfectHash) -> Codec:
    codec = Codec.__new__(Codec)
    codec.tokens, codec.ids, codec.pattern, codec.hash = tokens, ids, pattern, perfect
    codec.ranks = dict(zip(tokens, ids))
    codec.octets, codec.digits = dict(zip(ids, tokens)), {i: str(i) for i in ids}
    codec.known, codec.split = _Known(codec), regex.compile(pattern).findall
    return codec


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array of int), decoded (binary) for each row: the whole text encoded, and the ids decoded again.

    The vocabulary is read on the driver, hashed there and broadcast; its size does not depend on the data. No special
    token is made. A null or empty text gives no ids. Repeated rows each get a row; a null doc_id stays null.
    """
    return _mapped(docs, ranks_path, pattern, "doc_id long, ids array<int>, decoded binary", lambda codec, ids: {
        "ids": pa.array(ids, pa.list_(pa.int32())), "decoded": pa.array(map(codec.decode, ids), pa.binary())})


def token_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids, comma-joined), decoded_sha256 (of the decoded octets)."""
    def digests(codec: Codec, ids: list[list[int]]) -> dict[str, pa.Array]:
        digit = codec.digits.__getitem__
        return {"n_tokens": pa.array(map(len, ids), pa.int64()),
                "ids_sha256": pa.array([hashlib.sha256(",".join(map(digit, x)).encode()).hexdigest() for x in ids], pa.string()),
                "decoded_sha256": pa.array([hashlib.sha256(codec.decode(x)).hexdigest() for x in ids], pa.string())}

    return _mapped(docs, ranks_path, pattern, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", digests)


def _mapped(docs: DataFrame, ranks_path: str, pattern: str, schema: str, columns) -> DataFrame:
    spark = docs.sparkSession
    reachable(spark)
    shared = spark.sparkContext.broadcast(Codec(read_ranks(ranks_path), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = shared.value
        for batch in bounded(batches):
            ids = [codec.encode(text) for text in batch.column("text").to_pylist()]
            made = columns(codec, ids)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *made.values()], ["doc_id", *made])

    return documents(docs).mapInArrow(run, schema)
