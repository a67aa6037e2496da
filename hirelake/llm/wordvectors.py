"""Random-indexing word vectors: tokens of texts as hashes, sums of neighbours' index vectors over all texts, pooling."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import binary, bounded, reachable, settle

#: Word slots (words share one by hash, so the table has a fixed size), components, non-zero components of an index
#: vector, neighbours on each side.
SLOTS, WIDTH, SPARK, WINDOW = 1 << 15, 32, 4, 2
#: Share of all tokens at which a word counts half in a document's mean.
HALF = 1e-3
#: Octets of text that are taken apart at once, tokens that are pooled at once.
TEXT_BYTES, TOKENS = 1 << 20, 1 << 15
#: Parts in which tasks hand over their sums, and groups of tasks that are added up first.
PARTS, GROUPS = 64, 16

# Octets by kind: 0 white space, 1 letters (of ASCII, or any octet of another character), 2 digits, 3 marks.
_KIND = np.array([0 if c in b" \t\n\v\f\r" else 1 if c >= 128 or chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], dtype=np.int8)
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_SMALL = np.array([97 <= c <= 122 for c in range(256)])
_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(document, slot) of every token: runs of letters, of digits, and of marks; their slot is a hash of the octets.

    Letters are lower-cased (A-Z), but for words of two octets or more without a small letter: shouting has slots of its
    own. A run of marks is a token by its first four octets.
    """
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    kind = _KIND[raw]
    change = np.flatnonzero(np.diff(kind, prepend=np.int8(0)))
    begin = change[kind[change] != 0]
    stop = np.append(change, len(raw))[np.searchsorted(change, begin, side="right")]
    stop = np.where(kind[begin] == 3, np.minimum(stop, begin + 4), stop)
    small = np.concatenate(([0], np.cumsum(_SMALL[raw], dtype=np.int64)))
    loud = (kind[begin] == 1) & (stop - begin > 1) & (small[stop] == small[begin])
    with np.errstate(over="ignore"):
        # The power of where a token begins is divided out: odd numbers have an inverse modulo 2 ** 64.
        power, inverse = _powers(len(raw), _BASE), _powers(len(raw), pow(_BASE, -1, 1 << 64))
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_FOLD[raw].astype(np.uint64) + np.uint64(1)) * power)))
        hashed = _mixed((sums[stop] - sums[begin]) * inverse[begin], 1) + loud.astype(np.uint64)
        slot = (_mixed(hashed, 5) % np.uint64(SLOTS)).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return np.searchsorted(ends, begin, side="right"), slot


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the non-zero components of each slot's index vector, from hashes: alike on every machine."""
    with np.errstate(over="ignore"):
        h = np.stack([_mixed(np.arange(SLOTS, dtype=np.uint64), 101 + k) for k in range(SPARK)], axis=1)
    return (h % np.uint64(WIDTH)).astype(np.int64), np.where(h >> np.uint64(40) & np.uint64(1), 1, -1).astype(np.int64)


def neighbour_sums(document: np.ndarray, slot: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """(SLOTS, WIDTH + 1): for each slot the sum of the index vectors of its tokens' neighbours in the same document,
    and the number of its tokens."""
    total = np.zeros((SLOTS, WIDTH + 1))
    total[:, WIDTH] = np.bincount(slot, minlength=SLOTS)
    for apart in range(1, WINDOW + 1):
        same = np.flatnonzero(document[:-apart] == document[apart:])
        a, b = slot[same], slot[same + apart]
        for own, other in ((a, b), (b, a)):
            for k in range(SPARK):
                total[:, :WIDTH] += np.bincount(own * WIDTH + places[other, k], signs[other, k], SLOTS * WIDTH).reshape(SLOTS, WIDTH)
    return total


def corpus_sums(texts: DataFrame) -> np.ndarray:
    """``neighbour_sums`` over the column text of all rows.

    A task adds up its own rows and hands over PARTS blocks of its table; groups of tasks are added up, then the groups.
    Sums of whole numbers do not depend on the order. The table has a fixed size (SLOTS * (WIDTH + 1) numbers, 9 MB),
    which is all that reaches the driver.
    """
    reachable(texts.sparkSession)
    rows = SLOTS // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total, any_rows = np.zeros((SLOTS, WIDTH + 1)), False
        for batch in bounded(batches, limit=TEXT_BYTES):
            total += neighbour_sums(*tokens(binary(batch.column("text"))), places, signs)
            any_rows = True
        if any_rows:
            yield from blocks(total.astype(np.int64))

    def blocks(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        blobs = [np.ascontiguousarray(total[p * rows:(p + 1) * rows]).astype("<i8").tobytes() for p in range(PARTS)]
        yield pa.RecordBatch.from_pydict({"part": pa.array(range(PARTS), pa.int32()), "sums": pa.array(blobs, pa.binary())})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("sums")):
                own = np.frombuffer(blob.as_buffer(), dtype="<i8")
                held[part] = held[part] + own if part in held else own.copy()
        yield pa.RecordBatch.from_pydict({"part": pa.array(held.keys(), pa.int32()), "sums": pa.array([v.tobytes() for v in held.values()], pa.binary())})

    schema = "part int, sums binary"
    first = texts.select("text").mapInArrow(count, schema).withColumn("group", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    grouped = first.repartition("part", "group").select("part", "sums").mapInArrow(add, schema)
    whole = settle(grouped.repartition("part").mapInArrow(add, schema), "word-vectors")
    total = np.zeros((SLOTS, WIDTH + 1), dtype=np.int64)
    for row in whole.collect():
        total[row["part"] * rows:(row["part"] + 1) * rows] = np.frombuffer(row["sums"], dtype="<i8").reshape(rows, WIDTH + 1)
    return total


class WordVectors:
    """Vectors of slots: neighbours' sums less what the slot's frequency alone would give, scaled to length one and
    shrunk where a slot has few tokens; and the weight of a slot in a document's mean."""

    def __init__(self, sums: np.ndarray):
        count = sums[:, WIDTH].astype(float)
        total = max(1.0, count.sum())
        apart = sums[:, :WIDTH] - count[:, None] * (sums[:, :WIDTH].sum(axis=0) / total)
        chance = np.sqrt(2 * WINDOW * SPARK * count)  # length that unrelated neighbours would sum up to
        self.vectors = (apart / np.maximum(1e-9, np.linalg.norm(apart, axis=1) + chance)[:, None]).astype(np.float32)
        self.weight = (HALF / (HALF + count / total)).astype(np.float32)

    #: Mean, spread and length of the mean, logarithm of the number of tokens, shares of tokens that repeat the one before
    #: and the one before that (a word and its mark, again and again).
    FEATURES = 2 * WIDTH + 4

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """(len(texts), FEATURES); zeros for a text without tokens."""
        document, slot = tokens(texts)
        n, out = len(texts), np.zeros((len(texts), self.FEATURES))
        weight = self.weight[slot].astype(float)
        whole = np.maximum(np.bincount(document, weight, n), 1e-9)[:, None]
        mean, square = np.zeros((n, WIDTH)), np.zeros((n, WIDTH))
        for at in range(0, len(slot), TOKENS):  # a bounded number of vectors at a time, also of one long text
            own, vectors = document[at:at + TOKENS], self.vectors[slot[at:at + TOKENS]]
            first = np.flatnonzero(np.diff(own, prepend=-1))
            weighted = vectors * weight[at:at + TOKENS, None]
            mean[own[first]] += np.add.reduceat(weighted, first, axis=0)
            square[own[first]] += np.add.reduceat(weighted * vectors, first, axis=0)
        mean, square = mean / whole, square / whole
        number = np.bincount(document, minlength=n)
        out[:, :WIDTH], out[:, WIDTH:2 * WIDTH] = mean, np.sqrt(np.maximum(0, square - mean ** 2))
        out[:, -4], out[:, -3] = np.linalg.norm(mean, axis=1), np.log1p(number)
        for apart in (1, 2):
            again = np.flatnonzero((slot[apart:] == slot[:-apart]) & (document[apart:] == document[:-apart]))
            out[:, -3 + apart] = np.bincount(document[again], minlength=n) / np.maximum(1, number)
        return out
