"""Hamming distances of 64-bit fingerprints by bit planes, and the links within buckets of equal bit blocks."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import settle, sorted_runs

#: Planes between two looks at whether a block can be abandoned.
LOOK = 8
#: Query fingerprints that are compared together.
TOGETHER = 64


def bit_rows(values: np.ndarray) -> np.ndarray:
    """(64, n) zeros and ones: row p holds bit p of every value."""
    octets = np.ascontiguousarray(values, dtype="<u8").view(np.uint8).reshape(-1, 8)
    return np.unpackbits(octets, axis=1, bitorder="little").T


def planes_of(rows: np.ndarray) -> np.ndarray:
    """Bit rows packed into 64-bit words: plane p holds bit p of 64 values in each word."""
    packed = np.packbits(rows, axis=1, bitorder="little")
    return np.ascontiguousarray(np.pad(packed, ((0, 0), (0, -packed.shape[1] % 8)))).view(np.uint64)


def within(differing: Callable[[int], np.ndarray], order: list[int], shape: tuple, radius: int, spare: np.ndarray) -> np.ndarray:
    """Words in which a bit is 1 where at most ``radius`` of the planes in ``order`` differ.

    ``differing(p)`` gives plane p of the differences. Counts are kept vertically: counter k holds bit k of all counts,
    a plane is added by carry-save steps, and what overflows stays marked. The block is abandoned once every lane
    (but for the ``spare`` ones beyond the last value) exceeds the radius.
    """
    counters = [np.zeros(shape, dtype=np.uint64) for _ in range(radius.bit_length())]
    over = np.zeros(shape, dtype=np.uint64) | spare

    def exceeding() -> np.ndarray:
        more, same = over.copy(), ~np.zeros(shape, dtype=np.uint64)
        for k in reversed(range(len(counters))):
            if radius >> k & 1:
                same = same & counters[k]
            else:
                more |= same & counters[k]
                same = same & ~counters[k]
        return more

    for step, p in enumerate(order, 1):
        carry = differing(p)
        for k, counter in enumerate(counters):
            counters[k], carry = counter ^ carry, counter & carry
        over |= carry
        if step % LOOK == 0 and (exceeding() == ~np.uint64(0)).all():
            return np.zeros(shape, dtype=np.uint64)
    return ~exceeding()


def _spare(n: int, words: int) -> np.ndarray:
    lanes = np.zeros(words * 64, dtype=np.uint8)
    lanes[n:] = 1
    return np.packbits(lanes, bitorder="little").view(np.uint64)


def lanes(words: np.ndarray, n: int) -> np.ndarray:
    """Indices of the bits that are 1 among the first ``n``."""
    return np.flatnonzero(np.unpackbits(words.view(np.uint8), bitorder="little")[:n])


class Planes:
    """A block of fingerprints stored as bit planes."""

    def __init__(self, values: np.ndarray):
        self.values, self.n = values, len(values)
        rows = bit_rows(values)
        self.order = [p for p in range(64) if 0 < rows[p].sum() < self.n]  # where all agree nothing differs
        self.planes = planes_of(rows)
        self.spare = _spare(self.n, self.planes.shape[1])

    def close(self, queries: np.ndarray, radius: int) -> np.ndarray:
        """(len(queries), words): lanes within ``radius`` of each query, which must be a value of the block."""
        asked = np.where(bit_rows(queries), ~np.uint64(0), np.uint64(0)).astype(np.uint64)
        shape = (len(queries), self.planes.shape[1])
        return within(lambda p: self.planes[p][None, :] ^ asked[p][:, None], self.order, shape, radius, self.spare[None, :])


def forest(values: np.ndarray, radius: int, accept: Callable[[int, int], bool] | None = None) -> list[tuple[int, int]]:
    """Links (i, j) that span the groups of values within ``radius``: at most one fewer than there are values.

    A breadth-first walk: found values leave the set that is still looked for, so a group of n makes n - 1 links.
    ``accept(i, j)`` is a further check of a pair.
    """
    block, links = Planes(values), []
    left = ~block.spare
    for root in range(len(values)):
        if not left[root >> 6] >> np.uint64(root & 63) & np.uint64(1):
            continue
        left[root >> 6] &= ~(np.uint64(1) << np.uint64(root & 63))
        waiting = [root]
        while waiting and left.any():
            now, waiting = waiting[:TOGETHER], waiting[TOGETHER:]
            for i, row in zip(now, block.close(values[now], radius)):
                for j in lanes(row & left, block.n).tolist():
                    if accept is None or accept(i, j):
                        links.append((i, j))
                        left[j >> 6] &= ~(np.uint64(1) << np.uint64(j & 63))
                        waiting.append(j)
    return links


#: Runs up to this length are compared at equal distances within the run, many runs at once.
SHORT = 16


def _close_in_short_runs(values: np.ndarray, at: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """All index pairs within ``radius`` in the runs of up to SHORT values."""
    left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]
    size = np.diff(at)
    of = np.repeat(np.arange(len(size)), size)
    short = np.flatnonzero((size[of] <= SHORT) & (size[of] > 1))
    for shift in range(1, int(size[size <= SHORT].max(initial=1))):
        short = short[size[of[short]] > shift]  # shorter runs are done with
        n = len(short) - shift
        if n < 1:
            break
        rows, run = bit_rows(values[short]), of[short]
        planes = planes_of(rows[:, :-shift]) ^ planes_of(rows[:, shift:])
        apart = np.ones(planes.shape[1] * 64, dtype=np.uint8)
        apart[:n] = run[:-shift] != run[shift:]
        spare = np.packbits(apart, bitorder="little").view(np.uint64)
        found = lanes(within(planes.__getitem__, range(64), (planes.shape[1],), radius, spare), n)
        left.append(short[found])
        right.append(short[found + shift])
    return np.concatenate(left), np.concatenate(right)


def links_in_runs(values: np.ndarray, at: np.ndarray, radius: int,
                  accept: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of linked values within runs: the close pairs of short runs, a spanning forest of long ones.

    With ``accept`` a pair must pass that check as well; pairs that are connected already are not checked.
    """
    left, right = _close_in_short_runs(values, at, radius)
    if accept is not None:
        root: dict[int, int] = {}

        def top(i: int) -> int:
            while (up := root.get(i, i)) != i:
                i = up
            return i

        kept = []
        for k, (i, j) in enumerate(zip(left.tolist(), right.tolist())):
            a, b = top(i), top(j)
            if a != b and accept(i, j):
                root[max(a, b)] = min(a, b)
                kept.append(k)
        left, right = left[kept], right[kept]
    pairs = [np.stack((left, right), axis=1).reshape(-1, 2)]
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo > SHORT:
            check = None if accept is None else lambda i, j, lo=lo: accept(lo + i, lo + j)
            pairs.append(np.array(forest(values[lo:hi], radius, check), dtype=np.int64).reshape(-1, 2) + lo)
    found = np.concatenate(pairs).astype(np.int64)
    return found[:, 0], found[:, 1]


def close_pairs(values: np.ndarray, at: np.ndarray, radius: int, asks: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(i, js): for each value that ``asks``, the other values within ``radius`` in its run, some of them at a time."""
    left, right = _close_in_short_runs(values, at, radius)
    for i, j in ((left, right), (right, left)):
        chosen = asks[i]
        order = np.argsort(i[chosen], kind="stable")
        own, other = i[chosen][order], j[chosen][order]
        cuts = np.flatnonzero(np.diff(own, prepend=-1))
        for lo, hi in zip(cuts.tolist(), np.append(cuts, len(own))[1:].tolist()):
            yield int(own[lo]), other[lo:hi]
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo > SHORT and asks[lo:hi].any():
            block, asking = Planes(values[lo:hi]), lo + np.flatnonzero(asks[lo:hi])
            step = max(1, min(1 << 10, (1 << 22) // (hi - lo)))
            for start in range(0, len(asking), step):
                some = asking[start:start + step]
                for i, row in zip(some.tolist(), block.close(values[some], radius)):
                    near = lo + lanes(row, block.n)
                    yield i, near[near != i]


class Roots:
    """Groups of numbers, joined as links are found."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def top(self, i: int) -> int:
        root = i
        while (up := self.up.get(root, root)) != root:
            root = up
        while (up := self.up.get(i, i)) != root and up != i:
            self.up[i], i = root, up
        return root

    def join(self, i: int, j: int) -> None:
        self.up[self.top(j)] = self.top(i)


def with_partner(values: np.ndarray, at: np.ndarray, radius: int) -> np.ndarray:
    """Indices of the values that have another value within ``radius`` in their run."""
    out = [np.concatenate(_close_in_short_runs(values, at, radius))]
    for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
        if hi - lo > SHORT:
            own = values[lo:hi]
            block, step = Planes(own), max(1, min(1 << 10, (1 << 22) // (hi - lo)))
            for start in range(0, hi - lo, step):
                near = block.close(own[start:start + step], radius)
                at_least_two = (near & (near - np.uint64(1))).any(axis=1) | ((near != 0).sum(axis=1) > 1)
                out.append(lo + start + np.flatnonzero(at_least_two))
    return np.unique(np.concatenate(out)).astype(np.int64)


def block_masks(radius: int, blocks: int, bits: list[int] | None = None) -> list[int]:
    """Masks of the bits that agree in some choice of ``blocks - radius`` blocks of ``bits`` (all 64): two values within
    ``radius`` differ in at most ``radius`` blocks, so they are equal under one mask at least."""
    bits = list(range(64)) if bits is None else bits
    edges = [len(bits) * i // blocks for i in range(blocks + 1)]
    parts = [sum(1 << b for b in bits[lo:hi]) for lo, hi in itertools.pairwise(edges)]
    return [sum(chosen) for chosen in itertools.combinations(parts, blocks - radius)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


#: Blocks beyond the radius into which the free bits of a large bucket are cut.
FINER = 3
#: Fingerprints that one counted stands for at most, by hash; counts only decide how buckets are dealt, not what is found.
COUNTED = 16


def buckets(values: DataFrame, fingerprint: str, radius: int, blocks: int, most: int, label: str) -> DataFrame:
    """The rows of ``values`` once for each bucket they belong to: a further column bucket, a hash. Fingerprints are
    distinct.

    A bucket is a mask and the bits under it. In a bucket of over ``most`` rows all rows agree under its mask, so what
    differs lies in its free bits: these are cut into blocks in turn, and the rows are dealt by what agrees there. No pair
    within ``radius`` is lost, and a row is repeated a fixed number of times, not once for each part of its bucket.
    Distinct fingerprints cannot be many after that, as few bits are left free. Buckets are counted before anything is
    moved (summed before the shuffle), so a hot one never reaches one task.
    """
    masks = block_masks(radius, blocks)
    free = [[b for b in range(64) if not mask >> b & 1] for mask in masks]
    finer = [[_signed(m) for m in block_masks(radius, radius + FINER, bits)] for bits in free]

    def key(mask: int, t: int) -> Column:
        return F.struct(F.lit(t).alias("mask"), F.xxhash64(F.lit(t), F.col(fingerprint).bitwiseAND(F.lit(_signed(mask)))).alias("bucket"))

    keys = F.explode(F.array(*(key(mask, t) for t, mask in enumerate(masks)))).alias("of")
    rows = values.select("*", keys).select("*", "of.mask", "of.bucket").drop("of")
    share = max(1, min(COUNTED, most // 256))
    some = rows.filter(F.pmod(F.xxhash64(F.lit(5), fingerprint), F.lit(share)) == 0) if share > 1 else rows
    large = settle(some.select("bucket").groupBy("bucket").agg((F.count("*") * share).alias("rows")).filter(F.col("rows") > most), label)
    literal = ", ".join(f"array({', '.join(f'{m}L' if m > -(1 << 63) else 'bigint(-9223372036854775808)' for m in own)})" for own in finer)
    inner = F.expr(f"transform(element_at(array({literal}), mask + 1), m -> xxhash64(bucket, m, `{fingerprint}` & m))")
    return (rows.join(large, "bucket", "left")
            .withColumn("bucket", F.explode(F.when(F.col("rows").isNull(), F.array("bucket")).otherwise(inner))).drop("mask", "rows"))


RUN_KEYS = ["bucket"]


def near_links(values: DataFrame, radius: int = 3, blocks: int = 5, most: int = 4096) -> DataFrame:
    """(a, b): links that join all distinct fingerprints within ``radius`` of each other, as a spanning part.

    ``values``: one long column, fingerprint, without repeats. Links that follow from others in the same bucket may be
    left out; the connected components are those of all close pairs.
    """
    dealt = buckets(values.select("fingerprint"), "fingerprint", radius, blocks, most, "buckets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in sorted_runs(batches, RUN_KEYS, target=1 << 16):
            column = part.column("fingerprint").combine_chunks().to_numpy()
            left, right = links_in_runs(column.view(np.uint64), at, radius)
            yield pa.RecordBatch.from_pydict({"a": column[left], "b": column[right]})

    return (dealt.repartition(*RUN_KEYS).sortWithinPartitions(*RUN_KEYS).mapInArrow(compare, "a long, b long").distinct())


def near_values(values: DataFrame, radius: int = 3, blocks: int = 5, most: int = 4096) -> DataFrame:
    """(fingerprint): the distinct fingerprints of ``values`` that have another within ``radius``."""
    dealt = buckets(values.select("fingerprint"), "fingerprint", radius, blocks, most, "buckets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in sorted_runs(batches, RUN_KEYS, target=1 << 16):
            column = part.column("fingerprint").combine_chunks().to_numpy()
            yield pa.RecordBatch.from_pydict({"fingerprint": column[with_partner(column.view(np.uint64), at, radius)]})

    return dealt.repartition(*RUN_KEYS).sortWithinPartitions(*RUN_KEYS).mapInArrow(compare, "fingerprint long").distinct()
