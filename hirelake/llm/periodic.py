"""Periodic runs of words: a suffix automaton whose last occurrences are recoloured by link-cut access.

The automaton of a stretch of words is built first; its suffix links form a tree in which the ancestors of a prefix's
state stand for the suffixes of that prefix. Each word in turn accesses its state: the path to the root is cut into
segments of equal last occurrence, and all of them take the new place. A segment whose last occurrence ends ``d`` words
before, with ``d`` at most its longest suffix, is a square of two times ``d`` words; extended to both sides it is a run.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import binary, bounded, documents, reachable

#: A run has this many words at least, and repeats its period this many times at least.
LEAST_WORDS, LEAST_TIMES = 6, 4
#: Words compared one by one before whole arrays are.
FEW = 16

_RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def stretches(ids: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int]]:
    """(begin, end) of the stretches in which every word occurs ``least_times`` times or more.

    Each word of a run occurs that often within the run, so no run reaches over a rarer word: the text is cut there,
    the pieces are counted again by themselves, and so on until nothing more falls away. No run is lost.
    """
    out, waiting = [], [(0, len(ids))]
    while waiting:
        lo, hi = waiting.pop()
        if hi - lo < least_words:
            continue
        _, own, counts = np.unique(ids[lo:hi], return_inverse=True, return_counts=True)
        often = counts[own] >= least_times
        if often.all():
            out.append((lo, hi))
            continue
        edge = np.diff(np.concatenate(([False], often, [False])).astype(np.int8))
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        long = end - begin >= least_words
        waiting += [(lo + b, lo + e) for b, e in zip(begin[long].tolist(), end[long].tolist())]
    return sorted(out)


def automaton(ids: list[int]) -> tuple[list[int], list[int], list[int]]:
    """Suffix automaton of ``ids``: suffix link and longest length of each state, and the state of each prefix."""
    link, longest, moves, prefix = [-1], [0], [{}], []
    last = 0
    for i, word in enumerate(ids):
        state = len(link)
        link.append(0)
        longest.append(i + 1)
        moves.append({})
        p = last
        while p >= 0 and word not in moves[p]:
            moves[p][word] = state
            p = link[p]
        if p >= 0:
            q = moves[p][word]
            if longest[q] == longest[p] + 1:
                link[state] = q
            else:
                clone = len(link)
                link.append(link[q])
                longest.append(longest[p] + 1)
                moves.append(moves[q].copy())
                while p >= 0 and moves[p].get(word) == q:
                    moves[p][word] = clone
                    p = link[p]
                link[q] = link[state] = clone
        last = state
        prefix.append(state)
    return link, longest, prefix


class LastOccurrences:
    """The tree of suffix links as a link-cut tree: each preferred path is a splay tree of one colour, which its root
    holds. The colour of a state is where its words last ended; -1 is nowhere."""

    def __init__(self, link: list[int], longest: list[int]):
        self.up, self.longest = list(link), longest  # within a path the parent in the splay tree, above it the path's parent
        self.shallow, self.deep = [-1] * len(link), [-1] * len(link)
        self.colour = [-1] * len(link)

    def _rotate(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        y = up[x]
        z = up[y]
        if shallow[y] == x:
            inner = shallow[y] = deep[x]
            deep[x] = y
        else:
            inner = deep[y] = shallow[x]
            shallow[x] = y
        if inner >= 0:
            up[inner] = y
        up[y], up[x] = x, z
        if z >= 0 and shallow[z] == y:
            shallow[z] = x
        elif z >= 0 and deep[z] == y:
            deep[z] = x
        else:
            self.colour[x] = self.colour[y]  # y was the root

    def _splay(self, x: int) -> None:
        up, shallow, deep = self.up, self.shallow, self.deep
        while (y := up[x]) >= 0 and (shallow[y] == x or deep[y] == x):
            z = up[y]
            if z >= 0 and (shallow[z] == y or deep[z] == y):
                self._rotate(y if (shallow[y] == x) == (shallow[z] == y) else x)
            self._rotate(x)

    def access(self, state: int, place: int) -> list[tuple[int, int]]:
        """(last place, longest words) of each segment between ``state`` and the root; all then take ``place``."""
        found, below, x = [], -1, state
        while x >= 0:
            self._splay(x)
            cut = self.deep[x]
            if cut >= 0:
                self.colour[cut] = self.colour[x]  # what lies deeper is a path of its own from now on
            if self.colour[x] >= 0:
                found.append((self.colour[x], self.longest[x]))
            self.deep[x] = below
            below, x = x, self.up[x]
        self.colour[below] = place
        self._splay(state)
        return found


def _equal_from(ids: np.ndarray, words: list[int], at: int, period: int) -> int:
    """First place from ``at`` on whose word is not the one ``period`` before."""
    n = len(words)
    stop = min(n, at + FEW)
    while at < stop and words[at] == words[at - period]:
        at += 1
    step = 4 * FEW
    while at == stop and at < n:
        stop = min(n, at + step)
        differ = np.flatnonzero(ids[at:stop] != ids[at - period:stop - period])
        at = at + int(differ[0]) if len(differ) else stop
        step *= 2
    return at


def runs_of_stretch(ids: np.ndarray, least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the maximal runs of ``ids``; ``period`` is the smallest one."""
    words = ids.tolist()
    link, longest, prefix = automaton(words)
    last, ends, out = LastOccurrences(link, longest), {}, []
    for i, state in enumerate(prefix):
        for place, reach in last.access(state, i):
            period = i - place
            if period > reach or i < ends.get(period, 0):  # no square, or within a run that is known
                continue
            start = i - 2 * period + 1
            while start and words[start - 1] == words[start - 1 + period]:
                start -= 1
            ends[period] = end = _equal_from(ids, words, i + 1, period)
            if end - start >= max(least_words, least_times * period):
                out.append((start, end - start, period))
    return out


def runs_of_words(words: list[bytes], least_words: int = LEAST_WORDS, least_times: int = LEAST_TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a text's words, by start, then period."""
    if len(words) < least_words:
        return []
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], dtype=np.int64)
    found = [(lo + start, length, period) for lo, hi in stretches(ids, least_words, least_times)
             for start, length, period in runs_of_stretch(ids[lo:hi], least_words, least_times)]
    return sorted(found, key=lambda r: (r[0], r[2]))


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    depth = np.zeros(len(words) + 1, dtype=np.int64)
    for start, length, period in runs:
        depth[start + period] += 1
        depth[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(depth[:-1]) == 0).tolist()]


Rewrite = Callable[[int | None, list[bytes]], list[bytes]]


def periodic_runs(docs: DataFrame, rewrite: Rewrite | None = None, least_words: int = LEAST_WORDS,
                  least_times: int = LEAST_TIMES) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for each row of ``docs`` (doc_id, text).

    Words are what white space (blank and U+0009 to U+000D) parts, whole texts. ``runs``: (start, length, period) of each
    stretch of consecutive words that repeats its smallest period ``least_times`` times or more over ``least_words``
    words or more and cannot be extended; by start, then period. Runs of different periods may overlap. ``collapsed``:
    the words outside of repeats, joined by one blank. ``rewrite(doc_id, words)`` may change a text's words first.

    A null text, and a text without words, has no run and an empty ``collapsed``. Rows that repeat a doc_id are texts of
    their own. An empty table gives no rows; further columns are left out. The rows are neither moved nor gathered; a
    task holds one text at a time, and the automaton takes memory in proportion to the longest stretch of repeating
    words in it.
    """
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            sizes, runs, collapsed = [], [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), binary(batch.column("text"))):
                words = text.split()  # bytes are split at exactly these six characters
                if rewrite is not None:
                    words = rewrite(doc_id, words)
                own = runs_of_words(words, least_words, least_times)
                sizes.append(len(words))
                runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                collapsed.append(b" ".join(without_repeats(words, own)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()),
                 pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                 pa.array(collapsed, pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    return documents(docs).mapInArrow(run, f"doc_id long, n_words long, runs {_RUNS}, collapsed string")


def periodic_tail(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The rewriting of the contract: one document in ten goes on with a piece of itself, again and again."""
    h, n = zlib.crc32(str("" if doc_id is None else doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + k % p] for k in range(n - a)]


def run_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run of the greatest length / period (start, length, period, exponent_milli), runs_sha256,
    collapsed_sha256. A null doc_id is rewritten as the empty text would be."""
    found = periodic_runs(docs, periodic_tail)
    # Ratios are compared exactly; the runs come by start, then period, so the first of equals stays.
    best = F.expr("aggregate(runs, get(runs, 0), (b, r) -> if(r.length * b.period > b.length * r.period, r, b))")
    listed = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("best.start").alias("start"), F.col("best.length").alias("length"),
        F.col("best.period").alias("period"), F.expr("best.length * 1000 div best.period").alias("exponent_milli"),
        F.sha2(F.encode(F.when(F.size("runs") > 0, F.concat(listed, F.lit("\n"))).otherwise(F.lit("")), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"))
