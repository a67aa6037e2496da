"""Spelling variants: words one edit apart, by dense tiles of code-point matrices within blocks of equal remainders.

Two words of which the shorter has ``l`` code points and that differ by one edit at place ``p`` (the length of their
common start, 0 to ``l``) agree in all that lies before and behind the piece of the places that holds ``p``. With the
places cut into three pieces, words are compared only within blocks that agree in the other two. A block of many words
is dealt again by every single place of its piece, where a block holds the few words that one code point tells apart.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hirelake.llm.common import bounded, documents, reachable, settle, sorted_runs

#: Code points a word has, and times it occurs, at least; how many times more frequent a form is.
LEAST_LENGTH, LEAST_TIMES, FORM_TIMES = 7, 2, 10
#: One in so many (document, run) pairs loses a code point, by the contract of the query.
DAMAGED = 31
#: Rows of a block that are compared with each other as they are; a larger block is dealt by single places.
MOST = 256
#: Cells of a tile, words counted together in a task.
CELLS, TOGETHER = 1 << 22, 200_000

_FOLD = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_LETTERS = "a-zÀ-ÿ"
_BLOCK = ["l", "piece", "place", "key"]


def damaged(doc_id: int | None) -> int:
    """State of the checksum of ``<doc_id>:``, which a run's octets go on from; a null id is the empty text."""
    return zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())


def word_counts(docs: DataFrame, least_length: int = LEAST_LENGTH, least_times: int = LEAST_TIMES, every: int | None = None) -> DataFrame:
    """(word, n): the letter runs of all texts, A-Z lower-cased, that have ``least_length`` code points and occur
    ``least_times`` times. With ``every`` a run whose checksum with its document's id is a multiple of it loses one
    code point first. Texts are counted within a task before anything is shuffled."""
    reachable(docs.sparkSession)
    letters = re.compile(f"[{_LETTERS}]{{{least_length},}}")  # greedy, so a match is a whole run

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"word": pa.array(held.keys(), pa.string()), "n": pa.array(held.values(), pa.int64())})

        for batch in bounded(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()):
                own = Counter(letters.findall(text.translate(_FOLD).decode()))
                if every:
                    start = damaged(doc_id)
                    for run in [w for w in own if zlib.crc32(w.encode(), start) % every == 0]:
                        n, place = own[run], zlib.crc32(run.encode(), start) % len(run)
                        held[run[:place] + run[place + 1:]] += n
                        del own[run]
                held.update(own)
            if len(held) > TOGETHER:
                yield out()
                held.clear()
        yield out()

    counted = documents(docs).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter((F.col("n") >= least_times) & (F.char_length("word") >= least_length))


def _rest(word: str, l: Column, begin: Column, end: Column) -> Column:
    """Hash of what a word has before the places from ``begin`` to ``end`` and behind them, counted from its end."""
    behind = F.greatest(F.lit(0), l - end)
    return F.xxhash64(F.substring(word, F.lit(1), begin), F.substring(word, F.char_length(word) - behind + 1, behind))


def _pieces(words: DataFrame, least_length: int) -> DataFrame:
    """Each word once for each block it belongs to: l (code points of the shorter word), piece, place (-1), key."""
    def bounds(l: Column) -> list[tuple[Column, Column]]:
        first, second = F.floor((l + 1) / 3).cast("int"), F.floor(2 * (l + 1) / 3).cast("int")
        return [(F.lit(0), first), (first, second), (second, l + 1)]

    def block(l: Column, i: int, begin: Column, end: Column) -> Column:
        return F.struct(l.alias("l"), F.lit(i).alias("piece"), _rest("word", l, begin, end).alias("key"), begin.alias("begin"), end.alias("end"))

    length = F.char_length("word")
    of = [block(l, i, *ends) for l in (length, length - 1) for i, ends in enumerate(bounds(l))]
    return words.withColumn("block", F.explode(F.array(*of))).select("word", "n", "block.*").filter(F.col("l") >= least_length)


def matrix(words: list[str], right: bool = False) -> np.ndarray:
    """Code points of the words, a row each, padded by zeros at the end (``right``: at the start)."""
    widest = max(map(len, words), default=0) or 1
    return np.array([w.rjust(widest, "\0") for w in words] if right else words, dtype=f"U{widest}").view(np.uint32).reshape(len(words), widest)


def _first_difference(a: np.ndarray, b: np.ndarray, backward: bool = False) -> np.ndarray:
    """Code points on which two words agree from the start (``backward``: from the end); rows differ somewhere."""
    differ = (a != b)[..., ::-1] if backward else a != b
    return differ.argmax(axis=-1)


def near_pairs(words: list[str], lengths: np.ndarray, least: np.ndarray, begin: np.ndarray, end: np.ndarray,
               at: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of words one edit apart within the runs of rows that ``at`` bounds.

    Short runs are compared row against row at equal distances, many runs at once; the others in tiles of rows against
    rows. A pair counts where the shorter word has ``least`` code points and the edit lies from ``begin`` to ``end``, so
    it is found in one run only.
    """
    left, right = [np.empty(0, dtype=np.int64)], [np.empty(0, dtype=np.int64)]

    def keep(i: np.ndarray, j: np.ndarray, start: np.ndarray, stop: np.ndarray) -> None:
        longer, shorter = np.maximum(lengths[i], lengths[j]), np.minimum(lengths[i], lengths[j])
        good = (start + stop >= longer - 1) & (shorter == least[i]) & (longer - shorter <= 1) & (start >= begin[i]) & (start < end[i])
        left.append(np.minimum(i[good], j[good]))
        right.append(np.maximum(i[good], j[good]))

    size = np.diff(at)
    widest = np.maximum.reduceat(lengths, at[:-1]) if len(size) else size
    small = (size <= 16) & (size > 1)
    chunk, cost = [], 0
    waiting = [*np.flatnonzero(small).tolist(), -1]
    for r in waiting:  # short runs are gathered up to a number of cells
        if chunk and (r < 0 or cost + size[r] * widest[r] > cells or widest[r] > 2 * widest[chunk[0]] + 16):
            rows = np.concatenate([np.arange(at[k], at[k + 1]) for k in chunk])
            of = np.repeat(np.arange(len(chunk)), size[chunk])
            own = [words[k] for k in rows.tolist()]
            ahead, behind = matrix(own), matrix(own, right=True)
            for shift in range(1, int(size[chunk].max())):
                i = np.flatnonzero(of[:-shift] == of[shift:])
                j = i + shift
                keep(rows[i], rows[j], _first_difference(ahead[i], ahead[j]), _first_difference(behind[i], behind[j], True))
            chunk, cost = [], 0
        if r >= 0:
            chunk.append(r)
            cost += int(size[r] * widest[r])
    for r in np.flatnonzero(size > 16).tolist():
        lo, hi = int(at[r]), int(at[r + 1])
        side = max(1, int((cells / widest[r]) ** 0.5))
        tiles = [(t, min(hi, t + side)) for t in range(lo, hi, side)]
        for x, (a, b) in enumerate(tiles):
            for c, d in tiles[x:]:
                own = words[a:b] + words[c:d]
                ahead, behind = matrix(own), matrix(own, right=True)
                start = _first_difference(ahead[:b - a, None], ahead[None, b - a:])
                stop = _first_difference(behind[:b - a, None], behind[None, b - a:], True)
                i, j = np.divmod(np.arange(start.size), d - c)
                wanted = (a + i) < (c + j)
                keep((a + i)[wanted], (c + j)[wanted], start.ravel()[wanted], stop.ravel()[wanted])
    return np.concatenate(left), np.concatenate(right)


def near_words(words: DataFrame, least_length: int = LEAST_LENGTH, most: int = MOST) -> DataFrame:
    """(word, n, near, near_n): all pairs of different words that one inserted, deleted or replaced code point tells
    apart, in both directions, each once.

    ``words``: word (not null, each once, of ``least_length`` code points or more), n. A word goes to six blocks at
    most; blocks are counted first, and words alone in a block are not moved on. A block of over ``most`` words is
    dealt by the single places of its piece: there at most as many words agree as there are code points to put in that
    place (twice: for the longer words), whatever the size of the table. All pairs are found, none is left to chance.
    """
    reachable(words.sparkSession)
    pieces = _pieces(words, least_length)
    counted = settle(pieces.groupBy("l", "piece", "key").agg(F.count("*").alias("rows")).filter("rows > 1"), "spelling-blocks")
    many = F.col("rows") > most
    dealt = (pieces.join(counted, ["l", "piece", "key"])
             .withColumn("place", F.explode(F.when(many, F.sequence("begin", F.col("end") - 1)).otherwise(F.array(F.lit(-1)))))
             .withColumn("begin", F.when(many, F.col("place")).otherwise(F.col("begin")))
             .withColumn("end", F.when(many, F.col("place") + 1).otherwise(F.col("end")))
             .withColumn("key", F.when(many, _rest("word", F.col("l"), F.col("begin"), F.col("end"))).otherwise(F.col("key")))
             .drop("rows"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in sorted_runs(batches, _BLOCK):
            own, n = part.column("word").to_pylist(), part.column("n").combine_chunks().to_numpy()
            least, begin, end = (part.column(c).combine_chunks().to_numpy() for c in ("l", "begin", "end"))
            lengths = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
            i, j = near_pairs(own, lengths, least, begin, end, at)
            texts = part.column("word").combine_chunks()
            a, b = np.concatenate((i, j)), np.concatenate((j, i))
            yield pa.RecordBatch.from_arrays([texts.take(pa.array(a)), pa.array(n[a]), texts.take(pa.array(b)), pa.array(n[b])],
                                             ["word", "n", "near", "near_n"])

    return dealt.repartition(*_BLOCK).sortWithinPartitions(*_BLOCK).mapInArrow(compare, "word string, n long, near string, near_n long")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for each row (word, form) of ``forms``: the last word that is reached by following forms.

    Each round doubles the steps that a pointer spans. A form is more frequent than its word, so chains end, after a
    number of steps that grows with the logarithm of the largest count.
    """
    current = settle(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = current.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if current.join(ahead, "root", "left_semi").isEmpty():
            return current
        current = settle(current.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-roots")


def spelling_variants(words: DataFrame, least_length: int = LEAST_LENGTH, form_times: int = FORM_TIMES, most: int = MOST) -> DataFrame:
    """word, form, root, n, n_near, form_n for each row of ``words`` (word, n).

    ``n_near``: words one edit apart. ``form``: the most frequent of them (of several the first in code-point order) if
    it occurs ``form_times`` times as often as the word or more, else null; ``form_n`` its count. ``root``: where
    following forms ends, the word itself without a form. An empty table gives no rows.
    """
    nearest = near_words(words, least_length, most).groupBy("word").agg(
        F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("nearest"))
    found = words.join(nearest, "word", "left")
    enough = -F.col("nearest.less") >= form_times * F.col("n")
    formed = settle(found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("nearest.near")).alias("form"),
        F.when(enough, -F.col("nearest.less")).alias("form_n")), "spelling-forms")
    ends = roots(formed.filter("form IS NOT NULL"))
    return formed.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variant_groups(docs: DataFrame, every: int | None = DAMAGED) -> DataFrame:
    """``spelling_variants`` of the words of ``docs`` (doc_id, text), whole texts, counted over all rows.

    A null text has no words; a null doc_id counts as the empty text in the checksum; rows that repeat a doc_id or a
    text count again. Further columns are left out, an empty table gives no rows.
    """
    return spelling_variants(settle(word_counts(docs, every=every), "spelling-words"))
