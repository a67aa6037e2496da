"""Packing of token sequences by cutting stock: column generation over length classes, then ranks mapped to patterns."""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import binary, bounded, documents, reachable, settle

CAPACITY = 2048
#: Lengths are rounded up to a multiple of this many tokens for the linear program.
UNIT = 8
END_ID = 1
#: Words whose ids a Python worker remembers.
REMEMBERED = 1 << 20


_TAIL = b".,!?;:"


# What a tokenizer file must say for its texts to be encoded word by word: white space parts tokens, case does not count,
# and letters, single digits and marks are parted from each other, so that end marks are tokens of their own.
_PARTED = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "</w>",
)


class WordIds:
    """Ids of white-space parted words, remembered, for tokenizer files whose traits are those of ``_PARTED``. With any
    other file whole texts are encoded."""

    def __init__(self, model: bytes):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark has given the task its core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_buffer(model)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {b"": b""}
        said = json.loads(model)
        traits = said.get("normalizer"), said.get("pre_tokenizer"), said["model"].get("end_of_word_suffix")
        self.by_word = traits == _PARTED and not said["model"].get("dropout") and not said.get("truncation")

    def _learn(self, words: list[bytes]) -> None:
        """Encode new words. Words of letters alone are encoded many in one text: each ends in one id that ends a word;
        should a text have more such ids than words, its words are encoded one by one."""
        letters = [w for w in words if w.decode(errors="replace").isalpha()]
        single = list(set(words).difference(letters))
        for start in range(0, len(letters), 256):
            some = letters[start:start + 256]
            ids = np.array(self.tokenizer.encode(b" ".join(some).decode(), add_special_tokens=False).ids, dtype="<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) != len(some):
                single += some
                continue
            octets, stops = ids.tobytes(), (4 * ends).tolist()
            self.known.update((word, octets[lo:hi]) for word, lo, hi in zip(some, [0, *stops], stops))
        for start in range(0, len(single), 4096):
            some = single[start:start + 4096]
            found = self.tokenizer.encode_batch_fast([w.decode(errors="replace") for w in some], add_special_tokens=False)
            self.known.update((word, np.array(one.ids, dtype="<u4").tobytes()) for word, one in zip(some, found))

    def _prepare(self, new: set[bytes]) -> None:
        cores = {}
        for word in new:
            core = word.rstrip(_TAIL)
            if core != word and core[-1:].isalnum():
                cores[word] = core
        needed = (new - cores.keys()).union(cores.values(), (word[len(core):] for word, core in cores.items()))
        self._learn(list(needed.difference(self.known)))
        self.known.update((word, self.known[core] + self.known[word[len(core):]]) for word, core in cores.items())

    def encode(self, texts: list[bytes] | pa.Array) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text.

        The words of all texts together are numbered, each different one is looked up once, and the id runs are put
        together by number.
        """
        texts = texts if isinstance(texts, pa.Array) else pa.array([t.decode() for t in texts], pa.string())
        if not self.by_word:
            for one in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False):
                yield np.array(one.ids, dtype="<u4").tobytes()
            return
        words = pc.ascii_split_whitespace(pc.ascii_lower(texts))
        coded = words.flatten().dictionary_encode()
        names = binary(coded.dictionary)
        new = set(names).difference(self.known)
        if len(self.known) + len(new) > REMEMBERED:
            self.known, new = {b"": b""}, set(names) - {b""}
        self._prepare(new)
        runs = [self.known[w] for w in names]
        size = np.fromiter(map(len, runs), dtype=np.int64, count=len(runs)) // 4
        ids, first, number = np.frombuffer(b"".join(runs), dtype="<u4"), np.cumsum(size) - size, coded.indices.to_numpy()
        ends = np.cumsum(size[number])
        places = np.arange(ends[-1] if len(ends) else 0) + np.repeat(first[number] - ends + size[number], size[number])
        out, bounds = ids[places], np.concatenate(([0], ends))[words.offsets.to_numpy() - words.offsets[0].as_py()]
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            yield out[lo:hi].tobytes()


_LOADED: dict[bytes, WordIds] = {}


def pieces(docs: DataFrame, model_path: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, size, part, nth): a document's ids and ``end_id``, cut at every
    ``capacity`` ids; size is the length class, nth the number of pieces of that class before this one in the task."""
    reachable(docs.sparkSession)
    with open(model_path, "rb") as file:  # on the driver; executors get the bytes, whose size is that of the vocabulary
        content = file.read()
    model, key = docs.sparkSession.sparkContext.broadcast(content), hashlib.sha256(content).digest()
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if key not in _LOADED:
            _LOADED[key] = WordIds(model.value)
        words = _LOADED[key]
        part, seen = TaskContext.get().partitionId(), {}
        for batch in bounded(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), words.encode(batch.column("text"))):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, capacity):
                    own = ids[4 * start:4 * (start + capacity)]
                    size = -(-len(own) // (4 * unit))
                    nth = seen[size] = seen.get(size, -1) + 1
                    rows.append((doc_id, start, len(own) // 4, zlib.crc32(own), total, size, part, nth))
            names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "size", "part", "nth")
            kinds = (*[pa.int64()] * 5, pa.int32(), pa.int32(), pa.int64())
            columns = list(zip(*rows)) or [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    return documents(docs).mapInArrow(
        run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, size int, part int, nth long")


# ---- the linear program over the histogram of length classes: at most capacity / unit rows, whatever the input -------

def best_pattern(prices: np.ndarray, sizes: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the dearest multiset of sizes that fits, as copies per size."""
    best, choice = np.zeros(room + 1), np.full(room + 1, -1)
    for filled in range(1, room + 1):
        best[filled] = best[filled - 1]
        fit = np.flatnonzero(sizes <= filled)
        if len(fit):
            worth = best[filled - sizes[fit]] + prices[fit]
            k = int(worth.argmax())
            if worth[k] > best[filled]:
                best[filled], choice[filled] = worth[k], fit[k]
    copies, filled = np.zeros(len(sizes), dtype=np.int64), room
    while filled > 0:
        if choice[filled] < 0:
            filled -= 1
        else:
            copies[choice[filled]] += 1
            filled -= sizes[choice[filled]]
    return float(best[room]), copies


def fractional_patterns(sizes: np.ndarray, demand: np.ndarray, room: int, gap: float = 1e-3) -> list[tuple[np.ndarray, float]]:
    """Column generation: minimise the number of sequences so that each size occurs ``demand`` times at least.

    Starts from patterns of one size; the knapsack prices new columns with the dual values; ends when the bound from
    the dual values is within ``gap`` of the value reached. Gives the basic patterns and how often each is used.
    """
    n = len(sizes)
    columns = [np.where(np.arange(n) == i, room // sizes[i], 0).astype(float) for i in range(n)]
    cost = np.ones(n)
    inverse = np.diag([1 / columns[i][i] for i in range(n)])
    used = inverse @ demand
    for _ in range(50 * n + 100):
        prices = cost @ inverse
        lowest = int(prices.argmin())
        if prices[lowest] < -1e-9:  # producing more than is asked for is allowed
            entering, price = -np.eye(n)[lowest], 0.0
        else:
            worth, copies = best_pattern(prices, sizes, room)
            if worth <= 1 + 1e-9 or prices @ demand / worth >= (1 - gap) * (cost @ used):
                break
            entering, price = copies.astype(float), 1.0
        step = inverse @ entering
        ratios = np.full(n, np.inf)
        ratios[step > 1e-9] = np.maximum(used[step > 1e-9], 0) / step[step > 1e-9]
        leaving = int(ratios.argmin())
        amount = ratios[leaving]
        used = used - amount * step
        used[leaving] = amount
        row = inverse[leaving] / step[leaving]
        inverse = inverse - np.outer(step, row)
        inverse[leaving] = row
        columns[leaving], cost[leaving] = entering, price
    return [(columns[i].astype(np.int64), float(used[i])) for i in range(n) if cost[i] and used[i] > 0]


def packing_plan(histogram: dict[int, int], room: int) -> list[tuple[int, dict[int, int]]]:
    """[(times, {size: copies})] that uses up the histogram exactly: rounded-down patterns, then the rest packed by
    filling one sequence after another with the largest sizes left."""
    sizes = np.array(sorted(histogram, reverse=True), dtype=np.int64)
    left = np.array([histogram[int(s)] for s in sizes], dtype=np.int64)
    plan: list[tuple[int, dict[int, int]]] = []

    def take(copies: np.ndarray, times: int) -> None:
        nonlocal left
        on = copies > 0
        times = min(times, int((left[on] // copies[on]).min())) if on.any() else 0
        if times:
            left = left - times * copies
            plan.append((times, {int(s): int(c) for s, c in zip(sizes[on], copies[on])}))

    if len(sizes):
        for copies, times in sorted(fractional_patterns(sizes, left.astype(float), room), key=lambda x: -x[1]):
            take(copies, int(times + 1e-6))
    while left.any():
        copies, space = np.zeros_like(left), room
        for i in np.flatnonzero(left):
            copies[i] = min(left[i], space // sizes[i])
            space -= int(copies[i] * sizes[i])
        take(copies, int(left.max()))
    return plan


def slots(plan: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, from_rank, to_rank, copies, first_sequence, place): which ranks of a size go to which sequences."""
    out, used, sequence = [], {}, 0
    for times, pattern in plan:
        for place, (size, copies) in enumerate(pattern.items()):
            start = used.get(size, 0)
            used[size] = start + times * copies
            out.append((size, start, used[size], copies, sequence, place))
        sequence += times
    return out


def pack(docs: DataFrame, model_path: str, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row per piece of a document.

    A document longer than ``capacity`` is cut into full pieces and a rest. The histogram of length classes (a bounded
    number of counts) is all that reaches the driver; its linear program gives patterns, and pieces are assigned to
    them by rank within their class. Ranks come from per-task counts, so no class is gathered anywhere, however
    frequent. The slots that are broadcast are bounded: at most twice as many patterns as classes, each of at most
    ``capacity / unit`` sizes. A null or empty text is the single id ``end_id``; repeated rows are packed each; a null
    doc_id stays null; an empty table gives no rows.
    """
    spark = docs.sparkSession
    cut = settle(pieces(docs, model_path, capacity, unit, end_id), "pieces")
    counts = settle(cut.groupBy("size", "part").agg(F.count("*").alias("n")), "piece-counts")
    histogram = {r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}
    plan = spark.createDataFrame(slots(packing_plan(histogram, capacity // unit)),
                                 "size int, from_rank long, to_rank long, copies long, first_sequence long, place int")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranked = (cut.join(counts.select("size", "part", before.alias("before")), ["size", "part"])
              .withColumn("rank", F.col("before") + F.col("nth")))
    placed = ranked.alias("r").join(F.broadcast(plan).alias("s"), (F.col("r.size") == F.col("s.size")) & (F.col("rank") >= F.col("from_rank")) & (F.col("rank") < F.col("to_rank")))
    within = F.col("rank") - F.col("from_rank")
    placed = placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("first_sequence") + F.expr("(rank - from_rank) div copies")).alias("sequence_id"),
        "place", (within % F.col("copies")).alias("copy"))
    along = Window.partitionBy("sequence_id").orderBy("place", "copy")
    return placed.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id",
        F.coalesce(F.sum("length").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("offset"))
