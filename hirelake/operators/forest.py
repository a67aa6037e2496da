"""Trees of a random forest, grown deep without a pass over all rows for each level.

Rows are binned once. A node that holds many rows is split by a sum over all tasks; as soon as a node holds at most
``most`` rows, these are brought together and the whole subtree below it is grown there. Both use the same split search
over the same bins, weights and row statistics, so the trees do not depend on ``most``, and neither a task nor the driver ever
holds more rows than that. Only bins in which a node has rows are counted, so a small node costs as much as its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hirelake.session import reachable, settle

BINS = 32
#: Rows of a tree below a node that are brought together in one task.
MOST_ROWS = 500_000
#: Different values of a feature that a task keeps for its bounds; above it, runs of equal weight become one value each.
MOST_VALUES = 4096
#: A split has to explain more than this share of the variance of all labels; less is rounding.
LEAST_GAIN = 1e-12
#: Weights of a bootstrap sample are Poisson(1); the chance of more than 12 is below 1e-10.
_POISSON = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 13)]))

NODE = "tree int, heap long, w double, s double, q double, gain double, slot int"
NODE_DATA = """struct<id:int, prediction:double, impurity:double, impurityStats:array<double>, rawCount:bigint, gain:double,
  leftChild:int, rightChild:int, split:struct<featureIndex:int, leftCategoriesOrThreshold:array<double>, numCategories:int>>"""


class Layout(NamedTuple):
    """Slots are the bounds of all features in one row: a value is above the bounds up to the slot it is put in."""

    first: np.ndarray  # first slot of each feature, and the number of slots
    bound: np.ndarray  # of each slot

    @property
    def feature(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


class Rows(NamedTuple):
    """Rows of a tree: where each row's slots begin, the highest slot of each feature in which it has one, weight, label."""

    start: np.ndarray
    slot: np.ndarray
    w: np.ndarray
    y: np.ndarray

    def take(self, keep: np.ndarray) -> Rows:
        sizes = np.diff(self.start)
        return Rows(_starts(sizes[keep]), self.slot[np.repeat(keep, sizes)], self.w[keep], self.y[keep])

    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.w)), np.diff(self.start))


def _starts(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


# ---- bins ---------------------------------------------------------------------------------------------------------

def _entries(vectors: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, feature, value) of what the vectors hold explicitly."""
    values, indices = vectors.field("values"), vectors.field("indices")
    sizes = pc.list_value_length(values).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(vectors)), sizes)
    feature = np.arange(len(row)) - np.repeat(_starts(sizes)[:-1], sizes)
    sparse = np.repeat(vectors.field("type").to_numpy(zero_copy_only=False) == 0, sizes)
    feature[sparse] = indices.flatten().to_numpy(zero_copy_only=False)
    return row, feature, values.flatten().to_numpy(zero_copy_only=False)


def _merged(feature: np.ndarray, value: np.ndarray, count: np.ndarray, most: int = MOST_VALUES):
    """Equal values of a feature together; of a feature with more than ``most`` the last of each run of equal weight."""
    order = np.lexsort((value, feature))
    feature, value, count = feature[order], value[order], count[order]
    new = np.ones(len(feature), dtype=bool)
    new[1:] = (feature[1:] != feature[:-1]) | (value[1:] != value[:-1])
    at = np.flatnonzero(new)
    feature, value, count = feature[at], value[at], np.add.reduceat(count, at) if len(at) else count
    begin = np.flatnonzero(np.concatenate([[True], feature[1:] != feature[:-1]])) if len(feature) else at
    sizes = np.diff(np.append(begin, len(feature)))
    if not len(begin) or sizes.max() <= most:
        return feature, value, count
    group = np.repeat(np.arange(len(begin)), sizes)
    total = np.add.reduceat(count, begin)[group]
    run = np.cumsum(count)
    part = np.where(sizes[group] > most, (run - np.repeat(run[begin] - count[begin], sizes)) * (most // 2) // total, np.arange(len(group)))
    last = np.flatnonzero(np.append((part[1:] != part[:-1]) | (group[1:] != group[:-1]), True))
    return feature[last], value[last], np.diff(np.concatenate([[0], run[last]]))


def _bounds(value: np.ndarray, count: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Middles between neighbouring values: all of them, or those nearest to equal shares of the rows."""
    if len(value) < 2:
        return np.zeros(0)
    middle = (value[:-1] + value[1:]) / 2
    if len(value) <= bins:
        return middle
    run = np.cumsum(count)
    wanted = run[-1] * np.arange(1, bins) / bins
    at = np.clip(np.searchsorted(run, wanted), 0, len(middle) - 1)
    return middle[np.unique(at)]


def layout_of(df: DataFrame, features: str, width: int) -> Layout:
    """Bounds of each feature over all rows, at most ``BINS - 1``."""
    reachable(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = (np.zeros(0, dtype=np.int64), np.zeros(0), np.zeros(0, dtype=np.int64)), 0
        for batch in batches:
            _, feature, value = _entries(batch.column(0))
            rows += batch.num_rows
            held = _merged(*(np.concatenate(pair) for pair in zip(held, (feature, value + 0.0, np.ones(len(value), dtype=np.int64)))))
        given = np.bincount(held[0], weights=held[2], minlength=width).astype(np.int64)
        missing = np.flatnonzero(given < rows)  # what a vector does not hold is zero
        feature, value, number = (np.concatenate(pair) for pair in zip(held, (missing, np.zeros(len(missing)), rows - given[missing])))
        yield pa.RecordBatch.from_arrays([pa.array(feature), pa.array(value), pa.array(number)], ["feature", "value", "n"])

    def cut(group: pd.DataFrame) -> pd.DataFrame:
        _, value, number = _merged(np.zeros(len(group), dtype=np.int64), group["value"].to_numpy(), group["n"].to_numpy(), len(group))
        return pd.DataFrame({"feature": group["feature"].iloc[:1].to_numpy(), "bounds": [_bounds(value, number).tolist()]})

    counted = df.select(features).mapInArrow(count, "feature long, value double, n long")
    found = {r["feature"]: r["bounds"] for r in counted.groupBy("feature").applyInPandas(cut, "feature long, bounds array<double>").collect()}
    per = [found.get(i, []) for i in range(width)]
    return Layout(_starts(np.array([len(b) for b in per])), np.array([x for b in per for x in b]))


def binned(df: DataFrame, label: str, features: str, layout: Layout) -> DataFrame:
    """(row, label, slots), written once, so that a row keeps its number."""
    reachable(df.sparkSession)
    sizes = np.diff(layout.first)
    table = np.full((len(sizes), max(1, int(sizes.max(initial=0)))), np.inf)
    for feature, size in enumerate(sizes):
        table[feature, :size] = layout.bound[layout.first[feature]:layout.first[feature] + size]
    zero = np.flatnonzero((table < 0).any(axis=1))  # features in which a zero is above some bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, feature, value = _entries(batch.column("_features"))
            absent = np.ones((batch.num_rows, len(sizes)), dtype=bool)[:, zero]
            place = np.full(len(sizes), -1)
            place[zero] = np.arange(len(zero))
            held = place[feature] >= 0
            absent[row[held], place[feature[held]]] = False
            more, which = np.nonzero(absent)
            row, feature, value = np.concatenate([row, more]), np.concatenate([feature, zero[which]]), np.concatenate([value, np.zeros(len(more))])
            above = (value[:, None] > table[feature]).sum(axis=1)
            row, slot = row[above > 0], (layout.first[feature] + above - 1)[above > 0]
            order = np.lexsort((slot, row))
            starts = _starts(np.bincount(row, minlength=batch.num_rows))
            lists = pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(slot[order].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("label"), lists], ["row", "label", "slots"])

    numbered = df.select(F.monotonically_increasing_id().alias("row"), F.col(label).cast("double").alias("label"), F.col(features).alias("_features"))
    return settle(numbered.mapInArrow(run, "row long, label double, slots array<int>"), "binned")


# ---- split search -------------------------------------------------------------------------------------------------

def _mixed(x: np.ndarray) -> np.ndarray:
    """Splitmix64: well spread bits of whole numbers."""
    x = x.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def weights(row: np.ndarray, tree: int, seed: int) -> np.ndarray:
    """How often each row is in the tree's sample. It depends on the row's number only, so every pass finds the same."""
    own = _mixed(np.array([seed]))[0] ^ _mixed(np.array([tree + 1]) * 1_000_003)[0]
    share = (_mixed(_mixed(row) ^ own) >> np.uint64(11)) / 2.0 ** 53
    return np.searchsorted(_POISSON, share, side="right").astype(np.float64)


def _sums(place: np.ndarray, w: np.ndarray, y: np.ndarray, size: int) -> np.ndarray:
    return np.stack([np.bincount(place, weights=w, minlength=size), np.bincount(place, weights=w * y, minlength=size)], axis=1)


def cells(rows: Rows, node: np.ndarray, nodes: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(node · slots + slot in order, (weight, label sum)) of each slot in which a node has rows."""
    owner = rows.owner()
    key = node[owner] * slots + rows.slot
    w, y = rows.w[owner], rows.y[owner]
    if nodes * slots <= 4 * len(key) + 1000:
        all_sums = _sums(key, w, y, nodes * slots)
        found = np.flatnonzero(all_sums[:, 0])
        return found, all_sums[found]
    found, place = np.unique(key, return_inverse=True)
    return found, _sums(place, w, y, len(found))


def _score(sums: np.ndarray) -> np.ndarray:
    return sums[:, 1] ** 2 / sums[:, 0]


def best_splits(key: np.ndarray, sums: np.ndarray, totals: np.ndarray, layout: Layout) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each node (slot whose bound is the best split or -1, gain in variance, sums of the rows above the bound)."""
    slots, nodes = layout.first[-1], len(totals)
    slot, gain, above = np.full(nodes, -1), np.zeros(nodes), np.zeros((nodes, 2))
    if not len(key):
        return slot, gain, above
    node, at = np.divmod(key, slots)
    group = node * len(layout.first) + layout.feature[at]
    last = np.append(np.flatnonzero(group[1:] != group[:-1]), len(group) - 1)
    run = np.concatenate([np.cumsum(sums[::-1], axis=0)[::-1], np.zeros((1, 2))])
    higher = run[:-1] - np.repeat(run[last + 1], np.diff(np.concatenate([[-1], last])), axis=0)
    lower = totals[node] - higher
    ok = lower[:, 0] > 0.5
    node, at, higher, lower = node[ok], at[ok], higher[ok], lower[ok]
    if not len(node):
        return slot, gain, above
    own = (_score(higher) + _score(lower) - _score(totals)[node]) / totals[node, 0]
    begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
    top = np.maximum.reduceat(own, begin)
    hits = np.flatnonzero(own == np.repeat(top, np.diff(np.append(begin, len(own)))))
    hits = hits[np.unique(node[hits], return_index=True)[1]]
    slot[node[hits]], gain[node[hits]], above[node[hits]] = at[hits], own[hits], higher[hits]
    return slot, gain, above


def goes_up(rows: Rows, chosen: np.ndarray, layout: Layout) -> np.ndarray:
    """Is each row above the bound ``chosen`` for it?"""
    owner, end = rows.owner(), layout.first[1:][layout.feature]
    wanted = chosen[owner]
    up = np.zeros(len(rows.w), dtype=bool)
    up[owner[(rows.slot >= wanted) & (rows.slot < end[wanted])]] = True
    return up


def grow(rows: Rows, heap: int, depth: int, layout: Layout, least: float) -> dict[str, np.ndarray]:
    """All nodes below and with the node ``heap``; the children of node i are 2i and 2i + 1, the root of a tree is 1."""
    ids, node, out = np.array([heap], dtype=np.int64), np.zeros(len(rows.w), dtype=np.int64), []
    while len(ids):
        totals = _sums(node, rows.w, rows.y, len(ids))
        square = np.bincount(node, weights=rows.w * rows.y ** 2, minlength=len(ids))
        slot, gain = np.full(len(ids), -1), np.zeros(len(ids))
        if ids[0] < 1 << depth:
            slot, gain, _ = best_splits(*cells(rows, node, len(ids), layout.first[-1]), totals, layout)
            slot[gain <= least] = -1
        out.append({"heap": ids, "w": totals[:, 0], "s": totals[:, 1], "q": square, "gain": gain, "slot": slot})
        keep = slot[node] >= 0
        rows, node = rows.take(keep), node[keep]
        split = np.flatnonzero(slot >= 0)
        place = np.zeros(len(ids), dtype=np.int64)
        place[split] = np.arange(len(split))
        node = 2 * place[node] + goes_up(rows, slot[node], layout) if len(node) else node
        ids = np.stack([2 * ids[split], 2 * ids[split] + 1], axis=1).ravel()
    return {name: np.concatenate([part[name] for part in out]) for name in out[0]}


# ---- passes over all rows -----------------------------------------------------------------------------------------

def _read(batch: pa.RecordBatch) -> tuple[np.ndarray, Rows]:
    lists = batch.column("slots")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    return batch.column("row").to_numpy(), Rows(
        _starts(sizes), lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.zeros(len(sizes)), batch.column("label").to_numpy())


def _sampled(batch: pa.RecordBatch, splits: dict[int, dict[int, int]], seed: int, layout: Layout) -> Iterator[tuple[int, np.ndarray, Rows]]:
    """(tree, node that each row has reached in ``splits``, rows of its sample)"""
    number, rows = _read(batch)
    for tree, own in splits.items():
        w = weights(number, tree, seed)
        mine = rows._replace(w=w).take(w > 0)
        heap = np.ones(len(mine.w), dtype=np.int64)
        known, slot = np.array(sorted(own), dtype=np.int64), np.array([own[h] for h in sorted(own)], dtype=np.int64)
        moving = np.ones(len(heap), dtype=bool) if len(known) else np.zeros(len(heap), dtype=bool)
        while moving.any():
            at = np.minimum(np.searchsorted(known, heap), len(known) - 1)
            moving = known[at] == heap
            heap = np.where(moving, 2 * heap + goes_up(mine, slot[at], layout), heap)
        yield tree, heap, mine


def _split_large(table: DataFrame, splits: dict, frontier: dict[int, list[int]], seed: int, layout: Layout, least: float) -> list:
    """One pass over all rows: the nodes of ``frontier``, each with its best split and the weight above it."""
    slots = int(layout.first[-1])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, heap, rows in _sampled(batch, {t: splits[t] for t in frontier}, seed, layout):
                wanted = np.array(sorted(frontier[tree]), dtype=np.int64)
                at = np.minimum(np.searchsorted(wanted, heap), len(wanted) - 1)
                keep = wanted[at] == heap
                mine, node = rows.take(keep), at[keep]
                key, sums = cells(mine, node, len(wanted), slots)
                totals = _sums(node, mine.w, mine.y, len(wanted))
                square = np.bincount(node, weights=mine.w * mine.y ** 2, minlength=len(wanted))
                slot = np.concatenate([key % slots, np.full(len(wanted), -1)]) if slots else np.full(len(wanted), -1)
                owner = np.concatenate([key // slots, np.arange(len(wanted))]) if slots else np.arange(len(wanted))
                both = np.concatenate([sums, totals])
                yield pa.RecordBatch.from_pydict({
                    "tree": np.full(len(slot), tree, dtype=np.int32), "heap": wanted[owner], "slot": slot.astype(np.int32), "w": both[:, 0],
                    "s": both[:, 1], "q": np.concatenate([np.zeros(len(sums)), square])})

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("slot")
        inner, total = group[group["slot"] >= 0], group[group["slot"] < 0]
        totals = total[["w", "s"]].to_numpy()
        slot, gain, above = best_splits(inner["slot"].to_numpy().astype(np.int64), inner[["w", "s"]].to_numpy(), totals, layout)
        slot[gain <= least] = -1
        return pd.DataFrame({"tree": total["tree"].to_numpy(), "heap": total["heap"].to_numpy(), "w": totals[:, 0], "s": totals[:, 1],
                             "q": total["q"].to_numpy(), "gain": gain, "slot": slot.astype(np.int32), "above": above[:, 0]})

    parts = table.mapInArrow(count, "tree int, heap long, slot int, w double, s double, q double")
    summed = parts.groupBy("tree", "heap", "slot").agg(F.sum("w").alias("w"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    return summed.groupBy("tree", "heap").applyInPandas(choose, NODE + ", above double").collect()


def grow_trees(table: DataFrame, trees: range, depth: int, seed: int, layout: Layout, variance: float, most: int = MOST_ROWS) -> DataFrame:
    """Nodes of ``trees``, whose samples are drawn from ``table`` (see :func:`binned`; labels around zero). Written."""
    spark, least = table.sparkSession, LEAST_GAIN * variance
    reachable(spark)
    splits: dict[int, dict[int, int]] = {tree: {} for tree in trees}
    large = {tree: [1] for tree in trees} if table.count() > most and depth > 0 else {}
    done, roots = [], {} if large else {tree: [1] for tree in trees}
    while large:
        following: dict[int, list[int]] = {}
        for row in _split_large(table, splits, large, seed, layout, least):
            done.append(row[:7])
            if row["slot"] < 0:
                continue
            splits[row["tree"]][row["heap"]] = row["slot"]
            for child, w in ((2 * row["heap"], row["w"] - row["above"]), (2 * row["heap"] + 1, row["above"])):
                lasting = w > most and child < 1 << depth
                (following if lasting else roots).setdefault(row["tree"], []).append(child)
        large = following

    kind = np.uint16 if layout.first[-1] < 1 << 16 else np.int32

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree, heap, rows in _sampled(batch, {t: splits[t] for t in roots}, seed, layout):
                for root in np.intersect1d(heap, roots[tree]):
                    mine = rows.take(heap == root)
                    packed = (np.diff(mine.start).astype(np.int32), mine.slot.astype(kind), mine.w.astype(np.uint8), mine.y)
                    yield pa.RecordBatch.from_pydict({
                        "tree": pa.array([tree], pa.int32()), "heap": pa.array([root], pa.int64()),
                        **{name: pa.array([part.tobytes()], pa.binary()) for name, part in zip(("sizes", "slots", "w", "y"), packed)}})

    def finish(group: pa.Table) -> pa.Table:
        def joined(name: str, dtype) -> np.ndarray:
            return np.concatenate([np.frombuffer(part.as_buffer(), dtype=dtype) for part in group.column(name)])

        rows = Rows(_starts(joined("sizes", np.int32)), joined("slots", kind).astype(np.int64), joined("w", np.uint8).astype(np.float64), joined("y", np.float64))
        tree, heap = group.column("tree")[0].as_py(), group.column("heap")[0].as_py()
        nodes = grow(rows, heap, depth, layout, least)
        return pa.table({"tree": np.full(len(nodes["heap"]), tree, dtype=np.int32), **nodes, "slot": nodes["slot"].astype(np.int32)}).select(
            ["tree", "heap", "w", "s", "q", "gain", "slot"])

    # Groups are few and heavy, and adaptive execution would join them by their size: they get many parts of a given number.
    groups = sum(map(len, roots.values()))
    parts = max(1, min(4 * groups, 200 + groups))
    dealt = table.mapInArrow(deal, "tree int, heap long, sizes binary, slots binary, w binary, y binary").repartition(parts, "tree", "heap")
    below = dealt.groupBy("tree", "heap").applyInArrow(finish, NODE)
    return settle(below.unionByName(spark.createDataFrame(done, NODE)) if done else below, "nodes")


def node_data(nodes: DataFrame, layout: Layout, mean: float) -> DataFrame:
    """(treeID, nodeData) as Spark's model files hold the nodes of an ensemble: children lie behind their parents.

    In the order of levels the children of the n-th inner node are the nodes 2n + 1 and 2n + 2.
    """
    spark = nodes.sparkSession
    bounds = spark.createDataFrame([(i, int(f), float(b)) for i, (f, b) in enumerate(zip(layout.feature, layout.bound))], "slot int, feature int, bound double")
    order = W.partitionBy("tree").orderBy("heap")
    inner = F.col("slot") >= 0
    placed = nodes.withColumns({"id": F.row_number().over(order) - 1, "before": F.coalesce(F.sum(inner.cast("int")).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    shape = placed.join(bounds, "slot", "left").withColumns({"m": F.lit(mean), "inner": inner})
    return shape.select(F.col("tree").alias("treeID"), F.expr("""named_struct('id', id, 'prediction', m + s / w, 'impurity', greatest(0D, q / w - (s / w) * (s / w)),
      'impurityStats', array(w, s + w * m, q + 2 * m * s + w * m * m), 'rawCount', cast(w AS bigint), 'gain', if(inner, gain, -1D),
      'leftChild', cast(if(inner, 2 * before + 1, -1) AS int), 'rightChild', cast(if(inner, 2 * before + 2, -1) AS int),
      'split', named_struct('featureIndex', if(inner, feature, -1), 'leftCategoriesOrThreshold', if(inner, array(bound), cast(array() AS array<double>)), 'numCategories', -1))""")
        .cast(NODE_DATA).alias("nodeData"))
