"""Fuzzy line deduplication: SimHash of normalised lines, pigeonhole blocks, edit similarity, connected groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.bitslice import RUN_KEYS, Roots, buckets, close_pairs, links_in_runs, near_values
from hirelake.llm.common import binary, bounded, new_names, reachable, settle, sorted_runs
from hirelake.llm.components import connected

DISTANCE = 3
BLOCKS = 5
SIMILARITY = 0.8
#: Octets of text whose lines are taken at once.
TEXT_BYTES = 1 << 20
#: Rows of a chunk when fingerprints, and when whole lines, are compared.
MOST_FINGERPRINTS, MOST_LINES = 4096, 256

# Normalisation by octet: ASCII letters are lower-cased, ASCII digits and octets of other characters are kept, all else parts words.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[ord("A"):ord("Z") + 1] += 32
_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
_NEWLINE = 10
_HEAVIEST = 64
_P = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def _powers(n: int, base: int) -> np.ndarray:
    """base ** 0 … base ** (n - 1) modulo 2 ** 64, by doubling."""
    out = np.ones(max(n, 1), dtype=np.uint64)
    done, step = 1, np.uint64(base)
    while done < n:
        more = min(done, n - done)
        out[done:done + more] = out[:more] * step
        done += more
        step = step * step
    return out


def _mixed(x: np.ndarray, salt: int) -> np.ndarray:
    x = x + np.uint64(salt)
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def line_features(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Of every line with a word: doc (index of the text), line (from 0), key1, key2 (hash of its words in order),
    simhash (over its words, with repeats, long words weighing more)."""
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    with np.errstate(over="ignore"):
        ends = np.cumsum([len(t) + 1 for t in texts])  # each text ends in a line feed
        is_word = _WORD[raw]
        edge = np.diff(np.concatenate(([0], is_word.astype(np.int8), [0])))
        begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((_FOLD[raw].astype(np.uint64) + np.uint64(1)) * _powers(len(raw), _P[0]))))
        # The power of where a word begins is divided out: odd numbers have an inverse modulo 2 ** 64.
        inverse = _powers(len(raw), pow(_P[0], -1, 1 << 64))
        word = _mixed((sums[stop] - sums[begin]) * inverse[begin], 1) + (stop - begin).astype(np.uint64)
        feeds = np.flatnonzero(raw == _NEWLINE)
        line_of_word = np.searchsorted(feeds, begin)
        first = np.flatnonzero(np.diff(line_of_word, prepend=-1))
        lines = line_of_word[first] if len(first) else first
        count = np.diff(np.append(first, len(word)))
        place = np.arange(len(word)) - np.repeat(first, count)
        most = int(count.max(initial=0))
        keys = [np.add.reduceat(_mixed(word, salt) * _powers(most, _P[1])[place], first) if len(first) else np.empty(0, np.uint64) for salt in (11, 13)]
        # A word weighs as much as it is long beyond two octets (one at least), or frequent short words would decide.
        weight = np.clip(stop - begin - 2, 1, _HEAVIEST)
        full = np.add.reduceat(weight, first) if len(first) else first
        bits = np.unpackbits(_mixed(word, 17).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.zeros((len(first), 64), dtype=np.int64)
        step = 1 << 16
        for at in range(0, len(word), step):  # sums of a bounded number of words at once
            own = line_of_word[at:at + step]
            new = np.flatnonzero(np.diff(own, prepend=-1))
            ones[np.searchsorted(lines, own[new])] += np.add.reduceat(bits[at:at + step] * weight[at:at + step].astype(np.uint8)[:, None], new, axis=0, dtype=np.int32)
        simhash = np.packbits(2 * ones > full[:, None], axis=1, bitorder="little").view(np.uint64).reshape(-1)
    doc = np.searchsorted(ends, feeds[lines], side="right")
    before = np.searchsorted(feeds, np.concatenate(([0], ends[:-1])))
    return {"doc": doc, "line": lines - before[doc], "key1": keys[0], "key2": keys[1], "simhash": simhash}


def _as_table(ids: pa.Array, stamps: pa.Array, f: dict[str, np.ndarray]) -> pa.RecordBatch:
    doc = pa.array(f["doc"].astype(np.int64))
    return pa.RecordBatch.from_arrays(
        [ids.take(doc), stamps.take(doc), pa.array(f["line"].astype(np.int32)),
         *(pa.array(f[k].view(np.int64)) for k in ("key1", "key2", "simhash"))],
        ["doc_id", "stamp", "line", "key1", "key2", "fingerprint"])


def _common(a: str, b: str) -> int:
    """Length of the common start, by comparing ever shorter stretches."""
    if a[:1] != b[:1]:
        return 0
    known, step = 0, min(len(a), len(b))
    while step:
        if a[known:known + step] == b[known:known + step]:
            known += step
            step = min(step, len(a) - known, len(b) - known)
        else:
            step //= 2
    return known


def edit_distance(a: str, b: str) -> int:
    """Levenshtein distance, bit-parallel over the whole of ``a`` for each character of ``b``."""
    start = _common(a, b)
    a, b = a[start:], b[start:]
    if end := _common(a[::-1], b[::-1]):
        a, b = a[:-end], b[:-end]
    if not a or not b:
        return len(a) + len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for c in b:
        same = where.get(c, 0)
        diagonal = (((same & up) + up) ^ up) | same | down
        plus, minus = down | ~(diagonal | up) & full, up & diagonal
        distance += bool(plus & top) - bool(minus & top)
        plus, minus = plus << 1 | 1, minus << 1
        up, down = (minus | ~(diagonal | plus)) & full, plus & diagonal & full
    return distance


def at_most(a: str, b: str) -> int:
    """A bound of the distance: of lines of as many words, what it takes to write the differing words anew."""
    own, other = a.split(" "), b.split(" ")
    return sum(max(len(x), len(y)) for x, y in zip(own, other) if x != y) if len(own) == len(other) else len(a) + len(b)


def similar(a: str, b: str, least: float) -> bool:
    """1 - distance / longer length is ``least`` at the lowest."""
    longer = max(len(a), len(b))
    allowed = (1 - least) * longer + 1e-9
    return abs(len(a) - len(b)) <= allowed and (at_most(a, b) <= allowed or edit_distance(a, b) <= allowed)


def normalised(line: bytes) -> str:
    octets = np.frombuffer(line, dtype=np.uint8)
    return b" ".join(np.where(_WORD[octets], _FOLD[octets], 32).astype(np.uint8).tobytes().split()).decode(errors="replace")


def _close_lines(distinct: DataFrame, distance: int, blocks: int) -> DataFrame:
    """The rows of ``distinct`` that have another line within ``distance``.

    Fingerprints are compared, not lines: several lines of one fingerprint have each other.
    """
    values = settle(distinct.groupBy("fingerprint").agg(F.count("*").alias("lines")), "line-fingerprints")
    near = near_values(values, distance, blocks, MOST_FINGERPRINTS)
    close = settle(values.filter("lines > 1").select("fingerprint").union(near).distinct(), "close-fingerprints")
    return distinct.join(close, "fingerprint", "left_semi")


_SPOT = "struct<doc_id:bigint,stamp:bigint,line:int>"


def _similar_lines(lines: DataFrame, distance: int, blocks: int, similarity: float) -> DataFrame:
    """(a, b) first places of lines that are within ``distance`` and similar; links that follow from others are left out.

    ``lines``: first, fingerprint, words (the normalised line). A class is the lines of one fingerprint, its hub one of
    them. Lines are tied to their hub if they are similar to it, and the hubs of close classes to each other, group by
    group. Tied lines of close classes whose hubs are connected need no further look. What is left is compared: lines that
    are not tied with all lines of their class and of every close one, and all lines of two close classes whose hubs are
    not connected. No pair of similar lines within ``distance`` is left unconnected.
    """
    hubs = settle(lines.groupBy("fingerprint").agg(
        F.min("first").alias("hub"), F.min_by("words", "first").alias("hub_words"), F.count("*").alias("lines")), "line-hubs")

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["first", "fingerprint", "words", "hub"]
        for batch in batches:
            words, other = batch.column("words").to_pylist(), batch.column("hub_words").to_pylist()
            tied = pa.array([a == b or similar(a, b, similarity) for a, b in zip(words, other)], pa.bool_())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), tied], [*names, "tied"])

    joined = lines.join(hubs, "fingerprint").select("first", "fingerprint", "words", "hub", "hub_words")
    tied = settle(joined.mapInArrow(tie, f"first {_SPOT}, fingerprint long, words string, hub {_SPOT}, tied boolean"), "tied-lines")
    untied = tied.filter(~F.col("tied")).groupBy("fingerprint").agg(F.count("*").alias("untied"))
    classes = settle(hubs.join(untied, "fingerprint", "left").withColumn("untied", F.coalesce("untied", F.lit(0))), "line-classes")

    def compare_hubs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in sorted_runs(batches, RUN_KEYS, target=1024):
            column, hub = part.column("fingerprint").combine_chunks(), part.column("hub").combine_chunks()
            values, words = column.to_numpy().view(np.uint64), part.column("hub_words").to_pylist()
            left, right = links_in_runs(values, at, distance, lambda i, j: similar(words[i], words[j], similarity))
            roots, loose = Roots(), part.column("untied").combine_chunks().to_numpy() > 0
            for i, j in zip(left.tolist(), right.tolist()):
                roots.join(i, j)
            pairs = []
            for i, near in close_pairs(values, at, distance, part.column("lines").combine_chunks().to_numpy() > 1):
                for j in near.tolist():
                    apart = roots.top(i) != roots.top(j)
                    if apart or loose[i] or loose[j]:
                        pairs.append((i, j, apart) if column[i].as_py() < column[j].as_py() else (j, i, apart))
            f, g, apart = ([p[k] for p in pairs] for k in range(3))
            yield pa.RecordBatch.from_arrays(
                [*(pa.concat_arrays([hub.take(pa.array(ends, pa.int64())), pa.nulls(len(pairs), hub.type)]) for ends in (left, right)),
                 *(pa.concat_arrays([pa.nulls(len(left), column.type), column.take(pa.array(ends, pa.int64()))]) for ends in (f, g)),
                 pa.concat_arrays([pa.nulls(len(left), pa.bool_()), pa.array(apart, pa.bool_())])], ["a", "b", "f", "g", "apart"])

    dealt = buckets(classes, "fingerprint", distance, blocks, MOST_LINES, "hub-buckets")
    compared = settle(dealt.repartition(*RUN_KEYS).sortWithinPartitions(*RUN_KEYS).mapInArrow(
        compare_hubs, f"a {_SPOT}, b {_SPOT}, f long, g long, apart boolean"), "hub-links")
    to_hub = tied.filter(F.col("tied") & (F.col("first") != F.col("hub"))).select(F.col("first").alias("a"), F.col("hub").alias("b"))
    rest = _rest_of_classes(tied, classes, compared.filter("f IS NOT NULL").groupBy("f", "g").agg(F.bool_and("apart").alias("apart")), similarity)
    return to_hub.union(compared.filter("f IS NULL").select("a", "b")).union(rest).distinct()


def _rest_of_classes(tied: DataFrame, classes: DataFrame, pairs: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links of the lines that hubs do not decide. ``pairs``: close classes f < g, and whether their hubs are apart.

    Asking lines of a class (all, if the hubs are apart, else those not tied) meet all lines of the other class, in groups
    of up to about twice MOST_LINES: a line that does not ask is repeated once for each MOST_LINES asking lines only.
    """
    sizes = classes.select(F.col("fingerprint").alias("asking"), "untied", F.col("lines").alias("all_asking"))
    asked = classes.select(F.col("fingerprint").alias("other"), F.col("lines").alias("others"))
    within = classes.filter("untied > 0").select(F.col("fingerprint").alias("asking"), F.col("fingerprint").alias("other"), F.lit(False).alias("apart"))
    there, back = (pairs.select(F.col(x).alias("asking"), F.col(y).alias("other"), "apart") for x, y in (("f", "g"), ("g", "f")))
    meetings = (within.union(there).union(back.filter(~F.col("apart"))).join(sizes, "asking").join(asked, "other")
                .withColumn("n", F.when(F.col("apart"), F.col("all_asking")).otherwise(F.col("untied"))).filter("n > 0")
                .select("asking", "other", "apart", *(F.ceil(F.col(c) / MOST_LINES).cast("int").alias(name) for c, name in (("n", "xs"), ("others", "ys")))))
    meetings = settle(meetings, "line-meetings")

    def side(of: str, own: str, parts: str, parts_of_other: str, asks: bool) -> DataFrame:
        rows = meetings.join(tied.withColumnRenamed("fingerprint", of), of)
        if asks:
            rows = rows.filter(F.col("apart") | ~F.col("tied"))
        here = F.pmod(F.xxhash64(F.lit(7), "first"), F.col(parts)).cast("int")
        copies = rows.withColumn(own, here).withColumn("there", F.explode(F.sequence(F.lit(0), F.col(parts_of_other) - 1)))
        x, y = (F.col(own), F.col("there")) if asks else (F.col("there"), F.col(own))
        return copies.select(F.xxhash64("asking", "other", x, y).alias("bucket"), "first", "words", F.lit(asks).alias("asks"),
                             F.when(F.col("tied"), F.col("hub")).otherwise(F.col("first")).alias("root"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in sorted_runs(batches, RUN_KEYS, target=1024):
            words, first = part.column("words").to_pylist(), part.column("first").combine_chunks()
            asks, number = part.column("asks").to_pylist(), {}
            own = [number.setdefault((r["doc_id"], r["stamp"], r["line"]), len(number)) for r in part.column("root").to_pylist()]
            roots, links = Roots(), []
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                others = [j for j in range(lo, hi) if not asks[j]]
                for i in (k for k in range(lo, hi) if asks[k]):
                    for j in others:
                        if roots.top(own[i]) != roots.top(own[j]) and similar(words[i], words[j], similarity):
                            roots.join(own[i], own[j])
                            links.append((i, j))
            yield pa.RecordBatch.from_arrays([first.take(pa.array([link[k] for link in links], pa.int64())) for k in (0, 1)], ["a", "b"])

    both = side("asking", "x", "xs", "ys", True).union(side("other", "y", "ys", "xs", False))
    return both.repartition(*RUN_KEYS).sortWithinPartitions(*RUN_KEYS).mapInArrow(compare, f"a {_SPOT}, b {_SPOT}")


def _marked(docs: DataFrame, id_name: str, text_name: str, stamp_name: str) -> DataFrame:
    """``docs`` with the text's hash; a row is told by id and hash, so rows that repeat an id are told apart."""
    return docs.withColumn(stamp_name, F.xxhash64(F.coalesce(F.col(text_name), F.lit(""))))


def drop_repeated_lines(docs: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS,
                        similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` with further columns n_lines, n_dropped and kept_text: the text without lines that repeat another line.

    Lines are parted by line feeds. A line's words are the runs of letters, digits and non-ASCII characters, with A-Z
    lower-cased. Lines of equal words are one group from the start. Groups are linked if their SimHashes (over words)
    differ in at most ``distance`` bits and the normalised lines have an edit similarity of ``similarity`` or more.
    Of each connected group one occurrence stays: the first by doc_id, then by the text's hash, then by line. Lines
    without words are kept as they are.

    A null text has no lines, and its kept_text is empty. A null doc_id sorts first. Rows of equal doc_id and text are
    one document: each of them keeps the same lines. An empty table gives no rows. Other columns stay as they are; the
    three new columns get a leading underscore where ``docs`` has such a name.
    """
    spark = docs.sparkSession
    reachable(spark)
    n_lines, n_dropped, kept_text, stamp, gone = new_names(docs, "n_lines", "n_dropped", "kept_text", "_stamp", "_gone")
    slim = _marked(docs.select("doc_id", "text"), "doc_id", "text", "stamp").select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc_id"), "stamp", F.coalesce("text", F.lit("")).alias("text"))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches, limit=TEXT_BYTES):
            yield _as_table(batch.column("doc_id"), batch.column("stamp"), line_features(binary(batch.column("text"))))

    lines = settle(slim.mapInArrow(features, "doc_id long, stamp long, line int, key1 long, key2 long, fingerprint long"), "lines")
    spot = F.struct("doc_id", "stamp", "line")
    distinct = settle(lines.groupBy("key1", "key2").agg(
        F.min(spot).alias("first"), F.max(spot).alias("last"), F.min("fingerprint").alias("fingerprint")), "distinct-lines")

    close = settle(_close_lines(distinct, distance, blocks).select("first", "fingerprint"), "close-lines")
    wanted = close.groupBy("first.doc_id", "first.stamp").agg(F.collect_list(F.struct("first.line", "fingerprint")).alias("wanted"))

    def worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            out: list[dict] = []
            for row in batch.to_pylist():
                own = row["text"].encode().split(b"\n")
                out += [{"first": {"doc_id": row["doc_id"], "stamp": row["stamp"], "line": w["line"]}, "fingerprint": w["fingerprint"],
                         "words": normalised(own[w["line"]])} for w in row["wanted"]]
            yield pa.RecordBatch.from_pylist(out, pa.schema([
                ("first", pa.struct([("doc_id", pa.int64()), ("stamp", pa.int64()), ("line", pa.int32())])),
                ("fingerprint", pa.int64()), ("words", pa.string())]))

    texts = (slim.join(wanted.hint("shuffle_hash"), ["doc_id", "stamp"]).dropDuplicates(["doc_id", "stamp"])
             .mapInArrow(worded, f"first {_SPOT}, fingerprint long, words string"))
    links = _similar_lines(settle(texts, "line-texts"), distance, blocks, similarity)
    groups = connected(links, "line-groups").select(F.col("node").alias("first"), "component")

    # Only groups of several occurrences decide anything.
    kept = settle(distinct.join(groups, "first", "left")
                  .select("key1", "key2", F.coalesce("component", "first").alias("kept"), (F.col("component").isNotNull() | (F.col("first") != F.col("last"))).alias("several"))
                  .filter("several").drop("several"), "kept-lines")
    dropped = (lines.join(kept, ["key1", "key2"]).filter(spot != F.col("kept"))
               .groupBy("doc_id", "stamp").agg(F.collect_set("line").alias(gone))
               .withColumnsRenamed({"doc_id": "_doc", "stamp": "_text"}))
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    joined = _marked(docs, "doc_id", "text", stamp).alias("d").join(
        dropped.hint("shuffle_hash").alias("g"), (own_id == F.col("g._doc")) & (F.col(f"d.{stamp}") == F.col("g._text")), "left")
    all_lines = F.split(F.coalesce(F.col("text"), F.lit("")), "\n", -1)
    left = F.array_join(F.filter(all_lines, lambda line, i: ~F.array_contains(gone, i)), "\n")
    return joined.select(
        *(F.col(f"d.`{c}`") for c in docs.columns),
        F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(all_lines)).cast("long").alias(n_lines),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias(n_dropped),
        F.when(F.col(gone).isNull(), F.coalesce(F.col("text"), F.lit(""))).otherwise(left).alias(kept_text))


def line_dedup_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 (of the text that is left), a row for each row of ``docs``.

    Nulls, empty and long texts, ties, repeated rows and empty tables as for :func:`drop_repeated_lines`; other columns,
    whatever their names, are left out.
    """
    done = drop_repeated_lines(docs.select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("kept_text", "UTF-8"), 256).alias("kept_sha256"))
