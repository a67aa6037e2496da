"""Document fingerprints as Merkle trees: leaves, paragraphs, sections and a root, written as one string."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import bounded, documents, reachable, settle

#: A sentence, or its next part of this many characters, is a leaf.
LEAF = re.compile(r"[^.!?\n]{1,32}[.!?]*|[.!?]+")
#: A paragraph ends a section if its hash is a multiple of this, so that an edit moves no boundary but its own.
SECTION = 4


def fingerprint(text: str) -> str:
    """``root|section:paragraph=leafleaf…,paragraph=…|section:…``, in hexadecimal: root 32 digits, section 16,
    paragraph and leaf 8.

    A paragraph is a line; its leaves are sentences, long ones in parts counted from the sentence's start. A section
    is a run of paragraphs that ends where the content says so. Each hash covers the hashes below it, the root also
    the whole text, so roots are equal for equal texts only.
    """
    sections, open_section = [], []
    if text:
        for paragraph in text.split("\n"):
            leaves = [xxhash.xxh32_hexdigest(leaf) for leaf in LEAF.findall(paragraph)]
            joined = "".join(leaves)
            number = xxhash.xxh32_intdigest(joined)
            open_section.append(f"{number:08x}={joined}")
            if number % SECTION == 0:
                sections.append(open_section)
                open_section = []
        if open_section:
            sections.append(open_section)
    written = []
    for section in sections:
        inside = ",".join(section)
        written.append(f"{xxhash.xxh64_hexdigest(inside)}:{inside}")
    root = hashlib.blake2b(text.encode(), digest_size=16, key=b"merkle")
    root.update("".join(w[:16] for w in written).encode())
    return "|".join([root.hexdigest(), *written])


def parse(written: str) -> tuple[str, list[tuple[str, list[tuple[str, list[str]]]]]]:
    """(root, [(section, [(paragraph, [leaf])])])"""
    root, *sections = written.split("|")
    tree = []
    for section in sections:
        name, _, inside = section.partition(":")
        paragraphs = []
        for paragraph in inside.split(","):
            own, _, leaves = paragraph.partition("=")
            paragraphs.append((own, [leaves[i:i + 8] for i in range(0, len(leaves), 8)]))
        tree.append((name, paragraphs))
    return root, tree


def _unmatched(a: list[tuple], b: list[tuple]) -> tuple[list[tuple], list[tuple], list[tuple]]:
    """Branches of ``a`` and of ``b`` without a counterpart of the same hash, and the matched ones of ``a``."""
    common = Counter(x[0] for x in a) & Counter(x[0] for x in b)
    out, matched = [], []
    for side in (a, b):
        left, rest = common.copy(), []
        for branch in side:
            if left[branch[0]] > 0:
                left[branch[0]] -= 1
                if side is a:
                    matched.append(branch)
            else:
                rest.append(branch)
        out.append(rest)
    return out[0], out[1], matched


def compare(first: str, second: str) -> tuple[float, int, int]:
    """(likeness, sections that differ, paragraphs that differ). Equal roots end the comparison; below a differing
    root only differing sections are opened, below them only differing paragraphs. Likeness is twice the leaves in
    common over all leaves: 1 for equal texts, 0 for texts without a common leaf."""
    if first[:32] == second[:32]:
        return 1.0, 0, 0
    (_, a), (_, b) = parse(first), parse(second)
    total = sum(len(p[1]) for s in (*a, *b) for p in s[1])
    if not total:
        return 0.0, len(a) + len(b), 0
    sections_a, sections_b, same = _unmatched(a, b)
    common = sum(len(p[1]) for s in same for p in s[1])
    paragraphs_a, paragraphs_b, same_p = _unmatched([p for s in sections_a for p in s[1]], [p for s in sections_b for p in s[1]])
    common += sum(len(p[1]) for p in same_p)
    leaves = Counter(x for p in paragraphs_a for x in p[1]) & Counter(x for p in paragraphs_b for x in p[1])
    common += sum(leaves.values())
    return 2 * common / total, len(sections_a) + len(sections_b), len(paragraphs_a) + len(paragraphs_b)


def likeness(first: str, second: str) -> float:
    return compare(first, second)[0]


def document_trees(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) for each row; a null text is empty."""
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(fingerprint, batch.column("text").to_pylist()), pa.string())], ["doc_id", "fingerprint"])

    return documents(docs).mapInArrow(run, "doc_id long, fingerprint string")


_ROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()),
                  ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])
_COLUMNS = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
            "near_edited double, near_next double")


def _edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def _judged(doc_id: int | None, text: str, own: str, following: str, next_fingerprint: str) -> dict:
    changed = _edited(text, following)
    mark = fingerprint(changed)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(changed.encode()).hexdigest(), "fingerprint": own,
            "edited_fingerprint": mark, "near_edited": likeness(own, mark), "near_next": likeness(own, next_fingerprint)}


def _in_order(docs: DataFrame) -> DataFrame:
    """(span, extra, doc_id, text), dealt so that a task has whole spans of successive documents in order.

    Spans are ranges of doc_id between quantiles. The first row of a span goes to the span before it as well (that of
    the first to the last), marked as extra, so that each row finds its successor in its own span. One shuffle of the
    texts; the list of first rows is one row per span.
    """
    spark = docs.sparkSession
    n = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    keyed = documents(docs).withColumn("at", F.coalesce("doc_id", F.lit(-(1 << 63))).cast("double"))
    inner = sorted(set(keyed.approxQuantile("at", [i / n for i in range(1, n)], 1 / (4 * n)))) or [0.0]
    keyed = Bucketizer(splits=[-math.inf, *inner, math.inf], inputCol="at", outputCol="span").transform(keyed).select(
        F.col("span").cast("int").alias("span"), F.xxhash64("text").alias("stamp"), "doc_id", "text")
    firsts = keyed.groupBy("span").agg(F.min(F.struct("doc_id", "stamp")).alias("least"))
    along = Window.orderBy("span")
    firsts = settle(firsts.select("least", F.coalesce(F.lag("span").over(along), F.max("span").over(along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).alias("before")), "span-firsts")
    starts = F.broadcast(firsts.select(F.col("least.doc_id").alias("first_id"), F.col("least.stamp").alias("first_stamp"), "before"))
    marked = keyed.join(starts, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("stamp") == F.col("first_stamp")), "left")
    places = F.array_compact(F.array(F.struct(F.col("span"), F.lit(0).alias("extra")),
                                     F.when(F.col("before").isNotNull(), F.struct(F.col("before").alias("span"), F.lit(1).alias("extra")))))
    return (marked.select("doc_id", "stamp", "text", F.explode(places).alias("place")).select("place.*", "doc_id", "stamp", "text")
            .repartition("span").sortWithinPartitions("span", "extra", "doc_id", "stamp").select("span", "extra", "doc_id", "text"))


def edited_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A document's edited text has its last floor(n_chars / 2) code points replaced by the first as many of the next
    document in ascending doc_id (after the last: the first). Equal ids are ordered by the text's hash, so repeated
    rows follow each other; a null id sorts first. A null text is empty. A single document is its own next; an empty
    table gives no rows.
    """
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = span = None
        for batch in bounded(batches):
            rows: list[dict] = []
            columns = (batch.column(c).to_pylist() for c in ("span", "extra", "doc_id", "text"))
            for own_span, extra, doc_id, text in zip(*columns):
                if own_span != span:
                    held, span = None, own_span
                own = fingerprint(text)
                if held is not None:
                    rows.append(_judged(*held, text, own))
                held = None if extra else (doc_id, text, own)
            yield pa.RecordBatch.from_pylist(rows, _ROW)

    return _in_order(docs).mapInArrow(run, _COLUMNS)
