"""Near-duplicate documents by SimHash fingerprints of word shingles."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hirelake.llm.bitslice import near_links
from hirelake.llm.common import binary, bounded, documents, reachable, settle
from hirelake.llm.components import connected

SHINGLE = 3
DISTANCE = 3
SEED = 42
#: Shingles whose hashes are held at once.
STEP = 255 * 128


def _ones(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit set, bit 0 first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    total = np.zeros(64, dtype=np.int64)
    for start in range(0, len(bits), 255):  # sums of 255 ones fit an octet
        total += np.add.reduce(bits[start:start + 255], axis=0, dtype=np.uint8)
    return total


def simhash(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Fingerprint of UTF-8 text: A-Z lower-cased, words parted by ASCII white space, shingles with repeats."""
    words = text.lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(64, dtype=np.int64)
    for start in range(0, n, STEP):
        part = words[start:start + STEP + shingle - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(shingle)))) if len(words) >= shingle else [b" ".join(part)]
        total += _ones(np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype=np.uint64))
    return sum(1 << int(bit) for bit in np.flatnonzero(2 * total > n))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint long) for each row, over the whole text."""
    reachable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in bounded(batches):
            values = np.array([simhash(text, shingle, seed) for text in binary(batch.column("text"))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], ["doc_id", "fingerprint"])

    return documents(docs).mapInArrow(run, "doc_id long, fingerprint long")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, distance: int = DISTANCE, seed: int = SEED) -> DataFrame:
    """(doc_id, fingerprint long, component_id): documents whose fingerprints differ in at most ``distance`` bits are
    linked; component_id is the smallest doc_id that can be reached.

    Equal fingerprints are one class from the start, so any number of copies makes no links; candidates come from
    buckets of equal bit blocks (see ``near_links``), distances from bit planes. Texts without words have fingerprint
    zero and are linked like any other. A null text is empty. Rows with a null doc_id are grouped too; their
    component_id is null only if no doc_id can be reached. Repeated rows each get a row. An empty table gives no rows.
    """
    marked = settle(fingerprints(docs, shingle, seed), "fingerprints")
    classes = settle(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("first_id")), "classes")
    linked = connected(near_links(classes.select("fingerprint"), distance)).select(
        F.col("node").alias("fingerprint"), F.col("component").alias("root"))
    rooted = settle(classes.join(linked, "fingerprint", "left")
                    .withColumn("root", F.coalesce("root", "fingerprint")), "roots")
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of_class = rooted.join(least, "root").select("fingerprint", "component_id")
    return marked.join(of_class, "fingerprint").select("doc_id", "fingerprint", "component_id")


def near_duplicate_documents(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id."""
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, **parameters) -> DataFrame:
    """The documents of ``docs`` that are the first of their near-duplicate group, with all columns as they were.

    Rows that repeat the doc_id of a kept document stay with it. Rows with a null doc_id stay if their group has no
    doc_id at all, one row for each group cannot be told apart and so all of them stay. A null text is an empty one, texts
    are read whole, an empty table gives no rows, and other columns may have any names.
    """
    kept = (near_duplicates(docs, **parameters).filter("doc_id <=> component_id").select(F.col("doc_id").alias("_kept_id")).distinct())
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept_id"]), "left_semi")
