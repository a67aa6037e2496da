"""Links of fingerprints and lines against all pairs."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from hirelake.llm import bitslice, linededup


def family(rng, n, free):
    """Values that differ in few of the lowest ``free`` bits: large buckets at every level."""
    base = rng.getrandbits(64)
    return {base ^ sum(1 << rng.randrange(free) for _ in range(rng.randint(0, 3))) for _ in range(n)}


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def test_every_close_pair_shares_a_bucket(spark):
    rng = random.Random(11)
    values = sorted(family(rng, 150, 64) | family(rng, 150, 20) | {rng.getrandbits(64) for _ in range(100)})
    close = {(j, i) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3}
    rows = spark.createDataFrame([(signed(v), i) for i, v in enumerate(values)], "fingerprint long, id int")
    for most in (6, 4096):
        held = defaultdict(set)
        for r in bitslice.buckets(rows, "fingerprint", 3, 5, most, "test").collect():
            held[r["bucket"]].add(r["id"])
        assert close <= {(min(i, j), max(i, j)) for own in held.values() for i in own for j in own if i != j}
        near = {r["fingerprint"] for r in bitslice.near_values(rows.select("fingerprint"), most=most).collect()}
        assert near == {signed(values[i]) for pair in close for i in pair}


def test_close_pairs_of_runs():
    rng = random.Random(3)
    values = np.array(sorted(family(rng, 60, 12)) + sorted(family(rng, 9, 12)) + [5], dtype=np.uint64)
    at, asks = np.array([0, len(values) - 10, len(values) - 1, len(values)]), np.array([i % 3 == 0 for i in range(len(values))])
    run = np.searchsorted(at, np.arange(len(values)), side="right")
    got = [(i, j) for i, near in bitslice.close_pairs(values, at, 3, asks) for j in near.tolist()]
    want = {(i, j) for i in range(len(values)) for j in range(len(values)) if i != j and asks[i] and run[i] == run[j]
            and (int(values[i]) ^ int(values[j])).bit_count() <= 3}
    assert set(got) == want and len(got) == len(want)


def lines_of(spark, seed=5, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 9))) for _ in range(80)]
    lines = []
    for _ in range(40):
        line = [rng.choice(words) for _ in range(rng.randint(1, 14))]
        lines.append(" ".join(line))
        for _ in range(rng.randrange(5)):
            other = [*line]
            other[rng.randrange(len(other))] = rng.choice((rng.choice(words), rng.choice(words)[:-1], ""))
            lines.append(rng.choice((" ".join(other), " ".join(other).upper(), "- " + " ".join(other) + ".")))
    texts = ["\n".join(rng.choice(lines) for _ in range(rng.randint(0, 8))) for _ in range(n)]
    return [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (7, "another text\n" + lines[0]), (n, "\n\n ...\n"), (n + 1, "")]


def brute_kept(rows):
    """What stays of each text: groups of lines by all pairs within 3 bits and of similarity 0.8, first places stay."""
    places = defaultdict(list)
    for doc, text in set(rows):
        f = linededup.line_features([text.encode()])
        for line, print_ in zip(f["line"].tolist(), f["simhash"].tolist()):
            words = linededup.normalised(text.encode().split(b"\n")[line])
            places[words].append((doc, text, line, print_))
    keys = list(places)
    root = {k: k for k in keys}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (places[a][0][3] ^ places[b][0][3]).bit_count() <= 3 and linededup.edit_distance(a, b) <= 0.2 * max(len(a), len(b)) + 1e-9:
                root[top(a)] = top(b)
    groups = defaultdict(list)
    for k in keys:
        groups[top(k)] += [p[:3] for p in places[k]]
    return groups


def families(seed=8):
    """Lines of few fingerprints: one long word decides them, short words make them similar or not."""
    rng = random.Random(seed)
    rows = []
    for i in range(60):
        long = rng.choice(("extraordinarily", "incomprehensible", "unquestionable"))
        lines = [" ".join([long, *(rng.choice(("an", "of", "to", "in", "it", "we", "be")) for _ in range(rng.randint(0, 7)))]) for _ in range(rng.randint(1, 6))]
        rows.append((i, "\n".join(lines)))
    return rows


@pytest.mark.parametrize("make, most", [(lambda: lines_of(None), 256), (families, 256), (families, 4)])
def test_line_dedup_against_all_pairs(spark, monkeypatch, make, most):
    monkeypatch.setattr(linededup, "MOST_LINES", most)
    rows = make()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    stamps = {(r["doc_id"], r["text"]): r["s"] for r in docs.select("doc_id", "text", F.xxhash64("text").alias("s")).collect()}
    gone = defaultdict(set)
    for group in brute_kept(rows).values():
        first = min(group, key=lambda p: (p[0], stamps[p[:2]], p[2]))
        for doc, text, line in group:
            if (doc, text, line) != first:
                gone[doc, text].add(line)
    want = sorted((doc, len(text.split("\n")), len(gone[doc, text]), "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone[doc, text]))
                  for doc, text in rows)
    got = linededup.drop_repeated_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_text").collect()
    assert sorted(map(tuple, got)) == want


def test_line_dedup_with_clashing_names_and_empty_tables(spark):
    names = ["n_lines", "n_dropped", "kept_text", "_stamp", "_gone", "stamp", "bucket", "fingerprint", "first", "words", "_doc", "_text"]
    rows = [(1, "one line here\nother words there"), (2, "one line here"), (None, "one line here"), (4, None), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").select("doc_id", "text", *(F.lit("x").alias(n) for n in names))
    got = {r["doc_id"]: r["_kept_text"] for r in linededup.drop_repeated_lines(docs).collect()}
    assert got == {None: "one line here", 1: "other words there", 2: "", 4: "", 5: ""}
    assert linededup.drop_repeated_lines(docs.limit(0)).collect() == []
