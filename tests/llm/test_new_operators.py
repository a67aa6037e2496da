"""Quality classifier, spelling variants and periodic runs against brute force, held-out labels and edge cases."""

import hashlib
import random
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from hirelake.llm import periodic, qualityclassifier, spelling, wordvectors

EDGES = "doc_id long, text string, word string, n long, runs string, score double, features string, block string, key string"


def edge_rows(spark, *texts):
    """Rows with clashing further columns: null id, repeated row, null, empty and blank text, and ``texts``."""
    own = [(None, "alpha beta"), (1, "same text again"), (1, "same text again"), (2, None), (3, ""), (4, " \n\t ")]
    own += [(10 + i, t) for i, t in enumerate(texts)]
    return spark.createDataFrame([(i, t, "w", 1, "r", 0.5, "f", "b", "k") for i, t in own], EDGES)


# ---- periodic runs ------------------------------------------------------------------------------------------------

def brute_runs(words, least_words=6, least_times=4):
    out = []
    for q in range(1, len(words) // least_times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            primitive = all(any(words[k] != words[k + d] for k in range(i, i + length - d)) for d in range(1, q) if q % d == 0)
            if j > i and length >= max(least_words, least_times * q) and primitive:
                out.append((i, length, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


@given(st.lists(st.tuples(st.lists(st.integers(0, 3), min_size=1, max_size=5), st.integers(1, 9)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_runs_are_those_of_brute_force(pieces):
    words = [b"%d" % w for piece, times in pieces for w in piece * times]
    assert periodic.runs_of_words(words) == brute_runs(words)


def test_nested_and_overlapping_runs():
    inner = [b"a"] * 7 + [b"b"]
    words = inner * 5 + [b"x"] + [b"c", b"d"] * 4
    assert periodic.runs_of_words(words) == brute_runs(words)
    assert {r[2] for r in periodic.runs_of_words(words)} == {1, 2, 8}


def test_stretches_hold_every_run():
    rnd = random.Random(4)
    for _ in range(200):
        words = [rnd.randrange(30) for _ in range(120)]
        a, p = rnd.randrange(80), rnd.randint(1, 8)
        for i in range(a + p, min(120, a + 5 * p)):
            words[i] = words[i - p]
        held = periodic.stretches(np.array(words))
        assert all(any(lo <= s and s + n <= hi for lo, hi in held) for s, n, _ in brute_runs(words))


def test_last_occurrences_by_link_cut_access():
    rnd = random.Random(9)
    for _ in range(60):
        words = [rnd.randrange(3) for _ in range(rnd.randint(1, 40))]
        link, longest, prefix = periodic.automaton(words)
        last = periodic.LastOccurrences(link, longest)
        for i, state in enumerate(prefix):
            seen = {}
            for n in range(1, i + 2):  # nearest earlier end of each suffix
                ends = [j for j in range(n - 1, i) if words[j - n + 1:j + 1] == words[i - n + 1:i + 1]]
                if ends:
                    seen[max(ends)] = n
            got = {place: reach for place, reach in sorted(last.access(state, i), key=lambda s: s[1]) if reach}
            assert got == seen


def expected_runs(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str("" if doc_id is None else doc_id).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = brute_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
            sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_run_digests_and_edges(spark):
    rnd = random.Random(1)
    texts = [" ".join(rnd.choice("a b c dé e f".split(" ")) for _ in range(rnd.randint(1, 90))) for _ in range(150)]
    texts += ["x " * 500, "one two\n" * 400, "very " * 3 + "long", "w" * 300_000, "a a " * 6]
    docs = edge_rows(spark, *texts)
    got = sorted(map(tuple, periodic.run_digests(docs).collect()), key=repr)
    assert got == sorted((expected_runs(r["doc_id"], r["text"]) for r in docs.collect()), key=repr)
    assert periodic.run_digests(docs.limit(0)).collect() == []


def test_runs_keep_their_general_interface(spark):
    row, = periodic.periodic_runs(spark.createDataFrame([(7, "go go go on")], "doc_id long, text string"), least_words=3, least_times=3).collect()
    assert [tuple(r) for r in row["runs"]] == [(0, 3, 1)] and row["collapsed"] == "go on" and row["n_words"] == 4


# ---- spelling variants --------------------------------------------------------------------------------------------

def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def expected_variants(counts, form_times=10):
    forms, near = {}, {w: [v for v in counts if v != w and one_edit(v, w)] for w in counts}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        if best is not None and counts[best] >= form_times * n:
            forms[w] = best
    out = set()
    for w, n in counts.items():
        root = w
        while root in forms:
            root = forms[root]
        form = forms.get(w)
        out.add((w, form, root, n, len(near[w]), form and counts[form]))
    return out


def vocabulary(seed=3, size=400):
    rnd, words = random.Random(seed), {}
    for _ in range(size):
        base = "".join(rnd.choice("abé") for _ in range(rnd.randint(7, 12)))
        words[base] = rnd.choice((2, 3, 30, 400, 5000))
        for _ in range(3):
            i = rnd.randrange(len(base))
            word = rnd.choice((base[:i] + base[i + 1:], base[:i] + rnd.choice("abc") + base[i:], base[:i] + rnd.choice("xyz") + base[i + 1:]))
            if len(word) >= 7:
                words.setdefault(word, rnd.choice((2, 2, 5, 40)))
    return words


@pytest.mark.parametrize("most", [256, 3])  # 3: nearly all blocks are dealt by single places
def test_variants_are_those_of_brute_force(spark, most):
    counts = vocabulary()
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling.spelling_variants(words, most=most).collect()}
    assert got == expected_variants(counts)


def test_tiles_of_a_long_run():
    words = sorted({w for w in vocabulary(5, 60) if len(w) in (8, 9)})
    n = np.array([len(w) for w in words])
    one = np.zeros(len(words), dtype=int)
    i, j = spelling.near_pairs(words, n, one + 8, one, one + 9, np.array([0, len(words)]), cells=800)
    pairs = {(words[a], words[b]) for a, b in zip(i, j)}
    assert pairs == {(a, b) for x, a in enumerate(words) for b in words[x + 1:] if one_edit(a, b) and min(len(a), len(b)) == 8}
    assert len(i) == len(pairs)


def test_chain_of_forms_and_hot_family(spark):
    counts = {"aaaaaaa": 100_000, "aaaaaab": 5_000, "aaaaabb": 400, "aaaabbb": 20, "aaabbbb": 2}
    counts |= {"aaaaaaa"[:i] + chr(c) + "aaaaaaa"[i + 1:]: 2 for i in range(7) for c in range(ord("c"), ord("z"))}
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {tuple(r) for r in spelling.spelling_variants(words, most=8).collect()}
    assert got == expected_variants(counts)
    assert ("aaabbbb", "aaaabbb", "aaaaaaa", 2, 1, 20) in got


def test_word_counts_and_edges(spark):
    rnd = random.Random(2)
    pool = ["Straßenbahn", "éclairés", "ÉCLAIRÉS", "holiday", "holidays", "Holiday", "ring", "ÿÿÿÿÿÿÿ", "naïveté×naïveté", "x" * 20_000]
    texts = [" ".join(rnd.choice(pool) for _ in range(30)) + ";" + "_".join(rnd.choice(pool) for _ in range(9)) for _ in range(80)]
    docs = edge_rows(spark, *texts)
    counts = Counter()
    for r in docs.collect():
        run = ""
        for c in (r["text"] or "") + " ":
            if "a" <= c <= "z" or "A" <= c <= "Z" or "À" <= c <= "ÿ":
                run += c.lower() if c.isascii() else c
            elif run:
                h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
                k = h % len(run)
                counts[run[:k] + run[k + 1:] if h % 31 == 0 else run] += 1
                run = ""
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert {tuple(r) for r in spelling.spelling_variant_groups(docs).collect()} == expected_variants(counts)
    assert spelling.spelling_variant_groups(docs.limit(0)).collect() == []


# ---- quality classifier -------------------------------------------------------------------------------------------

def test_neighbour_sums_against_a_loop():
    texts = [b"one two THREE", b"", b"four ... 12 one one", b"shout"]
    document, slot = wordvectors.tokens(texts)
    assert document.tolist() == [0, 0, 0, 2, 2, 2, 2, 2, 3]
    assert slot[0] == slot[6] == slot[7] and wordvectors.tokens([b"Three"])[1][0] != slot[2] != wordvectors.tokens([b"three"])[1][0]
    places, signs = wordvectors.index_vectors()
    want = np.zeros((wordvectors.SLOTS, wordvectors.WIDTH + 1))
    for i in range(len(slot)):
        want[slot[i], -1] += 1
        for j in range(max(0, i - 2), min(len(slot), i + 3)):
            if j != i and document[i] == document[j]:
                for k in range(wordvectors.SPARK):
                    want[slot[i], places[slot[j], k]] += signs[slot[j], k]
    assert (wordvectors.neighbour_sums(document, slot, places, signs) == want).all()


def test_sums_do_not_depend_on_partitions(spark):
    docs = spark.createDataFrame([(i, f"w{i % 7} and w{i % 5} or W{i}!!") for i in range(300)], "doc_id long, text string")
    one, many = (wordvectors.corpus_sums(docs.repartition(n)) for n in (1, 9))
    assert (one == many).all() and one[:, -1].sum() == len(wordvectors.tokens([r["text"].encode() for r in docs.collect()])[0])


def test_network_learns_and_temperature_calibrates():
    random_ = np.random.default_rng(1)
    rows = random_.normal(size=(3000, 5))
    true = rows[:, 0] * rows[:, 1] + 0.5 * rows[:, 2]  # not linear
    labels = (random_.random(3000) < 1 / (1 + np.exp(-3 * true))).astype(float)
    network = qualityclassifier.Network(5)
    network.fit(rows[:2000], labels[:2000], rounds=40)
    raw = np.log1p(np.exp(-np.where(labels[2000:] > 0, 1, -1) * network.margins(rows[2000:]))).mean()
    network.calibrate(rows[2000:], labels[2000:])
    scores = network.scores(rows[2000:])
    assert -np.log(np.where(labels[2000:] > 0, scores, 1 - scores)).mean() <= raw + 1e-9
    assert ((scores > 0.5) == (labels[2000:] > 0)).mean() > 0.75


def good_and_bad(spark, n=400):
    rnd, words = random.Random(7), "the of and river stone garden walked slowly under bright morning sky houses".split()
    rows = []
    for i in range(n):
        text = " ".join(rnd.choice(words) for _ in range(rnd.randint(20, 60)))
        rows.append((i, text if i % 3 else rnd.choice((text.upper().replace(" ", "!! "), text.replace(" ", "### "), (text.split()[0] + " ") * 40)), int(bool(i % 3))))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int"), {r[0]: r[2] for r in rows}


def test_held_out_accuracy_and_no_look_at_held_out_labels(spark):
    docs, labels, truth = good_and_bad(spark)
    got = {r["doc_id"]: r for r in qualityclassifier.quality_scores(docs, labels).collect()}
    held = [i for i in truth if zlib.crc32(str(i).encode()) % 4 == 2]
    assert [i for i in got if got[i]["held_out"]] and all(got[i]["held_out"] == (i in held) for i in got)
    assert sum(got[i]["predicted"] == truth[i] for i in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got.values())
    turned = labels.selectExpr("doc_id", "if(crc32(cast(cast(doc_id AS string) AS binary)) % 4 = 2, 1 - quality, quality) AS quality")
    again = {r["doc_id"]: r["score"] for r in qualityclassifier.quality_scores(docs, turned).collect()}
    assert all(abs(again[i] - got[i]["score"]) < 1e-9 for i in got)


def test_quality_edges(spark):
    docs, labels, _ = good_and_bad(spark, 120)
    odd = edge_rows(spark, "w" * 200_000)
    model = qualityclassifier.fit_quality(docs, labels.union(labels.limit(5)))
    rows = model.score(odd).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert len({r["score"] for r in rows if r["doc_id"] in (2, 3, 4)}) == 1  # null, empty and blank texts alike
    assert qualityclassifier.quality_scores(docs.limit(0), labels).collect() == []
    assert {r["score"] for r in qualityclassifier.quality_scores(odd, labels.limit(0)).collect()} == {0.0}
    none = labels.selectExpr("doc_id", "cast(null AS int) AS quality")
    assert {r["score"] for r in qualityclassifier.quality_scores(odd, none).collect()} == {0.0}
