"""URL filters against a loop, whatever the number of pages, and edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from hirelake.llm import toxicity, urls


def made_pages(n=160, seed=3):
    rng = random.Random(seed)
    words = ["news", "garden", "casino", "poker", "river", "stone", "cheap", "school", "lamp", "bright", "zebra", "house", "pills", "cloud"]
    out = []
    for i in range(n):
        host = rng.choice(["", "www."]) + "".join(rng.sample(words, rng.randint(1, 3))) + rng.choice([".com", ".org", ".net", ".example.net", ".io"])
        path = "".join(f"/{rng.choice(words + ['en', 'fr', 'de', '12'])}" for _ in range(rng.randint(0, 3)))
        out.append((i, rng.choice(["http://", "HTTPS://"]) + host.upper() + path + rng.choice(["", "?casino=1", "#x"])))
    return out + [(n, None), (n + 1, "no scheme"), (None, "http://garden.com/"), (2, out[2][1])]


def pieces(text):
    return ["#" if t[0] in "0123456789" else t for t in re.findall(r"[^\W\d_]+|[0-9]+", text.lower())]


def brute(rows):
    """Viterbi over all substrings and naive Bayes over all pages, by loops."""
    cut = []
    for page, url in rows:
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest)[0]
        cut.append((page, host.lower(), re.match(r"[^?#]*", rest[len(host):])[0]))
    counts = Counter(w for _, h, p in cut for w in pieces(h) + pieces(p) if w != "#")
    total, known = sum(counts.values()), {*urls.BLOCK_WORDS, *urls.KNOWN_WORDS}
    share = {w: max(counts[w] / total, urls.KNOWN_SHARE if w in known else 0) for w in {*counts, *known}}

    def split(label):
        worth = {(s, e): math.log(share[label[s:e]]) for s in range(len(label)) for e in range(s + 1, len(label) + 1)
                 if label[s:e] in share and (e - s > 2 or label[s:e] in known) and (label[s:e] != label or label in known or len(label) <= 3)}
        return urls.viterbi(label, worth, math.log(urls.UNKNOWN_SHARE))

    words = {h: [w for label in re.findall(r"[^\W\d_]+", h) for w in split(label)] for _, h, _ in cut}
    seen = defaultdict(lambda: [0, 0])
    classes, bad_words = [0, 0], set(urls.BLOCK_WORDS)
    pages = Counter((h, p) for _, h, p in cut)
    for (h, p), n in pages.items():
        tokens = set(pieces(p))
        allow = not (bad_words & set(words[h]) or bad_words & tokens)
        classes[allow] += n
        for token in [*(f"path:{t}" for t in tokens), *(f"host:{w}" for w in words[h])]:
            seen[token][allow] += n
    totals = [max(1, sum(v[k] for v in seen.values())) for k in (0, 1)]
    pull = {t: math.log(v[0] / totals[0] + urls.SMOOTHING) - math.log(v[1] / totals[1] + urls.SMOOTHING) for t, v in seen.items()}
    prior = math.log((classes[0] / sum(classes) + urls.SMOOTHING) / (classes[1] / sum(classes) + urls.SMOOTHING))
    out = []
    for page, h, p in cut:
        score = prior + sum(pull[f"host:{w}"] for w in words[h]) + sum(pull[f"path:{t}"] for t in set(pieces(p))) if h else 0.0
        fits = [r for r in sorted(urls.RULES, key=lambda r: -len(r[1] + r[2])) if (h == r[1] or h.endswith("." + r[1])) and p.startswith(r[2])]
        out.append((page, h, p, fits[0][1] + fits[0][2] if fits else None, fits[0][0] if fits else "block" if score > 0 else "allow", score, tuple(words[h])))
    return out


def judged(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string").select("*", *(F.lit("x").alias(c) for c in ("host", "path", "rule", "words", "label")))
    return [(*tuple(r)[:5], r["score"], tuple(r["words"] or ())) for r in urls.filter_urls(pages).collect()]


def test_urls_against_loops_and_at_ten_times_the_size(spark):
    rows = made_pages()
    want = brute(rows)
    assert {w[4] for w in want} == {"block", "allow"}
    plain = lambda r: (*r[:5], r[6])  # noqa: E731  all but the score
    for times in (1, 10):
        got = judged(spark, rows * times)
        assert Counter(map(plain, got)) == Counter({k: times * n for k, n in Counter(map(plain, want)).items()})
        scores = {(w[1], w[2]): w[5] for w in want}
        assert all(g[5] == pytest.approx(scores[g[1], g[2]], abs=1e-3) for g in got)


def test_long_words_are_found_in_hosts(spark):
    long = "pneumonoultramicroscopicvolcanoconiosis"
    rows = [(1, f"http://a.com/{long}"), (2, f"http://my{long}news.com/"), (3, "http://" + "q" * 3000 + ".com/")]
    got = {r[0]: r[6] for r in judged(spark, rows)}
    assert got[2] == ("my", long, "news", "com") and got[3] == ("q" * 3000, "com")


def test_no_pages(spark):
    assert judged(spark, [(1, "x")])[0][:5] == (1, "", "", None, "allow")
    assert urls.filter_urls(spark.createDataFrame([], "page_id long, url string")).collect() == []


@pytest.mark.parametrize("length", [1, 70, 5000])
def test_stretched_insults_of_any_length(length):
    hidden = toxicity.FEATURES.index("hidden_insults")
    stretched = "idi" + "o" * (length + 2) + "t"
    assert toxicity.features(f"what an {stretched} really", frozenset())[hidden] == math.log1p(1)
    assert toxicity.features("x" * length + "aaab" * length, frozenset())[hidden] == 0
