"""Edge cases and brute-force versions of the training-data operators on small fixtures."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import xxhash

from hirelake.llm import bitslice, bpe, linededup, merkle, packing, pii, quality, secrets, simhash, toxicity, urls
from hirelake.llm.components import connected

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, features string, n_lines long"
ROWS = [(None, "a null id\nwith a line", None, None, None, "x", 1), (1, None, "en", "s", 0, None, None), (2, "", "en", "s", 0, "x", 1),
        (3, "one two three four five six seven eight nine ten eleven twelve\nshort", "en", "s", 5, "x", 1),
        (4, "one two three four five six seven eight nine ten eleven twelve\nother", "en", "s", 5, "x", 1),
        (4, "one two three four five six seven eight nine ten eleven twelve\nother", "en", "s", 5, "x", 1),
        (5, "long " * 40_000, "en", "s", 5, "x", 1), (6, 'é🎉 a@b.c_d@e.f +1 (509) 555-6973; 4111 1111 1111 1111 token = "abcdefgh12"', "en", "s", 5, "x", 1),
        (7, '+1 (509) 555-6973 4111 1111 1111 1111', "en", "s", 5, "x", 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, None) for i in range(3)], "doc_id long, toxic int, quality int")


WORDS, RANKS = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
OPERATORS = {
    "pii": pii.personal_data_documents, "secrets": secrets.secret_documents, "quality": quality.quality_documents,
    "simhash": simhash.near_duplicate_documents, "lines": linededup.line_dedup_documents, "merkle": merkle.edited_documents,
    "bpe": lambda d: bpe.token_digests(d, RANKS, public_tokenizers.PATTERN),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_each_and_empty_tables(docs, nothing, name):
    assert sorted((r["doc_id"] or -1) for r in OPERATORS[name](docs).collect()) == [-1, 1, 2, 3, 4, 4, 5, 6, 7]
    assert OPERATORS[name](nothing).collect() == []


def test_packing_covers_every_id_once(docs, nothing):
    rows = packing.pack(docs, WORDS).collect()
    assert packing.pack(nothing, WORDS).collect() == []
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by_sequence.values():
        at = 0
        for offset, length in sorted(placed):
            assert offset == at
            at += length
        assert at <= 2048
    long = sorted((r["start"], r["length"], r["doc_tokens"]) for r in rows if r["doc_id"] == 5)
    assert sum(x[1] for x in long) == long[0][2] == 40_001


def test_packing_plan_uses_the_histogram_up():
    rng = random.Random(1)
    histogram = {s: rng.randint(1, 400) for s in range(1, 257)}
    used = Counter()
    for times, pattern in packing.packing_plan(histogram, 256):
        assert sum(s * c for s, c in pattern.items()) <= 256
        for size, copies in pattern.items():
            used[size] += times * copies
    assert used == histogram


def test_bpe_against_the_library():
    import tiktoken
    codec = bpe.Codec(bpe.read_ranks(RANKS), public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})
    rng = random.Random(2)
    for _ in range(500):
        text = "".join(rng.choice("abcdeTh \n\t'sé日本🎉0123.,!-\xa0") for _ in range(rng.randint(0, 80)))
        assert codec.encode(text) == library.encode_ordinary(text)
        assert codec.decode(codec.encode(text)) == text.encode()
    assert sorted(codec.hash.slots) == list(range(codec.hash.n))


def test_word_ids_against_the_library():
    from tokenizers import Tokenizer
    model = open(WORDS, "rb").read()
    words, whole = packing.WordIds(model), Tokenizer.from_buffer(model)
    whole.encode_special_tokens = True
    rng = random.Random(3)
    for _ in range(500):
        text = "".join(rng.choice("abcDE \n\t'sé日🎉01.,!İΣÅ;:?") for _ in range(rng.randint(0, 60)))
        assert np.frombuffer(next(words.encode([text.encode()])), "<u4").tolist() == whole.encode(text, add_special_tokens=False).ids


def test_simhash_bits():
    text = "The cat, the CAT and the dog\tran\nhome"
    words = text.lower().split()
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i:i + 3]), 42) for i in range(len(words) - 2)]
    assert simhash.simhash(text.encode()) == sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_bit_planes_against_all_pairs(spark):
    rng = random.Random(4)
    values = []
    for _ in range(60):
        value = rng.getrandbits(64)
        for _ in range(rng.choice((1, 2, 40))):
            values.append(value)
            value ^= 1 << rng.randrange(64)
    values = sorted(set(values))
    block = bitslice.Planes(np.array(values, dtype=np.uint64))
    near = block.close(block.values, 3)
    for i, v in enumerate(values):
        assert bitslice.lanes(near[i], block.n).tolist() == [j for j, w in enumerate(values) if (v ^ w).bit_count() <= 3]
    root = list(range(len(values)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, v in enumerate(values):
        for j in range(i):
            if (v ^ values[j]).bit_count() <= 3:
                root[max(top(i), top(j))] = min(top(i), top(j))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    for most in (4096, 8):  # also with buckets that are dealt into chunks
        links = bitslice.near_links(spark.createDataFrame([(s,) for s in signed], "fingerprint long"), 3, most=most)
        groups = {r["node"]: r["component"] for r in connected(links).collect()}
        got = Counter(groups.get(s, s) for s in signed)
        assert sorted(got.values()) == sorted(Counter(top(i) for i in range(len(values))).values())


def test_lines(spark, docs):
    kept = {(r["doc_id"], r["kept_text"]) for r in linededup.drop_repeated_lines(docs).collect() if r["doc_id"] in (3, 4)}
    assert kept == {(3, ROWS[3][1]), (4, "other")}
    assert linededup.edit_distance("kitten", "sitting") == 3 and linededup.edit_distance("", "ab") == 2
    rng = random.Random(5)
    for _ in range(200):
        a, b = ("".join(rng.choice("ab ") for _ in range(rng.randint(0, 12))) for _ in range(2))
        rows = list(range(len(b) + 1))
        for i, x in enumerate(a):
            rows = [i + 1] + rows
            rows = [rows[0]] + [0] * len(b) if not b else _levenshtein_row(rows[1:], x, b, i)
        assert linededup.edit_distance(a, b) == rows[-1]
        assert linededup.at_most(a, b) >= linededup.edit_distance(a, b)


def _levenshtein_row(before, x, b, i):
    row = [i + 1]
    for j, y in enumerate(b):
        row.append(min(row[-1] + 1, before[j + 1] + 1, before[j] + (x != y)))
    return row


def test_spans(docs):
    found = {r["doc_id"]: r for r in pii.personal_data_documents(docs).collect()}
    assert (found[7]["n_card"], found[7]["n_phone"]) == (0, 0)  # the longest matches hold too many digits, and nothing is tried again
    row, text = found[6], next(r[1] for r in ROWS if r[0] == 6)
    assert (row["n_email"], row["n_ip"], row["n_card"], row["n_phone"]) == (2, 0, 1, 1)
    for part in row["spans"].split(","):
        kind, start, stop = part.split(":")
        assert kind in pii.KINDS and text[int(start):int(stop)].strip() == text[int(start):int(stop)]
    row = next(r for r in secrets.secret_documents(docs).collect() if r["doc_id"] == 6)
    match = re.search(r'token = "abcdefgh12', text)
    assert row["spans"] == f"assign:{match.start()}:{match.end()}"
    assert row["base_sha256"] == hashlib.sha256(row["spans"].encode()).hexdigest()
    clean = next(r for r in secrets.redacted(docs).collect() if r["doc_id"] == 6)
    assert clean["text"] == text[:match.start()] + "[secret]" + text[match.end():]


def test_ledger_scans_each_pair_once(spark, tmp_path):
    ledger = secrets.BlobLedger(spark, str(tmp_path / "ledger"))
    versions = spark.createDataFrame([("a", "token=12345678"), ("b", "token=12345678"), ("c", "x")], "path string, text string")
    ledger.scan(versions, secrets.BASE_RULES)
    assert ledger.rows().count() == 2
    ledger.scan(versions, secrets.RULES)  # only the further rules are new
    assert {tuple(r["rules"]) for r in ledger.rows().collect()} == {tuple(r.key for r in secrets.BASE_RULES), tuple(r.key for r in secrets.MORE_RULES)}
    ledger.scan(versions, secrets.RULES)
    assert sum(len(r["rules"]) for r in ledger.rows().collect()) == 2 * len(secrets.RULES)
    assert {r["path"]: len(r["findings"]) for r in ledger.joined(versions).collect()} == {"a": 1, "b": 1, "c": 0}


def test_toxicity(spark, docs, nothing, labels):
    assert toxicity.toxicity_scores(nothing, labels).collect() == []
    assert len(toxicity.toxicity_scores(docs, labels.limit(0)).collect()) == len(ROWS)
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("alpha beta gamma delta".split()) for _ in range(30)) + (" you idiot" if i % 4 == 0 else "")) for i in range(400)]
    made = spark.createDataFrame(rows, "doc_id long, text string")
    told = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(400)], "doc_id long, toxic int")
    out = toxicity.toxicity_scores(made, told).collect()
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in out if r["held_out"]) and any(r["held_out"] for r in out)


def test_merkle():
    text = "First sentence. Second one!\nAnother paragraph of words.\n\nThe end."
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text)) == 1.0
    assert 0 < merkle.likeness(merkle.fingerprint(text), merkle.fingerprint(text.replace("Another", "Some"))) < 1
    assert merkle.likeness(merkle.fingerprint(text), merkle.fingerprint("")) == 0.0


def test_urls(spark):
    pages = spark.createDataFrame([(1, "http://WWW.example.net/en/1?x"), (2, "https://a.example.net"), (3, None), (4, "no host"), (5, "http://casinowin.example.org/x"),
                                   (6, "http://example.com/de/"), (7, "http://blog.example.org/fr/1#t"), (8, "http://xexample.com/de/")]
                                  + [(10 + i, f"http://city{i}.example.org/en/{i}") for i in range(30)], "page_id long, url string")
    out = {r["page_id"]: r for r in urls.filter_urls(pages).collect()}
    assert (out[1]["host"], out[1]["path"], out[1]["rule"], out[1]["verdict"]) == ("www.example.net", "/en/1", "example.net/en/", "allow")
    assert (out[2]["path"], out[2]["rule"], out[2]["verdict"]) == ("", None, "allow")
    assert (out[3]["host"], out[4]["host"], out[3]["verdict"]) == ("", "", "allow")
    assert out[5]["verdict"] == "block" and out[5]["words"][:2] == ["casino", "win"]
    assert (out[6]["rule"], out[7]["rule"], out[8]["rule"]) == ("example.com/de/", "org/fr/", None)
