"""URL filters: rules by host suffix and path, host segmentation by unigram Viterbi, multinomial naive Bayes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hirelake.llm.common import reachable, settle, sorted_runs

#: (verdict, host, start of the path)
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Words that make a page a block example, and known words that start the unigram counts.
BLOCK_WORDS = ("adult", "ads", "bet", "bets", "bingo", "casino", "cheap", "escort", "farm", "free", "gambling", "jackpot", "loan",
               "lottery", "pharma", "pills", "poker", "porn", "replica", "sex", "slots", "spam", "track", "tracker", "viagra", "warez", "win", "xxx")
KNOWN_WORDS = ("article", "blog", "book", "city", "code", "data", "education", "food", "forum", "game", "garden", "health", "history", "home",
               "news", "library", "market", "media", "music", "online", "open", "photo", "press", "research", "school", "science", "shop",
               "sport", "store", "story", "tech", "travel", "video", "weather", "web", "wiki", "world", "the", "and", "of", "in", "for", "my", "best")
#: Shares of all counted words: what a known word has at least, and what a character outside of all words counts as. Only
#: shares enter, so a URL is cut and judged alike whatever the number of pages.
KNOWN_SHARE, UNKNOWN_SHARE = 1e-3, 1e-9
#: Share that is added to a token's share of each class.
SMOOTHING = 1e-5


def parts(url: str = "url") -> dict[str, Column]:
    """host and path of a URL; both are empty without ``://``."""
    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return {"host": F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
            "path": F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)}


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict): the longest rule that fits the host or a parent of it and the start of the path, else null.

    The longest is the one of most characters, host and path together; among equals the first listed.
    """
    name = verdict = None
    for kind, domain, start in sorted(rules, key=lambda r: -len(r[1]) - len(r[2])):
        fits = ((host == domain) | host.endswith(f".{domain}")) & path.startswith(start)
        name = F.when(fits, domain + start) if name is None else name.when(fits, domain + start)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return (name, verdict) if name is not None else (F.lit(None).cast("string"), F.lit(None).cast("string"))


def _pieces(text: Column) -> Column:
    """Runs of letters, runs of digits (as #)."""
    return F.transform(F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+|[0-9]+)"), F.lit(1)),
                       lambda t: F.when(t.rlike("^[0-9]"), F.lit("#")).otherwise(t))


def word_counts(hosts: DataFrame, paths: DataFrame) -> DataFrame:
    """(word, share, known): what the pages themselves part by dots, dashes and slashes, as a share of all such words
    by pages; the known words have KNOWN_SHARE at least."""
    spark = hosts.sparkSession
    seen = (hosts.select(F.explode(_pieces(F.col("host"))).alias("word"), "pages")
            .union(paths.select(F.explode(_pieces(F.col("path"))).alias("word"), "pages")).filter("word <> '#'"))
    known = spark.createDataFrame([(w, True) for w in dict.fromkeys((*BLOCK_WORDS, *KNOWN_WORDS))], "word string, known boolean")
    counted = seen.groupBy("word").agg(F.sum("pages").alias("n"))
    shares = counted.select("word", (F.col("n") / counted.agg(F.sum("n").alias("total")).scalar()).alias("share"))
    both = shares.join(known, "word", "full")
    least = F.when(F.col("known"), F.lit(KNOWN_SHARE))
    return both.select("word", F.greatest(F.coalesce("share", F.lit(0.0)), F.coalesce(least, F.lit(0.0))).alias("share"), F.coalesce("known", F.lit(False)).alias("known"))


def viterbi(text: str, worth: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """The likeliest way to cut ``text``; a stretch that is no known word costs ``unknown`` for each character."""
    best: list[tuple[float, int]] = [(0.0, 0)]
    ending: dict[int, list[int]] = {}
    for start, end in worth:
        ending.setdefault(end, []).append(start)
    for end in range(1, len(text) + 1):
        choices = [(best[end - 1][0] + unknown, end - 1)]
        choices += [(best[start][0] + worth[start, end], start) for start in ending.get(end, ())]
        best.append(max(choices))
    cuts, end = [], len(text)
    while end:
        start = best[end][1]
        cuts.append((start, end))
        end = start
    words: list[str] = []
    joined = -1  # where the last stretch of single unknown characters ended
    for start, end in reversed(cuts):
        if (start, end) not in worth and joined == start:
            words[-1] += text[start:end]
        else:
            words.append(text[start:end])
        joined = end if (start, end) not in worth else -1
    return words


def segmented(labels: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, words): each label cut by unigram Viterbi.

    Every substring as long as some word is joined to the word shares; the shares are not gathered anywhere and may be
    of any number, only the different lengths of words are. A label is not its own word, and a word has three letters at
    least, unless it is a known one: a label of several words would otherwise always be the word it was counted as.
    """
    reachable(labels.sparkSession)
    usable = counts.filter((F.length("word") > 2) | F.col("known"))
    sizes = sorted(r["n"] for r in usable.select(F.length("word").alias("n")).distinct().collect())
    positions = F.explode(F.expr(f"""flatten(transform(filter(array({', '.join(map(str, sizes)) or 0}), n -> n <= length(label) AND n > 0), n ->
        transform(sequence(1, length(label) - n + 1), s -> named_struct('start', s - 1, 'stop', s - 1 + n, 'word', substring(label, s, n)))))"""))
    spans = labels.filter("label <> ''").select("label", positions.alias("s")).select("label", "s.*")
    known = (spans.join(usable, "word")
             .filter((F.col("word") != F.col("label")) | F.col("known") | (F.length("label") <= 3))
             .select("label", "start", "stop", F.log("share").alias("worth")))
    rows = labels.filter("label <> ''").select("label", F.lit(-1).alias("start"), F.lit(-1).alias("stop"), F.lit(0.0).alias("worth")).union(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, at in sorted_runs(batches, ["label"]):
            data, out = part.to_pydict(), {"label": [], "words": []}
            for lo, hi in zip(at[:-1].tolist(), at[1:].tolist()):
                worth = {(data["start"][i], data["stop"][i]): data["worth"][i] for i in range(lo, hi) if data["stop"][i] > 0}
                out["label"].append(data["label"][lo])
                out["words"].append(viterbi(data["label"][lo], worth, math.log(UNKNOWN_SHARE)))
            yield pa.RecordBatch.from_pydict(out, pa.schema([("label", pa.string()), ("words", pa.list_(pa.string()))]))

    return rows.repartition("label").sortWithinPartitions("label").mapInArrow(run, "label string, words array<string>")


def filter_urls(pages: DataFrame, rules=RULES, block_words=BLOCK_WORDS) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block), words (of the segmented host).

    A rule decides where one fits. Elsewhere multinomial naive Bayes does, over the words of the segmented host and
    the tokens of the path (numbers count as ``#``). Its examples are all distinct hosts and paths: block where the
    segmented host has one of ``block_words`` or the path has one as a token, allow elsewhere; classes weigh as often as they occur.
    Counts and scores are made per distinct host and per distinct token by joins, over all pages.

    A null url, or one without ``://``, has an empty host and path and is allowed (score 0). Repeated rows and null
    page_ids are judged like others; an empty table gives no rows; other columns are left out.
    """
    cut = parts()
    judged = pages.select("page_id", cut["host"].alias("host"), cut["path"].alias("path"))
    hosts = settle(judged.groupBy("host").agg(F.count("*").alias("pages")), "hosts")
    paths = settle(judged.groupBy("host", "path").agg(F.count("*").alias("pages")), "paths")
    counts = settle(word_counts(hosts, paths), "word-counts")

    labels = hosts.select("host", F.posexplode_outer(F.regexp_extract_all(F.col("host"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("nth", "label"))
    cut_labels = segmented(labels.select("label").filter("label IS NOT NULL").distinct(), counts)
    host_words = settle(labels.join(cut_labels, "label", "left").groupBy("host")
                        .agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("words").isNotNull(), F.struct("nth", "words")))), lambda p: p["words"])).alias("words"))
                        .join(hosts, "host"), "host-words")

    known_bad = F.array(*map(F.lit, block_words))
    bad_host = F.arrays_overlap("words", known_bad)
    path_tokens = F.array_distinct(_pieces(F.col("path")))
    examples = (paths.join(host_words.select("host", "words", bad_host.alias("bad_host")), "host")
                .withColumn("tokens", path_tokens).withColumn("bad", F.col("bad_host") | F.arrays_overlap("tokens", known_bad)))
    tokens = (examples.select("bad", "pages", F.explode(F.transform("tokens", lambda t: F.concat(F.lit("path:"), t))).alias("token"))
              .union(examples.select("bad", "pages", F.explode(F.transform("words", lambda t: F.concat(F.lit("host:"), t))).alias("token"))))
    per_token = settle(tokens.groupBy("token").agg(F.sum(F.when(F.col("bad"), F.col("pages")).otherwise(0)).alias("block"),
                                                   F.sum(F.when(F.col("bad"), 0).otherwise(F.col("pages"))).alias("allow")), "token-counts")
    sums = per_token.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow")).first()
    block_total, allow_total = (max(sums[k] or 0, 1) for k in ("block", "allow"))
    of_class = examples.agg(F.sum(F.when(F.col("bad"), F.col("pages"))).alias("block"), F.sum(F.when(~F.col("bad"), F.col("pages"))).alias("allow")).first()
    pages_of = [(of_class[k] or 0) / max(1, (of_class["block"] or 0) + (of_class["allow"] or 0)) for k in ("block", "allow")]
    prior = math.log((pages_of[0] + SMOOTHING) / (pages_of[1] + SMOOTHING))
    pull = per_token.select("token", (F.log(F.col("block") / block_total + SMOOTHING) - F.log(F.col("allow") / allow_total + SMOOTHING)).alias("pull"))
    host_pull = (host_words.select("host", F.explode(F.transform("words", lambda t: F.concat(F.lit("host:"), t))).alias("token"))
                 .join(pull, "token").groupBy("host").agg(F.sum("pull").alias("host_pull")))
    path_pull = (paths.select("host", "path", F.explode(F.transform(path_tokens, lambda t: F.concat(F.lit("path:"), t))).alias("token"))
                 .join(pull, "token").groupBy("host", "path").agg(F.sum("pull").alias("path_pull")))
    scored = settle(paths.select("host", "path").join(path_pull, ["host", "path"], "left")
                    .join(host_pull, "host", "left").join(host_words.select("host", "words"), "host")
                    .select("host", "path", "words", (F.when(F.col("host") == "", 0.0).otherwise(F.lit(prior) + F.coalesce("host_pull", F.lit(0.0)) + F.coalesce("path_pull", F.lit(0.0)))).alias("score")), "url-scores")
    rule, by_rule = rule_of(F.col("host"), F.col("path"), rules)
    return (judged.join(scored, ["host", "path"])
            .select("page_id", "host", "path", rule.alias("rule"),
                    F.coalesce(by_rule, F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"), F.round("score", 6).alias("score"), "words"))
