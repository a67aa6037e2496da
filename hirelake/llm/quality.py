"""Quality rules: a table of thresholds compiled into one projection of built-in functions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: ASCII white space, as written in a SQL text.
_SPACES = r" \t\n\u000B\u000C\r"
WINDOW = 5

#: Frequent words of the languages that are expected.
STOP_WORDS = {
    "en": "the a an and or of to in is was are were be been it that this with for on as by at from not".split(),
    "fr": "le la les un une des de du et ou à en est sont que qui dans pour par sur au aux avec pas".split(),
    "de": "der die das den dem des ein eine einer und oder zu in ist sind von mit für auf im nicht sich als auch".split(),
    "es": "el la los las un una y o de del en es son que se con por para su lo al como no".split(),
}


@dataclass(frozen=True)
class Rule:
    """A document fails if ``measure`` is below ``least`` or above ``most``; null measures never fail."""

    name: str
    measure: str
    least: float | None = None
    most: float | None = None
    #: Documents of fewer words are not judged by this rule.
    from_words: int = 0


#: The threshold table.
RULES = (
    Rule("few_words", "n_words", least=10),
    Rule("repeated_words", "repeat_ratio", most=0.2),
    Rule("word_length", "mean_word_chars", least=2.5, most=14),
    Rule("symbols", "symbol_ratio", most=0.1),
    Rule("few_stop_words", "stop_ratio", least=0.02, from_words=50),
    Rule("repeated_lines", "dup_line_ratio", most=0.3),
    Rule("capitals", "capital_ratio", most=0.4),
)


def with_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, measures …) by built-in functions, each costly step in a projection of its own so that it runs once.

    Words are parted by ASCII white space. A repeated window is told by a 64-bit hash of its words; only a text that
    has equal hashes goes on to sort them, and the places of equal neighbours, ascending, give the words covered.
    """
    stop = ", ".join(f"'{w}'" for w in sorted(set().union(*STOP_WORDS.values())))
    trimmed = docs.select("doc_id", F.expr("coalesce(text, '') AS text")).withColumn("_trimmed", F.expr(f"trim(BOTH '{_SPACES}' FROM text)"))
    worded = trimmed.select("doc_id", "text", F.expr(
        f"CASE WHEN _trimmed = '' THEN array() ELSE split(_trimmed, '[{_SPACES}]+', -1) END AS _words"))
    parts = ", ".join(f"get(_words, i + {k})" for k in range(WINDOW))
    counted = worded.selectExpr(
        "doc_id", "text", "_words", "cast(size(_words) AS long) AS n_words",
        f"CASE WHEN size(_words) < {WINDOW} THEN array() ELSE transform(sequence(0, size(_words) - {WINDOW}), i -> xxhash64({parts})) END AS _windows",
        f"filter(split(text, '\n', -1), l -> trim(BOTH '{_SPACES}' FROM l) <> '') AS _lines")
    paired = counted.selectExpr(
        "doc_id", "n_words", "char_length(array_join(_words, '')) AS word_chars", "char_length(text) AS n_chars",
        # The symbols are single octets, so octets are counted.
        "octet_length(text) - octet_length(regexp_replace(text, '[#*$%&|<>]+', '')) AS n_symbols",
        "char_length(text) - char_length(regexp_replace(text, '\\\\p{Lu}+', '')) AS n_capitals",
        "size(_lines) AS n_lines", "size(_lines) - size(array_distinct(_lines)) AS n_dup_lines",
        f"size(filter(_words, w -> lower(w) IN ({stop}))) AS n_stop",
        "CASE WHEN size(array_distinct(_windows)) < size(_windows) THEN sort_array(transform(_windows, (h, i) -> struct(h AS h, i AS i))) END AS _pairs")
    placed = paired.withColumn("_places", F.expr("""sort_array(transform(filter(transform(_pairs, (p, k) -> struct(p.h AS h, p.i AS i, k AS k)),
        x -> get(_pairs, x.k - 1).h = x.h OR get(_pairs, x.k + 1).h = x.h), x -> x.i))"""))
    covered = f"aggregate(_places, struct(-{WINDOW} AS last, 0L AS n), (a, i) -> struct(i AS last, a.n + least({WINDOW}, i - a.last) AS n), a -> a.n)"
    whole = placed.withColumn("n_repeat_words", F.expr(f"coalesce({covered}, 0L)")).drop("_pairs", "_places")

    def ratio(over: str, under: str) -> Column:
        return F.when(F.col(under) > 0, F.col(over) / F.col(under))

    return whole.select(
        "doc_id", *(F.col(c).cast("long").alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ratio("word_chars", "n_words").alias("mean_word_chars"), ratio("n_symbols", "n_words").alias("symbol_ratio"),
        ratio("n_stop", "n_words").alias("stop_ratio"), ratio("n_dup_lines", "n_lines").alias("dup_line_ratio"),
        ratio("n_repeat_words", "n_words").alias("repeat_ratio"), ratio("n_capitals", "word_chars").alias("capital_ratio"))


def compiled(rules: tuple[Rule, ...]) -> Column:
    """Names of the rules that a row of measures breaks, as one expression."""
    broken = []
    for rule in rules:
        value, outside = F.col(rule.measure), F.lit(False)
        if rule.least is not None:
            outside = outside | (value < rule.least)
        if rule.most is not None:
            outside = outside | (value > rule.most)
        broken.append(F.when(outside & (F.col("n_words") >= rule.from_words), F.lit(rule.name)))
    return F.array_compact(F.array(*broken)) if broken else F.array().cast("array<string>")


def quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, ratios, base_failed, failed (names of
    the rules that are broken), kept.

    One projection, no shuffle, no user function; columns other than doc_id and text are not read. A null or empty
    text has no words: its counts are 0, its ratios null, and it fails for its length. Repeated rows and null ids are
    judged like others; an empty table gives no rows.
    """
    judged = with_measures(docs).withColumn("failed", compiled(rules)).withColumn(
        "base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("failed") == 0))


def quality_documents(docs: DataFrame) -> DataFrame:
    """The counts of the contract, base_failed, kept and failed (names of the rules that a text breaks), a row for each row.

    A null text is an empty one and fails; a null doc_id stays null; texts are read whole; a measure that equals its
    threshold passes; repeated rows each get a row; other columns, whatever their names, are left out; an empty table
    gives no rows.
    """
    return quality(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")
