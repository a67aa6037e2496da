"""Features read out of posting text: years of experience, ordered keyword rules, dictionary terms, USD amounts.

Arguments are SQL text, as in :mod:`hirelake.functions.text`.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake import rules
from hirelake.functions.text import SPACE, let_sql, number_sql, quoted, strip_sql

# ---- fixed values: patterns for years of experience, tried in this order ------------------------------------------
_NUMBER = r"\d+(?:\.\d+)?"
_UNIT = r"(?:years|yrs|yr|year)"
# Word edges are spelled out, because Java's \b takes marks that follow a letter for part of the word, and rules.WORD does not.
_START = f"(?<!{rules.WORD})"
_END = f"(?!{rules.WORD})"
_EDGE = f"(?:(?<={rules.WORD})(?!{rules.WORD})|(?<!{rules.WORD})(?={rules.WORD}))"
YEARS_RANGE = rf"(?iU){_START}{_NUMBER}{SPACE}*(?:-|to){SPACE}*{_NUMBER}{SPACE}*{_UNIT}{_END}"
YEARS_PLUS = rf"(?iU){_START}{_NUMBER}{SPACE}*\+{SPACE}*{_UNIT}{_END}"
YEARS_LABEL = (rf"(?iU)(?:experience|exp)(?:{SPACE}*level)?{SPACE}*[:-]?{SPACE}*"
               rf"{_NUMBER}{SPACE}*{_UNIT}?{_EDGE}")
PLUS_SPAN = 4.0


def _years_sql(text: str) -> str:
    def found(pattern: str, low: str, high: str) -> str:
        numbers = f"transform(regexp_extract_all(h, {quoted(f'(?U){_NUMBER}')}, 0), x -> {number_sql('x')})"
        bounds = let_sql(numbers, "n", f"named_struct('min', {low}, 'max', {high})")
        return let_sql(f"regexp_extract(t, {quoted(pattern)}, 0)", "h", f"CASE WHEN h <> '' THEN {bounds} END")

    first, second = "get(n, 0)", "get(n, 1)"
    with_unit = f"coalesce({found(YEARS_RANGE, first, second)}, {found(YEARS_PLUS, first, f'{first} + {PLUS_SPAN}D')})"
    tried = let_sql("lower(t)", "f", f"""coalesce(CASE WHEN contains(f, 'yr') OR contains(f, 'year') THEN {with_unit} END,
      CASE WHEN contains(f, 'exp') THEN {found(YEARS_LABEL, first, first)} END)""")
    with_digit = f"CASE WHEN rlike(t, {quoted(r'\p{Nd}')}) THEN {tried} END"
    return let_sql(f"translate({text}, '–—', '--')", "t", with_digit)


def years_range(text: str, fallback: str | None = None) -> Column:
    """struct(min, max) years asked for in ``text``, else in ``fallback``; null when neither names any.

    'X - Y years' gives (X, Y), 'X+ years' gives (X, X + 4), 'experience: X' gives (X, X). Each pattern scans the
    text once; the numbers are then taken from the short hit. A text without a digit is not scanned at all, and a
    pattern runs only where the letters occur that it cannot do without.
    """
    return F.expr(_years_sql(text) if fallback is None else f"coalesce({_years_sql(text)}, {_years_sql(fallback)})")


def first_rule_sql(text: str, ordered_rules, default: str, folded: bool = False) -> str:
    lowered = text if folded else f"lower({text})"
    cases = " ".join(
        "WHEN " + " OR ".join(f"contains({lowered}, {quoted(word)})" for word in words) + f" THEN {quoted(label)}"
        for label, words in ordered_rules
    )
    return f"CASE {cases} ELSE {quoted(default)} END" if cases else quoted(default)


def first_rule(text: str, ordered_rules, default: str, folded: bool = False) -> Column:
    """Label of the first rule with a keyword contained in the lower-cased text; ``default`` if none or blank.

    Pass ``folded=True`` when the text is already lower-cased, so that the work is done once per row.
    """
    return F.expr(first_rule_sql(text, ordered_rules, default, folded))


def role_category(title: str, ordered_rules=rules.ROLE_RULES, folded: bool = False) -> Column:
    return first_rule(title, ordered_rules, rules.ROLE_DEFAULT, folded)


def work_mode(description: str, ordered_rules=rules.MODE_RULES, folded: bool = False) -> Column:
    return first_rule(description, ordered_rules, rules.MODE_DEFAULT, folded)


def currency_sql(country: str, ordered_rules=rules.CURRENCY_RULES) -> str:
    chain = first_rule_sql("c", ordered_rules, rules.CURRENCY_DEFAULT, folded=True)
    return let_sql(f"lower({strip_sql(country)})", "c", chain)


def currency_of(country: str, ordered_rules=rules.CURRENCY_RULES) -> Column:
    return F.expr(currency_sql(country, ordered_rules))


def fold_case(text: str) -> Column:
    """Case-folded copy used as a cheap pre-test: if a term matches ignoring case, its folded form is contained.

    The empty text in between keeps the optimizer from taking lower(upper(x)) for lower(x), which folds less.
    """
    return F.expr(f"lower(concat(upper({text}), ''))")


def _is_word(stem: str) -> bool:
    """Does the stem consist of word characters, one folded character for each?"""
    return all(c.isalnum() or c == "_" for c in stem) and len(stem.upper().lower()) == len(stem)


def _fold(stem: str) -> str:
    return stem.upper().lower()


def dictionary_words_sql(text: str, folded: str, terms=None) -> str:
    """array<string>: the folded one-word terms that are words of the text, by one pass over its words and one lookup.

    ``folded`` is :func:`fold_case` of the same text. Null where folding changed the number of characters (as for ß):
    there a word of the folded text may be none of the text, and each term is tested by its pattern. A list of constants
    becomes one hash set for all rows; the array functions would build theirs again for each text.
    """
    terms = rules.default_terms() if terms is None else terms
    words = ", ".join(quoted(w) for w in sorted({_fold(term.stem) for term in terms if not term.ending and _is_word(term.stem)}))
    found = f"array_distinct(filter(regexp_extract_all({folded}, {quoted(rules.WORD + '+')}, 0), w -> w IN ({words})))"
    return f"CASE WHEN char_length({folded}) = char_length({text}) THEN {found if words else 'cast(array() AS array<string>)'} END"


def term_hits(text: str, folded: str, terms=None) -> Column:
    """array<struct(term, term_type)> of the dictionary terms that occur in ``text`` as whole words.

    ``folded`` is :func:`fold_case` of the same text. One-word terms are looked up (see :func:`dictionary_words_sql`); a
    term of several words, or with other characters, runs its regular expression only where a plain byte search finds its
    stem. All of it is one expression, so a query that does not read the terms does none of the work.
    """
    words = "ws"
    terms = rules.default_terms() if terms is None else terms

    def tag(term) -> str:
        return f"named_struct('term', {quoted(term.name)}, 'term_type', {quoted(term.kind)})"

    def by_pattern(some) -> str:
        hits = ", ".join(
            f"CASE WHEN contains({folded}, {quoted(_fold(term.stem))})"
            f" AND rlike({text}, {quoted(rules.whole_word(term.stem, term.ending))}) THEN {tag(term)} END"
            for term in some
        )
        return f"array_compact(array({hits}))"

    by_word: dict[str, list] = {}
    for term in terms:
        if not term.ending and _is_word(term.stem):
            by_word.setdefault(_fold(term.stem), []).append(term)
    if not by_word:
        return F.expr(by_pattern(terms))
    tags = ", ".join(f"array({', '.join(map(tag, some))})" for some in by_word.values())
    place = f"cast(array_position(array({', '.join(map(quoted, by_word))}), w) AS int) - 1"
    looked_up = f"flatten(transform({words}, w -> get(array({tags}), {place})))"
    others = [term for term in terms if term.ending or not _is_word(term.stem)]
    found = f"concat({looked_up}, {by_pattern(others)})" if others else looked_up
    chosen = f"CASE WHEN {words} IS NULL THEN {by_pattern(terms)} ELSE {found} END"
    return F.expr(let_sql(dictionary_words_sql(text, folded, terms), words, chosen))


def to_usd(low: str, high: str, country: str, rates=None, ordered_rules=rules.CURRENCY_RULES) -> Column:
    """struct(min_usd, max_usd, mid_usd, currency); a missing side takes the other, the middle is not rounded."""
    rates = rules.USD_RATES if rates is None else rates
    rate = "CASE c " + " ".join(f"WHEN {quoted(name)} THEN {value}D" for name, value in rates.items()) + " ELSE 1.0D END"
    converted = let_sql(
        f"named_struct('c', c, 'low', coalesce({low}, {high}) * {rate}, 'high', coalesce({high}, {low}) * {rate})", "u",
        "named_struct('min_usd', u.low, 'max_usd', u.high, 'mid_usd', (u.low + u.high) / 2.0D, 'currency', u.c)",
    )
    return F.expr(let_sql(currency_sql(country, ordered_rules), "c", converted))
