"""Text, number and JSON-value helpers.

Arguments are SQL text: a column name, or any expression. The ``…_sql`` functions give SQL text back for composing,
the others a Column. Building one expression text instead of hundreds of Column objects keeps planning short, and
everything stays in the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from hirelake import rules

SPACE = r"[\s\x1C-\x1F]"
_SPACES = "".join(chr(code) for code in range(0x10000) if chr(code).isspace())  # the characters of SPACE
_NON_ASCII_DIGITS = [chr(code) for code in range(128, 0x10000) if unicodedata.category(chr(code)) == "Nd"]
_DIGITS_FROM = "".join(_NON_ASCII_DIGITS)
_DIGITS_TO = "".join(str(unicodedata.decimal(char)) for char in _NON_ASCII_DIGITS)


def quoted(text: str) -> str:
    """SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let_sql(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` standing for ``value``, which is evaluated once."""
    return f"get(transform(array({value}), {name} -> {body}), 0)"


def strip_sql(text: str) -> str:
    return f"trim(BOTH {quoted(_SPACES)} FROM {text})"


def strip(text: str) -> Column:
    """Remove white space (all of Unicode's, not only blanks) at both ends. No pattern runs over the text in between."""
    return F.expr(strip_sql(text))


def number_sql(text: str) -> str:
    """Decimal digits of any script to double; null if it is not a number."""
    return f"try_cast(translate({text}, '{_DIGITS_FROM}', '{_DIGITS_TO}') AS double)"


def numeric_kind_sql(kind: str) -> str:
    return f"rlike({kind}, '^(BIGINT|INT|SMALLINT|TINYINT|DOUBLE|FLOAT|DECIMAL)')"


def _member_sql(value: str, key: str) -> str:
    """Text of one object member, null when it is absent or empty (null, '', 0, false, [] or {})."""
    text = "cast(m AS string)"
    empty_value = f"({text} IN ('0', '0.0', 'false', '[]', '{{}}') AND schema_of_variant(m) <> 'STRING')"
    usable = f"CASE WHEN {text} <> '' AND NOT {empty_value} THEN {text} END"
    return let_sql(f"try_variant_get({value}, '$.{key}', 'variant')", "m", usable)


def text_of_sql(value: str, keys=rules.TEXT_KEYS) -> str:
    members = ", ".join(_member_sql("v", key) for key in keys)
    text = f"""CASE WHEN k = 'STRING' THEN cast(v AS string)
      WHEN startswith(k, 'OBJECT') THEN coalesce({members}, cast(v AS string))
      WHEN k = 'BOOLEAN' THEN initcap(cast(v AS string)) ELSE cast(v AS string) END"""
    by_kind = let_sql("schema_of_variant(v)", "k", text)
    return strip_sql(f"coalesce({let_sql(value, 'v', by_kind)}, '')")


def text_of(value: str, keys=rules.TEXT_KEYS) -> Column:
    """Text of a variant: '' for null, a string as it is, the first usable member of an object, else its JSON form."""
    return F.expr(text_of_sql(value, keys))


# Fixed value: what counts as an amount inside a salary text.
AMOUNT = r"(?U)[\d,]+(?:\.\d+)?"


def amounts_in_text_sql(text: str) -> str:
    hits = f"regexp_extract_all(coalesce({text}, ''), {quoted(AMOUNT)}, 0)"
    number = number_sql("replace(h, ',', '')")
    return let_sql(
        f"transform({hits}, h -> {number})", "n",
        "named_struct('min', array_min(n), 'max', array_max(n), 'bad', exists(n, x -> x IS NULL))",
    )


def amounts_in_text(text: str) -> Column:
    """struct(min, max, bad) over all amounts in a text; ``bad`` marks an amount that is no number (only commas)."""
    return F.expr(amounts_in_text_sql(text))


def parse_amounts_sql(value: str) -> str:
    number = f"""CASE WHEN {numeric_kind_sql('schema_of_variant(v)')} THEN try_cast(cast(v AS string) AS double)
      WHEN schema_of_variant(v) = 'BOOLEAN' THEN if(cast(v AS string) = 'true', 1.0D, 0.0D) END"""
    exact = "named_struct('min', e, 'max', e, 'bad', false)"
    chosen = let_sql(number, "e", f"if(e IS NOT NULL, {exact}, {amounts_in_text_sql('cast(v AS string)')})")
    return let_sql(value, "v", chosen)


def parse_amounts(value: str) -> Column:
    """As :func:`amounts_in_text` for a variant: a number is its own range, anything else is read as text."""
    return F.expr(parse_amounts_sql(value))


def split_place_sql(text: str) -> str:
    pieces = let_sql(f"split({text}, ',')", "p", "named_struct('city', {}, 'region', {})".format(
        strip_sql("get(p, 0)"), strip_sql("get(p, 1)")))
    return f"CASE WHEN {text} <> '' THEN {pieces} END"


def split_place(text: str) -> Column:
    """struct(city, region) from 'City, Region'; blank gives null, further parts are dropped."""
    return F.expr(split_place_sql(text))


def title_plus_description(title: str, description: str) -> Column:
    return F.expr(f"concat({title}, ' ', coalesce({description}, ''))")
