"""Spans of regular expressions in a text by built-in functions: code points from 0, ends exclusive."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Lengths that are summed together; see ``spans``.
BLOCK = 64


def spans(text: str, pattern: str) -> str:
    """SQL for array<struct<start, stop, found>>: the leftmost non-overlapping matches of ``pattern`` (Java, never
    empty) in the column ``text``.

    The text between the matches and the matches themselves give the places. Running sums of their lengths are taken
    in two levels, blocks of BLOCK and within a block, so a text of n matches costs far less than n * n steps.
    """
    p = pattern.replace("\\", "\\\\").replace("'", "\\'")
    return f"""
    transform(array(named_struct('found', regexp_extract_all({text}, '{p}', 0), 'gaps', transform(split({text}, '{p}', -1), g -> char_length(g)))), m ->
      transform(array(named_struct('m', m, 'sizes', zip_with(m.found, slice(m.gaps, 1, size(m.found)), (f, g) -> char_length(f) + g))), x ->
        transform(array(named_struct('m', x.m, 'sizes', x.sizes, 'sums',
            transform(sequence(0, size(x.sizes) div {BLOCK}), b -> aggregate(slice(x.sizes, b * {BLOCK} + 1, {BLOCK}), 0, (a, s) -> a + s)))), y ->
          transform(array(named_struct('m', y.m, 'sizes', y.sizes, 'before',
              transform(sequence(0, size(y.sums) - 1), b -> aggregate(slice(y.sums, 1, b), 0, (a, s) -> a + s)))), z ->
            transform(z.m.found, (f, i) -> named_struct(
              'stop', z.before[i div {BLOCK}] + aggregate(slice(z.sizes, i div {BLOCK} * {BLOCK} + 1, i % {BLOCK} + 1), 0, (a, s) -> a + s), 'found', f))
          )[0])[0])[0])[0]"""


def found(text: str, pattern: str, needs: str | None = None) -> Column:
    """``spans`` as a column of (start, stop, found); ``needs`` is SQL for a cheap test that a text with a match passes."""
    none = "cast(array() AS array<struct<start:int,stop:int,found:string>>)"
    some = f"transform({spans(text, pattern)}, s -> named_struct('start', s.stop - char_length(s.found), 'stop', s.stop, 'found', s.found))"
    return F.expr(f"CASE WHEN {needs} THEN {some} ELSE {none} END" if needs else some)
