"""Regular expressions as Spark columns.

Spark compiles a pattern once only when it is a literal, so patterns always reach `rlike` as literals.
`\\w`, `\\s`, `\\d` and `\\b` must see every script, hence the `(?U)` flag.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
# White space as Unicode sees it plus the four separator controls; only inside patterns that start with (?U).
SPACE = r"[\s\x1c-\x1f]"


def quick_class(characters: str) -> str:
    """A class of these characters that most others leave after two tests."""
    low = "".join(f"\\x{ord(c):02x}" for c in sorted(set(characters)) if ord(c) < 256)
    high = [f"\\u{ord(c):04x}" for c in sorted(set(characters)) if ord(c) >= 256]
    return f"[{low}[{high[0]}-{high[-1]}&&[{''.join(high)}]]]"


#: The same characters, spelled out.
OTHER_SPACES = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
ANY_SPACE = quick_class(" " + OTHER_SPACES)


def one_of(alternatives: Iterable[str]) -> str:
    """One pattern that matches where any alternative does.

    Alternatives that begin with a word boundary share a single `\\b`, so the engine tests the boundary
    once per position instead of once per alternative.
    """
    bounded, free = [], []
    for alternative in alternatives:
        if alternative.startswith(r"\b"):
            bounded.append(f"(?:{alternative[2:]})")
        else:
            free.append(f"(?:{alternative})")
    parts = free + ([r"\b(?:" + "|".join(bounded) + ")"] if bounded else [])
    return "(?U)" + "|".join(parts)


def count_matches(column: Column, pattern: str) -> Column:
    return F.size(F.regexp_extract_all(column, F.lit(pattern), F.lit(0)))


def bind(value: Column, body) -> Column:
    """`body(value)` with `value` computed once per row, however often `body` mentions it."""
    return F.transform(F.array(value), body)[0]


def noisy_or(weights: Column) -> Column:
    """1 - Π(1 - w) over an array, weights clipped to 0..1: more evidence can only raise the score."""
    clipped = lambda w: F.greatest(F.lit(0.0), F.least(F.lit(1.0), w))
    return F.lit(1.0) - F.aggregate(weights, F.lit(1.0), lambda left, w: left * (F.lit(1.0) - clipped(w)))


def noisy_or_agg(weight: Column) -> Column:
    """The same combination as an aggregate over rows (an absent group or weight counts as no evidence)."""
    clipped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), weight))
    return F.lit(1.0) - F.coalesce(F.product(F.lit(1.0) - clipped), F.lit(1.0))


def combined(*weights: Column) -> Column:
    """Noisy-or of a fixed handful of columns."""
    return noisy_or(F.array(*weights))
