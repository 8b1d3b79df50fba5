"""Text building blocks shared by the extraction operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letters outside ASCII that patterns without case take for one of s, i, k.
ODD_LETTERS = "ſıİK"


def text(column: Column | str) -> Column:
    """A text field for matching; a missing field reads as empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def literal(value: str) -> str:
    """``value`` as an SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def any_of(sql: str, words: Sequence[str]) -> str:
    """SQL condition: the text ``sql`` holds at least one of ``words``."""
    return "(" + " OR ".join(f"contains({sql}, {literal(w)})" for w in shortest(words)) + ")"


def contains_any(sql: str, words: Sequence[str]) -> Column:
    """True where the SQL text holds at least one of the literal ``words``."""
    return F.expr(any_of(sql, words))


def shortest(words: Sequence[str]) -> list[str]:
    """Drop words another listed word is a part of; they add no match."""
    return [w for w in words if not any(o != w and o in w for o in words)]


def lowered(column: str) -> str:
    """SQL text of ``column`` in lower case, empty if missing."""
    return f"lower(coalesce({column}, ''))"


def blank_to_null(column: Column | str) -> Column:
    """Text of white space only becomes null; other text stays as it is."""
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column.rlike(r"(?U)^\s*$"), None).otherwise(column)


def may_match(source: str, folded: str, words: Sequence[str]) -> str:
    """SQL: necessary test for patterns without case that hold one of ``words``.

    ``folded`` holds ``source`` in lower case. Looking for plain words is
    several times faster than the pattern, and sends most mail away. Texts
    with one of the few odd letters that also match go to the pattern.
    """
    return f"({any_of(folded, words)} OR {any_of(source, ODD_LETTERS)})"


def first_by_pattern(
    df: DataFrame,
    name: str,
    source: str,
    patterns: Sequence[str],
    groups: int = 1,
    accept: Callable[[list[str]], str] | None = None,
    possible: Sequence[str] = (),
) -> DataFrame:
    """Add ``name``: the groups of the first pattern that matches ``source``.

    A struct ``g1 .. gN``, null if no pattern matches. ``accept`` may turn the
    SQL of the groups into a test a match has to pass, or the next pattern is
    tried. ``possible`` may give a cheap necessary test per pattern.

    Every pattern is one projection of its own that adds a helper column
    ``{name}_0`` and so on. Later patterns run only on rows the earlier ones
    left open, and because the optimizer does not inline a costly column used
    more than once, each pattern scans the text once.
    """
    tried, arms = [], []
    for i, pattern in enumerate(patterns):
        hit, quoted = f"{name}_{i}", literal(pattern)
        # The whole match first; its groups are then read from this short text.
        match = f"regexp_extract({source}, {quoted}, 0)"
        tests = [f"NOT ({good})" for good in tried] + list(possible[i : i + 1])
        if tests:
            match = f"CASE WHEN {' AND '.join(tests)} THEN {match} END"
        df = df.withColumn(hit, F.expr(match))
        found = [f"regexp_extract({hit}, {quoted}, {g})" for g in range(1, groups + 1)]
        good = f"coalesce({hit} <> '', false)"
        if accept is not None:
            good = f"{good} AND {accept(found)}"
        tried.append(good)
        fields = ", ".join(f"'g{g}', {value}" for g, value in enumerate(found, 1))
        arms.append(f"WHEN {good} THEN named_struct({fields})")
    return df.withColumn(name, F.expr(f"CASE {' '.join(arms)} END"))


def evaluated(df: DataFrame, keep: Sequence[str], untouched: Sequence[str] = ()) -> DataFrame:
    """Fix the columns of ``keep`` as computed values.

    A filter on a computed column is normally pushed under the projection,
    which then runs its patterns a second time. Passing the columns through
    ``inline`` of a one-element array stops that: filters stay above and each
    pattern runs once per row. Columns that are ``untouched`` input go beside the
    fence: filters on them reach the scan, and unused ones are not read.
    """
    beside = [c for c in keep if c in untouched]
    computed = [c for c in keep if c not in untouched]
    return df.select(*beside, F.inline(F.array(F.struct(*computed)))).select(*keep)
