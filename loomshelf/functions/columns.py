"""Small column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def steps_below(value: str | Column, steps: Sequence[tuple[float, str]], default: str, inclusive: bool = True) -> Column:
    """Label of the first upper bound the value does not pass; ``default`` beyond the last (and for NULL)."""
    v = col(value)
    out = F
    for bound, label in steps:
        out = out.when(v <= bound if inclusive else v < bound, F.lit(label))
    return out.otherwise(F.lit(default))


def steps_above(value: str | Column, steps: Sequence[tuple[float, str]], default: str) -> Column:
    """Label of the first lower bound the value reaches."""
    v = col(value)
    out = F
    for bound, label in steps:
        out = out.when(v >= bound, F.lit(label))
    return out.otherwise(F.lit(default))


def ratio(num: str | Column, den: str | Column, when_zero: float | None = None) -> Column:
    """Division that yields ``when_zero`` (NULL by default) where the denominator is 0."""
    n, d = col(num), col(den)
    return F.when(d != 0, n / d).otherwise(F.lit(when_zero).cast("double"))


def count_if(cond: Column) -> Column:
    return F.count_if(cond)


def share_if(cond: Column) -> Column:
    """Share of rows for which the condition holds; NULL conditions count as false."""
    return F.avg(F.when(cond, 1).otherwise(0))


def exact_std(n: Column, sx: Column, sxx: Column) -> Column:
    """Sample standard deviation from n, sum and sum of squares.

    For ratings and counts the sums are exact, so the result does not depend on how rows were
    partitioned; NULL below two rows.
    """
    n = n.cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0)) / (n * (n - 1))))


def unnest(array: str | Column, name: str) -> Column:
    """One row per element, NULL for an empty array; follow it by a NULL filter where arrays may be empty.

    A plain ``explode`` makes the optimizer push ``size(array) > 0`` below the projections, which
    evaluates a costly array (tokens, labels) a second time.
    """
    return F.explode_outer(array).alias(name)


def bound(value: Column, out: Callable[[Column], Column]) -> Column:
    """An expression of a value that is worked out once, however often the expression names it.

    The value is the beginning of a sum of nothing and the expression its end, so no list is written or read for it.
    """
    return F.aggregate(F.array(), value, lambda total, _: total, out)


def any_of(patterns: Iterable[str], flags: str = "(?iu)") -> str:
    """One alternation out of several patterns, so the text is scanned once."""
    return flags + "(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
