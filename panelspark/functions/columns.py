"""Column expressions with the panel semantics: nulls stay null, zero denominators give null, ranks are averaged."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """C within [low, high]; null stays null."""
    out = c if low is None else F.greatest(c, F.lit(low))
    out = out if high is None else F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)


def safe_div(a: Column, b: Column) -> Column:
    """A / |b|, null where b is zero."""
    return F.when(b != 0, a / F.abs(b))


def nearest(c: Column, d: int) -> Column:
    """c rounded to d decimals, halves away from zero, -0.0 as 0.0: in doubles, where F.round makes a decimal of each value."""
    y = c * 10.0**d
    near = F.rint(y)
    return F.when(F.abs(y - near) == 0.5, F.signum(y) * (F.abs(y) + 0.5)).otherwise(near) / 10.0**d + 0.0


def correlation(x: Column, y: Column, over=None) -> Column:
    """Pearson correlation of the rows that have both; null without deviation, which the least and greatest value tell: the deviation
    of equal values is not exactly 0 once partial sums of several tasks are merged."""
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    put = (lambda c: c.over(over)) if over is not None else (lambda c: c)
    moves = (put(F.min(x)) < put(F.max(x))) & (put(F.min(y)) < put(F.max(y)))
    return F.when(moves, F.try_divide(put(F.covar_pop(x, y)), put(F.stddev_pop(x)) * put(F.stddev_pop(y))))


def average_rank(c: str, *by: str) -> Column:
    """Rank of c within `by` from 1, equal values sharing the mean of their ranks; null for null."""
    at = Window.partitionBy(*by, F.col(c).isNull())
    ties = Window.partitionBy(*by, c)
    return F.when(F.col(c).isNotNull(), F.rank().over(at.orderBy(c)) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def row_mean(*names: str) -> Column:
    """Mean of the columns that are not null; null if all are."""
    total = sum((F.coalesce(F.col(n), F.lit(0.0)) for n in names), F.lit(0.0))
    known = sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0))
    return F.when(known > 0, total / known)


def keyword_sentiment(text: Column, bull: list[str], bear: list[str]) -> Column:
    """(bull - bear) / (bull + bear) over non-overlapping occurrences of the words in the lower-cased text; 0 without any."""
    low = F.lower(text)

    def hits(words: list[str]) -> Column:
        return sum(((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w) for w in words), F.lit(0.0))

    up, down = hits(bull), hits(bear)
    return F.coalesce(F.when(up + down > 0, (up - down) / (up + down)), F.lit(0.0))
