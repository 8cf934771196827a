"""Statistical expressions that Spark lacks or raises errors for."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vesselflow.functions.cleaning import ColumnLike, _c

# Abramowitz and Stegun, formula 7.1.26.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def correlation(x: ColumnLike, y: ColumnLike) -> Column:
    """Pearson correlation (aggregate); NULL if a side does not vary.

    The built-in one raises a division error in ANSI mode for such a group. Whether a side
    varies is told by its least and largest value: the deviation of equal values may come
    out a little above zero, depending on the order in which partial sums meet.
    """
    left = F.when(_c(y).isNotNull(), _c(x))
    right = F.when(_c(x).isNotNull(), _c(y))
    spread = F.stddev_pop(left) * F.stddev_pop(right)
    varies = (F.max(left) > F.min(left)) & (F.max(right) > F.min(right))
    return F.try_divide(F.covar_pop(left, right), F.when(varies & (spread > 0), spread))


def erf(column: ColumnLike) -> Column:
    """Error function for arguments >= 0, largest error 1.5e-7."""
    x = _c(column)
    t = 1.0 / (x * ERF_P + 1.0)
    series = F.lit(0.0)
    for factor in reversed(ERF_A):
        series = (series + factor) * t
    return 1.0 - series * F.exp(-x * x)


def plain_difference(a: ColumnLike, b: ColumnLike) -> Column:
    """Difference of two courses without regard to the turn (359 to 1 is 358)."""
    return F.abs(_c(a) - _c(b))


def circular_difference(a: ColumnLike, b: ColumnLike) -> Column:
    """Smaller angle between two courses, 0 to 180 (359 to 1 is 2)."""
    shifted = _c(a) - _c(b) + 180.0
    return F.abs(shifted - F.floor(shifted / 360.0) * 360.0 - 180.0)


def minutes_between(later: ColumnLike, earlier: ColumnLike) -> Column:
    """Whole elapsed minutes."""
    return F.timestamp_diff("MINUTE", _c(earlier), _c(later))


def percentile(column: ColumnLike, share: float, accuracy: int = 10_000) -> Column:
    """Approximate percentile (aggregate) by a mergeable summary of bounded size."""
    return F.percentile_approx(_c(column), F.lit(float(share)), F.lit(accuracy))
