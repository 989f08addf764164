"""Statistics that engines define differently, written out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided critical values of the t distribution by degrees of freedom, at 95 % and 99 %.
T_95 = {1: 12.706, 2: 4.303, 3: 3.182, 4: 2.776, 5: 2.571, 6: 2.447, 7: 2.365, 8: 2.306, 9: 2.262, 10: 2.228, 12: 2.179, 15: 2.131, 20: 2.086, 30: 2.042, 60: 2.000}
T_99 = {1: 63.657, 2: 9.925, 3: 5.841, 4: 4.604, 5: 4.032, 6: 3.707, 7: 3.499, 8: 3.355, 9: 3.250, 10: 3.169, 12: 3.055, 15: 2.947, 20: 2.845, 30: 2.750, 60: 2.660}


def t_critical(df: Column, level: float = 0.95) -> Column:
    """The value at the first tabled degrees of freedom that are no fewer; the normal one beyond 60."""
    steps, beyond = (T_99, 2.576) if level >= 0.99 else (T_95, 1.96)
    out = F.lit(beyond)
    for k in sorted(steps, reverse=True):
        out = F.when(df <= k, F.lit(steps[k])).otherwise(out)
    return out


def finite(col: Column) -> Column:
    """A number, or null where it isn't one, is NaN or infinite."""
    x = col.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))), x)


def pearson(x: Column, y: Column) -> Column:
    """An aggregate; null for fewer than two pairs or without variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    n = F.count(a)
    cov = F.sum(a * b) - F.try_divide(F.sum(a) * F.sum(b), n)
    va, vb = F.sum(a * a) - F.try_divide(F.sum(a) * F.sum(a), n), F.sum(b * b) - F.try_divide(F.sum(b) * F.sum(b), n)
    return F.when((n >= 2) & (va > 1e-12) & (vb > 1e-12), F.try_divide(cov, F.sqrt(va * vb)))


def precision_recall_f1(tp: Column, n_pred: Column, n_gold: Column) -> Column:
    p, r = F.coalesce(F.try_divide(tp, n_pred), F.lit(0.0)), F.coalesce(F.try_divide(tp, n_gold), F.lit(0.0))
    return F.struct(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))
