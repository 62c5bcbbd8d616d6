"""Small numeric expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def d(c: Column | str) -> Column:
    return as_col(c).cast("double")


def r6(c: Column | str) -> Column:
    """Six decimals and never a negative zero."""
    return F.round(d(c), 6) + F.lit(0.0)


def ratio(num: Column | str, den: Column | str, otherwise: float | None = 0.0) -> Column:
    """num/den as double, ``otherwise`` where the denominator is zero."""
    n, m = d(num), d(den)
    return F.when(m != 0, n / m).otherwise(F.lit(otherwise).cast("double"))


def sign(c: Column | str) -> Column:
    return F.signum(d(c)).cast("int")


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def steady(c: Column | str) -> Column:
    """Fitted parameters, rounded so that the order of summation cannot show."""
    x = d(c)
    return F.when(F.abs(x) >= 1000, F.round(x, 2)).otherwise(F.round(x, 6)) + F.lit(0.0)
