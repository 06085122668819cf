"""Annuities and depreciation as Column builders; iterative rates as vectorised functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _growth(rate: Column, n: Column) -> Column:
    return F.pow(1 + rate, n)


def pmt(rate: Column, n: Column, pv: Column, fv: Column | None = None) -> Column:
    fv = F.lit(0.0) if fv is None else fv
    g = _growth(rate, n)
    return F.when(rate == 0, -(pv + fv) / n).otherwise(-rate * (pv * g + fv) / F.nullif(g - 1, F.lit(0.0)))


def fv(rate: Column, n: Column, payment: Column, pv: Column | None = None) -> Column:
    pv = F.lit(0.0) if pv is None else pv
    g = _growth(rate, n)
    return F.when(rate == 0, -(pv + payment * n)).otherwise(-(pv * g + payment * (g - 1) / F.nullif(rate, F.lit(0.0))))


def pv(rate: Column, n: Column, payment: Column) -> Column:
    return F.when(rate == 0, -payment * n).otherwise(-payment * (1 - _growth(rate, -n)) / F.nullif(rate, F.lit(0.0)))


def nper(rate: Column, payment: Column, pv: Column) -> Column:
    return F.ln(payment / (payment + pv * rate)) / F.ln(1 + rate)


def npv(rate: Column, flows: list[Column]) -> Column:
    out = F.lit(0.0)
    for i, x in enumerate(flows, 1):
        out = out + x / _growth(rate, F.lit(i))
    return out


def ipmt(rate: Column, period: Column, n: Column, pv: Column) -> Column:
    """Interest part of a payment at the end of a period."""
    before = fv(rate, period - 1, pmt(rate, n, pv), pv)
    return before * rate


def ppmt(rate: Column, period: Column, n: Column, pv: Column) -> Column:
    return pmt(rate, n, pv) - ipmt(rate, period, n, pv)


def sln(cost: Column, salvage: Column, life: Column) -> Column:
    return (cost - salvage) / life


def syd(cost: Column, salvage: Column, life: Column, period: Column) -> Column:
    return (cost - salvage) * (life - period + 1) * 2 / (life * (life + 1))


def ddb(cost: Column, salvage: Column, life: Column, period: Column, factor: float = 2.0) -> Column:
    """Double declining balance; the book value does not fall below the salvage."""
    book = cost * F.pow(F.greatest(1 - F.lit(factor) / life, F.lit(0.0)), period - 1)
    return F.greatest(F.least(book * F.lit(factor) / life, book - salvage), F.lit(0.0))


def db(cost: Column, salvage: Column, life: Column, period: Column, months: int = 12) -> Column:
    """Fixed declining balance of any year: the rate has three digits, and the first year `months` months."""
    rate = F.round(1 - F.pow(salvage / cost, 1 / life), 3)
    first = cost * rate * (months / 12)
    book = (cost - first) * F.pow(1 - rate, period - 2)
    return F.when(period == 1, first).when(period <= life, book * rate).when(period == life + 1, book * rate * ((12 - months) / 12))


def _over(start: Column, end: Column, part) -> Column:
    """The sum of a part over the periods from start to end."""
    return F.aggregate(F.sequence(start.cast("int"), end.cast("int")), F.lit(0.0), lambda a, k: a + part(k))


def cumipmt(rate: Column, n: Column, pv: Column, start: Column, end: Column) -> Column:
    return _over(start, end, lambda k: ipmt(rate, k, n, pv))


def cumprinc(rate: Column, n: Column, pv: Column, start: Column, end: Column) -> Column:
    return _over(start, end, lambda k: ppmt(rate, k, n, pv))


def fvschedule(principal: Column, rates: Column) -> Column:
    return F.aggregate(rates, principal.cast("double"), lambda a, r: a * (1 + r))


def mirr(flows: Column, finance_rate: Column, reinvest_rate: Column) -> Column:
    """The rate at which the outflows, financed, grow to the inflows, reinvested; null without both."""
    n = F.size(flows)
    worth = F.aggregate(F.transform(flows, lambda x, i: F.greatest(x, F.lit(0.0)) * _growth(reinvest_rate, n - 1 - i)), F.lit(0.0), lambda a, x: a + x)
    spent = F.aggregate(F.transform(flows, lambda x, i: F.greatest(-x, F.lit(0.0)) / _growth(finance_rate, i)), F.lit(0.0), lambda a, x: a + x)
    return F.when((worth > 0) & (spent > 0), F.pow(worth / spent, F.lit(1.0) / (n - 1)) - 1)


def effect(nominal: Column, n: Column) -> Column:
    return _growth(nominal / n, n) - 1


def nominal(effective: Column, n: Column) -> Column:
    return n * (F.pow(1 + effective, 1 / n) - 1)


def rri(n: Column, pv: Column, fv: Column) -> Column:
    return F.pow(fv / pv, 1 / n) - 1


def ispmt(rate: Column, period: Column, n: Column, pv: Column) -> Column:
    return pv * rate * (period / n - 1)


def _solve(f, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bisection of many functions at once; NaN where the ends have the same sign."""
    a, b = f(low), f(high)
    ok = np.sign(a) * np.sign(b) <= 0
    for _ in range(80):
        mid = (low + high) / 2
        m = f(mid)
        left = np.sign(m) == np.sign(a)
        low, high = np.where(left, mid, low), np.where(left, high, mid)
    return np.where(ok, (low + high) / 2, np.nan)


def _irr(flows: pd.Series) -> pd.Series:
    """All rows with the same number of flows are solved at once."""
    out = np.full(len(flows), np.nan)
    sizes = flows.map(lambda x: 0 if x is None else len(x)).to_numpy()
    for n in np.unique(sizes[sizes > 1]):
        rows = np.flatnonzero(sizes == n)
        x = np.stack([np.asarray(flows.iloc[i], float) for i in rows])

        def value(r: np.ndarray, x: np.ndarray = x) -> np.ndarray:
            total, g = np.zeros(len(r)), 1 / (1 + r)
            for k in range(x.shape[1] - 1, -1, -1):
                total = total * g + x[:, k]
            return total

        out[rows] = _solve(value, np.full(len(rows), -0.99), np.full(len(rows), 10.0))
    return pd.Series(out)


def _rate(n: pd.Series, payment: pd.Series, pv: pd.Series) -> pd.Series:
    n, p, v = (np.asarray(x, float) for x in (n, payment, pv))

    def value(r: np.ndarray) -> np.ndarray:
        flat = np.abs(r) < 1e-12
        safe = np.where(flat, 1.0, r)
        g = (1 + safe) ** n
        return np.where(flat, v + p * n, v * g + p * (g - 1) / safe)

    # zero is a root of the scaled equation for no real annuity, so search either side of it
    up = _solve(value, np.full(len(n), 1e-9), np.full(len(n), 1.0))
    down = _solve(value, np.full(len(n), -0.5), np.full(len(n), -1e-9))
    return pd.Series(np.where(np.isnan(up), down, up))


def irr(flows: Column) -> Column:
    """The rate at which flows, the first one now, are worth nothing; null if none is found."""
    return F.pandas_udf(_irr, "double")(flows)


def rate(n: Column, payment: Column, pv: Column) -> Column:
    """The rate of an annuity, by bisection over all rows at once."""
    return F.pandas_udf(_rate, "double")(n, payment, pv)
