"""Spreadsheet dates: serial days, overflowing parts, month arithmetic, working days and quota windows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_ZERO = "1899-12-30"


def serial(d: Column) -> Column:
    return F.datediff(d, F.lit(DAY_ZERO).cast("date"))


def from_serial(n: Column) -> Column:
    return F.date_add(F.lit(DAY_ZERO).cast("date"), n.cast("int"))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """Parts that overflow carry over."""
    first = F.make_date(year, F.lit(1), F.lit(1))
    return F.date_add(F.add_months(first, (month - 1).cast("int")), (day - 1).cast("int"))


def weekday(d: Column, mode: int = 1) -> Column:
    """1: Sunday is 1. 2: Monday is 1. 3: Monday is 0."""
    return F.dayofweek(d) if mode == 1 else F.weekday(d) + (1 if mode == 2 else 0)


def weeknum(d: Column) -> Column:
    """Weeks that begin on Sunday; January 1 is in week 1."""
    first = F.trunc(d, "year")
    return F.floor((F.datediff(d, first) + F.dayofweek(first) - 1) / 7).cast("int") + 1


def edate(d: Column, months: int) -> Column:
    return F.add_months(d, months)


def eomonth(d: Column, months: int) -> Column:
    return F.last_day(F.add_months(d, months))


def networkdays(start: Column, end: Column) -> Column:
    """Monday to Friday, both ends included, without a sequence of days: whole weeks count five."""
    monday = F.date_sub(start, F.weekday(start))
    upto = lambda d: F.floor(F.datediff(d, monday) / 7) * 5 + F.least(F.weekday(d) + 1, F.lit(5))
    return (upto(end) - upto(F.date_sub(start, 1))).cast("int")


def networkdays_intl(start: Column, end: Column, off: str = "0000011") -> Column:
    """Days that are not off, both ends included, negative if end is before start. off has a 1 for each day off, from
    Monday. Whole weeks count alike; only the days of the last one are looked at."""
    each = off.count("0")
    low, high = F.least(start, end), F.greatest(start, end)
    days = F.datediff(high, low) + 1
    rest = F.sequence(F.lit(0), F.lit(6))
    left = F.aggregate(rest, F.lit(0), lambda a, i: a + F.when((i < days % 7) & ~_off(F.date_add(low, i), off), 1).otherwise(0))
    count = F.floor(days / 7).cast("int") * each + left
    return F.when(start <= end, count).otherwise(-count)


def _off(d: Column, off: str) -> Column:
    return F.array(*[F.lit(c == "1") for c in off])[F.weekday(d)]


def workday_intl(start: Column, days: int, off: str = "0000011") -> Column:
    """The date `days` days that are not off after start, or before it if days is negative; null if all are off."""
    each, sign, n = off.count("0"), 1 if days > 0 else -1, abs(days)
    if not each:
        return F.lit(None).cast("date")
    if not n:
        return start
    weeks = (n - 1) // each
    base = F.date_add(start, sign * 7 * weeks)
    ahead = F.filter(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.date_add(base, sign * i)), lambda d: ~_off(d, off))
    return F.get(ahead, F.lit(n - weeks * each - 1))


def workday(start: Column, days: int) -> Column:
    """The date `days` working days, Monday to Friday, after or before start."""
    return workday_intl(start, days)


def datedif(start: Column, end: Column, unit: str) -> Column:
    months = F.floor(F.months_between(end, start)).cast("int")
    return {"d": F.datediff(end, start), "m": months, "y": F.floor(months / 12).cast("int")}[unit]


def yearfrac_actual(start: Column, end: Column) -> Column:
    """Basis 1 over whole years: days over the mean length of the years touched."""
    years = F.year(end) - F.year(start) + 1
    days = F.datediff(F.make_date(F.year(end) + 1, F.lit(1), F.lit(1)), F.make_date(F.year(start), F.lit(1), F.lit(1)))
    return F.datediff(end, start) / (days / years)


def day_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd")


def month_key(ts: Column) -> Column:
    return F.concat(F.lit("m"), F.date_format(ts, "yyyy-MM"))


def month_end(ts: Column) -> Column:
    return F.add_months(F.trunc(ts, "month"), 1)


def add_months_at(anchor: Column, months: Column) -> Column:
    """The anchor moved by months, with its time of day, on the last day of a month that is too short for it."""
    day = F.to_date(anchor)
    seconds = F.unix_micros(anchor) - F.unix_micros(day.cast("timestamp"))
    return F.timestamp_micros(F.unix_micros(F.add_months(day, months).cast("timestamp")) + seconds)


def billing_end(anchor: Column, now: Column, drift: int = 36) -> Column:
    """The first renewal after now: the anchor moved by whole months, always from the anchor itself; null if the anchor is
    more than `drift` months away."""
    months = ((F.year(now) - F.year(anchor)) * 12 + F.month(now) - F.month(anchor)).cast("int")
    here = add_months_at(anchor, months)
    return F.when(F.abs(months) <= drift, F.when(here > now, F.when(add_months_at(anchor, months - 1) > now, add_months_at(anchor, months - 1)).otherwise(here)).otherwise(add_months_at(anchor, months + 1)))
