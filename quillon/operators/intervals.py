"""Intervals with inclusive ends: merging, coverage, page selections, segments by gap; overlaps of open ones."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NONE = np.iinfo(np.int64).min


def merge(df: DataFrame, by: list[str], first: str, last: str, touch: float = 1) -> DataFrame:
    """(by, first, last, parts): intervals that overlap or touch are one; those without a begin come last, and belong to the
    last one. Both windows have one order and so one sort, in which equal intervals keep their places."""
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_last(first), F.asc_nulls_last(last))
    before = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(before.isNull() | (F.col(first) > before + touch), 1).otherwise(0)
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    islands = df.withColumn("_new", opens).withColumn("_island", island)
    grouped = islands.groupBy(*by, "_island").agg(F.min(first).alias(first), F.max(last).alias(last), F.count("*").alias("parts"))
    return grouped.drop("_island")


def covers(merged: DataFrame, by: list[str], first: str, last: str, size: Column) -> DataFrame:
    """(by, covered): whether one interval spans the whole object of the given size."""
    return merged.groupBy(*by).agg(((F.count("*") == 1) & (F.min(first) == 0) & (F.max(last) >= F.max(size) - 1)).alias("covered"))


def page_selection(spec: Column, pages: Column) -> Column:
    """Distinct pages, ascending, that `N`, `N-M`, `N-` and `-M` parts name, within 1 to pages."""
    parts = F.filter(F.split(F.regexp_replace(spec, r"\s", ""), ","), lambda p: p.rlike(r"^\d+$|^\d+-\d*$|^-\d+$"))
    low = lambda p: F.when(p.startswith("-"), F.lit(1)).otherwise(F.substring_index(p, "-", 1).cast("int"))
    high = lambda p: F.when(p.endswith("-"), pages).otherwise(F.substring_index(p, "-", -1).cast("int"))
    span = lambda p: F.when(F.greatest(low(p), F.lit(1)) <= F.least(high(p), pages), F.sequence(F.greatest(low(p), F.lit(1)), F.least(high(p), pages))).otherwise(F.array().cast("array<int>"))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))


def segments(df: DataFrame, by: list[str], at: str, gap: float) -> DataFrame:
    """(by, segment, start, end, n): a new segment begins where a position lies more than gap past the one before."""
    order = Window.partitionBy(*by).orderBy(at)
    opens = F.when(F.col(at) - F.lag(at).over(order) > gap, 1).otherwise(0)
    cut = df.withColumn("_new", opens).withColumn("segment", F.sum("_new").over(order.rangeBetween(Window.unboundedPreceding, 0)))
    return cut.groupBy(*by, "segment").agg(F.min(at).alias("start"), F.max(at).alias("end"), F.count("*").alias("n"))


def _first_below(values: np.ndarray, depth: np.ndarray, least: np.ndarray, side: str) -> np.ndarray:
    """How many of the first `depth` values are below `least`, or at it with the side "right": a wavelet matrix, a pass over
    the values for each bit of their ranks."""
    names, code = np.unique(values, return_inverse=True)
    most, inside = np.searchsorted(names, least, side), np.zeros(len(depth), np.int64)
    begin, end = np.zeros(len(depth), np.int64), depth  # where the first ones of equal upper bits are now
    for bit in reversed(range(len(names).bit_length())):
        zero, one = code >> bit & 1 == 0, most >> bit & 1 == 1
        upto = np.concatenate([[0], np.cumsum(zero)])
        low, high = upto[begin], upto[end]
        inside += np.where(one, high - low, 0)
        begin, end = np.where(one, upto[-1] + begin - low, low), np.where(one, upto[-1] + end - high, high)
        code = np.concatenate([code[zero], code[~zero]])
    return inside


def _range_max(values: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The largest of values[low:high], NONE if that is empty."""
    out, level = np.full(len(low), NONE), np.frexp(np.maximum(high - low, 0))[1] - 1
    for k in range(level.max(initial=-1) + 1):
        at = level == k
        out[at] = np.maximum(values[low[at]], values[high[at] - 2**k])
        values = np.maximum(values[: -(2**k)], values[2**k :])
    return out


def _raised(size: int, low: np.ndarray, high: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each place the largest value whose range low to high holds it, NONE without one."""
    level = np.frexp(np.maximum(high - low, 0))[1] - 1
    top = level.max(initial=0)
    out = np.full(size - 2**top + 1, NONE)
    for k in range(top, -1, -1):
        at = level == k
        np.maximum.at(out, low[at], values[at])
        np.maximum.at(out, high[at] - 2**k, values[at])
        if k:
            half, wide = 2 ** (k - 1), np.full(size - 2 ** (k - 1) + 1, NONE)
            wide[: len(out)] = out
            wide[half : half + len(out)] = np.maximum(wide[half : half + len(out)], out)
            out = wide
    return out


def _later(ids: np.ndarray, x0: np.ndarray, x1: np.ndarray, of: np.ndarray, among: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the intervals `of`, how many of `among` with larger ids overlap them, and the largest such id. None may be empty."""
    down = among[np.argsort(-ids[among], kind="stable")]
    depth = len(down) - np.searchsorted(ids[down[::-1]], ids[of], "right")
    n = _first_below(x0[down], depth, x1[of], "left") - _first_below(x1[down], depth, x0[of], "right")
    rising = among[np.argsort(x0[among], kind="stable")]
    begin = _range_max(ids[rising], *(np.searchsorted(x0[rising], x[of], "left") for x in (x0, x1)))  # those that begin inside
    points, place = np.unique(x0[of], return_inverse=True)
    hold = _raised(len(points), *(np.searchsorted(points, x[among], "left") for x in (x0, x1)), ids[among])  # that hold the begin
    return n, np.maximum(begin, hold[place])


def overlaps(df: DataFrame, key: str, first: str, last: str, width: float) -> DataFrame:
    """(key, overlaps, last): how many intervals with larger keys share more than their ends with an interval, and the
    largest such key; none, no row. Cells of the given width are counted by themselves, and a pair counts in the cell where
    it begins. No pair is made: a cell of n intervals costs n log n, and is held by one task. Empty and reversed intervals
    are compared one by one. Without finite ends there is no interval."""

    def count(cell: pd.DataFrame) -> pd.DataFrame:
        ids, x0, x1 = cell["id"].to_numpy(np.int64), cell["x0"].to_numpy(float), cell["x1"].to_numpy(float)
        own, proper = cell["own"].to_numpy(bool), x0 < x1
        n, top = np.zeros(len(ids), np.int64), np.full(len(ids), NONE)
        # what begins here meets all, what began before only meets what begins here
        for of, among in ((own & proper, proper), (~own & proper, own & proper)):
            if of.any() and among.any():
                n[of], top[of] = _later(ids, x0, x1, np.flatnonzero(of), np.flatnonzero(among))
        for i in np.flatnonzero(~proper):
            hit = np.flatnonzero(proper & (x0 < x1[i]) & (x0[i] < x1))
            less, more = hit[ids[hit] < ids[i]], hit[ids[hit] > ids[i]]
            n[less] += 1
            top[less] = np.maximum(top[less], ids[i])
            n[i], top[i] = len(more), ids[more].max(initial=NONE)
        return pd.DataFrame({"id": ids, "n": n, "top": top})[n > 0]

    cell = lambda c: F.floor(F.col(c) / width)
    kind = df.schema[key].dataType.simpleString()
    spans = df.select(F.col(key).cast("long").alias("id"), F.col(first).cast("double").alias("x0"), F.col(last).cast("double").alias("x1"))
    finite = (F.abs("x0") < float("inf")) & (F.abs("x1") < float("inf"))
    cells = spans.where(F.col("id").isNotNull() & finite).withColumn("cell", F.explode(F.sequence(cell("x0"), F.greatest(cell("x0"), cell("x1")))))
    found = cells.withColumn("own", F.col("cell") == cell("x0")).groupBy("cell").applyInPandas(count, "id long, n long, top long")
    return found.groupBy(F.col("id").cast(kind).alias(key)).agg(F.sum("n").alias("overlaps"), F.max("top").cast(kind).alias("last"))
