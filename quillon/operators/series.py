"""Series of measurements: prediction bounds, steps, sign-test intervals, rate-distortion differences."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: Student's t, one-sided 99 %, by degrees of freedom from 1
T99 = [31.820515953773958, 6.964556734283274, 4.540702858698419, 3.7469473879791968, 3.364929998907218, 3.1426684032909824, 2.997951566868528, 2.896459447709622, 2.8214379233005493]
MIN_POINTS, MAX_POINTS = 5, 10
STEP_FACTOR, MIN_SPREAD, FLOOR_SHARE = 1.6, 0.05, 0.65


def lower_bound(df: DataFrame, by: list[str], at: str, ratio: str) -> DataFrame:
    """df with points, centre and lower: what the latest ten earlier ratios predict a new one to exceed."""
    before = Window.partitionBy(*by).orderBy(at).rowsBetween(-MAX_POINTS, -1)
    n, log = F.count(ratio).over(before), F.ln(ratio)
    quantile = F.element_at(F.array(*[F.lit(t) for t in T99]), F.greatest(n.cast("int") - 1, F.lit(1)))
    spread, centre = F.stddev_samp(log).over(before), F.avg(log).over(before)
    lower = F.exp(centre - quantile * spread * F.sqrt(1 + 1 / n))
    return df.withColumns({"points": n, "centre": F.exp(centre), "lower": F.when(n >= MIN_POINTS, lower)})


def history_floor(df: DataFrame, by: list[str], at: str, ratio: str) -> DataFrame:
    """df with floor: a share of the median of the ten ratios before."""
    before = Window.partitionBy(*by).orderBy(at).rowsBetween(-MAX_POINTS, -1)
    return df.withColumn("floor", F.lit(FLOOR_SHARE) * F.expr(f"percentile({ratio}, 0.5)").over(before))


def since_last_step(df: DataFrame, by: str, at: str, ratio: str) -> DataFrame:
    """(by, at, ratio): per series, the points since the last step up, at most ten. A series is walked in order, so it is
    one group of a grouped function; a series is as long as its own history."""
    kind, kat, kr = (df.schema[c].dataType.simpleString() for c in (by, at, ratio))

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        window: list[int] = []
        pdf = pdf.sort_values(at, kind="stable").reset_index(drop=True)
        logs = np.log(pdf[ratio].to_numpy(float))
        for i in range(len(pdf)):
            past = logs[window]
            step = False
            if len(past):
                step = logs[i] > past.mean() + math.log(STEP_FACTOR)
                if not step and len(past) >= MIN_POINTS:
                    spread = max(past.std(ddof=1), MIN_SPREAD)
                    step = logs[i] > past.mean() + T99[len(past) - 2] * spread * math.sqrt(1 + 1 / len(past))
            window = [i] if step else [*window, i][-MAX_POINTS:]
        return pdf.loc[window, [by, at, ratio]]

    return df.select(by, at, ratio).groupBy(by).applyInPandas(walk, f"{by} {kind}, {at} {kat}, {ratio} {kr}")


def sign_test_rank(n: int, confidence: float) -> int:
    """The widest order-statistic index whose interval of the median has the confidence; 0 if none."""
    rank, total = 0, 0
    for k in range(1, (n + 1) // 2 + 1):
        total += math.comb(n, k - 1)
        if 2 * total / 2**n <= 1 - confidence:
            rank = k
        else:
            break
    return rank


def sign_test(df: DataFrame, by: list[str], ratio: Column, pass_line: float, confidence: float = 0.95, most: int = 64, least: int = 6) -> DataFrame:
    """(by, pairs, median, lower, upper, verdict) of paired ratios; the pairs of a group are at most `most`."""
    ranks = F.array(*[F.lit(sign_test_rank(n, confidence) if n >= least else 0) for n in range(1, most + 1)])
    g = df.groupBy(*by).agg(F.sort_array(F.collect_list(ratio)).alias("x"), F.median(ratio).alias("median"))
    g = g.withColumns({"pairs": F.size("x"), "_k": F.element_at(ranks, F.size("x"))})
    lower = F.when(F.col("_k") > 0, F.get("x", F.col("_k") - 1))
    upper = F.when(F.col("_k") > 0, F.get("x", F.size("x") - F.col("_k")))
    verdict = F.when(F.col("_k") == 0, "unstable").when(lower >= pass_line, "pass").when(upper < pass_line, "fail").otherwise("unstable")
    return g.select(*by, "pairs", "median", lower.alias("lower"), upper.alias("upper"), verdict.alias("verdict"))


def _cubic_integral(x: np.ndarray, y: np.ndarray, low: float, high: float) -> float:
    p = np.polynomial.Polynomial.fit(x, y, 3).integ()
    return float(p(high) - p(low))


def bd_rate(anchor: list[tuple[float, float]], test: list[tuple[float, float]]) -> float:
    """Mean difference in rate at equal quality, in per cent; points are (rate, quality)."""
    a, t = np.array(anchor, float), np.array(test, float)
    low, high = max(a[:, 1].min(), t[:, 1].min()), min(a[:, 1].max(), t[:, 1].max())
    gap = _cubic_integral(t[:, 1], np.log(t[:, 0]), low, high) - _cubic_integral(a[:, 1], np.log(a[:, 0]), low, high)
    return (math.exp(gap / (high - low)) - 1) * 100


def bd_psnr(anchor: list[tuple[float, float]], test: list[tuple[float, float]]) -> float:
    a, t = np.array(anchor, float), np.array(test, float)
    a[:, 0], t[:, 0] = np.log(a[:, 0]), np.log(t[:, 0])
    low, high = max(a[:, 0].min(), t[:, 0].min()), min(a[:, 0].max(), t[:, 0].max())
    return (_cubic_integral(t[:, 0], t[:, 1], low, high) - _cubic_integral(a[:, 0], a[:, 1], low, high)) / (high - low)
