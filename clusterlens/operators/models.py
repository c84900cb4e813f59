"""Simple linear fit with quality and band, correlation, and two-cluster grouping.

Each fit is one aggregate: its state per group is a handful of sums, however many rows there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from clusterlens.operators.segments import join_on

CONFIDENCE = 0.95
# Nodes of the areas under the t density, and where its tail ends, in standard deviations.
NODES, WEIGHTS = np.polynomial.legendre.leggauss(256)
TAIL = 40.0


def linear_fit(df: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    """y = intercept + slope * x per group, with n, r2, mse, correlation and standard error of y."""
    xc, yc = F.col(x), F.col(y)
    both = xc.isNotNull() & yc.isNotNull()
    sums = df.where(both).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(yc, xc).alias("slope"),
        F.regr_intercept(yc, xc).alias("intercept"),
        F.regr_r2(yc, xc).alias("r2"),
        F.corr(xc, yc).alias("corr"),
        F.stddev_samp(yc).alias("stddev_y"),
        F.regr_syy(yc, xc).alias("_syy"),
        F.regr_sxy(yc, xc).alias("_sxy"),
    )
    return (
        sums.withColumn("mse", (F.col("_syy") - F.col("slope") * F.col("_sxy")) / F.col("n"))
        .withColumn("std_err", F.col("stddev_y") / F.sqrt("n"))
        .drop("_syy", "_sxy")
    )


def fit_quality(df: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return linear_fit(df, x, y, by).select(*by, "r2", "mse")


def correlation(df: DataFrame, x: str = "x", y: str = "y", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.corr(x, y).alias("corr"))


def predict(fit: DataFrame, x: Column) -> Column:
    return fit["intercept"] + fit["slope"] * x


def interval(
    fit: DataFrame, x0: float, pr: float = CONFIDENCE, t: float | None = None
) -> DataFrame:
    """Band of y at `x0`: prediction +- t * standard error of y.

    `t` defaults to the Student quantile of cumulative probability `pr` (one-sided) with n - 2 degrees,
    worked out once per distinct n.
    """
    if t is None:
        ns = fit.select("n").distinct().withColumn("_t", _t_quantile((F.col("n") - 2).cast("double"), F.lit(float(pr))))
        fit = join_on(fit, ns, ["n"], "left")
    else:
        fit = fit.withColumn("_t", F.lit(float(t)))
    y0 = F.col("intercept") + F.col("slope") * F.lit(float(x0))
    return (
        fit.withColumn("y0", y0)
        .withColumn("_half", F.col("_t") * F.col("std_err"))
        .withColumn("low", F.col("y0") - F.col("_half"))
        .withColumn("high", F.col("y0") + F.col("_half"))
        .drop("_half", "_t")
    )


def student_quantiles(p: float, degrees: np.ndarray) -> np.ndarray:
    """Inverse of Student's t distribution function for many degrees of freedom at once; NaN below one degree.

    With t = sqrt(n) tan(u) the density is proportional to cos(u)^(n-1). Both the area up to u and the whole area
    are sums over fixed nodes, and u is found by bisection: the same steps for every n, at 1e-9 or better.
    """
    n = np.asarray(degrees, dtype="float64")
    good = (n >= 1) & (0 < p < 1)
    n = np.where(good, n, 1.0)
    upper = np.minimum(math.pi / 2, TAIL / np.sqrt(n))

    def area(u: np.ndarray) -> np.ndarray:
        at = np.outer(u, (NODES + 1) / 2)
        return u / 2 * (np.exp((n - 1)[:, None] / 2 * np.log1p(-(np.sin(at) ** 2))) @ WEIGHTS)

    wanted = abs(2 * p - 1) * area(upper)
    low, high = np.zeros_like(n), upper
    for _ in range(60):
        mid = (low + high) / 2
        less = area(mid) < wanted
        low, high = np.where(less, mid, low), np.where(less, high, mid)
    t = math.copysign(1.0, p - 0.5) * np.sqrt(n) * np.tan((low + high) / 2)
    return np.where(good, t, np.nan)


def student_quantile(p: float, degrees: float) -> float:
    return float(student_quantiles(p, np.array([degrees]))[0])


@F.pandas_udf(T.DoubleType())
def _t_quantile(degrees: pd.Series, p: pd.Series) -> pd.Series:
    p = p.reset_index(drop=True)
    out = pd.Series(math.nan, index=p.index)
    for q in p.unique():
        of_q = p == q
        out[of_q] = student_quantiles(q, degrees.to_numpy()[of_q])
    return out


def _nearest(columns: Sequence[str], centres: Sequence[Sequence[float]]) -> Column:
    """Number of the nearest centre, the first of equals; null where a coordinate is."""
    apart = [
        sum(((F.col(c) - F.lit(v)) * (F.col(c) - F.lit(v)) for c, v in zip(columns, centre, strict=True)), F.lit(0.0))
        for centre in centres
    ]
    known = F.lit(True)
    for c in columns:
        known = known & F.col(c).isNotNull()
    return F.when(known, F.array_position(F.array(*apart), F.array_min(F.array(*apart))).cast("int") - 1)


def kmeans(
    df: DataFrame,
    columns: Sequence[str] = ("x", "y"),
    k: int = 2,
    most_steps: int = 100,
    close: float = 1e-9,
) -> DataFrame:
    """Add `cluster`, the number of the nearest of k centres; rows with a null coordinate get null.

    The first centres lie evenly between the least and the greatest row, so a fit does not depend on how
    rows are dealt. Each step is one aggregate of k rows; steps end when no centre moves by more than
    `close` of its size. A centre without rows stays. Clusters are numbered by their centres. Give a
    stored table: every step reads it.
    """
    columns = list(columns)
    point = F.struct(*[F.col(c).cast("double").alias(c) for c in columns])
    known = df.dropna(subset=columns)
    ends = known.agg(F.min(point).alias("low"), F.max(point).alias("high")).first()
    if ends is None or ends["low"] is None:
        return df.withColumn("cluster", F.lit(None).cast("int"))
    centres = [
        [a + (b - a) * i / max(k - 1, 1) for a, b in zip(ends["low"], ends["high"], strict=True)] for i in range(k)
    ]
    for _ in range(most_steps):
        means = known.groupBy(_nearest(columns, centres).alias("_c")).agg(*[F.avg(c).alias(c) for c in columns])
        found = {r["_c"]: [r[c] for c in columns] for r in means.toLocalIterator()}
        moved = [found.get(i, centre) for i, centre in enumerate(centres)]
        still = all(
            abs(a - b) <= close * max(1.0, abs(a)) for old, new in zip(centres, moved, strict=True) for a, b in zip(old, new, strict=True)
        )
        centres = moved
        if still:
            break
    return df.withColumn("cluster", _nearest(columns, sorted(centres)))
