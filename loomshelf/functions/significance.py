"""Test statistics from grouped sums; p-values are computed on the one-row result."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomshelf.functions.quantiles import running_before


def _beta_tail(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - _beta_tail(b, a, 1.0 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d, out = 1e-300, 1.0, 0.0, 1.0
    for i in range(400):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        d = 1.0 + term * d
        d = 1.0 / (d if abs(d) > tiny else tiny)
        c = 1.0 + term / c
        c = c if abs(c) > tiny else tiny
        out *= c * d
        if abs(1.0 - c * d) < 1e-14:
            break
    return front * (out - 1.0)


def f_tail(f: float, df1: float, df2: float) -> float:
    """P(F > f)."""
    if f is None or math.isnan(f):
        return float("nan")
    return _beta_tail(df2 / 2.0, df1 / 2.0, df2 / (df2 + df1 * f))


@F.pandas_udf(T.DoubleType())
def f_p_value(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
    return pd.Series([f_tail(*row) for row in zip(f, df1, df2)])


@F.pandas_udf(T.DoubleType())
def normal_two_sided(z: pd.Series) -> pd.Series:
    return z.map(lambda v: min(1.0, math.erfc(v / math.sqrt(2.0))))


def anova(df: DataFrame, group: str, value: str, p_value: bool = True) -> DataFrame:
    """One-way analysis of variance: F, degrees of freedom and p. One shuffle on the group."""
    v = F.col(value).cast("double")
    groups = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(v).alias("sx"), F.sum(v * v).alias("sxx")
    )
    total = groups.agg(
        F.count(F.lit(1)).cast("double").alias("k"),
        F.sum("n").alias("n"),
        F.sum("sx").alias("sx"),
        F.sum("sxx").alias("sxx"),
        F.sum(F.col("sx") * F.col("sx") / F.col("n")).alias("between"),
    )
    out = total.select(
        (F.col("k") - 1).alias("df_between"),
        (F.col("n") - F.col("k")).alias("df_within"),
        (
            (F.col("between") - F.col("sx") * F.col("sx") / F.col("n"))
            / F.nullif(F.col("k") - 1, F.lit(0.0))
            / F.nullif((F.col("sxx") - F.col("between")) / F.nullif(F.col("n") - F.col("k"), F.lit(0.0)), F.lit(0.0))
        ).alias("f_stat"),
    )
    return out.withColumn("p_value", f_p_value("f_stat", "df_between", "df_within")) if p_value else out


def mann_whitney(df: DataFrame, in_first: Column, value: str, p_value: bool = True) -> DataFrame:
    """U of the first group against the rest, mid-ranks, tie-corrected and continuity-corrected normal p."""
    counts = (
        df.where(F.col(value).isNotNull())
        .groupBy(F.col(value).cast("double").alias("_v"))
        .agg(F.count_if(in_first).alias("_a"), F.count(F.lit(1)).alias("_t"))
    )
    ranked = running_before(counts, "_v", "_t")
    t = F.col("_t").cast("double")
    sums = ranked.agg(
        F.sum("_a").cast("double").alias("n1"),
        F.sum("_t").cast("double").alias("n"),
        F.sum(F.col("_a") * (F.col("before") + (t + 1) / 2)).alias("r1"),
        F.sum(t * t * t - t).alias("ties"),
    ).withColumn("n2", F.col("n") - F.col("n1"))
    out = sums.withColumn("u_stat", F.col("r1") - F.col("n1") * (F.col("n1") + 1) / 2)
    if not p_value:
        return out.select(F.col("n1").cast("long"), F.col("n2").cast("long"), "u_stat")
    pairs = F.col("n1") * F.col("n2")
    spread = F.sqrt(pairs / 12 * ((F.col("n") + 1) - F.col("ties") / F.nullif(F.col("n") * (F.col("n") - 1), F.lit(0.0))))
    z = (F.greatest("u_stat", pairs - F.col("u_stat")) - pairs / 2 - 0.5) / F.nullif(spread, F.lit(0.0))
    return out.withColumn("z", z).select(
        F.col("n1").cast("long"), F.col("n2").cast("long"), "u_stat", normal_two_sided("z").alias("p_value")
    )
