"""Derived product columns: popularity, price position, value for money."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.functions.columns import ratio, steps_below
from loomshelf.functions.quantiles import exact_quantiles, with_row

# Weights and cut-offs of the product features.
ENGAGEMENT_WEIGHTS = {"likes": 0.15, "shares": 0.30, "review_count": 0.55}
PRICE_TIERS = [(1500, "Easy Pick"), (3000, "Standard")]
TOP_PRICE_TIER = "Premium"
CHEAP_BELOW, DEAR_ABOVE = 0.8, 1.2
VALUE_QUANTILE = 0.9


def with_review_count(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """review_count per product, 0 where nobody wrote one."""
    counts = reviews.groupBy("product_code").agg(F.count(F.lit(1)).alias("review_count"))
    return products.join(counts, "product_code", "left").withColumn(
        "review_count", F.coalesce("review_count", F.lit(0).cast("long"))
    )


def with_engagement(products: DataFrame, weights: dict[str, float] = ENGAGEMENT_WEIGHTS) -> DataFrame:
    score = None
    for name, weight in weights.items():
        term = F.lit(weight) * F.col(name)
        score = term if score is None else score + term
    return products.withColumn("engagement_score", score)


def weight_diagnostics(products: DataFrame, metrics: Sequence[str] = tuple(ENGAGEMENT_WEIGHTS)) -> DataFrame:
    """Per metric: spread before and after min-max scaling, and correlation with every other metric."""
    aggs = []
    for m in metrics:
        aggs += [
            F.count(m).alias(f"{m}_n"),
            F.avg(m).alias(f"{m}_mean"),
            F.stddev_samp(m).alias(f"{m}_std"),
            F.var_samp(m).alias(f"{m}_var"),
            F.min(m).cast("double").alias(f"{m}_min"),
            F.max(m).cast("double").alias(f"{m}_max"),
        ]
        aggs += [F.corr(m, other).alias(f"{m}_{other}_corr") for other in metrics]
    wide = products.agg(*aggs)
    rows = [
        F.struct(
            F.lit(m).alias("metric"),
            F.col(f"{m}_n").alias("n"),
            F.col(f"{m}_mean").alias("mean"),
            F.col(f"{m}_std").alias("std"),
            F.col(f"{m}_min").alias("min"),
            F.col(f"{m}_max").alias("max"),
            ratio(f"{m}_std", f"{m}_mean").alias("cv"),
            ratio(f"{m}_var", (F.col(f"{m}_max") - F.col(f"{m}_min")) * (F.col(f"{m}_max") - F.col(f"{m}_min"))).alias(
                "scaled_var"
            ),
            *[F.col(f"{m}_{other}_corr").alias(f"corr_{other}") for other in metrics],
        )
        for m in metrics
    ]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def with_price_tier(products: DataFrame, tiers=PRICE_TIERS, top: str = TOP_PRICE_TIER) -> DataFrame:
    return products.withColumn("price_tier", steps_below("price", tiers, top))


def with_price_position(
    products: DataFrame, category: str = "category_2", low: float = CHEAP_BELOW, high: float = DEAR_ABOVE
) -> DataFrame:
    """Price against the category mean.

    The mean is joined back from an aggregate and not taken over a category window, so that one huge
    category is not sorted in one task.
    """
    means = products.groupBy(category).agg(F.avg("price").alias("category_price"))
    joined = products.join(means.withColumnRenamed(category, "_cat"), F.col(category).eqNullSafe(F.col("_cat")), "left")
    relative = ratio("price", "category_price")
    return joined.drop("_cat").withColumn("relative_price_ratio", relative).withColumn(
        "price_position",
        F.when(F.col("relative_price_ratio") < low, "Cheaper than Avg")
        .when(F.col("relative_price_ratio") > high, "More Expensive than Avg")
        .otherwise("Average"),
    )


def with_value_index(products: DataFrame, quantile: float = VALUE_QUANTILE, scale: float = 1000.0, offset: int = 0) -> DataFrame:
    """cp_index = engagement / (price + offset) * scale, and whether it reaches the wanted quantile."""
    scored = products.withColumn("cp_index", ratio("engagement_score", F.col("price") + offset) * F.lit(scale))
    cut = exact_quantiles(scored, {"cp_index": {"cp_cut": quantile}})
    return with_row(scored, cut).withColumn("is_god_sung_bi", F.col("cp_index") >= F.col("cp_cut")).drop("cp_cut")


def with_review_density(products: DataFrame) -> DataFrame:
    return products.withColumn("review_density", ratio("review_count", "likes", 0.0))


def with_daily_density(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """Reviews per day between a product's first review and the last day of the data."""
    seen = reviews.groupBy("product_code").agg(F.min("date").alias("first_review_date"))
    last = reviews.agg(F.max("date").alias("_last"))
    days = F.datediff("_last", "first_review_date") + 1
    return (
        with_row(products.join(seen, "product_code", "left"), last)
        .withColumn("daily_density", F.coalesce(ratio("review_count", days), F.lit(0.0)))
        .drop("_last")
    )


def crosstab(df: DataFrame, rows: str, cols: str, values: Sequence[str], percent: bool = False) -> DataFrame:
    """Counts of ``rows`` × ``cols`` for the given column values; as row percentages when asked."""
    names = [v.lower().replace(" ", "_") for v in values]
    counts = df.groupBy(rows).agg(*[F.count_if(F.col(cols) == v).alias(n) for v, n in zip(values, names)])
    if not percent:
        return counts
    total = sum((F.col(n) for n in names), F.lit(0))
    return counts.select(rows, *[ratio(F.col(n) * 100.0, total).alias(n) for n in names])


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Share of each value; the window runs over the counted values only."""
    counts = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def top_n(df: DataFrame, metric: str, n: int, tiebreak: Sequence[str]) -> DataFrame:
    return df.orderBy(F.col(metric).desc_nulls_last(), *tiebreak).limit(n)
