"""Reorder rates, rating quadrants, viral and steady sellers, concentration."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.functions.columns import exact_std, ratio
from loomshelf.functions.quantiles import exact_quantiles, with_row
from loomshelf.functions.ranking import top_per_group

# Quadrant names.
VIRAL, AT_RISK, BLAND, STEADY = "Q1: viral", "Q2: at risk", "Q3: bland", "Q4: steady seller"
INSUFFICIENT = "insufficient data"
VIRAL_SUBSETS = {"q1": [VIRAL], "q2": [AT_RISK], "q1_q2": [VIRAL, AT_RISK]}


def percent_2dp(part: Column, whole: Column) -> Column:
    """Percentage with two decimals, halves to even."""
    return F.rint(ratio(part, whole) * 100 * 100) / 100


def product_reorder(products: DataFrame, reviews: DataFrame) -> DataFrame:
    stats = reviews.groupBy("product_code").agg(
        F.count_if(F.col("is_reorder")).alias("reorder_count"),
        F.count(F.lit(1)).alias("n_reviews"),
        F.avg("rating").alias("avg_rating"),
    )
    stats = stats.withColumn("reorder_rate", percent_2dp(F.col("reorder_count"), F.col("n_reviews")))
    return products.join(stats, "product_code", "left")


def high_reorder(stats: DataFrame, min_rate: float = 30.0, min_reviews: int = 20) -> DataFrame:
    return stats.where((F.col("reorder_rate") >= min_rate) & (F.col("n_reviews") >= min_reviews))


def low_reorder(stats: DataFrame, below: float = 10.0, min_reviews: int = 20) -> DataFrame:
    return stats.where((F.col("reorder_rate") < below) & (F.col("n_reviews") >= min_reviews))


def profile(selected: DataFrame, keys: Sequence[str] = ("category_2", "brand"), n: int = 10) -> DataFrame:
    """The most frequent values of each key among selected products, long form."""
    parts = None
    for key in keys:
        counts = selected.groupBy(F.col(key).alias("value")).agg(F.count(F.lit(1)).alias("n_products"))
        top = counts.orderBy(F.desc("n_products"), "value").limit(n).select(F.lit(key).alias("dimension"), "*")
        parts = top if parts is None else parts.unionByName(top)
    return parts


def rating_share(selected: DataFrame, reaches: float = 4.5) -> DataFrame:
    return selected.agg(
        F.count(F.lit(1)).alias("n_products"),
        F.avg("price").alias("mean_price"),
        F.percentile("price", F.lit(0.5)).alias("median_price"),
        F.avg("avg_rating").alias("mean_rating"),
        F.avg(F.when(F.col("avg_rating") >= reaches, 100.0).otherwise(0.0)).alias("well_rated_pct"),
    )


def category_reorder(stats: DataFrame, category: str = "category_2", min_reviews: int = 50) -> DataFrame:
    """Sums first, then the ratio, so big products weigh more."""
    return (
        stats.groupBy(category)
        .agg(
            F.sum("reorder_count").alias("reorder_count"),
            F.sum("n_reviews").alias("n_reviews"),
            F.count(F.lit(1)).alias("n_products"),
        )
        .where(F.col("n_reviews") >= min_reviews)
        .withColumn("reorder_rate", percent_2dp(F.col("reorder_count"), F.col("n_reviews")))
        .withColumn("avg_reorder_reviews", percent_2dp(F.col("reorder_count"), F.col("n_products")) / 100)
    )


def both_ends(df: DataFrame, metric: str, tiebreak: str, n: int = 15) -> DataFrame:
    top = df.orderBy(F.desc(metric), tiebreak).limit(n).withColumn("end", F.lit("top"))
    bottom = df.orderBy(F.asc(metric), tiebreak).limit(n).withColumn("end", F.lit("bottom"))
    return top.unionByName(bottom)


def reorder_groups(categories: DataFrame, high: float = 0.67, low: float = 0.33) -> DataFrame:
    cuts = exact_quantiles(categories, {"reorder_rate": {"_high": high, "_low": low}})
    group = F.when(F.col("reorder_rate") >= F.col("_high"), "high").when(F.col("reorder_rate") >= F.col("_low"), "mid").otherwise("low")
    return with_row(categories, cuts).withColumn("reorder_group", group).drop("_high", "_low")


def reorder_group_stats(grouped: DataFrame) -> DataFrame:
    return grouped.groupBy("reorder_group").agg(
        F.count(F.lit(1)).alias("n_categories"),
        F.avg("reorder_rate").alias("mean_rate"),
        F.avg("n_reviews").alias("mean_reviews"),
        F.avg("n_products").alias("mean_products"),
    )


def reorder_group_leaders(grouped: DataFrame, category: str = "category_2", n: int = 5) -> DataFrame:
    return top_per_group(grouped, ["reorder_group"], [F.desc("n_reviews"), F.asc(category)], n)


def rating_stats(reviews: DataFrame) -> DataFrame:
    """Count, mean, spread and reorder rate of the ratings per product, in one pass over the reviews."""
    r = F.col("rating")
    n = F.col("n_reviews")
    sums = reviews.groupBy("product_code").agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.sum(r).alias("_sx"),
        F.sum(r * r).alias("_sxx"),
        F.count_if(F.col("is_reorder")).alias("reorder_count"),
    )
    return sums.select(
        "product_code",
        "n_reviews",
        (F.col("_sx") / n).alias("avg_rating"),
        exact_std(n, F.col("_sx"), F.col("_sxx")).alias("std_rating"),
        percent_2dp(F.col("reorder_count"), n).alias("reorder_rate"),
    )


def rating_quadrants(
    products: DataFrame, stats: DataFrame, min_candidates: int = 10, min_reviews: int = 30, mean_floor: float = 4.5
) -> DataFrame:
    """Place products by mean and spread of their ratings (``rating_stats``).

    Thresholds are medians over products with enough reviews; they stay a one-row frame in the plan.
    The statistics are read several times, so hand in a written table when the reviews are large.
    """
    n = F.col("n_reviews")
    stats = stats.where(n >= min_candidates)
    cuts = exact_quantiles(stats, {"avg_rating": {"_mid_mean": 0.5}, "std_rating": {"_std_cut": 0.5}}).select(
        F.greatest("_mid_mean", F.lit(mean_floor)).alias("_mean_cut"), "_std_cut"
    )
    high_mean = F.col("avg_rating") >= F.col("_mean_cut")
    high_std = F.col("std_rating") >= F.col("_std_cut")
    quadrant = (
        F.when(n < min_reviews, INSUFFICIENT)
        .when(high_mean & high_std, VIRAL)
        .when(high_std, AT_RISK)
        .when(high_mean, STEADY)
        .otherwise(BLAND)
    )
    placed = with_row(stats, cuts).withColumn("quadrant", quadrant).drop("_mean_cut", "_std_cut")
    return products.join(placed, "product_code")


def quadrant_leaders(placed: DataFrame, n: int = 10) -> DataFrame:
    valid = placed.where(F.col("quadrant") != INSUFFICIENT)
    return top_per_group(valid, ["quadrant"], [F.desc("n_reviews"), F.asc("product_code")], n)


def quadrant_summary(placed: DataFrame) -> DataFrame:
    return (
        placed.where(F.col("quadrant") != INSUFFICIENT)
        .groupBy("quadrant")
        .agg(
            F.count(F.lit(1)).alias("n_products"),
            F.avg("avg_rating").alias("mean_rating"),
            F.avg("std_rating").alias("mean_std"),
            F.avg("n_reviews").alias("mean_reviews"),
            F.avg("price").alias("mean_price"),
        )
    )


def true_steady_sellers(placed: DataFrame, min_rate: float = 30.0) -> DataFrame:
    return placed.where((F.col("quadrant") == STEADY) & (F.col("reorder_rate") >= min_rate))


def viral_products(
    placed: DataFrame, subsets: Mapping[str, Sequence[str]] = VIRAL_SUBSETS, top: float = 0.70, bottom: float = 0.30
) -> DataFrame:
    """Much engagement and little reordering, both against quantiles inside each set of quadrants.

    A product belongs to every set that names its quadrant, so all sets share one pass.
    """
    member = F.array_compact(
        F.array(*[F.when(F.col("quadrant").isin(*quadrants), F.lit(name)) for name, quadrants in subsets.items()])
    )
    members = placed.withColumn("subset", F.explode(member))
    cuts = exact_quantiles(members, {"engagement_score": {"_eng": top}, "reorder_rate": {"_rate": bottom}}, by=["subset"])
    hit = (F.col("engagement_score") >= F.col("_eng")) & (F.col("reorder_rate") <= F.col("_rate"))
    # cuts: one row per named set
    return members.join(F.broadcast(cuts), "subset").where(hit).drop("_eng", "_rate")


def quadrant_engagement(placed: DataFrame) -> DataFrame:
    return placed.groupBy("quadrant").agg(
        F.avg("engagement_score").alias("mean_engagement"), F.avg("reorder_rate").alias("mean_reorder_rate")
    )


def concentration(products: DataFrame, metric: str = "likes") -> DataFrame:
    """Share and running share per brand, largest first; windows run over the brand totals only."""
    totals = products.groupBy("brand").agg(F.sum(metric).alias("total"), F.count(F.lit(1)).alias("n_products"))
    down = Window.partitionBy().orderBy(F.desc("total"), "brand")
    pct = percent_2dp(F.col("total"), F.sum("total").over(Window.partitionBy()))
    return (
        totals.withColumn("pct", pct)
        .withColumn("position", F.row_number().over(down))
        .withColumn("cum_pct", F.sum("pct").over(down.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    )


def top_shares(shares: DataFrame, sizes: Sequence[int] = (5, 10, 20)) -> DataFrame:
    return shares.agg(*[F.sum(F.when(F.col("position") <= k, F.col("pct")).otherwise(0.0)).alias(f"top_{k}_pct") for k in sizes])


def hhi(shares: DataFrame) -> DataFrame:
    """Sum of squared percentage shares, with the usual bands."""
    h = shares.agg(F.sum(F.col("pct") * F.col("pct")).alias("hhi"))
    band = F.when(F.col("hhi") < 1500, "competitive").when(F.col("hhi") < 2500, "moderate").otherwise("concentrated")
    return h.withColumn("band", band)


def lorenz(products: DataFrame, metric: str = "likes") -> DataFrame:
    totals = products.groupBy("brand").agg(F.sum(metric).alias("total"))
    up = Window.partitionBy().orderBy(F.asc("total"), "brand")
    everything = Window.partitionBy()
    return totals.select(
        "brand",
        (F.row_number().over(up) / F.count(F.lit(1)).over(everything) * 100).alias("cum_brands_pct"),
        (
            F.sum("total").over(up.rowsBetween(Window.unboundedPreceding, Window.currentRow))
            / F.sum("total").over(everything)
            * 100
        ).alias("cum_metric_pct"),
    )
