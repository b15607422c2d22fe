"""Descriptive statistics, user and product summaries, segment comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.functions.columns import exact_std, share_if
from loomshelf.functions.quantiles import exact_quantiles, small_domain_quantiles, with_row

QUARTILES = {"q25": 0.25, "median": 0.5, "q75": 0.75}


def describe(df: DataFrame, value: str, small_domain: bool = False) -> DataFrame:
    """count, mean, sample std, min, exact quartiles, max of a column, in one row."""
    basics = df.agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).cast("double").alias("min"),
        F.max(value).cast("double").alias("max"),
    )
    quartiles = small_domain_quantiles(df, value, QUARTILES) if small_domain else exact_quantiles(df, {value: QUARTILES})
    return with_row(basics, quartiles).select(F.lit(value).alias("metric"), "*")


def group_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """mean, median, std, count per group. For measures with a small domain (prices, ratings, lengths)."""
    return df.groupBy(by).agg(
        F.avg(value).alias("mean"),
        F.percentile(value, F.lit(0.5)).alias("median"),
        F.stddev_samp(value).alias("std"),
        F.count(value).alias("count"),
    )


def moments(df: DataFrame, value: str) -> DataFrame:
    """Bias-corrected skewness and excess kurtosis."""
    m = df.agg(
        F.count(value).cast("double").alias("n"), F.skewness(value).alias("g1"), F.kurtosis(value).alias("g2")
    )
    n, g1, g2 = F.col("n"), F.col("g1"), F.col("g2")
    return m.select(
        F.lit(value).alias("metric"),
        n.cast("long").alias("count"),
        F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)).alias("skewness"),
        F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)).alias("kurtosis"),
    )


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.agg(F.lit(a).alias("left"), F.lit(b).alias("right"), F.corr(a, b).alias("corr"))


def brand_means(products: DataFrame, metric: str, min_products: int = 5) -> DataFrame:
    return (
        products.groupBy("brand")
        .agg(F.avg(metric).alias("mean"), F.count(F.lit(1)).alias("n_products"))
        .where(F.col("n_products") >= min_products)
    )


def mean_by(df: DataFrame, key: str, value: str) -> DataFrame:
    return df.groupBy(key).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def trimmed(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """Rows not above the quantile."""
    return with_row(df, exact_quantiles(df, {value: {"_cut": q}})).where(F.col(value) <= F.col("_cut")).drop("_cut")


def flag_share(df: DataFrame, flag: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(flag)).alias("n_true"), share_if(F.col(flag)).alias("share"))


def user_profiles(reviews: DataFrame, length: Column | None = None) -> DataFrame:
    measures = [
        F.count(F.lit(1)).alias("review_count"),
        F.avg("rating").alias("avg_rating"),
        share_if(F.col("is_reorder")).alias("reorder_rate"),
    ]
    if length is not None:
        measures.append(F.avg(length).alias("avg_review_length"))
    return reviews.groupBy("user_id").agg(*measures)


def heavy_vs_normal(profiles: DataFrame, heavy_from: int = 20) -> DataFrame:
    """Mean of the users' own means, so every user weighs the same."""
    segment = F.when(F.col("review_count") >= heavy_from, "heavy").otherwise("normal")
    return profiles.groupBy(segment.alias("segment")).agg(
        F.count(F.lit(1)).alias("n_users"),
        F.avg("review_count").alias("mean_reviews"),
        F.avg("avg_rating").alias("mean_rating"),
        F.avg("reorder_rate").alias("mean_reorder_rate"),
    )


def top_users(reviews: DataFrame, n: int = 20) -> DataFrame:
    counts = reviews.groupBy("user_id").agg(F.count(F.lit(1)).alias("review_count"))
    return counts.orderBy(F.desc("review_count"), "user_id").limit(n)


def product_summary(products: DataFrame, reviews: DataFrame, length: Column | None = None) -> DataFrame:
    """Review aggregates per product, left-joined to all products."""
    r = F.col("rating")
    measures = [
        F.count(F.lit(1)).alias("n_reviews"),
        F.sum(r).alias("_sx"),
        F.sum(r * r).alias("_sxx"),
        F.count_if(F.col("is_reorder")).alias("reorder_count"),
        F.sum("image_count").alias("total_images"),
    ]
    if length is not None:
        measures.append(F.avg(length).alias("avg_length"))
    stats = reviews.groupBy("product_code").agg(*measures)
    n = F.col("n_reviews")
    stats = (
        stats.withColumn("avg_rating", F.col("_sx") / n)
        .withColumn("std_rating", exact_std(n, F.col("_sx"), F.col("_sxx")))
        .withColumn("reorder_rate", F.col("reorder_count") / n)
        .drop("_sx", "_sxx")
    )
    return products.join(stats, "product_code", "left")


def with_without_reviews(summary: DataFrame) -> DataFrame:
    return summary.agg(
        F.count_if(F.col("n_reviews").isNotNull()).alias("with_reviews"),
        F.count_if(F.col("n_reviews").isNull()).alias("without_reviews"),
    )


def well_rated(summary: DataFrame, min_rating: float = 4.7, min_reviews: int = 200, n: int = 10) -> DataFrame:
    kept = summary.where((F.col("avg_rating") >= min_rating) & (F.col("n_reviews") >= min_reviews))
    return kept.orderBy(F.desc("n_reviews"), "product_code").limit(n)


def often_reordered(summary: DataFrame, min_rate: float = 0.3, min_reviews: int = 100, n: int = 10) -> DataFrame:
    kept = summary.where((F.col("reorder_rate") >= min_rate) & (F.col("n_reviews") >= min_reviews))
    return kept.orderBy(F.desc("reorder_rate"), "product_code").limit(n)


def low_ratings_by(df: DataFrame, segment: str, low: float = 3.0) -> DataFrame:
    is_low = F.col("rating") <= low
    return df.groupBy(segment).agg(
        F.count_if(is_low).alias("n_low"), share_if(is_low).alias("low_share"), F.count(F.lit(1)).alias("n_total")
    )


def rating_pivot(df: DataFrame, segment: str, ratings: Sequence[int] = (1, 2, 3)) -> DataFrame:
    return df.groupBy(segment).agg(*[F.count_if(F.col("rating") == r).alias(f"rating_{r}") for r in ratings])


def star_shares(df: DataFrame, segment: str, top: float = 5.0, low: float = 3.0) -> DataFrame:
    return df.groupBy(segment).agg(
        (share_if(F.col("rating") == top) * 100).alias("top_pct"),
        (share_if(F.col("rating") <= low) * 100).alias("low_pct"),
        F.avg("rating").alias("mean_rating"),
    )


def two_metric_outliers(df: DataFrame, a: str, b: str) -> DataFrame:
    """High on one metric (above its third quartile) and low on the other (below its first), either way."""
    cuts = exact_quantiles(df, {a: {"_a25": 0.25, "_a75": 0.75}, b: {"_b25": 0.25, "_b75": 0.75}})
    kind = F.when((F.col(a) > F.col("_a75")) & (F.col(b) < F.col("_b25")), f"high {a}, low {b}").when(
        (F.col(a) < F.col("_a25")) & (F.col(b) > F.col("_b75")), f"low {a}, high {b}"
    )
    return (
        with_row(df, cuts)
        .withColumn("outlier_kind", kind)
        .where(F.col("outlier_kind").isNotNull())
        .drop("_a25", "_a75", "_b25", "_b75")
    )


def like_share_ratio(products: DataFrame, min_products: int = 5) -> DataFrame:
    return (
        products.groupBy("brand")
        .agg(F.avg("likes").alias("avg_likes"), F.avg("shares").alias("avg_shares"), F.count(F.lit(1)).alias("n_products"))
        .where(F.col("n_products") >= min_products)
        .withColumn("like_share_ratio", F.col("avg_likes") / (F.col("avg_shares") + 1))
    )


def compare_segments(df: DataFrame, segment: Column) -> DataFrame:
    """One column per measure and one row per segment; rows outside every segment drop out."""
    return (
        df.withColumn("segment", segment)
        .where(F.col("segment").isNotNull())
        .groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("n_products"),
            F.avg("price").alias("mean_price"),
            F.avg("avg_rating").alias("mean_rating"),
            F.avg("n_reviews").alias("mean_reviews"),
        )
    )


def overview(products: DataFrame, reviews: DataFrame, approximate: bool = False) -> DataFrame:
    """Totals, distinct counts and shares in one row."""
    distinct = F.approx_count_distinct if approximate else F.count_distinct
    p = products.agg(
        F.count(F.lit(1)).alias("n_products"),
        distinct("category_1").alias("n_categories"),
        distinct("brand").alias("n_brands"),
        F.avg("price").alias("mean_price"),
    )
    r = reviews.agg(
        F.count(F.lit(1)).alias("n_reviews"),
        F.avg("rating").alias("mean_rating"),
        share_if(F.col("is_reorder")).alias("reorder_share"),
        distinct("user_id").alias("n_users"),
        F.min("date").alias("first_date"),
        F.max("date").alias("last_date"),
    )
    return with_row(p, r)


def brand_catalogue(products: DataFrame, no_brand: str = "[no brand]") -> DataFrame:
    """Every product under its brand with the brand's product count.

    Long form: one row per product, so a brand with very many products is never one array.
    """
    named = products.withColumn("brand", F.coalesce(F.nullif(F.trim("brand"), F.lit("")), F.lit(no_brand)))
    counts = named.groupBy("brand").agg(F.count(F.lit(1)).alias("n_products"))
    return named.join(counts, "brand").select("brand", "n_products", "product_code", "name")
