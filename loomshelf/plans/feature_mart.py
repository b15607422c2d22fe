"""Products, reviews and promotions → feature tables → rating quadrants."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshelf.operators import product_features as pf
from loomshelf.operators import reorder as qa
from loomshelf.operators import review_features as rf
from loomshelf.sources.tables import settle


def product_features(products: DataFrame, reviews: DataFrame) -> DataFrame:
    """All product columns in one lazy plan."""
    counted = pf.with_review_count(products, reviews)
    scored = pf.with_price_position(pf.with_price_tier(pf.with_engagement(counted)))
    return pf.with_review_density(pf.with_value_index(scored))


def review_features(reviews: DataFrame, products: DataFrame, promos: DataFrame) -> DataFrame:
    """Review rows with reviewer, calendar, age and promotion columns; length columns where there is a text."""
    out = rf.with_product_age(rf.with_calendar(rf.with_user_activity(reviews)))
    out = rf.with_tendency(out)
    out = rf.with_repurchase(out, products).drop("brand", "category_2")
    if "text" in reviews.columns:
        out = rf.with_length(out)
    return rf.with_promo(out, products, promos)


def write_mart(products: DataFrame, reviews: DataFrame, promos: DataFrame, path: str) -> None:
    """The mart as Parquet, reviews partitioned by month so that date windows prune files."""
    product_features(products, reviews).write.mode("errorifexists").parquet(f"{path}/products")
    featured = review_features(reviews, products, promos).withColumn("review_month", F.date_format("date", "yyyy-MM"))
    # rows of a month are spread over tasks by product, so that a busy month is not one task
    spread = featured.repartition(F.col("review_month"), F.pmod(F.xxhash64("product_code"), F.lit(16)))
    spread.write.mode("errorifexists").partitionBy("review_month").parquet(f"{path}/reviews")


def steady_sellers(products: DataFrame, reviews: DataFrame, mean_floor: float = 4.5, min_rate: float = 30.0) -> DataFrame:
    """Well and evenly rated products that people buy again."""
    stats = settle(qa.rating_stats(reviews), "rating-stats")
    return qa.true_steady_sellers(qa.rating_quadrants(products, stats, mean_floor=mean_floor), min_rate)
