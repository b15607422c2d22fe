"""Reorder trends over time, launches, calendar counts, district footfall."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.functions.columns import ratio
from loomshelf.functions.quantiles import with_row
from loomshelf.functions.ranking import top_per_group

# Season order, and the hours that count as visiting time (both ends included).
SEASON_ORDER = ["Spring", "Summer", "Fall", "Winter"]
OPEN_HOUR, CLOSE_HOUR = 10, 22


def month_of(date: str | Column = "date") -> Column:
    return F.trunc(date, "month").alias("month")


def new_vs_reorder(reviews: DataFrame, *period: str | Column) -> DataFrame:
    """New and reorder reviews, total and reorder share in percent per period (and category)."""
    is_reorder = F.coalesce(F.col("is_reorder"), F.lit(False))
    return (
        reviews.groupBy(*period)
        .agg(
            F.count_if(~is_reorder).alias("n_new"),
            F.count_if(is_reorder).alias("n_reorder"),
            F.count(F.lit(1)).alias("total"),
        )
        .withColumn("reorder_pct", ratio(F.col("n_reorder") * 100.0, "total"))
    )


def yearly(reviews: DataFrame) -> DataFrame:
    return new_vs_reorder(reviews, F.year("date").alias("year"))


def monthly(reviews: DataFrame) -> DataFrame:
    return new_vs_reorder(reviews, month_of())


def monthly_by_category(reviews: DataFrame, products: DataFrame, category: str) -> DataFrame:
    placed = reviews.join(products.select("product_code", category), "product_code", "left")
    return new_vs_reorder(placed, month_of(), category)


def monthly_with_totals(reviews: DataFrame, products: DataFrame, category: str) -> DataFrame:
    """Months of each category, the whole period of each category and the whole of both, from one aggregate.

    ``level`` says which a row is: ``month``, ``category`` or ``all``; what a total leaves open is NULL, and so is the
    category of reviews of unknown products in rows of their own.
    """
    placed = reviews.join(products.select("product_code", category), "product_code", "left").select(category, month_of(), F.coalesce("is_reorder", F.lit(False)).alias("_re"))
    rolled = placed.rollup(category, "month").agg(
        F.grouping_id().alias("_level"), F.count_if(~F.col("_re")).alias("n_new"), F.count_if("_re").alias("n_reorder"), F.count(F.lit(1)).alias("total")
    )
    level = F.when(F.col("_level") == 0, "month").when(F.col("_level") == 1, "category").otherwise("all")
    share = ratio(F.col("n_reorder") * 100.0, "total")
    return rolled.select(category, "month", level.alias("level"), "n_new", "n_reorder", "total", share.alias("reorder_pct"))


def category_totals(by_month: DataFrame, category: str) -> DataFrame:
    """Whole-period totals, re-aggregated from the monthly frame instead of scanning reviews again."""
    return (
        by_month.groupBy(category)
        .agg(F.sum("n_new").alias("n_new"), F.sum("n_reorder").alias("n_reorder"), F.sum("total").alias("total"))
        .withColumn("reorder_pct", ratio(F.col("n_reorder") * 100.0, "total"))
    )


def biggest_categories(by_month: DataFrame, category: str, n: int = 10) -> DataFrame:
    """The monthly series of the ``n`` categories with most reviews."""
    top = (
        category_totals(by_month, category)
        .where(F.col(category).isNotNull())
        .orderBy(F.desc("total"), category)
        .limit(n)
        .select(category)
    )
    return by_month.join(F.broadcast(top), category, "left_semi")


def category_stars(products: DataFrame, category: str = "category_2", metric: str = "engagement_score", n: int = 3) -> DataFrame:
    return top_per_group(products, [category], [F.desc_nulls_last(metric), F.asc("product_code")], n)


def product_series(reviews: DataFrame, selected: DataFrame, min_reviews: int = 3) -> DataFrame:
    """Monthly count and reorder share of selected products, months with enough reviews only."""
    kept = reviews.join(selected.select("product_code").distinct(), "product_code", "left_semi")
    return new_vs_reorder(kept, "product_code", month_of()).where(F.col("total") >= min_reviews)


def launches(reviews: DataFrame) -> DataFrame:
    return reviews.groupBy("product_code").agg(F.trunc(F.min("date"), "month").alias("launch_month"))


def launches_per_month(reviews: DataFrame) -> DataFrame:
    """New products per month and running total; the window runs over months."""
    per_month = launches(reviews).groupBy("launch_month").agg(F.count(F.lit(1)).alias("n_new"))
    upto = Window.partitionBy().orderBy("launch_month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return per_month.withColumn("n_total", F.sum("n_new").over(upto))


def launches_by_category(reviews: DataFrame, products: DataFrame, category: str = "category_2", n: int = 10) -> DataFrame:
    per = (
        launches(reviews)
        .join(products.select("product_code", category), "product_code", "left")
        .groupBy("launch_month", category)
        .agg(F.count(F.lit(1)).alias("n_new"))
    )
    top = per.groupBy(category).agg(F.sum("n_new").alias("_t")).orderBy(F.desc("_t"), category).limit(n).select(category)
    return per.join(F.broadcast(top), category, "left_semi")


def recent_launches(reviews: DataFrame, products: DataFrame, since: str, n: int = 20) -> DataFrame:
    new = launches(reviews).where(F.col("launch_month") >= F.lit(since).cast("date"))
    return (
        new.join(products.select("product_code", "name", "category_2"), "product_code")
        .orderBy(F.desc("launch_month"), "product_code")
        .limit(n)
    )


def calendar_counts(calendar: DataFrame) -> DataFrame:
    """Counts by year, month, weekday in one long frame."""
    levels = {
        "year": F.col("year").cast("string"),
        "year_month": F.date_format("date", "yyyy-MM"),
        "day_of_week": F.col("day_of_week").cast("string"),
    }
    daily = calendar.groupBy("date", "year", "day_of_week").agg(F.count(F.lit(1)).alias("n"))
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), c.alias("value")) for k, c in levels.items()]))
    return daily.select("n", rows.alias("r")).groupBy("r.level", "r.value").agg(F.sum("n").alias("n_reviews"))


def season_counts(calendar: DataFrame, seasons: Sequence[str] = SEASON_ORDER) -> DataFrame:
    """Year × season with zeros where nothing was written, seasons in fixed order."""
    counts = calendar.groupBy("year", "season").agg(F.count(F.lit(1)).alias("n_reviews"))
    order = F.posexplode(F.array(*[F.lit(s) for s in seasons])).alias("season_no", "season")
    grid = counts.select("year").distinct().select("year", order)
    return grid.join(counts, ["year", "season"], "left").withColumn("n_reviews", F.coalesce("n_reviews", F.lit(0)))


def season_shares(counts: DataFrame) -> DataFrame:
    """Row percentages per year over the (year, season) frame."""
    return counts.withColumn(
        "pct", ratio(F.col("n_reviews") * 100.0, F.sum("n_reviews").over(Window.partitionBy("year")))
    )


def rating_by(calendar: DataFrame, period: str) -> DataFrame:
    return calendar.groupBy(period).agg(
        F.avg("rating").alias("mean"), F.percentile("rating", F.lit(0.5)).alias("median"), F.count("rating").alias("count")
    )


def visiting_hours(hours: DataFrame, first: int = OPEN_HOUR, last: int = CLOSE_HOUR) -> DataFrame:
    return hours.where(F.col("hour").between(first, last))


def district_footfall(hours: DataFrame, first: int = OPEN_HOUR, last: int = CLOSE_HOUR) -> DataFrame:
    """Average people present, and person-hours per day, during visiting hours."""
    days = F.count_distinct("day")
    return (
        visiting_hours(hours, first, last)
        .groupBy("district")
        .agg(F.sum("visitors").alias("total"), days.alias("n_days"), F.sum("foreign_visitors").alias("foreign_total"))
        .withColumn("person_hours", F.col("total") / F.col("n_days"))
        .withColumn("average_present", F.col("total") / (last - first + 1) / F.col("n_days"))
    )


def _scaled(c: str) -> Column:
    lo, hi = F.col(f"_min_{c}"), F.col(f"_max_{c}")
    return ratio(F.col(c) - lo, hi - lo, 0.0)


def composite_score(footfall: DataFrame, a: str = "foreign_total", b: str = "person_hours") -> DataFrame:
    """Sum of two min-max scaled measures and the rank by it (district frame)."""
    spans = footfall.agg(*[f(c).alias(f"_{f.__name__}_{c}") for c in (a, b) for f in (F.min, F.max)])
    scored = with_row(footfall, spans).withColumn("score", _scaled(a) + _scaled(b))
    rank = F.row_number().over(Window.partitionBy().orderBy(F.desc(F.round("score", 9)), "district"))
    return scored.select("district", a, b, "score", rank.alias("position"))


def hour_matrix(hours: DataFrame, first: int = OPEN_HOUR, last: int = CLOSE_HOUR) -> DataFrame:
    """District × hour visitors per hour column, 0 where nobody came."""
    cells = [F.coalesce(F.sum(F.when(F.col("hour") == h, F.col("visitors"))), F.lit(0)).alias(f"h{h}") for h in range(first, last + 1)]
    return hours.groupBy("district").agg(*cells)


def peak_hours(hours: DataFrame) -> DataFrame:
    """Busiest hour per district; the earlier hour wins a tie."""
    per_hour = visiting_hours(hours).groupBy("district", "hour").agg(F.sum("visitors").alias("n"))
    return per_hour.groupBy("district").agg(
        F.max_by("hour", F.struct(F.col("n"), -F.col("hour"))).alias("peak_hour"), F.max("n").alias("peak_visitors")
    )


def peak_distribution(peaks: DataFrame) -> DataFrame:
    return peaks.groupBy("peak_hour").agg(F.count(F.lit(1)).alias("n_districts"))


def monthly_nationality(hours: DataFrame) -> DataFrame:
    """Monthly daily average, nationality split and weekday/weekend day counts."""
    daily = hours.groupBy("day").agg(
        F.sum("visitors").alias("visitors"), F.sum("chinese").alias("chinese"), F.sum("other").alias("other")
    )
    weekend = F.weekday("day") >= 5
    per_month = daily.groupBy(F.trunc("day", "month").alias("month")).agg(
        F.sum("visitors").alias("visitors"),
        F.sum("chinese").alias("chinese"),
        F.sum("other").alias("other"),
        F.count_if(~weekend).alias("n_weekdays"),
        F.count_if(weekend).alias("n_weekend_days"),
        F.count(F.lit(1)).alias("n_days"),
    )
    both = F.col("chinese") + F.col("other")
    return per_month.withColumn("daily_average", F.col("visitors") / F.col("n_days")).withColumn(
        "chinese_pct", ratio(F.col("chinese") * 100.0, both)
    )


def yearly_nationality(per_month: DataFrame) -> DataFrame:
    """Mean of the monthly averages and the share weighted by visitors."""
    both = F.sum(F.col("chinese") + F.col("other"))
    return per_month.groupBy(F.year("month").alias("year")).agg(
        F.avg("daily_average").alias("mean_daily"), ratio(F.sum("chinese") * 100.0, both).alias("chinese_pct")
    )
