"""Derived review columns: length, reorder flags, reviewer, calendar and promotion features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.functions.columns import any_of, col, steps_above, steps_below
from loomshelf.functions.ranking import keep_first, null_safe_join
from loomshelf.functions.quantiles import with_row

# Class labels, bounds, words and patterns of the review features.
LENGTH_CLASSES = [(20, "Very Short"), (50, "Short"), (100, "Medium")]
LONGEST_CLASS = "Long"
LENGTH_BINS = [(50, "0-50"), (100, "51-100"), (200, "101-200"), (500, "201-500"), (1000, "501-1000")]
LONGEST_BIN = "1000+"
REORDER_WORD = "재구매"
REORDER_PREFIXES = ["재구매", "리구매", "re구매", r"\[재구매\]", r"\(재구매\)", "재.?구매"]
REORDER_TAGS = [r"^재구매\s*[\|｜:：]?\s*", r"^\[재구매\]\s*", r"^【재구매】\s*", r"^재구매\s+"]
ACTIVITY_LEVELS = [(1, "Newbie"), (5, "Junior"), (20, "Regular")]
TOP_ACTIVITY = "VIP"
ACTIVITY_LEVELS_V2 = [(20, "Very Active"), (10, "Active"), (5, "Moderate")]
LOWEST_ACTIVITY_V2 = "Casual"
TENDENCIES = [(4.8, "Always Positive"), (4.0, "Mostly Positive"), (3.0, "Balanced")]
LOWEST_TENDENCY = "Critical"
NO_REORDER = "No Reorder"
SEASONS = {"Spring": [3, 4, 5], "Summer": [6, 7, 8], "Fall": [9, 10, 11], "Winter": [12, 1, 2]}
NEW_PRODUCT_DAYS = 30
PROMO_DAYS = 7
PROMO_RULES = [
    ("event_type", ["리뷰", "review"], "리뷰이벤트"),
    ("description", ["할인", "sale"], "할인"),
    ("description", ["증정", "gift"], "증정"),
    ("event_type", ["구매"], "구매이벤트"),
]
OTHER_PROMO = "기타"
NO_PROMO = "프로모션 기간 아님"


def text_length(text: str | Column = "text") -> Column:
    return F.length(F.coalesce(col(text), F.lit("")))


def with_length(reviews: DataFrame, classes=LENGTH_CLASSES, longest: str = LONGEST_CLASS) -> DataFrame:
    return reviews.withColumn("review_length", text_length()).withColumn(
        "review_length_category", steps_below("review_length", classes, longest, inclusive=False)
    )


def length_bin(length: str | Column, bins=LENGTH_BINS, longest: str = LONGEST_BIN) -> Column:
    """Right-closed bins that start above 0; an empty text belongs to none."""
    return F.when(col(length) > 0, steps_below(length, bins, longest))


def starts_with_word(text: str | Column = "text", word: str = REORDER_WORD) -> Column:
    return F.ltrim(F.coalesce(F.regexp_replace(col(text), r"^\s+", ""), F.lit(""))).startswith(word)


def reorder_by_pattern(text: str | Column = "text", prefixes: Sequence[str] = REORDER_PREFIXES) -> Column:
    """Any reorder prefix within the first ten characters, case ignored; NULL text is false."""
    head = F.regexp_replace(F.substring(col(text), 1, 10), r"^\s+", "")
    return F.coalesce(head.rlike("(?iu)^(?:" + "|".join(prefixes) + ")"), F.lit(False))


def strip_reorder_tag(reviews: DataFrame, tags: Sequence[str] = REORDER_TAGS, out: str = "text_cleaned") -> DataFrame:
    """Remove the tags one after the other, trim, and drop reviews with nothing left."""
    cleaned = F.col("text")
    for tag in tags:
        cleaned = F.regexp_replace(cleaned, tag, "")
    return reviews.withColumn(out, F.regexp_replace(cleaned, r"^\s+|\s+$", "")).where(F.length(out) > 0)


def with_user_activity(
    reviews: DataFrame, levels=ACTIVITY_LEVELS, top: str = TOP_ACTIVITY, out: str = "user_activity_level"
) -> DataFrame:
    """Reviews per user and the activity level.

    Counts are pre-aggregated and joined back; a window over the user would sort the busiest user's
    rows in one task, while a skewed join can be split at run time.
    """
    counts = reviews.groupBy("user_id").agg(F.count(F.lit(1)).alias("user_total_reviews"))
    return null_safe_join(reviews, counts, ["user_id"]).withColumn(out, steps_below("user_total_reviews", levels, top))


def activity_level_v2(count: str | Column, levels=ACTIVITY_LEVELS_V2, lowest: str = LOWEST_ACTIVITY_V2) -> Column:
    return steps_above(count, levels, lowest)


def user_tendency(reviews: DataFrame) -> DataFrame:
    """Mean rating of a user's reorder reviews and the tendency class, one row per user."""
    means = reviews.groupBy("user_id").agg(F.avg(F.when(F.col("is_reorder"), F.col("rating"))).alias("user_avg_rating_reorder"))
    tendency = F.when(F.col("user_avg_rating_reorder").isNull(), NO_REORDER).otherwise(
        steps_above("user_avg_rating_reorder", TENDENCIES, LOWEST_TENDENCY)
    )
    return means.withColumn("user_rating_tendency", tendency)


def with_tendency(reviews: DataFrame) -> DataFrame:
    return null_safe_join(reviews, user_tendency(reviews), ["user_id"])


def with_repurchase(reviews: DataFrame, products: DataFrame) -> DataFrame:
    """Among a user's reorder reviews, does the brand (the category) occur at least twice?

    The repeated brands and categories of a user are one row, so that reviews are joined once.
    """
    placed = reviews.join(products.select("product_code", "brand", "category_2"), "product_code", "left")
    both = placed.where("is_reorder").groupBy("user_id", "brand", "category_2").agg(F.count(F.lit(1)).alias("_n"))
    # values are held in structs, so that a list finds NULL like any other
    kinds = F.array(*[F.struct(F.lit(k == "brand").alias("b"), F.col(k).alias("v")) for k in ("brand", "category_2")])
    kept = both.select("user_id", "_n", F.explode(kinds).alias("_k")).groupBy("user_id", "_k.b", "_k.v").agg(F.sum("_n").alias("_n")).where("_n > 1")
    lists = [F.collect_list(F.when(F.col("b") == b, F.struct("v"))).alias(name) for b, name in ((True, "_brands"), (False, "_categories"))]
    out = null_safe_join(placed, kept.groupBy("user_id").agg(*lists), ["user_id"])
    for key, name, found in (("brand", "is_brand_repurchase", "_brands"), ("category_2", "is_category_repurchase", "_categories")):
        again = F.coalesce(F.array_contains(found, F.struct(F.col(key).alias("v"))), F.lit(False))
        out = out.withColumn(name, F.when(F.col("is_reorder") & again, 1).otherwise(0))
    return out.drop("_brands", "_categories")


def season_of(month: str | Column, seasons: dict[str, list[int]] = SEASONS) -> Column:
    out = F
    for name, months in seasons.items():
        out = out.when(col(month).isin(months), F.lit(name))
    return out.otherwise(F.lit(None).cast("string"))


def with_calendar(reviews: DataFrame, date: str = "date") -> DataFrame:
    return reviews.withColumns(
        {
            "year": F.year(date),
            "month": F.month(date),
            "day_of_week": F.weekday(date),
            "day_name": F.date_format(date, "EEEE"),
            "season": season_of(F.month(date)),
        }
    )


def with_product_age(reviews: DataFrame, new_days: int = NEW_PRODUCT_DAYS) -> DataFrame:
    first = reviews.groupBy("product_code").agg(F.min("date").alias("first_review_date"))
    return (
        null_safe_join(reviews, first, ["product_code"])
        .withColumn("days_since_first_review", F.datediff("date", "first_review_date"))
        .withColumn("is_new_product", F.col("days_since_first_review") <= new_days)
    )


def promo_type(rules=PROMO_RULES, other: str = OTHER_PROMO) -> Column:
    out = F
    for field, words, label in rules:
        low = F.lower(F.coalesce(F.col(field), F.lit("")))
        hit = low.contains(words[0])
        for w in words[1:]:
            hit = hit | low.contains(w)
        out = out.when(hit, F.lit(label))
    return out.otherwise(F.lit(other))


def with_promo_type(promos: DataFrame) -> DataFrame:
    return promos.withColumn("promo_type_category", promo_type())


def expand_promo_days(promos: DataFrame, days: int = PROMO_DAYS) -> DataFrame:
    """One row per promotion and day, so that the date range match becomes an equi-join."""
    return promos.withColumn("promo_date", F.explode(F.sequence("date", F.date_add("date", days))))


def with_promo(
    reviews: DataFrame,
    products: DataFrame,
    promos: DataFrame,
    days: int = PROMO_DAYS,
    priority: Sequence[str] = ("promotion_id",),
    everyone: str = "-",
) -> DataFrame:
    """Brand promotion on the review date, else a promotion for all brands, else none.

    Each side is reduced to one row per key first, the earliest in ``priority``, so no review is doubled.
    """
    spread = expand_promo_days(with_promo_type(promos), days).select(
        "promo_date", F.col("brand").alias("promo_brand"), "promo_type_category", *priority
    )
    shared = keep_first(spread.where(F.col("promo_brand") == everyone), ["promo_date"], priority).select(
        F.col("promo_date").alias("date"), F.col("promo_type_category").alias("_shared")
    )
    own = keep_first(spread.where(F.col("promo_brand") != everyone), ["promo_date", "promo_brand"], priority).select(
        F.col("promo_date").alias("date"), F.col("promo_brand").alias("brand"), F.col("promo_type_category").alias("_own")
    )
    brands = products.select("product_code", "brand")
    return (
        reviews.join(brands, "product_code", "left")
        .join(shared, "date", "left")
        .join(own, ["date", "brand"], "left")
        .withColumn("promo_type_category", F.coalesce("_own", "_shared", F.lit(NO_PROMO)))
        .withColumn("is_during_promo", F.col("promo_type_category") != NO_PROMO)
        .drop("_own", "_shared")
    )


#: Levels of day intervals: 2^20 days are longer than any promotion.
LEVELS = 20


def day_number(day: str | Column) -> Column:
    """Days since a day before all others, so that no interval is cut at zero."""
    return (F.unix_date(day) + (1 << 21)).cast("long")


def range_pieces(promos: DataFrame) -> DataFrame:
    """Every promotion as whole day intervals of 1, 2, 4, ... days: ``_level`` and ``_block``.

    Two intervals a level at most, so a promotion has as many rows as its length has binary digits, twice. A range
    whose end is before its start covers the days between both.
    """
    first, last = F.least("start_date", "end_date"), F.greatest("start_date", "end_date")
    known = promos.where(F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
    level = known.withColumns({"_from": day_number(first), "_to": day_number(last) + 1}).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    # the next interval of a level on either side of what larger ones can cover
    low = level.withColumns({"_low": F.expr("(_from + shiftleft(1L, _level) - 1) >> _level"), "_high": F.expr("_to >> _level")}).where("_low < _high")
    ends = F.array(F.when(F.col("_low") % 2 == 1, F.col("_low")), F.when(F.col("_high") % 2 == 1, F.col("_high") - 1))
    return low.withColumn("_block", F.explode(F.filter(ends, lambda b: b.isNotNull()))).drop("_from", "_to", "_low", "_high")


def with_promo_range(
    reviews: DataFrame, products: DataFrame, promos: DataFrame, priority: Sequence[str] = ("promotion_id",), everyone: str = "-"
) -> DataFrame:
    """Range form: promotions carry start_date and end_date, both included; matched as ``with_promo`` matches days.

    Ranges and dates meet by equality: a promotion stands for the day intervals it is made of, a date for those it
    lies in, one of each length. Only the different dates and brands of the reviews are looked up.
    """
    pieces = range_pieces(with_promo_type(promos)).select("_level", "_block", F.col("brand").alias("promo_brand"), "promo_type_category", *priority)
    placed = reviews.join(products.select("product_code", "brand"), "product_code", "left")

    def met(asked: DataFrame, by: Sequence[str], rows: DataFrame, name: str) -> DataFrame:
        levels = asked.where(F.col("date").isNotNull()).withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
        blocks = levels.withColumn("_block", F.expr(f"({1 << 21} + unix_date(date)) >> _level").cast("long"))
        joined = blocks.join(rows, ["_level", "_block", *by[1:]])
        # the earliest in priority
        best = joined.groupBy(*by).agg(F.min_by("promo_type_category", F.struct(*priority)).alias(name))
        return best

    dates = placed.select("date").distinct()
    shared = met(dates, ["date"], pieces.where(F.col("promo_brand") == everyone).drop("promo_brand"), "_shared")
    brands = placed.select("date", "brand").distinct()
    own = met(brands, ["date", "brand"], pieces.where(F.col("promo_brand") != everyone).withColumnRenamed("promo_brand", "brand"), "_own")
    return (
        placed.join(shared, "date", "left")
        .join(own, ["date", "brand"], "left")
        .withColumn("promo_type_category", F.coalesce("_own", "_shared", F.lit(NO_PROMO)))
        .withColumn("is_during_promo", F.col("promo_type_category") != NO_PROMO)
        .drop("_own", "_shared")
    )


def with_promo_day(reviews: DataFrame, promos: DataFrame) -> DataFrame:
    """Plain flag: a promotion starts on the review date."""
    days = promos.select(F.col("date").alias("_day")).distinct()
    return (
        reviews.join(days, F.col("date") == F.col("_day"), "left")
        .withColumn("is_promo_day", F.col("_day").isNotNull())
        .drop("_day")
    )


def in_window(reviews: DataFrame, start: str, end: str) -> DataFrame:
    """Analysis window, both ends included; a plain predicate, so partitions and row groups are pruned."""
    return reviews.where(F.col("date").between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def until_last_days(reviews: DataFrame, days: int) -> DataFrame:
    """Reviews of the last ``days`` days of the data."""
    last = reviews.agg(F.max("date").alias("_last"))
    return with_row(reviews, last).where(F.col("date") > F.date_sub("_last", days)).drop("_last")
