"""Review, reviewer, calendar and promotion feature queries (RF*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshelf.catalog.registry import query, rounded
from loomshelf.operators import review_features as rf
from loomshelf.sources import views as v
from loomshelf.sources.views import with_views

KEY = ["order_key", "line_no", "product_code", "supplier_key", "quantity"]
KEYS = ", ".join(KEY)
# Words that open texts in the supplied corpus, in place of the shop's own reorder word.
OPENING_WORD = "The"
OPENINGS = ["the", "la", r"\(?les?", "d.?e"]
OPENING_TAGS = [r"^The\s*[\|:]?\s*", r"^\[The\]\s*", r"^La\s+"]


@query(
    "rf1_review_length",
    with_views(
        """SELECT order_id, CAST(length(coalesce(text, '')) AS INTEGER) AS review_length,
        CASE WHEN length(text) < 20 THEN 'Very Short' WHEN length(text) < 50 THEN 'Short'
             WHEN length(text) < 100 THEN 'Medium' ELSE 'Long' END AS review_length_category FROM doc_reviews""",
        "doc_reviews",
    ),
)
def rf1(spark, sf):
    return rf.with_length(v.doc_reviews(spark, sf)).select("order_id", "review_length", "review_length_category")


@query(
    "rf2_length_bins",
    with_views(
        """SELECT CASE WHEN n <= 0 THEN NULL WHEN n <= 50 THEN '0-50' WHEN n <= 100 THEN '51-100' WHEN n <= 200 THEN '101-200'
        WHEN n <= 500 THEN '201-500' WHEN n <= 1000 THEN '501-1000' ELSE '1000+' END AS length_category, count(*) AS n_reviews
        FROM (SELECT length(text) AS n FROM doc_reviews) GROUP BY 1""",
        "doc_reviews",
    ),
)
def rf2(spark, sf):
    binned = v.doc_reviews(spark, sf).select(rf.length_bin(rf.text_length()).alias("length_category"))
    return binned.groupBy("length_category").agg(F.count(F.lit(1)).alias("n_reviews"))


@query(
    "rf3_reorder_word",
    with_views(
        f"SELECT order_id, starts_with(regexp_replace(text, '^\\s+', ''), '{OPENING_WORD}') AS is_reorder FROM doc_reviews",
        "doc_reviews",
    ),
)
def rf3(spark, sf):
    return v.doc_reviews(spark, sf).select("order_id", rf.starts_with_word("text", OPENING_WORD).alias("is_reorder"))


@query(
    "rf4_reorder_pattern",
    with_views(
        f"""SELECT order_id, regexp_matches(regexp_replace(substr(text, 1, 10), '^\\s+', ''), '(?i)^(?:{"|".join(OPENINGS)})') AS is_reorder
        FROM doc_reviews""",
        "doc_reviews",
    ),
)
def rf4(spark, sf):
    return v.doc_reviews(spark, sf).select("order_id", rf.reorder_by_pattern("text", OPENINGS).alias("is_reorder"))


def _nested(expr: str, tags) -> str:
    for tag in tags:
        expr = f"regexp_replace({expr}, '{tag}', '')"
    return expr


@query(
    "rf5_strip_reorder_tag",
    with_views(
        f"""SELECT * FROM (SELECT order_id, regexp_replace({_nested("text", OPENING_TAGS)}, '^\\s+|\\s+$', '', 'g') AS text_cleaned FROM doc_reviews)
        WHERE length(text_cleaned) > 0""",
        "doc_reviews",
    ),
)
def rf5(spark, sf):
    return rf.strip_reorder_tag(v.doc_reviews(spark, sf), OPENING_TAGS).select("order_id", "text_cleaned")


@query(
    "rf6_user_activity",
    with_views(
        f"""SELECT {KEYS}, n AS user_total_reviews, CASE WHEN n <= 1 THEN 'Newbie' WHEN n <= 5 THEN 'Junior'
        WHEN n <= 20 THEN 'Regular' ELSE 'VIP' END AS user_activity_level
        FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM reviews)""",
        "reviews",
    ),
)
def rf6(spark, sf):
    return rf.with_user_activity(v.reviews(spark, sf)).select(*KEY, "user_total_reviews", "user_activity_level")


@query(
    "rf7_user_activity_v2",
    with_views(
        """SELECT user_id, n AS user_total_reviews, CASE WHEN n >= 20 THEN 'Very Active' WHEN n >= 10 THEN 'Active'
        WHEN n >= 5 THEN 'Moderate' ELSE 'Casual' END AS user_activity_level
        FROM (SELECT user_id, count(*) AS n FROM reviews GROUP BY 1)""",
        "reviews",
    ),
)
def rf7(spark, sf):
    counts = v.reviews(spark, sf).groupBy("user_id").agg(F.count(F.lit(1)).alias("user_total_reviews"))
    return counts.withColumn("user_activity_level", rf.activity_level_v2("user_total_reviews"))


@query(
    "rf8_rating_tendency",
    with_views(
        """SELECT user_id, round(m, 8) AS user_avg_rating_reorder, CASE WHEN m IS NULL THEN 'No Reorder' WHEN m >= 4.8 THEN 'Always Positive'
        WHEN m >= 4.0 THEN 'Mostly Positive' WHEN m >= 3.0 THEN 'Balanced' ELSE 'Critical' END AS user_rating_tendency
        FROM (SELECT user_id, avg(rating) FILTER (is_reorder) AS m FROM reviews GROUP BY 1)""",
        "reviews",
    ),
)
def rf8(spark, sf):
    return rounded(rf.user_tendency(v.reviews(spark, sf)), "user_avg_rating_reorder")


@query(
    "rf8_reviews_by_tendency",
    with_views(
        """SELECT CASE WHEN m IS NULL THEN 'No Reorder' WHEN m >= 4.8 THEN 'Always Positive'
        WHEN m >= 4.0 THEN 'Mostly Positive' WHEN m >= 3.0 THEN 'Balanced' ELSE 'Critical' END AS user_rating_tendency, count(*) AS n_reviews
        FROM (SELECT user_id, avg(CASE WHEN is_reorder THEN rating END) OVER (PARTITION BY user_id) AS m FROM reviews) GROUP BY 1""",
        "reviews",
    ),
)
def rf8b(spark, sf):
    return rf.with_tendency(v.reviews(spark, sf)).groupBy("user_rating_tendency").agg(F.count(F.lit(1)).alias("n_reviews"))


@query(
    "rf9_repurchase_flags",
    with_views(
        f"""SELECT {KEYS},
        CASE WHEN is_reorder AND count(*) FILTER (is_reorder) OVER (PARTITION BY user_id, brand) > 1 THEN 1 ELSE 0 END AS is_brand_repurchase,
        CASE WHEN is_reorder AND count(*) FILTER (is_reorder) OVER (PARTITION BY user_id, category_2) > 1 THEN 1 ELSE 0 END AS is_category_repurchase
        FROM reviews LEFT JOIN (SELECT product_code, brand, category_2 FROM products) USING (product_code)""",
        "products",
        "reviews",
    ),
)
def rf9(spark, sf):
    d = rf.with_repurchase(v.reviews(spark, sf), v.products(spark, sf))
    return d.select(*KEY, "is_brand_repurchase", "is_category_repurchase")


SEASON_SQL = """CASE WHEN month(date) IN (3,4,5) THEN 'Spring' WHEN month(date) IN (6,7,8) THEN 'Summer'
WHEN month(date) IN (9,10,11) THEN 'Fall' ELSE 'Winter' END"""


@query(
    "rf10_calendar",
    with_views(
        f"""SELECT date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
        dayname(date) AS day_name, {SEASON_SQL} AS season, count(*) AS n_reviews FROM reviews GROUP BY ALL""",
        "reviews",
    ),
)
def rf10(spark, sf):
    d = rf.with_calendar(v.reviews(spark, sf))
    return d.groupBy("date", "year", "month", "day_of_week", "day_name", "season").agg(F.count(F.lit(1)).alias("n_reviews"))


@query(
    "rf11_product_age",
    with_views(
        f"""SELECT {KEYS}, f AS first_review_date, CAST(date_diff('day', f, date) AS INTEGER) AS days_since_first_review,
        date_diff('day', f, date) <= 30 AS is_new_product
        FROM (SELECT *, min(date) OVER (PARTITION BY product_code) AS f FROM reviews)""",
        "reviews",
    ),
)
def rf11(spark, sf):
    d = rf.with_product_age(v.reviews(spark, sf))
    return d.select(*KEY, "first_review_date", "days_since_first_review", "is_new_product")


PROMO_SQL = """SELECT *, CASE WHEN contains(lower(event_type), '리뷰') OR contains(lower(event_type), 'review') THEN '리뷰이벤트'
WHEN contains(lower(description), '할인') OR contains(lower(description), 'sale') THEN '할인'
WHEN contains(lower(description), '증정') OR contains(lower(description), 'gift') THEN '증정'
WHEN contains(lower(event_type), '구매') THEN '구매이벤트' ELSE '기타' END AS promo_type_category FROM promotions"""
SPREAD_SQL = "SELECT promotion_id, brand, promo_type_category, date + CAST(d AS INTEGER) AS promo_date FROM typed, range(0, 8) t(d)"


@query("rf12_promo_type", with_views("SELECT promotion_id, promo_type_category FROM typed", "promotions", typed=PROMO_SQL))
def rf12(spark, sf):
    return rf.with_promo_type(v.promotions(spark, sf)).select("promotion_id", "promo_type_category")


@query(
    "rf13_promo_days",
    with_views("SELECT promotion_id, brand, promo_date FROM spread", "promotions", typed=PROMO_SQL, spread=SPREAD_SQL),
)
def rf13(spark, sf):
    return rf.expand_promo_days(v.promotions(spark, sf)).select("promotion_id", "brand", "promo_date")


PROMO_MATCH = f"""SELECT {KEYS}, coalesce(o.t, s.t, '프로모션 기간 아님') AS promo_type_category, coalesce(o.t, s.t) IS NOT NULL AS is_during_promo
FROM reviews LEFT JOIN (SELECT product_code AS pc, brand FROM products) p ON p.pc = product_code
LEFT JOIN (SELECT promo_date, arg_min(promo_type_category, promotion_id) AS t FROM spread WHERE brand = '-' GROUP BY 1) s ON s.promo_date = date
LEFT JOIN (SELECT promo_date, brand, arg_min(promo_type_category, promotion_id) AS t FROM spread WHERE brand <> '-' GROUP BY 1, 2) o
  ON o.promo_date = date AND o.brand = p.brand"""


@query("rf14_promo_match", with_views(PROMO_MATCH, "products", "reviews", "promotions", typed=PROMO_SQL, spread=SPREAD_SQL))
def rf14(spark, sf):
    d = rf.with_promo(v.reviews(spark, sf), v.products(spark, sf), v.promotions(spark, sf))
    return d.select(*KEY, "promo_type_category", "is_during_promo")


@query(
    "rf14_promo_range_match",
    with_views(
        """SELECT promo_type_category, count(*) AS n_reviews FROM (""" + PROMO_MATCH + ") GROUP BY 1",
        "products",
        "reviews",
        "promotions",
        typed=PROMO_SQL,
        spread=SPREAD_SQL,
    ),
)
def rf14_range(spark, sf):
    ranged = v.promotions(spark, sf).withColumn("start_date", F.col("date")).withColumn("end_date", F.date_add("date", 7))
    d = rf.with_promo_range(v.reviews(spark, sf), v.products(spark, sf), ranged.drop("date"))
    return d.groupBy("promo_type_category").agg(F.count(F.lit(1)).alias("n_reviews"))


@query(
    "rf15_promo_day",
    with_views(
        """SELECT is_promo_day, count(*) AS n_reviews, round(avg(rating), 8) AS avg_rating
        FROM (SELECT rating, date IN (SELECT date FROM promotions) AS is_promo_day FROM reviews) GROUP BY 1""",
        "reviews",
        "promotions",
    ),
)
def rf15(spark, sf):
    d = rf.with_promo_day(v.reviews(spark, sf), v.promotions(spark, sf)).groupBy("is_promo_day")
    return rounded(d.agg(F.count(F.lit(1)).alias("n_reviews"), F.avg("rating").alias("avg_rating")), "avg_rating")


@query(
    "rf16_date_window",
    with_views(
        f"SELECT {KEYS}, date FROM reviews WHERE date BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'", "reviews"
    ),
)
def rf16(spark, sf):
    return rf.in_window(v.reviews(spark, sf), "1997-01-01", "1998-12-31").select(*KEY, "date")
