"""Aggregation (AG*) and reorder/quadrant/concentration (QA*) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshelf.catalog.features import scored, stack
from loomshelf.catalog.registry import query, rounded
from loomshelf.functions import significance as sig
from loomshelf.operators import aggregates as ag
from loomshelf.operators import product_features as pf
from loomshelf.operators import reorder as qa
from loomshelf.operators import review_features as rf
from loomshelf.sources import tables
from loomshelf.sources import views as v
from loomshelf.sources.views import with_views

PR = ("products", "reviews")


def doc_lengths(spark, sf):
    return v.doc_reviews(spark, sf).select("order_id", "rating", "lang", rf.text_length().alias("review_length"))


def describe_sql(col: str, src: str) -> str:
    return f"""SELECT '{col}' AS metric, count({col}) AS count, round(avg({col}), 8) AS mean, round(stddev_samp({col}), 8) AS std,
    round(CAST(min({col}) AS DOUBLE), 8) AS min, round(CAST(max({col}) AS DOUBLE), 8) AS max, round(quantile_cont({col}, 0.25), 8) AS q25,
    round(quantile_cont({col}, 0.5), 8) AS median, round(quantile_cont({col}, 0.75), 8) AS q75 FROM {src}"""


DESCRIBED = ("mean", "std", "min", "max", "q25", "median", "q75")


@query("ag1_describe", with_views(f"{describe_sql('engagement_score', 'scored')} UNION ALL {describe_sql('price', 'scored')}", *PR, **stack("scored")))
def ag1(spark, sf):
    d = scored(spark, sf)
    both = ag.describe(d, "engagement_score").unionByName(ag.describe(d, "price", small_domain=True))
    return rounded(both, *DESCRIBED)


@query(
    "ag2_group_stats",
    with_views(
        """SELECT category_1, round(avg(price), 8) AS mean, round(quantile_cont(price, 0.5), 8) AS median,
        round(stddev_samp(price), 8) AS std, count(price) AS count FROM products GROUP BY 1""",
        "products",
    ),
)
def ag2(spark, sf):
    return rounded(ag.group_stats(v.products(spark, sf), "category_1", "price"), "mean", "median", "std")


@query(
    "ag3_moments",
    with_views(
        """SELECT 'engagement_score' AS metric, count(*) AS count, round(skewness(engagement_score), 8) AS skewness,
        round(kurtosis(engagement_score), 8) AS kurtosis FROM scored""",
        *PR,
        **stack("scored"),
    ),
)
def ag3(spark, sf):
    return rounded(ag.moments(scored(spark, sf), "engagement_score"), "skewness", "kurtosis")


@query(
    "ag4_correlation",
    with_views(
        """SELECT 'likes' AS "left", 'review_count' AS "right", round(corr(likes, review_count), 8) AS corr FROM scored
        UNION ALL SELECT 'price', 'engagement_score', round(corr(price, engagement_score), 8) FROM scored""",
        *PR,
        **stack("scored"),
    ),
)
def ag4(spark, sf):
    d = scored(spark, sf)
    return rounded(ag.correlation(d, "likes", "review_count").unionByName(ag.correlation(d, "price", "engagement_score")), "corr")


@query(
    "ag5_brand_means",
    with_views(
        """SELECT brand, round(avg(engagement_score), 8) AS mean, count(*) AS n_products FROM scored GROUP BY 1
        HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 20""",
        *PR,
        **stack("scored"),
    ),
)
def ag5(spark, sf):
    d = rounded(ag.brand_means(scored(spark, sf), "engagement_score", 5), "mean")
    return pf.top_n(d, "mean", 20, ["brand"])


@query(
    "ag6_length_by_rating",
    with_views("SELECT rating, round(avg(length(text)), 8) AS mean, count(*) AS n FROM doc_reviews GROUP BY 1", "doc_reviews"),
)
def ag6(spark, sf):
    return rounded(ag.mean_by(doc_lengths(spark, sf), "rating", "review_length"), "mean")


@query(
    "ag7_trimmed",
    with_views(
        """SELECT order_id, CAST(length(text) AS INTEGER) AS review_length FROM doc_reviews
        WHERE length(text) <= (SELECT quantile_cont(length(text), 0.99) FROM doc_reviews)""",
        "doc_reviews",
    ),
)
def ag7(spark, sf):
    return ag.trimmed(doc_lengths(spark, sf), "review_length").select("order_id", "review_length")


@query(
    "ag8_reorder_share",
    with_views(
        "SELECT count(*) AS n, count(*) FILTER (is_reorder) AS n_true, round(avg(is_reorder::INTEGER), 8) AS share FROM reviews", "reviews"
    ),
)
def ag8(spark, sf):
    return rounded(ag.flag_share(v.reviews(spark, sf), "is_reorder"), "share")


PROFILE = """SELECT user_id, count(*) AS review_count, avg(rating) AS avg_rating, avg(is_reorder::INTEGER) AS reorder_rate,
avg(image_count) AS avg_review_length FROM reviews GROUP BY 1"""


@query(
    "ag9_user_profiles",
    with_views(
        """SELECT user_id, review_count, round(avg_rating, 8) AS avg_rating, round(reorder_rate, 8) AS reorder_rate,
        round(avg_review_length, 8) AS avg_review_length FROM profiles""",
        "reviews",
        profiles=PROFILE,
    ),
)
def ag9(spark, sf):
    d = ag.user_profiles(v.reviews(spark, sf), F.col("image_count"))
    return rounded(d, "avg_rating", "reorder_rate", "avg_review_length")


@query(
    "ag10_heavy_users",
    with_views(
        """SELECT CASE WHEN review_count >= 40 THEN 'heavy' ELSE 'normal' END AS segment, count(*) AS n_users,
        round(avg(review_count), 8) AS mean_reviews, round(avg(avg_rating), 8) AS mean_rating,
        round(avg(reorder_rate), 8) AS mean_reorder_rate FROM profiles GROUP BY 1""",
        "reviews",
        profiles=PROFILE,
    ),
)
def ag10(spark, sf):
    d = ag.heavy_vs_normal(ag.user_profiles(v.reviews(spark, sf)), heavy_from=40)
    return rounded(d, "mean_reviews", "mean_rating", "mean_reorder_rate")


@query("ag11_top_users", with_views("SELECT user_id, count(*) AS review_count FROM reviews GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20", "reviews"))
def ag11(spark, sf):
    return ag.top_users(v.reviews(spark, sf))


SUMMARY = """SELECT p.*, n_reviews, avg_rating, std_rating, reorder_rate, total_images FROM scored p LEFT JOIN (
SELECT product_code, count(*) AS n_reviews, avg(rating) AS avg_rating, stddev_samp(rating) AS std_rating,
count(*) FILTER (is_reorder) / count(*) AS reorder_rate, CAST(sum(image_count) AS BIGINT) AS total_images FROM reviews GROUP BY 1) USING (product_code)"""


def summary(spark, sf):
    return ag.product_summary(scored(spark, sf), v.reviews(spark, sf))


@query(
    "ag12_product_summary",
    with_views(
        """SELECT product_code, n_reviews, round(avg_rating, 8) AS avg_rating, round(std_rating, 8) AS std_rating,
        round(reorder_rate, 8) AS reorder_rate, total_images FROM summary""",
        *PR,
        **stack("scored"),
        summary=SUMMARY,
    ),
)
def ag12(spark, sf):
    d = ag.product_summary(v.products(spark, sf), v.reviews(spark, sf))
    return rounded(
        d.select("product_code", "n_reviews", "avg_rating", "std_rating", "reorder_rate", "total_images"),
        "avg_rating",
        "std_rating",
        "reorder_rate",
    )


@query(
    "ag12_with_without_reviews",
    with_views(
        "SELECT count(n_reviews) AS with_reviews, count(*) - count(n_reviews) AS without_reviews FROM summary",
        *PR,
        **stack("scored"),
        summary=SUMMARY,
    ),
)
def ag12b(spark, sf):
    return ag.with_without_reviews(ag.product_summary(v.products(spark, sf), v.reviews(spark, sf)))


@query(
    "ag13_well_rated",
    with_views(
        """SELECT product_code, n_reviews, round(avg_rating, 8) AS avg_rating FROM summary
        WHERE avg_rating >= 4.2 AND n_reviews >= 30 ORDER BY n_reviews DESC, product_code LIMIT 10""",
        *PR,
        **stack("scored"),
        summary=SUMMARY,
    ),
)
def ag13(spark, sf):
    d = ag.well_rated(ag.product_summary(v.products(spark, sf), v.reviews(spark, sf)), 4.2, 30)
    return rounded(d.select("product_code", "n_reviews", "avg_rating"), "avg_rating")


@query(
    "ag13_often_reordered",
    with_views(
        """SELECT product_code, n_reviews, round(reorder_rate, 8) AS reorder_rate FROM summary
        WHERE reorder_rate >= 0.3 AND n_reviews >= 20 ORDER BY summary.reorder_rate DESC, product_code LIMIT 10""",
        *PR,
        **stack("scored"),
        summary=SUMMARY,
    ),
)
def ag13b(spark, sf):
    d = ag.often_reordered(ag.product_summary(v.products(spark, sf), v.reviews(spark, sf)), 0.3, 20)
    return rounded(d.select("product_code", "n_reviews", "reorder_rate"), "reorder_rate")


ACTIVE = """SELECT r.*, CASE WHEN n >= 45 THEN 'Very Active' WHEN n >= 40 THEN 'Active' WHEN n >= 35 THEN 'Moderate' ELSE 'Casual' END AS level
FROM reviews r JOIN (SELECT user_id, count(*) AS n FROM reviews GROUP BY 1) USING (user_id)"""


def active(spark, sf):
    reviews = v.reviews(spark, sf)
    levels = [(45, "Very Active"), (40, "Active"), (35, "Moderate")]
    d = rf.with_user_activity(reviews)
    return d.withColumn("level", rf.activity_level_v2("user_total_reviews", levels))


@query(
    "ag14_low_ratings_by_activity",
    with_views(
        """SELECT level, count(*) FILTER (rating <= 3) AS n_low, round(avg((rating <= 3)::INTEGER), 8) AS low_share, count(*) AS n_total
        FROM active GROUP BY 1""",
        "reviews",
        active=ACTIVE,
    ),
)
def ag14(spark, sf):
    return rounded(ag.low_ratings_by(active(spark, sf), "level"), "low_share")


@query(
    "ag15_rating_pivot",
    with_views(
        "SELECT level, " + ", ".join(f"count(*) FILTER (rating = {i}) AS rating_{i}" for i in (1, 2, 3)) + " FROM active GROUP BY 1",
        "reviews",
        active=ACTIVE,
    ),
)
def ag15(spark, sf):
    return ag.rating_pivot(active(spark, sf), "level")


@query(
    "ag16_star_shares",
    with_views(
        """SELECT level, round(100 * avg((rating = 5)::INTEGER), 8) AS top_pct, round(100 * avg((rating <= 3)::INTEGER), 8) AS low_pct,
        round(avg(rating), 8) AS mean_rating FROM active GROUP BY 1""",
        "reviews",
        active=ACTIVE,
    ),
)
def ag16(spark, sf):
    return rounded(ag.star_shares(active(spark, sf), "level"), "top_pct", "low_pct", "mean_rating")


@query(
    "ag17_two_metric_outliers",
    with_views(
        """, d AS (SELECT *, CASE WHEN likes = 0 THEN 0.0::DOUBLE ELSE review_count / likes END AS review_density FROM scored),
        q AS (SELECT quantile_cont(engagement_score, 0.25) AS a25, quantile_cont(engagement_score, 0.75) AS a75,
                     quantile_cont(review_density, 0.25) AS b25, quantile_cont(review_density, 0.75) AS b75 FROM d)
        SELECT * FROM (SELECT product_code,
          CASE WHEN engagement_score > a75 AND review_density < b25 THEN 'high engagement_score, low review_density'
               WHEN engagement_score < a25 AND review_density > b75 THEN 'low engagement_score, high review_density' END AS outlier_kind
        FROM d, q) WHERE outlier_kind IS NOT NULL""",
        *PR,
        **stack("scored"),
    ),
)
def ag17(spark, sf):
    d = pf.with_review_density(scored(spark, sf))
    return ag.two_metric_outliers(d, "engagement_score", "review_density").select("product_code", "outlier_kind")


@query(
    "ag18_like_share_ratio",
    with_views(
        """SELECT brand, round(avg(likes), 8) AS avg_likes, round(avg(shares), 8) AS avg_shares, count(*) AS n_products,
        round(avg(likes) / (avg(shares) + 1), 8) AS like_share_ratio FROM products GROUP BY 1 HAVING count(*) >= 5""",
        "products",
    ),
)
def ag18(spark, sf):
    return rounded(ag.like_share_ratio(v.products(spark, sf)), "avg_likes", "avg_shares", "like_share_ratio")


# the percentage is rounded to two places, halves to even, before it is compared
RATE = "round_even(CAST(reorder_count AS DOUBLE) / n_reviews * 100 * 100, 0) / 100"
REORDER = f"""SELECT *, {RATE} AS reorder_rate FROM products LEFT JOIN (SELECT product_code, count(*) FILTER (is_reorder) AS reorder_count,
count(*) AS n_reviews, avg(rating) AS avg_rating FROM reviews GROUP BY 1) USING (product_code)"""


def reorder(spark, sf):
    return qa.product_reorder(v.products(spark, sf), v.reviews(spark, sf))


@query(
    "ag19_high_vs_low",
    with_views(
        """SELECT CASE WHEN reorder_rate >= 30 THEN 'high reorder' ELSE 'low reorder' END AS segment, count(*) AS n_products,
        round(avg(price), 8) AS mean_price, round(avg(avg_rating), 8) AS mean_rating, round(avg(n_reviews), 8) AS mean_reviews
        FROM reorder WHERE n_reviews >= 20 AND (reorder_rate >= 30 OR reorder_rate < 25) GROUP BY 1""",
        *PR,
        reorder=REORDER,
    ),
)
def ag19(spark, sf):
    enough = F.col("n_reviews") >= 20
    segment = F.when(enough & (F.col("reorder_rate") >= 30), "high reorder").when(enough & (F.col("reorder_rate") < 25), "low reorder")
    return rounded(ag.compare_segments(reorder(spark, sf), segment), "mean_price", "mean_rating", "mean_reviews")


@query(
    "ag20_overview",
    with_views(
        """SELECT * FROM (SELECT count(*) AS n_products, count(DISTINCT category_1) AS n_categories, count(DISTINCT brand) AS n_brands,
        round(avg(price), 8) AS mean_price FROM products), (SELECT count(*) AS n_reviews, round(avg(rating), 8) AS mean_rating,
        round(avg(is_reorder::INTEGER), 8) AS reorder_share, count(DISTINCT user_id) AS n_users, min(date) AS first_date,
        max(date) AS last_date FROM reviews)""",
        *PR,
    ),
)
def ag20(spark, sf):
    return rounded(ag.overview(v.products(spark, sf), v.reviews(spark, sf)), "mean_price", "mean_rating", "reorder_share")


@query(
    "ag21_brand_catalogue",
    with_views("SELECT brand, count(*) OVER (PARTITION BY brand) AS n_products, product_code, name FROM products", "products"),
)
def ag21(spark, sf):
    return ag.brand_catalogue(v.products(spark, sf))


@query(
    "qa1_product_reorder",
    with_views(
        "SELECT product_code, reorder_count, n_reviews, round(avg_rating, 8) AS avg_rating, reorder_rate FROM reorder", *PR, reorder=REORDER
    ),
)
def qa1(spark, sf):
    return rounded(reorder(spark, sf).select("product_code", "reorder_count", "n_reviews", "avg_rating", "reorder_rate"), "avg_rating")


PROFILE_TOPS = """SELECT * FROM (SELECT 'category_2' AS dimension, category_2 AS value, count(*) AS n_products FROM picked GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)
UNION ALL SELECT * FROM (SELECT 'brand' AS dimension, brand AS value, count(*) AS n_products FROM picked GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT 10)"""


@query(
    "qa2_high_reorder_profile",
    with_views(PROFILE_TOPS, *PR, reorder=REORDER, picked="SELECT * FROM reorder WHERE reorder_rate >= 30 AND n_reviews >= 20"),
)
def qa2(spark, sf):
    return qa.profile(qa.high_reorder(reorder(spark, sf)))


SHARE_SQL = """SELECT count(*) AS n_products, round(avg(price), 8) AS mean_price, round(quantile_cont(price, 0.5), 8) AS median_price,
round(avg(avg_rating), 8) AS mean_rating, round(avg(CASE WHEN avg_rating >= 4.0 THEN 100 ELSE 0 END), 8) AS well_rated_pct FROM picked"""


@query(
    "qa2_high_reorder_rating_share",
    with_views(SHARE_SQL, *PR, reorder=REORDER, picked="SELECT * FROM reorder WHERE reorder_rate >= 30 AND n_reviews >= 20"),
)
def qa2b(spark, sf):
    d = qa.rating_share(qa.high_reorder(reorder(spark, sf)), 4.0)
    return rounded(d, "mean_price", "median_price", "mean_rating", "well_rated_pct")


@query(
    "qa3_low_reorder",
    with_views("SELECT product_code, reorder_rate, n_reviews, price, brand, category_2 FROM reorder WHERE reorder_rate < 20 AND n_reviews >= 20", *PR, reorder=REORDER),
)
def qa3(spark, sf):
    d = qa.low_reorder(reorder(spark, sf), below=20)
    return d.select("product_code", "reorder_rate", "n_reviews", "price", "brand", "category_2")


CATEGORY = f"""SELECT *, {RATE} AS reorder_rate, round_even(CAST(reorder_count AS DOUBLE) / n_products * 100 * 100, 0) / 100 / 100 AS avg_reorder_reviews FROM (
SELECT category_2, CAST(sum(reorder_count) AS BIGINT) AS reorder_count, CAST(sum(n_reviews) AS BIGINT) AS n_reviews, count(*) AS n_products
FROM reorder GROUP BY 1) WHERE n_reviews >= 50"""


@query(
    "qa4_category_reorder",
    with_views(
        """SELECT * FROM (SELECT *, 'top' AS "end" FROM category ORDER BY reorder_rate DESC, category_2 LIMIT 15)
        UNION ALL SELECT * FROM (SELECT *, 'bottom' AS "end" FROM category ORDER BY reorder_rate, category_2 LIMIT 15)""",
        *PR,
        reorder=REORDER,
        category=CATEGORY,
    ),
)
def qa4(spark, sf):
    return qa.both_ends(qa.category_reorder(reorder(spark, sf)), "reorder_rate", "category_2")


GROUPED = """SELECT category.*, CASE WHEN reorder_rate >= hi THEN 'high' WHEN reorder_rate >= lo THEN 'mid' ELSE 'low' END AS reorder_group
FROM category, (SELECT quantile_cont(reorder_rate, 0.67) AS hi, quantile_cont(reorder_rate, 0.33) AS lo FROM category)"""


@query(
    "qa5_reorder_groups",
    with_views(
        """SELECT reorder_group, count(*) AS n_categories, round(avg(reorder_rate), 8) AS mean_rate, round(avg(n_reviews), 8) AS mean_reviews,
        round(avg(n_products), 8) AS mean_products FROM grouped GROUP BY 1""",
        *PR,
        reorder=REORDER,
        category=CATEGORY,
        grouped=GROUPED,
    ),
)
def qa5(spark, sf):
    grouped = qa.reorder_groups(qa.category_reorder(reorder(spark, sf)))
    return rounded(qa.reorder_group_stats(grouped), "mean_rate", "mean_reviews", "mean_products")


@query(
    "qa5_group_leaders",
    with_views(
        """SELECT reorder_group, category_2, n_reviews, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY reorder_group
        ORDER BY n_reviews DESC, category_2) AS rn FROM grouped) WHERE rn <= 5""",
        *PR,
        reorder=REORDER,
        category=CATEGORY,
        grouped=GROUPED,
    ),
)
def qa5b(spark, sf):
    grouped = qa.reorder_groups(qa.category_reorder(reorder(spark, sf)))
    return qa.reorder_group_leaders(grouped).select("reorder_group", "category_2", "n_reviews", "rn")


def quadrant_sql(floor: float) -> dict[str, str]:
    return {
        "stats": f"""SELECT product_code, n_reviews, sx / n_reviews AS avg_rating,
        CASE WHEN n_reviews > 1 THEN sqrt((n_reviews::DOUBLE * sxx - sx * sx) / (n_reviews::DOUBLE * (n_reviews::DOUBLE - 1))) END AS std_rating,
        {RATE} AS reorder_rate FROM (SELECT product_code, count(*) AS n_reviews, sum(rating) AS sx, sum(rating * rating) AS sxx,
        count(*) FILTER (is_reorder) AS reorder_count FROM reviews GROUP BY 1) WHERE n_reviews >= 10""",
        "placed": f"""SELECT s.*, p.* EXCLUDE (product_code), CASE WHEN n_reviews < 30 THEN 'insufficient data'
        WHEN avg_rating >= mc AND std_rating >= sc THEN 'Q1: viral' WHEN std_rating >= sc THEN 'Q2: at risk'
        WHEN avg_rating < mc THEN 'Q3: bland' ELSE 'Q4: steady seller' END AS quadrant
        FROM stats s JOIN scored p USING (product_code),
        (SELECT greatest(quantile_cont(avg_rating, 0.5), {floor}::DOUBLE) AS mc, quantile_cont(std_rating, 0.5) AS sc FROM stats)""",
    }


def placed(spark, sf, floor=4.5, engagement=False):
    # one row per product, written once: the reviews are scanned a single time for all quantiles
    stats = tables.settle(qa.rating_stats(v.reviews(spark, sf)), "rating-stats")
    products = scored(spark, sf) if engagement else v.products(spark, sf)
    return qa.rating_quadrants(products, stats, mean_floor=floor)


@query(
    "qa6_rating_quadrants",
    with_views(
        """SELECT product_code, n_reviews, round(avg_rating, 8) AS avg_rating, round(std_rating, 8) AS std_rating, quadrant FROM placed""",
        *PR,
        **stack("scored"),
        **quadrant_sql(4.5),
    ),
)
def qa6(spark, sf):
    d = placed(spark, sf).select("product_code", "n_reviews", "avg_rating", "std_rating", "quadrant")
    return rounded(d, "avg_rating", "std_rating")


@query(
    "qa7_quadrant_leaders",
    with_views(
        """SELECT quadrant, product_code, n_reviews, CAST(rn AS INTEGER) AS rn FROM (SELECT *, row_number() OVER (PARTITION BY quadrant
        ORDER BY n_reviews DESC, product_code) AS rn FROM placed WHERE quadrant <> 'insufficient data') WHERE rn <= 10""",
        *PR,
        **stack("scored"),
        **quadrant_sql(4.0),
    ),
)
def qa7(spark, sf):
    return qa.quadrant_leaders(placed(spark, sf, 4.0)).select("quadrant", "product_code", "n_reviews", "rn")


@query(
    "qa7_quadrant_summary",
    with_views(
        """SELECT quadrant, count(*) AS n_products, round(avg(avg_rating), 8) AS mean_rating, round(avg(std_rating), 8) AS mean_std,
        round(avg(n_reviews), 8) AS mean_reviews, round(avg(price), 8) AS mean_price FROM placed WHERE quadrant <> 'insufficient data' GROUP BY 1""",
        *PR,
        **stack("scored"),
        **quadrant_sql(4.0),
    ),
)
def qa7b(spark, sf):
    return rounded(qa.quadrant_summary(placed(spark, sf, 4.0)), "mean_rating", "mean_std", "mean_reviews", "mean_price")


@query(
    "qa8_true_steady_sellers",
    with_views(
        """SELECT product_code, name, brand, price, n_reviews, round(avg_rating, 8) AS avg_rating, round(std_rating, 8) AS std_rating, reorder_rate
        FROM placed WHERE quadrant = 'Q4: steady seller' AND reorder_rate >= 30""",
        *PR,
        **stack("scored"),
        **quadrant_sql(4.5),
    ),
)
def qa8(spark, sf):
    d = qa.true_steady_sellers(placed(spark, sf))
    cols = ("product_code", "name", "brand", "price", "n_reviews", "avg_rating", "std_rating", "reorder_rate")
    return rounded(d.select(*cols), "avg_rating", "std_rating")


SUBSETS = {"q1": ["Q1: viral"], "q2": ["Q2: at risk"], "q1_q2": ["Q1: viral", "Q2: at risk"]}


def _viral_sql(name: str, quadrants: list[str]) -> str:
    inside = ", ".join(f"'{q}'" for q in quadrants)
    return f"""SELECT '{name}' AS subset, product_code, quadrant, reorder_rate FROM placed, (SELECT quantile_cont(engagement_score, 0.7) AS e,
    quantile_cont(reorder_rate, 0.3) AS r FROM placed WHERE quadrant IN ({inside})) WHERE quadrant IN ({inside}) AND engagement_score >= e AND reorder_rate <= r"""


@query(
    "qa9_viral_products",
    with_views(" UNION ALL ".join(_viral_sql(n, q) for n, q in SUBSETS.items()), *PR, **stack("scored"), **quadrant_sql(4.0)),
)
def qa9(spark, sf):
    # the engagement scores read the reviews again, so the placed products are written once as well
    base = tables.settle(placed(spark, sf, 4.0, engagement=True), "placed")
    hits = qa.viral_products(base, SUBSETS)
    return hits.select("subset", "product_code", "quadrant", "reorder_rate")


@query(
    "qa10_quadrant_engagement",
    with_views(
        """SELECT quadrant, round(avg(engagement_score), 8) AS mean_engagement, round(avg(reorder_rate), 8) AS mean_reorder_rate FROM placed GROUP BY 1""",
        *PR,
        **stack("scored"),
        **quadrant_sql(4.0),
    ),
)
def qa10(spark, sf):
    return rounded(qa.quadrant_engagement(placed(spark, sf, 4.0, engagement=True)), "mean_engagement", "mean_reorder_rate")


SHARES = """SELECT *, sum(pct) OVER (ORDER BY total DESC, brand ROWS UNBOUNDED PRECEDING) AS cum_pct, CAST(row_number() OVER (ORDER BY total DESC, brand) AS INTEGER) AS position
FROM (SELECT *, round_even(CAST(total AS DOUBLE) / sum(total) OVER () * 100 * 100, 0) / 100 AS pct FROM
(SELECT brand, CAST(sum(likes) AS BIGINT) AS total, count(*) AS n_products FROM products GROUP BY 1))"""


@query(
    "qa11_concentration",
    with_views("SELECT brand, total, n_products, pct, round(cum_pct, 8) AS cum_pct, position FROM shares", "products", shares=SHARES),
)
def qa11(spark, sf):
    return rounded(qa.concentration(v.products(spark, sf)), "cum_pct")


@query(
    "qa11_top_shares",
    with_views(
        "SELECT " + ", ".join(f"round(sum(pct) FILTER (position <= {k}), 8) AS top_{k}_pct" for k in (5, 10, 20)) + " FROM shares",
        "products",
        shares=SHARES,
    ),
)
def qa11b(spark, sf):
    return rounded(qa.top_shares(qa.concentration(v.products(spark, sf))), "top_5_pct", "top_10_pct", "top_20_pct")


@query(
    "qa12_hhi",
    with_views(
        """SELECT round(h, 8) AS hhi, CASE WHEN h < 1500 THEN 'competitive' WHEN h < 2500 THEN 'moderate' ELSE 'concentrated' END AS band
        FROM (SELECT sum(pct * pct) AS h FROM shares)""",
        "products",
        shares=SHARES,
    ),
)
def qa12(spark, sf):
    return rounded(qa.hhi(qa.concentration(v.products(spark, sf))), "hhi")


@query(
    "qa13_lorenz",
    with_views(
        """SELECT brand, round(100.0::DOUBLE * row_number() OVER w / count(*) OVER (), 8) AS cum_brands_pct,
        round(100.0::DOUBLE * sum(total) OVER (w ROWS UNBOUNDED PRECEDING) / sum(total) OVER (), 8) AS cum_metric_pct
        FROM shares WINDOW w AS (ORDER BY total, brand)""",
        "products",
        shares=SHARES,
    ),
)
def qa13(spark, sf):
    return rounded(qa.lorenz(v.products(spark, sf)), "cum_brands_pct", "cum_metric_pct")


@query(
    "qa14_anova",
    with_views(
        """, g AS (SELECT level, count(*) AS n, sum(rating) AS s, sum(rating * rating) AS ss FROM active GROUP BY 1),
        t AS (SELECT count(*) AS k, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM g)
        SELECT CAST(k - 1 AS DOUBLE) AS df_between, CAST(n - k AS DOUBLE) AS df_within,
        round(((b - s * s / n) / (k - 1)) / ((ss - b) / (n - k)), 8) AS f_stat FROM t""",
        "reviews",
        active=ACTIVE,
    ),
)
def qa14(spark, sf):
    return rounded(sig.anova(active(spark, sf), "level", "rating", p_value=False), "f_stat")


# p values by Simpson's rule over 20,000 steps
SIMPSON = "CASE WHEN i IN (0, 20000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"


@query(
    "qa14_anova_p_value",
    with_views(
        f""", g AS (SELECT level, count(*) AS n, sum(rating) AS s, sum(rating * rating) AS ss FROM active GROUP BY 1),
        t AS (SELECT count(*) AS k, sum(n) AS n, sum(s) AS s, sum(ss) AS ss, sum(s * s / n) AS b FROM g),
        f AS (SELECT CAST(k - 1 AS DOUBLE) AS df_between, CAST(n - k AS DOUBLE) AS df_within, ((b - s * s / n) / (k - 1)) / ((ss - b) / (n - k)) AS f FROM t),
        q AS (SELECT *, df_between / 2 AS p, df_within / 2 AS q, df_between * f / df_within AS y0, 80 / (df_between + df_within) / 20000 AS h FROM f),
        tail AS (SELECT any_value(df_between) AS df_between, any_value(df_within) AS df_within, any_value(f) AS f, sum({SIMPSON} * exp((p - 1) * ln(y0 + i * h)
        - (p + q) * ln(1 + y0 + i * h) + lgamma(p + q) - lgamma(p) - lgamma(q))) * any_value(h) / 3 AS p_value FROM q, range(0, 20001) r(i))
        SELECT df_between, df_within, round(f, 8) AS f_stat, round(p_value, 6) AS p_value FROM tail""",
        "reviews",
        active=ACTIVE,
    ),
)
def qa14p(spark, sf):
    out = rounded(sig.anova(active(spark, sf), "level", "rating"), "f_stat")
    return rounded(out, "p_value", places=6)


PICKED = "SELECT *, reorder_rate >= 30 AS high FROM reorder WHERE n_reviews >= 20 AND (reorder_rate >= 30 OR reorder_rate < 25)"


def picked(spark, sf):
    kept = reorder(spark, sf).where("n_reviews >= 20 AND (reorder_rate >= 30 OR reorder_rate < 25)")
    return kept.withColumn("high", F.col("reorder_rate") >= 30)


@query(
    "qa15_mann_whitney",
    with_views(
        """, r AS (SELECT high, rank() OVER (ORDER BY price) + (count(*) OVER (PARTITION BY price) - 1) / 2 AS mid FROM picked)
        SELECT count(*) FILTER (high) AS n1, count(*) FILTER (NOT high) AS n2,
        round(sum(mid) FILTER (high) - count(*) FILTER (high) * (count(*) FILTER (high) + 1) / 2, 8) AS u_stat FROM r""",
        *PR,
        reorder=REORDER,
        picked=PICKED,
    ),
)
def qa15(spark, sf):
    return rounded(sig.mann_whitney(picked(spark, sf), F.col("high"), "price", p_value=False), "u_stat")


@query(
    "qa15_mann_whitney_p_value",
    with_views(
        f""", r AS (SELECT high, avg_rating, rank() OVER (ORDER BY avg_rating) + (count(*) OVER (PARTITION BY avg_rating) - 1) / 2 AS mid FROM picked),
        u AS (SELECT count(*) FILTER (high) AS n1, count(*) FILTER (NOT high) AS n2, count(*) AS n,
        sum(mid) FILTER (high) - count(*) FILTER (high) * (count(*) FILTER (high) + 1) / 2 AS u FROM r),
        e AS (SELECT sum(t * t * t - t) AS ties FROM (SELECT CAST(count(*) AS DOUBLE) AS t FROM r GROUP BY avg_rating)),
        z AS (SELECT n1, n2, u, (greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5) / sqrt(n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM u, e),
        tail AS (SELECT any_value(n1) AS n1, any_value(n2) AS n2, any_value(u) AS u, least(1, sum({SIMPSON} * exp(-(z + i * 0.0005) * (z + i * 0.0005) / 2)) * 0.0005 / 3 * 2 / sqrt(2 * pi())) AS p
        FROM z, range(0, 20001) r(i))
        SELECT n1, n2, round(u, 8) AS u_stat, round(p, 6) AS p_value FROM tail""",
        *PR,
        reorder=REORDER,
        picked=PICKED,
    ),
)
def qa15p(spark, sf):
    out = rounded(sig.mann_whitney(picked(spark, sf), F.col("high"), "avg_rating"), "u_stat")
    return rounded(out, "p_value", places=6)
