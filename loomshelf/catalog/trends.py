"""Time-series and district queries (TS*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshelf.catalog.features import scored, stack
from loomshelf.catalog.registry import query, rounded
from loomshelf.catalog.reviews import SEASON_SQL
from loomshelf.operators import review_features as rf
from loomshelf.operators import trends as ts
from loomshelf.sources import views as v
from loomshelf.sources.views import with_views

NEW_RE = """count(*) FILTER (NOT is_reorder) AS n_new, count(*) FILTER (is_reorder) AS n_reorder, count(*) AS total,
round(100.0::DOUBLE * count(*) FILTER (is_reorder) / count(*), 8) AS reorder_pct"""
MONTH = "CAST(date_trunc('month', date) AS DATE)"


@query("ts1_yearly_reorder", with_views(f"SELECT CAST(year(date) AS INTEGER) AS year, {NEW_RE} FROM reviews GROUP BY 1", "reviews"))
def ts1(spark, sf):
    return rounded(ts.yearly(v.reviews(spark, sf)), "reorder_pct")


@query("ts2_monthly_reorder", with_views(f"SELECT {MONTH} AS month, {NEW_RE} FROM reviews GROUP BY 1", "reviews"))
def ts2(spark, sf):
    return rounded(ts.monthly(v.reviews(spark, sf)), "reorder_pct")


JOINED = "SELECT r.*, p.brand, p.name, p.category_1, p.category_2 FROM reviews r LEFT JOIN products p USING (product_code)"


def by_category(category):
    def run(spark, sf):
        d = ts.monthly_by_category(v.reviews(spark, sf), v.products(spark, sf), category)
        return rounded(d, "reorder_pct")

    return run


def totals_by(category):
    def run(spark, sf):
        by_month = ts.monthly_by_category(v.reviews(spark, sf), v.products(spark, sf), category)
        return rounded(ts.category_totals(by_month, category), "reorder_pct")

    return run


for _c in ("category_1", "category_2"):
    query(
        f"ts3_monthly_{_c}",
        with_views(f"SELECT {MONTH} AS month, {_c}, {NEW_RE} FROM joined GROUP BY 1, 2", "products", "reviews", joined=JOINED),
    )(by_category(_c))
    query(f"ts3_totals_{_c}", with_views(f"SELECT {_c}, {NEW_RE} FROM joined GROUP BY 1", "products", "reviews", joined=JOINED))(totals_by(_c))


@query(
    "ts3_monthly_with_totals",
    with_views(
        f"""SELECT category_2, month, CASE g WHEN 0 THEN 'month' WHEN 1 THEN 'category' ELSE 'all' END AS level, n_new, n_reorder, total, reorder_pct FROM (
        SELECT {MONTH} AS month, category_2, GROUPING(category_2, {MONTH}) AS g, {NEW_RE} FROM joined GROUP BY ROLLUP (category_2, {MONTH}))""",
        "products",
        "reviews",
        joined=JOINED,
    ),
)
def ts3r(spark, sf):
    """Both the monthly series and the totals from one pass."""
    return rounded(ts.monthly_with_totals(v.reviews(spark, sf), v.products(spark, sf), "category_2"), "reorder_pct")


@query(
    "ts4_biggest_categories",
    with_views(
        f"""SELECT {MONTH} AS month, category_2, {NEW_RE} FROM joined WHERE category_2 IN
        (SELECT category_2 FROM joined GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) GROUP BY 1, 2""",
        "products",
        "reviews",
        joined=JOINED,
    ),
)
def ts4(spark, sf):
    by_month = ts.monthly_by_category(v.reviews(spark, sf), v.products(spark, sf), "category_2")
    return rounded(ts.biggest_categories(by_month, "category_2"), "reorder_pct")


STARS = """SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category_2 ORDER BY round(engagement_score, 8) DESC, product_code) AS INTEGER) AS rn FROM scored) WHERE rn <= 3"""


def stars(spark, sf):
    return ts.category_stars(rounded(scored(spark, sf), "engagement_score"))


@query(
    "ts5_category_stars",
    with_views(
        "SELECT category_2, product_code, round(engagement_score, 8) AS engagement_score, rn FROM stars",
        "products",
        "reviews",
        **stack("scored"),
        stars=STARS,
    ),
)
def ts5(spark, sf):
    return stars(spark, sf).select("category_2", "product_code", "engagement_score", "rn")


@query(
    "ts6_product_series",
    with_views(
        f"""SELECT product_code, {MONTH} AS month, {NEW_RE} FROM reviews WHERE product_code IN (SELECT product_code FROM stars)
        GROUP BY 1, 2 HAVING count(*) >= 3""",
        "products",
        "reviews",
        **stack("scored"),
        stars=STARS,
    ),
)
def ts6(spark, sf):
    return rounded(ts.product_series(v.reviews(spark, sf), stars(spark, sf)), "reorder_pct")


LAUNCH = "SELECT product_code, CAST(date_trunc('month', min(date)) AS DATE) AS launch_month FROM reviews GROUP BY 1"


@query(
    "ts7_launches_per_month",
    with_views(
        """SELECT launch_month, n_new, CAST(sum(n_new) OVER (ORDER BY launch_month) AS BIGINT) AS n_total
        FROM (SELECT launch_month, count(*) AS n_new FROM launch GROUP BY 1)""",
        "reviews",
        launch=LAUNCH,
    ),
)
def ts7(spark, sf):
    return ts.launches_per_month(v.reviews(spark, sf))


@query(
    "ts8_launches_by_category",
    with_views(
        """, l AS (SELECT launch_month, category_2 FROM launch JOIN products USING (product_code))
        SELECT launch_month, category_2, count(*) AS n_new FROM l WHERE category_2 IN
        (SELECT category_2 FROM l GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 10) GROUP BY 1, 2""",
        "products",
        "reviews",
        launch=LAUNCH,
    ),
)
def ts8(spark, sf):
    return ts.launches_by_category(v.reviews(spark, sf), v.products(spark, sf))


@query(
    "ts9_recent_launches",
    with_views(
        """SELECT product_code, launch_month, name, category_2 FROM launch JOIN products USING (product_code)
        WHERE launch_month >= DATE '1995-03-01' ORDER BY launch_month DESC, product_code LIMIT 20""",
        "products",
        "reviews",
        launch=LAUNCH,
    ),
)
def ts9(spark, sf):
    return ts.recent_launches(v.reviews(spark, sf), v.products(spark, sf), "1995-03-01")


@query(
    "ts10_calendar_counts",
    with_views(
        """SELECT 'year' AS level, CAST(year(date) AS VARCHAR) AS value, count(*) AS n_reviews FROM reviews GROUP BY 2
        UNION ALL SELECT 'year_month', strftime(date, '%Y-%m'), count(*) FROM reviews GROUP BY 2
        UNION ALL SELECT 'day_of_week', CAST(isodow(date) - 1 AS VARCHAR), count(*) FROM reviews GROUP BY 2""",
        "reviews",
    ),
)
def ts10(spark, sf):
    return ts.calendar_counts(rf.with_calendar(v.reviews(spark, sf)))


SEASON_GRID = f"""SELECT y.year, s.season, CAST(s.no AS INTEGER) AS season_no, coalesce(c.n, 0) AS n_reviews
FROM (SELECT DISTINCT CAST(year(date) AS INTEGER) AS year FROM reviews) y
CROSS JOIN (VALUES ('Spring', 0), ('Summer', 1), ('Fall', 2), ('Winter', 3)) s(season, no)
LEFT JOIN (SELECT CAST(year(date) AS INTEGER) AS year, {SEASON_SQL} AS season, count(*) AS n FROM reviews GROUP BY 1, 2) c
ON c.year = y.year AND c.season = s.season"""


@query("ts10_season_counts", with_views("SELECT * FROM grid", "reviews", grid=SEASON_GRID))
def ts10b(spark, sf):
    return ts.season_counts(rf.with_calendar(v.reviews(spark, sf)))


@query(
    "ts11_season_shares",
    with_views(
        "SELECT year, season, round(100.0::DOUBLE * n_reviews / sum(n_reviews) OVER (PARTITION BY year), 8) AS pct FROM grid", "reviews", grid=SEASON_GRID
    ),
)
def ts11(spark, sf):
    d = ts.season_shares(ts.season_counts(rf.with_calendar(v.reviews(spark, sf))))
    return rounded(d.select("year", "season", "pct"), "pct")


@query(
    "ts12_rating_by_season",
    with_views(
        f"""SELECT {SEASON_SQL} AS season, round(avg(rating), 8) AS mean, quantile_cont(rating, 0.5) AS median, count(rating) AS count
        FROM reviews GROUP BY 1""",
        "reviews",
    ),
)
def ts12(spark, sf):
    return rounded(ts.rating_by(rf.with_calendar(v.reviews(spark, sf)), "season"), "mean")


@query(
    "ts12_rating_by_month",
    with_views(
        """SELECT CAST(month(date) AS INTEGER) AS month, round(avg(rating), 8) AS mean, quantile_cont(rating, 0.5) AS median, count(rating) AS count
        FROM reviews GROUP BY 1""",
        "reviews",
    ),
)
def ts12b(spark, sf):
    return rounded(ts.rating_by(rf.with_calendar(v.reviews(spark, sf)), "month"), "mean")


FOOTFALL = """SELECT district, CAST(sum(visitors) AS BIGINT) AS total, count(DISTINCT day) AS n_days, CAST(sum(foreign_visitors) AS BIGINT) AS foreign_total,
sum(visitors) / count(DISTINCT day) AS person_hours, sum(visitors) / 13.0::DOUBLE / count(DISTINCT day) AS average_present
FROM district_hours WHERE hour BETWEEN 10 AND 22 GROUP BY 1"""


def footfall(spark, sf):
    return ts.district_footfall(v.district_hours(spark, sf))


@query(
    "ts13_district_average",
    with_views("SELECT district, n_days, round(average_present, 8) AS average_present FROM footfall", "district_hours", footfall=FOOTFALL),
)
def ts13(spark, sf):
    return rounded(footfall(spark, sf).select("district", "n_days", "average_present"), "average_present")


@query(
    "ts14_person_hours",
    with_views(
        "SELECT district, round(person_hours, 8) AS person_hours FROM footfall ORDER BY round(person_hours, 8) DESC, district LIMIT 10",
        "district_hours",
        footfall=FOOTFALL,
    ),
)
def ts14(spark, sf):
    d = rounded(footfall(spark, sf).select("district", "person_hours"), "person_hours")
    return d.orderBy(F.desc("person_hours"), "district").limit(10)


@query(
    "ts15_composite_score",
    with_views(
        """SELECT district, foreign_total, round(person_hours, 8) AS person_hours, round(score, 8) AS score,
        CAST(row_number() OVER (ORDER BY round(score, 9) DESC, district) AS INTEGER) AS position FROM (SELECT *,
        (foreign_total - min(foreign_total) OVER ()) / (max(foreign_total) OVER () - min(foreign_total) OVER ())
        + (person_hours - min(person_hours) OVER ()) / (max(person_hours) OVER () - min(person_hours) OVER ()) AS score FROM footfall)""",
        "district_hours",
        footfall=FOOTFALL,
    ),
)
def ts15(spark, sf):
    return rounded(ts.composite_score(footfall(spark, sf)), "person_hours", "score")


@query(
    "ts16_hour_matrix",
    with_views(
        "SELECT district, "
        + ", ".join(f"CAST(coalesce(sum(visitors) FILTER (hour = {h}), 0) AS BIGINT) AS h{h}" for h in range(10, 23))
        + " FROM district_hours GROUP BY 1",
        "district_hours",
    ),
)
def ts16(spark, sf):
    return ts.hour_matrix(v.district_hours(spark, sf))


PEAKS = """SELECT district, hour AS peak_hour, n AS peak_visitors FROM (SELECT *, row_number() OVER (PARTITION BY district ORDER BY n DESC, hour) AS rn
FROM (SELECT district, hour, CAST(sum(visitors) AS BIGINT) AS n FROM district_hours WHERE hour BETWEEN 10 AND 22 GROUP BY 1, 2)) WHERE rn = 1"""


@query("ts16_peak_hours", with_views("SELECT * FROM peaks", "district_hours", peaks=PEAKS))
def ts16b(spark, sf):
    return ts.peak_hours(v.district_hours(spark, sf))


@query("ts16_peak_distribution", with_views("SELECT peak_hour, count(*) AS n_districts FROM peaks GROUP BY 1", "district_hours", peaks=PEAKS))
def ts16c(spark, sf):
    return ts.peak_distribution(ts.peak_hours(v.district_hours(spark, sf)))


NATION = """SELECT CAST(date_trunc('month', day) AS DATE) AS month, CAST(sum(visitors) AS BIGINT) AS visitors, CAST(sum(chinese) AS BIGINT) AS chinese,
CAST(sum(other) AS BIGINT) AS other, count(DISTINCT day) FILTER (isodow(day) < 6) AS n_weekdays, count(DISTINCT day) FILTER (isodow(day) >= 6) AS n_weekend_days,
count(DISTINCT day) AS n_days, sum(visitors) / count(DISTINCT day) AS daily_average,
100.0::DOUBLE * sum(chinese) / (sum(chinese) + sum(other)) AS chinese_pct FROM district_hours GROUP BY 1"""


@query(
    "ts17_monthly_nationality",
    with_views(
        """SELECT * EXCLUDE (daily_average, chinese_pct), round(daily_average, 8) AS daily_average, round(chinese_pct, 8) AS chinese_pct FROM nationality""",
        "district_hours",
        nationality=NATION,
    ),
)
def ts17(spark, sf):
    return rounded(ts.monthly_nationality(v.district_hours(spark, sf)), "daily_average", "chinese_pct")


@query(
    "ts17_yearly_nationality",
    with_views(
        """SELECT CAST(year(month) AS INTEGER) AS year, round(avg(daily_average), 8) AS mean_daily,
        round(100.0::DOUBLE * sum(chinese) / sum(chinese + other), 8) AS chinese_pct FROM nationality GROUP BY 1""",
        "district_hours",
        nationality=NATION,
    ),
)
def ts17b(spark, sf):
    return rounded(ts.yearly_nationality(ts.monthly_nationality(v.district_hours(spark, sf))), "mean_daily", "chinese_pct")
