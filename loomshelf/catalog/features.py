"""Product feature queries (PF*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshelf.catalog.registry import query, rounded
from loomshelf.operators import product_features as pf
from loomshelf.sources import tables
from loomshelf.sources import views as v
from loomshelf.sources.views import with_views

COUNTED = """
SELECT p.*, coalesce(c.n, 0) AS review_count
FROM products p LEFT JOIN (SELECT product_code, count(*) AS n FROM reviews GROUP BY 1) c USING (product_code)"""
SCORED = "SELECT *, 0.15::DOUBLE * likes + 0.30::DOUBLE * shares + 0.55::DOUBLE * review_count AS engagement_score FROM counted"
TIERED = """SELECT *, CASE WHEN price <= 1500 THEN 'Easy Pick' WHEN price <= 3000 THEN 'Standard' ELSE 'Premium' END AS price_tier
FROM scored"""
VALUED = """
SELECT *, cp_index >= (SELECT quantile_cont(cp_index, 0.9) FROM (SELECT engagement_score / price * 1000.0::DOUBLE AS cp_index FROM tiered)) AS is_god_sung_bi
FROM (SELECT *, engagement_score / price * 1000.0::DOUBLE AS cp_index FROM tiered)"""
STACK = {"counted": COUNTED, "scored": SCORED, "tiered": TIERED, "valued": VALUED}


def stack(upto: str) -> dict[str, str]:
    names = list(STACK)
    return {n: STACK[n] for n in names[: names.index(upto) + 1]}


def counted(spark, sf):
    return pf.with_review_count(v.products(spark, sf), v.reviews(spark, sf))


def scored(spark, sf):
    return pf.with_price_tier(pf.with_engagement(counted(spark, sf)))


@query("pf1_review_count", with_views("SELECT product_code, review_count FROM counted", "products", "reviews", **stack("counted")))
def pf1(spark, sf):
    return counted(spark, sf).select("product_code", "review_count")


@query(
    "pf2_engagement_score",
    with_views("SELECT product_code, round(engagement_score, 8) AS engagement_score FROM scored", "products", "reviews", **stack("scored")),
)
def pf2(spark, sf):
    return rounded(scored(spark, sf).select("product_code", "engagement_score"), "engagement_score")


METRICS = ("likes", "shares", "review_count")


@query(
    "pf3_weight_diagnostics",
    with_views(
        " UNION ALL ".join(
            f"""SELECT '{m}' AS metric, count({m}) AS n, round(avg({m}), 8) AS mean, round(stddev_samp({m}), 8) AS std,
            CAST(min({m}) AS DOUBLE) AS min, CAST(max({m}) AS DOUBLE) AS max, round(stddev_samp({m}) / avg({m}), 8) AS cv,
            round(var_samp({m}) / pow(max({m}) - min({m}), 2), 8) AS scaled_var, """
            + ", ".join(f"round(corr({m}, {o}), 8) AS corr_{o}" for o in METRICS)
            + " FROM counted"
            for m in METRICS
        ),
        "products",
        "reviews",
        **stack("counted"),
    ),
)
def pf3(spark, sf):
    d = pf.weight_diagnostics(counted(spark, sf))
    return rounded(d, "mean", "std", "cv", "scaled_var", *[f"corr_{m}" for m in METRICS])


@query("pf4_price_tier", with_views("SELECT product_code, price, price_tier FROM tiered", "products", "reviews", **stack("tiered")))
def pf4(spark, sf):
    return pf.with_price_tier(v.products(spark, sf)).select("product_code", "price", "price_tier")


@query(
    "pf5_price_position",
    with_views(
        """SELECT product_code, round(r, 8) AS relative_price_ratio,
        CASE WHEN r < 0.8 THEN 'Cheaper than Avg' WHEN r > 1.2 THEN 'More Expensive than Avg' ELSE 'Average' END AS price_position
        FROM (SELECT product_code, price / avg(price) OVER (PARTITION BY category_2) AS r FROM products)""",
        "products",
    ),
)
def pf5(spark, sf):
    d = pf.with_price_position(v.products(spark, sf))
    return rounded(d.select("product_code", "relative_price_ratio", "price_position"), "relative_price_ratio")


@query(
    "pf6_value_index",
    with_views(
        "SELECT product_code, round(cp_index, 8) AS cp_index, is_god_sung_bi FROM valued", "products", "reviews", **stack("valued")
    ),
)
def pf6(spark, sf):
    # the quantile needs further passes over the products; writing them once spares the reviews
    d = pf.with_value_index(tables.settle(scored(spark, sf), "scored"))
    return rounded(d.select("product_code", "cp_index", "is_god_sung_bi"), "cp_index")


@query(
    "pf7_review_density",
    with_views(
        """SELECT product_code, round(CASE WHEN likes = 0 THEN 0 ELSE review_count / likes END, 8) AS review_density,
        round(coalesce(review_count / (date_diff('day', first_date, (SELECT max(date) FROM reviews)) + 1), 0), 8) AS daily_density
        FROM counted LEFT JOIN (SELECT product_code, min(date) AS first_date FROM reviews GROUP BY 1) USING (product_code)""",
        "products",
        "reviews",
        **stack("counted"),
    ),
)
def pf7(spark, sf):
    d = pf.with_daily_density(pf.with_review_density(counted(spark, sf)), v.reviews(spark, sf))
    return rounded(d.select("product_code", "review_density", "daily_density"), "review_density", "daily_density")


TIERS = {"Easy Pick": "easy_pick", "Standard": "standard", "Premium": "premium"}
TIER_COUNTS = ", ".join(f"count(*) FILTER (price_tier = '{t}') AS {n}" for t, n in TIERS.items())


@query(
    "pf8_tier_crosstab",
    with_views(f"SELECT category_2, {TIER_COUNTS} FROM tiered GROUP BY 1", "products", "reviews", **stack("tiered")),
)
def pf8(spark, sf):
    return pf.crosstab(pf.with_price_tier(v.products(spark, sf)), "category_2", "price_tier", list(TIERS))


@query(
    "pf8_tier_crosstab_percent",
    with_views(
        "SELECT category_2, "
        + ", ".join(f"round(100.0::DOUBLE * count(*) FILTER (price_tier = '{t}') / count(*), 8) AS {n}" for t, n in TIERS.items())
        + " FROM tiered GROUP BY 1",
        "products",
        "reviews",
        **stack("tiered"),
    ),
)
def pf8p(spark, sf):
    d = pf.crosstab(pf.with_price_tier(v.products(spark, sf)), "category_2", "price_tier", list(TIERS), percent=True)
    return rounded(d, *TIERS.values())


@query(
    "pf9_value_shares",
    with_views(
        """SELECT 'all' AS scope, price_tier, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 8) AS share FROM valued GROUP BY 2
        UNION ALL
        SELECT 'top value', price_tier, count(*), round(count(*) / sum(count(*)) OVER (), 8) FROM valued WHERE is_god_sung_bi GROUP BY 2""",
        "products",
        "reviews",
        **stack("valued"),
    ),
)
def pf9(spark, sf):
    valued = pf.with_value_index(tables.settle(scored(spark, sf), "scored"))
    everyone = pf.value_shares(valued, "price_tier").withColumn("scope", F.lit("all"))
    best = pf.value_shares(valued.where("is_god_sung_bi"), "price_tier").withColumn("scope", F.lit("top value"))
    return rounded(everyone.unionByName(best), "share").select("scope", "price_tier", "n", "share")


@query(
    "pf10_top_products",
    with_views(
        """SELECT product_code, name, round(engagement_score, 8) AS engagement_score
        FROM scored ORDER BY round(scored.engagement_score, 8) DESC, product_code LIMIT 10""",
        "products",
        "reviews",
        **stack("scored"),
    ),
)
def pf10(spark, sf):
    d = rounded(scored(spark, sf).select("product_code", "name", "engagement_score"), "engagement_score")
    return pf.top_n(d, "engagement_score", 10, ["product_code"])
