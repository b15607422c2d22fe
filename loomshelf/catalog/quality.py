"""Data-quality queries (DQ*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshelf.catalog.registry import query, rounded
from loomshelf.operators import quality as dq
from loomshelf.sources import views as v
from loomshelf.sources.views import with_views


@query(
    "dq1_dedup_texts",
    with_views("SELECT min(order_id) AS order_id, text FROM doc_reviews GROUP BY text", "doc_reviews"),
)
def dq1(spark, sf):
    return dq.dedup_by_text(v.doc_reviews(spark, sf).select("order_id", "text"), "text", "order_id")


@query(
    "dq1_dedup_reviews",
    with_views(
        """SELECT user_id, product_code, date, arg_min(rating, (order_key, line_no, supplier_key, quantity)) AS rating
        FROM reviews GROUP BY 1, 2, 3""",
        "reviews",
    ),
)
def dq1b(spark, sf):
    d = v.reviews(spark, sf).select("user_id", "product_code", "date", "rating", "order_key", "line_no", "supplier_key", "quantity")
    kept = dq.dedup(d, ["user_id", "product_code", "date"], ["order_key", "line_no", "supplier_key", "quantity"])
    return kept.select("user_id", "product_code", "date", "rating")


SIDES = {
    "l": "SELECT d.lang, d.doc_id FROM labels JOIN documents d USING (doc_id)",
    "r": "SELECT d.lang, d.doc_id FROM embeddings e JOIN documents d ON e.vec_id = d.doc_id",
    "m": """SELECT coalesce(l.lang, r.lang) AS lang, coalesce(l.doc_id, r.doc_id) AS doc_id,
    CASE WHEN l.doc_id IS NOT NULL AND r.doc_id IS NOT NULL THEN 'both' WHEN l.doc_id IS NOT NULL THEN 'only_left' ELSE 'only_right' END AS status
    FROM (SELECT DISTINCT * FROM l) l FULL JOIN (SELECT DISTINCT * FROM r) r ON l.lang = r.lang AND l.doc_id = r.doc_id""",
}


def sides(spark, sf):
    docs = v.table(spark, sf, "documents").select("doc_id", "lang")
    labelled = v.table(spark, sf, "labels").select("doc_id").join(docs, "doc_id")
    embedded = v.table(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id")).join(docs, "doc_id")
    return dq.reconcile_keys(labelled, embedded, "lang", "doc_id")


@query("dq2_reconcile_keys", with_views("SELECT lang, doc_id, status FROM m", **SIDES))
def dq2(spark, sf):
    return sides(spark, sf)


@query("dq2_reconcile_counts", with_views("SELECT lang, status, count(*) AS n_keys FROM m GROUP BY 1, 2", **SIDES))
def dq2b(spark, sf):
    return dq.reconcile_counts(sides(spark, sf), "lang")


@query(
    "dq3_orphan_reviews",
    with_views(
        """SELECT user_id AS product_code, count(*) AS n_reviews FROM doc_reviews
        WHERE user_id NOT IN (SELECT doc_id FROM labels) GROUP BY 1""",
        "doc_reviews",
    ),
)
def dq3(spark, sf):
    reviews = v.doc_reviews(spark, sf).select(F.col("user_id").alias("product_code"))
    return dq.orphan_reviews(reviews, v.table(spark, sf, "labels").select(F.col("doc_id").alias("product_code")))


@query(
    "dq4_silent_products",
    with_views(
        """SELECT product_code, name, brand FROM (SELECT product_code, name, brand FROM products
        UNION ALL SELECT -product_code, name || ' (new)', brand FROM products WHERE price > 2000) WHERE product_code NOT IN (SELECT product_code FROM reviews)""",
        "products",
        "reviews",
    ),
)
def dq4(spark, sf):
    """Dearer products have a new edition that nobody reviewed yet."""
    sold = v.products(spark, sf).select("product_code", "name", "brand", "price")
    new = sold.where("price > 2000").withColumns({"product_code": -F.col("product_code"), "name": F.concat("name", F.lit(" (new)"))})
    return dq.silent_products(sold.unionByName(new).drop("price"), v.reviews(spark, sf))


@query(
    "dq5_file_pairs",
    """WITH f AS (SELECT DISTINCT source || '-' || lang AS category, CASE WHEN n_chars > 1000 THEN 'product' ELSE 'reviews' END AS kind FROM documents)
    SELECT category, bool_or(kind = 'product') AS has_products, bool_or(kind = 'reviews') AS has_reviews,
    bool_or(kind = 'product') AND bool_or(kind = 'reviews') AS complete FROM f GROUP BY 1""",
)
def dq5(spark, sf):
    kind = F.when(F.col("n_chars") > 1000, "product").otherwise("reviews")
    paths = F.concat(F.lit("/drop/"), kind, F.lit("_"), "source", F.lit("-"), "lang", F.lit(".csv"))
    return dq.file_pairs(v.table(spark, sf, "documents").select(paths.alias("path")))


DOC_COLUMNS = ("doc_id", "text", "lang", "quality")


@query(
    "dq6_null_report",
    with_views(
        " UNION ALL ".join(
            f"SELECT '{c}' AS column_name, count(*) - count({c}) AS n_null, "
            + (f"count(*) FILTER (trim({c}) = '')" if c in ("text", "lang") else "CAST(0 AS BIGINT)")
            + " AS n_blank, count(*) AS n_rows FROM d"
            for c in DOC_COLUMNS
        ),
        d="SELECT doc_id, text, CASE WHEN lang = 'es' THEN ' ' ELSE lang END AS lang, quality FROM documents LEFT JOIN labels USING (doc_id)",
    ),
)
def dq6(spark, sf):
    docs = v.table(spark, sf, "documents").join(v.table(spark, sf, "labels"), "doc_id", "left")
    docs = docs.withColumn("lang", F.when(F.col("lang") == "es", " ").otherwise(F.col("lang")))
    return dq.null_report(docs.select(*DOC_COLUMNS))


SIZES = "SELECT user_id, count(*) AS n FROM reviews GROUP BY 1"


@query(
    "dq7_iqr_outliers",
    with_views(
        """, b AS (SELECT quantile_cont(n, 0.25) AS q1, quantile_cont(n, 0.75) AS q3 FROM sizes)
        SELECT * FROM (SELECT user_id, n, round(q1 - 1.5::DOUBLE * (q3 - q1), 8) AS lower, round(q3 + 1.5::DOUBLE * (q3 - q1), 8) AS upper,
        CASE WHEN n < q1 - 1.5::DOUBLE * (q3 - q1) THEN 'low' WHEN n > q3 + 1.5::DOUBLE * (q3 - q1) THEN 'high' END AS kind
        FROM sizes, b) WHERE kind IS NOT NULL""",
        "reviews",
        sizes=SIZES,
    ),
)
def dq7(spark, sf):
    return rounded(dq.iqr_outliers(dq.group_sizes(v.reviews(spark, sf), "user_id")), "lower", "upper")


@query(
    "dq8_count_histogram",
    with_views(
        """SELECT CASE WHEN n <= 10 THEN '(0,10]' WHEN n <= 20 THEN '(10,20]' WHEN n <= 30 THEN '(20,30]' WHEN n <= 40 THEN '(30,40]'
        WHEN n <= 50 THEN '(40,50]' WHEN n <= 60 THEN '(50,60]' WHEN n <= 80 THEN '(60,80]' WHEN n <= 100 THEN '(80,100]' ELSE '(100,inf)' END AS bin,
        count(*) AS n_groups FROM sizes GROUP BY 1""",
        "reviews",
        sizes=SIZES,
    ),
)
def dq8(spark, sf):
    return dq.histogram(dq.group_sizes(v.reviews(spark, sf), "user_id"))


@query(
    "dq9_duplicate_pairs",
    with_views("SELECT user_id, product_code, count(*) AS n FROM reviews GROUP BY 1, 2 HAVING count(*) > 1", "reviews"),
)
def dq9(spark, sf):
    return dq.duplicate_pairs(v.reviews(spark, sf), ["user_id", "product_code"])


@query(
    "dq10_extreme_groups",
    with_views(
        """, s AS (SELECT category_2, count(*) AS n, arg_min(name, product_code) AS name FROM products GROUP BY 1)
        SELECT * FROM (SELECT *, CASE WHEN n < 60 THEN 'low' WHEN n > 70 THEN 'high' END AS kind FROM s) WHERE kind IS NOT NULL""",
        "products",
    ),
)
def dq10(spark, sf):
    return dq.extreme_groups(v.products(spark, sf), "category_2", "name", ["product_code"], 60, 70)


@query(
    "dq11_copied_texts",
    with_views(
        """SELECT md5(text) AS text_md5, count(*) AS n_rows, count(DISTINCT product_code) AS n_products, count(DISTINCT user_id) AS n_users,
        string_agg(DISTINCT CAST(CAST(rating AS INTEGER) AS VARCHAR), ',' ORDER BY CAST(CAST(rating AS INTEGER) AS VARCHAR)) AS ratings
        FROM doc_reviews GROUP BY text HAVING count(DISTINCT product_code) >= 2""",
        "doc_reviews",
    ),
)
def dq11(spark, sf):
    return dq.copied_texts(v.doc_reviews(spark, sf)).withColumn("text_md5", F.md5("text")).drop("text")


@query(
    "dq12_without_copies",
    with_views(
        """SELECT order_id, product_code FROM doc_reviews WHERE text NOT IN
        (SELECT text FROM doc_reviews GROUP BY 1 HAVING count(DISTINCT product_code) >= 3)""",
        "doc_reviews",
    ),
)
def dq12(spark, sf):
    return dq.without_copied_texts(v.doc_reviews(spark, sf)).select("order_id", "product_code")


EXCLUDED = ["ring", "PROMO"]
HIT = " OR ".join(f"regexp_matches({c}, '(?i)ring|PROMO')" for c in ("category_1", "category_2", "name"))


@query("dq13_excluded_products", with_views(f"SELECT product_code FROM products WHERE NOT ({HIT})", "products"))
def dq13(spark, sf):
    return dq.exclude_products(v.products(spark, sf), EXCLUDED).select("product_code")


@query(
    "dq13_excluded_reviews",
    with_views(
        f"""SELECT product_code, count(*) AS n_reviews FROM reviews WHERE product_code NOT IN (SELECT product_code FROM products WHERE {HIT}) GROUP BY 1""",
        "products",
        "reviews",
    ),
)
def dq13b(spark, sf):
    kept = dq.exclude_reviews_of(v.reviews(spark, sf), v.products(spark, sf), EXCLUDED)
    return kept.groupBy("product_code").agg(F.count(F.lit(1)).alias("n_reviews"))


@query(
    "dq14_target_language",
    with_views(
        """SELECT order_id, n + o > 0 AND coalesce(n / nullif(n + o, 0), 0) >= 0.97 AS keep FROM (SELECT order_id,
        len(regexp_extract_all(text, '[a-zA-Z]')) AS n, len(regexp_extract_all(text, '[à-ÿÀ-Ýœß]')) AS o FROM doc_reviews)""",
        "doc_reviews",
    ),
)
def dq14(spark, sf):
    keep = dq.in_target_language("text", "[a-zA-Z]", "[à-ÿÀ-Ýœß]", filler=None, min_share=0.97)
    return v.doc_reviews(spark, sf).select("order_id", keep.alias("keep"))


@query(
    "dq15_numeric_text",
    with_views(
        """SELECT product_code, price, CAST(likes % 50 AS DOUBLE) / 10 AS rating, shares AS n_reviews FROM products""",
        "products",
    ),
)
def dq15(spark, sf):
    raw = v.products(spark, sf).select(
        "product_code",
        F.concat(F.format_number("price", 0), F.lit("원")).alias("price_text"),
        F.concat(F.lit("별점 "), (F.col("likes") % 50 / 10).cast("string"), F.lit("점")).alias("rating_text"),
        F.when(F.col("shares") > 0, F.concat(F.lit("리뷰 "), F.format_number("shares", 0), F.lit("건"))).alias("count_text"),
    )
    return raw.select(
        "product_code",
        dq.parse_price("price_text").alias("price"),
        dq.parse_rating("rating_text").alias("rating"),
        dq.parse_count("count_text").alias("n_reviews"),
    )


@query(
    "dq16_brand_fallback",
    with_views(
        """SELECT product_code, CASE WHEN price > 2000 THEN brand WHEN category_1 IN ('PROMO', 'ECONOMY') THEN 'house'
        ELSE split_part(trim(name), ' ', 1) END AS brand FROM products""",
        "products",
    ),
)
def dq16(spark, sf):
    raw = v.products(spark, sf).withColumn("given", F.when(F.col("price") > 2000, F.col("brand")).otherwise("  "))
    picked = dq.brand_or_fallback("given", "category_1", "name", ["PROMO", "ECONOMY"], "house")
    return raw.select("product_code", picked.alias("brand"))


@query(
    "dq17_category_suffix",
    with_views(
        """SELECT product_code, replace(replace(replace(category_1 || '/' || brand || '_' || category_2 || CASE WHEN name = category_2 THEN '' ELSE '_' || name END,
        '/', '_'), ':', '_'), ' ', '') AS suffix FROM products""",
        "products",
    ),
)
def dq17(spark, sf):
    slash = F.concat_ws("/", "category_1", "brand")
    suffix = dq.category_suffix(F.array(slash, slash), F.array("category_2", "name"))
    return v.products(spark, sf).select("product_code", suffix.alias("suffix"))


# where the fields stand in the supplied pages
SUPPLIED_PAGE = {
    "url_code": r"/(\d+)(?:[?#]|$)",
    "page_code": r"track\((\d+)\)",
    "name": r"<h1[^>]*>\s*(.*?)\s*</h1>",
    "price": r"<!-- ad ([\d,]+) -->",
    "country": r"<html lang=\"([a-z]*)\"",
    "counts": r"<li><a href=\"/([^\"]*)\"",
}


@query(
    "dq18_page_fields",
    r"""SELECT page_id, coalesce(nullif(regexp_extract(html, 'track\((\d+)\)', 1), ''), nullif(regexp_extract(url, '/(\d+)(?:[?#]|$)', 1), '')) AS product_code,
    nullif(regexp_extract(html, '(?s)<h1[^>]*>\s*(.*?)\s*</h1>', 1), '') AS name,
    TRY_CAST(replace(regexp_extract(html, '<!-- ad ([\d,]+) -->', 1), ',', '') AS BIGINT) AS price,
    nullif(regexp_extract(html, '<html lang="([a-z]*)"', 1), '') AS country,
    CASE WHEN len(c) >= 2 THEN coalesce(TRY_CAST(regexp_replace(c[1], '[^0-9]', '', 'g') AS BIGINT), 0) END AS likes,
    CASE WHEN len(c) >= 2 THEN coalesce(TRY_CAST(regexp_replace(c[2], '[^0-9]', '', 'g') AS BIGINT), 0) END AS shares
    FROM (SELECT *, regexp_extract_all(html, '<li><a href="/([^"]*)"', 1) AS c FROM pages)""",
)
def dq18(spark, sf):
    pages = v.table(spark, sf, "pages").select("page_id", "url", "html")
    return dq.product_page_fields(pages, SUPPLIED_PAGE).drop("url", "html")
