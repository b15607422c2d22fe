"""Review-domain views over the supplied star-schema tables.

Each view exists twice, as a DataFrame and as SQL text for the oracle. Only integer arithmetic is
used, so both give the same bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def products(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("product_code"),
        F.col("p_brand").alias("brand"),
        F.col("p_name").alias("name"),
        F.col("p_type").alias("category_1"),
        F.concat("p_type", F.lit("-"), (F.col("p_size") % 5).cast("string")).alias("category_2"),
        (500 * (1 + F.col("p_size") % 10)).cast("long").alias("price"),
        ((F.col("p_partkey") * 37) % 997).alias("likes"),
        ((F.col("p_partkey") * 17) % 211).alias("shares"),
    )


def rating_of(q: F.Column) -> F.Column:
    return F.when(q % 10 < 6, 5).when(q % 10 < 8, 4).otherwise(q % 3 + 1).cast("double")


REVIEW_ORDER = ["date", "order_key", "line_no", "product_code", "supplier_key", "quantity"]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("l_quantity").cast("int")
    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", q.alias("quantity"), "l_returnflag"
    )
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    return lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("product_code"),
        F.col("l_suppkey").alias("supplier_key"),
        "quantity",
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderdate").cast("date").alias("date"),
        (F.col("l_returnflag") == "R").alias("is_reorder"),
        F.col("l_linenumber").alias("image_count"),
        rating_of(F.col("quantity")).alias("rating"),
    )


def promotions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Point-date promotions; brand '-' stands for every brand."""
    k = F.col("s_suppkey")
    kind = F.element_at(F.array(F.lit("Review event"), F.lit("구매 인증"), F.lit("Launch")), (k % 3 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(
        k.alias("promotion_id"),
        F.date_add(F.lit("1995-01-01").cast("date"), (k * 23).cast("int")).alias("date"),
        F.when(k % 10 == 0, F.lit("-")).otherwise(F.concat(F.lit("Brand#"), (1 + k % 25).cast("string"))).alias("brand"),
        kind.alias("event_type"),
        F.when(k % 4 == 0, F.lit("SALE week")).when(k % 4 == 1, F.lit("gift box")).otherwise(F.lit("plain")).alias(
            "description"
        ),
    )


def doc_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read as review texts."""
    d = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(
        d.alias("order_id"),
        F.expr("doc_id div 10").alias("product_code"),
        F.expr("doc_id div 4").alias("user_id"),
        F.date_add(F.lit("2024-01-01").cast("date"), (d % 365).cast("int")).alias("date"),
        (1 + d % 5).cast("double").alias("rating"),
        "text",
        "lang",
        "source",
    )


def district_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visitor counts per district, day and hour out of the event table."""
    events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (
        events.join(customers, events.user_id == customers.c_custkey)
        .groupBy(
            F.col("c_nationkey").alias("district"),
            F.col("ts").cast("date").alias("day"),
            F.hour("ts").alias("hour"),
        )
        .agg(
            F.count(F.lit(1)).alias("visitors"),
            F.count_if(F.col("event_type") == "click").alias("chinese"),
            F.count_if(F.col("event_type") == "error").alias("other"),
        )
        .withColumn("foreign_visitors", F.col("chinese") + F.col("other"))
    )


VIEW_SQL = {
    "products": """
SELECT p_partkey AS product_code, p_brand AS brand, p_name AS name, p_type AS category_1,
       p_type || '-' || CAST(p_size % 5 AS VARCHAR) AS category_2,
       CAST(500 * (1 + p_size % 10) AS BIGINT) AS price,
       (p_partkey * 37) % 997 AS likes, (p_partkey * 17) % 211 AS shares
FROM part""",
    "reviews": """
SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS product_code, l_suppkey AS supplier_key,
       CAST(l_quantity AS INTEGER) AS quantity, o_custkey AS user_id, CAST(o_orderdate AS DATE) AS date,
       l_returnflag = 'R' AS is_reorder, l_linenumber AS image_count,
       CAST(CASE WHEN CAST(l_quantity AS INTEGER) % 10 < 6 THEN 5
                 WHEN CAST(l_quantity AS INTEGER) % 10 < 8 THEN 4
                 ELSE CAST(l_quantity AS INTEGER) % 3 + 1 END AS DOUBLE) AS rating
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "promotions": """
SELECT s_suppkey AS promotion_id, DATE '1995-01-01' + CAST(s_suppkey * 23 AS INTEGER) AS date,
       CASE WHEN s_suppkey % 10 = 0 THEN '-' ELSE 'Brand#' || CAST(1 + s_suppkey % 25 AS VARCHAR) END AS brand,
       CASE s_suppkey % 3 WHEN 0 THEN 'Review event' WHEN 1 THEN '구매 인증' ELSE 'Launch' END AS event_type,
       CASE s_suppkey % 4 WHEN 0 THEN 'SALE week' WHEN 1 THEN 'gift box' ELSE 'plain' END AS description
FROM supplier""",
    "doc_reviews": """
SELECT doc_id AS order_id, doc_id // 10 AS product_code, doc_id // 4 AS user_id,
       DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) AS date, CAST(1 + doc_id % 5 AS DOUBLE) AS rating,
       text, lang, source
FROM documents""",
    "district_hours": """
SELECT c_nationkey AS district, CAST(ts AS DATE) AS day, CAST(hour(ts) AS INTEGER) AS hour, count(*) AS visitors,
       count(*) FILTER (event_type = 'click') AS chinese, count(*) FILTER (event_type = 'error') AS other,
       count(*) FILTER (event_type IN ('click', 'error')) AS foreign_visitors
FROM events JOIN customer ON user_id = c_custkey
GROUP BY 1, 2, 3""",
}


def with_views(body: str, *views: str, **extra: str) -> str:
    """SQL text with the named domain views (and further named parts, in order) as common table expressions."""
    parts = [f"{v} AS ({VIEW_SQL[v]})" for v in views] + [f"{n} AS ({q})" for n, q in extra.items()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
