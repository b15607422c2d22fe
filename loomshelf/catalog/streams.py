"""Incremental jobs (ST*): the corpus arrives as dropped files."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshelf.catalog.labels import ASPECTS, LABELLED, NEG, NEU, POS
from loomshelf.catalog.registry import query
from loomshelf.operators import labels as lb
from loomshelf.sources import tables
from loomshelf.sources import views as v
from loomshelf.sources.views import with_views
from loomshelf.streaming import incremental as st

CRAWL = "row_no bigint, user_masked string, product_code bigint, date date, text string, rating double, image_count int"


@query(
    "st1_incremental_reviews",
    with_views(
        """SELECT DISTINCT product_code, source || '*' AS user_masked, date AS write_date, md5(text) AS text_md5, CAST(length(text) AS INTEGER) AS length FROM doc_reviews""",
        "doc_reviews",
    ),
)
def st1(spark, sf):
    """Every review is dropped twice, one run of the job per drop; the second copies must not be loaded."""
    drops, target, checkpoint = (tables.new_path(spark, n) for n in ("drops", "star", "progress"))
    crawl = v.doc_reviews(spark, sf).select(
        F.col("order_id").alias("row_no"),
        F.concat("source", F.lit("*")).alias("user_masked"),
        "product_code",
        "date",
        "text",
        "rating",
        F.lit(0).alias("image_count"),
    )
    for _ in range(2):
        crawl.write.mode("append").parquet(drops)
        stream = st.read_drops(spark, drops, CRAWL)
        writer = st.stream_reviews(stream, target, checkpoint, ["row_no"], [F.expr("row_no div 4294967296"), F.expr("row_no div 65536")])
        writer.trigger(availableNow=True).start().awaitTermination()
    users = spark.read.parquet(f"{target}/users").select("user_id", "user_masked")
    lengths = spark.read.parquet(f"{target}/review_analysis").select("order_id", "length")
    reviews = spark.read.parquet(f"{target}/reviews").select("order_id", "product_code", "user_id", "write_date", F.md5("text").alias("text_md5"))
    return (
        reviews.join(users, "user_id")
        .join(lengths, "order_id")
        .select("product_code", "user_masked", "write_date", "text_md5", "length")
    )


@query(
    "st2_incremental_labels",
    with_views(
        """SELECT order_id, aspect, sentiment AS overall_sentiment, confidence AS aspect_confidence FROM found JOIN verdict USING (order_id)""",
        "doc_reviews",
        **LABELLED,
    ),
)
def st2(spark, sf):
    drops, target, checkpoint = (tables.new_path(spark, n) for n in ("drops", "labels", "progress"))
    reviews = v.doc_reviews(spark, sf).select("order_id", "product_code", "rating", "text")
    schema = "order_id bigint, product_code bigint, rating double, text string"
    for copies in (2, 1):  # the first run finds every review twice in one batch, the second finds it labelled
        for _ in range(copies):
            reviews.write.mode("append").parquet(drops)
        stream = st.read_drops(spark, drops, schema)
        writer = st.stream_labels(stream, target, checkpoint, lb.rule_labeller(ASPECTS, POS, NEG, NEU))
        writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(target).select("order_id", "aspect", "overall_sentiment", "aspect_confidence")
