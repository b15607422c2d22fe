"""Promotions over day ranges as dyadic intervals."""

import datetime as dt
import random

from pyspark.sql import functions as F

from loomshelf.operators.review_features import range_pieces, with_promo, with_promo_range

DAY = dt.date(2023, 1, 1)


def day(n):
    return None if n is None else DAY + dt.timedelta(days=n)


def test_rows_of_a_promotion_grow_with_the_digits_of_its_length(spark):
    rows = [(i, day(7), day(7 + n - 1)) for i, n in enumerate((1, 2, 31, 365, 3650, 36500))] + [(9, None, day(3)), (10, dt.date(1950, 1, 1), dt.date(1950, 2, 1))]
    promos = spark.createDataFrame(rows, "promotion_id int, start_date date, end_date date")
    sizes = {r.promotion_id: r.n for r in range_pieces(promos).groupBy("promotion_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert sizes[0] == 1 and sizes[5] <= 2 * 16 and 9 not in sizes and sizes[10] <= 10
    # the intervals of a promotion cover each of its days once
    days = range_pieces(promos).groupBy("promotion_id").agg(F.sum(F.expr("shiftleft(1L, _level)")).alias("days"))
    assert {r.promotion_id: r.days for r in days.collect()} == {0: 1, 1: 2, 2: 31, 3: 365, 4: 3650, 5: 36500, 10: 32}


def test_ranges_match_as_their_days_do(spark):
    rng = random.Random(8)
    promos = [(i, rng.choice(["b0", "b1", "b2", "-"]), rng.choice(["리뷰", "할인", "증정", "구매", "x"]), day(rng.randrange(80)), day(rng.randrange(80))) for i in range(25)] + [(99, "b1", "x", None, day(5))]
    promos = spark.createDataFrame(promos, "promotion_id int, brand string, promo_type string, start_date date, end_date date")
    for c in ("event_type", "description"):
        promos = promos.withColumn(c, F.col("promo_type"))
    products = spark.createDataFrame([(i, f"b{i % 4}") for i in range(8)] + [(8, None)], "product_code bigint, brand string")
    reviews = spark.createDataFrame([(i, rng.randrange(10), day(rng.choice([None, *range(-3, 85)]))) for i in range(400)], "order_id bigint, product_code bigint, date date")
    spread = promos.where("start_date IS NOT NULL").withColumn("date", F.explode(F.sequence("start_date", "end_date")))
    columns = ["order_id", "date", "brand", "promo_type_category", "is_during_promo"]
    want = with_promo(reviews, products, spread, days=0).select(*columns)
    got = with_promo_range(reviews, products, promos).select(*columns)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert got.where("is_during_promo").count() > 50
