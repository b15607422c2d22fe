"""Whole jobs on small inputs."""

from pyspark.sql import functions as F

from loomshelf.plans import feature_mart, ingredient_list, labelling
from loomshelf.sources import views as v


def test_feature_mart(spark, sf, tmp_path):
    products, reviews, promos = (f(spark, sf) for f in (v.products, v.reviews, v.promotions))
    feature_mart.write_mart(products, reviews, promos, str(tmp_path))
    mart = spark.read.parquet(str(tmp_path / "reviews"))
    assert mart.count() == reviews.count()
    assert {"user_activity_level", "season", "promo_type_category", "is_brand_repurchase"} <= set(mart.columns)
    assert spark.read.parquet(str(tmp_path / "products")).count() == products.count()
    assert feature_mart.steady_sellers(products, reviews).count() > 0


def test_labelling_flow(spark):
    pool = spark.range(600).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("key"),
        F.expr("id div 12").alias("product_code"),
        (F.col("id") % 3).cast("string").alias("category_1"),
        (F.col("id") % 6).cast("string").alias("category_2"),
        F.element_at(F.array(F.lit(1.0), F.lit(3.0), F.lit(5.0)), (F.col("id") % 3 + 1).cast("int")).alias("rating"),
        F.when(F.col("id") % 10 == 0, "only english words").otherwise(F.concat(F.lit("배송 빠르고 좋아요 "), F.col("id").cast("string"))).alias("text"),
    )
    sample = labelling.draw_sample(pool, "key", 200, 20, 5)
    assert sample.count() == 200 and sample.where("text like 'only%'").count() == 0

    def judge(queue):
        return queue.withColumns({"sentiment": F.lit("REMOVE"), "model": F.lit("judge")})

    labels = labelling.label_and_review(sample, "key", judge=judge)
    assert labels.where("confidence < 0.7").count() == 0
    gold = labelling.gold_splits(labelling.label_and_review(sample, "key"), "key", 3, 60)
    assert gold.count() == 60
    assert gold.groupBy("product_code").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0


def test_ingredient_flow(spark):
    rows = [
        (1, "크림", "HTML", "page", "전성분: 정제수, 글리세린, 녹차추출물, 젤라틴"),
        (1, "크림", "OCR_0", "ocr", "전성분: 정제수, 글리세린, 소듐클로라이드"),
        (2, "토너", "OCR_0", "ocr", "설명뿐인 글"),
    ]
    texts = spark.createDataFrame(rows, "product_id int, product_name string, source string, kind string, text string")
    known = spark.createDataFrame([("정제수",)], "entry string")
    found = ingredient_list.ingredient_rows(texts, known)
    got = {r["ingredient"]: (r["n_page"], r["n_ocr"]) for r in found.collect()}
    assert got == {"정제수": (1, 1), "글리세린": (1, 1), "녹차추출물": (1, 0), "젤라틴": (1, 0), "소듐클로라이드": (0, 1)}
    out = ingredient_list.verdict_tables(found)
    assert [(r["can_halal"], r["can_vegan"]) for r in out["products"].collect()] == [("No", "Unknown")]
    fixed = ingredient_list.corrected(found, spark.createDataFrame([("소듐클로라이드",), ("글리세린",)], "entry string"))
    assert {r["ingredient"]: r["is_known"] for r in fixed.collect()}["글리세린"] is True
