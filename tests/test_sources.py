"""Files, tables and streams."""

import json

from pyspark.sql import functions as F

from loomshelf.sources import files, tables
from loomshelf.streaming import incremental as st


def test_category_csv(spark, tmp_path):
    (tmp_path / "product_스킨 케어.csv").write_text("﻿product_code,name\n1,\"크림, 수분\"\n2,\"줄\n바꿈\"\n", encoding="utf-8")
    (tmp_path / "product_메이크업.csv").write_text("product_code,name\n3,립\n", encoding="utf-8")
    df = files.read_category_csv(spark, str(tmp_path / "product_*.csv"), "product_code long, name string")
    got = {(r["product_code"], r["name"], r["category"]) for r in df.collect()}
    assert got == {(1, "크림, 수분", "스킨 케어"), (2, "줄\n바꿈", "스킨 케어"), (3, "립", "메이크업")}


def test_strip_bom(spark):
    assert files.strip_bom(spark.createDataFrame([(1,)], "`﻿product_code` int")).columns == ["product_code"]


def test_responses(spark, tmp_path):
    ok = {"sentiment": "positive", "sentiment_score": 0.5, "aspect_labels": [], "evidence": "e", "summary": "s"}
    def line(i, status, content):
        return json.dumps({"custom_id": f"r-{i}", "response": {"status_code": status, "body": {"choices": [{"message": {"content": content}}]}}})
    path = tmp_path / "out.jsonl"
    path.write_text("\n".join([line(1, 200, json.dumps(ok)), line(2, 200, "not json"), line(3, 500, "x"), "garbage"]))
    got = {r["idx"]: (r["success"], r["error"]) for r in files.read_responses(spark, str(path)).collect()}
    assert got == {1: (True, None), 2: (False, "content is not valid JSON"), 3: (False, "status 500"), None: (False, "status missing")}


def test_bullets(spark, tmp_path):
    (tmp_path / "a.txt").write_text("• lost\n101\n• 정제수\n •글리세린\n\n102\ntext\n• 향료\n", encoding="utf-8")
    rows = files.parse_bullets(files.read_lines(spark, str(tmp_path))).orderBy("row").collect()
    assert [(r["product_id"], r["ingredient"]) for r in rows] == [(101, "정제수"), (101, "글리세린"), (102, "향료")]


def test_table_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    tables.insert(spark.createDataFrame([(1, "a")], "k int, s string"), path, "replace")
    tables.insert(spark.createDataFrame([(2, "b")], "k int, s string"), path, "append")
    new = tables.upsert_table(spark, path, spark.createDataFrame([(2, "B"), (3, "C")], "k int, s string"), ["k"], str(tmp_path / "t2"))
    assert sorted(map(tuple, new.collect())) == [(1, "a"), (2, "B"), (3, "C")]
    listing = tables.schema_listing(new).orderBy("position").collect()
    assert [(r["column_name"], r["column_type"]) for r in listing] == [("k", "int"), ("s", "string")]
    tables.truncate(spark, path)
    assert spark.read.parquet(path).count() == 0 and spark.read.parquet(path).columns == ["k", "s"]


def test_shared_folder_follows_the_session(spark):
    assert tables.shared_folder(spark) == tables.shared_folder(spark)
    assert tables.settle(spark.range(5)).count() == 5


SCHEMA = "row_no long, user_masked string, product_code long, date date, text string, rating double, image_count int"


def test_stream_continues_ids_and_drops_late_copies(spark, tmp_path):
    drops, target, progress = (str(tmp_path / n) for n in ("drops", "star", "progress"))

    def drop_and_run(rows):
        spark.createDataFrame(rows, "row_no long, user_masked string, product_code long, date string, text string, rating double, image_count int").withColumn(
            "date", F.to_date("date")
        ).select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.mode("append").parquet(drops)
        stream = st.read_drops(spark, drops, SCHEMA)
        writer = st.stream_reviews(stream, target, progress, ["row_no"], [F.expr("row_no div 100")])
        writer.trigger(availableNow=True).start().awaitTermination()

    drop_and_run([(1, "u*", 10, "2024-01-01", "a", 5.0, 0), (2, "v*", 10, "2024-06-01", "b", 4.0, 0), (3, "u*", 10, "2024-01-01", "a", 5.0, 0)])
    # a copy far behind the watermark, an old user and a new one
    drop_and_run([(4, "u*", 10, "2024-01-01", "a", 5.0, 0), (5, "v*", 11, "2024-06-02", "c", 4.0, 0), (6, "w*", 11, "2024-06-03", "d", 3.0, 0)])
    reviews = spark.read.parquet(f"{target}/reviews").orderBy("order_id").collect()
    assert [(r["order_id"], r["text"]) for r in reviews] == [(1, "a"), (2, "b"), (3, "c"), (4, "d")]
    users = spark.read.parquet(f"{target}/users").orderBy("user_id").collect()
    assert [(r["user_id"], r["user_masked"]) for r in users] == [(1, "u*"), (2, "v*"), (3, "w*")]
