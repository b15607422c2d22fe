"""Literal inputs with known results."""

import math

import pytest
from pyspark.sql import functions as F

from loomshelf.functions import significance as sig
from loomshelf.operators import aggregates as ag
from loomshelf.operators import dimensions as dim
from loomshelf.operators import evaluation as ev
from loomshelf.operators import ingredients as ig
from loomshelf.operators import labels as lb
from loomshelf.operators import quality as dq
from loomshelf.operators import review_features as rf
from loomshelf.operators import sampling as sm
from loomshelf.operators import text as tx


def values(df, col):
    return [r[col] for r in df.collect()]


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    "text,flag",
    [("재구매 너무 좋아요", True), ("좋아요", False), ("[재구매] 굿", True), ("재-구매", True), ("RE구매", True), (None, False)],
)
def test_reorder_pattern(spark, text, flag):
    assert one(spark, rf.reorder_by_pattern(F.lit(text).cast("string"))) is flag


def test_reorder_tag_and_word(spark):
    df = spark.createDataFrame([("재구매 | 좋아요",), ("[재구매] 굿",), ("재구매",), ("좋아요",)], "text string")
    assert values(rf.strip_reorder_tag(df), "text_cleaned") == ["좋아요", "굿", "좋아요"]
    assert values(df.select(rf.starts_with_word().alias("f")), "f") == [True, False, True, False]


def test_stop_words_and_frequency(spark):
    df = spark.createDataFrame([(["제품", "정말", "좋다", "것", "같다"],)], "tokens array<string>")
    assert df.select(tx.without_stop_words("tokens").alias("t")).first()["t"] == ["제품", "좋다"]
    docs = spark.createDataFrame([(["좋다", "제품"],), (["좋다", "가격"],)], "tokens array<string>")
    assert [tuple(r) for r in tx.top_keywords(docs, 3).collect()] == [("좋다", 2), ("가격", 1), ("제품", 1)]


def test_look_behind_pattern(spark):
    pattern = r"(?<!안\s)좋"
    assert one(spark, tx.matches(F.lit("안 좋아"), pattern)) == 0
    assert one(spark, tx.matches(F.lit("참 좋아"), pattern)) == 1


def test_target_language(spark):
    texts = ["좋아요 good", "only english", "ㅋㅋㅋㅋ", "ㅋㅋㅎㅎㅠㅠ", " ", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert values(df.select(dq.in_target_language("text").alias("k")), "k") == [True, False, False, True, False, False]


def test_numbers_in_text(spark):
    assert one(spark, dq.parse_price(F.lit("12,900원"))) == 12900
    assert one(spark, dq.parse_price(F.lit("무료"))) is None
    assert one(spark, dq.parse_rating(F.lit("4.5점"))) == 4.5
    assert one(spark, dq.parse_count(F.lit("없음"))) == 0


def test_product_page(spark):
    html = (
        '<h1 class="product-title"> 수분 크림 </h1><span class="value">3,000</span><p class="code-text">품번 1061921</p>'
        '<tr><th>제조국</th><td> 대한민국 </td></tr><b class="btn__count">1,234</b><b class="btn__count">56</b>'
    )
    df = spark.createDataFrame([("https://x/pd?pdNo=999", html), ("https://x/pd?pdNo=77", "<p></p>")], "url string, html string")
    a, b = dq.product_page_fields(df).drop("html", "url").collect()
    assert tuple(a) == ("1061921", "수분 크림", 3000, "대한민국", 1234, 56)
    assert tuple(b) == ("77", None, None, None, None, None)


def test_length_bins(spark):
    df = spark.createDataFrame([(n,) for n in (0, 20, 21, 500, 501)], "n int")
    assert values(df.select(dim.analysis_length_class("n").alias("c")), "c") == [None, "very_short", "short", "long", "very_long"]


def test_moments(spark):
    df = spark.createDataFrame([(float(x),) for x in (1, 2, 2, 3, 10)], "x double")
    r = ag.moments(df, "x").first()
    assert math.isclose(r["skewness"], 2.0286991, abs_tol=1e-6)
    assert math.isclose(r["kurtosis"], 4.2721465, abs_tol=1e-6)


def test_p_values(spark):
    # F(2, 12) = 3.8853 and |z| = 1.96 are the textbook 5 % points
    assert math.isclose(sig.f_tail(3.8853, 2, 12), 0.05, abs_tol=1e-4)
    assert math.isclose(sig.f_tail(1.0, 4, 4), 0.5, abs_tol=1e-9)
    groups = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("a", 3.0), ("b", 4.0), ("b", 5.0), ("b", 6.0)], "g string, v double")
    r = sig.anova(groups, "g", "v").first()
    assert math.isclose(r["f_stat"], 13.5) and math.isclose(r["p_value"], 0.021312, abs_tol=1e-5)
    u = sig.mann_whitney(groups, F.col("g") == "a", "v").first()
    assert (u["n1"], u["n2"], u["u_stat"]) == (3, 3, 0.0)
    assert math.isclose(u["p_value"], 0.0808556, abs_tol=1e-5)


@pytest.mark.parametrize(
    "counts,total,floor,expected",
    [
        ([("A", 900), ("B", 90), ("C", 10)], 100, 10, {"A": 74, "B": 16, "C": 10}),
        ([("A", 30), ("B", 20), ("C", 10)], 10, 5, {"A": 4, "B": 3, "C": 3}),
    ],
)
def test_quota_with_floor(spark, counts, total, floor, expected):
    df = spark.createDataFrame(counts, "u string, n long")
    assert {r["u"]: r["quota"] for r in sm.quotas_with_floor(df, "u", total, floor).collect()} == expected


def test_shards(spark):
    parts = sm.shards(spark.range(20_000), 6, ["id"], [F.expr("id div 1000")]).groupBy("shard").count()
    assert sorted(((r["shard"], r["count"]) for r in parts.collect())) == [(1, 3334), (2, 3334), (3, 3333), (4, 3333), (5, 3333), (6, 3333)]


def test_rule_labels(spark):
    df = spark.createDataFrame([(1, "배송 빠르고 포장 꼼꼼 가격 저렴 최고", 5.0), (2, "zz", 3.0)], "id int, text string, rating double")
    a, b = lb.label_reviews(df).orderBy("id").collect()
    assert (a["sentiment"], a["sentiment_score"]) == ("positive", 1.0)
    assert [x["aspect"] for x in a["aspect_labels"]] == ["배송/포장", "가격/가성비"]
    assert [x["confidence"] for x in a["aspect_labels"]] == [0.9, 0.8]
    assert a["aspect_labels"][1]["reason"] == "키워드 매칭: 가격, 저렴"
    assert [x["aspect"] for x in b["aspect_labels"]] == ["미분류"] and b["sentiment"] == "neutral"


def test_label_repair(spark):
    good = '{"sentiment":"great","sentiment_score":0.5,"aspect_labels":[{"aspect":"디자인","confidence":0.5}],"evidence":"","summary":"s"}'
    names = '{"sentiment":"negative","sentiment_score":-3,"aspect_labels":["디자인","없는것"],"evidence":"e","summary":"s"}'
    not_list = '{"sentiment":"neutral","sentiment_score":0,"aspect_labels":5,"evidence":"e","summary":"s"}'
    df = spark.createDataFrame([(1, good), (2, names), (3, not_list), (4, '{"sentiment":"x"}'), (5, "no json")], "id int, content string")
    r = {x["id"]: x for x in lb.repair_labels(df).collect()}
    assert (r[1]["sentiment"], r[1]["evidence"]) == ("positive", "N/A")
    assert [a["aspect"] for a in r[1]["aspect_labels"]] == ["미분류"]
    assert r[2]["sentiment_score"] == -1.0
    assert [(a["aspect"], a["sentiment"], a["confidence"]) for a in r[2]["aspect_labels"]] == [("디자인", "negative", 0.8)]
    assert [a["aspect"] for a in r[3]["aspect_labels"]] == ["미분류"]
    assert not r[4]["valid"] and not r[5]["valid"]


def test_roll_up(spark):
    rows = [(1, "사용감/성능", 0.82), (1, "재질/냄새", 0.61), (1, "가격/가성비", 0.74), (1, "배송/포장", 0.12)]
    df = spark.createDataFrame(rows, "id int, aspect string, score double")
    assert {r["parent"]: r["score"] for r in lb.roll_up(df, "id").collect()} == {"사용 체감": 0.82, "가격 가치": 0.74, "배송·유통 경험": 0.12}


def test_gold_sentiment_falls_back_to_overall(spark):
    label = "array<struct<aspect:string,sentiment:string>>"
    rows = [("A", "positive", "negative", [("A", "Positive")]), ("B", "negative", "negative", [("A", "positive")])]
    df = spark.createDataFrame(rows, f"corrected_aspect string, corrected_sentiment string, sentiment string, aspect_labels {label}")
    a, b = ev.judge_gold(df).collect()
    assert (a["aspect_match"], a["sentiment_match"]) == (True, True)
    assert (b["aspect_match"], b["sentiment_match"]) == (False, True)


@pytest.mark.parametrize(
    "text,expected",
    [
        ("1,2-헥산다이올, 정제수", ["1,2-헥산다이올", "정제수"]),
        ("정제수；글리세린， 향료", ["정제수", "글리세린", "향료"]),
        ("[클렌저] 정제수, 향료", ["[클렌저]", "정제수", "향료"]),
    ],
)
def test_split_items(spark, text, expected):
    assert one(spark, ig.split_items(F.lit(text))) == expected


def test_breaks_and_misreadings(spark):
    assert one(spark, ig.repair_breaks(F.lit("카프릴릭/\n카프릭, 폴리글리세릴-\n10, 트라이글리서라\n이드\n향료"))) == (
        "카프릴릭/카프릭, 폴리글리세릴-10, 트라이글리서라이드향료"
    )
    df = spark.createDataFrame([("트라이글리서라이드  정​제수",), ("한글",)], "text string")
    assert values(ig.normalise_text(df), "text") == ["트라이글리세라이드 정제수", "한글"]


def test_section(spark):
    text = "제품 설명 전성분: 정제수(용량 제외), 글리세린 주의사항: 상처"
    df = spark.createDataFrame([(text,), ("정제수, 향료",)], "text string")
    assert values(ig.extract_section(df), "section") == ["정제수(용량 제외), 글리세린", "정제수, 향료"]


def test_product_section(spark):
    by_option = "[52 인더다크] " + "정제수, 글리세린, 부틸렌글라이콜, 향료 " + "[53 인더라이트] 에탄올"
    by_heading = "감자캡슐팩\n에탄올\n화산송이 캡슐팩\n정제수, 글리세린, 부틸렌글라이콜,\n향료, 판테놀\n\n\n끝"
    df = spark.createDataFrame([(by_option, "본셉 [52 인더다크]"), (by_heading, "화산송이 캡슐팩"), ("짧은", "없는 제품")], "text string, product_name string")
    a, b, c = values(ig.pick_product_section(df), "text")
    assert a == "정제수, 글리세린, 부틸렌글라이콜, 향료"
    assert b == "정제수, 글리세린, 부틸렌글라이콜,\n향료, 판테놀"
    assert c == "짧은"


def test_concentration(spark):
    name, amount = ig.concentration(F.lit("병풀잎수(95%)"))
    assert (one(spark, name), one(spark, amount)) == ("병풀잎수", "95%")
    name, amount = ig.concentration(F.lit("정제수(물)"))
    assert (one(spark, name), one(spark, amount)) == ("정제수(물)", None)


def test_parse_whole_text(spark):
    text = "상품 안내\n전성분: 정제수, 병풀잎수(95%), 트라이글리서라\n이드, 글리 세린, 글리세린, SPF50, 합니다, 1,2-헥산다이올 ※ 주의사항 에탄올"
    df = spark.createDataFrame([(7, text)], "product_id int, text string")
    rows = ig.parse_ingredients(df, ["product_id"]).orderBy("pos").collect()
    assert [(r["ingredient"], r["concentration"]) for r in rows] == [
        ("정제수", None), ("병풀잎수", "95%"), ("트라이글리세라이드", None), ("글리세린", None), ("1,2-헥산다이올", None),
    ]


@pytest.mark.parametrize(
    "raw,clean",
    [
        ("전성분변성알코올", "변성알코올"),
        ("Complex블래더랙추출물", "블래더랙추출물"),
        ("슈퍼9콤플렉스아보카도", "아보카도"),
        ("10|하이드록사이드", "하이드록사이드"),
        ("1,2-헥산다이올", "1,2-헥산다이올"),
        ("솔비톨(44.79%)", "솔비톨"),
        ("색소(CI77891)", "색소(CI77891)"),
        ("글리세린(보습제)", "글리세린"),
        ("살리실릭애씨드*", "살리실릭애시드"),
    ],
)
def test_normalise_name(spark, raw, clean):
    assert one(spark, ig.normalise_name(F.lit(raw))) == clean


def test_score_names(spark):
    cases = {
        "정제수": (True, 1.0, "known_ingredient"),
        "가": (False, 0.0, "too_short"),
        "12.5": (False, 0.0, "pure_number"),
        "피부": (False, 0.0, "invalid_2char"),
        "발라주는": (False, 0.0, "verb_ending"),
        "녹차추출물": (True, 0.9, "pattern_match"),
        "PEG-40": (True, 0.9, "peg_ppg"),
        "리파아제": (True, 0.85, "enzyme"),
        "Glycerin": (True, 0.8, "english_chemical"),
        "SUPER9": (False, 0.0, "noise"),
        "소듐피씨에이치": (True, 0.85, "korean_chemical"),
        "Foobar": (False, 0.0, "english_noise"),
    }
    rows = spark.createDataFrame([(n,) for n in cases], "ingredient string")
    known = spark.createDataFrame([("정제수",)], "entry string")
    got = {r["ingredient"]: (r["valid"], r["confidence"], r["reason"]) for r in ig.score_names(rows, known).collect()}
    assert got == cases


def test_rules_chain_and_split(spark):
    assert ig.resolve_chains({"a": "b", "b": "c", "x": "a"}) == {"a": "c", "b": "c", "x": "a"}
    rows = [(1, "p", "계산"), (1, "p", "PDRN5"), (1, "p", "판테놀부틸렌글라이콜"), (1, "p", "기재정제수"), (1, "p", "정제수")]
    df = spark.createDataFrame(rows, "product_id int, name string, ingredient string")
    assert sorted(values(ig.apply_rules(df), "ingredient")) == ["PDRN", "부틸렌글라이콜", "정제수", "판테놀"]


def test_verdicts(spark):
    names = ["젤라틴", "에탄올", "글리세린", "정제수", "미지성분"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "product_id int, ingredient string")
    got = {r["ingredient"]: (r["can_halal"], r["can_vegan"]) for r in ig.verdicts(df).collect()}
    assert [got[n][0] for n in names] == ["No", "No", "Unknown", "Yes", "Yes"]
    assert [got[n][1] for n in names] == ["Unknown", "Unknown", "Unknown", "Yes", "Yes"]


def test_source_merge(spark):
    rows = [("a", "page", 0.9), ("a", "page", 0.9), ("a", "ocr", 0.9), ("b", "ocr", 0.6), ("b", "ocr", 0.6), ("c", "ocr", 0.5)]
    df = spark.createDataFrame([(1, *r) for r in rows], "product_id int, ingredient string, kind string, confidence double")
    got = {r["ingredient"]: round(r["confidence"], 6) for r in ig.merge_sources(df).collect()}
    assert got == {"a": 1.0, "b": round(0.6 * 0.9 + 0.15 + 2 * 0.05, 6)}
