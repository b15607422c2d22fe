"""Sampling, labelling and evaluation queries (LB*)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomshelf.catalog.registry import query, rounded
from loomshelf.operators import evaluation as ev
from loomshelf.operators import labels as lb
from loomshelf.operators import sampling as sm
from loomshelf.sources import tables
from loomshelf.sources import views as v
from loomshelf.sources.views import with_views

PR = ("products", "reviews")
# quotas for the supplied data, which is smaller than the shop's
TARGET, FLOOR_1, FLOOR_2, WHOLE = 2000, 100, 20, ["PROMO"]
SENT = "CASE WHEN rating BETWEEN 0 AND 2 THEN 'negative' WHEN rating > 2 AND rating <= 3 THEN 'neutral' WHEN rating > 3 AND rating <= 5 THEN 'positive' END"
POOL = f"""SELECT order_key || '-' || line_no || '-' || product_code || '-' || supplier_key || '-' || quantity AS review_key, category_1, category_2, rating,
{SENT} AS sentiment_group FROM reviews JOIN products USING (product_code)"""


def pool(spark, sf):
    p = v.products(spark, sf).select("product_code", "category_1", "category_2")
    key = F.concat_ws("-", "order_key", "line_no", "product_code", "supplier_key", "quantity")
    return v.reviews(spark, sf).join(p, "product_code").select(key.alias("review_key"), "category_1", "category_2", "rating")


@query(
    "lb1_sentiment_groups",
    with_views("SELECT category_1, sentiment_group, count(*) AS n FROM pool GROUP BY 1, 2", *PR, pool=POOL),
)
def lb1(spark, sf):
    d = pool(spark, sf).withColumn("sentiment_group", sm.sentiment_group())
    return d.groupBy("category_1", "sentiment_group").agg(F.count(F.lit(1)).alias("n"))


def quota_sql(counts: str, unit: str, total: str, floor: int, by: str = "") -> str:
    part = f"PARTITION BY {by} " if by else ""
    over = f"({part.strip()})"
    return f"""SELECT * EXCLUDE (pos, k, s, rest, base, fst, tot), base + CASE WHEN fst = 1 AND rest >= 0 THEN tot - sum(base) OVER {over} ELSE 0 END AS quota FROM (
    SELECT *, row_number() OVER ({part}ORDER BY base DESC, pos) AS fst FROM (
    SELECT *, CASE WHEN rest < 0 THEN tot // k + CASE WHEN pos <= tot % k THEN 1 ELSE 0 END ELSE {floor} + (rest * n) // s END AS base FROM (
    SELECT *, {total} AS tot, count(*) OVER {over} AS k, CAST(sum(n) OVER {over} AS BIGINT) AS s, row_number() OVER ({part}ORDER BY n DESC, {unit}) AS pos,
    {total} - {floor} * count(*) OVER {over} AS rest FROM {counts})))"""


TOPS = {
    "c1": "SELECT category_1, count(*) AS n FROM pool GROUP BY 1",
    "q1": quota_sql("c1", "category_1", str(TARGET), FLOOR_1),
    "c2": "SELECT p.category_1, CASE WHEN p.category_1 <> 'PROMO' THEN category_2 END AS category_2, count(*) AS n, any_value(quota) AS oq FROM pool p JOIN q1 USING (category_1) GROUP BY 1, 2",
    "q2": quota_sql("c2", "category_2", "oq", FLOOR_2, "category_1"),
}


@query("lb2_quotas", with_views("SELECT category_1, n, CAST(quota AS BIGINT) AS quota FROM q1", *PR, pool=POOL, **TOPS))
def lb2(spark, sf):
    counts = pool(spark, sf).groupBy("category_1").agg(F.count(F.lit(1)).alias("n"))
    return sm.quotas_with_floor(counts, "category_1", TARGET, FLOOR_1)


def settled_pool(spark, sf):
    """The pool is read many times over (counts, quotas, draws), so the join behind it is written once."""
    return tables.settle(pool(spark, sf), "pool")


def quotas(rows):
    return sm.two_level_quotas(rows, target=TARGET, floor_outer=FLOOR_1, floor_inner=FLOOR_2, whole=WHOLE)


@query("lb3_two_level_quotas", with_views("SELECT category_1, category_2, n, CAST(quota AS BIGINT) AS quota FROM q2", *PR, pool=POOL, **TOPS))
def lb3(spark, sf):
    return quotas(settled_pool(spark, sf))


DRAWN = {
    "drawn": """SELECT review_key, category_1, category_2, rating, sentiment_group FROM (SELECT p.*, quota, row_number() OVER (PARTITION BY q2.category_1, q2.category_2
    ORDER BY md5('42|' || review_key), review_key) AS rn FROM pool p JOIN q2 ON p.category_1 = q2.category_1
    AND q2.category_2 IS NOT DISTINCT FROM CASE WHEN p.category_1 <> 'PROMO' THEN p.category_2 END) WHERE rn <= quota"""
}


def drawn(rows):
    return sm.stratified_sample(rows, quotas(rows), ["category_1", "category_2"], "review_key", whole={"category_1": WHOLE})


@query("lb4_stratified_sample", with_views("SELECT review_key, category_1, category_2 FROM drawn", *PR, pool=POOL, **TOPS, **DRAWN))
def lb4(spark, sf):
    return drawn(settled_pool(spark, sf)).select("review_key", "category_1", "category_2")


BALANCED = {
    "flagged": "SELECT p.*, d.review_key IS NOT NULL AS in_sample FROM pool p LEFT JOIN drawn d ON d.review_key = p.review_key",
    "have": """SELECT g.s AS sentiment_group, g.goal, g.o, count(*) FILTER (in_sample) AS i, count(*) FILTER (NOT in_sample) AS u FROM
    (VALUES ('positive', 800, 0), ('neutral', 600, 1), ('negative', 600, 2)) g(s, goal, o) LEFT JOIN flagged f ON f.sentiment_group = g.s GROUP BY 1, 2, 3""",
    "plan": """SELECT *, greatest(0, least(spare, (SELECT sum(i + a) - 2000 FROM (SELECT i, greatest(0, least(goal - i, u)) AS a FROM have)) - earlier)) AS remove FROM (
    SELECT *, coalesce(sum(spare) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS earlier FROM (
    SELECT *, greatest(0, least(goal - i, u)) AS add, greatest(0, i + greatest(0, least(goal - i, u)) - goal) AS spare FROM have))""",
    "balanced": """SELECT f.review_key, f.sentiment_group, f.in_sample, f.rating FROM (SELECT *, row_number() OVER (PARTITION BY sentiment_group, in_sample
    ORDER BY md5('42-balance|' || review_key), review_key) AS rn FROM flagged) f JOIN plan USING (sentiment_group)
    WHERE rn <= CASE WHEN in_sample THEN i - remove ELSE add END""",
}


def balanced(spark, sf):
    rows = settled_pool(spark, sf)
    return sm.balance_sentiment(rows, tables.settle(drawn(rows), "sample"), "review_key", TARGET)


@query(
    "lb5_balanced_sample",
    with_views("SELECT review_key, sentiment_group, in_sample FROM balanced", *PR, pool=POOL, **TOPS, **DRAWN, **BALANCED),
)
def lb5(spark, sf):
    return balanced(spark, sf).select("review_key", "sentiment_group", "in_sample")


@query(
    "lb6_sample_report",
    with_views(
        """SELECT s AS sentiment_group, count(d.review_key) AS n, round(100.0::DOUBLE * count(d.review_key) / (SELECT count(*) FROM drawn), 8) AS pct,
        t AS target_pct, round(100.0::DOUBLE * count(d.review_key) / (SELECT count(*) FROM drawn) - t, 8) AS diff
        FROM (VALUES ('negative', 30.0::DOUBLE), ('neutral', 30.0::DOUBLE), ('positive', 40.0::DOUBLE)) g(s, t) LEFT JOIN drawn d ON d.sentiment_group = g.s GROUP BY s, t""",
        *PR,
        pool=POOL,
        **TOPS,
        **DRAWN,
    ),
)
def lb6(spark, sf):
    return rounded(sm.sample_report(drawn(settled_pool(spark, sf))), "pct", "target_pct", "diff")


@query(
    "lb6_duplicates",
    with_views("SELECT count(*) - count(DISTINCT (category_1, category_2, rating)) AS n_duplicates FROM pool", *PR, pool=POOL),
)
def lb6b(spark, sf):
    return sm.duplicate_count(pool(spark, sf), ["category_1", "category_2", "rating"])


@query(
    "lb7_shards",
    with_views(
        "SELECT order_id, CAST(ntile(6) OVER (ORDER BY order_id) AS INTEGER) AS shard, row_number() OVER (ORDER BY order_id) - 1 AS original_index FROM doc_reviews",
        "doc_reviews",
    ),
)
def lb7(spark, sf):
    d = v.doc_reviews(spark, sf).select("order_id")
    return sm.shards(d, 6, ["order_id"], [F.expr("order_id div 4294967296"), F.expr("order_id div 65536")])


# keyword lists for the supplied corpus
ASPECTS = {
    "ship": ["than", "ent", "than"],
    "price": ["eau", "ción", "gel"],
    "feel": ["tion", "sch", "ist", "ado"],
    "look": ["bl", "oi", "ung", "ñ"],
}
POS, NEG, NEU = ["best", "bon", "gut", "and"], ["idiot", "thor", "nicht", "pas"], ["mit", "sur", "para"]


def score_sql(words) -> str:
    return " + ".join(f"contains(low, '{w}')::INTEGER" for w in words)


def hits_sql(aspects) -> str:
    return " UNION ALL ".join(
        f"SELECT order_id, {i} AS pos, '{a}' AS aspect, {score_sql(w)} AS score, "
        f"array_to_string(list_filter([{', '.join(repr(x) for x in w)}], lambda x: contains(low, x))[1:3], ', ') AS matched FROM low"
        for i, (a, w) in enumerate(aspects.items())
    )


LABELLED = {
    "low": "SELECT *, lower(text) AS low FROM doc_reviews",
    "hits": hits_sql(ASPECTS),
    "found": """SELECT order_id, pos, rn, aspect, round(least(0.9, 0.5 + 0.15 * score), 2)::DOUBLE AS confidence, '키워드 매칭: ' || matched AS reason FROM (
    SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY score DESC, pos) AS rn FROM hits WHERE score > 0) WHERE rn <= 3
    UNION ALL SELECT order_id, 0, 1, '미분류', 0.5::DOUBLE, '일반적 표현' FROM low WHERE order_id NOT IN (SELECT order_id FROM hits WHERE score > 0)""",
    "votes": f"""SELECT *, {score_sql(POS)} + CASE WHEN rating >= 4 THEN 2 ELSE 0 END AS p, {score_sql(NEG)} + CASE WHEN rating <= 2 THEN 2 ELSE 0 END AS m,
    {score_sql(NEU)} + CASE WHEN rating = 3 THEN 1 ELSE 0 END AS z FROM low""",
    "verdict": """SELECT *, CASE WHEN p > m AND p > z THEN 'positive' WHEN m > p AND m > z THEN 'negative' ELSE 'neutral' END AS sentiment,
    CASE WHEN p > m AND p > z THEN least(1.0, 0.5 + 0.1 * p) WHEN m > p AND m > z THEN greatest(-1.0, -0.5 - 0.1 * m) ELSE 0 END::DOUBLE AS sentiment_score FROM votes""",
}


def labelled(spark, sf):
    return lb.label_reviews(v.doc_reviews(spark, sf), lb.rule_labeller(ASPECTS, POS, NEG, NEU))


@query("lb8_rule_aspects", with_views("SELECT order_id, CAST(rn AS INTEGER) AS rank, aspect, confidence, reason FROM found", "doc_reviews", **LABELLED))
def lb8(spark, sf):
    found = lb.with_rule_aspects(v.doc_reviews(spark, sf).select("order_id", "text"), ASPECTS)
    d = found.select("order_id", F.posexplode_outer("aspects").alias("pos", "a"))
    return d.select("order_id", (F.col("pos") + 1).alias("rank"), "a.aspect", "a.confidence", "a.reason")


# Korean reviews by rule: two or three of the shipped keywords, picked by the id and the length of the text
KEYWORDS = [w for words in lb.ASPECT_KEYWORDS.values() for w in words]
PICKS = ["order_id", "order_id * 13 + length(text)"]
KOREAN_LOW = f"SELECT order_id, lower(concat_ws(' ', text, {', '.join(f'ws[1 + ({p}) % {len(KEYWORDS)}]' for p in PICKS)}, CASE WHEN order_id % 9 = 0 THEN '그냥' END)) AS low FROM doc_reviews, (SELECT [{', '.join(repr(w) for w in KEYWORDS)}] AS ws)"


@query(
    "lb8_rule_aspects_korean",
    with_views(
        "SELECT order_id, aspect, confidence, reason FROM found",
        "doc_reviews",
        low=KOREAN_LOW,
        hits=hits_sql(lb.ASPECT_KEYWORDS),
        found=LABELLED["found"],
    ),
)
def lb8k(spark, sf):
    """The shipped Korean keyword lists over whole texts that end in Korean words."""
    words = F.array(*[F.lit(w) for w in KEYWORDS])
    picked = [F.element_at(words, (F.expr(p) % len(KEYWORDS) + 1).cast("int")) for p in PICKS]
    korean = v.doc_reviews(spark, sf).select("order_id", F.concat_ws(" ", "text", *picked, F.when(F.col("order_id") % 9 == 0, "그냥")).alias("text"))
    found = lb.with_rule_aspects(korean)
    return found.select("order_id", F.explode_outer("aspects").alias("a")).select("order_id", "a.*")


@query("lb9_rule_sentiment", with_views("SELECT order_id, sentiment, round(sentiment_score, 2) AS sentiment_score FROM verdict", "doc_reviews", **LABELLED))
def lb9(spark, sf):
    return labelled(spark, sf).select("order_id", "sentiment", "sentiment_score")


@query(
    "lb10_label_rows",
    with_views(
        """SELECT order_id, aspect, sentiment AS overall_sentiment, sentiment AS aspect_sentiment, confidence AS aspect_confidence,
        CASE WHEN length(text) > 100 THEN substr(text, 1, 100) || '...' ELSE text END AS evidence,
        CASE WHEN length(text) > 30 THEN substr(text, 1, 30) || '...' ELSE text END AS summary FROM found JOIN verdict USING (order_id)""",
        "doc_reviews",
        **LABELLED,
    ),
)
def lb10(spark, sf):
    cols = ("order_id", "aspect", "overall_sentiment", "aspect_sentiment", "aspect_confidence", "evidence", "summary")
    return lb.explode_labels(labelled(spark, sf)).select(*cols)


def raw_labels(spark, sf):
    """Label JSON with the usual faults, made from the corpus."""
    d = v.doc_reviews(spark, sf)
    score = (F.col("rating") - 3) / F.when(F.col("lang") == "de", 1).otherwise(2)
    sentiment = F.when(F.col("lang") == "fr", F.lit("great")).when(F.col("rating") >= 4, "positive").otherwise("negative")
    confidence = F.when(F.col("rating") >= 3, 0.9).otherwise(0.5)
    as_object = F.struct(F.col("lang").alias("aspect"), F.lit("odd").alias("sentiment"), confidence.alias("confidence"), F.col("source").alias("reason"))
    items = F.when(F.col("lang") == "es", F.lit('["es", "zz"]')).otherwise(F.concat(F.lit("["), F.to_json(as_object), F.lit("]")))
    body = F.concat(
        F.lit('{"sentiment":"'), sentiment, F.lit('","sentiment_score":'), score.cast("string"), F.lit(',"aspect_labels":'), items,
        F.when(F.col("rating") == 5, F.lit("")).otherwise(F.lit(',"evidence":" "')), F.lit(',"summary":"'), "source", F.lit('"}'),
    )
    return d.select("order_id", body.alias("content"))


@query(
    "lb11_repair_labels",
    with_views(
        """SELECT order_id, rating <> 5 AS valid, CASE WHEN rating <> 5 THEN CASE WHEN lang = 'fr' THEN CASE WHEN sc > 0.2 THEN 'positive' WHEN sc < -0.2 THEN 'negative' ELSE 'neutral' END
        WHEN rating >= 4 THEN 'positive' ELSE 'negative' END END AS sentiment, CASE WHEN rating <> 5 THEN greatest(-1, least(1, sc)) END AS sentiment_score,
        CASE WHEN rating <> 5 THEN CASE WHEN lang = 'es' OR (rating >= 3 AND lang <> 'en') THEN lang ELSE '미분류' END END AS aspect,
        CASE WHEN rating <> 5 THEN CASE WHEN lang = 'es' THEN 0.8 WHEN rating >= 3 AND lang <> 'en' THEN 0.9 ELSE 1.0 END END::DOUBLE AS confidence,
        CASE WHEN rating <> 5 THEN 'N/A' END AS evidence, CASE WHEN rating <> 5 THEN source END AS summary
        FROM (SELECT *, (rating - 3) / CASE WHEN lang = 'de' THEN 1 ELSE 2 END AS sc FROM doc_reviews)""",
        "doc_reviews",
    ),
)
def lb11(spark, sf):
    d = lb.repair_labels(raw_labels(spark, sf), aspects=["es", "de", "fr", lb.UNCLASSIFIED])
    a = F.get("aspect_labels", F.lit(0))
    return d.select("order_id", "valid", "sentiment", "sentiment_score", a["aspect"].alias("aspect"), a["confidence"].alias("confidence"), "evidence", "summary")


@query(
    "lb12_repair_judgements",
    with_views(
        """SELECT order_id, CASE WHEN rating = 1 THEN 'uncertain' WHEN rating <= 3 THEN 'fix' ELSE 'ok' END AS judgment,
        least(1.0, rating / 4) AS confidence, source AS reason,
        CASE WHEN rating IN (2, 3) THEN CASE WHEN lang = 'en' THEN 'neutral' END ELSE CASE WHEN lang = 'en' THEN 'neutral' ELSE lang END END AS fixed_sentiment,
        CASE WHEN rating IN (2, 3) THEN CASE WHEN lang = 'fr' THEN 'fr' ELSE '' END ELSE lang || ',x' END AS fixed_aspects FROM doc_reviews""",
        "doc_reviews",
    ),
)
def lb12(spark, sf):
    r = F.col("rating")
    label = F.struct(
        F.when(F.col("lang") == "en", "neutral").otherwise(F.col("lang")).alias("sentiment"), F.array("lang", F.lit("x")).alias("aspect_labels")
    )
    judgement = F.when(r == 1, "maybe").when(r <= 3, "fix").otherwise("ok")
    content = F.to_json(
        F.struct(judgement.alias("judgment"), (r / 4).alias("confidence"), F.col("source").alias("reason"), label.alias("fixed_label"))
    )
    d = lb.repair_judgements(v.doc_reviews(spark, sf).select("order_id", content.alias("content")), aspects=["fr"])
    return d.select("order_id", "judgment", "confidence", "reason", "fixed_sentiment", F.array_join("fixed_aspects", ",").alias("fixed_aspects"))


LONG_LABELS = "SELECT order_id, text, rating, aspect, confidence, sentiment, source AS model FROM found JOIN verdict USING (order_id)"
DOUBT = "confidence < 0.7 OR (rating >= 4 AND sentiment = 'negative') OR (rating <= 2 AND sentiment = 'positive')"


def long_labels(spark, sf):
    d = lb.explode_labels(labelled(spark, sf))
    return d.select(
        "order_id", "text", "rating", "aspect", F.col("aspect_confidence").alias("confidence"), F.col("aspect_sentiment").alias("sentiment"), F.col("source").alias("model")
    )


@query(
    "lb13_review_queue",
    with_views(
        f"SELECT DISTINCT order_id, aspect FROM ll WHERE {DOUBT}", "doc_reviews", **LABELLED, ll=LONG_LABELS
    ),
)
def lb13(spark, sf):
    return lb.review_queue(long_labels(spark, sf), ["order_id"]).select("order_id", "aspect")


FIXES = f"""SELECT DISTINCT order_id AS head, aspect, CASE WHEN aspect = 'look' THEN 'REMOVE' WHEN order_id % 5 > 0 THEN 'neutral' END AS s FROM ll WHERE {DOUBT}"""


@query(
    "lb14_merge_reviewed",
    with_views(
        """SELECT order_id, ll.aspect, CASE WHEN s IS NULL THEN sentiment ELSE s END AS sentiment, CASE WHEN s IS NULL THEN confidence ELSE 0.95 END::DOUBLE AS confidence,
        CASE WHEN s IS NULL THEN model ELSE 'judge' END AS model FROM ll LEFT JOIN fixes ON order_id = head AND ll.aspect = fixes.aspect
        WHERE s IS NULL OR s <> 'REMOVE'""",
        "doc_reviews",
        **LABELLED,
        ll=LONG_LABELS,
        fixes=FIXES,
    ),
)
def lb14(spark, sf):
    """Every fifth review comes back without a sentiment: its labels stay as they were."""
    labels = long_labels(spark, sf)
    verdict = F.when(F.col("aspect") == "look", "REMOVE").when(F.col("order_id") % 5 > 0, "neutral")
    reviewed = lb.review_queue(labels, ["order_id"]).withColumns(
        {"sentiment": verdict, "confidence": F.lit(0.95), "model": F.lit("judge")}
    )
    return lb.merge_reviewed(labels, reviewed).select("order_id", "aspect", "sentiment", "confidence", "model")


KEYED = "SELECT *, order_id || '/' || aspect AS label_key FROM ll"
GOLD = {
    "ll": LONG_LABELS,
    "keyed": KEYED,
    "cells": """SELECT label_key, aspect, sentiment FROM (SELECT *, row_number() OVER (PARTITION BY aspect, sentiment ORDER BY md5('42|' || label_key), label_key) AS rn FROM keyed)
    WHERE rn <= 5""",
    "fill": """SELECT label_key, aspect, sentiment FROM (SELECT *, row_number() OVER (ORDER BY md5('42-fill|' || label_key), label_key) AS rn FROM keyed
    WHERE label_key NOT IN (SELECT label_key FROM cells)) WHERE rn <= 100 - (SELECT count(*) FROM cells)""",
}


def gold(spark, sf):
    keyed = long_labels(spark, sf).withColumn("label_key", F.concat_ws("/", "order_id", "aspect"))
    return sm.gold_set(tables.settle(keyed, "labels"), "label_key", 5, 100)


@query(
    "lb15_gold_set",
    with_views("SELECT *, false AS is_fill FROM cells UNION ALL SELECT *, true FROM fill", "doc_reviews", **LABELLED, **GOLD),
)
def lb15(spark, sf):
    return gold(spark, sf).select("label_key", "aspect", "sentiment", "is_fill")


@query(
    "lb16_union_teams",
    with_views(
        """SELECT order_id, rating, CAST(NULL AS VARCHAR) AS lang, 1 AS team FROM doc_reviews WHERE rating <= 3
        UNION ALL SELECT order_id, rating, lang, 2 FROM doc_reviews WHERE rating >= 4""",
        "doc_reviews",
    ),
)
def lb16(spark, sf):
    d = v.doc_reviews(spark, sf)
    return sm.union_teams({1: d.where("rating <= 3").select("order_id", "rating"), 2: d.where("rating >= 4").select("order_id", "rating", "lang")})


SPLIT = "CASE WHEN rn <= n - ceil(n * 30 / 100) THEN 'train' WHEN rn <= n - ceil(ceil(n * 30 / 100) * 15 / 30) THEN 'valid' ELSE 'test' END AS split"


@query(
    "lb17_split_by_group",
    with_views(
        f"""SELECT order_id, product_code, split FROM doc_reviews JOIN (SELECT u, {SPLIT} FROM (SELECT u, row_number() OVER (ORDER BY md5('42|' || u), u) AS rn, count(*) OVER () AS n
        FROM (SELECT DISTINCT 'group-' || product_code AS u FROM doc_reviews))) ON u = 'group-' || product_code""",
        "doc_reviews",
    ),
)
def lb17(spark, sf):
    return sm.split_by_group(v.doc_reviews(spark, sf).select("order_id", "product_code"), "product_code", "order_id")


@query(
    "lb18_split_by_stratum",
    with_views(
        f"""SELECT order_id, sentiment, {SPLIT} FROM (SELECT order_id, s AS sentiment, row_number() OVER (PARTITION BY s ORDER BY md5('42|' || order_id), order_id) AS rn,
        count(*) OVER (PARTITION BY s) AS n FROM (SELECT order_id, {SENT} AS s FROM doc_reviews))""",
        "doc_reviews",
    ),
)
def lb18(spark, sf):
    d = v.doc_reviews(spark, sf).select("order_id", sm.sentiment_group().alias("sentiment"))
    return sm.split_by_stratum(d, "sentiment", "order_id").select("order_id", "sentiment", "split")


NAMES = [*ASPECTS, lb.UNCLASSIFIED]


@query(
    "lb19_encode_labels",
    with_views(
        """SELECT order_id, CAST(CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS INTEGER) AS sentiment_id, """
        + " || ".join(f"max(CASE WHEN aspect = '{a}' THEN '1' ELSE '0' END)" for a in NAMES)
        + " AS aspect_vector FROM found JOIN verdict USING (order_id) GROUP BY 1, 2",
        "doc_reviews",
        **LABELLED,
    ),
)
def lb19(spark, sf):
    d = lb.encode_labels(labelled(spark, sf), NAMES)
    return d.select("order_id", "sentiment_id", F.array_join(F.transform("aspect_vector", lambda x: x.cast("string")), "").alias("aspect_vector"))


@query(
    "lb20_class_weights",
    with_views(
        """SELECT s AS sentiment, count(v.order_id) AS n, round(CASE WHEN count(v.order_id) = 0 THEN 0 ELSE (SELECT count(*) FROM verdict) / (4 * count(v.order_id)) END, 8) AS weight
        FROM (VALUES ('negative'), ('neutral'), ('positive'), ('mixed')) g(s) LEFT JOIN verdict v ON v.sentiment = s GROUP BY s""",
        "doc_reviews",
        **LABELLED,
    ),
)
def lb20(spark, sf):
    return rounded(lb.class_weights(labelled(spark, sf), "sentiment", [*lb.SENTIMENTS, "mixed"]), "weight")


PROBS = {
    "probs": """SELECT order_id, (order_id % 7) / 16 AS p0, (16 - order_id % 7 - order_id % 9) / 16 AS p1, (order_id % 9) / 16 AS p2,
    (order_id % 11) / 8 AS a0, (order_id % 5) / 8 AS a1, (order_id % 3) / 2 AS a2, (order_id % 13) / 8 AS a3 FROM doc_reviews""",
    "scored": """SELECT *, greatest(p0, p1, p2) AS best, CASE WHEN p0 >= p1 AND p0 >= p2 THEN 'negative' WHEN p1 >= p2 THEN 'neutral' ELSE 'positive' END AS sentiment,
    concat_ws(',', CASE WHEN a0 >= 0.5 THEN 'ship' END, CASE WHEN a1 >= 0.5 THEN 'price' END, CASE WHEN a2 >= 0.5 THEN 'feel' END, CASE WHEN a3 >= 0.5 THEN 'look' END) AS aspects
    FROM probs""",
}


def model_output(spark, sf):
    """Stand-in for model probabilities, a function of the document number in sixteenths."""
    k = F.col("order_id")
    probs = F.array(k % 7 / 16, (16 - k % 7 - k % 9) / 16, k % 9 / 16)
    return v.doc_reviews(spark, sf).select(
        "order_id", probs.alias("sentiment_probs"), F.array(k % 11 / 8, k % 5 / 8, k % 3 / 2, k % 13 / 8).alias("aspect_probs")
    )


@query(
    "lb21_score_probabilities",
    with_views(
        """SELECT order_id, sentiment, p2 - p0 AS sentiment_score, best AS sentiment_confidence, aspects,
        best < 0.6 OR a0 BETWEEN 0.4 AND 0.6 OR a1 BETWEEN 0.4 AND 0.6 OR a2 BETWEEN 0.4 AND 0.6 OR a3 BETWEEN 0.4 AND 0.6 AS is_ambiguous FROM scored""",
        "doc_reviews",
        **PROBS,
    ),
)
def lb21(spark, sf):
    d = lb.score_probabilities(model_output(spark, sf), list(ASPECTS))
    return d.select("order_id", "sentiment", "sentiment_score", "sentiment_confidence", F.array_join("aspects", ",").alias("aspects"), "is_ambiguous")


@query(
    "lb22_summary",
    with_views(
        """SELECT order_id, CASE WHEN aspects = '' THEN '전반적으로 ' || sentiment ELSE array_to_string(string_split(aspects, ',')[1:3], ', ') ||
        CASE WHEN len(string_split(aspects, ',')) > 3 THEN ' 등' ELSE '' END || '에 대해 ' ||
        CASE sentiment WHEN 'positive' THEN '긍정적' WHEN 'neutral' THEN '중립적' ELSE '부정적' END END AS summary FROM scored""",
        "doc_reviews",
        **PROBS,
    ),
)
def lb22(spark, sf):
    d = lb.score_probabilities(model_output(spark, sf), list(ASPECTS))
    return d.select("order_id", lb.template_summary().alias("summary"))


TRUTH = {
    "gt": f"""SELECT d.*, CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS truth, {SENT} AS pred
    FROM doc_reviews d JOIN labels l ON l.doc_id = d.order_id"""
}


def judged_pairs(spark, sf):
    truth = v.table(spark, sf, "labels").select(
        F.col("doc_id").alias("order_id"),
        F.when(F.col("toxic") == 1, "negative").when(F.col("quality") == 1, "positive").otherwise("neutral").alias("truth"),
    )
    return v.doc_reviews(spark, sf).join(truth, "order_id").withColumn("pred", sm.sentiment_group())


CLASSES = {
    "k": """SELECT c, count(*) FILTER (truth = c) AS support, count(*) FILTER (pred = c) AS predicted, count(*) FILTER (truth = c AND pred = c) AS tp
    FROM gt, (VALUES ('negative'), ('neutral'), ('positive')) g(c) GROUP BY 1""",
    "m": """SELECT *, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS p, CASE WHEN support = 0 THEN 0 ELSE tp / support END AS r,
    CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f FROM k""",
}


@query(
    "lb23_multiclass_metrics",
    with_views(
        "SELECT 'accuracy' AS metric, round(sum(tp) / sum(support), 8) AS value FROM m"
        + "".join(
            f" UNION ALL SELECT '{n}_macro', round(avg({c}), 8) FROM m UNION ALL SELECT '{n}_weighted', round(sum({c} * support) / sum(support), 8) FROM m"
            for n, c in (("precision", "p"), ("recall", "r"), ("f1", "f"))
        ),
        "doc_reviews",
        **TRUTH,
        **CLASSES,
    ),
)
def lb23(spark, sf):
    return rounded(ev.multiclass_metrics(judged_pairs(spark, sf), "truth", "pred"), "value")


@query(
    "lb23_per_class",
    with_views(
        'SELECT c AS "class", support, predicted, tp, round(p, 8) AS precision, round(r, 8) AS recall, round(f, 8) AS f1 FROM m', "doc_reviews", **TRUTH, **CLASSES
    ),
)
def lb23b(spark, sf):
    return rounded(ev.per_class(judged_pairs(spark, sf), "truth", "pred"), "precision", "recall", "f1")


MULTI = {
    "sets": "SELECT order_id, unnest(['look', 'feel', 'price', 'ship']) AS aspect FROM doc_reviews",
    "flags": """SELECT s.aspect, f.order_id IS NOT NULL AS t, list_contains(string_split(scored.aspects, ','), s.aspect) AS p FROM sets s
    LEFT JOIN found f ON f.order_id = s.order_id AND f.aspect = s.aspect JOIN scored ON scored.order_id = s.order_id""",
    "k": "SELECT aspect, count(*) FILTER (t AND p) AS tp, count(*) FILTER (p) AS predicted, count(*) FILTER (t) AS support FROM flags GROUP BY 1",
    "m": CLASSES["m"],
}


def two_sets(spark, sf):
    truth = labelled(spark, sf).select("order_id", F.filter(F.col("aspect_labels.aspect"), lambda a: a != lb.UNCLASSIFIED).alias("truth"))
    pred = lb.score_probabilities(model_output(spark, sf), list(ASPECTS)).select("order_id", F.col("aspects").alias("pred"))
    return truth.join(pred, "order_id")


@query(
    "lb24_multilabel_metrics",
    with_views(
        """SELECT 'precision_micro' AS metric, round(sum(tp) / sum(predicted), 8) AS value FROM m UNION ALL SELECT 'recall_micro', round(sum(tp) / sum(support), 8) FROM m
        UNION ALL SELECT 'f1_micro', round(2 * sum(tp) / (sum(predicted) + sum(support)), 8) FROM m UNION ALL SELECT 'precision_macro', round(avg(p), 8) FROM m
        UNION ALL SELECT 'recall_macro', round(avg(r), 8) FROM m UNION ALL SELECT 'f1_macro', round(avg(f), 8) FROM m""",
        "doc_reviews",
        **LABELLED,
        **PROBS,
        **MULTI,
    ),
)
def lb24(spark, sf):
    return rounded(ev.multilabel_metrics(two_sets(spark, sf), "truth", "pred"), "value")


@query(
    "lb24_per_aspect",
    with_views(
        "SELECT aspect, tp, predicted, support, round(p, 8) AS precision, round(r, 8) AS recall, round(f, 8) AS f1 FROM m",
        "doc_reviews",
        **LABELLED,
        **PROBS,
        **MULTI,
    ),
)
def lb24b(spark, sf):
    return rounded(ev.per_aspect(two_sets(spark, sf), "truth", "pred"), "precision", "recall", "f1")


@query(
    "lb25_confusion",
    with_views(
        "SELECT truth, " + ", ".join(f"count(*) FILTER (pred = '{s}') AS pred_{s}" for s in lb.SENTIMENTS) + " FROM gt GROUP BY 1", "doc_reviews", **TRUTH
    ),
)
def lb25(spark, sf):
    return ev.confusion(judged_pairs(spark, sf), "truth", "pred", lb.SENTIMENTS)


@query(
    "lb25_aspect_support",
    with_views(
        """SELECT aspect, count(*) AS support, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM doc_reviews), 8) AS pct FROM found WHERE aspect <> '미분류' GROUP BY 1""",
        "doc_reviews",
        **LABELLED,
    ),
)
def lb25b(spark, sf):
    return rounded(ev.aspect_support(two_sets(spark, sf), "truth"), "pct")


GOLD_ROWS = {
    **TRUTH,
    "gold": """SELECT v.order_id, v.text, truth AS corrected_sentiment, CASE v.order_id % 4 WHEN 0 THEN 'ship' WHEN 1 THEN 'price' WHEN 2 THEN 'feel' ELSE 'look' END AS corrected_aspect,
    v.sentiment FROM verdict v JOIN gt USING (order_id)""",
    "judged": """SELECT g.*, f.order_id IS NOT NULL AS aspect_match, g.sentiment AS pred_sentiment, g.sentiment = corrected_sentiment AS sentiment_match
    FROM gold g LEFT JOIN found f ON f.order_id = g.order_id AND f.aspect = corrected_aspect""",
}


def judged(spark, sf):
    truth = judged_pairs(spark, sf).select("order_id", F.col("truth").alias("corrected_sentiment"))
    names = F.array(*[F.lit(a) for a in ASPECTS])
    rows = labelled(spark, sf).join(truth, "order_id")
    return ev.judge_gold(rows.withColumn("corrected_aspect", F.element_at(names, (F.col("order_id") % 4 + 1).cast("int"))))


@query(
    "lb26_gold_accuracy",
    with_views(
        """SELECT count(*) AS total, round(avg(aspect_match::INTEGER), 8) AS aspect_accuracy, round(avg(sentiment_match::INTEGER), 8) AS sentiment_accuracy,
        round(avg((aspect_match AND sentiment_match)::INTEGER), 8) AS both_accuracy FROM judged""",
        "doc_reviews",
        **LABELLED,
        **GOLD_ROWS,
    ),
)
def lb26(spark, sf):
    return rounded(ev.gold_accuracy(judged(spark, sf)), "aspect_accuracy", "sentiment_accuracy", "both_accuracy")


@query(
    "lb26_gold_accuracy_by",
    with_views(
        """SELECT 'aspect' AS dimension, corrected_aspect AS value, count(*) AS total, count(*) FILTER (aspect_match) AS correct, round(avg(aspect_match::INTEGER), 8) AS accuracy FROM judged GROUP BY 2
        UNION ALL SELECT 'sentiment', corrected_sentiment, count(*), count(*) FILTER (sentiment_match), round(avg(sentiment_match::INTEGER), 8) FROM judged GROUP BY 2""",
        "doc_reviews",
        **LABELLED,
        **GOLD_ROWS,
    ),
)
def lb26b(spark, sf):
    return rounded(ev.gold_accuracy_by(judged(spark, sf)), "accuracy")


@query(
    "lb26_gold_errors",
    with_views(
        "SELECT order_id, substr(text, 1, 50) || '...' AS text, aspect_match, sentiment_match FROM judged WHERE NOT (aspect_match AND sentiment_match)",
        "doc_reviews",
        **LABELLED,
        **GOLD_ROWS,
    ),
)
def lb26c(spark, sf):
    return ev.gold_errors(judged(spark, sf)).select("order_id", "text", "aspect_match", "sentiment_match")


TREE = {"service": ["ship", "price"], "product": ["feel", "look", "price"]}


@query(
    "lb27_roll_up",
    with_views(
        """SELECT order_id, parent, max(confidence) AS score FROM found JOIN (VALUES ('service', 'ship'), ('service', 'price'), ('product', 'feel'), ('product', 'look'), ('product', 'price'))
        t(parent, aspect) USING (aspect) GROUP BY 1, 2""",
        "doc_reviews",
        **LABELLED,
    ),
)
def lb27(spark, sf):
    scores = lb.explode_labels(labelled(spark, sf)).select("order_id", "aspect", F.col("aspect_confidence").alias("score"))
    return lb.roll_up(scores, "order_id", TREE)


@query("lb28_sentiment_counts", with_views("SELECT sentiment, count(*) AS n_reviews FROM verdict GROUP BY 1", "doc_reviews", **LABELLED))
def lb28(spark, sf):
    return lb.sentiment_counts(labelled(spark, sf))


@query(
    "lb28_aspects_per_review",
    with_views(
        "SELECT CAST(n AS INTEGER) AS n_aspects, count(*) AS n_reviews FROM (SELECT order_id, count(*) AS n FROM found GROUP BY 1) GROUP BY 1", "doc_reviews", **LABELLED
    ),
)
def lb28b(spark, sf):
    return lb.aspects_per_review(labelled(spark, sf))


@query(
    "lb28_aspect_sentiment_pivot",
    with_views(
        "SELECT aspect, " + ", ".join(f"count(*) FILTER (sentiment = '{s}') AS {s}" for s in lb.SENTIMENTS) + ", count(*) AS total FROM found JOIN verdict USING (order_id) GROUP BY 1",
        "doc_reviews",
        **LABELLED,
    ),
)
def lb28c(spark, sf):
    return lb.aspect_sentiment_pivot(lb.explode_labels(labelled(spark, sf)))


@query("lb29_not_yet_labelled", with_views("SELECT order_id FROM doc_reviews WHERE order_id NOT IN (SELECT doc_id FROM labels)", "doc_reviews"))
def lb29(spark, sf):
    done = v.table(spark, sf, "labels").select(F.col("doc_id").alias("order_id"))
    return lb.not_yet_labelled(v.doc_reviews(spark, sf).select("order_id"), done, "order_id")


@query(
    "lb29_reuse_labels",
    with_views(
        """, k AS (SELECT order_id, rating, md5(text || '|' || product_code || '|' || CAST(CAST(rating AS INTEGER) AS VARCHAR) || '|' || lang) AS cache_key FROM doc_reviews),
        c AS (SELECT cache_key, max(rating) AS cached FROM k WHERE rating >= 4 GROUP BY 1)
        SELECT order_id, cache_key, c.cache_key IS NOT NULL AS cache_hit FROM k LEFT JOIN c USING (cache_key)""",
        "doc_reviews",
    ),
)
def lb29b(spark, sf):
    d = v.doc_reviews(spark, sf)
    parts = ["text", "product_code", F.col("rating").cast("int"), "lang"]
    cache = d.where("rating >= 4").groupBy(lb.cache_key(*parts).alias("cache_key")).agg(F.max("rating").alias("cached"))
    return lb.reuse_labels(d, cache, *parts).select("order_id", "cache_key", "cache_hit")


@query(
    "lb30_labelling_cost",
    with_views(
        """SELECT *, round((tokens_input * i + tokens_output * o) / 1000, 8) AS cost, round((tokens_input * i + tokens_output * o) / 1000 / n_labels, 8) AS mean_cost FROM (
        SELECT CASE WHEN lang = 'en' THEN 'gpt-4o-mini' WHEN lang = 'es' THEN 'unpriced' ELSE 'gpt-4o' END AS model, count(*) AS n_labels, CAST(sum(length(text)) AS BIGINT) AS tokens_input,
        CAST(sum(order_id % 97) AS BIGINT) AS tokens_output FROM doc_reviews GROUP BY 1) LEFT JOIN (VALUES ('gpt-4o-mini', 0.00015::DOUBLE, 0.0006::DOUBLE), ('gpt-4o', 0.0025::DOUBLE, 0.01::DOUBLE)) p(model, i, o) USING (model)""",
        "doc_reviews",
    ).replace("SELECT *, round(", "SELECT model, n_labels, tokens_input, tokens_output, round("),
)
def lb30(spark, sf):
    d = v.doc_reviews(spark, sf).select(
        F.when(F.col("lang") == "en", "gpt-4o-mini").when(F.col("lang") == "es", "unpriced").otherwise("gpt-4o").alias("model"),
        F.length("text").cast("long").alias("tokens_input"),
        (F.col("order_id") % 97).alias("tokens_output"),
    )
    return rounded(lb.labelling_cost(d), "cost", "mean_cost")


@query(
    "lb31_risk_reasons",
    with_views(
        """SELECT order_id, concat_ws(',', CASE WHEN sentiment <> CASE WHEN rating <= 2 THEN 'negative' WHEN rating = 3 THEN 'neutral' ELSE 'positive' END THEN 'rating_mismatch' END,
        CASE WHEN regexp_matches(text, 'idiot|thor') AND sentiment <> 'negative' THEN 'negative_keyword' END, CASE WHEN regexp_matches(text, 'mais|aber|pero') THEN 'contrast' END,
        CASE WHEN length(text) >= 50 THEN 'long_text' END, CASE WHEN confidence BETWEEN 0.3 AND 0.5 THEN 'low_confidence' END) AS reasons
        FROM verdict JOIN (SELECT order_id, min(confidence) AS confidence FROM found GROUP BY 1) USING (order_id)""",
        "doc_reviews",
        **LABELLED,
    ),
)
def lb31(spark, sf):
    d = labelled(spark, sf).withColumn("confidence", F.array_min(F.col("aspect_labels.confidence")))
    return d.select("order_id", F.array_join(lb.risk_reasons(negative=["idiot", "thor"], contrast=["mais", "aber", "pero"]), ",").alias("reasons"))
