"""Results that must hold on any data: skew, order, brute-force equality."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.functions.quantiles import exact_quantiles, running_before
from loomshelf.functions.ranking import bucketed_row_number, keep_first
from loomshelf.functions.draws import take_per_group
from loomshelf.operators import dimensions as dim
from loomshelf.operators import ingredients as ig
from loomshelf.operators import review_features as rf
from loomshelf.operators import sampling as sm


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of all rows under one key, some keys NULL."""
    df = spark.range(6000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 97).cast("string")).alias("k"),
        ((F.col("id") * 7919) % 6007).alias("v"),
    )
    return df.repartition(7)


def test_keep_first_equals_row_number(skewed):
    first = Window.partitionBy("k").orderBy("v")
    want = skewed.withColumn("rn", F.row_number().over(first)).where("rn = 1").drop("rn")
    got = keep_first(skewed, ["k"], ["v"])
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_bucketed_row_number(skewed, keys):
    want = skewed.withColumn("rn", F.row_number().over(Window.partitionBy(*keys).orderBy("v")).cast("long"))
    for buckets in ([F.expr("v div 500")], [F.expr("v div 2000"), F.expr("v div 100")]):
        got = bucketed_row_number(skewed, ["v"], buckets, keys)
        assert sorted(map(tuple, got.select("id", "rn").collect())) == sorted(map(tuple, want.select("id", "rn").collect()))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(3)
    xs = np.concatenate([rng.normal(size=2000), rng.lognormal(3, 2, 1500), -rng.lognormal(1, 3, 500), np.zeros(900), np.full(2500, 4.25)])
    df = spark.createDataFrame([(float(x), "s" if i % 3 else "t") for i, x in enumerate(xs)], "x double, g string").repartition(5)
    probs = {"a": 0.0, "b": 0.1, "c": 1 / 3, "d": 0.5, "e": 0.9, "f": 1.0}
    r = exact_quantiles(df, {"x": probs}).first()
    for n, p in probs.items():
        assert np.isclose(r[n], np.quantile(xs, p), rtol=1e-12, atol=0)
    for row in exact_quantiles(df, {"x": {"m": 0.5}}, by=["g"]).collect():
        part = [x for i, x in enumerate(xs) if ("s" if i % 3 else "t") == row["g"]]
        assert np.isclose(row["m"], np.quantile(part, 0.5), rtol=1e-12)


def test_running_before(spark):
    rows = [(float(v), w) for v, w in zip(range(-300, 300), range(600))]
    random.Random(1).shuffle(rows)
    got = running_before(spark.createDataFrame(rows, "v double, w long"), "v", "w").collect()
    ordered = sorted(rows)
    want = {v: sum(w for _, w in ordered[:i]) for i, (v, _) in enumerate(ordered)}
    assert {r["v"]: r["before"] for r in got} == want


def test_sample_size_and_repeatability(skewed):
    quotas = skewed.groupBy("k").agg(F.lit(25).alias("quota"))
    a = take_per_group(skewed, quotas, ["k"], "id", 42)
    b = take_per_group(skewed.repartition(3, "v"), quotas, ["k"], "id", 42)
    ids = sorted(r["id"] for r in a.collect())
    assert ids == sorted(r["id"] for r in b.collect()) and len(ids) == len(set(ids))
    have = {r["k"]: r["count"] for r in skewed.groupBy("k").count().collect()}
    assert {r["k"]: r["count"] for r in a.groupBy("k").count().collect()} == {k: min(25, n) for k, n in have.items()}


def test_quotas_sum_and_balance(spark):
    pool = spark.range(3000).select(
        F.concat(F.lit("r"), F.col("id").cast("string")).alias("key"),
        (F.col("id") % 5).cast("string").alias("category_1"),
        (F.col("id") % 11).cast("string").alias("category_2"),
        F.when(F.col("id") % 10 == 0, 1.0).when(F.col("id") % 10 == 1, 3.0).otherwise(5.0).alias("rating"),
    )
    quotas = sm.two_level_quotas(pool, target=700, floor_outer=20, floor_inner=3)
    assert quotas.agg(F.sum("quota")).first()[0] == 700
    drawn = sm.stratified_sample(pool, quotas, ["category_1", "category_2"], "key")
    assert drawn.count() == 700
    final = sm.balance_sentiment(pool, drawn, "key", 700)
    counts = {r["sentiment_group"]: r["count"] for r in final.groupBy("sentiment_group").count().collect()}
    assert counts == {"negative": 210, "neutral": 210, "positive": 280}
    assert final.select("key").distinct().count() == 700


def test_splits_keep_groups_together(spark):
    df = spark.range(1000).select("id", (F.col("id") % 40).alias("g"))
    out = sm.split_by_group(df, "g", "id")
    assert out.groupBy("g").agg(F.count_distinct("split").alias("n")).where("n > 1").count() == 0
    sizes = {r["split"]: r["n"] for r in out.groupBy("split").agg(F.count_distinct("g").alias("n")).collect()}
    assert sizes == {"train": 28, "valid": 6, "test": 6}
    few = sm.split_by_group(df.withColumn("g", F.col("id") % 5), "g", "id", by="auto")
    assert {r["split"]: r["count"] for r in few.groupBy("split").count().collect()} == {"train": 700, "valid": 150, "test": 150}


def test_upsert_twice_is_once(spark):
    target = spark.createDataFrame([(1, "a", 1.0), (2, "b", 2.0)], "k int, s string, x double")
    source = spark.createDataFrame([(2, None), (3, "c")], "k int, s string")
    once = dim.upsert(target, source, ["k"])
    assert sorted(map(tuple, once.collect())) == [(1, "a", 1.0), (2, None, 2.0), (3, "c", None)]
    assert sorted(map(tuple, dim.upsert(once, source, ["k"]).collect())) == sorted(map(tuple, once.collect()))


def _edit(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("cutoff", [0.6, 0.75, 0.8])
def test_correct_names_equals_brute_force(spark, cutoff):
    rnd = random.Random(5)
    words = ["".join(rnd.choice("가나다라마") for _ in range(rnd.randint(1, 12))) for _ in range(60)]

    def spoil(w):
        w = list(w)
        for _ in range(rnd.randint(0, 3)):
            at = rnd.randrange(len(w) + 1)
            w[at : at + rnd.randint(0, 1)] = rnd.choice(["", "가", "바"])
        return "".join(w) or "가"

    names = sorted({spoil(rnd.choice(words)) for _ in range(150)})
    got = ig.correct_names(
        spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(w,) for w in words], "entry string"), cutoff
    )
    known = set(words)
    for r in got.collect():
        n = r["name"]
        near = [(-round(1 - _edit(n, w) / max(len(n), len(w)), 9), w) for w in known if 1 - _edit(n, w) / max(len(n), len(w)) >= cutoff - 1e-9]
        want = n if n in known else (min(near)[1] if near else n)
        assert r["corrected"] == want and r["is_known"] == (n in known)


def test_certified_equals_brute_force(spark):
    rnd = random.Random(9)
    text = lambda n: "".join(rnd.choice("ab c") for _ in range(n)).strip() or "a"
    products = [(i, text(rnd.randint(1, 14))) for i in range(120)]
    certs = [(i, text(rnd.randint(1, 14)).upper()) for i in range(60)] + [(99, " ")]
    got = ig.certified(
        spark.createDataFrame(products, "id int, name string"), spark.createDataFrame(certs, "cert_id int, cert_name string")
    )
    want = {}
    for i, p in products:
        hits = [c for c, n in certs if n.strip() and (p.lower() in n.lower() or n.lower() in p.lower())]
        want[i] = min(hits) if hits else None
    assert {r["id"]: r["cert_id"] for r in got.collect()} == want


def test_dedup_items_keeps_longest_at_first_position(spark):
    rows = [(1, 0, "글리 세린"), (1, 1, "향료"), (1, 2, "글리세린"), (1, 3, "글 리 세 린")]
    got = ig.dedup_items(spark.createDataFrame(rows, "p int, pos int, ingredient string"), ["p"])
    assert sorted(map(tuple, got.select("pos", "ingredient").collect())) == [(0, "글 리 세 린"), (1, "향료")]


def test_a_brand_on_every_name_brings_no_pairs(spark):
    from loomshelf.operators import ingredients as ig

    products = spark.createDataFrame([(f"Brandname product number {i}",) for i in range(3000)], "name string")
    certificates = spark.createDataFrame([(i, f"brandname product number {i}") for i in range(0, 3000, 2)], "cert_id int, cert_name string")
    got = {r.name: r.cert_id for r in ig.certified(products, certificates).where("is_certified").collect()}
    want = {}
    names = {i: f"brandname product number {i}" for i in range(0, 3000, 2)}
    for i in range(3000):
        n = f"brandname product number {i}"
        hits = [k for k in names if str(names[k])[len("brandname product number ") :] == str(i) or n.startswith(names[k]) or names[k].startswith(n)]
        if hits:
            want[f"Brandname product number {i}"] = min(hits)
    assert got == want


def test_repurchases_join_reviews_once_and_take_null_keys(spark):
    products = spark.createDataFrame([(1, "A", "x"), (2, "A", "y"), (3, None, "y"), (4, "B", None)], "product_code bigint, brand string, category_2 string")
    reviews = spark.createDataFrame(
        [(1, u, p, r) for u in (1, None) for p, r in ((1, True), (2, True), (2, False), (3, True), (9, True), (4, False), (4, True))] + [(1, 2, 1, True), (1, 2, 2, None)],
        "n int, user_id bigint, product_code bigint, is_reorder boolean",
    )
    out = rf.with_repurchase(reviews, products)
    rows = [(r.user_id, r.product_code, r.brand, r.category_2, r.is_reorder, r.is_brand_repurchase, r.is_category_repurchase) for r in out.collect()]
    for user, _, brand, category, again, b, c in rows:
        mine = [r for r in rows if r[0] == user and r[4]]
        assert b == int(bool(again) and sum(r[2] == brand for r in mine) > 1)
        assert c == int(bool(again) and sum(r[3] == category for r in mine) > 1)
    assert len(rows) == 16 and {r[5] for r in rows} == {r[6] for r in rows} == {0, 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join LeftOuter") == 3  # reviews with products, twice, and with the users' lists


def test_simple_extract_works_each_piece_out_once(spark):
    words = ["abc", "CI77891", "Ab12", "(x)abc", "[q]", "é1", "±abc*", "-ab-", "a", "42", "CI", "A(b", "Zz​"]
    df = spark.createDataFrame([(1, " ".join(words) + ",Last;x|yy")], "doc_id bigint, text string")
    out = ig.simple_extract(df, ["doc_id"], remove=[], phrases=[], misreadings={})
    got = {r.original: r.normalized for r in out.collect()}
    assert got == {"abc": "abc", "CI77891": "CI77891", "Ab12": "Ab", "(x)abc": "abc", "±abc*": "abc", "-ab-": "ab", "CI": "CI", "A(b": "A(b", "Zz​": "Zz", "Last": "Last", "yy": "yy"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CI\\d+") == 1


def test_rules_are_applied_where_rows_are_read(spark):
    rows = [(1, "a"), (1, "a"), (1, "gone"), (2, "old"), (2, "new"), (2, " "), (3, "xhead"), (3, "headx"), (3, "both"), (3, None), (None, "a"), (4, "dot.x")]
    df = spark.createDataFrame(rows, "product_id bigint, ingredient string").repartition("product_id")
    out = ig.apply_rules(df, ["gone"], {"old": "mid", "mid": "new"}, ["^head", r"^dot\.", "zz"], {"both": ["p ", "", "q"]}, keys=["product_id"])
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "a"), (2, "new"), (3, "xhead"), (3, "x"), (3, "p"), (3, "q"), (None, "a"), (4, "x")], key=str)
    # rows that are dealt out by product are not shuffled again, neither to their names nor to drop repeats
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("Exchange hashpartitioning") == 1
