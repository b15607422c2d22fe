"""Draws by a cut hash give the rows of a full ranking."""

import hashlib

import pytest
from pyspark.sql import functions as F

from loomshelf.functions.draws import take_per_group


def plain(rows, quotas, seed):
    out = []
    for g, q in quotas.items():
        own = sorted((hashlib.md5(f"{seed}|{k}".encode()).hexdigest(), k) for k, h in rows if h == g)
        out += [(k, g) for _, k in own[: max(q or 0, 0)]]
    return sorted(out, key=str)


@pytest.mark.parametrize("digits", [1, 2, 3])
def test_the_rows_of_a_full_ranking(spark, digits):
    rows = [(i, "big") for i in range(3000)] + [(i, "small") for i in range(3000, 3040)] + [(i, None) for i in range(4000, 4200)] + [(9000 + i % 2, "tied") for i in range(30)]
    quotas = {"big": 700, "small": 60, None: 37, "tied": 20, "none": 5, "zero": 0}
    df = spark.createDataFrame(rows + [(5000, "zero")], "k bigint, g string").repartition(5)
    wanted = spark.createDataFrame(list(quotas.items()), "g string, quota int")
    got = take_per_group(df, wanted, ["g"], "k", "s", digits=digits)
    assert sorted(map(tuple, got.collect()), key=str) == plain(rows, quotas, "s")


def test_no_row_is_ranked_but_those_of_the_last_block(spark):
    df = spark.range(20_000).select(F.col("id").alias("k"), F.lit("g").alias("g"))
    text = take_per_group(df, spark.createDataFrame([("g", 9000)], "g string, quota int"), ["g"], "k", 1)._jdf.queryExecution().optimizedPlan().toString()
    ranked = [line for line in text.splitlines() if "row_number()" in line]
    assert len(ranked) == 1 and text.count("Union") == 1  # the branch of whole blocks has no window but that of the counts
    assert "(_blk" in text and "= _last" in text


def test_blocks_are_counted_in_two_steps(spark):
    """No count is kept for every block of a group, only for 16 and for the parts of one of them."""
    df = spark.range(40_000).select(F.col("id").alias("k"), (F.col("id") % 4).cast("string").alias("g")).repartition(3)
    wanted = spark.createDataFrame([(str(i), 2500 * i) for i in range(4)] + [("4", 9)], "g string, quota int")
    got = take_per_group(df, wanted, ["g"], "k", "s")
    assert sorted(map(tuple, got.collect()), key=str) == plain([(i, str(i % 4)) for i in range(40_000)], {str(i): 2500 * i for i in range(4)}, "s")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert ", 1, 1)" in plan and ", 1, 3)" in plan
    # the drawn rows meet the cuts where they are read
    assert plan.count("strategy=broadcast") >= 2
