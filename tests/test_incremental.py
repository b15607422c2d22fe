"""Incremental labelling: which ids a batch opens."""

import random

from pyspark.sql import functions as F

from loomshelf.streaming import id_filters as f
from loomshelf.streaming import incremental as st


def ids(spark, values):
    return spark.createDataFrame([(v,) for v in values], "order_id bigint").repartition(2)


def test_a_batch_opens_only_the_ids_that_its_hits_name(spark, tmp_path):
    root, rng = f"{tmp_path}/h", random.Random(1)
    size = f.RANGE
    batches = [[*range(500)], [*range(size, size + 300)], [*range(500, 900), *range(5 * size, 5 * size + 50)], [-7, None, 3]]
    for n, own in enumerate(batches):
        f.remember(ids(spark, own), "order_id", root, n)
    folder = lambda b, r: f"{root}/ids/batch_id={b}/id_range={r}"
    named = lambda own, n: f.named_folders(ids(spark, own), "order_id", root, n)
    assert named([10, 20, 3 * size], 3) == [folder(0, 0)]
    assert named([size + 5], 9) == [folder(1, 1)]
    assert named([600, 5 * size + 1, -7], 9) == [folder(2, 0), folder(2, 5), folder(3, -1)]
    assert named([2 * size, None], 9) == [] and named([10], 0) == []
    # unseen ids of a known range rarely open anything, and never count as handled
    unseen = [rng.randrange(1000, size) for _ in range(50)]
    assert len(named(unseen, 9)) <= 3
    got = f.handled(ids(spark, [*unseen, 5, 5, 700, None]), "order_id", root, 9)
    assert {5, 700} <= {r.order_id for r in got.collect()} and not {*unseen} & {r.order_id for r in got.collect()}
    looked_up = f.handled(ids(spark, [10]), "order_id", root, 3)
    opened = {p.rpartition("/")[0].removeprefix("file://") for p in looked_up.inputFiles()}
    assert opened == {folder(0, 0)}


def test_no_handled_id_is_missed_and_replays_overwrite(spark, tmp_path):
    root = f"{tmp_path}/h"
    own = random.Random(4).sample(range(10 * f.RANGE), 3000)
    for _ in range(2):
        f.remember(ids(spark, own), "order_id", root, 0)
    assert {r.order_id for r in f.handled(ids(spark, own), "order_id", root, 1).collect()} == set(own)
    assert f.handled(ids(spark, own), "order_id", root, 0).count() == 0  # the batch itself is not earlier
    f.remember(ids(spark, []), "order_id", root, 1)
    assert f.handled(ids(spark, own[:10]), "order_id", root, 2).count() == 10


CRAWL = "row_no bigint, user_masked string, product_code bigint, date date, text string, rating double, image_count int"


def dropped(spark, path, rows):
    """One more file in the drop folder."""
    days = spark.createDataFrame(rows, "row_no bigint, user_masked string, product_code bigint, day string, text string")
    out = days.select("row_no", "user_masked", "product_code", F.to_date("day").alias("date"), "text", F.lit(5.0).alias("rating"), F.lit(0).alias("image_count"))
    out.coalesce(1).write.mode("append").parquet(path)


def test_reviews_of_several_drops(spark, tmp_path):
    drops, target, progress = f"{tmp_path}/drops", f"{tmp_path}/star", f"{tmp_path}/progress"
    batches = [
        [(1, "a", 1, "2024-01-05", "x"), (2, "b", 1, "2024-01-06", "y"), (3, "a", 1, "2024-01-05", "x")],
        [(4, "c", 1, "2024-02-01", "z"), (5, "a", 1, "2024-01-05", "x"), (6, None, 1, "2024-02-02", "w"), (7, "", 2, "2024-02-02", "w")],  # a late copy
        [(8, "b", 1, "2024-01-06", "y"), (9, "b", 2, "2024-01-06", "y"), (10, "d", 1, "2024-03-01", "v")],
    ]
    for rows in batches:
        dropped(spark, drops, rows)
        stream = st.read_drops(spark, drops, CRAWL)
        st.stream_reviews(stream, target, progress, ["row_no"], [F.expr("row_no div 100")]).trigger(availableNow=True).start().awaitTermination()
    users = {r.user_masked: r.user_id for r in spark.read.parquet(f"{target}/users").collect()}
    assert users == {"a": 1, "b": 2, "c": 3, "d": 4}
    got = [(r.order_id, r.user_id, r.product_code, str(r.write_date), r.text) for r in spark.read.parquet(f"{target}/reviews").collect()]
    assert len({g[0] for g in got}) == len(got)
    assert sorted(g[1:] for g in got if g[1]) == [(1, 1, "2024-01-05", "x"), (2, 1, "2024-01-06", "y"), (2, 2, "2024-01-06", "y"), (3, 1, "2024-02-01", "z"), (4, 1, "2024-03-01", "v")]
    # the next batch would open the folders of its users and no others
    asked = spark.createDataFrame([("b",), ("nobody",)], "user_masked string")
    want = {r.b for r in asked.select(st._user_bucket().alias("b")).collect()}
    found = st.known_users(spark, target, asked, 99)
    opened = {int(r.p.split("bucket=")[1].split("/")[0]) for r in found.select(F.input_file_name().alias("p")).collect()}
    assert opened <= want and "b" in {r.user_masked for r in found.collect()}
    scan = next(line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in line)
    assert all(part in scan.split("PartitionFilters")[1].split("PushedFilters")[0] for part in ("batch_id", "bucket"))


def test_a_text_moves_once_and_null_texts_are_kept_apart(spark, tmp_path):
    drops, target, progress = f"{tmp_path}/drops", f"{tmp_path}/star", f"{tmp_path}/progress"
    long = "word " * 50
    rows = [(i, f"u{i % 7}", i % 5, "2024-01-05", f"{long}{i % 20}") for i in range(60)] + [(100, "n", 1, "2024-01-05", None), (101, "n", 1, "2024-01-05", None)]
    plans = []

    class Spy:
        @staticmethod
        def put(df, path, batch, *by):
            if "_staging/" not in f"{path}/":
                plans.append((path.rpartition("/")[2], df._jdf.queryExecution().optimizedPlan().toString()))
            return put(df, path, batch, *by)

    put, st._put = st._put, Spy.put
    try:
        for _ in range(2):
            dropped(spark, drops, rows)
            stream = st.read_drops(spark, drops, CRAWL)
            st.stream_reviews(stream, target, progress, ["row_no"], [F.expr("row_no div 100")]).trigger(availableNow=True).start().awaitTermination()
    finally:
        st._put = put
    got = [(r.product_code, r.user_id, r.text) for r in spark.read.parquet(f"{target}/reviews").collect()]
    users = {r.user_masked: r.user_id for r in spark.read.parquet(f"{target}/users").collect()}
    # NULL is one text within a drop, but never that of a loaded row
    assert sorted(got, key=str) == sorted([*{(p, users[u], t) for _, u, p, _, t in rows}, (1, users["n"], None)], key=str)
    # rows are keyed without their texts
    keyed = [plan for name, plan in plans if name in ("users", "_staging_ids")]
    assert len(keyed) == 4 and not any(" min(struct" in p and "text#" in p.split("Aggregate", 1)[1].split("\n", 1)[0] for p in keyed)
    assert not any(line for plan in keyed for line in plan.splitlines() if "Join" in line and "text#" in line)


def test_labels_take_the_first_copy_without_moving_texts(spark):
    rows = [(1, 7, 2.0, "b"), (1, 7, 2.0, "a"), (1, 7, 2.0, "a"), (2, 7, 1.0, "x"), (2, 7, 1.0, "x"), (3, 7, 1.0, "done"), (4, 1, None, None), (4, 1, None, "y"), (None, 1, 1.0, "n"), (None, 1, 1.0, "m")]
    rows += [(i, 1, 5.0, f"text {i}") for i in range(10, 200)] * 2
    staged = spark.createDataFrame(rows, "order_id bigint, product_code bigint, rating double, text string").repartition(3)
    staged = staged.withColumns({st.DIGEST: st._text_digest(), st.PLACE: F.monotonically_increasing_id()}).localCheckpoint()
    done = spark.createDataFrame([(3,)], "order_id bigint")
    got = sorted(((r.order_id, r.product_code, r.rating, r.text) for r in st._first_copies(staged, done).collect()), key=str)
    want = [(1, 7, 2.0, "a"), (2, 7, 1.0, "x"), (4, 1, None, None), (None, 1, 1.0, "m"), *[(i, 1, 5.0, f"text {i}") for i in range(10, 200)]]
    assert got == sorted(want, key=str)
