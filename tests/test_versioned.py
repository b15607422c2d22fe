"""Versioned tables: what a change rewrites, what it leaves, and what a failed one leaves."""

import pytest
from pyspark.sql import functions as F

from loomshelf.sources import versioned as vt

SCHEMA = "k bigint, g string, v string, n int"


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema).repartition(3)


def content(spark, path, version=None):
    return sorted((tuple(r) for r in vt.read(spark, path, version).collect()), key=str)


@pytest.fixture
def table(spark, tmp_path):
    rows = [(i, f"g{i % 3}", f"v{i}", i) for i in range(300)] + [(None, "g0", "null key", -1)]
    path = f"{tmp_path}/t"
    vt.create(frame(spark, rows), path, ["k", "g"], 16)
    return path, rows


def test_upsert_rewrites_the_buckets_of_its_keys_only(spark, table):
    path, rows = table
    before = vt.data_files(spark, path)
    source = frame(spark, [(5, "g2", "changed"), (7, "g1", None), (1000, "g0", "new")], "k bigint, g string, v string")
    vt.upsert(source, path)
    want = {(k, g): (k, g, v, n) for k, g, v, n in rows} | {(5, "g2"): (5, "g2", "changed", 5), (7, "g1"): (7, "g1", None, 7), (1000, "g0"): (1000, "g0", "new", None)}
    assert content(spark, path) == sorted(want.values(), key=str)
    assert content(spark, path, 1) == sorted(rows, key=str)  # the version before can still be read
    after = vt.data_files(spark, path)
    changed = {b for b in after if after[b] != before.get(b)}
    touched = {r.b for r in source.select(vt._bucket(["k", "g"], 16).alias("b")).distinct().collect()}
    assert changed == touched and len(touched) < 4


def test_deletes_write_no_data_and_compaction_rewrites_what_they_hit(spark, table):
    path, rows = table
    before = vt.data_files(spark, path)
    vt.delete(frame(spark, [(i, f"g{i % 3}") for i in range(0, 40, 2)], "k bigint, g string"), path)
    vt.delete(frame(spark, [(1, "g1"), (2, "g2"), (9999, "g0"), (None, "g0"), (3, "other")], "k bigint, g string"), path)
    want = sorted((r for r in rows if r[0] is None or not (r[0] < 40 and r[0] % 2 == 0 or r[0] == 1)), key=str)
    assert content(spark, path) == want and vt.data_files(spark, path) == before
    cut = {e["bucket"] for e in vt.manifest(spark, path) if e["deletes"]}
    vt.compact(spark, path)
    after = vt.data_files(spark, path)
    assert content(spark, path) == want and {b for b in before if after.get(b) != before[b]} == cut
    assert all(not e["deletes"] for e in vt.manifest(spark, path)) and vt.compact(spark, path) == max(vt._versions(spark, path))


def test_changes_follow_each_other(spark, table):
    path, rows = table
    vt.delete(frame(spark, [(4, "g1")], "k bigint, g string"), path)
    vt.upsert(frame(spark, [(4, "g1", "back", 44)]), path)
    vt.delete(frame(spark, [(8, "g2")], "k bigint, g string"), path)
    want = [r for r in rows if r[0] not in (4, 8)] + [(4, "g1", "back", 44)]
    assert content(spark, path) == sorted(want, key=str)


def test_a_failed_write_leaves_the_version_before(spark, table):
    path, rows = table
    broken = frame(spark, [(5, "g2", "x", 1)]).withColumn("n", F.raise_error(F.lit("lost")).cast("int"))
    with pytest.raises(Exception, match="lost"):
        vt.upsert(broken, path)
    assert content(spark, path) == sorted(rows, key=str) and max(vt._versions(spark, path)) == 1
    # a second writer of the same version loses
    entries = vt.manifest(spark, path)
    vt._commit(spark, path, entries, 2)
    with pytest.raises(Exception, match="(?i)exist"):
        vt._commit(spark, path, entries, 2)


def test_long_files_and_empty_tables(spark, tmp_path):
    path = f"{tmp_path}/long"
    vt.create(spark.range(100_000).coalesce(1), path, ["id"], 1)  # positions beyond one bitmap
    vt.delete(spark.range(0, 100_000, 3), path)
    assert vt.read(spark, path).agg(F.count("id"), F.sum("id")).first()[:] == (66_666, sum(i for i in range(100_000) if i % 3))
    empty = f"{tmp_path}/empty"
    vt.create(frame(spark, []), empty, ["k"])
    assert content(spark, empty) == []
    vt.delete(frame(spark, [(1,)], "k bigint"), empty)
    vt.upsert(frame(spark, [(1, "g", "v", 1)]), empty)
    assert content(spark, empty) == [(1, "g", "v", 1)]
    vt.delete(frame(spark, [(1,)], "k bigint"), empty)
    vt.compact(spark, empty)
    assert content(spark, empty) == []
    with pytest.raises(ValueError):
        vt.create(frame(spark, []), empty, ["k"])
    with pytest.raises(ValueError):
        vt.read(spark, f"{tmp_path}/none")
