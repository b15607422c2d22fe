"""Quotas, exact stratified samples, balancing, shards and data splits."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.functions.columns import col, ratio
from loomshelf.functions.draws import draw_rank, take_per_group
from loomshelf.functions.quantiles import with_row
from loomshelf.functions.ranking import bucketed_row_number, null_safe_join

# Sample size, floors, sentiment targets, trim order and split shares.
TARGET_SIZE, FLOOR_1, FLOOR_2, SEED = 20_000, 600, 200, 42
SENTIMENT_TARGETS = {"negative": 0.30, "neutral": 0.30, "positive": 0.40}
TRIM_ORDER = ["positive", "neutral", "negative"]
TRAIN_PERCENT, VALID_PERCENT = 70, 15


def sentiment_group(rating: str | Column = "rating") -> Column:
    """[0,2] negative, (2,3] neutral, (3,5] positive."""
    r = col(rating)
    return F.when((r >= 0) & (r <= 2), "negative").when((r > 2) & (r <= 3), "neutral").when((r > 3) & (r <= 5), "positive")


def quotas_with_floor(
    counts: DataFrame, unit: str, total: int | Column, floor: int, by: Sequence[str] = (), n: str = "n", name: str = "quota"
) -> DataFrame:
    """Floor plus proportional share per unit; what rounding leaves goes to the largest quota.

    When the floors exceed the total it is split evenly and the remainder goes to the first units.
    Windows run over the unit frame only (categories).
    """
    everything = Window.partitionBy(*by)
    ranked = Window.partitionBy(*by).orderBy(F.desc(n), F.asc(unit))
    total = F.lit(total) if isinstance(total, int) else total
    units = (
        counts.withColumn("_total", total.cast("long"))
        .withColumn("_k", F.count(F.lit(1)).over(everything))
        .withColumn("_sum", F.sum(n).over(everything))
        .withColumn("_pos", F.row_number().over(ranked))
        .withColumn("_rest", F.col("_total") - F.lit(floor) * F.col("_k"))
    )
    even = F.expr("_total div _k") + F.when(F.col("_pos") <= F.col("_total") % F.col("_k"), 1).otherwise(0)
    # counts may be decimal sums in the caller's frame; whole numbers keep the share exact
    share = F.lit(floor) + F.expr(f"(_rest * {n}) div _sum")
    based = units.withColumn("_base", F.when(F.col("_rest") < 0, even).otherwise(share))
    largest = Window.partitionBy(*by).orderBy(F.desc("_base"), F.asc("_pos"))
    left = F.when(F.col("_rest") < 0, 0).otherwise(F.col("_total") - F.sum("_base").over(everything))
    return (
        based.withColumn("_left", left)
        .withColumn("_first", F.row_number().over(largest))
        .withColumn(name, (F.col("_base") + F.when(F.col("_first") == 1, F.col("_left")).otherwise(0)).cast("long"))
        .drop("_total", "_k", "_sum", "_pos", "_rest", "_base", "_left", "_first")
    )


def two_level_quotas(
    pool: DataFrame,
    outer: str = "category_1",
    inner: str = "category_2",
    target: int = TARGET_SIZE,
    floor_outer: int = FLOOR_1,
    floor_inner: int = FLOOR_2,
    whole: Sequence[str] = (),
) -> DataFrame:
    """Quota per (outer, inner); outer categories in ``whole`` are one unit with a NULL inner."""
    unit = F.when(~F.col(outer).isin(*whole), F.col(inner)) if whole else F.col(inner)
    counts = pool.groupBy(outer, unit.alias(inner)).agg(F.count(F.lit(1)).alias("n"))
    tops = quotas_with_floor(counts.groupBy(outer).agg(F.sum("n").alias("n")), outer, target, floor_outer, name="_outer_quota")
    placed = counts.join(tops.select(outer, "_outer_quota"), outer)
    return quotas_with_floor(placed, inner, F.col("_outer_quota"), floor_inner, by=[outer]).drop("_outer_quota")


def stratified_sample(
    pool: DataFrame, quotas: DataFrame, units: Sequence[str], key: str, seed: int = SEED, whole: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """min(quota, available) rows per unit."""
    if not whole:
        return take_per_group(pool, quotas, units, key, seed)
    (outer, names), = whole.items()
    inner = units[-1]
    tagged = pool.withColumn("_inner", F.col(inner)).withColumn(inner, F.when(~F.col(outer).isin(*names), F.col(inner)))
    drawn = take_per_group(tagged, quotas, units, key, seed)
    return drawn.withColumn(inner, F.col("_inner")).drop("_inner")


def sentiment_targets(target: int, shares: Mapping[str, float] = SENTIMENT_TARGETS) -> dict[str, int]:
    counts = {s: int(target * share) for s, share in shares.items()}
    counts[max(counts, key=counts.get)] += target - sum(counts.values())
    return counts


def balance_sentiment(
    pool: DataFrame,
    sampled: DataFrame,
    key: str,
    target: int = TARGET_SIZE,
    shares: Mapping[str, float] = SENTIMENT_TARGETS,
    seed: int = SEED,
    trim_order: Sequence[str] = TRIM_ORDER,
) -> DataFrame:
    """Bring the sample to the sentiment targets: fill shortages from the unsampled pool, then trim.

    ``sampled`` holds rows of ``pool``. What a sentiment has outside the sample is its pool count less its
    sample count, so the pool is joined with the sample only to draw what is missing, and only for the
    sentiments that miss something. A small frame says how many rows of each survive.
    """
    goals = sentiment_targets(target, shares)
    spark = pool.sparkSession
    goal_rows = spark.createDataFrame(
        [(s, goals[s], i) for i, s in enumerate(trim_order)], "sentiment_group string, _goal long, _order int"
    )
    grouped = pool.withColumn("sentiment_group", sentiment_group())
    inside = sampled.select(*pool.columns).withColumn("sentiment_group", sentiment_group())
    have_in = inside.groupBy("sentiment_group").agg(F.count(F.lit(1)).alias("_in"))
    have_all = grouped.groupBy("sentiment_group").agg(F.count(F.lit(1)).alias("_every"))
    have = have_all.join(have_in, "sentiment_group", "left").select(
        "sentiment_group", "_in", (F.col("_every") - F.coalesce("_in", F.lit(0))).alias("_out")
    )
    zero = F.lit(0).cast("long")
    plan = (
        goal_rows.join(have, "sentiment_group", "left")
        .withColumns({"_in": F.coalesce("_in", zero), "_out": F.coalesce("_out", zero)})
        .withColumn("_add", F.greatest(zero, F.least(F.col("_goal") - F.col("_in"), F.col("_out"))))
        .withColumn("_spare", F.greatest(zero, F.col("_in") + F.col("_add") - F.col("_goal")))
        .withColumn("_excess", F.sum(F.col("_in") + F.col("_add")).over(Window.partitionBy()) - F.lit(target))
        .withColumn(
            "_earlier",
            F.coalesce(
                F.sum("_spare").over(Window.partitionBy().orderBy("_order").rowsBetween(Window.unboundedPreceding, -1)), zero
            ),
        )
        .withColumn("_remove", F.greatest(zero, F.least(F.col("_spare"), F.col("_excess") - F.col("_earlier"))))
    )
    draw = f"{seed}-balance"
    stay = plan.select("sentiment_group", (F.col("_in") - F.col("_remove")).alias("quota"))
    kept = take_per_group(inside, stay, ["sentiment_group"], key, draw)
    lacking = plan.where("_add > 0").select("sentiment_group", F.col("_add").alias("quota"))
    # one row per sentiment
    rest = grouped.join(F.broadcast(lacking.select("sentiment_group")), "sentiment_group", "left_semi").join(sampled.select(key), key, "left_anti")
    added = take_per_group(rest.select(*grouped.columns), lacking, ["sentiment_group"], key, draw)
    return kept.withColumn("in_sample", F.lit(True)).unionByName(added.withColumn("in_sample", F.lit(False)))


def sample_report(sample: DataFrame, shares: Mapping[str, float] = SENTIMENT_TARGETS) -> DataFrame:
    """Sentiment distribution of a sample against its targets."""
    goals = sample.sparkSession.createDataFrame(list(shares.items()), "sentiment_group string, target double")
    counts = sample.groupBy(sentiment_group().alias("sentiment_group")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n").alias("_t"))
    return (
        with_row(goals.join(counts, "sentiment_group", "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long"))), total)
        .withColumn("pct", ratio(F.col("n") * 100.0, "_t"))
        .select("sentiment_group", "n", "pct", (F.col("target") * 100).alias("target_pct"))
        .withColumn("diff", F.col("pct") - F.col("target_pct"))
    )


def duplicate_count(sample: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows beyond the first per key."""
    sizes = sample.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("_extra"))
    return sizes.agg(F.coalesce(F.sum("_extra"), F.lit(0).cast("long")).alias("n_duplicates"))


def shards(df: DataFrame, k: int, order_by: Sequence[str], buckets: Sequence[Column], name: str = "shard") -> DataFrame:
    """k contiguous parts in the given order; the first parts get one row more. Keeps ``original_index``."""
    numbered = bucketed_row_number(df, order_by, buckets, name="_rn")
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    sized = with_row(numbered, total).withColumn("_q", F.expr(f"_n div {k}")).withColumn("_r", F.col("_n") % k)
    big = F.col("_r") * (F.col("_q") + 1)
    # the second branch is only reached when every part has at least one row
    part = F.when(F.col("_rn") <= big, F.expr("(_rn - 1) div (_q + 1)") + 1).otherwise(
        F.col("_r") + F.floor((F.col("_rn") - big - 1) / F.nullif(F.col("_q"), F.lit(0))) + 1
    )
    return (
        sized.withColumn(name, part.cast("int"))
        .withColumn("original_index", F.col("_rn") - 1)
        .drop("_rn", "_n", "_q", "_r")
    )


def gold_set(labels: DataFrame, key: str, per_cell: int, size: int, cell: Sequence[str] = ("aspect", "sentiment"), seed: int = SEED) -> DataFrame:
    """``per_cell`` rows of every (aspect, sentiment) cell, then random rows up to ``size``."""
    cells = labels.select(*cell).distinct().withColumn("quota", F.lit(per_cell))
    first = take_per_group(labels, cells, list(cell), key, seed)
    missing = first.agg(F.greatest(F.lit(0).cast("long"), F.lit(size) - F.count(F.lit(1))).alias("quota")).withColumn("_all", F.lit(1))
    rest = labels.join(first.select(key), key, "left_anti").withColumn("_all", F.lit(1))
    fill = take_per_group(rest, missing, ["_all"], key, f"{seed}-fill").drop("_all")
    return first.withColumn("is_fill", F.lit(False)).unionByName(fill.withColumn("is_fill", F.lit(True)))


def union_teams(parts: Mapping[int, DataFrame]) -> DataFrame:
    out = None
    for team, part in parts.items():
        tagged = part.withColumn("team", F.lit(team))
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return out


def _split_of(rank: Column, n: Column, train: int, valid: int) -> Column:
    """Cut a ranking of n items: the held-out part is rounded up, then its test part."""
    held = F.ceil(n * (100 - train) / 100)
    test = F.ceil(held * (100 - train - valid) / (100 - train))
    return F.when(rank <= n - held, "train").when(rank <= n - test, "valid").otherwise("test")


def split_by_group(
    df: DataFrame, group: str, key: str, train: int = TRAIN_PERCENT, valid: int = VALID_PERCENT, seed: int = SEED, by: str = "group", min_groups: int = 10
) -> DataFrame:
    """Train/valid/test so that no group is in two parts.

    ``by="row"`` splits row by row instead; ``by="auto"`` does so when there are ``min_groups`` groups or
    fewer. Only the distinct units are ranked; rows get their part by a join.
    """
    if by not in ("group", "row", "auto"):
        raise ValueError(f"by is group, row or auto, not {by}")
    of_row, of_group = F.concat(F.lit("row-"), F.col(key).cast("string")), F.concat(F.lit("group-"), F.col(group).cast("string"))
    if by == "auto":
        few = df.select(group).distinct().agg((F.count(F.lit(1)) <= min_groups).alias("_few"))
        tagged = with_row(df, few).withColumn("_unit", F.when(F.col("_few"), of_row).otherwise(of_group)).drop("_few")
    else:
        tagged = df.withColumn("_unit", of_row if by == "row" else of_group)
    units = tagged.select("_unit").distinct()
    ranked = with_row(draw_rank(units, "_unit", seed), units.agg(F.count(F.lit(1)).alias("_n")))
    parts = ranked.select("_unit", _split_of(F.col("draw_rank"), F.col("_n"), train, valid).alias("split"))
    return tagged.join(parts, "_unit").drop("_unit")


def split_by_stratum(
    df: DataFrame, stratum: str, key: str, train: int = TRAIN_PERCENT, valid: int = VALID_PERCENT, seed: int = SEED
) -> DataFrame:
    """Train/valid/test with the same stratum shares in every part."""
    sizes = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    ranked = null_safe_join(draw_rank(df, key, seed, [stratum]), sizes, [stratum], "inner")
    return ranked.withColumn("split", _split_of(F.col("draw_rank"), F.col("_n"), train, valid)).drop("_n", "draw_rank")
