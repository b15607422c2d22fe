"""Order-explicit picks and ranks that hold up when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def keep_first(df: DataFrame, keys: Sequence[str], order_by: Sequence[str | Column]) -> DataFrame:
    """One row per key: the first in ``order_by``.

    Written as an aggregate and not as ``row_number() = 1`` so that copies collapse on the map side:
    a key holding a third of the table never lands whole in one task. NULL keys are one group.
    """
    order = [F.col(c) if isinstance(c, str) else c for c in order_by]
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return picked.select(*keys, *[F.col("_first")[c].alias(c) for c in rest]).select(*df.columns)


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL matches NULL; key columns come from the left side."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"_rk_{k}")
    cond = None
    for k in keys:
        part = left[k].eqNullSafe(renamed[f"_rk_{k}"])
        cond = part if cond is None else cond & part
    return left.join(renamed, cond, how).drop(*[f"_rk_{k}" for k in keys])


def bucketed_row_number(
    df: DataFrame,
    order_by: Sequence[str | Column],
    buckets: Sequence[Column],
    keys: Sequence[str] = (),
    name: str = "rn",
) -> DataFrame:
    """Dense 1-based row number per ``keys`` without sorting a whole key in one task.

    ``buckets`` are expressions that never decrease along ``order_by`` (a date, a hash prefix, an id
    divided by a block size). Rows are numbered inside (key, bucket); the rows of earlier buckets are
    added from a count per bucket. Both passes are functions of the data only, so a retried task
    gives the same numbers.
    """
    names = [f"_bucket{i}" for i in range(len(buckets))]
    tagged = df.select("*", *[b.alias(n) for b, n in zip(buckets, names)])
    sizes = tagged.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_size"))
    # rows before the first-level bucket plus rows before the bucket inside it, so that no window
    # runs over more than one level of buckets
    outer, inner = names[:1], names[1:]
    upto = (Window.unboundedPreceding, -1)
    tops = sizes.groupBy(*keys, *outer).agg(F.sum("_size").alias("_top"))
    offsets = tops.select(
        *keys,
        *outer,
        F.coalesce(F.sum("_top").over(Window.partitionBy(*keys).orderBy(*outer).rowsBetween(*upto)), F.lit(0)).alias("_before"),
    )
    if inner:
        within = Window.partitionBy(*keys, *outer).orderBy(*inner).rowsBetween(*upto)
        sizes = sizes.withColumn("_within", F.coalesce(F.sum("_size").over(within), F.lit(0)))
        offsets = null_safe_join(sizes, offsets, [*keys, *outer], "inner").select(
            *keys, *names, (F.col("_before") + F.col("_within")).alias("_before")
        )
    local = F.row_number().over(Window.partitionBy(*keys, *names).orderBy(*order_by))
    numbered = tagged.withColumn("_local", local)
    joined = null_safe_join(numbered, offsets, [*keys, *names], "inner")
    return joined.withColumn(name, (F.col("_local") + F.col("_before")).cast("long")).drop(
        "_local", "_before", *names
    )


def top_per_group(df: DataFrame, keys: Sequence[str], order_by: Sequence[Column], k: int, name: str = "rn") -> DataFrame:
    """First ``k`` rows per group. Spark limits each group before the shuffle (WindowGroupLimit)."""
    w = Window.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)
