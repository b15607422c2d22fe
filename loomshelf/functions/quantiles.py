"""Exact linear-interpolated quantiles.

``percentile`` keeps a map of distinct values per group: right for ratings, prices or counts, whose
domain is small. ``exact_quantiles`` is for measures that may have as many values as rows; it reduces
to (value, count), finds the slices of the number line that hold the wanted ranks and looks only there.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# slices per doubling of the value; a slice spans about half a percent
SLICES_PER_OCTAVE = 128
_SHIFT = 200_000


def slice_of(value: str) -> Column:
    """Slice number of a double: never decreases with the value and needs no look at the data."""
    v = F.col(value)
    size = F.floor(F.log2(F.abs(v)) * SLICES_PER_OCTAVE) + _SHIFT
    return F.when(v == 0, F.lit(0)).when(v > 0, size).otherwise(-size).cast("int")


def small_domain_quantiles(
    df: DataFrame, value: str, probs: Mapping[str, float], by: Sequence[str] = ()
) -> DataFrame:
    """Quantiles of a column with a small domain, one row (per group)."""
    return df.groupBy(*by).agg(*[F.percentile(value, F.lit(p)).alias(n) for n, p in probs.items()])


def exact_quantiles(df: DataFrame, wanted: Mapping[str, Mapping[str, float]], by: Sequence[str] = ()) -> DataFrame:
    """Quantiles of columns of any size: ``{"column": {"result name": probability}}``.

    One row, or one per group of ``by`` (meant for a few segments). NULL and NaN are left out. All
    columns share one shuffle; only the slices that hold a wanted rank are sorted.
    """
    by = list(by)
    keys = [*by, "_m"]
    measures = [F.struct(F.lit(i).alias("m"), F.col(c).cast("double").alias("v")) for i, c in enumerate(wanted)]
    sliced = (
        df.select(*by, F.explode(F.array(*measures)).alias("_x"))
        .select(*by, F.col("_x.m").alias("_m"), F.col("_x.v").alias("_v"))
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .groupBy(*keys, "_v")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_s", slice_of("_v"))
    )
    below = Window.partitionBy(*keys).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    targets = [
        F.struct(F.lit(i).alias("m"), F.lit(name).alias("name"), F.lit(float(p)).alias("p"), F.lit(side).alias("side"))
        for i, probs in enumerate(wanted.values())
        for name, p in probs.items()
        for side in (0, 1)
    ]
    pos = F.col("_t.p") * (F.col("_n") - 1)
    rank = F.when(F.col("_t.side") == 0, F.floor(pos)).otherwise(F.least(F.floor(pos) + 1, F.col("_n") - 1))
    needed = (
        sliced.groupBy(*keys, "_s")
        .agg(F.sum("_c").alias("_sc"))
        .withColumn("_before", F.coalesce(F.sum("_sc").over(below), F.lit(0)))
        .withColumn("_n", F.sum("_sc").over(Window.partitionBy(*keys)))
        .withColumn("_t", F.explode(F.array(*targets)))
        .where(F.col("_t.m") == F.col("_m"))
        .withColumn("_rank", rank)
        .where((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_sc")))
        .groupBy(*keys, "_s", "_before")
        # at most two entries per wanted quantile
        .agg(
            F.collect_list(
                F.struct(
                    F.col("_t.name").alias("name"),
                    F.col("_t.side").alias("side"),
                    F.col("_rank").alias("rank"),
                    (pos - F.floor(pos)).alias("frac"),
                )
            ).alias("_hits")
        )
    )
    if not by:
        needed = F.broadcast(needed)  # two rows per wanted quantile at most
    upto = Window.partitionBy(*keys, "_s").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = (
        sliced.join(needed, [*keys, "_s"])
        .withColumn("_end", F.col("_before") + F.sum("_c").over(upto))
        .withColumn("_h", F.explode("_hits"))
        .where((F.col("_h.rank") < F.col("_end")) & (F.col("_h.rank") >= F.col("_end") - F.col("_c")))
    )

    def at(name: str, side: int, what: str) -> Column:
        return F.max(F.when((F.col("_h.name") == name) & (F.col("_h.side") == side), F.col(what)))

    names = [name for probs in wanted.values() for name in probs]
    return found.groupBy(*by).agg(
        *[(at(n, 0, "_v") + (at(n, 1, "_v") - at(n, 0, "_v")) * at(n, 0, "_h.frac")).alias(n) for n in names]
    )


def with_row(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Attach a frame of exactly one row (scalar thresholds) to every row without collecting it."""
    return df.crossJoin(F.broadcast(one_row))


def running_before(counts: DataFrame, value: str, weight: str, name: str = "before") -> DataFrame:
    """Total weight of all smaller values, for a frame with one row per value.

    The frame is summed slice by slice and not in one task.
    """
    sliced = counts.withColumn("_s", slice_of(value))
    before = Window.partitionBy().orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        sliced.groupBy("_s")
        .agg(F.sum(weight).alias("_sum"))
        .select("_s", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_offset"))
    )
    inside = Window.partitionBy("_s").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return (
        sliced.withColumn("_local", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, "_s")
        .withColumn(name, F.col("_offset") + F.col("_local"))
        .drop("_s", "_local", "_offset")
    )
