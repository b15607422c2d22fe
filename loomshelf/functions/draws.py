"""Reproducible random draws: rows are ranked by a keyed hash, which does not depend on partitioning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.functions.columns import col
from loomshelf.functions.ranking import bucketed_row_number, null_safe_join


def draw_hash(key: str | Column, seed: int | str) -> Column:
    """Uniform hexadecimal text; its order is the draw order."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), col(key).cast("string")))


def hash_block(h: str | Column, digits: int = 3) -> Column:
    """The first hex digits: 16^digits even blocks that rise with the hash.

    A block of one group is ranked in one task, so take digits enough that rows / 16^digits fit one.
    """
    return F.substring(col(h), 1, digits)


def _cut_block(hashed: DataFrame, wanted: DataFrame, keys: Sequence[str], digits: int) -> DataFrame:
    """One row for each group of which ``wanted`` has ``_left`` rows: the block where it is cut, if it is, and what is left there."""
    sizes = hashed.groupBy(*keys, hash_block("_h", digits).alias("_blk")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_blk").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = null_safe_join(sizes.withColumn("_end", F.sum("_n").over(upto)), wanted.select(*keys, "_left"), keys, "inner")
    passed = F.min(F.when(F.col("_end") > F.col("_left"), F.struct("_blk", (F.col("_left") - F.col("_end") + F.col("_n")).alias("_left"))))
    return ends.groupBy(*keys).agg(passed.alias("_cut")).select(*keys, F.col("_cut._blk").alias("_last"), F.col("_cut._left").alias("_left"))


def take_per_group(df: DataFrame, quotas: DataFrame, keys: Sequence[str], key: str, seed: int | str, quota: str = "quota", digits: int = 3) -> DataFrame:
    """The first ``quota`` rows of each group in draw order, without replacement.

    The block of the hash in which a group passes its quota is found from counts: first which of 16, then which part of
    that one, so that a task holds few counts of a group however many blocks there are. Rows of the blocks before it
    pass a plain filter; only those of that block, one in 16^``digits`` of the group, are shuffled and ranked.

    ``quotas`` is a plan of one row for each group; where each group is cut is broadcast, so that no other row moves.
    """
    hashed = df.withColumn("_h", draw_hash(key, seed)).withColumn("_blk", hash_block("_h", digits))
    wanted = quotas.select(*keys, F.col(quota).cast("long").alias("_left")).where(F.col(quota) > 0)
    cuts = _cut_block(hashed, wanted, keys, 1)
    if digits > 1:
        inside = null_safe_join(hashed, F.broadcast(cuts.where("_last IS NOT NULL")), keys, "inner").where(hash_block("_h", 1) == F.col("_last"))
        parts = _cut_block(inside.drop("_last", "_left"), cuts, keys, digits)
        cuts = null_safe_join(cuts.select(*keys), parts, keys)
    placed = null_safe_join(hashed, F.broadcast(cuts), keys, "inner")
    whole = placed.where(F.col("_last").isNull() | (F.col("_blk") < F.col("_last")))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_h", key))
    part = placed.where(F.col("_blk") == F.col("_last")).withColumn("_rank", rank).where(F.col("_rank") <= F.col("_left"))
    return whole.select(*df.columns).unionByName(part.select(*df.columns))


def draw_rank(df: DataFrame, key: str, seed: int | str, keys: Sequence[str] = (), name: str = "draw_rank", digits: int = 5) -> DataFrame:
    """Rank of every row in draw order, per group if asked. Blocks are offset in two levels."""
    hashed = df.withColumn("_h", draw_hash(key, seed))
    return bucketed_row_number(hashed, ["_h", key], [hash_block("_h", 2), hash_block("_h", digits)], keys, name).drop("_h")
