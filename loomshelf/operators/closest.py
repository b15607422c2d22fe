"""The dictionary entry closest to a name by its longest matching blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.functions.letters import pairs_in_order
from loomshelf.operators.ingredients import replace_all

#: Fixed value: the least similarity of a correction.
CUTOFF = 0.75


def block_ratio(entry: Column, name: Column) -> Column:
    """Twice the letters in matching blocks over the letters of both, blocks found in the name for the entry."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        matcher = SequenceMatcher()
        for entries, names in parts:
            found, last = [], None
            for e, n in zip(entries, names):
                if n != last:
                    matcher.set_seq2(n)
                    last = n
                matcher.set_seq1(e)
                found.append(matcher.ratio())
            yield pd.Series(found, dtype=float)

    return run(entry, name)


def candidate_pairs(names: DataFrame, entries: DataFrame, cutoff: float) -> DataFrame:
    """Pairs ``_a``, ``_b`` of a name and an entry whose letters would allow a ratio of ``cutoff``; all that reach it are among them.

    Blocks stand in the same order in both words, so a pair must have ``cutoff`` times half of both lengths of letters
    in the same order.
    """
    return pairs_in_order(names, entries, cutoff / (2 - cutoff), lambda x, y: math.ceil((x + y) * (cutoff / 2) - 1e-9))


def closest_names(
    names: DataFrame, dictionary: DataFrame, cutoff: float = CUTOFF, misreadings: Mapping[str, str] | None = None, name: str = "name", entry: str = "entry"
) -> DataFrame:
    """Every distinct name with its correction: ``name``, ``corrected``, ``similarity``, ``is_known``.

    Misreadings are replaced first, in their order. A name that is an entry, or one but for spaces (the first such
    entry by name), is known, at similarity one. Else the entry of the highest block ratio of ``cutoff`` or more is
    taken, both without spaces; of equal ones the last by name. Its similarity is the share of different letters that
    both have. A name without such an entry keeps its corrected spelling, at similarity zero.

    NULL and empty names and entries are left out; names that repeat are one row.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must lie above 0 and not above 1")
    spelt = replace_all(F.col("_n"), misreadings) if misreadings else F.col("_n")
    a = names.select(F.col(name).alias("_n")).where(F.length("_n") > 0).distinct().withColumn("_c", spelt).withColumn("_a", F.replace("_c", F.lit(" ")))
    b = dictionary.select(F.col(entry).alias("_e")).where(F.length("_e") > 0).distinct().withColumn("_b", F.replace("_e", F.lit(" ")))
    by_text = b.groupBy("_b").agg(F.min("_e").alias("_stripped"))
    exact = b.select(F.col("_e").alias("_same"))
    direct = a.join(exact, F.col("_c") == F.col("_same"), "left").join(by_text, F.col("_a") == F.col("_b"), "left").withColumn("_hit", F.coalesce("_same", "_stripped"))
    direct = direct.select("_n", "_c", "_a", "_hit")
    rest = direct.where(F.col("_hit").isNull() & (F.col("_a") != "")).select("_a").distinct()
    pairs = candidate_pairs(rest, by_text.where(F.col("_b") != "").select("_b"), cutoff)
    scored = pairs.withColumn("_r", block_ratio(F.col("_b"), F.col("_a"))).where(F.col("_r") >= cutoff)
    best = scored.groupBy(F.col("_a").alias("_of")).agg(F.max(F.struct("_r", "_b")).alias("_best"))
    found = best.join(by_text, F.col("_best._b") == F.col("_b")).select("_of", F.col("_b").alias("_match"), F.col("_stripped").alias("_entry"))
    letters = lambda c: F.array_distinct(F.regexp_extract_all(c, F.lit("(?s)."), F.lit(0)))
    share = F.size(F.array_intersect(letters("_a"), letters("_match"))) / F.size(F.array_union(letters("_a"), letters("_match")))
    return direct.join(found, F.col("_a") == F.col("_of"), "left").select(
        F.col("_n").alias(name),
        F.coalesce("_hit", "_entry", "_c").alias("corrected"),
        F.when(F.col("_hit").isNotNull(), 1.0).when(F.col("_match").isNotNull(), share).otherwise(0.0).alias("similarity"),
        F.col("_hit").isNotNull().alias("is_known"),
    )
