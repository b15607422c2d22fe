"""Pairs of words that have enough letters in common, found without a row for each letter or piece of a word."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Parts that the words of one length are dealt to; each meets the entries of the lengths near it.
PARTS = 32
#: Words and entries compared at once: cells of the table of common letters.
CELLS = 1 << 18


def _codes(words: list[str], size: int) -> np.ndarray:
    return np.array(words, dtype=f"U{size}").view(np.uint32).reshape(len(words), size)


def _numbered(codes: np.ndarray) -> np.ndarray:
    """The letters of each word, sorted, each with the number of times it stood before."""
    rows = np.sort(codes, axis=1)
    at = np.arange(rows.shape[1])
    first = np.zeros(rows.shape, np.int64)
    first[:, 1:] = np.where(rows[:, 1:] != rows[:, :-1], at[1:], 0)
    return (rows.astype(np.int64) << 32) | (at - np.maximum.accumulate(first, axis=1))


def _places(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each value among the known ones, or their number."""
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return np.where(known[at] == values, at, len(known))


def _letter_bits(letters: np.ndarray, known: np.ndarray) -> np.ndarray:
    """A bit for each known letter; the words of bits come first."""
    at = _places(letters, known)
    bits = np.zeros((len(known) // 64 + 1, len(letters)), np.uint64)
    for j in range(at.shape[1]):
        rows = np.flatnonzero(at[:, j] < len(known))
        place = at[rows, j]
        bits[place // 64, rows] |= np.uint64(1) << (place % 64).astype(np.uint64)
    return bits


def _in_order(a: np.ndarray, b: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For each pair of rows, the most letters that both words have in the same order; words of ``b`` have 63 at most."""
    size = b.shape[1]
    known = np.unique(b)
    stands = np.zeros((len(known) + 1, len(b)), np.uint64)
    for j, letters in enumerate(np.searchsorted(known, b).T):
        stands[letters, np.arange(len(b))] |= np.uint64(1 << j)
    at = _places(a, known)
    open_ = np.full(len(left), (1 << size) - 1, np.uint64)
    for letters in at.T:
        met = open_ & stands[letters[left], right]
        open_ = (open_ + met) | (open_ - met)
    return size - np.bitwise_count(open_ & np.uint64((1 << size) - 1)).astype(np.int64)


def _close(words: list[str], entries: list[str], need: int) -> Iterator[tuple[list[str], list[str]]]:
    """Pairs of words of one length and entries of one length that have ``need`` letters in the same order."""
    x, y = len(words[0]), len(entries[0])
    b = _codes(entries, y)
    numbered = _numbered(b)
    known = np.unique(numbered)
    held = _letter_bits(numbered, known)
    step = max(1, CELLS // max(len(entries), x))
    for start in range(0, len(words), step):
        some = words[start : start + step]
        a = _codes(some, x)
        own = _letter_bits(_numbered(a), known)
        shared = np.zeros((len(some), len(entries)), np.uint8 if y < 256 else np.uint32)
        for mine, theirs in zip(own, held):
            shared += np.bitwise_count(mine[:, None] & theirs)
        left, right = np.nonzero(shared >= need)
        if y < 64 and len(left):
            kept = _in_order(a, b, left, right) >= need
            left, right = left[kept], right[kept]
        yield [some[i] for i in left], [entries[j] for j in right]


def pairs_in_order(words: DataFrame, entries: DataFrame, shorter: float, least: Callable[[int, int], int]) -> DataFrame:
    """Pairs ``_a``, ``_b`` of distinct words and entries that have at least so many letters in common as ``least`` asks.

    Words longer than 63 letters are compared by their letters alone, others by those in the same order too; no pair
    with enough letters in the same order is lost. ``least`` gets both lengths; lengths of which one is under
    ``shorter`` times the other never meet. Words are dealt by their length and hash, entries to every part of the
    lengths near theirs, and compared there as bits, so a word is shuffled once however common its letters are.
    """
    spark = words.sparkSession
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    size = F.length("_b")
    lengths = F.sequence(F.greatest(F.lit(1), F.ceil(size * shorter - 1e-9).cast("int")), F.floor(size / shorter + 1e-9).cast("int"))
    part = F.pmod(F.xxhash64("_a"), F.lit(PARTS)).cast("int")
    # comparing takes long for its bytes, so the number of tasks is set here
    a = words.where(F.length("_a") > 0).select("_a", F.length("_a").alias("_x"), part.alias("_part")).repartition(dealt, "_x", "_part")
    b = entries.where(size > 0).select("_b", F.explode(lengths).alias("_x"))
    b = b.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))

    def compare(mine: pd.DataFrame, theirs: pd.DataFrame) -> pd.DataFrame:
        found: tuple[list[str], list[str]] = ([], [])
        if len(mine):
            own = mine["_a"].tolist()
            for y, same in theirs["_b"].groupby(theirs["_b"].map(len)):
                need = least(len(own[0]), y)
                if need <= min(len(own[0]), y):
                    for pairs in _close(own, same.tolist(), need):
                        found[0].extend(pairs[0])
                        found[1].extend(pairs[1])
        return pd.DataFrame({"_a": pd.Series(found[0], dtype=object), "_b": pd.Series(found[1], dtype=object)})

    return a.groupBy("_x", "_part").cogroup(b.groupBy("_x", "_part")).applyInPandas(compare, "_a string, _b string")
