"""Benchmark decontamination: item-sized windows under a random-walk embedding, bit sampling, exact edit check.

Windows and items are sequences of words (lower-cased runs of letters, digits and underscores). A window leaks
an item of m words when at most ``(1 - similarity) * m`` word edits lie between them. The walk of Chakraborty,
Goldenberg and Koucky reads a sequence with a hash-driven pointer that repeats some words, so that after an
edit two walks soon fall into step again and edit distance becomes Hamming distance. Repeated samples of a few
places of several walks are the keys on which windows meet items.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshelf.llm.common import settle, whole_text

_WORD = re.compile(r"\w+")
# a window, and the words from ``low`` on: the window with room on both sides for the check
_WINDOWS = "row bigint, at int, size int, low int, words array<string>, keys array<bigint>"
#: Items whose windows are looked for in one pass over the documents: this many words together.
BLOCK_WORDS = 400_000


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


@dataclass(frozen=True)
class Sampling:
    """Walks, samples of each walk, places in a sample. The keys of a sequence are ``walks * samples``.

    At 20 % edits, the most that counts, about half of the places still agree; 64 samples of three places
    then meet at least once in over 99 of 100 cases, and more often for fewer edits.
    """

    walks: int = 8
    samples: int = 8
    places: int = 3
    seed: int = 20231

    def keys(self, symbols: np.ndarray) -> np.ndarray:
        """Keys of sequences of one length: rows of word hashes (unsigned 64-bit) in, rows of keys out."""
        n, m = symbols.shape
        padded = np.concatenate([symbols, np.zeros((n, 1), np.uint64)], axis=1)
        rows, out = np.arange(n), []
        for walk in range(self.walks):
            rng = np.random.default_rng([self.seed, walk, m])
            steps = 2 * m  # a walk stays at a word for two steps on average
            odd = rng.integers(0, 1 << 62, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
            add = rng.integers(0, 1 << 63, steps, dtype=np.uint64)
            walked = np.empty((n, steps), np.uint64)
            at = np.zeros(n, np.int64)
            for j in range(steps):
                here = padded[rows, at]
                walked[:, j] = here
                at = np.minimum(at + ((here * odd[j] + add[j]) >> np.uint64(63)).astype(np.int64), m)
            for sample in range(self.samples):
                places = rng.choice(steps, min(self.places, steps), replace=False)
                key = np.full(n, (m << 16) ^ (walk << 8) ^ sample, np.uint64)
                for p in places:
                    key = (key ^ walked[:, p]) * np.uint64(0x9E3779B97F4A7C15)
                    key ^= key >> np.uint64(29)
                out.append(key)
        return np.stack(out, axis=1).view(np.int64)


def symbols_of(words: Sequence[str]) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(w) for w in words], np.uint64)


class Anchors:
    """Where an item may stand in a text, without a loss.

    d edits spoil at most 2d of an item's m - 1 word pairs. A window of that size therefore holds at least
    m - 1 - 2d pairs known from the benchmark, and one of the first 2d + 1 pairs of the item is found
    unspoilt, which fixes where the window begins (up to the words inserted or deleted before it, which the
    walk and the check allow for). The pairs are counted twice: cheaply against all items, then, where that
    is enough, against the items of the window's size, a repeated pair no oftener than an item repeats it.
    """

    def __init__(self, items: list[list[str]], similarity: float):
        self.vocabulary = {w: i for i, w in enumerate(sorted({w for item in items for w in item}))}
        self.width = len(self.vocabulary)
        known, heads = set(), set()
        self.least: dict[int, int] = {}
        self.of_size: dict[int, dict[int, int]] = {}  # pairs of a size's items, and how often one item has them at most
        for item in items:
            ids = [self.vocabulary[w] for w in item]
            m, d = len(item), edits_allowed(len(item), similarity)
            pairs = [a * self.width + b for a, b in zip(ids, ids[1:])]
            known.update(pairs)
            most = self.of_size.setdefault(m, {})
            for pair, n in Counter(pairs).items():
                most[pair] = max(n, most.get(pair, 0))
            heads.update((pair, m, p) for p, pair in enumerate(pairs[: 2 * d + 1]))
            self.least[m] = max(0, m - 1 - 2 * d)
        self.pairs = np.array(sorted(known), np.int64)
        self.heads: dict[int, list[tuple[int, int]]] = {}
        for pair, m, p in sorted(heads):
            self.heads.setdefault(pair, []).append((m, p))
        # the weakest demand any size makes, by which most texts are put aside
        self.sizes = sorted(self.least)
        self.share = min(((self.least[m], m) for m in self.sizes), default=(0, 0))

    def windows(self, words: list[str]) -> list[tuple[int, int]]:
        """Place and size of every window to look at."""
        if not self.sizes or len(words) < 2:
            return []
        ids = np.array(list(map(self.vocabulary.get, words, repeat(-1))), np.int64)
        both = (ids[:-1] >= 0) & (ids[1:] >= 0)
        pairs = np.where(both, ids[:-1] * self.width + ids[1:], -1)
        at = np.minimum(np.searchsorted(self.pairs, pairs), len(self.pairs) - 1)
        hit = both & (self.pairs[at] == pairs)
        upto = np.concatenate([[0], np.cumsum(hit)])
        least, size = self.share
        span = min(max(self.sizes) - 1, len(hit))
        if (upto[span:] - upto[: len(upto) - span]).max(initial=0) < least:
            return []
        seen, found, here, counts = set(), [], pairs.tolist(), upto.tolist()
        for q in np.flatnonzero(hit).tolist():
            for m, p in self.heads.get(here[q], ()):
                start = max(0, q - p)
                end = min(start + m - 1, len(here))
                if counts[end] - counts[start] < self.least[m] or (start, m) in seen:
                    continue
                seen.add((start, m))
                most = self.of_size[m]
                own = Counter(filter(most.__contains__, here[start:end]))
                if sum(min(n, most[pair]) for pair, n in own.items()) >= self.least[m]:
                    found.append((start, m))
        return sorted(found)


def edits_allowed(m: int, similarity: float) -> int:
    return math.floor((1 - similarity) * m + 1e-9)


def _scan(pattern: Sequence[str], text: Sequence[str], free_start: bool) -> tuple[int, int]:
    """Least word edits between the pattern and a stretch of the text, and the first end that reaches it.

    Bit-parallel (Myers 1999). With ``free_start`` the stretch may begin anywhere, else at the start.
    """
    m = len(pattern)
    peq: dict[str, int] = {}
    for i, w in enumerate(pattern):
        peq[w] = peq.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, where = m, 0
    for j, w in enumerate(text, 1):
        eq = peq.get(w, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (~(xh | pv) & full), pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph = (ph << 1) & full | (0 if free_start else 1)
        mh = (mh << 1) & full
        pv, mv = mh | (~(xv | ph) & full), ph & xv
        if score < best:
            best, where = score, j
    return best, where


def closest_stretch(item: Sequence[str], text: Sequence[str]) -> tuple[int, int, int]:
    """Edits, start and end of the stretch of a text that is closest to an item."""
    edits, end = _scan(item, text, True)
    back = _scan(item[::-1], text[:end][::-1], False)[1]
    return edits, end - back, end


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    similarity: float = 0.8,
    least_words: int = 5,
    sampling: Sampling = Sampling(),
) -> DataFrame:
    """Which documents hold which benchmark items: the closest stretch of every such pair.

    Columns: ``doc_id``, ``text_hash``, ``item_id``, ``start_word``, ``end_word`` (exclusive), ``edits``,
    ``similarity`` (one less edits per word of the item).

    The benchmark is a stated query set: its words are gathered in blocks of about ``BLOCK_WORDS``, each block
    is looked for in one pass over all documents, and the windows that may hold an item are given their keys.
    Windows meet items in a join on keys, and each pair that meets is checked by edit distance. A passage that
    many documents share meets its item once a document.

    Items of fewer than ``least_words`` words, NULL and empty ones included, are too short to tell and are
    not looked for. NULL and empty texts hold nothing. Items with the same text are all reported. Rows that
    repeat an id and its text are reported once; NULL ids are reported as they are. Empty tables give an
    empty table.
    """
    spark = docs.sparkSession

    def split(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([words_of(t) for t in part], dtype=object)

    splitter = F.pandas_udf(split, "array<string>")
    items = settle(
        benchmark.select(benchmark[item_col].alias("item_id"), splitter(whole_text(benchmark, item_text_col)).alias("item_words")).where(
            F.size("item_words") >= least_words
        ),
        "benchmark-words",
    )
    total = items.agg(F.sum(F.size("item_words"))).first()[0] or 0
    blocks = max(1, math.ceil(total / BLOCK_WORDS))
    text = whole_text(docs, text_col)
    rows = docs.select(docs[id_col].alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))

    def keyed(windows: list[tuple[int, int, int, int, list[str]]]) -> pd.DataFrame:
        out = pd.DataFrame(windows, columns=["row", "at", "size", "low", "words"])
        parts = []
        for size, group in out.groupby("size"):
            own = [w[at - low :][:size] for at, low, w in zip(group["at"], group["low"], group["words"])]
            hashed = np.stack([symbols_of([*w, *[""] * (size - len(w))]) for w in own])
            parts.append(group.assign(keys=list(sampling.keys(hashed))))
        return pd.concat(parts)

    def item_keys(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series([sampling.keys(symbols_of(w)[None, :])[0].tolist() for w in part], dtype=object)

    item_keyed = F.pandas_udf(item_keys, "array<bigint>")

    @F.pandas_udf("struct<edits: int, start_word: int, end_word: int>")
    def check(words: pd.Series, lows: pd.Series, items: pd.Series) -> pd.DataFrame:
        out = []
        for text, low, item in zip(words, lows, items):
            edits, start, end = closest_stretch(list(item), list(text))
            out.append((edits, low + start, low + end))
        return pd.DataFrame(out, columns=["edits", "start_word", "end_word"])

    found = None
    for block in range(blocks):
        mine = items.where(F.pmod(F.xxhash64("item_words"), F.lit(blocks)) == block)
        anchors = Anchors([list(r.item_words) for r in mine.select("item_words").distinct().toLocalIterator()], similarity)

        def search(parts: Iterator[pd.DataFrame], anchors: Anchors = anchors) -> Iterator[pd.DataFrame]:
            for part in parts:
                held = []
                for row, text in zip(part["text_hash"], part["text"]):
                    words = words_of(text)
                    for at, size in anchors.windows(words):
                        slack = edits_allowed(size, similarity) + 1
                        low = max(0, at - slack)
                        held.append((row, at, size, low, words[low : at + size + slack]))
                    if len(held) >= 2000:
                        yield keyed(held)
                        held = []
                if held:
                    yield keyed(held)

        # copies of a text give the same windows
        windows = settle(rows.select("text_hash", "text").mapInPandas(search, _WINDOWS).dropDuplicates(["row", "at", "size"]), "windows")
        keys = mine.select("item_id", "item_words", F.explode(item_keyed("item_words")).alias("key"))
        met = (
            windows.select("row", "at", "size", F.explode("keys").alias("key"))
            .join(keys.select("item_id", F.xxhash64("item_words").alias("item_hash"), "key"), "key")
            .select("row", "at", "size", "item_id", "item_hash")
            .distinct()
        )
        spelled = mine.select(F.xxhash64("item_words").alias("item_hash"), "item_words").dropDuplicates(["item_hash"])
        checked = (
            met.join(windows.select("row", "at", "size", "low", "words"), ["row", "at", "size"])
            .join(spelled, "item_hash")
            .select("row", "item_id", F.size("item_words").alias("m"), check("words", "low", "item_words").alias("c"))
        )
        good = settle(checked.where(F.col("c.edits") <= F.floor((1 - similarity) * F.col("m") + 1e-9)), "leaks")
        found = good if found is None else found.unionByName(good)
    best = found.groupBy("row", "item_id").agg(F.min("c").alias("c"), F.first("m").alias("m")).select("row", "item_id", "m", "c.*")
    return (
        rows.select("doc_id", "text_hash")
        .distinct()
        .join(best, F.col("text_hash") == best.row)
        .select("doc_id", "text_hash", "item_id", "start_word", "end_word", "edits", F.round(1 - F.col("edits") / F.col("m"), 6).alias("similarity"))
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents that hold no benchmark item; same columns. Rows that repeat an id and its text go together."""
    found = leaks(docs, benchmark, id_col, text_col, **options)
    gone = found.select(F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash")).distinct()
    own = docs.withColumn("_llm_own", F.xxhash64(whole_text(docs, text_col)))
    return own.join(gone.hint("shuffle_hash"), own[id_col].eqNullSafe(gone._llm_id) & (own._llm_own == gone._llm_hash), "left_anti").drop("_llm_own")
