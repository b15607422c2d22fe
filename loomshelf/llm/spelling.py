"""Spelling variants: frequent words one edit apart, and the common form each of them leads to.

A word is known by its frequency vector: how many of its letters fall into each of a few groups. One edit changes
the vector by at most one letter too many and one too few, so the vectors are arranged as a trie of successive
group counts and searched with a surplus of one and a deficit of one to spend. Words at the leaves that the search
reaches are verified letter by letter.

The trie is dealt out by its upper levels: a cell is a prefix of the vector, deepened while it holds too many
words. A word visits the cells that its budget reaches; the cells then go to tasks with their visitors, and the
search goes on there down to the leaves. Each pair is met once, by the word whose vector comes first.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.llm.common import forget, settle

#: Runs of letters in UTF-8: A to Z in either case, and U+00C0 to U+00FF.
_RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
#: Letter groups, the levels of the trie, and the levels every cell has.
GROUPS, UPPER = 12, 4
#: Words of a cell, or words that visit one, in a task at once.
CELL_WORDS = 20_000
#: Different words a task counts before it hands them on; words searched at once; pairs verified at once.
_HELD, _SEARCHED, _VERIFIED = 400_000, 4096, 100_000
#: Letters of a word that are compared as an array; longer words are compared as strings.
_WIDTH = 48

_GROUP = np.zeros(256, np.uint8)
_GROUP[97:123] = np.arange(26) % GROUPS
_GROUP[0xC0:] = np.arange(64) % GROUPS


def _without_one(run: bytes, h: int) -> bytes:
    letters = run.decode()
    at = h % len(letters)
    return (letters[:at] + letters[at + 1 :]).encode()


def _counted(least: int, slip: int | None):
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def told() -> pa.RecordBatch:
            # a letter has one byte below 0x80, or one of 0xC3 and one more
            words = [(w, n) for w, n in held.items() if len(w) - w.count(b"\xc3") >= least]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], ["word", "n"])

        for part in parts:
            for name, text in zip(part["name"].to_pylist(), part["text"]):
                runs = [r for r in _RUN.findall(text.as_py().lower()) if len(r) >= least]  # on bytes: A to Z only
                if slip is None:
                    held.update(runs)
                else:
                    start = crc32(name + b":")
                    held.update([r if (h := crc32(r, start)) % slip else _without_one(r, h) for r in runs])
                if len(held) >= _HELD:
                    yield told()
        if held:
            yield told()

    return count


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_letters: int = 5, least_count: int = 3, slip: int | None = None) -> DataFrame:
    """The words of all texts and how often they occur: ``word``, ``n``.

    A word is a maximal run of A to Z in either case and U+00C0 to U+00FF, of which only A to Z are lower-cased. With
    ``slip``, a run loses a letter where the crc32 of id, colon and run (an id that is NULL: nothing) is divisible by
    it. NULL and empty texts have no words, an empty table has none; rows that repeat count as often as they occur; a
    text is read whole, however long, and so is a run. Other columns are not read.
    """
    rows = docs.select(F.coalesce(docs[id_col].cast("string"), F.lit("")).cast("binary").alias("name"), docs[text_col].cast("string").cast("binary").alias("text"))
    counted = rows.where("text IS NOT NULL").mapInArrow(_counted(least_letters, slip), "word string, n bigint")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _vectors(words: list[bytes]) -> np.ndarray:
    """Letters of each group in each word (Latin-1). Counts end at 255, which keeps one edit within the budget."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    letters = _GROUP[np.frombuffer(b"".join(words), np.uint8)].astype(np.int64)
    at = np.repeat(np.arange(len(words)), sizes)
    counts = np.bincount(at * GROUPS + letters, minlength=len(words) * GROUPS)
    return np.minimum(counts, 255).astype(np.uint8).reshape(len(words), GROUPS)


def _vector(word: Column) -> Column:
    @F.pandas_udf("array<smallint>")
    def run(words: pd.Series) -> pd.Series:
        return pd.Series(list(_vectors([w.encode("latin-1") for w in words]).astype(np.int16)), dtype=object)

    return run(word)


def _deeper(rows: DataFrame, level: int) -> DataFrame:
    """Rows of cells of ``level`` groups in their cells of one group more; ``up`` and ``down`` are left to spend.

    Words that are at home follow their own count. Visitors also go where one letter more is, or, once they have
    spent that, one letter less: a visitor's vector never comes after the words it meets.
    """
    c = F.col("vector")[level]
    step = lambda count, up, down: F.struct(count.cast("int").alias("count"), up.cast("int").alias("up"), down.cast("int").alias("down"))
    ways = F.array(
        step(c, F.col("up"), F.col("down")),
        F.when(~F.col("home") & (F.col("up") > 0), step(c + 1, F.col("up") - 1, F.col("down"))),
        F.when(~F.col("home") & (F.col("up") == 0) & (F.col("down") > 0) & (c > 0), step(c - 1, F.col("up"), F.col("down") - 1)),
    )
    went = rows.withColumn("_way", F.explode(F.filter(ways, lambda w: w.isNotNull())))
    return went.select(F.concat_ws(".", F.when(F.col("cell") != "", F.col("cell")), F.col("_way.count")).alias("cell"), "home", "word", "n", "vector", "_way.up", "_way.down")


def _cells(words: DataFrame, most: int) -> DataFrame:
    """Words at home and visiting, by cell of ``most`` words or of all levels: ``cell``, ``home``, ``word``, ``n``."""
    known = settle(words.select("word", "n", _vector(F.col("word")).alias("vector")), "vectors")
    start = known.select(F.lit("").alias("cell"), F.explode(F.array(F.lit(True), F.lit(False))).alias("home"), "word", "n", "vector", F.lit(1).alias("up"), F.lit(1).alias("down"))
    rows = start
    for level in range(UPPER):
        rows = _deeper(rows, level)
    done, level = [], UPPER
    while True:
        sizes = settle(rows.where("home").groupBy("cell").agg(F.count(F.lit(1)).alias("_home")), "cells")
        large = sizes.where(F.col("_home") > most).select(F.col("cell").alias("_cell"))
        rows = rows.join(sizes.select(F.col("cell").alias("_at")), F.col("cell") == F.col("_at"), "left_semi")  # no use to visit where nobody is
        if level == GROUPS or large.isEmpty():
            return _united([*done, rows])
        rows = settle(rows, "rows")
        done.append(rows.join(large, F.col("cell") == F.col("_cell"), "left_anti"))
        rows = _deeper(rows.join(large, F.col("cell") == F.col("_cell"), "left_semi"), level)
        level += 1


def _united(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select("cell", "home", "word", "n")


def _one_edit(a: bytes, b: bytes) -> bool:
    """Whether two different words are one inserted, deleted or replaced letter apart."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    i = next((i for i in range(len(a)) if a[i] != b[i]), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


class _Words:
    """Words of a call as arrays: letters from the left and from the right, lengths, vectors."""

    def __init__(self, words: list[bytes]) -> None:
        self.words, self.sizes, self.vectors = words, np.fromiter(map(len, words), np.int64, len(words)), _vectors(words)
        width = min(_WIDTH, int(self.sizes.max(initial=0)))
        self.left = np.frombuffer(b"".join(w[:width].ljust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)
        self.right = np.frombuffer(b"".join(w[-width:].rjust(width, b"\0") for w in words), np.uint8).reshape(len(words), width)


def _verified(v: _Words, i: np.ndarray, r: _Words, j: np.ndarray) -> np.ndarray:
    """Which pairs of words are one edit apart."""
    a, b = v.sizes[i], r.sizes[j]
    out = np.abs(a - b) <= 1
    long = np.maximum(a, b) > _WIDTH
    for k in np.flatnonzero(out & long):
        x, y = v.words[i[k]], r.words[j[k]]
        out[k] = x != y and _one_edit(x, y)
    short = np.flatnonzero(out & ~long)
    width = max(v.left.shape[1], r.left.shape[1])

    def same(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Letters that agree before the first that does not."""
        wide = min(x.shape[1], y.shape[1])
        differ = x[i[short], :wide] != y[j[short], :wide]
        return np.where(differ.any(axis=1), differ.argmax(axis=1), width)

    before = same(v.left, r.left)
    after = same(v.right[:, ::-1], r.right[:, ::-1])
    least = np.minimum(a[short], b[short])
    before, after = np.minimum(before, least), np.minimum(after, least)
    out[short] = np.where(a[short] == b[short], before + after == least - 1, before + after >= least)
    return out


class _Trie:
    """Words at home by cell and vector: per level the sorted (node, count) of its nodes; the words of each leaf."""

    def __init__(self, cells: np.ndarray, vectors: np.ndarray) -> None:
        node, self.levels = cells.astype(np.int64), []
        for level in range(GROUPS):
            nodes, node = np.unique(node * 256 + vectors[:, level], return_inverse=True)
            self.levels.append(nodes)
        self.order = np.argsort(node, kind="stable")
        self.begins = np.append(0, np.cumsum(np.bincount(node, minlength=1)))

    def search(self, cells: np.ndarray, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of a visitor and a word at a leaf within its budget. All visitors go down together."""
        who, node = np.arange(len(cells)), cells.astype(np.int64)
        up = down = np.ones(len(cells), np.int8)
        for level, nodes in enumerate(self.levels):
            c = vectors[who, level].astype(np.int64)
            found = []
            for more, may in ((0, np.ones(len(who), bool)), (1, (up > 0) & (c < 255)), (-1, (up == 0) & (down > 0) & (c > 0))):
                k = np.flatnonzero(may)
                child = node[k] * 256 + c[k] + more
                at = np.minimum(np.searchsorted(nodes, child), len(nodes) - 1)
                hit = nodes[at] == child
                k = k[hit]
                found.append((who[k], at[hit], up[k] - (more > 0), down[k] - (more < 0)))
            who, node, up, down = (np.concatenate(x) for x in zip(*found))
        sizes = self.begins[node + 1] - self.begins[node]
        first = np.repeat(self.begins[node], sizes)
        within = np.arange(len(first)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        return np.repeat(who, sizes), self.order[first + within]


def _pairs_of_call(rows: pd.DataFrame) -> pd.DataFrame:
    cell = pd.factorize(rows["unit"])[0]
    home = rows["home"].to_numpy(bool)
    words, n = rows["word"].to_numpy(object), rows["n"].to_numpy(np.int64)
    out = []
    if home.any() and not home.all():
        mine, theirs = np.flatnonzero(home), np.flatnonzero(~home)
        r = _Words([w.encode("latin-1") for w in words[mine]])
        trie = _Trie(cell[mine], r.vectors)
        for k in range(0, len(theirs), _SEARCHED):
            some = theirs[k : k + _SEARCHED]
            v = _Words([w.encode("latin-1") for w in words[some]])
            who, at = trie.search(cell[some], v.vectors)
            for m in range(0, len(who), _VERIFIED):
                i, j = who[m : m + _VERIFIED], at[m : m + _VERIFIED]
                ok = _verified(v, i, r, j)
                a, b = some[i[ok]], mine[j[ok]]
                # words of one vector visit each other; the first of them tells
                once = (v.vectors[i[ok]] != r.vectors[j[ok]]).any(axis=1) | (words[a] < words[b])
                out.append((a[once], b[once]))
    a, b = (np.concatenate(x) for x in zip(*out)) if out else (np.zeros(0, int),) * 2
    return pd.DataFrame({"a": words[a], "n_a": n[a], "b": words[b], "n_b": n[b]})


def near_pairs(words: DataFrame, most: int = CELL_WORDS) -> DataFrame:
    """Pairs of words one inserted, deleted or replaced letter apart, each once: ``a``, ``n_a``, ``b``, ``n_b``.

    ``words`` has distinct ``word`` of the letters of ``word_counts``, and ``n``. No task holds more than ``most`` words
    of a cell, nor more than ``most`` visitors: larger sides are dealt into blocks that all meet.
    """
    rows = settle(_cells(words, most), "visits")
    sizes = rows.groupBy("cell").agg(F.count_if("home").alias("_home"), F.count_if(~F.col("home")).alias("_visit"))
    blocks = lambda c: F.ceil(F.col(c) / most).cast("int")
    sizes = sizes.select(F.col("cell").alias("_cell"), blocks("_home").alias("_h"), blocks("_visit").alias("_v"))
    of = lambda count: F.pmod(F.xxhash64("word"), count).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), count - 1))
    met = rows.join(sizes.where("_h > 0 AND _v > 0"), F.col("cell") == F.col("_cell"))
    home = met.where("home").select("*", of(F.col("_h")).alias("_i"), every(F.col("_v")).alias("_j"))
    visits = met.where("NOT home").select("*", every(F.col("_h")).alias("_i"), of(F.col("_v")).alias("_j"))
    units = home.union(visits).select(F.concat_ws("/", "cell", "_i", "_j").alias("unit"), "home", "word", "n")
    calls = rows.count() // (2 * most) + 1
    dealt = units.withColumn("call", F.pmod(F.xxhash64("unit"), F.lit(calls)))
    return dealt.groupBy("call").applyInPandas(_pairs_of_call, "a string, n_a bigint, b string, n_b bigint")


def roots(forms: DataFrame) -> DataFrame:
    """Where following ``form`` from ``word`` ends, for words that have one: ``word``, ``root``. Every step is doubled each round.

    Forms must not lead back to their word. The rounds are the logarithm of the longest way.
    """
    now = settle(forms.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = now.select(F.col("word").alias("_via"), F.col("root").alias("_on"))
        then = settle(now.join(on, F.col("root") == F.col("_via"), "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")), "roots")
        moved = not then.where("_moved").isEmpty()
        forget(now)
        now = then.drop("_moved")
        if not moved:
            return now


def variants(words: DataFrame, ratio: int = 2, most: int = CELL_WORDS) -> DataFrame:
    """The form and the root of every word: ``word``, ``form``, ``root``, ``n``, ``n_near``, ``form_n``.

    ``words``: distinct ``word``, and how often it occurs, ``n`` (see ``word_counts``). The form is the near word that
    occurs most, the first in code-point order if there are several, where it occurs ``ratio`` times as often as the
    word or more (``ratio`` above one); else NULL. The root is where the forms lead, the word itself if it has none.
    No words give an empty table.
    """
    known = settle(words.select("word", "n"), "words")
    pairs = near_pairs(known, most)
    side = lambda x, y, m: F.struct(F.col(x).alias("x"), F.col(y).alias("y"), F.col(m).alias("m"))
    both = pairs.select(F.explode(F.array(side("a", "b", "n_b"), side("b", "a", "n_a"))).alias("p")).select("p.*")
    near = both.groupBy("x").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), F.col("y"))).alias("best"))
    joined = known.join(near, F.col("word") == F.col("x"), "left")
    often: Column = -F.col("best.m") >= F.col("n") * ratio
    found = joined.select(
        "word",
        F.when(often, F.col("best.y")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(often, -F.col("best.m")).alias("form_n"),
    )
    found = settle(found, "forms")
    ends = roots(found).withColumnRenamed("word", "_word")
    return found.join(ends, F.col("word") == F.col("_word"), "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
