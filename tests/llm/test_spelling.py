"""Spelling variants against plain loops over all pairs of words."""

import random
import re
import zlib
from collections import Counter

import pytest
from test_operators import AWKWARD, make

from loomshelf.llm import spelling

LOWER = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})


def plain_counts(rows, least=5, count=3, slip=None):
    seen = Counter()
    for i, text in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if slip and h % slip == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            seen[w] += len(w) >= least
    return {w: n for w, n in seen.items() if n >= count}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def plain_variants(words, ratio=2):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, vs in near.items():
        best = min(vs, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= ratio * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def table(spark, words):
    return spark.createDataFrame(list(words.items()), "word string, n bigint")


def some_words(seed, n, letters, longest=9):
    rng = random.Random(seed)
    return {"".join(rng.choices(letters, k=rng.randint(5, longest))): rng.choice([3, 4, 5, 9, 40, 300]) for _ in range(n)}


@pytest.mark.parametrize("slip", [None, 2, 97])
def test_word_counts_of_awkward_rows(spark, slip):
    rows = [*AWKWARD, (20, "Ünder über ÜBER Über\nßßßßß straßen Straßen STRASSEN ×÷×÷×"), (21, "a" * 100_000 + " Straßen's strAßen-wörter"), (22, "Seven seven SEVEN sevens seve1n")]
    got = spelling.word_counts(make(spark, rows), least_count=1, slip=slip)
    assert {r.word: r.n for r in got.collect()} == plain_counts(rows, count=1, slip=slip)


@pytest.mark.parametrize("most", [20_000, 25, 3])
def test_variants_of_crowded_words(spark, most):
    """Few letters, so that cells are deepened, and at three words a cell leaves are cut into blocks."""
    words = some_words(7, 400, "abß") | some_words(8, 300, "aeimquyéè", 12)
    assert sorted(map(tuple, spelling.variants(table(spark, words), most=most).collect())) == plain_variants(words)


def test_chains_ties_and_long_words(spark):
    chain = {"alpha" + "b" * k: 3 * 2**k for k in range(12)}  # eleven steps to the root
    ties = {"stone": 3, "stony": 8, "stona": 8, "sxone": 8}
    long = {"x" * 400: 3, "x" * 399: 9, "x" * 200 + "y" + "x" * 199: 30, "x" * 300: 5, "q" * 48 + "r": 4, "q" * 48: 8, "q" * 47 + "rr": 9}
    words = chain | ties | long
    got = sorted(map(tuple, spelling.variants(table(spark, words)).collect()))
    assert got == plain_variants(words)
    by_word = {r[0]: r for r in got}
    assert by_word["alpha"][2] == "alpha" + "b" * 11 and by_word["stone"][1] == "stona"


def test_no_words(spark):
    empty = make(spark, AWKWARD[:1])
    assert spelling.variants(spelling.word_counts(empty)).collect() == []
    assert spelling.variants(spelling.word_counts(empty.where("doc_id < 0"))).collect() == []
