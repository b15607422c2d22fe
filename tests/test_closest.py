"""Closest names by matching blocks against the standard library's own ranking."""

import random
from difflib import get_close_matches

import pytest

from loomshelf import catalog
from loomshelf.operators.closest import candidate_pairs, closest_names

WORDS = ["eau", "dé", "straße", "über", "señor", "niño", "corazón", "größer", "water", "glycerin", "glycerol", "tocopherol", "tocopheryl acetate", "оливковое масло", "글리세린", "소듐클로라이드", "소듐 라우레스설페이트", "a", "é", "hyaluronique", "natriumlaureth", "sodium laureth", "aab", "aba", "baa", "𝒳𝒴𝒵water"]


def misspelt(rng, word):
    for _ in range(rng.randint(0, 3)):
        at = rng.randrange(len(word))
        word = word[:at] + rng.choice(["", "é", "z", word[at] * 2, " ", "글"]) + word[at + rng.randint(0, 1) :] or "x"
    return word


def plain(name, words, cutoff, misreadings):
    """Correction, similarity and whether the name is known, one name at a time."""
    spelt = name
    for old, new in misreadings.items():
        spelt = spelt.replace(old, new)
    if spelt in words:
        return spelt, 1.0, True
    bare = spelt.replace(" ", "")
    stripped = {}
    for w in sorted(words, reverse=True):
        stripped[w.replace(" ", "")] = w
    if bare in stripped:
        return stripped[bare], 1.0, True
    close = get_close_matches(bare, sorted(stripped), n=1, cutoff=cutoff) if bare else []
    if not close:
        return spelt, 0.0, False
    return stripped[close[0]], len({*bare} & {*close[0]}) / len({*bare} | {*close[0]}), False


@pytest.mark.parametrize("cutoff", [0.75, 0.8, 1.0])
def test_closest_names_are_those_of_the_standard_library(spark, cutoff):
    rng = random.Random(3)
    names = sorted({misspelt(rng, rng.choice(WORDS)) for _ in range(400)} | {"x" * 260, "xy" * 130, " ", "oleum"})
    words = [*WORDS, "xy" * 120 + "z" * 10]
    misreadings = {"gliserin": "glycerin", "zz": "z", "z글": "글"}
    df = spark.createDataFrame([(n,) for n in [*names, *names[:5]]] + [(None,), ("",)], "name string").repartition(3)
    dictionary = spark.createDataFrame([(w,) for w in words] + [(None,), ("",), (words[0],)], "entry string")
    got = {r.name: (r.corrected, round(r.similarity, 9), r.is_known) for r in closest_names(df, dictionary, cutoff, misreadings).collect()}
    want = {n: plain(n, words, cutoff, misreadings) for n in names}
    assert got == {n: (c, round(s, 9), k) for n, (c, s, k) in want.items()}
    assert cutoff == 1.0 or sum(0 < s < 1 for _, s, _ in want.values()) > 50


def test_random_words_of_few_letters(spark):
    """Many equal letters, where the order decides and the letters alone do not."""
    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abc", k=rng.randint(2, 9)))
    words, names = sorted({word() for _ in range(120)}), sorted({word() for _ in range(120)})
    got = closest_names(spark.createDataFrame([(n,) for n in names], "name string"), spark.createDataFrame([(w,) for w in words], "entry string"), 0.8).collect()
    assert {(r.name, r.corrected, r.is_known) for r in got} == {(n, *plain(n, words, 0.8, {})[::2]) for n in names}


def test_names_of_one_prefix_do_not_all_meet(spark):
    rng = random.Random(2)
    counts = {}
    for n in (1000, 2000):
        word = lambda: "prefix" + "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=12))
        a = spark.createDataFrame([(word(),) for _ in range(n)], "_a string")
        b = spark.createDataFrame([(word(),) for _ in range(200)], "_b string")
        counts[n] = candidate_pairs(a, b, 0.8).count()
    assert counts[2000] < 0.02 * 2000 * 200 and counts[2000] < 3 * counts[1000] + 50


def test_the_query_reads_every_language(spark, tmp_path):
    rng = random.Random(5)
    texts = [" ".join(misspelt(rng, w).replace(" ", "") for w in rng.sample(WORDS, 6)).lower() for _ in range(20)]
    path = str(tmp_path)
    spark.createDataFrame([(i, t, ("en", "fr", None)[i % 3], "s") for i, t in enumerate(texts)] + [(50, None, "en", "s")], "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(w for w in WORDS if " " not in w)), (2, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    import regex

    from loomshelf.functions import ingredient_lexicon as lex

    words = sorted({w for w in regex.split(r"[^\p{L}]+", " ".join(x for x in WORDS if " " not in x).lower()) if w})
    names = sorted({w for t in texts for w in regex.split(r"[^\p{L}]+", t) if w})
    got = {r.name: (r.corrected, r.similarity, r.is_known) for r in catalog.QUERIES["ig14_closest_names"](spark, path).collect()}
    want = {n: plain(n, words, 0.75, lex.MISREADINGS) for n in names}
    assert got == {n: (c, round(s, 8), k) for n, (c, s, k) in want.items()}


def test_equal_letters_in_another_order_are_no_candidates(spark):
    rng = random.Random(4)
    shuffled = sorted({"".join(rng.sample("abcdefghijkl", 12)) for _ in range(300)})
    names, entries = shuffled[:200], [*shuffled[200:], "lkjihgfedcba" * 7, "x" * 80]
    a, b = spark.createDataFrame([(n,) for n in [*names, "lkjihgfedcab" * 7]], "_a string"), spark.createDataFrame([(e,) for e in entries], "_b string")
    got = {tuple(r) for r in candidate_pairs(a, b, 0.75).collect()}

    def common(x, y):
        row = [0] * (len(y) + 1)
        for p in x:
            last = 0
            for j, q in enumerate(y, 1):
                last, row[j] = row[j], last + 1 if p == q else max(row[j], row[j - 1])
        return row[-1]

    # words of more than 63 letters are told apart by their letters alone
    assert got == {(x, y) for x in names for y in entries if common(x, y) >= 0.75 * 12 and len(y) == 12} | {("lkjihgfedcab" * 7, "lkjihgfedcba" * 7)}
