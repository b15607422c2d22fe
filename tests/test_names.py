"""Name queries on whole inputs: every language, script and length."""

import random
import re

import pytest

from loomshelf import catalog

WORDS = ["eau", "dé", "straße", "über", "señor", "niño", "corazón", "größer", "être", "water", "glycerin", "tocopherol", "оливковое", "масло", "글리세린", "a", "é", "hyaluronique", "natriumlaureth"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(7)

    def misspelt(w):
        at = rng.randrange(len(w))
        return w[:at] + rng.choice(["", "é", "z", w[at] * 2]) + w[at + 1 :]

    path = str(tmp_path_factory.mktemp("names"))
    texts = [", ".join(misspelt(w) if rng.random() < 0.6 else w.title() for w in rng.sample(WORDS, 8)) + " 12\n" for _ in range(30)]
    docs = [(i, t, ("en", "fr", "de", "es", None)[i % 5], "src1") for i, t in enumerate(texts)] + [(40, None, "en", "src1"), (41, "", "fr", "src2")]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(WORDS[:10])), (2, ". ".join(WORDS[10:])), (3, None)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, {w for t in texts for w in re.findall(r"[^\W\d_]+", t.lower())}


def test_names_of_all_languages_and_lengths(spark, folder):
    path, names = folder
    want = set()
    for n in names:
        near = [(-round(1 - distance(n, e) / max(len(n), len(e)), 9), e) for e in WORDS if 1 - distance(n, e) / max(len(n), len(e)) >= 0.8 - 1e-9]
        best = n if n in WORDS else min(near)[1] if near else None
        want.add((n, best or n, 0.0 if best is None else 1.0 if best == n else round(len({*n} & {*best}) / len({*n} | {*best}), 8), n in WORDS))
    got = {tuple(r) for r in catalog.QUERIES["ig14_correct_all_names"](spark, path).collect()}
    assert got == want
    assert {"eau", "straße", "масло"} <= {n for n, *_ in got} and any(c != n and not c.isascii() for n, c, *_ in got)


def test_short_entries_are_known_to_the_extraction(spark, folder, monkeypatch):
    seen = []
    operator = catalog.ingredients.ig.extract_by_mode
    monkeypatch.setattr(catalog.ingredients.ig, "extract_by_mode", lambda df, keys, known: seen.append(known) or operator(df, keys, known))
    assert catalog.QUERIES["ig25_extract_by_mode"](spark, folder[0]).count() > 0
    assert {r.entry for r in seen[0].collect()} == set(WORDS)
