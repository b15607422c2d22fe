"""Byte n-gram perplexity against plain dictionaries, however the model is split between tasks and joins."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from test_operators import make

from loomshelf.llm import byte_ngrams
from loomshelf.llm.byte_ngrams import END, ORDER
from loomshelf.llm.common import maybe_among
from loomshelf.llm.perplexity import judge, keep_good, thresholds


def plain_model(texts):
    """Log probability of the last byte of a gram after the others under the same model."""
    counts = {ORDER: Counter()}
    for t in texts:
        own = bytes(ORDER - 1) + t.encode() + bytes([END])
        counts[ORDER].update(own[i : i + ORDER] for i in range(len(own) - ORDER + 1))
    for k in range(ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    discount, follow = {}, {}
    for k, c in counts.items():
        n1, n2, n3, n4 = (Counter(c.values())[i] for i in range(1, 5))
        discount[k] = [0.5, 0.75, 0.75]
        if min(n1, n2, n3, n4):
            y = n1 / (n1 + 2 * n2)
            discount[k] = [max(0.1, min(i, i - (i + 1) * y * b / a)) for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        for g, n in c.items():
            follow.setdefault(g[:-1], []).append(n)

    def p(gram):
        k = len(gram)
        lower = p(gram[1:]) if k > 1 else 1 / 256
        after = follow.get(gram[:-1])
        if not after:
            return lower
        off = lambda n: discount[k][min(n, 3) - 1] if n else 0
        n = counts[k][gram]
        return (n - off(n)) / sum(after) + sum(map(off, after)) / sum(after) * lower

    return p


def plain_log_perplexity(p, text):
    own = bytes(ORDER - 1) + text.encode() + bytes([END])
    n = len(own) - ORDER + 1
    return -sum(math.log(p(own[i : i + ORDER])) for i in range(n)) / n


def some_texts(seed, size):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randint(1, 3)))
    return [" ".join(word() for _ in range(rng.randint(1, 30))) for _ in range(size)]


@pytest.mark.parametrize("lead", [0, 1])
def test_texts_may_be_cut_anywhere(monkeypatch, lead):
    texts = [t.encode() for t in some_texts(9, 20)] + [b"", b"\0\0", b"x" * 100]

    def held():
        grams, symbols = Counter(), Counter()
        for pieces, names, models in byte_ngrams._pieces((((i,), t, i % 2) for i, t in enumerate(texts)), lead):
            codes, at = byte_ngrams._codes(pieces, models)
            grams.update((names[p][0], c) for p, c in zip(at.tolist(), codes.tolist()))
            for name, n in names:
                symbols[name] += n
        return grams, symbols

    whole = held()
    assert whole[1] == {i: len(t) + 1 for i, t in enumerate(texts)}
    for chunk in (1, 7, 50):
        monkeypatch.setattr(byte_ngrams, "CHUNK", chunk)
        assert held() == whole


@pytest.mark.parametrize(("size", "hot"), [(40, 2_000_000), (40, 0), (40, 300), (1, 20)])
def test_scores_are_modified_kneser_ney_of_the_other_half(spark, size, hot):
    """Whether all n-grams are held by every task, none or some."""
    texts = some_texts(size, size)
    others = [texts[0], texts[0] + "\n", "never seen", "a\x0bb  c", " ", "", "a zzz b ab é a a", "\0\0\0\0\0\0\0", "x" * 200]
    docs = spark.createDataFrame([(i, "en", t) for i, t in enumerate(texts + others + others)], "doc_id bigint, lang string, text string")
    docs = docs.withColumn("text_hash", F.xxhash64("text")).repartition(3).cache()
    trusted = docs.where(F.col("doc_id") < size)
    model = byte_ngrams.train(trusted, hot)
    halves = {m: [r.text for r in trusted.collect() if r.text_hash & 1 == m] for m in (0, 1)}
    models = {m: plain_model(own) for m, own in halves.items() if own}
    assert set(model.base) == set(models) and (model.rest.count() > 0) == (hot < 2_000_000)
    got = byte_ngrams.log_perplexities(docs, model).join(docs.select("doc_id", "text"), "doc_id").collect()
    assert len(got) == size + 2 * len(others)
    for r in got:
        by = 1 - (r.text_hash & 1) if len(models) == 2 else next(iter(models))
        assert r.log_perplexity is None if r.text == "" else math.isclose(r.log_perplexity, plain_log_perplexity(models[by], r.text), rel_tol=1e-5)


def test_probabilities_add_up_to_one():
    p = plain_model(["a b a c", "b a d d", "c"])
    for context in (bytes(5), b"a b a", b"zzzzz", b""):
        assert math.isclose(sum(p(context + bytes([b])) for b in range(256)), 1)


def test_gathered_tables_grow_with_the_input(spark):
    def held(n):
        texts = spark.range(n).select(F.concat_ws(" ", *[F.sha2(F.concat(F.col("id"), F.lit(f"-{k}")), 256) for k in range(4)]).alias("text"))
        model = byte_ngrams.train(texts.withColumn("text_hash", F.xxhash64("text")), 0)
        return model.rest.where(F.shiftright("key", 48) % 256 == ORDER).count()

    assert held(400) > 9 * held(40)


def test_no_text_no_model(spark):
    assert byte_ngrams.train(make(spark, [(1, "x")]).where("doc_id < 0").withColumn("text_hash", F.xxhash64("text"))) is None


def test_verdicts_follow_from_scores_and_quantiles(spark):
    """The registered verdict, from plain scores: the bound is the language's quantile, rounded up to a bin, and the margin."""
    texts = some_texts(3, 60) + ["qqqq wwww"] * 2 + [t.upper() for t in some_texts(4, 10)]
    rows = [(i, t, "xy"[i % 2]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(2)
    labels = spark.range(50).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    hashes = {r.doc_id: r.h for r in docs.select("doc_id", F.xxhash64("text").alias("h")).collect()}
    models = {m: plain_model([t for i, t, _ in rows[:50] if hashes[i] & 1 == m]) for m in (0, 1)}
    plain = {i: plain_log_perplexity(models[1 - (hashes[i] & 1)], t) for i, t, _ in rows}
    bound = {}
    for lang in "xy":
        bins = sorted(math.ceil(round(plain[i], 6) / 0.001) for i, _, g in rows[:50] if g == lang)
        bound[lang] = bins[math.ceil(len(bins) * 0.9) - 1] * 0.001 + 0.1
    got = judge(docs, labels, quantile=0.9, margin=0.1).collect()
    for r in got:
        assert math.isclose(r.perplexity, math.exp(plain[r.doc_id]), rel_tol=1e-4)
        assert math.isclose(r.threshold, math.exp(bound[r.lang]), rel_tol=2e-3)
        assert r.kept == (r.perplexity <= r.threshold)
    assert any(not r.kept for r in got)


def test_quantiles_are_exact_on_bins(spark):
    scored = spark.createDataFrame([("a", i / 1000 - 0.0004, True) for i in range(1, 101)] + [(None, 7.0, True), ("a", 99.0, False)], "lang string, log_perplexity double, trusted boolean")
    found = {(r.every, r.lang): (r.bound, r.texts) for r in thresholds(scored, 0.9, 0.5).collect()}
    assert found == {(False, "a"): (pytest.approx(0.59), 100), (False, None): (pytest.approx(7.5), 1), (True, None): (pytest.approx(0.591), 101)}


def test_the_bitmap_loses_no_id(spark):
    docs = spark.range(5000).select(F.when(F.col("id") > 0, F.col("id")).alias("doc_id"))
    ids = spark.range(0, 5000, 7).select(F.col("id").alias("x"))
    got = maybe_among(docs, F.col("doc_id"), ids).where("_maybe").select("doc_id").collect()
    assert {r.doc_id for r in got} >= set(range(7, 5000, 7)) and len(got) < 800
    assert not maybe_among(docs, F.col("doc_id"), ids.where("x < 0")).where("_maybe").count()


def test_kept_documents_keep_their_columns_and_rows(spark):
    texts = some_texts(5, 80)
    rows = [*enumerate(texts), (80, "QQQQ ###"), (80, "QQQQ ###"), (80, texts[0]), (None, "QQQQ ###"), (None, None), (82, "")]
    docs = make(spark, rows)
    labels = spark.range(80).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"))
    left = keep_good(docs, labels, quantile=1.0, margin=0.2)
    assert left.columns == docs.columns
    assert sorted((str(r.doc_id), r.text or "") for r in left.collect()) == sorted([(str(i), t or "") for i, t in rows if t != "QQQQ ###"])
