"""Near-dedup on word shingles against brute force."""

import random

import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from loomshelf.llm.shingle_dedup import index_pairs, keep_one, near_texts, prefix_pairs, shingles_of
from loomshelf.llm.simhash import print_of


def plain_shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def plain_stay(rows):
    """Ids left of (id, text): the smallest of each component."""
    sets, label = [plain_shingles(t) for _, t in rows], list(range(len(rows)))
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in pairs:
            if label[i] != label[j]:
                label[i] = label[j] = min(label[i], label[j])
                changed = True
    first = {}
    for (i, _), x in zip(rows, label):
        first[x] = min(i, first.get(x, i))
    return sorted(first.values()), len(pairs)


def some_texts(rng):
    """Texts with 0 to 8 words of 300 replaced, and one large group of near copies."""
    word = lambda: f"w{rng.randint(0, 3000)}"
    out = []
    for k in range(40):
        base = [word() for _ in range(300)]
        for edits in (0, 1, 2, 3, 4, 5, 8) if k else [2] * 60:
            own = base[:]
            for at in rng.sample(range(300), edits):
                own[at] = word()
            out.append(" ".join(own))
    rng.shuffle(out)
    return out


def test_every_pair_at_the_similarity_is_found(spark):
    rows = list(enumerate(some_texts(random.Random(3))))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    stay, n_pairs = plain_stay(rows)
    assert n_pairs > 300
    assert sorted(r.doc_id for r in keep_one(docs).collect()) == stay
    # the stage of the pipeline is this one
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == stay


def test_awkward_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n"), (4, "One two\tthree"), (5, "one two three"), (5, "one two three"), (5, "another text"), (None, "one two three"), (None, None), (6, "x")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, band string").repartition(2)
    left = keep_one(docs)
    assert left.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in left.collect()), key=str)
    assert got == sorted([(1, None), (4, "One two\tthree"), (5, "another text"), (6, "x"), (None, "one two three"), (None, None)], key=str)
    assert keep_one(docs.where(F.lit(False))).collect() == []


def sets_of(spark, texts):
    rows = [(i, [int(x) for x in shingles_of(t.encode()).view("int64")]) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "text_hash bigint, s array<bigint>")


def test_texts_of_one_template_are_not_paired(spark):
    """64 words in common and 34 of their own: similar enough to share bands, too little to link."""
    counts = {}
    for n in (100, 200):
        rng = random.Random(n)
        common = [f"c{i}" for i in range(64)]
        texts = [" ".join(common + [f"w{rng.randrange(10**6)}" for _ in range(34)]) for _ in range(n)]
        sets = sets_of(spark, texts)
        counts[n] = prefix_pairs(sets, sets.select("text_hash", F.col("text_hash").alias("root")), 0.8).count()
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
        assert near_texts(docs.select("text", F.xxhash64("text").alias("text_hash"))).count() == 0
    assert counts[200] <= 2.3 * counts[100] + 10


def test_no_similar_pair_escapes_the_prefixes(spark):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(40)]
    texts = some_texts(rng)[:120] + [" ".join(common + [f"w{rng.randrange(30)}" for _ in range(rng.randint(2, 14))]) for _ in range(120)] + ["a b", ""]
    plain = [plain_shingles(t) for t in texts]
    want = {(j, i) for i in range(len(texts)) for j in range(i) if 5 * len(plain[i] & plain[j]) >= 4 * len(plain[i] | plain[j])}
    sets = sets_of(spark, texts)
    got = {(r.a, r.b) for r in prefix_pairs(sets, sets.select("text_hash", F.col("text_hash").alias("root")), 0.8).collect()}
    assert want <= got and len(want) > 50
    # texts of one component do not meet
    assert prefix_pairs(sets, sets.select("text_hash", F.lit(0).cast("long").alias("root")), 0.8).count() == 0


def test_index_pairs_tie_together_what_two_bits_tie(spark):
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(60)]
    prints += [p ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for p in prints[:40]] + prints[:20]
    rows = [(1000 + i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(prints)]
    got = [(r.a - 1000, r.b - 1000) for r in index_pairs(spark.createDataFrame(rows, "text_hash bigint, fp bigint")).collect()]
    plain = [(i, j) for j in range(len(prints)) for i in range(j) if bin(prints[i] ^ prints[j]).count("1") <= 2]

    def classes(pairs):
        label = list(range(len(prints)))
        for a, b in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return [min(i for i, y in enumerate(label) if y == x) for x in label]

    assert len(plain) >= 60
    assert classes(got) == classes(plain)


def test_print_of_shingles_is_a_simhash():
    digests = [xxhash.xxh64_intdigest(s, 42) for s in (b"a b c d e", b"b c d e f", b"c d e f g")]
    plain = sum(1 << k for k in range(64) if 2 * sum(d >> k & 1 for d in digests) > 3)
    shingles = shingles_of(b"a b c d e f g")
    assert print_of(shingles.astype(">u8").view("u1")) & (1 << 64) - 1 == plain
