"""The Merkle manifest against a tree built in plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD, make

from loomshelf.llm import merkle

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(fields):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in fields))


def tree(nodes, arity):
    """Root, and for each node the siblings before and after it by level."""
    paths, at, now = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(now) > 1:
        for k, p in enumerate(at):
            first = p - p % arity
            paths[k] += ["".join(now[first:p]), "".join(now[p + 1 : first + arity])]
            at[k] = p // arity
        now = [h("".join(now[i : i + arity])) for i in range(0, len(now), arity)]
    return now[0], paths


def plain(rows, arity, shown=leaf_of):
    """doc_id, leaf, subroot, root, proof, folded root of each row."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = {}
    for g in names:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r), shown(r)))
        made[g] = (own, *tree([leaf_of(r) for r in own], arity))
    root, above = tree([made[g][1] for g in names], arity) if names else (None, [])
    out = []
    for g, up in zip(names, above):
        own, subroot, paths = made[g]
        for r, path in zip(own, paths):
            proof, folded = path + up, shown(r)
            for left, right in zip(proof[::2], proof[1::2]):
                folded = h(left + folded + right)
            out.append((r[0], leaf_of(r), subroot, root, tuple(proof), folded))
    return sorted(out, key=str)


def found(df):
    return sorted(((r.doc_id, r.leaf, r.subroot, r.root, tuple(r.proof), r.folded_root) for r in df.collect()), key=str)


def fields_of(docs):
    return [tuple(r) for r in docs.select(*FIELDS).collect()]


@pytest.mark.parametrize(("arity", "levels"), [(3, 6), (3, 1), (2, 2)])
def test_trees_of_awkward_rows(spark, arity, levels):
    docs = make(spark, AWKWARD).withColumn("source", F.expr("CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN '' ELSE 'é' END"))
    assert found(merkle.manifest(docs, arity=arity, levels=levels)) == plain(fields_of(docs), arity)


def test_superblocks_of_several_levels_and_many_groups(spark):
    schema = "doc_id bigint, source string, lang string, n_chars int, text string"
    rows = [(2**60 + i, "hot" if i % 3 else f"g{i % 23}", None, i, f"line {i}\nof text") for i in range(500)]
    docs = spark.createDataFrame(rows, schema).repartition(7)

    def cut(r):
        return leaf_of((*r[:4], r[4].replace("\n", ""))) if r[0] % 2 else leaf_of(r)

    text = F.when(F.col("doc_id") % 2 == 1, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    shown = merkle.leaf_digest(*[F.col(c) for c in FIELDS[:-1]], text)
    got = found(merkle.manifest(docs, presented=shown, levels=1))
    assert got == plain(rows, 3, cut)
    assert all((r[5] == r[3]) == (r[0] % 2 == 0) for r in got)


def test_equal_rows_and_a_lone_leaf(spark):
    rows = [(1, "s", "en", 1, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, lang string, n_chars int, text string")
    (only,) = found(merkle.manifest(docs))
    assert only[1] == only[2] == only[3] == only[5] == leaf_of(rows[0]) and only[4] == ()
    assert found(merkle.manifest(docs.union(docs).union(docs).union(docs))) == plain(rows * 4, 3)


def test_an_empty_table(spark):
    assert merkle.manifest(make(spark, AWKWARD[:1]).where("doc_id < 0")).collect() == []
