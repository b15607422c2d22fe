"""SimHash near-dedup through an inverted index over byte positions with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.llm.common import connected_components, settle, whole_text

SEED = 42
BYTES = 8
#: bits of each byte value, most significant first
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
_EDGES = "array<struct<a: bigint, b: bigint>>"


def print_of(digests: np.ndarray) -> int:
    """Signed 64-bit fingerprint of 64-bit hashes, given as bytes, most significant first: bits that over half of them have."""
    hashes = digests.reshape(-1, BYTES)
    counts = np.concatenate([np.bincount(hashes[:, i], minlength=256) @ _BITS for i in range(BYTES)])
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big", signed=True)


def fingerprint_of(text: bytes, width: int = 3) -> int:
    """Signed 64-bit fingerprint of a UTF-8 text: a bit is set if over half of the shingle hashes have it."""
    words = text.lower().split()  # on bytes both touch ASCII only: A-Z, and \x20 \x09-\x0D
    if not words:
        return 0
    digest = xxhash.xxh64_digest
    n = max(1, len(words) - width + 1)
    joined = [b" ".join(words)] if n == 1 else map(b" ".join, zip(*(words[i:] for i in range(width))))
    return print_of(np.frombuffer(b"".join([digest(s, SEED) for s in joined]), np.uint8))


def fingerprint(text: Column, width: int = 3) -> Column:
    """Fingerprint of a text column; an empty or NULL text has fingerprint zero."""

    @F.pandas_udf("long")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([fingerprint_of(t, width) for t in part], dtype="int64")

    return run(F.coalesce(text.cast("string"), F.lit("")).cast("binary"))


def bucket_edges(members: np.ndarray, bits: int) -> list[tuple[int, int]]:
    """Edges that tie together the members reachable from each other inside one bucket, one per member at most.

    Members agree in all but two byte positions, so there are 65,536 of them at most. Small buckets compare
    their members at once; larger ones look each neighbour up by the differing bits, so neither time nor
    edges grow with the square.
    """
    values = members.view(np.uint64)
    n = len(values)
    label = np.arange(n)
    if n <= 128:
        near = np.bitwise_count(values[:, None] ^ values[None, :]) <= bits
        step = lambda: np.where(near, label[None, :], n).min(axis=1)
    else:
        varying = int(np.bitwise_or.reduce(values ^ values[0]))
        single = [1 << i for i in range(64) if varying >> i & 1]
        flips = [sum(c) for k in range(1, bits + 1) for c in combinations(single, k)]
        order = np.argsort(values)
        ranked = values[order]
        hits = []
        for flip in flips:
            other = values ^ np.uint64(flip)
            at = np.minimum(np.searchsorted(ranked, other), n - 1)
            found = np.flatnonzero(ranked[at] == other)
            if len(found):
                hits.append((found, order[at[found]]))

        def step() -> np.ndarray:
            out = label.copy()
            for i, j in hits:
                np.minimum.at(out, i, label[j])
            return out

    while True:
        new = step()
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(members[i]), int(members[r])) for i, r in enumerate(label) if i != r]


def near_fingerprints(prints: DataFrame, fp: str = "fp", bits: int = 2) -> DataFrame:
    """Edges ``a``, ``b`` between distinct fingerprints whose closure is that of all links at ``bits`` or fewer bits.

    Fingerprints at k bits or fewer differ in at most k of the 8 bytes, so a pair must share 8 - k positional
    bytes: the tally every linked pair is sure to reach. A posting for a single byte would hold 1/256 of all
    rows and its pairs would grow with the square of the corpus. The index is therefore keyed by each set of
    8 - k byte positions with the bytes there: two fingerprints meet only if they reach that tally, and every
    pair that reaches it meets. What meets is verified by its differing bits.
    """
    if not 1 <= bits <= 2:
        raise ValueError("the index serves 1 or 2 differing bits")
    kept = list(combinations(range(BYTES), BYTES - bits))
    masks = [sum(0xFF << 8 * p for p in positions) for positions in kept]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    distinct = prints.select(F.col(fp).alias("_fp")).distinct()
    postings = distinct.select(
        "_fp",
        F.explode(F.array(*[F.struct(F.lit(i).cast("byte").alias("s"), F.col("_fp").bitwiseAND(F.lit(m)).alias("v")) for i, m in enumerate(signed)])).alias("_p"),
    ).select("_fp", "_p.s", "_p.v")
    buckets = settle(
        postings.groupBy("s", "v").agg(F.count(F.lit(1)).alias("_n"), F.min("_fp").alias("a"), F.max("_fp").alias("b")).where(F.col("_n") > 1),
        "buckets",
    )
    pairs = buckets.where(F.col("_n") == 2).select("a", "b")
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= bits)

    @F.pandas_udf(_EDGES)
    def linked(groups: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in groups:
            yield pd.Series([[{"a": a, "b": b} for a, b in bucket_edges(np.asarray(g, np.int64), bits)] for g in part])

    groups = (
        postings.join(buckets.where(F.col("_n") > 2).select("s", "v"), ["s", "v"])
        .groupBy("s", "v")
        .agg(F.collect_set("_fp").alias("_members"))
    )
    more = groups.select(F.explode(linked("_members")).alias("e")).select("e.a", "e.b")
    return pairs.unionByName(more)


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, bits: int = 2) -> DataFrame:
    """Fingerprint and component of every document: ``doc_id``, ``fp`` (signed), ``component_id``.

    Documents link when their fingerprints differ in ``bits`` or fewer bits; ``component_id`` is the smallest
    id reachable. Equal fingerprints are one class, so copies of a text are one node however many there are.

    NULL and empty texts have fingerprint zero and link like any other. Rows that repeat an id are in the
    component of their own text. A NULL id never names a component; one of NULL ids alone has NULL as its
    id. An empty table gives an empty table. Other columns are not looked at.
    """
    rows = settle(docs.select(docs[id_col].alias("doc_id"), fingerprint(whole_text(docs, text_col), width).alias("fp")), "fingerprints")
    classes = settle(rows.groupBy("fp").agg(F.min("doc_id").alias("_first")), "classes")
    roots = connected_components(near_fingerprints(classes, "fp", bits))
    placed = classes.join(roots, classes.fp == roots.node, "left").select("fp", "_first", F.coalesce("root", "fp").alias("_root"))
    names = placed.groupBy("_root").agg(F.min("_first").alias("component_id"))
    named = placed.join(names, "_root").select(F.col("fp").alias("_fp"), "component_id")
    return rows.join(named, rows.fp == named._fp).select("doc_id", "fp", "component_id")
