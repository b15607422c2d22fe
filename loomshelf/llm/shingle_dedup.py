"""Near-dedup of whole texts by the Jaccard similarity of their word shingles.

Texts whose SimHash fingerprints differ in two bits or fewer meet through the inverted index over byte positions of
``simhash``. Two texts at 0.8 differ in 5 to 7 of 64 bits in the median, where that index has no shared bytes left to
look up, and keys of enough bits of a wider fingerprint would have to be hundreds per text. The other candidates
therefore come from bands of minima (MinHash), and every link is verified on the shingles themselves.
What a band leaves undecided is settled by a join over the rarest shingles of each text, which is exact and does not
pair texts that only share a template.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.llm.common import connected_components, forget, maybe_among, settle, whole_text
from loomshelf.llm.simhash import near_fingerprints, print_of

SEED = 42
#: A pair at similarity s has a band in common with probability 1 - (1 - s^ROWS)^BANDS: 0.999997 at 0.8.
BANDS, ROWS = 24, 4
#: Shingles whose minima are taken at once.
BLOCK = 4096
_RNG = np.random.default_rng(SEED)
_MIX = _RNG.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles_of(text: bytes, width: int = 5) -> np.ndarray:
    """Distinct hashes of the word shingles; a shorter text is one shingle. ASCII case and blanks do not count."""
    words = text.lower().split()
    if len(words) <= width:
        joined = [b" ".join(words)]
    else:
        joined = map(b" ".join, zip(*(words[i:] for i in range(width))))
    return np.unique(np.frombuffer(b"".join([xxhash.xxh64_digest(s, SEED) for s in joined]), ">u8").astype(np.uint64))


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """One hash per band of minima, signed."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(shingles), BLOCK):
        x = (shingles[i : i + BLOCK, None] ^ _MIX[0]) * _MIX[1]
        x ^= x >> np.uint64(32)
        low = np.minimum(low, (x * _MIX[0]).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(b.tobytes(), i) for i, b in enumerate(low.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def _arrays(text: Column, width: int, bands: bool) -> Column:
    @F.pandas_udf("array<bigint>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            found = (shingles_of(t, width) for t in part)
            yield pd.Series([np.append(np.int64(print_of(s.astype(">u8").view(np.uint8))), bands_of(s)) if bands else s.view(np.int64) for s in found], dtype=object)

    return run(text.cast("binary"))


def _sets(nodes: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The shingles ``s`` of the texts whose hash is among ``nodes``, a row for each ``text_hash``."""
    maybe = maybe_among(texts, F.col("text_hash"), nodes).where("_maybe").drop("_maybe")
    node = nodes.columns[0]
    own = maybe.join(nodes.hint("shuffle_hash"), maybe.text_hash == nodes[node], "left_semi").dropDuplicates(["text_hash"])
    return settle(own.select("text_hash", _arrays(F.col("text"), width, False).alias("s")), "shingles")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs ``a``, ``b`` of text hashes whose shingles reach the similarity."""
    left = sets.select(F.col("text_hash").alias("a"), F.col("s").alias("_s"))
    right = sets.select(F.col("text_hash").alias("b"), F.col("s").alias("_t"))
    both = F.size(F.array_intersect("_s", "_t"))
    near = pairs.join(left, "a").join(right, "b").where(both >= (F.size("_s") + F.size("_t") - both) * similarity - 1e-9)
    return settle(near.select("a", "b"), "links")


def prefix_pairs(sets: DataFrame, roots: DataFrame, similarity: float) -> DataFrame:
    """Pairs ``a``, ``b`` of texts with different roots that may reach the similarity; all that do are among them.

    ``sets``: ``text_hash``, ``s``; ``roots``: ``text_hash``, ``root``. The shingles of a text are put in order, the rarest first.
    Two sets at the similarity share one of the first few of each: of the larger so many that leaving them all out
    would leave too little, of the smaller fewer still, as it must give the larger half of the overlap. A shingle
    that no other text has is never looked up; it only moves the others back, so of texts that share a template
    and differ by more than the similarity allows no shingle of the template is looked up either.
    """
    tokens = sets.select("text_hash", F.size("s").alias("size"), F.explode("s").alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    known = tokens.join(shared, "token").groupBy("text_hash", "size").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("ranked"))
    # places left for the larger and for the smaller set after the shingles that no other text has
    alone = F.col("size") - F.size("ranked")
    probe = F.col("size") - F.ceil(F.col("size") * similarity - 1e-9) + 1 - alone
    index = F.col("size") - F.ceil(F.col("size") * 2 * similarity / (1 + similarity) - 1e-9) + 1 - alone
    placed = known.select("text_hash", "size", index.alias("_index"), F.slice("ranked", F.lit(1), F.greatest(probe, F.lit(0)).cast("int")).alias("ranked"))
    posts = placed.join(roots, "text_hash").select("text_hash", "root", "size", "_index", F.posexplode("ranked").alias("at", "t"))
    posts = settle(posts.select("text_hash", "root", "size", F.col("t.token").alias("token"), (F.col("at") < F.col("_index")).alias("indexed")), "prefixes")
    open_ = posts.groupBy("token").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high").select("token")
    posts = posts.join(open_, "token")
    large = posts.select("token", F.col("text_hash").alias("_x"), F.col("root").alias("_rx"), F.col("size").alias("_nx"))
    small = posts.where("indexed").select("token", F.col("text_hash").alias("_y"), F.col("root").alias("_ry"), F.col("size").alias("_ny"))
    met = large.join(small, "token").where((F.col("_rx") != F.col("_ry")) & (F.col("_ny") <= F.col("_nx")) & (F.col("_ny") >= F.col("_nx") * similarity - 1e-9))
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b")).distinct()


def index_pairs(prints: DataFrame, bits: int = 2) -> DataFrame:
    """Pairs ``a``, ``b`` of text hashes whose closure holds every two texts with fingerprints at ``bits`` or fewer bits.

    ``prints``: ``text_hash``, ``fp``. Texts of one fingerprint meet its smallest text, which stands for them in the
    inverted index over byte positions.
    """
    heads = settle(prints.groupBy("fp").agg(F.min("text_hash").alias("head"), F.count(F.lit(1)).alias("_n")), "prints")
    same = prints.join(heads.where("_n > 1"), "fp").where("text_hash <> head").select(F.col("head").alias("_x"), F.col("text_hash").alias("_y"))
    edges = near_fingerprints(heads, "fp", bits)
    left, right = heads.select(F.col("fp").alias("a"), F.col("head").alias("_x")), heads.select(F.col("fp").alias("b"), F.col("head").alias("_y"))
    met = same.unionByName(edges.join(left, "a").join(right, "b").select("_x", "_y"))
    return met.select(F.least("_x", "_y").alias("a"), F.greatest("_x", "_y").alias("b"))


def near_texts(texts: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Root of every text that is linked to another: ``node``, ``root``. ``texts``: ``text``, ``text_hash``.

    Candidates of the inverted index are verified first. Every pair that shares a band is decided: either it is verified, or both are already in one component, or the
    pair cannot reach the similarity. First the members of a bucket meet its smallest and largest only, which ties
    a large group together by a number of pairs that grows with its size. Members of buckets that still hold
    different components then meet through their rarest shingles (``prefix_pairs``), never all with all.

    Texts that repeat are one; an empty text has one empty shingle. No texts give no rows.
    """
    signed = settle(texts.select("text_hash", F.posexplode(_arrays(F.col("text"), width, True)).alias("_at", "band")).select("text_hash", (F.col("_at") == 0).alias("_print"), "band").distinct(), "postings")
    postings = signed.where("NOT _print").drop("_print")
    by_index = index_pairs(signed.where("_print").select("text_hash", F.col("band").alias("fp")))
    buckets = postings.groupBy("band").agg(F.min("text_hash").alias("_low"), F.max("text_hash").alias("_high")).where("_low < _high")
    meets = postings.join(buckets.hint("merge"), "band").select("text_hash", F.explode(F.array("_low", "_high")).alias("_end")).where("text_hash <> _end")
    by_band = meets.select(F.least("text_hash", "_end").alias("a"), F.greatest("text_hash", "_end").alias("b"))
    first = settle(by_index.unionByName(by_band).distinct(), "candidates")
    sets = _sets(first.select(F.explode(F.array("a", "b")).alias("_node")).distinct(), texts, width)
    links = _verified(first, sets, similarity)
    roots = settle(connected_components(links), "roots")
    placed = settle(
        postings.join(buckets.hint("merge").select("band"), "band")
        .join(roots.hint("merge"), F.col("text_hash") == F.col("node"), "left")
        .select("band", "text_hash", F.coalesce("root", "text_hash").alias("root")),
        "placed",
    )
    forget(signed)
    mixed = placed.groupBy("band").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high").select("band")
    open_ = settle(placed.join(mixed.hint("merge"), "band").select("text_hash", "root").distinct(), "open")
    forget(placed)
    # the members of an open bucket have met one of its ends, so their shingles are there
    rest = prefix_pairs(sets.join(open_.select("text_hash"), "text_hash", "left_semi"), open_, similarity)
    more = _verified(settle(rest.join(first, ["a", "b"], "left_anti"), "candidates"), sets, similarity)
    found = connected_components(links.unionByName(more))
    for done in (first, sets, links, more, open_, roots):
        forget(done)
    return found


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents with one, that of the smallest id, left of each group of linked texts; same columns.

    Texts link when the Jaccard similarity of their shingles of ``width`` words is ``similarity`` or more; groups
    are closed over links. NULL, empty and blank texts are alike. Of rows that repeat an id and its text one
    stays. Rows without an id are all kept and name no group.
    """
    own = docs.withColumn("_llm_text", F.xxhash64(whole_text(docs, text_col)))
    named = own.where(own[id_col].isNotNull())
    roots = near_texts(named.select(whole_text(docs, text_col).alias("text"), F.col("_llm_text").alias("text_hash")), width, similarity)
    classes = settle(named.groupBy(F.col("_llm_text").alias("_hash")).agg(F.min(id_col).alias("_id"), F.count(F.lit(1)).alias("_n")), "texts")
    placed = classes.join(roots, classes._hash == roots.node, "left").select("_hash", "_id", "_n", F.coalesce("root", "_hash").alias("_root"))
    groups = placed.groupBy("_root").agg(F.min(F.struct("_id", "_hash")).alias("_stay"), F.sum("_n").alias("_rows")).where("_rows > 1")
    # texts of more than one row, or with a link; one id of one text stays of each group
    busy = placed.join(groups, "_root").select(F.col("_hash").alias("_llm_hash"), F.when(F.col("_hash") == F.col("_stay._hash"), F.col("_stay._id")).alias("_llm_stay"))
    busy = settle(busy, "groups")
    forget(classes)
    # only texts that may be among them are shuffled
    marked = maybe_among(named, F.col("_llm_text"), busy.select("_llm_hash"))
    met = marked.where("_maybe").join(busy, F.col("_llm_text") == F.col("_llm_hash"), "left").where(F.col("_llm_hash").isNull() | (F.col(id_col) == F.col("_llm_stay")))
    once = met.dropDuplicates([id_col, "_llm_text"])
    return marked.where("NOT _maybe").select(*docs.columns).unionByName(once.select(*docs.columns)).unionByName(docs.where(docs[id_col].isNull()))
