"""Exact dedup by a split of heavy hitters: frequent digests are settled on the map side, the rest by a shuffle."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshelf.llm.common import settle, whole_text

#: The characters that do not count: [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\x0c\r"


def _pick():
    # most code points, then the smallest id; a NULL id comes last
    return F.min(F.struct((-F.col("_n")).alias("n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"))).alias("_keep")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot_share: float = 0.001) -> DataFrame:
    """Which row of each set of equal texts stays.

    Texts are equal when they are the same after blanks are deleted. The row with the most code points of
    the original text stays, then the one with the smallest id. Columns: ``doc_id``, ``keep_id``,
    ``group_size``, ``kept``, ``text_sha256``.

    A frequent-items sketch (the Misra-Gries family, mergeable, of fixed size) names every digest that may
    hold ``hot_share`` of the rows. These candidates are counted exactly; the true winners, at most
    ``1 / hot_share`` rows, are broadcast, so that copies of a hot text get their verdict where they are
    read. All other digests are grouped and joined in shuffles of narrow rows.

    NULL texts are empty texts. Rows that repeat an id and its text are one document and share the verdict;
    NULL ids are legal and lose ties. An empty table gives an empty table. Other columns are not looked at.
    """
    text = whole_text(docs, text_col)
    rows = settle(
        docs.select(
            docs[id_col].alias("doc_id"),
            F.unhex(F.sha2(F.translate(text, BLANKS, ""), 256)).alias("_digest"),
            F.length(text).alias("_n"),
        ),
        "digests",
    )
    most = math.ceil(1 / hot_share)
    # the sketch's error is under 4 / tracked of the rows, a quarter of the share that counts as hot
    tracked = 2 ** math.ceil(math.log2(16 * most))
    sketch = rows.select(F.xxhash64("_digest").alias("_h")).agg(
        F.expr(f"approx_top_k(_h, {2 * most}, {tracked})").alias("_top"), F.count(F.lit(1)).alias("_rows")
    )
    candidates = sketch.select("_rows", F.explode("_top").alias("_c")).where(F.col("_c.count") > 1).select("_rows", F.col("_c.item").alias("_h"))
    winners = settle(
        rows.withColumn("_h", F.xxhash64("_digest"))
        .join(F.broadcast(candidates), "_h")
        .groupBy("_digest")
        .agg(_pick(), F.count(F.lit(1)).alias("_size"), F.first("_rows").alias("_rows"))
        .where(F.col("_size") > F.col("_rows") * hot_share)
        .select("_digest", "_keep", "_size"),
        "hot-digests",
    )
    hot = rows.join(F.broadcast(winners), "_digest")
    rest = rows.join(F.broadcast(winners), "_digest", "left_anti")
    groups = rest.groupBy("_digest").agg(_pick(), F.count(F.lit(1)).alias("_size"))
    return hot.unionByName(rest.join(groups, "_digest")).select(
        "doc_id",
        F.col("_keep.id").alias("keep_id"),
        F.col("_size").alias("group_size"),
        (F.col("doc_id").eqNullSafe(F.col("_keep.id")) & (F.col("_n") == -F.col("_keep.n"))).alias("kept"),
        F.lower(F.hex("_digest")).alias("text_sha256"),
    )
