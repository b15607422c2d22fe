"""Quality by perplexity under the Kneser-Ney model of trusted text in ``byte_ngrams``, with a bound per language."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from loomshelf.llm import byte_ngrams
from loomshelf.llm.common import maybe_among, settle, whole_text

#: Width of the bins of log-perplexity in which quantiles are found.
BIN = 0.001


def thresholds(scored: DataFrame, quantile: float, margin: float) -> DataFrame:
    """The bound per language: the quantile of the trusted documents' log-perplexity, and room above it.

    Exact on bins of ``BIN``; NULL languages are one. The row with ``every`` true holds the bound over all languages.
    """
    bins = scored.where("trusted AND log_perplexity IS NOT NULL").select("lang", F.ceil(F.col("log_perplexity") / BIN).alias("bin"))
    counted = bins.groupBy("lang", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = counted.groupBy("bin").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "bin", "n", F.lit(True).alias("every"))
    both = counted.select("lang", "bin", "n", F.lit(False).alias("every")).unionByName(every)
    up = Window.partitionBy("every", "lang").orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("every", "lang")
    reached = both.withColumn("upto", F.sum("n").over(up)).withColumn("total", F.sum("n").over(whole))
    return (
        reached.where(F.col("upto") >= F.col("total") * quantile)
        .groupBy("every", "lang")
        .agg((F.min("bin") * BIN + margin).alias("bound"), F.max("total").alias("texts"))
    )


def judge(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", quantile: float = 0.99, margin: float = 0.05, least_texts: int = 20
) -> DataFrame:
    """Perplexity of every document and whether it is kept: ``doc_id``, ``text_hash``, ``lang``, ``perplexity``, ``threshold``, ``kept``.

    Trusted are the documents that ``labels`` (doc_id, quality) gives quality 1. A document is rejected if its
    perplexity per byte is above the bound of its language: the ``quantile`` of that language's trusted
    documents, and ``margin`` (in log-perplexity) on top. A language with fewer than ``least_texts`` trusted
    texts has the bound of all trusted texts.

    NULL and empty texts have no perplexity and are kept, and so is everything if nothing is trusted. NULL
    languages are one language. Ids that repeat are judged by their own text; an id labelled both ways is
    not trusted; NULL ids are judged but never trusted. An empty table gives an empty table.
    """
    text = whole_text(docs, text_col)
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select(F.col("doc_id").alias("_llm_id"))
    rows = docs.select(docs[id_col].alias("doc_id"), docs[lang_col].cast("string").alias("lang"), text.alias("text"))
    rows = rows.withColumn("text_hash", F.xxhash64("text"))
    # only texts that may be trusted are shuffled to find those that are
    maybe = maybe_among(rows.where("text <> ''"), F.col("doc_id"), marks).where("_maybe").drop("_maybe")
    model = byte_ngrams.train(maybe.join(marks.hint("shuffle_hash"), maybe.doc_id == marks._llm_id, "left_semi"))
    if model is None:
        return rows.select("doc_id", "text_hash", "lang", F.lit(None).cast("double").alias("perplexity"), F.lit(None).cast("double").alias("threshold"), F.lit(True).alias("kept"))
    scored = byte_ngrams.log_perplexities(rows, model)
    model.forget()
    marked = scored.join(marks.withColumn("trusted", F.lit(True)), scored.doc_id == marks._llm_id, "left").drop("_llm_id")
    found = settle(thresholds(marked, quantile, margin), "thresholds")
    own = found.where(~F.col("every") & (F.col("texts") >= least_texts)).select(F.col("lang").alias("_lang"), F.col("bound").alias("_own"))
    every = found.where("every").agg(F.max("bound")).first()[0]  # one number
    bounded = scored.join(own, scored.lang.eqNullSafe(own._lang), "left")
    bound = F.coalesce(F.col("_own"), F.lit(every).cast("double"))
    return bounded.select(
        "doc_id",
        "text_hash",
        "lang",
        F.round(F.exp("log_perplexity"), 6).alias("perplexity"),
        F.round(F.exp(bound), 6).alias("threshold"),
        F.coalesce(F.col("log_perplexity") <= bound, F.lit(True)).alias("kept"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **options) -> DataFrame:
    """The documents that ``judge`` keeps; same columns. Rows that repeat an id and its text share the verdict."""
    verdicts = judge(docs, labels, id_col, text_col, lang_col, **options)
    gone = settle(verdicts.where(~F.col("kept")).select(F.col("doc_id").alias("_llm_id"), F.col("text_hash").alias("_llm_hash")).distinct(), "rejected")
    own = docs.withColumn("_llm_own", F.xxhash64(whole_text(docs, text_col)))
    marked = maybe_among(own, F.col("_llm_own"), gone.select("_llm_hash"))
    # only texts that may be rejected are shuffled
    left = marked.where("_maybe").join(gone.hint("shuffle_hash"), marked[id_col].eqNullSafe(gone._llm_id) & (marked._llm_own == gone._llm_hash), "left_anti")
    return marked.where("NOT _maybe").unionByName(left).select(*docs.columns)
