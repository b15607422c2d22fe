"""Classification metrics and gold-set evaluation from counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.functions.columns import ratio, unnest


def _prf(tp: str, predicted: str, support: str) -> dict[str, Column]:
    """Precision, recall and F1 with 0 where undefined."""
    return {
        "precision": ratio(tp, predicted, 0.0),
        "recall": ratio(tp, support, 0.0),
        "f1": ratio(F.col(tp) * 2.0, F.col(predicted) + F.col(support), 0.0),
    }


def _long(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    rows = [F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def per_class(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Counts and metrics per class, from one pass over (label, prediction) pairs."""
    pairs = df.groupBy(label, pred).agg(F.count(F.lit(1)).alias("_n"))
    sides = F.array(
        F.struct(F.col(label).alias("class"), F.col("_n").alias("support"), F.lit(0).cast("long").alias("predicted"), F.when(F.col(label) == F.col(pred), F.col("_n")).otherwise(0).alias("tp")),
        F.struct(F.col(pred).alias("class"), F.lit(0).cast("long").alias("support"), F.col("_n").alias("predicted"), F.lit(0).cast("long").alias("tp")),
    )
    counts = (
        pairs.select(F.explode(sides).alias("s"))
        .groupBy("s.class")
        .agg(F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp"))
    )
    return counts.withColumns(_prf("tp", "predicted", "support"))


def multiclass_metrics(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Accuracy, and macro and weighted precision, recall and F1."""
    c = per_class(df, label, pred)
    aggs = [(F.sum("tp") / F.sum("support")).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        aggs += [F.avg(m).alias(f"{m}_macro"), (F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"{m}_weighted")]
    wide = c.agg(*aggs)
    return _long(wide, wide.columns)


def per_aspect(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """True and false positives and misses per aspect of two aspect lists."""
    both = df.select(truth, pred, unnest(F.array_union(truth, pred), "aspect")).where(F.col("aspect").isNotNull())
    is_true, is_pred = F.array_contains(truth, F.col("aspect")), F.array_contains(pred, F.col("aspect"))
    counts = both.groupBy("aspect").agg(
        F.count_if(is_true & is_pred).alias("tp"), F.count_if(is_pred).alias("predicted"), F.count_if(is_true).alias("support")
    )
    return counts.withColumns(_prf("tp", "predicted", "support"))


def multilabel_metrics(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Micro and macro precision, recall and F1 over aspects."""
    c = per_aspect(df, truth, pred)
    tp, predicted, support = F.sum("tp"), F.sum("predicted"), F.sum("support")
    wide = c.agg(
        ratio(tp, predicted, 0.0).alias("precision_micro"),
        ratio(tp, support, 0.0).alias("recall_micro"),
        ratio(tp * 2.0, predicted + support, 0.0).alias("f1_micro"),
        *[F.avg(m).alias(f"{m}_macro") for m in ("precision", "recall", "f1")],
    )
    return _long(wide, wide.columns)


def confusion(df: DataFrame, label: str, pred: str, classes: Sequence[str]) -> DataFrame:
    return df.groupBy(label).agg(*[F.count_if(F.col(pred) == c).alias(f"pred_{c}") for c in classes])


def aspect_support(df: DataFrame, truth: str) -> DataFrame:
    """Rows per true aspect and their share of all rows."""
    total = df.agg(F.count(F.lit(1)).alias("_n"))
    counts = df.select(unnest(F.array_distinct(truth), "aspect")).where(F.col("aspect").isNotNull()).groupBy("aspect").agg(F.count(F.lit(1)).alias("support"))
    return counts.crossJoin(F.broadcast(total)).select("aspect", "support", (F.col("support") * 100.0 / F.col("_n")).alias("pct"))


def judge_gold(df: DataFrame) -> DataFrame:
    """Per gold row: is the true aspect predicted, and does its sentiment (else the overall one) agree?

    Expects ``corrected_aspect, corrected_sentiment, sentiment, aspect_labels``.
    """
    same = F.filter("aspect_labels", lambda a: a["aspect"] == F.col("corrected_aspect"))
    own = F.nullif(F.lower(F.get(same, F.size(same) - 1)["sentiment"]), F.lit(""))
    pred = F.coalesce(own, F.lower("sentiment"))
    return df.withColumns(
        {
            "aspect_match": F.size(same) > 0,
            "pred_sentiment": pred,
            "sentiment_match": F.coalesce(pred == F.lower("corrected_sentiment"), F.lit(False)),
        }
    )


def gold_accuracy(judged: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    return judged.agg(
        n.alias("total"),
        (F.count_if(F.col("aspect_match")) / n).alias("aspect_accuracy"),
        (F.count_if(F.col("sentiment_match")) / n).alias("sentiment_accuracy"),
        (F.count_if(F.col("aspect_match") & F.col("sentiment_match")) / n).alias("both_accuracy"),
    )


def gold_accuracy_by(judged: DataFrame) -> DataFrame:
    """Accuracy per true aspect and per true sentiment, long form."""
    sides = F.array(
        F.struct(F.lit("aspect").alias("dimension"), F.col("corrected_aspect").alias("value"), F.col("aspect_match").alias("hit")),
        F.struct(F.lit("sentiment").alias("dimension"), F.lower("corrected_sentiment").alias("value"), F.col("sentiment_match").alias("hit")),
    )
    return (
        judged.select(F.explode(sides).alias("s"))
        .groupBy("s.dimension", "s.value")
        .agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("s.hit")).alias("correct"))
        .withColumn("accuracy", F.col("correct") / F.col("total"))
    )


def gold_errors(judged: DataFrame) -> DataFrame:
    return judged.where(~(F.col("aspect_match") & F.col("sentiment_match"))).withColumn(
        "text", F.concat(F.substring("text", 1, 50), F.lit("..."))
    )
