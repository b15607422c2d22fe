"""Sample, label, route for review, merge, draw a gold set and split it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshelf.operators import labels as lb
from loomshelf.operators import quality as dq
from loomshelf.operators import sampling as sm
from loomshelf.sources.tables import settle


def draw_sample(pool: DataFrame, key: str, target: int = sm.TARGET_SIZE, floor_1: int = sm.FLOOR_1, floor_2: int = sm.FLOOR_2, min_share: float = dq.MIN_SCRIPT_SHARE) -> DataFrame:
    """Language filter, two-level quotas, draw, sentiment balance. Each stage is written once."""
    clean = settle(pool.where(dq.in_target_language("text", min_share=min_share)), "pool")
    quotas = settle(sm.two_level_quotas(clean, target=target, floor_outer=floor_1, floor_inner=floor_2), "quotas")
    drawn = settle(sm.stratified_sample(clean, quotas, ["category_1", "category_2"], key), "sample")
    return sm.balance_sentiment(clean, drawn, key, target)


def label_and_review(
    sample: DataFrame, key: str, labeller: lb.Labeller | None = None, judge: Callable[[DataFrame], DataFrame] | None = None
) -> DataFrame:
    """One row per review and aspect; doubtful ones pass through ``judge``, which rewrites sentiment,
    confidence and model (or marks a label REMOVE)."""
    rows = lb.explode_labels(lb.label_reviews(sample, labeller)).select(
        key,
        "text",
        "rating",
        "product_code",
        "aspect",
        F.col("aspect_sentiment").alias("sentiment"),
        F.col("aspect_confidence").alias("confidence"),
        F.lit("rules").alias("model"),
    )
    labels = settle(rows, "labels")
    keys = (key, "aspect")
    if judge is None:
        return labels
    return lb.merge_reviewed(labels, judge(lb.review_queue(labels, [key], keys)), keys)


def gold_splits(labels: DataFrame, key: str, per_cell: int = 3, size: int = 100) -> DataFrame:
    """Gold rows with their train, valid or test part; no product is in two parts."""
    keyed = labels.withColumn("label_key", F.concat_ws("/", key, "aspect"))
    gold = settle(sm.gold_set(keyed, "label_key", per_cell, size), "gold")
    return sm.split_by_group(gold, "product_code", "label_key")
