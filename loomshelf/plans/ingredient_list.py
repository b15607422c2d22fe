"""Page and OCR texts → confident ingredient rows → product verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomshelf.operators import ingredients as ig


def ingredient_rows(texts: DataFrame, known: DataFrame, minimum: float = 0.5) -> DataFrame:
    """``texts(product_id, product_name, source, kind, text)`` → one row per product and ingredient.

    ``kind`` is page or ocr. Every text is narrowed to its product, parsed, scored and merged over sources.
    """
    own = ig.pick_product_section(texts.where(ig.has_ingredient_section("text")))
    parsed = ig.parse_ingredients(own, ["product_id", "source", "kind"])
    named = parsed.withColumn("ingredient", ig.normalise_name("ingredient"))
    finds = ig.score_names(named, known).where("valid")
    return ig.merge_sources(finds, minimum=minimum)


def verdict_tables(rows: DataFrame) -> dict[str, DataFrame]:
    judged = ig.verdicts(rows)
    return {"ingredients": judged, "products": ig.product_verdicts(judged), "issues": ig.issues(judged), "summary": ig.issue_summary(judged)}


def corrected(rows: DataFrame, dictionary: DataFrame, cutoff: float = 0.75) -> DataFrame:
    """Rows with the closest dictionary name; names are corrected once each."""
    fixes = ig.correct_names(rows.select(F.col("ingredient").alias("name")), dictionary, cutoff)
    return rows.join(fixes.withColumnRenamed("name", "ingredient"), "ingredient", "left")
