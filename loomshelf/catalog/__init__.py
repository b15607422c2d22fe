"""Every registered query, by operator family."""

from loomshelf.catalog.registry import QUERIES, SQL
from loomshelf.catalog import features, ingredients, insights, labels, loading, quality, reviews, streams, text, trends  # noqa: F401

__all__ = ["QUERIES", "SQL"]
