"""Every query with SQL gives the same rows as DuckDB on the same tables."""

import importlib
import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare  # noqa: E402

from loomshelf import catalog  # noqa: E402

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(sf):
        if f.endswith(".parquet"):
            c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{sf}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_same_rows(spark, sf, con, name):
    _, problems = compare(catalog.QUERIES[name](spark, sf), con, catalog.SQL[name])
    assert not problems


#: Queries that SQL cannot say, and the plain version that each is held to instead.
ELSEWHERE = {
    "ig4_product_section": "test_ingredient_queries.test_product_section",
    "ig10_normalise_names": "test_ingredient_queries.test_normalised_names",
    "ig14_closest_names": "test_closest.test_the_query_reads_every_language",
    "ig14_correct_all_names": "test_names.test_names_of_all_languages_and_lengths",
    "ig25_extract_by_mode": "test_ingredient_queries.test_extraction_by_mode",
    "ig_parse_ingredients": "test_ingredient_queries.test_the_whole_parse",
}


def test_every_query_is_held_to_something():
    assert set(ELSEWHERE) == set(catalog.QUERIES) - set(catalog.SQL)
    for place in ELSEWHERE.values():
        module, _, test = place.partition(".")
        assert callable(getattr(importlib.import_module(module), test))


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
