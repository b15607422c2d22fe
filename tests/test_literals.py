"""Signs of a pattern: no match without one."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from loomshelf import catalog
from loomshelf.functions.lexicon import PATTERNS
from loomshelf.functions.literals import required_literals
from loomshelf.operators.text import may_match, pattern_counts


@pytest.mark.parametrize(
    ("pattern", "signs"),
    [
        ("가격", {"가격"}),
        ("싸[다고]", {"싸"}),
        ("[다고]", {"다", "고"}),
        ("(?:abc|de)f?", {"abc", "de"}),
        ("(?:abc|d?)f", {"f"}),
        ("x*yz+", {"y", "yz"}),
        (r"ab\s?cde", {"cde"}),
        ("(?!abc)d", {"d"}),
        ("a?b*", None),
        (r"\d+", None),
        ("(?i)abc", None),
        ("a|b?", None),
        ("[^a]", None),
        ("(?:ab){2,}", {"ab"}),
        ("(", None),
    ],
)
def test_signs(pattern, signs):
    got = required_literals(pattern)
    assert got == signs or signs == {"y", "yz"} and got in ({"y"}, {"z"}, {"yz"})


def some_texts():
    """Pieces of the shipped patterns in random order, so that many of them match."""
    rng = random.Random(1)
    pieces = [x for rules in PATTERNS.values() for p in rules for x in re.findall(r"[가-힣A-Za-z0-9]+", p)] + [" ", "안 ", "인데 ", "\n"]
    return ["".join(rng.choices(pieces, k=rng.randint(0, 60))) for _ in range(400)]


def test_no_shipped_pattern_matches_without_its_sign():
    texts, seen = some_texts(), 0
    for p in {p for rules in PATTERNS.values() for p in rules}:
        signs = required_literals(p)
        for t in texts:
            if re.search(p, t) and signs is not None:
                seen += 1
                assert any(s in t for s in signs), (p, t)
    assert seen > 500


def test_counts_are_those_of_all_patterns(spark):
    texts = some_texts()[:150] + [None, ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    counts = pattern_counts()
    got = {r[0]: tuple(r[1:]) for r in df.select("i", *[c.alias(f"c{k}") for k, c in enumerate(counts.values())]).collect()}
    want = {i: tuple(sum(len(re.findall(f"(?:{p})", t or "")) for p in rules) for rules in PATTERNS.values()) for i, t in enumerate(texts)}
    assert got == want and sum(map(sum, want.values())) > 500


def test_a_pattern_without_its_sign_is_not_searched(spark):
    plan = spark.range(1).select(pattern_counts({"c": ["가격"]}, F.lit("x"))["c"])._jdf.queryExecution().analyzed().toString().lower()
    assert "contains" in plan and "case when" in plan


def test_one_reading_tells_which_texts_may_match(spark):
    rules = {"a": ["MAC|3ce"], "b": ["별로[.]?"]}
    texts = ["d3cee", "an emac", "MA C", "별 로", "꽤 별로", "", None]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(may_match(rules).alias("may"), may_match({"c": ["x?"]}).alias("all")).collect()
    assert [r.may for r in got] == [True, False, False, False, True, False, None]
    assert all(r["all"] for r in got)


def test_korean_counts_leave_out_what_the_text_before_holds(spark, tmp_path):
    texts = ["token d3cee76 MAC", "", "안", "MAC 별로", "plain " * 9, "닥터", "A'pieu YSL\n"] * 6 + [None]
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    known = con.execute(catalog.SQL["tx10_pattern_counts_korean"]).fetchall()
    got = catalog.QUERIES["tx10_pattern_counts_korean"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(known)
