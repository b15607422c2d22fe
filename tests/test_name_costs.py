"""What cleaning may cost: each step once per item."""

import re

from loomshelf.functions import ingredient_lexicon as lex
from loomshelf.operators import ingredients as ig


def test_an_item_is_cleaned_once(spark):
    rows = [(1, "전성분: ·글리세린(  )(기능성 원료), 판테놀 오일), (나이아신아마이드, [ ]\"알란토인\", 미백 정제수(95%), 티이에이, , abc")]
    parsed = ig.parse_ingredients(spark.createDataFrame(rows, "product_id long, text string"), ["product_id"])
    plan = parsed._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("자외선") == 1
    got = sorted((r.pos, r.ingredient, r.concentration) for r in parsed.collect())
    assert got == [(0, "글리세린", None), (1, "판테놀오일", None), (2, "나이아신아마이드", None), (3, "알란토인", None), (4, "정제수", "95%"), (5, "티이에이", None)]


def test_a_name_is_no_row_for_each_piece_of_it(spark):
    names = spark.createDataFrame([("glyzerin",), ("gly cerin",), ("ab c",)], "name string")
    entries = spark.createDataFrame([("glycerin",), ("a bd",), ("glyceral",), ("gl yceral",)], "entry string")
    corrected = ig.correct_names(names, entries)
    # entries alone are laid out, by the lengths that they may meet and by part
    assert corrected._jdf.queryExecution().optimizedPlan().toString().count("Generate") == 2
    got = {r.name: (r.corrected, r.is_known) for r in corrected.collect()}
    assert got == {"glyzerin": ("glycerin", False), "gly cerin": ("glycerin", True), "ab c": ("ab c", False)}


def test_a_name_meets_only_patterns_that_may_change_it(spark):
    named = spark.createDataFrame([("glycerin",)], "n string").select(ig.normalise_name("n").alias("x"))
    plan = named._jdf.queryExecution().optimizedPlan().toString()
    # what is left for names without syllables follows the last literal of the Korean steps
    plain = plan[plan.rindex(list(lex.LATE_SPELLINGS)[-1]) :].partition("ELSE")[2]
    assert plain.count("regexp_replace") == 9 and not re.search("[가-힣]", plain)
    # two patterns are bound to the beginning, each other one has a test of its own
    assert plain.count("CASE WHEN") == 7 and "[^\\w()]+$" not in plan


def test_steps_left_out_change_nothing(spark):
    names = {
        "a.b.c...": "a.b.c",
        "..(a) b!\u2028": "b",
        "!?.": "",
        "a\t\x0b b\u0085": "ab",
        "12=a-1,2-b": "a-1,2-b",
        "1,2-b*": "1,2-b",
        "Complex글리세린": "글리세린",
        "Complexity": "Complexity",
        "전성분[전성분]주성분:물": "물",
        "에탄 을(5%)★": "에탄올",
        "다이메i콘": "다이메티콘",
        "(CI 77891)\U0001f600": "(CI77891)",
        None: None,
    }
    rows = spark.createDataFrame([(n,) for n in names], "n string")
    assert {r.n: r.x for r in rows.select("n", ig.normalise_name("n").alias("x")).collect()} == names
    # a misreading without syllables may write some
    own = rows.where("n = '!?.' or n = 'Complexity'").select("n", ig.normalise_name("n", {"C": "에칠", "!": "에칠x"}).alias("x"))
    assert {r.n: r.x for r in own.collect()} == {"!?.": "에틸x", "Complexity": "에틸omplexity"}
    broken = spark.sql("SELECT cast(X'41FF2042C3' AS string) AS n").select(ig.normalise_name("n").alias("x"))
    assert [r.x for r in broken.collect()] == ["AB"]


def test_wide_blanks_of_every_kind_part_long_items(spark):
    long = "가" * 50
    texts = [f"{long}  나", f"{long} \t나", f"{long}\x0b\x0c나", f"{long} 나", f"{long}\t나", "가  나", "x" * 60 + "  나", "【세트】가", "[세트]가", "세트 :가", ":가"]
    got = [r.x for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(ig.split_items("t").alias("x")).collect()]
    want = [[long, "나"]] * 3 + [[t] for t in texts[3:7]] + [["【세트】", "가"], ["[세트]", "가"], ["세트 :", "가"], [":가"]]
    assert got == want
