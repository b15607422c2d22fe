"""What parsing a text may cost, and that its tests say what their patterns say."""

import random

from pyspark.sql import functions as F

from loomshelf.functions import ingredient_lexicon as lex
from loomshelf.operators import ingredients as ig


def test_steps_are_taken_only_where_they_change_something(spark):
    docs = spark.createDataFrame([(1, "전성분: 정제수,\n글리세린")], "doc_id long, text string")
    plan = ig.parse_ingredients(docs, ["doc_id"])._jdf.queryExecution().optimizedPlan().toString()
    # words that end a section are not counted through letter by letter, and one look tells whether any stands
    assert plan.count("Contains") > len(lex.END_WORDS) and ig._some(lex.END_WORDS) in plan and ig._some(lex.MISREADINGS) in plan
    assert ig.UNCLEAN in plan


def test_items_are_told_as_one_pattern_tells_them(spark):
    words = ["합니다", "있다", "사용", "피부", "바르", "12ml", "SPF50", "spf5", "PA++", "02-1234-5678", "123456", "을", "때", "제품", "point3", "BOOK", "정제수", "오일"]
    words += ["BHT", "cI77891", "CI77491", "C6-14", "PEG-40", "peg-40", "A1", "abc", "é", "😀", "\n", "\r\n", "\u0085", " ", "ㄱ", "가" * 49, "x" * 50]
    rng = random.Random(7)
    items = {*words, *("가" * n + e for n in (1, 2, 99, 100, 101, 102) for e in ("", "\n", "\r\n", " ", "x"))}
    items |= {"".join(rng.choices(words, k=rng.randint(1, 4))) for _ in range(3000)}
    rows = spark.createDataFrame([(i,) for i in sorted(items)] + [("",), (None,)], "i string")
    noisy = "(?!(?i:" + "|".join(f"(?:{p})" for p in lex.NOT_AN_ITEM) + "))"

    def whole(script, allowed):
        last = f"|(?=(?i:{'|'.join(allowed)})$)" if allowed else ""
        return F.col("i").rlike(f"(?s)^(?=.{{2,100}}$){noisy}(?:(?=.*{script})|(?={lex.FORMULA}){last})")

    tests = [(lex.HANGUL, lex.PLAIN_ENGLISH), (lex.HANGUL, ()), ("[a-zß-ÿ]", lex.PLAIN_ENGLISH)]
    got = rows.select("i", *[c.alias(f"c{n}{k}") for n, (s, a) in enumerate(tests) for k, c in enumerate((ig.is_item("i", s, allowed=a), whole(s, a)))]).collect()
    assert [r for r in got if any(r[f"c{n}0"] != r[f"c{n}1"] for n in range(len(tests)))] == []


def test_keys_amounts_and_breaks_are_those_of_their_patterns(spark):
    items = ["애씨드", "씨드", "글리세린", "A b-c", "éß", "É", "ab\n", "12가", "٣", "ǅ", "a ", "물(95%)", "물(x)", "물(", "(1 ppm) a", "a/\nb", "3-\n4", "가\n나", "a\r\nb", "/", "-", None, ""]
    rows = spark.createDataFrame([(i,) for i in items], "i string").union(spark.sql("SELECT cast(X'41FF28' AS string) UNION ALL SELECT cast(X'ECFF' AS string)"))
    amount = r"\(([^)]*(?:ppm|ppb|%|mg|g|ml)[^)]*)\)"
    name, found = ig.concentration("i")
    key = F.regexp_replace(F.lower("i"), r"[\s-]+", "")
    joined = F.regexp_replace(F.regexp_replace("i", r"/\s*[\r\n]+\s*", "/"), r"-\s*[\r\n]+\s*(\d)", "-$1")
    joined = F.regexp_replace(F.regexp_replace(joined, r"([가-힣])\s*[\r\n]+\s*([가-힣])", "$1$2"), r"[\r\n]+", ", ")
    pairs = [
        (name, F.regexp_replace("i", r"(?i)(?s)^\s*(.*?)\s*" + amount + r"\s*(.*?)\s*$", "$1$3")),
        (found, F.nullif(ig.strip(F.regexp_extract("i", "(?i)" + amount, 1)), F.lit(""))),
        (ig.spelling_key("i"), ig.replace_all(key, {"애씨드": "애시드", "에씨드": "애시드"})),
        (ig.repair_breaks("i"), joined),
    ]
    got = rows.select(*[c.alias(f"c{n}{k}") for n, p in enumerate(pairs) for k, c in enumerate(p)]).collect()
    assert [r for r in got if any(r[f"c{n}0"] != r[f"c{n}1"] for n in range(len(pairs)))] == []
