"""What judging a name may cost, and that the rules say what their patterns say."""

import random

from pyspark.sql import functions as F

from loomshelf.functions import ingredient_lexicon as lex
from loomshelf.functions.literals import needs, reach
from loomshelf.operators import ingredients as ig


def by_patterns(t):
    """Every rule by its pattern over the whole name."""
    either = lambda patterns: "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    among = lambda words: F.coalesce(t.isin(*words), F.lit(False))
    long_stops = "|".join(w.replace("·", "[·]") for w in lex.NAME_STOP_WORDS if len(w) >= 4)
    rules = {
        "too_short": t.isNull() | (F.length(t) < 2),
        "pure_number": t.rlike(lex.PURE_NUMBER),
        "dimension": t.rlike(lex.DIMENSION),
        "product_description": t.rlike(lex.DESCRIPTION),
        "invalid_2char": among(lex.BAD_TWO_LETTER),
        "verb_ending": t.rlike(lex.VERB_ENDING) & ~t.rlike("(?:" + "|".join(lex.ENDING_EXCEPTIONS) + ")$"),
        "pattern_match": t.rlike(either(lex.CHEMICAL_PATTERNS)),
        "ci_colorant": t.rlike(lex.COLORANT),
        "peg_ppg": t.rlike(lex.PEG_PPG),
        "ethoxylate": t.rlike(lex.ETHOXYLATE),
        "ethoxylate_extended": t.rlike(lex.ETHOXYLATE_EXTENDED),
        "enzyme": t.rlike(lex.ENZYME),
        "amino_acid_salt": t.rlike(lex.AMINO_ACID_SALT),
        "plant_derived": t.rlike(lex.PLANT_DERIVED),
        "glucoside": t.rlike(lex.GLUCOSIDE),
        "cellulose_derivative": t.rlike(lex.CELLULOSE) & (F.length(t) >= 6),
        "english_chemical": ~among(lex.ENGLISH_NOISE) & t.rlike(lex.ENGLISH_CHEMICAL),
        "alphanumeric_compound": ~among(lex.ENGLISH_NOISE) & t.rlike(lex.MIXED) & (F.length(t) >= 4) & ~t.rlike(lex.NOT_COMPOUND),
        "korean_chemical": t.rlike("^(?:" + "|".join(lex.CHEMICAL_PREFIXES) + ")|(?:" + "|".join(lex.CHEMICAL_SUFFIXES) + ")$"),
        "noise": t.rlike(either(lex.NOISE_PATTERNS)),
        "stopword": among(lex.NAME_STOP_WORDS),
        "english_noise": t.rlike(lex.SHORT_ENGLISH) & ~among(lex.VALID_ENGLISH) & ~t.rlike(lex.CHEMICAL_WORD),
        "contains_stopword": (F.length(t) >= 12) & t.rlike(long_stops),
    }
    return F.coalesce(*[F.when(applies, F.lit(name)) for name, applies in rules.items()], F.lit("no_pattern_match"))


def test_rules_say_what_their_patterns_say(spark):
    words = [*lex.NAME_STOP_WORDS, *lex.BAD_TWO_LETTER, *lex.ENGLISH_NOISE, *lex.VALID_ENGLISH, *lex.CHEMICAL_PREFIXES, *lex.CHEMICAL_SUFFIXES, *lex.ENDING_EXCEPTIONS]
    words += [*"할된한는을를가이에로의과와도만서라다인산염올틴", "사용", "개선", "합니다", "있을", "펩타이드-3", "세스7", "CI 77891", "CI77891", "C6-14x", "PEG-40", "라우레스-7", "글리세레스-26x", "x글루코사이드", "xx셀룰로스"]
    words += ["SPF50", "12ml", "1.5", "ab12", "Xylitol", "Glycerin", "a sentence of words", "é", "😀", "µ", "-", ".", "12/3", "02-1234-5678", "아제", "오일"]
    ends = ["", "\n", "\r\n", "\r", "\u0085", " ", "\n\n", "\n\r", "\nx", " 오일"]
    rng = random.Random(5)
    names = {w + e for w in words for e in ends} | {"".join(rng.choices([*words, "\n", " "], k=rng.randint(2, 5))) + rng.choice(ends) for _ in range(4000)}
    rows = spark.createDataFrame([(n,) for n in sorted(names)] + [("",), (None,)], "n string")
    broken = spark.sql("SELECT cast(X'EC98A4EC9DBCFF' AS string) AS n UNION ALL SELECT cast(X'F0EC98A4EC9DBC' AS string) UNION ALL SELECT cast(X'EC98E1EC82B0' AS string)")
    got = rows.union(broken).select("n", ig.validity_reason("n").alias("a"), by_patterns(F.col("n")).alias("b")).collect()
    assert [r for r in got if r.a != r.b] == []
    assert {r.a for r in got} >= {*ig.ACCEPTING, "no_pattern_match", "noise", "contains_stopword"} - {"known_ingredient"}


def test_texts_are_cut_once_and_no_pattern_starts_anywhere(spark):
    docs = spark.createDataFrame([(1, "a", "정제수 글리세린 판테놀 ab12"), (2, None, "가나다산, 세린, x, 정제수, y, z, 오일\n향")], "doc_id long, source string, text string")
    known = spark.createDataFrame([("판테놀",)], "entry string")
    out = ig.extract_by_mode(docs, ["doc_id"], known)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("posexplode") == 1
    # sought from every letter on, any letters before a literal cost the square of a name's length
    assert lex.AMINO_ACID_SALT not in plan and ig.SALT in plan
    rows = sorted((r.doc_id, r.pos, r.raw, r.ingredient, r.reason, r.confidence) for r in out.collect())
    assert rows == [(1, 1, "글리세린", "글리세린", "pattern_match", 0.9), (1, 2, "판테놀", "판테놀", "known_ingredient", 1.0), *[(2, i, n, n, "pattern_match", 0.9) for i, n in enumerate(["가나다산", "세린"])]]


def test_a_long_name_is_judged_in_time_that_grows_with_it(spark):
    rows = spark.createDataFrame([("가" * 300_000 + "x",), ("a" * 300_000,), ("가" * 300_000 + "염산염",)], "n string")
    assert [r.x for r in rows.select(ig.validity_reason("n").alias("x")).collect()] == ["no_pattern_match", "no_pattern_match", "pattern_match"]


def test_literals_that_a_pattern_needs():
    assert needs(lex.ENZYME, ig.SYLLABLE) and needs(lex.NOISE_PATTERNS[0], ig.SYLLABLE)
    assert not needs(lex.PEG_PPG, ig.SYLLABLE) and not needs("[가-힣]?x", ig.SYLLABLE)
    assert reach("(?:ab|cde)$") == 6
