"""Ingredient queries (IG*): the corpus is read as noisy ingredient text."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from loomshelf.catalog.loading import WORDS, word_rows
from loomshelf.catalog.registry import query, rounded
from loomshelf.functions import ingredient_lexicon as lex
from loomshelf.operators import closest
from loomshelf.operators import ingredients as ig
from loomshelf.sources import views as v
from loomshelf.sources.views import with_views

SWAPS = {"ction": "tion", "  ": " ", "eaue": "eau e", "erer": "er"}


def docs(spark, sf):
    return v.table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def _swapped(expr: str) -> str:
    for old, new in SWAPS.items():
        expr = f"replace({expr}, '{old}', '{new}')"
    return expr


@query(
    "ig1_normalise_text",
    r"SELECT doc_id, regexp_replace(regexp_replace("
    + _swapped("translate(nfc_normalize(text), chr(160) || chr(12288) || chr(8203) || chr(65279), '  ')")
    + r", '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g') AS text FROM documents",
)
def ig1(spark, sf):
    return ig.normalise_text(docs(spark, sf).select("doc_id", "text"), misreadings=SWAPS)


@query(
    "ig2_repair_breaks",
    r"""SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, '/\s*[\r\n]+\s*', '/', 'g'), '-\s*[\r\n]+\s*(\d)', '-\1', 'g'), '[\r\n]+', ', ', 'g') AS text FROM documents""",
)
def ig2(spark, sf):
    return docs(spark, sf).select("doc_id", ig.repair_breaks("text").alias("text"))


STARTS, ENDS = ["The ", "La ", "Der ", "El "], ["License", "@", ".\n"]
OPENED = "len(regexp_extract_all({0}, '[(（]')) - len(regexp_extract_all({0}, '[)）]'))"


def _section_sql() -> str:
    starts = ", ".join(f"nullif(instr(text, '{w}'), 0) AS s{i}" for i, w in enumerate(STARTS))
    first = f"least({', '.join(f's{i}' for i in range(len(STARTS)))})"
    skip = "CASE m " + " ".join(f"WHEN s{i} THEN {len(w)}" for i, w in enumerate(STARTS)) + " END"
    words = [w.replace("\n", "' || chr(10) || '") for w in ENDS]
    stops = ", ".join(
        f"CASE WHEN instr(tail, '{w}') > 0 AND opened + {OPENED.format(f"substr(tail, 1, instr(tail, '{w}') - 1)")} <= 0 THEN instr(tail, '{w}') END"
        for w in words
    )
    trim = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
    body = trim.format("CASE WHEN stop IS NULL THEN tail ELSE substr(tail, 1, stop - 1) END")
    heads = "|".join(STARTS)
    return f"""WITH a AS (SELECT doc_id, text, {starts} FROM documents), b AS (SELECT *, {first} AS m FROM a),
    c AS (SELECT doc_id, text, coalesce(m + {skip}, 1) AS f FROM b),
    d AS (SELECT doc_id, substr(text, f) AS tail, {OPENED.format("substr(text, 1, f - 1)")} AS opened FROM c), e AS (SELECT *, least({stops}) AS stop FROM d)
    SELECT doc_id, {trim.format(f"regexp_replace(regexp_replace({body}, '^(?:{heads})\\s*', ''), '^[:：–—-]+', '')")} AS section FROM e"""


@query("ig3_section", _section_sql())
def ig3(spark, sf):
    return ig.extract_section(docs(spark, sf).select("doc_id", "text"), starts=STARTS, ends=ENDS).select("doc_id", "section")


@query("ig4_product_section")
def ig4(spark, sf):
    named = docs(spark, sf).withColumn("product_name", F.array_join(F.slice(F.split("text", " "), 1, 2), " "))
    return ig.pick_product_section(named, brands=[]).select("doc_id", "text")


ITEMS = r"""SELECT doc_id, item AS ingredient, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos FROM (
SELECT doc_id, unnest(p) AS raw, generate_subscripts(p, 1) AS pos, replace(regexp_replace(raw, '^\s+|\s+$', '', 'g'), chr(1), ',') AS item FROM (
SELECT doc_id, string_split_regex(regexp_replace(text, '(\d),(\d)', '\1' || chr(1) || '\2', 'g'), '[,，;；\n]') AS p FROM documents)) WHERE item <> ''"""


def items(spark, sf):
    return ig.item_rows(docs(spark, sf), ["doc_id"])


@query("ig5_split_items", with_views("SELECT doc_id, ingredient, CAST(pos AS INTEGER) AS pos FROM items", items=ITEMS))
def ig5(spark, sf):
    return items(spark, sf)


@query(
    "ig6_clean_items",
    with_views(
        r"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, trim(trim(regexp_replace(regexp_replace(trim(ingredient, ' ' || chr(9) || chr(10) || chr(13) || '·•-'), '\(\s*\)', '', 'g'), '\[\s*\]', '', 'g'), '"'''))
        AS ingredient FROM items""",
        items=ITEMS,
    ),
)
def ig6(spark, sf):
    return items(spark, sf).withColumn("ingredient", ig.clean_item("ingredient"))


NOISE = "|".join(f"(?:{p})" for p in lex.NOT_AN_ITEM)


@query(
    "ig7_plausible_items",
    with_views(
        f"""SELECT doc_id, CAST(pos AS INTEGER) AS pos, ingredient FROM items WHERE length(ingredient) BETWEEN 2 AND 100 AND NOT regexp_matches(ingredient, '(?i)^(?:{NOISE})')
        AND (regexp_matches(ingredient, '[a-zß-ÿ]') OR upper(ingredient) IN ({", ".join(f"'{w}'" for w in lex.PLAIN_ENGLISH)}) OR regexp_matches(ingredient, '{lex.FORMULA}'))""",
        items=ITEMS,
    ),
)
def ig7(spark, sf):
    return items(spark, sf).where(ig.is_item("ingredient", script="[a-zß-ÿ]"))


@query(
    "ig8_dedup_items",
    with_views(
        """SELECT product_id, min(pos) AS pos, arg_max(ingredient, (length(ingredient), -pos)) AS ingredient FROM (
        SELECT product_id, pos, word AS ingredient FROM (SELECT doc_id AS product_id, unnest(w) AS word, CAST(generate_subscripts(w, 1) - 1 AS BIGINT) AS pos
        FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)) WHERE word <> '')
        GROUP BY product_id, regexp_replace(lower(ingredient), '[\\s-]+', '', 'g')""",
    ),
)
def ig8(spark, sf):
    # a text is dealt out whole, by the product, so that its words are grouped where they are cut
    dealt = v.table(spark, sf, "documents").select(F.col("doc_id").alias("product_id"), "text").repartition("product_id")
    d = dealt.select("product_id", F.posexplode_outer(F.split("text", " ")).alias("pos", "ingredient"))
    return ig.dedup_items(d.where("ingredient <> ''").withColumn("pos", F.col("pos").cast("long")), ["product_id"])


AMOUNT = r"\(([^)]*(?:ppm|ppb|%|mg|g|ml)[^)]*)\)"


@query(
    "ig9_concentration",
    with_views(
        rf"""SELECT regexp_replace(item, '(?is)^\s*(.*?)\s*{AMOUNT}\s*(.*?)\s*$', '\1\3') AS ingredient,
        nullif(regexp_replace(regexp_extract(item, '(?i){AMOUNT}', 1), '^\s+|\s+$', '', 'g'), '') AS concentration, count(*) AS n_rows FROM marked GROUP BY 1, 2""",
        words=WORDS,
        marked="SELECT CASE WHEN pos % 3 = 0 THEN ingredient || '(' || pos || ' ppm)' WHEN pos % 3 = 1 THEN '(' || ingredient || ')' ELSE ingredient END AS item FROM words",
    ),
)
def ig9(spark, sf):
    """A third of the words get an amount in brackets, a third are in brackets themselves."""
    rows = word_rows(spark, sf)
    amount = F.concat("ingredient", F.lit("("), F.col("pos").cast("string"), F.lit(" ppm)"))
    bare = F.when(F.col("pos") % 3 == 1, F.concat(F.lit("("), "ingredient", F.lit(")"))).otherwise(F.col("ingredient"))
    name, found = ig.concentration(F.when(F.col("pos") % 3 == 0, amount).otherwise(bare))
    return rows.groupBy(name.alias("ingredient"), found.alias("concentration")).agg(F.count(F.lit(1)).alias("n_rows"))


@query("ig10_normalise_names")
def ig10(spark, sf):
    names = items(spark, sf).select("ingredient").distinct()
    return names.select("ingredient", ig.normalise_name("ingredient").alias("normalised"))


def known_words(spark, sf, least=5):
    """Words of the benchmark passages stand for the dictionary."""
    words = v.table(spark, sf, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("entry"))
    return words.where(F.length("entry") >= least).distinct()


# every second word of the corpus stands for a listed name, a noise word or a stop word
NAMED = [*lex.SAFE[::4], *lex.NAME_STOP_WORDS[::4], *lex.BAD_TWO_LETTER[::5], *lex.ENGLISH_NOISE[::6], *lex.VALID_ENGLISH[::5], "PEG-40", "CI 77891", "SPF50", "1.5", "30ml", "STEP1", "PDRN5", "라우레스-7", "폴리글리세릴-10라우레이트", "피부에바르는", "Ab12", "Xylitol", "동백오일", "소듐이온", "에틸셀룰로오스", "알파글루코사이드", "리신에이치씨엘", "프로테아제", "가나다라마바사아자차카하이알루로네"]


def score_case() -> str:
    def m(pattern: str) -> str:
        return "regexp_matches(t, '" + pattern.replace("'", "''") + "')"

    def either(patterns) -> str:
        return m("^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")")

    def among(words) -> str:
        return "t IN (" + ", ".join(f"'{w}'" for w in words) + ")"

    parts = "^(?:" + "|".join(lex.CHEMICAL_PREFIXES) + ")|(?:" + "|".join(lex.CHEMICAL_SUFFIXES) + ")$"
    long_stops = " OR ".join(f"contains(t, '{w}')" for w in lex.NAME_STOP_WORDS if len(w) >= 4)
    rules = {
        "too_short": "length(t) < 2",
        "known_ingredient": "t IN (SELECT e FROM known)",
        "pure_number": m(lex.PURE_NUMBER),
        "dimension": m(lex.DIMENSION),
        "product_description": m(lex.DESCRIPTION),
        "invalid_2char": among(lex.BAD_TWO_LETTER),
        "verb_ending": m(lex.VERB_ENDING) + " AND NOT " + m("(?:" + "|".join(lex.ENDING_EXCEPTIONS) + ")$"),
        "pattern_match": either(lex.CHEMICAL_PATTERNS),
        "ci_colorant": m(lex.COLORANT),
        "peg_ppg": m(lex.PEG_PPG),
        "ethoxylate": m(lex.ETHOXYLATE),
        "ethoxylate_extended": m(lex.ETHOXYLATE_EXTENDED),
        "enzyme": m(lex.ENZYME),
        "amino_acid_salt": m(lex.AMINO_ACID_SALT),
        "plant_derived": m(lex.PLANT_DERIVED),
        "glucoside": m(lex.GLUCOSIDE),
        "cellulose_derivative": m(lex.CELLULOSE) + " AND length(t) >= 6",
        "english_chemical": "NOT " + among(lex.ENGLISH_NOISE) + " AND " + m(lex.ENGLISH_CHEMICAL),
        "alphanumeric_compound": "NOT " + among(lex.ENGLISH_NOISE) + " AND length(t) >= 4 AND " + m(lex.MIXED) + " AND NOT " + m(lex.NOT_COMPOUND),
        "korean_chemical": m(parts),
        "noise": either(lex.NOISE_PATTERNS),
        "stopword": among(lex.NAME_STOP_WORDS),
        "english_noise": m(lex.SHORT_ENGLISH) + " AND NOT " + among(lex.VALID_ENGLISH) + " AND NOT " + m(lex.CHEMICAL_WORD),
        "contains_stopword": f"length(t) >= 12 AND ({long_stops})",
    }
    return "CASE " + " ".join(f"WHEN {rule} THEN '{name}'" for name, rule in rules.items()) + " ELSE 'no_pattern_match' END"


ACCEPTED = ", ".join(f"('{name}', {value}::DOUBLE)" for name, value in ig.ACCEPTING.items())


@query(
    "ig11_score_names",
    with_views(
        f"""SELECT ingredient, a.c IS NOT NULL AS valid, coalesce(a.c, 0) AS confidence, reason, count(*) AS n_rows
        FROM judged LEFT JOIN (VALUES {ACCEPTED}) a(r, c) ON a.r = reason GROUP BY ALL""",
        words=WORDS,
        named=f"SELECT CASE WHEN pos % 2 = 0 THEN ns[1 + (pos + length(ingredient)) % {len(NAMED)}] ELSE ingredient END AS ingredient FROM words, (SELECT {NAMED} AS ns)",
        known="SELECT DISTINCT e FROM (SELECT unnest(string_split_regex(lower(text), '[^\\p{L}]+')) AS e FROM benchmark) WHERE e <> ''",
        trimmed="SELECT ingredient, regexp_replace(ingredient, '^[\\s\\v]+|[\\s\\v]+$', '', 'g') AS t FROM named",
        judged=f"SELECT ingredient, {score_case()} AS reason FROM trimmed",
    ),
)
def ig11(spark, sf):
    listed = F.element_at(F.array(*[F.lit(w) for w in NAMED]), ((F.col("pos") + F.length("ingredient")) % len(NAMED) + 1).cast("int"))
    rows = word_rows(spark, sf).withColumn("ingredient", F.when(F.col("pos") % 2 == 0, listed).otherwise(F.col("ingredient")))
    scored = ig.score_names(rows, known_words(spark, sf, 1))
    return scored.groupBy("ingredient", "valid", "confidence", "reason").agg(F.count(F.lit(1)).alias("n_rows"))


DELETE, REPLACE = ["the", "und"], {"of": "off", "les": "le", "off": "from", "le": "la"}
DIVIDE = {"and": ["an", "d"], "from": ["fr", " om"]}


@query(
    "ig12_apply_rules",
    with_views(
        """, r AS (SELECT product_id, regexp_replace(CASE ingredient WHEN 'of' THEN 'from' WHEN 'les' THEN 'la' WHEN 'off' THEN 'from' WHEN 'le' THEN 'la' ELSE ingredient END, '^er', '') AS i
        FROM words WHERE ingredient NOT IN ('the', 'und')),
        p AS (SELECT product_id, unnest(CASE i WHEN 'and' THEN ['an', 'd'] WHEN 'from' THEN ['fr', 'om'] ELSE [i] END) AS ingredient FROM r)
        SELECT DISTINCT product_id, regexp_replace(ingredient, '^\\s+|\\s+$', '', 'g') AS ingredient FROM p WHERE regexp_replace(ingredient, '^\\s+|\\s+$', '', 'g') <> ''""",
        words=WORDS,
    ),
)
def ig12(spark, sf):
    rows = word_rows(spark, sf, dealt=True)
    return ig.apply_rules(rows, DELETE, REPLACE, ["^er"], DIVIDE, keys=["product_id"])


# every second word of the corpus stands for a name that the shipped rules know, picked by its length and place
RULED = [*lex.DELETED[::3], *lex.REPLACED, *lex.SPLIT, "기재정제수", "표시글리세린", "화장품법에따라판테놀", "기재", " 정제수 "]


def ruled_rows() -> str:
    """What the rules make of each name, one after the other."""
    rows = []
    for i, name in enumerate(RULED):
        if name in lex.DELETED:
            continue
        for old, new in lex.REPLACED.items():
            name = new if name == old else name
        for pattern in lex.MARKETING:
            name = re.sub(pattern, "", name)
        rows += [(i, piece.strip()) for piece in lex.SPLIT.get(name, [name]) if piece.strip()]
    return ", ".join(f"({i}, '{piece}')" for i, piece in rows)


@query(
    "ig12_apply_korean_rules",
    with_views(
        rf"""SELECT product_id, piece AS ingredient FROM words JOIN (VALUES {ruled_rows()}) k(i, piece) ON pos % 2 = 0 AND i = (pos + length(ingredient)) % {len(RULED)}
        UNION SELECT product_id, regexp_replace(ingredient, '^\s+|\s+$', '', 'g') FROM words WHERE pos % 2 = 1 AND regexp_matches(ingredient, '\S')""",
        words=WORDS,
    ),
)
def ig12k(spark, sf):
    """The shipped rule table over names it knows and words it does not."""
    known = F.element_at(F.array(*[F.lit(w) for w in RULED]), ((F.col("pos") + F.length("ingredient")) % len(RULED) + 1).cast("int"))
    rows = word_rows(spark, sf, dealt=True).withColumn("ingredient", F.when(F.col("pos") % 2 == 0, known).otherwise(F.col("ingredient")))
    return ig.apply_rules(rows, keys=["product_id"])


@query(
    "ig13_unify_spellings",
    with_views(
        r"""SELECT count(*) AS n_rows, regexp_replace(regexp_replace(regexp_replace(replace(replace(ingredient, 'é', 'e'), 'ee', 'e'), '\(\d+\s*[a-z]+\)', '', 'g'), '^(?:the|la)', '', 'g'), '^\s+|\s+$', '', 'g') AS ingredient FROM words GROUP BY 2""",
        words=WORDS,
    ),
)
def ig13(spark, sf):
    t = ig.unify_spellings("ingredient", {"é": "e", "ee": "e"}, [r"\(\d+\s*[a-z]+\)", "^(?:the|la)"])
    return word_rows(spark, sf).groupBy(t.alias("ingredient")).agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "ig14_correct_names",
    r"""WITH n AS (SELECT DISTINCT w AS name FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents WHERE lang = 'en') WHERE length(w) >= 5),
    e AS (SELECT DISTINCT w AS entry FROM (SELECT unnest(string_split_regex(lower(text), '[^\p{L}]+')) AS w FROM benchmark) WHERE length(w) >= 5),
    m AS (SELECT name, entry, 1 - levenshtein(name, entry)::DOUBLE / greatest(length(name), length(entry)) AS r FROM n, e
          WHERE abs(length(name) - length(entry)) <= 0.2 * greatest(length(name), length(entry)) AND NOT regexp_matches(entry, '[^a-z]')),
    b AS (SELECT name, arg_min(entry, (-round(r, 9), entry)) AS entry FROM m WHERE r >= 0.8 - 1e-9 AND name NOT IN (SELECT entry FROM e) GROUP BY 1)
    SELECT n.name, CASE WHEN k.entry IS NOT NULL THEN n.name ELSE coalesce(b.entry, n.name) END AS corrected,
    round(CASE WHEN k.entry IS NOT NULL THEN 1.0 WHEN b.entry IS NULL THEN 0.0 ELSE
      len(list_intersect(list_distinct(string_split(n.name, '')), list_distinct(string_split(b.entry, ''))))::DOUBLE /
      len(list_distinct(list_concat(string_split(n.name, ''), string_split(b.entry, '')))) END::DOUBLE, 8) AS similarity, k.entry IS NOT NULL AS is_known
    FROM n LEFT JOIN b USING (name) LEFT JOIN e k ON k.entry = n.name""",
)
def ig14(spark, sf):
    english = docs(spark, sf).where("lang = 'en'").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("name"))
    dictionary = known_words(spark, sf).where(~F.col("entry").rlike("[^a-z]"))
    return rounded(ig.correct_names(english.where(F.length("name") >= 5), dictionary), "similarity")


@query("ig14_correct_all_names")
def ig14b(spark, sf):
    """Names of every language, script and length; ``ig14_correct_names`` is held to what its SQL can compare in time."""
    names = docs(spark, sf).select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("name"))
    return rounded(ig.correct_names(names, known_words(spark, sf, 1)), "similarity")


@query("ig14_closest_names")
def ig14c(spark, sf):
    """By longest matching blocks, after the known misreadings; names of every language, script and length."""
    names = docs(spark, sf).select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("name"))
    return rounded(closest.closest_names(names, known_words(spark, sf, 1), misreadings=lex.MISREADINGS), "similarity")


SIMPLE = r"""SELECT * FROM (SELECT doc_id, CAST(pos AS INTEGER) AS pos, original,
regexp_replace(CASE WHEN regexp_matches(c, '^CI\d+') THEN c ELSE regexp_replace(c, '\d+$', '') END, '^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$', '', 'g') AS normalized FROM (
SELECT doc_id, pos, original, regexp_replace(regexp_replace(regexp_replace(original, '\([^)]*\)', '', 'g'), '\[[^\]]*\]', '', 'g'), '[±*★☆※]', '', 'g') AS c FROM (
SELECT doc_id, unnest(p) AS original, generate_subscripts(p, 1) - 1 AS pos FROM (
SELECT doc_id, string_split_regex(replace(regexp_replace(text, '(?i)license[^\n]*', '', 'g'), 'idiot', ''), '[,;|\s]+') AS p FROM documents)) WHERE original <> '')) WHERE length(normalized) >= 2"""


@query("ig15_simple_extract", SIMPLE)
def ig15(spark, sf):
    return ig.simple_extract(docs(spark, sf), ["doc_id"], remove=[r"license[^\n]*"], phrases=["idiot"], misreadings={})


FINDS = """SELECT product_id, ingredient, CASE WHEN pos % 3 = 0 THEN 'page' ELSE 'ocr' END AS kind,
CASE length(ingredient) % 4 WHEN 0 THEN 0.9 WHEN 1 THEN 0.75 WHEN 2 THEN 0.55 ELSE 0.4 END::DOUBLE AS confidence FROM words"""


def finds(spark, sf):
    n = F.length("ingredient") % 4
    return word_rows(spark, sf).select(
        "product_id",
        "ingredient",
        F.when(F.col("pos") % 3 == 0, "page").otherwise("ocr").alias("kind"),
        F.when(n == 0, 0.9).when(n == 1, 0.75).when(n == 2, 0.55).otherwise(0.4).alias("confidence"),
    )


@query(
    "ig16_merge_sources",
    with_views(
        """, k AS (SELECT *, CASE WHEN kind = 'page' THEN confidence ELSE confidence * 0.9::DOUBLE END AS own FROM finds),
        g AS (SELECT product_id, ingredient, count(*) FILTER (kind = 'page') AS n_page, count(*) FILTER (kind = 'ocr') AS n_ocr,
        coalesce(max(own) FILTER (kind = 'page'), max(own)) AS base FROM k WHERE own >= 0.5 GROUP BY 1, 2)
        SELECT product_id, ingredient, n_page, n_ocr, n_page + n_ocr AS n_sources, round(least(1, least(1, base + CASE WHEN n_page > 0 THEN (n_page - 1) * 0.1 + n_ocr * 0.15
        ELSE (n_ocr - 1) * 0.15 END) + (n_page + n_ocr) * 0.05), 8) AS confidence FROM g""",
        words=WORDS,
        finds=FINDS,
    ),
)
def ig16(spark, sf):
    return rounded(ig.merge_sources(finds(spark, sf)), "confidence")


@query(
    "ig17_source_mode",
    with_views(
        """SELECT product_id, count(DISTINCT ingredient) FILTER (kind = 'page') AS n_page,
        CASE WHEN count(DISTINCT ingredient) FILTER (kind = 'page') >= 6 THEN 'verify' ELSE 'supplement' END AS mode FROM finds GROUP BY 1""",
        words=WORDS,
        finds=FINDS,
    ),
)
def ig17(spark, sf):
    return ig.source_mode(finds(spark, sf))


@query(
    "ig17_has_section",
    """SELECT doc_id, regexp_matches(text, 'License|licensed') OR (contains(text, 'the')::INTEGER + contains(text, 'and')::INTEGER + contains(text, 'eau')::INTEGER
    + contains(text, 'sch')::INTEGER) >= 3 AS has_section FROM documents""",
)
def ig17b(spark, sf):
    has = ig.has_ingredient_section("text", ["License", "licensed"], ["the", "and", "eau", "sch"])
    return docs(spark, sf).select("doc_id", has.alias("has_section"))


CLASSES = {"forbidden": ["the", "sch", "alcohol"], "animal": ["and", "the", "ción"], "safe": ["la", "le"], "ambiguous": ["of", "la", "que"]}
JUDGED = f"""SELECT *, CASE c WHEN 'f' THEN 'No' WHEN 'a' THEN 'Questionable' WHEN 'u' THEN 'Unknown' ELSE 'Yes' END AS can_halal,
CASE c WHEN 'f' THEN CASE WHEN ingredient = 'alcohol' THEN 'Yes' ELSE 'Unknown' END WHEN 'a' THEN 'No' WHEN 'u' THEN 'Unknown' ELSE 'Yes' END AS can_vegan,
CASE c WHEN 'f' THEN '{lex.WARN_FORBIDDEN}' WHEN 'a' THEN '{lex.WARN_ANIMAL}' WHEN 'u' THEN '{lex.WARN_AMBIGUOUS}' WHEN 's' THEN '' ELSE '{lex.WARN_UNKNOWN}' END AS warning,
CASE WHEN c = 'f' THEN ingredient ELSE '' END AS not_halal FROM (SELECT product_id, pos, ingredient, CASE WHEN ingredient IN ('the', 'sch', 'alcohol') THEN 'f'
WHEN ingredient IN ('and', 'ción') THEN 'a' WHEN ingredient IN ('la', 'le') THEN 's' WHEN ingredient IN ('of', 'que') THEN 'u' ELSE 'n' END AS c FROM words)"""


def judged(spark, sf):
    return ig.verdicts(word_rows(spark, sf), CLASSES)


@query("ig18_ingredient_verdicts", with_views("SELECT * EXCLUDE (c, product_id, pos), count(*) AS n_rows FROM judged GROUP BY ALL", words=WORDS, judged=JUDGED))
def ig18(spark, sf):
    d = judged(spark, sf)
    return d.groupBy("ingredient", "can_halal", "can_vegan", "warning", "not_halal").agg(F.count(F.lit(1)).alias("n_rows"))


# every second word of the corpus stands for an ingredient of the shipped lists, picked by its length and place
LISTED = [w for c in ig.CLASSES.values() for w in c[::3]] + ["쌀추출물", "에탄올앤물"]
FIRST_CLASS = {w: c for c, words in reversed(ig.CLASSES.items()) for w in words}


def korean_rows() -> str:
    """Verdicts of the listed words, one after the other."""
    rows = []
    for i, w in enumerate(LISTED):
        c, low = FIRST_CLASS.get(w), w.lower()
        alcohol, pork = "알코올" in low or "alcohol" in low, "돼지" in w or "pork" in low
        halal = {"forbidden": "No", "animal": "Questionable", "ambiguous": "Unknown"}.get(c, "Yes")
        vegan = {"forbidden": "Yes" if alcohol else "No" if pork else "Unknown", "animal": "No", "ambiguous": "Unknown"}.get(c, "Yes")
        warning = {"forbidden": lex.WARN_FORBIDDEN, "animal": lex.WARN_ANIMAL, "ambiguous": lex.WARN_AMBIGUOUS, "safe": ""}.get(c, lex.WARN_UNKNOWN)
        rows.append(f"({i}, '{halal}', '{vegan}', '{warning}')")
    return ", ".join(rows)


@query(
    "ig18_korean_verdicts",
    with_views(
        f"""SELECT coalesce(h, 'Yes') AS can_halal, coalesce(g, 'Yes') AS can_vegan, coalesce(w, '{lex.WARN_UNKNOWN}') AS warning, count(*) AS n_rows
        FROM words LEFT JOIN (VALUES {korean_rows()}) k(i, h, g, w) ON pos % 2 = 0 AND i = (pos + length(ingredient)) % {len(LISTED)} GROUP BY 1, 2, 3""",
        words=WORDS,
    ),
)
def ig18k(spark, sf):
    """The shipped class lists over listed and unlisted names."""
    listed = F.element_at(F.array(*[F.lit(w) for w in LISTED]), ((F.col("pos") + F.length("ingredient")) % len(LISTED) + 1).cast("int"))
    rows = word_rows(spark, sf).withColumn("ingredient", F.when(F.col("pos") % 2 == 0, listed).otherwise(F.col("ingredient")))
    return ig.verdicts(rows).groupBy("can_halal", "can_vegan", "warning").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "ig19_product_verdicts",
    with_views(
        """SELECT product_id, ['Yes', 'Unknown', 'Questionable', 'No'][1 + max(CASE can_halal WHEN 'No' THEN 3 WHEN 'Questionable' THEN 2 WHEN 'Unknown' THEN 1 ELSE 0 END)] AS can_halal,
        ['Yes', 'Unknown', 'Questionable', 'No'][1 + max(CASE can_vegan WHEN 'No' THEN 3 WHEN 'Unknown' THEN 1 ELSE 0 END)] AS can_vegan FROM judged GROUP BY 1""",
        words=WORDS,
        judged=JUDGED,
    ),
)
def ig19(spark, sf):
    return ig.product_verdicts(judged(spark, sf))


@query(
    "ig20_issues",
    with_views(
        """SELECT DISTINCT product_id, ingredient, 'vegan' AS "check", '동물성' AS issue FROM judged WHERE can_vegan = 'No' UNION ALL
        SELECT DISTINCT product_id, ingredient, 'halal', CASE can_halal WHEN 'No' THEN '부적합' ELSE '원료확인필요' END FROM judged WHERE can_halal IN ('No', 'Questionable')""",
        words=WORDS,
        judged=JUDGED,
    ),
)
def ig20(spark, sf):
    return ig.issues(judged(spark, sf))


@query(
    "ig20_issue_summary",
    with_views(
        """SELECT *, n_vegan_issues = 0 AS is_vegan, bad = 0 AS is_halal, '비건: ' || CASE WHEN n_vegan_issues = 0 THEN '적합' ELSE '부적합' END || ', 할랄: ' || CASE WHEN bad = 0 THEN '적합' ELSE '부적합 또는 의심' END AS summary
        FROM (SELECT product_id, count(*) FILTER (can_vegan = 'No') AS n_vegan_issues, count(*) FILTER (can_halal IN ('No', 'Questionable')) AS n_halal_issues,
        count(*) FILTER (can_halal = 'No') AS bad FROM judged GROUP BY 1)""".replace("SELECT *, n_vegan", "SELECT product_id, n_vegan_issues, n_halal_issues, n_vegan"),
        words=WORDS,
        judged=JUDGED,
    ),
)
def ig20b(spark, sf):
    return ig.issue_summary(judged(spark, sf))


CERTS = """SELECT product_code AS cert_id, CASE WHEN price = 500 THEN upper(name) || ' XL' WHEN price = 1000 THEN upper(brand) ELSE split_part(name, ' ', 1) || '!' END AS cert_name
FROM products WHERE price <= 1500"""


@query(
    "ig21_certified",
    with_views(
        """SELECT product_code, name, min(cert_id) AS cert_id, min(cert_id) IS NOT NULL AS is_certified FROM products LEFT JOIN certs
        ON contains(lower(name), lower(cert_name)) OR contains(lower(cert_name), lower(name)) GROUP BY 1, 2""",
        "products",
        certs=CERTS,
    ),
)
def ig21(spark, sf):
    p = v.products(spark, sf)
    cert = F.when(F.col("price") == 500, F.concat(F.upper("name"), F.lit(" XL"))).when(F.col("price") == 1000, F.upper("brand"))
    cert = cert.otherwise(F.concat(F.split("name", " ")[0], F.lit("!")))
    certs = p.where("price <= 1500").select(F.col("product_code").alias("cert_id"), cert.alias("cert_name"))
    return ig.certified(p.select("product_code", "name"), certs)


FUNCTIONS = [*lex.ANIMAL_FUNCTIONS, "보습", *lex.PLANT_FUNCTIONS, "Alcohol", "기타", "알코올", "돼지", "Porcine", "용제", "점증제", "향료"]


def said(words) -> str:
    return "(" + " OR ".join(f"contains(about, '{w}')" for w in words) + ")"


@query(
    "ig22_function_verdict",
    f"""WITH a AS (SELECT doc_id, lower(text || ' ' || ws[1 + (doc_id * 7 + length(text)) % {len(FUNCTIONS)}] || ' ' || ws[1 + doc_id % {len(FUNCTIONS)}]) AS about
    FROM documents, (SELECT {FUNCTIONS} AS ws))
    SELECT doc_id, CASE WHEN {said(lex.ANIMAL_FUNCTIONS)} THEN 'No' WHEN {said(lex.PLANT_FUNCTIONS)} THEN 'Yes' ELSE 'Unknown' END AS vegan,
    CASE WHEN {said(lex.ALCOHOL_FUNCTIONS + lex.PIG_FUNCTIONS)} THEN 'No' ELSE 'Unknown' END AS halal FROM a""",
)
def ig22(spark, sf):
    """Whole texts, each with two function words or other words behind it."""
    words = F.array(*[F.lit(w) for w in FUNCTIONS])
    picked = [F.element_at(words, (F.expr(p) % len(FUNCTIONS) + 1).cast("int")) for p in ("doc_id * 7 + length(text)", "doc_id")]
    vegan, halal = ig.function_verdict(F.concat_ws(" ", "text", *picked))
    return docs(spark, sf).select("doc_id", vegan.alias("vegan"), halal.alias("halal"))


@query("ig23_distinct_ingredients", with_views("SELECT DISTINCT ingredient FROM words", words=WORDS))
def ig23(spark, sf):
    return ig.distinct_ingredients(word_rows(spark, sf))


@query(
    "ig23_spelling_audit",
    with_views(
        """SELECT 'starts with a letter A-Z' AS "check", count(*) FILTER (regexp_matches(ingredient, '^[A-Za-z]')) AS n_rows FROM words
        UNION ALL SELECT 'accent', count(*) FILTER (regexp_matches(ingredient, 'é|è|ê')) FROM words UNION ALL SELECT 'digit', count(*) FILTER (regexp_matches(ingredient, '[0-9]')) FROM words""",
        words=WORDS,
    ),
)
def ig23b(spark, sf):
    return ig.spelling_audit(word_rows(spark, sf), {"accent": "é|è|ê", "digit": "[0-9]"})


@query(
    "ig24_union_categories",
    with_views("SELECT DISTINCT product_id, CASE WHEN length(ingredient) > 5 THEN 'long' ELSE 'short' END AS name, ingredient FROM words", words=WORDS),
)
def ig24(spark, sf):
    rows = word_rows(spark, sf)
    long = rows.where(F.length("ingredient") > 5).withColumn("name", F.lit("long"))
    short = rows.where(F.length("ingredient") <= 5).withColumn("name", F.lit("short"))
    return ig.union_categories([long, short], ["pos"]).select("product_id", "name", "ingredient")


@query(
    "ig25_separator_mode",
    r"""SELECT doc_id, CASE WHEN len(regexp_extract_all(text, ',')) - len(regexp_extract_all(text, ',\d-')) < 5 THEN 'space' ELSE 'comma' END AS mode,
    CASE WHEN source IN ('src1', 'src2') THEN 0.75 ELSE 0.85 END::DOUBLE AS threshold FROM documents""",
)
def ig25(spark, sf):
    origin = F.when(F.col("source") == "src1", "ALT_1").when(F.col("source") == "src2", "ocr_clova").otherwise(F.col("source"))
    return docs(spark, sf).select("doc_id", ig.separator_mode("text").alias("mode"), ig.acceptance_threshold(origin).alias("threshold"))


@query("ig25_extract_by_mode")
def ig25b(spark, sf):
    return ig.extract_by_mode(docs(spark, sf), ["doc_id"], known_words(spark, sf, 1))


@query(
    "ig26_mentions",
    """SELECT doc_id, concat_ws(', ', CASE WHEN regexp_matches(lower(text), 'license|gnu') THEN 'lic' END, CASE WHEN regexp_matches(lower(text), 'idiot|pathetic') THEN 'rude' END) AS mentions FROM documents""",
)
def ig26(spark, sf):
    return docs(spark, sf).select("doc_id", ig.mentions("text", {"lic": ["license", "gnu"], "rude": ["idiot", "pathetic"]}).alias("mentions"))


@query("ig_parse_ingredients")
def parse(spark, sf):
    """The whole parse on list text in the target script, written from the corpus words."""
    listed = F.concat(F.lit("전성분: "), F.regexp_replace("text", r"(\p{L}+)[^\p{L}]+", "$1오일,\n"))
    return ig.parse_ingredients(docs(spark, sf).select("doc_id", listed.alias("text")), ["doc_id"])
