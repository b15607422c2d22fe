"""Noisy ingredient text to clean, corrected, scored ingredient rows and product verdicts."""

from __future__ import annotations

import operator
import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomshelf.functions import ingredient_lexicon as lex
from loomshelf.functions.columns import any_of, bound, col, unnest
from loomshelf.functions.letters import pairs_in_order
from loomshelf.functions.literals import needs, reach, required_literals
from loomshelf.functions.ranking import keep_first

DECOMPOSED = "[̀-ͯᄀ-ᇿ]"


@F.pandas_udf(T.StringType())
def compose(text: pd.Series) -> pd.Series:
    """Unicode NFC; NULL stays NULL."""
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def replace_all(text: Column, pairs: Mapping[str, str]) -> Column:
    for old, new in pairs.items():
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def strip(text: Column, chars: str | None = None) -> Column:
    """Trim white space, or a set of characters, at both ends."""
    return F.btrim(text, F.lit(" \t\n\r\f\x0b" if chars is None else chars))


def holds(text: Column, literals: Iterable[str]) -> Column:
    """Whether a text holds one of some literals; one that holds another of them need not be looked for."""
    every = list(literals)
    least = [a for a in every if not any(b != a and b in a for b in every)]
    return reduce(operator.or_, [text.contains(a) for a in least], F.lit(False))


def _some(words: Iterable[str]) -> str:
    """A pattern for any of some words; a letter is compared with them only if one of them begins with it."""
    every = [w for w in words if w]
    first = "".join(sorted({re.escape(w[0]) for w in every}))
    return f"(?=[{first}])(?:{'|'.join(re.escape(w) for w in every)})"


def _if(test, step):
    """A step that is only taken where a cheap test holds, which holds for every name that the step changes."""
    return lambda t: F.when(test(t), step(t)).otherwise(t)


def normalise_text(df: DataFrame, text: str = "text", out: str = "text", misreadings: Mapping[str, str] = lex.MISREADINGS) -> DataFrame:
    """NFC, exotic spaces, ordered substitutions of misread syllables, single spaces.

    Only texts with combining characters are sent through Python; all others pass as NULL.
    """
    composed = F.coalesce(compose(F.when(F.col(text).rlike(DECOMPOSED), F.col(text))), F.col(text))
    steps = (
        _if(lambda t: holds(t, lex.SPACES + lex.INVISIBLE), lambda t: F.translate(t, lex.SPACES + lex.INVISIBLE, " " * len(lex.SPACES))),
        _if(lambda t: t.rlike(_some(misreadings)) if any(misreadings) else F.lit(False), lambda t: replace_all(t, misreadings)),
        lambda t: strip(F.regexp_replace(t, r"\s+", " ")),
    )
    return df.withColumn(out, composed).withColumn(out, _through(F.col(out), steps))


def repair_breaks(text: str | Column) -> Column:
    """Join names broken over lines; every other line break becomes a comma."""
    joins = (
        _replaced(r"/\s*[\r\n]+\s*", "/", "/"),
        _replaced(r"-\s*[\r\n]+\s*(\d)", "-$1", "-"),
        lambda t: F.regexp_replace(t, r"([가-힣])\s*[\r\n]+\s*([가-힣])", "$1$2"),
    )
    joined = bound(col(text), lambda t: F.when(holds(t, "\r\n"), _through(t, joins)).otherwise(t))
    return F.regexp_replace(joined, r"[\r\n]+", ", ")


def extract_section(
    df: DataFrame, text: str = "text", out: str = "section", starts: Sequence[str] = lex.START_WORDS, ends: Sequence[str] = lex.END_WORDS
) -> DataFrame:
    """The part after the earliest start word and before the earliest end word outside parentheses.

    Without a start word the whole text counts.
    """
    t = F.col(text)
    # a word is sought among bytes, which is quick, before its place is counted in letters
    hits = F.array_compact(
        F.array(*[F.when(t.contains(w) & (F.instr(t, w) > 0), F.struct(F.instr(t, w).alias("at"), F.lit(-len(w)).alias("length"))) for w in starts])
    )
    staged = df.withColumn("_first", F.array_min(hits)).withColumn(
        "_from", F.when(F.col("_first").isNull(), F.lit(1)).otherwise(F.col("_first.at") - F.col("_first.length"))
    )
    staged = staged.withColumn("_head", F.expr(f"substring(`{text}`, 1, _from - 1)")).withColumn("_tail", F.expr(f"substring(`{text}`, _from)"))
    opened = F.regexp_count("_head", F.lit("[(（]")) - F.regexp_count("_head", F.lit("[)）]"))
    staged = staged.withColumn("_open", opened)

    def stop(word: str) -> Column:
        at = F.instr("_tail", word)
        before = F.substring_index("_tail", word, 1)
        inside = F.col("_open") + F.regexp_count(before, F.lit("[(（]")) - F.regexp_count(before, F.lit("[)）]")) > 0
        return F.when(F.col("_tail").contains(word) & (at > 0) & ~inside, at)

    first = F.array_min(F.array_compact(F.array(*[stop(w) for w in ends])))
    staged = staged.withColumn("_stop", F.when(F.col("_tail").rlike(_some(ends)), first) if any(ends) else first)
    section = F.when(F.col("_stop").isNull(), F.col("_tail")).otherwise(F.expr("substring(_tail, 1, _stop - 1)"))
    trimmed = F.regexp_replace(F.regexp_replace(strip(section), "^(?:" + "|".join(re.escape(w) for w in starts) + r")\s*", ""), r"^[:：\-–—]+", "")
    return staged.withColumn(out, strip(trimmed)).drop("_first", "_from", "_head", "_tail", "_open", "_stop")


def product_keywords(name: str | Column, brands: Sequence[str] = lex.BRANDS, generic: Sequence[str] = lex.GENERIC_WORDS) -> Column:
    """Up to three telling words of a product name: no option, brand, amount, bracket or generic word."""
    n = strip(F.regexp_replace(col(name), r"\[\d+[^\]]*\]", ""))
    for brand in brands:
        n = F.regexp_replace(n, "(?iu)^" + re.escape(brand) + r"\s*", "")
    n = F.regexp_replace(n, r"(?iU)\d+\s*(ml|g|mg|매|개입|P)\b", "")
    words = F.split(strip(F.regexp_replace(n, r"\([^)]*\)", "")), r"\s+")
    return F.slice(F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(*generic)), 1, 3)


def pick_product_section(
    df: DataFrame,
    text: str = "text",
    name: str = "product_name",
    out: str = "text",
    heading: str = lex.PRODUCT_HEADING,
    min_length: int = 20,
    brands: Sequence[str] = lex.BRANDS,
) -> DataFrame:
    """Narrow a text about several products to one: by option number, else by the heading line that holds
    the name's words. Short finds are ignored and the whole text stays."""
    option = F.nullif(F.regexp_extract(name, r"\[(\d+)\s*[^\]]*\]", 1), F.lit(""))
    pattern = F.concat(F.lit(r"(?s)\["), option, F.lit(r"\s+[^\]]*\]\s*(.*?)(?=\[\d+\s+|\z)"))
    by_option = strip(F.call_function("regexp_extract", F.col(text), pattern, F.lit(1)))
    flat = F.transform("_lines", lambda x: F.lower(F.replace(x, F.lit(" "))))
    words = F.transform("_words", lambda w: F.lower(w))

    def is_heading(line: Column) -> Column:
        return F.forall(words, lambda w: F.contains(line, w)) | F.contains(line, F.array_join(words, ""))

    staged = (
        df.withColumn("_option", by_option)
        .withColumn("_lines", F.split(text, "\n"))
        .withColumn("_words", product_keywords(name, brands))
        .withColumn("_flat", flat)
        .withColumn("_found", F.when(F.size("_words") > 0, F.array_position(F.transform("_flat", is_heading), F.lit(True))))
        .withColumn("_after", F.transform(F.expr("slice(_lines, cast(coalesce(_found, 0) + 1 as int), size(_lines))"), lambda x: strip(x)))
    )
    stops = F.filter(
        F.sequence(F.lit(1), F.greatest(F.size("_after"), F.lit(1))),
        lambda i: F.coalesce(
            F.get("_after", i - 1).rlike(heading) | ((F.get("_after", i - 1) == "") & (i >= 2) & (F.get("_after", i - 2) == "")), F.lit(False)
        ),
    )
    by_heading = F.regexp_replace(F.array_join(F.slice("_after", F.lit(1), F.coalesce(F.get(stops, F.lit(0)) - 1, F.size("_after"))), "\n"), r"\n+$", "")
    return (
        staged.withColumn("_section", F.when(F.col("_found") > 0, by_heading))
        .withColumn(
            out,
            F.when(F.length("_option") > min_length, F.col("_option"))
            .when(F.length("_section") > min_length, F.col("_section"))
            .otherwise(F.col(text)),
        )
        .drop("_option", "_lines", "_words", "_flat", "_found", "_after", "_section")
    )


COMMA = "\u0001"
# what \s matches beside the space
OTHER_BLANKS = "\t\n\x0b\f\r"


def split_items(text: str | Column, kits: Sequence[str] = lex.KIT_HEADINGS, long_over: int = 50) -> Column:
    """Items of an ingredient list. Commas inside numbers stay; a kit's product headings are items of their own."""
    t = col(text)
    cut = F
    for heading in kits:
        signs = required_literals(heading)
        found = t.rlike(heading)
        cut = cut.when(found if signs is None else holds(t, signs) & found, F.regexp_replace(t, heading, ",$1,"))
    whole = cut.otherwise(t) if kits else t
    kept = F.regexp_replace(whole, r"(\d),(\d)", "$1" + COMMA + "$2")
    parts = F.transform(F.split(kept, "[,，;；\n]"), lambda p: strip(p))
    parts = F.transform(parts, lambda p: F.when(p.contains(COMMA), F.replace(p, F.lit(COMMA), F.lit(","))).otherwise(p))
    wide = r"(?<=[가-힣])\s{2,}(?=[가-힣])"
    # two blanks in a row are two spaces, or one of them is another blank
    blanks = ["  ", *OTHER_BLANKS]
    pieces = lambda p: F.transform(F.split(p, wide), lambda x: strip(x))
    split = F.flatten(F.transform(parts, lambda p: F.when((F.length(p) > long_over) & holds(p, blanks), pieces(p)).otherwise(F.array(p))))
    return F.filter(split, lambda p: p != "")


def _replaced(pattern: str, by: str, sign: str):
    """A replacement that is only tried where the sign, which every match holds, stands."""
    return lambda t: F.when(t.contains(sign), F.regexp_replace(t, pattern, by)).otherwise(t)


# an item goes through these one after the other, each with the result of the one before as its argument
CLEANING = (
    lambda t: strip(t, " \t\n\r·•-"),
    _replaced(r"\(\s*\)", "", "("),
    _replaced(r"\[\s*\]", "", "["),
    lambda t: strip(strip(t, "\"'")),
)
FUNCTIONAL = (
    _replaced(r"\([^)]*(?:식품의약품|심사|고시|기능성)[^)]*\)", "", "("),
    lambda t: F.regexp_replace(t, "|".join(lex.FUNCTIONAL_PHRASES), ""),
    _replaced(r"\(\s*\)", "", "("),
    # a bracket is stripped only when it has no partner, so "name(95%)" keeps its amount
    lambda t: strip(t, " ,;:"),
    _replaced(r"^([^(]*?)[ ,;:)]*\)$", "$1", ")"),
    _replaced(r"^\([ ,;:(]*([^)]*)$", "$1", "("),
)


# brackets, what is stripped at either end, and the openings of phrases: an item without any of them is clean as it is
_STRIPPED = " \t\n\r\f\x0b·•\"',;:\\-"
_OPENINGS = [re.match("[가-힣]{2}(?![?*{])", p) for p in lex.FUNCTIONAL_PHRASES]
UNCLEAN = "|".join([r"[()\[\]]", f"^[{_STRIPPED}]", f"[{_STRIPPED}]$", *sorted({m[0] if m else "" for m in _OPENINGS})])


def _through(value: Column, steps) -> Column:
    """One value through the steps, none of which is evaluated twice."""
    return bound(value, lambda t: _through(steps[0](t), steps[1:])) if steps else value


def clean_item(item: str | Column) -> Column:
    """Strip bullets and quotes, drop empty brackets."""
    return _through(col(item), CLEANING)


def without_functional_text(item: str | Column) -> Column:
    """Drop notes on approval and function, and brackets that these leave without a partner."""
    return _through(col(item), FUNCTIONAL)


def is_item(
    item: str | Column,
    script: str = lex.HANGUL,
    noise: Sequence[str] = lex.NOT_AN_ITEM,
    allowed: Sequence[str] = lex.PLAIN_ENGLISH,
    formula: str = lex.FORMULA,
    lengths: tuple[int, int] = (2, 100),
) -> Column:
    """Plausible ingredient: right length, no noise, and in the wanted script or an allowed code."""
    t = col(item)
    wanted = t.rlike(f"{script}|^(?:{formula})")
    wanted = wanted | t.rlike(f"^(?i:{'|'.join(allowed)})$") if allowed else wanted
    # what may stand after any letters is sought as it is, and what is no letter with case without regard to it
    inner = [p[2:-2] if p[-2:] == ".*" else p[2:] for p in noise if re.fullmatch(r"\.\*\([^()\\|]+(\|[^()\\|]+)*\)(\.\*|\$)", p) and p.lower() == p.upper()]
    opening = [p for p in noise if not (p[2:] in inner or p[2:-2] in inner)]
    noisy = [t.rlike("|".join(inner))] if inner else []
    noisy += [t.rlike("(?s)^(?i:" + "|".join(f"(?:{p})" for p in opening) + ")")] if opening else []
    least, most = lengths
    # a line end may follow the longest item
    fits = F.length(t).between(least, most) | (F.length(t).between(most + 1, most + 2) & t.rlike(f"(?s)^.{{{least},{most}}}$"))
    return reduce(operator.and_, [~n for n in noisy], fits & wanted)


def item_rows(df: DataFrame, keys: Sequence[str], text: str = "text", kits: Sequence[str] = lex.KIT_HEADINGS) -> DataFrame:
    """One row per item with its position in the list."""
    return df.select(*keys, F.posexplode_outer(split_items(text, kits)).alias("pos", "ingredient")).where(F.col("ingredient").isNotNull())


def spelling_key(item: str | Column) -> Column:
    """Spelling without case, spaces, hyphens and the acid variants."""
    t = col(item)
    key = replace_all(F.regexp_replace(F.lower(t), r"[\s-]+", ""), {"애씨드": "애시드", "에씨드": "애시드"})
    # syllables, small letters and digits alone are their own key, but for the acids
    return F.when(t.rlike(r"^[\p{Ll}\p{Nd}가-힣]+\z") & ~t.contains("씨드"), t).otherwise(key)


def dedup_items(rows: DataFrame, keys: Sequence[str], item: str = "ingredient", pos: str = "pos") -> DataFrame:
    """One row per spelling: first position, longest form (the earliest of equally long ones)."""
    longest = F.struct(F.length(item), -F.col(pos))
    return (
        rows.groupBy(*keys, spelling_key(item).alias("_key"))
        .agg(F.min(pos).alias(pos), F.max_by(item, longest).alias(item))
        .drop("_key")
    )


def concentration(item: str | Column, flags: str = "(?i)") -> tuple[Column, Column]:
    """Name without, and text of, the bracketed amount; NULL amount when there is none."""
    amount = r"\(([^)]*(?:ppm|ppb|%|mg|g|ml)[^)]*)\)"
    t = col(item)
    name = F.regexp_replace(t, flags + r"(?s)^\s*(.*?)\s*" + amount + r"\s*(.*?)\s*$", "$1$3")
    # an item without a bracket is its name; a pattern would mend broken bytes
    bracket = t.contains("(")
    found = F.nullif(strip(F.regexp_extract(t, flags + amount, 1)), F.lit(""))
    return F.when(bracket, name).otherwise(F.make_valid_utf8(t)), F.when(bracket, found)


def parse_ingredients(df: DataFrame, keys: Sequence[str], text: str = "text", misreadings: Mapping[str, str] = lex.MISREADINGS) -> DataFrame:
    """Whole path from raw text to ranked ingredient rows with amounts."""
    repaired = df.select(*keys, repair_breaks(text).alias("text"))
    section = extract_section(normalise_text(repaired, misreadings=misreadings)).select(*keys, "section")
    # cleaned inside the list: a filter on a cleaned column would be pushed below it and clean every item again
    clean = _if(lambda t: t.rlike(UNCLEAN), lambda t: _through(t, (*CLEANING, *FUNCTIONAL)))
    items = F.transform(split_items("section"), clean)
    cleaned = section.select(*keys, F.posexplode_outer(items).alias("pos", "ingredient")).where(F.col("ingredient").isNotNull())
    kept = cleaned.where(is_item("ingredient", allowed=()))
    name, amount = concentration("ingredient")
    return dedup_items(kept, keys).select(
        *keys, "pos", F.regexp_replace(name, r"\s+", "").alias("ingredient"), amount.alias("concentration")
    )


def _without_prefixes(prefixes: Sequence[str], after: str = ""):
    """Prefixes dropped one after the other, each once; tried where the name begins with one of them."""

    def drop(t: Column) -> Column:
        for p in prefixes:
            t = F.regexp_replace(t, f"^{p}{after}", "")
        return t

    return _if(lambda t: t.rlike(f"^(?:{'|'.join(prefixes)}){after}"), drop)


def _respelled(pairs: Mapping[str, str]):
    return _if(lambda t: holds(t, pairs), lambda t: replace_all(t, pairs))


SYLLABLE = "[가-힣]"
EDGE = r"(?U)^[^\w()]+"
LEAD = "[0-9=|!@#$%^&*<>]"
# syllables, and signs that some step other than those at both ends deletes or that open what it deletes
INSIDE = f"[가-힣{OTHER_BLANKS}±·�(\\[*★☆※]"


def _at_ends():
    """What is left to do to a name without syllables and signs: its spaces go, and so do symbols at both ends."""
    return (
        lambda t: F.when(t.contains(" "), F.replace(t, F.lit(" "), F.lit(""))).otherwise(t),
        _if(lambda t: F.substring(t, 1, 1).rlike(LEAD), lambda t: F.regexp_replace(t, rf"^(?!\d,\d-){LEAD}+", "")),
        _if(lambda t: F.substring(t, 1, 1).rlike(EDGE), lambda t: F.regexp_replace(t, EDGE, "")),
        _if(lambda t: F.substring(t, -1, 1).rlike(EDGE), lambda t: F.reverse(F.regexp_replace(F.reverse(t), EDGE, ""))),
    )


def _naming(misreadings: Mapping[str, str], korean: bool):
    """The steps of a name, each with the result of the one before as its argument; those that act on syllables if wanted."""
    units = "ppb|ppm|%|mg/kg|µg/kg|mg/L|µg/L|g/L|w/w|w/v|v/v|mg|g|ml|L|kg"
    phrases = "|".join(re.escape(p) for p in lex.EMBEDDED_PHRASES)
    opening = (
        _without_prefixes([re.escape(p) for p in lex.NAME_PREFIXES]),
        _if(lambda t: holds(t, lex.EMBEDDED_PHRASES), lambda t: F.regexp_replace(t, phrases, "")),
        _without_prefixes(lex.ENGLISH_PREFIXES, f"(?={SYLLABLE})"),
        _without_prefixes(lex.KOREAN_PREFIXES, "(?=.{3})"),
    )
    return (
        *(opening if korean else ()),
        lambda t: F.when(holds(t, OTHER_BLANKS), F.regexp_replace(t, r"\s+", "")).otherwise(F.replace(t, F.lit(" "), F.lit(""))),
        *([_respelled(misreadings)] if korean else ()),
        _if(lambda t: holds(t, "±·�"), lambda t: F.regexp_replace(t, "[±·�]", "")),
        lambda t: F.regexp_replace(t, rf"^(?!\d,\d-){LEAD}+", ""),
        _replaced(rf"(?i)\(\s*[\d,\.]+\s*({units})?\s*\)", "", "("),
        _replaced(r"\((?!(?:(?i:CI)\s*\d+\)|C\d+|\d+-\d+))[^)]*\)", "", "("),
        _replaced(r"\[[^\]]*\]", "", "["),
        _if(lambda t: holds(t, "*★☆※"), lambda t: F.regexp_replace(t, r"[*★☆※]", "")),
        lambda t: F.regexp_replace(t, EDGE, ""),
        # the other end is the beginning of the reversed name, so that no search runs through the whole of it
        _if(lambda t: F.substring(t, -1, 1).rlike(EDGE), lambda t: F.reverse(F.regexp_replace(F.reverse(t), EDGE, ""))),
        *([_respelled(lex.LATE_SPELLINGS)] if korean else ()),
        lambda t: strip(t),
    )


def normalise_name(name: str | Column, misreadings: Mapping[str, str] = lex.MISREADINGS, valid: bool = False) -> Column:
    """Ingredient name without prefixes, embedded phrases, amounts, notes and edge symbols.

    Brackets with a colour index or a carbon chain (CI 77891, C6-14, 6-14) stay. ``valid`` says that no name has broken
    bytes, as none has that a pattern has cut out of a text.
    """

    def through(t: Column, korean: bool) -> Column:
        return _through(t, _naming(misreadings, korean))

    # a name without syllables meets no literal that has one, and the steps left to it only delete
    literals = [*lex.NAME_PREFIXES, *lex.EMBEDDED_PHRASES, *lex.KOREAN_PREFIXES, *misreadings, *lex.LATE_SPELLINGS]
    every = not all(re.search(SYLLABLE, w) for w in literals)

    def named(t: Column) -> Column:
        if every:
            return through(t, True)
        return F.when(~t.rlike(INSIDE), _through(t, _at_ends())).when(t.rlike(SYLLABLE), through(t, True)).otherwise(through(t, False))

    # literals are sought among bytes, patterns among characters: both read the same once broken bytes are U+FFFD
    return bound(col(name) if valid else F.make_valid_utf8(col(name)), named)


# Confidence of every reason that accepts a name; all other reasons reject it.
ACCEPTING = {
    "known_ingredient": 1.0,
    "pattern_match": 0.9,
    "ci_colorant": 0.95,
    "peg_ppg": 0.9,
    "ethoxylate": 0.9,
    "ethoxylate_extended": 0.9,
    "enzyme": 0.85,
    "amino_acid_salt": 0.85,
    "plant_derived": 0.85,
    "glucoside": 0.85,
    "cellulose_derivative": 0.85,
    "english_chemical": 0.8,
    "alphanumeric_compound": 0.75,
    "korean_chemical": 0.85,
}


def _either(patterns: Sequence[str]) -> str:
    return "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"


def _met(t: Column, pattern: str, korean: bool) -> Column | None:
    """Whether a pattern is found; it is tried only where a literal that every match holds stands. None: it cannot be."""
    if not korean and needs(pattern, SYLLABLE):
        return None
    signs = required_literals(pattern)
    return t.rlike(pattern) if signs is None else holds(t, signs) & t.rlike(pattern)


def _among(words: Sequence[str], korean: bool) -> list[str]:
    """The words that a name may be or hold."""
    return [w for w in words if korean or not re.search(SYLLABLE, w)]


def _any_met(t: Column, patterns: Sequence[str], korean: bool) -> Column | None:
    """Whether one of some patterns is found at the beginning."""
    left = [p for p in patterns if korean or not needs(p, SYLLABLE)]
    return t.rlike(_either(left)) if left else None


def _or(*tests: Column | None) -> Column | None:
    left = [t for t in tests if t is not None]
    return reduce(operator.or_, left) if left else None


def _and(*tests: Column | None) -> Column | None:
    return None if any(t is None for t in tests) else reduce(operator.and_, tests)


# these are bound to the end of a name, so its last letters are enough to find them
EXCEPTED = "(?:" + "|".join(lex.ENDING_EXCEPTIONS) + ")$"
SUFFIXES = "(?:" + "|".join(lex.CHEMICAL_SUFFIXES) + ")$"
# a pattern that may begin anywhere is found after any letters if it is found after one
SALT = lex.AMINO_ACID_SALT.replace(".+", ".", 1) if lex.AMINO_ACID_SALT.startswith(".+") else lex.AMINO_ACID_SALT
# patterns of any letters and then a literal at the end; all others are tried as they are
_LAST = {p: p[2:-1] for p in lex.CHEMICAL_PATTERNS if p[:2] == ".+" and p[-1] == "$" and p[2:-1] == re.escape(p[2:-1])}
NAMED = ".(?:" + "|".join(_LAST.values()) + ")$"
# what is bound to the beginning and needs no syllable: a name that begins with none of it meets none of its rules
_OPENING = [lex.PURE_NUMBER, lex.DIMENSION, lex.DESCRIPTION, lex.COLORANT, lex.PEG_PPG, lex.ETHOXYLATE, lex.ETHOXYLATE_EXTENDED, lex.ENGLISH_CHEMICAL]
_OPENING += [lex.ENZYME, lex.PLANT_DERIVED, lex.GLUCOSIDE, lex.CELLULOSE, lex.MIXED, lex.SHORT_ENGLISH, *lex.CHEMICAL_PATTERNS, *lex.NOISE_PATTERNS]
OPENING = "^(?:" + "|".join(f"(?:{p})" for p in _OPENING if not needs(p, SYLLABLE)) + ")"
NAME_END = max(map(reach, (lex.VERB_ENDING, EXCEPTED, SUFFIXES, SALT, NAMED)))


def validity_reason(name: str | Column, known: str | Column | None = None, stop_words: Sequence[str] = lex.NAME_STOP_WORDS) -> Column:
    """Why a (trimmed) name is taken or refused: the first rule that applies.

    ``known`` is a boolean column that says whether the name is in the known list (a join made before). The work on a
    name grows with its length: no pattern is sought from each of its letters to its end.
    """

    def judged(t: Column) -> Column:
        rules = lambda end, korean, opened: _first_rule(t, end, korean, opened, known, stop_words)
        by_end = bound(F.substring(t, -NAME_END, NAME_END), lambda end: rules(end, True, True))
        # a name without syllables meets only the rules that need none, few of which are not bound to the beginning
        return F.when(t.rlike(SYLLABLE), by_end).when(t.rlike(OPENING), rules(t, False, True)).otherwise(rules(t, False, False))

    return bound(col(name), judged)


def _first_rule(t: Column, end: Column, korean: bool, opened: bool, known: str | Column | None, stop_words: Sequence[str]) -> Column:
    """``end`` has the last letters of a name at least, ``korean`` says whether it may have syllables, ``opened`` whether
    it may begin with what needs none."""
    mixed = t.rlike(lex.MIXED) & (F.length(t) >= 4)
    not_noise = ~t.isin(*lex.ENGLISH_NOISE)
    # any letters and then a literal at the end: the literal is sought at the end, the letters must be one line
    patterns = [_met(t, f"^(?:{p})", korean) for p in lex.CHEMICAL_PATTERNS if p not in _LAST]
    bad, stops = _among(lex.BAD_TWO_LETTER, korean), _among(stop_words, korean)
    rules = [
        ("too_short", t.isNull() | (F.length(t) < 2)),
        ("known_ingredient", F.coalesce(col(known), F.lit(False)) if known is not None else None),
        ("pure_number", t.rlike(lex.PURE_NUMBER)),
        ("dimension", t.rlike(lex.DIMENSION)),
        ("product_description", t.rlike(lex.DESCRIPTION)),
        ("invalid_2char", t.isin(*bad) if bad else None),
        ("verb_ending", _and(_at_end(end, lex.VERB_ENDING, korean), ~end.rlike(EXCEPTED))),
        ("pattern_match", _or(_and(_at_end(end, NAMED, korean), t.rlike("^.+$")), *patterns)),
        ("ci_colorant", _met(t, lex.COLORANT, korean)),
        ("peg_ppg", _met(t, lex.PEG_PPG, korean)),
        ("ethoxylate", _met(t, lex.ETHOXYLATE, korean)),
        ("ethoxylate_extended", _met(t, lex.ETHOXYLATE_EXTENDED, korean)),
        ("enzyme", _met(t, lex.ENZYME, korean)),
        ("amino_acid_salt", _at_end(end, SALT, korean)),
        ("plant_derived", _met(t, lex.PLANT_DERIVED, korean)),
        ("glucoside", _met(t, lex.GLUCOSIDE, korean)),
        ("cellulose_derivative", _and(_met(t, lex.CELLULOSE, korean), F.length(t) >= 6)),
        ("english_chemical", not_noise & t.rlike(lex.ENGLISH_CHEMICAL)),
        ("alphanumeric_compound", not_noise & mixed & ~t.rlike(lex.NOT_COMPOUND)),
        ("korean_chemical", _or(_any_met(t, lex.CHEMICAL_PREFIXES, korean), _at_end(end, SUFFIXES, korean))),
        ("noise", _any_met(t, lex.NOISE_PATTERNS, korean)),
        ("stopword", t.isin(*stops) if stops else None),
        ("english_noise", t.rlike(lex.SHORT_ENGLISH) & ~t.isin(*lex.VALID_ENGLISH) & ~t.rlike(lex.CHEMICAL_WORD)),
        ("contains_stopword", _contains_long(t, stops)),
    ]
    reason = F
    for label, applies in rules:
        if applies is not None and (opened or label not in OPENED):
            reason = reason.when(applies, F.lit(label))
    return reason.otherwise(F.lit("no_pattern_match"))


# rules that ask for one of the patterns bound to the beginning
OPENED = {
    "pure_number", "dimension", "product_description", "pattern_match", "ci_colorant", "peg_ppg", "ethoxylate", "ethoxylate_extended", "enzyme",
    "plant_derived", "glucoside", "cellulose_derivative", "english_chemical", "alphanumeric_compound", "noise", "english_noise",
}


def _at_end(end: Column, pattern: str, korean: bool) -> Column | None:
    return end.rlike(pattern) if korean or not needs(pattern, SYLLABLE) else None


def _contains_long(t: Column, stop_words: Sequence[str]) -> Column | None:
    words = [w for w in stop_words if len(w) >= 4]
    if not words:
        return None
    return (F.length(t) >= 12) & t.rlike(_some(words))


def reason_confidence(reason: str | Column) -> Column:
    out = F
    for label, confidence in ACCEPTING.items():
        out = out.when(col(reason) == label, F.lit(confidence))
    return out.otherwise(F.lit(0.0))


def score_names(rows: DataFrame, known: DataFrame, name: str = "ingredient", stop_words: Sequence[str] = lex.NAME_STOP_WORDS) -> DataFrame:
    """valid, confidence and reason per row; the rules run once per distinct name and are joined back."""
    distinct = rows.select(F.col(name).alias("_name")).distinct().withColumn("_t", strip(F.col("_name")))
    marks = known.select(F.trim(known.columns[0]).alias("_known")).distinct()
    judged = distinct.join(marks, F.col("_t") == F.col("_known"), "left").select(
        "_name", validity_reason("_t", F.col("_known").isNotNull(), stop_words).alias("reason")
    )
    confidence = reason_confidence("reason")
    return rows.join(judged, F.col(name) == F.col("_name"), "left").select(
        *rows.columns, F.col("reason").isin(*ACCEPTING).alias("valid"), confidence.alias("confidence"), "reason"
    )


def resolve_chains(replacements: Mapping[str, str]) -> dict[str, str]:
    """Replacements are applied one after the other, so a result may be replaced again by a later rule."""
    order = list(replacements)
    out = {}
    for i, old in enumerate(order):
        new = replacements[old]
        for later in order[i + 1 :]:
            if new == later:
                new = replacements[later]
        out[old] = new
    return out


def apply_rules(
    rows: DataFrame,
    delete: Sequence[str] = tuple(lex.DELETED),
    replace: Mapping[str, str] = lex.REPLACED,
    patterns: Sequence[str] = tuple(lex.MARKETING),
    split: Mapping[str, Sequence[str]] = lex.SPLIT,
    keys: Sequence[str] = ("product_id", "name"),
    item: str = "ingredient",
) -> DataFrame:
    """Delete, replace, strip phrases, split one into many, drop blanks and repeats.

    The rule tables are hand-written and broadcast, and every rule is applied where a row is read: rows are not sent to
    their names and back. They are shuffled once, when repeats of the same keys are dropped, and not at all if they are
    dealt out by ``keys`` already.
    """
    spark = rows.sparkSession
    named = rows.select(*keys, F.col(item).alias("_name")).where("_name IS NOT NULL")
    gone = spark.createDataFrame([(d,) for d in delete], "_name string") if delete else None
    kept = named.join(F.broadcast(gone), "_name", "left_anti") if gone is not None else named
    fixes = spark.createDataFrame(list(resolve_chains(replace).items()) or [(None, None)], "_old string, _new string")
    fixed = kept.join(F.broadcast(fixes), F.col("_name") == F.col("_old"), "left").select(*keys, F.coalesce("_new", "_name").alias("_item"))
    for p in patterns:
        # nothing but a literal holds every match of a pattern: where it does not stand, the pattern is not tried
        head = p.removeprefix("^")
        swapped = F.regexp_replace("_item", p, "")
        if head and head == re.escape(head):
            swapped = F.when(F.col("_item").startswith(head) if p != head else F.col("_item").contains(head), swapped).otherwise(F.col("_item"))
        fixed = fixed.withColumn("_item", swapped)
    parts = spark.createDataFrame([(k, list(v)) for k, v in split.items()] or [(None, None)], "_whole string, _parts array<string>")
    # the item is worked out before it is joined, by a generator, so that no rule is applied twice
    fixed = fixed.select(*keys, unnest(F.array("_item"), "_item"))
    pieces = fixed.join(F.broadcast(parts), F.col("_item") == F.col("_whole"), "left").select(
        *keys, unnest(F.coalesce("_parts", F.array("_item")), "_piece")
    )
    clean = pieces.select(*keys, strip(F.col("_piece")).alias(item))
    return clean.distinct().where(F.col(item) != "")


def unify_spellings(item: str | Column, pairs: Mapping[str, str], patterns: Sequence[str]) -> Column:
    """Spelling variants in order, then phrases and bracketed amounts removed."""
    t = replace_all(col(item), pairs)
    for p in patterns:
        t = F.regexp_replace(t, p, "")
    return strip(t)


def correct_names(names: DataFrame, dictionary: DataFrame, cutoff: float = 0.8, name: str = "name", entry: str = "entry") -> DataFrame:
    """Closest dictionary entry per name: exact, exact without spaces, else edit similarity ≥ cutoff.

    Edit similarity is 1 - distance / longer length. With at most k edits all but k letters of the longer word
    stand in the same order in the other one, so candidates are the pairs that have as many (``functions.letters``).
    """
    if not 0.5 < cutoff <= 1:
        raise ValueError("cutoff must lie above 0.5 and not above 1")
    a = names.select(F.col(name).alias("_n")).where(F.length("_n") > 0).distinct().withColumn("_a", F.replace(F.col("_n"), F.lit(" ")))
    b = dictionary.select(F.col(entry).alias("_e")).where(F.length("_e") > 0).distinct().withColumn("_b", F.replace(F.col("_e"), F.lit(" ")))
    by_text = b.groupBy(F.col("_b").alias("_a")).agg(F.min("_e").alias("_stripped"))
    exact = b.select(F.col("_e").alias("_n"), F.col("_e").alias("_same"))
    direct = a.join(exact, "_n", "left").join(by_text, "_a", "left").withColumn("_hit", F.coalesce("_same", "_stripped"))

    # names and entries meet without their spaces, which several of each may share
    rest = direct.where(F.col("_hit").isNull()).select("_a").distinct()
    share = round(1 - cutoff, 9)
    pairs = pairs_in_order(rest, b.select("_b").distinct(), 1 - share, lambda x, y: max(x, y) - int(share * max(x, y) + 1e-9))
    ratio = 1 - F.levenshtein("_a", "_b") / F.greatest(F.length("_a"), F.length("_b"))
    best = (
        pairs.withColumn("_r", ratio)
        .where(F.col("_r") >= cutoff - 1e-9)
        .join(by_text.withColumnRenamed("_a", "_b"), "_b")
        .groupBy("_a")
        .agg(F.min_by(F.struct(F.col("_stripped").alias("_e"), "_b"), F.struct(-F.round("_r", 9), F.col("_stripped"))).alias("_best"))
    )
    letters = lambda c: F.array_distinct(F.split(c, ""))
    jaccard = F.size(F.array_intersect(letters("_a"), letters(F.col("_best._b")))) / F.size(F.array_union(letters("_a"), letters(F.col("_best._b"))))
    return direct.join(best, "_a", "left").select(
        F.col("_n").alias(name),
        F.coalesce("_hit", F.col("_best._e"), "_n").alias("corrected"),
        F.when(F.col("_hit").isNotNull(), 1.0).when(F.col("_best").isNotNull(), jaccard).otherwise(0.0).alias("similarity"),
        F.col("_hit").isNotNull().alias("is_known"),
    )


def simple_extract(
    df: DataFrame,
    keys: Sequence[str],
    text: str = "text",
    remove: Sequence[str] = lex.SIMPLE_REMOVE,
    phrases: Sequence[str] = lex.SIMPLE_PHRASES,
    misreadings: Mapping[str, str] = lex.MISREADINGS,
    min_length: int = 2,
) -> DataFrame:
    """Plain extraction: drop noise, split on , ; | and spaces, normalise each piece."""
    t = F.col(text)
    for p in remove:
        t = F.regexp_replace(t, "(?i)" + p, "")
    for p in phrases:
        t = F.replace(t, F.lit(p))
    pieces = df.select(*keys, F.posexplode_outer(F.split(t, r"[,;|\s]+")).alias("pos", "original")).where(F.col("original") != "")
    n = replace_all(F.col("original"), misreadings)
    n = F.regexp_replace(F.regexp_replace(n, r"\([^)]*\)", ""), r"\[[^\]]*\]", "")
    n = F.regexp_replace(n, "[±*★☆※]", "")
    n = F.when(n.rlike(r"^CI\d+"), n).otherwise(F.regexp_replace(n, r"\d+$", ""))
    n = F.regexp_replace(n, r"^[^\p{L}\p{N}_]+|[^\p{L}\p{N}_]+$", "")
    # a piece of ASCII letters alone is left as it is by every pattern; the generator keeps the test of the length from
    # working everything out once more
    plain = replace_all(F.col("original"), misreadings)
    n = F.when(plain.rlike("^[A-Za-z]+$") & ~plain.endswith("\n"), plain).otherwise(n)
    named = pieces.select("*", unnest(F.array(n), "normalized"))
    return named.where(F.length("normalized") >= min_length)


def merge_sources(finds: DataFrame, keys: Sequence[str] = ("product_id", "ingredient"), minimum: float = 0.5) -> DataFrame:
    """Confidence of an ingredient seen in several sources.

    ``finds`` has one row per sighting with ``kind`` (page or ocr) and ``confidence`` of the name. OCR
    counts at 0.9; every further sighting adds 0.1 (page) or 0.15 (OCR) up to 1; each source adds 0.05.
    """
    page = F.col("kind") == "page"
    own = F.when(page, F.col("confidence")).otherwise(F.col("confidence") * 0.9)
    kept = finds.withColumn("_own", own).where(F.col("_own") >= minimum)
    counted = kept.groupBy(*keys).agg(
        F.count_if(page).alias("n_page"),
        F.count_if(~page).alias("n_ocr"),
        F.max(F.when(page, F.col("_own"))).alias("_page"),
        F.max(F.when(~page, F.col("_own"))).alias("_ocr"),
    )
    further = F.when(F.col("n_page") > 0, (F.col("n_page") - 1) * 0.1 + F.col("n_ocr") * 0.15).otherwise((F.col("n_ocr") - 1) * 0.15)
    merged = F.least(F.lit(1.0), F.coalesce("_page", "_ocr") + further)
    sources = F.col("n_page") + F.col("n_ocr")
    return (
        counted.withColumn("n_sources", sources)
        .withColumn("confidence", F.least(F.lit(1.0), merged + sources * 0.05))
        .where(F.col("confidence") >= minimum)
        .drop("_page", "_ocr")
    )


def source_mode(finds: DataFrame, product: str = "product_id", enough: int = 6) -> DataFrame:
    """Whether OCR verifies (enough page finds) or supplements a product's list."""
    per = finds.groupBy(product).agg(F.count_distinct(F.when(F.col("kind") == "page", F.col("ingredient"))).alias("n_page"))
    return per.withColumn("mode", F.when(F.col("n_page") >= enough, "verify").otherwise("supplement"))


def has_ingredient_section(text: str | Column, headers: Sequence[str] = lex.HEADERS, names: Sequence[str] = lex.COMMON_NAMES, enough: int = 3) -> Column:
    """A header word, or at least three common ingredient names."""
    t = F.coalesce(col(text), F.lit(""))
    seen = F.lit(0)
    for n in names:
        seen = seen + F.when(t.contains(n), 1).otherwise(0)
    return t.rlike("|".join(re.escape(h) for h in headers)) | (seen >= enough)


CLASSES = {"forbidden": lex.FORBIDDEN, "animal": lex.ANIMAL, "safe": lex.SAFE, "ambiguous": lex.AMBIGUOUS}


def verdicts(rows: DataFrame, classes: Mapping[str, Sequence[str]] = CLASSES, item: str = "ingredient") -> DataFrame:
    """can_halal, can_vegan and warning per ingredient row; the first class that lists it decides.

    The class table is hand-written and broadcast. Unlisted ingredients count as plant-based or synthetic.
    """
    ranked = [(w, i, c) for i, (c, words) in enumerate(classes.items()) for w in words]
    first: dict[str, tuple[int, str]] = {}
    for w, i, c in ranked:
        first.setdefault(w, (i, c))
    table = rows.sparkSession.createDataFrame([(w, c) for w, (_, c) in first.items()], "_word string, _class string")
    name, cls = F.col(item), F.col("_class")
    low = F.lower(name)
    alcohol = low.contains("알코올") | low.contains("alcohol")
    pork = name.contains("돼지") | low.contains("pork")
    halal = F.when(cls == "forbidden", "No").when(cls == "animal", "Questionable").when(cls == "ambiguous", "Unknown").otherwise("Yes")
    vegan = (
        F.when(cls == "forbidden", F.when(alcohol, "Yes").when(pork, "No").otherwise("Unknown"))
        .when(cls == "animal", "No")
        .when(cls == "ambiguous", "Unknown")
        .otherwise("Yes")
    )
    warning = (
        F.when(cls == "forbidden", lex.WARN_FORBIDDEN)
        .when(cls == "animal", lex.WARN_ANIMAL)
        .when(cls == "ambiguous", lex.WARN_AMBIGUOUS)
        .when(cls == "safe", "")
        .otherwise(lex.WARN_UNKNOWN)
    )
    return rows.join(F.broadcast(table), name == F.col("_word"), "left").select(
        *rows.columns,
        halal.alias("can_halal"),
        vegan.alias("can_vegan"),
        warning.alias("warning"),
        F.when(cls == "forbidden", name).otherwise("").alias("not_halal"),
    )


def product_verdicts(judged: DataFrame, product: str = "product_id") -> DataFrame:
    """Worst ingredient verdict per product."""
    halal = F.when(F.col("can_halal") == "No", 3).when(F.col("can_halal") == "Questionable", 2).when(F.col("can_halal") == "Unknown", 1).otherwise(0)
    vegan = F.when(F.col("can_vegan") == "No", 3).when(F.col("can_vegan") == "Unknown", 1).otherwise(0)
    names = F.array(*[F.lit(x) for x in ("Yes", "Unknown", "Questionable", "No")])
    return (
        judged.groupBy(product)
        .agg(F.max(halal).alias("_h"), F.max(vegan).alias("_v"))
        .select(product, F.get(names, F.col("_h")).alias("can_halal"), F.get(names, F.col("_v")).alias("can_vegan"))
    )


def issues(judged: DataFrame, product: str = "product_id", item: str = "ingredient") -> DataFrame:
    """Offending ingredients, one row each, so that a product of any size stays spread out."""
    vegan = F.when(F.col("can_vegan") == "No", "동물성").when(F.col("can_vegan") == "Questionable", "의심")
    halal = F.when(F.col("can_halal") == "No", "부적합").when(F.col("can_halal") == "Questionable", "원료확인필요")
    found = F.array_compact(
        F.array(
            F.when(vegan.isNotNull(), F.struct(F.lit("vegan").alias("check"), vegan.alias("issue"))),
            F.when(halal.isNotNull(), F.struct(F.lit("halal").alias("check"), halal.alias("issue"))),
        )
    )
    return judged.select(product, item, F.explode(found).alias("_i")).select(product, item, "_i.*").distinct()


def issue_summary(judged: DataFrame, product: str = "product_id") -> DataFrame:
    """Pass or fail per product and check, with the number of offending rows."""
    bad_vegan = F.col("can_vegan").isin("No", "Questionable")
    per = judged.groupBy(product).agg(
        F.count_if(bad_vegan).alias("n_vegan_issues"),
        F.count_if(F.col("can_halal").isin("No", "Questionable")).alias("n_halal_issues"),
        F.count_if(F.col("can_halal") == "No").alias("_bad"),
    )
    is_vegan, is_halal = F.col("n_vegan_issues") == 0, F.col("_bad") == 0
    text = F.concat(
        F.lit("비건: "), F.when(is_vegan, "적합").otherwise("부적합"), F.lit(", 할랄: "), F.when(is_halal, "적합").otherwise("부적합 또는 의심")
    )
    return per.withColumns({"is_vegan": is_vegan, "is_halal": is_halal, "summary": text}).drop("_bad")


GRAMS = (1, 2, 4, 8)


def certified(products: DataFrame, certificates: DataFrame, name: str = "name", cert_name: str = "cert_name", order: str = "cert_id") -> DataFrame:
    """Products whose name contains, or is contained in, a certificate's name (case ignored); first certificate.

    Containment is turned into an equi-join on grams of 8, 4, 2 or 1 letters, by the shorter name's length: the
    shorter name is probed by that of its grams which the fewest longer names hold, so a brand at the
    opening of every name brings no pairs. A gram that no longer name holds rules the name out. Works on
    distinct names.
    """
    p = products.select(F.lower(name).alias("_p")).where(F.trim("_p") != "").distinct()
    c = certificates.select(F.lower(cert_name).alias("_c"), order).where(F.trim("_c") != "")
    c = c.groupBy("_c").agg(F.min(order).alias(order))

    def cut(text: str, g: int) -> Column:
        return F.expr(f"transform(sequence(1, greatest(1, length({text}) - {g - 1})), i -> substring({text}, i, {g}))")

    def all_grams(text: str) -> Column:
        return unnest(F.array_distinct(F.flatten(F.array(*[cut(text, g) for g in GRAMS]))), "_g")

    def own_grams(text: str) -> Column:
        out = F
        for g in reversed(GRAMS):
            out = out.when(F.length(text) >= g, cut(text, g))
        return unnest(F.array_distinct(out), "_g")

    def held(short: DataFrame, text: str, longer: DataFrame) -> DataFrame:
        """The shorter names with the longer names that hold their rarest gram."""
        frequency = longer.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
        counted = short.select(text, own_grams(text)).join(frequency, "_g", "left")
        rarest = counted.groupBy(text).agg(F.min(F.struct(F.coalesce("_n", F.lit(0).cast("long")).alias("n"), "_g")).alias("_r"))
        return rarest.where("_r.n > 0").select(text, F.col("_r._g").alias("_g")).join(longer, "_g")

    inside = held(p, "_p", c.select("_c", order, all_grams("_c"))).where(F.contains("_c", "_p"))
    around = held(c, "_c", p.select("_p", all_grams("_p"))).where(F.contains("_p", "_c")).join(c, "_c")
    hits = inside.select("_p", order).unionByName(around.select("_p", order)).groupBy("_p").agg(F.min(order).alias(order))
    return (
        products.join(hits, F.lower(name) == F.col("_p"), "left").drop("_p").withColumn("is_certified", F.col(order).isNotNull())
    )


def function_verdict(text: str | Column) -> tuple[Column, Column]:
    """(vegan, halal) read off an ingredient's described function."""
    t = F.lower(F.coalesce(col(text), F.lit("")))

    def has(words: Sequence[str]) -> Column:
        return t.rlike("|".join(re.escape(w) for w in words))

    vegan = F.when(has(lex.ANIMAL_FUNCTIONS), "No").when(has(lex.PLANT_FUNCTIONS), "Yes").otherwise("Unknown")
    halal = F.when(has([*lex.ALCOHOL_FUNCTIONS, *lex.PIG_FUNCTIONS]), "No").otherwise("Unknown")
    return vegan, halal


def distinct_ingredients(rows: DataFrame, item: str = "ingredient") -> DataFrame:
    return rows.select(item).where(F.col(item).isNotNull()).distinct()


def spelling_audit(rows: DataFrame, spellings: Mapping[str, str], item: str = "ingredient") -> DataFrame:
    """Rows per spelling pattern, English-first names among them."""
    checks = {"starts with a letter A-Z": "^[A-Za-z]", **spellings}
    aggs = [F.count_if(F.coalesce(F.col(item).rlike(p), F.lit(False))).alias(f"_c{i}") for i, p in enumerate(checks.values())]
    out = [F.struct(F.lit(n).alias("check"), F.col(f"_c{i}").alias("n_rows")) for i, n in enumerate(checks)]
    return rows.agg(*aggs).select(F.explode(F.array(*out)).alias("r")).select("r.*")


def separator_mode(text: str | Column, min_commas: int = 5) -> Column:
    """Space mode when there are fewer than five commas outside chemical numbers."""
    return F.when(F.regexp_count(col(text), F.lit(r",(?!\d-)")) < min_commas, "space").otherwise("comma")


def acceptance_threshold(source: str | Column) -> Column:
    s = col(source)
    return F.when(s.startswith("ALT") | F.upper(s).contains("CLOVA"), 0.75).otherwise(0.85)


def extract_by_mode(df: DataFrame, keys: Sequence[str], known: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """Items cut by the text's own separator, scored, and accepted by the source's threshold."""
    spaced = strip(F.regexp_replace("_text", r"(?i)\(\s*\d+\s*(ppm|ppb|%)\s*\)", ""))
    # both are columns of their own, as the cutting below names them many times
    read = df.select(*keys, source, (separator_mode(text) == "space").alias("_space"), F.col(text).alias("_text"))
    read = read.select(*keys, source, "_space", F.when(F.col("_space"), spaced).otherwise(repair_breaks("_text")).alias("_list"))
    items = F.when(F.col("_space"), F.split("_list", r"\s+")).otherwise(split_items("_list"))
    rows = read.select(*keys, source, F.posexplode_outer(items).alias("pos", "raw")).where(F.col("raw").isNotNull())
    # a name is worked out and judged where it is cut, so texts are cut once and rows are not sent to their names and
    # back; generators keep the tests below from working either out again
    marks = known.select(F.trim(known.columns[0]).alias("_known")).distinct()
    named = rows.select("*", unnest(F.array(normalise_name("raw", valid=True)), "ingredient")).join(marks, F.col("ingredient") == F.col("_known"), "left")
    judged = named.select(*rows.columns, "ingredient", unnest(F.array(validity_reason("ingredient", F.col("_known").isNotNull())), "reason"))
    taken = judged.where(F.col("reason").isin(*ACCEPTING))  # no threshold takes a refused name
    return taken.withColumn("confidence", reason_confidence("reason")).where(F.col("confidence") >= acceptance_threshold(source))


def mentions(text: str | Column, pairs: Mapping[str, Sequence[str]] | None = None) -> Column:
    """Certification names mentioned in a page text, joined by commas."""
    pairs = pairs or {"할랄": ["할랄", "halal"], "비건": ["비건", "vegan"]}
    t = F.lower(F.coalesce(col(text), F.lit("")))
    found = [F.when(t.rlike(any_of([re.escape(w) for w in words], "")), F.lit(n)) for n, words in pairs.items()]
    return F.array_join(F.array_compact(F.array(*found)), ", ")


def union_categories(parts: Sequence[DataFrame], order_by: Sequence[str]) -> DataFrame:
    """Category files under one roof, first row per (product, name, ingredient)."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return keep_first(out, ["product_id", "name", "ingredient"], order_by)
