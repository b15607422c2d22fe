"""Registered ingredient queries that SQL cannot say, against plain versions of every step over the whole tables."""

import unicodedata
from collections import Counter

import pytest
import regex

from loomshelf import catalog
from loomshelf.functions import ingredient_lexicon as lex

BLANK = " \t\n\r\f\x0b"


def sub(pattern, to, text, unicode=False):
    return regex.sub(pattern, to, text, flags=0 if unicode else regex.A)


def hit(pattern, text):
    return regex.search(pattern, text, flags=regex.A) is not None


def replaced(text, pairs):
    for old, new in pairs.items():
        text = text.replace(old, new)
    return text


def plain_items(text):
    for heading in lex.KIT_HEADINGS:
        if hit(heading, text):
            text = sub(heading, r",\1,", text)
            break
    kept = sub(r"(\d),(\d)", "\\1\x01\\2", text)
    out = []
    for part in regex.split("[,，;；\n]", kept):
        part = part.strip(BLANK).replace("\x01", ",")
        out += regex.split(r"(?<=[가-힣])\s{2,}(?=[가-힣])", part, flags=regex.A) if len(part) > 50 else [part]
    return [p.strip(BLANK) for p in out if p.strip(BLANK)]


def plain_name(n):
    for p in lex.NAME_PREFIXES:
        n = sub("^" + regex.escape(p), "", n)
    n = sub("|".join(regex.escape(p) for p in lex.EMBEDDED_PHRASES), "", n)
    for p in lex.ENGLISH_PREFIXES:
        n = sub("^" + p + "(?=[가-힣])", "", n)
    for p in lex.KOREAN_PREFIXES:
        n = sub("^" + p + "(?=.{3})", "", n)
    n = replaced(sub(r"\s+", "", n), lex.MISREADINGS)
    n = sub("[±·�]", "", n)
    n = sub(r"^(?!\d,\d-)[0-9=|!@#$%^&*<>]+", "", n)
    units = "ppb|ppm|%|mg/kg|µg/kg|mg/L|µg/L|g/L|w/w|w/v|v/v|mg|g|ml|L|kg"
    n = sub(rf"(?i)\(\s*[\d,\.]+\s*({units})?\s*\)", "", n)
    n = sub(r"\((?!(?:(?i:CI)\s*\d+\)|C\d+|\d+-\d+))[^)]*\)", "", n)
    n = sub(r"\[[^\]]*\]", "", n)
    n = sub("[*★☆※]", "", n)
    n = sub(r"^[^\w()]+|[^\w()]+$", "", n, unicode=True)
    return replaced(n, lex.LATE_SPELLINGS).strip(BLANK)


def plain_reason(t, known):
    def either(patterns):
        return "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"

    noise_word = t in lex.ENGLISH_NOISE
    rules = [
        ("too_short", lambda: len(t) < 2),
        ("known_ingredient", lambda: known),
        ("pure_number", lambda: hit(lex.PURE_NUMBER, t)),
        ("dimension", lambda: hit(lex.DIMENSION, t)),
        ("product_description", lambda: hit(lex.DESCRIPTION, t)),
        ("invalid_2char", lambda: t in lex.BAD_TWO_LETTER),
        ("verb_ending", lambda: hit(lex.VERB_ENDING, t) and not hit("(?:" + "|".join(lex.ENDING_EXCEPTIONS) + ")$", t)),
        ("pattern_match", lambda: hit(either(lex.CHEMICAL_PATTERNS), t)),
        ("ci_colorant", lambda: hit(lex.COLORANT, t)),
        ("peg_ppg", lambda: hit(lex.PEG_PPG, t)),
        ("ethoxylate", lambda: hit(lex.ETHOXYLATE, t)),
        ("ethoxylate_extended", lambda: hit(lex.ETHOXYLATE_EXTENDED, t)),
        ("enzyme", lambda: hit(lex.ENZYME, t)),
        ("amino_acid_salt", lambda: hit(lex.AMINO_ACID_SALT, t)),
        ("plant_derived", lambda: hit(lex.PLANT_DERIVED, t)),
        ("glucoside", lambda: hit(lex.GLUCOSIDE, t)),
        ("cellulose_derivative", lambda: hit(lex.CELLULOSE, t) and len(t) >= 6),
        ("english_chemical", lambda: not noise_word and hit(lex.ENGLISH_CHEMICAL, t)),
        ("alphanumeric_compound", lambda: not noise_word and hit(lex.MIXED, t) and len(t) >= 4 and not hit(lex.NOT_COMPOUND, t)),
        ("korean_chemical", lambda: hit("^(?:" + "|".join(lex.CHEMICAL_PREFIXES) + ")|(?:" + "|".join(lex.CHEMICAL_SUFFIXES) + ")$", t)),
        ("noise", lambda: hit(either(lex.NOISE_PATTERNS), t)),
        ("stopword", lambda: t in lex.NAME_STOP_WORDS),
        ("english_noise", lambda: hit(lex.SHORT_ENGLISH, t) and t not in lex.VALID_ENGLISH and not hit(lex.CHEMICAL_WORD, t)),
        ("contains_stopword", lambda: len(t) >= 12 and any(w in t for w in lex.NAME_STOP_WORDS if len(w) >= 4)),
    ]
    return next((name for name, applies in rules if applies()), "no_pattern_match")


def plain_breaks(t):
    t = sub(r"/\s*[\r\n]+\s*", "/", t)
    t = sub(r"-\s*[\r\n]+\s*(\d)", r"-\1", t)
    t = sub(r"([가-힣])\s*[\r\n]+\s*([가-힣])", r"\1\2", t)
    return sub(r"[\r\n]+", ", ", t)


def plain_section(text):
    found = [(text.find(w), -len(w)) for w in lex.START_WORDS if w in text]
    at = sum((min(found)[0], -min(found)[1])) if found else 0
    head, tail = text[:at], text[at:]
    depth = lambda s: sum(c in "(（" for c in s) - sum(c in ")）" for c in s)
    stops = [tail.find(w) for w in lex.END_WORDS if w in tail and depth(head) + depth(tail[: tail.find(w)]) <= 0]
    section = (tail[: min(stops)] if stops else tail).strip(BLANK)
    section = sub("^(?:" + "|".join(regex.escape(w) for w in lex.START_WORDS) + r")\s*", "", section)
    return sub(r"^[:：\-–—]+", "", section).strip(BLANK)


def plain_clean(item):
    t = item.strip(" \t\n\r·•-")
    t = sub(r"\[\s*\]", "", sub(r"\(\s*\)", "", t)).strip("\"'").strip(BLANK)
    t = sub(r"\([^)]*(?:식품의약품|심사|고시|기능성)[^)]*\)", "", t)
    t = sub("|".join(lex.FUNCTIONAL_PHRASES), "", t)
    t = sub(r"\(\s*\)", "", t).strip(" ,;:")
    return sub(r"^\([ ,;:(]*([^)]*)$", r"\1", sub(r"^([^(]*?)[ ,;:)]*\)$", r"\1", t))


def plain_is_item(t):
    if not 2 <= len(t) <= 100 or any(regex.match(p, t, flags=regex.A | regex.I) for p in lex.NOT_AN_ITEM):
        return False
    return hit(lex.HANGUL, t) or hit(lex.FORMULA, t)


def plain_parse(text):
    composed = unicodedata.normalize("NFC", plain_breaks(text))
    spaced = composed.translate({ord(c): " " for c in lex.SPACES} | {ord(c): None for c in lex.INVISIBLE})
    text = sub(r"\s+", " ", replaced(spaced, lex.MISREADINGS)).strip(BLANK)
    best = {}
    for pos, item in enumerate(plain_items(plain_section(text))):
        item = plain_clean(item)
        if not plain_is_item(item):
            continue
        key = replaced(sub(r"[\s-]+", "", item.lower()), {"애씨드": "애시드", "에씨드": "애시드"})
        first, longest = best.get(key, (pos, ""))
        best[key] = (first, item if len(item) > len(longest) else longest)
    out = []
    amount = r"\(([^)]*(?:ppm|ppb|%|mg|g|ml)[^)]*)\)"
    for pos, item in best.values():
        name = sub(r"(?i)(?s)^\s*(.*?)\s*" + amount + r"\s*(.*?)\s*$", r"\1\3", item)
        told = regex.search("(?i)" + amount, item, flags=regex.A)
        out.append((pos, sub(r"\s+", "", name), (told[1].strip(BLANK) or None) if told else None))
    return out


def plain_product_section(text, name):
    """Brands are not given."""
    if text is None:
        return None
    option = regex.search(r"\[(\d+)\s*[^\]]*\]", name, flags=regex.A)
    if option:
        own = regex.search(rf"(?s)\[{option[1]}\s+[^\]]*\]\s*(.*?)(?=\[\d+\s+|\Z)", text, flags=regex.A)
        if own and len(own[1].strip(BLANK)) > 20:
            return own[1].strip(BLANK)
    words = sub(r"\[\d+[^\]]*\]", "", name).strip(BLANK)
    words = regex.sub(r"(?i)\d+\s*(ml|g|mg|매|개입|P)\b", "", words)
    words = [w for w in regex.split(r"\s+", sub(r"\([^)]*\)", "", words).strip(BLANK), flags=regex.A) if len(w) >= 2 and w not in lex.GENERIC_WORDS][:3]
    lines = text.split("\n")
    low = [w.lower() for w in words]
    flat = [x.replace(" ", "").lower() for x in lines]
    at = next((i for i, x in enumerate(flat) if words and (all(w in x for w in low) or "".join(low) in x)), None)
    if at is not None:
        after = [x.strip(BLANK) for x in lines[at + 1 :]]
        stop = next((i for i, x in enumerate(after) if hit(lex.PRODUCT_HEADING, x) or (x == "" and i >= 1 and after[i - 1] == "")), len(after))
        section = sub(r"\n+$", "", "\n".join(after[:stop]))
        if len(section) > 20:
            return section
    return text


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def test_product_section(spark, sf, docs):
    got = {r.doc_id: r.text for r in catalog.QUERIES["ig4_product_section"](spark, sf).collect()}
    want = {d.doc_id: plain_product_section(d.text, " ".join((d.text or "").split(" ")[:2])) for d in docs}
    assert got == want and sum(want[d.doc_id] != d.text for d in docs) > 0


def test_product_section_by_option_and_heading(spark):
    from loomshelf.operators.ingredients import pick_product_section

    page = "[1 토너] 정제수, 글리세린, 부틸렌글라이콜, 판테놀\n[2 크림] 정제수, 스쿠알란, 세테아릴알코올, 시어버터\n\n수분 크림\n정제수, 스쿠알란, 세테아릴알코올, 시어버터\n\n\n다른 글"
    rows = [(i, page, n) for i, n in enumerate(["[2 크림] 수분", "수분 크림 50ml", "없는 이름", "[9 x] 수분크림", "크림 (대용량)"])]
    got = pick_product_section(spark.createDataFrame(rows, "doc_id int, text string, product_name string"), brands=[]).collect()
    assert {r.doc_id: r.text for r in got} == {i: plain_product_section(t, n) for i, t, n in rows}


def test_normalised_names(spark, sf, docs):
    got = {r.ingredient: r.normalised for r in catalog.QUERIES["ig10_normalise_names"](spark, sf).collect()}
    assert got == {n: plain_name(n) for d in docs for n in plain_items(d.text or "")}


def test_order_of_name_rules(spark):
    from pyspark.sql import functions as F

    from loomshelf.operators.ingredients import normalise_name

    parts = [*lex.NAME_PREFIXES[:4], *lex.EMBEDDED_PHRASES[:4], *list(lex.MISREADINGS)[:12], *lex.LATE_SPELLINGS, "CI 77891", "(CI 77891)", "(C6-14)", "(1.5%)", "[노트]", "*", "12=", "1,2-헥산다이올", "정제수", "·", " ", "(a(b)", "±", "µ"]
    import random

    rng = random.Random(3)
    names = sorted({"".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(600)})
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", normalise_name(F.col("n")).alias("x")).collect()
    assert {r.n: r.x for r in got} == {n: plain_name(n) for n in names}


def test_extraction_by_mode(spark, sf, docs):
    known = {w for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect() for w in regex.split(r"[^\p{L}]+", (r.text or "").lower()) if w}
    want = Counter()
    for d in docs:
        text = d.text or ""
        spaces = len(regex.findall(r",(?!\d-)", text.replace("\n", " "), flags=regex.A)) < 5
        cut = regex.split(r"\s+", sub(r"(?i)\(\s*\d+\s*(ppm|ppb|%)\s*\)", "", text).strip(BLANK), flags=regex.A) if spaces else plain_items(plain_breaks(text))
        source = d.source or ""
        least = 0.75 if source.startswith("ALT") or "CLOVA" in source.upper() else 0.85
        for pos, raw in enumerate(cut):
            name = plain_name(raw)
            reason = plain_reason(name, name in known)
            if d.text is not None and catalog.ingredients.ig.ACCEPTING.get(reason, 0.0) >= least:
                want[d.doc_id, pos, raw, name, reason] += 1
    got = Counter((r.doc_id, r.pos, r.raw, r.ingredient, r.reason) for r in catalog.QUERIES["ig25_extract_by_mode"](spark, sf).collect())
    assert got == want and sum(want.values()) > 100


def test_the_whole_parse(spark, sf, docs):
    got = Counter(tuple(r) for r in catalog.QUERIES["ig_parse_ingredients"](spark, sf).collect())
    want = Counter((d.doc_id, *row) for d in docs if d.text is not None for row in plain_parse("전성분: " + regex.sub(r"(\p{L}+)[^\p{L}]+", "\\1오일,\n", d.text)))
    assert got == want and sum(want.values()) > 1000
