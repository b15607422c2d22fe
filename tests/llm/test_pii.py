"""Personal data against the patterns taken literally, and the checks against known numbers."""

import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F
from test_operators import AWKWARD, make

from loomshelf.llm import pii, queries

LITERAL = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def literal(text):
    """Kind, start and end of the base spans, by the contract's own words."""
    out = []
    for kind, pattern in LITERAL.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else False,
                "card": 13 <= len(digits) <= 19 and plain_luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


PIECES = [
    "a.b+c@mail.example.com", "@x.y", "x@y", "a@b.c@d.e-f.g", "_%@a.b.", "é@ü.de", "1.2.3.4", "01.002.0003.255", "256.1.1.1", "1.2.3.4.5.6.7.8", "1..2.3.4.5",
    "4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "4111111111111111 4111111111111111", "4 1 1 1", "7", "0000000000000000",
    "+1 (799) 555-3729", "+49.30 1234-567", "+1", "+1 2", "+12345678901234567890", "+1 (843) 555-7672 170.106.47.218", "++1 23456789", " ", "\n", ",", "-", ".", "+", "@", "𝒳", "tel",
]


def random_texts(n=3000):
    rng = random.Random(5)
    return ["".join(rng.choices(PIECES, k=rng.randint(0, 8))) for _ in range(n)] + ["".join(rng.choices("01.+@ -(a", k=40)) for _ in range(n)]


def test_base_spans_are_the_literal_ones():
    for text in random_texts():
        got = [s[:3] for s in pii.find_personal_data(text) if s[0] in pii.BASE]
        assert got == literal(text), text


def test_checks():
    rng = random.Random(1)
    for _ in range(300):
        digits = "".join(rng.choices("0123456789", k=rng.randint(13, 19)))
        assert pii.luhn(digits) == plain_luhn(digits)
    assert pii.mod97("GB82WEST12345698765432") and pii.mod97("DE89370400440532013000") and not pii.mod97("DE88370400440532013000")


@pytest.mark.parametrize(
    ("text", "spans"),
    [
        ("pay to GB82 WEST 1234 5698 7654 32 THANKS", [("iban", 7, 34)]),
        ("pay to GB82 WEST 1234 5698 7654 33", []),
        ("his SSN is 123-45-6789", [("ssn", 11, 22)]),
        ("model 123-45-6789", []),
        ("call (030) 123 45 67 now", [("phone_local", 5, 20)]),
        ("order (030) 123 45 67", []),
        ("4111111111111111 4111111111111111", [("card_inner", 0, 16), ("card_inner", 17, 33)]),
        ("+1 (843) 555-7672 170.106.47.218", [("ip", 18, 32), ("phone_inner", 0, 17)]),
    ],
)
def test_added_spans(text, spans):
    assert [s[:3] for s in pii.find_personal_data(text)] == spans


def test_words_nearby_adjust_the_score():
    score = lambda text: pii.find_personal_data(text)[0][3]
    assert score("invoice 4111111111111111") < score("see 4111111111111111") < score("visa card 4111111111111111")


def test_awkward_rows_keep_their_columns(spark):
    rows = [*AWKWARD, (30, "a@b.de " * 3000), (31, "x" * 200_000 + "@a.b"), (32, "1" * 200_000), (33, "+1" + "." * 100_000)]
    docs = make(spark, rows)
    got = pii.scan_personal_data(docs, out_col="found")
    assert got.columns == [*docs.columns, "found"]
    key = lambda r: (str(r[0]), r[1] or "")
    told = sorted(((r.doc_id, r.text, [(s["kind"], s["start"], s["end"]) for s in r.found if s["kind"] in pii.BASE]) for r in got.select("doc_id", "text", "found").collect()), key=key)
    assert told == sorted(((i, t, literal(t or "") if len(t or "") < 100_000 or "@" in t[-9:] else []) for i, t in rows), key=key)
    assert pii.scan_personal_data(docs.where("doc_id < 0")).collect() == []


def test_linear_in_the_length():
    start = time.process_time()
    for text in ("a" * 10**6, "1" * 10**6, "1." * 10**6, "+1 " * 10**6, "a@" * 10**6, "1 " * 10**6):
        pii.find_personal_data(text)
    assert time.process_time() - start < 60


def test_the_query_against_the_literal_patterns(spark, sf):
    got = {r.doc_id: r for r in queries.QUERIES["op12_pii"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).collect()
    assert len(got) == len(docs)
    for d in docs:
        spans, r = literal(d.text), got[d.doc_id]
        assert [r[f"n_{k}"] for k in pii.BASE] == [sum(s[0] == k for s in spans) for k in pii.BASE]
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for k, s, e in spans).encode()).hexdigest()
        assert {f"{k}:{s}:{e}" for k, s, e in spans} <= set(r.spans.split(",")) or not spans
