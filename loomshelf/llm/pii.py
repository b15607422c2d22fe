"""Personal data: patterns propose spans, check digits confirm them, and the words nearby adjust the score.

Base kinds (``email``, ``ip``, ``card``, ``phone``) are reported whenever their pattern and their check hold, whatever
the score. The other kinds are reported from a least score on: account numbers (``iban``, mod 97), social security
numbers and national phone numbers, which nothing confirms but the words around them, and card and phone numbers
inside a run of digits that fails as a whole.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.llm.common import whole_text

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "phone_local", "card_inner", "phone_inner")

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
# a run of digits is taken whole, so no start inside of it is tried
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}")
_SSN = re.compile(r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+().-])(?:\([0-9]{2,5}\)|[0-9]{2,5})(?:[\x20./-]?[0-9]{2,4}){2,4}(?![0-9-])")
_DIGITS = re.compile(r"[0-9]+")
_NOT_DIGITS = re.compile(r"[^0-9]+")

#: Characters of an account number by country (ISO 13616).
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24,
    "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IS": 26, "IT": 27, "LI": 21, "LT": 20,
    "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24, "SE": 24, "SI": 19,
    "SK": 24, "SM": 27, "TR": 26,
}

#: What a span scores by its pattern and check alone.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.7, "phone": 0.7, "iban": 0.8, "ssn": 0.3, "phone_local": 0.2, "card_inner": 0.5, "phone_inner": 0.5}
#: Words nearby that raise the score of a kind.
CONTEXT = {
    "email": "mail e-mail email contact courriel correo",
    "ip": "ip address host server login adresse dirección",
    "card": "card visa mastercard amex credit debit carte tarjeta karte kreditkarte",
    "phone": "phone tel telephone call mobile cell fax téléphone appelez portable teléfono móvil llame telefon handy anruf",
    "iban": "iban account bank konto compte cuenta banque banco",
    "ssn": "ssn social security",
}
CONTEXT |= {"phone_local": CONTEXT["phone"], "card_inner": CONTEXT["card"], "phone_inner": CONTEXT["phone"]}
#: Words nearby that lower the score of any kind.
AGAINST = "order invoice isbn version serial sku part item ticket page ref article commande factura pedido rechnung bestellung artikel"
RAISED, LOWERED = 0.35, 0.25
#: Code points before and after a span in which words are looked for.
BEFORE, AFTER = 40, 20
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def luhn(digits: str) -> bool:
    """The check of card numbers: every second digit from the right counts twice."""
    twice = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (twice + sum(map(int, digits[::-2]))) % 10 == 0


def mod97(account: str) -> bool:
    """The check of account numbers: the first four characters go last, letters count from 10."""
    turned = account[4:] + account[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _only_digits(text: str) -> str:
    return _NOT_DIGITS.sub("", text)


def _is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and luhn(digits)


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    end = 0
    for m in _DOMAIN.finditer(text):
        # what stands before the sign, back to the end of the address before
        start = end + len(text[end : m.start()].rstrip(_LOCAL))
        if start < m.start():
            end = m.end()
            yield "email", start, end


def _ips(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            yield "ip", m.start(), m.end()


def _cards(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        if _is_card(_only_digits(m[0])):
            yield "card", m.start(), m.end()
        else:
            for own in _DIGITS.finditer(text, m.start(), m.end()):
                if own.span() != m.span() and _is_card(own[0]):
                    yield "card_inner", own.start(), own.end()


def _phones(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_only_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()
            continue
        digits, last = 0, 0  # the first groups of a longer run, up to a blank after at least nine digits
        for own in _DIGITS.finditer(text, m.start(), m.end()):
            if digits >= 9 and " " in text[last : own.start()]:
                break
            digits, last = digits + len(own[0]), own.end()
            if digits > 15:
                break
        if 9 <= digits <= 15 and last < m.end():
            yield "phone_inner", m.start(), last


def _ibans(text: str) -> Iterator[tuple[str, int, int]]:
    for m in _IBAN.finditer(text):
        size = IBAN_LENGTH.get(m[0][:2])
        own = [k for k in range(m.start(), m.end()) if text[k] != " "]
        if size is None or len(own) < size:
            continue
        end = own[size - 1] + 1
        if not text[end : end + 1].isalnum() and mod97("".join(text[k] for k in own[:size])):
            yield "iban", m.start(), end


def _plain(kind: str, pattern: re.Pattern, least: int = 0, most: int = 99):
    def find(text: str) -> Iterator[tuple[str, int, int]]:
        for m in pattern.finditer(text):
            if least <= len(_only_digits(m[0])) <= most:
                yield kind, m.start(), m.end()

    return find


#: Each search, and a sign that a text must hold to be searched.
_SEARCHES = (
    ("@", _emails),
    (".", _ips),
    ("", _cards),
    ("+", _phones),
    ("", _ibans),
    ("-", _plain("ssn", _SSN)),
    ("", _plain("phone_local", _LOCAL_PHONE, 9, 12)),
)
_ANY_DIGIT = re.compile("[0-9]")
_CONTEXT_SETS = {k: frozenset(v.split()) for k, v in CONTEXT.items()}
_AGAINST_SET = frozenset(AGAINST.split())


def context_score(text: str, kind: str, start: int, end: int) -> float:
    """Score of a span: what its kind has, raised and lowered by whole words nearby."""
    near = {w.lower() for part in (text[max(0, start - BEFORE) : start], text[end : end + AFTER]) for w in _WORD.findall(part)}
    score = SCORE[kind] + RAISED * bool(near & _CONTEXT_SETS[kind]) - LOWERED * bool(near & _AGAINST_SET)
    return min(1.0, max(0.0, score))


def find_personal_data(text: str, least: float = 0.5) -> list[tuple[str, int, int, float]]:
    """Spans of a text by kind and start: kind, start, end (code points, end exclusive), score.

    Spans of the added kinds that overlap a base span are left out.
    """
    digits = _ANY_DIGIT.search(text) is not None
    found = [s for sign, search in _SEARCHES if sign in text and (digits or search is _emails) for s in search(text)]
    found.sort(key=lambda s: (KINDS.index(s[0]), s[1]))
    out, taken = [], []
    for kind, start, end in found:
        if kind in BASE:
            out.append((kind, start, end, context_score(text, kind, start, end)))
            taken.append((start, end))
    for kind, start, end in _apart([s for s in found if s[0] not in BASE], taken):
        score = context_score(text, kind, start, end)
        if score >= least:
            out.append((kind, start, end, score))
    return out


def _apart(spans: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """Spans that touch none of ``taken``."""
    taken = sorted(taken)
    ends, most = [], 0
    for _, end in taken:  # where the spans that begin up to here reach
        most = max(most, end)
        ends.append(most)
    begins = [s for s, _ in taken]
    out = []
    for kind, start, end in spans:
        k = bisect_right(begins, end - 1)
        if k == 0 or ends[k - 1] <= start:
            out.append((kind, start, end))
    return out


def personal_spans(text: Column, least: float = 0.5) -> Column:
    """Array of ``kind``, ``start``, ``end``, ``score`` for a text column; NULL and empty texts have none."""

    @F.pandas_udf("array<struct<kind: string, start: bigint, end: bigint, score: double>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series([[{"kind": k, "start": s, "end": e, "score": x} for k, s, e, x in find_personal_data(t, least)] for t in part], dtype=object)

    return run(F.coalesce(text.cast("string"), F.lit("")))


def scan_personal_data(docs: DataFrame, text_col: str = "text", out_col: str = "spans", least: float = 0.5) -> DataFrame:
    """The documents with a column of spans (see ``personal_spans``), a row for each row.

    NULL and empty texts have an empty array; a text is searched whole, however long, in time linear in its length;
    rows that repeat have the same spans; an empty table stays empty. Spans that start together stand by kind. Other
    columns stay as they are, but one named ``out_col`` is replaced.
    """
    return docs.withColumn(out_col, personal_spans(whole_text(docs, text_col), least))
