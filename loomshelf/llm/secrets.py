"""Secret scan: fixed patterns, and credential-context values that would take many guesses.

How many guesses a value takes is the cheapest way to put it together from words, dates, repeats, keyboard
walks and brute-force characters, found by dynamic programming over its positions; spans of each kind may start
anywhere. Words are ranked by how often the corpus has them. A value that is cheap to guess is prose or a
placeholder; a costly one is likely a real secret.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from math import log10

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomshelf.llm.common import forget, settle, whole_text
from loomshelf.llm.spelling import word_counts

#: The base patterns and the least length of what they must find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run is matched whole, so a shorter one is one that fails
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "guess")

#: A name that announces a credential, a sign, and the value after it.
CONTEXT = re.compile(
    r"""(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|credentials?|auth(?:orization)?|bearer|(?:api|access|private|secret|account)[_-]?key)["']?[\x20\t]*(?:=>|:=|[:=])[\x20\t]*(?:(?:bearer|basic)\x20+)?["']?([^\s"'<>,;]+)""",
    re.IGNORECASE | re.ASCII,
)
#: What a text must hold, lower-cased, to be searched at all.
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"credential", b"auth", b"bearer", b"key")
_RUNS = bytes.maketrans(bytes(range(256)), bytes(1 if chr(i) in "0123456789abcdef" else 0 for i in range(256)))
_LONG_RUN = b"\x01" * 24

#: Common words of passwords and placeholders, the most common first.
COMMON = (
    "password passwd pass secret token key admin root user login welcome letmein changeme default example test testing"
    " demo sample guest public private master monkey dragon shadow sunshine princess football baseball iloveyou"
    " superman batman trustno hello whatever freedom access server client system service account database mysql"
    " postgres oracle redis docker spring summer autumn winter january february march april may june july august"
    " september october november december monday tuesday wednesday thursday friday saturday sunday love angel"
    " michael jordan jennifer thomas charlie daniel andrew qwerty abc your my the and for new old temp dummy none"
    " null true false value string enter insert here placeholder hidden redacted xxxx"
).split()
_ROWS = ("`1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./")
_LEET = str.maketrans("430157$@!", "aeolstsai")
_DAY, _MONTH, _YEAR = "(?:0[1-9]|[12][0-9]|3[01])", "(?:0[1-9]|1[0-2])", "(?:19|20)[0-9]{2}"
#: Dates: a year, a year with month and day, day and month with a year; what stands between the parts is the same.
_DATES = [re.compile(p) for p in (_YEAR, rf"{_YEAR}([-/._]?){_MONTH}\1{_DAY}", rf"{_DAY}([-/._]?){_MONTH}\1{_YEAR}")]
_DATE_COST = {4: log10(130), 8: log10(130 * 366), 10: log10(130 * 366 * 5)}
#: Longest block that a repeat is made of.
MAX_BLOCK = 16
#: Words of the corpus that are known, at most, and how often a word must occur.
CORPUS_WORDS, CORPUS_LEAST = 50_000, 5


_PLACE = {c: (x + y * 0.5, y) for y, row in enumerate(_ROWS) for x, c in enumerate(row)}


def _step(a: str, b: str) -> tuple[float, int] | None:
    """The way from a key to a neighbouring one; None if they are no neighbours."""
    if a == b or a not in _PLACE or b not in _PLACE:
        return None
    (x, y), (u, v) = _PLACE[a], _PLACE[b]
    return (u - x, v - y) if abs(u - x) <= 1 and abs(v - y) <= 1 else None


def _brute(c: str) -> float:
    return 1.0 if c.isdigit() else log10(26) if c.isalpha() else log10(33)


def word_cost(word: str, words: Mapping[str, int]) -> float | None:
    """Log10 of the guesses for a word in any case, or with figures for letters; None if it is not known."""
    low = word.lower()
    rank, leet = words.get(low), 0.0
    if rank is None:
        rank, leet = words.get(low.translate(_LEET)), log10(2)
    if rank is None:
        return None
    upper = sum(c.isupper() for c in word)
    case = 0.0 if not upper else log10(2) if upper in (1, len(word)) else upper * log10(2)
    return log10(rank + 1) + case + leet


def spans_from(value: str, words: Mapping[str, int], longest: int) -> list[list[tuple[int, float]]]:
    """By place: end and cost of every word, date, repeat and keyboard walk that starts there.

    A walk goes on as far as it can; a repeat has as many whole blocks as follow each other.
    """
    n, low = len(value), value.lower()
    out: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for i in range(n):
        for end in range(i + 3, min(n, i + longest) + 1):
            cost = word_cost(value[i:end], words)
            if cost is not None:
                out[i].append((end, cost))
        for pattern in _DATES:
            if m := pattern.match(value, i):
                out[i].append((m.end(), _DATE_COST[m.end() - i]))
    end, turns = n, [0] * (n + 1)  # how often the way turns from a place on to the end of its walk
    steps = [_step(low[i], low[i + 1]) for i in range(n - 1)]
    for i in range(n - 2, -1, -1):  # three keys or more: a start, and where the walk turns
        if steps[i] is None:
            end = i + 1
            continue
        turns[i] = turns[i + 1] + (steps[i + 1] != steps[i]) if i + 2 < end else 1
        if end - i >= 3:
            out[i].append((end, log10(47) + turns[i] * log10(4) + log10(end - i)))
    for size in range(1, min(MAX_BLOCK, n // 2) + 1):  # a block, and how often
        same = 0  # places from here on that equal the one a block further on
        for i in range(n - size - 1, -1, -1):
            same = same + 1 if value[i] == value[i + size] else 0
            times = same // size + 1
            if times >= 2 and times * size >= 3:
                block = value[i : i + size]
                cost = min(sum(map(_brute, block)), word_cost(block, words) or float("inf"))
                out[i].append((i + times * size, cost + log10(times)))
    return out


def guess_cost(value: str, words: Mapping[str, int], longest: int | None = None) -> float:
    """Log10 of the guesses for a value: the cheapest of all segmentations. Linear in its length.

    ``words`` maps a lower-case word to its rank, from 1; ``longest`` is the length of the longest of them. A
    hexadecimal value costs 16 guesses a character.
    """
    n = len(value)
    longest = max(map(len, words), default=0) if longest is None else longest
    hexadecimal = n >= 16 and all(c in "0123456789abcdefABCDEF" for c in value)
    spans = spans_from(value, words, longest)
    best = [0.0] + [float("inf")] * n
    for i in range(n):
        best[i + 1] = min(best[i + 1], best[i] + (log10(16) if hexadecimal else _brute(value[i])))
        for end, cost in spans[i]:
            best[end] = min(best[end], best[i] + cost)
    return best[n]


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = CORPUS_WORDS, least: int = CORPUS_LEAST) -> list[str]:
    """The words of three letters or more that all texts have most often, by count and word: ``most`` at most.

    Every text is counted whole. Counts fall into eight steps for each doubling; the list ends before the step with
    which it would pass ``most`` and never goes below ``least``, so no more than ``most`` words reach the driver from all
    tasks together. NULL and empty texts have no words, rows that repeat count each time, an empty table has none.
    """
    counts = settle(word_counts(docs, text_col, text_col, least_letters=3, least_count=least), "corpus-words")
    step = F.floor(F.log2("n") * 8)
    first, held = None, 0
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True):  # a few hundred rows at most
        held += r["count"]
        if held > most:
            break
        first = r["step"]
    found = counts.where(step >= first).select("n", "word").collect() if first is not None else []
    forget(counts)
    return [r["word"] for r in sorted(found, key=lambda r: (-r["n"], r["word"]))]


def ranks(words: list[str]) -> dict[str, int]:
    """Rank of each word, the common words of passwords before all others."""
    return {w: i + 1 for i, w in enumerate(dict.fromkeys([*COMMON, *words]))}


def find_secrets(text: str, words: Mapping[str, int], least: float, longest: int | None = None) -> list[tuple[str, int, int, float]]:
    """Spans of one text by start and kind: kind, start, end (code points), log10 guesses (NaN for base spans)."""
    raw = text.encode("utf-8", "surrogatepass")
    nan = float("nan")
    spans = []
    low = raw.lower()
    if any(h in low for h in _HINTS):
        spans += [("assign", m.start(), m.end(), nan) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
        for m in CONTEXT.finditer(text):
            cost = guess_cost(m[1], words, longest)
            if cost >= least:
                spans.append(("guess", m.start(1), m.end(1), cost))
    if b"AKIA" in raw:
        spans += [("access", m.start(), m.end(), nan) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    if _LONG_RUN in raw.translate(_RUNS):
        spans += [("hex", m.start(), m.end(), nan) for m in HEX.finditer(text)]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def secret_spans(text: Column, words: Mapping[str, int] | None = None, least: float = 8.0) -> Column:
    """Array of ``kind``, ``start``, ``end``, ``guesses`` for a text column.

    Kinds ``assign``, ``access`` and ``hex`` are the fixed patterns; ``guess`` is a credential-context value
    that takes 10^``least`` guesses or more; ``words`` gives the rank of each known word (``ranks``). NULL and empty
    texts have no spans; a text, and a value in it, is read whole in time linear in its length.
    """
    known = dict(words) if words is not None else ranks([])
    longest = max(map(len, known), default=0)

    @F.pandas_udf("array<struct<kind: string, start: bigint, end: bigint, guesses: double>>")
    def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in texts:
            yield pd.Series(
                [[{"kind": k, "start": s, "end": e, "guesses": g} for k, s, e, g in find_secrets(t, known, least, longest)] for t in part], dtype=object
            )

    return run(F.coalesce(text.cast("string"), F.lit("")))


def scan_secrets(docs: DataFrame, text_col: str = "text", out_col: str = "spans", **options) -> DataFrame:
    """The documents with a column of secret spans (see ``secret_spans``), a row for each row.

    Spans that start together stand by kind. Rows that repeat have the same spans; an empty table stays empty. Other
    columns stay as they are, but one named ``out_col`` is replaced.
    """
    return docs.withColumn(out_col, secret_spans(whole_text(docs, text_col), **options))
