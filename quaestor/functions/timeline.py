"""Dated events in texts: patterns in order of precedence, with the sentence and the names around each."""

from __future__ import annotations

import datetime
import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quaestor.functions import lexicons as L

# for texts as ``folded`` gives them: without a flag for case, ``re`` looks for first letters at once
_DATES = [(re.compile(p.lower()), precision, confidence) for p, precision, confidence in L.DATES]
_RELATIVE = [re.compile(p.lower()) for p in L.RELATIVE_DATES]
_DIGITS = re.compile(r"\d+")
#: One of these is in every relative date.
_RELATIVE_WORDS = ("day", "week", "month", "year", "evening", "morning", "afternoon", "night", "shortly", "soon", "immediately")
_MONTH = {m: k for k, m in enumerate(("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"), 1)}
_END = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(])|\n{2,}")
#: Fixed value: words whose full stop ends no sentence.
_ABBREVIATIONS = ("mr", "mrs", "ms", "dr", "prof", "sr", "jr", "st", "vs", "inc", "ltd", "corp", "co", "no", "gov", "gen", "sen", "rep", "u.s", "e.g", "i.e", "etc")
SCHEMA = "document_id long, event_date string, date_raw string, precision string, confidence double, context string, is_resolved boolean, source_start int, source_end int, names array<string>"


def folded(text: str) -> str:
    """A text in lower case, character by character, with those that ``re.I`` takes for an ASCII letter as that letter."""
    if not text.isascii():
        for c, letter in ("\u0130i", "\u0131i", "\u017fs", "\u212ak"):
            text = text.replace(c, letter)
    return text.lower()


def _words_back(text: str, at: int, words: int, floor: int) -> int:
    """Where the word that ends at or holds ``at`` begins, or one so many words before it; ``floor`` if that is later."""
    for n in range(words + 1):
        while at > floor and not text[at - 1].isspace():
            at -= 1
        while n < words and at > floor and text[at - 1].isspace():
            at -= 1
    return at


def _windows(text: str, marks: Iterable[tuple[int, int]], ahead: int) -> list[tuple[int, int]]:
    """Stretches of a text, in order and apart, around marks in order: from two words before the word of each to its end or, with ``ahead``, so far into the next word."""
    out: list[tuple[int, int]] = []
    for a, b in marks:
        floor = out[-1][1] if out else 0
        if a > floor:
            a = _words_back(text, a, 2, floor)
        if ahead:
            b = min(b + 1, len(text))  # a plural
            while b < len(text) and text[b].isspace():
                b += 1
            b = min(b + ahead, len(text))
        if out and a <= floor:
            out[-1] = out[-1][0], max(b, floor)
        else:
            out.append((a, b))
    return out


def _found(text: str, word: str) -> Iterator[tuple[int, int]]:
    at = text.find(word)
    while at >= 0:
        yield at, at + len(word)
        at = text.find(word, at + 1)


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of sentences; a full stop after an abbreviation or an initial ends none."""
    out, start = [], 0
    for m in _END.finditer(text):
        if m.start() > start and text[m.start() - 1] == ".":
            word = text[_words_back(text, m.start(), 0, start) : m.start()].lower().rstrip(".")
            if word in _ABBREVIATIONS or len(word) == 1 and word.isalpha():
                continue
        out.append((start, m.start()))
        start = m.end()
    if start < len(text):
        out.append((start, len(text)))
    return out


def iso_date(found: re.Match | str, precision: str, year_now: int = 2024) -> str | None:
    """ISO text of a matched date in its precision: yyyy-MM-dd, yyyy-MM or yyyy; any four-digit year if the parts make no date."""
    raw = found if isinstance(found, str) else found.group()
    year = re.search(r"\d{4}", raw)
    word = next((w for w in re.findall(r"[a-z]+", raw.lower()) if w[:3] in _MONTH and (w[:3] != "mar" or w in ("mar", "march"))), None)
    if precision == "season":
        season = next(s for s in L.SEASONS if s in raw.lower())
        return f"{year.group()}-{L.SEASONS[season]}"
    if precision in ("year", "approx"):
        return year.group() if year else None
    if precision == "month":
        return f"{year.group()}-{_MONTH[word[:3]]:02d}"
    numbers = [int(n) for n in re.findall(r"\d+", raw)]
    if word:
        day, full = numbers[0], numbers[-1]
        parts = (full, _MONTH[word[:3]], day)
    elif re.match(r"\d{4}-", raw):
        parts = (numbers[0], numbers[1], numbers[2])
    else:
        month, day, full = numbers
        if full < 100:
            century = year_now // 100 * 100
            full = min((full + c for c in (century - 100, century, century + 100)), key=lambda y: (abs(y - year_now) >= 50, abs(y - year_now)))
        parts = (full, day, month) if month > 12 else (full, month, day)
    try:
        return datetime.date(*parts).isoformat()
    except ValueError:
        return year.group() if year else None


def dates(text: str, year_now: int = 2024) -> list[tuple[int, int, str | None, str, float]]:
    """(start, end, iso, precision, confidence) in order of place; the first pattern to claim a stretch keeps it."""
    taken: list[tuple[int, int]] = []  # in order, none touches another
    out = []

    def claimed(a: int, b: int) -> bool:
        k = bisect_right(taken, (a, b))
        if k and taken[k - 1][1] > a or k < len(taken) and taken[k][0] < b:
            return False
        taken.insert(k, (a, b))
        return True

    # each date ends in digits and each relative one has one of a few words, so patterns are tried around those only
    low = folded(text)
    windows = _windows(low, (m.span() for m in _DIGITS.finditer(low)), 0)
    for pattern, precision, confidence in _DATES if windows else ():
        for window in windows:
            for m in pattern.finditer(low, *window):
                if claimed(*m.span()):
                    out.append((*m.span(), iso_date(m, precision, year_now), precision, confidence))
    windows = _windows(low, sorted(x for word in _RELATIVE_WORDS for x in _found(low, word)), 12)
    for pattern in _RELATIVE if windows else ():
        for window in windows:
            for m in pattern.finditer(low, *window):
                if claimed(*m.span()):
                    out.append((*m.span(), None, "relative", L.RELATIVE_CONFIDENCE))
    return sorted(out)


def extract_events(documents: DataFrame, names: DataFrame | None = None, *, doc_id: str = "id", text: str = "text", year_now: int = 2024) -> DataFrame:
    """One row per date found (``SCHEMA``); ``names`` (document_id, name) are those looked for in the sentence of each."""
    rows = documents.select(F.col(doc_id).alias("document_id"), F.col(text).alias("body"))
    if names is not None:
        own = names.groupBy("document_id").agg(F.array_sort(F.collect_set("name")).alias("known"))
        rows = rows.join(own, "document_id", "left")
    else:
        rows = rows.withColumn("known", F.lit(None).cast("array<string>"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for frame in frames:
            out, held = [], 0
            for doc, body, known in zip(frame["document_id"], frame["body"], frame["known"]):
                body = body or ""
                found = dates(body, year_now)
                spans = sentences(body) if found else []
                starts = [a for a, _ in spans]
                looked = [(n, n.lower()) for n in (known if found and known is not None else []) if n]
                last, context, near = None, "", []
                for a, b, iso, precision, confidence in found:
                    k = bisect_right(starts, a) - 1
                    if k != last:  # dates of one sentence share it and its names
                        last, context = k, body[spans[k][0] : spans[k][1]].strip() if spans and k >= 0 else ""
                        low = context.lower()
                        near = [n for n, own in looked if own in low]
                    out.append((doc, iso, body[a:b], precision, confidence, context, iso is not None, a, b, near))
                    held += len(context)
                    if held > 4_000_000:
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
            if out:
                yield pd.DataFrame(out, columns=columns)

    return rows.select("document_id", "body", "known").mapInPandas(run, SCHEMA)
