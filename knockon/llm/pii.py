"""Personal data detection with offset-preserving deobfuscation.

Plain detectors find emails, IP addresses, payment cards and phone numbers in
the text as it is.  Transducers then rewrite disguises: look-alike and full-width
characters, invisible characters, spelled digits, and "at"/"dot" in brackets or
words.  Each rewritten character remembers the source span it came from, so what
the detectors find in the rewritten text is reported as a span of the source.
Such a span is added only where no plain span of its kind overlaps it.

Spans are in code points, end exclusive.  Defined results: null text counts as
empty and has no spans; ids may be null or repeated; extra columns are not read
by ``find`` and kept by ``mask``.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_NUMBER_ROW = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")

Span = tuple[int, int]


def emails(text: str) -> list[Span]:
    """Leftmost matches of local part, ``@`` and dotted domain: only an ``@`` can hold one."""
    found, end = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            end = domain.end()
            found.append((start, end))
        at = text.find("@", max(at + 1, end))
    return found


def ips(text: str) -> list[Span]:
    """Every four numbers of a row of numbers parted by dots, from its start on."""
    found = []
    for row in _NUMBER_ROW.finditer(text):
        numbers, start = row[0].split("."), row.start()
        for i in range(0, len(numbers) - 3, 4):
            four = numbers[i:i + 4]
            end = start + sum(map(len, four)) + 3
            if all(len(n.lstrip("0")) <= 3 and int(n[-4:]) <= 255 for n in four):
                found.append((start, end))
            start = end + 1
    return found


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def cards(text: str) -> list[Span]:
    return [m.span() for m in _CARD.finditer(text)
            if 16 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and luhn(digits)]


def phones(text: str) -> list[Span]:
    return [m.span() for m in _PHONE.finditer(text) if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]


DETECTORS = {"email": emails, "ip": ips, "card": cards, "phone": phones}

#: Cyrillic and Greek letters that look like a Latin letter.
LOOK_ALIKES = dict(zip("АВЕКМНОРСТХаеорсухіјѕԁԛԝΑΒΕΖΗΙΚΜΝΟΡΤΥΧαορν",
                       "ABEKMHOPCTXaeopcyxijsdqwABEZHIKMNOPTYXaopv", strict=True))
#: Characters that show nothing.
INVISIBLE = "­​‌‍⁠﻿"
#: Dashes and dots that stand for the ASCII ones.
MARKS = {"‐": "-", "‑": "-", "‒": "-", "–": "-", "−": "-", "。": ".",
         "․": ".", "·": ".", "﹒": "."}
#: Spelled digits by language.
SPELLED = {
    "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7",
    "eight": "8", "nine": "9", "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5",
    "sechs": "6", "sieben": "7", "acht": "8", "neun": "9", "zéro": "0", "deux": "2", "trois": "3",
    "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9", "cero": "0", "uno": "1", "dos": "2",
    "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
#: Words for the marks of addresses and numbers.
AT_WORDS, DOT_WORDS, PLUS_WORDS = "at|arroba|ät", "dot|punkt|point|punto", "plus|más"
#: Last parts of a host that a worded address may end in.
TOP_LEVEL = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|app|dev|de|fr|es|uk|eu|us|it|nl|ch|at|be|ca|au|br|mx"

_STRANGE = re.compile("[" + "".join(LOOK_ALIKES) + INVISIBLE + "".join(MARKS)
                      + "！-～٠-٩\U0001d400-\U0001d7ff]")
_DIGIT_WORD = "|".join(sorted(SPELLED, key=len, reverse=True))
_BRACKETED = re.compile(rf"[\[({{<]\s*(?:({AT_WORDS}|@)|({DOT_WORDS}|\.))\s*[\])}}>]\s*", re.I)
_ADDRESS = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+(?P<at>\s+at\s+|\s*_at_\s*|@)[A-Za-z0-9-]+"
                      rf"(?:(?:\s+dot\s+|\s*_dot_\s*|\.)[A-Za-z0-9-]+)*(?:\s+dot\s+|\s*_dot_\s*)(?:{TOP_LEVEL})\b", re.I)
_NUMBERS = re.compile(r"(?<![0-9.])[0-9]{1,3}(?:(?:\s+dot\s+|\s*_dot_\s*)[0-9]{1,3}){3}(?![0-9.])", re.I)
_DOT_WORD = re.compile(r"\s+dot\s+|\s*_dot_\s*", re.I)
_SPELLED_RUN = re.compile(rf"\b(?:(?:{PLUS_WORDS})\s+)?(?:{_DIGIT_WORD}|[0-9])"
                          rf"(?:[\s,./-]+(?:(?:{DOT_WORDS})\s+)?(?:{_DIGIT_WORD}|[0-9]))+\b", re.I)
_SPELLED_PART = re.compile(rf"(?P<plus>{PLUS_WORDS})\s+|(?P<dot>\s+(?:{DOT_WORDS})\s+)|(?P<digit>{_DIGIT_WORD}|[0-9])"
                           r"|(?P<gap>[\s,./-]+)", re.I)
#: Spelled digits in a run before it is rewritten.
LEAST_SPELLED = 4


class Tape:
    """Rewritten text with the source span of every character."""

    def __init__(self, text: str, starts=None, ends=None):
        self.text = text
        self.starts = range(len(text)) if starts is None else starts
        self.ends = range(1, len(text) + 1) if ends is None else ends

    def rewrite(self, edits: list[tuple[int, int, str]]) -> Tape:
        """Replace (start, end, new) ranges; each new character stands for its whole range."""
        if not edits:
            return self
        parts, starts, ends, at = [], [], [], 0
        for a, b, new in edits:
            parts.append(self.text[at:a] + new)
            starts.extend(self.starts[at:a])
            ends.extend(self.ends[at:a])
            starts.extend([self.starts[a]] * len(new))
            ends.extend([self.ends[b - 1]] * len(new))
            at = b
        parts.append(self.text[at:])
        starts.extend(self.starts[at:])
        ends.extend(self.ends[at:])
        return Tape("".join(parts), starts, ends)

    def source(self, span: Span) -> Span:
        return self.starts[span[0]], self.ends[span[1] - 1]


def plain_characters(tape: Tape) -> Tape:
    """Look-alikes, full-width and styled characters become ASCII; invisible ones vanish."""
    edits = []
    for m in _STRANGE.finditer(tape.text):
        own = m[0]
        new = "" if own in INVISIBLE else LOOK_ALIKES.get(own) or MARKS.get(own)
        if new is None:
            new = unicodedata.normalize("NFKC", own)
            new = str(unicodedata.digit(own)) if not new.isascii() and unicodedata.digit(own, None) is not None else new
        edits.append((*m.span(), new))
    return tape.rewrite(edits)


def digits_of_words(tape: Tape) -> Tape:
    """Runs of spelled digits become digits; "plus" and "dot" inside them become their marks."""
    edits = []
    for run in _SPELLED_RUN.finditer(tape.text):
        parts = list(_SPELLED_PART.finditer(tape.text, *run.span()))
        if sum(bool(p["digit"]) and not p["digit"].isdigit() for p in parts) < LEAST_SPELLED:
            continue
        for p in parts:
            new = ("+" if p["plus"] else "." if p["dot"] or (p["gap"] and "." in p["gap"]) else
                   "" if p["gap"] else SPELLED.get(p["digit"].lower(), p["digit"]))
            edits.append((*p.span(), new))
    return tape.rewrite(edits)


def marks_of_words(tape: Tape) -> Tape:
    """"at" and "dot" become their marks: in brackets, and as bare words inside a whole address."""
    edits, before = [], 0
    for m in _BRACKETED.finditer(tape.text):
        start = m.start()
        while start > before and tape.text[start - 1].isspace():
            start -= 1
        before = m.end()
        edits.append((start, before, "@" if m[1] else "."))
    tape = tape.rewrite(edits)
    edits = []
    for m in _ADDRESS.finditer(tape.text):
        edits.append((*m.span("at"), "@"))
        edits.extend((*dot.span(), ".") for dot in _DOT_WORD.finditer(tape.text, m.end("at"), m.end()))
    tape = tape.rewrite(edits)
    return tape.rewrite([(*dot.span(), ".") for m in _NUMBERS.finditer(tape.text)
                         for dot in _DOT_WORD.finditer(tape.text, *m.span())])


_HINT = re.compile(rf"[\[({{<_]\s*(?:{AT_WORDS}|{DOT_WORDS}|@|\.)\s*[\])}}>_]|\sdot\s", re.I)
_SPELLED_HINT = re.compile(rf"\b(?:{_DIGIT_WORD})[\s,./-]+(?:{_DIGIT_WORD}|[0-9])\b", re.I)


def deobfuscated(text: str) -> Tape:
    """The composed transducers; each runs only where its disguise shows."""
    tape = Tape(text)
    if not text.isascii() and _STRANGE.search(text):
        tape = plain_characters(tape)
    low = tape.text.lower()
    if _SPELLED_HINT.search(low):
        tape = digits_of_words(tape)
    if _HINT.search(low):
        tape = marks_of_words(tape)
    return tape


def base_spans(text: str) -> dict[str, list[Span]]:
    return {kind: find(text) for kind, find in DETECTORS.items()}


def added_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Source spans of what only the rewritten text shows."""
    tape = deobfuscated(text)
    added: dict[str, list[Span]] = {kind: [] for kind in KINDS}
    if tape.text == text:
        return added
    for kind, find in DETECTORS.items():
        taken = base[kind]
        for span in find(tape.text):
            a, b = tape.source(span)
            if not any(a < y and x < b for x, y in taken):
                added[kind].append((a, b))
    return added


def _pairs(spans: dict[str, list[Span]]) -> list[tuple[str, int, int]]:
    return [(kind, a, b) for kind in KINDS for a, b in sorted(spans[kind])]


SPANS = "base array<struct<kind:string,start:long,end:long>>, spans array<struct<kind:string,start:long,end:long>>"


def spans_column(text: Column) -> Column:
    """struct(base, spans): plain spans, and all spans, each by kind and start."""
    @F.pandas_udf(SPANS)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            base, every = [], []
            for text in texts:
                text = text or ""
                plain = base_spans(text)
                extra = added_spans(text, plain)
                base.append(_pairs(plain))
                every.append(_pairs({k: plain[k] + extra[k] for k in KINDS}))
            yield pd.DataFrame({"base": pd.Series(base, dtype=object), "spans": pd.Series(every, dtype=object)})
    return run(text)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, base, spans."""
    return (docs.select(F.col(id_col).alias("id"), spans_column(F.col(text_col)).alias("p"))
            .select("id", F.col("p.base").alias("base"), F.col("p.spans").alias("spans")))


def mask_spans(text: str, spans: list[tuple[str, int, int]]) -> str:
    """Each span replaced by its kind in angle brackets; of overlapping spans the first, longest counts."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2], s[0])):
        if a >= at:
            out.append(text[at:a] + f"<{kind}>")
            at = b
    return "".join(out) + text[at:]


def mask(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows with personal data replaced in ``text_col``; null stays null."""
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for text in texts:
                if text is not None:
                    plain = base_spans(text)
                    extra = added_spans(text, plain)
                    text = mask_spans(text, _pairs(plain) + _pairs(extra))
                out.append(text)
            yield pd.Series(out, dtype=object)
    return docs.withColumn(text_col, run(F.col(text_col)))
