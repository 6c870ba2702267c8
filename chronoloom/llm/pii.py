"""Personal data, also where it is disguised, at offsets of the source text.

Plain identifiers (e-mail, IPv4 address, payment card, phone) are found in the
text as it is. Disguised ones are found by a chain of transducers: each rewrites
a text and keeps, for every character it writes, the span of source characters
it came from:

1. look-alikes: full-width and foreign digits and letters become ASCII, and
   invisible characters vanish;
2. spelled digits: "five five oh" becomes "550", "plus one" becomes "+1";
3. at and dot: "[at]", "(dot)" and the bare words inside an address become "@"
   and ".".

The same detectors then run on the rewritten text, and what they find is mapped
back through the spans. Finds that equal a plain one are not repeated. Every text
goes through all transducers; one that replaces nothing costs its scan alone.

A bare "x at host.tld" is also plain prose ("look at example.com"). It counts as
an address only where x is no mere word: it has a letter, and a digit or one of
"._+%" too.

All detectors take linear time: no pattern is tried again over the same run of
characters, however long.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, small, strings

KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
Span = tuple[int, int, int]  # start, kind, end


def emails(text: str) -> Iterator[Span]:
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            yield start, 0, host.end()
            done = host.end()
        at = text.find("@", max(at + 1, done))


def addresses(text: str) -> Iterator[Span]:
    for m in DOTTED.finditer(text):
        parts = m[0].split(".")
        start = m.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            end = start + len(".".join(four))
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in four):
                yield start, 1, end
            start = end + 1


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def cards(text: str) -> Iterator[Span]:
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _digits(m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                yield m.start(), 2, m.end()


def phones(text: str) -> Iterator[Span]:
    for m in PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            yield m.start(), 3, m.end()


def detect(text: str) -> list[Span]:
    """Plain identifiers: leftmost, without overlap within a kind; sorted by start and kind."""
    found: list[Span] = []
    if "@" in text:
        found.extend(emails(text))
    found.extend(addresses(text))
    found.extend(cards(text))
    if "+" in text:
        found.extend(phones(text))
    return sorted(found)


class Tape:
    """A rewritten text that can tell, for each of its characters, the source characters it stands for.

    Only the replacements are held, each with its place and length here and its
    span in the tape below; places are looked up when something is found.
    """

    def __init__(self, text: str, below: Tape | None = None, at: list[int] | None = None, size: list[int] | None = None, span: list[tuple[int, int]] | None = None):
        self.text, self.below = text, below
        self.at, self.size, self.span = at or [], size or [], span or []

    def rewrite(self, pattern: re.Pattern, to: Callable[[re.Match], str | None]) -> Tape:
        """Replace matches; a replacement spans all that it replaces. None leaves a match as it is."""
        out: list[str] = []
        at: list[int] = []
        size: list[int] = []
        span: list[tuple[int, int]] = []
        done = length = 0
        for m in pattern.finditer(self.text):
            new = to(m)
            if new is None:
                continue
            a, b = m.span()
            out += [self.text[done:a], new]
            length += a - done
            at.append(length)
            size.append(len(new))
            span.append((a, b))
            length += len(new)
            done = b
        if not span:
            return self
        out.append(self.text[done:])
        return Tape("".join(out), self, at, size, span)

    def source(self, a: int, b: int) -> tuple[int, int]:
        """The source span of the characters from a up to b, b not included."""
        tape = self
        while tape.below is not None:
            a, b = tape._under(a)[0], tape._under(b - 1)[1]
            tape = tape.below
        return a, b

    def _under(self, k: int) -> tuple[int, int]:
        """The span of one character in the tape below."""
        i = bisect_right(self.at, k) - 1
        if i < 0:
            return k, k + 1
        over = k - self.at[i] - self.size[i]
        return self.span[i] if over < 0 else (self.span[i][1] + over, self.span[i][1] + over + 1)


# Letters of other scripts that look like the Latin letters below them.
LOOKALIKES = dict(zip(
    "аеорсухіјѕԁһԛԝАВЕКМНОРСТХІЈЅαορνικυΑΒΕΖΗΙΚΜΝΟΡΤΥΧ",
    "aeopcyxijsdhqwABEKMHOPCTXIJSaopvikuABEZHIKMNOPTYX",
))
# Characters without width.
INVISIBLE = "­​‌‍‎‏⁠﻿"
# Words for the digits in English, German, French and Spanish.
DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "un": "1", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
TIMES = {"double": 2, "triple": 3}

_digit = "|".join(sorted(DIGITS, key=len, reverse=True))
_item = rf"(?:(?:double|triple)[ -]+)?(?:{_digit}|[0-9]+)"
SPELLED = re.compile(rf"(?i)\b(?:(plus)[ -]+)?{_item}(?:[ ,-]+{_item})*\b")
HIDDEN = re.compile(f"[{INVISIBLE}]+")
WORD = re.compile(r"(?i)[^\W\d_]+|[0-9]+")
ODD = re.compile("[" + "".join(LOOKALIKES) + INVISIBLE + "٠-٩۰-۹०-९！-～‐-―․﹒﹫。]")
AT = re.compile(r"(?i)(?<![ ])[ ]*[\[({<][ ]*(?:at|arroba|@)[ ]*[\])}>][ ]*|(?<=[a-z0-9])[ ]+(?:at|arroba)[ ]+(?=[a-z0-9-]+(?:[ ]*[\[({<][ ]*(?:dot|punkt|point|punto|\.)|[ ]+(?:dot|punkt|punto)[ ]|\.[a-z]))")
DOT = re.compile(r"(?i)(?<![ ])[ ]*[\[({<][ ]*(?:dot|punkt|point|punto|\.)[ ]*[\])}>][ ]*|(?<=[a-z0-9])[ ]+(?:dot|punkt|punto)[ ]+(?=[a-z0-9])")


def _plain_char(m: re.Match) -> str | None:
    c = m[0]
    if c in INVISIBLE:
        return ""
    if c in LOOKALIKES:
        return LOOKALIKES[c]
    if "‐" <= c <= "―":
        return "-"
    if c == "。":
        return "."
    d = unicodedata.decimal(c, None)
    return str(d) if d is not None else unicodedata.normalize("NFKC", c)


def _plain_digits(m: re.Match) -> str | None:
    words = [w.lower() for w in WORD.findall(m[0])]
    if not any(w in DIGITS for w in words):
        return None
    out, times = ["+"] if words[0] == "plus" else [], 1
    for w in words:
        if w in TIMES:
            times = TIMES[w]
        elif w != "plus":
            out.append(DIGITS.get(w, w) * times)
            times = 1
    return "".join(out)


def _at(m: re.Match) -> str | None:
    """"@"; of the bare word before a plain host only where the word before it is no mere word."""
    text, end = m.string, m.start()
    if any(c in "[({<" for c in m[0]) or not HOST.match(text, m.end()):
        return "@"
    start = end
    while start and text[start - 1] in LOCAL:
        start -= 1
    word = text[start:end]
    return "@" if any(c.isalpha() for c in word) and any(c.isdigit() or c in "._+%" for c in word) else None


def rewritten(text: str) -> Tape:
    """The text with its disguises undone."""
    tape = Tape(text)
    if not text.isascii():
        tape = tape.rewrite(HIDDEN, lambda m: "").rewrite(ODD, _plain_char)
    tape = tape.rewrite(SPELLED, _plain_digits)
    return tape.rewrite(AT, _at).rewrite(DOT, lambda m: ".")


def disguised(text: str, plain: list[Span]) -> list[Span]:
    """Spans of the source text that hold an identifier only after rewriting."""
    tape = rewritten(text)
    if tape.below is None:
        return []
    known = set(plain)
    found = set()
    for a, kind, b in detect(tape.text):
        start, end = tape.source(a, b)
        found.add((start, kind, end))
    return sorted(found - known)


def written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[Span]) -> str:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    out, done = [], 0
    for a, k, b in sorted(spans, key=lambda s: (s[0], -s[2], s[1])):
        if a >= done:
            out += [text[done:a], f"[{KINDS[k].upper()}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: counts of plain identifiers, the digest of their spans, and all spans.

    Spans are in code points, the end exclusive. ``n_disguised`` counts the spans
    that the transducers add. A null or empty text has none. Repeated rows each
    give a row, other columns are ignored, an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        for batch in small(batches):
            counts: list[list[int]] = [[], [], [], []]
            sha, spans, more = [], [], []
            for t in strings(batch.column(1)):
                base = detect(t)
                extra = disguised(t, base)
                for k in range(4):
                    counts[k].append(sum(s[1] == k for s in base))
                sha.append(hashlib.sha256(written(base).encode()).hexdigest())
                spans.append(written(sorted(base + extra) if extra else base))
                more.append(len(extra))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(more, pa.int64())],
                names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_disguised"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_disguised long")


def redacted(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with identifiers, plain or disguised, replaced by their kind; other columns stay as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        claim("pii")
        for batch in small(batches):
            k = batch.schema.get_field_index(text)
            out = []
            for t in batch.column(k).to_pylist():
                if t:
                    base = detect(t)
                    spans = base + disguised(t, base)
                    t = redact(t, spans) if spans else t
                out.append(t)
            columns = list(batch.columns)
            columns[k] = pa.array(out, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
