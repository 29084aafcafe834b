r"""Personal data with offsets, under disguises.

A transducer rewrites a text character by character and keeps, for each character it writes, the span of source characters
it stands for: homoglyphs and fullwidth forms become ASCII, zero-width characters vanish, spelled digits become digits,
and " at " / "(dot)" disguises become @ and a full stop. The detectors run over the source text and over its rewritings, and every find
is mapped back to source characters. The plain detectors on the source give the base spans; finds in a rewriting that
meet no span of their kind are added. Nothing is taken away from the base.

Kinds: email, ip (four parts of at most 255), card (14 to 19 digits that pass Luhn), phone (+ and 10 to 15 digits).
Regular expressions are matched leftmost without overlaps, per kind; a match that fails its test is dropped and not
tried again from inside.

Defined results: null text is empty; offsets are code points of the whole text, end exclusive; repeated rows are handled
alike; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import table

KINDS = ("email", "ip", "card", "phone")
PATTERN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: The same matches, tried at the start of a run of digits only: a run of n digits costs n steps instead of n squared.
SEARCH = PATTERN | {"ip": re.compile("(?<![0-9])" + PATTERN["ip"].pattern)}
#: What must be in a text for a kind to match at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}
LONG_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9]){13}")
HOST = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")

_LOOKALIKE = dict(zip("аеорсухіјѕԁһӏԛԝАВЕКМНОРСТХІЈЅαοντυιρκΑΒΕΖΗΙΚΜΝΟΡΤΥΧıℓ", "aeopcyxijsdhlqwABEKMHOPCTXIJSaovtuipkABEZHIKMNOPTYXil", strict=True))
_LOOKALIKE |= {chr(0xFF01 + k): chr(0x21 + k) for k in range(94)}
_LOOKALIKE |= {chr(0x0660 + k): str(k) for k in range(10)} | {chr(0x06F0 + k): str(k) for k in range(10)} | {chr(0x0966 + k): str(k) for k in range(10)}
for _start in (0x1D7CE, 0x1D7D8, 0x1D7E2, 0x1D7EC, 0x1D7F6):
    _LOOKALIKE |= {chr(_start + k): str(k) for k in range(10)}
_LOOKALIKE |= dict.fromkeys("‐‑‒–—−", "-") | dict.fromkeys("。．․·", ".") | dict.fromkeys("    ", " ") | {"＠": "@", "﹫": "@", "＋": "+", "﹢": "+"}
_ZERO_WIDTH = "​‌‍⁠﻿­"
_GLYPH = re.compile("[" + "".join(map(re.escape, _LOOKALIKE)) + _ZERO_WIDTH + "]")

_DIGITS = {
    "zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9",
    "null": "0", "eins": "1", "zwei": "2", "drei": "3", "vier": "4", "fünf": "5", "sechs": "6", "sieben": "7", "acht": "8", "neun": "9",
    "zéro": "0", "deux": "2", "trois": "3", "quatre": "4", "cinq": "5", "sept": "7", "huit": "8", "neuf": "9",
    "cero": "0", "uno": "1", "dos": "2", "tres": "3", "cuatro": "4", "cinco": "5", "seis": "6", "siete": "7", "ocho": "8", "nueve": "9",
}
_SPELLED = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(_DIGITS, key=len, reverse=True)) + r")(?![^\W_])", re.IGNORECASE)
#: Spelled digits count in a run of at least seven digits and signs, one of them spelled or more, with marks between them.
_RUN = re.compile(rf"\+?(?:(?:{_SPELLED.pattern}|[0-9+()])[ .,()/-]*){{7,}}", re.IGNORECASE)
#: The word behind blanks alone counts where the whole has the shape of an address; the bracketed forms count anywhere.
_AT = r"\s*(?:[\[({<]\s*(?:at|arroba|@)\s*[\])}>]|\s(?:at|arroba)\s|\s+@\s*|\s*@\s+)\s*"
_DOT = r"\s*(?:[\[({<]\s*(?:dot|punkt|point|punto|\.)\s*[\])}>]|\s(?:dot|punkt|punto)\s)\s*"
_ADDRESS = re.compile(rf"(?<![A-Za-z0-9_%+-])[A-Za-z0-9_%+-]+(?:(?:\.|{_DOT})[A-Za-z0-9_%+-]+)*(?:@|{_AT})[A-Za-z0-9-]+(?:(?:\.|{_DOT})[A-Za-z0-9-]+)+", re.IGNORECASE)
#: Behind a bare word the host is dotted as it should be and ends in letters of one case.
_BARE_AT = re.compile(r"\s(?:[Aa][Tt]|[Aa][Rr][Rr][Oo][Bb][Aa])\s+[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.(?:[a-z]{2,24}|[A-Z]{2,24})(?![A-Za-z0-9-])")
_ADDRESS_HINT = re.compile(r"[\[({<]\s*(?:at|arroba|@|dot|punkt|point|punto|\.)\s*[\])}>]|\s(?:dot|punkt|punto)\s|\s@|@\s", re.IGNORECASE)
_DOTTED = re.compile(rf"[0-9]{{1,3}}(?:(?:\.|{_DOT})[0-9]{{1,3}}){{3}}(?![0-9])", re.IGNORECASE)
_DOT_WORD = re.compile(r"[\[({<]\s?(?:dot|punkt|point|punto|\.)\s?[\])}>]|(?<=\s)(?:dot|punkt|punto)(?=\s)", re.IGNORECASE)
_PART = r"(?:[0-9](?:[ -]{1,3}[0-9]){1,2}|[0-9]{1,3})"
#: Four parts, each in digits or in single digits with blanks between them, as spelled ones come out.
_SPACED_IP = re.compile(rf"(?<![0-9.]){_PART}(?:[ ]{{0,3}}\.[ ]{{0,3}}{_PART}){{3}}(?![0-9])")

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _holds(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(int(p) <= 255 for p in found.split("."))
    digits = "".join(c for c in found if c in "0123456789")
    if kind == "card":
        return 14 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 10 <= len(digits) <= 15
    return True


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What the email pattern matches, leftmost: from each @ to both sides, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        lo = at
        while lo > end and (text[lo - 1].isascii() and (text[lo - 1].isalnum() or text[lo - 1] in "._%+-")):
            lo -= 1
        host = HOST.match(text, at + 1) if lo < at else None
        if host:
            end = host.end()
            yield lo, end
            at = text.find("@", end)
        else:
            at = text.find("@", at + 1)


def detect(text: str) -> list[Span]:
    """The base spans of the text."""
    out: list[Span] = []
    for kind in KINDS:
        if NEEDS[kind] and NEEDS[kind] not in text:
            continue
        if kind == "email":
            out += [("email", a, b) for a, b in _emails(text)]
        elif kind != "card" or LONG_DIGITS.search(text):
            out += [(kind, m.start(), m.end()) for m in SEARCH[kind].finditer(text) if _holds(kind, m[0])]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


class Rewriting:
    """A text and, for each of its characters, the source characters [start, end) it stands for."""

    def __init__(self, text: str, start: list[int] | None = None, end: list[int] | None = None) -> None:
        self.text = text
        self.start = range(len(text)) if start is None else start
        self.end = range(1, len(text) + 1) if end is None else end

    def replace(self, edits: list[tuple[int, int, str]]) -> Rewriting:
        """Replaces [a, b) by a string, for ordered edits that don't overlap."""
        parts, start, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            parts.append(self.text[at:a]), start.extend(self.start[at:a]), end.extend(self.end[at:a])
            if b > a:
                parts.append(new), start.extend([self.start[a]] * len(new)), end.extend([self.end[b - 1]] * len(new))
            at = b
        return Rewriting("".join(parts), start, end)

    def back(self, a: int, b: int) -> tuple[int, int]:
        return self.start[a], self.end[b - 1]


def normalise(text: str) -> Rewriting:
    """Homoglyphs to ASCII, zero-width characters away."""
    edits = [(m.start(), m.end(), _LOOKALIKE.get(m[0], "")) for m in _GLYPH.finditer(text)]
    return Rewriting(text).replace(edits) if edits else Rewriting(text)


def spelled_digits(r: Rewriting) -> list[Span]:
    """Finds with spelled digits in them, in source characters: each run of spelled digits alone, in digits, as it is and with the
    marks between single digits away; addresses with dots kept or spelled."""
    words = list(_SPELLED.finditer(r.text))
    if not words:
        return []
    out: list[Span] = []
    at = 0
    for run in _RUN.finditer(r.text):
        while at < len(words) and words[at].start() < run.start():
            at += 1
        first = at
        while at < len(words) and words[at].end() <= run.end():
            at += 1
        if at == first:
            continue
        part = Rewriting(r.text[run.start() : run.end()], r.start[run.start() : run.end()], r.end[run.start() : run.end()])
        whole = part.replace([(m.start() - run.start(), m.end() - run.start(), _DIGITS[m[0].lower()]) for m in words[first:at]])
        gaps = [(m.start(), m.end(), "") for m in re.finditer(r"(?<=[0-9])[ ,/.()-]+(?=[0-9])", whole.text)]
        for digits in (whole.replace(gaps), whole):
            out += [(k, *digits.back(a, b)) for k, a, b in detect(digits.text) if k != "ip"]
    dots = [(m.start(), m.end(), ".") for m in _DOT_WORD.finditer(r.text)]
    if len(dots) + r.text.count(".") >= 3:
        plain = r.replace(sorted([*dots, *((m.start(), m.end(), _DIGITS[m[0].lower()]) for m in words)]))
        for m in _SPACED_IP.finditer(plain.text):
            # a digit is spelled where it stands for several source characters
            spelled = any(plain.text[k] != "." and plain.end[k] - plain.start[k] > 1 for k in range(m.start(), m.end()))
            if spelled and all(int(re.sub("[ -]", "", x)) <= 255 for x in m[0].split(".")):
                out.append(("ip", *plain.back(m.start(), m.end())))
    return out


def disguised(r: Rewriting) -> list[Span]:
    """Addresses with at and dot spelled or bracketed, and dotted numbers with spelled dots, in r's characters."""
    if not _ADDRESS_HINT.search(r.text) and not _BARE_AT.search(r.text):
        return []
    out: list[Span] = []
    for m in _ADDRESS.finditer(r.text):
        plain = re.sub(_DOT, ".", re.sub(_AT, "@", m[0], count=1, flags=re.I), flags=re.I)
        if PATTERN["email"].fullmatch(plain):
            # a bare word between blanks is a disguise in the company of a spelled or bracketed dot, or before a dotted host
            if re.search(r"[\[({<]|\sdot\s|\spunkt\s|\spunto\s|@", m[0], re.I) or _BARE_AT.search(m[0]):
                out.append(("email", m.start(), m.end()))
    out += [("ip", m.start(), m.end()) for m in _DOTTED.finditer(r.text) if all(int(x) <= 255 for x in re.findall("[0-9]+", m[0]))]
    return out


def added(base: list[Span], more: list[Span]) -> list[Span]:
    """Those of more that meet no base span and no earlier added span of their kind: one sweep over both in order."""
    out: list[Span] = []
    for kind in {s[0] for s in more}:
        held = [s for s in base if s[0] == kind]
        at, end = 0, 0
        for k, a, b in in_order([s for s in more if s[0] == kind]):
            while at < len(held) and held[at][2] <= a:
                at += 1
            if a >= end and not (at < len(held) and held[at][1] < b):
                out.append((k, a, b))
                end = b
    return out


def find(text: str | None) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans) of the text."""
    text = text or ""
    base = detect(text)
    more: list[Span] = []
    r = normalise(text)
    if r.text is not text and r.text != text:
        more += [(k, *r.back(a, b)) for k, a, b in detect(r.text)]
    more += [(k, *r.back(a, b)) for k, a, b in disguised(r)]
    more += spelled_digits(r)
    return base, in_order(base + added(base, more))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its id, counts by kind over all spans, the base's digest, all spans and the base's count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [find(x.as_py()) for x in batch.column(1)]
            counts = [pa.array([sum(s[0] == k for s in spans) for _, spans in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, pa.array([joined(s) for _, s in found], pa.string()), pa.array([len(b) for b, _ in found], pa.int64())], names)

    names = [id_col, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_base"]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_base long")


def masked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with every span of text_col replaced by its kind in brackets."""
    given = docs.columns.index(text_col)
    schema = docs.schema

    def mask(text: str | None) -> str | None:
        if text is None:
            return None
        parts, at = [], 0
        for k, a, b in find(text)[1]:
            if a >= at:
                parts += [text[at:a], f"[{k}]"]
                at = b
        return "".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = list(batch.columns)
            columns[given] = pa.array([mask(x.as_py()) for x in columns[given]], pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(run, schema)


def op6_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document."""
    return personal_data(table(spark, sf_dir, "documents"))
