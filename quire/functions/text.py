"""Scalar text functions as Column expressions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

INVISIBLE = "".join(map(chr, (0x200B, 0x200C, 0x200D, 0xFEFF, 0xAD)))
ONE_TO_ONE = {
    "x": "×", "/": "÷", "*": "∗", "-": "‐‑‒–—−―•▪●◦○", '"': "“”„«»″", "'": "‘’‚′",
}
ONE_TO_MANY = {"∑": " Tổng ", "∏": " Tích ", "√": " căn ", "∞": " vô cùng ", "≤": "<=", "≥": ">=", "≠": "!=", "≈": "~=", "±": "+/-", "→": "->", "⇒": "=>"}
FROM = "".join(ONE_TO_ONE.values())
TO = "".join(k * len(v) for k, v in ONE_TO_ONE.items())
#: Private-use codes of symbol fonts: 0xF000 plus the ASCII code; letters mean other glyphs there.
SYMBOL_FONT = {chr(0xF000 + c): chr(c) for c in range(0x20, 0x7F) if not chr(c).isalpha()} | {chr(0xF0B7): "-", chr(0xF0A7): "-"}
ARROWS = chr(0xF0D8) + chr(0xF0E0)

#: Holds all that fold_symbols changes, and few signs that it doesn't: most texts have none of them, which one pattern finds out
#: faster than each rule in turn.
_LOW, _HIGH = ([x for x in FROM + "".join(ONE_TO_MANY) if (x < "\u2000") == low] for low in (True, False))
FOLDED = f"[{min(_HIGH)}-{max(_HIGH)}\\x{{E000}}-\\x{{F8FF}}{''.join(_LOW)}]"

CHARS_PER_TOKEN = 2.8
ENDS_SENTENCE = r"[.:;!?]\s*$"
STARTS_ITEM = r"^\s*([-–—•+*]|\(?[a-zA-Zđ][.)]\s|\(?[ivx]+[.)]\s|\d+(\.\d+)*[.)]?\s)"
CAPITAL = "A-ZĐÀÁÂÃÈÉÊÌÍÒÓÔÕÙÚĂĨŨƠƯẠ-ỹ0-9("


@F.pandas_udf(T.StringType())
def _nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def nfkc(c: Column) -> Column:
    """Unicode NFKC, which Spark has no function for. Only texts beyond ASCII travel to Python."""
    return F.coalesce(_nfkc(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def fold_symbols(c: Column) -> Column:
    """Private-use glyphs and typographic signs as plain characters; expects NFKC text."""
    x = F.regexp_replace(c, f"[{ARROWS}]", "->")
    x = F.translate(x, "".join(SYMBOL_FONT), "".join(SYMBOL_FONT.values()))
    x = F.regexp_replace(x, "[\\x{E000}-\\x{F8FF}]", " ")
    for sign, words in ONE_TO_MANY.items():
        x = F.replace(x, F.lit(sign), F.lit(words))
    return F.when(c.rlike(FOLDED), F.translate(x, FROM, TO)).otherwise(c)


def visible(c: Column) -> Column:
    """c without invisible characters."""
    return F.when(c.rlike(f"[{INVISIBLE}]"), F.translate(c, INVISIBLE, "")).otherwise(c)


def squeeze(c: Column) -> Column:
    """No-break spaces and tabs as spaces, runs of spaces as one, none at the ends."""
    c = F.regexp_replace(F.when(c.rlike("[\u00a0\t]"), F.translate(c, "\u00a0\t", "  ")).otherwise(c), " {2,}", " ")
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def clean_text(c: Column) -> Column:
    """Invisible characters away, NFKC, symbols folded, blanks squeezed."""
    return squeeze(fold_symbols(nfkc(visible(c))))


def clean_lines(c: Column) -> Column:
    """Every line of an already normalised text squeezed; empty lines go."""
    return F.array_join(F.filter(F.transform(F.split(c, "\n"), squeeze), lambda x: x != ""), "\n")


def norm_key(c: Column) -> Column:
    """The key under which repeated lines meet: cleaned, lower case, digits as #."""
    return F.regexp_replace(F.lower(c), r"\d+", "#")


def token_units(c: Column) -> Column:
    """The syllables and marks of c."""
    words = F.filter(F.split(c, r"\s+"), lambda w: w != "")
    syllables = F.aggregate(words, F.lit(0), lambda n, w: n + 1 + (F.length(w) / 7).cast("int"))
    return syllables + F.length(F.regexp_replace(c, r"[\p{L}\p{N}\s]+", ""))


def est_tokens(c: Column) -> Column:
    """An upper estimate of the tokens of c: by characters or by syllables and marks, whichever is more."""
    chars = F.ceil(F.length(c) / F.lit(CHARS_PER_TOKEN)).cast("int")
    return F.when(~c.rlike(r"\S"), 0).otherwise(F.greatest(F.lit(1), chars, token_units(c))).cast("long")


def clean_text_lines(c: Column) -> Column:
    """clean_text for each line of c; lines that end up empty go."""
    return clean_lines(fold_symbols(nfkc(visible(c))))


def split_sentences(c: Column) -> Column:
    """The sentences of c: cut behind a closing mark where blanks and a capital, digit or parenthesis follow."""
    parts = F.split(c, f"(?<=[.!?;:])[ \\t\\n\\f\\r]+(?=[{CAPITAL}])")
    # not F.trim itself: transform would pass it each sentence's position as the signs to trim
    return F.filter(F.transform(parts, lambda s: F.trim(s)), lambda s: s != "")


def continues_sentence(lead: Column, follow: Column) -> Column:
    return (lead != "") & (follow != "") & ~lead.rlike(ENDS_SENTENCE) & ~follow.rlike(STARTS_ITEM)


def document_title(path: Column) -> Column:
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)(\.(pdf|docx?)){1,2}$", "")
    return squeeze(F.translate(name, "_", " "))


def doc_id(path: Column) -> Column:
    """A readable slug of at most 48 characters and 8 hex digits of the path's SHA-1."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    slug = F.regexp_replace(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.concat_ws("-", F.left(slug, F.lit(48)), F.left(F.sha1(path.cast("binary")), F.lit(8)))


def rows_to_markdown(rows: Column) -> Column:
    """A markdown table of an array of rows of cells; blank rows and columns go."""
    full = F.filter(rows, lambda r: F.exists(r, lambda c: F.trim(c) != ""))
    width = F.array_max(F.transform(full, F.size))
    padded = F.transform(full, lambda r: F.concat(r, F.array_repeat(F.lit(""), (width - F.size(r)).cast("int"))))
    kept = F.filter(F.sequence(F.lit(0), width - 1), lambda i: F.exists(padded, lambda r: F.trim(F.get(r, i)) != ""))
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(kept, lambda i: F.get(r, i)), " | "), F.lit(" |"))
    rule = F.concat(F.lit("| "), F.array_join(F.transform(kept, lambda i: F.lit("---")), " | "), F.lit(" |"))
    head = F.array(line(F.element_at(padded, 1)), rule)
    return F.when(F.size(full) == 0, "").otherwise(F.array_join(F.concat(head, F.transform(F.slice(padded, F.lit(2), F.size(padded)), line)), "\n"))


def heading_points(level: Column) -> Column:
    sizes = F.array(*[F.lit(x) for x in (20.0, 17.0, 15.0, 13.5, 12.5, 11.5)])
    return F.when(level <= 0, 24.0).otherwise(F.element_at(sizes, F.least(level, F.lit(6)).cast("int")))


def to_letters(n: Column) -> Column:
    """1 -> a, 26 -> z, 27 -> aa ..., for every int."""
    digit = lambda x: F.char(F.lit(97) + x % 26)
    x, out = n - 1, F.lit("")
    for _ in range(7):
        out = F.when(x >= 0, F.concat(digit(x), out)).otherwise(out)
        x = F.when(x >= 0, F.floor(x / 26) - 1).otherwise(x)
    return F.when(n <= 0, n.cast("string")).otherwise(out)


ROMAN = [(1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")]


def to_roman(n: Column) -> Column:
    left, out = n.cast("int"), F.lit("")
    for value, sign in ROMAN:
        out = F.concat(out, F.repeat(F.lit(sign), F.floor(left / value).cast("int")))
        left = left % value
    return F.when(n <= 0, n.cast("string")).otherwise(out)


def format_counter(n: Column, fmt: Column) -> Column:
    """A list counter in one of Word's number formats."""
    return (
        F.when(fmt == "decimalZero", F.lpad(n.cast("string"), 2, "0"))
        .when(fmt == "lowerLetter", to_letters(n))
        .when(fmt == "upperLetter", F.upper(to_letters(n)))
        .when(fmt == "lowerRoman", to_roman(n))
        .when(fmt == "upperRoman", F.upper(to_roman(n)))
        .otherwise(n.cast("string"))
    )


def figure_placeholder(caption: Column, width: Column, height: Column, file: Column) -> Column:
    size = F.when(width.isNotNull() & height.isNotNull(), F.format_string("%dx%d", width, height))
    return F.concat(F.lit("[FIGURE: "), F.concat_ws(" | ", F.when(caption != "", caption), size, F.when(file != "", file)), F.lit("]"))


def looks_truncated(cell: Column) -> Column:
    """A long cell that opens with a single letter which is no word: the source dropped characters."""
    first = F.lower(F.regexp_extract(cell, r"^(\p{L})\s+\p{L}{2,}", 1))
    return (F.length(cell) > 25) & (first != "") & ~first.isin("ở", "à", "ừ", "ê", "ơ", "y", "a", "ý")


def markdown_rows(md: Column) -> Column:
    """The cells of a markdown table's rows, without its rule; escaped bars are plain again."""
    lines = F.filter(F.split(md, "\n"), lambda x: F.trim(x).startswith("|") & ~x.rlike(r"^[|\s:-]+$"))
    cells = lambda x: F.transform(F.split(F.regexp_replace(F.trim(x), r"^\||(?<!\\)\|$", ""), r"(?<!\\)\|"), lambda c: F.replace(F.trim(c), F.lit("\\|"), F.lit("|")))
    return F.transform(lines, cells)
