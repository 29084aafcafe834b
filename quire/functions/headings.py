"""Heading classification as Column expressions. The same patterns serve Spark and the oracle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BANNER, PART, CHAPTER, APPENDIX, SECTION, ROMAN_UPPER, ARTICLE, DECIMAL, LETTER_UPPER, LETTER, ROMAN = -1, 0, 1, 1, 2, 3, 4, 10, 25, 30, 50
MARK = r"\s*[:.\-–]?\s*(.*)$"
NUMERAL = "([0-9IVXivx]+)"
#: (pattern of keyword, number and title; rank; kind), the first that matches counts.
KEYWORDS = [
    (rf"^(PHẦN|Phần)\s+{NUMERAL}{MARK}", PART, "part"),
    (rf"^(CHƯƠNG|Chương)\s+{NUMERAL}{MARK}", CHAPTER, "chapter"),
    (rf"^(PHỤ LỤC|Phụ lục)\s*([0-9IVXivx]*){MARK}", APPENDIX, "appendix"),
    (r"^(PL)\s*([0-9][0-9.()A-Za-z]*)\s*[:\-–]\s*(.*)$", APPENDIX, "appendix"),
    (rf"^(MỤC|Mục)\s+{NUMERAL}{MARK}", SECTION, "section"),
    (rf"^(ĐIỀU|Điều)\s+(\d+){MARK}", ARTICLE, "article"),
]
NUMBERED = r"^(\d+(?:\.\d+)*)\.?\s+(\S.*)$"
NUMBER_ONLY = r"^(\d+(?:\.\d+)*)\.?$"
ROMAN_MARK = r"^(\(?[ivxIVX]{1,5}[.)])\s+(\S.*)$"
LETTER_MARK = r"^([a-zA-Z][.)])\s+(\S.*)$"
#: What every heading's form begins with: a cheap test before the patterns.
ANY_FORM = r"^(\(?[a-zA-Z]{1,5}[.)]|\d|PHẦN|Phần|CHƯƠNG|Chương|PHỤ|Phụ|PL|MỤC|Mục|ĐIỀU|Điều)"
UPPER_ROMAN = r"^X{0,3}(IX|IV|V?I{0,3})$"
REFERENCE = "theo|tại|quy định tại|căn cứ|xem|nêu tại|như"
EDGE = " :.-–"
STRUCTURAL = ("part", "chapter", "article", "section", "roman-upper")


def match_heading(text: Column) -> Column:
    """struct(number, title, rank, kind) of a line that has the form of a heading, else null."""
    group = lambda p, n: F.regexp_extract(text, p, n)
    edge = lambda c: F.trim(c, F.lit(EDGE))
    form = lambda number, title, rank, kind: F.struct(number.alias("number"), edge(title).alias("title"), rank.cast("int").alias("rank"), kind.alias("kind"))
    out = F.when(F.lit(False), form(F.lit(""), F.lit(""), F.lit(0), F.lit("")))
    for p, rank, kind in KEYWORDS:
        number = F.concat(group(p, 1), group(p, 2)) if p.startswith("^(PL)") else F.trim(F.concat(group(p, 1), F.lit(" "), group(p, 2)))
        out = out.when(text.rlike(p), form(number, group(p, 3), F.lit(rank), F.lit(kind)))
    dots = lambda c: F.length(c) - F.length(F.replace(c, F.lit("."), F.lit("")))
    for p, title in ((NUMBERED, group(NUMBERED, 2)), (NUMBER_ONLY, F.lit(""))):
        out = out.when(text.rlike(p), form(group(p, 1), title, F.lit(DECIMAL) + dots(group(p, 1)), F.lit("decimal")))
    marker = group(ROMAN_MARK, 1)
    token = F.trim(marker, F.lit("()."))
    high = (F.upper(token) == token) & token.rlike(UPPER_ROMAN)
    deep = (F.length(token) > 1) | marker.startswith("(")
    rank = F.when(high, ROMAN_UPPER).when(deep, ROMAN).otherwise(LETTER)
    kind = F.when(high, "roman-upper").when(deep, "roman").otherwise("letter")
    out = out.when(text.rlike(ROMAN_MARK), form(marker, group(ROMAN_MARK, 2), rank, kind))
    letter = group(LETTER_MARK, 1)
    return out.when(text.rlike(LETTER_MARK), form(letter, group(LETTER_MARK, 2), F.when(letter.rlike("^[A-Z]"), LETTER_UPPER).otherwise(LETTER), F.lit("letter")))


def name_colon(title: Column) -> Column:
    """The part before the first colon that has no digit beside it; null without one."""
    found = F.regexp_extract(title, r"^(.*?)(?<!\d):(?!\d)", 1)
    return F.when(title.rlike(r"(?<!\d):(?!\d)"), found)


def mostly_upper(title: Column) -> Column:
    letters = F.length(F.regexp_replace(title, r"[^\p{L}]", ""))
    return (letters > 0) & (F.length(F.regexp_replace(title, r"[^\p{Lu}]", "")) / letters >= 0.8)


def looks_like_heading(text: Column, title: Column, kind: Column, bold: Column, from_word: Column | bool = False) -> Column:
    """Whether a line of a heading's form is one and no sentence."""
    from_word = F.lit(from_word) if isinstance(from_word, bool) else from_word
    opens_low = F.regexp_replace(title, "^[“\"'(]+", "").rlike(r"^\p{Ll}")
    structural = kind.isin(*STRUCTURAL) & ((title == "") | opens_low | (~from_word & ~bold & ~mostly_upper(title)))
    before = name_colon(title)
    run_on = F.when(before.isNotNull(), F.length(F.trim(before)) > 60).otherwise(F.length(text) > 160)
    plain = (F.length(text) > 250) | (kind.isin("letter", "roman") & ~bold) | ((kind == "decimal") & ~bold & (run_on | title.rlike(r"^\p{Ll}")))
    return ~text.rlike(f"(?iuU)^({REFERENCE})\\b") & ~structural & (from_word | ~plain)


def shorten_title(title: Column, limit: int = 90) -> Column:
    """The name in a heading: before the colon, else cut at the last sentence, comma or semicolon within the limit."""
    t = F.trim(title)
    fields = F.split(t, r"\s*\|\s*")
    value = lambda f: F.trim(F.when(F.instr(f, ":") > 0, F.regexp_extract(f, "(?s)^[^:]*:(.*)$", 1)).otherwise(f), F.lit(" .;-–"))
    values = F.filter(F.transform(fields, value), lambda v: (v != "") & ~v.rlike(r"^[\d.,/()\-–\s]*$"))
    short = F.filter(values, lambda v: F.length(v) <= limit)
    flat = F.coalesce(F.get(short, F.lit(0)), F.get(values, F.lit(0)), F.lit(""))
    t = F.when((F.size(fields) > 1) & (F.instr(t, ":") > 0), flat).otherwise(t)
    head = F.trim(name_colon(t))
    cut = F.left(t, F.lit(limit))
    last = lambda sep: F.length(cut) - F.instr(F.reverse(cut), sep[::-1]) - len(sep) + 1
    out = F.when((head != "") & (F.length(head) <= limit), head).when(F.length(t) <= limit, t)
    for sep in (". ", ", ", "; "):
        out = out.when((F.instr(cut, sep) > 0) & (last(sep) >= limit // 2), F.trim(F.left(cut, last(sep))))
    blank = (F.instr(cut, " ") > 0) & (last(" ") >= limit // 2)
    return out.otherwise(F.concat(F.trim(F.when(blank, F.left(cut, last(" "))).otherwise(cut)), F.lit("…")))


def as_counter(number: Column) -> Column:
    """2.3.1. as [2, 3, 1]; null for anything else."""
    return F.when(number.rlike(r"^\d+(\.\d+)*\.?$"), F.transform(F.split(F.rtrim(number, F.lit(".")), r"\."), lambda x: x.cast("int")))


def continues_sequence(num: Column, prev: Column) -> Column:
    """Whether counter num may follow counter prev: the next or next but one on its branch, or the first of a new branch."""
    d, size = F.size(num), F.size(prev)
    step = lambda k: (F.get(num, k) == 1) | ((F.get(prev, k) < F.get(num, k)) & (F.get(num, k) <= F.get(prev, k) + 2))
    at = F.sequence(F.lit(0), F.least(d, size) - 1)
    differ = F.filter(at, lambda k: F.get(num, k) != F.get(prev, k))
    common = F.coalesce(F.get(differ, F.lit(0)), F.least(d, size))
    ones = F.forall(F.filter(F.sequence(F.lit(0), d - 1), lambda k: k > common), lambda k: F.get(num, k) == 1)
    return (
        F.when(prev.isNull(), True)
        .when((d <= size) & (common >= d - 1), step(d - 1))
        .when(d > size + 1, False)
        .when(common == size, F.get(num, d - 1) == 1)
        .otherwise(step(common) & ones)
    )


def word_rank(marker: Column, fmt: Column, word_level: Column) -> Column:
    """The rank of a number that Word has made: by its format, then by its list level; decimals state their depth themselves."""
    f, below = F.lower(F.coalesce(fmt, F.lit(""))), F.greatest(F.lit(0), F.coalesce(word_level, F.lit(1)) - 1)
    upper = f.contains("upper")
    inner = F.rtrim(F.trim(marker), F.lit("."))
    dots = F.length(inner) - F.length(F.replace(inner, F.lit("."), F.lit("")))
    roman = F.when(upper, ROMAN_UPPER).otherwise(ROMAN) + below
    letter = F.when(upper, LETTER_UPPER).otherwise(LETTER) + below
    return F.when(f.contains("roman"), roman).when(f.contains("letter"), letter).otherwise(F.lit(DECIMAL) + F.greatest(dots, below)).cast("int")


FIELD_MARK = r"\s*\|\s*"


def column_labels(title: Column) -> Column:
    """The labels ("label: value") of a title that is a whole flattened row; none for others."""
    fields = F.split(title, FIELD_MARK)
    named = F.filter(fields, lambda f: (F.instr(f, ":") > 0) & (F.trim(F.substring_index(f, ":", 1)) != ""))
    return F.when(F.size(fields) > 1, F.transform(named, lambda f: F.lower(F.trim(F.substring_index(f, ":", 1))))).otherwise(F.array().cast("array<string>"))


def own_label(title: Column, limit: int = 60) -> tuple[Column, Column]:
    """The label of a title of one field, null for others, and what is left without it: a name if it is short, else empty."""
    single = F.size(F.split(title, FIELD_MARK)) == 1
    rest = F.trim(F.when(F.instr(title, ":") > 0, F.substr(title, F.instr(title, ":") + 1)).otherwise(""), F.lit(" :.-–"))
    return F.when(single, F.lower(F.trim(F.substring_index(title, ":", 1)))), F.when(F.length(rest) <= limit, rest).otherwise("")


def drop_column_label(title: Column, labels: Column, limit: int = 60) -> Column:
    """A title of one field without a label that the document's rows have."""
    label, rest = own_label(title, limit)
    return F.when(F.coalesce(F.array_contains(labels, label), F.lit(False)), rest).otherwise(title)
