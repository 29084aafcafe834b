import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quire.functions import folds, merging, packing
from quire.functions import headings as hd
from quire.functions import text as tx


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(
    ("given", "want"),
    [
        (f"1.{chr(0x200B)}Phạm vi", "1.Phạm vi"),
        ("𝐌𝐢", "Mi"),
        ("𝟏𝟐", "12"),
        ("𝐋 = 𝐌 ∗𝐓 ∗𝐑", "L = M *T *R"),
        ("a ≤ b ≥ c ≠ d", "a <= b >= c != d"),
        ("5 × 3 ÷ 2 ± 1", "5 x 3 / 2 +/- 1"),
        ("“abc” – ‘x’", "\"abc\" - 'x'"),
        (f"a {chr(0xF02B)} b", "a + b"),
        (f"a\t\tb{chr(0xA0)}c", "a b c"),
        ("Điều 5.1: Lãi suất 6,5%/năm (áp dụng từ 01/2026) - xem mục 2.3.", "Điều 5.1: Lãi suất 6,5%/năm (áp dụng từ 01/2026) - xem mục 2.3."),
    ],
)
def test_clean_text(spark, given, want):
    assert value(spark, tx.clean_text(F.lit(given))) == want


@pytest.mark.parametrize(("n", "fmt", "want"), [(4, "lowerRoman", "iv"), (2026, "lowerRoman", "mmxxvi"), (1, "lowerLetter", "a"), (27, "lowerLetter", "aa"), (3, "upperRoman", "III"), (2, "decimalZero", "02"), (0, "lowerRoman", "0")])
def test_counters(spark, n, fmt, want):
    assert value(spark, tx.format_counter(F.lit(n), F.lit(fmt))) == want


@pytest.mark.parametrize("text", ["", "  ", "a", "word " * 30, "| a | b |\n| --- | --- |", "Đây là một câu. Và thêm nữa!"])
def test_tokens_agree(spark, text):
    assert value(spark, tx.est_tokens(F.lit(text))) == packing.tokens(text)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("ĐIỀU 2: MỘT SỐ QUY ĐỊNH", ("ĐIỀU 2", "MỘT SỐ QUY ĐỊNH", 4, "article")),
        ("2.3.1. Nghĩa vụ cung cấp", ("2.3.1", "Nghĩa vụ cung cấp", 12, "decimal")),
        ("I. THÔNG TIN CHUNG", ("I.", "THÔNG TIN CHUNG", 3, "roman-upper")),
        ("i) nhỏ", ("i)", "nhỏ", 30, "letter")),
        ("(i) nhỏ", ("(i)", "nhỏ", 50, "roman")),
        ("PL02.1003.PCS.2026(1): Giải thích từ ngữ", ("PL02.1003.PCS.2026(1)", "Giải thích từ ngữ", 1, "appendix")),
        ("Một câu bình thường.", None),
        ("PL01.1016.PDS.2026(1);", None),
    ],
)
def test_match_heading(spark, text, want):
    got = value(spark, hd.match_heading(F.lit(text)))
    assert (tuple(got) if got else None) == want


@pytest.mark.parametrize(
    ("title", "want"),
    [
        ("Hợp đồng bảo hiểm: là tất cả", "Hợp đồng bảo hiểm"),
        ("Điều kiện áp dụng:", "Điều kiện áp dụng"),
        ("Khung 8:30 tới 17:00", "Khung 8:30 tới 17:00"),
        ("STT: 3.1 | Nội dung: Đối tượng khách hàng | Cụ thể:", "Đối tượng khách hàng"),
        ("STT: | Nội dung: | Cụ thể:", ""),
        ("Khoản: 3.1 | Điều kiện vay vốn | Quy định:", "Điều kiện vay vốn"),
        ("x" * 60 + ". " + "y" * 60, "x" * 60),
        ("word " * 40, ("word " * 18).strip() + "…"),
    ],
)
def test_shorten_title(spark, title, want):
    assert value(spark, hd.shorten_title(F.lit(title))) == want == folds.short_title(title)


@pytest.mark.parametrize(("num", "prev", "want"), [([2, 3, 1], [2, 2, 5], True), ([30], [1, 25], False), ([1, 26], [1, 25], True), ([3], None, True), ([2], [1, 4], True), ([1, 1, 1], [1], False)])
def test_sequence(spark, num, prev, want):
    arr = lambda x: F.lit(None).cast("array<int>") if x is None else F.array(*map(F.lit, x))
    assert value(spark, hd.continues_sequence(arr(num), arr(prev))) == want == folds.follows(tuple(num), None if prev is None else tuple(prev))


def test_table_drops_blank_columns(spark):
    rows = F.array(*[F.array(*map(F.lit, r)) for r in (["", "Năm hợp đồng", "", "1", ""], ["", "Lãi suất", "", "3%", ""])])
    assert value(spark, tx.rows_to_markdown(rows)).split("\n")[0] == "| Năm hợp đồng | 1 |"


def test_splitters_keep_words():
    text = " ".join(f"Câu số {i} dài vừa phải." for i in range(80))
    assert all(len(p) <= 200 for p in packing.split_text(text, 200)) and " ".join(packing.split_text(text, 200)).split() == text.split()
    table = "| a | b |\n| --- | --- |\n" + "\n".join(f"| {i} | x{i} |" for i in range(60))
    parts = packing.split_table(table, 300)
    assert len(parts) > 1 and all(p.startswith("| a | b |") for p in parts)


def test_sections_cap_depth():
    numbers = ["1.", "1.1", "1.1.1", "1.1.1.1", "1.1.1.1.1", "1.2"]
    blocks = [folds.Block(f"{n} Tên {n}", 1, "heading", n, n.rstrip(".").count(".") + 1, title=f"Tên {n}") for n in numbers]
    out = folds.build_sections(blocks)
    assert [s.number for s in out] == ["1.", "1.1", "1.1.1", "1.2"] and len(out[2].blocks) == 2


def test_merge_short_joins_siblings():
    blocks = []
    for k in range(1, 4):
        blocks += [folds.Block(f"1.{k} Từ {k}", 1, "heading", f"1.{k}", 1, title=f"Từ {k}"), folds.Block(f"Nghĩa {k}.", 1)]
    out = merging.merge_short(folds.build_sections(blocks), 60, 512)
    assert len(out) == 1 and out[0].number == "1.1 + 1.2 + 1.3"
    assert len(merging.merge_short(folds.build_sections(blocks), 0, 512)) == 3


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("0 rows are 100. 19.37.233.111", ["0 rows are 100.", "19.37.233.111"]),
        (" A. 2b 2! 10 ", ["A.", "2b 2!", "10"]),
        ("A.\x0bB. \t C", ["A.\x0bB.", "C"]),
        ("", []),
    ],
)
def test_sentences_keep_their_digits(spark, text, want):
    assert value(spark, tx.split_sentences(F.lit(text))) == want


def test_every_folded_sign_passes_the_guard(spark):
    signs = [*tx.FROM, *tx.ONE_TO_MANY, *tx.SYMBOL_FONT, *tx.ARROWS, chr(0xE000), chr(0xF8FF)]
    rows = spark.createDataFrame([(x,) for x in signs], "c string").select("c", tx.fold_symbols(F.col("c")).alias("v")).collect()
    assert len(rows) == len(signs) and all(r["v"] != r["c"] for r in rows)


@pytest.mark.parametrize("text", ["a\x0bb  seven77 fourteen144444 é1234567\n\n, .", "\x0b\f", "𝐌" * 15, "|" * 8 + " _ "])
def test_token_units_are_counted_by_words(spark, text):
    words = [w for w in re.split(r"[ \t\n\x0b\f\r]+", text) if w]
    assert value(spark, tx.token_units(F.lit(text))) == sum(1 + len(w) // 7 for w in words) + sum(unicodedata.category(x)[0] not in "LN" and x not in " \t\n\x0b\f\r" for x in text)
