"""The rebuilt layout against plain loops and invariants."""

import math
import random

from quire.functions import folds
from quire.functions import layout as ly
from quire.functions.folds import Block, Section
from quire.operators import documents as dc
from quire.operators import layout as lo


def counted(items, lines, most):
    """Parts of a greedy layout, one item after another."""
    parts = []
    for i in items:
        if parts and sum(x.lines for x in parts[-1]) + i.lines <= lines and sum(x.tokens for x in parts[-1]) + i.tokens <= most:
            parts[-1].append(i)
        else:
            parts.append([i])
    return parts


def test_even_parts_by_plain_loop():
    r = random.Random(3)
    for _ in range(150):
        items = [ly.Item("para", " ".join(["word"] * r.randrange(1, 120))) for _ in range(r.randrange(1, 40))]
        room, most = r.randrange(6, 42), r.randrange(40, 300)
        parts = ly.evenly(items, room, most)
        assert [i for p in parts for i in p] == items
        whole = sum(i.lines for i in items) <= room and sum(i.tokens for i in items) <= most
        need = 1 if whole else len(counted(items, room, most))
        assert len(parts) == need
        if not whole:
            low, high = 10, 100
            while low < high:
                mid = (low + high) // 2
                low, high = (low, mid) if len(counted(items, room * mid // 100, most * mid // 100)) <= need else (mid + 1, high)
            assert parts == counted(items, max(1, room * low // 100), max(1, most * low // 100))


def test_cut_items():
    long_ = ly.Item("para", " ".join(f"Sentence number {k} of this text ends here." for k in range(200)))
    parts = ly.cut(long_, 20, 120)
    assert len(parts) > 1 and all(p.within(20, 120) for p in parts) and " ".join(p.text for p in parts) == long_.text
    table = ly.Item("table", "\n".join(["| a | b |", "| --- | --- |", *[f"| {k} | value {k} |" for k in range(100)]]))
    parts = ly.cut(table, 20, 120)
    assert all(p.kind == "table" and p.text.startswith("| a | b |\n| --- |") for p in parts)
    assert [x for p in parts for x in p.text.split("\n")[2:]] == table.text.split("\n")[2:]
    figure = ly.Item("figure", "[FIGURE]", height=1400.0, width=700.0)
    (small,) = ly.cut(figure, 42, 500)
    assert math.isclose(small.height / figure.height, 41 / figure.lines) and math.isclose(small.width / figure.width, 41 / figure.lines) and small.lines <= 42
    assert ly.cut(ly.Item("figure", "x"), 2, 1) == [ly.Item("figure", "x")]


def section(number, title, path, *texts, full=""):
    return Section(number, title, len(path), path, 1, 1, "decimal", full or f"{number} {title}", title, title, [Block(t, 1) for t in texts])


def test_titles_and_rest():
    run_on = section("14.", "KOC", ["14. KOC"], "More.", full="14. KOC: people who buy")
    assert ly.title_and_rest(run_on) == ("14. KOC", "people who buy")
    assert [i.text for i in ly.content_of(run_on, True)] == ["people who buy More."]
    joined = Section("1 + 2", "A + B", 1, ["1 + 2 A + B"], 1, 1, "decimal", "1 A: the text", "A + B", "A")
    assert ly.title_and_rest(joined) == ("1 + 2 A + B", "the text")
    assert ly.heading_of(Section("", folds.PREAMBLE, 1, [folds.PREAMBLE], 1, 1)) is None


def test_pages_by_section():
    top, sub, alone = section("1", "Top", ["1 Top"]), section("1.1", "Sub", ["1 Top", "1.1 Sub"], "Text of it."), section("2", "Alone", ["2 Alone"])
    pages = ly.laid_out([top, sub, alone], by_section=True, title="Doc")
    assert [(p.page, p.item.text) for p in pages] == [(1, "Doc"), (1, "1 Top"), (1, "1.1 Sub"), (1, "Text of it."), (2, "2 Alone")]
    other = section("2", "Other", ["2 Other"], "Text.")
    assert [(p.page, p.item.text) for p in ly.laid_out([top, other], by_section=True)] == [(1, "1 Top"), (2, "2 Other"), (2, "Text.")]
    assert ly.laid_out([], title="Doc") == [] and ly.laid_out([], by_section=True, title="Doc") == []


def test_flow_reopens_long_sections(spark):
    body = "\n".join(f"Paragraph {k} says that the rule holds for every case." for k in range(120))
    docs = spark.createDataFrame([(1, f"1. SCOPE\n{body}\n2. TERMS\nShort."), (2, None), (3, "no heading")], "doc_id long, text string")
    blocks = dc.detect_headings(dc.document_blocks(docs))
    cfg = folds.ChunkConfig(merge_short=False)
    items = lo.layout(blocks, cfg).toPandas().sort_values(["doc_id", "item_no"])
    first = items[items.doc_id == "1"]
    heads = list(first[first.kind == "heading"].text)
    assert len(heads) > 2 and all(h.endswith(ly.CONTINUED) for h in heads[1:-1]) and not heads[0].endswith(ly.CONTINUED)
    assert [x for t in first[first.kind == "para"].text for x in t.split("\n")] == [*body.split("\n"), "Short."]
    sums = first[first.section_no == 0].assign(n=lambda x: x.text.map(ly.tokens)).groupby("part_index").n.sum()
    assert (sums <= 512).all() and len(sums) == math.ceil(sums.sum() / 512)
    assert set(items.doc_id) == {"1", "3"}
    out = {r["doc_id"]: r for r in lo.rebuilt(lo.layout(blocks, cfg)).collect()}
    assert out["1"]["sections_out"] == 2 and out["3"]["sections_out"] == 0 and out["3"]["pages_out"] == 1
    assert lo.layout(blocks.limit(0)).count() == 0
