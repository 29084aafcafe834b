"""Folds, sources and the stream front end on small tables, against plain loops."""

import random
import re

from pyspark.sql import functions as F

from quire.functions import text as tx
from quire.operators import figures as fg
from quire.operators import lines as ln
from quire.operators import numbering as nb
from quire.operators import outline as ol
from quire.sources import files as sf
from quire.streaming import ingest


def test_clusters_by_plain_loop(spark):
    r = random.Random(4)
    rows = [(str(d), 1, k, x, y, x + r.random() * 60, y + r.random() * 60) for d in range(30) for k in range(r.randrange(1, 45)) for x, y in [(r.random() * 500, r.random() * 700)]]

    def once(boxes, gap=26.0):
        out = []
        for b in boxes:
            near = [a for a in out if a[0] < b[2] + gap and b[0] - gap < a[2] and a[1] < b[3] + gap and b[1] - gap < a[3]]
            out = [a for a in out if a not in near]
            out.append((min(x[0] for x in [*near, b]), min(x[1] for x in [*near, b]), max(x[2] for x in [*near, b]), max(x[3] for x in [*near, b])))
        return out

    got: dict = {}
    for x in fg.clusters(spark.createDataFrame(rows, "doc_id string, page int, no int, x0 double, y0 double, x1 double, y1 double")).collect():
        got.setdefault(x["doc_id"], []).append((x["x0"], x["y0"], x["x1"], x["y1"]))
        assert x["n"] >= 1
    for d in got:
        assert sorted(got[d]) == sorted(once(once([x[3:] for x in rows if x[0] == d])))


def test_wrapped_lines_by_plain_loop(spark):
    r = random.Random(5)
    rows = []
    for d in range(40):
        y = 0.0
        for k in range(r.randrange(1, 25)):
            y += r.choice([12.0, 14.0, 40.0])
            rows.append((d, 1, k, y, r.choice([72.0, 80.0, 100.0, 200.0]), r.choice([11.0, 11.4, 14.0]), r.random() < 0.3, r.choice(["some words", "ends here.", "split wo-", "rd goes on", "1. item", "a) item", "Điều 5 x", "Next"])))
    want = []
    for d in range(40):
        out: list = []
        for x in (list(x) for x in rows if x[0] == d):
            if out:
                p = out[-1]
                gap, indent, opens = x[3] - p[3], x[4] - p[4], re.match(ln.ITEM_START, x[7])
                near = 0 < gap < p[5] * 2.2 and not opens
                placed = abs(indent) < 12 or (0 < indent <= 60 and re.match(ln.ITEM_START, p[7]))
                if near and re.search(r"\w-$", p[7]) and x[7][0].islower():
                    p[7] += x[7]
                    continue
                if near and p[6] == x[6] and abs(p[5] - x[5]) < 0.6 and placed and not re.search("[.:;!?]$", p[7]):
                    p[7] += " " + x[7]
                    continue
            out.append(x)
        want += out
    got = ln.merge_wrapped(spark.createDataFrame(rows, "doc_id int, page int, line_no int, y double, x0 double, size double, bold boolean, text string")).select("doc_id", "page", "line_no", "y", "x0", "size", "bold", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) < len(rows)


def test_outline_fold_and_windows_agree(spark, monkeypatch):
    r = random.Random(6)
    rows = [(d, k, r.randrange(1, 7), f"n{k}") for d in range(40) for k in range(r.randrange(1, 20))]
    h = spark.createDataFrame(rows, "doc_id int, ord int, level int, name string")
    look = lambda: sorted((x["doc_id"], x["ord"], tuple(x["ancestors"]), x["depth"], x["demoted"]) for x in ol.open_ancestors(h).collect())
    windows = look()
    monkeypatch.setattr(ol, "MAX_LEVELS", 3)
    assert look() == windows and len(windows) == len(rows)


def test_numbers_of_word(spark):
    levels = spark.createDataFrame([("d", "1", "a", 0, "decimal", "%1.", 1, None, None), ("d", "1", "a", 1, "lowerLetter", "%1.%2)", 1, None, None), ("d", "2", "b", 0, "none", "%1", 1, None, None), ("d", "3", "c", 0, "decimal", "%1-%3", 5, None, None)], "doc_id string, num_id string, abstract_id string, ilvl int, fmt string, lvl_text string, start int, restart int, start_override int")
    pars = spark.createDataFrame([("d", k, n, i) for k, (n, i) in enumerate([("1", 0), ("1", 1), ("1", 1), ("1", 0), ("1", 1), ("2", 0), ("3", 0), ("9", 0)])], "doc_id string, par_no long, num_id string, ilvl int")
    got = [x["number"] for x in nb.numbers(pars, levels).orderBy("par_no").collect()]
    assert got == ["1.", "1.a)", "1.b)", "2.", "2.a)", None, "5-1", None]


def test_letters_beyond_four(spark):
    got = spark.range(1).select(*[tx.to_letters(F.lit(n)).alias(str(n)) for n in (475_254, 475_255, 2_000_000_000)]).first()
    assert list(got) == [nb._letters(n) for n in (475_254, 475_255, 2_000_000_000)]


def test_footer_numbers_go(spark):
    lines = spark.createDataFrame([("d", "Rules 3/9", 800.0, 842.0), ("d", "Rules 3/9", 400.0, 842.0), ("d", "Other 3/9", 800.0, 842.0)], "doc_id string, text string, y double, page_h double")
    repeats = spark.createDataFrame([("d", "rules")], "doc_id string, key string")
    assert sorted((x["text"], x["y"]) for x in ln.drop_footer_numbers(lines, repeats).collect()) == [("Other 3/9", 800.0), ("Rules 3/9", 400.0)]


def test_captions(spark):
    images = spark.createDataFrame([("d", 1, 7, 100.0, 100.0, 300.0, 200.0), ("d", 2, 8, 100.0, 100.0, 300.0, 200.0)], "doc_id string, page int, xref int, x0 double, y0 double, x1 double, y1 double")
    lines = spark.createDataFrame([("d", 1, 0, "Hình 1: x", 120.0, 200.0, 90.0), ("d", 1, 1, "Hình 2: y", 120.0, 200.0, 210.0), ("d", 2, 0, "no caption", 120.0, 200.0, 210.0)], "doc_id string, page int, line_no int, text string, x0 double, x1 double, y double")
    assert {x["xref"]: x["caption"] for x in fg.captions(images, lines).collect()} == {7: "Hình 2: y", 8: None}


def test_paths_and_files(spark, tmp_path):
    row = spark.range(1).select(sf.parse_drop(F.lit("{/a b/c.pdf} /d.docx")).alias("p"), sf.output_path(F.lit("/in/x/a.pdf"), F.lit("/in"), F.lit("/out"), ".pdf").alias("o")).first()
    assert row["p"] == ["/a b/c.pdf", "/d.docx"] and row["o"] == "/out/x/a_formalized.pdf"
    for name in ("a.pdf", "sub/b.DOCX", "sub/~$b.docx", "c.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    assert sorted(x["title"] for x in sf.discover(spark, str(tmp_path)).collect()) == ["a", "b"]


def test_stream_makes_chunks(spark, tmp_path):
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, "1. First\nSome words that follow it."), (2, None)], "doc_id long, text string").write.parquet(folder)
    ingest.stream_chunks(spark, folder, out, str(tmp_path / "state")).awaitTermination(120)
    got = spark.read.parquet(out)
    assert {x["doc_id"] for x in got.collect()} == {"1"}
    sf.write_chunks(got.drop("batch"), str(tmp_path / "json"))
    assert sf.read_chunks(spark, str(tmp_path / "json")).count() == got.count()


def test_page_ranges_and_paths_by_plain_loop(spark):
    r = random.Random(8)
    heads = [(d, 2 * k, r.randrange(1, 6), f"n{k}", r.choice([None, *range(9)])) for d in range(40) for k in range(r.randrange(1, 25)) if r.random() < 0.8]
    blocks = [(d, k, r.choice([None, *range(30)])) for d in range(41) for k in range(-1, 50) if r.random() < 0.6]
    h = spark.createDataFrame(heads, "doc_id long, ord long, level long, name string, page int")
    b = spark.createDataFrame(blocks, "doc_id long, ord long, page int")

    def ranges(inside):
        for d, o, level, _, page in heads:
            until = min((x[1] for x in heads if x[0] == d and x[1] > o and x[2] <= level), default=10**9)
            yield d, o, page, max((p for e, n, p in inside if e == d and o < n < until and p is not None), default=page) if page is None else max([page, *(p for e, n, p in inside if e == d and o < n < until and p is not None)])

    for given, inside in ((b, blocks), (None, [(d, o, p) for d, o, _, _, p in heads])):
        out = ol.page_ranges(h, given)
        assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
        assert sorted(map(tuple, out.collect()), key=str) == sorted(ranges(inside), key=str)
    out, want = ol.paths(h), []
    for d, o, level, name, _ in heads:
        up = [x for x in heads if x[0] == d and x[1] < o and x[2] < level and not any(y[0] == d and x[1] < y[1] < o and y[2] <= x[2] for y in heads)]
        want += [(d, o, level, name, len(up) + 1, [x[3] for x in up] + [name])] if len(up) < 3 else []
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert sorted(map(tuple, out.collect()), key=str) == sorted(want, key=str)
