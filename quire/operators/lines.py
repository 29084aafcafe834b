"""Clean-up of page lines, in joins, windows and aggregates keyed by document and page.

Lines are (doc_id, page, line_no, text, y, page_h) with x0, size, bold where a rule needs them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import norm_key, squeeze

PAGE_NUMBER = r"(?i)^(trang\s*)?[-–\s]*\d+\s*(/\s*\d+)?\s*[-–]*$"
DOT_LEADER = r"\.{4,}\s*\d*\s*$"
FOOTER = r"(?i)^((tài liệu|văn bản|thông tin)\s+(nội bộ|mật|lưu hành nội bộ)|lưu hành nội bộ|(bản|phiên bản|version)\s*[:\s]*[\d.]+|(trang|page)\s*\d+|(mã|số)\s*(hiệu|văn bản|tài liệu)\s*[:.]|confidential|internal use only|all rights reserved)"
TOP, BOTTOM = 0.10, 0.75


def repeated_lines(lines: DataFrame) -> DataFrame:
    """(doc_id, key, n_pages): the lines in page margins that stand at the same height on 30 % of the pages, two at least."""
    ratio = F.col("y") / F.col("page_h")
    rows = lines.withColumns({"ratio": ratio, "key": norm_key(F.col("text"))}).filter(((F.col("ratio") <= TOP) | (F.col("ratio") >= BOTTOM)) & (F.col("key") != "") & ((F.length("key") >= 3) | F.col("text").rlike(PAGE_NUMBER)))
    first = rows.groupBy("doc_id", "page", "key").agg(F.min_by("ratio", "line_no").alias("ratio"))
    pages = lines.groupBy("doc_id").agg(F.count_distinct("page").alias("pages"))
    found = first.groupBy("doc_id", "key").agg(F.count("*").alias("n_pages"), (F.max("ratio") - F.min("ratio")).alias("spread"))
    need = F.greatest(F.lit(2), F.floor(F.col("pages") * F.lit(0.3)))
    return found.join(pages, "doc_id").filter((F.col("n_pages") >= need) & (F.col("spread") <= 0.02)).select("doc_id", "key", "n_pages")


def drop_boilerplate(lines: DataFrame) -> DataFrame:
    """lines without repeated margins, page numbers and footer phrases."""
    repeats = repeated_lines(lines).select("doc_id", "key", F.lit(True).alias("repeated"))
    ratio = F.col("y") / F.col("page_h")
    marked = lines.withColumn("key", norm_key(F.col("text"))).join(repeats, ["doc_id", "key"], "left")
    margin = (ratio <= TOP) | (ratio >= BOTTOM)
    drop = (margin & F.coalesce("repeated", F.lit(False))) | (~((ratio > TOP) & (ratio < 0.84)) & (F.col("text").rlike(PAGE_NUMBER) | F.col("text").rlike(FOOTER)))
    return marked.filter(~drop).drop("key", "repeated")


def body_size(lines: DataFrame) -> DataFrame:
    """(doc_id, body_size): the size that most characters have; 12 without any."""
    sizes = lines.groupBy("doc_id", F.round("size", 1).alias("size")).agg(F.sum(F.length("text")).alias("n"), F.min(F.struct("page", "line_no")).alias("at"))
    best = F.row_number().over(W.partitionBy("doc_id").orderBy(F.desc("n"), "at"))
    return sizes.withColumn("r", best).filter("r = 1").select("doc_id", F.when(F.col("n") > 0, F.col("size")).otherwise(12.0).alias("body_size"))


def before_toc(lines: DataFrame) -> DataFrame:
    """lines without tables of contents: on a page with four dot leaders or more, what is above the first of them."""
    leader = F.col("text").rlike(DOT_LEADER)
    title = F.lower("text").rlike(r"^(mục lục|contents|table of contents)\s*$")
    page = W.partitionBy("doc_id", "page")
    marked = lines.withColumns({"_n": F.count_if(leader).over(page), "_y": F.min(F.when(leader, F.col("y"))).over(page)}).withColumn("_t", F.min(F.when(title & (F.col("y") <= F.col("_y")), F.col("y"))).over(page))
    return marked.filter((F.col("_n") < 4) | (F.col("y") < F.coalesce("_t", "_y"))).filter(~leader).drop("_n", "_y", "_t")


def without_footnotes(lines: DataFrame) -> DataFrame:
    """lines (with size, body_size, ref_start) without the run of small lines at a page's foot, if one opens with a mark."""
    up = W.partitionBy("doc_id", "page").orderBy(F.desc("y"), F.desc("line_no"))
    small = (F.col("y") >= F.col("page_h") * 0.70) & (F.col("size") > 0) & (F.col("size") <= F.col("body_size") - 1.0)
    run = lines.withColumn("_in", F.max(F.when(small, 0).otherwise(1)).over(up.rowsBetween(W.unboundedPreceding, 0)) == 0)
    noted = F.max(F.col("_in") & F.col("ref_start")).over(W.partitionBy("doc_id", "page"))
    return run.withColumn("_note", noted).filter(~(F.col("_in") & F.col("_note"))).drop("_in", "_note")


def outside_boxes(lines: DataFrame, boxes: DataFrame) -> DataFrame:
    """lines whose middle lies in none of the boxes (doc_id, page, x0, y0, x1, y1) of their page."""
    b = boxes.select("doc_id", "page", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y") + F.col("y1")) / 2
    inside = (lines["doc_id"] == b["doc_id"]) & (lines["page"] == b["page"]) & x.between(F.col("_x0"), F.col("_x1")) & y.between(F.col("_y0"), F.col("_y1"))
    return lines.join(b, inside, "left_anti")


def rebuild_spaces(glyphs: DataFrame) -> DataFrame:
    """(line_id, text) of glyphs (line_id, dir_y, span_no, size, char_no, c, x0, x1): blanks come from gaps of 0.12 of the
    size; lines that are turned keep theirs."""
    glyph = F.struct("span_no", "char_no", "dir_y", "size", "c", "x0", "x1")
    lines = glyphs.groupBy("line_id").agg(F.sort_array(F.collect_list(glyph)).alias("gs")).withColumn("text", spaced("gs"))
    return lines.filter(F.col("text").isNotNull()).select("line_id", "text")


def spaced(glyphs: str) -> Column:
    """The text of an array column of glyphs in order (dir_y, size, c, x0, x1), as in rebuild_spaces; null without a glyph to show.
    Lines that are held whole need no shuffle."""
    turned = lambda g: F.abs(g["dir_y"]) >= 0.01
    seen = F.filter(F.col(glyphs), lambda g: turned(g) | (F.trim(g["c"]) != ""))
    # exploding one element would make a row of it: the array is bound by a lambda instead, so that it is made once
    part = lambda gs: F.transform(gs, lambda g, k: F.when(~turned(g) & (g["x0"] - F.get(gs, k - 1)["x1"] >= g["size"] * 0.12), F.concat(F.lit(" "), g["c"])).otherwise(g["c"]))
    return F.get(F.transform(F.array(seen), lambda gs: F.when(F.size(gs) > 0, F.array_join(part(gs), ""))), F.lit(0))


def join_rows(lines: DataFrame, tolerance: float = 2.5) -> DataFrame:
    """(doc_id, page, y, x0, size, bold, text): lines of one height joined from left to right. A row is anchored to its first
    line, so the rows come from a fold over each page's lines."""
    line = F.struct("y", "x0", "text", "size", "bold", "line_no")
    pages = lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(line)).alias("ls"))
    empty = F.slice("ls", 1, 0)

    def step(acc, s):
        same = (F.size(acc["row"]) > 0) & (F.abs(s["y"] - F.get(acc["row"], F.lit(0))["y"]) <= tolerance)
        return F.when(same, F.struct(acc["done"].alias("done"), F.concat(acc["row"], F.array(s)).alias("row"))).otherwise(
            F.struct(F.when(F.size(acc["row"]) > 0, F.concat(acc["done"], F.array(acc["row"]))).otherwise(acc["done"]).alias("done"), F.array(s).alias("row"))
        )

    rows = F.aggregate("ls", F.struct(F.array(empty).alias("done"), empty.alias("row")), step, lambda acc: F.filter(F.concat(acc["done"], F.array(acc["row"])), lambda r: F.size(r) > 0))
    by_x = F.array_sort("r", lambda a, b: F.when(a["x0"] < b["x0"], -1).when(a["x0"] > b["x0"], 1).otherwise(F.when(a["line_no"] < b["line_no"], -1).otherwise(1)))
    wide = F.filter(F.slice("s", F.lit(2), F.size("s")), lambda x: F.length(x["text"]) > 4)
    return pages.select("doc_id", "page", F.explode(rows).alias("r")).select("doc_id", "page", by_x.alias("s")).select(
        "doc_id", "page", F.get("s", F.lit(0))["y"].alias("y"), F.coalesce(F.get(wide, F.lit(0))["x0"], F.get("s", F.lit(0))["x0"]).alias("x0"),
        F.array_max(F.transform("s", lambda x: x["size"])).alias("size"), F.exists("s", lambda x: x["bold"]).alias("bold"), F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"),
    )


def estimated_pages(paragraphs: DataFrame, chars_per_page: int = 2200) -> DataFrame:
    """paragraphs (doc_id, par_no, text) with page: a new page after so many characters, and before a paragraph with page_breaks,
    where there is such a column. The count begins anew with each page, so it is a fold."""
    breaks = F.col("page_breaks") > 0 if "page_breaks" in paragraphs.columns else F.lit(False)
    item = F.struct("par_no", F.length("text").cast("long").alias("n"), F.coalesce(breaks, F.lit(False)).alias("b"))
    docs = paragraphs.groupBy("doc_id").agg(F.sort_array(F.collect_list(item)).alias("ps"))

    def step(acc, p):
        page, chars = acc["page"] + p["b"].cast("int"), F.when(p["b"], 0).otherwise(acc["chars"]) + p["n"]
        full = chars >= chars_per_page
        row = F.struct(p["par_no"].alias("par_no"), page.alias("page"))
        return F.struct(F.when(full, 0).otherwise(chars).cast("long").alias("chars"), (page + full.cast("int")).alias("page"), F.concat(acc["out"], F.array(row)).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(1).alias("page"), F.array().cast("array<struct<par_no:bigint,page:int>>").alias("out"))
    return docs.select("doc_id", F.explode(F.aggregate("ps", start, step)["out"]).alias("r")).select("doc_id", "r.par_no", "r.page")


ITEM_START = r"^([-–•▪]|\(?[a-zA-Z]\)|\(?[ivx]+\)|(Điều|PHẦN|Phần|Chương|Mục)\b|\d+(\.\d+)*[.)]?\s)"
HANGING = 60.0


def merge_wrapped(lines: DataFrame) -> DataFrame:
    """(doc_id, page, y, x0, size, bold, text): lines (with line_no) that the margin has wrapped joined to paragraphs. A paragraph keeps
    place and style of its first line, against which every later line is held: a fold over each page's lines."""
    item = F.struct("line_no", "y", "x0", "size", "bold", "text")
    pages = lines.groupBy("doc_id", "page").agg(F.sort_array(F.collect_list(item)).alias("ls"))

    def step(acc, b):
        p = acc["now"]
        gap, indent = b["y"] - p["y"], b["x0"] - p["x0"]
        opens = b["text"].rlike(ITEM_START)
        near = (gap > 0) & (gap < p["size"] * 2.2) & ~opens
        broken = near & p["text"].rlike(r"(?U)\w-$") & b["text"].rlike(r"^\p{Ll}")
        style = (p["bold"] == b["bold"]) & (F.abs(p["size"] - b["size"]) < 0.6)
        placed = (F.abs(indent) < 12) | ((indent > 0) & (indent <= HANGING) & p["text"].rlike(ITEM_START))
        wrapped = near & style & placed & ~p["text"].rlike("[.:;!?]$")
        joined = p.withField("text", squeeze(F.concat(p["text"], F.when(broken, "").otherwise(" "), b["text"])))
        return F.when(broken | wrapped, F.struct(acc["done"].alias("done"), joined.alias("now"))).otherwise(F.struct(F.concat(acc["done"], F.array(p)).alias("done"), b.alias("now")))

    first = F.struct(F.slice("ls", 1, 0).alias("done"), F.element_at("ls", 1).alias("now"))
    rows = F.aggregate(F.slice("ls", F.lit(2), F.size("ls")), first, step, lambda acc: F.concat(acc["done"], F.array(acc["now"])))
    return pages.select("doc_id", "page", F.explode(rows).alias("r")).select("doc_id", "page", "r.line_no", "r.y", "r.x0", "r.size", "r.bold", "r.text")


def drop_footer_numbers(lines: DataFrame, repeats: DataFrame) -> DataFrame:
    """lines without margin lines that end in a page number and repeat (doc_id, key) without it."""
    ratio = F.col("y") / F.col("page_h")
    shorter = F.regexp_replace("text", r"\s*\d+\s*/\s*\d+\s*$", "")
    last = F.regexp_extract("text", r"(\S+)\s*$", 1)
    able = ((ratio <= TOP) | (ratio >= BOTTOM)) & (F.length("text") < 90) & last.rlike(PAGE_NUMBER)
    known = repeats.select(F.col("doc_id").alias("_d"), F.col("key").alias("_k")).distinct()
    return lines.join(known, able & (F.col("doc_id") == F.col("_d")) & (norm_key(shorter) == F.col("_k")), "left_anti")


def tables_outside_diagrams(tables: DataFrame, diagrams: DataFrame, share: float = 0.6) -> DataFrame:
    """tables (doc_id, page, x0, y0, x1, y1) of which no diagram of their page covers more than `share`."""
    d = diagrams.select("doc_id", "page", *[F.col(c).alias(f"_{c}") for c in ("x0", "y0", "x1", "y1")])
    wide = F.least(tables["x1"], d["_x1"]) - F.greatest(tables["x0"], d["_x0"])
    high = F.least(tables["y1"], d["_y1"]) - F.greatest(tables["y0"], d["_y0"])
    area = (tables["x1"] - tables["x0"]) * (tables["y1"] - tables["y0"])
    covered = (wide > 0) & (high > 0) & (wide * high > area * share)
    return tables.join(d, (tables["doc_id"] == d["doc_id"]) & (tables["page"] == d["page"]) & covered, "left_anti")


def flow(texts: DataFrame, tables: DataFrame, figures: DataFrame) -> DataFrame:
    """(doc_id, page, y, kind, text, block_no): text, tables and figures (doc_id, page, y, text) of each page from top to bottom; at one
    height text stands before tables and these before figures, each as they came (ord)."""
    rows = [f.select("doc_id", "page", "y", F.lit(k).alias("src"), F.lit(kind).alias("kind"), "ord", "text") for k, (kind, f) in enumerate((("para", texts), ("table", tables), ("figure", figures)))]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    no = F.row_number().over(W.partitionBy("doc_id").orderBy("page", "y", "src", "ord"))
    return every.select("doc_id", "page", "y", "kind", "text", no.cast("long").alias("block_no"))
