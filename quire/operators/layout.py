"""The rebuilt layout: a document's items in order, what must share a page, and the markup to print."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import folds
from ..functions import layout as ly
from ..functions.text import markdown_rows
from .documents import folded

ITEMS = "doc_id string, page int, item_no long, section_no int, part_index int, part_total int, kind string, text string, level int, size double, height double, width double, caption string"
BULLET = r"^\s*([-–—•+*]|\(?[a-zđ]\)|\(?[ivx]+\)|\d+[.)])\s+"
CONTENT_WIDTH, EMPTY_PAGE = 470.0, 15


def layout(blocks: DataFrame, cfg: folds.ChunkConfig | None = None, title: str = "", by_section: bool = False, lines_per_page: int = ly.LINES_PER_PAGE, drop_cover: bool = True) -> DataFrame:
    """The items of detected blocks, in one flow or with pages of one section each. One task lays out one document."""
    cfg = cfg or folds.ChunkConfig()

    def run(doc: object, sections: list[folds.Section]) -> Iterator[tuple]:
        placed = ly.laid_out(sections, lines_per_page, cfg.max_tokens, drop_cover, by_section, title)
        return ((doc, p.page, k, p.section, p.part, p.parts, p.item.kind, p.item.text, p.item.level, p.item.size, p.item.height, p.item.width, p.item.caption) for k, p in enumerate(placed))

    return folded(blocks, run, cfg, ITEMS)


def item_lines(kind: Column, text: Column, size: Column, height: Column) -> Column:
    """The lines that an item takes on the page."""
    rows = F.split(text, "\n")
    total = lambda xs, wide: F.aggregate(xs, F.lit(0).cast("long"), lambda n, r: n + F.greatest(F.lit(1), F.ceil(F.length(r) / wide)))
    figure = F.when(F.coalesce(height, F.lit(0.0)) == 0, F.lit(3)).otherwise(F.greatest(F.lit(2), F.ceil(height / ly.POINTS_PER_LINE) + 1))
    table = total(F.filter(rows, lambda r: r.rlike(r"(?U)\S")), F.lit(float(ly.CHARS_PER_LINE))) + 1
    return F.when(kind == "figure", figure).when(kind == "table", table).otherwise(total(rows, ly.CHARS_PER_LINE * ly.BODY_PT / size) + (kind == "heading").cast("int")).cast("long")


def keep_together(items: DataFrame) -> DataFrame:
    """items with group_no and heads: headings in a row share a page with the first content below them."""
    w = W.partitionBy("doc_id").orderBy("item_no")
    closed = F.coalesce(F.lag("kind").over(w) != "heading", F.lit(True))
    g = items.withColumn("group_no", F.sum(closed.cast("int")).over(w))
    return g.withColumn("heads", F.count_if(F.col("kind") == "heading").over(W.partitionBy("doc_id", "group_no")))


def group_heights(items: DataFrame) -> DataFrame:
    """(doc_id, group_no, height): the height that a group's figures need."""
    return items.groupBy("doc_id", "group_no").agg(F.coalesce(F.max(F.when(F.col("kind") == "figure", F.col("height"))), F.lit(0.0)).alias("height"))


def stranded_pages(lines: DataFrame, images: DataFrame) -> DataFrame:
    """(doc_id, page) of the printed pages, but for a document's last, that end on a line (line_no, bottom, size) of heading size
    with no image (bottom) below it."""
    pages = lines.filter("size > 0").groupBy("doc_id", "page").agg(F.max("bottom").alias("bottom"), F.max_by("size", F.struct("bottom", -F.col("line_no"))).alias("size"))
    last = lines.groupBy("doc_id").agg(F.max("page").alias("last"))
    low = images.groupBy("doc_id", "page").agg(F.max("bottom").alias("image"))
    ends = pages.join(last, "doc_id").join(low, ["doc_id", "page"], "left")
    return ends.filter((F.col("page") < F.col("last")) & (F.col("size") > ly.BODY_PT + 0.4) & ~(F.coalesce("image", F.lit(0.0)) > F.col("bottom"))).select("doc_id", "page")


def blank_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, page) of pages (doc_id, page, text, images: array<struct<width, height>>, drawings) with nothing to keep; images of
    one dot are removed ones."""
    seen = F.exists(F.coalesce("images", F.array().cast("array<struct<width:int,height:int>>")), lambda i: (i["width"] > 1) & (i["height"] > 1))
    bare = F.regexp_replace(F.coalesce("text", F.lit("")), r"(?U)^\s+|\s+$", "")
    return pages.filter((F.length(bare) < EMPTY_PAGE) & ~seen & (F.coalesce("drawings", F.lit(0)) == 0)).select("doc_id", "page")


def escaped(c: Column) -> Column:
    for sign, made in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(sign), F.lit(made))
    return c


def table_html(md: Column) -> Column:
    """A markdown table as HTML, its first row as head; empty for what is no table."""
    cell = lambda tag: lambda c: F.concat(F.lit(f"<{tag}>"), escaped(c), F.lit(f"</{tag}>"))
    row = lambda r, k: F.concat(F.lit("<tr>"), F.array_join(F.when(k == 0, F.transform(r, cell("th"))).otherwise(F.transform(r, cell("td"))), ""), F.lit("</tr>"))
    rows = markdown_rows(md)
    return F.when(F.size(rows) == 0, "").otherwise(F.concat(F.lit("<table>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>")))


def item_html(kind: Column, text: Column, level: Column, size: Column) -> Column:
    """An item's markup; figures show their placeholder, as their files are outside."""
    tag = F.greatest(F.lit(1), F.least(level, F.lit(5))).cast("string")
    style = F.concat(F.lit("font-size: "), size.cast("string"), F.lit("px"), F.when(level <= 0, "; text-align: center").otherwise(""))
    heading = F.concat(F.lit("<h"), tag, F.lit(' style="'), style, F.lit('">'), escaped(text), F.lit("</h"), tag, F.lit(">"))
    plain = F.concat(F.lit("<p>"), escaped(text), F.lit("</p>"))
    table = table_html(text)
    shown = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"(?U)\S"))
    line = lambda x: F.concat(F.when(x.rlike(BULLET), '<p class="li">').otherwise("<p>"), escaped(F.regexp_replace(x, r"(?U)^\s+|\s+$", "")), F.lit("</p>"))
    return (
        F.when(kind == "heading", heading)
        .when(kind == "table", F.when(table != "", table).otherwise(plain))
        .when(kind == "figure", F.concat(F.lit('<p class="fig">'), escaped(text), F.lit("</p>")))
        .otherwise(F.array_join(F.transform(shown, line), ""))
    )


def page_html(items: DataFrame) -> DataFrame:
    """(doc_id, page, html): each page's items in order."""
    made = items.withColumn("_h", F.struct("item_no", item_html(F.col("kind"), F.col("text"), F.col("level"), F.col("size")).alias("h")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list("_h")), lambda x: x["h"]), "")
    return made.groupBy("doc_id", "page").agg(whole.alias("html")).withColumn("html", F.when(F.col("html") == "", "<p></p>").otherwise(F.col("html")))


def rebuilt(items: DataFrame, lines_per_page: int = ly.LINES_PER_PAGE) -> DataFrame:
    """(doc_id, pages_out, sections_out, figures_kept): of a flow, the pages are estimated from its lines."""
    n = item_lines(F.col("kind"), F.col("text"), F.col("size"), F.col("height"))
    sums = items.withColumn("_n", n).groupBy("doc_id").agg(F.max("page").alias("p"), F.sum("_n").alias("n"), F.count_if(F.col("kind") == "figure").alias("figures_kept"), F.count_distinct(F.when((F.col("kind") == "heading") & (F.col("level") > 0), F.col("section_no"))).alias("sections_out"))
    return sums.select("doc_id", F.when(F.col("p") > 1, F.col("p")).otherwise(F.greatest(F.lit(1), F.ceil(F.col("n") / lines_per_page))).cast("long").alias("pages_out"), "sections_out", "figures_kept")
