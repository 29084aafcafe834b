"""Document warnings, the run's summary and the preview, as aggregates and windows over chunks and sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SCAN_SHARE, ORPHAN_SHARE, MAX_TREE_DEPTH = 0.8, 0.3, 6


def scanned_warning(pages_total: Column, pages_without_text: Column) -> Column:
    """The warning of a document that is a scan; empty otherwise."""
    scan = (pages_total > 0) & (pages_without_text >= pages_total * SCAN_SHARE)
    return F.when(scan, F.concat(pages_without_text.cast("string"), F.lit("/"), pages_total.cast("string"), F.lit(" pages have no text layer: a scan"))).otherwise("")


def text_pages(lines: DataFrame, least: int = 40) -> DataFrame:
    """(doc_id, pages_total, pages_without_text): pages with fewer than `least` characters have no text."""
    pages = lines.groupBy("doc_id", "page").agg(F.sum(F.length(F.trim("text"))).alias("n"))
    return pages.groupBy("doc_id").agg(F.count("*").alias("pages_total"), F.count_if(F.col("n") < least).alias("pages_without_text"))


def document_warnings(figures: DataFrame) -> DataFrame:
    """(doc_id, warnings) of (doc_id, pages_total, pages_without_text, n_chunks, orphans, too_long, lower_titles, truncated, depth)."""
    say = lambda c, text: F.when(c, F.concat(*[x if isinstance(x, Column) else F.lit(x) for x in text]))
    n = lambda name: F.col(name).cast("string")
    scan = scanned_warning(F.col("pages_total"), F.col("pages_without_text"))
    rules = F.array(
        F.when(scan != "", scan),
        say(F.col("n_chunks") == 0, ["no chunks were produced"]),
        say((F.col("n_chunks") > 0) & (F.col("orphans") > F.col("n_chunks") * ORPHAN_SHARE), [n("orphans"), "/", n("n_chunks"), " chunks have no section"]),
        say(F.col("too_long") > 0, [n("too_long"), " chunks are over the token ceiling"]),
        say(F.col("lower_titles") > 0, [n("lower_titles"), " section names begin in lower case"]),
        say(F.col("truncated") > 0, [n("truncated"), " lines look truncated"]),
        say(F.col("depth") > MAX_TREE_DEPTH, ["the outline is ", n("depth"), " levels deep"]),
    )
    return figures.select("doc_id", F.filter(rules, lambda w: w.isNotNull()).alias("warnings"))


def report_lines(report: DataFrame) -> DataFrame:
    """(doc_id, report): a report of n_chunks, n_pages, min_chars, max_chars, median_tokens, max_tokens as text."""
    made = F.format_string("%d chunks on %d pages, %d to %d characters, %.1f tokens in the middle, %d at most", "n_chunks", "n_pages", "min_chars", "max_chars", F.col("median_tokens").cast("double"), "max_tokens")
    return report.select("doc_id", made.alias("report"))


def run_summary(report: DataFrame) -> DataFrame:
    """One row over all documents of (doc_id, n_chunks, error): totals, and the exit code: 1 for failures without any chunk."""
    sums = report.agg(F.count("*").alias("documents"), F.coalesce(F.sum("n_chunks"), F.lit(0)).alias("chunks"), F.count_if(F.col("error").isNotNull()).alias("failures"))
    return sums.withColumn("exit_code", F.when((F.col("failures") > 0) & (F.col("chunks") == 0), 1).otherwise(0))


def preview(chunks: DataFrame, n: int, doc="doc_id", order="idx", text="text", width: int = 300) -> DataFrame:
    """The first n chunks of each document, their texts cut to width: a report on purpose."""
    first = F.row_number().over(W.partitionBy(doc).orderBy(order))
    return chunks.withColumn("_no", first).filter(F.col("_no") <= n).drop("_no").withColumn(text, F.left(text, F.lit(width)))


def page_source(paragraphs: DataFrame) -> DataFrame:
    """(doc_id, page_source) of (doc_id, rendered_breaks, page_breaks): where the page numbers come from."""
    sums = paragraphs.groupBy("doc_id").agg(F.sum("rendered_breaks").alias("r"), F.sum("page_breaks").alias("b"))
    return sums.select("doc_id", F.when(F.col("r") > 0, "rendered").when(F.col("b") > 0, "page_break").otherwise("estimated").alias("page_source"))
