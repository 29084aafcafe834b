"""Spans of a line to its text and style, as windows and aggregates keyed by line.

Spans are (line_id, no, text, size, bold, x0, x1), no giving their order in the line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_text

REF_MARK = r"^(\d{1,3}([,;]\s*\d{1,3})*|[*†‡§¶]{1,3})$"
GAP = 1.5
BOLD_SHARE = 0.6


def is_ref_mark(text: Column, size: Column, main: Column) -> Column:
    """A small span of numbers or signs: the mark of a footnote."""
    return (size <= main - 1.5) & F.trim(text).rlike(REF_MARK)


def dominant_sizes(spans: DataFrame) -> DataFrame:
    """(line_id, main): the size that most characters of the line have, the first seen of several; 0 for blank lines."""
    n = F.length(F.trim("text"))
    sizes = spans.filter(n > 0).groupBy("line_id", F.round("size", 1).alias("size")).agg(F.sum(n).alias("n"), F.min("no").alias("first"))
    best = sizes.groupBy("line_id").agg(F.max_by("size", F.struct("n", -F.col("first"))).alias("main"))
    return spans.select("line_id").distinct().join(best, "line_id", "left").select("line_id", F.coalesce("main", F.lit(0.0)).alias("main"))


def with_marks(spans: DataFrame) -> DataFrame:
    """spans with main and mark, whether each is a reference mark."""
    return spans.join(dominant_sizes(spans), "line_id").withColumn("mark", is_ref_mark(F.col("text"), F.col("size"), F.col("main")))


def line_texts(spans: DataFrame) -> DataFrame:
    """(line_id, text, ref_start): the line's text without reference marks; a gap between spans is a blank, but none stands where a
    mark has stood. ref_start: the first span that isn't blank is a mark."""
    order = W.partitionBy("line_id").orderBy("no")
    marked = with_marks(spans).filter("text <> ''")
    before = marked.withColumns({"_end": F.lag("x1").over(order), "_after": F.lag("mark").over(order)})
    part = F.when(F.col("_after"), F.ltrim("text")).when(F.col("x0") - F.col("_end") > GAP, F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    held = before.groupBy("line_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("mark"), F.struct("no", part.alias("p"))))), lambda s: s["p"]), "").alias("text"),
        F.coalesce(F.min_by("mark", F.when(F.trim("text") != "", F.col("no"))), F.lit(False)).alias("ref_start"),
    )
    return held.select("line_id", clean_text(F.col("text")).alias("text"), "ref_start")


def line_styles(spans: DataFrame) -> DataFrame:
    """(line_id, size, bold): the greatest size, and whether most characters are bold."""
    n = F.length(F.trim("text"))
    sums = spans.groupBy("line_id").agg(F.max("size").alias("size"), F.sum(F.when(F.col("bold"), n).otherwise(0)).alias("b"), F.sum(n).alias("n"))
    return sums.select("line_id", "size", ((F.col("n") > 0) & (F.col("b") >= F.col("n") * BOLD_SHARE)).alias("bold"))
