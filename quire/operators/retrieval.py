"""Context of chunks at query time, as windows and joins keyed by document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(chunks: DataFrame, doc="doc_id", order="idx", path="section_path") -> DataFrame:
    """chunks with run, run_pos and run_size: the stretches of one path in a document."""
    w = W.partitionBy(doc).orderBy(order)
    opens = F.when(F.lag(path).over(w) == F.col(path), 0).otherwise(1)
    marked = chunks.withColumn("_opens", opens).withColumn("run", F.sum("_opens").over(w)).drop("_opens")
    r = W.partitionBy(doc, "run")
    return marked.withColumns({"run_pos": F.row_number().over(r.orderBy(order)), "run_size": F.count("*").over(r)})


def expand_sections(chunks: DataFrame, max_parts: int = 6, doc="doc_id", order="idx", path="section_path", text="raw_text") -> DataFrame:
    """Each chunk with the text of its section around it: parts before it first, then after it, max_parts in all."""
    w = W.partitionBy(doc, "run").orderBy(order)
    r = runs(chunks, doc, order, path)
    near = F.collect_list(text).over(w.rowsBetween(-(max_parts - 1), max_parts - 1))
    back = F.least(F.col("run_pos") - 1, F.lit(max_parts - 1))
    ahead = F.least(F.col("run_size") - F.col("run_pos"), F.lit(max_parts - 1) - back)
    return r.withColumns({"_near": near, "n_parts": (back + ahead + 1).cast("long")}).withColumn("expanded", F.array_join(F.slice("_near", F.lit(1), F.col("n_parts").cast("int")), "\n")).drop("_near", "run", "run_pos", "run_size")


def neighbours(chunks: DataFrame, window: int = 1, doc="doc_id", order="idx", item="chunk_id") -> DataFrame:
    """Each chunk with the ids of those at most `window` before and after it."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(-window, window)
    return chunks.withColumn("neighbours", F.collect_list(item).over(w))


def link(chunks: DataFrame, doc="doc_id", order="idx", item="chunk_id") -> DataFrame:
    w = W.partitionBy(doc).orderBy(order)
    return chunks.withColumns({"prev_chunk_id": F.lag(item).over(w), "next_chunk_id": F.lead(item).over(w)})


def parts(chunks: DataFrame, doc="doc_id", order="idx", path="section_path") -> DataFrame:
    """part_index and part_total by path, and whether a chunk goes on from the last or into the next."""
    w, whole = W.partitionBy(doc).orderBy(order), W.partitionBy(doc, path)
    same = lambda other: F.coalesce(other == F.col(path), F.lit(False))
    return chunks.withColumns({"part_index": F.row_number().over(whole.orderBy(order)).cast("long"), "part_total": F.count("*").over(whole), "is_continuation": same(F.lag(path).over(w)), "is_continued": same(F.lead(path).over(w))})


def outline_text(sections: DataFrame) -> DataFrame:
    """(doc_id, outline): the indented tree of sections (doc_id, section_no, level, number, title)."""
    line = F.concat(F.repeat(F.lit("   "), F.col("level")), F.lit("L"), F.col("level").cast("string"), F.lit(" "), F.concat_ws(" ", F.when(F.col("number") != "", F.col("number")), "title"))
    return sections.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("section_no", line.alias("l")))), lambda s: s["l"]), "\n").alias("outline"))
