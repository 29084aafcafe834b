"""Boilerplate lines by their spread over distinct sites.

Lines are trimmed and hashed. For each line hash a HyperLogLog sketch of its sites is built by aggregation (partial sketches
merge, so a line that fills a third of the table is no hot group). Lines whose estimated spread is near the threshold, within
`MARGIN` of it, get an exact distinct count; only those are shuffled by (line, site). Lines on at least `min_sites`
sites are boilerplate and are removed from every document; the other lines stay in their order.

Defined results: lines are parts between newlines; blank lines are never boilerplate and stay; null text has no lines and
stays null; a null site counts as a site of its own; rows that repeat a doc_id are cleaned each by its own text; columns named
like the added ones are replaced, others stay; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table, written

MIN_SITES = 5
PRECISION = 12
#: Six standard errors of a sketch of that precision.
MARGIN = 6 * 1.04 / 2 ** (PRECISION / 2)


def site_spread(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """(line, sites): the line hashes on min_sites sites or more; lines is (line, site)."""
    spread = written(lines.groupBy("line").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(PRECISION))).alias("sites")).filter(F.col("sites") >= max(2, min_sites * (1 - MARGIN) - 1)), name="spread")
    sure = spread.filter(F.col("sites") > min_sites * (1 + MARGIN) + 1)
    near = spread.filter(F.col("sites") <= min_sites * (1 + MARGIN) + 1).select("line")
    # a set of sites of near-threshold lines is bounded by the threshold and its margin
    exact = lines.join(near, "line", "left_semi").distinct().groupBy("line").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return sure.unionByName(exact)


def line_key(line: Column) -> Column:
    """96 bits of a trimmed line."""
    return F.struct(F.xxhash64(F.trim(line)).alias("a"), F.hash(F.trim(line)).alias("b"))


def remove_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, text_col: str = "text", site_col: str = "source") -> DataFrame:
    """docs with text_col cleaned, and n_lines, n_removed."""
    docs = docs.drop("n_lines", "n_removed")
    site = F.coalesce(F.concat(F.lit("s"), F.col(site_col).cast("string")), F.lit("-"))
    parts = F.split(F.col("text"), "\n", -1)
    # a document's own columns travel in one struct, where no name of theirs can clash
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), site.alias("site"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.length(text_col).alias("n"))
    each = rows.filter("text IS NOT NULL").select("site", F.explode(parts).alias("l")).filter(F.trim("l") != "").select("site", line_key(F.col("l")).alias("line"))
    bad = written(site_spread(each, min_sites).select("line"), name="boilerplate")
    marked = rows.select("h", "n", F.explode(parts).alias("l")).filter(F.trim("l") != "").select("h", "n", line_key(F.col("l")).alias("line"))
    # written, so that the join below shuffles both sides itself and a text with many copies can be split
    hit = written(marked.join(bad, "line", "left_semi").groupBy(F.col("h").alias("of"), F.col("n").alias("of_n")).agg(F.collect_set("line").alias("bad")), name="hits")
    joined = rows.drop("site").join(hit, (F.col("h") == F.col("of")) & (F.col("n") == F.col("of_n")), "left")
    stay = F.filter(parts, lambda x: ~F.array_contains("bad", line_key(x)))
    cleaned = F.when(F.col("bad").isNull(), F.col("text")).otherwise(F.array_join(stay, "\n"))
    out = F.struct(
        *[cleaned.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns],
        F.greatest(F.coalesce(F.size(parts), F.lit(0)), F.lit(0)).cast("long").alias("n_lines"),
        F.when(F.col("bad").isNull(), 0).otherwise(F.size(parts) - F.size(stay)).cast("long").alias("n_removed"),
    )
    return joined.select(out.alias("out")).select("out.*")


def op8_line_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without the lines that are on five sources or more."""
    found = remove_boilerplate(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return found.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("clean_chars"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("clean_sha256"))


SQL = r"""
WITH l AS (
  SELECT doc_id, source, u.i AS i, u.s AS l FROM documents, unnest(string_split(text, chr(10))) WITH ORDINALITY AS u(s, i)
), bad AS (SELECT trim(l, ' ') AS t FROM l WHERE trim(l, ' ') <> '' GROUP BY 1 HAVING count(DISTINCT coalesce('s' || source, '-')) >= 5),
m AS (SELECT l.doc_id, l.i, l.l, b.t IS NOT NULL AS gone FROM l LEFT JOIN bad b ON trim(l.l, ' ') = b.t)
SELECT d.doc_id, coalesce(count(m.i), 0) AS n_lines, CAST(coalesce(sum(CASE WHEN gone THEN 1 ELSE 0 END), 0) AS BIGINT) AS n_removed,
  CAST(CASE WHEN any_value(d.text) IS NULL THEN NULL ELSE length(coalesce(string_agg(m.l, chr(10) ORDER BY m.i) FILTER (NOT gone), '')) END AS BIGINT) AS clean_chars,
  sha256(coalesce(string_agg(m.l, chr(10) ORDER BY m.i) FILTER (NOT gone), '')) AS clean_sha256
FROM documents d LEFT JOIN m USING (doc_id) GROUP BY d.doc_id
"""
