r"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

Items are cut into windows of ten consecutive words (a shorter item is one window). Words are ordered by rarity, counted
over all documents. Containment of a window asks for every one of its words, so its necessary prefix is its rarest word
alone: only document words that are some window's prefix are joined. The position of that word in its window bounds where
the window would begin (positional filter) and whether it fits into the document (length filter); what is left is verified
word by word. The join's build side is the distinct windows of the benchmark; it is broadcast where their counted number
is at most `BROADCAST_WINDOWS` and their counted bytes `BROADCAST_BYTES`. Otherwise it is shuffled: document words whose hash is none of a
prefix word go first, by a set of `FILTER` numbers at most, the others are shuffled with only a window's surroundings.

Defined results: null text has no words; an item without words has no window; a null item_id counts as the empty string;
repeated items and windows count once; rows that repeat a doc_id are judged by their own text; other columns play no part;
an empty table of documents gives no rows, and an empty benchmark hits nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lower_ascii, table, written

WINDOW = 10
SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BROADCAST_WINDOWS, BROADCAST_BYTES = 200_000, 64 << 20
FILTER = 1 << 20


def parts_of(text: Column) -> Column:
    """The words of the text, with an empty part before or after them where the text begins or ends with other characters.
    Words are maximal runs of letters a-z after lower-casing A-Z, digits and non-ASCII characters."""
    return F.split(lower_ascii(F.coalesce(text, F.lit(""))), SPLIT)


def words_of(text: Column) -> Column:
    return F.array_remove(parts_of(text), "")


def count_parts(parts: Column) -> Column:
    """The number of words among the parts."""
    first = F.when(F.element_at(parts, 1) == "", 1).otherwise(0)
    last = F.when((F.size(parts) > 1) & (F.element_at(parts, -1) == ""), 1).otherwise(0)
    return (F.size(parts) - first - last).cast("long")


def item_windows(items: DataFrame, item_col="item_id", text_col="text") -> DataFrame:
    """(window, n, items): the distinct windows, their lengths and the items that hold them."""
    w = items.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item_id"), words_of(F.col(text_col)).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - (WINDOW - 1), F.lit(1)))
    return w.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, WINDOW))).alias("window")).groupBy("window").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("n", F.size("window"))


def prefixes(windows: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, at, window, n, items): each window under its rarest word; at is that word's position in it, from 0."""
    each = windows.select("window", "n", "items", F.posexplode("window").alias("at", "word")).join(counts, "word", "left")
    rarest = F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "word", "at")).alias("p")
    return each.groupBy("window").agg(F.first("n").alias("n"), F.first("items").alias("items"), rarest).select(F.col("p.word").alias("word"), F.col("p.at").alias("at"), "window", "n", "items")


def find_windows(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text") -> tuple[DataFrame, DataFrame]:
    """(documents, occurrences): (doc_id, h, n_words) of every row, h naming its text, and (doc_id, h, start, stop, items)
    of every occurrence of a window, in words from 1, stop exclusive."""
    windows = written(item_windows(items), name="windows")
    size = windows.agg(F.count("*").alias("n"), F.sum(F.octet_length(F.array_join("window", " ")) + F.octet_length(F.array_join("items", " "))).alias("bytes")).first()
    small = size["n"] <= BROADCAST_WINDOWS and (size["bytes"] or 0) <= BROADCAST_BYTES
    hint = F.broadcast if small else lambda df: df
    parts = parts_of(F.col(text_col))
    # every text is split once; the later passes read the words
    split = written(docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("h"), F.explode(F.array(parts)).alias("w")).withColumn("n_words", count_parts(F.col("w"))), name="words")
    vocabulary = windows.select(F.explode("window").alias("word")).distinct()
    counts = split.select(F.explode("w").alias("word")).join(hint(vocabulary), "word").groupBy("word").count()
    index = written(prefixes(windows, hint(counts)), name="prefixes")  # counts has no more words than the vocabulary
    near = split.select("doc_id", "h", "w", F.posexplode("w").alias("pos", "word"))
    if not small:
        # words that are no prefix go before anything is shuffled; there are FILTER keys at most
        keys = index.select(F.pmod(F.xxhash64("word"), F.lit(FILTER)).alias("bucket")).distinct()
        near = near.join(F.broadcast(keys), F.pmod(F.xxhash64("word"), F.lit(FILTER)) == F.col("bucket"), "left_semi")
        low = F.greatest(F.col("pos") + 2 - WINDOW, F.lit(1))
        near = near.select("doc_id", "h", "pos", "word", F.slice("w", low, 2 * WINDOW - 1).alias("around"), low.alias("low"))
        part = lambda start, n: F.slice("around", start - F.col("low") + 1, n)
        fits = lambda start: start >= 1
    else:
        part = lambda start, n: F.slice("w", start, n)
        fits = lambda start: (start >= 1) & (start + F.col("n") - 1 <= F.size("w"))
    start = F.col("pos") + 1 - F.col("at")
    found = near.join(hint(index), "word").filter(fits(start))
    found = found.filter(F.when(start >= 1, part(start, F.col("n"))) == F.col("window"))
    return split.select("doc_id", "h", "n_words"), found.select("doc_id", "h", start.alias("start"), (start + F.col("n")).alias("stop"), "items")


def contaminated(docs: DataFrame, items: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated; h names its text."""
    rows, found = find_windows(docs, items, id_col, text_col)
    # hits are gathered by document: at most one start for each of its words
    spans = found.groupBy("doc_id", "h", "start").agg(F.max("stop").alias("stop"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    merged = F.aggregate(
        F.sort_array("spans"),
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, s: F.struct(F.greatest(acc["end"], s["stop"]).alias("end"), (acc["n"] + F.greatest(s["stop"] - F.greatest(acc["end"], s["start"]), F.lit(0))).alias("n")),
    )
    hits = spans.groupBy("doc_id", "h").agg(F.collect_list(F.struct("start", "stop")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items")).select(
        F.col("doc_id").alias("of"), F.col("h").alias("of_h"), merged["n"].alias("n_hit"), "items"
    )
    none = F.array().cast("array<string>")
    return rows.join(hits, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left").select(
        "doc_id",
        "h",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(F.coalesce("items", none)).cast("long").alias("n_items"),
        F.sha2(F.array_join(F.coalesce("items", none), ","), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("h")


SQL = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, i, i + 9), ' ') AS win
  FROM iw, unnest(range(1, greatest(len(w) - 8, 2))) AS t(i) WHERE len(w) > 0
), lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS win
  FROM dw, lens, unnest(range(1, len(w) - n + 2)) AS t(i) WHERE len(w) >= n
), m AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM pos p JOIN win v ON p.win = v.win AND p.n = v.n),
h AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(h.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AS contaminated
FROM dw d LEFT JOIN h USING (doc_id) LEFT JOIN it USING (doc_id)
"""
