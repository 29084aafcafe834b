"""Mixing sources to target weights by pivotal dependent rounding, in DataFrame functions only.

A source's target is its share of the mix, filled up to a limit of so many times its size. Every document would be taken
target / size of its source times: the whole part for certain, the fraction by dependent rounding. Two documents with
fractions duel: words are moved from one to the other, in the direction that a hash decides with the odds that keep each
one's expectation, until one of the two is whole. The sum of taken words of the two stays as it is. Duels run inside blocks
of about `FAN_IN` documents of a source; each block leaves at most one fraction, and the blocks' residuals meet in blocks of the
next level, until one is left for each source. A source's taken words thus differ from its target by less than
one document. The tree's levels grow with the logarithm of the largest source; no block grows with it.

Defined results: sources are ordered by code point, null last, and weigh 3, 1, 2, repeating; null and blank texts have
size 0 and are taken 0 words (their copies are as their rate says); rows with the same doc_id, source and size are numbered
and duel each for itself, so that their copies may differ by one; everything depends on those columns and numbers only, so
reruns agree; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import count_words, table, written

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
LIMIT = 2.0
FAN_IN = 64
SALTS = 32
REPEATS = 10_000


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, limit: float = LIMIT) -> DataFrame:
    """(source, source_size, target) of (source, source_size): the budget dealt by weight, none above limit times its
    size, the excess dealt again by weight. One row per source goes through one task."""
    ranked = W.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    w = sizes.withColumn("no", F.row_number().over(ranked)).withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("no") - 1, F.lit(len(weights))) + 1).cast("int")))
    w = w.withColumn("cap", F.col("source_size") * F.lit(float(limit)))
    filled = W.orderBy(F.col("cap") / F.col("weight"), "no")
    all_ = W.partitionBy()
    w = w.withColumn("total", F.sum("source_size").over(all_) * F.lit(float(budget)))
    w = w.withColumn("cap_before", F.coalesce(F.sum("cap").over(filled.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    w = w.withColumn("weight_left", F.sum("weight").over(filled.rowsBetween(0, W.unboundedFollowing)))
    # the sources before the first one that its share doesn't fill are at their limit
    w = w.withColumn("level", (F.col("total") - F.col("cap_before")) / F.col("weight_left"))
    level = F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("no_filled", "level"))).over(all_)["level"]
    w = w.withColumn("no_filled", F.row_number().over(filled)).withColumn("final", level)
    return w.select("source", "source_size", F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap"))).alias("target"))


def _duels(items: DataFrame) -> DataFrame:
    """(source, block, left, done) of (source, block, items): the fraction a block leaves and what it settled."""
    uniform = lambda a, b: (F.pmod(F.xxhash64(a["doc_id"], a["size"], a["no"], b["doc_id"], b["size"], b["no"], F.lit("duel")), F.lit(1 << 53)) / F.lit(float(1 << 53)))
    whole = lambda s, x: s.withField("x", F.lit(float(x)))

    def duel(acc, s):
        c = acc["left"]
        a, b = c["words"], s["words"]
        x, y = c["x"], s["x"]
        up = F.least(a * (1 - x), b * y)  # words that c may gain
        down = F.least(a * x, b * (1 - y))
        gain = uniform(c, s) * (up + down) < down
        # what becomes whole is set to it, so that rounding errors end there
        c_up, s_up = a * (1 - x) <= b * y, b * (1 - y) <= a * x
        settled = F.when(gain, F.when(c_up, whole(c, 1)).otherwise(whole(s, 0))).otherwise(F.when(s_up, whole(s, 1)).otherwise(whole(c, 0)))
        going = F.when(gain, F.when(c_up, s.withField("x", y - a * (1 - x) / b)).otherwise(c.withField("x", x + b * y / a))).otherwise(F.when(s_up, c.withField("x", x - b * (1 - y) / a)).otherwise(s.withField("x", y + a * x / b)))
        return F.struct(going.alias("left"), F.concat(acc["done"], F.array(settled)).alias("done"))

    first = F.element_at("items", 1)
    begin = F.struct(first.alias("left"), F.slice("items", 1, 0).alias("done"))
    rest = F.slice("items", F.lit(2), F.size("items"))
    return items.withColumn("r", F.aggregate(rest, begin, duel)).select("source", "block", "r.left", "r.done")


def pivotal(units: DataFrame, largest: int, fan_in: int = FAN_IN) -> DataFrame:
    """(doc_id, source, size, no, whole, x) of (doc_id, source, size, no, words, whole, x): every x becomes 0 or 1. largest is the number
    of units of the largest source; words are what a unit weighs in the sums that are kept."""
    names = ["doc_id", "source", "size", "no", "whole", "x"]
    item = F.struct("doc_id", "size", "no", "words", "whole", "x").alias("item")
    fractions = units.filter("words > 0 AND x > 0 AND x < 1")
    out = units.filter("NOT (words > 0 AND x > 0 AND x < 1)").withColumn("x", F.when(F.col("words") > 0, F.col("x")).otherwise(F.lit(0.0))).select(names)
    level, blocks = fractions.select("source", F.xxhash64("doc_id", "size", "no", F.lit("block")).alias("h"), item), max(1, math.ceil(largest / fan_in))
    while True:
        dealt = level.select("source", F.pmod("h", F.lit(blocks)).alias("block"), "item").groupBy("source", "block").agg(F.sort_array(F.collect_list("item")).alias("items"))
        met = written(_duels(dealt), name="duels")
        out = out.unionByName(met.select("source", F.explode("done").alias("s")).select("source", "s.*").select(names))
        if blocks == 1:
            last = met.select("source", "left.*")
            coin = F.pmod(F.xxhash64("doc_id", "size", "no", F.lit("last")), F.lit(1 << 53)) / F.lit(float(1 << 53))
            return out.unionByName(last.withColumn("x", F.when(coin < F.col("x"), 1.0).otherwise(0.0)).select(names))
        level, blocks = met.select("source", F.col("block").alias("h"), F.col("left").alias("item")), math.ceil(blocks / fan_in)


def numbered(units: DataFrame) -> DataFrame:
    """(doc_id, source, size, no): units (doc_id, source, size, rows) as many times as they occur, with a number from 1; those that
    occur very often are dealt to several tasks before they are written out."""
    once = units.filter("rows = 1").select("doc_id", "source", "size", F.lit(1).cast("long").alias("no"))
    part = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / REPEATS))).alias("part")
    more = units.filter("rows > 1").select("*", part).repartition("doc_id", "source", "size", "part")
    first = F.col("part") * REPEATS
    return once.unionByName(more.select("doc_id", "source", "size", F.explode(F.sequence(first + 1, F.least(first + REPEATS, F.col("rows")))).alias("no")))


def mix(docs: DataFrame, id_col="doc_id", source_col="source", text_col="text", weights=WEIGHTS, budget: float = BUDGET, limit: float = LIMIT) -> DataFrame:
    """One row per document: doc_id, source, size, no, source_size, target, copies, taken; no numbers the rows of one doc_id, source and size."""
    units = written(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(F.col(text_col)).alias("size")).groupBy("doc_id", "source", "size").agg(F.count("*").alias("rows")), name="units"
    )
    sources = units.groupBy("source").agg(F.sum(F.col("size") * F.col("rows")).alias("source_size"), F.sum("rows").alias("n"))
    sources = written(sources, name="sources")
    largest = sources.agg(F.max("n")).first()[0] or 0
    goal = written(targets(sources.select("source", "source_size"), weights, budget, limit), name="targets")
    # a row for each source and salt: no source's documents meet in one task, however many it has
    salted = goal.select(F.col("source").alias("of"), "source_size", "target", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))

    def with_goal(rows: DataFrame) -> DataFrame:
        dealt = rows.withColumn("salt_", F.pmod(F.xxhash64("doc_id", "no"), F.lit(SALTS)).cast("int"))
        return dealt.join(salted, (F.col("salt_") == F.col("salt")) & F.col("source").eqNullSafe(F.col("of")))

    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rated = with_goal(numbered(units)).withColumn("rate", rate).select("doc_id", "source", "size", "no", F.col("size").cast("double").alias("words"), F.floor("rate").alias("whole"), (F.col("rate") - F.floor("rate")).alias("x"))
    settled = pivotal(rated, largest).select("doc_id", "source", "size", "no", (F.col("whole") + F.col("x").cast("long")).alias("copies"))
    return with_goal(settled).select("doc_id", "source", "size", "no", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    """All documents, mixed to 150 % of their words."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mix_targets(spark, sf_dir: str) -> DataFrame:
    """The words and the target of every source, to a thousandth."""
    sizes = table(spark, sf_dir, "documents").groupBy("source").agg(F.sum(count_words(F.col("text"))).alias("source_size"))
    return targets(sizes).select("source", "source_size", F.round("target", 3).alias("target"))


TARGETS_SQL = r"""
WITH s AS (
  SELECT source, CAST(sum(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)) AS BIGINT) AS source_size FROM documents GROUP BY source
), w AS (
  SELECT *, [3, 1, 2][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM s
), f AS (SELECT *, 2.0 * source_size / weight AS full_at FROM w),
level AS (
  -- the level to which all sources are filled: the shares below it and the limits above it make up 150 %
  SELECT arg_min(l, full_at) AS l FROM (
    SELECT a.full_at, (1.5 * (SELECT sum(source_size) FROM w) - coalesce(sum(CASE WHEN b.full_at < a.full_at THEN 2.0 * b.source_size END), 0)) / sum(CASE WHEN b.full_at >= a.full_at THEN b.weight END) AS l
    FROM f a CROSS JOIN f b GROUP BY a.source, a.full_at
  ) WHERE l <= full_at
)
SELECT source, source_size, round(CAST(least(2.0 * source_size, coalesce((SELECT l FROM level) * weight, 2.0 * source_size)) AS DOUBLE), 3) AS target FROM f
"""
