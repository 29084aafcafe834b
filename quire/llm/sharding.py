"""Sharding by extendible hashing, in DataFrame functions.

A document's key is 60 bits of the MD5 of its doc_id. A bucket is a prefix of the key; a bucket that is above the byte limit
and holds more than one key is split on its next bit, every other bucket is a shard. As a prefix's bytes only shrink with
depth, the shards are the buckets where the chain of oversized prefixes ends, whatever the order of splits, so they come from
one histogram over fine prefixes instead of a loop over single splits. The directory has an entry for each prefix of the
global depth (the deepest shard's) and leads to the shard; a document finds its shard by one lookup. Where a document
alone is above the limit, only its own fine bucket is looked at again, eight bits deeper at a time.

The histogram's fineness follows the total bytes, so its size follows the number of shards, not of documents; the directory
is broadcast where its counted entries are at most `BROADCAST_ENTRIES` and joined by shuffle otherwise.

Defined results: null text has 0 bytes; a null doc_id has the key of the empty string; a document above the limit has a
shard of its own (oversized true); rows that repeat one doc_id can't be parted by any bit of its hash: where they are above the
limit together, the bucket gets overflow pages (shard names ending in .1, .2 ...), in groups of bounded size; no split
drops or caps rows; columns named like the added ones are replaced, others stay; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written

BITS = 60
DEEPER = 8
LIMIT_BYTES = 16 << 20
SMALL_BYTES = 64 << 10
BROADCAST_ENTRIES = 1 << 19
GROUP = 1 << 16
ADDED = ("shard", "shard_depth", "shard_bytes", "shard_docs", "n_bytes", "oversized")


def key_of(c: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit(""))), 1, BITS // 4), 16, 10).cast("long")


def prefix(key: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", key, (F.lit(BITS) - depth).cast("int") if isinstance(depth, Column) else F.lit(BITS - depth))


def _level(rows: DataFrame, base: int, top: int, limit: int) -> tuple[DataFrame, DataFrame]:
    """(shards, open): of the rows' buckets from depth base to top, those that are shards and those of depth top to be split."""
    sums = [F.sum("bytes").alias("bytes"), F.sum("docs").alias("docs"), F.min("k0").alias("k0"), F.max("k1").alias("k1")]
    fine = rows.groupBy(prefix(F.col("key"), top).alias("p")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs"), F.min("key").alias("k0"), F.max("key").alias("k1"))
    depths = F.explode(F.sequence(F.lit(base), F.lit(top))).alias("depth")
    nodes = fine.select("*", depths).withColumn("p", F.call_function("shiftright", F.col("p"), F.lit(top) - F.col("depth"))).groupBy("depth", "p").agg(*sums)
    nodes = written(nodes.withColumn("split", (F.col("bytes") > limit) & (F.col("k0") < F.col("k1"))), name="buckets")
    parents = nodes.filter("split").select((F.col("depth") + 1).alias("depth"), F.col("p").alias("parent"))
    found = nodes.filter("NOT split").withColumn("parent", F.call_function("shiftright", F.col("p"), F.lit(1)))
    shards = found.filter(F.col("depth") == base).drop("parent").unionByName(found.filter(F.col("depth") > base).join(parents, ["depth", "parent"], "left_semi").drop("parent"))
    return shards, nodes.filter((F.col("depth") == top) & F.col("split")).select("p")


def _directory(shards: DataFrame) -> tuple[DataFrame, int]:
    """(entry, shard columns) for each prefix of the global depth, and that depth."""
    shards = written(shards, name="shards")
    depth = shards.agg(F.max("depth")).first()[0] or 0
    wide = F.call_function("shiftleft", F.lit(1).cast("long"), F.lit(depth) - F.col("depth"))
    first = F.call_function("shiftleft", F.col("p"), F.lit(depth) - F.col("depth"))
    name = F.when(F.col("depth") == 0, "-").otherwise(F.lpad(F.bin("p"), F.col("depth"), F.lit("0")))
    entries = shards.select(F.explode(F.sequence(first, first + wide - 1)).alias("entry"), name.alias("shard"), F.col("depth").cast("long").alias("shard_depth"), F.col("bytes").alias("shard_bytes"), F.col("docs").alias("shard_docs"), (F.col("k0") == F.col("k1")).alias("one_key"))
    return entries, depth


def _pages(rows: DataFrame, limit: int) -> DataFrame:
    """rows of overfull buckets (row, key, n_bytes and the shard's columns) dealt to pages within the limit. Rows that repeat one key may
    be any number, so they are numbered once, dealt to groups of about `GROUP` rows and paged inside their group."""
    rows = written(rows.withColumn("n", F.monotonically_increasing_id()), name="full")
    groups = F.ceil(F.col("shard_docs") / GROUP)
    group = W.partitionBy("shard", "g")
    before = group.orderBy("n_bytes", "n").rowsBetween(W.unboundedPreceding, 0)
    rows = rows.withColumn("groups", groups).withColumn("g", F.pmod(F.xxhash64("n"), F.col("groups")))
    rows = rows.withColumn("fill", F.sum("n_bytes").over(before) - F.col("n_bytes")).withColumn("room", F.greatest(F.lit(limit) - F.max("n_bytes").over(group), F.lit(1)))
    rows = rows.withColumn("page", F.col("g") + F.floor(F.col("fill") / F.col("room")) * F.col("groups"))
    page = W.partitionBy("shard", "page")
    return rows.select("row", "n_bytes", F.when(F.col("page") > 0, F.concat_ws(".", "shard", F.col("page").cast("string"))).otherwise(F.col("shard")).alias("shard"), "shard_depth", F.sum("n_bytes").over(page).alias("shard_bytes"), F.count("*").over(page).alias("shard_docs"))


def shard(docs: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_bytes, shard, shard_depth, shard_bytes, shard_docs and oversized."""
    docs = docs.drop(*ADDED)
    # a document's own columns travel in one struct, where no name of theirs can clash
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), key_of(F.col(id_col)).alias("key"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"))
    rows = written(keyed.select("key", "n_bytes"), name="keys")
    total = rows.agg(F.sum("n_bytes")).first()[0] or 0
    base, top = 0, min(BITS, max(4, math.ceil(math.log2(max(1, total / limit))) + 6))
    out, pending = None, keyed
    while True:
        shards, open_ = _level(rows, base, top, limit)
        entries, depth = _directory(shards)
        small = entries.count() <= BROADCAST_ENTRIES
        placed = pending.join(F.broadcast(entries) if small else entries, prefix(F.col("key"), depth) == F.col("entry")).drop("entry")
        out = placed if out is None else out.unionByName(placed)
        if top >= BITS or not open_.limit(1).count():
            break
        rows = written(rows.join(open_, prefix(F.col("key"), top) == F.col("p")).drop("p"), name="keys")
        pending = pending.join(open_, prefix(F.col("key"), top) == F.col("p")).drop("p")
        base, top = top, min(BITS, top + DEEPER)
    full = F.col("one_key") & (F.col("shard_docs") > 1) & (F.col("shard_bytes") > limit)
    both = out.filter(~full).select("row", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs").unionByName(_pages(out.filter(full), limit))
    return both.select("row.*", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs", (F.col("n_bytes") > limit).alias("oversized"))


def op3_shard(spark, sf_dir: str) -> DataFrame:
    """The shard of every document, of 16 MiB of text at most."""
    found = shard(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs", "oversized")


def shard_small_buckets(spark, sf_dir: str) -> DataFrame:
    """The shard of every document, of 64 KiB of text at most: many splits on small tables too."""
    found = shard(table(spark, sf_dir, "documents").select("doc_id", "text"), SMALL_BYTES)
    return found.select("doc_id", "n_bytes", "shard", "shard_depth", "shard_bytes", "shard_docs", "oversized")


SQL = """
WITH k AS (SELECT doc_id, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS key, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes FROM documents),
node AS (
  SELECT d, key >> (60 - d) AS p, sum(n_bytes) AS bytes, count(*) AS docs, min(key) AS k0, max(key) AS k1
  FROM k, unnest(range(0, 61)) AS t(d) GROUP BY 1, 2
), depth AS (
  SELECT doc_id, key, n_bytes, coalesce(max(CASE WHEN n.bytes > 16777216 AND n.k0 < n.k1 THEN n.d END) + 1, 0) AS d
  FROM k JOIN node n ON n.p = k.key >> (60 - n.d) GROUP BY 1, 2, 3
)
SELECT doc_id, n_bytes, CASE WHEN depth.d = 0 THEN '-' ELSE lpad(bin(depth.key >> (60 - depth.d)), CAST(depth.d AS INTEGER), '0') END AS shard,
  depth.d AS shard_depth, CAST(node.bytes AS BIGINT) AS shard_bytes, node.docs AS shard_docs, n_bytes > 16777216 AS oversized
FROM depth JOIN node ON node.d = depth.d AND node.p = depth.key >> (60 - depth.d)
"""
SMALL_SQL = SQL.replace(str(LIMIT_BYTES), str(SMALL_BYTES))
