"""The corpus pipeline: language, near-duplicates, benchmark passages, source weights, shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quire.llm import decontaminate, language_id, mixing, near_dedup, sharding
from quire.llm.common import table, written


def carried(docs: DataFrame, **keys: Column) -> DataFrame:
    """docs as one struct column `row`, where no name of theirs can clash, and the keys."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[c.alias(k) for k, c in keys.items()])


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no language can be told (null text, or without a letter) go; the others get the told language. Repeated
    rows are judged alike; where no row is labelled nothing can be told, and an empty table gives none."""
    told = language_id.identify(docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")), language_id.fit(docs))
    return told.filter(F.col("lang_pred") != language_id.UNKNOWN).select(*[F.col("lang_pred").alias(c) if c == "lang" else F.col("row")[c].alias(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least doc_id of each near-duplicate group stays (5-word shingles, Jaccard of 0.8 or more), once
    where its row is repeated; texts without words and rows without a doc_id have no group and stay."""
    judged = near_dedup.near_duplicates(docs).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("kept").alias("kept"), F.count("*").alias("rows"))
    told = written(judged.filter("NOT kept OR rows > 1").select("doc_id", "kept"), name="told")
    rows = carried(docs, id=F.col("doc_id").cast("long"))
    # texts that no id tells about stay out of the shuffle
    asked, free = near_dedup.may_hold(rows, "id", told), near_dedup.may_hold(rows, "id", told, never=True)
    alone = asked.join(told, F.col("id") == F.col("doc_id"), "left_anti")
    repeated = told.filter("kept").select(F.col("doc_id").alias("of"))
    once = asked.join(repeated, F.col("id") == F.col("of")).drop("of").withColumn("text", F.col("row.text")).dropDuplicates(["id", "text"]).drop("text")
    return free.unionByName(alone).unionByName(once).select("row.*")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null texts and an empty benchmark hit nothing; rows that repeat a
    doc_id are judged each by its own text."""
    hit = decontaminate.contaminated(docs, table(spark, sf_dir, "benchmark")).filter("contaminated").select(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).distinct()
    rows = carried(docs, id=F.col("doc_id"), h=F.xxhash64(F.coalesce("text", F.lit(""))))
    return rows.join(hit, F.col("id").eqNullSafe(F.col("of")) & (F.col("h") == F.col("of_h")), "left_anti").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it. Null and blank texts have size 0; a null source is a source; of rows with one
    doc_id, source and size the first by a hash of their text get the odd copies."""
    doc, source = F.coalesce(F.concat(F.lit("d"), F.col("doc_id").cast("string")), F.lit("-")), F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("-"))
    key = lambda size: F.concat_ws(",", F.length(doc).cast("string"), doc, size.cast("string"), source)
    taken = mixing.mix(docs).select(key(F.col("size")).alias("of"), "copies").groupBy("of").agg(F.min("copies").alias("least"), F.sum("copies").alias("all"), F.count("*").alias("rows"))
    rows = carried(docs, key=key(mixing.count_words(F.col("text"))), h=F.xxhash64("text"))
    # the window deals the rows by key, which the join then takes as they lie
    joined = rows.withColumn("no", F.row_number().over(W.partitionBy("key").orderBy("h"))).join(taken, F.col("key") == F.col("of"))
    copies = F.col("least") + F.when(F.col("no") <= F.col("all") - F.col("least") * F.col("rows"), 1).otherwise(0)
    return joined.withColumn("copies", copies).filter("copies > 0").withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def shard_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard; null texts have 0 bytes, a null doc_id the key of the empty string."""
    return sharding.shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", identify_language),
    ("near-dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("source mixing", mix_sources),
    ("sharding", shard_documents),
]
#: Language ID can't be expressed in SQL; a test holds run() against plain Python, given the told languages and the copies of the mix.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is a table of the shared folder that the next one reads."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, name="stage")
    return docs
