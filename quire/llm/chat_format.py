r"""Chat formatting by prefix-target expansion, in DataFrame functions only.

Every assistant turn becomes an example: all turns before it are context and its own text alone is trainable. Examples of
one conversation are prefixes of the same formatted text, so the formatted text is kept once, in segments, and an example
is a prefix length with a loss span. `example_texts` writes them out as (context, target).

Template: ``<|turn|>`` role ``<|text|>`` text ``<|end|>``. Inside roles and texts, ``<``, any run of backslashes and ``|`` gets one
more backslash, so ``<|`` occurs in control strings only; taking one backslash away restores every text.

Defined results: rows are ordered by turn (nulls first), ties by their formatted form; repeated rows are turns of their
own; null role or text counts as empty; a null conv_id is a conversation too; other columns are ignored; an empty table
gives no rows. A segment holds the turns of one range of 64 turn numbers: no task needs a whole conversation
except to hash it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
SEGMENT_TURNS = 64
TRAINED_ROLE = "assistant"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, r"<(\\*)\|", r"<\\$1|")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, r"<\\(\\*)\|", r"<$1|")


def format_segments(turns: DataFrame, conv="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """(conv_id, segment, base, formatted, turns): the formatted text of a range of turns, where it starts in the
    conversation, and of each turn its start in the segment, header and text lengths and whether it is trained on."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.floor(F.col(turn).cast("long") / F.lit(SEGMENT_TURNS)).alias("segment"),
        F.col(turn).cast("long").alias("turn"),
        F.concat(F.lit(TURN), escape(role_), F.lit(TEXT)).alias("head"),
        escape(text_).alias("body"),
        (role_ == TRAINED_ROLE).alias("trained"),
    ).withColumn("rendered", F.concat("head", "body", F.lit(END)))
    inside = W.partitionBy("conv_id", "segment").orderBy("turn", "rendered")
    placed = rows.select(
        "conv_id",
        "segment",
        F.struct(
            F.row_number().over(inside).alias("no"),
            (F.sum(F.length("rendered")).over(inside.rowsBetween(W.unboundedPreceding, 0)) - F.length("rendered")).cast("long").alias("start"),
            F.length("head").cast("long").alias("head"),
            F.length("body").cast("long").alias("body"),
            F.col("trained"),
            F.col("rendered"),
        ).alias("t"),
    )
    segments = placed.groupBy("conv_id", "segment").agg(F.sort_array(F.collect_list("t")).alias("t")).select(
        "conv_id",
        "segment",
        F.array_join(F.transform("t", lambda t: t["rendered"]), "").alias("formatted"),
        F.transform("t", lambda t: t.dropFields("rendered")).alias("turns"),
    )
    before = W.partitionBy("conv_id").orderBy("segment").rowsBetween(W.unboundedPreceding, 0)
    return segments.withColumn("base", F.sum(F.length("formatted")).over(before) - F.length("formatted"))


def examples(segments: DataFrame) -> DataFrame:
    """One row for each assistant turn: its context is the first `context_chars` characters of the conversation's
    formatted text, which end with the header of the reply; the loss is on [loss_start, loss_end)."""
    return segments.select("conv_id", "segment", "base", F.explode("turns").alias("t")).filter("t.trained").select(
        "conv_id",
        "segment",
        (F.col("base") + F.col("t.start") + F.col("t.head")).alias("context_chars"),
        (F.col("base") + F.col("t.start") + F.col("t.head")).alias("loss_start"),
        (F.col("base") + F.col("t.start") + F.col("t.head") + F.col("t.body")).alias("loss_end"),
        (F.col("base") + F.col("t.start") + F.col("t.head") + F.col("t.body") + F.lit(len(END))).alias("example_chars"),
    )


def conversations_text(segments: DataFrame) -> DataFrame:
    """(conv_id, formatted): each conversation's formatted text."""
    return segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("segment", "formatted"))).alias("s")).select("conv_id", F.array_join(F.transform("s", lambda s: s["formatted"]), "").alias("formatted"))


def example_texts(segments: DataFrame) -> DataFrame:
    """(conv_id, loss_start, context, target): every example written out. The output is as long as all prefixes together."""
    found = examples(segments)
    whole = conversations_text(segments).withColumnRenamed("conv_id", "of")
    return found.join(whole, found["conv_id"].eqNullSafe(whole["of"])).select(
        "conv_id",
        "loss_start",
        F.substring("formatted", F.lit(1), F.col("context_chars").cast("int")).alias("context"),
        F.substring("formatted", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")).alias("target"),
    )


def read_back(segments: DataFrame) -> DataFrame:
    """Parses the formatted segments: (conv_id, segment, n_turns, formatted_chars, said), said being role, newline, text,
    newline of each turn."""
    parts = F.split("formatted", r"<\|end\|>", -1)
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn_of(p: Column) -> Column:
        head = F.substring_index(p, TEXT, 1)
        role = F.substr(head, F.lit(len(TURN) + 1))
        text = F.substr(p, F.length(head) + F.lit(len(TEXT) + 1))
        return F.concat(unescape(role), F.lit("\n"), unescape(text), F.lit("\n"))

    return segments.select(
        "conv_id",
        "segment",
        F.size(parts).cast("long").alias("n_turns"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.array_join(F.transform(parts, turn_of), "").alias("said"),
    )


def losses(segments: DataFrame) -> DataFrame:
    """(of, n_examples, loss): the number of examples of each conversation and the text under their loss spans."""
    held = segments.select(F.col("conv_id").alias("of"), F.col("segment").alias("_s"), "base", "formatted")
    found = examples(segments)
    same = found["conv_id"].eqNullSafe(held["of"]) & found["segment"].eqNullSafe(held["_s"])
    target = F.substr("formatted", (F.col("loss_start") - F.col("base") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    rows = found.join(held, same).select("of", F.struct("loss_start", unescape(target).alias("target")).alias("e"))
    return rows.groupBy("of").agg(F.count("*").alias("n_examples"), F.array_join(F.transform(F.sort_array(F.collect_list("e")), lambda e: e["target"]), "").alias("loss"))


def digests(segments: DataFrame) -> DataFrame:
    """One row for each conversation: counts and hashes of what is read back from its segments and from its examples."""
    said = (
        read_back(segments)
        .groupBy("conv_id")
        .agg(F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"), F.sort_array(F.collect_list(F.struct("segment", "said"))).alias("s"))
    )
    loss = losses(segments)
    text = F.coalesce("loss", F.lit(""))
    return said.join(loss, said["conv_id"].eqNullSafe(loss["of"]), "left").select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("s", lambda s: s["said"]), ""), 256).alias("turns_sha256"),
        F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text, 256).alias("loss_sha256"),
        "formatted_chars",
        F.coalesce("n_examples", F.lit(0)).cast("long").alias("n_examples"),
    )


def op1_chat_format(spark, sf_dir: str) -> DataFrame:
    """All conversations, and conversation -7 whose texts look like control strings."""
    said = r"\### Assistant: </turn> ok"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return digests(format_segments(rows.unionByName(extra)))


SQL = r"""
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST)) AS loss_sha256,
  CAST(sum(23 + length(regexp_replace(role, '<(\\*)\|', '<\\\1|', 'g')) + length(regexp_replace(text, '<(\\*)\|', '<\\\1|', 'g'))) AS BIGINT) AS formatted_chars,
  CAST(sum(CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) AS BIGINT) AS n_examples
FROM c GROUP BY conv_id
"""
