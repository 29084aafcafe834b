"""Language identification by string kernels.

The kernel of two texts is the share of character n-grams that both hold, for n from 1 to 4 blended in one set: the size of the
common set over the geometric mean of both sizes (presence, not counts). n-grams of the lower-cased text are hashed to
`BUCKETS`. Nystroem landmarks, drawn from the labelled sample, turn the kernel into features, and one ridge regression for
each language against the rest is solved in closed form. Scoring multiplies the presence rows of a batch of texts with the
landmarks' matrix, folded with the solved weights, in one matrix product.

The fit uses `PER_LANGUAGE` labelled texts of each language at most, those with the least hash of their doc_id, and `MOST_ROWS` in
all, of the `MOST_LANGUAGES` most frequent languages; the packed presence rows (`BUCKETS` / 8 bytes each, 4 KB) of these texts are
all that reaches the driver. Every whole text is scored.

Defined results: null text and text without a letter are `und` with score 0; so is every text where nothing was learned; ties
between languages go to the first by name; of labelled rows that repeat a doc_id the first by language and text is learned from; rows with a null doc_id are scored and neither trained on nor held out; repeated
rows are scored alike; other columns play no part; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

ORDER = 4
BUCKETS = 1 << 15
PER_LANGUAGE = 200
MOST_LANGUAGES, MOST_ROWS = 100, 2000
LANDMARKS = 256
RIDGE = 1e-2
PIECE = 1 << 18
BATCH = 64
UNKNOWN = "und"
U32 = np.uint32


def mark_presence(text: str, row: np.ndarray) -> None:
    """Sets row[b] = 1 for the bucket b of every n-gram of the text; long texts go in overlapping pieces."""
    for at in range(0, len(text), PIECE):
        c = np.frombuffer(text[at : at + PIECE + ORDER - 1].lower().encode("utf-32-le", "surrogatepass"), U32)
        h = np.zeros(len(c), U32)
        for n in range(1, ORDER + 1):
            if len(c) < n:
                break
            h = (h[: len(c) - n + 1] if n > 1 else h) * U32(0x01000193) + c[n - 1 :] * U32(0x9E3779B1) + U32(n)
            row[((h ^ (h >> U32(15))) * U32(0x85EBCA77)) >> U32(17)] = 1


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def is_held_out(c: Column, parts: int, which: int) -> Column:
    return F.coalesce(F.crc32(c.cast("string")) % parts == which, F.lit(False))


def presence_rows(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """The kept columns and `bits`, the packed presence row, of the texts that have a letter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            took, bits = [], []
            for i, x in enumerate(texts):
                if has_letter(x.as_py()):
                    row = np.zeros(BUCKETS, np.uint8)
                    mark_presence(x.as_py(), row)
                    took.append(i), bits.append(np.packbits(row).tobytes())
            part = batch.take(pa.array(took, pa.int64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(bits, pa.binary())], [*keep, "bits"])

    given = docs.select(*keep, F.col(text_col).alias("_text"))
    return given.mapInArrow(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in given.schema.fields[:-1]) + ", bits binary")


class Classifier:
    """names and weights (BUCKETS x languages): a text's scores are its presence row @ weights / sqrt(its n-grams)."""

    def __init__(self, names: list[str], weights: np.ndarray) -> None:
        self.names, self.weights = names, weights

    @classmethod
    def fit(cls, bits: list[bytes], labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Classifier:
        names = sorted(set(labels))
        if not names:
            return cls([], np.zeros((BUCKETS, 0), np.float32))
        rows = np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).astype(np.float32)
        rows /= np.sqrt(rows.sum(1, keepdims=True))
        chosen = np.sort(np.random.default_rng(7).permutation(len(rows))[: min(landmarks, len(rows))])
        marks = rows[chosen]
        value, vector = np.linalg.eigh((marks @ marks.T).astype(np.float64))
        good = value > 1e-6 * value.max()
        whiten = vector[:, good] / np.sqrt(value[good])
        features = (rows @ marks.T).astype(np.float64) @ whiten
        goal = np.where(np.array(labels)[:, None] == np.array(names)[None], 1.0, -1.0)
        # each language against the rest, both sides with the same weight
        solved = []
        for k in range(len(names)):
            mine = goal[:, k] > 0
            w = np.where(mine, 0.5 / max(1, mine.sum()), 0.5 / max(1, (~mine).sum())) * len(rows)
            solved.append(np.linalg.solve(features.T @ (features * w[:, None]) + ridge * len(rows) * np.eye(features.shape[1]) / 100, features.T @ (w * goal[:, k])))
        return cls(names, (marks.T @ (whiten @ np.array(solved).T)).astype(np.float32))

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        names, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        able = [i for i, x in enumerate(texts) if has_letter(x)] if self.names else []
        for at in range(0, len(able), BATCH):
            part = able[at : at + BATCH]
            rows = np.zeros((len(part), BUCKETS), np.float32)
            for row, i in zip(rows, part, strict=True):
                mark_presence(texts[i], row)
            found = (rows @ self.weights) / np.sqrt(rows.sum(1, keepdims=True))
            best = found.argmax(1)
            for row, i, b in zip(found, part, best, strict=True):
                names[i], scores[i] = self.names[b], min(1.0, max(0.0, (float(row[b]) + 1) / 2))
        return names, scores


def fit(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", folds: int = 5, held: int = 0, per_language: int = PER_LANGUAGE) -> Classifier:
    """Learns from rows with a language whose crc32(doc_id as text) mod folds is not held."""
    key = F.col(id_col).cast("string")
    pool = docs.filter(F.col(lang_col).isNotNull() & (F.crc32(key) % folds != held)).select(key.alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))
    # MOST_LANGUAGES names
    names = [r["lang"] for r in pool.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES).collect()]
    share = min(per_language, max(10, MOST_ROWS // max(1, len(names))))
    rank = F.dense_rank().over(W.partitionBy("lang").orderBy(F.xxhash64("id"), "id"))
    sample = pool.filter(F.col("lang").isin(names)).select("id", "lang").withColumn("rank", rank).filter(F.col("rank") <= share).select("id").distinct()
    # MOST_ROWS ids at most; of rows that repeat an id the first by language and text counts
    chosen = pool.filter(F.col("lang").isin(names)).join(F.broadcast(sample), "id", "left_semi").groupBy("id").agg(F.min(F.struct("lang", "text")).alias("s")).select("id", "s.lang", "s.text")
    rows = sorted((r["id"], r["lang"], bytes(r["bits"])) for r in presence_rows(chosen, "text", ["id", "lang"]).collect())
    return Classifier.fit([r[2] for r in rows], [r[1] for r in rows])


def identify(docs: DataFrame, model: Classifier, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and lang_score, from the text alone."""
    given = docs.drop("lang_pred", "lang_score")
    sent = docs.sparkSession.sparkContext.broadcast((model.names, model.weights))
    at = given.columns.index(text_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields) + ", lang_pred string, lang_score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Classifier(*sent.value)
        for batch in batches:
            for lo in range(0, batch.num_rows, 512):
                part = batch.slice(lo, 512)
                names, scores = known.score([x.as_py() for x in part.column(at)])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "lang_score"])

    return given.mapInArrow(run, schema)


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id"), 5, 0).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
