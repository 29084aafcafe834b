"""A file-stream front end: new documents become chunks, batch by batch. A document arrives whole, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.documents import chunks, detect_headings, document_blocks


def stream_chunks(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Reads parquet files of (doc_id, text) that appear in folder and writes their chunks below out, a folder for each batch;
    a batch that runs again overwrites its own."""

    def one(batch: DataFrame, no: int) -> None:
        chunks(detect_headings(document_blocks(batch))).write.mode("overwrite").parquet(f"{out}/batch={no}")

    rows = spark.readStream.schema("doc_id long, text string").parquet(folder)
    return rows.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
