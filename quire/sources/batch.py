"""A folder of files to chunks and a report: the dispatch by format, one bad file never stopping the others."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.folds import ChunkConfig
from ..operators.documents import CHUNKS, chunks, detect_headings, report, sections
from ..operators.reporting import run_summary
from .files import _part, discover, docx_blocks, read_chunks, write_chunks


@dataclass(frozen=True)
class Result:
    """chunks and report as read back from the output, sections, and the exit code of the run."""

    chunks: DataFrame
    report: DataFrame
    sections: DataFrame
    exit_code: int


def checked(files: DataFrame) -> DataFrame:
    """(path, doc_id, error) of files (path, content, doc_id): null where the file can be read. Only .docx files can."""

    def fault(path: str, content: bytes | None) -> str | None:
        if not path.lower().endswith(".docx"):
            return f"no reader for .{path.rsplit('.', 1)[-1].lower()} files"
        try:
            for name in ("word/styles.xml", "word/numbering.xml"):
                _part(content, name)
            return "no document inside" if _part(content, "word/document.xml") is None else None
        except Exception as e:  # whatever a damaged file raises is its line in the report
            return f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            yield pd.DataFrame([(f.path, f.doc_id, fault(f.path, f.content)) for f in g.itertuples()], columns=["path", "doc_id", "error"], dtype=object)

    return files.select("path", "doc_id", "content").mapInPandas(run, "path string, doc_id string, error string")


def stored(df: DataFrame, path: str) -> DataFrame:
    """df written to path and read back: later steps use it several times and don't parse the files again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_chunks(files: DataFrame, cfg: ChunkConfig, out: str) -> tuple[DataFrame, DataFrame]:
    """Chunks and sections of files that can be read; each chunk names its file and where its page number comes from. The blocks,
    before and after their headings are told, are kept below out."""
    blocks = stored(docx_blocks(files), f"{out}/blocks")
    about = blocks.groupBy("doc_id").agg(F.max("page_source").alias("page_source")).join(files.select("doc_id", F.substring_index("path", "/", -1).alias("source_file")), "doc_id")
    headed = stored(detect_headings(blocks), f"{out}/headed")
    made = chunks(headed, cfg).drop("source_file", "page_source").join(about, "doc_id")
    return made.select(*[c.split()[0] for c in CHUNKS.split(", ")]), sections(headed, cfg)


def process(spark: SparkSession, folder: str, out: str, cfg: ChunkConfig | None = None, merge: bool = False) -> Result:
    """Writes the chunks of the files below folder to out/chunks (JSON lines, together or a folder for each document) and a row for
    each file to out/report: its error, or the figures of its chunks. A folder without files gives empty tables and exit code 1."""
    cfg = cfg or ChunkConfig()
    files = discover(spark, folder)
    state = stored(checked(files), f"{out}/files")
    made, parts = file_chunks(files.join(state.filter("error IS NULL").select("path"), "path", "left_semi"), cfg, out)
    write_chunks(made, f"{out}/chunks", not merge)
    back = read_chunks(spark, f"{out}/chunks").drop("_doc")
    rows = state.join(report(back, cfg.max_tokens), "doc_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))
    rows.write.mode("overwrite").json(f"{out}/report")
    kept = spark.read.schema(rows.schema).json(f"{out}/report")
    total = run_summary(kept).first()
    return Result(back, kept, parts, 1 if not total["documents"] else total["exit_code"])
