"""python -m quire FOLDER -o OUT: chunks and a report of a folder of documents."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.folds import ChunkConfig
from .operators.reporting import preview, report_lines
from .operators.retrieval import outline_text
from .sources.batch import process


def options(argv: list[str] | None = None) -> argparse.Namespace:
    cfg = ChunkConfig()
    p = argparse.ArgumentParser(prog="quire", description=__doc__)
    p.add_argument("folder")
    p.add_argument("-o", "--output", default="output")
    p.add_argument("--max-tokens", type=int, default=cfg.max_tokens, help="ceiling of a chunk")
    p.add_argument("--min-tokens", type=int, default=cfg.min_tokens, help="shorter sections are merged")
    p.add_argument("--overlap", type=int, default=cfg.overlap_sentences, help="sentences that a continued chunk repeats")
    p.add_argument("--path-depth", type=int, default=cfg.max_path_depth, help="outline levels before a chunk")
    p.add_argument("--keep-short-sections", action="store_true")
    p.add_argument("--no-prefix", action="store_true", help="chunks without their outline path")
    p.add_argument("--merge", action="store_true", help="all chunks together")
    p.add_argument("--outline", action="store_true", help="print the outlines")
    p.add_argument("--preview", type=int, default=0, metavar="N", help="print the first N chunks of each document")
    return p.parse_args(argv)


def main(argv: list[str] | None = None) -> int:
    o = options(argv)
    cfg = ChunkConfig(o.max_tokens, o.min_tokens, o.overlap, not o.no_prefix, o.path_depth, not o.keep_short_sections)
    spark = SparkSession.builder.appName("quire").getOrCreate()
    done = process(spark, o.folder, o.output, cfg, o.merge)
    for r in done.report.filter("error IS NOT NULL").toLocalIterator():
        print(f"{r['path']}: {r['error']}", file=sys.stderr)
    for r in report_lines(done.report.filter("n_chunks > 0")).toLocalIterator():
        print(f"{r['doc_id']}: {r['report']}")
    if o.outline:
        for r in outline_text(done.sections).toLocalIterator():
            print(f"{r['doc_id']}\n{r['outline']}")
    if o.preview:
        numbered = done.chunks.withColumn("idx", F.substring_index("chunk_id", "#", -1).cast("long"))
        for r in preview(numbered, o.preview).orderBy("doc_id", "idx").toLocalIterator():
            print(f"--- {r['chunk_id']}, {r['est_tokens']} tokens\n{r['text']}")
    return done.exit_code


if __name__ == "__main__":
    sys.exit(main())
