"""Input files and output paths."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import clean_text, doc_id, document_title
from ..operators.documents import CHUNKS
from ..operators.lines import estimated_pages
from ..operators.numbering import numbers

NS = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PARAGRAPHS = "path string, par_no long, text string, style string, bold boolean, size double, num_id string, ilvl int, breaks int, is_table boolean, page_breaks int"
LEVELS = "path string, num_id string, abstract_id string, ilvl int, fmt string, lvl_text string, start int, restart int, start_override int"


def discover(spark: SparkSession, *folders: str) -> DataFrame:
    """(path, length, content, doc_id, title) of the .pdf and .docx files below the folders; lock files are skipped."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(list(folders))
    name = F.substring_index("path", "/", -1)
    return files.filter(name.rlike(r"(?i)\.(pdf|docx)$") & ~name.startswith("~$")).select("path", "length", "content", doc_id(F.col("path")).alias("doc_id"), document_title(F.col("path")).alias("title"))


def parse_drop(c: Column) -> Column:
    """The paths in a dropped string: separated by blanks, braces around those that hold some."""
    found = F.regexp_extract_all(c, F.lit(r"(\{[^}]*\}|\S+)"), F.lit(1))
    return F.transform(found, lambda p: F.when(p.startswith("{") & p.endswith("}"), F.substr(p, F.lit(2), F.length(p) - 2)).otherwise(p))


def _text(p: ElementTree.Element) -> str:
    return "".join(t.text or "" if t.tag == f"{NS}t" else "\t" for t in p.iter() if t.tag in (f"{NS}t", f"{NS}tab"))


def _part(content: bytes, name: str) -> ElementTree.Element | None:
    """A part of a .docx file; None where it has none."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        return ElementTree.fromstring(z.read(name)) if name in z.namelist() else None


def _val(e: ElementTree.Element | None, path: str) -> str | None:
    found = None if e is None else e.find("/".join(f"{NS}{x}" for x in path.split("/")))
    return None if found is None else found.get(f"{NS}val")


def _on(e: ElementTree.Element | None, tag: str) -> bool | None:
    """A switch of run properties: None where it isn't set."""
    found = None if e is None else e.find(f"{NS}{tag}")
    return None if found is None else found.get(f"{NS}val", "true") not in ("0", "false", "off")


class _Styles:
    """The paragraph styles of a file: look and list of a paragraph that states none itself."""

    def __init__(self, root: ElementTree.Element | None) -> None:
        styles = [] if root is None else root.findall(f"{NS}style")
        self.by_id = {x.get(f"{NS}styleId"): x for x in styles}
        self.default = next((x.get(f"{NS}styleId") for x in styles if x.get(f"{NS}type") == "paragraph" and x.get(f"{NS}default") in ("1", "true", "on")), None)

    def chain(self, style: str | None) -> Iterator[ElementTree.Element]:
        """A style and those that it is based on, each once."""
        seen: set = set()
        while style in self.by_id and style not in seen:
            seen.add(style)
            yield self.by_id[style]
            style = _val(self.by_id[style], "basedOn")

    def listed(self, p: ElementTree.Element, style: str | None) -> tuple[str | None, int | None]:
        """(num_id, ilvl): a paragraph's own, else those of the nearest style that names a list."""
        for x in (p, *self.chain(style)):
            num = _val(x, "pPr/numPr/numId")
            if num is not None:
                return num, int(_val(x, "pPr/numPr/ilvl") or 0)
        return None, None

    def look(self, p: ElementTree.Element, style: str | None) -> tuple[bool, float]:
        """(bold, size) of the first run with text; the paragraph's style stands in for what the run leaves open."""
        run = next((r for r in p.findall(f"{NS}r") if _text(r).strip()), None)
        if run is None:
            return False, 0.0
        both = [run.find(f"{NS}rPr"), *(x.find(f"{NS}rPr") for x in (self.by_id.get(style),) if x is not None)]
        bold = next((b for b in (_on(r, "b") for r in both) if b is not None), False)
        size = next((z for z in (_val(r, "sz") for r in both) if z is not None), None)
        return bold, float(size) / 2 if size else 0.0


def _paragraphs(path: str, content: bytes) -> Iterator[tuple]:
    document, styles = _part(content, "word/document.xml"), _Styles(_part(content, "word/styles.xml"))
    body = None if document is None else document.find(f"{NS}body")
    for no, x in enumerate(body if body is not None else []):
        manual = sum(1 for b in x.iter(f"{NS}br") if b.get(f"{NS}type") == "page")
        if x.tag == f"{NS}p":
            style = _val(x, "pPr/pStyle") or styles.default
            yield path, no, _text(x), style, *styles.look(x, style), *styles.listed(x, style), sum(1 for _ in x.iter(f"{NS}lastRenderedPageBreak")), False, manual
        elif x.tag == f"{NS}tbl":
            rows = [[re.sub(r"\s+", " ", " ".join(_text(p) for p in c.iter(f"{NS}p"))).replace("|", "\\|").strip() for c in r.iter(f"{NS}tc")] for r in x.iter(f"{NS}tr")]
            rows = [r for r in rows if any(r)]
            if rows:
                md = [f"| {' | '.join(r)} |" for r in rows]
                md.insert(1, "| " + " | ".join(["---"] * len(rows[0])) + " |")
                yield path, no, "\n".join(md), None, False, 0.0, None, None, sum(1 for r in x.iter(f"{NS}tr") if r.find(f".//{NS}lastRenderedPageBreak") is not None), True, manual


def _levels(path: str, content: bytes) -> Iterator[tuple]:
    root = _part(content, "word/numbering.xml")
    if root is None:
        return
    whole = lambda x: None if x is None else int(x)
    abstract = {a.get(f"{NS}abstractNumId"): a.findall(f"{NS}lvl") for a in root.findall(f"{NS}abstractNum")}
    for num in root.findall(f"{NS}num"):
        of = _val(num, "abstractNumId")
        begins = {o.get(f"{NS}ilvl"): _val(o, "startOverride") for o in num.findall(f"{NS}lvlOverride")}
        for lvl in abstract.get(of, []):
            k, text, fmt = lvl.get(f"{NS}ilvl") or "0", _val(lvl, "lvlText"), _val(lvl, "numFmt")
            yield path, num.get(f"{NS}numId"), of, int(k), fmt or "decimal", text or "", int(_val(lvl, "start") or 1), whole(_val(lvl, "lvlRestart")), whole(begins.get(k))


def _of_files(files: DataFrame, rows: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            yield pd.DataFrame([r for f in g.itertuples() for r in rows(f.path, f.content)], columns=names, dtype=object)

    return files.filter(F.col("path").rlike(r"(?i)\.docx$")).select("path", "content").mapInPandas(run, schema)


def read_docx(files: DataFrame) -> DataFrame:
    """The paragraphs and tables of .docx files (path, content), in body order."""
    return _of_files(files, _paragraphs, PARAGRAPHS)


def read_numbering(files: DataFrame) -> DataFrame:
    """The list levels that the numberings of .docx files (path, content) define."""
    return _of_files(files, _levels, LEVELS)


def docx_blocks(files: DataFrame) -> DataFrame:
    """Blocks of .docx files (path, content, doc_id) with the numbers that Word shows (number, level, list_format) and page_source.
    Pages are those last printed; without any, those of breaks by hand and of the characters so far."""
    ids = files.select("path", "doc_id")
    read = read_docx(files).join(ids, "path")
    of_doc = W.partitionBy("doc_id")
    pars = rendered_pages(read).withColumns({"_r": F.sum("breaks").over(of_doc), "_b": F.sum("page_breaks").over(of_doc), "_p": F.col("page")}).drop("page")
    pars = pars.withColumn("text", F.when(F.col("is_table"), F.col("text")).otherwise(clean_text(F.col("text"))))
    guess = estimated_pages(pars.select("doc_id", "par_no", "text", "page_breaks"))
    shown = pars.join(guess, ["doc_id", "par_no"]).filter("text <> ''")
    listed = shown.filter("num_id IS NOT NULL AND NOT is_table").select("doc_id", "par_no", "num_id", "ilvl")
    found = numbers(listed, read_numbering(files).join(ids, "path").drop("path"))
    return shown.join(found, ["doc_id", "par_no"], "left").select(
        "doc_id", F.col("par_no").alias("block_no"), "text", F.when(F.col("_r") > 0, F.col("_p")).otherwise(F.col("page")).cast("int").alias("page"), F.when(F.col("is_table"), "table").otherwise("para").alias("kind"), "number", (F.col("ilvl") + 1).alias("level"), "list_format", "bold", "size", "is_table",
        F.when(F.col("_r") > 0, "rendered").when(F.col("_b") > 0, "page_break").otherwise("estimated").alias("page_source"),
    )


def rendered_pages(paragraphs: DataFrame) -> DataFrame:
    """paragraphs with page: rendered breaks so far, a paragraph's own among them, a table's only behind it."""
    w = W.partitionBy("path").orderBy("par_no")
    upto = F.sum("breaks").over(w.rowsBetween(W.unboundedPreceding, 0))
    return paragraphs.withColumn("page", (1 + upto - F.when(F.col("is_table"), F.col("breaks")).otherwise(0)).cast("int"))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNKS).json(path)


def write_chunks(chunks: DataFrame, path: str, by_document: bool = False) -> None:
    """JSON lines, in one folder for each document or together."""
    writer = chunks.withColumn("_doc", F.col("doc_id")).write.partitionBy("_doc") if by_document else chunks.write
    writer.mode("overwrite").json(path)


def output_path(source: Column, root: Column, out: Column, ext: str) -> Column:
    """Where a rebuilt document goes: the source tree mirrored below out, the suffix never doubled, never over the source."""
    rest = F.regexp_replace(F.substr(source, F.length(root) + 1), r"\.[^./]*$", "")
    made = F.concat(out, F.regexp_replace(rest, "_formalized$", ""), F.lit(f"_formalized{ext}"))
    return F.when(made == source, F.raise_error(F.lit("the output would overwrite its source"))).otherwise(made)
