"""Blocks to headings, sections and chunks. doc_id is the one shuffle key; the folds run once per document."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import folds
from ..functions.headings import ANY_FORM, BANNER, column_labels, looks_like_heading, match_heading, own_label, word_rank
from ..functions.merging import merge_short
from ..functions.text import clean_text, clean_text_lines, est_tokens, split_sentences, token_units
from .ordered import by_document
from .retrieval import link, parts

FIGURES = "array<struct<caption:string,width:int,height:int,file:string,page:int>>"
CHUNKS = (
    "chunk_id string, doc_id string, source_file string, text string, raw_text string, section_number string, section_title string, section_path string, "
    "section_level int, page int, page_source string, is_continued boolean, is_continuation boolean, part_index int, part_total int, prev_chunk_id string, "
    f"next_chunk_id string, char_count int, est_tokens int, has_table boolean, has_figure boolean, figures {FIGURES}, warnings array<string>"
)
KEYWORD_KINDS = ("part", "chapter", "appendix", "section", "article")
BLOCKS = "doc_id string, block_no long, text string, page int, kind string, number string, level int, bold boolean, is_table boolean, heading_kind string, title string"


def candidates(blocks: DataFrame) -> DataFrame:
    """blocks (doc_id, block_no, text, page, bold, is_table, kind) with `hit`, the heading each line may be; null for others."""
    line = ~F.col("is_table") & (F.col("kind") != "figure")
    able = line & F.col("text").rlike(ANY_FORM)
    # exploding one element keeps the optimizer from writing the long expression out at each of its uses
    blocks = blocks.withColumn("hit", F.explode(F.array(F.when(able, match_heading(F.col("text"))))))
    fits = looks_like_heading(F.col("text"), F.col("hit.title"), F.col("hit.kind"), F.col("bold"))
    typed = F.col("hit").isNotNull() & fits
    if not {"number", "list_format", "level"} <= set(blocks.columns):
        return blocks.withColumns({"hit": F.when(typed, F.col("hit")), "from_word": F.lit(False)})
    # Word's number counts as it stands, unless the line opens with a keyword
    keyword = typed & F.col("hit.kind").isin(*KEYWORD_KINDS)
    word = line & F.col("number").isNotNull() & (F.trim("text") != "") & ~F.coalesce(keyword, F.lit(False))
    shown = F.struct("number", F.col("text").alias("title"), word_rank(F.col("number"), F.col("list_format"), F.col("level")).alias("rank"), F.lit("decimal").alias("kind"))
    stands = looks_like_heading(F.col("text"), F.col("text"), F.lit("decimal"), F.col("bold"), True)
    return blocks.withColumns({"hit": F.when(word, F.when(stands, shown)).when(typed, F.col("hit")), "from_word": F.coalesce(word, F.lit(False))})


def with_banners(blocks: DataFrame) -> DataFrame:
    """blocks (with size and number) whose banners are joined on their first block and named in `banner`; the others of a run are empty.
    The size of body text is the one that most characters have."""
    sizes = blocks.filter("kind = 'para' AND NOT is_table AND size > 0").groupBy("doc_id", "size").agg(F.sum(F.length("text")).alias("n"), F.min("block_no").alias("at"))
    body = sizes.groupBy("doc_id").agg(F.max_by("size", F.struct("n", -F.col("at"))).alias("body_size"))
    marked = mark_banners(blocks.join(body, "doc_id", "left").withColumn("body_size", F.coalesce("body_size", F.lit(0.0))))
    joined = F.when(F.col("banner").isNotNull(), clean_text(F.col("banner"))).when(F.col("banner_tail"), "").otherwise(F.col("text"))
    return marked.withColumns({"text": joined, "banner": F.when(F.col("banner").isNotNull(), joined)}).drop("body_size", "banner_tail")


def mark_banners(blocks: DataFrame, body_size: str = "body_size") -> DataFrame:
    """blocks with `banner`, the joined text of a run of large upper-case lines, on the run's first block, and `banner_tail` on its
    others; documents with one run have none."""
    letters = F.length(F.regexp_replace("text", r"[^\p{L}]", ""))
    upper = F.length(F.regexp_replace("text", r"[^\p{Lu}]", ""))
    words = F.size(F.filter(F.split("text", r"\s+"), lambda w: w.rlike(r"^\p{L}{2,}$")))
    is_banner = ~F.col("is_table") & (F.col("kind") != "figure") & F.col("number").isNull() & F.length("text").between(3, 120) & (F.col("size") > F.col(body_size)) & match_heading(F.col("text")).isNull() & (letters * 2 >= F.length("text")) & (words >= 2) & (upper / letters >= 0.8)
    order = W.partitionBy("doc_id").orderBy("block_no")
    run_order = W.partitionBy("doc_id", "_run").orderBy("block_no")
    b = blocks.withColumn("_b", is_banner)
    opens = F.col("_b") & ~(F.coalesce(F.lag("_b").over(order), F.lit(False)) & (F.lag("page").over(order) == F.col("page")))
    b = b.withColumn("_opens", opens).withColumn("_run", F.when(F.col("_b"), F.sum(F.col("_opens").cast("int")).over(order)))
    many = F.sum(F.col("_opens").cast("int")).over(W.partitionBy("doc_id")) >= 2
    text = F.array_join(F.collect_list("text").over(W.partitionBy("doc_id", "_run").orderBy("block_no").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), " ")
    first = F.row_number().over(run_order) == 1
    return b.withColumns({"banner": F.when(F.col("_b") & many & first, text), "banner_tail": F.coalesce(F.col("_b") & many & ~first, F.lit(False))}).drop("_b", "_opens", "_run")


def detect_headings(blocks: DataFrame) -> DataFrame:
    """blocks with kind, number, level, heading_kind and title of the headings. Numbers that break their document's sequence
    are content; the kinds of marks that are left are ranked densely to levels. Blocks with size and number may hold banners;
    those with number, level and list_format carry Word's numbers."""

    if {"size", "number"} <= set(blocks.columns):
        blocks = with_banners(blocks)
    found = candidates(blocks)
    if "banner" in blocks.columns:
        name = F.struct(F.lit("").alias("number"), F.col("banner").alias("title"), F.lit(BANNER).alias("rank"), F.lit("banner").alias("kind"))
        found = found.withColumn("hit", F.when(F.col("banner").isNotNull(), name).otherwise(F.col("hit")))
    hit = F.col("hit.number").isNotNull()
    title = F.col("hit.title")
    label, bare = own_label(title)
    # an empty number or title tells a heading whose line is its number from others
    whole = lambda shown: (shown != "") | (F.rtrim("text", F.lit(".")) == F.rtrim("hit.number", F.lit(".")))
    told = found.select(
        "doc_id", F.col("block_no").cast("long").alias("block_no"), "text", F.col("page").cast("int").alias("page"), "kind", "bold", "is_table", "hit.number", F.col("hit.kind").alias("mark"), "hit.rank", "hit.title", "from_word",
        F.when(hit, column_labels(title)).alias("labels"), F.when(hit, label).alias("label"), F.when(hit, bare).alias("bare"), F.when(hit, whole(title)).alias("named"), F.when(hit, whole(bare)).alias("bare_named"),
    )
    return by_document(told, "block_no", _headings, BLOCKS)


def _headings(rows: list[tuple]) -> Iterator[tuple]:
    """A document's blocks with their headings, from the columns that detect_headings tells."""
    hits = [r for r in rows if r[7] is not None]
    kept = [r for r, ok in zip(hits, folds.keep_sequence([(r[7], r[8], r[11]) for r in hits]), strict=True) if ok]
    level = {rank: k + 1 for k, rank in enumerate(sorted({r[9] for r in kept}))}
    labels = {x for r in kept for x in r[12]}
    marks = {r[1] for r in kept}
    for doc, no, text, page, kind, bold, is_table, number, mark, rank, title, _, _, label, bare, named, bare_named in rows:
        if no in marks and number is not None:
            shown, named = (bare, bare_named) if label in labels else (title, named)
            yield doc, no, text, page, "heading", number, level[rank], bold, is_table, mark, shown if named else text
        else:
            yield doc, no, text, page, kind, None, None, bold, is_table, "", None


def _measured(blocks: DataFrame) -> DataFrame:
    """blocks with chars and units, the costs that packing adds up."""
    return blocks.withColumns({"chars": F.length("text"), "units": token_units(F.col("text"))})


#: The columns of a document's rows in the folds over its blocks.
FOLDED = ("doc_id", "text", "page", "kind", "number", "level", "bold", "is_table", "heading_kind", "title", "chars", "units", "block_no")


def folded(blocks: DataFrame, run: Callable[[object, list[folds.Section]], Iterator[tuple]], cfg: folds.ChunkConfig | None, schema: str) -> DataFrame:
    """The rows that run makes of each document's id and sections, short ones merged where a config is given."""
    return by_document(_measured(blocks).select(*FOLDED), "block_no", lambda rows: run(rows[0][0], _sections(rows, cfg)), schema)


def _sections(rows: list[tuple], cfg: folds.ChunkConfig | None) -> list[folds.Section]:
    blocks = [folds.Block(text, page, kind, number, level, bool(bold), bool(is_table), heading_kind or "", title, None, (chars, units)) for _, text, page, kind, number, level, bold, is_table, heading_kind, title, chars, units, _ in rows]
    out = folds.build_sections(blocks)
    return merge_short(out, cfg.min_tokens, cfg.max_tokens) if cfg is not None and cfg.merge_short else out


SECTIONS = "doc_id string, section_no int, number string, title string, level int, path array<string>, kind string, full_heading string, page_start int, page_end int, n_blocks int, est_tokens int"


def sections(blocks: DataFrame, cfg: folds.ChunkConfig | None = None) -> DataFrame:
    """One row per section of detected blocks, short ones merged where a config is given."""

    def run(doc: object, found: list[folds.Section]) -> Iterator[tuple]:
        return ((doc, i, s.number, s.title, s.level, s.path, s.kind, s.heading_text, s.page_start, s.page_end, len(s.blocks), s.tokens()) for i, s in enumerate(found))

    return folded(blocks, run, cfg, SECTIONS)


PIECES = f"doc_id string, idx long, page int, piece string, head string, section_number string, section_title string, section_path string, section_level int, has_table boolean, figures {FIGURES}"


def pieces(blocks: DataFrame, cfg: folds.ChunkConfig) -> DataFrame:
    """The ordered pieces of detected blocks: what depends on a document's own earlier decisions ends here."""

    def run(doc: object, sections_: list[folds.Section]) -> Iterator[tuple]:
        found = folds.document_pieces(sections_, cfg)
        return ((doc, i, p.page, p.text, folds.prefix(p.section, cfg), p.section.number, p.section.title, " > ".join(p.section.path), p.section.level, p.has_table, p.figures) for i, p in enumerate(found))

    return folded(blocks, run, cfg, PIECES)


def chunks(blocks: DataFrame, cfg: folds.ChunkConfig | None = None, source_file: str = "", page_source: str = "estimated") -> DataFrame:
    """The chunks of detected blocks, linked in document order: windows over the pieces. A chunk that goes on in its section
    opens with the last sentences of the one before, where they fit."""
    cfg = cfg or folds.ChunkConfig()
    order = W.partitionBy("doc_id").orderBy("idx")
    p = parts(pieces(blocks, cfg)).withColumn("chunk_id", F.format_string("%s#p%d#%04d", "doc_id", "page", "idx"))
    p = link(p).withColumn("before", F.lag("piece").over(order))
    n = cfg.overlap_sentences
    # bound by a lambda, so that the sentences are told once, and only where the chunk goes on in its section
    ends = lambda x: F.when(F.size(x) > 0, F.array_join(F.slice(x, F.greatest(F.size(x) - n + 1, F.lit(1)), n), " ")).otherwise(F.col("before"))
    last = F.get(F.transform(F.array(split_sentences(F.col("before"))), ends), F.lit(0))
    p = p.withColumn("carry", F.when(F.col("is_continuation"), F.trim(last)).otherwise("") if n > 0 else F.lit(""))
    fits = est_tokens(F.col("head")) + est_tokens(F.col("piece")) + est_tokens(F.col("carry")) + 3 <= cfg.max_tokens
    body = F.when(F.col("is_continuation") & (F.col("carry") != "") & fits, F.concat(F.lit("[...] "), "carry", F.lit("\n"), "piece")).otherwise(F.col("piece"))
    first = F.trim(F.substring_index("body", "\n", 1))
    rest = F.when(F.instr("body", "\n") > 0, F.regexp_replace("body", r"\A[^\n]*\n", "")).otherwise("")
    named = (F.col("head") != "") & (first != "") & F.col("head").endswith(first)
    p = p.withColumn("body", body)
    p = p.withColumn("text", clean_text_lines(F.concat(F.col("head"), F.lit("\n"), F.when(named, rest).otherwise(F.col("body"))))).withColumn("raw_text", clean_text_lines(F.col("piece")))
    out = p.select(
        "chunk_id", "doc_id", F.lit(source_file).alias("source_file"), "text", "raw_text", "section_number", "section_title", "section_path", "section_level", "page",
        F.lit(page_source).alias("page_source"), "is_continued", "is_continuation", F.col("part_index").cast("int").alias("part_index"), F.col("part_total").cast("int").alias("part_total"),
        "prev_chunk_id", "next_chunk_id", F.length("text").alias("char_count"), est_tokens(F.col("text")).cast("int").alias("est_tokens"), "has_table", (F.size("figures") > 0).alias("has_figure"), "figures",
    )
    return warnings(out, cfg.max_tokens)


def document_blocks(docs: DataFrame, lines_per_page: int = 40) -> DataFrame:
    """Blocks of documents (doc_id, text): one for each line that isn't blank."""
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("block_no", "text"))
    return rows.select("doc_id", F.col("block_no").cast("long").alias("block_no"), F.regexp_replace("text", r"(?U)^\s+|\s+$", "").alias("text"), (F.floor(F.col("block_no") / lines_per_page) + 1).cast("int").alias("page")).filter("text <> ''").select(
        "*", F.lit("para").alias("kind"), F.lit(False).alias("bold"), F.col("text").startswith("|").alias("is_table")
    )


def report(chunks_: DataFrame, max_tokens: int = 512) -> DataFrame:
    """Quality figures of each document's chunks."""
    long_, short = F.col("est_tokens") > max_tokens, F.length("raw_text") < 30
    return chunks_.groupBy("doc_id").agg(
        F.count("*").alias("n_chunks"), F.count_distinct("page").alias("n_pages"), F.min("char_count").cast("long").alias("min_chars"), F.max("char_count").cast("long").alias("max_chars"), F.median("est_tokens").alias("median_tokens"), F.max("est_tokens").cast("long").alias("max_tokens"),
        F.count_if(long_).alias("too_long"), F.count_if(short).alias("too_short"), F.count_if(F.col("section_number") == "").alias("orphans"), F.sum(F.size("figures")).cast("long").alias("n_figures"), F.count_if("is_continued").alias("continued"),
    )


def warnings(chunks_: DataFrame, max_tokens: int = 512) -> DataFrame:
    """chunks with their warnings."""
    rules = [(F.col("est_tokens") > max_tokens, "over the token ceiling"), (F.length("raw_text") < 30, "very short"), (F.col("page") < 1, "invalid page")]
    return chunks_.withColumn("warnings", F.filter(F.array(*[F.when(c, w) for c, w in rules]), lambda w: w.isNotNull()))


