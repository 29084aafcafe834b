"""Which images are figures: a ladder of tests over measured columns, captions by a range join on the page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPTION = r"^(?i:hình|hình ảnh|biểu đồ|sơ đồ|lưu đồ|figure|fig\.?|chart|diagram)\s*(\d+|:|[IVX]+\b)"


def classify(images: DataFrame) -> DataFrame:
    """images (doc_id, page, xref, x0, y0, x1, y1, page_w, page_h, page_chars, live_chars, ink, colours, caption) with kind and reason.
    The pages of an image are counted in two steps, as distinct counts have no window."""
    pages = images.select("doc_id", "xref", "page").distinct().groupBy("doc_id", "xref").agg(F.count("*").alias("n_pages"))
    w, h = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    area = w * h / (F.col("page_w") * F.col("page_h"))
    captioned = F.coalesce(F.col("caption") != "", F.lit(False))
    margin = (F.col("y1") <= F.col("page_h") * 0.10) | (F.col("y0") >= F.col("page_h") * 0.90)
    reason = (
        F.when((area >= 0.85) & (F.col("page_chars") >= 200), "background")
        .when(area >= 0.85, "cover")
        .when(F.col("n_pages") >= 2, "repeated")
        .when((F.least(w, h) < 70) | (area < 0.025), "small")
        .when(margin & (area < 0.12), "margin")
        .when(~captioned & (F.col("ink") < 0.05), "watermark")
        .when(~captioned & (F.col("live_chars") >= 40), "frame")
        .when(~captioned & (F.col("page_chars") >= 200) & (F.col("colours") >= 8000), "photo")
        .otherwise("figure")
    )
    kind = F.when(F.col("reason") == "figure", "figure").when(F.col("reason") == "cover", "cover").otherwise("logo")
    return images.join(pages, ["doc_id", "xref"]).withColumn("reason", reason).withColumn("kind", kind)


def captions(images: DataFrame, lines: DataFrame) -> DataFrame:
    """images with caption: the first caption line within 60 points below, else within 45 above."""
    line = lines.filter(F.col("text").rlike(CAPTION) & (F.length("text") <= 180)).select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("line_no").alias("_no"), F.col("text").alias("_t"), F.col("x0").alias("_x0"), F.col("x1").alias("_x1"), F.col("y").alias("_y"))
    below, above = F.col("_y").between(F.col("y1"), F.col("y1") + 60), F.col("_y").between(F.col("y0") - 45, F.col("y0"))
    beside = (F.col("_x1") >= F.col("x0") - 30) & (F.col("_x0") <= F.col("x1") + 30)
    near = images.join(line, (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & beside & (below | above), "left")
    keys = images.columns
    return near.groupBy(*keys).agg(F.min_by("_t", F.when(F.col("_t").isNotNull(), F.struct(F.when(below, 0).otherwise(1).alias("s"), "_no"))).alias("caption"))


def clusters(boxes: DataFrame, gap: float = 26.0) -> DataFrame:
    """(doc_id, page, x0, y0, x1, y1, n): strokes (doc_id, page, no, x0, y0, x1, y1) united with every region within gap of them, in
    order, in two passes; n counts the strokes whose middle lies in the region. The union depends on the order, so each page is a fold."""
    import numpy as np
    import pandas as pd

    def united(b: np.ndarray) -> np.ndarray:
        out = np.empty((0, 4))
        for box in b:
            near = (out[:, 0] < box[2] + gap) & (box[0] - gap < out[:, 2]) & (out[:, 1] < box[3] + gap) & (box[1] - gap < out[:, 3])
            whole = np.vstack([out[near], box])
            out = np.vstack([out[~near], np.concatenate([whole[:, :2].min(0), whole[:, 2:].max(0)])])
        return out

    def run(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        strokes = g.sort_values("no")[["x0", "y0", "x1", "y1"]].to_numpy(float)
        found = united(united(strokes))
        x, y = (strokes[:, 0] + strokes[:, 2]) / 2, (strokes[:, 1] + strokes[:, 3]) / 2
        n = [int(((x >= b[0]) & (x <= b[2]) & (y >= b[1]) & (y <= b[3])).sum()) for b in found]
        return pd.DataFrame([(*key, *b, k) for b, k in zip(found, n, strict=True)], columns=["doc_id", "page", "x0", "y0", "x1", "y1", "n"])

    return boxes.groupBy("doc_id", "page").applyInPandas(run, "doc_id string, page int, x0 double, y0 double, x1 double, y1 double, n long")


def measured(pixels: DataFrame) -> DataFrame:
    """(image, ink, colours) of a histogram (image, grey, colour, n): the dark share of what isn't white (1 where nothing is
    known, 0 for a white sheet) and the number of colours."""
    seen, dark = F.sum(F.when(F.col("grey") < 247, F.col("n")).otherwise(0)), F.sum(F.when(F.col("grey") < 170, F.col("n")).otherwise(0))
    ink = F.when(F.sum("n").isNull() | (F.sum("n") == 0), 1.0).when(seen == 0, 0.0).otherwise(dark / seen)
    return pixels.groupBy("image").agg(ink.alias("ink"), F.count_distinct("colour").alias("colours"))


def live_chars(images: DataFrame, words: DataFrame) -> DataFrame:
    """images (doc_id, page, xref, x0, y0, x1, y1) with live_chars: the characters of the words (doc_id, page, x, y, text) inside."""
    w = words.select(F.col("doc_id").alias("_d"), F.col("page").alias("_p"), F.col("x").alias("_x"), F.col("y").alias("_y"), F.length(F.trim("text")).alias("_n"))
    inside = (F.col("doc_id") == F.col("_d")) & (F.col("page") == F.col("_p")) & F.col("_x").between(F.col("x0"), F.col("x1")) & F.col("_y").between(F.col("y0"), F.col("y1"))
    return images.join(w, inside, "left").groupBy(*images.columns).agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("live_chars"))


def docx_image_kind(width: Column, height: Column, least: float = 70.0) -> Column:
    """An image of a .docx is a logo where a side is short or unknown."""
    return F.when(F.coalesce(F.least(width, height) >= least, F.lit(False)) & width.isNotNull() & height.isNotNull(), "figure").otherwise("logo")


def vector_figures(boxes: DataFrame, page_w: float = 595, page_h: float = 842) -> DataFrame:
    """Clusters of six marks or more that are large enough for a diagram, padded by 6 points."""
    w, h = F.col("x1") - F.col("x0") + 12, F.col("y1") - F.col("y0") + 12
    return clusters(boxes).filter((F.col("n") >= 6) & (F.least(w, h) >= 90) & (w * h >= 0.05 * page_w * page_h))
