"""Classification of raw rectangles: checkbox, signature field, fill."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import box, prefixed

#: Fixed values of the classifier, in points and shares.
BOX_SIDE_MIN, BOX_SIDE_MAX, BOX_ASPECT = 5.0, 22.0, 0.35
SIGN_WIDTH_MIN, SIGN_HEIGHT_MAX, SIGN_FROM_TOP = 80.0, 25.0, 0.75
FILL_SHARE = 0.25


def is_checkbox(w: Column, h: Column) -> Column:
    """Both sides of a checkbox's size, and nearly square."""
    sized = w.between(BOX_SIDE_MIN, BOX_SIDE_MAX) & h.between(BOX_SIDE_MIN, BOX_SIDE_MAX)
    return sized & (F.coalesce(F.try_divide(F.abs(w - h), F.greatest(w, h)), F.lit(1.0)) <= BOX_ASPECT)


def is_signature(w: Column, h: Column, top: Column, page_height: Column) -> Column:
    """Wide, low and in the last quarter of the page."""
    return (w >= SIGN_WIDTH_MIN) & (h <= SIGN_HEIGHT_MAX) & (page_height > 0) & (F.coalesce(F.try_divide(top, page_height), F.lit(0.0)) >= SIGN_FROM_TOP)


def rect_type(w: Column, h: Column, top: Column, page_height: Column) -> Column:
    return F.when(is_checkbox(w, h), "checkbox").when(is_signature(w, h, top, page_height), "signature_field").otherwise("box")


def looks_filled(fill: Column, non_stroking: Column) -> Column:
    """Any colour counts, white too; a non-stroking colour of null, 0 or nothing falls through to ``fill``."""
    return F.coalesce(non_stroking != 0, F.lit(False)) | F.coalesce(fill, F.lit(False))


def filled_by_overlap(checkboxes: DataFrame, rects: DataFrame, exclude_self: bool = True) -> DataFrame:
    """Checkboxes that hold a rectangle of a quarter of their area or more; (doc_id, page, rect_idx, filled).

    Without ``exclude_self`` every checkbox holds itself and counts as filled.
    """
    c, r = box("c_"), box()
    cb = checkboxes.select("doc_id", "page", *prefixed(("rect_idx", "x", "y", "w", "h"), "c_"))
    inner = rects.select("doc_id", "page", "rect_idx", "x", "y", "w", "h")
    inside = (r.x >= c.x) & (r.y >= c.y) & (r.right <= c.right) & (r.bottom <= c.bottom) & (r.area >= FILL_SHARE * c.area)
    if exclude_self:
        inside = inside & (F.col("rect_idx") != F.col("c_rect_idx"))
    hits = cb.join(inner, ["doc_id", "page"]).where(inside).select("doc_id", "page", F.col("c_rect_idx").alias("rect_idx")).distinct().withColumn("filled", F.lit(True))
    return checkboxes.select("doc_id", "page", "rect_idx").join(hits, ["doc_id", "page", "rect_idx"], "left").withColumn("filled", F.coalesce("filled", F.lit(False)))


def clean_grid(grid: Column) -> Column:
    """Rows of cell boxes without the missing cells."""
    return F.transform(grid, lambda row: F.filter(row, lambda c: c.isNotNull()))


def clean_texts(cells: Column) -> Column:
    """Text matrix; a missing text is empty."""
    return F.transform(cells, lambda row: F.transform(row, lambda c: F.coalesce(c, F.lit(""))))
