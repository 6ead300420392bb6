"""Fusion of text items, semantic blocks and rectangles of many documents.

Joins are on (doc_id, page) with the spatial condition as residual, and each
choice is a minimum of one struct that spells the whole order with ties, so
results don't depend on partitioning.  Grouping keeps (doc_id, page) in the key:
the join's partitioning serves the aggregate, without another shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, box, prefixed
from tessera.functions.text import strip

KEY = ("doc_id", "page", "item_idx")
_BOX = ("x", "y", "w", "h")


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""


def _narrow(items: DataFrame) -> DataFrame:
    return items.select(*KEY, *_BOX)


def _choose(items: DataFrame, others: DataFrame, fits: Column, order: Column) -> DataFrame:
    """``items`` with ``m``: the least ``order`` among the ``others`` (doc_id as o_doc, page as o_page) of the page that fit, or null.

    The items go along through the aggregate, so a chain of choices deals them out once.  Both sides grow with the
    documents, so they are merged: no broadcast holds one of them on the driver.
    """
    rest = [c for c in items.columns if c not in KEY]
    near = items.join(others.hint("merge"), (F.col("doc_id") == F.col("o_doc")) & (F.col("page") == F.col("o_page")) & fits, "left")
    best = near.groupBy(*KEY).agg(F.first(F.struct(*rest)).alias("item"), F.min(F.when(F.col("o_doc").isNotNull(), order)).alias("m"))
    return best.select(*KEY, "item.*", "m")


def _others(relation: DataFrame, prefix: str, *columns: str) -> DataFrame:
    return relation.select(F.col("doc_id").alias("o_doc"), F.col("page").alias("o_page"), *prefixed((*columns, *_BOX), prefix))


def with_blocks(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Per item the smallest block that holds its centre, else the block of largest IoU, else none.

    Adds block_idx, block_label, block_heading_level, match_method, match_score; ties by area, then block order.
    """
    i, o = box(), box("b_")
    order = block_order(i, o, *(F.col(f"b_{c}") for c in ("block_idx", "label", "heading_level")))
    best = _choose(items, _others(blocks, "b_", "block_idx", "label", "heading_level"), o.touches(i) & (o.holds_centre_of(i) | (o.iou(i) > 0)), order)
    return best.select(*items.columns, *(v.alias(c) for c, v in match_of(F.col("m")).items()))


def block_order(i: Box, o: Box, block_idx: Column, label: Column, level: Column) -> Column:
    """Blocks that hold the item's centre by area, then the others by IoU."""
    centre = o.holds_centre_of(i)
    return F.struct(
        F.when(centre, 0).otherwise(1).alias("tier"), F.when(centre, 0.0).otherwise(-o.iou(i)).alias("k"), o.area.alias("area"), block_idx.alias("block_idx"), label.alias("label"), level.alias("level"),
    )


def match_of(m: Column) -> dict[str, Column]:
    """What an item gets of the least ``block_order``, or of null."""
    tier = m["tier"]
    return {
        "block_idx": m["block_idx"], "block_label": m["label"], "block_heading_level": m["level"],
        "match_method": F.when(tier == 0, "centroid").when(tier == 1, "iou").otherwise("none"),
        "match_score": F.round(F.when(tier == 0, 1.0).when(tier == 1, -m["k"]).otherwise(0.0), 4),
    }


def with_rects(items: DataFrame, rects: DataFrame) -> DataFrame:
    """Per item the smallest rectangle with an area, not a checkbox, that holds its centre; adds box_rect_idx, enclosing_box_id."""
    o = box("r_")
    others = _others(rects.where(F.col("rect_type") != "checkbox"), "r_", "rect_idx", "rect_id").where(o.area > 0)
    best = _choose(items, others, o.holds_centre_of(box()), F.struct(o.area.alias("area"), F.col("r_rect_idx").alias("rect_idx"), F.col("r_rect_id").alias("rect_id")))
    return best.select(*items.columns, F.col("m.rect_idx").alias("box_rect_idx"), F.col("m.rect_id").alias("enclosing_box_id"))


def match_blocks(items: DataFrame, blocks: DataFrame) -> DataFrame:
    return with_blocks(_narrow(items), blocks).drop(*_BOX)


def match_rects(items: DataFrame, rects: DataFrame) -> DataFrame:
    return with_rects(_narrow(items), rects).drop(*_BOX)


def table_cells(rects: DataFrame) -> DataFrame:
    """Cells of the grids: (doc_id, page, rect_idx, rect_id, row, col, x, y, w, h) and the table's box with prefix t_."""
    tables = rects.where((F.col("rect_type") == "table") & F.col("table_grid").isNotNull())
    rows = tables.select("doc_id", "page", "rect_idx", "rect_id", *prefixed(_BOX, "t_"), F.posexplode("table_grid").alias("row", "cells"))
    return rows.select("*", F.posexplode("cells").alias("col", "cell")).select("doc_id", "page", "rect_idx", "rect_id", *(f"t_{c}" for c in _BOX), "row", "col", *(F.col(f"cell.{c}").alias(c) for c in _BOX))


def with_cells(items: DataFrame, rects: DataFrame) -> DataFrame:
    """Per item the first cell in row order, of the smallest table that holds it and has such a cell; adds table_id, table_row, table_col, cell_*."""
    i, t, c = box(), box("t_"), box("c_")
    cells = table_cells(rects).where(t.area > 0)
    others = cells.select(F.col("doc_id").alias("o_doc"), F.col("page").alias("o_page"), *prefixed(("rect_idx", "rect_id", "row", "col", *_BOX), "c_"), *(f"t_{k}" for k in _BOX))
    order = F.struct(t.area.alias("area"), "c_rect_idx", "c_row", "c_col", "c_rect_id", *(F.col(f"c_{k}") for k in _BOX))
    best = _choose(items, others, t.holds_centre_of(i) & c.holds_centre_of(i), order)
    return best.select(*items.columns, F.col("m.c_rect_id").alias("table_id"), F.col("m.c_row").alias("table_row"), F.col("m.c_col").alias("table_col"), *(F.col(f"m.c_{k}").alias(f"cell_{k}") for k in _BOX))


def match_cells(items: DataFrame, rects: DataFrame) -> DataFrame:
    return with_cells(_narrow(items), rects).drop(*_BOX)


def section_titles(boxed: DataFrame) -> DataFrame:
    """A1: per (doc_id, enclosing_box_id) the text of the largest, then topmost, then first item; blank gives no title."""
    order = F.struct(F.coalesce("font_size", F.lit(0.0)).alias("size"), (-F.col("y")).alias("up"), (-F.col("item_idx")).alias("first"))
    best = boxed.where(F.col("enclosing_box_id").isNotNull()).groupBy("doc_id", "enclosing_box_id").agg(F.max_by("text", order).alias("title"))
    return best.select("doc_id", "enclosing_box_id", strip(F.col("title")).alias("title")).where("title <> ''")


def fuse(items: DataFrame, blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """A4: items with their block, box, section title (A2) and table cell."""
    matched = with_cells(with_rects(with_blocks(items, blocks), rects), rects)
    by_box = Window.partitionBy("doc_id", "enclosing_box_id")
    order = F.struct(F.coalesce("font_size", F.lit(0.0)), -F.col("y"), -F.col("item_idx"))
    title = strip(F.max_by("text", order).over(by_box))
    titled = F.when(F.col("enclosing_box_id").isNotNull() & (title != "") & (strip(F.col("text")) != title), title)
    return matched.withColumn("section_title", titled)


def fusion_stats(fused: DataFrame) -> DataFrame:
    """A3: per document total_items, matched_to_block, matched_to_box, coverage."""
    n, blocks_ = F.count("*"), F.count_if(F.col("match_method") != "none")
    return fused.groupBy("doc_id").agg(n.alias("total_items"), blocks_.alias("matched_to_block"), F.count("enclosing_box_id").alias("matched_to_box"), F.round(F.coalesce(F.try_divide(blocks_.cast("double"), n), F.lit(0.0)), 4).alias("coverage"))


def items_in_box(fused: DataFrame, rect_id: str) -> DataFrame:
    """A5."""
    return fused.where(F.col("enclosing_box_id") == rect_id)


def items_in_cell(fused: DataFrame, table_id: str, row: int, col: int) -> DataFrame:
    """A6."""
    return fused.where((F.col("table_id") == table_id) & (F.col("table_row") == row) & (F.col("table_col") == col))


def point_lookup(relation: DataFrame, **key: object) -> DataFrame:
    """The one row of a key; raises ``KeyError`` if there is none."""
    found = relation
    for c, v in key.items():
        found = found.where(F.col(c) == v)
    found = found.limit(1)
    if found.isEmpty():
        raise KeyError(key)
    return found
