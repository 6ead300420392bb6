"""Provenance of items: text items, block, box, table cell, section path.

All relations grow with the documents, so they are merged: Spark takes a table for as small as its files, which are for
much alike rows, or for as small as before rows were made of it, and a broadcast would hold it on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, box, prefixed

KEY = ("doc_id", "item_idx")
_BOX = ("x", "y", "w", "h")


def text_items_of(fused: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_idx, source_idx): text items of the same page, box and text, all duplicates."""
    same = ("doc_id", "page", *_BOX, "text")
    return fused.select(*same, "item_idx").join(items.select(*same, F.col("item_idx").alias("source_idx")).hint("merge"), list(same)).select(*KEY, "source_idx")


def block_of(fused: DataFrame, blocks: DataFrame) -> DataFrame:
    """The smallest block of the item's label that holds its centre; none for items matched by overlap only."""
    own = fused.where(F.col("block_label").isNotNull()).select(*KEY, "page", *_BOX, F.col("block_label").alias("label"))
    found = own.join(blocks.select("doc_id", "page", "label", *prefixed(("block_idx", *_BOX), "b_")).hint("merge"), ["doc_id", "page", "label"]).where(box("b_").holds_centre_of(box()))
    best = found.groupBy("doc_id", "page", "label", "item_idx").agg(F.min(F.struct(box("b_").area.alias("area"), "b_block_idx")).alias("m"))
    return best.select(*KEY, F.col("m.b_block_idx").alias("block_idx"))


def box_of(fused: DataFrame, rects: DataFrame) -> DataFrame:
    """The first rectangle of the item's box id."""
    first = rects.groupBy("doc_id", F.col("rect_id").alias("enclosing_box_id")).agg(F.min("rect_idx").alias("rect_idx"))
    return fused.select(*KEY, "enclosing_box_id").join(first.hint("merge"), ["doc_id", "enclosing_box_id"]).select(*KEY, "rect_idx")


def cell_headers(fused: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, table_id, header_row, header_col): texts of the first row by column and of the first column by row."""
    grids = rects.where("rect_type = 'table' and size(table_grid) > 0").groupBy("doc_id", F.col("rect_id").alias("table_id")).agg(F.min_by("table_grid", "rect_idx").alias("grid"))
    texts = fused.where("table_id is not null and coalesce(text, '') <> ''")
    cells = texts.where("table_row = 0 or table_col = 0").groupBy("doc_id", "table_id", "table_row", "table_col").agg(
        F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_idx", "text"))), lambda s: s["text"]), " ")).alias("said"))
    one = cells.groupBy("doc_id", "table_id").agg(F.collect_list(F.struct(F.struct("table_row", "table_col").alias("key"), F.col("said").alias("value"))).alias("cells"))
    joined = grids.join(one.hint("merge"), ["doc_id", "table_id"], "left").withColumn("map", F.map_from_entries(F.coalesce("cells", F.array().cast(one.schema["cells"].dataType))))
    at = lambda r, c: F.coalesce(F.try_element_at("map", F.struct(r.alias("table_row"), c.alias("table_col"))), F.lit(""))
    return joined.select("doc_id", "table_id", F.transform(F.col("grid")[0], lambda _, c: at(F.lit(0), c)).alias("header_row"), F.transform("grid", lambda _, r: at(r, F.lit(0))).alias("header_col"))


def section_paths(fused: DataFrame, rects: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """(doc_id, item_idx, path): titles from the item's section outwards.

    One fold over the page's rectangles in order of area: each that holds the current box and is larger becomes it, and adds
    the text of its largest-font item unless blank or present. A rectangle smaller than the new box can't be its parent.
    """
    named = rects.where("rect_type <> 'checkbox'").withColumn("area", box().area)
    titles = fused.where("enclosing_box_id is not null").groupBy("doc_id", F.col("enclosing_box_id").alias("rect_id")).agg(F.max_by("text", F.struct(F.coalesce("font_size", F.lit(0.0)), -F.col("item_idx"))).alias("title"))
    page = named.join(titles.hint("merge"), ["doc_id", "rect_id"], "left").groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("area", "rect_idx", "rect_id", *_BOX, "title"))).alias("page_rects"))
    own = fused.select(*KEY, "page", "section_title", "enclosing_box_id").join(box_of(fused, rects).withColumnRenamed("rect_idx", "own_idx").hint("merge"), list(KEY), "left")
    own = own.join(rects.select("doc_id", F.col("rect_idx").alias("own_idx"), *prefixed(_BOX, "r_")).hint("merge"), ["doc_id", "own_idx"], "left").join(page.hint("merge"), ["doc_id", "page"], "left")
    start = F.when(F.coalesce("section_title", F.lit("")) != "", F.array("section_title")).otherwise(F.array().cast("array<string>"))

    def step(acc, r):
        now, outer = Box(*(acc[c] for c in _BOX)), Box(*(r[c] for c in _BOX))
        parent = outer.holds_box(now, tolerance) & (r["area"] > now.area)
        says = parent & (F.coalesce(r["title"], F.lit("")) != "") & ~F.array_contains(acc["path"], r["title"])
        return F.struct(*(F.when(parent, r[c]).otherwise(acc[c]).alias(c) for c in _BOX), F.when(says, F.array_append(acc["path"], r["title"])).otherwise(acc["path"]).alias("path"))

    fold = F.aggregate("page_rects", F.struct(*(F.col(f"r_{c}").alias(c) for c in _BOX), start.alias("path")), step, lambda a: a["path"])
    return own.select(*KEY, F.when(F.col("own_idx").isNull(), start).otherwise(F.coalesce(fold, start)).alias("path"))


def provenance(fused: DataFrame, items: DataFrame, blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """A10: the chain of every item."""
    key = list(KEY)
    texts = text_items_of(fused, items).groupBy(*key).agg(F.array_sort(F.collect_list("source_idx")).alias("text_items"))
    chain = fused
    for part in (texts, block_of(fused, blocks), box_of(fused, rects), section_paths(fused, rects)):
        chain = chain.join(part.hint("merge"), key, "left")
    return chain.join(cell_headers(fused, rects).hint("merge"), ["doc_id", "table_id"], "left")


def trace_values(typed: DataFrame, chains: DataFrame) -> DataFrame:
    """Chains of the source items of typed values; ids that don't exist are skipped."""
    return typed.select("doc_id", "field", F.explode("source_items").alias("item_idx")).join(chains.hint("merge"), ["doc_id", "item_idx"])
