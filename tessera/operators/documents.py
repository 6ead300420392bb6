"""Document outputs: model context, merged document, contained texts, payload rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import box, box_of, prefixed
from tessera.functions.text import is_bold, is_italic, normalize, strip
from tessera.operators.fuse import block_order, fusion_stats

_BOX = ("x", "y", "w", "h")
#: Labels that no context needs.
FURNITURE = ("page_header", "page_footer", "picture")
UNSECTIONED = "_unsectioned"
#: Columns of items that contexts and sources are made of.
SOURCE = ("item_idx", "page", *_BOX, "section_title", "block_label")
READ = ("item_idx", "page", "text", *_BOX, "section_title", "block_label")
IOU_FLOOR = 0.3


def is_useful(text: Column, label: Column) -> Column:
    """Text, and no furniture; an unlabelled item counts."""
    return (strip(F.coalesce(text, F.lit(""))) != "") & ~F.coalesce(label, F.lit("")).isin(*FURNITURE)


def context_sections(fused: DataFrame) -> DataFrame:
    """A12 in rows: (doc_id, section, first, items): sections in order of first sight, items (i, t) in order."""
    useful = fused.where(is_useful(F.col("text"), F.col("block_label")))
    said = strip(F.coalesce("section_title", F.lit("")))
    section = F.when(said == "", UNSECTIONED).otherwise(said)
    return useful.groupBy("doc_id", section.alias("section")).agg(F.min("item_idx").alias("first"), F.array_sort(F.collect_list(F.struct(F.col("item_idx").alias("i"), F.col("text").alias("t")))).alias("items"))


def llm_context(fused: DataFrame) -> DataFrame:
    """(doc_id, context): one JSON text per document."""
    sections = context_sections(fused)
    ordered = F.array_sort(F.collect_list(F.struct("first", "section", "items")))
    shown = F.transform(ordered, lambda s: F.struct(s["section"].alias("title"), s["items"].alias("items")))
    return sections.groupBy("doc_id").agg(F.to_json(F.struct(shown.alias("sections"))).alias("context"))


def _once(rows: DataFrame, kept: list[str], *columns: Column) -> DataFrame:
    """``kept`` and new columns that are evaluated once a row: projections may be put into each other, and a lambda would evaluate them for every item."""
    return rows.select(*kept, F.inline(F.array(F.struct(*columns))))


def by_document(fused: DataFrame) -> DataFrame:
    """(doc_id, items): a row per document, its items in no order, with what contexts and sources read."""
    return fused.groupBy("doc_id").agg(F.collect_list(F.struct(*READ)).alias("items"))


def fuse_documents(items: DataFrame, blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """As ``by_document`` of ``fuse``, with one exchange of each relation.

    The blocks and rectangles of a document come to its items as arrays, by page; the choices are minima of the same structs. Cells aren't read, so none are looked for.
    """
    own = [c for c in READ if c not in ("section_title", "block_label")]
    docs = items.groupBy("doc_id").agg(F.collect_list(F.struct(*own, F.coalesce("font_size", F.lit(0.0)).alias("size"))).alias("items"))
    for name, others in (
        ("blocks", blocks.select("doc_id", "page", "block_idx", "label", "heading_level", *_BOX)),
        ("boxes", rects.where((F.col("rect_type") != "checkbox") & (box().area > 0)).select("doc_id", "page", "rect_idx", "rect_id", *_BOX)),
    ):
        docs = docs.join(others.groupBy("doc_id").agg(F.collect_list(F.struct(*others.columns[1:])).alias(name)).hint("merge"), "doc_id", "left")
    by_page = lambda name: F.transform(F.array_distinct(F.transform(name, lambda o: o["page"])), lambda p: F.struct(p.alias("page"), F.filter(name, lambda o: o["page"] == p).alias("own"))).alias(name)
    least = lambda i, name, fits, order: F.array_min(F.transform(F.filter(F.get(F.filter(name, lambda p: p["page"] == i["page"]), F.lit(0))["own"], fits), order))

    def matched(i: Column) -> Column:
        a = box_of(i)
        near = lambda o: box_of(o).touches(a) & (box_of(o).holds_centre_of(a) | (box_of(o).iou(a) > 0))
        block = least(i, "blocks", near, lambda o: block_order(a, box_of(o), o["block_idx"], o["label"], o["heading_level"]))
        rect = least(i, "boxes", lambda o: box_of(o).holds_centre_of(a), lambda o: F.struct(box_of(o).area.alias("area"), o["rect_idx"].alias("rect_idx"), o["rect_id"].alias("rect_id")))
        return F.struct(i.alias("i"), block["label"].alias("label"), rect["rect_id"].alias("box"))

    docs = _once(_once(docs, ["doc_id", "items"], by_page("blocks"), by_page("boxes")), ["doc_id"], F.transform("items", matched).alias("own"))
    # items of a box side by side, that of its title last
    order = F.array_sort(F.transform(F.filter("own", lambda x: x["box"].isNotNull()), lambda x: F.struct(x["box"].alias("box"), x["i"]["size"].alias("size"), (-x["i"]["y"]).alias("up"), (-x["i"]["item_idx"]).alias("first"), x["i"]["text"].alias("text"))))
    lasts = F.filter("order", lambda o, k: ~F.get("order", k + 1)["box"].eqNullSafe(o["box"]))
    titles = F.map_from_entries(F.transform(lasts, lambda o: F.struct(o["box"], strip(o["text"]))))

    def titled(x: Column) -> Column:
        title = F.try_element_at("titles", x["box"])
        shown = F.when((title != "") & (strip(x["i"]["text"]) != title), title)
        columns = {c: x["i"][c] for c in own} | {"section_title": shown, "block_label": x["label"]}
        return F.struct(*(columns[c].alias(c) for c in READ))

    docs = _once(_once(docs, ["doc_id", "own"], order.alias("order")), ["doc_id", "own"], titles.alias("titles"))
    return docs.select("doc_id", F.transform("own", titled).alias("items"))


def prepared(docs: DataFrame) -> DataFrame:
    """(doc_id, context, norms, places) of documents that are a row each (doc_id, items), without an exchange.

    ``context`` as of ``llm_context``, or null; ``norms`` the normalised texts that aren't blank, in order, and ``places`` what bound values take of their items.
    """
    said = lambda i: strip(F.coalesce(i["section_title"], F.lit("")))
    named = lambda i: F.struct(F.when(said(i) == "", UNSECTIONED).otherwise(said(i)).alias("section"), i["item_idx"].alias("i"), i["text"].alias("t"))
    useful = F.array_sort(F.transform(F.filter("items", lambda i: is_useful(i["text"], i["block_label"])), named))
    begins = lambda own: F.filter(F.sequence(F.lit(0), F.size(own) - 1), lambda k: (k == 0) | (F.get(own, k)["section"] != F.get(own, k - 1)["section"]))

    def section(own: Column, begin: Column, end: Column) -> Column:
        first = F.get(own, begin)
        return F.struct(first["i"].alias("first"), first["section"].alias("section"), F.transform(F.slice(own, begin + 1, end - begin), lambda i: F.struct(i["i"].alias("i"), i["t"].alias("t"))).alias("items"))

    # a section's items lie side by side, from its beginning to that of the next one
    parts = lambda x: F.array_sort(F.transform(x["at"], lambda begin, n: section(x["own"], begin, F.coalesce(F.get(x["at"], n + 1), F.size(x["own"])))))
    shown = lambda x: F.transform(parts(x), lambda s: F.struct(s["section"].alias("title"), s["items"].alias("items")))
    placed = lambda i: F.struct(i["item_idx"].alias("item_idx"), normalize(F.coalesce(i["text"], F.lit(""))).alias("norm"), F.struct(*(i[c].alias(c) for c in SOURCE)).alias("place"))
    rows = _once(docs, ["doc_id"], useful.alias("own"), F.array_sort(F.filter(F.transform("items", placed), lambda i: i["norm"] != "")).alias("placed"))
    sections = F.flatten(F.transform(F.transform(F.array("own"), lambda own: F.struct(own.alias("own"), begins(own).alias("at"))), shown))
    return rows.select("doc_id", F.when(F.size("own") > 0, F.to_json(F.struct(sections.alias("sections")))).alias("context"), F.col("placed.norm").alias("norms"), F.col("placed.place").alias("places"))


def items_in_blocks(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """Every block with the items whose centre it holds; an item may be in several."""
    b = blocks.select("doc_id", "page", *prefixed(("block_idx", *_BOX), "b_"))
    return b.join(items, ["doc_id", "page"]).where(box("b_").holds_centre_of(box()))


def merged_spans(items: DataFrame, blocks: DataFrame) -> DataFrame:
    """A15 in rows: (doc_id, page, block_idx, label, spans) of blocks that are no tables; spans in reading order."""
    plain = blocks.where("label <> 'table'")
    inside = items_in_blocks(items, plain)
    span = F.struct("y", "x", "item_idx", F.coalesce("text", F.lit("")).alias("text"), "font_name", "font_size", is_bold(F.col("font_name")).alias("is_bold"), is_italic(F.col("font_name")).alias("is_italic"), "w", "h")
    spans = inside.groupBy("doc_id", "page", F.col("b_block_idx").alias("block_idx")).agg(F.array_sort(F.collect_list(span)).alias("spans"))
    return plain.join(spans, ["doc_id", "page", "block_idx"], "left")


def block_grids(blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, page, block_idx, rect_idx, table_grid): the gridded table of best IoU, from 0.3 on."""
    tables = rects.where("rect_type = 'table' and size(table_grid) > 0").select("doc_id", "page", "table_grid", *prefixed(("rect_idx", *_BOX), "r_"))
    b = blocks.where("label = 'table'").select("doc_id", "page", "block_idx", *_BOX)
    iou = box().iou(box("r_"))
    best = b.join(tables, ["doc_id", "page"]).where(box().touches(box("r_"))).groupBy("doc_id", "page", "block_idx").agg(F.max_by(F.struct("r_rect_idx", "table_grid"), F.struct(iou.alias("iou"), -F.col("r_rect_idx"))).alias("t"), F.max(iou).alias("iou"))
    return best.where(F.col("iou") >= IOU_FLOOR).select("doc_id", "page", "block_idx", F.col("t.r_rect_idx").alias("rect_idx"), F.col("t.table_grid").alias("table_grid"))


def merged_table_cells(items: DataFrame, blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, page, block_idx, row, col, item_idx, y, x, text): items of table blocks by cell of the matched grid.

    With a grid, items in no cell are left out; without one all are in cell (0, 0).
    """
    tables = blocks.where("label = 'table'")
    inside = items_in_blocks(items, tables).withColumnRenamed("b_block_idx", "block_idx")
    key = ["doc_id", "page", "block_idx"]
    gridded = inside.join(block_grids(blocks, rects).select(*key, "table_grid"), key, "left")
    cx, cy = box().cx, box().cy
    holds = lambda c: (cx >= c["x"]) & (cx <= c["x"] + c["w"]) & (cy >= c["y"]) & (cy <= c["y"] + c["h"])
    hits = F.flatten(F.transform("table_grid", lambda row, r: F.filter(F.transform(row, lambda c, k: F.when(holds(c), F.struct(r.alias("row"), k.alias("col")))), lambda s: s.isNotNull())))
    placed = gridded.withColumn("cell", F.when(F.col("table_grid").isNull(), F.struct(F.lit(0).alias("row"), F.lit(0).alias("col"))).otherwise(F.get(hits, F.lit(0))))
    return placed.where("cell is not null").select(*key, "cell.row", "cell.col", "item_idx", "y", "x", "text")


def _span() -> Column:
    """Of an item, in reading order: y, x, item_idx, then what a span shows."""
    return F.struct(
        "y", "x", "item_idx", F.coalesce("text", F.lit("")).alias("text"), "font_name", "font_size",
        is_bold(F.col("font_name")).alias("is_bold"), is_italic(F.col("font_name")).alias("is_italic"), _quad(),
    )


_SPAN = "struct<text:string,font_name:string,font_size:double,is_bold:boolean,is_italic:boolean,bbox:array<double>>"


def _shown(spans: Column) -> Column:
    """Spans in reading order, without what orders them."""
    return F.transform(F.array_sort(spans), lambda s: F.struct(*(s[c].alias(c) for c in ("text", "font_name", "font_size", "is_bold", "is_italic", "bbox"))))


def merged_blocks(items: DataFrame, blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """O3, A16 in rows: (doc_id, pos, page, block_idx, label, level, layer, bbox, spans or cells), blocks by page, y, x, then input order.

    A table has ``cells``, a matrix of lists of spans: of the shape of its grid, with items in no cell left out; without a
    grid of the shape of ``blocks.cells`` (if the relation has them) or 1 x 1, with all spans in the first cell.
    """
    key = ["doc_id", "page", "block_idx"]
    own = blocks if "cells" in blocks.columns else blocks.withColumn("cells", F.lit(None).cast("array<array<string>>"))
    inside = items_in_blocks(items, own.select("doc_id", "page", "block_idx", *_BOX)).withColumnRenamed("b_block_idx", "block_idx")
    spans = inside.groupBy(*key).agg(F.collect_list(_span()).alias("found"))
    grids = block_grids(blocks, rects).select(*key, "table_grid")
    every = own.join(spans, key, "left").join(grids, key, "left")
    none = F.array().cast(f"array<{_SPAN}>")
    wide = lambda rows: F.array_max(F.transform(rows, lambda r: F.size(r)))
    found = F.coalesce("found", F.array().cast(spans.schema["found"].dataType))
    holds = lambda c, s: (s["x"] + s["bbox"][2] / 2).between(c["x"], c["x"] + c["w"]) & (s["y"] + s["bbox"][3] / 2).between(c["y"], c["y"] + c["h"])
    # the first cell in row order that holds the span's centre, as one number
    first = lambda s: F.array_min(F.flatten(F.transform("table_grid", lambda row, r: F.transform(row, lambda c, k: F.when(c.isNotNull() & holds(c, s), r * 100_000 + k)))))
    placed = F.transform(found, lambda s: F.struct(first(s).alias("cell"), s.alias("span")))
    every = every.withColumn("placed", F.when(F.col("table_grid").isNotNull(), placed))
    n_rows, n_cols = (F.coalesce(x, F.lit(1)) for x in (F.size(F.coalesce("table_grid", "cells_shape")), wide(F.coalesce("table_grid", "cells_shape"))))
    shape = F.transform("cells", lambda row: F.transform(row, lambda c: F.lit(None).cast("struct<x:double,y:double,w:double,h:double>")))
    every = every.withColumn("cells_shape", F.when(F.size("cells") > 0, shape)).withColumns({"n_rows": F.greatest(n_rows, F.lit(1)), "n_cols": F.greatest(n_cols, F.lit(1))})
    inner = lambda r, k: F.when(
        F.col("placed").isNotNull(), _shown(F.transform(F.filter("placed", lambda p: p["cell"] == r * 100_000 + k), lambda p: p["span"])),
    ).when((r == 0) & (k == 0), _shown(found)).otherwise(none)
    matrix = F.transform(F.sequence(F.lit(0), F.col("n_rows") - 1), lambda r: F.transform(F.sequence(F.lit(0), F.col("n_cols") - 1), lambda k: inner(r, k)))
    is_table = F.col("label") == "table"
    order = Window.partitionBy("doc_id").orderBy("page", "y", "x", "block_idx")
    return every.select(
        "doc_id", (F.row_number().over(order) - 1).cast("int").alias("pos"), "page", "block_idx", "label", F.col("heading_level").alias("level"), F.coalesce("content_layer", F.lit("body")).alias("layer"), _quad(),
        F.when(~is_table, _shown(found)).alias("spans"), F.when(is_table, matrix).alias("cells"),
    )


def merged_document(docs: DataFrame, items: DataFrame, blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, page_count, blocks) of every document of ``docs``; without blocks none and no page."""
    rows = merged_blocks(items, blocks, rects)
    block = F.struct("pos", *(c for c in rows.columns if c not in ("doc_id", "pos")))
    one = rows.groupBy("doc_id").agg(F.max("page").alias("page_count"), F.array_sort(F.collect_list(block)).alias("blocks"))
    return docs.select("doc_id").distinct().join(one, "doc_id", "left").select("doc_id", F.coalesce("page_count", F.lit(0)).alias("page_count"), F.coalesce("blocks", F.array().cast(one.schema["blocks"].dataType)).alias("blocks"))


def contained_text(regions: DataFrame, items: DataFrame, key: str) -> DataFrame:
    """(doc_id, key, contained_text): texts of the items inside a region in input order, joined by blanks."""
    r = regions.select("doc_id", "page", key, *prefixed(_BOX, "r_"))
    inside = r.join(items.select("doc_id", "page", "item_idx", strip(F.coalesce("text", F.lit(""))).alias("said"), *_BOX).where("said <> ''"), ["doc_id", "page"]).where(box("r_").holds_centre_of(box()))
    texts = inside.groupBy("doc_id", "page", key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("item_idx", "said"))), lambda s: s["said"]), " ").alias("contained_text"))
    return r.select("doc_id", "page", key).join(texts, ["doc_id", "page", key], "left").withColumn("contained_text", F.coalesce("contained_text", F.lit("")))


def _quad() -> Column:
    return F.array(*(F.col(c) for c in _BOX)).alias("bbox")


def text_items_payload(items: DataFrame) -> DataFrame:
    """One JSON text per item."""
    return items.select("doc_id", "item_idx", F.to_json(F.struct(F.coalesce("text", F.lit("")).alias("text"), F.col("font_name").alias("font"), F.col("font_size").alias("size"), "page", _quad())).alias("payload"))


def blocks_payload(blocks: DataFrame, items: DataFrame) -> DataFrame:
    """One JSON text per block, with its first 120 characters, and its cells or else the contained text."""
    said = contained_text(blocks, items, "block_idx")
    own = blocks if "cells" in blocks.columns else blocks.withColumn("cells", F.lit(None).cast("array<array<string>>"))
    cells = F.when(F.size("cells") > 0, F.col("cells")).alias("cells")
    text = F.when(F.coalesce(F.size("cells"), F.lit(0)) <= 0, F.col("contained_text")).alias("contained_text")
    return own.join(said, ["doc_id", "page", "block_idx"]).select("doc_id", "block_idx", F.to_json(F.struct("label", F.col("heading_level").alias("level"), F.col("content_layer").alias("layer"), "page", _quad(), F.left(F.coalesce("text", F.lit("")), F.lit(120)).alias("text"), cells, text)).alias("payload"))


def rects_payload(rects: DataFrame, items: DataFrame) -> DataFrame:
    """Rectangle rows with the shape of the grid, and the cells if there are any or else the contained text."""
    said = contained_text(rects, items, "rect_idx")
    cols = F.array_max(F.transform("table_grid", lambda r: F.size(r)))
    shape = F.when(F.size("table_grid") > 0, F.concat(F.size("table_grid").cast("string"), F.lit(" rows x "), cols.cast("string"), F.lit(" cols")))
    text = F.when(F.coalesce(F.size("cells"), F.lit(0)) <= 0, F.col("contained_text")).alias("contained_text") if "cells" in rects.columns else F.col("contained_text")
    return rects.withColumn("grid_shape", shape).join(said, ["doc_id", "page", "rect_idx"]).select("doc_id", "rect_idx", "rect_id", "rect_type", "is_filled", "page", _quad(), "grid_shape", *(["cells"] if "cells" in rects.columns else []), text)


def fusion_payload(fused: DataFrame, n: int = 3) -> DataFrame:
    """(doc_id, items_count, matched_to_block, matched_to_box, coverage, sample_texts) of a fusion."""
    return fusion_stats(fused).withColumnRenamed("total_items", "items_count").join(first_texts(fused, n).select("doc_id", "sample_texts"), "doc_id")


def step_boxes(items: DataFrame, blocks: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, kind, idx, page, x, y, w, h): all boxes of a document, texts first, then blocks, then rectangles."""
    own = lambda rows, kind, idx: rows.select("doc_id", F.lit(kind).alias("kind"), F.col(idx).alias("idx"), "page", *_BOX)
    return own(items, "0-text", "item_idx").unionByName(own(blocks, "1-block", "block_idx")).unionByName(own(rects, "2-rect", "rect_idx"))


def first_texts(items: DataFrame, n: int = 3) -> DataFrame:
    """Count and the first texts of each document."""
    sample = F.array_sort(F.collect_list(F.when((F.col("item_idx") < n) & (F.col("text") != ""), F.struct("item_idx", "text"))))
    return items.groupBy("doc_id").agg(F.count("*").alias("items_count"), F.array_join(F.transform(sample, lambda s: s["text"]), " | ").alias("sample_texts"))
