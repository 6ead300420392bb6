"""Queries over layouts: geometry, fusion, rectangles, pairing, traces, documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.geometry import box, from_edges, prefixed
from tessera.operators import documents, fuse, pairing, rects, trace
from tessera.operators.pairing import FieldSpec
from tessera.plans import layouts
from tessera.plans.catalog import query
from tessera.sources import engines
from tessera.sources.staging import staged

_L = layouts.LAYOUT_SQL


def _overlap(a: str, b: str) -> str:
    return (
        f"greatest(0.0, least({a}.x + {a}.w, {b}.x + {b}.w) - greatest({a}.x, {b}.x)) * greatest(0.0, least({a}.y + {a}.h, {b}.y + {b}.h) - greatest({a}.y, {b}.y))"
    )


def _area(a: str) -> str:
    return f"(greatest(0.0, {a}.w) * greatest(0.0, {a}.h))"


def _holds(o: str, i: str) -> str:
    return f"({i}.x + {i}.w / 2 BETWEEN {o}.x AND {o}.x + {o}.w AND {i}.y + {i}.h / 2 BETWEEN {o}.y AND {o}.y + {o}.h)"


def _iou(a: str, b: str) -> str:
    union = f"({_area(a)} + {_area(b)} - {_overlap(a, b)})"
    return f"(CASE WHEN {union} > 0 THEN ({_overlap(a, b)}) / {union} ELSE 0.0 END)"


_BASE = f"items AS MATERIALIZED ({_L['items']}), blocks AS MATERIALIZED ({_L['blocks']}), rects AS MATERIALIZED ({_L['rects']})"
_MB = f"""mb0 AS (
  SELECT i.doc_id, i.page, i.item_idx, b.block_idx, b.label, b.heading_level, {_holds('b', 'i')} AS hit, {_area('b')} AS area, {_iou('b', 'i')} AS iou
  FROM items i JOIN blocks b ON i.doc_id = b.doc_id AND i.page = b.page
), mb1 AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id, item_idx ORDER BY CASE WHEN hit THEN 0 ELSE 1 END, CASE WHEN hit THEN 0.0 ELSE -iou END, area, block_idx) AS rn FROM mb0 WHERE hit OR iou > 0
), mb AS (
  SELECT i.doc_id, i.page, i.item_idx, block_idx, label AS block_label, heading_level AS block_heading_level,
         CASE WHEN hit THEN 'centroid' WHEN hit IS NOT NULL THEN 'iou' ELSE 'none' END AS match_method,
         round(CASE WHEN hit THEN 1.0 WHEN hit IS NOT NULL THEN iou ELSE 0.0 END, 4) AS match_score
  FROM items i LEFT JOIN mb1 ON i.doc_id = mb1.doc_id AND i.item_idx = mb1.item_idx AND rn = 1
)"""
_MR = f"""mr1 AS (
  SELECT i.doc_id, i.item_idx, r.rect_idx, r.rect_id, row_number() OVER (PARTITION BY i.doc_id, i.item_idx ORDER BY {_area('r')}, r.rect_idx) AS rn
  FROM items i JOIN rects r ON i.doc_id = r.doc_id AND i.page = r.page WHERE r.rect_type <> 'checkbox' AND {_area('r')} > 0 AND {_holds('r', 'i')}
), mr AS (SELECT i.doc_id, i.page, i.item_idx, rect_idx AS box_rect_idx, rect_id AS enclosing_box_id FROM items i LEFT JOIN mr1 ON i.doc_id = mr1.doc_id AND i.item_idx = mr1.item_idx AND rn = 1)"""
_MC = f"""cells AS (
  SELECT doc_id, page, rect_idx, rect_id, t.x AS tx, t.y AS ty, t.w AS tw, t.h AS th, CAST(r AS INT) AS row, CAST(c AS INT) AS col, t.x + c * (t.w / 3) AS x, t.y + r * (t.h / 3) AS y, t.w / 3 AS w, t.h / 3 AS h
  FROM rects t, range(0, 3) AS a(r), range(0, 3) AS b(c) WHERE rect_type = 'table'
), mc1 AS (
  SELECT i.doc_id, i.item_idx, c.rect_id, c.row, c.col, c.x, c.y, c.w, c.h, row_number() OVER (PARTITION BY i.doc_id, i.item_idx ORDER BY c.tw * c.th, c.rect_idx, c.row, c.col) AS rn
  FROM items i JOIN cells c ON i.doc_id = c.doc_id AND i.page = c.page
  WHERE c.tw * c.th > 0 AND i.x + i.w / 2 BETWEEN c.tx AND c.tx + c.tw AND i.y + i.h / 2 BETWEEN c.ty AND c.ty + c.th AND {_holds('c', 'i')}
), mc AS (SELECT i.doc_id, i.page, i.item_idx, rect_id AS table_id, row AS table_row, col AS table_col, mc1.x AS cell_x, mc1.y AS cell_y, mc1.w AS cell_w, mc1.h AS cell_h FROM items i LEFT JOIN mc1 ON i.doc_id = mc1.doc_id AND i.item_idx = mc1.item_idx AND rn = 1)"""
_TITLES = """t1 AS (
  SELECT mr.doc_id, enclosing_box_id, trim(text) AS title, row_number() OVER (PARTITION BY mr.doc_id, enclosing_box_id ORDER BY coalesce(font_size, 0) DESC, y, i.item_idx) AS rn
  FROM mr JOIN items i ON i.doc_id = mr.doc_id AND i.item_idx = mr.item_idx WHERE enclosing_box_id IS NOT NULL
), titles AS (SELECT doc_id, enclosing_box_id, title FROM t1 WHERE rn = 1 AND title <> '')"""
_FUSED = """fused AS (
  SELECT i.*, block_idx, block_label, block_heading_level, match_method, match_score, mr.enclosing_box_id, CASE WHEN trim(text) <> title THEN title END AS section_title, table_id, table_row, table_col, cell_x, cell_y, cell_w, cell_h
  FROM items i JOIN mb USING (doc_id, item_idx) JOIN mr USING (doc_id, item_idx) JOIN mc USING (doc_id, item_idx) LEFT JOIN titles ON titles.doc_id = mr.doc_id AND titles.enclosing_box_id = mr.enclosing_box_id
)"""
FUSED_SQL = f"WITH {_BASE}, {_MB}, {_MR}, {_MC}, {_TITLES}, {_FUSED}"


def _relations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return layouts.items(spark, sf_dir), layouts.blocks(spark, sf_dir), layouts.rects(spark, sf_dir)


def fused_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.fuse(*_relations(spark, sf_dir))


def _written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For queries that read it more than once."""
    return staged(fused_items(spark, sf_dir), "fused")


# --- geometry


@query(f"WITH blocks AS ({_L['blocks']}) SELECT doc_id, block_idx, {_area('b')} AS area, x + w / 2 AS cx, y + h / 2 AS cy, x + w AS edge_right, y + h AS edge_bottom FROM blocks b")
def geom_area_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = box()
    return layouts.blocks(spark, sf_dir).select("doc_id", "block_idx", b.area.alias("area"), b.cx.alias("cx"), b.cy.alias("cy"), b.right.alias("edge_right"), b.bottom.alias("edge_bottom"))


@query(f"WITH b AS ({_L['blocks']}), r AS ({_L['rects']}) SELECT b.doc_id, b.block_idx, r.rect_idx, round({_iou('b', 'r')}, 6) AS iou FROM b JOIN r ON b.doc_id = r.doc_id AND b.page = r.page WHERE {_iou('b', 'r')} > 0")
def geom_iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b, r = box("b_"), box()
    own = layouts.blocks(spark, sf_dir).select("doc_id", "page", *prefixed(("block_idx", "x", "y", "w", "h"), "b_"))
    near = own.join(layouts.rects(spark, sf_dir), ["doc_id", "page"]).where(b.touches(r) & (b.iou(r) > 0))
    return near.select("doc_id", F.col("b_block_idx").alias("block_idx"), "rect_idx", F.round(b.iou(r), 6).alias("iou"))


@query(f"""WITH b AS ({_L['blocks']}), r AS ({_L['rects']}) SELECT b.doc_id, r.rect_idx, b.block_idx FROM b JOIN r ON b.doc_id = r.doc_id AND b.page = r.page
  WHERE b.x >= r.x - 0.5 AND b.y >= r.y - 0.5 AND b.x + b.w <= r.x + r.w + 0.5 AND b.y + b.h <= r.y + r.h + 0.5""")
def geom_contains_tol(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = layouts.rects(spark, sf_dir).select("doc_id", "page", *prefixed(("rect_idx", "x", "y", "w", "h"), "r_"))
    return layouts.blocks(spark, sf_dir).join(r, ["doc_id", "page"]).where(box("r_").holds_box(box())).select("doc_id", F.col("r_rect_idx").alias("rect_idx"), "block_idx")


@query(f"WITH i AS ({_L['items']}) SELECT doc_id, page, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h FROM i GROUP BY doc_id, page")
def geom_union_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = box()
    edges = layouts.items(spark, sf_dir).groupBy("doc_id", "page").agg(F.min("x").alias("l"), F.min("y").alias("t"), F.max(b.right).alias("r"), F.max(b.bottom).alias("b"))
    return edges.select("doc_id", "page", from_edges(*(F.col(c) for c in "ltrb")).alias("u")).select("doc_id", "page", "u.*")


# --- fusion


@query(f"WITH items AS MATERIALIZED ({_L['items']}), blocks AS MATERIALIZED ({_L['blocks']}), {_MB} SELECT * FROM mb")
def fused_block_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.match_blocks(layouts.items(spark, sf_dir), layouts.blocks(spark, sf_dir))


@query(f"WITH items AS MATERIALIZED ({_L['items']}), rects AS MATERIALIZED ({_L['rects']}), {_MR} SELECT * FROM mr")
def fused_enclosing_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.match_rects(layouts.items(spark, sf_dir), layouts.rects(spark, sf_dir))


@query(f"WITH items AS MATERIALIZED ({_L['items']}), rects AS MATERIALIZED ({_L['rects']}), {_MC} SELECT * FROM mc")
def fused_table_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.match_cells(layouts.items(spark, sf_dir), layouts.rects(spark, sf_dir))


@query(f"WITH items AS MATERIALIZED ({_L['items']}), rects AS MATERIALIZED ({_L['rects']}), {_MR}, {_TITLES} SELECT * FROM titles")
def fused_section_title(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.section_titles(fuse.with_rects(layouts.items(spark, sf_dir), layouts.rects(spark, sf_dir)))


_FUSED_COLUMNS = "doc_id, item_idx, page, text, block_label, block_heading_level, match_method, match_score, enclosing_box_id, section_title, table_id, table_row, table_col, cell_x, cell_y"


@query(f"{FUSED_SQL} SELECT {_FUSED_COLUMNS} FROM fused")
def fused_items_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fused_items(spark, sf_dir).select(*_FUSED_COLUMNS.split(", "))


@query(f"""WITH {_BASE}, {_MB}, {_MR} SELECT mb.doc_id, count(*) AS total_items, count(*) FILTER (WHERE match_method <> 'none') AS matched_to_block, count(enclosing_box_id) AS matched_to_box,
  round(count(*) FILTER (WHERE match_method <> 'none') / CAST(count(*) AS DOUBLE), 4) AS coverage FROM mb JOIN mr USING (doc_id, item_idx) GROUP BY mb.doc_id""")
def fusion_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, blocks, own = _relations(spark, sf_dir)
    return fuse.fusion_stats(fuse.with_rects(fuse.with_blocks(items, blocks), own))


@query(f"{FUSED_SQL} SELECT doc_id, item_idx, text FROM fused WHERE enclosing_box_id = 'p1-r4'")
def items_in_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.items_in_box(fused_items(spark, sf_dir), "p1-r4").select("doc_id", "item_idx", "text")


@query(f"{FUSED_SQL} SELECT doc_id, item_idx, text FROM fused WHERE table_id = 'p1-r2' AND table_row = 1 AND table_col = 2")
def items_in_cell(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.items_in_cell(fused_items(spark, sf_dir), "p1-r2", 1, 2).select("doc_id", "item_idx", "text")


@query(f"WITH items AS ({_L['items']}), s AS (SELECT * FROM items WHERE item_idx < 3 AND text <> '') SELECT i.doc_id, count(*) AS items_count, (SELECT string_agg(text, ' | ' ORDER BY item_idx) FROM s WHERE s.doc_id = i.doc_id) AS sample_texts FROM items i GROUP BY i.doc_id")
def step_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.first_texts(layouts.items(spark, sf_dir))


@query(f"{FUSED_SQL} SELECT doc_id, item_idx, page, text, block_label, enclosing_box_id, section_title FROM fused WHERE doc_id = 7 AND item_idx = 3")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One item by its key."""
    return fuse.point_lookup(fused_items(spark, sf_dir), doc_id=7, item_idx=3).select("doc_id", "item_idx", "page", "text", "block_label", "enclosing_box_id", "section_title")


# --- rectangles

_CLASS = """CASE WHEN w BETWEEN 5 AND 22 AND h BETWEEN 5 AND 22 AND abs(w - h) / greatest(w, h) <= 0.35 THEN 'checkbox'
  WHEN w >= 80 AND h <= 25 AND y / 792.0 >= 0.75 THEN 'signature_field' ELSE 'box' END"""


@query(f"WITH r AS (SELECT doc_id, rect_idx, 'r' AS kind, w, h, y FROM ({_L['rects']}) UNION ALL SELECT doc_id, block_idx, 'b', w, h / 4, y FROM ({_L['blocks']})) SELECT doc_id, rect_idx, kind, {_CLASS} AS rect_type FROM r")
def rect_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layouts.rects(spark, sf_dir).select("doc_id", "rect_idx", F.lit("r").alias("kind"), "w", "h", "y")
    low = layouts.blocks(spark, sf_dir).select("doc_id", F.col("block_idx").alias("rect_idx"), F.lit("b").alias("kind"), "w", (F.col("h") / 4).alias("h"), "y")
    return own.union(low).select("doc_id", "rect_idx", "kind", rects.rect_type(F.col("w"), F.col("h"), F.col("y"), F.lit(792.0)).alias("rect_type"))


@query(f"""WITH r AS ({_L['rects']}) SELECT c.doc_id, c.page, c.rect_idx, coalesce(bool_or(r.rect_idx IS NOT NULL), false) AS filled FROM r c LEFT JOIN r ON r.doc_id = c.doc_id AND r.page = c.page AND r.rect_idx <> c.rect_idx
  AND r.x >= c.x AND r.y >= c.y AND r.x + r.w <= c.x + c.w AND r.y + r.h <= c.y + c.h AND r.w * r.h >= 0.25 * (c.w * c.h) WHERE c.rect_type <> 'checkbox' GROUP BY ALL""")
def checkbox_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = layouts.rects(spark, sf_dir)
    return rects.filled_by_overlap(own.where("rect_type <> 'checkbox'"), own)


@query("SELECT o_orderkey AS doc_id, (o_custkey % 3 <> 0 AND o_custkey % 3 IS NOT NULL) OR o_orderstatus = 'F' AS filled FROM orders")
def rect_looks_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = layouts.table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("doc_id"), rects.looks_filled(F.col("o_orderstatus") == "F", F.col("o_custkey") % 3).alias("filled"))


@query(f"""WITH r AS ({_L['rects']}) SELECT doc_id, rect_id, CAST(r AS INT) AS row, CAST(2 + (r + rect_idx) % 2 AS BIGINT) AS n_cells FROM r, range(0, 3) AS a(r) WHERE rect_type = 'table'""")
def table_grid_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grids with a cell missing in every second row."""
    holed = F.transform("table_grid", lambda row, r: F.transform(row, lambda c, k: F.when((k < 2) | ((r + F.col("rect_idx")) % 2 == 1), c)))
    grids = layouts.rects(spark, sf_dir).where("rect_type = 'table'").select("doc_id", "rect_id", F.posexplode(rects.clean_grid(holed)).alias("row", "cells"))
    return grids.select("doc_id", "rect_id", "row", F.size("cells").cast("long").alias("n_cells"))


_RAW_RECTS = "SELECT CAST(floor(o_orderkey / 30.0) AS BIGINT) AS doc_id, CAST(o_orderkey % 2 + 1 AS INT) AS page, CAST(o_orderkey % 30 AS INT) AS seq, CAST((o_custkey * 17) % 420 AS DOUBLE) AS x0, CAST((o_orderkey * 29) % 780 AS DOUBLE) AS top, CAST((o_custkey * 17) % 420 + CASE WHEN o_orderkey % 3 = 0 THEN 6 + o_custkey % 14 ELSE 4 + (o_custkey * 5) % 200 END AS DOUBLE) AS x1, CAST((o_orderkey * 29) % 780 + CASE WHEN o_orderkey % 3 = 0 THEN 6 + o_custkey % 14 ELSE 4 + (o_orderkey * 3) % 40 END AS DOUBLE) AS bottom, o_orderkey % 7 = 0 AS fill, CASE WHEN o_orderkey % 5 = 0 THEN CAST(o_custkey % 2 AS INT) END AS non_stroking, CAST(792 AS DOUBLE) AS page_height FROM orders WHERE o_orderkey % 30 < 26"
_RAW_TABLES = "SELECT CAST(floor(o_orderkey / 30.0) AS BIGINT) AS doc_id, CAST(o_orderkey % 2 + 1 AS INT) AS page, CAST(o_orderkey % 30 - 26 AS INT) AS seq, CAST(o_custkey % 300 AS DOUBLE) AS x0, CAST(o_custkey % 500 AS DOUBLE) AS top, CAST(o_custkey % 300 + 200 AS DOUBLE) AS x1, CAST(o_custkey % 500 + 90 AS DOUBLE) AS bottom FROM orders WHERE o_orderkey % 30 >= 26"


@query(f"""WITH r AS ({_RAW_RECTS}), t AS ({_RAW_TABLES}), c AS (
  SELECT doc_id, page, seq, x0 AS x, top AS y, x1 - x0 AS w, bottom - top AS h, coalesce(non_stroking <> 0, false) OR coalesce(fill, false) AS coloured FROM r),
 k AS (SELECT *, {_CLASS} AS rect_type FROM c),
 f AS (SELECT k.*, coloured OR (rect_type = 'checkbox' AND EXISTS (SELECT 1 FROM k i WHERE i.doc_id = k.doc_id AND i.page = k.page AND i.seq <> k.seq AND i.x >= k.x AND i.y >= k.y AND i.x + i.w <= k.x + k.w AND i.y + i.h <= k.y + k.h AND i.w * i.h >= 0.25 * k.w * k.h)) AS is_filled FROM k),
 u AS (SELECT doc_id, page, 0 AS part, seq, x0 AS x, top AS y, x1 - x0 AS w, bottom - top AS h, 'p' || page || '-t' || seq AS rect_id, 'table' AS rect_type, false AS is_filled, seq % 2 = 0 AS gridded FROM t
  UNION ALL SELECT doc_id, page, 1, seq, x, y, w, h, 'p' || page || '-r' || seq, rect_type, is_filled, false FROM f)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY page, part, seq) - 1 AS INT) AS rect_idx, page, x, y, w, h, rect_id, rect_type, rect_type = 'checkbox' AS is_checkbox, is_filled,
  CASE WHEN gridded THEN '2,1' END AS grid_shape, CASE WHEN part = 0 AND seq % 3 <> 2 THEN 'a||b' END AS cells FROM u""")
def engine_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a vector engine gives, some cells missing, every second table without a grid."""
    layouts.table(spark, sf_dir, "orders").createOrReplaceTempView("engine_orders")
    own, tables = (spark.sql(q.replace("FROM orders", "FROM engine_orders")) for q in (_RAW_RECTS, _RAW_TABLES))
    cell = "named_struct('x', x0, 'y', top, 'w', 100D, 'h', 45D)"
    grid = f"CASE WHEN seq % 2 = 0 THEN array(array({cell}, {cell}), array(CAST(NULL AS STRUCT<x:DOUBLE,y:DOUBLE,w:DOUBLE,h:DOUBLE>)), array(CAST(NULL AS STRUCT<x:DOUBLE,y:DOUBLE,w:DOUBLE,h:DOUBLE>), {cell})) END"
    tables = tables.withColumns({"grid": F.expr(grid), "texts": F.expr("CASE WHEN seq % 3 <> 2 THEN array(array('a', NULL, 'b')) END")})
    found = engines.rects_of(own, tables)
    shape = F.array_join(F.transform("table_grid", lambda r: F.size(r).cast("string")), ",")
    return found.select("doc_id", "rect_idx", "page", "x", "y", "w", "h", "rect_id", "rect_type", "is_checkbox", "is_filled", shape.alias("grid_shape"), F.array_join(F.get("cells", F.lit(0)), "|").alias("cells"))


_RAW_BLOCKS = "SELECT CAST(floor(o_orderkey / 30.0) AS BIGINT) AS doc_id, CAST(o_orderkey % 30 AS INT) AS seq, CASE WHEN o_orderkey % 11 = 0 THEN 'background' WHEN o_orderkey % 4 = 0 THEN 'furniture' ELSE 'body' END AS layer, CASE o_orderkey % 3 WHEN 0 THEN 'section_header' WHEN 1 THEN 'table' ELSE 'text' END AS label, CAST(o_orderkey % 3 + 1 AS INT) AS level, CASE WHEN o_orderkey % 5 > 0 THEN concat('block ', CAST(o_orderkey AS STRING)) END AS text, CAST(o_orderkey % 3 AS INT) AS page, CAST(o_custkey % 300 AS DOUBLE) AS l, CAST(o_custkey % 500 AS DOUBLE) AS t, o_orderkey % 7 AS seventh FROM orders"


@query(f"""WITH r AS ({_RAW_BLOCKS}) SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY seq) - 1 AS INT) AS block_idx, page, l AS x, CASE WHEN seq % 2 = 0 THEN 792 - (t + 40) ELSE t END AS y, CAST(120 AS DOUBLE) AS w, CAST(40 AS DOUBLE) AS h, label,
  CASE WHEN label = 'section_header' THEN level END AS heading_level, layer AS content_layer, coalesce(text, '') AS text, CASE WHEN label = 'table' AND seq % 2 = 1 THEN 'x|;|y' END AS cells FROM r WHERE layer <> 'background' AND seventh <> 0 AND page > 0""")
def engine_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a semantic engine gives: some stand nowhere, some on a page without a height, half measured from the bottom."""
    layouts.table(spark, sf_dir, "orders").createOrReplaceTempView("engine_orders")
    raw = spark.sql(_RAW_BLOCKS.replace("FROM orders", "FROM engine_orders"))
    place = "named_struct('page', page, 'l', l + 120, 't', CASE WHEN seq % 2 = 0 THEN t + 40 ELSE t END, 'r', l, 'b', CASE WHEN seq % 2 = 0 THEN t ELSE t + 40 END, 'origin', CASE WHEN seq % 2 = 0 THEN 'bottom' ELSE 'top' END)"
    other = "named_struct('page', 9, 'l', 0D, 't', 0D, 'r', 1D, 'b', 1D, 'origin', 'top')"
    grid = "CASE WHEN seq % 2 = 1 THEN array(array(named_struct('text', 'x'), named_struct('text', CAST(NULL AS STRING))), array(CAST(NULL AS STRUCT<text:STRING>), named_struct('text', 'y'))) ELSE array() END"
    raw = raw.withColumns({"prov": F.expr(f"CASE WHEN seventh = 0 THEN array() ELSE array({place}, {other}) END"), "grid": F.expr(grid)})
    pages = raw.select("doc_id", "page").distinct().withColumn("height", F.when(F.col("page") > 0, 792.0))
    said = F.array_join(F.transform("cells", lambda row: F.array_join(row, "|")), ";")
    return engines.blocks_of(raw, pages).withColumn("cells", said)


# --- pairing

_LABEL = "regexp_matches(text, ':\\s*$')"
_FORM = f"WITH form AS MATERIALIZED ({_L['form']}), form_rects AS MATERIALIZED ({_L['form_rects']})"
SPECS = [
    FieldSpec("pedido.fecha", ("Fecha",), True), FieldSpec("pedido.importe", ("Importe",), True), FieldSpec("cliente"),
    FieldSpec("estado", ("Estado",), False, ("F", "O", "P")), FieldSpec("pedido.numero", ("Número",), True),
]


def fused_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    form, boxes = layouts.form(spark, sf_dir), layouts.form_rects(spark, sf_dir)
    none = layouts.blocks(spark, sf_dir).where("false")
    return fuse.fuse(form, none, boxes)


@query(f"""{_FORM}, rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY y, x, item_idx) AS rn FROM form),
 p AS (SELECT l.doc_id, l.rn, l.text AS label, v.text AS value, row_number() OVER (PARTITION BY l.doc_id, l.item_idx ORDER BY v.x - (l.x + l.w), v.rn) AS k
  FROM rk l JOIN rk v ON l.doc_id = v.doc_id AND v.rn > l.rn AND abs((v.y + v.h / 2) - (l.y + l.h / 2)) <= 4 AND v.x >= l.x + l.w AND v.text NOT LIKE '%:' WHERE l.text LIKE '%:')
 SELECT doc_id, rtrim(label, ':') AS label, value FROM p WHERE k = 1""")
def pair_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.pair_labels(fused_form(spark, sf_dir))


_LABELS = """labels AS (SELECT doc_id, item_idx, x, y, w, h, CASE text WHEN 'Fecha:' THEN 0 WHEN 'Importe:' THEN 1 WHEN 'Cliente:' THEN 2 ELSE 3 END AS field_pos,
  CASE text WHEN 'Fecha:' THEN 'pedido.fecha' WHEN 'Importe:' THEN 'pedido.importe' WHEN 'Cliente:' THEN 'cliente' ELSE 'estado' END AS field_name FROM form WHERE text IN ('Fecha:', 'Importe:', 'Cliente:', 'Estado:'))"""
_RIGHT = """rights AS (SELECT l.doc_id, field_pos, field_name, v.item_idx, row_number() OVER (PARTITION BY l.doc_id, field_pos ORDER BY v.x - (l.x + l.w), v.item_idx) AS k
  FROM labels l JOIN form v ON l.doc_id = v.doc_id AND v.item_idx <> l.item_idx AND abs((v.y + v.h / 2) - (l.y + l.h / 2)) <= 8 AND v.x >= l.x + l.w AND v.text NOT LIKE '%:')"""
_BELOW = """belows AS (SELECT l.doc_id, field_pos, field_name, v.item_idx, row_number() OVER (PARTITION BY l.doc_id, field_pos ORDER BY v.y - (l.y + l.h), v.item_idx) AS k
  FROM labels l JOIN form v ON l.doc_id = v.doc_id AND v.item_idx <> l.item_idx AND v.y >= l.y + l.h AND abs((v.x + v.w / 2) - (l.x + l.w / 2)) <= l.w + 12 AND v.text NOT LIKE '%:')"""
_TICK = """opts AS (SELECT l.doc_id, field_pos, field_name, o.item_idx, o.x, o.y, o.w, o.h, o.item_idx AS opt_pos FROM labels l JOIN form o ON o.doc_id = l.doc_id AND o.text IN ('F', 'O', 'P') WHERE field_pos = 3),
 near AS (SELECT o.doc_id, field_pos, field_name, o.item_idx, r.is_filled, row_number() OVER (PARTITION BY o.doc_id, o.item_idx ORDER BY sqrt(pow((o.x + o.w / 2) - (r.x + r.w / 2), 2) + pow((o.y + o.h / 2) - (r.y + r.h / 2), 2)), rect_idx) AS k
  FROM opts o JOIN form_rects r ON o.doc_id = r.doc_id AND r.is_checkbox),
 ticks AS (SELECT doc_id, field_pos, field_name, min(item_idx) AS item_idx FROM near WHERE k = 1 AND is_filled GROUP BY ALL)"""
_BOUND = f"""{_LABELS}, {_RIGHT}, {_BELOW}, {_TICK}, found AS (
  SELECT doc_id, field_pos, field_name, item_idx FROM rights WHERE k = 1 AND field_pos < 3
  UNION ALL SELECT doc_id, field_pos, field_name, item_idx FROM belows b WHERE k = 1 AND field_pos < 3 AND NOT EXISTS (SELECT 1 FROM rights r WHERE r.doc_id = b.doc_id AND r.field_pos = b.field_pos)
  UNION ALL SELECT doc_id, field_pos, field_name, item_idx FROM ticks),
 bound AS (SELECT f.doc_id, field_pos, field_name, trim(text) AS value, f.item_idx, x, y, w, h, CASE WHEN trim(text) <> 'DATOS DEL PEDIDO' THEN 'DATOS DEL PEDIDO' END AS section_title, page FROM found f JOIN form i ON f.doc_id = i.doc_id AND f.item_idx = i.item_idx)"""


@query(f"{_FORM}, {_LABELS} SELECT doc_id, field_name, item_idx FROM labels")
def det_label_item(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.label_items(fused_form(spark, sf_dir), SPECS).select("doc_id", "field_name", "item_idx")


@query(f"{_FORM}, {_LABELS}, {_RIGHT} SELECT doc_id, field_name, item_idx FROM rights WHERE k = 1")
def det_value_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.values_right(fused_form(spark, sf_dir), SPECS).select("doc_id", "field_name", "item_idx")


@query(f"{_FORM}, {_LABELS}, {_BELOW} SELECT doc_id, field_name, item_idx FROM belows WHERE k = 1")
def det_value_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.values_below(fused_form(spark, sf_dir), SPECS).select("doc_id", "field_name", "item_idx")


@query(f"{_FORM}, {_LABELS}, {_TICK} SELECT doc_id, field_name, item_idx FROM ticks")
def det_checkbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairing.values_checkbox(fused_form(spark, sf_dir), layouts.form_rects(spark, sf_dir), SPECS).select("doc_id", "field_name", "item_idx")


@query(f"{_FORM}, {_BOUND} SELECT doc_id, field_name, value, item_idx, x, y, section_title, 'deterministic_pair' AS match_method, 1.0::DOUBLE AS match_score, page FROM bound")
def det_bound_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = pairing.pair_fields(fused_form(spark, sf_dir), layouts.form_rects(spark, sf_dir), SPECS)
    return bound.select("doc_id", "field_name", "value", F.col("source_items")[0].alias("item_idx"), "x", "y", "section_title", "match_method", "match_score", "page")


@query(f"""{_FORM}, {_BOUND}, asked AS (SELECT DISTINCT doc_id, f.field_pos, f.field_name FROM form, (VALUES (0, 'pedido.fecha'), (1, 'pedido.importe'), (4, 'pedido.numero')) AS f(field_pos, field_name))
 SELECT doc_id, field_name, '' AS value, 'missing_required' AS issue_type, 'high' AS severity FROM asked a WHERE NOT EXISTS (SELECT 1 FROM bound b WHERE b.doc_id = a.doc_id AND b.field_pos = a.field_pos)""")
def det_missing_required(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound = pairing.pair_fields(fused_form(spark, sf_dir), layouts.form_rects(spark, sf_dir), SPECS)
    docs = layouts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return pairing.missing_required(docs, bound, SPECS)


# --- traces


@query(f"""{FUSED_SQL}, tb AS (SELECT f.doc_id, f.item_idx, b.block_idx, row_number() OVER (PARTITION BY f.doc_id, f.item_idx ORDER BY {_area('b')}, b.block_idx) AS k FROM fused f JOIN blocks b ON b.doc_id = f.doc_id AND b.page = f.page AND b.label = f.block_label WHERE {_holds('b', 'f')})
 SELECT f.doc_id, f.item_idx, (SELECT count(*) FROM items i WHERE i.doc_id = f.doc_id AND i.page = f.page AND i.x = f.x AND i.y = f.y AND i.w = f.w AND i.h = f.h AND i.text = f.text) AS n_text_items,
  tb.block_idx AS trace_block_idx, mr.box_rect_idx AS trace_rect_idx FROM fused f LEFT JOIN tb ON tb.doc_id = f.doc_id AND tb.item_idx = f.item_idx AND k = 1 LEFT JOIN mr ON mr.doc_id = f.doc_id AND mr.item_idx = f.item_idx""")
def trace_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    items, blocks, own = _relations(spark, sf_dir)
    fused = fuse.fuse(items, blocks, own).drop("block_idx")
    key = ["doc_id", "item_idx"]
    texts = trace.text_items_of(fused, items).groupBy(*key).agg(F.count("*").alias("n_text_items"))
    return fused.select(*key).join(texts, key).join(trace.block_of(fused, blocks).withColumnRenamed("block_idx", "trace_block_idx"), key, "left").join(trace.box_of(fused, own).withColumnRenamed("rect_idx", "trace_rect_idx"), key, "left")


@query(f"""{FUSED_SQL}, cellt AS (SELECT doc_id, table_id, table_row, table_col, trim(string_agg(text, ' ' ORDER BY item_idx)) AS said FROM fused WHERE table_id IS NOT NULL AND text <> '' GROUP BY ALL),
 tabs AS (SELECT doc_id, rect_id AS table_id FROM rects WHERE rect_type = 'table')
 SELECT t.doc_id, t.table_id, array_to_string([coalesce((SELECT said FROM cellt c WHERE c.doc_id = t.doc_id AND c.table_id = t.table_id AND table_row = 0 AND table_col = k), '') for k in [0, 1, 2]], '|') AS header_row,
  array_to_string([coalesce((SELECT said FROM cellt c WHERE c.doc_id = t.doc_id AND c.table_id = t.table_id AND table_row = k AND table_col = 0), '') for k in [0, 1, 2]], '|') AS header_col FROM tabs t""".replace(
    "array_to_string([coalesce((SELECT said FROM cellt c WHERE c.doc_id = t.doc_id AND c.table_id = t.table_id AND table_row = 0 AND table_col = k), '') for k in [0, 1, 2]], '|')",
    "concat_ws('|', " + ", ".join(f"coalesce((SELECT said FROM cellt c WHERE c.doc_id = t.doc_id AND c.table_id = t.table_id AND table_row = 0 AND table_col = {k}), '')" for k in range(3)) + ")",
).replace(
    "array_to_string([coalesce((SELECT said FROM cellt c WHERE c.doc_id = t.doc_id AND c.table_id = t.table_id AND table_row = k AND table_col = 0), '') for k in [0, 1, 2]], '|')",
    "concat_ws('|', " + ", ".join(f"coalesce((SELECT said FROM cellt c WHERE c.doc_id = t.doc_id AND c.table_id = t.table_id AND table_row = {k} AND table_col = 0), '')" for k in range(3)) + ")",
))
def trace_cell_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = trace.cell_headers(fused_items(spark, sf_dir), layouts.rects(spark, sf_dir))
    return heads.select("doc_id", "table_id", F.array_join("header_row", "|").alias("header_row"), F.array_join("header_col", "|").alias("header_col"))


_PATHS = f"""big AS (SELECT doc_id, enclosing_box_id AS rect_id, text AS title, row_number() OVER (PARTITION BY doc_id, enclosing_box_id ORDER BY coalesce(font_size, 0) DESC, item_idx) AS k FROM fused WHERE enclosing_box_id IS NOT NULL),
 named AS (SELECT r.*, {_area('r')} AS area, b.title FROM rects r LEFT JOIN big b ON b.doc_id = r.doc_id AND b.rect_id = r.rect_id AND k = 1 WHERE rect_type <> 'checkbox'),
 parent AS (SELECT a.doc_id, a.rect_idx, p.rect_idx AS up, row_number() OVER (PARTITION BY a.doc_id, a.rect_idx ORDER BY p.area, p.rect_idx) AS k FROM named a JOIN named p ON p.doc_id = a.doc_id AND p.page = a.page AND p.area > a.area
  AND a.x >= p.x - 0.5 AND a.y >= p.y - 0.5 AND a.x + a.w <= p.x + p.w + 0.5 AND a.y + a.h <= p.y + p.h + 0.5),
 walk(doc_id, item_idx, rect_idx, path) AS (
  SELECT f.doc_id, f.item_idx, mr.box_rect_idx, CASE WHEN section_title <> '' THEN [section_title] ELSE CAST([] AS VARCHAR[]) END FROM fused f JOIN mr ON mr.doc_id = f.doc_id AND mr.item_idx = f.item_idx
  UNION ALL
  SELECT w.doc_id, w.item_idx, p.up, CASE WHEN coalesce(n.title, '') <> '' AND NOT list_contains(w.path, n.title) THEN list_append(w.path, n.title) ELSE w.path END
  FROM walk w JOIN parent p ON p.doc_id = w.doc_id AND p.rect_idx = w.rect_idx AND p.k = 1 JOIN named n ON n.doc_id = p.doc_id AND n.rect_idx = p.up),
 ends AS (SELECT *, row_number() OVER (PARTITION BY w.doc_id, w.item_idx ORDER BY len(path) DESC) AS k FROM walk w WHERE NOT EXISTS (SELECT 1 FROM parent p WHERE p.doc_id = w.doc_id AND p.rect_idx = w.rect_idx))"""


@query(f"{FUSED_SQL}, {_PATHS} SELECT doc_id, item_idx, array_to_string(path, ' > ') AS path FROM ends".replace("WITH items", "WITH RECURSIVE items", 1))
def section_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = trace.section_paths(_written(spark, sf_dir), layouts.rects(spark, sf_dir))
    return paths.select("doc_id", "item_idx", F.array_join("path", " > ").alias("path"))


@query(f"""{_FORM}, {_BOUND} SELECT doc_id, field_name AS field, item_idx, text_items, block_idx, CASE WHEN boxed THEN CAST(0 AS INT) END AS rect_idx, path FROM (
  SELECT b.*, (SELECT string_agg(CAST(i.item_idx AS VARCHAR), ',' ORDER BY i.item_idx) FROM form i WHERE i.doc_id = b.doc_id AND i.item_idx = b.item_idx) AS text_items, CAST(NULL AS INT) AS block_idx, true AS boxed, section_title AS path FROM bound b)""")
def trace_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chains of paired values."""
    form, boxes = layouts.form(spark, sf_dir), layouts.form_rects(spark, sf_dir)
    none = layouts.blocks(spark, sf_dir).where("false")
    fused = staged(fused_form(spark, sf_dir), "form")
    bound = pairing.pair_fields(fused, boxes, SPECS).select("doc_id", F.col("field_name").alias("field"), "source_items")
    chains = trace.provenance(fused.drop("block_idx"), form, none, boxes)
    found = trace.trace_values(bound, chains)
    return found.select("doc_id", "field", "item_idx", F.array_join(F.transform("text_items", lambda i: i.cast("string")), ",").alias("text_items"), "block_idx", "rect_idx", F.array_join("path", " > ").alias("path"))


# --- documents


@query(f"""{FUSED_SQL}, u AS (SELECT doc_id, item_idx, text, coalesce(nullif(trim(section_title), ''), '_unsectioned') AS section FROM fused WHERE trim(text) <> '' AND coalesce(block_label, '') NOT IN ('page_header', 'page_footer', 'picture'))
 SELECT doc_id, section, min(item_idx) AS first_item, count(*) AS n_items, string_agg(item_idx || ':' || text, '|' ORDER BY item_idx) AS said FROM u GROUP BY doc_id, section""")
def llm_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.context_sections(fused_items(spark, sf_dir))
    said = F.array_join(F.transform("items", lambda s: F.concat_ws(":", s["i"].cast("string"), s["t"])), "|")
    return rows.select("doc_id", "section", F.col("first").alias("first_item"), F.size("items").cast("long").alias("n_items"), said.alias("said"))


@query(f"""WITH items AS ({_L['items']}), b AS ({_L['blocks']}) SELECT b.doc_id, b.page, b.block_idx, b.label, coalesce(string_agg(i.text || CASE WHEN i.font_name LIKE '%Bold%' THEN '*' WHEN i.font_name LIKE '%Italic%' THEN '/' ELSE '' END, ' ' ORDER BY i.y, i.x, i.item_idx), '') AS spans
 FROM b LEFT JOIN items i ON i.doc_id = b.doc_id AND i.page = b.page AND {_holds('b', 'i')} WHERE b.label <> 'table' GROUP BY ALL""")
def merged_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.merged_spans(layouts.items(spark, sf_dir), layouts.blocks(spark, sf_dir))
    said = F.array_join(F.transform("spans", lambda s: F.concat(s["text"], F.when(s["is_bold"], "*").when(s["is_italic"], "/").otherwise(""))), " ")
    return rows.select("doc_id", "page", "block_idx", "label", F.coalesce(said, F.lit("")).alias("spans"))


_TABLE_CELLS = f"""items AS MATERIALIZED ({_L['items']}), b AS MATERIALIZED ({_L['blocks']}), rects AS MATERIALIZED ({_L['rects']}), g AS (SELECT b.doc_id, b.block_idx, r.rect_idx, r.x, r.y, r.w, r.h, {_iou('b', 'r')} AS iou, row_number() OVER (PARTITION BY b.doc_id, b.block_idx ORDER BY {_iou('b', 'r')} DESC, r.rect_idx) AS k
  FROM b JOIN rects r ON r.doc_id = b.doc_id AND r.page = b.page AND r.rect_type = 'table' WHERE b.label = 'table'),
 gg AS (SELECT * FROM g WHERE k = 1 AND iou >= 0.3),
 i AS (SELECT b.doc_id, b.block_idx, i.item_idx, i.text, i.x + i.w / 2 AS cx, i.y + i.h / 2 AS cy FROM b JOIN items i ON i.doc_id = b.doc_id AND i.page = b.page AND {_holds('b', 'i')} WHERE b.label = 'table'),
 c AS (SELECT i.*, CAST(r AS INT) AS row, CAST(c AS INT) AS col, row_number() OVER (PARTITION BY i.doc_id, i.block_idx, i.item_idx ORDER BY r, c) AS k FROM i JOIN gg USING (doc_id, block_idx), range(0, 3) AS a(r), range(0, 3) AS e(c)
  WHERE cx BETWEEN gg.x + c * (gg.w / 3) AND gg.x + c * (gg.w / 3) + gg.w / 3 AND cy BETWEEN gg.y + r * (gg.h / 3) AND gg.y + r * (gg.h / 3) + gg.h / 3)"""


@query(f"""WITH {_TABLE_CELLS}
 SELECT doc_id, block_idx, item_idx, row, col, text FROM c WHERE k = 1
 UNION ALL SELECT i.doc_id, i.block_idx, item_idx, 0, 0, text FROM i WHERE NOT EXISTS (SELECT 1 FROM gg WHERE gg.doc_id = i.doc_id AND gg.block_idx = i.block_idx)""")
def merged_table_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.merged_table_cells(*_relations(spark, sf_dir))
    return rows.select("doc_id", "block_idx", "item_idx", "row", "col", "text")


@query(f"""WITH {_TABLE_CELLS},
 p AS (SELECT doc_id, block_idx, item_idx, row, col, text FROM c WHERE k = 1 UNION ALL SELECT i.doc_id, i.block_idx, item_idx, 0, 0, text FROM i WHERE NOT EXISTS (SELECT 1 FROM gg WHERE gg.doc_id = i.doc_id AND gg.block_idx = i.block_idx)),
 said AS (SELECT p.doc_id, p.block_idx, row, col, string_agg(p.text, ' ' ORDER BY i.y, i.x, i.item_idx) AS t FROM p JOIN items i ON i.doc_id = p.doc_id AND i.item_idx = p.item_idx GROUP BY ALL),
 cells AS (SELECT b.doc_id, b.block_idx, r, q FROM b LEFT JOIN gg USING (doc_id, block_idx), range(0, 3) AS x(r), range(0, 3) AS y(q) WHERE b.label = 'table' AND (gg.rect_idx IS NOT NULL OR (r = 0 AND q = 0))),
 rows_ AS (SELECT cells.doc_id, cells.block_idx, r, string_agg(coalesce(t, ''), '|' ORDER BY q) AS t FROM cells LEFT JOIN said ON said.doc_id = cells.doc_id AND said.block_idx = cells.block_idx AND row = r AND col = q GROUP BY ALL),
 tabs AS (SELECT doc_id, block_idx, string_agg(t, ';' ORDER BY r) AS cells FROM rows_ GROUP BY ALL),
 sp AS (SELECT b.doc_id, b.block_idx, string_agg(i.text, ' ' ORDER BY i.y, i.x, i.item_idx) AS spans FROM b JOIN items i ON i.doc_id = b.doc_id AND i.page = b.page AND {_holds('b', 'i')} GROUP BY ALL)
 SELECT b.doc_id, max(page) OVER (PARTITION BY b.doc_id) AS page_count, CAST(row_number() OVER (PARTITION BY b.doc_id ORDER BY page, y, x, b.block_idx) - 1 AS INT) AS pos, b.block_idx, label, heading_level AS level, content_layer AS layer, x, h, CASE WHEN label <> 'table' THEN coalesce(spans, '') END AS spans, cells
 FROM b LEFT JOIN sp USING (doc_id, block_idx) LEFT JOIN tabs USING (doc_id, block_idx)""")
def merged_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The blocks of each merged document, in order."""
    items, blocks, own = _relations(spark, sf_dir)
    whole = documents.merged_document(blocks, items, blocks, own)
    said = lambda spans: F.array_join(F.transform(spans, lambda s: s["text"]), " ")
    b = whole.select("doc_id", "page_count", F.inline("blocks"))
    cells = F.array_join(F.transform("cells", lambda row: F.array_join(F.transform(row, said), "|")), ";")
    return b.select("doc_id", "page_count", "pos", "block_idx", "label", "level", "layer", F.col("bbox")[0].alias("x"), F.col("bbox")[3].alias("h"), said("spans").alias("spans"), cells.alias("cells"))


@query(f"""WITH items AS ({_L['items']}) SELECT doc_id, item_idx, text, font_name AS font, CAST(font_size AS DOUBLE) AS size, page, x, h FROM items""")
def text_items_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents.text_items_payload(layouts.items(spark, sf_dir))
    said = F.from_json("payload", "text string, font string, size double, page int, bbox array<double>")
    return rows.select("doc_id", "item_idx", said.alias("p")).select("doc_id", "item_idx", "p.text", "p.font", "p.size", "p.page", F.col("p.bbox")[0].alias("x"), F.col("p.bbox")[3].alias("h"))


@query(f"""WITH items AS ({_L['items']}), b AS ({_L['blocks']}), t AS (SELECT b.doc_id, b.block_idx, coalesce(string_agg(trim(i.text), ' ' ORDER BY i.item_idx), '') AS said FROM b LEFT JOIN items i ON i.doc_id = b.doc_id AND i.page = b.page AND {_holds('b', 'i')} GROUP BY b.doc_id, b.block_idx)
 SELECT b.doc_id, b.block_idx, label, heading_level AS level, content_layer AS layer, b.page, b.y, left(b.text, 120) AS text, CASE WHEN label <> 'table' OR b.block_idx % 2 = 0 THEN said END AS contained_text, CASE WHEN label = 'table' AND b.block_idx % 2 = 1 THEN 'a|b' END AS cells
 FROM b JOIN t ON t.doc_id = b.doc_id AND t.block_idx = b.block_idx""")
def blocks_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With cells in every second table."""
    blocks = layouts.blocks(spark, sf_dir).withColumn("cells", F.expr("CASE WHEN label = 'table' AND block_idx % 2 = 1 THEN array(array('a', 'b')) END"))
    rows = documents.blocks_payload(blocks, layouts.items(spark, sf_dir))
    said = F.from_json("payload", "label string, level int, layer string, page int, bbox array<double>, text string, cells array<array<string>>, contained_text string")
    return rows.select("doc_id", "block_idx", said.alias("p")).select("doc_id", "block_idx", "p.label", "p.level", "p.layer", "p.page", F.col("p.bbox")[1].alias("y"), "p.text", "p.contained_text", F.array_join(F.get("p.cells", F.lit(0)), "|").alias("cells"))


@query(f"""{FUSED_SQL}, s AS (SELECT doc_id, string_agg(text, ' | ' ORDER BY item_idx) AS sample_texts FROM fused WHERE item_idx < 3 AND text <> '' GROUP BY doc_id)
 SELECT f.doc_id, count(*) AS items_count, count(*) FILTER (WHERE match_method <> 'none') AS matched_to_block, count(enclosing_box_id) AS matched_to_box, round(count(*) FILTER (WHERE match_method <> 'none') / CAST(count(*) AS DOUBLE), 4) AS coverage, any_value(sample_texts) AS sample_texts
 FROM fused f LEFT JOIN s ON s.doc_id = f.doc_id GROUP BY f.doc_id""")
def fuse_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.fusion_payload(_written(spark, sf_dir))


@query(f"WITH {_BASE} SELECT doc_id, '0-text' AS kind, item_idx AS idx, page, x, y, w, h FROM items UNION ALL SELECT doc_id, '1-block', block_idx, page, x, y, w, h FROM blocks UNION ALL SELECT doc_id, '2-rect', rect_idx, page, x, y, w, h FROM rects")
def step_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.step_boxes(*_relations(spark, sf_dir))


@query(f"""WITH items AS ({_L['items']}), b AS ({_L['blocks']}) SELECT b.doc_id, b.page, b.block_idx, coalesce(string_agg(trim(i.text), ' ' ORDER BY i.item_idx), '') AS contained_text
 FROM b LEFT JOIN items i ON i.doc_id = b.doc_id AND i.page = b.page AND {_holds('b', 'i')} GROUP BY ALL""")
def contained_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.contained_text(layouts.blocks(spark, sf_dir), layouts.items(spark, sf_dir), "block_idx")


@query(f"""WITH items AS ({_L['items']}), r AS ({_L['rects']}) SELECT r.doc_id, r.rect_idx, r.rect_id, r.rect_type, r.is_filled, r.page, CASE WHEN rect_type = 'table' THEN '3 rows x 3 cols' END AS grid_shape, coalesce(string_agg(trim(i.text), ' ' ORDER BY i.item_idx), '') AS contained_text
 FROM r LEFT JOIN items i ON i.doc_id = r.doc_id AND i.page = r.page AND {_holds('r', 'i')} GROUP BY ALL""")
def rects_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents.rects_payload(layouts.rects(spark, sf_dir), layouts.items(spark, sf_dir)).drop("bbox")


@query(f"{_FORM}, {_BOUND}, asked AS (SELECT DISTINCT doc_id, f.* FROM form, (VALUES (0, 'pedido.fecha', 'Fecha', 'Fecha'), (1, 'pedido.importe', 'Importe', 'Importe'), (2, 'cliente', 'Cliente', 'Cliente'), (3, 'estado', 'Estado', 'Estado'), (4, 'pedido.numero', 'Número', 'Número')) AS f(field_pos, field, label_searched, l)) SELECT a.doc_id, field, label_searched, CASE WHEN b.value IS NOT NULL THEN l END AS label_found, b.value AS value_raw, b.value IS NOT NULL AS matched, b.page FROM asked a LEFT JOIN bound b ON b.doc_id = a.doc_id AND b.field_pos = a.field_pos")
def pairs_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.operators.typed import pairs_report as report

    bound = pairing.pair_fields(fused_form(spark, sf_dir), layouts.form_rects(spark, sf_dir), SPECS)
    docs = layouts.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
    return report(docs, bound, SPECS)
