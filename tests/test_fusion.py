"""Small cases of fusion, pairing, traces and documents, and invariance to partitioning."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tessera.functions.geometry import box
from tessera.operators import documents, fuse, pairing, rects, trace
from tessera.operators.pairing import FieldSpec, infer_labels
from tessera.plans import layouts

ITEMS = "doc_id long, item_idx int, page int, text string, x double, y double, w double, h double, font_name string, font_size double"
BLOCKS = "doc_id long, block_idx int, page int, x double, y double, w double, h double, label string, heading_level int, content_layer string, text string"
RECTS = "doc_id long, rect_idx int, page int, x double, y double, w double, h double, rect_id string, rect_type string, is_checkbox boolean, is_filled boolean, table_grid array<array<struct<x:double,y:double,w:double,h:double>>>"


def item(idx, text, x, y, w=40.0, h=12.0, size=10.0, page=1, doc=1, font="Helvetica"):
    return (doc, idx, page, text, float(x), float(y), float(w), float(h), font, size)


def block(idx, x, y, w, h, label="text", level=None, page=1, doc=1):
    return (doc, idx, page, float(x), float(y), float(w), float(h), label, level, "body", "t")


def rect(idx, x, y, w, h, kind="box", filled=False, grid=None, page=1, doc=1, flag=None):
    return (doc, idx, page, float(x), float(y), float(w), float(h), f"p{page}-r{idx}", kind, kind == "checkbox" if flag is None else flag, filled, grid)


@pytest.fixture
def make(spark):
    return lambda items=(), blocks=(), boxes=(): (spark.createDataFrame(list(items), ITEMS), spark.createDataFrame(list(blocks), BLOCKS), spark.createDataFrame(list(boxes), RECTS))


GRID = [[(0.0, 0.0, 100.0, 50.0), (100.0, 0.0, 100.0, 50.0)], [(0.0, 50.0, 100.0, 50.0), (100.0, 50.0, 100.0, 50.0)]]


def test_block_match(make):
    items, blocks, _ = make([item(0, "a", 100, 100), item(1, "b", 200, 200, 20, 20), item(2, "c", 700, 10)], [block(0, 0, 0, 150, 150), block(1, 90, 90, 100, 30, "section_header", 1), block(2, 90, 90, 100, 30, "later"), block(3, 215, 215, 100, 100)])
    got = {r.item_idx: r for r in fuse.match_blocks(items, blocks).collect()}
    assert (got[0].block_label, got[0].block_heading_level, got[0].match_method, got[0].match_score) == ("section_header", 1, "centroid", 1.0)
    assert got[1].match_method == "iou" and 0 < got[1].match_score < 1 and got[1].block_idx == 3
    assert (got[2].match_method, got[2].match_score, got[2].block_label) == ("none", 0.0, None)


def test_boxes_titles_and_cells(make):
    items, blocks, boxes = make(
        [item(0, " TITLE ", 110, 110, size=14.0), item(1, "one", 110, 140), item(2, "TITLE", 110, 160, size=None), item(3, "out", 400, 400), item(4, "in", 10, 10), item(5, "cell", 150, 70)],
        [], [rect(0, 100, 100, 300, 200), rect(1, 100, 100, 300, 200), rect(2, 105, 105, 20, 20, "checkbox"), rect(3, 0, 0, 200, 100, "table", grid=GRID), rect(4, 0, 0, 0, 900)],
    )
    got = {r.item_idx: r for r in fuse.fuse(items, blocks, boxes).collect()}
    assert [got[i].enclosing_box_id for i in range(4)] == ["p1-r0"] * 3 + [None]
    assert [got[i].section_title for i in range(3)] == [None, "TITLE", None]
    assert (got[4].table_row, got[4].table_col) == (0, 0) and (got[5].table_row, got[5].table_col, got[5].cell_x) == (1, 1, 100.0) and got[3].table_id is None
    stats = fuse.fusion_stats(fuse.fuse(items, blocks, boxes)).first()
    assert (stats.total_items, stats.matched_to_block, stats.coverage) == (6, 0, 0.0)
    assert fuse.point_lookup(boxes, rect_id="p1-r3").first().rect_idx == 3
    with pytest.raises(KeyError):
        fuse.point_lookup(boxes, rect_id="none")


def test_partitioning_changes_nothing(spark, sf_dir):
    parts = layouts.items(spark, sf_dir), layouts.blocks(spark, sf_dir), layouts.rects(spark, sf_dir)
    once = fuse.fuse(*parts)
    again = fuse.fuse(*(p.orderBy(F.rand(3)).repartition(5) for p in parts))
    columns = ["doc_id", "item_idx", "block_idx", "match_score", "enclosing_box_id", "section_title", "table_id", "table_row"]
    assert once.count() == parts[0].count()
    assert once.select(columns).exceptAll(again.select(columns)).count() == 0


def test_geometry(spark):
    df = spark.createDataFrame([(0.0, 0.0, 10.0, 10.0, 5.0, 5.0, 10.0, 10.0), (0.0, 0.0, 100.0, 100.0, -0.2, 0.0, 50.0, 50.0), (0.0, 0.0, 100.0, 100.0, -1.0, 0.0, 50.0, 50.0), (0.0, 0.0, -5.0, 3.0, 0.0, 0.0, 0.0, 0.0)], "a_x double, a_y double, a_w double, a_h double, b_x double, b_y double, b_w double, b_h double")
    a, b = box("a_"), box("b_")
    got = df.select(a.iou(b).alias("iou"), a.holds_box(b).alias("holds"), a.area.alias("area"), a.holds(F.lit(0.0), F.lit(0.0)).alias("edge")).collect()
    assert abs(got[0].iou - 25 / 175) < 1e-9 and [r.holds for r in got[:3]] == [False, True, False] and got[3].area == 0.0 and got[3].iou == 0.0 and got[0].edge


def test_rect_classifier(spark):
    rows = spark.createDataFrame([(10.0, 10.0, 0.0), (50.0, 50.0, 0.0), (10.0, 50.0, 0.0), (150.0, 10.0, 700.0), (150.0, 10.0, 100.0)], "w double, h double, y double")
    got = [r[0] for r in rows.select(rects.rect_type(F.col("w"), F.col("h"), F.col("y"), F.lit(800.0))).collect()]
    assert got == ["checkbox", "box", "box", "signature_field", "box"]


def test_fill_and_self(make):
    _, _, boxes = make([], [], [rect(0, 10, 10, 10, 10, "checkbox"), rect(1, 12, 12, 6, 6), rect(2, 50, 50, 10, 10, "checkbox")])
    own = boxes.where("rect_type = 'checkbox'")
    assert {r.rect_idx: r.filled for r in rects.filled_by_overlap(own, boxes).collect()} == {0: True, 2: False}
    assert all(r.filled for r in rects.filled_by_overlap(own, boxes, exclude_self=False).collect())


def test_plain_pairing(make):
    items, blocks, boxes = make([item(0, "Nombre:", 100, 100), item(1, "Carlos", 150, 100), item(2, "far", 300, 101), item(3, "NIF: ", 100, 130), item(4, "X", 150, 130), item(5, "None:", 100, 160), item(6, "Nombre:", 100, 190), item(7, "Last", 150, 191)])
    got = {r.label: r.value for r in pairing.pair_labels(fuse.fuse(items, blocks, boxes)).collect()}
    assert got == {"Nombre": "Last", "NIF:": "X"}


def test_deterministic_fields(make):
    items, blocks, boxes = make(
        [item(0, "NIF:", 50, 100, 30), item(1, "51789286W", 90, 100, 80), item(2, "Apellidós :", 50, 120, 60), item(3, "LORENZO", 50, 140, 80), item(4, "Vivienda:", 50, 200, 60)]
        + [item(5 + k, t, 130 + 60 * k, 200, 30) for k, t in enumerate(("Propia", "Alquiler", "Otra"))],
        [], [rect(k, 118 + 60 * k, 202, 8, 8, "checkbox", k == 1) for k in range(3)],
    )
    specs = [FieldSpec("titular.nif", (), True), FieldSpec("titular.apellidos"), FieldSpec("vivienda", (), False, ("propia", "alquiler", "otra")), FieldSpec("fecha_alta", (), True)]
    fused = fuse.fuse(items, blocks, boxes)
    bound = pairing.pair_fields(fused, boxes, specs)
    assert {r.field_name: r.value for r in bound.collect()} == {"titular.nif": "51789286W", "titular.apellidos": "LORENZO", "vivienda": "Alquiler"}
    assert [r.field_name for r in pairing.missing_required(items.select("doc_id").distinct(), bound, specs).collect()] == ["fecha_alta"]
    assert infer_labels("a.fecha_de_X") == ("Fecha de de X", "Fecha de X") and infer_labels("nif") == ("Nif",)


def test_trace_and_paths(make):
    items, blocks, boxes = make(
        [item(0, "OUTER", 15, 15, size=20.0), item(1, "INNER", 110, 110, size=14.0), item(2, "v", 110, 130), item(3, "v", 110, 130)], [block(0, 100, 100, 90, 90, "list_item")],
        [rect(0, 0, 0, 500, 500), rect(1, 100, 100, 100, 100), rect(2, 90, 90, 200, 200)],
    )
    fused = fuse.fuse(items, blocks, boxes)
    chain = {r.item_idx: r for r in trace.provenance(fused.drop("block_idx"), items, blocks, boxes).collect()}
    assert chain[2].path == ["INNER", "OUTER"] and chain[2].text_items == [2, 3] and chain[2].rect_idx == 1 and chain[2].block_idx == 0
    assert chain[0].path == [] and chain[0].block_idx is None


def test_documents(make):
    items, blocks, boxes = make(
        [item(0, "Consulta", 20, 20), item(1, "TGSS", 70, 20, 30, font="Arial-Bold"), item(2, "far", 500, 500), item(3, "cell", 150, 70)],
        [block(0, 10, 10, 200, 30), block(1, 0, 0, 200, 100, "table"), block(2, 600, 0, 50, 50, "table")], [rect(0, 0, 0, 200, 100, "table", grid=GRID)],
    )
    assert {r.block_idx: r.contained_text for r in documents.contained_text(blocks, items, "block_idx").collect()}[0] == "Consulta TGSS"
    spans = documents.merged_spans(items, blocks).first().spans
    assert [(s.text, s.is_bold) for s in spans] == [("Consulta", False), ("TGSS", True)]
    cells = {r.item_idx: (r.row, r.col) for r in documents.merged_table_cells(items, blocks, boxes).collect()}
    assert cells == {0: (0, 0), 1: (0, 0), 3: (1, 1)}
    context = documents.llm_context(fuse.fuse(items, blocks, boxes)).first().context
    assert '"title":"_unsectioned"' in context or '"title"' in context
    assert '"contained_text":"Consulta TGSS"' in documents.blocks_payload(blocks, items).where("block_idx = 0").first().payload
    assert documents.text_items_payload(items).count() == 4
