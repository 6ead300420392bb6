"""Label-value pairing: the plain heuristic and the schema-driven deterministic mode."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import Box, box, prefixed
from tessera.functions.text import is_label, normalize_label, strip, strip_label

#: Tolerances in points: a row of the plain heuristic, of deterministic mode, and how far off a value below may be.
ROW, ROW_LOOSE, BELOW = 4.0, 8.0, 12.0
_BOX = ("x", "y", "w", "h")
#: What a bound value takes from its item.
_VALUE = ("text", *_BOX, "section_title", "block_label", "page")


def pair_labels(fused: DataFrame) -> DataFrame:
    """(doc_id, label, value).

    Per box, pages ignored: the nearest item to the right on the row that comes later in (top, left) order
    and is no label. Of equal labels the last one wins, in the order in which their boxes first occur.
    """
    by_box = Window.partitionBy("doc_id", "enclosing_box_id")
    ranked = fused.select("doc_id", "item_idx", "enclosing_box_id", "text", "x", "y", "w", "h").withColumns({"rn": F.row_number().over(by_box.orderBy("y", "x", "item_idx")), "box_first": F.min("item_idx").over(by_box)})
    labels = ranked.where(is_label(F.col("text")) & (strip_label(F.col("text")) != "")).select("doc_id", "item_idx", F.col("enclosing_box_id").alias("l_box"), "box_first", *prefixed(("rn", "text", "x", "y", "w", "h"), "l_"))
    values = ranked.where(~is_label(F.col("text"))).drop("item_idx", "box_first").withColumnRenamed("doc_id", "v_doc")
    a, b = box("l_"), box()
    near = labels.join(values, (F.col("doc_id") == F.col("v_doc")) & F.col("l_box").eqNullSafe(F.col("enclosing_box_id")) & (F.col("rn") > F.col("l_rn")) & (F.abs(b.cy - a.cy) <= ROW) & (b.x >= a.right))
    best = near.groupBy("doc_id", "item_idx", "box_first", "l_rn", "l_text").agg(F.min(F.struct((b.x - a.right).alias("dx"), "rn", "text")).alias("m"))
    return best.groupBy("doc_id", strip_label(F.col("l_text")).alias("label")).agg(F.max_by(strip(F.coalesce(F.col("m.text"), F.lit(""))), F.struct("box_first", "l_rn")).alias("value"))


def infer_labels(key: str) -> tuple[str, ...]:
    """Labels of a dotted key's last segment."""
    parts = [p for p in key.rpartition(".")[2].split("_") if p]
    if not parts:
        return ()
    first = parts[0].capitalize()
    if len(parts) == 1:
        return (first,)
    rest = " ".join(parts[1:])
    return (f"{first} de {rest}", f"{first} {rest}")


@dataclass(frozen=True)
class FieldSpec:
    """What deterministic mode needs of a schema field: ``options`` only for checkbox fields."""

    name: str
    labels: tuple[str, ...] = ()
    required: bool = False
    options: tuple[str, ...] | None = None
    searched: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "searched", self.labels or infer_labels(self.name))


def _asked(fields: list[FieldSpec]) -> Column:
    """The schema as an array literal: field_pos, field_name, norms of its labels, tokens of its path, norms of its options or null."""
    texts = lambda values: F.array(*map(F.lit, values)).cast("array<string>")
    rows = [
        F.struct(
            F.lit(p).alias("field_pos"), F.lit(f.name).alias("field_name"), F.transform(texts([x for x in f.searched if x]), normalize_label).alias("norms"),
            F.filter(F.transform(texts(f.name.replace(".", " ").replace("_", " ").split()), normalize_label), lambda t: F.length(t) >= 4).alias("tokens"),
            (F.lit(None).cast("array<string>") if f.options is None else F.transform(texts(f.options), normalize_label)).alias("options"),
        )
        for p, f in enumerate(fields)
    ]
    return F.array(*rows)


def _of(item: Column) -> Box:
    return Box(*(item[c] for c in _BOX))


def _least(items: Column, fits: Callable[[Column], Column], *order: tuple[str, Callable[[Column], Column]]) -> Column:
    """The item that fits and comes first by ``order``, then by its index, as STRUCT<.., item_idx, item>; null if none fits."""
    return F.array_min(F.transform(F.filter(items, fits), lambda i: F.struct(*(f(i).alias(n) for n, f in order), i["item_idx"].alias("item_idx"), F.struct(*(i[c].alias(c) for c in _VALUE), i["box"].alias("box")).alias("item"))))


def _paired(fused: DataFrame, fields: list[FieldSpec], rects: DataFrame | None = None) -> DataFrame:
    """(doc_id, field_pos, field_name, label, right, below, tick): of each field with a label, its label's item (P4) and the
    items that J4, J5 and P6 choose, as STRUCT<item_idx, item>, or null.

    A document is one row here, so all choices take one exchange of the items and one of the checkboxes.

    P4: equal after normalisation; an item whose section title holds a token of the field's path comes first, else the first.
    J4: the nearest item to the right on the label's row; J5: the nearest below whose centre is about under the label's;
    both in the label's page and box (a null box is a box), and no label.  J6, J7, P6: the first declared option whose item,
    the first in the label's box that equals it, of any page, has as its nearest checkbox on the label's page a filled one.
    """
    text = F.coalesce("text", F.lit(""))
    full, bare = normalize_label(text), strip(F.regexp_replace(normalize_label(text), ":+\\z", ""))
    item = F.struct("item_idx", *_VALUE, F.col("enclosing_box_id").alias("box"), F.when(text != "", bare).alias("bare"), full.alias("full"), normalize_label(F.lower("section_title")).alias("section"), is_label(F.col("text")).alias("labels"))
    docs = fused.groupBy("doc_id").agg(F.collect_list(item).alias("items"))
    if rects is None:
        docs = docs.withColumn("ticks", F.array().cast("array<struct<rect_idx:int,page:int,x:double,y:double,w:double,h:double,is_filled:boolean>>"))
    else:
        boxes = rects.where(is_checkbox_rect()).groupBy("doc_id").agg(F.collect_list(F.struct("rect_idx", "page", *_BOX, "is_filled")).alias("ticks"))
        docs = docs.join(boxes.hint("merge"), "doc_id", "left")

    def label_of(f: Column) -> Column:
        hinted = lambda i: F.exists(f["tokens"], lambda t: F.contains(i["section"], t))
        return _least(F.col("items"), lambda i: F.array_contains(f["norms"], i["bare"]), ("unhinted", lambda i: ~F.coalesce(hinted(i), F.lit(False))))

    def beside(label: Column, fits: Callable[[Box, Box], Column], far: Callable[[Box, Box], Column]) -> Column:
        a = _of(label["item"])
        around = lambda i: (i["page"] == label["item"]["page"]) & i["box"].eqNullSafe(label["item"]["box"]) & (i["item_idx"] != label["item_idx"]) & ~i["labels"]
        return _least(F.col("items"), lambda i: around(i) & fits(a, _of(i)), ("d", lambda i: far(a, _of(i))))

    def tick(f: Column, label: Column) -> Column:
        def chosen(option: Column) -> Column:
            own = _least(F.col("items"), lambda i: (option != "") & (i["full"] == option) & i["box"].eqNullSafe(label["item"]["box"]) & (i["item_idx"] != label["item_idx"]))
            nearest = lambda o: F.array_min(F.transform(F.filter("ticks", lambda b: b["page"] == label["item"]["page"]), lambda b: F.struct(_of(o["item"]).distance(_of(b)).alias("d"), b["rect_idx"].alias("rect_idx"), b["is_filled"].alias("is_filled"))))
            return F.get(F.transform(F.array(own), lambda o: F.when(F.coalesce(nearest(o)["is_filled"], F.lit(False)), o)), F.lit(0))

        return F.get(F.filter(F.transform(f["options"], chosen), lambda o: o.isNotNull()), F.lit(0))

    right = lambda label: beside(label, lambda a, b: (F.abs(b.cy - a.cy) <= ROW_LOOSE) & (b.x >= a.right), lambda a, b: b.x - a.right)
    below = lambda label: beside(label, lambda a, b: (b.y >= a.bottom) & (F.abs(b.cx - a.cx) <= a.w + BELOW), lambda a, b: b.y - a.bottom)
    # generators evaluate what they give once; as a column under a filter it would be evaluated for each mention
    labelled = F.filter(F.transform(_asked(fields), lambda f: F.struct(f.alias("f"), label_of(f).alias("label"))), lambda x: x["label"].isNotNull())
    rows = docs.select("doc_id", "items", "ticks", F.explode(labelled).alias("x")).select("doc_id", "items", "ticks", F.col("x.f").alias("f"), F.col("x.label").alias("label"))
    found = F.struct("label", right(F.col("label")).alias("right"), below(F.col("label")).alias("below"), tick(F.col("f"), F.col("label")).alias("tick"))
    return rows.select("doc_id", "f.field_pos", "f.field_name", F.col("f.options").isNotNull().alias("ticked"), F.inline(F.array(found)))


_FOUND = ("doc_id", "field_pos", "field_name")


def _chosen(paired: DataFrame, what: str) -> DataFrame:
    return paired.where(F.col(what).isNotNull()).select(*_FOUND, F.col(f"{what}.item_idx").alias("item_idx"))


def label_items(fused: DataFrame, fields: list[FieldSpec]) -> DataFrame:
    """(doc_id, field_pos, field_name, item_idx) of each field's label."""
    return _chosen(_paired(fused, fields), "label")


def values_right(fused: DataFrame, fields: list[FieldSpec]) -> DataFrame:
    """(doc_id, field_pos, field_name, item_idx)."""
    return _chosen(_paired(fused, fields), "right")


def values_below(fused: DataFrame, fields: list[FieldSpec]) -> DataFrame:
    """(doc_id, field_pos, field_name, item_idx), also where there is a value to the right."""
    return _chosen(_paired(fused, fields), "below")


def is_checkbox_rect() -> Column:
    """Type or flag."""
    return (F.col("rect_type") == "checkbox") | F.coalesce("is_checkbox", F.lit(False))


def values_checkbox(fused: DataFrame, rects: DataFrame, fields: list[FieldSpec]) -> DataFrame:
    """(doc_id, field_pos, field_name, item_idx) of the fields with options."""
    return _chosen(_paired(fused, fields, rects), "tick")


def pair_fields(fused: DataFrame, rects: DataFrame, fields: list[FieldSpec]) -> DataFrame:
    """Bound values of deterministic mode, one row per document and paired field; P5: to the right, else below."""
    paired = _paired(fused, fields, rects if any(f.options is not None for f in fields) else None)
    item = lambda c: F.struct(F.col(f"{c}.item_idx").alias("item_idx"), F.col(f"{c}.item").alias("item"))
    value = F.when(F.col("ticked"), F.when(F.col("tick").isNotNull(), item("tick"))).when(F.col("right").isNotNull(), item("right")).when(F.col("below").isNotNull(), item("below"))
    found = paired.withColumn("v", value).where("v is not null").select(*_FOUND, "v.item_idx", "v.item.*")
    return found.select(
        *_FOUND, strip(F.coalesce("text", F.lit(""))).alias("value"), F.array("item_idx").alias("source_items"), *_BOX,
        "section_title", "block_label", F.lit("deterministic_pair").alias("match_method"), F.lit(1.0).alias("match_score"), "page",
    )


def missing_required(docs: DataFrame, bound: DataFrame, fields: list[FieldSpec]) -> DataFrame:
    """Issues of required fields without a pair: ``docs`` has a row per document."""
    rows = [(p, f.name) for p, f in enumerate(fields) if f.required]
    asked = docs.select("doc_id").withColumn("f", F.explode(F.array(*(F.struct(F.lit(p).alias("field_pos"), F.lit(n).alias("field_name")) for p, n in rows)))) if rows else None
    if asked is None:
        return docs.select("doc_id", F.lit("").alias("field_name"), F.lit("").alias("value"), F.lit("").alias("issue_type"), F.lit("").alias("severity")).where("false")
    asked = asked.select("doc_id", "f.field_pos", "f.field_name")
    left = asked.join(bound.select("doc_id", "field_pos"), ["doc_id", "field_pos"], "left_anti")
    return left.select("doc_id", "field_name", F.lit("").alias("value"), F.lit("missing_required").alias("issue_type"), F.lit("high").alias("severity"))
