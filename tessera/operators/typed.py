"""Schemas applied to bound values."""

from __future__ import annotations

import hashlib
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.geometry import box, prefixed
from tessera.functions.transforms import MONEY_TYPE, Transformer, money_text
from tessera.operators.pairing import FieldSpec, is_checkbox_rect


@dataclass(frozen=True)
class Field:
    transformer: Transformer
    required: bool = False
    description: str | None = None
    labels: tuple[str, ...] = ()


@dataclass(frozen=True)
class Schema:
    """Ordered fields by dotted key."""

    fields: Mapping[str, Field]

    def specs(self) -> list[FieldSpec]:
        return [FieldSpec(n, f.labels, f.required, f.transformer.options) for n, f in self.fields.items()]

    def fingerprint(self) -> str:
        """Of names, transformers, labels and flags: the same in every process."""
        said = "\n".join(f"{n}\t{f.transformer.name}\t{f.required}\t{'|'.join(f.labels)}" for n, f in self.fields.items())
        return hashlib.sha256(said.encode()).hexdigest()


def boxes_near(bound: DataFrame, rects: DataFrame) -> DataFrame:
    """(doc_id, field_pos, n_boxes, any_filled): checkboxes of the page whose centre is in the value's box, or the reverse."""
    c, v = box("c_"), box()
    near = bound.where("page is not null and x is not null").select("doc_id", "field_pos", "page", "x", "y", "w", "h").join(rects.where(is_checkbox_rect()).select("doc_id", "page", "is_filled", *prefixed(("x", "y", "w", "h"), "c_")), ["doc_id", "page"])
    near = near.where(v.holds_centre_of(c) | c.holds_centre_of(v))
    return near.groupBy("doc_id", "field_pos").agg(F.count("*").alias("n_boxes"), F.bool_or("is_filled").alias("any_filled"))


def _said(value: Column, kind: str) -> Column:
    if kind == MONEY_TYPE:
        return money_text(value)
    return F.array_join(value, ",") if kind.startswith("array") else value.cast("string")


def _one(transformer: Transformer, context: Mapping[str, Column]) -> Column:
    """A transformer's verdict with its value as text."""
    said = lambda t: F.struct(_said(t["normalized"], transformer.kind).alias("said"), t["score"].alias("score"), t["issues"].alias("issues"))
    own = transformer(F.col("value"), **context)
    return said(own) if transformer.python else F.get(F.transform(F.array(own), said), F.lit(0))


def apply_schema(docs: DataFrame, bound: DataFrame, schema: Schema, rects: DataFrame | None = None, as_of: Column | None = None) -> DataFrame:
    """One row per document and bound field of the schema, and per required field that is missing.

    Of values bound twice to a field the last counts. ``normalized_str`` is canonical text.
    """
    names = list(schema.fields)
    last = bound.where(F.col("field_name").isin(names)).groupBy("doc_id", "field_name").agg(F.max_by(F.struct(*bound.columns), "field_pos").alias("b")).select("b.*")
    if rects is not None:
        last = last.join(boxes_near(last, rects), ["doc_id", "field_pos"], "left")
        context = {"n_boxes": F.col("n_boxes"), "any_filled": F.col("any_filled")}
    else:
        context = {}
    if as_of is not None:
        context["as_of"] = as_of
    typed = None
    for name, f in schema.fields.items():
        one = _one(f.transformer, context)
        typed = F.when(F.col("field_name") == name, one) if typed is None else typed.when(F.col("field_name") == name, one)
    rows = last.select("*", F.inline(F.array(typed)))  # a generator evaluates the verdict once
    used = F.create_map(*(F.lit(x) for n, f in schema.fields.items() for x in (n, f.transformer.name)))
    found = rows.select(
        "doc_id", F.col("field_name").alias("field"), F.col("value").alias("raw"), F.col("said").alias("normalized_str"), "x", "y", "w", "h", "page", "source_items",
        F.round(F.col("score") * F.col("match_score"), 4).alias("confidence"), used[F.col("field_name")].alias("transform_used"), "issues",
    )
    required = [n for n, f in schema.fields.items() if f.required]
    if not required:
        return found
    asked = docs.select("doc_id").withColumn("field", F.explode(F.array(*map(F.lit, required))))
    gone = asked.join(found.select("doc_id", "field"), ["doc_id", "field"], "left_anti")
    empty = {f.name: F.lit(None).cast(f.dataType) for f in found.schema.fields}
    empty |= {"doc_id": F.col("doc_id"), "field": F.col("field"), "raw": F.lit(""), "confidence": F.lit(0.0), "transform_used": used[F.col("field")], "issues": F.array(F.lit("required_field_missing")), "source_items": F.array().cast(found.schema["source_items"].dataType)}
    return found.unionByName(gone.select(*(empty[c].alias(c) for c in found.columns)))


def is_ok() -> Column:
    """No issue, and a value."""
    return (F.size("issues") == 0) & F.col("normalized_str").isNotNull()


def pairs_report(docs: DataFrame, bound: DataFrame, specs: Sequence[FieldSpec]) -> DataFrame:
    """Every document and field, paired or not; ``label_found`` is the first label searched."""
    rows = F.array(*(F.struct(F.lit(p).alias("field_pos"), F.lit(s.name).alias("field"), F.lit("|".join(s.searched)).alias("label_searched"), F.lit(s.searched[0] if s.searched else None).cast("string").alias("first")) for p, s in enumerate(specs)))
    asked = docs.select("doc_id", F.explode(rows).alias("f")).select("doc_id", "f.*")
    one = bound.groupBy("doc_id", "field_pos").agg(F.first("value").alias("value_raw"), F.first("page").alias("page"))
    joined = asked.join(one.withColumn("matched", F.lit(True)), ["doc_id", "field_pos"], "left")
    matched = F.coalesce("matched", F.lit(False))
    return joined.select("doc_id", "field", "label_searched", F.when(matched, F.col("first")).alias("label_found"), "value_raw", matched.alias("matched"), "page")
