"""What a model's answers are bound to is searched once, and nothing that grows with the documents goes through the driver."""

from __future__ import annotations

import pytest

from tessera.operators.binding import bind_found
from tessera.plans import layouts, value_queries
from tessera.plans.extraction import Pipeline
from tessera.plans.providers import Scripted
from tessera.sources.staging import staged


@pytest.mark.parametrize("policy, calls", [("drop", 1), ("retry", 2)])
def test_search_is_kept_and_joins_are_merged(spark, sf_dir, policy, calls):
    form, boxes = (own.where("doc_id < 200") for own in (layouts.form(spark, sf_dir), layouts.form_rects(spark, sf_dir)))
    plans = {}

    def keep(relation, label):
        plans[label] = relation._jdf.queryExecution().executedPlan().toString()
        return staged(relation, label)

    answer = lambda prompt: (value_queries._SECOND if "could not be found" in prompt else value_queries._FIRST) % prompt[prompt.find("Customer#") :][:18]
    out = Pipeline(value_queries.SCHEMA, Scripted(answer), on_hallucination=policy, keep=keep).run(form, layouts.blocks(spark, sf_dir).where("false"), boxes)
    assert out.bound.count() == form.select("doc_id").distinct().count() > 0
    assert {f"found-{k}" for k in range(calls)} <= set(plans)
    for label in ("found-0", "bound-0", *(("found-1", "bound-1") if calls == 2 else ())):
        assert "Broadcast" not in plans[label] and ("MapInArrow" in plans[label]) == label.startswith("found"), label


def test_bound_values_are_merged(spark, sf_dir):
    fused = value_queries._fused_prose(spark, sf_dir).where("doc_id < 5")
    found = spark.createDataFrame([(1, 0, "a", "b", "exact", 1.0, 0, 5)], "doc_id long, field_pos int, field_name string, value string, match_method string, match_score double, start int, size int")
    bound = bind_found(found, fused)
    assert "Broadcast" not in bound._jdf.queryExecution().executedPlan().toString() and bound.first().source_items[0] == 0
