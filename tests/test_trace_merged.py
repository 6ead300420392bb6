"""What the chains of bound values are joined of grows with the documents, so none of it goes through the driver."""

from __future__ import annotations

from tessera.plans import layout_queries, layouts


def test_chains_of_values_are_merged(spark, sf_dir, monkeypatch):
    plans, staged = [], layout_queries.staged
    plan = lambda relation: relation._jdf.queryExecution().executedPlan().toString()

    def keep(relation, label):
        plans.append(plan(relation))
        return staged(relation, label)

    monkeypatch.setattr(layout_queries, "staged", keep)
    chains = layout_queries.trace_values(spark, sf_dir)
    for p in (*plans, plan(chains)):
        sent = [x for x in p.splitlines() if "BroadcastHashJoin" in x or "BroadcastNestedLoopJoin" in x]
        assert "SortMergeJoin" in p and all("o_custkey" in x for x in sent), sent  # the form's customers are a table of their own
    assert len(plans) == 1
    # blocks are kept even where there are some
    items, blocks, rects = (own.where("doc_id < 5") for own in (layouts.items(spark, sf_dir), layouts.blocks(spark, sf_dir), layouts.rects(spark, sf_dir)))
    fused = layout_queries.fuse.fuse(items, blocks, rects)
    chain = layout_queries.trace.provenance(fused.drop("block_idx"), items, blocks, rects)
    assert "Broadcast" not in plan(chain) and chain.count() == items.count() > 0
