"""A run with a model keeps a row per document: fusion, contexts, search and sources give what they give on rows of items."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import binding, documents
from tessera.operators.fuse import fuse
from tessera.plans import layouts, value_queries
from tessera.plans.extraction import Pipeline
from tessera.plans.providers import Scripted
from tessera.sources.staging import staged

_ROWS = lambda df: sorted(map(str, df.collect()))


@pytest.fixture(scope="module", params=["pages", "form"])
def layout(request, spark, sf_dir):
    if request.param == "pages":
        return tuple(own.where("doc_id < 12") for own in (layouts.items(spark, sf_dir), layouts.blocks(spark, sf_dir), layouts.rects(spark, sf_dir)))
    return tuple(own.where("doc_id < 60") for own in (layouts.form(spark, sf_dir), layouts.blocks(spark, sf_dir).where("doc_id < 0"), layouts.form_rects(spark, sf_dir)))


def odd(items):
    """With blank, spaced and missing texts, and items of no page and no box."""
    k = F.col("item_idx") % 9
    return items.withColumns({"text": F.when(k == 1, F.lit(None)).when(k == 2, "  ").when(k == 4, F.concat(F.lit(" "), F.upper("text"), F.lit("\t X"))).otherwise(F.col("text")), "page": F.when(k == 5, F.lit(None)).otherwise(F.col("page")), "x": F.when(k == 7, F.lit(5000.0)).otherwise(F.col("x"))})


def test_documents_are_fused_as_their_items(layout):
    items, blocks, rects = layout
    for own in (items, odd(items)):
        want, got = fuse(own, blocks, rects), documents.fuse_documents(own, blocks, rects).select("doc_id", F.inline("items"))
        assert _ROWS(got) == _ROWS(want.select(*got.columns)) and set(got.columns) == {"doc_id", *documents.READ} and want.count() > 100


def test_contexts_and_sources_of_documents(spark, layout):
    items, blocks, rects = layout
    fused = staged(fuse(odd(items), blocks, rects).withColumn("block_label", F.when(F.col("item_idx") % 5 == 3, "page_header").otherwise(F.col("block_label"))), "fused")
    docs = staged(documents.prepared(documents.by_document(fused)), "docs")
    want = documents.llm_context(fused)
    assert _ROWS(docs.where("context is not null").select("doc_id", "context")) == _ROWS(want) and want.count() > 5
    told = F.collect_list(F.when(F.col("text") != "", F.col("text")))
    texts = fused.groupBy("doc_id").agg(told.alias("t")).select("doc_id", F.array(F.get("t", F.lit(0)), F.concat(F.get("t", F.lit(1)), F.lit(" "), F.get("t", F.lit(2))), F.regexp_replace(F.get("t", F.lit(3)), "[a-z]", "q"), F.concat(F.lit("¡"), F.get("t", F.lit(4)), F.lit("!")), F.lit("no consta 99"), F.lit("!"), F.lit("datos del pedida")).alias("t"))
    more = spark.createDataFrame([(-5, ["of no document"]), (-6, [])], "doc_id long, t array<string>")
    said = texts.unionByName(more).select("doc_id", F.transform("t", lambda t, k: F.struct(k.alias("field_pos"), F.concat(F.lit("f"), k.cast("string")).alias("field_name"), F.coalesce(t, F.lit("?")).alias("value"))).alias("said"))
    want = binding.bind(said.select("doc_id", F.inline("said")), fused)
    got = binding.bind_documents(said, docs).select("doc_id", F.inline("bound"))
    assert got.columns == ["doc_id", *(c for c in got.columns if c != "doc_id")] and set(got.columns) == set(want.columns)
    assert _ROWS(got.select(*want.columns)) == _ROWS(want) and {r.match_method for r in want.select("match_method").distinct().collect()} >= {"not_found", "substring"}


def test_pairs_without_hope_are_told():
    draw = random.Random(7)
    for threshold in (0.85, 0.6, 1.0):
        hays, asked = [], []
        for _ in range(600):
            letters = draw.choice(("ab", "abcdef ", "abcdefghijklmnop é¡𝒳!"))
            hay, own = "".join(draw.choices(letters, k=draw.randint(0, 150))), []
            for _ in range(draw.randint(0, 4)):
                needle = list(draw.choice(("".join(draw.choices(letters, k=draw.randint(0, 80))), hay[(at := draw.randint(0, 140)) : at + draw.randint(0, 70)])))
                for _ in range(draw.randint(0, 3) if needle else 0):
                    needle[draw.randrange(len(needle))] = draw.choice(letters)
                own.append((x := "".join(needle), x.replace("!", "").replace("¡", "")))
            hays.append(hay), asked.append(own)
        want = [binding.find_all(hay, [own], threshold) for hay, own in zip(hays, asked, strict=True)]
        assert binding._find_own(hays, asked, threshold) == want and sum(map(bool, want)) > 100
        pairs = [(x, hay) for hay, own in zip(hays, asked, strict=True) for x, _ in own]
        assert any(binding.hopeless(pairs, threshold))


def test_invented_values_open_no_window(monkeypatch):
    """A value that no text is near to was compared with every stretch of it."""
    monkeypatch.setattr(binding, "open_windows", lambda *_: 1 / 0)
    hay = "datos del pedido fecha: 01/02/1996 importe: 12345,67 € cliente: customer#{:09} estado: f o p"
    found = binding._find_own([hay.format(k) for k in range(300)], [[("no consta 99", "no consta 99"), (f"customer#{k:09}", f"customer{k:09}")] for k in range(300)], binding.FUZZY_FROM)
    assert [[h[:2] for h in own] for own in found] == [[(1, "substring")]] * 300


def test_a_run_keeps_documents(spark, sf_dir):
    kept = {}

    def keep(relation, label):
        kept[label] = staged(relation, label)
        return kept[label]

    form, boxes = (own.where("doc_id < 90") for own in (layouts.form(spark, sf_dir), layouts.form_rects(spark, sf_dir)))
    answer = lambda prompt: (value_queries._SECOND if "could not be found" in prompt else value_queries._FIRST) % prompt[prompt.find("Customer#") :][:18]
    out = Pipeline(value_queries.SCHEMA, Scripted(answer), on_hallucination="retry", keep=keep).run(form, layouts.blocks(spark, sf_dir).where("doc_id < 0"), boxes)
    n = form.select("doc_id").distinct().count()
    assert n > 50 and kept["documents"].count() == kept["found-0"].count() == kept["found-1"].count() == n and out.fused.count() == form.count()
    assert out.bound.count() == n and kept["bound-0"].count() == 2 * n
