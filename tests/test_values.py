"""Transformers, binding, schemas, the pipeline, cache, providers, sources and arrivals on small cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as tx
from tessera.functions import transforms as tf
from tessera.operators import binding
from tessera.operators.typed import Field, Schema, apply_schema
from tessera.plans.cache import MemoryCache, TableCache, cache_key
from tessera.plans.extraction import Pipeline, describe_schema
from tessera.plans.providers import ChatClient, Fallbacks, ModelError, RateLimited, Retry, Scripted
from tessera.plans.steps import MODEL_STEPS, PLAIN_STEPS, StepLog, title_for
from tessera.sources.engines import TEXT_ITEMS, clean_items, scan
from tessera.streaming.arrivals import extract_arrivals, step_rates, stream_tables
from tests.test_fusion import BLOCKS, ITEMS, RECTS, item, rect

CASES = [
    (tf.date_es, "06/12/26", "2026-12-06", 1.0, ""), (tf.date_es, "6 de diciembre de 2025", "2025-12-06", 1.0, ""), (tf.date_es, "06 de Diciembre", "2026-12-06", 0.7, "year_inferred"), (tf.date_es, "30/02/2026", None, 0.0, "invalid_date"),
    (tf.date_es, "06 de Foo de 2025", None, 0.0, "unknown_month"), (tf.date_es, "6 de diciembre 2025", None, 0.0, "format_unrecognized"), (tf.date_es, "1/1/999", "0999-01-01", 1.0, ""), (tf.date_es, None, None, 0.0, "empty"),
    (tf.date_iso, "2026-06-05", "2026-06-05", 1.0, ""), (tf.datetime_iso, "2026-06-05T10:30:00Z", "2026-06-05 10:30:00", 1.0, ""), (tf.datetime_iso, "2026-06-05 25:30", None, 0.0, "invalid_datetime"), (tf.datetime_iso, "20260605", "2026-06-05 00:00:00", 1.0, ""),
    (tf.amount_eu, "1.234,56 €", "1234.560000000 EUR", 1.0, ""), (tf.amount_eu, "1.234,56", "1234.560000000", 0.7, "currency_ambiguous"), (tf.amount_us, "$1,234.56", "1234.560000000 USD", 1.0, ""), (tf.amount_auto, "1,234.56 USD", "1234.560000000 USD", 1.0, ""),
    (tf.amount_eu, "not a number", None, 0.0, "amount_unparseable"), (tf.amount_eu, "100EUR", None, 0.0, "amount_unparseable"), (tf.amount_auto, "1.234", "1.234000000", 0.7, "currency_ambiguous"), (tf.amount_eu, "1234.56", "123456.000000000", 0.7, "currency_ambiguous"),
    (tf.integer, "1.5", "15", 1.0, ""), (tf.decimal, "1.234,5", "1234.500000000", 1.0, ""), (tf.percentage, "12,5 %", "12.500000000", 1.0, ""), (tf.integer, "x", None, 0.0, "integer_format_invalid"),
    (tf.nif_es, "51789286W", "51789286W", 1.0, ""), (tf.nif_es, "12345678A", "12345678A", 0.5, "nif_checksum_mismatch"), (tf.nif_es, "ABCDEFG", None, 0.0, "nif_format_invalid"), (tf.nif_es, "51789286-w", "51789286W", 1.0, ""),
    (tf.nie_es, "X1234567L", "X1234567L", 1.0, ""), (tf.cif_es, "A12345674", "A12345674", 0.8, ""), (tf.cif(strict=True), "A12345674", "A12345674", 1.0, ""), (tf.cif(strict=True), "A12345675", "A12345675", 0.5, "cif_checksum_mismatch"), (tf.cif_es, "123456789", None, 0.0, "cif_format_invalid"),
    (tf.iban, "ES91 2100 0418 4502 0005 1332", "ES9121000418450200051332", 1.0, ""), (tf.iban, "ES" + "0" * 22, "ES" + "0" * 22, 0.5, "iban_checksum_mismatch"), (tf.iban, "ES12 ABC", None, 0.0, "iban_format_invalid"), (tf.bic, "BBVAESMMXXX", "BBVAESMMXXX", 0.9, ""),
    (tf.phone_es, "659390517", "+34659390517", 1.0, ""), (tf.phone_es, "+34 659 39 05 17", "+34659390517", 1.0, ""), (tf.phone_international, "0034659390517", "0034659390517", 0.0, "missing_country_code"), (tf.email, " A@Ex.com", "a@ex.com", 1.0, ""),
    (tf.url, "example.com", "https://example.com", 1.0, ""), (tf.url, "not a url", "https://not a url", 1.0, ""), (tf.postal_code_es, "99000", "99000", 0.5, "postal_code_prefix_unknown"), (tf.province_es, "santa cruz de tenerife", "Santa Cruz de Tenerife", 1.0, ""),
    (tf.checkbox_binary("V", "H"), "v", "true", 1.0, ""), (tf.checkbox_binary("V", "H"), "X", None, 0.0, "not_binary_label"), (tf.multi_checkbox(("a", "b")), "a, z", "a", 0.6, "unknown_choice"), (tf.regex("[a-z]+"), "abc\n", "abc", 1.0, ""),
    (tf.compose(tf.percentage, tf.integer), "12 %", "12000000000", 1.0, ""), (tf.enum(("A", "a")), "a", "a", 1.0, ""),
]


def test_transformers(spark):
    rows = spark.createDataFrame([(i, c[1]) for i, c in enumerate(CASES)], "i int, raw string")
    for i, (t, _, value, score, issues) in enumerate(CASES):
        v = t(F.col("raw"), as_of=F.to_date(F.lit("2026-05-05")))
        said = tf.money_text(v["normalized"]) if t.kind == tf.MONEY_TYPE else F.array_join(v["normalized"], ",") if t.kind.startswith("array") else v["normalized"].cast("string")
        got = rows.where(F.col("i") == i).select(said, v["score"], F.array_join(v["issues"], ",")).first()
        assert tuple(got) == (value, score, issues), (t.name, CASES[i])


def test_custom_transformer(spark):
    def shout(raw):
        if raw == "!":
            raise ValueError(raw)
        return raw.upper(), 1.0, ()

    t = tf.from_python("shout", "string", shout)
    got = spark.createDataFrame([("a",), ("!",)], "raw string").select(t(F.col("raw")).alias("v")).select("v.*").collect()
    assert [tuple(r) for r in got] == [("A", 1.0, []), (None, 0.0, ["transform_exception:ValueError"])]


def test_texts(spark):
    df = spark.createDataFrame([(" Número  de Años：: ",)], "t string")
    assert df.select(tx.normalize_label(F.col("t"))).first()[0] == "numero de anos"
    answers = {'```json\n{"a": 1}\n```': "1", 'so {"a": 2} it is': "2", "[1]": None, "": None, '{"a": {"b": 1}}': '{"b":1}'}
    got = spark.createDataFrame([(k,) for k in answers], "t string").select("t", F.try_variant_get(tx.parse_json_object(F.col("t")), "$.a", "string").alias("a")).collect()
    assert {r.t: r.a for r in got} == answers


FORM = [item(i, t, 50 + 100 * (i % 2), 100 + 20 * (i // 2)) for i, t in enumerate(("APELLIDOS", "ZAIDAN HASSAN", "NOMBRE", "CLAUDIO ALEJANDRO", "NIF", "51789286W"))]


def fused(spark, label="text"):
    return spark.createDataFrame(FORM, ITEMS).withColumns({"section_title": F.lit(None).cast("string"), "block_label": F.lit(label)})


def test_binding(spark):
    said = {"titular": {"apellidos": "Zaidan  Hassan", "typo": "CLAUDIO ALEJANDRA", "span": "hassan nombre"}, "nif": "51.789.286-W", "phone": "600 000 000", "none": None, "n": [1.5, True, " "]}
    docs = spark.createDataFrame([(1, json.dumps(said)), (2, "not json")], "doc_id long, json string")
    needles = binding.walk_json(docs, "json")
    assert [(r.field_name, r.value) for r in needles.orderBy("field_pos").collect()][-3:] == [("phone", "600 000 000"), ("n[0]", "1.5"), ("n[1]", "true")]
    got = {r.field_name: r for r in binding.bind(needles, fused(spark)).collect()}
    assert (got["titular.apellidos"].match_method, got["titular.apellidos"].match_score, got["titular.apellidos"].source_items) == ("substring", 0.95, [1])
    assert got["titular.span"].source_items == [1, 2] and (got["titular.span"].x, got["titular.span"].w) == (50.0, 140.0)
    assert got["titular.typo"].match_method == "fuzzy" and 0.85 <= got["titular.typo"].match_score < 1 and 3 in got["titular.typo"].source_items
    assert got["nif"].match_score == 0.9 and got["phone"].match_method == "not_found" and got["phone"].page is None
    issues = {(r.field_name, r.issue_type, r.severity) for r in binding.collect_issues(binding.bind(needles, fused(spark, "title"))).collect()}
    assert ("phone", "hallucination", "high") in issues and ("nif", "role_mismatch", "medium") in issues


def test_fuzzy_scores():
    assert binding.common_subsequence("abcde", "xaybcze") == 4 and binding.ratio("", "") == 100.0
    assert binding.partial_ratio("hello", "say helo there", 80) == pytest.approx(200 * 4 / 9, abs=1e-9) or binding.partial_ratio("hello", "say helo there", 80) >= 80
    assert binding.partial_ratio("hello", "zzzzzzz", 50) == 0.0 and binding.best_window("abc", "ab") == -1


SCHEMA = Schema({"titular.nif": Field(tf.nif_es, True, None, ("NIF",)), "titular.apellidos": Field(tf.regex("[A-Z ]+"), False, "Surname", ("Apellidos",)), "fecha": Field(tf.date_es, True)})


def test_schema(spark):
    docs = spark.createDataFrame([(1,), (2,)], "doc_id long")
    rows = [(1, 0, "titular.nif", "51789286W", [5], 0.85), (1, 1, "titular.nif", "12345678A", [5], 0.85), (1, 2, "other", "x", [1], 1.0)]
    bound = spark.createDataFrame(rows, "doc_id long, field_pos int, field_name string, value string, source_items array<int>, match_score double").withColumns({c: F.lit(None).cast("double") for c in "xywh"}).withColumn("page", F.lit(1))
    got = {(r.doc_id, r.field): r for r in apply_schema(docs, bound, SCHEMA).collect()}
    assert got[1, "titular.nif"].confidence == 0.425 and got[1, "titular.nif"].issues == ["nif_checksum_mismatch"]
    assert got[2, "fecha"].issues == ["required_field_missing"] and (1, "titular.apellidos") not in got and len(got) == 4
    assert SCHEMA.fingerprint() == Schema(dict(SCHEMA.fields)).fingerprint() and "(required)" in describe_schema(SCHEMA)


def relations(spark):
    return spark.createDataFrame(FORM, ITEMS), spark.createDataFrame([], BLOCKS), spark.createDataFrame([rect(0, 0, 0, 600, 600)], RECTS)


def test_plain_pipeline(spark):
    seen = []
    out = Pipeline(SCHEMA, callback=seen.append).run(*relations(spark))
    assert [s.name for s in out.steps] == list(PLAIN_STEPS) == [s.name for s in seen] and out.steps[-1].progress == 1.0
    assert {r.field: r.raw for r in out.typed.collect()} == {"titular.nif": "51789286W", "titular.apellidos": "ZAIDAN HASSAN", "fecha": ""}
    assert [r.issue_type for r in out.issues.collect()] == ["missing_required"]


def answer(prompt):
    if "could not be found" in prompt:
        return '```json\n{"titular": {"nif": "51789286W"}, "fecha": "nope nope"}\n```'
    return '{"titular": {"nif": "99999999Z", "apellidos": "ZAIDAN HASSAN"}}'


def test_model_pipeline(spark):
    out = Pipeline(SCHEMA, Scripted(answer), on_hallucination="retry").run(*relations(spark))
    assert [s.name for s in out.steps] == list(MODEL_STEPS)
    assert {r.field_name: r.match_method for r in out.bound.collect()} == {"titular.nif": "substring", "fecha": "not_found"}
    cost = out.cost.first()
    assert cost.model_used == "scripted" and len(cost.breakdown) == 2 and cost.tokens_in > 0
    dropped = Pipeline(SCHEMA, Scripted(answer), on_hallucination="drop").run(*relations(spark))
    assert {r.field: r.issues for r in dropped.typed.collect()}["titular.nif"] == ["required_field_missing"] and dropped.issues.count() == 0


def test_retry_and_fallbacks():
    slept, left = [], [1, 1, 0]

    def work():
        if left.pop(0):
            raise RateLimited("later")
        return "ok"

    assert Retry().call(work, slept.append) == "ok" and slept == [1.0, 2.0]
    assert [Retry(backoff="linear", first_delay_s=0.5).delay(k) for k in range(3)] == [0.5, 1.0, 1.5]
    with pytest.raises(RateLimited):
        Retry(most=1, backoff="none").call(lambda: (_ for _ in ()).throw(RateLimited("no")), lambda s: None)

    def fails(*_):
        raise ModelError("down")

    both = Fallbacks([ChatClient("A", "a", object, fails), ChatClient("B", "gpt-5", object, lambda *_: ("{}", 1_000_000, 0))])
    assert both.complete("s", "p").usd == 1.25 and both.model_id() == "Fallbacks:A:a|B:gpt-5"


def test_routes_and_errors():
    from tessera.plans.providers import BadAnswer, RoutedClient, TimedOut, error_of

    class APITimeoutError(Exception):
        pass

    asked = []

    def send(client, request):
        asked.append(request)
        if request["model"] == "a":
            raise APITimeoutError("slow")
        return {"model": "b-1", "choices": [{"message": {"content": "" if request["model"] == "empty" else "{}"}}], "usage": {"prompt_tokens": 3, "completion_tokens": 2, "cost": 0.5}}

    got = RoutedClient(object, send, ("a", "b"), headers=(("X", "y"),)).complete("s", "p")
    assert (got.model_used, got.tokens_in, got.usd) == ("b-1", 3, 0.5) and [r["model"] for r in asked] == ["a", "b"]
    assert asked[0]["extra_headers"] == {"X": "y"} and asked[0]["response_format"] == {"type": "json_object"} and "models" not in asked[0]["extra_body"]
    RoutedClient(object, send, ("b", "a"), route="lowest-cost").complete("s", "p")
    assert asked[-1]["extra_body"] == {"usage": {"include": True}, "models": ["b", "a"], "route": "lowest-cost"}
    for models, kind in ((("a",), TimedOut), (("a", "empty"), BadAnswer)):
        with pytest.raises(kind):
            RoutedClient(object, send, models).complete("s", "p")
    with pytest.raises(ValueError):
        RoutedClient(object, send, ())
    assert isinstance(error_of(RuntimeError("HTTP 429")), RateLimited) and type(error_of(RuntimeError("x"))) is ModelError
    with pytest.raises(BadAnswer):
        ChatClient("A", "a", object, lambda *_: ("", 1, 1)).complete("s", "p")


def test_steps_of_bundled_cached_and_failed_runs(spark, tmp_path):
    from tessera.plans.steps import BUNDLED_PLAIN_STEPS, CACHE_STEPS, EXPLANATIONS, TITLES, explanation_for

    items, blocks, boxes = relations(spark)
    assert [s.name for s in Pipeline(SCHEMA, parallel_extract=True).run(items, blocks, boxes).steps] == list(BUNDLED_PLAIN_STEPS)
    seen = []
    run = Pipeline(SCHEMA, callback=seen.append, cache_dir=f"file://{tmp_path}/results")
    docs = spark.createDataFrame([(1, "one")], "doc_id long, content string")
    first = run.run_cached(docs, items, blocks, boxes).count()
    seen.clear()
    again = run.run_cached(docs, items, blocks, boxes)
    assert again.count() == first and [s.name for s in seen] == list(CACHE_STEPS) and seen[-1].is_terminal
    TableCache(spark, f"file://{tmp_path}/results").compact()
    assert run.run_cached(docs, items, blocks, boxes).count() == first

    def broken(*_):
        raise ZeroDivisionError("no")

    seen.clear()
    with pytest.raises(ZeroDivisionError):
        Pipeline(SCHEMA, fuse_with=broken, callback=seen.append).run(items, blocks, boxes)
    assert [s.name for s in seen] == ["start", "cache_check", "extract_all", "error"] and seen[-1].payload == {"error": "ZeroDivisionError", "message": "no"}
    # a step is there before the next one's work
    steps = Pipeline(SCHEMA, fuse_with=broken).stream(items, blocks, boxes)
    assert [next(steps).name for _ in range(3)] == ["start", "cache_check", "extract_all"]
    out = Pipeline(SCHEMA).run(items, blocks, boxes)
    by = {s.name: s for s in out.steps}
    assert by["extract_text"].payload["samples"].first().items_count == 6 and by["fuse"].payload["stats"].first().items_count == 6
    assert by["extract_rects"].payload["boxes"].count() == 1 and out.merged.first().page_count == 0
    assert set(EXPLANATIONS) == set(TITLES) and explanation_for("fuse", "xx") == EXPLANATIONS["fuse"][0] and explanation_for("nope") == ""


def test_memory_cache_lets_go(spark):
    memory = MemoryCache(ttl_s=10)
    memory.put("x", spark.range(3), now=100.0)
    assert memory.get("x", now=105.0).count() == 3 and memory.get("x", now=111.0) is None and memory.get("x", now=105.0) is None


def test_merged_document_shapes(spark):
    from tessera.operators.documents import merged_document

    items = spark.createDataFrame([item(0, "b", 60, 20), item(1, "a", 10, 20), item(2, "c", 10, 40)], ITEMS)
    blocks = spark.createDataFrame([(1, 0, 1, 0.0, 10.0, 200.0, 60.0, "table", None, "body", "", [["x", "y"], ["z"]]), (1, 1, 1, 0.0, 0.0, 200.0, 60.0, "text", None, None, "t", None)], BLOCKS + ", cells array<array<string>>")
    rects = spark.createDataFrame([rect(0, 0, 0, 600, 600)], RECTS)
    got = {r.doc_id: r for r in merged_document(spark.createDataFrame([(1,), (2,)], "doc_id long"), items, blocks, rects).collect()}
    assert (got[2].page_count, got[2].blocks) == (0, []) and got[1].page_count == 1
    text, table = got[1].blocks
    assert (text.label, table.label, text.layer) == ("text", "table", "body") and [s.text for s in text.spans] == ["a", "b", "c"] and text.spans[0].bbox[:2] == [10.0, 20.0]
    assert [[len(c) for c in row] for row in table.cells] == [[3, 0], [0, 0]]


def test_cache(spark, tmp_path):
    cache = TableCache(spark, f"file://{tmp_path}/cache", ttl_s=10)
    assert cache.get() is None
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string").withColumn("cache_key", cache_key(F.col("text"), "s", "m"))
    cache.put(docs, now=100.0)
    cache.put(docs.where("doc_id = 1").withColumn("text", F.lit("new")), now=105.0)
    assert {r.doc_id: r.text for r in cache.get(now=108.0).collect()} == {1: "new", 2: "b"} and cache.get(now=112.0).count() == 1
    memory = MemoryCache()
    memory.put("x", docs)
    assert memory.get("x").count() == 2 and memory.get("y") is None


def test_cached_runs(spark, tmp_path):
    import tessera

    items, blocks, boxes = relations(spark)
    twice = items.union(items.withColumn("doc_id", F.lit(2).cast("long")))
    boxes = boxes.union(boxes.withColumn("doc_id", F.lit(2).cast("long")))
    docs = spark.createDataFrame([(1, "same"), (2, "same")], "doc_id long, content string")
    run = tessera.Pipeline(SCHEMA, cache=TableCache(spark, f"file://{tmp_path}/runs"))
    first = run.run_cached(docs, twice, blocks, boxes).collect()
    assert len(first) == 6 and not any(r.cache_hit for r in first)
    seen = []
    again = tessera.Pipeline(SCHEMA, cache=run.cache, callback=seen.append).run_cached(docs.union(spark.createDataFrame([(3, "same")], docs.schema)), twice, blocks, boxes).collect()
    assert len(again) == 9 and all(r.cache_hit for r in again) and {r.raw for r in again if r.doc_id == 3} == {"51789286W", "ZAIDAN HASSAN", ""}
    assert tessera.register_views("t_", items=items) == ["t_items"] and spark.sql("SELECT count(*) FROM t_items").first()[0] == 6
    steps = list(tessera.Pipeline(SCHEMA).stream(items, blocks, boxes))
    assert [s.name for s in steps[:-1]] == list(PLAIN_STEPS)


def test_steps():
    now = iter(range(100))
    log = StepLog(9, clock=lambda: float(next(now)))
    log.emit("start")
    assert log.emit("cache_hit").cumulative_s == 2.0 and log.steps[1].progress < 1 and title_for("fuse", "xx") == "Fusión 3 motores" and title_for("fuse", "en") == "Fusion of 3 engines"


def test_sources(spark):
    def engine(content):
        for k, t in enumerate(content.decode().split()):
            yield {"item_idx": k, "page": 1, "text": t, "x": 0.0, "y": 0.0, "w": 1.0, "h": 1.0, "font_name": None, "font_size": 0.0}

    docs = spark.createDataFrame([(1, bytearray(b"a b")), (2, bytearray(b""))], "doc_id long, content binary")
    got = clean_items(scan(docs, engine, TEXT_ITEMS)).collect()
    assert [(r.doc_id, r.text, r.font_size) for r in got] == [(1, "a", None), (1, "b", None)]


def test_arrivals(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs.where("doc_id < 50").repartition(2).write.parquet(f"{tmp_path}/in")
    extract_arrivals(stream_tables(spark, f"{tmp_path}/in", docs.schema), lambda d: d.select("doc_id", F.length("text").alias("n")), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 50
    assert step_rates(spark.read.parquet(f"{sf_dir}/events.parquet")).agg(F.sum("n")).first()[0] == spark.read.parquet(f"{sf_dir}/events.parquet").count()
