"""All ten operators and the pipeline on clashing columns, ids of other types, null, empty and long texts, ties, repeated rows and empty tables."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import langid, quality, secrets
from tessera.llm.chat import render_maximal
from tessera.llm.decontaminate import find_contamination
from tessera.llm.htmltext import extract_text
from tessera.llm.linededup import dedup_lines
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix
from tessera.llm.toxicity import fit_chain, score

LINE = "A line of text that is long enough, forty characters or more."
LONG = " ".join(f"w{i}" for i in range(30_000))
TEXTS = [None, "", " \n ", LINE, LINE + "\nmore", "x\n" + LINE, LINE + "\ny", LINE + "\nz", LONG, LONG + " end", "password = abcdefgh12", "password = abcdefgh12"]
#: Result columns of every operator, and a name that needs quotes.
CLASHES = ("n_words", "n_hit", "items", "spans", "n_lines", "n_dropped", "p_toxic", "p_low_quality", "text_in", "lang_pred", "score", "proportions", "secrets", "fail_bits", "n_copies", "shuffle_key", "kept", "component_id", "carried_0", "id", "a.b c")


def docs(spark, ids, repeat=1):
    rows = [(i, t, "en" if k % 2 else "de", "s", 3, *(f"own {k} {c}" for c in CLASHES)) for k, (i, t) in enumerate(zip(ids, TEXTS, strict=True))] * repeat
    kind = "string" if any(isinstance(i, str) for i in ids) else "long"
    return spark.createDataFrame(rows, f"doc_id {kind}, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in CLASHES))


NUMBERS = [*range(len(TEXTS) - 1), None]
NAMES = [f"doc-{9 - i}" if i < 9 else f"doc-{i}x" for i in range(len(TEXTS) - 1)] + [None]


def run_all(spark, d):
    """Rows of each operator, with every clashing column carried along."""
    bench = spark.createDataFrame([("q1", LINE), ("q2", None), (None, "x")], "item_id string, text string")
    labels = d.select("doc_id").distinct().withColumns({"quality": F.lit(1), "toxic": F.lit(0)})
    chain = fit_chain(d, labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic"), ("low_quality", "toxic"))
    return {
        "op1": score(d, chain, ("low_quality", "toxic"), carry=CLASHES), "op2": find_contamination(d, bench, carry=CLASHES), "op3": langid.predict(d, langid.learn(d), carry=("doc_id", *CLASHES)),
        "op4": extract_text(d.withColumn("url", F.lit("http://x.example")).withColumnRenamed("text", "html"), carry=("doc_id", *CLASHES)), "op5": quality.ledger(d, carry=("doc_id", *CLASHES)),
        "op7": secrets.find_secrets(d, carry=CLASHES), "op8": dedup_lines(d, carry=CLASHES), "op10": near_duplicates(d), "op6": mix(d),
    }


@pytest.mark.parametrize("ids", [NUMBERS, NAMES], ids=["numbers", "names"])
def test_clashing_columns_and_ids(spark, ids):
    d = docs(spark, ids, repeat=2)
    kind = d.schema["doc_id"].dataType
    for name, found in run_all(spark, d).items():
        rows = found.collect()
        assert found.schema["doc_id"].dataType == kind, name
        if name not in ("op6", "op10"):
            assert len(rows) == 2 * len(TEXTS) and len(set(found.columns)) == len(found.columns), name
            place = {c: c if c in found.columns and not any(r[c] is not None and not str(r[c]).startswith("own ") for r in rows) else c + "_in" for c in CLASHES}
            for c in ("n_words", "score", "a.b c", "id", "carried_0"):
                got = sorted((r[place[c]] or "") for r in rows)
                assert got == sorted(f"own {k} {c}" for k in range(len(TEXTS)) for _ in range(2)), (name, c)
        elif name == "op10":
            assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i in ids * 2)


def test_names_order_as_numbers_do(spark):
    """The least and the largest id are those of the id's own order."""
    d = docs(spark, NAMES)
    lines = {r.doc_id: r.n_dropped for r in dedup_lines(d).collect()}
    holders = [NAMES[i] for i in (3, 4, 5, 6, 7)]
    assert {i for i in holders if lines[i]} == set(holders) - {max(holders)}
    classes = {r.doc_id: r.component_id for r in near_duplicates(d).collect()}
    assert classes[NAMES[8]] == classes[NAMES[9]] == min(NAMES[8], NAMES[9]) and classes[NAMES[10]] == NAMES[10]


def test_empty_tables(spark):
    d = docs(spark, NUMBERS).where("false")
    for name, found in run_all(spark, d).items():
        assert found.count() == 0, name


@pytest.fixture()
def tables(spark, tmp_path):
    def write(d):
        d.write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
        spark.createDataFrame([(k, 1, 0) for k in range(9)] + [(None, 0, 1)], "doc_id long, quality int, toxic int").write.mode("overwrite").parquet(f"{tmp_path}/labels.parquet")
        spark.createDataFrame([(1, "Nothing that any text holds, word for word"), (None, None)], "item_id long, text string").write.mode("overwrite").parquet(f"{tmp_path}/benchmark.parquet")
        return str(tmp_path)

    return write


def test_pipeline_on_odd_rows(spark, tables):
    d = docs(spark, NUMBERS, repeat=2)
    sf_dir = tables(d)
    now, kept = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for _, stage in corpus_pipeline.STAGES[:4]:
        now = stage(spark, now, sf_dir).cache()
        assert now.columns == d.columns
        kept.append(sorted((str(r.doc_id), r["a.b c"], r["n_words"]) for r in now.collect()))
    every = sorted((str(i), f"own {k} a.b c", f"own {k} n_words") for k, i in enumerate(NUMBERS) for _ in range(2))
    assert kept[0] == kept[1] == every
    # the line stays in the largest id that holds it; of the two long texts the least id stays, null ids and empty texts too
    assert [r.n_chars for r in now.where("doc_id = 4").collect()] == [4, 4]
    assert {i for i, _, _ in kept[2]} == {str(i) for i in NUMBERS if i != 9} and kept[3] == kept[2]
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.where("copy < 1 or copy > n_copies").count() == 0 and out.columns.count("n_copies") == 1 and set(CLASHES) <= set(out.columns)
    assert corpus_pipeline.run(spark, tables(d.where("false"))).count() == 0


def test_ties_of_turns(spark):
    """Rows of one turn number stand by role, then by the text's MD5; the SQL says the same."""
    from tessera.llm.registry import SQL, op9_chat_format
    from tests.oracle import assert_same

    rows = [(1, 1, "user", "a"), (1, 1, "user", "b"), (1, 1, "assistant", "c"), (1, None, "user", "d"), (1, 1, None, "e"), (1, 2, None, None), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, 1, "assistant", "c"), (2, None, "user", "d"), (2, 1, None, "e"), (3, None, "user", "d"), (3, None, "user", "d"), (4, 1, "user", "y" * 100_000)]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    import duckdb

    con = duckdb.connect()
    con.register("conversations", d.toPandas().astype({"turn": "Int64"}))
    assert {r.conv_id for r in render_maximal(d).collect()} == {1, 4}
    real = op9_chat_format.__globals__["read"]
    try:
        op9_chat_format.__globals__["read"] = lambda *_: d
        assert_same(op9_chat_format(spark, ""), con, SQL["op9_chat_format"])
    finally:
        op9_chat_format.__globals__["read"] = real


def test_no_shared_folder_on_a_cluster():
    from tessera.llm.workspace import shared_dir

    class Context:
        master = "spark://host:7077"

    class Session:
        sparkContext = Context()
        conf = {}  # noqa: RUF012

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
