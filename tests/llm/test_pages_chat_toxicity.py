"""HTML extraction, chat formatting, toxicity, the pipeline, and all SQL of the subpackage."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm.chat import render_maximal
from tessera.llm.htmltext import extract_text, host_of, low_branches, main_text, read_page
from tessera.llm.registry import QUERIES, SQL
from tessera.llm.toxicity import fit_chain, score
from tests.oracle import assert_same, connect

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="has-nav"><header>Site</header><nav><ul><li><a href="/a">Menu</a></li></ul></nav>
<div class="tagline">Same words on every page</div>{body}<aside>Side</aside><form><p>Name</p></form><div class="comments"><article><p>Reader says</p></article></div><footer>&copy; {n}</footer></body></html>"""


def page(body, n=0):
    return PAGE.format(body=body, n=n)


class TestHtml:
    def texts(self, source):
        return main_text(read_page(source)[0])

    def test_article(self):
        body = "<article><header><h1>Head &amp; more</h1></header><p><b>One\n  two<br>three<p>Caf&eacute; &#233;&lt;</p><div class='ad-slot'>Buy</div><ul><li>a<li>b</ul><table><tr><td>c<td>d</table></article>"
        assert self.texts(page(body)) == "Head & more\nOne two three\nCafé é<\na\nb\nc\nd"

    def test_without_marked_article(self):
        assert self.texts(page("<p>Only text</p>")) == "Same words on every page\nOnly text"
        assert self.texts("no tags &amp; more") == "no tags & more"
        assert self.texts("") == "" and self.texts("<p>open <b>never closed") == "open never closed"
        assert self.texts("<p>a<!-- <p>x</p> -->b</p><script>if (a<b) c</script><p title='>'>d</p>") == "ab\nd"

    def test_style_tree_removes_templates_only(self, spark):
        rng = np.random.default_rng(1)
        said = lambda: " ".join(rng.choice([f"w{i}" for i in range(500)], 40))
        plain = [(i, "http://One.example/p", page(f"<div class='story'><p>{said()}</p><p>{said()}</p></div>", i)) for i in range(12)]
        copies = [(100 + i, "https://two.example:80/x", page("<article><h1>Copy</h1><p>The same article again and again</p></article>", i)) for i in range(12)]
        few = [(200 + i, "http://three.example", page(f"<p>{said()}</p>")) for i in range(3)]
        odd = [(300, None, None), (301, "http://one.example/q", ""), (None, None, "<p>x</p>"), (300, None, None)]
        pages = spark.createDataFrame([(*r, "host", "text") for r in plain + copies + few + odd], "page_id long, url string, html string, host string, text string")
        low = {(r.host, r.path.rpartition("/")[2]) for r in low_branches(pages.select(host_of(F.col("url")).alias("host"), "html")).collect()}
        assert ("one.example", "div.tagline") in low and not any(p in ("p", "div.story", "article") for _, p in low)
        for sent in (10**6, -1):
            got = {r.page_id: r.text for r in extract_text(pages, sent_rows=sent).collect()}
            assert len(got[0].split("\n")) == 2 and "Same words" not in got[0]
            assert got[100] == "Copy\nThe same article again and again"
            assert got[200].startswith("Same words on every page\n") and got[300] == "" and got[301] == "" and got[None] == "x"
        assert extract_text(pages).count() == pages.count()
        assert extract_text(pages.where("false")).count() == 0


class TestChat:
    SCHEMA = "conv_id long, turn long, role string, text string, n_turns long, conv string, h1 long"

    def rows(self, spark, convs):
        return spark.createDataFrame([(c, t, r, x, 1, "c", 1) for c, turns in convs for t, (r, x) in enumerate(turns)], self.SCHEMA)

    def test_prefixes_copies_and_odd_rows(self, spark):
        talk = [("user", "hi"), ("assistant", "yes?"), ("user", None), (None, "x" * 100_000)]
        convs = [(1, talk[:1]), (2, talk[:3]), (3, talk), (4, talk), (5, [("user", "hi"), ("user", "yes?")]), (6, [("user", "")]), (7, [("user", None)]), (None, talk[:2])]
        rows = self.rows(spark, convs)
        got = {r.conv_id: r for r in render_maximal(rows.union(rows)).collect()}
        assert {k: (r.n_turns, r.n_copies) for k, r in got.items()} == {3: (4, 2), 5: (2, 1), 6: (1, 1), 7: (1, 1)}
        assert got[5].rendered == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>user\nyes?<|im_end|>\n" and "<|im_start|>unknown\nxxx" in got[3].rendered
        assert render_maximal(rows.where("false")).count() == 0

    def test_against_brute_force(self, spark):
        rng = np.random.default_rng(4)
        convs = [(i, [("user" if k % 2 else "assistant", str(rng.integers(0, 2))) for k in range(rng.integers(1, 6))]) for i in range(120)]
        whole = Counter(tuple(t) for _, t in convs)
        want = {min(i for i, t in convs if tuple(t) == w): (len(w), n) for w, n in whole.items() if not any(len(v) > len(w) and v[: len(w)] == w for v in whole)}
        assert {r.conv_id: (r.n_turns, r.n_copies) for r in render_maximal(self.rows(spark, convs)).collect()} == want


class TestToxicity:
    def test_chain_learns_and_odd_rows(self, spark):
        rng = np.random.default_rng(3)
        clean, bad = [f"word{i}" for i in range(60)], ["nasty", "vile", "awful"]
        rows, marks = [], []
        for i in range(600):
            toxic, junk = i % 6 == 0, i % 5 == 0
            words = list(rng.choice(clean, 40)) + (list(rng.choice(bad, 2)) if toxic else [])
            rng.shuffle(words)
            rows.append((i, " ".join(w + ("%%%" if junk else "") for w in words), 1.0))
            marks.append((i, int(junk), int(toxic) if i % 50 else None))
        docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic double")
        labels = spark.createDataFrame(marks[:400] + marks[:3] + [(None, 1, 1)], "doc_id long, junk int, toxic int")
        chain = fit_chain(docs, labels, ("junk", "toxic"), sample_rows=380)
        assert len(chain.models[1][0]) == len(chain.models[0][0]) + 1
        got = {r.doc_id: r for r in score(docs.where("doc_id >= 400"), chain, ("junk", "toxic")).collect()}
        assert all((got[i].p_toxic >= 0.5) == (i % 6 == 0) and (got[i].p_junk >= 0.5) == (i % 5 == 0) for i in got)
        odd = spark.createDataFrame([(1, None, 0.0), (None, "", 0.0), (2, "vile " * 50_000, 0.0), (2, "vile", 0.0)], docs.schema)
        p = [(r.doc_id, r.p_toxic) for r in score(odd, chain, ("junk", "toxic"), carry=("p_toxic",)).select("doc_id", F.col("text"), "p_junk").withColumn("p_toxic", F.lit(0.5)).collect()]
        assert len(p) == 4
        assert score(odd.where("false"), chain, ("junk", "toxic")).count() == 0

    @pytest.mark.parametrize("mark, low", [(None, True), (0, True)])
    def test_without_labels_nothing_is_toxic(self, spark, mark, low):
        docs = spark.createDataFrame([(i, "some text") for i in range(9)], "doc_id long, text string")
        labels = spark.createDataFrame([(i, mark) for i in range(9)], "doc_id long, toxic int")
        got = score(docs, fit_chain(docs, labels, ("toxic",)), ("toxic",)).collect()
        assert all((r.p_toxic < 0.5) == low for r in got)
        assert score(docs, fit_chain(docs, labels.where("false"), ("toxic",)), ("toxic",)).where("p_toxic >= 0.5").count() == 0

    def test_held_out_accuracy(self, spark, sf_dir):
        """On the given labels, fitted on half of them."""
        docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet")
        labels = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/labels.parquet")
        chain = fit_chain(docs, labels.where("doc_id % 2 = 0"), ("toxic",))
        got = score(docs, chain, ("toxic",)).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
        assert sum((r.p_toxic >= 0.5) == (r.toxic == 1) for r in got) / len(got) > 0.93


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, con, SQL[name])
    else:
        table = "pages" if name.startswith("op4_") else "documents"
        assert df.count() == spark.read.parquet(f"{sf_dir}/{table}.parquet").count()


def test_language_held_out_accuracy(spark, sf_dir):
    rows = QUERIES["op3_language_id"](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97


def test_pipeline_stages(spark, sf_dir):
    """Each stage against a plain version of its decision, on what its predecessor kept."""
    from tests.llm.test_text_operators import TestDecontaminate, TestLineDedup, classes

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], sf_dir).cache())
    assert all(t.columns == columns for t in tables[:5])
    ids = [{r.doc_id for r in t.select("doc_id").collect()} for t in tables]
    marks = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    assert sum((i in ids[1]) == (marks[i] == 0) for i in marks if i in ids[0]) / len(marks) > 0.95
    before = [(r.doc_id, r.text, r.source) for r in tables[1].collect()]
    after = {r.doc_id: r for r in tables[2].collect()}
    assert {i: r.text for i, r in after.items()} == {i: x for i, _, x in TestLineDedup().brute(before)}
    assert all(r.n_chars == len(r.text) for r in after.values() if r.text != dict((i, t) for i, t, _ in before)[r.doc_id])
    want = classes([(i, r.text) for i, r in after.items()], 5)
    assert ids[3] == {i for (i, _), c in want.items() if c == i}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    found = {i: TestDecontaminate().brute(after[i].text, items) for i in ids[3]}
    assert ids[4] == {i for i, (n, h, _) in found.items() if not (h and 20 * h >= n)}
    assert tables[5].where("copy < 1 or copy > n_copies").count() == 0 and ids[5] <= ids[4]
    assert corpus_pipeline.run(spark, sf_dir).count() == tables[5].count()
