"""The whole search of values against brute force, on small tables."""

from __future__ import annotations

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import binding
from tessera.plans import value_queries  # noqa: F401
from tessera.plans.catalog import QUERIES


def made(seed, n):
    return " ".join(np.random.default_rng(seed).choice("ona theri esan lyou whed inti rone sath".split(), n))


def norm(text):
    return re.sub(r"\s+", " ", (text or "").lower()).strip()


def brute(passages, texts, threshold):
    """(doc, item): method, score, start."""
    found = {}
    for doc, text in texts.items():
        hay = norm(text)
        for k, passage in passages.items():
            needle, soft = norm(passage), re.sub(r"[^\w\s%]", "", norm(passage))
            score = binding.partial_ratio(needle, hay) / 100 if threshold and len(needle) >= 6 and hay else 0.0
            if needle == hay != "":
                found[doc, k] = ("exact", 1.0, 0)
            elif needle and needle in hay:
                found[doc, k] = ("substring", 0.95, hay.find(needle))
            elif soft and soft != needle and soft in hay:
                found[doc, k] = ("substring", 0.9, hay.find(soft))
            elif threshold and score >= threshold and binding.best_window(needle, hay) >= 0:
                found[doc, k] = ("fuzzy", round(score, 3), binding.best_window(needle, hay))
            else:
                found[doc, k] = ("not_found", 0.0, None)
    return found


PASSAGES = {0: made(1, 20), 1: made(2, 24) + ".", 2: made(3, 30), 7: "!?", 8: None, 45: "Short one"}
TEXTS = {
    1: made(4, 30) + "\n" + PASSAGES[0] + " " + made(5, 30), 2: PASSAGES[2].upper(), 3: None, 4: "x " + made(2, 24) + " y", 5: PASSAGES[2][:60] + "q" + PASSAGES[2][61:] + " " + made(6, 20), 6: made(7, 30) + " " + PASSAGES[0][6:],
    7: PASSAGES[2][5:] + " " + made(8, 5), 41: "a short  one and " + PASSAGES[1] + made(9, 60) + PASSAGES[0][:-7], 42: made(10, 8), 43: "",
}


@pytest.fixture()
def tables(spark, tmp_path):
    spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(PASSAGES.items()), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("threshold, block", [(None, 256), (0.85, 256), (0.85, 2), (0.7, 3)])
def test_search_against_brute_force(spark, monkeypatch, threshold, block):
    monkeypatch.setattr(binding, "BLOCK", block)
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    items = docs.select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("item_idx", "text"))
    values = spark.createDataFrame([(k, f"item_{k}", v) for k, v in PASSAGES.items()], "field_pos int, field_name string, value string")
    got = binding.search_values(values, docs, binding.haystacks(items), threshold).collect()
    assert len(got) == len(TEXTS) * len(PASSAGES)
    assert {(r.doc_id, r.field_pos): (r.match_method, r.match_score, r.start) for r in got} == brute(PASSAGES, TEXTS, threshold)


def test_every_pair_is_searched(spark, tables):
    got = {(r.doc_id, r.field_pos): r.match_method for r in QUERIES["bind_substring"](spark, tables).collect()}
    assert len(got) == len(TEXTS) * len(PASSAGES)
    assert got[1, 0] == got[41, 45] == got[41, 1] == "substring" and got[2, 2] == "exact"
    sources = {(r.doc_id, r.field_pos): r.source_items for r in QUERIES["bind_sources"](spark, tables).collect()}
    assert len(sources) == len(got) and sources[1, 0] == "1" and sources[2, 2] == "0"
    issues = QUERIES["issues_all"](spark, tables).collect()
    lost = {(r.doc_id, r.field_pos) for r in issues if r.issue_type == "hallucination"}
    want = brute(PASSAGES, TEXTS, 0.85)
    assert lost == {k for k, v in want.items() if v[0] == "not_found"} and want[5, 2][0] == "fuzzy"
    assert sources[5, 2] == "0" and all((k not in lost) == bool(v) for k, v in sources.items())
    assert {r.doc_id: r.issue_types for r in QUERIES["issues_by_type"](spark, tables).collect()}[2] == "hallucination,role_mismatch"
    dropped = QUERIES["issues_dropped"](spark, tables).collect()
    assert {(r.doc_id, r.field_pos) for r in dropped if r.issue_type == "role_mismatch"} >= {(2, 2)} and all(r.issue_type != "hallucination" for r in dropped)


def test_whole_passages_are_altered(spark, tables):
    """A passage whose beginning is missing is found, one that shares only the beginning is not."""
    q = {k: v if v is None else v[:12] + ("z" if v[12:13] == "q" else "q") + v[13:] for k, v in PASSAGES.items()}
    fuzzy = {(r.doc_id, r.field_pos): (r.match_method, r.match_score) for r in QUERIES["bind_fuzzy"](spark, tables).collect()}
    assert fuzzy == {k: v[:2] for k, v in brute(q, TEXTS, 0.85).items()}
    assert fuzzy[7, 2][0] == fuzzy[6, 0][0] == "fuzzy"
    docs = spark.createDataFrame([(1, "x " + PASSAGES[0] + " y"), (2, PASSAGES[0][:20] + " " + made(11, 40))], "doc_id long, text string")
    docs.write.mode("overwrite").parquet(f"{tables}/documents.parquet")
    soft = {(r.doc_id, r.field_pos): (r.match_method, r.match_score) for r in QUERIES["bind_soft"](spark, tables).collect()}
    assert soft[1, 0] == ("substring", 0.9) and soft[2, 0][0] == "not_found"
    assert QUERIES["bind_fuzzy"](spark, tables).where("doc_id = 2 AND field_pos = 0 AND match_method <> 'not_found'").isEmpty()


def test_best_window_is_the_first_of_the_best():
    rng = np.random.default_rng(2)

    def plain(needle, hay):
        n = len(needle)
        own = [(at, binding.ratio(needle, hay[at : at + n])) for at in range(0, len(hay) - n + 1, max(1, n // 4))]
        good = [at for at, r in own if r >= 97]
        return good[0] if good else max(own, key=lambda x: (x[1], -x[0]))[0] if own else -1

    for _ in range(300):
        hay = "".join(rng.choice(list("abc "), rng.integers(1, 60)))
        at = rng.integers(0, len(hay))
        needle = hay[at : at + rng.integers(1, 50)] if rng.random() < 0.5 else "".join(rng.choice(list("abc"), rng.integers(1, 12)))
        needle = needle[:-1] + "x" if rng.random() < 0.5 else needle
        assert binding.best_window(needle, hay) == plain(needle, hay)
