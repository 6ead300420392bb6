"""Operators that SQL can't express, against plain versions of their methods on small tables."""

from __future__ import annotations

import itertools
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import htmltext as ht
from tessera.llm import langid
from tessera.llm.bloom import is_twice, seen_twice, twice_filter
from tessera.llm.linededup import dedup_lines
from tessera.llm.minhash import _likely, near_duplicates
from tessera.llm.registry import TOXIC_FROM
from tessera.llm.toxicity import CATEGORIES, fit_chain, low_quality_and_toxic, score
from tessera.llm.workspace import Workspace

WORDS = [f"w{i}" for i in range(400)]


# --- op4: a style tree in plain recursion


class Plain:
    def __init__(self):
        self.children, self.styles, self.texts = {}, Counter(), Counter()
        self.m = self.points = self.clear = self.bare = 0.0

    def at(self, path):
        node = self
        for step in [x for x in path.split("/") if x]:
            node = node.children.setdefault(step, Plain())
        return node


def entropy(counts, m):
    total = sum(counts.values())
    return -sum(c / total * math.log(c / total) for c in counts.values()) / math.log(m)


def plain_low(pages):
    """Of the pages of one host: low branches, and whether without regard to names."""
    weights = Counter(ht._content_key(ht.read_page(p)[0]) for p in pages)
    root = Plain()
    for p in pages:
        blocks, styles = ht.read_page(p)
        w = 1 / weights[ht._content_key(blocks)]
        for path, children in styles.items():
            root.at(path).m += w
            root.at(path).styles["||".join(children)] += w
        seen = set()
        for b, (said, bare) in zip(blocks, ht.said_by_markup(blocks), strict=True):
            node = root.at(b.path + "/#text")
            node.points, node.clear, node.bare = node.points + w * len(b.text), node.clear + w * len(b.text) * said, node.bare + w * len(b.text) * bare
            for key in {(b.path, None), (b.path, b.text)} - seen:
                if key[1] is None:
                    node.m += w
                else:
                    node.texts[b.text] += w
            seen |= {(b.path, None), (b.path, b.text)}
    doubt = lambda x, m: 1 - (1 - min(1.0, max(0.0, x))) * m / (m + ht.DOUBT)

    def text_importance(n):
        if n.m < 2:
            return 1.0
        total = sum(n.texts.values())
        return 1 - sum(c * math.log(c) for c in n.texts.values()) / (total * math.log(n.m))

    found = {}

    def weigh(n, path):
        """(importance, points, varying, clear, bare, low things of the subtree)."""
        if path.endswith("/#text"):
            own = text_importance(n)
            return doubt(own, n.m), n.points, n.clear * min(1, max(0, own)), n.clear / max(1, n.points), n.bare / max(1, n.points)
        parts = [parts_of[f"{path}/{c}"] for c in n.children]
        total = sum(max(1.0, x[1]) for x in parts)
        below = sum(max(1.0, x[1]) * x[0] for x in parts) / total if parts else 1.0
        share = 1 - ht.INHERITED ** len(parts) if parts else 0.0
        shown = doubt(entropy(n.styles, n.m) if n.m >= 2 else 1.0, n.m)
        return share * max(shown, below) + (1 - share) * below, sum(x[1] for x in parts), sum(x[2] for x in parts), max((x[3] for x in parts), default=0), max((x[4] for x in parts), default=0)

    parts_of = {}

    def walk(n, path):
        for c, child in n.children.items():
            walk(child, f"{path}/{c}")
        parts_of[path] = weigh(n, path)

    walk(root, "")
    whole = parts_of[""][2]
    for path, (importance, points, varied, clear, bare) in parts_of.items():
        least = ht.LOW_INSIDE if any(s.split(".")[0].split("#")[0] in ("article", "main") for s in path.split("/") if s) else ht.LOW
        known = 1.0 if varied >= ht.MOST_VARIED * whole else importance
        if path and points and known * clear < least:
            found[path] = known * bare < least
    return found


def made_site(rng, n, article, terms):
    said = lambda k: " ".join(rng.choice(WORDS, k))
    tag = "article" if article else "div class='story'"
    end = "article" if article else "div"
    menu = "".join(f"<li><a>{w}</a></li>" for w in rng.choice(WORDS, 5))
    return [
        f"<html><head><title>{said(3)}</title></head><body><nav><ul>{menu}</ul></nav><div class='wrap'><div class='tagline'>Every page says so</div><{tag}><h1>{said(4)}</h1>"
        + "".join(f"<p>{said(int(rng.integers(5, 30)))}</p>" for _ in range(int(rng.integers(1, 4))))
        + f"<p class='by'>By the staff</p></{end}><div class='terms'>{terms}</div><div class='ad-slot'>{said(3)}</div><div class='related-work'><p>{said(6)}</p></div></div></body></html>"
        for _ in range(n)
    ]


def test_style_tree_against_plain_recursion(spark):
    rng = np.random.default_rng(8)
    sites = {f"h{k}.example": made_site(rng, n, article, "Terms of use. " * t) for k, (n, article, t) in enumerate([(1, False, 1), (2, True, 2), (3, False, 30), (4, False, 1), (7, False, 5), (12, False, 60), (12, True, 3), (30, True, 9)])}
    sites["copies.example"] = made_site(rng, 1, False, "T") * 9 + made_site(rng, 3, False, "T")
    rows = [(i, f"http://{h}/{i}", x) for h, pages in sites.items() for i, x in enumerate(pages)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = defaultdict(dict)
    for r in extract(pages):
        got[r.url.split("/")[2]][r.page_id] = r.text
    for h, own in sites.items():
        low = plain_low(own)
        assert {i: ht.main_text(ht.read_page(x)[0], low) for i, x in enumerate(own)} == got[h], h
    # without any article tag: the tree drops what every page says and keeps the story
    assert all("Every page says so" not in t and "Terms" not in t and len(t) > 20 for t in got["h5.example"].values())
    assert all("Every page says so" in t for t in got["h2.example"].values()) == ("Every page says so" in got["h2.example"][0])


def extract(pages):
    return ht.extract_text(pages).collect()


def test_article_text_stays_whole():
    text = lambda x: ht.main_text(ht.read_page(x)[0])
    assert text("<main><h1>Title</h1><p>Lead</p><article><p>Body of it</p></article></main>") == "Title\nLead\nBody of it"
    body = "Some body text. " * 10
    assert text(f"<body><p>{body}</p><article class='card'>teaser</article></body>") == f"{body.strip()}\nteaser"
    assert text("<article><p>A</p><div class='related-work'>B</div><p class='notice-period'>C</p><section id='comment-on-results'>D</section><div class='ad-slot'>E</div><ol class='comment-list'>F</ol></article>") == "A\nB\nC\nD"


# --- op3: sets of languages, fitted long


def plain_fit(words, own):
    likely = np.exp(words[:, own] - words.max(1)[:, None])
    share = np.full(len(own), 1 / len(own))
    for _ in range(1500):
        mixed = share * likely
        share = (mixed / mixed.sum(1, keepdims=True)).mean(0)
    return np.log((share * likely).sum(1)).sum(), share


def plain_mixture(words, more, every_set):
    """The set of greatest penalised likelihood, of all sets or of the 1, 2, 3 ... most present languages (the best one alone first)."""
    n, n_langs = words.shape
    order = np.argsort(-plain_fit(words, list(range(n_langs)))[1], kind="stable")
    alone = [[k] for k in range(n_langs)]
    larger = [list(x) for k in range(2, n_langs + 1) for x in itertools.combinations(range(n_langs), k)] if every_set else [list(order[:k]) for k in range(2, n_langs + 1)]
    best = None
    for own in alone + larger:
        value, share = plain_fit(words, own)
        value -= (len(own) - 1) * (np.log(n) / 2 + more)
        if best is None or value > best[0] + 1e-9:
            best = (value, own, share)
    out = np.zeros(n_langs)
    out[best[1]] = best[2]
    return out, best[0]


def value_of(words, share, more):
    likely = np.exp(words - words.max(1)[:, None])
    return np.log(likely @ share).sum() - (np.count_nonzero(share) - 1) * (np.log(len(words)) / 2 + more)


@pytest.mark.parametrize("apart", [True, False])
def test_mixtures_against_long_fits(apart):
    """Languages as far apart as real ones: the best of every set; else: as good as the best set of most present ones."""
    rng = np.random.default_rng(4)
    for _ in range(5):
        n_langs = int(rng.integers(2, 6))
        sizes = rng.integers(3, 120, 4)
        parts = []
        for n in sizes:
            spoken = rng.choice(rng.permutation(n_langs)[: rng.integers(1, n_langs + 1)], n)
            own = rng.normal(-14, 1 if apart else 2, (n, n_langs))
            own[np.arange(n), spoken] += rng.uniform(5, 9) if apart else rng.uniform(1, 8)
            parts.append(own)
        got = langid.mixtures(np.concatenate(parts), sizes)
        for own, share in zip(parts, got, strict=True):
            want, value = plain_mixture(own, langid.MORE, apart)
            if apart:
                assert set(np.flatnonzero(want)) == set(np.flatnonzero(share)), (want, share)
                assert np.allclose(want, share, atol=0.02)
            assert value_of(own, share, langid.MORE) >= value - 3 * langid.CLOSE


def test_six_languages_and_a_bound_that_holds():
    rng = np.random.default_rng(6)
    spoken = np.repeat(np.arange(6), 400)
    words = rng.normal(-20, 1, (2400, 8))
    words[np.arange(2400), spoken] += 3.0
    share = langid.mixtures(words, np.array([2400]))[0]
    assert np.count_nonzero(share) == 6 and np.allclose(share[:6], 1 / 6, atol=0.03)
    likely = np.exp(words - words.max(1)[:, None])
    _, value, gap = langid._fit(np.full((1, 8), 1 / 8), likely, np.array([2400]), np.array([-1e9]))
    assert gap[0] <= langid.CLOSE
    for _ in range(50):
        other = rng.dirichlet(np.ones(8))
        assert np.log(likely @ other).sum() <= value[0] + gap[0] + 1e-6


# --- op1: the registered chain in plain numpy


def plain_chain(texts, marks, folds, fold_of, asked):
    """marks: rows x categories, nan where unlabelled."""
    from tessera.llm import toxicity as tx

    def features(t):
        return {f for w in tx._counted(t or "")[0] for f in (w, *("^" + w[:b] for b in tx.BEGINNINGS if len(w) >= b))}

    sets = [features(t) for t in texts]

    def picked(k, rows):
        rows = [r for r in rows if not np.isnan(marks[r, k])]
        n, a = Counter(f for r in rows for f in sets[r]), Counter(f for r in rows if marks[r, k] for f in sets[r])
        p = sum(marks[r, k] for r in rows) / max(1, len(rows))
        if not 0 < p < 1:
            return []
        part = lambda x, of: x * math.log(x / of) if x > 0 else 0.0
        gain = {f: round(2 * (part(a[f], c * p) + part(c - a[f], c * (1 - p))), 9) for f, c in n.items() if c >= 3}
        order = sorted(gain, key=lambda f: (-gain[f], f))[: tx.FEATURES]
        return [f for i, f in enumerate(order) if i < tx.AT_LEAST or gain[f] >= tx.GAIN]

    def matrix(some, own, before):
        rows = []
        for t, p in zip(some, before, strict=True):
            counted, n_words, n_letters = tx._counted(t or "")
            total = Counter()
            for w, c in counted.items():
                for f in (w, *("^" + w[:b] for b in tx.BEGINNINGS if len(w) >= b)):
                    total[f] += c
            rows.append([x for f in own for x in (float(total[f] > 0), min(1.0, tx.FULL_DENSITY * total[f] / max(1, n_words)))] + tx._shares(t or "", n_words, n_letters) + list(p))
        return np.array(rows)

    def fit(x, y):
        if y.min() == y.max():
            share = (y.sum() + 0.5) / (len(y) + 1)
            return np.zeros(x.shape[1] + 1) + np.append(np.zeros(x.shape[1]), math.log(share / (1 - share)))
        x = np.hstack((x, np.ones((len(x), 1))))
        ridge = np.diag(np.append(np.full(x.shape[1] - 1, 0.1), 1e-9))
        w = np.zeros(x.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-x @ w))
            w = w - np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge, x.T @ (p - y) + ridge @ w)
        return w

    prob = lambda x, w: 1 / (1 + np.exp(-np.hstack((x, np.ones((len(x), 1)))) @ w))
    held, out = np.zeros((len(texts), 0)), np.zeros((len(asked), 0))
    everyone = np.arange(len(texts))
    for k in range(marks.shape[1]):
        known = ~np.isnan(marks[:, k])
        own = picked(k, everyone)
        w = fit(matrix([texts[r] for r in everyone[known]], own, held[known]), marks[known, k])
        out = np.hstack((out, prob(matrix(asked, own, out), w)[:, None]))
        column = np.zeros(len(texts))
        for f in range(folds if k + 1 < marks.shape[1] else 0):
            apart, rest = fold_of == f, known & (fold_of != f)
            own = picked(k, everyone[fold_of != f])
            w = fit(matrix([texts[r] for r in everyone[rest]], own, held[rest]), marks[rest, k])
            column[apart] = prob(matrix([texts[r] for r in everyone[apart]], own, held[apart]), w)
        held = np.hstack((held, column[:, None]))
    return out


def test_chain_against_plain_numpy(spark):
    from tessera.llm.toxicity import FOLDS

    rng = np.random.default_rng(9)
    rows, marks = [], []
    for i in range(260):
        toxic, junk = rng.random() < 0.25, rng.random() < 0.3
        words = list(rng.choice(WORDS[:50], 25)) + (["nasty", "vile"] if toxic and rng.random() < 0.9 else []) + (["%%%", "###"] if junk else [])
        rows.append((i, " ".join(words)))
        marks.append((i, int(not junk), int(toxic) if i % 9 else None))
    docs = spark.createDataFrame([*rows, (1000, rows[3][1]), (1001, None)], "doc_id long, text string")
    labels = low_quality_and_toxic(spark.createDataFrame([*marks, (1000, 1, 0)], "doc_id long, quality int, toxic int"))
    chain = fit_chain(docs, labels, CATEGORIES)
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in score(docs, chain, CATEGORIES).collect()}
    sample = docs.where("doc_id <> 1001").select("doc_id", "text", F.pmod(F.xxhash64("text", F.lit("fold")), F.lit(FOLDS)).alias("fold")).orderBy("doc_id").collect()
    known = {i: (1 - q, np.nan if t is None else t) for i, q, t in [*marks, (1000, 1, 0)]}
    folds = np.array([r.fold for r in sample])
    assert folds[3] == folds[-1]  # equal texts are held out together
    want = plain_chain([r.text for r in sample], np.array([known[r.doc_id] for r in sample], float), FOLDS, folds, [r.text for r in sample] + [None])
    assert np.allclose([got[r.doc_id] for r in sample] + [got[1001]], want, atol=5e-3)


def test_registered_chain_at_its_threshold(spark, sf_dir):
    """Fitted on half of the labelled rows (35 toxic ones), judged on the other half."""
    sf = sf_dir.replace("sf0.001", "sf0.01")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    chain = fit_chain(docs, low_quality_and_toxic(labels.where("doc_id % 2 = 0")), CATEGORIES)
    rows = score(docs, chain, CATEGORIES).join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    clean, toxic = [r for r in rows if not r.toxic], [r for r in rows if r.toxic]
    assert sum(r.p_toxic >= TOXIC_FROM for r in clean) <= 0.01 * len(clean)
    assert sum(r.p_toxic >= TOXIC_FROM for r in toxic) >= 0.7 * len(toxic)


# --- op8: filters that are far too small, and one hash for a third of all


def test_filters_find_every_repeat(spark):
    rng = np.random.default_rng(3)
    values = rng.integers(0, 2**63, 40_000, dtype=np.uint64)
    again = values[rng.integers(0, len(values), 3_000)]
    hot = np.full(20_000, values[0])
    every = np.concatenate((values, again, hot))
    rng.shuffle(every)
    rows = [(len(x), bytearray(x.tobytes())) for x in np.array_split(every, 300)]
    hashes = spark.createDataFrame(rows, "n long, hashes binary").repartition(5)
    twice = set(np.unique(np.concatenate((again, hot[:1]))).view(np.int64).tolist())
    for range_hashes, range_bits in ((1 << 22, 1 << 26), (2_000, 1 << 16), (500, 1 << 8)):
        found = {r.hash for r in seen_twice(hashes, range_hashes, range_bits).collect()}
        assert twice <= found
        if range_bits == 1 << 26:
            assert len(found - twice) < 50
    sent, bits = twice_filter(hashes, Workspace(spark, "filters"), 1 << 20)
    assert is_twice(np.array(sorted(twice)).view(np.uint64), np.frombuffer(sent.value, np.uint8), bits).all()


def test_full_once_filters_change_no_text(spark):
    line = "This line stands in many documents, and it is long enough."
    rows = [(i, f"{line}\nown line of document number {i}, long enough to be looked at") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for range_bits in (1 << 26, 64):
        got = {r.doc_id: r.n_dropped for r in dedup_lines(docs, range_bits=range_bits).collect()}
        assert got == {i: int(i != 399) for i in range(400)}


# --- op10: a family without links


def test_family_without_links_sends_no_text(spark):
    """Signatures alone settle members that share buckets but hardly agree."""
    import pyarrow as pa

    rng = np.random.default_rng(7)
    n = 700
    minima = rng.integers(0, 256, (n, 200), dtype=np.uint8)
    table = lambda m: pa.table({"open": pa.array([True] * n + [False] * n), "component": pa.array(list(range(n)) * 2), "id": pa.array(list(range(n)) * 2), "minima": pa.array([x.tobytes() for x in m] * 2), "buckets": pa.array([[1, 2, k] for k in range(10, 10 + n)] * 2, pa.list_(pa.int64()))})
    assert _likely(0.66)(table(minima)).num_rows == 0
    minima[5] = minima[600]
    minima[5, :30] ^= 1
    assert sorted(_likely(0.66)(table(minima)).column("id").to_pylist()) == [5, 5, 600, 600]


def test_recall_of_five_word_classes(spark, sf_dir):
    """Links of the pipeline's stage against all pairs through an inverted index."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    from tests.llm.test_text_operators import shingles

    sets = {i: shingles(t, 5) for i, t in rows}
    holders = defaultdict(list)
    for i, own in sets.items():
        for g in own:
            holders[g].append(i)
    common = Counter()
    for own in holders.values():
        common.update(itertools.combinations(sorted(own), 2))
    links = [(a, b) for (a, b), c in common.items() if 100 * c >= 80 * (len(sets[a]) + len(sets[b]) - c)]
    classes = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert links and all(classes[a] == classes[b] for a, b in links)
