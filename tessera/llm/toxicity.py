"""Toxicity by a classifier chain of linear models.

Categories are predicted one after the other; each later model sees the
probabilities of the earlier ones, and learns from probabilities that models
trained without the row gave it (out of fold), as it will meet them on new rows.
A row's fold follows from its text, so equal texts are held out together; the
features of a fold's model are picked without the fold too.

Features are words and word beginnings that go with a category by the likelihood
ratio over the labelled rows, as presence and as density, and a few shares of
characters.  The models are fitted on at most ``SAMPLE_ROWS`` labelled rows, those
of least hash; the features come from the same rows.  Every text is scored whole.

Results for odd input: null text scores like an empty one; a very long text is
scored whole; ids may be of any type; a row with no label in a category doesn't
train that category, nor does a label without an id or a document; labels repeated
for an id count as one row with the largest value, documents repeated for an id are
rows each; of features that gain equally the first by name is taken; with one class
only the probability is the smoothed share of that class, and without labelled rows
(an empty table of documents or labels) it is 0; columns that aren't carried are
ignored, and a carried one that is called like one of the result is given with
``_in`` added; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.linear import Rows, fit_logistic, sigmoid
from tessera.llm.workspace import Workspace, carried, column, given_back

SAMPLE_ROWS, FEATURES, FOLDS = 12_000, 256, 5
#: Features beyond the first few must gain so much: chance gives one in 270,000 as much.
AT_LEAST, GAIN = 64, 25.0
#: A density of one in so many words counts fully.
FULL_DENSITY = 40
BEGINNINGS = (4, 5, 6, 7)
#: Features that a task counts before it hands them on.
STATISTICS = 500_000

_WORD = re.compile(r"[^\W\d_]+")
_SYMBOL = re.compile(r"[#*$%&|<>{}\\^~=+]")
_N_SHARES = 5


def _shares(text: str, n_words: int, n_letters: int) -> list[float]:
    n = max(1, len(text))
    lines = text.split("\n")
    return [len(_SYMBOL.findall(text)) / n * 5, n_letters / n, min(2.0, n_letters / max(1, n_words) / 10), 1 - len(set(lines)) / len(lines), min(1.0, 20 / max(1, n_words))]


def _counted(text: str) -> tuple[Counter, int, int]:
    found = _WORD.findall(text.lower())
    return Counter(found), len(found), sum(map(len, found))


def _statistics(n_labels: int):
    names = ["feature", "fold", *(str(k) for k in range(2 * n_labels))]

    def rows(seen: dict[tuple, Counter]) -> pa.RecordBatch:
        # features by fold and by which labels their rows had: a few patterns, each with a counter
        total: dict[tuple[str, int], list[int]] = {}
        for (fold, *own), counted in seen.items():
            for f, n in counted.items():
                at = total.setdefault((f, fold), [0] * (2 * n_labels))
                for k, y in enumerate(own):
                    if y is not None:
                        at[2 * k] += n
                        at[2 * k + 1] += n * y
        return pa.RecordBatch.from_arrays([pa.array([f for f, _ in total], pa.string()), pa.array([k for _, k in total], pa.int32()), *(pa.array([v[k] for v in total.values()], pa.int64()) for k in range(2 * n_labels))], names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of some texts (text, fold, labels) at a time: features with the number of labelled rows and of positive ones, by category."""
        for batch in batches:
            labels = list(zip(*(batch.column(1 + k).to_pylist() for k in range(1 + n_labels)), strict=True))
            seen: dict[tuple, Counter] = {}
            size = 0
            for text, own in zip(batch.column(0).to_pylist(), labels, strict=True):
                found = {f for w in _counted(text or "")[0] for f in (w, *("^" + w[:b] for b in BEGINNINGS if len(w) >= b))}
                seen.setdefault(own, Counter()).update(found)
                size += len(found)
                if size > STATISTICS:
                    yield rows(seen)
                    seen, size = {}, 0
            if seen:
                yield rows(seen)

    return count


class Featurizer:
    """Text to (columns, values): presence and density of each chosen feature, then the shares."""

    def __init__(self, features: Sequence[str]):
        self.place = {f: i for i, f in enumerate(features)}
        self.heads = {f.removeprefix("^")[: BEGINNINGS[0]] for f in features}
        self.width = 2 * len(features) + _N_SHARES

    def __call__(self, text: str) -> tuple[list[int], list[float]]:
        words, n_words, n_letters = _counted(text)
        found: dict[int, int] = {}
        head, place, heads = BEGINNINGS[0], self.place, self.heads
        for w, n in words.items():
            if w[:head] in heads:
                for f in (w, *("^" + w[:b] for b in BEGINNINGS if len(w) >= b)):
                    if (k := place.get(f)) is not None:
                        found[k] = found.get(k, 0) + n
        cols, vals = [], []
        for k, n in found.items():
            cols += [2 * k, 2 * k + 1]
            vals += [1.0, min(1.0, FULL_DENSITY * n / n_words)]
        return cols + list(range(self.width - _N_SHARES, self.width)), vals + _shares(text, n_words, n_letters)


def _rows(texts: Sequence[str | None], featurize: Featurizer) -> Rows:
    own = [featurize(t or "") for t in texts]
    sizes = [len(c) for c, _ in own]
    return Rows(np.repeat(np.arange(len(own)), sizes), np.array([x for c, _ in own for x in c], np.int64), np.array([x for _, v in own for x in v], np.float64), (len(own), featurize.width))


@dataclass
class Chain:
    """Fitted models in the order of the chain."""

    featurize: Featurizer
    models: list[tuple[np.ndarray, float]]

    def probabilities(self, texts: Sequence[str | None]) -> np.ndarray:
        x = _rows(texts, self.featurize)
        out = np.zeros((len(texts), len(self.models)))
        for k, (w, b) in enumerate(self.models):
            out[:, k] = sigmoid(x.times(w[: x.shape[1]]) + out[:, :k] @ w[x.shape[1] :] + b)
        return out


def _picked(stats: DataFrame, total: dict[str, float], k: int, held: int | None, folds: int, most: int) -> list[str]:
    """Features of category ``k`` by gain, counted without the fold ``held``."""
    used = [f for f in range(folds) if f != held]
    rows, positive = (sum(total[f"{c}{k}_{f}"] for f in used) for c in "np")
    if not 0 < positive < rows:
        return []
    n, a = (sum((F.col(f"{c}{k}_{f}") for f in used[1:]), F.col(f"{c}{k}_{used[0]}")) for c in "np")
    part = lambda x, of: F.when(x > 0, x * F.log(x / of)).otherwise(0.0)
    # how unlikely the feature's share of positive rows is by chance; sound for small counts too
    gain = F.round(2 * (part(a, n * (positive / rows)) + part(n - a, n * (1 - positive / rows))), 9)
    best = stats.where(n >= 3).select("feature", gain.alias("gain")).orderBy(F.desc("gain"), "feature").limit(most).collect()
    return [r["feature"] for i, r in enumerate(best) if i < AT_LEAST or r["gain"] >= GAIN]


def _unpacked(places: Sequence[bytes], values: Sequence[bytes], kind: type, width: int) -> Rows:
    """What a ``Featurizer`` gives of some texts, of the places and densities of their features with the shares behind them."""
    n = np.array([len(c) for c in places], np.int64) // np.dtype(kind).itemsize
    place = np.frombuffer(b"".join(places), kind).astype(np.int64)
    value = np.frombuffer(b"".join(values), np.float32).astype(np.float64)
    end = np.cumsum(n + _N_SHARES)
    is_share = np.zeros(len(value), bool)
    is_share[(end[:, None] - np.arange(_N_SHARES, 0, -1)).ravel()] = True
    row = np.repeat(np.arange(len(n)), n)
    rows = np.concatenate((row, row, np.repeat(np.arange(len(n)), _N_SHARES)))
    cols = np.concatenate((2 * place, 2 * place + 1, np.tile(np.arange(width - _N_SHARES, width), len(n))))
    return Rows(rows, cols, np.concatenate((np.ones(len(place)), value[~is_share], value[is_share])), (len(n), width))


def fit_chain(docs: DataFrame, labels: DataFrame, categories: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text", sample_rows: int = SAMPLE_ROWS, features: int = FEATURES, folds: int = FOLDS) -> Chain:
    """Models for the 0/1 columns ``categories`` of ``labels``, in that order."""
    names = [f"y{k}" for k in range(len(categories))]
    known = labels.where(column(id_col).isNotNull()).groupBy(column(id_col).alias("id")).agg(*(F.max(column(c).cast("int")).alias(n) for c, n in zip(categories, names, strict=True)))
    chosen = known.withColumn("h", F.xxhash64("id")).orderBy("h", "id").limit(sample_rows)  # bounded, so it may be sent to all tasks
    texts = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    work = Workspace(docs.sparkSession, "toxicity")
    fold = F.pmod(F.xxhash64(F.coalesce("text", F.lit("")), F.lit("fold")), F.lit(folds)).cast("int")
    sample = work.save(texts.join(F.broadcast(chosen), "id").select("id", "text", fold.alias("fold"), *names), "sample")

    by_fold = lambda c: [F.sum(F.when(F.col("fold") == f, F.col(c)).otherwise(0)).cast("double").alias(f"{c}_{f}") for f in range(folds)]
    counts = [f"{c}{k}" for k in range(len(names)) for c in "np"]
    stats = sample.select("text", "fold", *names).mapInArrow(_statistics(len(names)), "feature string, fold int, " + ", ".join(f"{c} long" for c in counts))
    stats = work.save(stats.groupBy("feature").agg(*(x for c in counts for x in by_fold(c))), "features")
    marks = sample.select("fold", *(x for k, n in enumerate(names) for x in (F.col(n).isNotNull().cast("int").alias(f"n{k}"), F.coalesce(n, F.lit(0)).alias(f"p{k}"))))
    total = {c: x or 0.0 for c, x in marks.agg(*(x for c in counts for x in by_fold(c))).first().asDict().items()}
    whole = [_picked(stats, total, k, None, folds, features) for k in range(len(names))]
    # only a category that a later one follows is predicted out of fold
    apart = [[_picked(stats, total, k, f, folds, features) for f in range(folds)] for k in range(len(names) - 1)]
    kept = list(dict.fromkeys(f for own in whole for f in own))
    every = list(dict.fromkeys([*kept, *(f for own in apart for part in own for f in part)]))
    featurize = Featurizer(every)

    small = np.uint16 if len(every) < 1 << 16 else np.int32

    def featurized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of (h, text, fold, labels): the features' places and densities, and the shares behind these; presence follows from them."""
        for batch in batches:
            own = [featurize(t or "") for t in batch.column(1).to_pylist()]
            places = pa.array([(np.array(c[:-_N_SHARES:2], np.int64) // 2).astype(small).tobytes() for c, _ in own], pa.binary())
            values = pa.array([np.array(v[1:-_N_SHARES:2] + v[-_N_SHARES:], np.float32).tobytes() for _, v in own], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), places, values, *batch.columns[2:]], ["h", "c", "v", "fold", *names])

    hashed = sample.select(F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), "text", "fold", *names)
    frame = hashed.mapInArrow(featurized, "h long, c binary, v binary, fold int, " + ", ".join(f"{n} int" for n in names)).toPandas()
    work.remove()
    # rows that are equal in these are equal, so the order is the same in every run
    frame = frame.sort_values(["h", *names], kind="stable", na_position="first").reset_index(drop=True)
    x = _unpacked(frame["c"], frame["v"], small, featurize.width)
    row_fold = frame["fold"].to_numpy(np.int64)

    def own_columns(picked: list[str]) -> np.ndarray:
        """A model sees its own category's features, the shares, and the earlier probabilities."""
        own = np.ones(x.shape[1], bool)
        own[: featurize.width - _N_SHARES] = False
        for f in picked:
            own[2 * featurize.place[f] : 2 * featurize.place[f] + 2] = True
        return own

    models = []
    for k, n in enumerate(names):
        y = frame[n].to_numpy(np.float64, na_value=np.nan)
        with_label = np.flatnonzero(~np.isnan(y))
        w, b = fit_logistic(x.only(own_columns(whole[k])).take(with_label), y[with_label])
        # of the features only those of some whole model go into the chain; the shares and probabilities stand behind them
        models.append((np.concatenate((w[: 2 * len(kept)], w[2 * len(every) :])), b))
        if k + 1 < len(names):
            held = np.zeros(len(frame))
            for f in range(folds):
                seen, others = x.only(own_columns(apart[k][f])), with_label[row_fold[with_label] != f]
                w, b = fit_logistic(seen.take(others), y[others])
                held[row_fold == f] = sigmoid(seen.take(np.flatnonzero(row_fold == f)).times(w) + b)
            x = x.with_column(held)
    return Chain(Featurizer(kept), models)


def score(docs: DataFrame, chain: Chain, categories: Sequence[str], *, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """id, text, ``p_<category>`` of every row, and ``carry``."""
    base = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), *carried(carry))
    sent, names = docs.sparkSession.sparkContext.broadcast(chain), base.columns

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                p = sent.value.probabilities(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([*(pa.array(p[:, k]) for k in range(p.shape[1])), *part.columns], [f"p{k}" for k in range(p.shape[1])] + names)

    schema = T.StructType([*(T.StructField(f"p{k}", T.DoubleType()) for k in range(len(categories))), *base.schema.fields])
    out = base.mapInArrow(scored, schema)
    result = [f"p_{c}" for c in categories]
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), *(F.col(f"p{k}").alias(c) for k, c in enumerate(result)), *given_back(carry, (id_col, text_col, *result)))


def low_quality_and_toxic(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The categories that the label table offers, in the order of the chain."""
    return labels.select(id_col, (1 - F.col("quality")).alias("low_quality"), "toxic")


CATEGORIES = ("low_quality", "toxic")
