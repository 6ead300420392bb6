"""Language identification by inference of multilingual mixtures.

Per language a smoothed model of letter trigrams inside words.  A document is a
mixture: each word comes from one of its languages.  Expectation-maximisation
estimates the proportions over all languages; then the sets of the 1, 2, 3 ...
most present languages are fitted, and the one of greatest penalised likelihood
is kept.  The prediction is the language of largest proportion in it.

Each fit goes on until its likelihood is within ``CLOSE`` of the greatest: with
d_k the mean over the words of (likelihood in language k / likelihood in the
mixture), no mixture of these languages reaches more than n log max d_k beyond
the present one.  The same bound tells when no larger set can win.

Models are counted over at most about ``ROWS_PER_LANG`` labelled rows of each
language, chosen by hash of the id, for the ``MOST_LANGS`` languages of most
labelled rows.  Every text is read whole.

Results for odd input: null text or text without a letter is ``und`` with score 0,
and so is everything if nothing could be learned; a very long text is a run of its
own; of languages that explain a text equally well the first by name stands; a row
whose id is null is never learned from and counts as not held out; repeated rows
are predicted each; columns that aren't carried are ignored, and a carried one that
is called like one of the result is given with ``_in`` added; an empty table gives
an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.workspace import carried, column, given_back

ROWS_PER_LANG, MOST_LANGS, BUCKETS = 3_000, 256, 1 << 16
UNKNOWN = "und"
RUN_POINTS = 400_000
SMOOTHING = 0.2
#: Nats that a further language must gain over the half log of the number of words.
MORE = 6.0
#: Nats under the greatest likelihood at which a fit ends, and sweeps after which it ends in any case.
CLOSE, SWEEPS = 0.05, 1000

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def _runs(texts: Sequence[str | None]) -> Iterator[tuple[int, list[str]]]:
    at, own, size = 0, [], 0
    for i, t in enumerate(texts):
        own.append((t or "").lower())
        size += len(own[-1])
        if size >= RUN_POINTS:
            yield at, own
            at, own, size = i + 1, [], 0
    if own:
        yield at, own


def _trigrams(own: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each letter's trigram, first trigram of each word, row of each word."""
    points = np.frombuffer("\n".join([*own, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    at = np.flatnonzero(letter)
    if not len(at):
        return at, at, at
    before = np.where(letter[at - 1] & (at > 0), points[at - 1], 1).astype(np.uint64)
    after = np.where(letter[np.minimum(at + 1, len(points) - 1)], points[np.minimum(at + 1, len(points) - 1)], 2).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = before * np.uint64(0x9E3779B97F4A7C15) + points[at] * np.uint64(0xC2B2AE3D27D4EB4F) + after * np.uint64(0x165667B19E3779F9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
    bucket = (h >> np.uint64(48)).astype(np.int64) % BUCKETS
    first = np.flatnonzero(np.concatenate(([True], np.diff(at) > 1)))
    ends = np.cumsum([len(t) + 1 for t in own])
    return bucket, first, np.searchsorted(ends, at[first], "right")


def _counter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = batch.column(1).to_pylist()
        seen: dict[str, np.ndarray] = {}
        for at, own in _runs(batch.column(0).to_pylist()):
            bucket, first, row = _trigrams(own)
            if not len(bucket):
                continue
            rows = np.repeat(row, np.diff(np.concatenate((first, [len(bucket)]))))
            named = np.array(langs[at : at + len(own)], object)[rows]
            for lang in set(langs[at : at + len(own)]):
                seen.setdefault(lang, np.zeros(BUCKETS, np.int64))[:] += np.bincount(bucket[named == lang], minlength=BUCKETS)
        for lang, counts in seen.items():
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(counts[some], pa.int64())], ["lang", "bucket", "n"])


@dataclass
class Languages:
    names: list[str]
    #: log likelihood of each bucket under each language
    table: np.ndarray


def held_out(id_col: str = "doc_id") -> Column:
    """A quarter of the ids, by their text's crc32; these are never learned from."""
    return F.coalesce(F.crc32(column(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows_per_lang: int = ROWS_PER_LANG, most_langs: int = MOST_LANGS) -> Languages:
    usable = docs.where(~held_out(id_col) & column(id_col).isNotNull() & column(lang_col).isNotNull() & column(text_col).isNotNull())
    usable = usable.select(column(id_col).alias("id"), column(text_col).alias("text"), column(lang_col).alias("lang"))
    sizes = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_langs).collect()}
    if not sizes:
        return Languages([], np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(min(1.0, rows_per_lang / n)))))
    chosen = usable.where(F.pmod(F.xxhash64("id", F.lit("learn")), F.lit(1_000_000)) < share[F.col("lang")] * 1_000_000)
    counted = chosen.select("text", "lang").mapInArrow(_counter, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    names = sorted(set(counted["lang"]))
    counts = np.zeros((BUCKETS, len(names)))
    counts[counted["bucket"].to_numpy(np.int64), counted["lang"].map({x: k for k, x in enumerate(names)}).to_numpy(np.int64)] = counted["n"]
    return Languages(names, np.log((counts + SMOOTHING) / (counts.sum(0) + SMOOTHING * BUCKETS)).astype(np.float32))


def _fit(share: np.ndarray, likely: np.ndarray, size: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expectation-maximisation from ``share`` for all documents at once: proportions, log likelihood, and by how much the greatest may lie above it.

    A document whose likelihood can't reach ``wanted`` any more is left where it is.
    """
    share, value, gap = share.copy(), np.zeros(len(size)), np.zeros(len(size))
    open_ = np.arange(len(size))
    for _ in range(SWEEPS):
        first = np.concatenate(([0], np.cumsum(size)[:-1]))
        old = share[open_]
        own = np.repeat(old, size, axis=0) * likely
        total = own.sum(1)
        own /= total[:, None]
        new = np.add.reduceat(own, first, axis=0) / size[:, None]
        value[open_] = np.add.reduceat(np.log(total), first)
        gap[open_] = size * np.log(np.max(np.divide(new, old, out=np.zeros_like(new), where=old > 0), axis=1))
        share[open_] = new
        on = (gap[open_] > CLOSE) & (value[open_] + gap[open_] > wanted[open_])
        if not on.any():
            break
        if not on.all():
            likely, size, open_ = likely[np.repeat(on, size)], size[on], open_[on]
    return share, value, gap


def mixtures(words: np.ndarray, size: np.ndarray, more: float = MORE, most_set: int | None = None) -> np.ndarray:
    """Proportions (documents x languages) in the set of greatest penalised likelihood; ``words``: log likelihoods by word, ``size``: words by document (none 0); ``most_set`` bounds the sets, all languages without it."""
    n_langs = words.shape[1]
    first = np.concatenate(([0], np.cumsum(size)[:-1]))
    top = words.max(1)
    likely = np.exp(words - top[:, None]) + 1e-30
    alone = np.add.reduceat(words - top[:, None], first, axis=0)
    best = alone.argmax(1)
    reached = alone[np.arange(len(size)), best]
    out = np.zeros((len(size), n_langs))
    out[np.arange(len(size)), best] = 1.0
    if n_langs == 1:
        return out
    cost = np.log(size) / 2 + more
    share, value, gap = _fit(np.full((len(size), n_langs), 1 / n_langs), likely, size, reached + cost)
    bound = value + gap
    open_ = np.flatnonzero(bound - cost > reached)
    k, widest = 2, n_langs if most_set is None else min(most_set, n_langs)
    while len(open_) and k <= widest:
        word = np.concatenate([np.arange(first[d], first[d] + size[d]) for d in open_])
        order = np.argsort(-share[open_], axis=1, kind="stable")
        own = np.zeros((len(open_), n_langs))
        np.put_along_axis(own, order[:, :k], np.take_along_axis(share[open_], order[:, :k], 1) + 1e-6, 1)
        own /= own.sum(1, keepdims=True)
        own, reached_k, _ = _fit(own, likely[word], size[open_], reached[open_] + (k - 1) * cost[open_])
        gained = reached_k - (k - 1) * cost[open_]
        better = gained > reached[open_]
        reached[open_[better]] = gained[better]
        out[open_[better]] = own[better]
        # a set of k + 1 languages or more
        open_ = open_[bound[open_] - k * cost[open_] > reached[open_]]
        k += 1
    return out


def _predictor(sent):
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Languages = sent.value
        for batch in batches:
            names = np.full(batch.num_rows, UNKNOWN, object)
            scores = np.zeros(batch.num_rows)
            shares: list[list[tuple[str, float]] | None] = [[] for _ in range(batch.num_rows)]
            for at, own in _runs(batch.column(0).to_pylist()) if model.names else ():
                bucket, first, row = _trigrams(own)
                if not len(bucket):
                    continue
                words = np.add.reduceat(model.table[bucket], first, axis=0).astype(np.float64)
                docs, size = np.unique(row, return_counts=True)
                share = mixtures(words, size)
                best = share.argmax(1)
                for d, b, own_share in zip(docs, best, share, strict=True):
                    names[at + d], scores[at + d] = model.names[b], min(1.0, own_share[b])
                    shares[at + d] = [(model.names[k], float(own_share[k])) for k in np.flatnonzero(own_share > 0)]
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(shares, pa.map_(pa.string(), pa.float64())), *batch.columns[1:]], ["lang_pred", "score", "proportions", *(f"carried_{i}" for i in range(batch.num_columns - 1))])

    return predict


def predict(docs: DataFrame, model: Languages, *, text_col: str = "text", carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """lang_pred, score, proportions (language to share) of every row, and the columns of ``carry``; only the text is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    base = docs.select(column(text_col).alias("text"), *carried(carry))
    schema = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("proportions", T.MapType(T.StringType(), T.DoubleType())), *base.schema.fields[1:]])
    out = base.mapInArrow(_predictor(sent), schema)
    result = ("lang_pred", "score", "proportions")
    return out.select(*given_back(carry, result), *result)
