"""Benchmark decontamination by an FM-index of each training shard.

A shard is a run of whole documents of one task.  Its words become symbols (words
that no benchmark item has become the mark that no phrase may pass), stretches
too short for any phrase are left out, and the rest is indexed.  All benchmark
phrases are searched backwards at once through wavelet ranks, occurrences are
located through sampled suffix positions, and their word spans merged.

Benchmark items are sent to the tasks in blocks of bounded size; with more than
one block the finds of each block are written and merged per document.

Results for odd input: null or empty text has no words and is clean; a very long
text is a shard of its own; ids may be of any type; an item without id or words is
not searched; repeated items of one id are one item with the phrases of all, equal
phrases of several items count for each; repeated documents are judged alike; an
empty table gives an empty table, and without items every document is clean;
columns that aren't carried are ignored, and a carried one that is called like one
of the result is given with ``_in`` added.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textarrays as ta
from tessera.llm.fmindex import FMIndex
from tessera.llm.workspace import Workspace, carried, column, given_back

WIDTH = 13
#: Code points of benchmark text that a block may hold.
BLOCK_POINTS = 4 << 20
SHARD_BYTES = 2 << 20

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


class Phrases:
    """Windows of a block of items: symbols of their words, distinct windows by width, and who has them."""

    def __init__(self, items: Sequence[tuple[str, str]], width: int):
        column = pa.array([t for _, t in items], pa.string())
        self.names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        found: dict[int, dict[bytes, set[int]]] = {}
        hashes = []
        for run in ta.runs(column):
            w = ta.words(run, ta.NON_ALNUM)
            for r, (a, b) in enumerate(zip(w.first[:-1], w.first[1:], strict=True)):
                hashes.append((number[items[run.first + r][0]], w.hash[a:b]))
        self.vocabulary = np.unique(np.concatenate([h for _, h in hashes])) if hashes else np.zeros(0, np.uint64)
        for owner, own in hashes:
            symbols = np.searchsorted(self.vocabulary, own) + 1
            size = min(width, len(symbols))
            for k in range(len(symbols) - size + 1 if size else 0):
                found.setdefault(size, {}).setdefault(symbols[k : k + size].tobytes(), set()).add(owner)
        self.by_width = []
        for size, own in sorted(found.items()):
            patterns = np.frombuffer(b"".join(own), np.int64).reshape(-1, size)
            owners = [sorted(x) for x in own.values()]
            self.by_width.append((patterns, np.concatenate(([0], np.cumsum([len(x) for x in owners]))), np.concatenate(owners)))
        self.least = min(found, default=0)


def occurrences(text: np.ndarray, phrases: Phrases) -> Iterator[tuple[np.ndarray, int, np.ndarray, np.ndarray]]:
    """Of each width: positions in ``text``, the width, and pairs (which position, item)."""
    index = FMIndex(text, len(phrases.vocabulary) + 1)
    for patterns, first, owners in phrases.by_width:
        begin, end = index.search(patterns)
        hit = np.flatnonzero(end > begin)
        if not len(hit):
            continue
        count = (end - begin)[hit]
        offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        position = index.locate(np.repeat(begin[hit], count) + offset)
        pattern = np.repeat(hit, count)
        n = (first[1:] - first[:-1])[pattern]
        which = np.repeat(np.arange(len(pattern)), n)
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        yield position, patterns.shape[1], which, owners[np.repeat(first[pattern], n) + inner]


def _ranges(hit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _search_run(run: ta.Run, phrases: Phrases) -> tuple[ta.Words, np.ndarray, np.ndarray]:
    """Words of the run, which of them are hit, and distinct pairs (row, item)."""
    w = ta.words(run, ta.NON_ALNUM)
    hit = np.zeros(len(w.hash), bool)
    pairs = np.zeros((0, 2), np.int64)
    if not len(w.hash) or not phrases.least:
        return w, hit, pairs
    at = np.minimum(np.searchsorted(phrases.vocabulary, w.hash), len(phrases.vocabulary) - 1)
    known = phrases.vocabulary[at] == w.hash
    row = w.row
    # stretches of known words within one row, of at least the shortest phrase
    fresh = np.ones(len(known), bool)
    fresh[1:] = (row[1:] != row[:-1]) | ~known[:-1]
    stretch = np.cumsum(fresh & known) - 1
    length = np.bincount(stretch[known]) if known.any() else np.zeros(0, int)
    use = known.copy()
    use[known] = length[stretch[known]] >= phrases.least
    place = np.flatnonzero(use)
    if not len(place):
        return w, hit, pairs
    # one mark between stretches
    shift = np.cumsum(np.concatenate(([0], np.diff(stretch[place]) != 0)))
    text = np.zeros(len(place) + int(shift[-1]) + 1, np.int64)
    slot = np.arange(len(place)) + shift
    text[slot] = at[place] + 1
    back = np.full(len(text), -1)
    back[slot] = place
    cover = np.zeros(len(w.hash) + 1, np.int64)
    found = []
    for position, width, which, item in occurrences(text, phrases):
        word = back[position]
        np.add.at(cover, word, 1)
        np.add.at(cover, word + width, -1)
        found.append(np.stack((row[word[which]], item), axis=1))
    hit = np.cumsum(cover[:-1]) > 0
    if found:
        pairs = np.unique(np.concatenate(found), axis=0)
    return w, hit, pairs


def _searcher(sent):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = sent.value
        for batch in batches:
            for run in ta.runs(batch.column(1), SHARD_BYTES):
                w, hit, pairs = _search_run(run, phrases)
                first = w.first
                spans: list[list[dict]] = [[] for _ in range(run.rows)]
                items: list[list[str]] = [[] for _ in range(run.rows)]
                for r, i in pairs:
                    items[r].append(phrases.names[i])
                n_hit = np.zeros(run.rows, np.int64)
                for r in np.unique(pairs[:, 0]):
                    own = hit[first[r] : first[r + 1]]
                    n_hit[r] = own.sum()
                    points = np.concatenate(([0], np.cumsum((run.data[run.begin[r] : run.begin[r + 1]] & 0xC0) != 0x80)))
                    for a, b in zip(*_ranges(own), strict=True):
                        spans[r].append({"start": int(points[w.start[first[r] + a] - run.begin[r]]), "end": int(points[w.end[first[r] + b - 1] - run.begin[r]])})
                yield pa.RecordBatch.from_arrays([
                    pa.array(w.per_row, pa.int64()), pa.array(n_hit), pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    pa.array(spans, _SPANS_ARROW), *(c.slice(run.first, run.rows) for c in [batch.column(0), *batch.columns[1:]]),
                ], [str(i) for i in range(4 + len(batch.columns))])

    return search


def find_contamination(docs: DataFrame, benchmark: DataFrame, *, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", carry: Sequence[str] = (), block_points: int = BLOCK_POINTS) -> DataFrame:
    """id, text, n_words, n_hit, items (ids as strings, sorted), spans (code points, end exclusive) of every row, and ``carry``."""
    spark = docs.sparkSession
    base = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), *carried(carry))
    kinds = base.schema.fields
    schema = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPANS), *kinds])
    items = benchmark.select(column(item_col).cast("string").alias("item"), column(item_text_col).alias("text")).where("item is not null and text is not null")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-total // block_points) or 1
    if blocks > 1:
        blocks *= 2  # dealt by hash, so with room
    searched = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b) if blocks > 1 else items
        phrases = Phrases([(r["item"], r["text"]) for r in own.toLocalIterator()], width)
        searched.append(base.mapInArrow(_searcher(spark.sparkContext.broadcast(phrases)), schema))
    if blocks == 1:
        out = searched[0]
    else:
        out = _merged(base, searched, Workspace(spark, "contamination"))
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_words", "n_hit", "items", "spans", *given_back(carry, (id_col, text_col, "n_words", "n_hit", "items", "spans")))


def _merged(base: DataFrame, searched: list[DataFrame], work: Workspace) -> DataFrame:
    """Finds of several blocks: spans of a document joined where they overlap or only separators lie between neighbours' words."""
    kind = base.schema["id"].dataType
    key = [F.col("id").alias("key"), F.xxhash64("text").alias("text_key")]
    finds = [work.save(x.where("n_hit > 0").select(*key, "items", F.transform("spans", lambda s: s).alias("spans"), "text").dropDuplicates(["key", "text_key"]), f"block-{i}") for i, x in enumerate(searched)]
    every = finds[0]
    for x in finds[1:]:
        every = every.unionByName(x)

    def merge(table: pa.Table) -> pa.Table:
        text = table.column("text")[0].as_py()
        w = ta.words(next(ta.runs(pa.array([text], pa.string()))), ta.NON_ALNUM)
        points = np.concatenate(([0], np.cumsum((np.frombuffer(text.encode(), np.uint8) & 0xC0) != 0x80)))
        start, end = points[w.start], points[w.end]
        hit = np.zeros(len(start), bool)
        for s in (s for own in table.column("spans").to_pylist() for s in own):
            hit |= (start >= s["start"]) & (end <= s["end"])
        spans = [{"start": int(start[a]), "end": int(end[b - 1])} for a, b in zip(*_ranges(hit), strict=True)]
        names = sorted({x for own in table.column("items").to_pylist() for x in own})
        return pa.table({"key": table.column("key").slice(0, 1), "text_key": table.column("text_key").slice(0, 1), "n_hit": pa.array([int(hit.sum())]), "items": pa.array([names], pa.list_(pa.string())), "spans": pa.array([spans], _SPANS_ARROW)})

    schema = T.StructType([T.StructField("key", kind), T.StructField("text_key", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", SPANS)])
    joined = every.groupBy("key", "text_key").applyInArrow(merge, schema)
    joined = joined.withColumnRenamed("text_key", "found_key")
    plain = searched[0].drop("n_hit", "items", "spans").withColumn("text_key", key[1])
    return plain.join(joined, F.col("id").eqNullSafe(F.col("key")) & (F.col("text_key") == F.col("found_key")), "left").withColumns({"n_hit": F.coalesce("n_hit", F.lit(0)), "items": F.coalesce("items", F.array().cast("array<string>")), "spans": F.coalesce("spans", F.array().cast(SPANS))})


def contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """Contract's rule: a hit, and at least a twentieth of the words."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
