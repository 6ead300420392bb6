"""Line deduplication with a once-seen and a twice-seen Bloom filter.

1. Every text is split once; the hashes of its distinct long lines are written.
2. The hashes go through two Bloom filters: those that the once filter of their
   range has already make the twice filter.
3. A line whose bits are all set in the twice filter is a suspected repeat.
   Only suspected repeats shuffle, as 128-bit digests counted per task first;
   the counts confirm exactly and choose the document that keeps the line.
4. Confirmed lines leave every other document.

The once filters are as many as the number of long lines asks for and stay where
they are; the twice filter grows with the number of lines seen twice up to
``MOST_BITS``; beyond that more lines are suspected, which costs shuffle, never a
result.  The confirmed lines are sent to the tasks while they are at most
``SENT_ROWS``; beyond that they are joined by digest and handed to each document
as a list.

Results for odd input: null or empty text is one empty line, which stays; a very
long text is split whole; ids may be of any type that has an order; rows of one id
count as one document, and all rows that carry the largest id holding a line keep
it; a null id counts as the least id; columns that aren't carried are ignored, a
carried one that is called like one of the result is given with ``_in`` added; an
empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textarrays as ta
from tessera.llm.bloom import MOST_BITS, RANGE_BITS, is_twice, twice_filter
from tessera.llm.workspace import SALTS, Workspace, carried, column, given_back, lookup

LEAST_POINTS, LEAST_DOCS = 40, 5
SENT_ROWS = 1 << 20


def _row_hashes(run: ta.Run, own: ta.Lines) -> np.ndarray:
    """Hashes of the long lines, one for each row that holds the line."""
    row = np.repeat(np.arange(run.rows), own.per_row)[own.long]
    pairs = np.zeros(len(row), [("row", np.int64), ("hash", np.uint64)])
    pairs["row"], pairs["hash"] = row, own.hash[own.long]
    return np.unique(pairs)["hash"]


def _hasher(least: int):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in ta.runs(batch.column(0)):
                found = _row_hashes(run, ta.lines(run, least))
                yield pa.RecordBatch.from_arrays([pa.array([len(found)], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["n", "hashes"])

    return hashes


def _digest(run: ta.Run, own: ta.Lines, i: int) -> bytes:
    return hashlib.blake2b(ta.LOWER[run.data[own.key_start[i] : own.key_end[i]]].tobytes(), digest_size=16).digest()


def _suspects(run: ta.Run, own: ta.Lines, twice: np.ndarray, bits: int) -> list[tuple[int, int, bytes]]:
    """(row, hash, digest) of the suspected lines, each once for a row."""
    which = np.flatnonzero(own.long)
    which = which[is_twice(own.hash[which], twice, bits)]
    rows = np.repeat(np.arange(run.rows), own.per_row)[which]
    return list(dict.fromkeys((int(r), int(own.hash[i].view(np.int64)), _digest(run, own, i)) for r, i in zip(rows, which, strict=True)))


def _counter(sent, bits: int, least: int, least_docs: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of each batch: suspected lines with the ids that hold them, ``least_docs`` at most since so many confirm, and the largest id."""
        twice = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            kind, ids = batch.schema.field(0).type, batch.column(0).to_pylist()
            seen: dict[bytes, list] = {}
            for run in ta.runs(batch.column(1)):
                for row, hashed, digest in _suspects(run, ta.lines(run, least), twice, bits):
                    doc = ids[run.first + row]
                    if digest not in seen:
                        seen[digest] = [hashed, {doc}, doc]
                        continue
                    own = seen[digest]
                    if len(own[1]) < least_docs:
                        own[1].add(doc)
                    if own[2] is None or doc is not None and doc > own[2]:
                        own[2] = doc
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([list(x[1]) for x in seen.values()], pa.list_(kind)), pa.array([x[2] for x in seen.values()], kind)], ["digest", "hash", "ids", "keeper"])

    return count


def _lister(sent, bits: int, least: int):
    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The suspected lines of each row, for the join."""
        twice = np.frombuffer(sent.value, np.uint8)
        for batch in batches:
            kind, ids = batch.schema.field(0).type, batch.column(0).to_pylist()
            for run in ta.runs(batch.column(1)):
                found = _suspects(run, ta.lines(run, least), twice, bits)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([ids[run.first + r] for r, _, _ in found], kind), pa.array([d for _, _, d in found], pa.binary())], ["id", "digest"])

    return listed


def _dropper(sent, least: int):
    """Takes id, text, a list of digests (null where the confirmed lines were sent), then the carried columns."""

    def drop(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = digests = keepers = None
        if sent is not None:
            hashes, digests = (np.frombuffer(x, d) for x, d in zip(sent.value[:2], (np.uint64, "V16"), strict=True))
            keepers = sent.value[2]
        for batch in batches:
            ids = batch.column(0).to_pylist()
            lists = None if sent is not None else batch.column(2).to_pylist()
            for run in ta.runs(batch.column(1)):
                own = ta.lines(run, least)
                gone = np.zeros(len(own.start), bool)
                if sent is not None:
                    which = np.flatnonzero(own.long)
                    row = np.repeat(np.arange(run.rows), own.per_row)[which]
                    at = np.searchsorted(hashes, own.hash[which])
                    near = np.flatnonzero(at < len(hashes))
                    near = near[hashes[at[near]] == own.hash[which[near]]]
                    for k in near:
                        digest, j = _digest(run, own, which[k]), at[k]
                        while j < len(hashes) and hashes[j] == own.hash[which[k]]:
                            if digests[j].tobytes() == digest:
                                gone[which[k]] = keepers[j] != ids[run.first + row[k]]
                            j += 1
                else:
                    first = own.first
                    for r in range(run.rows):
                        if listed := lists[run.first + r]:
                            listed = set(listed)
                            for i in range(first[r], first[r + 1]):
                                gone[i] = own.long[i] and _digest(run, own, i) in listed
                first = own.first
                count = np.add.reduceat(gone.astype(np.int64), first[:-1])
                texts = batch.column(1).slice(run.first, run.rows)
                if count.any():
                    texts = texts.to_pylist()
                    for r in np.flatnonzero(count):
                        texts[r] = b"\n".join(run.data[own.start[i] : own.end[i]].tobytes() for i in range(first[r], first[r + 1]) if not gone[i]).decode()
                    texts = pa.array(texts, pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(run.first, run.rows), texts.cast(pa.string()), pa.array(own.per_row, pa.int64()), pa.array(count, pa.int64()), *(c.slice(run.first, run.rows) for c in batch.columns[3:])], [str(i) for i in range(4 + len(batch.columns) - 3)])

    return drop


def dedup_lines(docs: DataFrame, *, least_points: int = LEAST_POINTS, least_docs: int = LEAST_DOCS, id_col: str = "doc_id", text_col: str = "text", carry: Sequence[str] = (), most_bits: int = MOST_BITS, range_bits: int = RANGE_BITS, sent_rows: int = SENT_ROWS) -> DataFrame:
    """id, text (what stays), n_lines, n_dropped of every row, and the columns named in ``carry``."""
    spark = docs.sparkSession
    work = Workspace(spark, "lines")
    base = docs.select(column(id_col).alias("id"), column(text_col).alias("text"), *carried(carry))
    texts = base.select("id", "text")
    kind = base.schema["id"].dataType
    typed = lambda *fields: T.StructType([T.StructField(n, t) for n, t in fields])
    hashes = work.save(texts.select("text").mapInArrow(_hasher(least_points), "n long, hashes binary"), "hashes")
    filter_sent, bits = twice_filter(hashes, work, most_bits, range_bits=range_bits)
    counted = texts.mapInArrow(_counter(filter_sent, bits, least_points, least_docs), typed(("digest", T.BinaryType()), ("hash", T.LongType()), ("ids", T.ArrayType(kind)), ("keeper", kind)))
    # ids counted once each per line, dealt by line and id first: a line of a third of all rows has a few rows a batch here
    holders = counted.select("digest", "hash", "keeper", F.explode("ids").alias("id")).groupBy("digest", "id").agg(F.min("hash").alias("hash"), F.max("keeper").alias("keeper"))
    lines = holders.groupBy("digest").agg(F.min("hash").alias("hash"), F.max("keeper").alias("keeper"), F.count("*").alias("n"))
    confirmed = work.save(lines.where(F.col("n") >= least_docs).select("digest", "hash", "keeper"), "confirmed")
    work.drop("hashes")

    others = base.columns[2:]
    if confirmed.count() <= sent_rows:
        rows = confirmed.toPandas()
        order = np.argsort(rows["hash"].to_numpy(np.int64).view(np.uint64), kind="stable")
        rows = rows.iloc[order]
        sent = spark.sparkContext.broadcast((rows["hash"].to_numpy(np.int64).tobytes(), b"".join(bytes(x) for x in rows["digest"]), rows["keeper"].tolist()))
        work.drop("confirmed")
        ready = base.select("id", "text", F.lit(None).cast("array<binary>").alias("gone"), *others)
    else:
        sent = None
        lists = texts.mapInArrow(_lister(filter_sent, bits, least_points), typed(("id", kind), ("digest", T.BinaryType())))
        lists = lookup(lists, confirmed.select("digest", "keeper", F.lit((1 << SALTS) - 1).alias("salts")), "digest", "id").where(~F.col("id").eqNullSafe(F.col("keeper"))).groupBy(F.col("id").alias("of")).agg(F.collect_set("digest").alias("gone"))
        ready = base.join(lists, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "text", "gone", *others)
    schema = T.StructType([*typed(("id", kind), ("text", T.StringType()), ("n_lines", T.LongType()), ("n_dropped", T.LongType())).fields, *base.schema.fields[2:]])
    out = ready.mapInArrow(_dropper(sent, least_points), schema)
    return out.select(F.col("id").alias(id_col), F.col("text").alias(text_col), "n_lines", "n_dropped", *given_back(carry, (id_col, text_col, "n_lines", "n_dropped")))
