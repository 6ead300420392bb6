"""MinHash near-duplicate classes over word shingles, confirmed on the full sets.

1. One pass over the texts: set size, a 128-bit key of the whole set, many
   universal-hash minima as one byte each, and one key per band of minima.
2. Equal sets collapse to their least id before anything is paired.
3. Members of a band's bucket are compared with leaders, never with each other:
   first every document with the most central leader of all its buckets (central:
   with many neighbours over all its buckets).
4. What buckets with several components still connect is a family; its members
   outside its largest component meet the whole family twice, in tiles of bounded
   size: first as signatures, which tell the members that share a bucket and
   enough minima with one of another component; then these alone as texts, each
   tile a matrix product in one task that gives back links only.  So every pair
   of a bucket is met unless already connected, and no step emits the pairs of a
   group.
5. A pair goes on if its minima agree often enough, and becomes a link if the
   Jaccard similarity of the full sets reaches the threshold.
6. Components by alternating large-star and small-star.

Results for odd input: null or wordless text has an empty set and is linked with
nothing; a text of fewer words than a shingle is one shingle; a very long text is
read whole; ids may be of any type that has an order (others than whole numbers go
by their rank, which is written once); repeated rows of an id are one document; a
row whose id is null takes part as a text but can't name a component; of equally
central leaders the least id leads, which changes no class; an empty table gives
an empty table.  Only ``id_col`` and ``text_col`` are read, so further columns may
have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm import textarrays as ta
from tessera.llm.components import connected_components
from tessera.llm.workspace import Workspace, column, lookup, salts

BANDS, ROWS = 40, 5
#: Links per verification task: how many texts meet a leader's text in one group.
MEET = 64
#: Signatures that meet a leader's signature in one group.
SIGNED = 4096
#: Signatures in a tile: still unsettled, of the whole family; pairs that it compares at once.
OPEN_SIGNED, FAMILY_SIGNED, COMPARED = 4096, 16384, 1 << 16
#: Documents in a tile of texts, likewise; shingles in a block of its matrix product.
OPEN_BLOCK, FAMILY_BLOCK, COLUMNS = 256, 768, 4096
#: Shingles that make a document of a tile count as a further one.
HEAVY = 2000

_SIGNED = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
    T.StructField("minima", T.BinaryType()), T.StructField("bands", T.ArrayType(T.LongType())),
])


def _family(n: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(7919))
    return rng.integers(1, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, n, dtype=np.uint64)


def shingle_sets(run: ta.Run, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each row, sorted, one row after the other, and where each row begins."""
    hashed, row = ta.windows(ta.words(run, ta.BLANKS), width)
    cut = np.searchsorted(row, np.arange(run.rows + 1))
    own = [np.unique(hashed[a:b]) for a, b in zip(cut[:-1], cut[1:], strict=True)]
    return (np.concatenate(own) if own else np.zeros(0, np.uint64)), np.concatenate(([0], np.cumsum([len(x) for x in own]))).astype(np.int64)


def _signer(width: int, bands: int, rows: int):
    scale, shift = _family(bands * rows)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            for run in ta.runs(batch.column(1)):
                values, begin = shingle_sets(run, width)
                size = np.diff(begin)
                full = np.flatnonzero(size)
                minima = np.zeros((len(full), bands * rows), np.uint32)
                keys = np.zeros((run.rows, 2), np.uint64)
                if len(full):
                    at = begin[:-1][full]
                    with np.errstate(over="ignore"):
                        for j in range(bands * rows):
                            minima[:, j] = np.minimum.reduceat((values * scale[j] + shift[j]) >> np.uint64(32), at)
                        keys[full, 0] = ta.mixed(np.add.reduceat(values, at))
                        keys[full, 1] = ta.mixed(np.add.reduceat(ta.mixed(values ^ scale[0]), at) + size[full].astype(np.uint64))
                        band = np.zeros((len(full), bands), np.uint64)
                        for r in range(rows):
                            band = ta.mixed(band * np.uint64(31) + minima[:, r::rows].astype(np.uint64) + np.uint64(1))
                        band = ta.mixed(band + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                place = np.full(run.rows, -1)
                place[full] = np.arange(len(full))
                short = minima.astype(np.uint8)
                yield pa.RecordBatch.from_arrays([
                    ids.slice(run.first, run.rows), pa.array(size, pa.int64()),
                    pa.array([keys[i].tobytes() if place[i] >= 0 else None for i in range(run.rows)], pa.binary()),
                    pa.array([short[p].tobytes() if p >= 0 else None for p in place], pa.binary()),
                    pa.array([band[p].view(np.int64) if p >= 0 else None for p in place], pa.list_(pa.int64())),
                ], ["id", "n_shingles", "set_key", "minima", "bands"])

    return sign


@F.pandas_udf(T.DoubleType())
def _agreement(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of equal minima."""
    return pd.Series([float(np.mean(np.frombuffer(x, np.uint8) == np.frombuffer(y, np.uint8))) for x, y in zip(a, b, strict=True)], dtype="float64")


def _confirmer(width: int, percent: int):
    def confirm(table: pa.Table) -> pa.Table:
        """Of one leader and some others, with texts: the others that reach the threshold with it."""
        led = np.asarray(table.column("led").combine_chunks())
        ids = np.asarray(table.column("id").combine_chunks())
        lead, sets = [], []
        for run in ta.runs(table.column("text")):
            values, begin = shingle_sets(run, width)
            sets += [values[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)]
        lead = [sets[i] for i in np.flatnonzero(led)]
        name = table.column("leader")[0].as_py()
        hits = set()
        for i in np.flatnonzero(~led):
            for own in lead:
                if 100 * min(len(own), len(sets[i])) < percent * max(len(own), len(sets[i])):
                    continue
                common = len(np.intersect1d(own, sets[i], assume_unique=True))
                if common and 100 * common >= percent * (len(own) + len(sets[i]) - common):
                    hits.add(int(ids[i]))
        hits = sorted(hits)
        return pa.table({"u": pa.array(hits, pa.int64()), "v": pa.array([name] * len(hits), pa.int64())})

    return confirm


def _tile(width: int, percent: int):
    def tile(table: pa.Table) -> pa.Table:
        """Of one block of unsettled documents (``open``) and one block of their family: the pairs that reach the threshold.

        All intersections at once: a product of incidence matrices over the shingles that occur twice here.
        """
        sets, ids = [], np.asarray(table.column("id").combine_chunks())
        for run in ta.runs(table.column("text")):
            values, begin = shingle_sets(run, width)
            sets += [values[x:y] for x, y in zip(begin[:-1], begin[1:], strict=True)]
        size = np.array([len(x) for x in sets], np.int64)
        opened = np.asarray(table.column("open").combine_chunks().cast(pa.int8())).astype(bool)
        s, m = np.flatnonzero(opened), np.flatnonzero(~opened)
        _, which, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(sets)), size)
        twice = count > 1
        column = np.cumsum(twice) - 1
        use = twice[which]
        row, column = row[use], column[which[use]]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        place = np.zeros(len(sets), np.int64)
        place[s], place[m] = np.arange(len(s)), np.arange(len(m))
        common = np.zeros((len(s), len(m)), np.float32)
        for at in range(0, int(twice.sum()), COLUMNS):
            x, y = np.searchsorted(column, (at, at + COLUMNS))
            sides = []
            for side, n in ((True, len(s)), (False, len(m))):
                own = np.flatnonzero(opened[row[x:y]] == side) + x
                matrix = np.zeros((n, COLUMNS), np.float32)
                matrix[place[row[own]], column[own] - at] = 1
                sides.append(matrix)
            common += sides[0] @ sides[1].T
        common = common.astype(np.int64)
        links = (100 * common >= percent * (size[s][:, None] + size[m][None, :] - common)) & (common > 0)
        u, v = np.nonzero(links & (ids[s][:, None] != ids[m][None, :]))
        return pa.table({"u": pa.array(ids[s][u], pa.int64()), "v": pa.array(ids[m][v], pa.int64())})

    return tile


def _likely(least_agreement: float):
    def likely(table: pa.Table) -> pa.Table:
        """Of one block of unsettled documents (``open``) and one block of their family, as signatures: those of either
        that share a bucket with one of the other block, of another component, and agree with it often enough."""
        opened = np.asarray(table.column("open").combine_chunks().cast(pa.int8())).astype(bool)
        component = np.asarray(table.column("component").combine_chunks())
        minima = np.frombuffer(b"".join(table.column("minima").to_pylist()), np.uint8).reshape(len(opened), -1)
        sides = []
        for own in (np.flatnonzero(opened), np.flatnonzero(~opened)):
            lists = table.column("buckets").take(pa.array(own)).combine_chunks()
            size = np.diff(np.asarray(lists.offsets))
            keys, at = np.asarray(lists.flatten()), np.repeat(own, size)
            order = np.argsort(keys, kind="stable")
            sides.append((keys[order], at[order]))
        (s_keys, s_at), (m_keys, m_at) = sides
        lo, hi = np.searchsorted(m_keys, s_keys, "left"), np.searchsorted(m_keys, s_keys, "right")
        active = np.zeros(len(opened), bool)
        least = least_agreement * minima.shape[1]
        which = np.flatnonzero(hi > lo)
        cut = np.searchsorted(np.cumsum((hi - lo)[which]), np.arange(COMPARED, int((hi - lo).sum()) + COMPARED, COMPARED), "right")
        for part in np.split(which, np.unique(cut[cut < len(which)])):
            n = (hi - lo)[part]
            s = np.repeat(s_at[part], n)
            m = m_at[np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[part], n)]
            new = (component[s] != component[m]) & ~(active[s] & active[m])
            s, m = s[new], m[new]
            for at in range(0, len(s), COMPARED):
                x, y = s[at : at + COMPARED], m[at : at + COMPARED]
                agree = (minima[x] == minima[y]).sum(1) >= least
                active[x[agree]] = active[y[agree]] = True
        ids = np.asarray(table.column("id").combine_chunks())
        return pa.table({"id": pa.array(ids[active], pa.int64())})

    return likely


_blocks = lambda n, most: F.greatest(F.ceil(n / F.lit(most)).cast("int"), F.lit(1))


def _tiled(placed: DataFrame, open_block: int, family_block: int, *columns: str) -> DataFrame:
    """Members (family, component, id, weight) dealt into tiles (family, s, m): each block of those outside the largest component with each block of the family."""
    sizes = placed.groupBy("family", "component").agg(F.sum("weight").alias("n"), salts("id"))
    family = sizes.groupBy("family").agg(F.max(F.struct("n", (-F.col("component")).alias("least"))).alias("top"), F.sum("n").alias("all"), F.bit_or("salts").alias("salts"))
    family = family.select("family", "salts", (-F.col("top.least")).alias("main"), _blocks(F.col("all") - F.col("top.n"), open_block).alias("ns"), _blocks(F.col("all"), family_block).alias("nm"))
    own = lookup(placed, family, "family", "id")
    s, m = F.pmod(F.xxhash64("id"), F.col("ns")).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), F.col("nm")).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    opened = own.where("component <> main").select("family", s.alias("s"), all_of("nm").alias("m"), "id", "component", F.lit(True).alias("open"), *columns)
    return opened.unionByName(own.select("family", all_of("ns").alias("s"), m.alias("m"), "id", "component", F.lit(False).alias("open"), *columns))


def _within_families(left: DataFrame, signed: DataFrame, texts: DataFrame, work: Workspace, width: int, percent: int, least_agreement: float) -> DataFrame:
    """Links that unsettled buckets (bucket, id, component) may still hold, as (u, v).

    A family is what such buckets connect; ``signed``: (id, minima, weight).
    """
    heads = left.groupBy("bucket").agg(F.min("id").alias("head"), salts("id"))
    families = connected_components(lookup(left, heads, "bucket", "id").where("id <> head").select(F.col("id").alias("u"), F.col("head").alias("v")).distinct(), work, "families")
    own = left.groupBy("id").agg(F.first("component").alias("component"), F.collect_set("bucket").alias("buckets"))
    placed = work.save(own.join(families.withColumnRenamed("component", "family"), "id").join(signed, "id"), "families-placed")
    tiles = _tiled(placed.withColumn("weight", F.lit(1)), OPEN_SIGNED, FAMILY_SIGNED, "minima", "buckets")
    active = work.save(tiles.groupBy("family", "s", "m").applyInArrow(_likely(least_agreement), "id long").distinct(), "active")
    # a long document counts for several
    tiles = _tiled(placed.join(active, "id").select("family", "component", "id", "weight"), OPEN_BLOCK, FAMILY_BLOCK).join(texts, "id")
    found = work.save(tiles.groupBy("family", "s", "m").applyInArrow(_tile(width, percent), "u long, v long"), "links-families").distinct()
    work.drop("families-placed", "active")
    return found


def near_duplicates(docs: DataFrame, *, width: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, n_shingles, component_id (least id of its class), kept (it is that id).

    ``percent``: documents are linked from this Jaccard similarity, in hundredths.
    With 40 bands of 5 minima a pair of similarity 0.8 misses every band with
    probability 1.3e-7; the agreement asked of the 200 minima lies five standard
    deviations under the threshold.
    """
    work = Workspace(docs.sparkSession, "minhash")
    base = docs.select(column(id_col).alias("id"), column(text_col).alias("text"))
    kind = base.schema["id"].dataType
    if isinstance(kind, T.IntegralType):
        found = _classes(base.withColumn("id", F.col("id").cast("long")), work, width, percent, bands, rows)
    else:
        # numbers that grow along the sorted ids
        ranked = Workspace(docs.sparkSession, "ranks").save(base.where("id is not null").select(F.col("id").alias("name")).distinct().orderBy("name").withColumn("rank", F.monotonically_increasing_id()), "ranked")
        own = base.join(ranked, F.col("id") == F.col("name"), "left").select(F.col("rank").alias("id"), "text")
        found = _classes(own, work, width, percent, bands, rows)
        named = lambda c, name: ranked.select(F.col("rank").alias(c), F.col("name").alias(name))
        found = found.join(named("id", "id_name"), "id", "left").join(named("component_id", "component_name"), "component_id", "left").select(F.col("id_name").alias("id"), "n_shingles", F.col("component_name").alias("component_id"), "kept")
    return found.select(F.col("id").cast(kind).alias(id_col), "n_shingles", F.col("component_id").cast(kind).alias("component_id"), "kept")


def _classes(texts: DataFrame, work: Workspace, width: int, percent: int, bands: int, rows: int) -> DataFrame:
    """``near_duplicates`` of (id, text) with long ids."""
    signed = work.save(texts.mapInArrow(_signer(width, bands, rows), _SIGNED), "signed")
    least_agreement = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / (bands * rows)) ** 0.5

    groups = work.save(signed.where("set_key is not null").groupBy("set_key").agg(F.min("id").alias("rep"), salts("id")), "groups")
    reps = signed.where("set_key is not null").join(groups.select(F.col("rep").alias("id"), "set_key"), ["id", "set_key"], "left_semi")
    minima = work.save(reps.groupBy("id").agg(F.min("minima").alias("minima"), F.max("n_shingles").alias("n_shingles")), "minima")
    spread = reps.select("id", F.explode("bands").alias("bucket"))
    shared = spread.groupBy("bucket").agg(F.count("*").alias("n"), salts("id")).where("n > 1")
    members = work.save(lookup(spread, shared, "bucket", "id").distinct(), "members")
    known = work.save(members.groupBy("id").agg(F.sum("n").alias("degree")), "central")

    def confirmed(pairs: DataFrame, name: str) -> DataFrame:
        """Pairs (id, leader) that are links, as (u, v)."""
        # a leader of many meets them in groups, each with its own copy of what it is compared by
        fans = lambda rows, most: rows.groupBy("leader").agg(F.ceil(F.count("*") / F.lit(most)).cast("int").alias("fan"), salts("id"))
        part = F.pmod(F.xxhash64("id"), F.col("fan")).cast("int").alias("part")
        fan = fans(pairs, SIGNED)
        spread = lookup(pairs, fan, "leader", "id").select("id", "leader", part).join(minima.select("id", F.col("minima").alias("ma")), "id")
        leaders = fan.join(minima.select(F.col("id").alias("leader"), F.col("minima").alias("mb")), "leader").select("leader", "mb", F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("part"))
        likely = work.save(spread.join(leaders, ["leader", "part"]).where(_agreement("ma", "mb") >= least_agreement).select("id", "leader"), f"likely-{name}")
        dealt = work.save(lookup(likely, fans(likely, MEET), "leader", "id").select("leader", "id", part), f"dealt-{name}")
        others = dealt.select("leader", "part", "id").join(texts, "id").select("leader", "part", "id", "text", F.lit(False).alias("led"))
        leaders = dealt.select("leader", "part").distinct().join(texts.withColumnRenamed("id", "leader"), "leader").select("leader", "part", F.col("leader").alias("id"), "text", F.lit(True).alias("led"))
        found = work.save(others.unionByName(leaders).groupBy("leader", "part").applyInArrow(_confirmer(width, percent), "u long, v long"), f"links-{name}")
        work.drop(f"likely-{name}", f"dealt-{name}")
        return found

    def unsettled(own: DataFrame, classes: DataFrame) -> DataFrame:
        """Of (bucket, id): those in buckets with more than one component, with the component."""
        placed = own.select("bucket", "id").join(classes, "id", "left").select("bucket", "id", F.coalesce("component", "id").alias("component"))
        split = placed.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), salts("id")).where("lo <> hi").select("bucket", "salts")
        return lookup(placed, split, "bucket", "id")

    # every document with the most central leader of all its buckets
    order = F.struct(F.col("degree"), (-F.col("id")).alias("least_id"))
    heads = members.select("bucket", "id").join(known, "id").groupBy("bucket").agg(F.max(order).alias("head"), salts("id"))
    first = lookup(members.select("bucket", "id"), heads, "bucket", "id").groupBy("id").agg(F.max("head").alias("head")).select("id", (-F.col("head.least_id")).alias("leader")).where("id <> leader")
    classes = connected_components(confirmed(first, "first"), work, "stars-first")

    # a head that all others of its bucket have met is done with that bucket
    seen = lookup(members.select("bucket", "id"), heads.select("bucket", (-F.col("head.least_id")).alias("head"), "salts"), "bucket", "id").join(first, "id", "left")
    met = seen.groupBy("bucket").agg(F.bool_and((F.col("id") == F.col("head")) | F.col("leader").eqNullSafe(F.col("head"))).alias("met"), salts("id"))
    own = lookup(seen, met, "bucket", "id").where("not (met and id = head)").select("bucket", "id")
    left = work.save(unsettled(own, classes), "unsettled")
    if not left.isEmpty():
        weighed = minima.select("id", "minima", (1 + F.floor(F.col("n_shingles") / HEAVY)).cast("long").alias("weight"))
        links = _within_families(left, weighed, texts, work, width, percent, least_agreement)
        old = classes.select(F.col("id").alias("u"), F.col("component").alias("v"))
        classes = connected_components(old.union(links.select("u", "v")), work, "stars-all")

    labels = groups.join(classes.withColumnRenamed("id", "rep"), "rep", "left").select("set_key", F.coalesce("component", "rep").alias("component_id"), "salts")
    out = lookup(signed.select("id", "n_shingles", "set_key"), labels, "set_key", "id", "left")
    component = F.coalesce("component_id", "id")
    found = Workspace(texts.sparkSession, "classes").save(out.select("id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept")), "classes")
    work.remove()
    return found
