"""Mixing sources to target weights by Poisson replication.

A source's rate is its target size over its own size.  Each document draws a
number of copies from the Poisson distribution of its source's rate by inversion
of a uniform number that a hash of seed and id gives; so a rerun, a retry or
another partitioning draws the same.  Documents are exploded by their counts and
sorted by a second hash over the whole corpus: that hash is uniform, so equal
ranges of it are dealt to the partitions without looking at the rows first.

A rate above ``STEP`` is the sum of several draws of at most that rate each.

Results for odd input: a text counts as at least one code point, so null and
empty texts take part, and a very long one weighs what it has; a null source is a
source of its own; sources without a weight in ``weights`` get none, so they leave
the mix; repeated rows of an id draw the same count each and stand side by side
(in no given order); a row whose id is null draws by its text; ids may be of any
type; an empty table gives an empty table.  Column names of the result that the table already has
(``copy``, ``n_copies``, ``shuffle_key``) replace the table's.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace, column

#: Rate of one draw at most, and how far its distribution is tabulated (the rest is below 1e-40).
STEP, TABLE = 16.0, 96
#: Rows of rates that may be sent to all tasks.
SENT_ROWS = 10_000
#: Code points of a partition of the mix, about.
PART_POINTS = 64 << 20


def source_rates(docs: DataFrame, *, weights: Mapping[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, source_col: str = "source", text_col: str = "text") -> DataFrame:
    """(source, points, weight, rate): weights as given, else in proportion to size to the power ``alpha``."""
    size = F.greatest(F.coalesce(F.length(column(text_col)), F.lit(0)), F.lit(1))
    sizes = Workspace(docs.sparkSession, "mix").save(docs.groupBy(column(source_col).alias("mix_source")).agg(F.sum(size).alias("points")), "sizes")
    if weights is None:
        raw = F.pow(F.col("points").cast("double"), F.lit(alpha))
    else:
        named = F.create_map(*(x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v))))) if weights else F.create_map().cast("map<string,double>")
        raw = F.coalesce(named[F.col("mix_source")], F.lit(0.0))
    total = sizes.agg(F.sum("points").alias("points"), F.sum(raw).alias("raw")).first()
    weight = raw / F.lit(total["raw"]) if total["raw"] else F.lit(0.0)
    return sizes.select("mix_source", "points", weight.alias("weight"), (weight * F.lit(total["points"]) * F.lit(epochs) / F.col("points")).alias("rate"))


def _cumulative(rate: Column) -> Column:
    """Poisson distribution function of 0, 1, 2 ... ``TABLE``."""
    start = F.struct(F.exp(-rate).alias("term"), F.array(F.exp(-rate)).alias("sums"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(TABLE)), start, lambda a, k: F.struct((a["term"] * rate / k).alias("term"), F.concat(a["sums"], F.array(F.element_at(a["sums"], -1) + a["term"] * rate / k)).alias("sums")), lambda a: a["sums"])


def uniform(*parts: Column) -> Column:
    """In [0, 1): the first 52 bits of the md5 of the parts, joined by '|'."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts).cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def mix(docs: DataFrame, *, seed: int = 1, weights: Mapping[str, float] | None = None, alpha: float = 0.5, epochs: float = 1.0, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Rows of ``docs``, each as often as drawn, in the order of ``shuffle_key``, with ``n_copies`` and ``copy`` (from 1)."""
    rates = source_rates(docs, weights=weights, alpha=alpha, epochs=epochs, source_col=source_col, text_col=text_col)
    n = rates.agg(F.count("*").alias("rows"), F.sum("points").alias("points")).first()
    draws = F.greatest(F.ceil(F.col("rate") / STEP).cast("int"), F.lit(1))
    rates = rates.withColumn("mix_draws", draws).select("mix_source", "mix_draws", _cumulative(F.col("rate") / draws).alias("mix_sums"))
    if n["rows"] <= SENT_ROWS:
        rates = F.broadcast(rates)
    kept = docs.drop("copy", "n_copies", "shuffle_key")
    joined = kept.join(rates, column(source_col).eqNullSafe(F.col("mix_source")))
    name = F.coalesce(column(id_col).cast("string"), F.concat(F.lit("null|"), F.md5(F.coalesce(column(text_col), F.lit("")).cast("binary"))))
    # each uniform number is made once, outside of the count that it is compared in
    asked = F.transform(F.sequence(F.lit(1), F.col("mix_draws")), lambda j: uniform(F.lit(f"{seed}:copies"), name, j.cast("string")))
    drawn = F.aggregate(asked, F.lit(0), lambda a, u: a + F.size(F.filter("mix_sums", lambda c: c <= u)))
    counted = joined.withColumn("n_copies", drawn.cast("long")).drop("mix_source", "mix_draws", "mix_sums")
    copies = counted.where("n_copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    key = F.md5(F.concat_ws("|", F.lit(f"{seed}:order"), name, F.col("copy").cast("string")).cast("binary"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-int(epochs * (n["points"] or 0)) // PART_POINTS))
    place = F.floor(F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("double") * F.lit(parts / 2**32)).cast("int")
    return copies.withColumn("shuffle_key", key).repartitionById(parts, place).sortWithinPartitions("shuffle_key")
