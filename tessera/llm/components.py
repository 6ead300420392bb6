"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.workspace import Workspace, lookup, salts


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node hands the least of its neighbourhood to its greater neighbours."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), salts("v"))
    return lookup(both.where("v > u"), least, "u", "v").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node hands the least of its smaller neighbours to them and to itself."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("m"), salts("v"))
    moved = lookup(down, least, "u", "v").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return row["n"], row["x"]


def connected_components(edges: DataFrame, work: Workspace, label: str, most: int = 60) -> DataFrame:
    """``edges(u, v)`` of long ids to ``(id, component)``, component = least id reachable.

    Self-loops and null ends are ignored; nodes without an edge don't occur in the result.
    Each round is a written table; the loop ends when a round changes nothing.
    """
    now = work.save(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-0")
    before, name = _state(now), f"{label}-0"
    for k in range(1, most):
        after_name = f"{label}-{k}"
        after = work.save(_small_star(_large_star(now)), after_name)
        state = _state(after)
        work.drop(name)
        now, name = after, after_name
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("connected components did not settle")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
