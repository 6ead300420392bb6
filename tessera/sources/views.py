"""Relations as views, so that any SQL can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame


def register_views(prefix: str = "", **relations: DataFrame) -> list[str]:
    """Temporary views by name, ``prefix`` before each; the names."""
    for name, relation in relations.items():
        relation.createOrReplaceTempView(prefix + name)
    return [prefix + name for name in relations]
