"""Every registered query of the library itself against its SQL; without SQL it must at least give rows."""

from __future__ import annotations

import pytest

from tessera.plans import layout_queries, value_queries  # noqa: F401
from tessera.plans.catalog import QUERIES, SQL
from tests.oracle import assert_same, connect

@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf_dir, con):
    df = QUERIES[name](spark, sf_dir)
    if name in SQL:
        assert_same(df, con, SQL[name])
    assert not df.isEmpty()


def test_entry(spark, sf_dir):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert df.count() == 6000 and "match_method" in df.columns
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_does_not_need_the_training_data_operators():
    import ast
    import pathlib

    root = pathlib.Path(layout_queries.__file__).parents[1]
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            for node in ast.walk(ast.parse(path.read_text())):
                names = [node.module or ""] if isinstance(node, ast.ImportFrom) else [a.name for a in node.names] if isinstance(node, ast.Import) else []
                assert not any(n.startswith("tessera.llm") for n in names), path
