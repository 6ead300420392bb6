"""Document layouts derived from the benchmark tables, at any scale.

Expressions are written so that other SQL engines read them too: the correctness
queries lay out the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOC = "CAST(floor({k} / 30.0) AS BIGINT)"

ITEMS = (
    f"{DOC.format(k='l_orderkey')} AS doc_id",
    "CAST(row_number() OVER (PARTITION BY floor(l_orderkey / 30.0) ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) - 1 AS INT) AS item_idx",
    "CAST(l_linenumber % 2 + 1 AS INT) AS page",
    "concat(l_returnflag, l_linestatus, ' ', CAST(l_partkey AS STRING)) AS text",
    "CAST((l_partkey * 7) % 560 AS DOUBLE) AS x",
    "CAST((l_orderkey * 13 + l_suppkey * 5) % 760 AS DOUBLE) AS y",
    "10 + l_quantity AS w",
    "CAST(8 + l_linenumber % 5 AS DOUBLE) AS h",
    "CASE WHEN l_partkey % 3 = 0 THEN 'Arial-BoldMT' WHEN l_partkey % 3 = 1 THEN 'Times-Italic' ELSE 'Helvetica' END AS font_name",
    "8 + l_quantity % 7 AS font_size",
)
BLOCKS = (
    f"{DOC.format(k='o_orderkey')} AS doc_id",
    "CAST(o_orderkey % 30 AS INT) AS block_idx",
    "CAST(o_orderkey % 2 + 1 AS INT) AS page",
    "CAST((o_custkey * 11) % 400 AS DOUBLE) AS x",
    "CAST((o_orderkey * 37) % 700 AS DOUBLE) AS y",
    "CAST(60 + (o_custkey * 3) % 300 AS DOUBLE) AS w",
    "CAST(30 + (o_orderkey * 7) % 200 AS DOUBLE) AS h",
    "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'section_header' WHEN '2' THEN 'list_item' WHEN '3' THEN 'page_header' WHEN '4' THEN 'table' ELSE 'text' END AS label",
    "CASE WHEN substr(o_orderpriority, 1, 1) = '1' THEN CAST(o_orderkey % 3 + 1 AS INT) END AS heading_level",
    "CASE WHEN substr(o_orderpriority, 1, 1) = '3' THEN 'furniture' ELSE 'body' END AS content_layer",
    "concat('block ', CAST(o_orderkey AS STRING)) AS text",
)
BLOCKS_WHERE = "o_orderkey % 30 < 20"
_IDX = "(o_orderkey % 30 - 20)"
RECTS = (
    f"{DOC.format(k='o_orderkey')} AS doc_id",
    f"CAST({_IDX} AS INT) AS rect_idx",
    "CAST(o_orderkey % 2 + 1 AS INT) AS page",
    f"CASE WHEN {_IDX} < 2 THEN CAST(20 AS DOUBLE) ELSE CAST((o_custkey * 17) % 420 AS DOUBLE) END AS x",
    f"CASE WHEN {_IDX} < 2 THEN CAST(20 AS DOUBLE) ELSE CAST((o_orderkey * 29) % 600 AS DOUBLE) END AS y",
    f"CASE WHEN {_IDX} < 2 THEN CAST(560 AS DOUBLE) WHEN {_IDX} >= 8 THEN CAST(6 + o_custkey % 14 AS DOUBLE) ELSE CAST(80 + (o_custkey * 5) % 200 AS DOUBLE) END AS w",
    f"CASE WHEN {_IDX} < 2 THEN CAST(740 AS DOUBLE) WHEN {_IDX} >= 8 THEN CAST(6 + o_custkey % 14 AS DOUBLE) ELSE CAST(40 + (o_orderkey * 3) % 160 AS DOUBLE) END AS h",
    f"concat('p', CAST(o_orderkey % 2 + 1 AS STRING), '-r', CAST({_IDX} AS STRING)) AS rect_id",
    f"CASE WHEN {_IDX} >= 8 THEN 'checkbox' WHEN {_IDX} IN (2, 3) THEN 'table' ELSE 'box' END AS rect_type",
    f"{_IDX} >= 8 AS is_checkbox",
    "o_orderstatus = 'F' AS is_filled",
)
RECTS_WHERE = "o_orderkey % 30 >= 20"

_EURO = "replace(CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING), '.', ',')"
_DATE = "concat(lpad(CAST(day(o_orderdate) AS STRING), 2, '0'), '/', lpad(CAST(month(o_orderdate) AS STRING), 2, '0'), '/', CAST(year(o_orderdate) AS STRING))"
#: One order form of one page per order; ``item_idx`` runs from 0 to 10.
FORM = (
    "o_orderkey AS doc_id",
    "CAST(item_idx AS INT) AS item_idx",
    "1 AS page",
    f"CASE item_idx WHEN 0 THEN 'DATOS DEL PEDIDO' WHEN 1 THEN 'Fecha:' WHEN 2 THEN {_DATE} WHEN 3 THEN 'Importe:' WHEN 4 THEN concat({_EURO}, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ' €' END) WHEN 5 THEN 'Cliente:' WHEN 6 THEN c_name WHEN 7 THEN 'Estado:' WHEN 8 THEN 'F' WHEN 9 THEN 'O' ELSE 'P' END AS text",
    "CAST(CASE WHEN item_idx IN (2, 4) THEN 170 WHEN item_idx = 8 THEN 190 WHEN item_idx = 9 THEN 230 WHEN item_idx = 10 THEN 270 ELSE 110 END AS DOUBLE) AS x",
    "CAST(CASE item_idx WHEN 0 THEN 110 WHEN 1 THEN 140 WHEN 2 THEN 140 WHEN 3 THEN 160 WHEN 4 THEN 160 + o_orderkey % 3 WHEN 5 THEN 180 WHEN 6 THEN 196 ELSE 220 END AS DOUBLE) AS y",
    "CAST(CASE item_idx WHEN 0 THEN 120 WHEN 1 THEN 40 WHEN 2 THEN 60 WHEN 3 THEN 50 WHEN 4 THEN 60 WHEN 5 THEN 50 WHEN 6 THEN 90 WHEN 7 THEN 45 ELSE 8 END AS DOUBLE) AS w",
    "CAST(12 AS DOUBLE) AS h",
    "'Helvetica' AS font_name",
    "CAST(CASE WHEN item_idx = 0 THEN 14 ELSE 10 END AS DOUBLE) AS font_size",
)
FORM_WHERE = "NOT (item_idx = 3 AND o_orderkey % 7 = 0)"
FORM_RECTS = (
    "o_orderkey AS doc_id",
    "CAST(rect_idx AS INT) AS rect_idx",
    "1 AS page",
    "CAST(CASE rect_idx WHEN 0 THEN 100 WHEN 1 THEN 178 WHEN 2 THEN 218 ELSE 258 END AS DOUBLE) AS x",
    "CAST(CASE rect_idx WHEN 0 THEN 100 ELSE 221 END AS DOUBLE) AS y",
    "CAST(CASE rect_idx WHEN 0 THEN 420 ELSE 8 END AS DOUBLE) AS w",
    "CAST(CASE rect_idx WHEN 0 THEN 200 ELSE 8 END AS DOUBLE) AS h",
    "concat('p1-r', CAST(rect_idx AS STRING)) AS rect_id",
    "CASE WHEN rect_idx = 0 THEN 'box' ELSE 'checkbox' END AS rect_type",
    "rect_idx > 0 AS is_checkbox",
    "(rect_idx = 1 AND o_orderstatus = 'F') OR (rect_idx = 2 AND o_orderstatus = 'O') OR (rect_idx = 3 AND o_orderstatus = 'P') AS is_filled",
)

#: Tables of a layout as they read in another engine.
LAYOUT_SQL = {
    "items": f"SELECT {', '.join(ITEMS)} FROM lineitem",
    "blocks": f"SELECT {', '.join(BLOCKS)} FROM orders WHERE {BLOCKS_WHERE}",
    "rects": f"SELECT {', '.join(RECTS)} FROM orders WHERE {RECTS_WHERE}",
    "form": f"SELECT {', '.join(FORM)} FROM orders JOIN customer ON o_custkey = c_custkey, (SELECT unnest(range(0, 11)) AS item_idx) WHERE {FORM_WHERE}",
    "form_rects": f"SELECT {', '.join(FORM_RECTS)} FROM orders, (SELECT unnest(range(0, 4)) AS rect_idx)",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").selectExpr(*ITEMS)


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where(BLOCKS_WHERE).selectExpr(*BLOCKS)


def rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a 3 x 3 grid of equal cells in tables."""
    own = table(spark, sf_dir, "orders").where(RECTS_WHERE).selectExpr(*RECTS)
    cell = "named_struct('x', x + c * (w / 3), 'y', y + r * (h / 3), 'w', w / 3, 'h', h / 3)"
    return own.withColumn("table_grid", F.expr(f"CASE WHEN rect_type = 'table' THEN transform(sequence(0, 2), r -> transform(sequence(0, 2), c -> {cell})) END"))


def form(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    joined = orders.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.withColumn("item_idx", F.explode(F.sequence(F.lit(0), F.lit(10)))).where(FORM_WHERE).selectExpr(*FORM)


def form_rects(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.withColumn("rect_idx", F.explode(F.sequence(F.lit(0), F.lit(3)))).selectExpr(*FORM_RECTS).withColumn("table_grid", F.lit(None).cast("array<array<struct<x:double,y:double,w:double,h:double>>>"))


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text item per line of a document."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("item_idx", "text"))
    return lines.selectExpr("doc_id", "item_idx", "CAST(floor(item_idx / 40.0) AS INT) + 1 AS page", "text", "50D AS x", "CAST(40 + (item_idx % 40) * 18 AS DOUBLE) AS y", "CAST(6 * length(text) AS DOUBLE) AS w", "12D AS h", "'Helvetica' AS font_name", "CASE WHEN item_idx = 0 THEN 14D ELSE 10D END AS font_size")
