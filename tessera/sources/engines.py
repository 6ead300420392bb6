"""Sources of the three relations: adapters over document engines, and pages of HTML.

An engine is a function from a document's bytes to rows; it runs in
``mapInPandas`` over a binary-file scan, one document at a time, and imports its
library there.  What follows (first place of a block, cell texts, classes of
rectangles, grids) is done on its rows by built-in functions.  Parsers of PDF are
not part of this repository.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.geometry import from_edges
from tessera.operators import rects as classify

TEXT_ITEMS = "doc_id long, item_idx int, page int, text string, x double, y double, w double, h double, font_name string, font_size double"
BLOCKS = "doc_id long, block_idx int, page int, x double, y double, w double, h double, label string, heading_level int, content_layer string, text string"
_CELL = "struct<x:double,y:double,w:double,h:double>"
RECTS = f"doc_id long, rect_idx int, page int, x double, y double, w double, h double, rect_id string, rect_type string, is_checkbox boolean, is_filled boolean, table_grid array<array<{_CELL}>>"

Engine = Callable[[bytes], Iterable[dict]]


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, content): the id is a hash of the path."""
    return spark.read.format("binaryFile").load(path).select(F.xxhash64("path").alias("doc_id"), "path", "content")


def scan(documents: DataFrame, engine: Engine, schema: str) -> DataFrame:
    """Rows of an engine over (doc_id, content)."""
    names = [c.strip().split(" ")[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, content in zip(batch["doc_id"], batch["content"], strict=True):
                rows = [r | {"doc_id": doc} for r in engine(bytes(content))]
                yield pd.DataFrame(rows, columns=names)

    return documents.select("doc_id", "content").mapInPandas(run, schema)


def clean_items(items: DataFrame) -> DataFrame:
    """A font size of 0 is unknown."""
    return items.withColumn("font_size", F.when(F.col("font_size") != 0, F.col("font_size")))


#: Layers of a document that have blocks; the label that has a level, and the one that has cells.
LAYERS, LEVELLED, TABULAR = ("body", "furniture"), "section_header", "table"


def cell_texts(grid: Column) -> Column:
    """S3: a row x column matrix of texts of cells (structs with ``text``); a missing text is empty, no rows are no matrix."""
    return F.when(F.size(grid) > 0, F.transform(grid, lambda row: F.transform(F.coalesce(row, F.array().cast("array<struct<text:string>>")), lambda c: F.coalesce(c["text"], F.lit("")))))


def blocks_of(raw: DataFrame, pages: DataFrame) -> DataFrame:
    """Blocks of what a semantic engine gives, (doc_id, seq, layer, label, level, text, prov, grid) in reading order.

    ``prov``: where it stands, structs (page, l, t, r, b, origin 'top' or 'bottom'), of which the first counts; ``pages``
    (doc_id, page, height).  What stands nowhere or on a page without a height is no block, nor is another layer.
    """
    first = raw.where(F.col("layer").isin(*LAYERS) & (F.size("prov") > 0)).withColumn("p", F.col("prov")[0])
    placed = first.withColumn("page", F.col("p.page")).join(pages.where("height is not null").select("doc_id", "page", "height"), ["doc_id", "page"])
    from_top = lambda y: F.when(F.col("p.origin") == "bottom", F.col("height") - y).otherwise(y)
    boxed = placed.withColumn("u", from_edges(F.col("p.l"), from_top(F.col("p.t")), F.col("p.r"), from_top(F.col("p.b"))))
    order = Window.partitionBy("doc_id").orderBy("seq")
    return boxed.select(
        "doc_id", (F.row_number().over(order) - 1).cast("int").alias("block_idx"), "page", "u.*", "label", F.when(F.col("label") == LEVELLED, F.col("level")).alias("heading_level"),
        F.col("layer").alias("content_layer"), F.coalesce("text", F.lit("")).alias("text"), F.when(F.col("label") == TABULAR, cell_texts(F.col("grid"))).alias("cells"),
    )


def rects_of(raw: DataFrame, tables: DataFrame) -> DataFrame:
    """Rectangles of what a vector engine gives; per page the tables first, then the raw rectangles by class.

    ``raw``: (doc_id, page, seq, x0, top, x1, bottom, fill, non_stroking, page_height); ``tables``: (doc_id, page, seq,
    x0, top, x1, bottom, grid of cell boxes, texts), both with null cells; a checkbox without a colour is filled by what lies in it.
    """
    edges = [(F.col("x1") - F.col("x0")).alias("w"), (F.col("bottom") - F.col("top")).alias("h")]
    own = raw.select("doc_id", "page", F.col("seq").alias("rect_idx"), F.col("x0").alias("x"), F.col("top").alias("y"), *edges, "page_height", classify.looks_filled(F.col("fill"), F.col("non_stroking")).alias("coloured"))
    own = own.withColumn("rect_type", classify.rect_type(F.col("w"), F.col("h"), F.col("y"), F.col("page_height")))
    inner = classify.filled_by_overlap(own.where("rect_type = 'checkbox' and not coloured"), own)
    own = own.join(inner, ["doc_id", "page", "rect_idx"], "left").withColumn("is_filled", F.col("coloured") | F.coalesce("filled", F.lit(False)))
    rows = F.filter(classify.clean_grid(F.col("grid")), lambda row: F.size(row) > 0)
    kind = f"array<array<{_CELL}>>"
    named = lambda mark: F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(mark), F.col("rect_idx").cast("string")).alias("rect_id")
    gridded = tables.withColumn("rect_idx", F.col("seq")).select(
        "doc_id", "page", "rect_idx", F.lit(0).alias("part"), F.col("x0").alias("x"), F.col("top").alias("y"), *edges, named("-t"), F.lit("table").alias("rect_type"), F.lit(False).alias("is_filled"),
        F.when(F.size(rows) > 0, rows).cast(kind).alias("table_grid"), F.when(F.size("texts") > 0, classify.clean_texts(F.col("texts"))).alias("cells"),
    )
    plain = own.select("doc_id", "page", "rect_idx", F.lit(1).alias("part"), "x", "y", "w", "h", named("-r"), "rect_type", "is_filled", F.lit(None).cast(kind).alias("table_grid"), F.lit(None).cast("array<array<string>>").alias("cells"))
    order = Window.partitionBy("doc_id").orderBy("page", "part", "rect_idx")
    every = gridded.unionByName(plain).withColumn("rect_idx", (F.row_number().over(order) - 1).cast("int"))
    return every.withColumn("is_checkbox", F.col("rect_type") == "checkbox").drop("part")


#: Block labels of tags; other text of a page is no block.
TAG_LABELS = (("h1", "title"), ("p", "text"), ("li", "list_item"), ("nav", "page_header"), ("footer", "page_footer"))


def html_blocks(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Blocks of the pages' titles, paragraphs, list items, menus and footers, 20 points apart, by built-in functions.

    A block goes from its tag to the next tag of a block, opening or closing.
    """
    tags = "|".join(t for t, _ in TAG_LABELS)
    bare = F.regexp_replace(F.coalesce(html_col, F.lit("")), r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<!--.*?-->", "")
    marked = F.regexp_replace(F.regexp_replace(bare, rf"(?i)</(?:{tags})\b[^>]*>", "\x01\x02"), rf"(?i)<({tags})\b[^>]*>", "\x01$1\x02")
    pieces = F.filter(F.split(marked, "\x01"), lambda x: F.contains(x, F.lit("\x02")) & ~F.startswith(x, F.lit("\x02")))
    rows = pages.select(F.col(id_col).alias("doc_id"), F.posexplode(pieces).alias("block_idx", "piece"))
    tag = F.lower(F.substring_index("piece", "\x02", 1))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.substring_index("piece", "\x02", -1), r"<[^>]*>", " "), r"\s+", " "))
    label = F.create_map(*(F.lit(x) for p in TAG_LABELS for x in p))[tag]
    return rows.select("doc_id", "block_idx", F.lit(1).alias("page"), F.lit(50.0).alias("x"), (F.col("block_idx") * 20.0).alias("y"), (F.length(text) * 6.0).alias("w"), F.lit(16.0).alias("h"), label.alias("label"), text.alias("text")).where("text <> ''")
