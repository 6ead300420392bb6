"""A corpus pipeline of the training-data operators: five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a table that is written and
read again as the next stage's docs.  All but the last return the columns of
``documents``; the last adds the draw of the mix.  Toxicity and the mix can't be
expressed in SQL together with the near-duplicate classes, so the whole is tested
against brute-force versions of its stages.

Results for odd input: null and empty texts are clean, lose no line and have no
near-duplicate, so they reach the mix; a very long text is read whole by every
stage; rows that repeat an id go and stay together; of equal documents the one of
least id stays, of lines that repeat those of the largest id; a row whose id is
null can't name a class and stays unless its text is toxic or contaminated; further
columns, whatever their names, go through every stage unchanged, but that
``n_chars``, where there is one, follows a text that lost lines, and ``copy``,
``n_copies`` and ``shuffle_key`` are those of the mix; an empty table gives an empty
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.decontaminate import contaminated, find_contamination
from tessera.llm.linededup import dedup_lines
from tessera.llm.minhash import near_duplicates
from tessera.llm.mixing import mix
from tessera.llm.registry import TOXIC_FROM
from tessera.llm.toxicity import CATEGORIES, fit_chain, low_quality_and_toxic, score
from tessera.llm.workspace import Workspace, column, read

_OWN = ("doc_id", "text")


def _apart(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """``docs`` with its further columns under names that no operator uses, and these names."""
    names = [c if c in _OWN else f"kept_{i}" for i, c in enumerate(docs.columns)]
    return docs.toDF(*names), [n for n in names if n not in _OWN]


def _back(found: DataFrame, docs: DataFrame) -> DataFrame:
    return found.select(*_apart(docs)[0].columns).toDF(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain calls toxic go."""
    own, others = _apart(docs)
    chain = fit_chain(own, low_quality_and_toxic(read(spark, sf_dir, "labels")), CATEGORIES)
    return _back(score(own, chain, CATEGORIES, carry=others).where(F.col("p_toxic") < TOXIC_FROM), docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long lines of five documents stay in one; ``n_chars`` follows the text. A text that loses nothing stays as it is."""
    own, others = _apart(docs)
    kept = dedup_lines(own, carry=others)
    if "n_chars" in docs.columns:
        name = own.columns[docs.columns.index("n_chars")]
        kept = kept.withColumn(name, F.when(F.col("n_dropped") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col(name)))
    return _back(kept, docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of 5-word shingles at Jaccard 0.8 stays."""
    gone = near_duplicates(docs, width=5, percent=80).where("not kept").select(F.col("doc_id").alias("gone_id")).distinct()
    return docs.join(gone, column("doc_id") == F.col("gone_id"), "left_anti")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which benchmark windows cover a twentieth of the words go."""
    own, others = _apart(docs)
    found = find_contamination(own, read(spark, sf_dir, "benchmark"), carry=others)
    return _back(found.where(~contaminated()), docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources weigh as the square root of their size; rows are repeated and shuffled."""
    return mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_contaminated),
    ("mixing sources to target weights", mix_sources),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    work = Workspace(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = work.save(stage(spark, docs, sf_dir), f"stage-{k}")
        if k:
            work.drop(f"stage-{k - 1}")
    return STAGES[-1][1](spark, docs, sf_dir)
