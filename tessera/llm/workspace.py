"""Written intermediate tables in the folder that the cluster shares, and carried columns.

Lineage is cut by writing a table, never by a local checkpoint: a lost
executor takes nothing with it that a retry would need.

Columns that an operator carries travel under names of their own, so a table's
column may be called like one of the result: it is given back with ``_in`` added.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only where that is unset in a local session (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


class Workspace:
    """Parquet tables of one run, under a fresh folder of the shared directory."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, hadoop = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
            path.getFileSystem(hadoop).delete(path, True)

    def remove(self) -> None:
        """All tables of the run."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def column(name: str) -> Column:
    """The column of that very name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def carried(names: Sequence[str]) -> list[Column]:
    return [column(c).alias(f"carried_{i}") for i, c in enumerate(names)]


def given_back(names: Sequence[str], result: Sequence[str]) -> list[Column]:
    """Carried columns under their names; ``result``: the names that the operator's own columns take."""
    taken = {c.lower() for c in result}
    found = []
    for i, c in enumerate(names):
        name = c
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        found.append(F.col(f"carried_{i}").alias(name))
    return found


#: Parts into which the rows of one key are dealt in a lookup.
SALTS = 8


def _salt(spread: str) -> str:
    return f"cast(pmod(xxhash64({spread}), {SALTS}) as int)"


def salts(spread: str) -> Column:
    """Aggregate for ``lookup``: which parts the rows of a group are dealt into."""
    return F.expr(f"bit_or(shiftleft(1, {_salt(spread)}))").alias("salts")


def lookup(rows: DataFrame, table: DataFrame, key: str, spread: str, how: str = "inner") -> DataFrame:
    """``rows`` with what ``table`` (a row per key, aggregated from these rows, with ``salts(spread)``) says of their key.

    The rows of a hot key are dealt over ``SALTS`` partitions; of the table, each part gets the keys that it has.
    """
    parts = table.withColumn("salt", F.expr(f"explode(filter(sequence(0, {SALTS - 1}), k -> (shiftright(salts, k) & 1) = 1))")).drop("salts")
    return rows.withColumn("salt", F.expr(_salt(spread))).join(parts, [key, "salt"], how).drop("salt")
