"""Relations that several later joins read are written once, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def staged(relation: DataFrame, label: str) -> DataFrame:
    """``relation`` as a Parquet table under ``spark.checkpoint.dir`` (a temporary folder only where that is unset in a local session)."""
    spark = relation.sparkSession
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
        spark.conf.set("spark.checkpoint.dir", shared)
    path = f"{shared.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"
    relation.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(relation.schema).parquet(path)
