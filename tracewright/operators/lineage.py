"""Cutting lineage where a loop would let plans grow."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df by a reliable checkpoint below spark.checkpoint.dir, which all executors share; a local session may do without the setting."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="tracewright-"))
    return df.checkpoint()
