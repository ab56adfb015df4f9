"""Cutting lineage: a plan that is used several times is worked out once and kept where the whole cluster reads it."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, written to the folder that ``spark.checkpoint.dir`` names; a fresh local one only in local mode, where it is unset in
    tests."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            base = tempfile.mkdtemp(prefix="wardline-")
        spark.sparkContext.setCheckpointDir(base)
    return df.checkpoint()
