"""Where operators keep tables and files between jobs: always the folder that the whole cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Rows and bytes of one Arrow batch handed to Python; texts may be long, so batches are kept small.
ARROW_ROWS, ARROW_BYTES = 500, 32 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a fresh local one only in local mode, where it is unset in tests."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="wardline-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/wardline"


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def staged(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Writes df once to the shared folder and reads it again: lineage is cut, work with side effects runs
    once, a lost executor loses nothing, and Spark knows the size when it plans joins over it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def carried(docs: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """work(docs), with columns whose names begin as the operators' own do renamed for its time."""
    away: dict[str, str] = {}
    for c in docs.columns:
        if c.startswith("__"):
            name = f"carried_{len(away)}_{c.strip('_')}"
            while name in docs.columns:
                name += "_"
            away[c] = name
    out = work(docs.withColumnsRenamed(away))
    return out.withColumnsRenamed({name: c for c, name in away.items()})


def small_batches(spark: SparkSession) -> None:
    """Bounds the rows and bytes of an Arrow batch, so that Python workers hold a few long texts at most. Plans are lazy, so
    the bounds stay in the session; lower ones of the caller's are kept."""
    for name, bound in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        key = f"spark.sql.execution.arrow.{name}"
        if not 0 < int(spark.conf.get(key).removesuffix("b")) <= bound:
            spark.conf.set(key, str(bound))


def spread(spark: SparkSession) -> int:
    """Partitions for work that weighs more than its rows: never merged by their few bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


def clear(spark: SparkSession) -> None:
    """Deletes all that operators have staged or written; call it once their results have been written elsewhere."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
