"""Incremental landing: a stream over folders of JSON rows that keeps raw versions and candidates up to date.

Run with ``availableNow`` by a scheduler: each start takes what has arrived and stops. A micro-batch writes folders named
by its id and overwrites them if it is replayed, so every file lands once; readers take the first of raw versions and
the last of candidates by key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.operators.merge import first_wins, last_wins
from wardline.sources import landing

KEYS = ["source_id", "updated_text"]


def land(spark: SparkSession, incoming: str, out: str, *, files_per_batch: int = 1000) -> int:
    """Lands all that has arrived since the last call; returns the number of micro-batches."""
    rows = spark.readStream.option("maxFilesPerTrigger", files_per_batch).schema("value string").text(incoming).withColumnRenamed("value", "payload")

    def write(batch: DataFrame, number: int) -> None:
        parsed = landing.parsed(batch).withColumn("batch_id", F.lit(number))
        parsed.write.mode("overwrite").parquet(f"{out}/rows/batch_id={number}")

    query = rows.writeStream.foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return len(query.recentProgress)


def landed(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(f"{landing.PARSED}, batch_id long").parquet(f"{out}/rows")


def raw_versions(spark: SparkSession, out: str) -> DataFrame:
    """The first row that came for each version of a source row; bad rows included if they can be identified."""
    rows = landed(spark, out).where(F.col("source_id").isNotNull() & F.col("updated_text").isNotNull())
    return first_wins(rows, KEYS, ["batch_id", "payload"]).select(*KEYS, "payload")


def candidates(spark: SparkSession, out: str) -> DataFrame:
    """The last good row that came for each source row."""
    return last_wins(landed(spark, out).where(F.col("error").isNull()), ["source_id"], ["batch_id", "updated_at", "payload"]).select(*landing.CANDIDATE)
