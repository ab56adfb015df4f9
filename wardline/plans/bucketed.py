"""Publication without shuffling the live table: it is kept in buckets of its key, sorted, and so is what a run has staged.

``published`` joins bucket to bucket and retires what disappeared in the same pass: the scanned keys, canonical building identifiers of
seven digits, make a bitmap of KEY_SPACE bits at most, 1.2 MB, so they are broadcast whatever their number. What comes out is dealt as
the live table was, and is written so: a task writes its own bucket. No row of the live table is ever exchanged.
"""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.functions.identifiers import BUILDING_DIGITS
from wardline.operators import audit
from wardline.plans import publish

KEY_SPACE = 10**BUILDING_DIGITS
KEY = "source_id"


def write(df: DataFrame, path: str, buckets: int, *, dealt: bool = False) -> None:
    """dealt: df has a partition for each bucket already, as what ``published`` gives."""
    name = f"bucketed_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(buckets, KEY)
    rows.write.bucketBy(buckets, KEY).sortBy(KEY).option("path", path).format("parquet").saveAsTable(name)
    df.sparkSession.sql(f"DROP TABLE {name}")  # the files stay: the table is external


def read(spark: SparkSession, path: str, schema: str, buckets: int) -> DataFrame:
    """The files as a bucketed table; its definition lives in the session's catalogue alone."""
    name = f"bucketed_{uuid.uuid5(uuid.NAMESPACE_URL, path).hex}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema}) USING parquet CLUSTERED BY ({KEY}) SORTED BY ({KEY}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def bitmaps(scope: DataFrame) -> DataFrame:
    """(bucket, bits) of the scanned keys: KEY_SPACE / 32,768 rows of 4 kB at most."""
    number = F.col("scan_key").try_cast("long")
    return audit.key_bitmaps(scope, F.when((number >= 0) & (number < KEY_SPACE), number))


def _is_set(bits: Column, number: Column) -> Column:
    at = F.bitmap_bit_position(number)
    byte = F.conv(F.hex(F.substring(bits, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))


def published(live: DataFrame, staged: DataFrame, scanned: DataFrame, run_id: str, at: dt.datetime | Column | None = None) -> DataFrame:
    """As ``publish.promote`` and ``publish.reconcile`` in one pass. live, staged: in as many buckets as each other; scanned: bitmaps
    of the run's scope, written."""
    rows = publish.promote(live, staged, run_id, at, null_keys=False)
    number = F.col("scan_key").try_cast("long")
    joined = rows.withColumn("__bucket", F.bitmap_bucket_number(number)).join(F.broadcast(scanned.select(F.col("bucket").alias("__bucket"), F.col("bits").alias("__bits"))), "__bucket", "left")
    gone = _is_set(F.col("__bits"), number) & F.col("is_current") & ~F.col("last_run_id").eqNullSafe(F.lit(run_id))
    return joined.withColumn("is_current", F.when(gone, F.lit(False)).otherwise(F.col("is_current"))).select(*live.columns)
