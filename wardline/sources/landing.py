"""Landing of JSON rows: everything that can be identified is kept as it came, and parsed into a candidate or an error."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.functions import identifiers as ids
from wardline.functions import json_fields as jf
from wardline.functions import parsing

#: The source's field names.
SOURCE_ID, ROW_ID, UPDATED, KEY = "isn_dob_bis_extract", ":id", ":updated_at", "bin"
NUMBER, ISSUED, STATUS, BALANCE = "ecb_violation_number", "issue_date", "ecb_violation_status", "balance_due"

CANDIDATE = ["source_id", "row_id", "scan_key", "number", "issue_date", "status", "balance_due", "updated_at"]
PARSED = "payload string, source_id string, row_id string, updated_text string, scan_key string, number string, issue_date date, status string, balance_due decimal(15,2), updated_at timestamp, error string"


def read(spark, path: str) -> DataFrame:
    """Lines of JSON texts under a folder, unparsed: schema and errors are this module's, not the reader's."""
    return spark.read.text(path, pathGlobFilter="*.json*").withColumnRenamed("value", "payload")


def parsed(rows: DataFrame, *carried: str) -> DataFrame:
    """rows: (payload) and what is carried. Typed columns, and the first error of each row; raw columns are there even for
    bad rows."""
    m = rows.select(*carried, "payload", jf.fields(F.col("payload")).alias("m"))
    f = lambda name: jf.required_text(F.col("m"), name)
    quoted = jf.is_text(F.col("payload"), ISSUED)
    p = m.select(
        *carried, "payload", f(SOURCE_ID).alias("source_id"), f(ROW_ID).alias("row_id"), f(UPDATED).alias("updated_text"),
        ids.canonical_building(jf.field(F.col("m"), KEY)).alias("scan_key"), f(NUMBER).alias("number"), f(STATUS).alias("status"),
        parsing.parse_issue_date(jf.field(F.col("m"), ISSUED), quoted).alias("issued"),
        parsing.parse_amount(jf.field(F.col("m"), BALANCE)).alias("balance"),
        parsing.parse_source_time(jf.field(F.col("m"), UPDATED)).alias("updated"), F.col("m").isNull().alias("no_object"),
    )
    error = F.coalesce(
        F.when(F.col("no_object"), F.lit("NOT_AN_OBJECT")),
        *(F.when(F.col(c).isNull(), F.lit(f"MISSING_{c.upper()}")) for c in ("source_id", "row_id")),
        F.when(F.col("scan_key").isNull(), F.lit("INVALID_KEY")),
        *(F.when(F.col(c)["error"].isNotNull(), F.concat(F.lit(f"{c.upper()}:"), F.col(c)["error"])) for c in ("issued", "balance", "updated")),
    )
    return p.select(*carried, "payload", "source_id", "row_id", "updated_text", "scan_key", "number", F.col("issued.value").alias("issue_date"), "status", F.col("balance.value").alias("balance_due"), F.col("updated.value").alias("updated_at"), error.alias("error"))
