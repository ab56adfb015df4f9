"""The engine's relations over the star-schema tables, as SQL that Spark and DuckDB read alike.

Live facts include some under keys that no entity has, and versions some entities without keys. Every relation holds all rows of its
tables: what a run has not scanned or staged has another key or id there, it is not left out.
``relation(spark, sf_dir, name)`` is a DataFrame; ``with_clause()`` the same relations for DuckDB. A pair of texts is for
the one thing the two write differently: gathering keys into a batch's JSON.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from wardline.operators import snapshots

TABLES = ("customer", "events", "lineitem", "nation", "orders", "part", "pages", "supplier")
BATCH = 100

_PARCEL = "'1' || lpad(CAST(c_custkey % 700 AS STRING), 5, '0') || lpad(CAST(CASE WHEN c_custkey % 3 = 0 THEN 1001 + c_custkey % 40 ELSE c_custkey % 40 END AS STRING), 4, '0')"
_BATCHES = """SELECT 'r1' AS run_id, batch_number, CASE WHEN batch_number % 4 = 0 OR batch_number % 6 = 0 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
  CASE WHEN batch_number % 4 = 0 THEN 'UPSTREAM_TIMEOUT ' || CAST(batch_number AS STRING) WHEN batch_number % 6 = 0 THEN ' ' END AS last_error, count(*) * 3 AS rows_fetched, count(*) + batch_number % 3 AS requests, batch_number % 3 AS retries,
  CASE WHEN batch_number = 8 THEN '{{"keys":"x"}}' ELSE '{{"keys":["' || %s || '"]}}' END AS definition FROM batch_keys GROUP BY batch_number"""

RELATIONS: dict[str, str | tuple[str, str]] = {
    "entity_keys": "SELECT c_nationkey AS entity_id, c_custkey AS scan_key FROM {customer} UNION ALL SELECT (c_nationkey + 1) % 25 AS entity_id, c_custkey AS scan_key FROM {customer} WHERE c_custkey % 10 = 0",
    "versions": "SELECT n_nationkey AS entity_id, n_nationkey % 4 + 1 + CASE WHEN n_nationkey % 5 = 0 THEN 1 ELSE 0 END AS version FROM {nation} UNION ALL SELECT n_nationkey + 100, 1 FROM {nation} WHERE n_nationkey < 5",
    "snapshot": "SELECT 'r1' AS run_id, entity_id, CASE WHEN entity_id % 3 = 0 AND scan_key % 10 = 3 THEN scan_key + 1000000 ELSE scan_key END AS scan_key, entity_id % 4 + 1 AS version FROM entity_keys",
    "mixed_snapshot": "SELECT run_id, entity_id, scan_key, version + CASE WHEN entity_id % 9 = 0 AND scan_key % 3 = 0 THEN 1 ELSE 0 END AS version FROM snapshot",
    "live": """SELECT md5(CAST(o_orderkey AS STRING)) AS id, CAST(o_orderkey AS STRING) AS source_id, 'row-' || CAST(o_orderkey AS STRING) AS row_id, CASE WHEN o_orderkey % 23 <> 0 THEN 'V' || CAST(o_orderkey AS STRING) END AS number, CASE WHEN o_orderkey % 19 = 0 THEN -o_custkey ELSE o_custkey END AS scan_key, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS issue_date,
  CASE o_orderstatus WHEN 'O' THEN 'ACTIVE' WHEN 'F' THEN 'RESOLVE' END AS status,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN 0 WHEN o_orderkey % 13 = 0 THEN -12.5 WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS DECIMAL(15,2)) AS balance_due,
  CAST(o_orderdate AS TIMESTAMP) AS updated_at, o_orderkey % 11 <> 0 AS is_current, 'r0' AS last_run_id, CAST('2024-01-01 00:00:01' AS TIMESTAMP) AS created_at, CAST('2024-01-02 03:04:05' AS TIMESTAMP) AS modified_at FROM {orders}""",
    "staged": """SELECT CASE WHEN o_orderkey % 50 = 0 THEN 'n' WHEN o_orderkey % 7 = 3 THEN 'm' ELSE '' END || CAST(o_orderkey AS STRING) AS source_id, 'row2-' || CAST(o_orderkey AS STRING) AS row_id, 'W' || CAST(o_orderkey AS STRING) AS number, o_custkey AS scan_key, CAST(o_orderdate AS DATE) AS issue_date, 'ACTIVE' AS status,
  CAST(o_totalprice + 1 AS DECIMAL(15,2)) AS balance_due, CAST(o_orderdate AS TIMESTAMP) AS updated_at, 'r1' AS run_id FROM {orders}""",
    "runs": "SELECT * FROM (VALUES ('r0', 'COMPLETED', CAST('2024-01-01 00:00:00' AS TIMESTAMP)), ('r1', 'RUNNING', CAST('2024-01-08 00:00:00' AS TIMESTAMP)), ('r2', 'COMPLETED', CAST('2024-01-15 00:00:00' AS TIMESTAMP)), ('a3', 'FAILED', CAST('2024-01-22 00:00:00' AS TIMESTAMP))) AS t(run_id, status, started_at)",
    "coverage": """SELECT n_nationkey AS entity_id, CASE n_nationkey % 3 WHEN 0 THEN 'CHECKED' WHEN 1 THEN 'NOT_CHECKED' ELSE 'FAILED' END AS status, CASE WHEN n_nationkey % 3 = 1 THEN 'NEVER_INGESTED' END AS status_reason,
  CASE n_nationkey % 4 WHEN 0 THEN 'r0' WHEN 1 THEN 'r2' END AS last_attempt_run_id, CASE n_nationkey % 6 WHEN 0 THEN 'r0' WHEN 5 THEN 'a3' END AS last_success_run_id,
  CASE WHEN n_nationkey % 4 < 2 THEN CAST('2024-01-02 03:04:05.678' AS TIMESTAMP) END AS last_attempt_at, CASE WHEN n_nationkey % 6 = 0 THEN CAST('2023-12-31 00:00:00' AS TIMESTAMP) END AS last_success_at,
  CAST(NULL AS TIMESTAMP) AS source_version_at, CASE WHEN n_nationkey % 3 = 2 THEN 'old error' END AS last_error FROM {nation} WHERE n_nationkey < 20""",
    "batch_keys": f"SELECT scan_key, CAST(floor((row_number() OVER (ORDER BY scan_key) - 1) / {BATCH}) + 1 AS INT) AS batch_number FROM (SELECT DISTINCT scan_key FROM snapshot) AS k",
    "batches": tuple(_BATCHES.replace("%s", x) for x in ("array_join(collect_list(CAST(scan_key AS STRING)), '\",\"')", "string_agg(CAST(scan_key AS STRING), '\",\"')")),
    "raw_rows": "SELECT CAST(user_id AS STRING) AS source_id, CAST(ts AS STRING) AS updated_text, props AS payload, event_id FROM {events}",
    "raw_table": "SELECT source_id, updated_text, min(event_id) AS event_id FROM raw_rows WHERE event_id % 3 = 0 GROUP BY source_id, updated_text",
    "inputs": f"SELECT c_custkey AS pos, CASE WHEN c_custkey % 23 = 0 THEN 'bad' || CAST(c_custkey AS STRING) WHEN c_custkey % 19 = 0 THEN ' ' || substr({_PARCEL}, 1, 4) || ' ' || substr({_PARCEL}, 5) || ' ' ELSE {_PARCEL} END AS input FROM {{customer}}",
    "seeds": """SELECT pos, lpad(CAST(pos AS STRING), 12, '0') AS in_order, CASE WHEN k >= 100 THEN '0' ELSE '1' END || lpad(CAST(pos AS STRING), 12, '0') AS broken_at_gap, CASE WHEN k % 50 = 0 THEN CAST(NULL AS STRING) WHEN k % 60 = 1 THEN '0' ELSE lpad(CAST(pos AS STRING), 12, '0') END AS broken_inside, input
  FROM (SELECT pos AS k, CASE WHEN pos % 31 = 0 THEN NULL ELSE pos - pos % 2 + 50000 * CAST(floor(pos / 100) AS BIGINT) END AS pos, input FROM inputs) AS s""",
    "lots": f"SELECT DISTINCT {_PARCEL} AS parcel FROM {{customer}}",
    "registered": "SELECT parcel, CAST(substr(parcel, 2) AS BIGINT) AS entity_id FROM lots WHERE CAST(substr(parcel, 2, 5) AS INT) % 8 = 1",
    "unit_map": """SELECT parcel AS unit_parcel, substr(parcel, 1, 6) || '0001' AS base_parcel FROM lots WHERE CAST(substr(parcel, 7) AS INT) > 1000 AND CAST(substr(parcel, 2, 5) AS INT) % 7 <> 0
  UNION ALL SELECT parcel, substr(parcel, 1, 6) || '0002' FROM lots WHERE CAST(substr(parcel, 7) AS INT) > 1000 AND CAST(substr(parcel, 2, 5) AS INT) % 11 = 0""",
    "billing_map": """SELECT base_parcel, substr(base_parcel, 1, 6) || '7501' AS billing_parcel FROM (SELECT DISTINCT base_parcel FROM unit_map) AS b WHERE CAST(substr(base_parcel, 2, 5) AS INT) % 5 <> 0
  UNION ALL SELECT base_parcel, substr(base_parcel, 1, 6) || '7502' FROM (SELECT DISTINCT base_parcel FROM unit_map) AS b WHERE CAST(substr(base_parcel, 2, 5) AS INT) % 13 = 0""",
    "parcels": "SELECT parcel FROM lots UNION SELECT billing_parcel AS parcel FROM billing_map",
    "parcel_records": """SELECT CASE WHEN b % 29 = 0 THEN CAST(NULL AS STRING) ELSE parcel || CASE WHEN b % 2 = 0 THEN '.00000000' ELSE '' END END AS bbl, CASE WHEN b % 17 = 0 THEN NULL ELSE '1.0' END AS borocode,
  CAST(b AS STRING) AS block, CAST(CASE WHEN b % 31 = 0 THEN l + 1 ELSE l END AS STRING) AS lot, CASE WHEN b % 37 = 0 THEN '  ' ELSE ' ' || CAST(b AS STRING) || ' MAIN STREET ' END AS address
  FROM (SELECT parcel, CAST(substr(parcel, 2, 5) AS INT) AS b, CAST(substr(parcel, 7) AS INT) AS l FROM parcels) AS p CROSS JOIN (VALUES (1), (2)) AS twice(k) WHERE b % 41 <> 0 AND (k = 1 OR b % 43 = 0)""",
    "footprints": """SELECT CASE WHEN b % 47 = 0 THEN '1000000' ELSE '1' || lpad(CAST((b * 41 + l * 7 + k) % 1000000 AS STRING), 6, '0') END AS building, CASE WHEN b % 10 = 3 AND k = 1 THEN '1999999999' WHEN b % 4 = 1 THEN substr(parcel, 1, 6) || '0001' ELSE parcel END AS base_parcel,
  CASE WHEN b % 6 = 0 THEN NULL WHEN l < 1000 AND b % 10 = 7 THEN '1888888888' WHEN b % 4 = 1 THEN substr(parcel, 1, 6) || '7501' ELSE parcel END AS map_parcel, b % 6 <> 2 AS has_map
  FROM (SELECT parcel, CAST(substr(parcel, 2, 5) AS INT) AS b, CAST(substr(parcel, 7) AS INT) AS l FROM parcels) AS p CROSS JOIN (VALUES (1), (2)) AS twice(k) WHERE k = 1 OR b % 3 = 0""",
    "addresses": """SELECT p_partkey AS id, CASE p_partkey % 6 WHEN 0 THEN '  37–' || CAST(p_size AS STRING) || '   82ND st' WHEN 1 THEN CAST(p_size AS STRING) || 'b east ' || lower(p_brand) || ' apt. 12c' WHEN 2 THEN CAST(p_size AS STRING) || ' W 4TH AVE # 3-a' WHEN 3 THEN 'Unit 7'
  WHEN 4 THEN CAST(p_size AS STRING) || ' ' || p_type || ' Ct,  Queens, NY' ELSE ' , ' END AS address FROM {part}""",
    "candidates": """SELECT s_suppkey % 12 AS input_id, s_suppkey AS pos, CASE WHEN s_suppkey % 12 = 3 THEN '5 Main St, Queens' ELSE CAST(s_suppkey % 12 AS STRING) || ' Main St' END AS address,
  CAST(s_suppkey % 4 AS STRING) || ' Main Street, NY' AS label, CASE WHEN s_suppkey % 3 = 0 THEN CAST(s_suppkey % 12 AS STRING) || ' MAIN ST' END AS name, CASE WHEN s_suppkey % 5 = 0 THEN 'venue' ELSE 'address' END AS layer,
  CASE WHEN s_suppkey % 2 = 0 THEN ' Queens ' ELSE 'Bronx' END AS borough, CASE WHEN s_suppkey % 7 = 0 THEN NULL ELSE CAST(s_suppkey % 9 AS DOUBLE) / 10 END AS confidence,
  CASE WHEN s_suppkey % 12 = 5 THEN NULL ELSE '10000' || lpad(CAST(CASE WHEN s_suppkey % 12 < 6 THEN 1 ELSE s_suppkey % 2 END AS STRING), 5, '0') END AS parcel, CAST(s_suppkey AS STRING) AS source_id FROM {supplier}""",
    "unit_names": "SELECT unit_parcel, base_parcel, CASE CAST(substr(unit_parcel, 7) AS INT) % 4 WHEN 0 THEN '12C' WHEN 1 THEN '3-A' WHEN 2 THEN ' ' ELSE '7' END AS unit FROM unit_map",
    "known_addresses": "SELECT DISTINCT CAST(p_size AS STRING) || ' W 4th Ave # 3-A' AS key, p_size AS entity_id FROM {part} WHERE p_size % 10 = 0",
    "geo_candidates": """SELECT p_partkey AS input_id, k AS pos, '1 Main St' AS address, 'Main Street' AS label, CAST(NULL AS STRING) AS name, 'address' AS layer, 'Queens' AS borough, CAST(k AS DOUBLE) / 10 AS confidence,
  CASE WHEN p_partkey % 23 = 0 THEN NULL ELSE '1' || lpad(CAST(CASE WHEN k = 2 AND p_partkey % 7 = 0 THEN p_partkey + 1 ELSE p_partkey END % 700 AS STRING), 5, '0') || CASE WHEN p_partkey % 6 NOT IN (1, 2) THEN lpad(CAST(p_partkey % 40 AS STRING), 4, '0')
  WHEN p_partkey % 4 = 3 THEN '7501' WHEN p_partkey % 13 = 0 THEN '7502' ELSE '0001' END END AS parcel,
  CASE WHEN p_partkey % 5 = 0 THEN '1999998' WHEN p_partkey % 5 = 1 THEN '1000000' WHEN p_partkey % 5 = 2 THEN '1' || lpad(CAST((p_partkey % 700 * 41 + p_partkey % 40 * 7 + 1) % 1000000 AS STRING), 6, '0') END AS building, CAST(k AS STRING) AS source_id
  FROM {part} CROSS JOIN (VALUES (1), (2)) AS twice(k) WHERE p_partkey % 29 <> 0""",
    "typed_rows": """SELECT p_partkey AS id, '{{"bbl":' || CASE p_partkey % 11 WHEN 0 THEN '1' || lpad(CAST(p_partkey AS STRING), 9, '0') || '.25' WHEN 1 THEN CAST(p_partkey AS STRING) WHEN 2 THEN '"1' || lpad(CAST(p_partkey AS STRING), 9, '0') || '"' WHEN 3 THEN '" 1 ' || lpad(CAST(p_partkey AS STRING), 9, '0') || '"' WHEN 4 THEN '"12"' WHEN 5 THEN 'null' WHEN 6 THEN 'true'
  WHEN 7 THEN substr('987654321012345', 1, 1 + CAST(p_partkey % 15 AS INT)) WHEN 8 THEN '-' || CAST(p_partkey AS STRING) WHEN 9 THEN CASE WHEN p_partkey % 2 = 0 THEN '-0.5' ELSE '0.' || CAST(p_partkey AS STRING) END ELSE CAST(p_partkey AS STRING) || '.75' END
  || ',"count":' || CASE p_partkey % 4 WHEN 0 THEN '"' || CAST(p_partkey AS STRING) || '"' WHEN 1 THEN CAST(p_partkey AS STRING) WHEN 2 THEN '-1' ELSE '"1.5"' END || '}}' AS payload FROM {part}""",
    "replies": """SELECT s_suppkey AS input_id, CAST(s_suppkey AS STRING) || ' Main St' AS address, '{{"features":[' || CASE WHEN s_suppkey % 5 = 0 THEN '' ELSE '{{"geometry":{{"coordinates":[-73.5,40.25]}},"properties":{{"label":" L' || CAST(s_suppkey AS STRING) || ' ","name":' || CASE WHEN s_suppkey % 3 = 0 THEN '""' ELSE '"N"' END || ',"layer":"address","borough":"Queens","confidence":' || CASE WHEN s_suppkey % 4 = 0 THEN '"0.5"' WHEN s_suppkey % 4 = 1 THEN '"x"' ELSE '0.75' END
  || CASE WHEN s_suppkey % 2 = 0 THEN ',"pad_bbl":"100001' || lpad(CAST(s_suppkey % 10000 AS STRING), 4, '0') || '"' ELSE '' END || ',"addendum":{{"pad":{{"bbl":2000010001,"bin":"' || CASE WHEN s_suppkey % 6 = 0 THEN '12' ELSE '1000001' END || '"}}}},"id":' || CAST(s_suppkey AS STRING) || '}}}},{{"geometry":{{"coordinates":[]}},"properties":{{"name":"unlabelled"}}}}' END || ']}}' AS reply FROM {supplier}""",
    "landed_rows": """SELECT o_orderkey AS id, CASE WHEN o_orderkey % 31 = 0 THEN 'no object' ELSE '{{"isn_dob_bis_extract":' || CASE WHEN o_orderkey % 29 = 0 THEN '" "' ELSE '"' || CAST(o_orderkey AS STRING) || '"' END || CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE ',":id":"row-' || CAST(o_orderkey AS STRING) || '"' END
  || ',":updated_at":"' || substr(CAST(o_orderdate AS STRING), 1, 10) || 'T01:02:03.456Z","BIN":' || CASE WHEN o_orderkey % 19 = 0 THEN '"x"' ELSE '" 1' || lpad(CAST(o_custkey AS STRING), 6, '0') || '"' END || ',"ecb_violation_status":" ACTIVE "'
  || ',"issue_date":' || CASE o_orderkey % 5 WHEN 0 THEN '"0"' WHEN 1 THEN '"' || replace(substr(CAST(o_orderdate AS STRING), 1, 10), '-', '') || '"' WHEN 2 THEN 'null' WHEN 3 THEN '0' ELSE '"20261350"' END || ',"balance_due":' || CASE WHEN o_orderkey % 7 = 0 THEN '"1,0x"' ELSE '"' || CAST(o_custkey AS STRING) || '.50"' END || '}}' END AS payload FROM {orders}""",
    "dated_texts": """SELECT o_orderkey AS id, CASE o_orderkey % 9 WHEN 0 THEN strf WHEN 1 THEN ' ' || replace(strf, '-', '') || ' ' WHEN 2 THEN substr(strf, 6, 2) || '/' || substr(strf, 9, 2) || '/' || substr(strf, 1, 4) WHEN 3 THEN strf || 'T10:20:30.123456Z'
  WHEN 4 THEN '0' WHEN 5 THEN ' 0 ' WHEN 6 THEN '2026-02-30' WHEN 7 THEN strf || 'T23:59:59-05:00' ELSE '0099-01-01' END AS text FROM (SELECT o_orderkey, substr(CAST(o_orderdate AS STRING), 1, 10) AS strf FROM {orders}) AS o""",
    "amount_texts": "SELECT o_orderkey AS id, CASE o_orderkey % 8 WHEN 0 THEN '-125.50' WHEN 1 THEN ' 1,250.005 ' WHEN 2 THEN '.5' WHEN 3 THEN '7.' WHEN 4 THEN '1e3' WHEN 5 THEN '' WHEN 6 THEN '99999999999999999' ELSE CAST(o_orderkey AS STRING) END AS text FROM {orders}",
    "json_rows": "SELECT event_id AS id, CASE event_id % 5 WHEN 0 THEN '{{\"Bin\":\"' || CAST(user_id AS STRING) || '\"}}' WHEN 1 THEN '{{\"BIN\":1,\"bin\":\" 2 \"}}' WHEN 2 THEN '{{\"bin\":null}}' WHEN 3 THEN '{{}}' ELSE props END AS payload FROM {events}",
}


def _duck(text: str | tuple[str, str]) -> str:
    return (text if isinstance(text, str) else text[1]).format(**{t: t for t in TABLES})


def with_clause() -> str:
    return "WITH " + ",\n".join(f"{name} AS ({_duck(text)})" for name, text in RELATIONS.items())


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "batch_keys":  # a window over all keys in DuckDB, ranges of keys here
        return snapshots.batch_numbers(snapshots.scan_keys(relation(spark, sf_dir, "snapshot")), BATCH)
    if name not in RELATIONS:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = RELATIONS[name] if isinstance(RELATIONS[name], str) else RELATIONS[name][0]
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in text}
    others = [r for r in RELATIONS if re.search(rf"(?<![\w'.]){r}(?!\w)", text) and re.search(rf"(?:FROM|JOIN) {r}\b", text)]
    text = re.sub(r"(?:FROM|JOIN) (\w+)\b", lambda m: m[0].replace(m[1], f"{{{m[1]}}}") if m[1] in others else m[0], text)
    return spark.sql(text, **used, **{r: relation(spark, sf_dir, r) for r in others})
