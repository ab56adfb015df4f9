"""Reads of several tables as one publication left them, and of a live table laid out for the keys that pages ask for.

``write_by_key`` sorts rows by key over many files, so that a key's rows lie in one or two row groups, whose bounds and Bloom filters
let a page of a few keys skip the others. ``of_keys`` asks with the keys themselves, which Parquet's reader can use; a
semi join would read the whole table first.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from wardline.operators import feeds
from wardline.plans.control import Store


def entity_page(store: Store, entity_id, query: feeds.FeedQuery) -> tuple[list[Row], str | None, Row | None]:
    """A page of an entity's feed, the next page's cursor, and the entity's coverage. All come from the versions that one state
    file names, so a publication in between changes neither: rows never stand beside the coverage of another run."""
    v = store.versions()
    facts = feeds.of_entity(store.table("live", v), store.table("entity_keys", v), entity_id)
    rows, cursor = feeds.read_page(facts, query)
    covered = store.table("coverage", v).where(F.col("entity_id") == F.lit(entity_id)).limit(1).collect()
    return rows, cursor, covered[0] if covered else None


#: Rows of one row group are about this many bytes, so that a page reads little more than its rows.
GROUP_BYTES = 1 << 20


def write_by_key(live: DataFrame, path: str, files: int) -> None:
    dealt = live.repartitionByRange(files, "scan_key").sortWithinPartitions("scan_key", F.desc_nulls_last("issue_date"), F.desc("source_id"))
    options = {"parquet.bloom.filter.enabled#scan_key": "true", "parquet.block.size": str(GROUP_BYTES)}
    dealt.write.options(**options).parquet(path)


def of_keys(live: DataFrame, entity_keys: DataFrame, entity_id) -> DataFrame:
    """As ``feeds.of_entity``. The keys of one entity are collected: some dozens at most, as many as it has buildings."""
    keys = [r.scan_key for r in entity_keys.where(F.col("entity_id") == F.lit(entity_id)).select("scan_key").distinct().collect()]
    return live.where(F.col("scan_key").isin(keys))
