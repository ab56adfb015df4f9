import datetime as dt
import random

import pytest

from pyspark.sql import functions as F

from wardline.operators import feeds

LIVE = "source_id string, scan_key string, issue_date date, status string, balance_due decimal(15,2), updated_at timestamp, is_current boolean"


def whole(df):
    """With the columns of live facts that the tests do not look at."""
    texts = {c: F.concat(F.lit(f"{c}-"), "source_id") for c in ("id", "row_id", "number")}
    return df.withColumns(texts | {"last_run_id": F.lit("r1"), "created_at": F.col("updated_at"), "modified_at": F.col("updated_at")})


def live(spark, n=60):
    from decimal import Decimal

    rng = random.Random(1)
    rows = []
    for k in range(n):
        day = None if k % 4 == 0 else dt.date(2026, 1, 1 + rng.randrange(5))
        rows.append((str(rng.randrange(10**6)) + f"-{k}", f"k{k % 7}", day, rng.choice(["ACTIVE", "active", "RESOLVE", None]), rng.choice([None, Decimal("0.00"), Decimal("-5.00"), Decimal("12.50")]), dt.datetime(2026, 1, 1, k % 5), k % 10 != 9))
    return rows, whole(spark.createDataFrame(rows, LIVE))


def in_order(rows):
    return sorted(sorted(rows, key=lambda r: r[0], reverse=True), key=lambda r: (r[2] is None, -(r[2].toordinal() if r[2] else 0)))


@pytest.mark.parametrize("limit", [1, 7, 15, 60])
def test_a_walk_over_pages_sees_every_row_once(spark, limit):
    rows, df = live(spark)
    seen, cursor = [], None
    for _ in range(61):
        page, cursor = feeds.read_page(df, feeds.FeedQuery(cursor=cursor, limit=limit))
        seen += [r.source_id for r in page]
        if cursor is None or limit == 1 and len(seen) > 20:
            break
    want = [r[0] for r in in_order([r for r in rows if r[-1]])]
    assert seen == want[: len(seen)] and (limit == 1 or len(seen) == len(want))


def test_updated_since_is_strict_and_walks(spark):
    rows, df = live(spark)
    since = dt.datetime(2026, 1, 1, 2)
    seen, cursor = [], None
    while True:
        page, cursor = feeds.read_page(df, feeds.FeedQuery(since=since, cursor=cursor, limit=6))
        seen += [r.source_id for r in page]
        if cursor is None:
            break
    want = sorted((r for r in rows if r[-1] and r[5] > since), key=lambda r: (r[5], r[0]), reverse=True)
    assert seen == [r[0] for r in want]


def test_filters(spark):
    rows, df = live(spark)
    found = {r.source_id for r in df.where(feeds.is_open() & feeds.unpaid()).collect()}
    assert found == {r[0] for r in rows if r[3] == "ACTIVE" and r[4] is not None and r[4] > 0}


def test_shared_keys_show_a_fact_once(spark):
    rows, df = live(spark)
    keys = spark.createDataFrame([(1, "k0"), (2, "k0"), (2, "k1")], "entity_id int, scan_key string")
    assert feeds.of_portfolio(df, keys).count() == sum(r[1] in ("k0", "k1") for r in rows)
    assert feeds.of_entity(df, keys, 1).count() == sum(r[1] == "k0" for r in rows)
    assert feeds.of_portfolio(df, keys.where("entity_id = 2 AND scan_key = 'k1'")).count() == sum(r[1] == "k1" for r in rows)


def test_pages_are_top_k(spark):
    _, df = live(spark)
    plan = feeds.page(df.where(feeds.current()), 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan


@pytest.mark.parametrize("raw", [{"openOnly": "yes"}, {"unpaidOnly": "1"}, {"limit": "0"}, {"limit": "-1"}, {"limit": "1.5"}, {"limit": "101"}, {"cursor": "not*a*cursor"}, {"x": "1"}, {"updatedSince": "2026-01-01"}])
def test_bad_requests(raw):
    with pytest.raises(ValueError):
        feeds.FeedQuery.parse(raw, portfolio=False)


def test_requests():
    assert feeds.FeedQuery.parse({}, portfolio=False) == feeds.FeedQuery()
    q = feeds.FeedQuery.parse({"unpaidOnly": "true", "limit": "100", "updatedSince": "2026-01-01T00:00:00+00:00"}, portfolio=True)
    assert q.unpaid_only and q.limit == 100 and q.since.year == 2026
    with pytest.raises(ValueError):
        feeds.FeedQuery.parse({"openOnly": "true"}, portfolio=True)


def test_shapes(spark):
    from decimal import Decimal

    df = spark.createDataFrame([("1", "k", dt.date(2026, 2, 3), "ACTIVE", Decimal("10.50"), dt.datetime(2026, 1, 2, 3, 4, 5, 678000), True), ("2", "k", None, None, None, dt.datetime(2026, 1, 1), True)], LIVE)
    df = whole(df)
    one, two = feeds.entity_shape(df).orderBy("source_id").collect()
    assert tuple(one) == ("1", "k", "number-1", "2026-02-03", "ACTIVE", "10.5", "2026-01-02T03:04:05.678Z") and two.balance_due is None
    first = feeds.portfolio_shape(df).orderBy("source_id").first()
    assert first.balance_due == "10.50" and len(first) == 11 and len(feeds.FEED) == 13


def test_payload_nests_keys_and_coverage(spark):
    entities = spark.createDataFrame([(1, 3), (2, 1)], "entity_id int, version int")
    keys = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a")], "entity_id int, scan_key string")
    coverage = spark.createDataFrame([(1, "y", "FAILED", None), (1, "x", "CHECKED", "z")], "entity_id int, dataset string, status string, status_reason string")
    one, two = feeds.entity_payload(entities, keys, coverage).orderBy("entity_id").collect()
    assert one.scan_keys == ["a", "b"] and [tuple(c) for c in one.coverage] == [("x", "CHECKED", "z"), ("y", "FAILED", None)] and (two.scan_keys, two.coverage) == ([], [])
