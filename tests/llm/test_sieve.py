from collections import Counter

from wardline.llm import sieve


def test_no_match_is_lost(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 500, k % 7 if k % 11 else None, f"t{k}", 9) for k in range(2000)], "a long, b long, text string, slot int").repartition(3)
    gone = spark.createDataFrame([(k, k % 7) for k in range(0, 500, 3)] + [(1, None)], "a long, b long")
    want = Counter(map(tuple, rows.join(gone, ["a", "b"], "left_anti").select(*rows.columns).collect()))
    for slots in (1 << 26, 1 << 15, 1 << 16):
        monkeypatch.setattr(sieve, "SLOTS", slots)
        perhaps, never = sieve.sifted(rows, gone, ["a", "b"])
        assert perhaps.columns == never.columns == rows.columns
        assert perhaps.count() + never.count() == 2000 and never.join(gone, ["a", "b"]).count() == 0
        assert Counter(map(tuple, sieve.without(rows, gone, ["a", "b"]).collect())) == want
    monkeypatch.setattr(sieve, "SLOTS", 1 << 26)
    assert sieve.sifted(rows, gone, ["a", "b"])[0].count() < 700
    assert sieve.without(rows, gone.limit(0), ["a", "b"]).count() == 2000 and sieve.without(rows.limit(0), gone, ["a", "b"]).count() == 0
