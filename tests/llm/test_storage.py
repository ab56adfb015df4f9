import os

import pytest

from wardline.llm import storage


def test_staged_and_cleared(spark):
    df = storage.staged(spark.range(5), "numbers")
    folder = storage.shared_dir(spark)
    assert folder.startswith(spark.conf.get("spark.checkpoint.dir")) and df.count() == 5 and any(x.startswith("numbers-") for x in os.listdir(folder))
    storage.clear(spark)
    assert not os.path.exists(folder)


def test_batches_are_bounded(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    for before, after in (("10000", "500"), ("0", "500"), ("20", "20")):
        spark.conf.set(key, before)
        storage.small_batches(spark)
        assert spark.conf.get(key) == after
    spark.conf.set(key, "500")


def test_a_cluster_must_name_its_folder(spark, monkeypatch):
    class Conf:
        def get(self, *a):
            return None

    class Session:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="checkpoint.dir"):
        storage.shared_dir(Session())
