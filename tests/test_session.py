import os

import pytest

from parcelyard import session


def test_tables_that_are_passed_through_are_deleted(spark):
    with session.passing() as keep:
        gone = session.shared_table(spark.range(5))
        with session.passing() as also:
            inner, left = also(session.shared_table(spark.range(3))), session.shared_table(spark.range(2))
        kept = keep(session.shared_table(spark.range(7)))
        assert gone.count() == 5 and inner.count() == 3
        folder = session.scratch(spark).removeprefix("file://")
        assert len(os.listdir(folder)) >= 3
    assert kept.count() == 7 and kept.inputFiles()
    for df in (gone, inner, left):
        with pytest.raises(Exception):
            df.count()


def test_folders_are_new_and_shared_by_the_application(spark):
    assert session.shared_dir(spark) != session.shared_dir(spark)
    assert session.shared_dir(spark).startswith(session.scratch(spark))


def test_a_cluster_needs_the_setting(monkeypatch):
    class Context:
        applicationId, master = "app-of-a-cluster", "spark://host:7077"

        def getConf(self):
            return {}

    class Session:
        sparkContext, conf = Context(), {}

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.scratch(Session())
