import os
import time

import pytest

from quellwerk import session


class _Conf(dict):
    def get(self, key, default=None):
        return super().get(key, default)


class _Session:
    def __init__(self, master, conf):
        self.conf = _Conf(conf)
        self.sparkContext = type("C", (), {"master": master})()


def test_work_folder():
    assert session.work_folder(_Session("spark://h:7077", {session.CHECKPOINT: "/shared/x/"})) == "/shared/x"
    assert session.work_folder(_Session("local[2]", {})).endswith("quellwerk-checkpoints")
    with pytest.raises(ValueError):
        session.work_folder(_Session("spark://h:7077", {}))


def test_materialise_reads_what_it_wrote(spark):
    df = spark.range(5).selectExpr("id", "array(id) as a")
    assert session.materialise(df, "t").orderBy("id").collect() == df.collect()
    assert session.materialise(df.limit(0), "t").count() == 0


def test_materialised_results_leave_no_shuffle_files(spark, tmp_path):
    """The shuffle of a written result is removed with the write, the setting is put back, and a spent result can be dropped."""
    before = spark.conf.get(session.FILE_CLEANUP, "false")
    tracker = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    count = tracker.size()
    df = session.materialise(spark.range(1000).selectExpr("id % 7 as k").repartition(3, "k").groupBy("k").count(), "spent")
    wait = time.time() + 10
    while tracker.size() > count and time.time() < wait:
        time.sleep(0.1)
    assert tracker.size() <= count and spark.conf.get(session.FILE_CLEANUP) == before
    folder = df.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file:").replace("///", "/")
    assert df.count() == 7 and os.path.isdir(folder)
    session.drop(df)
    assert not os.path.exists(folder)
