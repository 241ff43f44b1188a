"""A failure in a query over the streaming mirror is no smaller result."""

import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.test_mirror import changes, configs, expected
from tidemirror.operators import actions as A
from tidemirror.plans import catalog
from tidemirror.sources import ordered_log as L
from tidemirror.sources.changelog import with_commits
from tidemirror.streaming.mirror_stream import Mirror


@pytest.fixture
def tables(spark, tmp_path):
    began = dt.datetime(2024, 1, 1)
    rows = [(i, began + dt.timedelta(seconds=i), i % 7, ("signup", "click", "error", "view")[i % 4], f'{{"k": {i}}}') for i in range(120)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_a_query_that_is_lost_and_starts_anew_has_the_whole_result(spark, tables):
    got, want = catalog.stream_restart(spark, tables), catalog.mirror_latest(spark, tables)
    assert sorted(got.drop("events_processed").collect()) == sorted(want.collect()) and want.count() > 0
    assert {r.events_processed for r in got.select("events_processed").collect()} == {120}


@pytest.mark.parametrize("first", [0, 2])
def test_a_failure_that_is_not_the_lost_driver_is_raised(spark, tables, monkeypatch, first):
    """In the first micro-batch, and in one that only the last run reaches."""
    real = Mirror.whole

    def full(self, rows, batch_id):
        if batch_id >= first:
            raise OSError("the disk is full")
        return real(self, rows, batch_id)

    monkeypatch.setattr(Mirror, "whole", full)
    with pytest.raises(StreamingQueryException, match="the disk is full"):
        catalog.stream_restart(spark, tables)


def test_a_driver_that_is_never_lost_is_a_failure(spark, tables, monkeypatch):
    real = Mirror.run_log
    monkeypatch.setattr(Mirror, "run_log", lambda self, *args: real(Mirror(self.spark, self.path, self.configs, buckets=8), *args))
    with pytest.raises(catalog.Unfinished, match="lost"):
        catalog.stream_restart(spark, tables)


def test_a_mirror_behind_its_log_is_not_shown(spark, tmp_path):
    log, path = changes(spark, 40), str(tmp_path / "log")
    L.append_log(with_commits(log), path, 4)
    assert L.log_end(spark, path) == (39, 2**62)
    second = sorted(p for p in (tmp_path / "log").iterdir() if p.name.startswith("segment="))[1]
    second.rename(tmp_path / "away")
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), buckets=2)
    for waits in (False, True):
        if waits:
            m.run_log(path, str(tmp_path / "q"), on_gap="wait")
        with pytest.raises(catalog.Unfinished, match="ends at 39"):
            catalog._shown(m)
    (tmp_path / "away").rename(second)
    m.run_log(path, str(tmp_path / "q"))
    assert {(r.id, r.lsn, r.events_processed) for r in catalog._shown(m).collect()} == {(i, lsn, 40) for i, _, lsn in expected(log.collect())}


def test_a_mirror_with_failed_events_is_not_shown(spark, tmp_path):
    L.append_log(with_commits(changes(spark, 40)), str(tmp_path / "log"), 2)
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), lambda routed: A.passthrough(routed).withColumn("error", F.when(F.col("lsn") == 9, "no")), buckets=2)
    m.run_log(str(tmp_path / "log"), str(tmp_path / "q"))
    with pytest.raises(catalog.Unfinished, match="dead letters"):
        catalog._shown(m)
