import random

import pyarrow.parquet as pq
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.test_mirror import changes, configs, expected, shown
from tidemirror.operators import actions as A
from tidemirror.operators import dlq as D
from tidemirror.operators.letters import DeadLetters
from tidemirror.sources import ordered_log as L
from tidemirror.sources.changelog import with_commits
from tidemirror.streaming import mirror_stream as MS
from tidemirror.streaming.mirror_stream import Mirror


def test_segments_join_up():
    cut = [((0, 0), (5, 2), "a"), ((5, 2), (9, 0), "b"), ((9, 0), (9, 7), "c"), ((11, 0), (12, 0), "e")]
    assert L.chain(cut, (0, 0)) == (cut[:3], (11, 0)) and L.chain(cut, (5, 2)) == (cut[1:3], (11, 0)) and L.chain(cut, (9, 7)) == ([], (11, 0))
    assert L.chain(cut, (12, 0)) == ([], None) and L.chain([], (0, 0)) == ([], None)
    with pytest.raises(L.LogError):
        L.chain([*cut, ((8, 0), (20, 0), "x")][::-1][:1] + cut[3:], (9, 0))
    with pytest.raises(L.LogError):
        L.chain(sorted([*cut, ((4, 0), (6, 0), "x")]), (0, 0))


def test_appended_segments_cover_all_rows_in_order(spark, tmp_path):
    log, path = with_commits(changes(spark, 60, seed=2)), str(tmp_path / "log")
    L.append_log(log.where("ack_lsn < 30"), path, 3)
    L.append_log(log.where("ack_lsn >= 30"), path, 2)
    found = L.segments_in(*L.file_system(path))
    assert len(found) == 5 and L.chain(found, L.START) == (found, None) and found[-1][1] == (59, 2**62)
    for (a, s), (b, t), folder in found:
        at = spark.read.parquet(folder).agg(F.min(F.struct("ack_lsn", "seq")), F.max(F.struct("ack_lsn", "seq"))).first()
        assert (a, s) < tuple(at[0]) and tuple(at[1]) == (b, t)
    with pytest.raises(L.LogError, match="not behind"):
        L.append_log(log.where("ack_lsn = 7"), path)
    assert len(L.segments_in(*L.file_system(path))) == 5


def test_a_large_segment_has_many_files_and_tasks(spark, tmp_path, monkeypatch):
    log, path = with_commits(changes(spark, 400, seed=6)), str(tmp_path / "log")
    monkeypatch.setattr(L, "PIECE_ROWS", 25)
    L.append_log(log, path, 2)
    found = L.segments_in(*L.file_system(path))
    assert len(found) == 2 and L.chain(found, L.START) == (found, None)
    files = [f for f in (tmp_path / "log").rglob("*.parquet")]
    rows = [pq.ParquetFile(f).read(["ack_lsn", "seq"]).to_pylist() for f in files]
    assert max(map(len, rows)) < 100 and sum(map(len, rows)) == 500 and all(r == sorted(r, key=lambda x: (x["ack_lsn"], x["seq"])) for r in rows)
    reader = L.LogReader(None, {"path": path})
    (a, s), (b, t) = L.START, found[-1][1]
    parts = lambda: reader.partitions({"ack_lsn": a, "seq": s}, {"ack_lsn": b, "seq": t})
    assert len(parts()) == 1  # small files are read together
    monkeypatch.setattr(L, "READ_BYTES", 1)
    assert sorted(p for f in parts() for p in f.paths) == sorted(map(str, files)) and len(parts()) == len(files) > 8
    assert L.packed([[("a", 3), ("b", 1)], [], [("c", 1)]]) == [["a"], ["b"], ["c"]] and L.packed([]) == []


def test_only_routed_tables_and_later_segments_are_read(spark, tmp_path):
    log, path = changes(spark, 80, seed=3), str(tmp_path / "log")
    odd = log.withColumns({"src_table": F.lit("a/b=c d"), "seq": F.col("seq") + 1000})
    L.append_log(with_commits(log.unionByName(odd)), path, 4)
    assert L.routed_tables(configs(spark)) == ["public.t"] and L.routed_tables(configs(spark).limit(0)) == []
    every = L.log_changes(spark, path)
    assert every.count() == 180 and every.columns == log.columns
    mine = L.log_changes(spark, path, ["public.t"], (39, 2**62))
    want = {r.lsn for r in log.where("ack_lsn > 39").collect()}
    assert {r.lsn for r in mine.where("op <> 'commit'").collect()} == want and mine.where("op = 'commit'").count() == 10
    plan = mine._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan.split("PushedFilters")[0] and "of#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert L.log_changes(spark, path, ["public.a/b=c d"]).where("op <> 'commit'").count() == 80
    reader = L.LogReader(None, {"path": path, "tables": '["public.a/b=c d"]'})
    files = [str(p) for p in (tmp_path / "log").rglob("*.parquet")]
    taken = [f for f in files if reader.wanted(f)]
    assert taken and len(taken) < len(files) and not any("of=public.t/" in f for f in taken)


def test_the_stream_opens_routed_tables_only(spark, tmp_path):
    log = changes(spark, 60, seed=4).persist()
    odd = log.withColumns({"src_table": F.lit("u"), "seq": F.col("seq") + 1000})
    L.append_log(with_commits(log.unionByName(odd)), str(tmp_path / "log"), 3)
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), buckets=2)
    q = m.run_log(str(tmp_path / "log"), str(tmp_path / "q"), routed_only=True)
    cp = m.checkpoints.read().first()
    assert shown(m.store.read()) == expected(log.collect()) and (cp.lsn, cp.events_processed) == (59, 60)
    assert m.metrics().agg(F.sum("events")).first()[0] == 60 and q.exception() is None


@pytest.mark.parametrize("seed", [1, 2])
def test_segments_in_any_order_of_time_give_the_same_mirror(spark, tmp_path, seed):
    """Segments come one by one in random order; each time the query is started and ended."""
    rng, log = random.Random(seed), changes(spark, 80, seed=seed).persist()
    L.append_log(with_commits(log), str(tmp_path / "all"), 6)
    names = [p.name for p in (tmp_path / "all").iterdir() if p.name.startswith("segment=")]
    rng.shuffle(names)
    (tmp_path / "log").mkdir()
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), buckets=2)
    for n, name in enumerate(names):
        (tmp_path / "all" / name).rename(tmp_path / "log" / name)
        if n % 2 or n == len(names) - 1:
            m.run_log(str(tmp_path / "log"), str(tmp_path / "q"), on_gap="wait")
    cp = m.checkpoints.read().first()
    assert shown(m.store.read()) == expected(log.collect()) and (cp.lsn, cp.events_processed) == (79, 80) and m.dlq.read().count() == 0


def test_a_hole_stops_the_query(spark, tmp_path):
    L.append_log(with_commits(changes(spark, 40)), str(tmp_path / "log"), 4)
    second = sorted(p for p in (tmp_path / "log").iterdir() if p.name.startswith("segment="))[1]
    second.rename(tmp_path / "away")
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), buckets=2)
    with pytest.raises(StreamingQueryException, match="hole"):
        m.run_log(str(tmp_path / "log"), str(tmp_path / "q"))
    (tmp_path / "away").rename(second)
    m.run_log(str(tmp_path / "log"), str(tmp_path / "q"))
    assert m.checkpoints.read().first().events_processed == 40


def test_late_rows_are_never_passed_over(spark, tmp_path):
    log = with_commits(changes(spark, 24, seed=3)).persist()
    rows = log.where("lsn < 8"), log.where("lsn >= 12"), log.where("lsn BETWEEN 8 AND 11")
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), buckets=2, clock=lambda: 1)
    for n, part in enumerate(rows):
        m.apply(part, n)
    assert {r.lsn for r in m.dlq.read().collect()} == {8, 9, 10, 11} and {r.kind for r in m.dlq.read().collect()} == {D.RETRYABLE}
    told = m.metrics().orderBy("batch_id").collect()
    assert [(r.events, r.transactions, r.late, r.done) for r in told] == [(8, 2, 0, 7), (12, 3, 0, 23), (0, 0, 4, 23)]
    strict = Mirror(spark, str(tmp_path / "s"), configs(spark), buckets=2, late="fail")
    strict.apply(rows[0], 0)
    strict.apply(rows[1], 1)
    with pytest.raises(MS.LateRows):
        strict.apply(rows[2], 2)
    again = Mirror(spark, str(tmp_path / "a"), configs(spark), buckets=2, late="skip")
    for n in range(2):
        again.apply(log, n)
    assert again.dlq.read().count() == 0 and again.checkpoints.read().first().events_processed == 24


@pytest.mark.parametrize("cuts", [(10, 20, 30), (8, 20, 30), (30,), (1, 29, 30)])
def test_limits_over_micro_batches(spark, tmp_path, cuts):
    """One transaction of 30 events and a small one behind it, with a limit of 10 events."""
    log = changes(spark, 34, seed=4)
    log = with_commits(log.withColumns({"xid": F.when(F.col("lsn") < 30, 1).otherwise(2).cast("long"), "ack_lsn": F.when(F.col("lsn") < 30, 29).otherwise(33).cast("long")})).persist()
    edges = [0, *cuts, 10**9]
    for eager, processed in ((False, 4), (True, 34)):
        m = Mirror(spark, str(tmp_path / f"m{eager}"), configs(spark), buckets=2, most_events=10, eager=eager)
        for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            own = log.where((F.col("lsn") >= a) & (F.col("lsn") < b) & (F.col("op") != "commit")) if b <= 30 else log.where((F.col("lsn") >= a) | (F.col("op") == "commit"))
            m.apply(own, n)
        assert {r.lsn for r in m.store.read(markers=True).collect()} <= set(range(0 if eager else 30, 34))
        cp = m.checkpoints.read().first()
        assert (cp.lsn, cp.events_processed) == (33, processed)


def test_events_are_counted_before_a_first_position(spark, tmp_path):
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), buckets=2, eager=True)
    m.apply(changes(spark, 3), 0)
    assert tuple(m.checkpoints.read().select("lsn", "events_processed").first()) == (-1, 3)


def test_dead_letter_log(spark, tmp_path):
    def letter(i, **kw):
        return (i, "c", 1, '{"Int":1}', "update", "e", "retryable", 0, 5, None, None)

    log = DeadLetters(spark, str(tmp_path / "d"))
    frame = lambda *ids: spark.createDataFrame([letter(i) for i in ids], D.DLQ_SCHEMA)
    assert log.read().count() == 0
    log.append(frame("1", "2", "3").repartition(3), 0)
    assert len(list((tmp_path / "d").glob("g=0/batch-*/part-*"))) == 3
    results = spark.createDataFrame([("1", True, None, False), ("2", False, "no", False)], "dlq_id string, ok boolean, error string, fatal boolean")
    log.settle(results, 5, 7)
    log.append(frame("1", "2", "3"), 0)  # the micro-batch again
    state = lambda: {r.dlq_id: (r.kind, r.retry_count) for r in log.read().collect()}
    assert state() == {"2": ("retryable", 1), "3": ("retryable", 0)}
    assert not log.compact(1) and log.compact(1, after=1) and state() == {"2": ("retryable", 1), "3": ("retryable", 0)}
    log.append(frame("1", "4"), 0)  # and once more
    assert set(state()) == {"2", "3", "4"}
    log.settle(spark.createDataFrame([("2", False, "no", True)], results.schema), 5, 9)
    assert state()["2"] == ("permanent", 1)
    log.purge(9 + 73 * 3_600_000)
    assert set(state()) == {"3", "4"} and log.compact(9, after=0) and set(state()) == {"3", "4"}
    assert log.lines().where("gone").count() == 0


@pytest.mark.parametrize("kind", ["int", "string"])
def test_backfill_resumes_open_ranges_only(spark, tmp_path, kind):
    source = spark.createDataFrame([(i, f"n{i}") for i in range(1, 101)] + [(None, "x")], "id int, name string").withColumn("id", F.col("id").cast(kind))
    cfg = configs(spark).withColumn("id_type", F.lit("int"))
    m = Mirror(spark, str(tmp_path / "m"), cfg, buckets=2)
    assert m.backfill({"c": source}, 100, pieces=5, at_once=2, waves=1) == 3
    assert m.checkpoints.read().count() == 0
    first = m.store.read().count()
    assert 0 < first < 100
    changed = source.withColumn("name", F.lit("second"))  # rows that are copied now show it
    m = Mirror(spark, str(tmp_path / "m"), cfg, buckets=2)
    assert m.backfill({"c": changed}, 500, pieces=5) == 0
    got = m.store.read().collect()
    assert len(got) == 100 and sum("second" in r.document for r in got) == 100 - first and {r.lsn for r in got} == {100}
    assert m.ranges.read().agg(F.sum("n_rows")).first()[0] == 100 and m.checkpoints.read().first().lsn == 100
    assert m.backfill({"c": source}, 900) == 0 and m.store.read().where("document LIKE '%second%'").count() == 100 - first
    log = changes(spark, 20, start=96)
    m.apply(with_commits(log), 0)
    assert m.checkpoints.read().first().events_processed == 16  # of transactions that end behind the watermark


def test_unsafe_layouts_are_signalled(spark, tmp_path):
    row = lambda lsn, op, cols, types=None: (lsn, lsn, 1, 9, 0, 1, "public", "t", op, cols, types, [])
    m = Mirror(spark, str(tmp_path / "m"), configs(spark).withColumn("columns", F.array(F.lit("v"))), buckets=2)
    first = [row(0, "relation", ["id", "v"], ["int4", "text"]), row(1, "insert", ["1", "a"])]
    m.apply(spark.createDataFrame(first, MS.PLACED_SCHEMA), 0)
    # In the next micro-batch, but in the same transaction, behind a row of the table: unsafe though no watched column changes.
    m.apply(spark.createDataFrame([row(2, "relation", ["id", "v", "w"], ["int4", "text", "text"]), row(3, "insert", ["2", "b", "c"]), row(9, "commit", None)], MS.PLACED_SCHEMA), 1)
    assert [tuple(r) for r in m.signals.read().select("seq", "breaking", "unsafe").collect()] == [(2, False, True)]
    assert {r.id for r in m.store.read().collect()} == {"1", "2"}


def test_metrics_have_lags(spark, tmp_path):
    log = changes(spark, 8).withColumn("commit_us", F.lit(1_000_000).cast("long"))
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), lambda r: A.passthrough(r).withColumn("error", F.when(F.col("lsn") < 3, "no")), buckets=2, clock=lambda: 946_684_800_000 + 5_000)
    assert m.metrics().count() == 0
    m.apply(with_commits(log), 0)
    r = m.metrics().first()
    assert (r.lag_ms, r.processed, r.failed, r.requests) == (4_000, 5, 3, 2)


def test_the_mirror_reads_the_files_of_the_log(spark, tmp_path):
    """The stream brings names of files; rows are read off the log by Spark, and aren't written a second time."""
    log, path = with_commits(changes(spark, 60, seed=2)), str(tmp_path / "log")
    L.append_log(log, path, 3)
    seen = []

    class Watched(Mirror):
        def apply(self, rows, batch_id, *stored):
            seen.append((stored, rows.inputFiles()))
            super().apply(rows, batch_id, *stored)

    mirror = Watched(spark, str(tmp_path / "m"), configs(spark), buckets=4)
    mirror.run_log(path, str(tmp_path / "q"), 2)
    assert [s for s, _ in seen] == [(True,), (True,)] and not (tmp_path / "m" / "batch").exists()
    files = [f for _, own in seen for f in own]
    assert len(files) == len(set(files)) == len(list((tmp_path / "log").rglob("*.parquet")))
    assert shown(mirror.store.read()) == expected(log.where("op <> 'commit'").collect())
    assert L.rows_of_files(spark, [], path).count() == 0
