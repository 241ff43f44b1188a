import json
import random
import sys
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemirror.operators import actions as A
from tidemirror.operators import backfill as B
from tidemirror.operators import contract as C
from tidemirror.operators import dlq as D
from tidemirror.operators import metrics as M
from tidemirror.operators import mirror as MR
from tidemirror.operators import state as ST
from tidemirror.sources.changelog import SCHEMA, stream_changes, with_commits
from tidemirror.streaming import buffering
from tidemirror.streaming.buffering import buffer_transactions
from tidemirror.streaming.mirror_stream import PLACED_SCHEMA, Mirror, StateTable

CONFIG = "name string, namespace string, src_schema string, src_table string, id_column string, id_type string, columns array<string>, tombstone_applied_at long"


def configs(spark, *extra):
    return spark.createDataFrame([("c", "ns", "public", "t", "id", "int", None, None), *extra], CONFIG)


def actions(spark, rows):
    return spark.createDataFrame([("c", "ns", lsn, 0, lsn, a, i, d, v, m, None, None) for lsn, a, i, d, v, m in rows], A.ACTION_SCHEMA)


def changes(spark, n, seed=0, start=0):
    rng, rows = random.Random(seed), []
    for k in range(start, start + n):
        i, op = str(rng.randint(1, 25)), rng.choice(["insert", "update", "update", "delete"])
        image = {"id": i, "v": str(k)}
        rows.append((k, k, k // 4, k // 4 * 4 + 3, 0, 1, "public", "t", op, None if op == "delete" else image, image if op == "delete" else None, []))
    return spark.createDataFrame(rows, SCHEMA)


def shown(df):
    return {(r.id, r.document, r.lsn) for r in df.collect()}


def expected(rows):
    state = {}
    for r in sorted(rows, key=lambda r: r.lsn):
        image = r.new or r.old
        state[image["id"]] = None if r.op == "delete" else (image["id"], json.dumps(image, separators=(",", ":")), r.lsn)
    return {v for v in state.values() if v}


def test_last_action_wins_and_merging_twice_changes_nothing(spark):
    a = actions(spark, [(1, "upsert", "1", '{"v":1}', None, None), (2, "delete", "1", None, None, None), (3, "upsert", "2", '{"v":2}', None, None), (4, "skip", "3", None, None, None)])
    m = MR.latest(a)
    assert shown(MR.visible(m)) == {("2", '{"v":2}', 3)} and m.where("deleted").count() == 1
    again = MR.merge(m, a.where("lsn = 1"))  # an older upsert can't bring the document back
    assert shown(MR.visible(again)) == {("2", '{"v":2}', 3)}
    assert MR.drop_markers(m, spark.createDataFrame([("c", 9)], "config string, lsn long")).where("deleted").count() == 0


def test_store_in_batches_equals_one_batch(spark, tmp_path):
    log = changes(spark, 120, seed=1)
    acts = A.passthrough(_routed(spark, log)).persist()
    store = MR.MirrorStore(spark, str(tmp_path / "m"), 4)
    order = list(range(6))
    for n in order:
        assert store.apply(acts.where(F.col("lsn") % 6 == n), n)
    assert not store.apply(acts, 3)  # a batch id that was applied
    assert shown(store.read()) == expected(log.collect())
    assert store.apply(acts.limit(0), 6) and store.manifest()["version"] == 7


def _routed(spark, log):
    from tidemirror.operators.route import routed

    return routed(log, configs(spark))


def test_actions(spark):
    log = changes(spark, 12, seed=2)
    doc = A.passthrough(_routed(spark, log), ["v", "missing"]).where("action = 'upsert'").first().document
    assert set(json.loads(doc)) == {"v", "missing"} and json.loads(doc)["missing"] is None
    part = log.withColumn("unchanged", F.array(F.lit("v"))).withColumn("old", F.create_map(F.lit("id"), F.lit("1"), F.lit("v"), F.lit("before")))
    filled = A.passthrough(_routed(spark, part), fill_unchanged=True).where("action = 'upsert'").first().document
    assert json.loads(filled)["v"] == "before"

    def fine(frame):
        return pd.DataFrame({"action": "upsert", "id": frame["id"], "document": [{"n": len(c)} for c in frame["columns"]], "vector": [[1.0, 2.0]] * len(frame), "distance_metric": "cosine_distance"})

    def short(frame):
        return fine(frame).head(0)

    two = configs(spark, ("d", "nd", "public", "t", "id", "string", None, None))
    from tidemirror.operators.route import routed

    acts = A.transform(routed(log, two), {"c": fine, "d": short})
    assert A.fine(acts).count() == 12 and {r.error for r in A.failed(acts).collect()} == {"ValueError: 0 actions for 12 events"} or A.failed(acts).count() == 12
    script = "import json,sys; print(json.dumps([{'action':'upsert','id':e['id'],'document':{'op':e['operation']}} for e in json.loads(sys.stdin.readline())]))"
    done = A.transform(_routed(spark, log), {"c": A.command([sys.executable, "-c", script])}).collect()
    assert len(done) == 12 and all(r.error is None and "op" in json.loads(r.document) for r in done)
    bad = A.transform(_routed(spark, log), {"c": A.command([sys.executable, "-c", "raise SystemExit(3)"])})
    assert bad.where("error LIKE 'RuntimeError: exit 3%'").count() == 12


def test_external_process_lives_is_started_anew_and_times_out(tmp_path):
    frame = pd.DataFrame({"op": ["insert"], "id": ["1"], "columns": [{"id": "1"}]})
    answer = "print(json.dumps([{'action':'upsert','id':'1','document':{'pid':os.getpid()}}]),flush=True)"
    stays = A.command([sys.executable, "-c", f"import json,os,sys\nfor line in sys.stdin: {answer}"])
    pids = {stays(frame)["document"][0]["pid"] for _ in range(3)}
    assert len(pids) == 1
    once = A.command([sys.executable, "-c", f"import json,os,sys; sys.stdin.readline(); {answer}"])
    assert len({once(frame)["document"][0]["pid"] for _ in range(3)}) == 3
    starts = tmp_path / "starts"
    crash = f"import sys; open({str(starts)!r}, 'a').write('x'); sys.stdin.readline(); print('told', file=sys.stderr); sys.exit(4)"
    with pytest.raises(RuntimeError, match="exit 4: told"):
        A.command([sys.executable, "-c", crash])(frame)
    assert starts.read_text() == "xx"
    slow = f"import sys, time; open({str(starts)!r}, 'a').write('y'); sys.stdin.readline(); time.sleep(60)"
    with pytest.raises(TimeoutError):
        A.command([sys.executable, "-c", slow], timeout_s=1)(frame)
    assert starts.read_text() == "xxy"


def test_action_checks(spark):
    a = actions(spark, [(1, "upsert", "1", "[1]", None, None), (1, "upsert", "2", "{}", [1.0], None), (1, "upsert", "3", "{}", [1.0], "cosine_distance"), (2, "upsert", "4", "{}", None, "cosine_distance"), (2, "upsert", "5", "{}", None, "euclidean_squared"), (2, "upsert", "6", "{}", None, "strange"), (3, "other", "7", None, None, None)])
    assert {r.id: r.error for r in A.checked(a).collect() if r.error} == {"1": "document must be a JSON object", "2": "vector needs a distance metric", "7": "unknown action"}
    assert [r.batch_id for r in A.mixed_batches(a).collect()] == [2] and {r.id for r in A.uniform(a).collect()} == {"1", "2", "3", "7"}
    stats = MR.write_statistics(a).first()
    assert (stats.calls, stats.upserts, stats.deletes, stats.skips) == (3, 6, 0, 0)


def test_distinct_texts_are_embedded_once(spark, tmp_path):
    calls = str(tmp_path)

    def embed(texts):
        import uuid

        open(f"{calls}/{uuid.uuid4().hex}", "w").write("\n".join(texts))
        return [[float(len(t))] for t in texts]

    df = spark.createDataFrame([(i, t) for i, t in enumerate(["aa", "b", "aa", None, ""])], "i int, body string")
    got = {r.i: r.vector[0] for r in A.embed_distinct(df, "body", embed).collect()}
    assert got == {0: 2.0, 1: 1.0, 2: 2.0, 3: 0.0, 4: 0.0}
    cut = A.truncate_tokens(df, "body", 1, tokenizer=lambda texts: [list(t) for t in texts])
    assert {r.i: r.truncated for r in cut.collect()}[0] == "a"


def test_queries_over_a_namespace(spark):
    a = actions(spark, [(i, "upsert", str(i), json.dumps({"w": str(30 - i), "g": "x"}), None, None) for i in range(1, 13)] + [(20, "upsert", "99", "{}", None, None)])
    m = MR.visible(MR.latest(a))
    assert [r.id for r in MR.first_documents(m, "ns", 3, "int").collect()] == ["1", "2", "3"] and [r.id for r in MR.first_documents(m, "ns", 3).collect()] == ["1", "10", "11"]
    assert [r.id for r in MR.rank_by_attribute(m, "ns", "w", 2, ["w"], as_type="int").collect()] == ["12", "11"]
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, [2.0, 0.0])], "id long, vector array<float>")
    q = spark.createDataFrame([(7, [1.0, 0.0])], "query_id long, query array<float>")
    assert [(r.id, r.dist) for r in MR.vector_top_k(v, q, 2, "cosine_distance").orderBy("rank").collect()] == [(1, 0.0), (3, 0.0)]
    assert [(r.id, r.dist) for r in MR.vector_top_k(v, q, 3, "euclidean_squared").orderBy("rank").collect()] == [(1, 0.0), (3, 1.0), (2, 2.0)]
    with pytest.raises(ValueError):
        MR.vector_top_k(v, q, 1, "dot")
    odd = v.unionByName(spark.createDataFrame([(4, None), (5, [None, 1.0]), (6, [1.0]), (0, [2.0, 0.0]), (7, [0.0, 0.0])], "id long, vector array<float>"))
    assert [r.id for r in MR.vector_top_k(odd, q, 9, "cosine_distance").orderBy("rank").collect()] == [0, 1, 3, 2, 7]
    names = v.select(F.concat(F.lit("v"), "id").alias("id"), "vector")
    assert [r.id for r in MR.vector_top_k(names, q, 2, "cosine_distance").orderBy("rank").collect()] == ["v1", "v3"]
    assert MR.vector_top_k(v, q.limit(0), 2, "cosine_distance").count() == 0


def test_backfill(spark):
    source = spark.createDataFrame([(i, f"n{i}") for i in range(1, 6)] + [(None, "x")], "id int, name string")
    snap = B.snapshot_actions(source, "c", "ns", "id", "int", 100, "public", "t")
    later = actions(spark, [(101, "upsert", "1", '{"id":"1","name":"new"}', None, None), (102, "delete", "2", None, None, None), (103, "upsert", "8", "{}", None, None), (99, "upsert", "3", '{"old":1}', None, None)])
    got = {r.id: r.lsn for r in MR.visible(MR.latest(B.handoff(snap, later, 100))).collect()}
    assert got == {"1": 101, "3": 100, "4": 100, "5": 100, "8": 103}
    assert {r.id for r in B.snapshot_actions(source, "c", "ns", "id", "int", 100, "public", "t", after_id="3").collect()} == {"4", "5"}
    first = B.begin(None, "c", 100, 6, 1)
    broken = B.finish(first, 3, "3", 2, "source is away")
    again = B.begin(broken, "c", 500, 6, 3)
    assert broken["status"] == "failed" and again["watermark_lsn"] == 100 and again["last_id"] == "3" and again["started_ms"] == 1
    done = B.finish(again, 6, "5", 4)
    progress = spark.createDataFrame([tuple(done[c.split()[0]] for c in ST.PROGRESS_SCHEMA.split(", "))], ST.PROGRESS_SCHEMA)
    todo = B.needs_backfill(progress, configs(spark, ("d", "nd", "public", "t", "id", "int", None, None)))
    assert [(r.config, r.status) for r in todo.collect()] == [("d", "pending")]


def test_checkpoints(spark):
    cfg = configs(spark, ("d", "nd", "public", "u", "id", "int", None, None))
    cp = spark.createDataFrame([("c", 10, 4, 1)], ST.CHECKPOINT_SCHEMA)
    routed = spark.createDataFrame([("c",), ("c",)], "config string")
    after = {r.config: (r.lsn, r.events_processed) for r in ST.advance(cp, cfg, routed, spark.createDataFrame([(12,), (15,)], "ack_lsn long"), 9).collect()}
    assert after == {"c": (15, 6), "d": (15, 0)}
    assert {r.config: r.lsn for r in ST.advance(cp, cfg, routed.limit(0), spark.createDataFrame([(5,)], "ack_lsn long"), 9).collect()} == {"c": 10, "d": 5}
    assert ST.start_lsn(cp).first().start_lsn == 10
    assert {r.config for r in ST.upsert(cp, spark.createDataFrame([("c", 11, 5, 2), ("e", 1, 1, 1)], ST.CHECKPOINT_SCHEMA), ["config"]).collect()} == {"c", "e"}


def _letters(spark):
    rows = [("1", "c", 1, '{"Int":1}', "update", "e", "retryable", 0, 5, None, None), ("2", "c", 2, '{"Int":2}', "insert", "e", "retryable", 4, 4, None, None), ("3", "c", 3, '{"Int":3}', "delete", "e", "retryable", 0, 3, None, None), ("4", "gone", 4, '{"Int":4}', "update", "e", "retryable", 0, 2, None, None), ("5", "c", 5, "nonsense", "update", "e", "retryable", 0, 1, None, None), ("6", "c", 6, None, None, "e", "permanent", 0, 9, None, 0)]
    return spark.createDataFrame(rows, D.DLQ_SCHEMA)


def test_dead_letters(spark):
    dlq, cfg = _letters(spark), configs(spark)
    assert tuple(D.counts_by_kind(dlq).first()) == (5, 1) and D.counts(dlq, "gone").first().n == 1
    assert [r.dlq_id for r in D.retryable(dlq, cfg, 2).collect()] == ["5", "3"] and [r.dlq_id for r in D.listing(dlq, 2).collect()] == ["6", "1"]
    o = {r.dlq_id: r for r in D.orphans(dlq, cfg).collect()}
    assert {k: r.reason for k, r in o.items()} == {"1": None, "2": None, "3": None, "4": "config no longer exists", "5": "doc_id deserialization failed", "6": "missing doc_id"}
    source = spark.createDataFrame([(1, "a"), (3, "b")], "id int, name string")
    events = {r.dlq_id: (r.replay_op, r.new) for r in D.replay_events(D.orphans(dlq, cfg).where("reason IS NULL"), source, "id").collect()}
    assert events == {"1": ("update", {"id": "1", "name": "a"}), "2": ("delete", None), "3": ("delete", None)}
    results = spark.createDataFrame([("1", True, None, False), ("2", False, "no", False), ("3", False, "no", False), ("4", False, "config no longer exists", True)], "dlq_id string, ok boolean, error string, fatal boolean")
    after = {r.dlq_id: (r.kind, r.retry_count, r.error) for r in D.settle(dlq, results, 5, 77).collect()}
    assert after == {"2": ("permanent", 4, "max retries exhausted: no"), "3": ("retryable", 1, "e"), "4": ("permanent", 0, "config no longer exists"), "5": ("retryable", 0, "e"), "6": ("permanent", 0, "e")}
    assert {r.dlq_id for r in D.purge(dlq, 73 * 3_600_000).collect()} == {"1", "2", "3", "4", "5"}
    passes = []

    def replay(d):
        passes.append(1)
        return d.where("kind = 'retryable'").select("dlq_id", (F.col("dlq_id") == "1").alias("ok"), F.lit("no").alias("error"), F.lit(False).alias("fatal"))

    left = D.drain(dlq, replay, 100, 1)
    assert len(passes) == 3 and left.count() == 5  # one pass with a success, then two without


def test_contract(spark):
    good = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    check = lambda df, **kw: tuple(C.check_source(df, {"name": "c", "id_column": "id", "id_type": "int"} | kw).first())
    assert check(good) == ("c", True, None)
    assert check(good.unionByName(good))[2] == "id is not unique" and check(good.withColumn("id", F.lit(None).cast("int")))[2] == "id is null in some rows"
    assert check(good, id_column="name", id_type="uuid")[2] == "id can't be parsed in some rows"
    gone = spark.createDataFrame([("c", "ns")], "name string, namespace string")
    mirror = MR.latest(actions(spark, [(1, "upsert", "1", "{}", None, None)]))
    kept, states = C.purge_config(mirror, {"dlq": _letters(spark)}, gone)
    assert kept.count() == 0 and states["dlq"].count() == 1 and C.purge_config(kept, states, gone)[1]["dlq"].count() == 1
    tried = C.dry_run(_routed(spark, changes(spark, 1)), A.passthrough).collect()
    assert len(tried) == 1 and tried[0].error is None
    config = {"name": "c", "id_column": "id", "id_type": "int"}
    tried = lambda df, fn: tuple(C.check_source(df, config, transform=fn).first())
    assert tried(good, A.passthrough) == ("c", True, None)
    broken = lambda events: A.passthrough(events).withColumn("error", F.lit("no"))
    assert tried(good, broken) == ("c", False, "transform failed: no") and tried(good.limit(0), broken) == ("c", True, None)


def test_latency_and_observation(spark):
    df = spark.createDataFrame([("a", float(i)) for i in range(1, 101)], "g string, v double")
    r = M.latency_summary(df, "v", ["g"]).first()
    assert (r.n, r.mean, r.p50, r.p95, r.p99, r.p99_9) == (100, 50.5, 51.0, 95.0, 99.0, 100.0)
    rng = np.random.default_rng(3)
    mixed = {"x": np.exp(rng.normal(0, 5, 4000)), "y": np.repeat([1.0, -1e300, 1e300, 0.0], 50), "z": np.array([7.5]), None: np.array([1.0, 2.0])}
    many = spark.createDataFrame([(g, float(v)) for g, vs in mixed.items() for v in vs] + [("x", None)], "g string, v double")
    for m in M.latency_summary(many, "v", ["g"]).collect():
        vs = np.sort(mixed[m.g])
        assert m.n == len(vs) and [m.p50, m.p95, m.p99, m.p99_9] == [vs[int(p * (len(vs) - 1) + 0.5)] for p in (0.5, 0.95, 0.99, 0.999)]
    near = M.latency_summary(df, "v", ["g"], exact=False).first()
    assert abs(near.p95 - r.p95) <= 1
    seen_df, seen = M.observed(changes(spark, 40), "t")
    seen_df.write.format("noop").mode("overwrite").save()
    assert seen.get["events"] == 40 and seen.get["max_lsn"] == 39


def files(log, folder, borders):
    """The log as files cut at the given positions, in their order."""
    edges = [-1, *borders, 10**9]
    for lo, hi in zip(edges, edges[1:], strict=False):
        log.where((F.col("lsn") > lo) & (F.col("lsn") <= hi)).coalesce(1).write.mode("append").parquet(folder)


@pytest.mark.parametrize(("eager", "seed"), [(False, 7), (True, 17)])
def test_stream_in_any_cut_equals_one_batch(spark, tmp_path, eager, seed):
    rng = random.Random(seed)
    log = changes(spark, 80, seed=seed).persist()
    # Cuts inside transactions of four events; the commit comes behind the last of them.
    files(with_commits(log), str(tmp_path / "log"), sorted(rng.sample([i for i in range(80) if i % 4 != 3], 4)))
    stream = lambda: stream_changes(spark, str(tmp_path / "log"), files_per_trigger=1)
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), buckets=4, eager=eager)
    m.run(stream(), str(tmp_path / "q"))
    assert m.passes >= 4 and shown(m.store.read()) == expected(log.collect())
    cp = m.checkpoints.read().first()
    assert (cp.config, cp.lsn) == ("c", 79) and cp.events_processed == 80
    before = m.store.manifest()["version"]
    m.run(stream(), str(tmp_path / "q"))
    assert m.store.manifest()["version"] == before


@pytest.mark.parametrize("eager", [False, True])
def test_open_transactions_wait_and_are_not_checkpointed(spark, tmp_path, eager):
    log = changes(spark, 14, seed=5)
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), buckets=2, eager=eager)
    m.apply(log.where("lsn < 6"), 0)
    assert m.checkpoints.read().first().lsn == 3
    assert {r.lsn for r in m.store.read(markers=True).collect()} <= set(range(6 if eager else 4))
    m.apply(log.where("lsn = 6"), 1)
    m.apply(log.where("lsn > 6"), 2)
    assert m.checkpoints.read().first().lsn == 11
    m.apply(with_commits(log).where("op = 'commit' AND ack_lsn = 15"), 3)
    assert m.checkpoints.read().first().lsn == 15 and shown(m.store.read()) == expected(log.collect())


def test_replays_between_batches_lose_nothing(spark, tmp_path):
    log = changes(spark, 30, seed=6).persist()

    def picky(routed):
        return A.passthrough(routed).withColumn("error", F.when((F.col("id").cast("int") % 5 == 0) & (F.col("seq") >= 0), "no"))

    m = Mirror(spark, str(tmp_path / "m"), configs(spark), picky, buckets=2, clock=lambda: 1)
    rows = with_commits(log)
    source = spark.createDataFrame([(i, "now") for i in range(1, 26)], "id int, v string")
    for n, (lo, hi) in enumerate([(0, 9), (10, 21), (22, 99)]):
        m.apply(rows.where(f"lsn BETWEEN {lo} AND {hi}"), n)
        for _ in range(2):
            m.replay(source, "id")
    assert m.store.manifest()["batch_id"] == 2 and m.dlq.read().count() == 0
    want = {d for d in expected(log.collect()) if int(d[0]) % 5}
    assert {d for d in shown(m.store.read()) if int(d[0]) % 5} == want


@pytest.mark.parametrize("step", ["store", "dlq", "checkpoints", "end"])
def test_crashes_at_every_step(spark, tmp_path, step):
    log = changes(spark, 60, seed=8).persist()
    files(with_commits(log), str(tmp_path / "log"), [17, 37])

    def picky(routed):
        return A.passthrough(routed).withColumn("error", F.when(F.col("id") == "7", "not seven"))

    m = Mirror(spark, str(tmp_path / "m"), configs(spark), picky, buckets=4, clock=lambda: 1)
    place, name = {"store": (m.store, "apply"), "dlq": (m.dlq, "append"), "checkpoints": (m.checkpoints, "write"), "end": (m, "apply")}[step]
    real, calls = getattr(place, name), []

    def crashing(*args):
        done = real(*args)
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return done

    setattr(place, name, crashing)
    with pytest.raises(Exception, match="lost|FOREACH_BATCH|STREAM_FAILED"):
        m.run(stream_changes(spark, str(tmp_path / "log"), files_per_trigger=1), str(tmp_path / "q"))
    setattr(place, name, real)
    m.run(stream_changes(spark, str(tmp_path / "log"), files_per_trigger=1), str(tmp_path / "q"))
    rows = log.collect()
    assert {d for d in shown(m.store.read()) if d[0] != "7"} == {d for d in expected(rows) if d[0] != "7"}
    assert sorted(r.lsn for r in m.dlq.read().collect()) == [r.lsn for r in rows if (r.new or r.old)["id"] == "7"]
    assert m.checkpoints.read().first().lsn == 59


def test_failures_go_to_dead_letters_and_come_back(spark, tmp_path):
    log = changes(spark, 20, seed=9).persist()

    def picky(routed):
        return A.passthrough(routed).withColumn("error", F.when(F.col("id").cast("int") % 2 == 0, "odd only"))

    m = Mirror(spark, str(tmp_path / "m"), configs(spark), picky, buckets=2, clock=lambda: 1)
    m.apply(with_commits(log), 0)
    even = [r for r in log.collect() if int((r.new or r.old)["id"]) % 2 == 0]
    assert m.dlq.read().count() == len(even) > 0
    m.transform = A.passthrough
    source = spark.createDataFrame([(int(i),) for i in {(r.new or r.old)["id"] for r in even}], "id int")
    m.replay(source, "id")
    assert m.dlq.read().count() == 0 and m.replayed == len(even)
    assert {r.id for r in m.store.read().collect()} >= {(r.new or r.old)["id"] for r in even if r.op != "delete"} - {(r.new or r.old)["id"] for r in even if r.op == "delete"}


def test_replay_every_so_many_batches_and_drain_at_the_start(spark, tmp_path):
    log = with_commits(changes(spark, 24, seed=9)).persist()

    def picky(routed):
        return A.passthrough(routed).withColumn("error", F.when((F.col("id").cast("int") % 2 == 0) & (F.col("seq") >= 0), "odd only"))

    source = lambda: spark.createDataFrame([(i,) for i in range(1, 26)], "id int")
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), picky, buckets=2, clock=lambda: 1, source=source, replay_every=2)
    m.apply(log.where("lsn <= 11"), 0)
    left = m.dlq.read().count()
    assert left > 0 and m.replayed == 0
    m.apply(log.where("lsn > 11"), 1)
    assert m.dlq.read().count() == 0 and m.replayed >= left
    n = Mirror(spark, str(tmp_path / "n"), configs(spark), lambda r: A.passthrough(r).withColumn("error", F.lit("never")), buckets=2, clock=lambda: 1, source=source, most_retries=9)
    n.apply(log, 0)
    n.drain()
    assert {r.retry_count for r in n.dlq.read().collect()} == {2}


def test_a_drain_replays_all_dead_letters_in_one_pass(spark, tmp_path, monkeypatch):
    ids, passes = spark.range(1, 10_502, numPartitions=2), []
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), buckets=2, clock=lambda: 1, source=lambda: ids)
    rows = ids.select(F.lit("c").alias("config"), F.col("id").alias("lsn"), F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), F.lit("int").alias("id_type"), F.lit("update").alias("op"), F.lit("e").alias("error"))
    m.dlq.append(D.entries(rows, 1), 0)
    real = m.replay
    monkeypatch.setattr(m, "replay", lambda *args: passes.append(real(*args)) or passes[-1])
    m.drain()
    assert passes == [10_501] and m.dlq.read().isEmpty() and m.store.read().count() == 10_501


def test_ids_that_cannot_be_read_are_permanent_dead_letters(spark, tmp_path):
    log = changes(spark, 8, seed=1).withColumn("new", F.when(F.col("lsn") == 2, F.create_map(F.lit("id"), F.lit("x"))).otherwise(F.col("new"))).withColumn("op", F.when(F.col("lsn") == 2, "insert").otherwise(F.col("op")))
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), buckets=2, clock=lambda: 5)
    m.apply(with_commits(log), 0)
    assert [(r.lsn, r.kind, r.error, r.permanent_ms) for r in m.dlq.read().collect()] == [(2, "permanent", "id can't be parsed", 5)]
    assert m.checkpoints.read().first().events_processed == 7


def test_user_code_runs_once_for_each_event(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()

    def count(frame):
        import uuid

        (calls / uuid.uuid4().hex).write_text(str(len(frame)))
        return pd.DataFrame({"action": "upsert", "id": frame["id"], "document": [{"a": 1}] * len(frame)})

    m = Mirror(spark, str(tmp_path / "m"), configs(spark), lambda r: A.transform(r, {"c": count}), buckets=2)
    log = with_commits(changes(spark, 40, seed=4)).persist()
    m.apply(log.where("lsn <= 21"), 0)
    m.apply(log.where("lsn > 21"), 1)
    assert sum(int(f.read_text()) for f in calls.iterdir()) == 40


def test_mixed_batches_are_refused(spark, tmp_path):
    def mixed(routed):
        return A.passthrough(routed).withColumn("distance_metric", F.when(F.col("lsn") == 5, "euclidean_squared").otherwise("cosine_distance"))

    log = changes(spark, 12, seed=2).withColumn("op", F.lit("insert")).withColumn("new", F.coalesce("new", "old"))
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), mixed, buckets=2)
    m.apply(with_commits(log), 0)
    assert {(r.lsn, r.error) for r in m.dlq.read().collect()} == {(i, "mixed distance metrics in batch") for i in range(4, 8)}


def test_layouts_are_remembered_and_signalled(spark, tmp_path):
    row = lambda lsn, op, cols, types=None: (lsn, lsn, lsn // 4, lsn // 4 * 4 + 3, 0, 1, "public", "t", op, cols, types, [])
    batches = [
        [row(0, "relation", ["id", "v"], ["int4", "text"]), row(1, "insert", ["1", "a"]), row(3, "commit", None)],
        [row(4, "insert", ["2", "b"]), row(7, "commit", None)],
        [row(8, "relation", ["v", "id"], ["text", "int4"]), row(9, "insert", ["c", "3"]), row(10, "delete", None, ["a", "1"]), row(11, "commit", None)],
        [row(12, "relation", ["v", "id", "w"], ["text", "int4", "text"]), row(13, "insert", ["d", "4", "e"]), row(15, "commit", None)],
    ]
    m = Mirror(spark, str(tmp_path / "m"), configs(spark).withColumn("columns", F.array(F.lit("v"))), buckets=2)
    for n, rows in enumerate(batches):
        m.apply(spark.createDataFrame(rows, PLACED_SCHEMA), n)
    assert {(r.id, json.loads(r.document).get("v")) for r in m.store.read().collect()} == {("2", "b"), ("3", "c"), ("4", "d")}
    assert {(r.seq, r.breaking) for r in m.signals.read().collect()} == {(8, False), (12, False)} and m.relations.read().count() == 3


def test_oversized_transactions_are_acknowledged(spark, tmp_path):
    log = with_commits(changes(spark, 8, seed=3).withColumn("xid", F.when(F.col("lsn") < 5, 1).otherwise(2).cast("long")).withColumn("ack_lsn", F.when(F.col("lsn") < 5, 4).otherwise(7).cast("long")))
    m = Mirror(spark, str(tmp_path / "m"), configs(spark), most_events=4, buckets=2)
    m.apply(log.where("lsn < 3"), 0)  # five events over two micro-batches
    m.apply(log.where("lsn >= 3"), 1)
    assert {r.lsn for r in m.store.read(markers=True).collect()} <= {5, 6, 7} and m.checkpoints.read().first().lsn == 7


def test_old_versions_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(MR, "KEPT_VERSIONS", 2)
    store = MR.MirrorStore(spark, str(tmp_path / "m"), 2)
    for n in range(6):
        store.apply(actions(spark, [(n, "upsert", str(i), f'{{"n":{n}}}', None, None) for i in range(n % 2, 20, 2)]), n)
    assert store.read().count() == 20 and len(list((tmp_path / "m").glob("manifest-*.json"))) == 2
    assert sum(1 for _ in (tmp_path / "m").glob("v=*/bucket=*")) <= 6


def test_buffered_transactions(spark, tmp_path):
    schema = "xid long, seq long, payload string, is_commit boolean, ack_lsn long, commit_us long"
    batches = [[(1, 1, "a", False, None, None), (2, 2, "b", False, None, None)], [(1, 3, "c", False, None, None), (1, None, None, True, 10, 5)], [(3, None, None, True, 11, 6)]]
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    q = buffer_transactions(stream).writeStream.format("memory").queryName("buffered").option("checkpointLocation", str(tmp_path / "q")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.xid, r.payload, r.ack_lsn) for r in spark.sql("SELECT * FROM buffered").collect()} == {(1, "a", 10), (1, "c", 10)}
    assert q.lastProgress.stateOperators[0].numRowsTotal <= 3  # only the open transaction has a state


def _buffered(spark, tmp_path, batches, name, timeout=None):
    schema = "xid long, seq long, payload string, is_commit boolean, ack_lsn long, commit_us long"
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    out = buffer_transactions(stream, timeout).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "q"))
    if timeout is None:
        q = out.trigger(availableNow=True).start()
        q.awaitTermination()
    else:  # Spark goes on making batches, so the query is stopped once it has read all
        q = out.start()
        until = time.time() + 60
        while sum(p.numInputRows for p in q.recentProgress) < sum(map(len, batches)) and time.time() < until:
            time.sleep(0.5)
        q.stop()
    return q, [tuple(r) for r in spark.sql(f"SELECT * FROM {name}").collect()]


def test_a_long_transaction_writes_each_row_once(spark, tmp_path, monkeypatch):
    n = 5
    batches = [[(x, 100 * b + i, None if i == 3 else f"{x}-{b}-{i}", False, None, None) for x in (1, 2) for i in (4, 1, 3, 2)] for b in range(n)]
    batches.append([(1, 7, "early", False, None, None), (1, None, None, True, 5000, 9), (1, None, None, True, 5000, 9)])
    q, got = _buffered(spark, tmp_path, batches, "long_ones")
    rows = [r for b in batches for r in b if r[0] == 1 and not r[3]]
    assert got == [(1, r[1], r[2], 5000, 9) for r in sorted(rows, key=lambda r: r[1])]
    updated = [p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.numInputRows]
    assert max(updated[1:n]) <= updated[0] + 2  # a batch adds its own piece of each transaction, whatever came before


def test_late_rows_pass_within_the_timeout(spark, tmp_path):
    batches = [[(1, 1, "a", False, None, None)], [(1, None, None, True, 10, 5)], [(1, 2, "late", False, None, None), (3, 1, "x", False, None, None)]]
    _, got = _buffered(spark, tmp_path, batches, "late_ones", "1 hour")
    assert got == [(1, 1, "a", 10, 5), (1, 2, "late", 10, 5)]


def test_pieces_are_merged_when_they_are_due():
    pieces = {0: ([1, 5, 9], list("abc")), 1: ([2, 5, 6], list("def")), 2: ([20], ["g"])}
    read = []

    def piece(number):
        read.append(number)
        return pieces[number]

    rows = buffering.merged([(20, 2), (2, 1), (1, 0)], piece)
    assert [next(rows) for _ in range(4)] == [(1, "a"), (2, "d"), (5, "b"), (5, "e")] and read == [0, 1]
    assert list(rows) == [(6, "f"), (9, "c"), (20, "g")]


def test_state_table(spark, tmp_path):
    t = StateTable(spark, str(tmp_path / "s"), ST.CHECKPOINT_SCHEMA)
    assert t.read().count() == 0
    t.write(spark.createDataFrame([("c", 1, 1, 1)], ST.CHECKPOINT_SCHEMA))
    t.write(t.read().withColumn("lsn", F.col("lsn") + 1))
    assert t.read().first().lsn == 2


@pytest.mark.parametrize("metric", ["cosine_distance", "euclidean_squared"])
def test_vector_top_k_of_many_queries(spark, metric, monkeypatch):
    monkeypatch.setattr(MR, "VECTOR_ROWS", 60)
    monkeypatch.setattr(MR, "QUERY_ROWS", 33)
    rng = np.random.default_rng(9)
    x = rng.normal(size=(400, 6))
    v = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vector array<double>")
    q = v.where("id % 2 = 0").selectExpr("id AS query_id", "vector AS query")
    got = MR.vector_top_k(v, q, 3, metric, query_bytes=6 * 8 * 70).collect()
    if metric == "cosine_distance":
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        far = 1 - unit @ unit.T
    else:
        far = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    want = {(i, n + 1, int(j)) for i in range(0, 400, 2) for n, j in enumerate(np.argsort(far[i], kind="stable")[:3])}
    assert len(got) == 600 and {(r.query_id, r["rank"], r.id) for r in got} == want


@pytest.mark.parametrize("name", ["vector_topk_cosine_many", "vector_topk_l2_many"])
def test_queries_grow_with_the_vectors(spark, tmp_path, name):
    from tidemirror.plans import catalog

    rows = [(i, [float(i % 97 + 1), float(i % 89), 1.0]) for i in range(320)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = catalog.QUERIES[name](spark, str(tmp_path)).collect()
    assert len(got) == 175 and {r.query_id for r in got} == set(range(0, 320, 50))


def test_whole_transactions_never_reach_the_state(spark, tmp_path, monkeypatch):
    """What begins and ends in one micro-batch is delivered without a row in the state; open ones, and rows without an xid, wait."""
    monkeypatch.setattr(buffering, "BUCKETS", 4)
    big = 2**60
    whole = [row for x in range(40) for row in ((x, 2, f"{x}b", False, None, None), (x, 1, None, False, None, None), (x, None, None, True, big + x, 5))]
    batches = [[*whole, (90, 3, "late", False, None, None), (None, 1, "n", False, None, None)], [(90, 1, "first", False, None, None), (90, None, None, True, big + 90, 6), (None, None, None, True, 7, 7)], [(90, None, None, True, 1, 1)]]
    q, got = _buffered(spark, tmp_path, batches, "whole_ones")
    assert sorted(map(str, got)) == sorted(map(str, [r for x in range(40) for r in ((x, 1, None, big + x, 5), (x, 2, f"{x}b", big + x, 5))] + [(90, 1, "first", big + 90, 6), (90, 3, "late", big + 90, 6), (None, 1, "n", 7, 7)]))
    assert [r[1] for r in got if r[0] == 90] == [1, 3] and all(r[1] == 1 for r in got[:80:2])
    updated = [p.stateOperators[0].numRowsUpdated for p in q.recentProgress if p.numInputRows]
    assert updated[0] <= 4 and q.lastProgress.stateOperators[0].numRowsTotal == 0
