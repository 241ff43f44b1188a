import random
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidemirror.operators import route as R
from tidemirror.operators import transactions as X
from tidemirror.sources import snapshot as SN
from tidemirror.sources import wal as W

CONFIG = "name string, namespace string, src_schema string, src_table string, id_column string, id_type string, columns array<string>, tombstone_applied_at long"


def log(spark, rows):
    return spark.createDataFrame([(i, i, x, "public", t, op, n, o, u) for i, x, t, op, n, o, u in rows], "lsn long, seq long, xid long, src_schema string, src_table string, op string, new map<string,string>, old map<string,string>, unchanged array<string>")


def test_messages(spark):
    rows = [
        W.encode_begin(500, 7, 42), W.encode_relation(9, "public", "users", [("id", True, 23), ("name", False, 25)]), W.encode_change("insert", 9, [1, "a"]), W.encode_change("update", 9, [1, ...], [1, None]), W.encode_change("update", 9, [2, b"\x00\xff"]),
        W.encode_change("delete", 9, None, [1, None]), b"T" + struct.pack(">IBI", 1, 0, 9), W.encode_commit(500, 510, 8), b"M123", b"", None, b"I\x00", b"U" + struct.pack(">I", 9) + b"X", b"R" + struct.pack(">I", 1) + b"abc",
        b"I" + struct.pack(">I", 9) + b"N" + struct.pack(">H", 1) + b"z", b"T" + struct.pack(">IB", 2**31, 0),
    ]
    m = {r.seq: r for r in W.decode(spark.createDataFrame(list(enumerate(rows)), "seq long, data binary")).collect()}
    assert [m[i].tag for i in range(16)] == ["begin", "relation", "insert", "update", "update", "delete", "truncate", "commit", "other"] + ["error"] * 7
    assert (m[0].lsn, m[0].commit_us, m[0].xid, m[7].end_lsn) == (500, 7, 42, 510)
    assert [c["name"] for c in m[1].columns] == ["id", "name"] and m[1].columns[0].key
    assert [c.kind for c in m[3].cols] == ["t", "u"] and m[3].old_cols[1].kind == "n" and m[4].old_cols is None and bytes(m[4].cols[1].bin) == b"\x00\xff"
    assert m[6].relation_ids == [9] and [m[i].error for i in (9, 10, 11)] == ["empty message", "empty message", "need 4 bytes, 1 remaining"]
    assert "unexpected update marker: 0x58" in m[12].error and m[13].error == "unterminated string" and "unexpected column type: 0x7A" in m[14].error
    lines = {r.seq: r.line for r in W.inspection_view(W.decode(spark.createDataFrame(list(enumerate(rows)), "seq long, data binary"))).collect()}
    assert lines[0] == '{"type":"begin","xid":42,"lsn":"0/1F4"}' and '"value":"(unchanged)"' in lines[3] and "(binary: 2 bytes)" in lines[4] and '"table":"public.users"' in lines[5] and '"value":"NULL"' in lines[5]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_any_bytes_give_a_message_or_an_error(data):
    got = W.message(data)
    assert got["tag"] in ("begin", "commit", "relation", "insert", "update", "delete", "truncate", "other", "error")
    assert (got["tag"] == "error") == ("error" in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=8), st.binary(max_size=8)), max_size=6))
def test_tuples_round_trip(values):
    got = W.message(W.encode_change("insert", 5, values))
    assert [c["text"] if c["kind"] == "t" else c["bin"] if c["kind"] == "b" else None for c in got["cols"]] == values


def test_transactions(spark):
    rows = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 9)], "seq long, xid long")
    commits = spark.createDataFrame([(1, 10, 0), (2, 11, 0), (3, 12, 0)], "xid long, ack_lsn long, commit_us long")
    assert {(r.seq, r.ack_lsn) for r in X.assemble(rows, commits).collect()} == {(1, 10), (2, 10), (3, 11)}
    assert {(r.xid, r.n_events) for r in X.transactions(rows, commits).collect()} == {(1, 2), (2, 1), (3, 0)}


@pytest.mark.parametrize("bucket", [2, 3, 100])
def test_transactions_of_a_raw_log(spark, bucket):
    m = [(0, "begin", 1, 0), (1, "insert", None, None), (2, "commit", None, 20), (3, "begin", 2, 0), (4, "insert", None, None), (5, "begin", 3, 0), (6, "update", None, None), (7, "delete", None, None), (40, "commit", None, 30), (41, "insert", None, None), (42, "begin", 4, 0), (43, "insert", None, None)]
    messages = spark.createDataFrame([(s, t, x, e, 0, 7, None) for s, t, x, e in m], "seq long, tag string, xid long, end_lsn long, commit_us long, lsn long, cols string")
    got = {(r.seq, r.xid, r.ack_lsn) for r in X.assemble_stream(messages, bucket).collect()}
    assert got == {(1, 1, 20), (6, 3, 30), (7, 3, 30)}


def test_oversized_boundary(spark):
    rows = spark.createDataFrame([(i, 1) for i in range(5)] + [(i, 2) for i in range(6)], "seq long, xid long")
    kept, report = X.split_oversized(rows, 5)
    assert {r.xid for r in kept.collect()} == {1} and [(r.xid, r.n_events, r.most_events) for r in report.collect()] == [(2, 6, 5)]


def test_sub_batches(spark):
    rows = spark.createDataFrame([(i, 1) for i in range(7)], "seq long, xid long")
    assert [r.chunk_no for r in X.sub_batches(rows, 3).orderBy("seq").collect()] == [0, 0, 0, 1, 1, 1, 2]
    sizes = X.sub_batch_sizes(rows.where("seq < 6"), spark.createDataFrame([(1,), (2,)], "xid long"), 3).orderBy("xid", "chunk_no").collect()
    assert [(r.xid, r.n_events, r.at_commit) for r in sizes] == [(1, 3, False), (1, 3, False), (1, 0, True), (2, 0, True)]


def test_layouts(spark):
    rel = [(1, 1, 7, ["a:1", "b:1"]), (10, 2, 7, ["a:1", "b:1"]), (20, 3, 7, ["a:1", "b:1", "c:1"]), (30, 4, 7, ["a:1", "b:2", "c:1"]), (40, 5, 7, ["b:2"]), (50, 5, 8, ["z:1"])]
    relations = spark.createDataFrame([(s, x, r, "public", "t", [(c[0], int(c[2])) for c in cols]) for s, x, r, cols in rel], "seq long, xid long, relation_id long, src_schema string, src_table string, columns array<struct<name:string,type_oid:long>>")
    events = spark.createDataFrame([(0, 7), (5, 7), (10, 7), (39, 7), (60, 7), (60, 9)], "seq long, relation_id long")
    got = X.with_relation(events, relations.drop("xid")).collect()
    assert {(r.seq, r.relation_id): None if r.columns is None else len(r.columns) for r in got} == {(0, 7): None, (5, 7): 2, (10, 7): 2, (39, 7): 3, (60, 7): 1, (60, 9): None}
    watched = spark.createDataFrame([("public", "t", ["a"])], "src_schema string, src_table string, columns array<string>")
    buffered = spark.createDataFrame([(3, 7, 19), (4, 7, 31)], "xid long, relation_id long, seq long")
    flags = {r.seq: (r.changed, r.breaking, r.unsafe) for r in X.schema_changes(relations, watched, buffered).collect()}
    assert flags == {1: (False,) * 3, 10: (False,) * 3, 20: (True, False, True), 30: (True, False, False), 40: (True, True, True), 50: (False,) * 3}
    assert {r.seq for r in X.schema_changes(relations).where("breaking").collect()} == {20, 30, 40}


def test_many_layouts_are_filled_forward(spark):
    """Rows and layouts meet in one order, not pair by pair (no join), whatever rows have no relation or come before any layout."""
    rng = random.Random(5)
    layouts = [(s, r, f"{r}@{s}") for r in (1, 2) for s in sorted(rng.sample(range(400), 60))] + [(3, None, "none")]
    rows = [(s, rng.choice([1, 2, 9, None])) for s in rng.choices(range(400), k=500)]
    events = spark.createDataFrame(rows, "seq long, relation_id long")
    got = X.with_relation(events, spark.createDataFrame(layouts, "seq int, relation_id int, name string"))
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and got.columns == ["seq", "relation_id", "name"]
    want = [(s, r, max(((a, n) for a, k, n in layouts if k == r and k is not None and a <= s), default=(0, None))[1]) for s, r in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))


def test_routing(spark):
    cfg = spark.createDataFrame([("u", "nu", "public", "t", "id", "int", None, None), ("v", "nv", "public", "t", "name", "string", None, None), ("w", "nw", "public", "other", "id", "int", None, None), ("x", "nx", "public", "t", "id", "int", None, 5)], CONFIG)
    changes = log(spark, [
        (1, 1, "t", "insert", {"id": "1", "name": "a"}, None, []), (2, 1, "t", "update", {"id": "2", "name": None}, {"id": "1", "name": "a"}, []), (3, 1, "t", "delete", None, {"id": " 7 ", "name": "b"}, []), (4, 2, "t", "update", {"id": None, "name": "c"}, None, ["id"]),
        (5, 2, "none", "insert", {"id": "1"}, None, []), (6, 3, "t", "delete", None, None, []), (7, 3, "t", "insert", {"name": "z"}, None, []),
    ])
    live = R.active(cfg)
    assert {(r.config, r.lsn, r.id) for r in R.routed(changes, live).collect()} == {("u", 1, "1"), ("u", 2, "2"), ("v", 1, "a"), ("v", 3, "b"), ("v", 4, "c"), ("v", 7, "z")}
    assert {(r.config, r.lsn): r.problem for r in R.rejected(changes, live).collect()} == {("u", 3): "id can't be parsed", ("u", 4): "id is unchanged", ("u", 6): "no tuple", ("u", 7): "id column missing", ("v", 2): "id is null", ("v", 6): "no tuple"}
    kept = R.skip_applied(R.routed(changes, live), spark.createDataFrame([("u", 1)], "config string, lsn long"))
    assert {(r.config, r.n_events) for r in R.routed_counts(kept).collect()} == {("u", 1), ("v", 4)}
    assert [r["name"] for r in R.tombstoned(cfg).collect()] == ["x"]


def test_snapshots(spark):
    df = spark.createDataFrame([(i, f"n{i}", [i]) for i in range(10)] + [(None, "null id", [])], "id int, name string, tags array<int>")
    assert SN.snapshot(df, "id", ["name"]).columns == ["name", "id"] and dict(SN.snapshot(df, "id").dtypes) == {"id": "string", "name": "string", "tags": "string"}
    for bad in ([], ["name", "name"], ["nope"]):
        with pytest.raises(ValueError):
            SN.snapshot(df, "id", bad)
    pages, cursor = [], None
    while True:
        got = SN.page(df, "id", cursor, 4).collect()
        pages.append([r.id for r in got])
        if not got[-1].has_more:
            break
        cursor = got[-1].id
    assert pages == [[0, 1, 2, 3], [4, 5, 6, 7], [8, 9]]
    with pytest.raises(ValueError):
        SN.page(df, "id", None, 0)
    assert SN.count_with_id(df, "id").first().n == 10 and SN.sample_row(df.limit(0)).count() == 0
    ids = spark.createDataFrame([("3",), ("5",), ("99",)], "id string")
    for bound in (10, 1):
        assert {r.id for r in SN.rows_by_id(df, "id", ids, broadcast_bound=bound).collect()} == {3, 5}
    assert SN.chunks(df, "id", 3).groupBy("chunk").agg(F.count("*").alias("n")).count() == 3


def test_sub_batches_of_a_large_transaction_in_segments(spark):
    from tidemirror.operators import transactions as X

    rows = spark.range(1000).selectExpr("CASE WHEN id < 900 THEN 1 ELSE id END AS xid", "id * 3 AS seq")
    got = {(r.xid, r.seq): r.chunk_no for r in X.sub_batches(rows, 7, segment=50).collect()}
    assert got == {(1 if i < 900 else i, i * 3): i // 7 if i < 900 else 0 for i in range(1000)}


@pytest.mark.parametrize("few", [True, False])
def test_few_layouts_are_looked_up(spark, monkeypatch, few):
    """Rows of few layouts aren't put in order; positions stay whole beside nulls, and either way gives the same."""
    if not few:
        monkeypatch.setattr(X, "SMALL_ROWS", 2)
    big = 2**62
    layouts = [(big, 1, "a"), (big + 1, 1, "b"), (big + 3, 1, "c"), (5, 2, "d"), (None, 2, "none"), (7, None, "none")]
    rows = [(big + i, 1) for i in range(-1, 5)] + [(4, 2), (5, 2), (None, 2), (9, None), (9, 3)]
    got = X.with_relation(spark.createDataFrame(rows, "seq long, relation_id long"), spark.createDataFrame(layouts, "seq long, relation_id long, name string"))
    assert ("Window" in got._jdf.queryExecution().executedPlan().toString()) != few
    want = [(s, r, max(((a, n) for a, k, n in layouts if None not in (a, k, s, r) and k == r and a <= s), default=(0, None))[1]) for s, r in rows]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    none = X.with_relation(spark.createDataFrame(rows, "seq long, relation_id long"), spark.createDataFrame([], "seq long, relation_id long, name string"))
    assert {r.name for r in none.collect()} == {None} and none.count() == len(rows)


def test_a_table_of_one_row_group_is_dealt_before_it_is_worked_on(spark, tmp_path):
    from tidemirror.plans import catalog

    spark.range(1000).selectExpr("id AS event_id", "timestamp_seconds(id) AS ts", "id AS user_id", "'view' AS event_type", "'{}' AS props").coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    for made in (catalog._as_wal(spark, str(tmp_path)), catalog.event_changes(spark, str(tmp_path), deal=True)):
        assert "Exchange hashpartitioning(event_id" in made._jdf.queryExecution().executedPlan().toString()
