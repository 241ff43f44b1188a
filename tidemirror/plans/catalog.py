"""Named queries over the given tables, with the SQL that says the same."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemirror.functions import scalars as S
from tidemirror.operators import actions as A
from tidemirror.operators import backfill as B
from tidemirror.operators import contract as C
from tidemirror.operators import dlq as D
from tidemirror.operators import metrics as M
from tidemirror.operators import mirror as MR
from tidemirror.operators import route as R
from tidemirror.operators import state as ST
from tidemirror.operators import transactions as X
from tidemirror.operators.letters import DeadLetters
from tidemirror.sources import snapshot as SN
from tidemirror.sources import wal as W
from tidemirror.sources.changelog import as_changes, with_commits
from tidemirror.sources.ordered_log import append_log, log_changes, log_end, read_log, routed_tables
from tidemirror.streaming.buffering import OUT, buffer_transactions
from tidemirror.streaming.mirror_stream import Mirror, StateTable

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/mirror-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- change logs over the given tables

EVENT_OP = "CASE event_type WHEN 'signup' THEN 'insert' WHEN 'error' THEN 'delete' ELSE 'update' END"
EV = f"""ev AS (SELECT event_id AS lsn, event_id AS seq, event_id // 10 AS xid, (event_id // 10) * 10 + 9 AS ack_lsn,
  epoch_us(ts) - 946684800000000 AS commit_us, CAST(user_id AS VARCHAR) AS user_id, event_type, json_extract_string(props, '$.k') AS k,
  {EVENT_OP} AS op FROM events)"""
LI = """li AS (SELECT l_orderkey AS lsn, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS seq,
  l_orderkey AS xid, l_orderkey AS ack_lsn, CAST(l_partkey AS VARCHAR) AS id, CAST(l_suppkey AS VARCHAR) AS suppkey, CAST(l_linenumber AS VARCHAR) AS linenumber,
  CASE l_returnflag WHEN 'A' THEN 'insert' WHEN 'N' THEN 'update' ELSE 'delete' END AS op FROM lineitem)"""


def dealt(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt over tasks by a key of many values. A row group is read by one task however large it is, so a table of few
    would have all that follows done by as few tasks."""
    return df.repartition(key)


def event_changes(spark: SparkSession, sf_dir: str, deal: bool = False) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    e = dealt(e, "event_id") if deal else e
    xid = F.floor(F.col("event_id") / 10)
    return as_changes(
        e, lsn=F.col("event_id"), seq=F.col("event_id"), xid=xid, ack_lsn=xid * 10 + 9, commit_us=F.unix_micros(F.col("ts").cast("timestamp")) - S.PG_EPOCH_MICROS, relation_id=1, schema="public", table="events", op=F.expr(EVENT_OP),
        values={"user_id": F.col("user_id"), "event_type": F.col("event_type"), "k": F.get_json_object("props", "$.k")},
    )


def lineitem_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"))
    op = F.when(F.col("l_returnflag") == "A", "insert").when(F.col("l_returnflag") == "N", "update").otherwise("delete")
    rows = li.withColumn("_seq", seq)
    return as_changes(
        rows, lsn=F.col("l_orderkey"), seq=F.col("_seq"), xid=F.col("l_orderkey"), ack_lsn=F.col("l_orderkey"), commit_us=F.unix_micros(F.col("l_shipdate").cast("timestamp")) - S.PG_EPOCH_MICROS, relation_id=2, schema="public", table="lineitem", op=op,
        values={"partkey": F.col("l_partkey"), "suppkey": F.col("l_suppkey"), "linenumber": F.col("l_linenumber")},
    )


CONFIG_SCHEMA = "name string, namespace string, src_schema string, src_table string, id_column string, id_type string, columns array<string>, tombstone_applied_at long"
#: (name, namespace, table, id column, id type, columns, tombstoned)
CONFIG_ROWS = [
    ("users", "users", "events", "user_id", "uint", None, None),
    ("types", "event_types", "events", "event_type", "string", ["event_type", "k"], None),
    ("keys", "event_keys", "events", "k", "int", ["k"], None),
    ("parts", "parts", "lineitem", "partkey", "int", None, None),
    ("suppliers", "suppliers", "lineitem", "suppkey", "uint", ["suppkey", "linenumber"], None),
    ("old_users", "old_users", "events", "user_id", "int", None, 1),
]
CFG = "cfg(name, namespace, src_table, id_column, gone) AS (VALUES " + ", ".join(f"('{n}', '{ns}', '{t}', '{c}', {g is not None})" for n, ns, t, c, _, _, g in CONFIG_ROWS) + ")"


def configs(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(n, ns, "public", t, c, k, cols, gone) for n, ns, t, c, k, cols, gone in CONFIG_ROWS], CONFIG_SCHEMA)


def one(spark: SparkSession, name: str) -> DataFrame:
    return configs(spark).where(F.col("name") == name)


# ---------------------------------------------------------------- sources


@query("SELECT CAST(c_name AS VARCHAR) AS c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment, CAST(c_custkey AS VARCHAR) AS c_custkey FROM customer")
def snapshot_text(spark, sf_dir):
    return SN.snapshot(table(spark, sf_dir, "customer"), "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, true AS has_more FROM (SELECT * FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500) t")
def keyset_page(spark, sf_dir):
    return SN.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey", 1000, 500)


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS ids, min(o_orderkey) AS first_id, max(o_orderkey) AS last_id, true AS even, true AS ordered FROM orders")
def chunked_scan(spark, sf_dir):
    c = SN.chunks(table(spark, sf_dir, "orders"), "o_orderkey", 8)
    per = c.groupBy("chunk").agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("ids"), F.min("o_orderkey").alias("lo"), F.max("o_orderkey").alias("hi"))
    nxt = per.select((F.col("chunk") - 1).alias("chunk"), F.col("lo").alias("next_lo"))
    return per.join(nxt, "chunk", "left").agg(
        F.sum("n").alias("n"), F.sum("ids").alias("ids"), F.min("lo").alias("first_id"), F.max("hi").alias("last_id"), (F.max("n") < 2 * F.min("n")).alias("even"), F.bool_and(F.col("next_lo").isNull() | (F.col("hi") < F.col("next_lo"))).alias("ordered")
    )


@query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_returnflag = 'R')")
def rows_by_id(spark, sf_dir):
    ids = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.col("l_partkey").alias("id"))
    return SN.rows_by_id(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey", ids)


@query("SELECT count(o_orderkey) AS n FROM orders")
def count_with_id(spark, sf_dir):
    return SN.count_with_id(table(spark, sf_dir, "orders"), "o_orderkey")


@query("SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_nationkey AS VARCHAR) AS c_nationkey, c_mktsegment FROM customer ORDER BY customer.c_custkey LIMIT 1")
def sample_row(spark, sf_dir):
    return SN.sample_row(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "c_custkey")


def _as_wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as binary messages: a layout message, then begin, row and commit of every event."""
    e = dealt(table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type"), "event_id")
    e = e.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.col("user_id").cast("string").alias("u"), "event_type")

    number = lambda c, digits: F.unhex(F.lpad(F.hex(c.cast("bigint")), digits, "0"))
    value = lambda c: F.concat(F.lit(b"t"), number(F.octet_length(c), 8), c.cast("binary"))
    i, us = F.col("event_id"), F.col("us") - S.PG_EPOCH_MICROS
    pair, op = F.concat(F.lit(b"\0\2"), value(F.col("u"))), F.col("event_type")
    layout = F.lit(W.encode_relation(1, "public", "events", [("user_id", True, 20), ("event_type", False, 25)]))
    change = (
        F.when(op == "error", F.concat(F.lit(b"D\0\0\0\1O"), pair, F.lit(b"n")))
        .when(op == "signup", F.concat(F.lit(b"I\0\0\0\1N"), pair, value(op)))
        .otherwise(F.concat(F.lit(b"U\0\0\0\1N"), pair, value(op)))
    )
    end = F.when(i % 7 != 0, F.struct((i * 10 + 3).alias("seq"), F.concat(F.lit(b"C\0"), number(i, 16), number(i + 1, 16), number(us, 16)).alias("data"))).otherwise(F.struct((i * 10 + 4).alias("seq"), F.lit(b"I\0").alias("data")))
    messages = F.array(
        F.when(i % 1000 == 0, F.struct((i * 10).alias("seq"), layout.alias("data"))),
        F.struct((i * 10 + 1).alias("seq"), F.concat(F.lit(b"B"), number(i, 16), number(us, 16), number(i, 8)).alias("data")), F.struct((i * 10 + 2).alias("seq"), change.alias("data")), end,
    )
    return e.select(F.explode(messages).alias("m")).where("m IS NOT NULL").select("m.seq", "m.data")


@query(f"""SELECT event_id * 10 + 2 AS seq, {EVENT_OP} AS tag, 1::BIGINT AS relation_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(user_id AS VARCHAR) END AS new_id,
  CASE WHEN event_type = 'error' THEN CAST(user_id AS VARCHAR) END AS old_id, NULL::VARCHAR AS error FROM events
  UNION ALL SELECT event_id * 10 + 4, 'error', NULL, NULL, NULL, 'need 4 bytes, 1 remaining' FROM events WHERE event_id % 7 = 0""")
def wal_decode(spark, sf_dir):
    m = W.decode(_as_wal(spark, sf_dir)).where("tag IN ('insert', 'update', 'delete', 'error')")
    return m.select("seq", "tag", "relation_id", F.try_element_at("cols", F.lit(1))["text"].alias("new_id"), F.try_element_at("old_cols", F.lit(1))["text"].alias("old_id"), "error")


@query("""WITH m AS (SELECT event_id AS i, event_type AS t, CAST(user_id AS VARCHAR) AS u FROM events),
pair AS (SELECT *, '[{"name":"user_id","value":"' || u || '"},{"name":"event_type","value":"' AS head FROM m)
SELECT i * 10 AS seq, 'relation' AS type, '{"type":"relation","table":"public.events","columns":["user_id","event_type"]}' AS line FROM m WHERE i % 1000 = 0
UNION ALL SELECT i * 10 + 1, 'begin', '{"type":"begin","xid":' || i || ',"lsn":"0/' || upper(to_hex(i)) || '"}' FROM m
UNION ALL SELECT i * 10 + 2, 'insert', '{"type":"insert","table":"public.events","new":' || head || t || '"}]}' FROM pair WHERE t = 'signup'
UNION ALL SELECT i * 10 + 2, 'update', '{"type":"update","table":"public.events","new":' || head || t || '"}]}' FROM pair WHERE t NOT IN ('signup', 'error')
UNION ALL SELECT i * 10 + 2, 'delete', '{"type":"delete","table":"public.events","old":' || head || 'NULL"}]}' FROM pair WHERE t = 'error'
UNION ALL SELECT i * 10 + 3, 'commit', '{"type":"commit","lsn":"0/' || upper(to_hex(i + 1)) || '"}' FROM m WHERE i % 7 <> 0
UNION ALL SELECT i * 10 + 4, 'error', '{"type":"error","error":"need 4 bytes, 1 remaining"}' FROM m WHERE i % 7 = 0
UNION ALL SELECT i * 10 + 5, 'truncate', '{"type":"truncate","tables":[1,2]}' FROM m WHERE i % 500 = 1
UNION ALL SELECT i * 10 + 6, 'other', '{"type":"other","tag":77}' FROM m WHERE i % 500 = 2
UNION ALL SELECT i * 10 + 7, 'insert', '{"type":"insert","table":"?","new":[{"name":"?","value":"(unchanged)"},{"name":"?","value":"(binary: 3 bytes)"}]}' FROM m WHERE i % 500 = 3""")
def change_feed_view(spark, sf_dir):
    """Every kind of line: beside the events' messages some truncates, unknown messages and rows of an unknown table."""
    i = F.col("event_id")
    odd = F.when(i % 500 == 1, F.struct((i * 10 + 5).alias("seq"), F.unhex(F.lit("5400000002000000000100000002")).alias("data"))).when(i % 500 == 2, F.struct((i * 10 + 6).alias("seq"), F.lit(b"Mxy").alias("data")))
    odd = odd.when(i % 500 == 3, F.struct((i * 10 + 7).alias("seq"), F.concat(F.lit(b"I"), F.unhex(F.lit("00000009")), F.lit(b"N"), F.unhex(F.lit("0002")), F.lit(b"u"), F.lit(b"b"), F.unhex(F.lit("00000003010203"))).alias("data")))
    more = table(spark, sf_dir, "events").select(odd.alias("m")).where("m IS NOT NULL").select("m.seq", "m.data")
    messages = _as_wal(spark, sf_dir).unionByName(more)
    return W.inspection_view(W.decode(messages), W.layouts(messages))


@query("SELECT event_id * 10 + 2 AS seq, event_id AS xid, event_id + 1 AS ack_lsn FROM events WHERE event_id % 7 <> 0")
def raw_txn_assembly(spark, sf_dir):
    # Without its commit a transaction's begin is followed by another begin, so its rows are not delivered.
    return X.assemble_stream(W.decode(_as_wal(spark, sf_dir))).select("seq", "xid", "ack_lsn")


# ---------------------------------------------------------------- routing and ids


@query(f"""WITH {EV}, {LI}, {CFG}, n AS (SELECT 'events' AS t, count(*) AS n, count(k) AS nk FROM ev UNION ALL SELECT 'lineitem', count(*), 0 FROM li)
SELECT name AS config, CASE name WHEN 'keys' THEN nk ELSE n END AS n_events FROM cfg JOIN n ON src_table = t WHERE NOT gone""")
def route_fanout_counts(spark, sf_dir):
    changes = event_changes(spark, sf_dir).unionByName(lineitem_changes(spark, sf_dir))
    return R.routed_counts(R.routed(changes, R.active(configs(spark))))


BAD_ID = "CASE event_id % 7 WHEN 0 THEN ' ' || user_id WHEN 1 THEN '+' || user_id WHEN 2 THEN '-' || user_id WHEN 3 THEN NULL WHEN 4 THEN 'x' || user_id WHEN 5 THEN '18446744073709551616' ELSE '0' || user_id END"


@query(f"""WITH r AS (SELECT event_id, {BAD_ID} AS t FROM events)
SELECT event_id, CASE WHEN regexp_matches(t, '^\\+?[0-9]+$') AND TRY_CAST(ltrim(t, '+') AS UBIGINT) IS NOT NULL THEN CAST(TRY_CAST(ltrim(t, '+') AS UBIGINT) AS VARCHAR) END AS as_uint,
 CASE WHEN regexp_matches(t, '^[+-]?[0-9]+$') AND TRY_CAST(ltrim(t, '+') AS BIGINT) IS NOT NULL THEN CAST(TRY_CAST(ltrim(t, '+') AS BIGINT) AS VARCHAR) END AS as_int, t AS as_string,
 CASE WHEN t IS NULL THEN 'id is null' WHEN NOT (regexp_matches(t, '^\\+?[0-9]+$') AND TRY_CAST(ltrim(t, '+') AS UBIGINT) IS NOT NULL) THEN 'id can''t be parsed' END AS problem FROM r""")
def extract_id_typed(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("t", F.expr(BAD_ID))
    log = e.select("event_id", "t", F.create_map(F.lit("id"), F.col("t")).alias("new"), F.lit(None).cast("map<string,string>").alias("old"), F.array().cast("array<string>").alias("unchanged"))
    return log.select("event_id", S.parse_id("t", "uint").alias("as_uint"), S.parse_id("t", "int").alias("as_int"), S.parse_id(R.raw_id(F.lit("id")), "string").alias("as_string"), R.id_problem(F.lit("id"), F.lit("uint")).alias("problem"))


@query("""SELECT event_id, '{"Uint":' || user_id || '}' AS tagged, 'uint' AS id_type, CAST(user_id AS VARCHAR) AS id, lower(md5(CAST(user_id AS VARCHAR)))[1:8] || '-' || md5(CAST(user_id AS VARCHAR))[9:12] || '-' || md5(CAST(user_id AS VARCHAR))[13:16] || '-' || md5(CAST(user_id AS VARCHAR))[17:20] || '-' || md5(CAST(user_id AS VARCHAR))[21:32] AS uuid,
 '{"String":"' || event_type || '"}' AS name_tag FROM events""")
def id_forms(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tag = S.id_tag(S.parse_id(F.col("user_id").cast("string"), "uint"), "uint")
    back = S.untag_id(tag)
    return e.select("event_id", tag.alias("tagged"), back["id_type"].alias("id_type"), back["id"].alias("id"), S.parse_id(F.upper(F.md5(F.col("user_id").cast("string"))), "uuid").alias("uuid"), S.id_tag("event_type", "string").alias("name_tag"))


@query(f"""SELECT event_id, CAST(value * 100 AS BIGINT) AS as_int, event_type = 'click' AS as_bool, TRY_CAST(event_type AS DOUBLE) AS as_float, json_extract_string(props, '$.k') AS k,
 CASE WHEN event_id % 2 = 0 THEN 'int' ELSE 'string[]' END AS doc_type, event_id % 2 = 0 AS fits FROM events""")
def type_coercion(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("src", F.when(F.col("event_id") % 2 == 0, "int4").otherwise("text[]"))
    values = F.array(F.round(F.col("value") * 100).cast("bigint").cast("string"), F.when(F.col("event_type") == "click", "t").otherwise("false"), F.col("event_type"), F.col("props"))
    row = S.parse_row([("i", "int"), ("b", "bool"), ("f", "float"), ("j", "json")], values)
    return e.select("event_id", "src", row.alias("r")).select("event_id", F.col("r.i").alias("as_int"), F.col("r.b").alias("as_bool"), F.col("r.f").alias("as_float"), F.try_variant_get("r.j", "$.k", "string").alias("k"), S.doc_type("src").alias("doc_type"), S.id_type_compatible(F.lit("int"), F.col("src")).alias("fits"))


@query("SELECT event_id, upper(to_hex(event_id)) || '/' || upper(to_hex(event_id * 7)) AS lsn, CAST(event_id::HUGEINT * 4294967296 + event_id * 7 AS DECIMAL(20,0)) AS back, CASE event_id % 4 WHEN 0 THEN 'default' WHEN 1 THEN 'nothing' WHEN 2 THEN 'full' ELSE 'index' END AS identity, CASE WHEN event_id % 2 = 0 THEN 'p_ns' ELSE 'ns' END AS namespace, CASE event_id % 3 WHEN 0 THEN 'retryable' WHEN 1 THEN 'permanent' ELSE 'retryable' END AS kind, epoch_us(ts) // 1000 AS ms FROM events")
def scalar_functions(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    text = S.format_lsn(F.shiftleft(i, 32) + i * 7)
    code = F.when(i % 4 == 1, "n").when(i % 4 == 2, "f").when(i % 4 == 3, "i").otherwise("?")
    source = F.when(i % 3 == 2, "http").otherwise("api")
    ms = S.epoch_millis(S.from_epoch_millis(F.unix_millis(F.col("ts").cast("timestamp"))))
    return e.select("event_id", text.alias("lsn"), S.parse_lsn(text).alias("back"), S.replica_identity(code).alias("identity"), S.prefixed_namespace(F.when(i % 2 == 0, "p").otherwise(""), F.lit("ns")).alias("namespace"), S.error_kind(source, F.when(i % 3 == 0, 503).otherwise(404)).alias("kind"), ms.alias("ms"))


@query(f"WITH {EV}, r AS (SELECT *, CASE WHEN lsn % 3 = 0 THEN NULL ELSE user_id END AS id FROM ev) SELECT lsn, 'id is null' AS problem FROM r WHERE id IS NULL")
def null_id_rejects(spark, sf_dir):
    holes = F.when(F.col("lsn") % 3 == 0, F.lit(None).cast("string"))
    hole = lambda c: F.transform_values(c, lambda k, v: F.when((k == "user_id") & (F.col("lsn") % 3 == 0), holes).otherwise(v))
    changes = event_changes(spark, sf_dir).withColumn("new", hole("new")).withColumn("old", hole("old"))
    return R.rejected(changes, one(spark, "users")).select("lsn", "problem")


# ---------------------------------------------------------------- transactions


@query(f"WITH {EV}, last AS (SELECT max(xid) AS x FROM ev) SELECT xid, max(ack_lsn) AS ack_lsn, count(*) AS n_events FROM ev, last WHERE xid <> x GROUP BY xid UNION ALL SELECT -1, -1, 0")
def txn_assembly(spark, sf_dir):
    rows = event_changes(spark, sf_dir)
    last = rows.agg(F.max("xid").alias("x"))
    commits = rows.groupBy("xid").agg(F.max("ack_lsn").alias("ack_lsn"), F.max("commit_us").alias("commit_us")).join(F.broadcast(last), F.col("xid") != F.col("x")).drop("x")
    empty = commits.sparkSession.createDataFrame([(-1, -1, 0)], "xid long, ack_lsn long, commit_us long")
    return X.transactions(rows, commits.unionByName(empty)).select("xid", "ack_lsn", "n_events")


@query("SELECT l_orderkey AS xid, count(*) AS n_events, 6::BIGINT AS most_events FROM lineitem GROUP BY 1 HAVING count(*) > 6")
def oversized_txn(spark, sf_dir):
    return X.split_oversized(lineitem_changes(spark, sf_dir), 6)[1]


@query("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) > 6) GROUP BY 1")
def oversized_kept(spark, sf_dir):
    kept, _ = X.split_oversized(table(spark, sf_dir, "lineitem").withColumn("xid", F.col("l_orderkey")), 6)
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"))


@query(f"WITH {LI} SELECT xid, seq, (seq - 1) // 3 AS chunk_no FROM li")
def sub_batches(spark, sf_dir):
    return X.sub_batches(lineitem_changes(spark, sf_dir), 3).select("xid", F.col("seq"), "chunk_no")


@query("WITH n AS (SELECT l_orderkey AS xid, count(*) AS n FROM lineitem GROUP BY 1) SELECT xid, c AS chunk_no, CASE WHEN c < n // 3 THEN 3 ELSE n % 3 END AS n_events, c = n // 3 AS at_commit FROM n, LATERAL (SELECT unnest(range(0, n // 3 + 1)) AS c) u")
def sub_batch_sizes(spark, sf_dir):
    rows = lineitem_changes(spark, sf_dir)
    return X.sub_batch_sizes(rows, rows.select("xid").distinct(), 3)


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A layout message before every 1000th event: columns change with each, every third adds one, every fourth retypes."""
    marks = table(spark, sf_dir, "events").where("event_id % 1000 = 0").select(F.col("event_id").alias("seq"), F.floor(F.col("event_id") / 10).alias("xid"))
    v = F.floor(F.col("seq") / 1000)
    col = lambda name, oid: F.struct(F.lit(name).alias("name"), oid.cast("long").alias("type_oid"))
    base = F.array(col("user_id", F.lit(20)), col("event_type", F.when(v % 4 == 0, 25).otherwise(1043)))
    columns = F.when(v % 3 == 0, F.concat(base, F.array(col("extra", F.lit(25))))).otherwise(base)
    return marks.select("seq", "xid", F.lit(1).cast("long").alias("relation_id"), F.lit("public").alias("src_schema"), F.lit("events").alias("src_table"), columns.alias("columns"))


REL = "rel AS (SELECT event_id AS seq, event_id // 10 AS xid, event_id // 1000 AS v FROM events WHERE event_id % 1000 = 0)"


@query(f"WITH {REL} SELECT e.event_id AS seq, r.seq AS layout_seq, CASE WHEN r.v % 3 = 0 THEN 3 ELSE 2 END AS n_columns FROM events e ASOF JOIN rel r ON e.event_id >= r.seq")
def relation_asof(spark, sf_dir):
    rel = relations(spark, sf_dir).withColumn("layout_seq", F.col("seq")).drop("src_schema", "src_table", "xid")
    return X.with_relation(event_changes(spark, sf_dir).select("seq", "relation_id"), rel).where("layout_seq IS NOT NULL").select("seq", "layout_seq", F.size("columns").alias("n_columns"))


@query(f"""WITH {REL}, p AS (SELECT *, lag(v) OVER (ORDER BY seq) AS w FROM rel),
c AS (SELECT seq, w IS NOT NULL AND ((v % 3 = 0) <> (w % 3 = 0) OR (v % 4 = 0) <> (w % 4 = 0)) AS changed, w IS NOT NULL AND ((v % 4 = 0) <> (w % 4 = 0)) AS breaking FROM p)
SELECT seq, changed, breaking, breaking AS unsafe FROM c""")
def schema_changes(spark, sf_dir):
    watched = X.watched_columns(configs(spark).where("name = 'types'").withColumn("columns", F.array(F.lit("event_type"))))
    events = event_changes(spark, sf_dir).select("xid", "relation_id", "seq")
    return X.schema_changes(relations(spark, sf_dir), watched, events).select("seq", "changed", "breaking", "unsafe")


@query(f"""WITH {REL}, p AS (SELECT *, lag(v) OVER (ORDER BY seq) AS w FROM rel)
SELECT seq, w IS NOT NULL AND ((v % 3 = 0) <> (w % 3 = 0) OR (v % 4 = 0) <> (w % 4 = 0)) AS unsafe FROM p""")
def schema_changes_in_txn(spark, sf_dir):
    # The layout comes after the first event of its transaction.
    late = relations(spark, sf_dir)
    events = event_changes(spark, sf_dir).select("xid", "relation_id", (F.col("seq") - 1).alias("seq"))
    watched = X.watched_columns(configs(spark).where("name = 'types'").withColumn("columns", F.array(F.lit("user_id"))))
    return X.schema_changes(late, watched, events).select("seq", "unsafe")


# ---------------------------------------------------------------- actions


@query(f"WITH {EV} SELECT lsn, CASE op WHEN 'delete' THEN 'delete' ELSE 'upsert' END AS action, event_type AS id, CASE WHEN op <> 'delete' THEN k END AS k, CASE WHEN op <> 'delete' THEN 2 END AS n_fields FROM ev")
def passthrough_actions(spark, sf_dir):
    acts = A.passthrough(R.routed(event_changes(spark, sf_dir), one(spark, "types")), ["event_type", "k"])
    return acts.select("lsn", "action", "id", F.get_json_object("document", "$.k").alias("k"), F.size(F.json_object_keys("document")).alias("n_fields"))


@query("""SELECT event_id, CASE WHEN props IS NULL THEN '{"b":"' || event_type || '","a":null}' ELSE '{"b":"' || event_type || '","a":"' || user_id || '"}' END AS document, event_type AS second, NULL::VARCHAR AS ninth FROM events""")
def documents_of_arrays(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    values = F.array(F.when(F.col("props").isNotNull(), F.col("user_id").cast("string")), F.col("event_type"))
    picked = A.reindex(values, F.array(F.lit(1), F.lit(0), F.lit(8)))
    return e.select("event_id", S.passthrough_document(F.array(F.lit("b"), F.lit("a")), picked).alias("document"), picked[0].alias("second"), picked[2].alias("ninth"))


def _score(frame):
    import pandas as pd

    return pd.DataFrame({"action": ["delete" if op == "delete" else "skip" if c.get("event_type") == "view" else "upsert" for op, c in zip(frame["op"], frame["columns"], strict=True)], "id": frame["id"], "document": [{"kind": c.get("event_type"), "score": len(c.get("event_type") or "")} for c in frame["columns"]]})


def _broken(frame):
    raise ValueError("no model")


@query(f"""WITH {EV} SELECT 'users' AS config, lsn, CASE WHEN op = 'delete' THEN 'delete' WHEN event_type = 'view' THEN 'skip' ELSE 'upsert' END AS action, CAST(length(event_type) AS VARCHAR) AS score, NULL::VARCHAR AS error FROM ev
UNION ALL SELECT 'types', lsn, 'skip', NULL, 'ValueError: no model' FROM ev""")
def user_transform(spark, sf_dir):
    routed = R.routed(event_changes(spark, sf_dir), configs(spark).where("name IN ('users', 'types')"))
    acts = A.transform(routed, {"users": _score, "types": _broken})
    return acts.select("config", "lsn", "action", F.get_json_object("document", "$.score").alias("score"), "error")


@query(f"""WITH {EV}, c AS (SELECT 'users' AS namespace, count(DISTINCT ack_lsn) AS calls, count(*) FILTER (op <> 'delete' AND event_type <> 'view') AS upserts, count(*) FILTER (op = 'delete') AS deletes, count(*) FILTER (event_type = 'view') AS skips FROM ev) SELECT * FROM c""")
def sink_stats(spark, sf_dir):
    return MR.write_statistics(A.transform(R.routed(event_changes(spark, sf_dir), one(spark, "users")), {"users": _score}))


METRIC = "CASE WHEN vec_id % 40 = 7 THEN 'euclidean_squared' WHEN vec_id % 3 = 0 THEN NULL WHEN vec_id % 5 = 0 THEN 'dot' ELSE 'cosine_distance' END"


@query(f"WITH a AS (SELECT vec_id // 20 AS batch_id, {METRIC} AS m FROM embeddings) SELECT 'vectors' AS namespace, batch_id, count(DISTINCT m) FILTER (m <> 'dot') AS metrics, 'mixed distance metrics in batch' AS problem FROM a GROUP BY batch_id HAVING count(DISTINCT m) FILTER (m <> 'dot') > 1")
def batch_uniformity(spark, sf_dir):
    acts = table(spark, sf_dir, "embeddings").select(F.lit("vectors").alias("namespace"), F.floor(F.col("vec_id") / 20).alias("batch_id"), F.lit("upsert").alias("action"), F.expr(METRIC).alias("distance_metric"), F.lit(None).cast("string").alias("attr_schema"))
    return A.mixed_batches(acts).select("namespace", "batch_id", "metrics", "problem")


@query("SELECT vec_id, CASE vec_id % 4 WHEN 1 THEN 'document must be a JSON object' WHEN 2 THEN 'vector needs a distance metric' END AS problem, 64 AS kept FROM embeddings")
def action_checks(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    document = F.when(F.col("vec_id") % 4 == 1, F.lit("[1]")).otherwise(F.to_json(F.struct("label")))
    metric = F.when(F.col("vec_id") % 4 == 2, F.lit("dot")).otherwise(F.lit("cosine_distance"))
    return v.select("vec_id", S.action_problem(F.lit("upsert"), document, F.col("embedding"), metric).alias("problem"), F.size(S.vector_json("embedding")).alias("kept"))


def _embed(texts):
    import hashlib

    return [[b / 255 for b in hashlib.md5((t or "").encode()).digest()[:8]] for t in texts]


@query("SELECT doc_id, 8 AS dims, round(CAST(('0x' || md5(coalesce(text, ''))[1:2]) AS INTEGER) / 255.0, 4) AS first FROM documents")
def distinct_embed(spark, sf_dir):
    d = A.embed_distinct(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", _embed)
    return d.select("doc_id", F.size("vector").alias("dims"), F.round(F.col("vector")[0].cast("double"), 4).alias("first"))


@query("SELECT doc_id, array_to_string(list_filter(regexp_split_to_array(coalesce(text, ''), '\\s+'), lambda w: w <> '')[1:16], ' ') AS truncated FROM documents")
def truncate_tokens(spark, sf_dir):
    return A.truncate_tokens(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 16).select("doc_id", "truncated")


@query(f"""WITH {EV} SELECT lsn, CASE op WHEN 'delete' THEN 'delete' ELSE 'upsert' END AS action, CASE WHEN op <> 'delete' THEN 'cosine_distance' END AS distance_metric,
 CASE WHEN op <> 'delete' THEN round(CAST(('0x' || md5(event_type)[1:2]) AS INTEGER) / 255.0, 4) END AS first FROM ev""")
def embed_and_upsert(spark, sf_dir):
    acts = A.embed_and_upsert(R.routed(event_changes(spark, sf_dir), one(spark, "users")), "event_type", _embed)
    return acts.select("lsn", "action", "distance_metric", F.round(F.col("vector")[0].cast("double"), 4).alias("first"))


@query(f"WITH {EV} SELECT 'users' AS config, CASE WHEN op = 'delete' THEN 'delete' ELSE 'upsert' END AS action, NULL::VARCHAR AS error FROM ev ORDER BY lsn LIMIT 1")
def dry_run(spark, sf_dir):
    sample = event_changes(spark, sf_dir).orderBy("lsn").limit(1)
    return C.dry_run(R.routed(sample, one(spark, "users")), lambda r: A.transform(r, {"users": _score})).select("config", "action", "error")


# ---------------------------------------------------------------- the mirror

LATEST_EV = f"WITH {EV}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY lsn DESC, seq DESC) AS n FROM ev)"


def events_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    return MR.latest(A.passthrough(R.routed(event_changes(spark, sf_dir), one(spark, "users"))))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change log, three configs, passthrough documents, latest per id, the first documents of a namespace."""
    changes = R.routed(event_changes(spark, sf_dir), configs(spark).where("name IN ('users', 'types', 'keys')"))
    return MR.first_documents(MR.visible(MR.latest(A.passthrough(changes))), "users", 100, "uint").select("namespace", "id", "document", "lsn")


@query(f"{LATEST_EV} SELECT 'users' AS namespace, user_id AS id, event_type, k, lsn FROM r WHERE n = 1 AND op <> 'delete'")
def mirror_latest(spark, sf_dir):
    return MR.visible(events_mirror(spark, sf_dir)).select("namespace", "id", F.get_json_object("document", "$.event_type").alias("event_type"), F.get_json_object("document", "$.k").alias("k"), "lsn")


@query(f"WITH {LI}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC, seq DESC) AS n FROM li) SELECT 'parts' AS namespace, id, suppkey, linenumber, lsn, seq FROM r WHERE n = 1 AND op <> 'delete'")
def mirror_latest_parts(spark, sf_dir):
    m = MR.visible(MR.latest(A.passthrough(R.routed(lineitem_changes(spark, sf_dir), one(spark, "parts")))))
    return m.select("namespace", "id", F.get_json_object("document", "$.suppkey").alias("suppkey"), F.get_json_object("document", "$.linenumber").alias("linenumber"), "lsn", "seq")


@query(ORACLES["mirror_latest"])
def mirror_store(spark, sf_dir):
    """The same through the versioned store, in three batches, one of them twice."""
    store = MR.MirrorStore(spark, shared_folder(spark), 16)
    acts = A.passthrough(R.routed(event_changes(spark, sf_dir), one(spark, "users")))
    for n, part in enumerate((F.col("lsn") % 3 == 0, F.col("lsn") % 3 == 2, F.col("lsn") % 3 == 2, F.col("lsn") % 3 == 1)):
        store.apply(acts.where(part), n - (n > 1))
    return store.read().select("namespace", "id", F.get_json_object("document", "$.event_type").alias("event_type"), F.get_json_object("document", "$.k").alias("k"), "lsn")


@query(f"""WITH {EV}, s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events), c AS (SELECT user_id AS id, op, k, lsn FROM ev WHERE lsn > 5000),
u AS (SELECT id, 'upsert' AS op, NULL AS k, 5000 AS lsn FROM s UNION ALL SELECT id, op, k, lsn FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC) AS n FROM u)
SELECT id, k, lsn FROM r WHERE n = 1 AND op <> 'delete'""")
def backfill_then_cdc(spark, sf_dir):
    source = table(spark, sf_dir, "events").select("user_id").distinct()
    snap = B.snapshot_actions(source, "users", "users", "user_id", "uint", 5000, "public", "events")
    acts = A.passthrough(R.routed(event_changes(spark, sf_dir), one(spark, "users")))
    return MR.visible(MR.latest(B.handoff(snap, acts, 5000))).select("id", F.get_json_object("document", "$.k").alias("k"), "lsn")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, 'upsert' AS action, CAST(o_custkey AS VARCHAR) AS custkey, 77::BIGINT AS lsn FROM orders WHERE o_orderkey > 9000")
def backfill_resume(spark, sf_dir):
    acts = B.snapshot_actions(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "orders", "orders", "o_orderkey", "int", 77, "public", "orders", after_id="9000")
    return acts.select("id", "action", F.get_json_object("document", "$.o_custkey").alias("custkey"), "lsn")


def checkpoints(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("users", 4009, 7, 1), ("types", 999, 5, 1), ("parts", 100, 2, 1)], ST.CHECKPOINT_SCHEMA)


@query(f"""WITH {EV}, cp(config, lsn) AS (VALUES ('users', 4009), ('types', 999)), c(config) AS (VALUES ('users'), ('types'), ('keys'))
SELECT c.config, count(*) AS n_events FROM ev JOIN c ON c.config <> 'keys' OR k IS NOT NULL LEFT JOIN cp ON cp.config = c.config WHERE ack_lsn > coalesce(cp.lsn, -1) GROUP BY 1""")
def checkpoint_skip(spark, sf_dir):
    routed = R.routed(event_changes(spark, sf_dir), configs(spark).where("name IN ('users', 'types', 'keys')"))
    return R.routed_counts(R.skip_applied(routed, checkpoints(spark), "ack_lsn"))


@query(f"""WITH {EV}, cp(config, lsn, n) AS (VALUES ('users', 4009, 7), ('types', 999, 5), ('parts', 100, 2)), c(config) AS (VALUES ('users'), ('types'), ('keys'), ('parts'), ('suppliers')),
e AS (SELECT c.config, count(*) AS n FROM ev JOIN c ON c.config IN ('users', 'types') OR (c.config = 'keys' AND k IS NOT NULL) LEFT JOIN cp ON cp.config = c.config WHERE ack_lsn > coalesce(cp.lsn, -1) GROUP BY 1)
SELECT c.config, greatest((SELECT max(ack_lsn) FROM ev), coalesce(cp.lsn, -1)) AS lsn, coalesce(cp.n, 0) + coalesce(e.n, 0) AS events_processed, 99::BIGINT AS start_lsn FROM c LEFT JOIN cp USING (config) LEFT JOIN e USING (config)""")
def checkpoint_advance(spark, sf_dir):
    changes, live = event_changes(spark, sf_dir), R.active(configs(spark))
    routed = R.skip_applied(R.routed(changes, live), checkpoints(spark), "ack_lsn")
    after = ST.advance(checkpoints(spark), live, routed, changes.select("ack_lsn"), 5)
    progress = spark.createDataFrame([("keys", None, 10, 10, "completed", 1, 2, None, 99)], ST.PROGRESS_SCHEMA)
    return after.select("config", "lsn", "events_processed").crossJoin(F.broadcast(ST.start_lsn(checkpoints(spark), progress)))


@query("SELECT o_orderstatus AS namespace FROM orders WHERE o_orderstatus > 'F' GROUP BY 1 ORDER BY 1 LIMIT 2")
def namespace_list(spark, sf_dir):
    return MR.list_namespaces(orders_mirror(spark, sf_dir), "", "F", 2)


def orders_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderstatus").alias("namespace"), F.col("o_orderkey").cast("string").alias("id"), F.to_json(F.struct("o_custkey", "o_orderpriority")).alias("document"), F.lit(None).cast("array<float>").alias("vector"), F.lit(None).cast("string").alias("distance_metric"), F.lit(1).cast("long").alias("lsn"), F.lit(0).cast("long").alias("seq"), F.lit(False).alias("deleted"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, CAST(o_custkey AS VARCHAR) AS custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderkey LIMIT 10) t")
def namespace_topk(spark, sf_dir):
    return MR.first_documents(orders_mirror(spark, sf_dir), "O", 10, "uint").select("id", F.get_json_object("document", "$.o_custkey").alias("custkey"))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS id, o_orderpriority, CAST(o_custkey AS VARCHAR) AS o_custkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'F' ORDER BY o_custkey DESC, CAST(o_orderkey AS VARCHAR) LIMIT 25) t")
def rank_by_attribute(spark, sf_dir):
    return MR.rank_by_attribute(orders_mirror(spark, sf_dir), "F", "o_custkey", 25, ["o_orderpriority", "o_custkey"], descending=True, as_type="bigint")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and as queries every 50th id, so that their number grows with the table."""
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), F.col("vector").alias("query"))


VECTOR_SQL = """WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT q.id AS query_id, v.id, {dist} AS dist FROM v q, v WHERE q.id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist, id) AS rank FROM d) SELECT query_id, rank::INTEGER AS rank, id, round(dist, 6) AS dist FROM r WHERE rank <= 10"""


@query(VECTOR_SQL.format(dist="1 - list_inner_product(q.v, v.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(v.v, v.v))"))
def vector_topk_cosine(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return MR.vector_top_k(v, q, 10, "cosine_distance").withColumn("dist", F.round("dist", 6))


@query(VECTOR_SQL.format(dist="list_sum(list_transform(list_zip(q.v, v.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"))
def vector_topk_l2(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return MR.vector_top_k(v, q, 10, "euclidean_squared").withColumn("dist", F.round("dist", 6))


MANY_VECTOR_SQL = VECTOR_SQL.replace("rank <= 10", "rank <= 25")


@query(MANY_VECTOR_SQL.format(dist="1 - list_inner_product(q.v, v.v) / sqrt(list_inner_product(q.v, q.v) * list_inner_product(v.v, v.v))"))
def vector_topk_cosine_many(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return MR.vector_top_k(v, q, 25, "cosine_distance").withColumn("dist", F.round("dist", 6))


@query(MANY_VECTOR_SQL.format(dist="list_sum(list_transform(list_zip(q.v, v.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"))
def vector_topk_l2_many(spark, sf_dir):
    v, q = _vectors(spark, sf_dir)
    return MR.vector_top_k(v, q, 25, "euclidean_squared").withColumn("dist", F.round("dist", 6))


@query(f"{LATEST_EV} SELECT user_id AS id, op = 'delete' AS deleted FROM r WHERE n = 1 AND NOT (op = 'delete' AND lsn < 9000)")
def drop_markers(spark, sf_dir):
    low = spark.createDataFrame([("users", 9000, 0, 0), ("keys", 9500, 0, 0)], ST.CHECKPOINT_SCHEMA)
    return MR.drop_markers(events_mirror(spark, sf_dir), low).select("id", "deleted")


# ---------------------------------------------------------------- dead letters

DLQ_SQL = f"""{EV}, dlq AS (SELECT 'users-' || lsn || '-' || seq AS dlq_id, CASE WHEN lsn % 11 = 0 THEN 'gone' ELSE 'users' END AS config, lsn, CASE WHEN lsn % 13 = 0 THEN NULL ELSE '{{"Uint":' || user_id || '}}' END AS doc_id, user_id AS id,
 CASE WHEN lsn % 17 = 0 THEN NULL WHEN lsn % 2 = 0 THEN 'update' ELSE 'delete' END AS op, CASE WHEN lsn % 5 = 0 THEN 'permanent' ELSE 'retryable' END AS kind, CAST(lsn % 4 AS INTEGER) AS retry_count, lsn * 1000 AS created_ms,
 CASE WHEN lsn % 5 = 0 THEN lsn * 100000 END AS permanent_ms FROM ev WHERE event_type = 'error')"""


def dead_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = event_changes(spark, sf_dir).where("op = 'delete'")
    routed = R.routed(bad, one(spark, "users")).withColumn("error", F.lit("store is away"))
    d = D.entries(routed, 0)
    i = F.col("lsn")
    permanent = i % 5 == 0
    return d.withColumns({
        "config": F.when(i % 11 == 0, "gone").otherwise(F.col("config")), "doc_id": F.when(i % 13 != 0, F.col("doc_id")), "op": F.when(i % 17 == 0, F.lit(None).cast("string")).when(i % 2 == 0, "update").otherwise("delete"),
        "kind": F.when(permanent, "permanent").otherwise("retryable"), "retry_count": (i % 4).cast("int"), "created_ms": i * 1000, "permanent_ms": F.when(permanent, i * 100000),
    })


@query(f"WITH {DLQ_SQL} SELECT count(*) FILTER (kind = 'retryable') AS retryable, count(*) FILTER (kind = 'permanent') AS permanent, count(*) AS n FROM dlq")
def dlq_counts(spark, sf_dir):
    d = dead_letters(spark, sf_dir)
    return D.counts_by_kind(d).crossJoin(D.counts(d))


@query(f"WITH {DLQ_SQL} SELECT dlq_id, created_ms FROM dlq WHERE config = 'users' ORDER BY created_ms DESC, dlq_id DESC LIMIT 20")
def dlq_list(spark, sf_dir):
    return D.listing(dead_letters(spark, sf_dir), 20, "users").select("dlq_id", "created_ms")


@query(f"WITH {DLQ_SQL} SELECT dlq_id, doc_id, op FROM dlq WHERE kind = 'retryable' AND config = 'users' ORDER BY created_ms, dlq_id LIMIT 50")
def dlq_retryable(spark, sf_dir):
    return D.retryable(dead_letters(spark, sf_dir), configs(spark), 50).select("dlq_id", "doc_id", "op")


@query(f"WITH {DLQ_SQL} SELECT dlq_id, CASE WHEN config = 'gone' THEN 'config no longer exists' WHEN doc_id IS NULL THEN 'missing doc_id' WHEN op IS NULL THEN 'missing operation (legacy entry)' END AS reason FROM dlq")
def dlq_orphans(spark, sf_dir):
    return D.orphans(dead_letters(spark, sf_dir), R.active(configs(spark))).select("dlq_id", "reason")


@query(f"""WITH {DLQ_SQL}, s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events WHERE user_id % 2 = 0)
SELECT dlq_id, CASE WHEN op = 'delete' OR s.id IS NULL THEN 'delete' ELSE op END AS replay_op, CASE WHEN op <> 'delete' THEN s.id END AS new_id FROM dlq LEFT JOIN s ON s.id = dlq.id WHERE config = 'users' AND doc_id IS NOT NULL AND op IS NOT NULL""")
def dlq_replay(spark, sf_dir):
    sound = D.orphans(dead_letters(spark, sf_dir), R.active(configs(spark))).where("reason IS NULL")
    source = table(spark, sf_dir, "events").where("user_id % 2 = 0").select("user_id").distinct()
    return D.replay_events(sound, source, "user_id").select("dlq_id", "replay_op", F.try_element_at("new", F.lit("user_id")).alias("new_id"))


@query(f"""WITH {DLQ_SQL}, f AS (SELECT *, lsn % 3 = 0 AS ok, lsn % 3 = 1 AS bad, lsn % 7 = 0 AS fatal FROM dlq)
SELECT dlq_id, CASE WHEN bad AND fatal THEN 'no row' WHEN bad AND retry_count + 1 >= 3 THEN 'max retries exhausted: no row' ELSE 'store is away' END AS error, CASE WHEN bad AND (fatal OR retry_count + 1 >= 3) THEN 'permanent' ELSE kind END AS kind,
 CASE WHEN bad AND NOT (fatal OR retry_count + 1 >= 3) THEN retry_count + 1 ELSE retry_count END AS retry_count FROM f WHERE NOT ok""")
def dlq_retry_accounting(spark, sf_dir):
    d = dead_letters(spark, sf_dir)
    results = d.where("lsn % 3 < 2").select("dlq_id", (F.col("lsn") % 3 == 0).alias("ok"), F.lit("no row").alias("error"), (F.col("lsn") % 7 == 0).alias("fatal"))
    return D.settle(d, results, 3, 9).select("dlq_id", "error", "kind", "retry_count")


@query(f"WITH {DLQ_SQL} SELECT dlq_id FROM dlq WHERE NOT (kind = 'permanent' AND permanent_ms < 600000000 - 72 * 3600000)")
def dlq_purge(spark, sf_dir):
    return D.purge(dead_letters(spark, sf_dir), 600_000_000).select("dlq_id")


# ---------------------------------------------------------------- contracts, purges, metrics


@query("""SELECT 'orders' AS config, true AS ok, NULL::VARCHAR AS problem UNION ALL SELECT 'lines', false, 'id is not unique' UNION ALL SELECT 'names', false, 'id type ''int'' doesn''t fit column type ''text''' UNION ALL SELECT 'none', false, 'id column ''nope'' not found'
UNION ALL SELECT 'cols', false, 'columns not found: x' UNION ALL SELECT 'stale', false, 'declared columns are stale'""")
def source_contract(spark, sf_dir):
    t = lambda n: table(spark, sf_dir, n)
    reports = [
        C.check_source(t("orders"), {"name": "orders", "id_column": "o_orderkey", "id_type": "uint"}),
        C.check_source(t("lineitem"), {"name": "lines", "id_column": "l_orderkey", "id_type": "int"}),
        C.check_source(t("customer"), {"name": "names", "id_column": "c_name", "id_type": "int"}),
        C.check_source(t("customer"), {"name": "none", "id_column": "nope", "id_type": "int"}),
        C.check_source(t("customer"), {"name": "cols", "id_column": "c_custkey", "id_type": "int", "columns": ["c_name", "x"]}),
        C.check_source(t("part"), {"name": "stale", "id_column": "p_partkey", "id_type": "int"}, declared=[("p_partkey", "int8")]),
    ]
    out = reports[0]
    for r in reports[1:]:
        out = out.unionByName(r)
    return out


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1")
def duplicate_ids(spark, sf_dir):
    return C.duplicate_ids(table(spark, sf_dir, "lineitem"), "l_orderkey")


@query("SELECT o_orderkey AS place, o_orderpriority AS declared_name, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderpriority || CASE WHEN o_orderkey % 7 = 0 THEN '!' ELSE '' END END AS actual_name FROM orders WHERE o_orderkey % 11 = 0 OR o_orderkey % 7 = 0")
def column_differences(spark, sf_dir):
    """Orders as a long list of columns; in the actual list some have another name and some are gone."""
    declared = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("place"), F.col("o_orderpriority").alias("name"), F.col("o_orderstatus").alias("type"))
    actual = declared.where("place % 11 <> 0").withColumn("name", F.concat("name", F.when(F.col("place") % 7 == 0, "!").otherwise("")))
    return C.column_differences(declared, actual).select("place", "declared_name", "actual_name")


@query(f"WITH {DLQ_SQL} SELECT 'mirror' AS part, (SELECT count(*) FROM orders WHERE o_orderstatus <> 'F') AS n UNION ALL SELECT 'dlq', (SELECT count(*) FROM dlq WHERE config <> 'users') UNION ALL SELECT 'namespace', (SELECT count(*) FROM orders WHERE o_orderstatus <> 'O')")
def purge_config(spark, sf_dir):
    gone = spark.createDataFrame([("users", "F")], "name string, namespace string")
    mirror, states = C.purge_config(orders_mirror(spark, sf_dir), {"dlq": dead_letters(spark, sf_dir)}, gone)
    count = lambda df, part: df.agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "n")
    return count(mirror, "mirror").unionByName(count(states["dlq"], "dlq")).unionByName(count(MR.delete_namespace(orders_mirror(spark, sf_dir), "O"), "namespace"))


@query("""WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
SELECT event_type, max(n) AS n, round(avg(value), 6) AS mean, max(value) FILTER (i = round(0.5 * (n - 1))) AS p50, max(value) FILTER (i = round(0.95 * (n - 1))) AS p95, max(value) FILTER (i = round(0.99 * (n - 1))) AS p99, max(value) FILTER (i = round(0.999 * (n - 1))) AS p99_9 FROM r GROUP BY 1""")
def latency_summary(spark, sf_dir):
    return M.latency_summary(table(spark, sf_dir, "events"), "value", ["event_type"]).withColumn("mean", F.round("mean", 6))


@query(f"WITH {EV} SELECT xid, (1800000000000000 - (max(commit_us) + 946684800000000)) / 1000.0::DOUBLE AS lag_ms FROM ev GROUP BY xid")
def replication_lag(spark, sf_dir):
    txns = event_changes(spark, sf_dir).groupBy("xid").agg(F.max("commit_us").alias("commit_us"))
    return M.replication_lag(txns, F.lit(1_800_000_000_000_000)).select("xid", "lag_ms")


@query(f"WITH {EV}, {DLQ_SQL.split(', dlq AS', 1)[0].replace(EV, 'x1 AS (SELECT 1)')} SELECT count(*) AS processed, 0::BIGINT AS failed, count(DISTINCT ack_lsn) AS requests, count(DISTINCT xid) AS acks, count(*) FILTER (event_type = 'error') AS dlq_size, count(*) FILTER (event_type = 'error' AND lsn % 3 = 0) AS replayed, count(*) FILTER (event_type = 'error' AND lsn % 3 <> 0) AS replay_failed, (SELECT count(*) FROM orders) AS backfill_rows FROM ev")
def pipeline_metrics(spark, sf_dir):
    changes = event_changes(spark, sf_dir)
    acts = A.passthrough(R.routed(changes, one(spark, "users")))
    letters = dead_letters(spark, sf_dir)
    replays = letters.select((F.col("lsn") % 3 == 0).alias("ok"))
    progress = table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count("*").alias("processed_rows"))
    return M.pipeline_metrics(acts, letters, changes.select("xid").distinct(), replays, progress)


# ---------------------------------------------------------------- streams


def _mirrored(spark: SparkSession, log: DataFrame, **options) -> Mirror:
    """A mirror of the users config, fed by a log of ordered segments that is read in micro-batches. The segments' borders fall
    where they like, so transactions are cut by them."""
    folder = shared_folder(spark)
    append_log(log, f"{folder}/log", 5)
    mirror = Mirror(spark, f"{folder}/m", options.pop("configs", one(spark, "users")), buckets=8, **options)
    mirror.run_log(f"{folder}/log", f"{folder}/q", 2, schema=log.schema)
    return mirror


class Unfinished(RuntimeError):
    """What a query set out to do wasn't done, so it has no result."""


def _shown(mirror: Mirror) -> DataFrame:
    """The documents, and on each row how many events the checkpoints count. A mirror that didn't come to the end of the log beside
    it, or that left events as dead letters to be replayed, isn't shown: its documents would look like a result."""
    end = log_end(mirror.spark, f"{mirror.path.rsplit('/', 1)[0]}/log")
    done = mirror.checkpoints.read().agg(F.min("lsn")).first()[0]
    if end is not None and done != end[0]:  # a commit is the last row of each log
        raise Unfinished(f"the mirror has done the log up to {done}, which ends at {end[0]}")
    if not D.retryable(mirror.dlq.read(), mirror.configs).isEmpty():
        raise Unfinished("events failed and wait as dead letters")
    rows = mirror.store.read().select("namespace", "id", F.get_json_object("document", "$.event_type").alias("event_type"), F.get_json_object("document", "$.k").alias("k"), "lsn")
    return rows.crossJoin(F.broadcast(mirror.checkpoints.read().agg(F.sum("events_processed").alias("events_processed"))))  # one row


STREAM_SQL = ORACLES["mirror_latest"].replace(", lsn FROM r", ", lsn, (SELECT count(*) FROM ev) AS events_processed FROM r")


@query(STREAM_SQL)
def stream_mirror(spark, sf_dir):
    """Events as files, read by a stream in micro-batches into the versioned mirror."""
    return _shown(_mirrored(spark, with_commits(event_changes(spark, sf_dir, deal=True))))


@query(STREAM_SQL)
def stream_mirror_cuts(spark, sf_dir):
    """Transactions of 70 events, so that all borders of micro-batches fall inside one; the log's last is closed by its commit."""
    log = event_changes(spark, sf_dir, deal=True).withColumn("xid", F.floor(F.col("lsn") / 70)).withColumn("ack_lsn", F.col("xid") * 70 + 69)
    return _shown(_mirrored(spark, with_commits(log)))


@query(STREAM_SQL)
def stream_mirror_eager(spark, sf_dir):
    """One transaction of all events, applied before its commit in parts."""
    log = event_changes(spark, sf_dir, deal=True)
    top = log.agg(F.max("lsn").alias("_top"))
    whole = log.crossJoin(F.broadcast(top)).withColumns({"xid": F.lit(1).cast("long"), "ack_lsn": F.col("_top")}).drop("_top")
    return _shown(_mirrored(spark, with_commits(whole), eager=True))


@query(f"WITH {EV} SELECT 'users' AS config, max(ack_lsn) AS lsn, count(*) FILTER (xid % 100 <> 7) AS events_processed, 0::BIGINT AS dead_letters FROM ev")
def stream_oversized(spark, sf_dir):
    """Every hundredth transaction has one event too many, spread over micro-batches or not: it is dropped and acknowledged."""
    log = event_changes(spark, sf_dir, deal=True)
    more = log.where(F.col("xid") % 100 == 7).withColumn("seq", F.col("seq") + F.lit(2**40))
    mirror = _mirrored(spark, with_commits(log.unionByName(more)), most_events=10)
    return mirror.checkpoints.read().select("config", "lsn", "events_processed").crossJoin(mirror.dlq.read().agg(F.count("*").alias("dead_letters")))


@query(STREAM_SQL)
def stream_layouts(spark, sf_dir):
    """Rows by place: a layout row before every 1000th event turns the columns round, and is remembered across micro-batches."""
    log = event_changes(spark, sf_dir, deal=True)
    turned = F.floor(F.col("lsn") / 1000) % 2 == 1
    names, values = [F.lit(c) for c in ("user_id", "event_type", "k")], F.coalesce("new", "old")
    placed = F.when(turned, F.array(*[F.try_element_at(values, c) for c in names[::-1]])).otherwise(F.array(*[F.try_element_at(values, c) for c in names]))
    gone, none = F.col("op") == "delete", F.lit(None).cast("array<string>")
    base = ["lsn", "seq", "xid", "ack_lsn", "commit_us", "relation_id", "src_schema", "src_table"]
    rows = log.select(*base, "op", F.when(~gone, placed).alias("cols"), F.when(gone, placed).otherwise(none).alias("old_cols"), "unchanged").withColumn("seq", F.col("seq") * 2)
    layouts = log.where("lsn % 1000 = 0").select(*base, F.lit("relation").alias("op"), F.when(turned, F.array(*names[::-1])).otherwise(F.array(*names)).alias("cols"), F.array(*[F.lit("text")] * 3).alias("old_cols"), "unchanged").withColumn("seq", F.col("seq") * 2 - 1)
    commits = with_commits(log).where("op = 'commit'").select(*base, "op", none.alias("cols"), none.alias("old_cols"), "unchanged")
    return _shown(_mirrored(spark, rows.unionByName(layouts).unionByName(commits)))


def _two_tables(spark, sf_dir):
    """Transactions that hold each event twice: as a row of the routed table and of one that no config routes."""
    log = event_changes(spark, sf_dir, deal=True)
    return with_commits(log.unionByName(log.withColumns({"src_table": F.lit("unrouted"), "seq": F.col("seq") + F.lit(2**40)})))


@query(STREAM_SQL)
def stream_routed_tables(spark, sf_dir):
    """A log of two tables, whose stream opens the files of the routed one only."""
    folder = shared_folder(spark)
    append_log(_two_tables(spark, sf_dir), f"{folder}/log", 3)
    mirror = Mirror(spark, f"{folder}/m", one(spark, "users"), buckets=8)
    mirror.run_log(f"{folder}/log", f"{folder}/q", routed_only=True)
    return _shown(mirror)


@query(f"WITH {EV} SELECT 'events' AS src_table, op, count(*) AS n, min(lsn) AS first_lsn FROM ev WHERE ack_lsn > 999 GROUP BY op")
def pruned_log(spark, sf_dir):
    """The log as a table from a position on: other tables and segments that end before are pruned by their folders."""
    path = f"{shared_folder(spark)}/log"
    append_log(_two_tables(spark, sf_dir), path, 4)
    rows = log_changes(spark, path, routed_tables(R.active(one(spark, "users"))), (999, 2**62))
    return rows.where("op <> 'commit'").groupBy("src_table", "op").agg(F.count("*").alias("n"), F.min("lsn").alias("first_lsn"))


@query(STREAM_SQL)
def stream_late_segments(spark, sf_dir):
    """The log's segments come in an order of their own: the last ones first, one in the middle at the very end. Nothing behind a
    segment that is missing is read before it is there."""
    folder = shared_folder(spark)
    append_log(with_commits(event_changes(spark, sf_dir, deal=True)), f"{folder}/all", 6)
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(n for n in (s.getPath().getName() for s in fs.listStatus(place(f"{folder}/all"))) if n.startswith("segment="))
    fs.mkdirs(place(f"{folder}/log"))
    mirror = Mirror(spark, f"{folder}/m", one(spark, "users"), buckets=8)
    for wave in (names[4:] + names[:1], names[1:2], names[3:4], names[2:3]):
        for n in wave:
            if not fs.rename(place(f"{folder}/all/{n}"), place(f"{folder}/log/{n}")):
                raise Unfinished(f"{n} didn't come to the log")
        mirror.run_log(f"{folder}/log", f"{folder}/q", on_gap="wait")
    return _shown(mirror)


@query(STREAM_SQL)
def stream_restart(spark, sf_dir):
    """The driver is lost three times behind a step of a micro-batch: behind the mirror's new version, the checkpoints, and the whole
    batch before Spark has noted it. Each time the query starts anew and runs that batch again. Any other failure is one."""
    folder, lost = shared_folder(spark), []
    append_log(with_commits(event_changes(spark, sf_dir, deal=True)), f"{folder}/log", 4)
    losses = [(lambda m: m.store, "apply"), (lambda m: m.checkpoints, "write"), (lambda m: m, "apply")]
    for place, name in (*losses, (None, None)):
        mirror, before = Mirror(spark, f"{folder}/m", one(spark, "users"), buckets=8), len(lost)
        if place is not None:
            step, real = place(mirror), getattr(place(mirror), name)

            def losing(*args, real=real, name=name):
                real(*args)
                lost.append(name)
                raise RuntimeError("the driver is lost")

            setattr(step, name, losing)
        try:
            mirror.run_log(f"{folder}/log", f"{folder}/q", 1)
        except StreamingQueryException:
            if len(lost) == before:
                raise
    if len(lost) < len(losses) and log_end(spark, f"{folder}/log") is not None:
        raise Unfinished(f"the driver was lost behind {lost} only")
    return _shown(mirror)


@query(f"WITH {EV} SELECT count(*) AS events, count(DISTINCT xid) AS transactions, count(*) AS processed, 0::BIGINT AS failed, 0::BIGINT AS late, max(ack_lsn) AS done, (1800000000000000 - (max(commit_us) + 946684800000000)) // 1000 AS lag_ms, 3::BIGINT AS batches FROM ev")
def stream_metrics(spark, sf_dir):
    """What the mirror notes for each micro-batch, summed up; the lag is that of the last one."""
    m = _mirrored(spark, with_commits(event_changes(spark, sf_dir, deal=True)), clock=lambda: 1_800_000_000_000).metrics()
    return m.agg(*[F.sum(c).alias(c) for c in ("events", "transactions", "processed", "failed", "late")], F.max("done").alias("done"), F.max_by("lag_ms", "batch_id").alias("lag_ms"), F.count("*").alias("batches"))


@query(f"WITH {EV} SELECT 'users' AS config, max(ack_lsn) AS lsn, count(*) AS events_processed, 0::BIGINT AS dead_letters FROM (SELECT *, lsn % 400 AS p FROM ev) x")
def stream_eager_limit(spark, sf_dir):
    """Transactions of 400 events over micro-batches, eager and with a limit of 10: a limit can't drop what was applied in parts,
    so it doesn't hold, and every event is applied and counted."""
    log = event_changes(spark, sf_dir, deal=True).withColumn("xid", F.floor(F.col("lsn") / 400)).withColumn("ack_lsn", F.least(F.col("xid") * 400 + 399, F.lit(10**15)))
    top = log.agg(F.max("lsn").alias("_top"))
    log = log.crossJoin(F.broadcast(top)).withColumn("ack_lsn", F.least("ack_lsn", F.floor(F.col("_top") / 10) * 10 + 9)).drop("_top")
    mirror = _mirrored(spark, with_commits(log), most_events=10, eager=True)
    return mirror.checkpoints.read().select("config", "lsn", "events_processed").crossJoin(mirror.dlq.read().agg(F.count("*").alias("dead_letters")))


def _not_now(routed: DataFrame) -> DataFrame:
    """A transform that fails for every fifth user, but not when a dead letter is replayed."""
    return A.passthrough(routed).withColumn("error", F.when((F.col("id").cast("long") % 5 == 0) & (F.col("seq") >= 0), "not now"))


@query(f"WITH {EV} SELECT 0::BIGINT AS dead_letters, count(*) FILTER (CAST(user_id AS BIGINT) % 5 = 0) AS replayed, 0::BIGINT AS replay_failed, count(*) FILTER (CAST(user_id AS BIGINT) % 5 <> 0) AS events_processed FROM ev")
def stream_replay(spark, sf_dir):
    """Dead letters are replayed behind every second micro-batch, and drained at the end."""
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    mirror = _mirrored(spark, with_commits(event_changes(spark, sf_dir, deal=True)), transform=_not_now, source=lambda: users, id_column="user_id", replay_every=2)
    mirror.drain()
    counts = spark.createDataFrame([(mirror.replayed, mirror.replay_failed)], "replayed long, replay_failed long")
    return mirror.dlq.read().agg(F.count("*").alias("dead_letters")).crossJoin(counts).crossJoin(mirror.checkpoints.read().select("events_processed"))


@query(f"WITH {DLQ_SQL}, f AS (SELECT * FROM dlq WHERE NOT (lsn % 3 = 0) AND NOT (kind = 'permanent' AND permanent_ms < 600000000 - 72 * 3600000)) SELECT dlq_id, kind, CASE WHEN lsn % 3 = 1 AND kind = 'retryable' AND retry_count + 1 < 3 THEN retry_count + 1 ELSE retry_count END AS retry_count FROM f WHERE lsn % 3 = 2 UNION ALL SELECT dlq_id, CASE WHEN retry_count + 1 >= 3 THEN 'permanent' ELSE kind END, CASE WHEN retry_count + 1 >= 3 THEN retry_count ELSE retry_count + 1 END FROM f WHERE lsn % 3 = 1")
def dead_letter_log(spark, sf_dir):
    """Entries of four micro-batches (one of them written twice), then outcomes of a replay, a purge, and a compaction."""
    log = DeadLetters(spark, f"{shared_folder(spark)}/dlq")
    d = dead_letters(spark, sf_dir)
    for n in (0, 1, 2, 2, 3):
        log.append(d.where(F.col("lsn") % 4 == n), n)
    log.purge(600_000_000)
    held = log.read()
    log.settle(held.where("lsn % 3 < 2").select("dlq_id", (F.col("lsn") % 3 == 0).alias("ok"), F.lit("no row").alias("error"), F.lit(False).alias("fatal")), 3, 9)
    log.append(d.where("lsn % 4 = 3"), 3)  # the last micro-batch is run again: what was replayed stays gone
    log.compact(3, after=2)
    return log.read().select("dlq_id", "kind", "retry_count")


@query(f"""WITH {EV}, s AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS id FROM events), c AS (SELECT user_id AS id, op, k, lsn FROM ev WHERE ack_lsn > 5000),
u AS (SELECT id, 'upsert' AS op, NULL AS k, 5000 AS lsn, -1 AS seq FROM s UNION ALL SELECT id, op, k, lsn, lsn FROM c), r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY lsn DESC, seq DESC) AS n FROM u)
SELECT id, k, lsn, (SELECT count(*) FROM c) AS events_processed, (SELECT count(*) FROM s) AS copied, 6::BIGINT AS still_open FROM r WHERE n = 1 AND op <> 'delete'""")
def mirror_backfill(spark, sf_dir):
    """A table is copied in eight ranges, the run is ended when two have been, the next one copies those still open; then the log
    is streamed from its beginning, of which the config takes what lies behind its watermark."""
    folder = shared_folder(spark)
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    append_log(with_commits(event_changes(spark, sf_dir, deal=True)), f"{folder}/log", 3)
    make = lambda: Mirror(spark, f"{folder}/m", one(spark, "users"), buckets=8)
    still = make().backfill({"users": users}, 5000, pieces=8, at_once=2, waves=1)
    mirror = make()
    mirror.backfill({"users": users}, 9000, pieces=8, at_once=3)
    mirror.run_log(f"{folder}/log", f"{folder}/q")
    rows = mirror.store.read().select("id", F.get_json_object("document", "$.k").alias("k"), "lsn")
    copied = mirror.ranges.read().agg(F.sum("n_rows").alias("copied"))  # one row, as is the next
    return rows.crossJoin(mirror.checkpoints.read().select("events_processed")).crossJoin(copied).withColumn("still_open", F.lit(still).cast("long"))


@query(f"WITH {EV} SELECT lsn, CASE WHEN op = 'delete' THEN 'delete' ELSE 'upsert' END AS action, user_id AS id, CASE WHEN op <> 'delete' THEN op END AS op FROM ev")
def process_transform(spark, sf_dir):
    """User code in a process of its own that answers a JSON line of events with a JSON line of actions."""
    script = "import json, sys\nfor line in sys.stdin:\n    print(json.dumps([{'action': 'delete' if e['operation'] == 'delete' else 'upsert', 'id': e['id'], 'document': {'op': e['operation']}} for e in json.loads(line)]), flush=True)"
    acts = A.transform(R.routed(event_changes(spark, sf_dir), one(spark, "users")), {"users": A.command([sys.executable, "-c", script])})
    return acts.select("lsn", "action", "id", F.when(F.col("action") == "upsert", F.get_json_object("document", "$.op")).alias("op"))


@query("SELECT event_id AS seq, event_id // 10 AS xid, event_type AS payload, (event_id // 10) * 10 + 9 AS ack_lsn FROM events WHERE event_id // 10 % 5 <> 3")
def buffered_transactions(spark, sf_dir):
    """Rows and commits of a stream, mixed over micro-batches; every fifth transaction never commits. They come from an ordered
    log, since a commit must not be read before its rows: a row's position is (its number, 1), its transaction's commit is next."""
    e, folder = dealt(table(spark, sf_dir, "events").select("event_id", "event_type"), "event_id"), shared_folder(spark)
    xid, none = F.floor(F.col("event_id") / 10), F.lit(None).cast("long")
    base = {"seq": F.lit(1).cast("long"), "src_schema": F.lit(None).cast("string"), "src_table": F.lit(None).cast("string")}
    rows = e.select(xid.alias("xid"), F.col("event_id").alias("ack_lsn"), F.col("event_type").alias("payload"), F.lit(False).alias("is_commit"), none.alias("end_lsn"), none.alias("commit_us")).withColumns(base)
    commits = rows.where("xid % 5 <> 3").groupBy("xid").agg(F.max("ack_lsn").alias("ack_lsn")).withColumns({**base, "seq": F.lit(2).cast("long"), "is_commit": F.lit(True), "end_lsn": F.col("xid") * 10 + 9, "commit_us": F.lit(0).cast("long")})
    append_log(rows.unionByName(commits, allowMissingColumns=True), f"{folder}/log", 3)
    placed = read_log(spark, f"{folder}/log", f"{folder}/q", 1, schema="xid long, ack_lsn long, seq long, payload string, is_commit boolean, end_lsn long, commit_us long")
    stream = placed.select("xid", F.col("ack_lsn").alias("seq"), "payload", "is_commit", F.col("end_lsn").alias("ack_lsn"), "commit_us")
    query_ = buffer_transactions(stream).writeStream.format("parquet").option("checkpointLocation", f"{folder}/q").start(f"{folder}/out")
    try:
        query_.processAllAvailable()
    finally:
        query_.stop()
    return spark.read.schema(OUT).parquet(f"{folder}/out").select("seq", "xid", "payload", "ack_lsn")


@query(f"""WITH {EV}, c AS (SELECT 'types' AS config, 999::BIGINT AS lsn, 5::BIGINT AS events_processed, 0::BIGINT AS updated_ms UNION ALL SELECT event_type, max(lsn), count(*), 7 FROM ev GROUP BY 1) SELECT * FROM c""")
def state_upsert(spark, sf_dir):
    """Checkpoints of event types, written over older ones of the same configs in a state table."""
    new = event_changes(spark, sf_dir).groupBy(F.try_element_at(F.coalesce("new", "old"), F.lit("event_type")).alias("config")).agg(F.max("lsn").alias("lsn"), F.count("*").alias("events_processed")).withColumn("updated_ms", F.lit(7).cast("long"))
    state = StateTable(spark, f"{shared_folder(spark)}/state", ST.CHECKPOINT_SCHEMA)
    state.write(new.withColumn("lsn", F.lit(1).cast("long")).unionByName(spark.createDataFrame([("types", 999, 5, 0)], ST.CHECKPOINT_SCHEMA)))
    state.write(ST.upsert(state.read(), new, ["config"]))
    return state.read()


@query("SELECT event_type AS id, count(*) AS n FROM events WHERE event_id % 3 <> 0 GROUP BY 1")
def kept_actions(spark, sf_dir):
    acts = A.passthrough(R.routed(event_changes(spark, sf_dir), one(spark, "types"))).withColumn("action", F.when(F.col("lsn") % 3 == 0, "skip").otherwise(F.col("action")))
    return A.not_skipped(acts).groupBy("id").agg(F.count("*").alias("n"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) END AS as_uint,
 CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN '-5' END AS as_int,
 CASE event_id % 4 WHEN 0 THEN CAST(event_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN '-5' END AS as_string FROM events""")
def id_of_json(spark, sf_dir):
    e, i = table(spark, sf_dir, "events"), F.col("event_id") % 4
    value = F.when(i == 0, F.col("event_id").cast("string")).when(i == 1, F.concat(F.lit('"'), F.col("user_id").cast("string"), F.lit('"'))).when(i == 2, F.lit("-5")).otherwise(F.lit("[1]"))
    return e.select("event_id", value.alias("v")).select("event_id", *[S.parse_id_json("v", kind).alias(f"as_{kind}") for kind in ("uint", "int", "string")])
