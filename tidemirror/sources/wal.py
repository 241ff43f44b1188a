"""Binary logical-replication messages as typed rows, and a readable view of them.

The format is PostgreSQL's documented pgoutput protocol. A bad message becomes a row with ``error``; it never fails the job.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidemirror.functions.scalars import format_lsn

VALUE = "struct<kind:string,text:string,bin:binary>"
MESSAGE_SCHEMA = (
    "seq long, tag string, xid long, lsn long, end_lsn long, commit_us long, relation_id long, src_schema string, src_table string, replica_identity string,"
    " columns array<struct<name:string,key:boolean,type_oid:long,type_mod:int>>,"
    f" cols array<{VALUE}>, old_cols array<{VALUE}>, relation_ids array<long>, error string"
)
FIELDS = ["seq", "tag", "xid", "lsn", "end_lsn", "commit_us", "relation_id", "src_schema", "src_table", "replica_identity", "columns", "cols", "old_cols", "relation_ids", "error"]
IDENTITY = {"n": "nothing", "f": "full", "i": "index"}


class Malformed(ValueError):
    pass


class Cursor:
    """Reads big-endian fields off a message; running out of bytes is Malformed."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0

    def take(self, layout: str) -> tuple:
        size = struct.calcsize(">" + layout)
        if len(self.data) - self.at < size:
            raise Malformed(f"need {size} bytes, {len(self.data) - self.at} remaining")
        out = struct.unpack_from(">" + layout, self.data, self.at)
        self.at += size
        return out

    def raw(self, size: int) -> bytes:
        return self.take(f"{size}s")[0]

    def name(self) -> str:
        end = self.data.find(b"\0", self.at)
        if end < 0:
            raise Malformed("unterminated string")
        try:
            out = self.data[self.at : end].decode()
        except UnicodeDecodeError as e:
            raise Malformed(f"invalid UTF-8: {e.reason}") from None
        self.at = end + 1
        return out

    def marker(self, allowed: str, what: str) -> str:
        (code,) = self.take("B")
        if chr(code) not in allowed:
            raise Malformed(f"unexpected {what} marker: 0x{code:02X}")
        return chr(code)

    def row(self) -> list[dict]:
        out = []
        for _ in range(self.take("H")[0]):
            (code,) = self.take("B")
            kind = chr(code)
            if kind in "nu":
                out.append({"kind": kind, "text": None, "bin": None})
            elif kind in "tb":
                body = self.raw(self.take("I")[0])
                out.append({"kind": kind, "text": body.decode("utf-8", "replace") if kind == "t" else None, "bin": body if kind == "b" else None})
            else:
                raise Malformed(f"unexpected column type: 0x{code:02X}")
        return out


def _relation(c: Cursor) -> dict:
    out = {"relation_id": c.take("I")[0], "src_schema": c.name(), "src_table": c.name()}
    code, n = c.take("BH")
    columns = []
    for _ in range(n):
        (flags,) = c.take("B")
        name = c.name()
        oid, mod = c.take("Ii")
        columns.append({"name": name, "key": bool(flags & 1), "type_oid": oid, "type_mod": mod})
    return out | {"replica_identity": IDENTITY.get(chr(code), "default"), "columns": columns}


def _insert(c: Cursor) -> dict:
    out = {"relation_id": c.take("I")[0]}
    c.marker("N", "insert")
    return out | {"cols": c.row()}


def _update(c: Cursor) -> dict:
    out = {"relation_id": c.take("I")[0]}
    if c.marker("KON", "update") != "N":
        out["old_cols"] = c.row()
        c.marker("N", "update")
    return out | {"cols": c.row()}


def _delete(c: Cursor) -> dict:
    out = {"relation_id": c.take("I")[0]}
    c.marker("KO", "delete")
    return out | {"old_cols": c.row()}


def _truncate(c: Cursor) -> dict:
    n, _ = c.take("IB")
    if n * 4 > len(c.data):
        raise Malformed(f"need {n * 4} bytes, {len(c.data) - c.at} remaining")
    return {"relation_ids": list(c.take(f"{n}I"))}


READERS = {
    "B": ("begin", lambda c: dict(zip(("lsn", "commit_us", "xid"), c.take("QqI"), strict=True))),
    "C": ("commit", lambda c: dict(zip(("_", "lsn", "end_lsn", "commit_us"), c.take("BQQq"), strict=True))),
    "R": ("relation", _relation), "I": ("insert", _insert), "U": ("update", _update), "D": ("delete", _delete), "T": ("truncate", _truncate),
}


def message(data: bytes | None) -> dict:
    """The fields of one message."""
    if not data:
        return {"tag": "error", "error": "empty message"}
    name, reader = READERS.get(chr(data[0]), ("other", None))
    if reader is None:
        return {"tag": "other", "xid": data[0]}
    try:
        return {"tag": name} | reader(Cursor(data[1:]))
    except Malformed as e:
        return {"tag": "error", "error": str(e)}


def _marks(messages: DataFrame) -> DataFrame:
    """Begins and commits, whose fields have fixed places, read by Spark's own functions."""

    def number(at: int, size: int, signed: bool = False) -> Column:
        return F.conv(F.hex(F.substring("data", at, size)), 16, -10 if signed else 10).try_cast("bigint")

    begin, none = F.col("_tag") == "B", F.lit(None)
    fields = {
        "tag": F.when(begin, "begin").otherwise("commit"), "xid": F.when(begin, number(18, 4)), "lsn": F.when(begin, number(2, 8)).otherwise(number(3, 8)),
        "end_lsn": F.when(~begin, number(11, 8)), "commit_us": F.when(begin, number(10, 8, True)).otherwise(number(19, 8, True)),
    }
    types = dict(zip(FIELDS, StructType.fromDDL(MESSAGE_SCHEMA).fields, strict=True))
    return messages.select("seq", *[fields.get(c, none).cast(types[c].dataType).alias(c) for c in FIELDS[1:]])


def decode(df: DataFrame, data: str = "data", seq: str = "seq") -> DataFrame:
    """Typed messages of a table (seq, data). Python reads the messages of varying length only, in Arrow batches."""
    kinds = to_arrow_schema(StructType.fromDDL(MESSAGE_SCHEMA))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [message(d) for d in batch.column(1).to_pylist()]
            columns = [batch.column(0), *[pa.array([r.get(f.name) for r in rows], f.type) for f in list(kinds)[1:]]]
            yield pa.RecordBatch.from_arrays(columns, schema=kinds)

    size = F.length(data)
    tag = F.decode(F.substring(data, 1, 1), "ISO-8859-1")
    messages = df.select(F.col(seq).cast("long").alias("seq"), F.col(data).alias("data"), tag.alias("_tag"))
    fixed = F.coalesce(((F.col("_tag") == "B") & (size >= 21)) | ((F.col("_tag") == "C") & (size >= 26)), F.lit(False))
    return _marks(messages.where(fixed)).unionByName(messages.where(~fixed).select("seq", "data").mapInArrow(run, MESSAGE_SCHEMA))


def relation_versions(messages: DataFrame) -> DataFrame:
    return messages.where("tag = 'relation'").select("seq", "relation_id", "src_schema", "src_table", "replica_identity", "columns")


def _readable(columns: Column, cols: Column) -> Column:
    text = lambda v: F.when(v["kind"] == "n", "NULL").when(v["kind"] == "u", "(unchanged)").when(v["kind"] == "b", F.concat(F.lit("(binary: "), F.length(v["bin"]).cast("string"), F.lit(" bytes)"))).otherwise(v["text"])
    return F.transform(cols, lambda v, i: F.struct(F.coalesce(F.try_element_at(columns, i + 1)["name"], F.lit("?")).alias("name"), text(v).alias("value")))


def layouts(df: DataFrame, data: str = "data", seq: str = "seq") -> DataFrame:
    """The layouts of a table (seq, data) of messages; only their messages are decoded."""
    return relation_versions(decode(df.where(F.substring(data, 1, 1) == F.lit(b"R")), data, seq))


def inspection_view(messages: DataFrame, versions: DataFrame | None = None) -> DataFrame:
    """(seq, type, line): one JSON line for each message, with the table layout valid at it (``versions``: the messages' layouts,
    if they are at hand)."""
    from tidemirror.operators.transactions import with_relation

    joined = with_relation(messages.drop("src_schema", "src_table", "columns"), relation_versions(messages) if versions is None else versions)
    table = F.coalesce(F.concat_ws(".", F.col("src_schema"), F.col("src_table")), F.lit("?"))
    table = F.when(F.col("src_table").isNull(), F.lit("?")).otherwise(table)
    t = F.col("tag")
    line = (
        F.when(t == "begin", F.to_json(F.struct(t.alias("type"), "xid", format_lsn("lsn").alias("lsn"))))
        .when(t == "commit", F.to_json(F.struct(t.alias("type"), format_lsn("end_lsn").alias("lsn"))))
        .when(t == "relation", F.to_json(F.struct(t.alias("type"), table.alias("table"), F.transform("columns", lambda c: c["name"]).alias("columns"))))
        .when(t.isin("insert", "update", "delete"), F.to_json(F.struct(t.alias("type"), table.alias("table"), _readable(F.col("columns"), F.col("cols")).alias("new"), _readable(F.col("columns"), F.col("old_cols")).alias("old"))))
        .when(t == "truncate", F.to_json(F.struct(t.alias("type"), F.col("relation_ids").alias("tables"))))
        .when(t == "other", F.to_json(F.struct(t.alias("type"), F.col("xid").alias("tag"))))
        .otherwise(F.to_json(F.struct(F.lit("error").alias("type"), "error")))
    )
    return joined.select("seq", t.alias("type"), line.alias("line"))


# ---------------------------------------------------------------- writing messages, for tests and replays of stored logs


def encode_begin(lsn: int, commit_us: int, xid: int) -> bytes:
    return b"B" + struct.pack(">QqI", lsn, commit_us, xid)


def encode_commit(lsn: int, end_lsn: int, commit_us: int) -> bytes:
    return b"C" + struct.pack(">BQQq", 0, lsn, end_lsn, commit_us)


def encode_relation(relation_id: int, schema: str, table: str, columns: list[tuple[str, bool, int]]) -> bytes:
    body = struct.pack(">I", relation_id) + schema.encode() + b"\0" + table.encode() + b"\0" + b"d" + struct.pack(">H", len(columns))
    return b"R" + body + b"".join(struct.pack(">B", key) + name.encode() + b"\0" + struct.pack(">Ii", oid, -1) for name, key, oid in columns)


def encode_tuple(values: list) -> bytes:
    """None is null, an Ellipsis is an unchanged value, bytes are binary, all else is text."""
    out = struct.pack(">H", len(values))
    for v in values:
        if v is None or v is ...:
            out += b"n" if v is None else b"u"
        else:
            body = v if isinstance(v, bytes) else str(v).encode()
            out += (b"b" if isinstance(v, bytes) else b"t") + struct.pack(">I", len(body)) + body
    return out


def encode_change(op: str, relation_id: int, new: list | None, old: list | None = None) -> bytes:
    head = struct.pack(">I", relation_id)
    if op == "insert":
        return b"I" + head + b"N" + encode_tuple(new)
    if op == "delete":
        return b"D" + head + b"O" + encode_tuple(old)
    return b"U" + head + (b"O" + encode_tuple(old) if old is not None else b"") + b"N" + encode_tuple(new)
