"""Scalar functions of the mirror as Column expressions: ids, types, values, LSNs, times, documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UINT_MAX = "18446744073709551615"
ID_TYPES = ("uint", "int", "uuid", "string")

# Source type names by kind.
INTEGER_TYPES = ["int2", "int4", "int8", "smallint", "integer", "bigint", "serial", "bigserial", "smallserial"]
TEXT_TYPES = ["text", "varchar", "char", "bpchar", "name", "citext"]
DOC_TYPES = {"int2": "int", "int4": "int", "int8": "int", "float4": "float", "float8": "float", "numeric": "float", "bool": "bool", "uuid": "uuid", "json": "json", "jsonb": "json"}
DISTANCE_METRICS = ["cosine_distance", "euclidean_squared"]
PG_EPOCH_MICROS = 946_684_800_000_000

_HEX = "[0-9a-fA-F]"
_UUID_PLAIN = rf"^{_HEX}{{32}}$"
_UUID_HYPHENS = rf"^{_HEX}{{8}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{4}}-{_HEX}{{12}}$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_id(text: Column | str, id_type: Column | str) -> Column:
    """The canonical id text of a typed id; null where it can't be parsed. Blanks are not trimmed away."""
    t, kind = _col(text), F.lit(id_type) if isinstance(id_type, str) and id_type in ID_TYPES else _col(id_type)
    digits = F.when(t.rlike(r"^\+?[0-9]+$"), F.regexp_replace(t, r"^\+", "").try_cast("decimal(38,0)"))
    large = F.when(digits <= F.lit(UINT_MAX).cast("decimal(38,0)"), digits.cast("string"))
    uint = F.when(t.rlike(r"^\+?[0-9]{1,18}$"), t.try_cast("bigint").cast("string")).otherwise(large)  # most ids need no decimals
    whole = F.when(t.rlike(r"^[+-]?[0-9]+$"), t.try_cast("bigint")).cast("string")
    bare = F.regexp_replace(F.regexp_replace(t, r"^urn:uuid:", ""), r"^\{(.*)\}$", "$1")
    packed = F.lower(F.regexp_replace(bare, "-", ""))
    uuid = F.when(bare.rlike(_UUID_PLAIN) | bare.rlike(_UUID_HYPHENS), F.concat_ws("-", F.substring(packed, 1, 8), F.substring(packed, 9, 4), F.substring(packed, 13, 4), F.substring(packed, 17, 4), F.substring(packed, 21, 12)))
    return F.when(kind == "uint", uint).when(kind == "int", whole).when(kind == "uuid", uuid).when(kind == "string", t)


def parse_id_json(value: Column | str, id_type: Column | str) -> Column:
    """An id from JSON text: numbers or strings for uint, int and string, only strings for uuid; null for anything else."""
    v = _col(value)
    kind = F.lit(id_type) if isinstance(id_type, str) and id_type in ID_TYPES else _col(id_type)
    parsed = F.try_parse_json(v)
    shape = F.schema_of_variant(parsed)
    number = shape.isin("BIGINT", "DOUBLE", "FLOAT") | shape.startswith("DECIMAL") | shape.isin("TINYINT", "SMALLINT", "INT")
    text = F.when(shape == "STRING", F.try_variant_get(parsed, "$", "string")).when(number & (kind != "uuid"), F.trim(v))
    return parse_id(text, kind)


def id_tag(id_text: Column | str, id_type: Column | str) -> Column:
    """The tagged JSON form of an id, as the dead-letter table keeps it: {"Uint":1}."""
    i, kind = _col(id_text), F.lit(id_type) if isinstance(id_type, str) and id_type in ID_TYPES else _col(id_type)
    name = F.initcap(kind)
    quoted = F.when(kind.isin("uint", "int"), i).otherwise(F.regexp_replace(F.to_json(F.array(i)), r"^\[|\]$", ""))
    return F.when(i.isNotNull(), F.concat(F.lit('{"'), name, F.lit('":'), quoted, F.lit("}")))


def untag_id(tagged: Column | str) -> Column:
    """(id_type, id) from the tagged form; null where it isn't one."""
    t = _col(tagged)
    got = F.from_json(t, "struct<Uint decimal(20,0), Int bigint, Uuid string, String string>")
    return F.when(got["Uint"].isNotNull(), F.struct(F.lit("uint").alias("id_type"), got["Uint"].cast("string").alias("id"))).when(
        got["Int"].isNotNull(), F.struct(F.lit("int").alias("id_type"), got["Int"].cast("string").alias("id"))
    ).when(parse_id(got["Uuid"], "uuid").isNotNull(), F.struct(F.lit("uuid").alias("id_type"), parse_id(got["Uuid"], "uuid").alias("id"))).when(
        got["String"].isNotNull(), F.struct(F.lit("string").alias("id_type"), got["String"].alias("id"))
    )


def id_type_compatible(id_type: Column | str, source_type: Column | str) -> Column:
    kind, src = _col(id_type), _col(source_type)
    integer, text, uuid = src.isin(INTEGER_TYPES), src.isin(TEXT_TYPES), src == "uuid"
    return F.when(kind.isin("uint", "int"), integer).when(kind == "uuid", uuid | text).when(kind == "string", text | integer | uuid).otherwise(F.lit(False))


def doc_type(source_type: Column | str) -> Column:
    """The document type of a source type; arrays keep their brackets."""
    src = _col(source_type)
    known = F.create_map(*[F.lit(x) for kv in DOC_TYPES.items() for x in kv])
    base = F.regexp_replace(src, r"\[\]$", "")
    return F.concat(F.coalesce(F.try_element_at(known, base), F.lit("string")), F.when(src.endswith("[]"), F.lit("[]")).otherwise(F.lit("")))


def parse_value(doc_type_name: str, text: Column | str) -> Column:
    """A text value as its document type; null stays null, as does what can't be parsed."""
    t = _col(text)
    if doc_type_name == "uint":
        return parse_id(t, "uint").cast("decimal(20,0)")
    if doc_type_name == "int":
        return t.try_cast("bigint")
    if doc_type_name == "float":
        return t.try_cast("double")
    if doc_type_name == "bool":
        return F.when(t.isNotNull(), t.isin("true", "t"))
    if doc_type_name == "json":
        return F.try_parse_json(t)
    return t


def parse_row(columns: list[tuple[str, str]], values: Column | str) -> Column:
    """A struct of typed values from an array of texts, by place; what is missing is null."""
    v = _col(values)
    return F.struct(*[parse_value(kind, F.try_element_at(v, F.lit(i + 1))).alias(name) for i, (name, kind) in enumerate(columns)])


def parse_array(element_type: str, text: Column | str) -> Column:
    """A one-level array literal such as {1,2,NULL} as an array."""
    inner = F.regexp_replace(_col(text), r"^\{(.*)\}$", "$1")
    parts = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, ","))
    return F.transform(parts, lambda x: parse_value(element_type, F.when(x != "NULL", x)))


def format_lsn(lsn: Column | str) -> Column:
    n = _col(lsn).cast("bigint")
    return F.concat(F.hex(F.shiftright(n, 32)), F.lit("/"), F.hex(n.bitwiseAND(F.lit(0xFFFFFFFF))))


def parse_lsn(text: Column | str) -> Column:
    t = _col(text)
    ok = t.rlike(r"^[0-9A-Fa-f]{1,8}/[0-9A-Fa-f]{1,8}$")
    hi, lo = F.split_part(t, F.lit("/"), F.lit(1)), F.split_part(t, F.lit("/"), F.lit(2))
    part = lambda x: F.conv(x, 16, 10).cast("decimal(20,0)")
    return F.when(ok, (part(hi) * F.lit(4294967296).cast("decimal(11,0)") + part(lo)).cast("decimal(20,0)"))


def pg_micros_to_timestamp(micros: Column | str) -> Column:
    return F.timestamp_micros(_col(micros) + F.lit(PG_EPOCH_MICROS))


def lag_ms(commit_micros: Column | str, now_micros: Column | str) -> Column:
    """Milliseconds from a commit (micros since 2000) to now (micros since 1970)."""
    return (_col(now_micros) - (_col(commit_micros) + F.lit(PG_EPOCH_MICROS))) / F.lit(1000.0)


def epoch_millis(ts: Column | str) -> Column:
    return F.unix_millis(_col(ts))


def from_epoch_millis(ms: Column | str) -> Column:
    """A timestamp; null out of the years 1 to 9999."""
    m = _col(ms)
    return F.when(m.between(-62135596800000, 253402300799999), F.timestamp_millis(m))


def replica_identity(code: Column | str) -> Column:
    c = _col(code)
    return F.when(c == "n", "nothing").when(c == "f", "full").when(c == "i", "index").otherwise("default")


def prefixed_namespace(prefix: Column | str | None, namespace: Column | str) -> Column:
    p = F.lit(None).cast("string") if prefix is None else _col(prefix)
    return F.concat(F.when(p.isNotNull() & (p != ""), F.concat(p, F.lit("_"))).otherwise(F.lit("")), _col(namespace))


def passthrough_document(names: Column | str, values: Column | str) -> Column:
    """A JSON object of texts or nulls; the longer list is cut to the shorter."""
    n, v = _col(names), _col(values)
    size = F.least(F.size(n), F.size(v))
    pairs = F.map_from_arrays(F.slice(n, F.lit(1), size), F.slice(v, F.lit(1), size))
    return F.to_json(pairs, {"ignoreNullFields": "false"})


def vector_json(vector: Column | str) -> Column:
    """NaN and infinities become null."""
    inf = F.lit(float("inf"))
    return F.transform(_col(vector), lambda x: F.when(~F.isnan(x) & (F.abs(x.cast("double")) != inf), x))


def error_kind(source: Column | str, status: Column | str) -> Column:
    """retryable or permanent, by where an error came from and its code (an HTTP status or an SQL state)."""
    s, code = _col(source), _col(status).cast("string")
    http = code.try_cast("int")
    transient = (
        F.when(s == "api", (http == 429) | (http >= 500))
        .when(s.isin("http", "pg_connection", "pg_postgres", "pg_replication", "replication_connection", "replication_stream"), F.lit(True))
        .when(s == "pg_query", F.coalesce(code.startswith("08"), F.lit(False)))
        .otherwise(F.lit(False))
    )
    return F.when(F.coalesce(transient, F.lit(False)), "retryable").otherwise("permanent")


def action_problem(action: Column | str, document: Column | str, vector: Column | str, metric: Column | str) -> Column:
    """Why an action can't be written; null if it can. Unknown metric names count as none."""
    a, m = _col(action), known_metric(metric)
    kind = F.schema_of_variant(F.try_parse_json(_col(document)))
    upsert = a == "upsert"
    return (
        F.when(~a.isin("upsert", "delete", "skip") | a.isNull(), "unknown action")
        .when(upsert & ~F.coalesce(kind.startswith("OBJECT"), F.lit(False)), "document must be a JSON object")
        .when(upsert & _col(vector).isNotNull() & m.isNull(), "vector needs a distance metric")
    )


def known_metric(metric: Column | str) -> Column:
    m = _col(metric)
    return F.when(m.isin(DISTANCE_METRICS), m)
