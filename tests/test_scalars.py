import pytest
from pyspark.sql import functions as F

from tidemirror.functions import scalars as S

UUID = "550e8400-e29b-41d4-a716-446655440000"


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("text", "kind", "want"),
    [
        ("7", "uint", "7"), ("+7", "uint", "7"), (" 7 ", "uint", None), ("-1", "uint", None), ("18446744073709551615", "uint", "18446744073709551615"), ("18446744073709551616", "uint", None), ("007", "uint", "7"), ("", "uint", None),
        ("-5", "int", "-5"), ("+5", "int", "5"), ("9223372036854775808", "int", None), ("1.0", "int", None), (" 7", "int", None),
        (UUID.upper(), "uuid", UUID), (UUID.replace("-", ""), "uuid", UUID), ("{" + UUID + "}", "uuid", UUID), ("550e8400", "uuid", None), ("anything at all", "string", "anything at all"), (None, "int", None), ("1" * 60, "uint", None),
    ],
)
def test_parse_id(spark, text, kind, want):
    assert one(spark, S.parse_id("t", kind), t=text) == want


@pytest.mark.parametrize(
    ("value", "kind", "want"),
    [("42", "uint", "42"), ('"42"', "uint", "42"), ("-1", "uint", None), ("1.5", "int", None), ("-3", "int", "-3"), (f'"{UUID}"', "uuid", UUID), ("5", "uuid", None), ("5", "string", "5"), ('"a b"', "string", "a b"), ("true", "string", None), ("[1]", "int", None), ("null", "int", None), ("{bad", "int", None)],
)
def test_parse_id_json(spark, value, kind, want):
    assert one(spark, S.parse_id_json("t", kind), t=value) == want


@pytest.mark.parametrize(("kind", "text"), [("uint", "42"), ("int", "-1"), ("uuid", UUID), ("string", 'a "quoted" \\ one')])
def test_tagged_ids_round_trip(spark, kind, text):
    got = one(spark, S.untag_id(S.id_tag(S.parse_id("t", kind), kind)), t=text)
    assert (got["id_type"], got["id"]) == (kind, text)
    assert one(spark, S.untag_id("t"), t='{"Other":1}') is None


def test_lsn_round_trip(spark):
    assert one(spark, S.format_lsn(F.lit((22 << 32) + 0xABC))) == "16/ABC"
    assert int(one(spark, S.parse_lsn("t"), t="16/ABC")) == (22 << 32) + 0xABC
    assert int(one(spark, S.parse_lsn("t"), t="FFFFFFFF/FFFFFFFF")) == 2**64 - 1
    assert one(spark, S.parse_lsn("t"), t="16") is None and one(spark, S.parse_lsn("t"), t="G/1") is None


def test_types_and_values(spark):
    got = lambda t: one(spark, S.doc_type("t"), t=t)
    assert [got(t) for t in ("int8", "numeric", "bool", "jsonb", "timestamptz", "int4[]", "text[]", "uuid[]")] == ["int", "float", "bool", "json", "string", "int[]", "string[]", "uuid[]"]
    fits = lambda i, t: one(spark, S.id_type_compatible("i", "t"), i=i, t=t)
    assert fits("uint", "int8") and fits("uuid", "varchar") and fits("string", "uuid") and not fits("int", "text") and not fits("uuid", "int4") and not fits("string", "bool")
    assert [one(spark, S.parse_value("bool", "t"), t=t) for t in ("true", "t", "false", "x", None)] == [True, True, False, False, None]
    assert one(spark, S.parse_value("int", "t"), t="x") is None and one(spark, S.parse_value("float", "t"), t="1e3") == 1000.0
    assert one(spark, S.parse_array("int", "t"), t="{1,NULL,3}") == [1, None, 3] and one(spark, S.parse_array("int", "t"), t="{}") == []


def test_documents_and_vectors(spark):
    doc = S.passthrough_document(F.array(F.lit("a"), F.lit("b"), F.lit("c")), F.array(F.lit("1"), F.lit(None)))
    assert one(spark, doc) == '{"a":"1","b":null}'
    assert one(spark, S.vector_json(F.array(F.lit(1.0), F.lit(float("nan")), F.lit(float("-inf"))))) == [1.0, None, None]
    assert one(spark, S.prefixed_namespace(F.lit("p"), F.lit("n"))) == "p_n" and one(spark, S.prefixed_namespace(None, F.lit("n"))) == "n"


@pytest.mark.parametrize(
    ("source", "status", "want"),
    [("api", "429", "retryable"), ("api", "503", "retryable"), ("api", "400", "permanent"), ("http", None, "retryable"), ("client", None, "permanent"), ("json", None, "permanent"), ("pg_query", "08006", "retryable"), ("pg_query", "42P01", "permanent"), ("pg_query", None, "permanent"), ("pg_connection", None, "retryable"), ("decoder", None, "permanent"), ("config", None, "permanent")],
)
def test_error_kind(spark, source, status, want):
    assert one(spark, S.error_kind("s", "c"), s=source, c=status) == want


def test_times(spark):
    assert one(spark, S.from_epoch_millis(F.lit(10**18))) is None
    assert one(spark, S.epoch_millis(S.from_epoch_millis(F.lit(1700000000123)))) == 1700000000123
    assert one(spark, S.lag_ms(F.lit(0), F.lit(946_684_800_001_500))) == 1.5
    assert one(spark, F.unix_micros(S.pg_micros_to_timestamp(F.lit(5)))) == 946_684_800_000_005
