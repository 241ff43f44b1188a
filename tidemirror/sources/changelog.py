"""Change logs: ordered row changes with a log position (lsn, seq), a transaction and the table they belong to.

A row with op ``commit`` ends its transaction; a log without such rows is read as one whose transactions end where the next
begins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = (
    "lsn long, seq long, xid long, ack_lsn long, commit_us long, relation_id long, src_schema string, src_table string, op string,"
    " new map<string,string>, old map<string,string>, unchanged array<string>"
)
COLUMNS = [c.split()[0] for c in SCHEMA.replace("map<string,string>", "map").split(",")]


def read_changes(spark: SparkSession, path: str, start_lsn: int | None = None, fmt: str = "parquet") -> DataFrame:
    """Committed changes from a log position on."""
    rows = spark.read.schema(SCHEMA).format(fmt).load(path)
    return rows if start_lsn is None else rows.where(F.col("lsn") >= start_lsn)


def stream_changes(spark: SparkSession, path: str, start_lsn: int | None = None, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    """The same as a stream; the rate is limited by files per micro-batch."""
    reader = spark.readStream.schema(SCHEMA).format(fmt)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.load(path)
    return rows if start_lsn is None else rows.where(F.col("lsn") >= start_lsn)


def with_commits(changes: DataFrame) -> DataFrame:
    """The changes with a commit row behind each transaction, at its ack position."""
    last = changes.groupBy("xid").agg(F.max("ack_lsn").alias("ack_lsn"), F.max("commit_us").alias("commit_us"))
    values = {"lsn": F.col("ack_lsn"), "seq": F.lit(2**62).cast("long"), "op": F.lit("commit"), "unchanged": F.array().cast("array<string>")}
    return changes.unionByName(last.withColumns(values), allowMissingColumns=True)


def as_changes(df: DataFrame, *, lsn: Column, seq: Column, xid: Column, ack_lsn: Column, commit_us: Column, relation_id: int, schema: str, table: str, op: Column, values: dict[str, Column]) -> DataFrame:
    """A table whose rows are changes, as a change log: inserts and updates carry new values, deletes old ones."""
    image = F.map_from_arrays(F.array(*[F.lit(k) for k in values]), F.array(*[v.cast("string") for v in values.values()]))
    none = F.lit(None).cast("map<string,string>")
    return df.select(
        lsn.cast("long").alias("lsn"), seq.cast("long").alias("seq"), xid.cast("long").alias("xid"), ack_lsn.cast("long").alias("ack_lsn"), commit_us.cast("long").alias("commit_us"),
        F.lit(relation_id).cast("long").alias("relation_id"), F.lit(schema).alias("src_schema"), F.lit(table).alias("src_table"), op.alias("op"),
        F.when(op == "delete", none).otherwise(image).alias("new"), F.when(op == "delete", image).otherwise(none).alias("old"), F.array().cast("array<string>").alias("unchanged"),
    )
