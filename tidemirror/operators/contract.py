"""Checks of source tables against their configs, and removal of what belongs to a config."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemirror.functions.scalars import action_problem, id_type_compatible, parse_id
from tidemirror.functions.tables import small
from tidemirror.operators.actions import row_to_event
from tidemirror.sources.snapshot import sample_row

SPARK_TO_SOURCE = {"tinyint": "int2", "smallint": "int2", "int": "int4", "bigint": "int8", "float": "float4", "double": "float8", "boolean": "bool", "string": "text"}


def source_type(dtype: str) -> str:
    if dtype.startswith("array<"):
        return source_type(dtype[6:-1]) + "[]"
    return SPARK_TO_SOURCE.get(dtype, "numeric" if dtype.startswith("decimal") else dtype)


def duplicate_ids(df: DataFrame, id_column: str) -> DataFrame:
    return df.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.count("*").alias("n")).where("n > 1")


def column_differences(declared: DataFrame, actual: DataFrame) -> DataFrame:
    """Columns (place, name, type) that differ between two lists."""
    d = declared.select("place", F.col("name").alias("declared_name"), F.col("type").alias("declared_type"))
    a = actual.select("place", F.col("name").alias("actual_name"), F.col("type").alias("actual_type"))
    same = F.col("declared_name").eqNullSafe(F.col("actual_name")) & F.col("declared_type").eqNullSafe(F.col("actual_type"))
    return d.join(a, "place", "full_outer").where(~same)


def columns_of(spark: SparkSession, df: DataFrame) -> DataFrame:
    return spark.createDataFrame([(i, name, source_type(kind)) for i, (name, kind) in enumerate(df.dtypes)], "place int, name string, type string")


def check_source(df: DataFrame, config: dict, declared: list[tuple[str, str]] | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row (config, ok, problem): the first failure of a source table. Ids are checked over the whole table, in one job;
    then the transform, if one is given, is tried on one row of a table that isn't empty."""
    spark, name = df.sparkSession, config["name"]
    id_column, kinds = config["id_column"], dict(df.dtypes)

    def report(problem: str | None) -> DataFrame:
        return spark.createDataFrame([(name, problem is None, problem)], "config string, ok boolean, problem string")

    if id_column not in kinds:
        return report(f"id column '{id_column}' not found")
    fits = spark.range(1).select(id_type_compatible(F.lit(config["id_type"]), F.lit(source_type(kinds[id_column]))).alias("ok")).first()["ok"]
    if not fits:
        return report(f"id type '{config['id_type']}' doesn't fit column type '{source_type(kinds[id_column])}'")
    missing = [c for c in config.get("columns") or [] if c not in kinds]
    if missing:
        return report(f"columns not found: {', '.join(missing)}")
    if declared is not None and declared != [(c, source_type(k)) for c, k in df.dtypes]:
        return report("declared columns are stale")
    parsed = parse_id(F.col(id_column).cast("string"), config["id_type"])
    per_id = df.groupBy(id_column).agg(F.count("*").alias("n"), F.max((F.col(id_column).isNotNull() & parsed.isNull()).cast("int")).alias("bad"))
    facts = per_id.agg(F.count_if(F.col(id_column).isNull()).alias("nulls"), F.count_if((F.col("n") > 1) & F.col(id_column).isNotNull()).alias("twice"), F.coalesce(F.sum("bad"), F.lit(0)).alias("bad"))
    problem = F.when(F.col("nulls") > 0, "id is null in some rows").when(F.col("twice") > 0, "id is not unique").when(F.col("bad") > 0, "id can't be parsed in some rows")
    found = facts.select(F.lit(name).alias("config"), problem.isNull().alias("ok"), problem.alias("problem"))
    if transform is None or not found.first()["ok"]:
        return found
    sample = row_to_event(sample_row(df, id_column), id_column, config["id_type"], config.get("src_schema", "public"), config.get("src_table", name))
    placed = sample.withColumns({"config": F.lit(name), "namespace": F.lit(config.get("namespace", name)), **{c: F.lit(0).cast("long") for c in ("lsn", "seq", "ack_lsn")}})
    failed = dry_run(placed, transform).where(F.col("error").isNotNull()).first()
    return report(None if failed is None else f"transform failed: {failed['error']}")


def dry_run(sample: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The actions of a transform on a sample, with why they couldn't be written. An empty sample gives no row."""
    actions = transform(sample)
    return actions.withColumn("error", F.coalesce("error", action_problem("action", "document", "vector", "distance_metric")))


def without_configs(table: DataFrame, gone: DataFrame, column: str = "config") -> DataFrame:
    """A state table without the rows of removed configs. Doing it again changes nothing."""
    return table.join(small(gone.select(F.col("name").alias("_gone"))), F.col(column) == F.col("_gone"), "left_anti")


def purge_config(mirror: DataFrame, states: dict[str, DataFrame], gone: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
    """The mirror without the namespaces of removed configs, and all state tables without their rows."""
    kept = mirror.join(small(gone.select(F.col("namespace").alias("_gone"))), F.col("namespace") == F.col("_gone"), "left_anti")
    return kept, {name: without_configs(table, gone) for name, table in states.items()}
