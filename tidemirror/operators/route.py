"""Routing of changes to configs, and ids of the routed documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemirror.functions.scalars import parse_id
from tidemirror.functions.tables import join_few_keys


def active(configs: DataFrame) -> DataFrame:
    return configs.where(F.col("tombstone_applied_at").isNull())


def tombstoned(configs: DataFrame) -> DataFrame:
    return configs.where(F.col("tombstone_applied_at").isNotNull())


def raw_id(id_column: Column) -> Column:
    """The id's text: from the new values if there are any, else from the old ones."""
    return F.when(F.col("new").isNotNull(), F.try_element_at("new", id_column)).otherwise(F.try_element_at("old", id_column))


def id_problem(id_column: Column, id_type: Column) -> Column:
    """Why a change has no usable id; null if it has one."""
    return _problem(id_column, raw_id(id_column), parse_id(raw_id(id_column), id_type))


def _problem(id_column: Column, raw: Column, parsed: Column) -> Column:
    image = F.coalesce("new", "old")
    return (
        F.when(parsed.isNotNull() & ~F.array_contains("unchanged", id_column), None)
        .when(image.isNull(), "no tuple")
        .when(F.array_contains("unchanged", id_column), "id is unchanged")
        .when(~F.map_contains_key(image, id_column), "id column missing")
        .when(raw.isNull(), "id is null")
        .when(parsed.isNull(), "id can't be parsed")
    )


def route(changes: DataFrame, configs: DataFrame) -> DataFrame:
    """Every change once for each config of its table, with config, namespace, id_type, id and problem. Each id is read and
    parsed once.

    Configs are counted, and broadcast as long as they are few, so the log is not shuffled."""
    c = configs.select(F.col("name").alias("config"), "namespace", "src_schema", "src_table", "id_column", "id_type")
    joined = join_few_keys(changes, c, ["src_schema", "src_table"]).withColumn("_raw", raw_id(F.col("id_column"))).withColumn("_id", parse_id("_raw", F.col("id_type")))
    out = joined.withColumn("problem", _problem(F.col("id_column"), F.col("_raw"), F.col("_id")))
    return out.withColumn("id", F.when(F.col("problem").isNull(), F.col("_id"))).drop("id_column", "_raw", "_id")


def skip_problem(routes: DataFrame) -> DataFrame:
    """Routed changes that have a usable id."""
    return routes.where(F.col("problem").isNull()).drop("problem")


def routed(changes: DataFrame, configs: DataFrame) -> DataFrame:
    """The changes that have a usable id; the others are left to rejected()."""
    return skip_problem(route(changes, configs))


def rejected(changes: DataFrame, configs: DataFrame) -> DataFrame:
    return route(changes, configs).where(F.col("problem").isNotNull())


def skip_applied(routed_changes: DataFrame, checkpoints: DataFrame, position: str = "lsn") -> DataFrame:
    """Drop what a config's checkpoint covers; a config without checkpoint keeps all."""
    cp = checkpoints.select("config", F.col("lsn").alias("_cp"))
    return join_few_keys(routed_changes, cp, ["config"], "left").where(F.col(position) > F.coalesce("_cp", F.lit(-1))).drop("_cp")


def routed_counts(routed_changes: DataFrame) -> DataFrame:
    return routed_changes.groupBy("config").agg(F.count("*").alias("n_events"))
