"""Snapshots of source tables as text, pages, counts and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project_columns(df: DataFrame, columns: list[str] | None) -> DataFrame:
    """Chosen columns in the chosen order; a name given twice or missing is an error."""
    if columns is None:
        return df
    twice = sorted({c for c in columns if columns.count(c) > 1})
    missing = [c for c in columns if c not in df.columns]
    if twice or missing:
        raise ValueError(f"columns given twice: {twice}; columns not in the table: {missing}")
    return df.select(*columns)


def text_of(df: DataFrame, column: str) -> Column:
    kind = df.schema[column].dataType.typeName()
    return F.to_json(column) if kind in ("array", "map", "struct") else F.col(column).cast("string")


def snapshot(df: DataFrame, id_column: str, columns: list[str] | None = None) -> DataFrame:
    """All or the chosen columns as text, in one parallel scan; the id comes last if it wasn't chosen."""
    if columns is not None and not columns:
        raise ValueError("the column list is empty")
    chosen = list(columns) if columns is not None else list(df.columns)
    if id_column not in chosen:
        chosen.append(id_column)
    chosen_df = project_columns(df, chosen)
    return chosen_df.select(*[text_of(df, c).alias(c) for c in chosen])


def page(df: DataFrame, id_column: str, cursor=None, n: int = 1000) -> DataFrame:
    """The n rows after a cursor in id order, with has_more. One top-n job; null ids are left out."""
    if n <= 0:
        raise ValueError("a page holds at least one row")
    rows = df.where(F.col(id_column).isNotNull())
    if cursor is not None:
        rows = rows.where(F.col(id_column) > F.lit(cursor))
    ahead = rows.orderBy(id_column).limit(n + 1)
    place = ahead.agg(F.count("*").alias("_n"))  # at most n + 1 rows
    return ahead.crossJoin(F.broadcast(place)).withColumn("has_more", F.col("_n") > n).drop("_n").orderBy(id_column).limit(n)


def chunks(df: DataFrame, id_column: str, n_chunks: int) -> DataFrame:
    """Every row with a non-null id and its chunk: ranges of ids of about equal counts, from one approximate quantile scan."""
    rows = df.where(F.col(id_column).isNotNull())
    if n_chunks <= 1:
        return rows.withColumn("chunk", F.lit(0))
    shares = [i / n_chunks for i in range(1, n_chunks)]
    bounds = rows.agg(F.percentile_approx(id_column, shares, 10_000)).first()[0] or []
    place = sum([(F.col(id_column) > F.lit(b)).cast("int") for b in bounds], F.lit(0))
    return rows.withColumn("chunk", place)


def rows_by_id(df: DataFrame, id_column: str, ids: DataFrame, ids_column: str = "id", broadcast_bound: int = 100_000) -> DataFrame:
    """The rows whose id is asked for. Few ids are broadcast (their number is checked), many are joined by a shuffle."""
    wanted = ids.select(F.col(ids_column).alias("_wanted")).distinct()
    small = wanted.limit(broadcast_bound + 1).count() <= broadcast_bound
    return df.join(F.broadcast(wanted) if small else wanted, F.col(id_column).cast("string") == F.col("_wanted").cast("string"), "left_semi")


def count_with_id(df: DataFrame, id_column: str) -> DataFrame:
    return df.agg(F.count(id_column).alias("n"))


def sample_row(df: DataFrame, key: str | None = None) -> DataFrame:
    """One row as text (that of the smallest key, if one is named); none for an empty table."""
    ordered = df if key is None else df.orderBy(key)
    return ordered.select(*[text_of(df, c).alias(c) for c in df.columns]).limit(1)
