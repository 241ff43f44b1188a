"""Checkpoints and backfill progress as small keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHECKPOINT_SCHEMA = "config string, lsn long, events_processed long, updated_ms long"
PROGRESS_SCHEMA = "config string, last_id string, total_rows long, processed_rows long, status string, started_ms long, completed_ms long, error string, watermark_lsn long"


def upsert(state: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """The state with changed rows replaced and new ones added."""
    return state.join(changes.select(*key), key, "left_anti").unionByName(changes.select(*state.columns))


def start_lsn(checkpoints: DataFrame, progress: DataFrame | None = None) -> DataFrame:
    """One row: the least position to read from, over checkpoints and (on a first start) backfill watermarks."""
    rows = checkpoints.select("lsn")
    if progress is not None:
        rows = rows.unionByName(progress.where(F.col("watermark_lsn").isNotNull()).select(F.col("watermark_lsn").alias("lsn")))
    return rows.agg(F.min("lsn").alias("start_lsn"))


def advance(checkpoints: DataFrame, configs: DataFrame, routed: DataFrame, batch: DataFrame, now_ms: int, succeeded: DataFrame | None = None) -> DataFrame:
    """Checkpoints after a batch: every config moves to the batch's last ack position (also one without an event), unless it
    is already there; events_processed grows by what was sent for it. A config that was sent events and has no position yet (of
    a transaction that is applied before its commit) is kept at -1, where nothing is acknowledged.

    batch: the transactions (ack_lsn); routed: the batch's events by config; succeeded: the configs whose sends succeeded.
    """
    top = batch.agg(F.max("ack_lsn").alias("_top"))  # one row
    sent = routed if succeeded is None else routed.join(succeeded.select("config"), "config", "left_semi")
    counts = sent.groupBy("config").agg(F.count("*").alias("_n"))
    old = checkpoints.select("config", F.col("lsn").alias("_old"), "events_processed", "updated_ms")
    rows = configs.select(F.col("name").alias("config")).crossJoin(F.broadcast(top)).join(old, "config", "left").join(counts, "config", "left")
    moved = F.col("_top").isNotNull() & (F.col("_old").isNull() | (F.col("_top") > F.col("_old")))
    return rows.select(
        "config", F.coalesce(F.when(moved, F.col("_top")).otherwise(F.col("_old")), F.when(F.col("_n") > 0, F.lit(-1))).cast("long").alias("lsn"), (F.coalesce("events_processed", F.lit(0)) + F.coalesce("_n", F.lit(0))).cast("long").alias("events_processed"),
        F.when(moved | F.col("_old").isNull(), F.lit(now_ms)).otherwise(F.col("updated_ms")).cast("long").alias("updated_ms"),
    ).where(F.col("lsn").isNotNull())
