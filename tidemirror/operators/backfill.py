"""Backfill: a snapshot copied in id order, resumed after a failure, and handed over to the stream without a gap."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from tidemirror.operators.actions import passthrough, row_to_event
from tidemirror.sources.snapshot import snapshot

PENDING, RUNNING, DONE, FAILED = "pending", "in_progress", "completed", "failed"
#: The ledger of a backfill: ids above low up to high (null: no border), as text.
RANGE_SCHEMA = "config string, range_no long, low string, high string, status string, n_rows long, watermark_lsn long"


def needs_backfill(progress: DataFrame, configs: DataFrame) -> DataFrame:
    """Configs whose backfill isn't completed, with the id to go on from and the watermark to keep."""
    p = progress.select("config", "status", "last_id", "watermark_lsn")
    rows = configs.select(F.col("name").alias("config")).join(p, "config", "left")
    return rows.withColumn("status", F.coalesce("status", F.lit(PENDING))).where(F.col("status") != DONE)


def begin(progress_row: dict | None, config: str, current_lsn: int, total_rows: int, now_ms: int) -> dict:
    """The progress row of a start or a resume. The watermark is taken at the first start and never raised."""
    old = progress_row or {}
    mark = old.get("watermark_lsn")
    return {
        "config": config, "last_id": old.get("last_id"), "total_rows": total_rows, "processed_rows": old.get("processed_rows") or 0, "status": RUNNING,
        "started_ms": old.get("started_ms") or now_ms, "completed_ms": None, "error": None, "watermark_lsn": current_lsn if mark is None else mark,
    }


def finish(row: dict, processed: int, last_id: str | None, now_ms: int, error: str | None = None) -> dict:
    """The progress row of the end: completed, or failed with its message; both keep the cursor."""
    return row | {"processed_rows": processed, "last_id": last_id or row["last_id"], "status": FAILED if error else DONE, "completed_ms": None if error else now_ms, "error": error}


def snapshot_actions(source: DataFrame, config: str, namespace: str, id_column: str, id_type: str, watermark_lsn: int, schema: str, table: str, columns: list[str] | None = None, after_id: str | None = None) -> DataFrame:
    """Upserts for the rows of a table (those after an id, when resumed), placed in the log at the watermark."""
    rows = source.where(F.col(id_column).isNotNull())
    if after_id is not None:
        kind = source.schema[id_column].dataType
        rows = rows.where(F.col(id_column) > F.lit(after_id).cast(kind))
    events = row_to_event(snapshot(rows, id_column, columns), id_column, id_type, schema, table).where(F.col("problem").isNull())
    placed = events.withColumns({"config": F.lit(config), "namespace": F.lit(namespace), "lsn": F.lit(watermark_lsn).cast("long"), "seq": F.lit(-1).cast("long"), "ack_lsn": F.lit(watermark_lsn).cast("long")})
    return passthrough(placed)


def handoff(snapshot_rows: DataFrame, change_actions: DataFrame, watermark_lsn: int) -> DataFrame:
    """Snapshot and later changes as one stream of actions. The watermark is taken before the scan, so nothing is lost."""
    return snapshot_rows.unionByName(change_actions.where(F.col("lsn") > watermark_lsn))


# ---------------------------------------------------------------- by ranges of ids


def plan_ranges(source: DataFrame, config: str, id_column: str, pieces: int, watermark_lsn: int) -> DataFrame:
    """Ranges of ids of about equal counts, from one approximate quantile scan (for ids that aren't numbers over a hash, which
    any sample of ids cuts as evenly)."""
    spark = source.sparkSession
    ids = source.where(F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"))
    if isinstance(source.schema[id_column].dataType, NumericType):
        cuts = ids.agg(F.percentile_approx("_id", [i / pieces for i in range(1, pieces)], 10_000)).first()[0] or [] if pieces > 1 else []
    else:
        size = max(1, pieces * 200)  # a sample of fixed size, of the smallest hashes
        sample = sorted(r[0] for r in ids.select("_id").distinct().orderBy(F.xxhash64("_id")).limit(size).collect())
        cuts = [sample[len(sample) * i // pieces] for i in range(1, pieces)] if sample else []
    cuts = list(dict.fromkeys(cuts))
    edges = [None, *map(str, cuts), None]
    rows = [(config, i, a, b, PENDING, 0, watermark_lsn) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    return spark.createDataFrame(rows, RANGE_SCHEMA)


def range_actions(source: DataFrame, config, row) -> DataFrame:
    """Upserts of the rows of one range, with its number as their batch."""
    kind = source.schema[config.id_column].dataType
    own = source if row.high is None else source.where(F.col(config.id_column) <= F.lit(row.high).cast(kind))
    made = snapshot_actions(own, config.name, config.namespace, config.id_column, config.id_type, row.watermark_lsn, config.src_schema, config.src_table, config.columns, after_id=row.low)
    return made.withColumn("batch_id", F.lit(row.range_no).cast("long"))
