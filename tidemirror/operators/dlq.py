"""Dead letters: failed events kept without payload, and replayed against the current row."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemirror.functions.scalars import error_kind, id_tag, untag_id
from tidemirror.functions.tables import small

DLQ_SCHEMA = "dlq_id string, config string, lsn long, doc_id string, op string, error string, kind string, retry_count int, created_ms long, last_retry_ms long, permanent_ms long"
DLQ_COLUMNS = [c.split()[0] for c in DLQ_SCHEMA.split(", ")]
RETRYABLE, PERMANENT = "retryable", "permanent"


def entries(failed: DataFrame, now_ms: int, classify: bool = False) -> DataFrame:
    """Dead letters of failed events (config, lsn, seq, id, id_type, op, error; with classify also error_source, status)."""
    kind = error_kind("error_source", "status") if classify else F.lit(RETRYABLE)
    return failed.select(
        F.concat_ws("-", "config", "lsn", "seq").alias("dlq_id"), "config", "lsn", id_tag("id", "id_type").alias("doc_id"), "op", "error", kind.alias("kind"),
        F.lit(0).alias("retry_count"), F.lit(now_ms).cast("long").alias("created_ms"), F.lit(None).cast("long").alias("last_retry_ms"), F.lit(None).cast("long").alias("permanent_ms"),
    )


def append(dlq: DataFrame, new: DataFrame) -> DataFrame:
    """Dead letters with new ones; an entry that is there already stays as it is."""
    return dlq.unionByName(new.join(dlq.select("dlq_id"), "dlq_id", "left_anti").select(*dlq.columns))


def counts(dlq: DataFrame, config: str | None = None) -> DataFrame:
    return (dlq if config is None else dlq.where(F.col("config") == config)).agg(F.count("*").alias("n"))


def counts_by_kind(dlq: DataFrame, config: str | None = None) -> DataFrame:
    rows = dlq if config is None else dlq.where(F.col("config") == config)
    return rows.agg(F.count_if(F.col("kind") == RETRYABLE).alias("retryable"), F.count_if(F.col("kind") == PERMANENT).alias("permanent"))


def listing(dlq: DataFrame, n: int, config: str | None = None) -> DataFrame:
    """The newest n."""
    return (dlq if config is None else dlq.where(F.col("config") == config)).orderBy(F.desc("created_ms"), F.desc("dlq_id")).limit(n)


def retryable(dlq: DataFrame, configs: DataFrame, n: int | None = None) -> DataFrame:
    """The oldest n retryable entries of configs that aren't tombstoned; all of them without n."""
    live = configs.where(F.col("tombstone_applied_at").isNull()).select(F.col("name").alias("config"))
    found = dlq.where(F.col("kind") == RETRYABLE).join(small(live), "config").select(*dlq.columns)
    return found if n is None else found.orderBy("created_ms", "dlq_id").limit(n)


def orphans(dlq: DataFrame, configs: DataFrame, transforms: list[str] | None = None) -> DataFrame:
    """Entries with the reason why they can't be replayed, or null: the first that holds, in this order."""
    live = configs.select(F.col("name").alias("config"), "namespace", F.lit(True).alias("_known"))
    parsed = untag_id("doc_id")
    no_transform = F.lit(False) if transforms is None else ~F.col("config").isin(transforms)
    reason = (
        F.when(F.col("_known").isNull(), "config no longer exists")
        .when(no_transform, "transformer no longer exists")
        .when(F.col("namespace").isNull(), "namespace no longer exists")
        .when(F.col("doc_id").isNull(), "missing doc_id")
        .when(parsed.isNull(), "doc_id deserialization failed")
        .when(F.col("op").isNull(), "missing operation (legacy entry)")
    )
    return dlq.join(small(live), "config", "left").withColumn("reason", reason).withColumn("_id", parsed).select(*dlq.columns, "namespace", F.col("_id.id_type").alias("id_type"), F.col("_id.id").alias("id"), "reason").drop("_known")


def replay_events(sound: DataFrame, source: DataFrame, id_column: str) -> DataFrame:
    """Entries (with id) as events on the current rows: the original operation where the row is there, else a delete with no
    values at all. A delete stays a delete whatever the row is now."""
    image = F.map_from_arrays(F.array(*[F.lit(c) for c in source.columns]), F.array(*[F.col(c).cast("string") for c in source.columns]))
    rows = source.select(F.col(id_column).cast("string").alias("_id"), image.alias("_new"))
    gone = (F.col("op") == "delete") | F.col("_new").isNull()
    joined = sound.join(rows, sound["id"] == rows["_id"], "left")
    return joined.select(*sound.columns, F.when(gone, "delete").otherwise(F.col("op")).alias("replay_op"), F.when(~gone, F.col("_new")).alias("new"), F.lit(None).cast("map<string,string>").alias("old"))


def settle(dlq: DataFrame, results: DataFrame, most_retries: int, now_ms: int) -> DataFrame:
    """The dead letters after a replay. results: (dlq_id, ok, error, fatal): successes go, failures count one retry and turn
    permanent at the limit, fatal ones (orphans) turn permanent at once; entries without a result stay."""
    r = results.select("dlq_id", F.col("ok").alias("_ok"), F.col("error").alias("_e"), F.coalesce("fatal", F.lit(False)).alias("_fatal"))
    rows = dlq.join(r, "dlq_id", "left").where(~F.coalesce("_ok", F.lit(False)))
    failed, spent = F.col("_ok").isNotNull(), F.col("retry_count") + 1 >= most_retries
    permanent = failed & (F.col("_fatal") | spent)
    return rows.select(
        "dlq_id", "config", "lsn", "doc_id", "op",
        F.when(failed & F.col("_fatal"), F.col("_e")).when(permanent, F.concat(F.lit("max retries exhausted: "), "_e")).otherwise(F.col("error")).alias("error"),
        F.when(permanent, PERMANENT).otherwise(F.col("kind")).alias("kind"),
        F.when(failed & ~permanent, F.col("retry_count") + 1).otherwise(F.col("retry_count")).cast("int").alias("retry_count"), "created_ms",
        F.when(failed & ~permanent, F.lit(now_ms)).otherwise(F.col("last_retry_ms")).cast("long").alias("last_retry_ms"),
        F.when(permanent, F.lit(now_ms)).otherwise(F.col("permanent_ms")).cast("long").alias("permanent_ms"),
    )


def purge(dlq: DataFrame, now_ms: int, hours: int = 72) -> DataFrame:
    """Without permanent entries older than so many hours."""
    return dlq.where(~((F.col("kind") == PERMANENT) & (F.coalesce("permanent_ms", F.lit(now_ms)) < now_ms - hours * 3_600_000)))


def drain(dlq: DataFrame, replay, most_retries: int, now_ms: int, stalls: int = 2) -> DataFrame:
    """Replay until nothing retryable is left or ``stalls`` passes in a row had no success. replay(dlq) gives results."""
    idle = 0
    while idle < stalls and not dlq.where(F.col("kind") == RETRYABLE).isEmpty():
        results = replay(dlq)
        idle = 0 if not results.where("ok").isEmpty() else idle + 1
        dlq = settle(dlq, results, most_retries, now_ms)
    return dlq
