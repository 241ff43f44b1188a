"""Counters, lags and latency summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tidemirror.functions.scalars import lag_ms
from tidemirror.functions.tables import SMALL_ROWS, is_small

PERCENTS = (50.0, 95.0, 99.0, 99.9)
#: Buckets of a round in which ranks are selected.
BUCKETS = 1_024


def observed(routed: DataFrame, name: str = "pipeline") -> tuple[DataFrame, Observation]:
    """Count events and the last position while they pass by, without a job of their own."""
    seen = Observation(name)
    return routed.observe(seen, F.count("*").alias("events"), F.max("lsn").alias("max_lsn"), F.count_if(F.col("op") == "delete").alias("deletes")), seen


def pipeline_metrics(actions: DataFrame, dlq: DataFrame, transactions: DataFrame, replays: DataFrame | None = None, progress: DataFrame | None = None) -> DataFrame:
    """One row: processed, failed, requests, acks, dlq_size; with the results of replays (ok) also replayed and replay_failed,
    with backfill progress also backfill_rows."""
    a = actions.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_distinct("namespace", "batch_id").alias("requests"))
    out = a.crossJoin(transactions.agg(F.count("*").alias("acks"))).crossJoin(dlq.agg(F.count("*").alias("dlq_size")))  # one row each
    if replays is not None:
        out = out.crossJoin(replays.agg(F.count_if("ok").alias("replayed"), F.count_if(~F.col("ok")).alias("replay_failed")))
    if progress is not None:
        out = out.crossJoin(progress.agg(F.coalesce(F.sum("processed_rows"), F.lit(0)).alias("backfill_rows")))
    return out


def replication_lag(transactions: DataFrame, now_micros) -> DataFrame:
    return transactions.withColumn("lag_ms", lag_ms("commit_us", now_micros))


def latency_summary(df: DataFrame, value: str, by: list[str], exact: bool = True) -> DataFrame:
    """mean and nearest-rank percentiles (rank round(p * (n - 1))) of each group; inexact, one scan with sketches."""
    v = F.col(value).cast("double")
    names = [f"p{str(p).removesuffix('.0').replace('.', '_')}" for p in PERCENTS]
    if not exact:
        return df.groupBy(*by).agg(F.count("*").alias("n"), F.avg(v).alias("mean"), *[F.percentile_approx(v, p / 100, 100_000).alias(c) for p, c in zip(PERCENTS, names, strict=True)])
    rows = df.where(v.isNotNull()).select(*by, v.alias("_v"))
    told = rows.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_v").alias("mean"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    ranks = F.array(*[F.struct(F.lit(c).alias("name"), F.round(F.lit(p / 100) * (F.col("n") - 1)).cast("long").alias("rank")) for p, c in zip(PERCENTS, names, strict=True)])
    asked = told.select(*by, F.explode(ranks).alias("_a"), "_lo", "_hi").select(*by, "_a.*", "_lo", "_hi")
    found = select_ranks(rows, asked, by).groupBy(*by).agg(*[F.max(F.when(F.col("name") == c, F.col("_lo"))).alias(c) for c in names])
    return _join_groups(told, found, by).select(*by, "n", "mean", *names)


def _join_groups(left: DataFrame, right: DataFrame, by: list[str], broadcast: bool = False) -> DataFrame:
    """left joined to right by groups; null is a group too."""
    names = {c: f"_by_{c}" for c in by}
    other = right.withColumnsRenamed(names)
    on = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(n)) for c, n in names.items()])
    return left.join(F.broadcast(other) if broadcast else other, on).drop(*names.values())


def _cut(df: DataFrame) -> DataFrame:
    """The same rows without their lineage: made anew in the driver if they are few, else checkpointed."""
    rows = df.limit(SMALL_ROWS + 1).collect()
    return df.sparkSession.createDataFrame(rows, df.schema) if len(rows) <= SMALL_ROWS else df.checkpoint()


def select_ranks(rows: DataFrame, asked: DataFrame, by: list[str], buckets: int = BUCKETS) -> DataFrame:
    """The values at ranks (from 0) of each group: asked (by, name, rank, _lo, _hi) with _lo = _hi = the value.

    A round counts the values between _lo and _hi of each rank in so many buckets, and goes on with the bucket that holds the
    rank and its least and greatest value. So no group is ever put in order, and a task gives at most ``buckets`` rows for a
    rank. The two ends fall into different buckets, so every round is nearer; few are needed."""
    schema = rows.sparkSession.createDataFrame([], asked.schema).schema
    done, left = [], _cut(asked)
    while not left.isEmpty():
        key = [*by, "name"]
        ended = left.where(~(F.col("_lo") < F.col("_hi")))
        inside = _join_groups(rows, left.where("_lo < _hi"), by, is_small(left)).where((F.col("_v") >= F.col("_lo")) & (F.col("_v") <= F.col("_hi")))
        share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        place = F.when(F.col("_v") == F.col("_hi"), buckets - 1).otherwise(F.least(F.floor(share * (buckets - 1)).cast("int"), F.lit(buckets - 2)))
        counts = inside.groupBy(*key, "rank", place.alias("b")).agg(F.count("*").alias("c"), F.min("_v").alias("lo"), F.max("_v").alias("hi"))
        lists = counts.groupBy(*key, "rank").agg(F.array_sort(F.collect_list(F.struct("b", "c", "lo", "hi"))).alias("_l"))
        start = F.struct(F.col("rank").alias("r"), F.lit(False).alias("ok"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
        step = lambda a, x: F.when(a["ok"], a).when(a["r"] < x["c"], F.struct(a["r"].alias("r"), F.lit(True).alias("ok"), x["lo"].alias("lo"), x["hi"].alias("hi"))).otherwise(F.struct((a["r"] - x["c"]).alias("r"), F.lit(False).alias("ok"), F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi")))
        after = lists.select(*key, F.aggregate("_l", start, step).alias("_f")).select(*key, F.col("_f.r").alias("rank"), F.col("_f.lo").alias("_lo"), F.col("_f.hi").alias("_hi"))
        done.append(ended)
        left = _cut(after)
    return reduce(DataFrame.unionByName, done, rows.sparkSession.createDataFrame([], schema))
