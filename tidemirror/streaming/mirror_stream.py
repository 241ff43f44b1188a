"""The continuous mirror: changes in micro-batches, routed, transformed, merged, then checkpointed.

Order of a micro-batch: layouts, open transactions, mirror version, dead letters, checkpoints; Spark writes its own commit
last. Every step can be done again with the same effect: a batch that is run again finds its id in the mirror's manifest,
rows of transactions at or below a config's checkpoint are skipped, dead letters keep their ids, and what a batch leaves open
is kept under its own id. So a crash at any point repeats work but changes nothing.

The log holds transactions in the order of their commits (ack_lsn), and micro-batches must come in that order: ``run_log`` reads
an ordered log (sources/ordered_log.py), where files may come in any order. Rows that come from another source below what was
done before are never passed over in silence: they become dead letters, or stop the query (``late``). In the log rows with op ``commit`` end one, rows with op ``relation``
bring the layout of a table. A transaction is whole when its commit has been read or a later transaction has begun. Rows of
the last one, if it isn't whole, wait under ``open/`` for a later micro-batch; with ``eager`` they are applied at once, but
the checkpoints wait for the commit, so that a restart repeats the transaction.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemirror.functions.scalars import PG_EPOCH_MICROS
from tidemirror.operators import actions as A
from tidemirror.operators import backfill as B
from tidemirror.operators import dlq as D
from tidemirror.operators import route as R
from tidemirror.operators import state as S
from tidemirror.operators import transactions as X
from tidemirror.operators.letters import DeadLetters
from tidemirror.operators.mirror import MirrorStore, read_text, write_text
from tidemirror.sources.changelog import COLUMNS
from tidemirror.sources.changelog import SCHEMA as CHANGE_SCHEMA
from tidemirror.sources.ordered_log import log_files, routed_tables, rows_of_files

#: Rows by place: values in the order of the table's layout; a layout row holds the columns' names and their types.
PLACED_SCHEMA = "lsn long, seq long, xid long, ack_lsn long, commit_us long, relation_id long, src_schema string, src_table string, op string, cols array<string>, old_cols array<string>, unchanged array<string>"
RELATION_SCHEMA = "seq long, xid long, relation_id long, src_schema string, src_table string, columns array<struct<name: string, type: string>>"
SIGNAL_SCHEMA = "seq long, relation_id long, src_schema string, src_table string, breaking boolean, unsafe boolean"
METRIC_SCHEMA = "batch_id long, events long, transactions long, processed long, failed long, requests long, late long, done long, lag_ms long, took_ms long"
#: Versions of a small table that readers may still hold.
KEPT_VERSIONS = 3


class StateTable:
    """A small keyed table, rewritten as a new Parquet version each time; the newest complete version counts."""

    def __init__(self, spark: SparkSession, path: str, schema: str):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def versions(self) -> list[int]:
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[2:]) for n in found if n.startswith("v=") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        v = self.versions()
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v={v[-1]}") if v else self.spark.createDataFrame([], self.schema)

    def write(self, df: DataFrame) -> None:
        v = self.versions()
        df.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/v={(v[-1] if v else 0) + 1}")
        for old in v[: -KEPT_VERSIONS + 1]:
            self._fs.delete(self._path(f"{self.path}/v={old}"), True)


class LateRows(RuntimeError):
    """Rows at or below the position up to which the log was applied."""


class Mirror:
    """A mirror with its checkpoints, dead letters, layouts, signals, backfill ranges and metrics under one folder.

    transform: routed changes to actions; most_events: transactions of more events are dropped whole and acknowledged; eager:
    rows of an open transaction are applied before its commit, and most_events doesn't hold (nothing can be dropped whole that
    was applied in parts); late: what becomes of rows at or below the position that was done before their micro-batch:
    ``dead_letter`` (they are replayed against the current rows), ``fail`` or ``skip`` (for sources that send rows again);
    source, id_column: where dead letters are replayed from, every ``replay_every`` micro-batches and at the start of ``run``.
    """

    def __init__(
        self, spark: SparkSession, path: str, configs: DataFrame, transform: Callable[[DataFrame], DataFrame] = A.passthrough, most_events: int | None = None, buckets: int = 64,
        clock: Callable[[], int] = lambda: int(time.time() * 1000), eager: bool = False, source: Callable[[], DataFrame] | None = None, id_column: str = "id", replay_every: int = 0, most_retries: int = 5, late: str = "dead_letter",
    ):
        self.spark, self.path, self.configs, self.transform, self.clock = spark, path.rstrip("/"), configs, transform, clock
        self.most_events = None if eager else most_events
        self.eager, self.source, self.id_column, self.replay_every, self.most_retries, self.late = eager, source, id_column, replay_every, most_retries, late
        self.store = MirrorStore(spark, f"{path}/mirror", buckets)
        self.checkpoints = StateTable(spark, f"{path}/checkpoints", S.CHECKPOINT_SCHEMA)
        self.dlq = DeadLetters(spark, f"{path}/dlq")
        self.relations = StateTable(spark, f"{path}/relations", RELATION_SCHEMA)
        self.signals = StateTable(spark, f"{path}/signals", SIGNAL_SCHEMA)
        self.ranges = StateTable(spark, f"{path}/ranges", B.RANGE_SCHEMA)
        self.passes = self.replayed = self.replay_failed = 0
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        for name in ("borders", "metrics"):
            self._fs.mkdirs(self._path(f"{self.path}/{name}"))

    # ------------------------------------------------------------ layouts

    def named(self, rows: DataFrame, held: DataFrame | None = None) -> DataFrame:
        """Rows by place as changes by name, by the latest layout of their table, be it of this micro-batch or of one before.
        New layouts are kept. Those that change watched columns are signalled, and as unsafe also those that change any column
        behind rows of their table in the same transaction (held: its rows of earlier micro-batches)."""
        fresh = rows.where("op = 'relation'").select("seq", "xid", "relation_id", "src_schema", "src_table", F.arrays_zip(F.col("cols").alias("name"), F.col("old_cols").alias("type")).alias("columns"))
        fresh = fresh.join(self.relations.read().select("relation_id", "seq"), ["relation_id", "seq"], "left_anti").select("seq", "xid", "relation_id", "src_schema", "src_table", "columns")
        events = rows.where("op <> 'relation'").drop("src_schema", "src_table")
        if not fresh.isEmpty():
            before = self.relations.read()
            self.relations.write(before.unionByName(fresh.dropDuplicates(["relation_id", "seq"])))
            place = ["xid", "relation_id", "seq"]
            own = events.where("op <> 'commit'").select(*place)
            told = X.schema_changes(self.relations.read(), X.watched_columns(R.active(self.configs)), own if held is None else own.unionByName(held.select(*place))).where("changed")
            # Those of before were told with their own transaction's rows.
            new = told.join(fresh.select("relation_id", "seq"), ["relation_id", "seq"], "left_semi").select(*[c.split()[0] for c in SIGNAL_SCHEMA.split(", ")])
            self.signals.write(self.signals.read().join(new.select("relation_id", "seq"), ["relation_id", "seq"], "left_anti").unionByName(new))
        known = X.with_relation(events, self.relations.read().drop("xid"))
        image = lambda c: F.when(F.col(c).isNotNull() & F.col("columns").isNotNull(), F.map_from_arrays(F.col("columns.name"), F.transform(F.col("columns"), lambda _, i: F.try_element_at(c, i.cast("int") + 1))))
        return known.withColumns({"new": image("cols"), "old": image("old_cols")}).select(*COLUMNS)

    # ------------------------------------------------------------ transactions across micro-batches

    def _border(self, batch_id: int) -> dict:
        """Where the micro-batch before ended: done, open_ack, first (the micro-batch in which the open transaction began), and
        open_events. A few numbers in a file of their own for each micro-batch."""
        older = [b for b in self._numbered("borders") if b < batch_id]
        if not older:
            return {"done": None, "open_ack": None, "first": batch_id, "open_events": 0}
        return json.loads(read_text(self.spark, f"{self.path}/borders/{max(older)}"))

    def _keep_border(self, batch_id: int, border: dict) -> None:
        known = sorted(self._numbered("borders"))
        for b in known:
            # The one before is needed if this micro-batch is run again.
            if b >= batch_id or (b < batch_id - 1 and b != max((k for k in known if k < batch_id), default=None)):
                self._fs.delete(self._path(f"{self.path}/borders/{b}"), False)
        write_text(self.spark, f"{self.path}/borders/{batch_id}", json.dumps(border))

    def _numbered(self, name: str) -> list[int]:
        folder = self._path(f"{self.path}/{name}")
        found = [s.getPath().getName() for s in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        return [int(n) for n in found if n.isdigit()]

    def _held(self, before: dict, batch_id: int) -> DataFrame | None:
        """The open transaction's rows of earlier micro-batches."""
        held = [f"{self.path}/open/{b}" for b in self._kept_open() if before["first"] <= b < batch_id]
        return self.spark.read.schema(CHANGE_SCHEMA).parquet(*held) if held else None

    def whole(self, changes: DataFrame, batch_id: int) -> tuple[DataFrame, int | None, dict]:
        """The rows to apply now, the position up to which transactions are whole, and the micro-batch's numbers. What stays
        open is kept, unless it has grown too large by now: then only its events are counted on."""
        before = self._border(batch_id)
        event = ~F.col("op").isin("commit", "relation")
        each = changes.groupBy("ack_lsn").agg(F.max(F.col("op") == "commit").alias("closed"), F.count_if(event).alias("n"), F.max("commit_us").alias("us"))
        if before["done"] is not None:
            each = each.where(F.col("ack_lsn") > before["done"])
        tops = each.orderBy(F.desc("ack_lsn")).limit(2).collect()
        top = tops[0].ack_lsn if tops else before["open_ack"]
        closed = bool(tops and tops[0].closed)
        below = [x for x in (before["done"], tops[1].ack_lsn if len(tops) > 1 else None, before["open_ack"] if before["open_ack"] != top else None) if x is not None]
        done = top if closed else max(below, default=None)
        open_ack = None if closed else top
        goes_on = open_ack is not None and open_ack == before["open_ack"]
        first = before["first"] if goes_on else batch_id
        own = tops[0].n if open_ack is not None and tops else 0
        counted = own + (before["open_events"] or 0 if goes_on else 0)
        numbers = each.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("events"), F.count_if(F.col("ack_lsn") <= (-1 if done is None else done)).alias("transactions"), F.max(F.when(F.col("ack_lsn") <= (-1 if done is None else done), F.col("us"))).alias("us"), F.sum(F.when(F.col("ack_lsn") == before["open_ack"], F.col("n"))).alias("more")).first().asDict()
        rows = changes.where("op <> 'commit'")
        if before["done"] is not None:
            rows = rows.where(F.col("ack_lsn") > before["done"])
        if not self.eager:
            grown = self.most_events is not None and counted > self.most_events
            waiting = rows.where(F.col("ack_lsn") == open_ack) if open_ack is not None and not grown else rows.limit(0)
            waiting.write.mode("overwrite").parquet(f"{self.path}/open/{batch_id}")
            held = self._held(before, batch_id)
            if held is not None:
                rows = rows.unionByName(held)
            if open_ack is not None:
                rows = rows.where(F.col("ack_lsn") != open_ack)
            if self.most_events is not None and before["open_ack"] is not None and (before["open_events"] or 0) + (numbers["more"] or 0) > self.most_events:
                rows = rows.where(F.col("ack_lsn") != before["open_ack"])
        self._keep_border(batch_id, {"done": done, "open_ack": open_ack, "first": first, "open_events": counted})
        for b in self._kept_open():
            if b < before["first"]:  # Spark has committed the batches that used it
                self._fs.delete(self._path(f"{self.path}/open/{b}"), True)
        return rows, done, numbers

    def _kept_open(self) -> list[int]:
        return self._numbered("open")

    def _late(self, changes: DataFrame, batch_id: int) -> DataFrame | None:
        """Rows at or below what was done before, if there are any and they aren't to be skipped."""
        done = self._border(batch_id)["done"]
        if done is None or self.late == "skip":
            return None
        rows = changes.where((F.col("ack_lsn") <= done) & ~F.col("op").isin("commit", "relation"))
        if rows.isEmpty():
            return None
        if self.late == "fail":
            raise LateRows(f"micro-batch {batch_id} has rows at or below {done}, which was done before")
        return rows

    # ------------------------------------------------------------ a micro-batch

    def apply(self, changes: DataFrame, batch_id: int, stored: bool = False) -> None:
        """One micro-batch (the body of foreachBatch): changes by name, or rows by place with layouts. Those that are ``stored``
        as files that stay are read where they are."""
        began = self.clock()
        inbox, folder = f"{self.path}/batch/{batch_id}", f"{self.path}/actions/{batch_id}"
        if not stored:
            # The source is read once; all that follows reads the stored rows.
            changes.write.mode("overwrite").parquet(inbox)
            changes = self.spark.read.schema(changes.schema).parquet(inbox)
        if "cols" in changes.columns:
            self.named(changes, self._held(self._border(batch_id), batch_id)).write.mode("overwrite").parquet(f"{inbox}-named")
            changes = self.spark.read.schema(CHANGE_SCHEMA).parquet(f"{inbox}-named")
        changes = changes.select(*COLUMNS)
        late = self._late(changes, batch_id)
        kept, done, numbers = self.whole(changes, batch_id)
        live, before = R.active(self.configs), self.checkpoints.read()
        if self.most_events is not None:
            kept, _ = X.split_oversized(kept, self.most_events)
        seen = Observation()
        routes = R.skip_applied(R.route(kept, live), before, "ack_lsn").observe(seen, F.count_if(F.col("problem").isNotNull()).alias("bad"))
        # User code runs once: its actions are written, and all that follows reads them.
        made = A.checked(self.transform(routes.where(F.col("problem").isNull()).drop("problem")))
        made.write.mode("overwrite").parquet(folder)
        acts = self.spark.read.schema(A.ACTION_SCHEMA).parquet(folder)
        tallied = lambda a: a.agg(F.count_if(F.col("error").isNull()).alias("processed"), F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_distinct("namespace", "batch_id").alias("requests"), F.count("distance_metric").alias("m"), F.count("attr_schema").alias("s")).first()
        tally = tallied(acts)
        if tally.m + tally.s and A.has_mixed(A.fine(acts)):
            acts = A.refuse_mixed(acts)
            tally = tallied(acts)
        self.store.apply(A.fine(acts), batch_id)
        if tally.failed:
            routed = routes.where(F.col("problem").isNull()).select("config", "lsn", "seq", "id_type", "op")
            self.dlq.append(D.entries(A.failed(acts).join(routed, ["config", "lsn", "seq"]), began), batch_id, "failed")
        bad = seen.get.get("bad", 1)
        if bad:
            self.dlq.append(self._permanent(routes.where(F.col("problem").isNotNull()), F.col("problem"), began), batch_id, "bad")
        if late is not None:
            found = R.skip_problem(R.route(late, live))
            self.dlq.append(D.entries(found.withColumn("error", F.lit("late: below the position that was done")), began), batch_id, "late")
        self.dlq.compact(batch_id)
        # Dropped transactions are acknowledged too.
        position = self.spark.createDataFrame([(done,)], "ack_lsn long")
        self.checkpoints.write(S.advance(before, live, A.fine(acts), position, began))
        lag = None if numbers["us"] is None else (began * 1000 - numbers["us"] - PG_EPOCH_MICROS) // 1000
        row = (batch_id, numbers["events"], numbers["transactions"], tally.processed, tally.failed, tally.requests, int(late is not None and late.count()), done, lag, self.clock() - began)
        names = [c.split()[0] for c in METRIC_SCHEMA.split(", ")]
        at = f"{self.path}/metrics/batch-{batch_id:020d}.json"
        self._fs.delete(self._path(at), False)
        write_text(self.spark, at, json.dumps(dict(zip(names, row, strict=True))) + "\n")
        for used in (folder, inbox, f"{inbox}-named"):
            self._fs.delete(self._path(used), True)
        self.passes += 1
        if self.source is not None and self.replay_every and self.passes % self.replay_every == 0:
            self.replay(self.source(), self.id_column, self.most_retries)

    @staticmethod
    def _permanent(rows: DataFrame, error: Column, now_ms: int) -> DataFrame:
        return D.entries(rows.withColumn("error", error), now_ms).withColumns({"kind": F.lit(D.PERMANENT), "permanent_ms": F.lit(now_ms).cast("long")})

    def metrics(self) -> DataFrame:
        """One row for each micro-batch: events, transactions, processed, failed, requests, late, done, lag_ms, took_ms."""
        folder = self._path(f"{self.path}/metrics")
        known = self._fs.exists(folder) and len(self._fs.listStatus(folder))
        return self.spark.read.schema(METRIC_SCHEMA).json(f"{self.path}/metrics") if known else self.spark.createDataFrame([], METRIC_SCHEMA)

    def run(self, stream: DataFrame, checkpoint: str, available_now: bool = True):
        """Start the continuous mirror; with available_now it ends when all that is there has been read. Dead letters are
        drained first, if there is a source."""
        return self._run(stream, self.apply, checkpoint, available_now)

    def _run(self, stream: DataFrame, body: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool):
        if self.source is not None:
            self.drain()
        query = stream.writeStream.foreachBatch(body).option("checkpointLocation", checkpoint).start()
        if available_now:
            try:
                query.processAllAvailable()
            finally:
                query.stop()
        return query

    def run_log(self, log: str, checkpoint: str, segments_per_batch: int | None = None, on_gap: str = "fail", available_now: bool = True, schema: str | StructType = CHANGE_SCHEMA, routed_only: bool = False):
        """The continuous mirror of a log of ordered segments: rows come in log order, whatever came first to the folder. With
        ``routed_only`` files of tables that no config routes aren't opened; their events don't count for ``most_events`` then."""
        tables = routed_tables(R.active(self.configs)) if routed_only else None
        # The stream brings names of files, at most some thousands; every step reads the columns that it needs off the log itself.
        files = log_files(self.spark, log, checkpoint, segments_per_batch, on_gap, tables)
        body = lambda names, batch_id: self.apply(rows_of_files(self.spark, [r["path"] for r in names.collect()], log, schema), batch_id, True)
        return self._run(files, body, checkpoint, available_now)

    # ------------------------------------------------------------ backfill

    def backfill(self, sources: dict[str, DataFrame], current_lsn: int, pieces: int = 16, at_once: int = 4, waves: int | None = None) -> int:
        """Copy the tables of configs that haven't been copied yet, by ranges of ids; the number of ranges still open.

        A ledger keeps every range: ``at_once`` open ones are copied side by side in one job and marked then, so whatever ends
        a run, only open ranges are copied by the next one (``waves`` bounds this run). The position of a config's first start
        stays its watermark; its checkpoint begins there when all its ranges are done."""
        for config in R.active(self.configs).collect():
            if config.name in sources and self.ranges.read().where(F.col("config") == config.name).isEmpty():
                self.ranges.write(self.ranges.read().unionByName(B.plan_ranges(sources[config.name], config.name, config.id_column, pieces, current_lsn)))
        todo = self.ranges.read().where(F.col("status") != B.DONE).orderBy("config", "range_no").collect()
        by_name = {c.name: c for c in R.active(self.configs).collect()}
        todo = [r for r in todo if r.config in sources and r.config in by_name]
        for n, start in enumerate(range(0, len(todo), at_once)):
            if waves is not None and n >= waves:
                break
            wave = todo[start : start + at_once]
            parts = [B.range_actions(sources[r.config], by_name[r.config], r) for r in wave]
            folder = f"{self.path}/actions/backfill-{wave[0].config}-{wave[0].range_no}"
            reduce(DataFrame.unionByName, parts).write.mode("overwrite").parquet(folder)
            acts = self.spark.read.schema(A.ACTION_SCHEMA).parquet(folder)
            # Snapshot rows stand at the watermark, so a range that is copied again, or late, changes nothing that is newer.
            self.store.apply_replay(acts)
            counts = self._range_counts(wave, acts)
            self.ranges.write(S.upsert(self.ranges.read(), counts, ["config", "range_no"]))
            self._fs.delete(self._path(folder), True)
        self._begin_at_watermarks(by_name)
        return self.ranges.read().where(F.col("status") != B.DONE).count()

    def _range_counts(self, wave: list, acts: DataFrame) -> DataFrame:
        done = self.spark.createDataFrame([tuple(r) for r in wave], B.RANGE_SCHEMA).withColumn("status", F.lit(B.DONE))
        counts = acts.groupBy("config", F.col("batch_id").alias("range_no")).agg(F.count("*").alias("_n"))
        return done.join(counts, ["config", "range_no"], "left").withColumn("n_rows", F.coalesce("_n", F.lit(0)).cast("long")).drop("_n")

    def _begin_at_watermarks(self, by_name: dict) -> None:
        """A config without a checkpoint begins at its watermark once it is copied."""
        copied = self.ranges.read().groupBy("config").agg(F.bool_and(F.col("status") == B.DONE).alias("done"), F.min("watermark_lsn").alias("lsn")).where("done")
        fresh = copied.join(self.checkpoints.read().select("config"), "config", "left_anti")
        if not fresh.isEmpty():
            rows = fresh.select("config", "lsn", F.lit(0).cast("long").alias("events_processed"), F.lit(self.clock()).cast("long").alias("updated_ms"))
            self.checkpoints.write(self.checkpoints.read().unionByName(rows))

    # ------------------------------------------------------------ dead letters

    def replay(self, source: DataFrame, id_column: str, most_retries: int = 5, limit: int | None = None) -> int:
        """Replay dead letters against the current rows of their source; the number of successes. All are replayed in one pass
        of a few jobs, as each pass reads all dead letters and rewrites buckets of the mirror (``limit``: the oldest so many).
        Replays have versions of the mirror of their own and leave the micro-batches' ids alone."""
        entries = D.orphans(D.retryable(self.dlq.read(), self.configs, limit), R.active(self.configs))
        sound = D.replay_events(entries.where("reason IS NULL"), source, id_column)
        events = sound.select("dlq_id", "config", "namespace", "lsn", F.lit(-1).cast("long").alias("seq"), F.col("lsn").alias("ack_lsn"), F.col("replay_op").alias("op"), "id", "id_type", "new", "old", F.array().cast("array<string>").alias("unchanged"))
        folder = f"{self.path}/actions/replay-{self.store.manifest()['replay_id'] + 1}"
        A.checked(self.transform(events)).write.mode("overwrite").parquet(folder)
        acts = self.spark.read.schema(A.ACTION_SCHEMA).parquet(folder)
        done = acts.join(sound.select("config", "lsn", "id", "dlq_id"), ["config", "lsn", "id"])
        results = done.groupBy("dlq_id").agg(F.max("error").alias("error")).select("dlq_id", F.col("error").isNull().alias("ok"), "error", F.lit(False).alias("fatal"))
        results = results.unionByName(entries.where("reason IS NOT NULL").select("dlq_id", F.lit(False).alias("ok"), F.col("reason").alias("error"), F.lit(True).alias("fatal"))).persist()
        tally = results.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed")).first()
        # A document written later than the failed event wins by (lsn, seq), so a replay never takes it back.
        self.store.apply_replay(A.fine(acts))
        self.dlq.settle(results, most_retries, self.clock())
        results.unpersist()
        self._fs.delete(self._path(folder), True)
        self.replayed, self.replay_failed = self.replayed + tally.ok, self.replay_failed + tally.failed
        return tally.ok

    def drain(self, stalls: int = 2) -> None:
        """Replay until nothing retryable is left or ``stalls`` passes in a row had no success."""
        idle = 0
        while idle < stalls and not D.retryable(self.dlq.read(), self.configs).isEmpty():
            idle = 0 if self.replay(self.source(), self.id_column, self.most_retries) else idle + 1

    def purge(self, hours: int = 72) -> None:
        self.dlq.purge(self.clock(), hours)
