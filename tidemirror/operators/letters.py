"""Dead letters as an append-only log of entries and outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemirror.operators import dlq as D

#: A line of the log: an entry as it stands from its version on; gone entries were replayed or purged.
LOG_SCHEMA = f"{D.DLQ_SCHEMA}, version long, batch_id long, gone boolean"
#: Folders of lines after which the log is compacted.
COMPACT_AFTER = 64


class DeadLetters:
    """Entries come by micro-batch (version 0), outcomes of replays and purges with versions of their own; the line of the
    highest version counts. Every write adds a folder, by as many tasks as its rows have; nothing is rewritten but in a
    compaction, which starts a new generation of the log now and then. A micro-batch that is run again writes its own
    folder again, and an entry that was replayed in between stays gone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.path}/g=0"))

    def _names(self, folder: str) -> list[str]:
        return [s.getPath().getName() for s in self._fs.listStatus(self._path(folder))]

    def _generation(self) -> int:
        """The newest generation whose base is whole; the first one has no base."""
        known = sorted((int(n[2:]) for n in self._names(self.path) if n.startswith("g=")), reverse=True)
        return next(g for g in known if g == 0 or self._fs.exists(self._path(f"{self.path}/g={g}/base/_SUCCESS")))

    def _folders(self) -> list[str]:
        at = f"{self.path}/g={self._generation()}"
        return [f"{at}/{n}" for n in sorted(self._names(at)) if self._fs.exists(self._path(f"{at}/{n}/_SUCCESS"))]

    def lines(self) -> DataFrame:
        """The last line of every entry, gone ones too."""
        folders = self._folders()
        log = self.spark.read.schema(LOG_SCHEMA).parquet(*folders) if folders else self.spark.createDataFrame([], LOG_SCHEMA)
        names = [c for c in log.columns if c != "dlq_id"]
        last = log.groupBy("dlq_id").agg(F.max_by(F.struct(*names), F.struct("version", "batch_id")).alias("_l"))
        return last.select("dlq_id", "_l.*").select(*log.columns)

    def read(self) -> DataFrame:
        return self.lines().where(~F.col("gone")).select(*D.DLQ_COLUMNS)

    def append(self, entries: DataFrame, batch_id: int, part: str = "entries") -> None:
        """The entries of a micro-batch; writing them again changes nothing."""
        lines = entries.select(*D.DLQ_COLUMNS, F.lit(0).cast("long").alias("version"), F.lit(batch_id).cast("long").alias("batch_id"), F.lit(False).alias("gone"))
        lines.write.mode("overwrite").parquet(f"{self.path}/g={self._generation()}/batch-{batch_id:020d}-{part}")

    def _next(self) -> int:
        """The version of the next replay or purge."""
        return 1 + max((int(n.rsplit("/", 1)[-1].split("-")[1]) for n in self._folders() if "/replay-" in n), default=self._base_version())

    def _base_version(self) -> int:
        return self._generation() * 1_000_000_000

    def _outcomes(self, lines: DataFrame) -> None:
        version = self._next()
        rows = lines.select(*D.DLQ_COLUMNS, F.lit(version).cast("long").alias("version"), "batch_id", "gone")
        rows.write.mode("overwrite").parquet(f"{self.path}/g={self._generation()}/replay-{version:020d}")

    def settle(self, results: DataFrame, most_retries: int, now_ms: int) -> None:
        """What replays brought about: a line for each entry with a result (dlq_id, ok, error, fatal)."""
        held = self.lines().where(~F.col("gone")).join(results.select("dlq_id"), "dlq_id", "left_semi")
        after = D.settle(held.select(*D.DLQ_COLUMNS), results, most_retries, now_ms).withColumn("gone", F.lit(False)).join(held.select("dlq_id", "batch_id"), "dlq_id")
        done = held.join(results.where("ok").select("dlq_id"), "dlq_id", "left_semi").withColumn("gone", F.lit(True))
        self._outcomes(after.select(*D.DLQ_COLUMNS, "batch_id", "gone").unionByName(done.select(*D.DLQ_COLUMNS, "batch_id", "gone")))

    def purge(self, now_ms: int, hours: int = 72) -> None:
        """Permanent entries older than so many hours go."""
        held = self.lines().where(~F.col("gone"))
        self._outcomes(held.join(D.purge(held.select(*D.DLQ_COLUMNS), now_ms, hours).select("dlq_id"), "dlq_id", "left_anti").withColumn("gone", F.lit(True)))

    def compact(self, batch_id: int, after: int | None = None) -> bool:
        """Start a new generation if the log has many folders. Lines of gone entries stay as long as their micro-batch may
        be run again (it is one of the last two)."""
        if len(self._folders()) <= (COMPACT_AFTER if after is None else after):
            return False
        old = self._generation()
        kept = self.lines().where(~F.col("gone") | (F.col("batch_id") >= batch_id - 1))
        kept.write.mode("overwrite").parquet(f"{self.path}/g={old + 1}/base")
        for name in self._names(self.path):
            if name.startswith("g=") and int(name[2:]) < old:  # readers may still hold the last one
                self._fs.delete(self._path(f"{self.path}/{name}"), True)
        return True
