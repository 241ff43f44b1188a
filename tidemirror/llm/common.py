"""What several operators share: table access, checkpoints, and numpy helpers that run inside tasks."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Rows of an Arrow batch. Texts are long, so far fewer than Spark's 10,000.
BATCH_ROWS = 512
#: Bytes of text that a task turns into numpy arrays at once (one longer text makes a block of its own).
BLOCK_BYTES = 1 << 19


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keep Arrow batches of long texts small."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir. Without it, a temporary one in local mode only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


@dataclass
class Stored:
    """A table written as Parquet into the shared folder, to be dropped when it has served."""

    df: DataFrame
    path: str

    def drop(self) -> None:
        remove(self.df.sparkSession, self.path)


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def stored(df: DataFrame) -> Stored:
    """Write a table into the cluster's shared folder and read it back from there.

    Unlike checkpoint() this computes the last stage once, and Parquet is small. The shuffles behind it have served then;
    Spark is asked to remove their files with the job that made them.
    """
    spark = df.sparkSession
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    path, seen = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}", Observation()
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out, rows = spark.read.schema(df.schema).parquet(path), seen.get.get("n")
    return Stored(counted(out, out.count() if rows is None else rows), path)


def counted(df: DataFrame, rows: int) -> DataFrame:
    """The table with its known number of rows."""
    df.n_rows = rows
    return df


def rows_of(df: DataFrame) -> int:
    """The number of rows; stored tables were counted as they were written."""
    known = getattr(df, "n_rows", None)
    return df.count() if known is None else known


class Scratch:
    """The intermediate tables of one operator: ``with Scratch() as s: t = s.keep(df)``. All go at the end of the block, some
    before (``s.drop(t)``); what an operator returns is ``stored`` on its own."""

    def __init__(self) -> None:
        self.tables: dict[int, Stored] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_) -> None:
        for t in self.tables.values():
            t.drop()
        self.tables.clear()

    def keep(self, df: DataFrame) -> DataFrame:
        """The same rows without their lineage: later steps reread them, lost executors cost nothing."""
        t = stored(df)
        self.tables[id(t.df)] = t
        return t.df

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            self.tables.pop(id(df)).drop()


#: Rows of ids that may be broadcast (some 50 bytes each).
BROADCAST_ROWS = 500_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The table, marked for broadcast if its counted rows allow; else Spark joins it by a shuffle."""
    return F.broadcast(df) if rows_of(df) <= rows else df


#: Rows of one key that one task joins.
HOT_ROWS = 20_000


def hot_keys(counts: DataFrame, key: str, total: int, rows: int) -> DataFrame:
    """(key, _parts) of the keys that hold more than ``rows`` of ``total`` rows, from their counts (key, _n). At most
    BROADCAST_ROWS keys: in a table so large that there could be more, the bound on rows rises with the table."""
    most = max(rows, total // BROADCAST_ROWS)
    return F.broadcast(counts.where(F.col("_n") > most).select(key, F.ceil(F.col("_n") / most).cast("int").alias("_parts")))


def join_hot(left: DataFrame, right: DataFrame, key: str, how: str = "inner", rows: int | None = None, like: DataFrame | None = None, counts: DataFrame | None = None) -> DataFrame:
    """left.join(right, key, how) for a right side with one row for each key: the left rows of a hot key are dealt over several
    tasks (of ``rows`` rows, HOT_ROWS if not said), each of which gets that key's right row. Keys are counted in ``like``, a
    stored table that has as many rows of each key as left, or come counted (key, _n)."""
    rows, like = HOT_ROWS if rows is None else rows, left if like is None else like
    total = rows_of(like)
    if total <= rows:
        return left.join(right, key, how)
    hot = hot_keys(like.groupBy(key).agg(F.count("*").alias("_n")) if counts is None else counts, key, total, rows)
    parts = F.coalesce("_parts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("_salt", F.pmod(F.monotonically_increasing_id(), parts).cast("int")).drop("_parts")
    each = right.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(each, [key, "_salt"], how).drop("_salt")


def bounded_sample(df: DataFrame, key: str, rows: int, text: str | None = None, characters: int = 0, seed: int = 7) -> DataFrame:
    """About ``rows`` rows (all, if fewer) of about ``characters`` characters of text in all, if a text column is named; chosen
    by a hash of the key, so the same on every run. Rows come whole."""
    size = F.lit(0) if text is None else F.coalesce(F.sum(F.length(text)), F.lit(0))
    total = df.agg(F.count("*").alias("n"), size.alias("c")).first()
    share = min(1.0, rows / max(1, total["n"]), characters / total["c"] if text is not None and total["c"] else 1.0)
    if share == 1.0:
        return df
    return df.where(F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(10_000_000)) < int(share * 10_000_000))


# ---------------------------------------------------------------- what a Python worker remembers between its tasks

_memories: list[dict] = []


def memory() -> dict:
    """What an operator's tasks leave in their Python worker for its next tasks, until ``forget``."""
    _memories.append({})
    return _memories[-1]


def forget() -> None:
    """Drop what other operators' tasks left in this worker: Spark keeps workers, and with them the memory, for the session."""
    for m in _memories:
        m.clear()


# ---------------------------------------------------------------- numpy helpers, run inside tasks

_MUL = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: Powers that a worker remembers; those of a longer text go with it.
POWERS = 1 << 20


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_pow[0]) < n:
        found = []
        for base in (_BASE, _INV):
            p = np.full(n if n > POWERS else min(n + (1 << 16), POWERS), base, np.uint64)
            p[0] = 1
            found.append(np.multiply.accumulate(p, out=p))
        if n > POWERS:
            return found[0], found[1]
        _pow[:] = found
    return _pow[0][:n], _pow[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Finish a 64-bit hash so that all its bits can be used."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(29))
    x = x * _MUL
    return x ^ (x >> np.uint64(32))


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[start:end] for many spans at once, by prefix sums of a polynomial."""
    n = len(buf)
    up, down = _powers(n + 1)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:n], out=pre[1:])
    return mix((pre[end] - pre[start]) * down[start] + (end - start).astype(np.uint64) * _MUL)


def blocks(texts: list[bytes], limit: int = BLOCK_BYTES) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of about ``limit`` bytes, with the index of the first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, texts[at:]


def as_bytes(values) -> list[bytes]:
    return [b"" if v is None or v != v else v.encode("utf-8", "surrogatepass") for v in values]


def word_table(separators: bytes) -> np.ndarray:
    is_word = np.ones(256, bool)
    is_word[list(separators)] = False
    return is_word


def words_of(texts: list[bytes], is_word: np.ndarray, sep: bytes = b" ") -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buf, start, end, owner): the words of all texts, as byte spans of one buffer, and each word's text."""
    joined = sep.join(texts) + sep
    buf = np.frombuffer(joined, np.uint8)
    lens = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens + len(sep), out=at[1:])
    inside = is_word[buf]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    owner = np.searchsorted(at, start, side="right") - 1
    return buf, start, end, owner


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a, b): every node that has an edge to another, with the smallest node it reaches.

    Alternating large and small stars: each step is a minimum for each node, so a node with very many edges costs no task
    more than its share. The result is a stored table of its own.
    """
    return stored_components(edges).df


def stored_components(edges: DataFrame) -> Stored:
    def written(df: DataFrame) -> tuple[Stored, dict]:
        # Number and hash sums: two sets of edges that agree in all are the same.
        h, seen = F.xxhash64("a", "b"), Observation()
        t = stored(df.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("x"), F.sum(F.xxhash64(h, "a").cast("decimal(38,0)")).alias("y")))
        return t, seen.get

    current, digest = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    while True:
        # Neighbours on both sides: low is the least that a node sees, itself included.
        both = current.df.unionByName(current.df.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small_ = large.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        after, digest_after = written(small_.unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        current.drop()
        same, digest, current = digest == digest_after, digest_after, after
        if same:
            current.df = counted(current.df.select(F.col("a").alias("node"), F.col("b").alias("label")), rows_of(current.df))
            return current
