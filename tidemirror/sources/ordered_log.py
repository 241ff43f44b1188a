"""A change log on disk that is read in log order, whatever the order in which its files came.

The log is a folder of segments. A segment's name tells the positions it covers, ``segment=<after>-<upto>`` with positions
(ack_lsn, seq) written as ``ack_lsn.seq``: all rows behind the first up to the second. Segments follow one another without a
hole: each begins where the one before ends. So the reader knows what is missing. It is a streaming source whose offsets are
positions of the log:

* a micro-batch takes the next segments that join up, at most ``segments_per_batch`` of them;
* a segment that isn't there yet holds back all that come later (``on_gap=wait``), or stops the query (``on_gap=fail``);
* segments that overlap stop the query: no row is delivered twice or passed over;
* after a restart reading goes on behind the last offset in Spark's own offset log.

Within a segment the rows of each source table have a folder of their own (``of=<schema>.<table>``), rows without a table
(commits) one more. So a reader that is told the routed tables opens only their files, as a stream (option ``tables``) and as a
table (``log_changes``). A segment's rows are cut into files of about PIECE_ROWS by position, however large it is: one task
sorts and writes so many, and one task reads one file (or several small ones) in Arrow batches. The driver lists the names of
segments, and of the files of a micro-batch. Where a micro-batch is worked on by jobs of its own, the stream can bring these
names only (``log_files``), and Spark reads the files themselves (``rows_of_files``).
"""

from __future__ import annotations

import json
import re
import uuid
from urllib.parse import unquote
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import DataStreamReader
from pyspark.sql.types import StructType

from tidemirror.sources.changelog import SCHEMA

#: The folder of a table's rows in a segment; rows without a table are in Spark's folder for null.
OF = re.compile(r"/of=([^/]+)/")
NO_TABLE = "__HIVE_DEFAULT_PARTITION__"
NAME = re.compile(r"segment=(\d+)\.(\d+)-(\d+)\.(\d+)$")
#: Rows of a log that one task sorts and writes, and bytes of small files that one task reads.
PIECE_ROWS, READ_BYTES = 250_000, 4 << 20
Position = tuple[int, int]
START: Position = (0, 0)


class LogError(PySparkException):
    """The log has a hole or overlapping segments."""

    def __init__(self, text: str):
        super().__init__(text)


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub(r"^file:/+", "/", path)
    return (pafs.LocalFileSystem(), path) if path.startswith("/") else pafs.FileSystem.from_uri(path)


def segments_in(fs: pafs.FileSystem, path: str) -> list[tuple[Position, Position, str]]:
    """(after, upto, folder) of all segments, in log order."""
    found = []
    for info in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True)):
        name = NAME.search(info.path)
        if name and info.type == pafs.FileType.Directory:
            a, b, c, d = map(int, name.groups())
            found.append(((a, b), (c, d), info.path))
    return sorted(found)


def chain(segments: list[tuple[Position, Position, str]], at: Position) -> tuple[list[tuple[Position, Position, str]], Position | None]:
    """The segments that join up from a position on, and where the first one behind a hole begins, if there is a hole."""
    out = []
    for after, upto, folder in segments:
        if upto <= at and not out:
            continue
        if after < at:
            raise LogError(f"segments overlap: {folder} begins at {after}, before {at}")
        if after > at:
            return out, after
        out.append((after, upto, folder))
        at = upto
    return out, None


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


def packed(segments: Iterable[list[tuple[str, int]]]) -> list[list[str]]:
    """Files of segments, dealt to tasks: a large file has one of its own, small ones are read together up to READ_BYTES."""
    out, held = [], READ_BYTES
    for path, size in (f for files in segments for f in files):
        if not out or held + size > READ_BYTES:
            out.append([])
            held = 0
        out[-1].append(path)
        held += size
    return out


class LogReader(DataSourceStreamReader):
    def __init__(self, schema: StructType, options: dict):
        self.schema, self.options = schema, options
        self.path = options["path"]
        self.most = int(options.get("segments_per_batch", 1 << 30))
        self.tables = {*json.loads(options["tables"]), NO_TABLE} if "tables" in options else None
        self.names = options.get("names") == "true"
        # After a restart; a first micro-batch that is run again still begins at the log's start.
        self.at: Position = tuple(json.loads(options["from"])) if "from" in options else START

    def initialOffset(self) -> dict:
        return {"ack_lsn": START[0], "seq": START[1]}

    def latestOffset(self) -> dict:
        fs, path = file_system(self.path)
        ready, hole = chain(segments_in(fs, path), self.at)
        if not ready and hole and self.options.get("on_gap") == "fail":
            raise LogError(f"the log has a hole: nothing between {self.at} and {hole}")
        if ready:
            self.at = ready[: self.most][-1][1]
        return {"ack_lsn": self.at[0], "seq": self.at[1]}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        fs, path = file_system(self.path)
        a, b = (start["ack_lsn"], start["seq"]), (end["ack_lsn"], end["seq"])
        self.at = max(self.at, b)
        own = [s for s in segments_in(fs, path) if s[0] >= a and s[1] <= b]
        joined, _ = chain(own, a)
        if a != b and (not joined or joined[-1][1] != b):
            raise LogError(f"segments between {a} and {b} are gone")
        return [Files(paths) for paths in packed(self.files(fs, folder) for _, _, folder in joined)]

    def files(self, fs: pafs.FileSystem, folder: str) -> list[tuple[str, int]]:
        """(path, bytes) of a segment's files that are wanted."""
        found = fs.get_file_info(pafs.FileSelector(folder, recursive=True))
        return sorted((i.path, i.size) for i in found if i.path.endswith(".parquet") and self.wanted(i.path))

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        fs, root = file_system(self.path)
        want = to_arrow_schema(self.schema)
        if self.names:
            yield pa.RecordBatch.from_arrays([pa.array([p[len(root.rstrip("/")) + 1 :] for p in partition.paths], pa.string())], schema=want)
            return
        for path in partition.paths:
            with pq.ParquetFile(path, filesystem=fs) as file:
                for batch in file.iter_batches(8_192, columns=want.names):
                    yield pa.RecordBatch.from_arrays([batch.column(n).cast(want.field(n).type) for n in want.names], schema=want)

    def wanted(self, path: str) -> bool:
        of = OF.search(path)
        return self.tables is None or of is None or unquote(of.group(1)) in self.tables


class OrderedLog(DataSource):
    """``spark.readStream.format("ordered_log").option("path", ...)``"""

    @classmethod
    def name(cls) -> str:
        return "ordered_log"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> LogReader:
        return LogReader(schema, dict(self.options))


def last_offset(spark: SparkSession, checkpoint: str) -> Position | None:
    """The newest position in a streaming query's offset log."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    folder = path(f"{checkpoint}/offsets")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    known = [int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()] if fs.exists(folder) else []
    if not known:
        return None
    stream = fs.open(path(f"{checkpoint}/offsets/{max(known)}"))
    try:
        lines = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()
    offset = json.loads(lines[-1])
    return offset["ack_lsn"], offset["seq"]


def read_log(spark: SparkSession, path: str, checkpoint: str, segments_per_batch: int | None = None, on_gap: str = "wait", schema: str | StructType = SCHEMA, tables: list[str] | None = None) -> DataFrame:
    """The log as a stream, for a query with this checkpoint folder; with ``tables`` only those tables' rows, and rows without
    a table."""
    return _reader(spark, path, checkpoint, segments_per_batch, on_gap, tables).schema(schema).load()


def log_files(spark: SparkSession, path: str, checkpoint: str, segments_per_batch: int | None = None, on_gap: str = "wait", tables: list[str] | None = None) -> DataFrame:
    """The same as a stream of the files' names below the log's folder; no row is read."""
    return _reader(spark, path, checkpoint, segments_per_batch, on_gap, tables).option("names", "true").schema("path string").load()


def rows_of_files(spark: SparkSession, names: list[str], path: str, schema: str | StructType = SCHEMA) -> DataFrame:
    """The rows of files of the log at ``path``. Spark deals row groups to tasks, and reads the columns that are asked for."""
    return spark.read.schema(schema).parquet(*[f"{path.rstrip('/')}/{n}" for n in names]) if names else spark.createDataFrame([], schema)


def _reader(spark: SparkSession, path: str, checkpoint: str, segments_per_batch: int | None, on_gap: str, tables: list[str] | None) -> DataStreamReader:
    spark.dataSource.register(OrderedLog)
    reader = spark.readStream.format("ordered_log").option("path", path).option("on_gap", on_gap)
    if segments_per_batch:
        reader = reader.option("segments_per_batch", segments_per_batch)
    if tables is not None:
        reader = reader.option("tables", json.dumps(tables))
    at = last_offset(spark, checkpoint)
    return reader if at is None else reader.option("from", json.dumps(at))


def position_text(at: Position) -> str:
    return f"{at[0]:020d}.{at[1]:020d}"


def table_name() -> Column:
    """schema.table of a change; null if it has no table."""
    return F.when(F.col("src_table").isNotNull(), F.concat_ws(".", "src_schema", "src_table"))


def routed_tables(configs: DataFrame) -> list[str]:
    """The tables that configs route, by name. Configs are kept by hand, so these are few."""
    return [r["t"] for r in configs.select(table_name().alias("t")).where("t IS NOT NULL").distinct().orderBy("t").collect()]


def log_changes(spark: SparkSession, path: str, tables: list[str] | None = None, after: Position | None = None) -> DataFrame:
    """The log as a table. Segments that end at or before ``after``, and tables that aren't named, are pruned by their folders."""
    rows = spark.read.schema(f"{SCHEMA}, segment string, of string").option("basePath", path).parquet(path)
    if tables is not None:
        rows = rows.where(F.col("of").isNull() | F.col("of").isin(tables))
    if after is not None:
        behind = (F.col("ack_lsn") > after[0]) | ((F.col("ack_lsn") == after[0]) & (F.col("seq") > after[1]))
        rows = rows.where(F.substring_index("segment", "-", -1) > position_text(after)).where(behind)
    return rows.drop("segment", "of")


def log_end(spark: SparkSession, path: str) -> Position | None:
    """Where the last segment of a log ends; None for a log without segments."""
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    names = [NAME.search(s.getPath().getName()) for s in fs.listStatus(place(path))]
    return max((tuple(map(int, m.groups()[2:])) for m in names if m), default=None)


def append_log(changes: DataFrame, path: str, segments: int = 1, after: Position | None = None) -> None:
    """Append changes, all behind the log's end (or behind ``after``), as segments of about equal size, each of as many files
    (of a table) as its rows need.

    They are written beside the log first and come into it by one rename each, so a reader never sees half a segment."""
    spark = changes.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path
    fs = place(path).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(place(path))
    if after is None:
        after = log_end(spark, path) or START
    pieces = max(1, -(-changes.count() // (segments * PIECE_ROWS)))
    placed = changes.repartitionByRange(segments * pieces, "ack_lsn", "seq").withColumns({"_part": F.floor(F.spark_partition_id() / pieces).cast("int"), "of": table_name()})
    # The order that the writer wants comes first, so there is one sort.
    parts = placed.sortWithinPartitions("_part", "of", "ack_lsn", "seq")
    beside = f"{path}/.writing-{uuid.uuid4().hex}"
    parts.write.partitionBy("_part", "of").parquet(beside)
    ends = spark.read.parquet(beside).groupBy("_part").agg(F.min(F.struct("ack_lsn", "seq")).alias("first"), F.max(F.struct("ack_lsn", "seq")).alias("last")).orderBy("first").collect()  # one row for each segment
    if ends and tuple(ends[0]["first"]) <= after:
        fs.delete(place(beside), True)
        raise LogError(f"rows at {tuple(ends[0]['first'])} are not behind the log's end {after}")
    for r in ends:
        upto = tuple(r["last"])
        if not fs.rename(place(f"{beside}/_part={r['_part']}"), place(f"{path}/segment={position_text(after)}-{position_text(upto)}")):
            raise LogError(f"segment up to {upto} is there already")
        after = upto
    fs.delete(place(beside), True)
