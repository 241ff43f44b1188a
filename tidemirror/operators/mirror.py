"""The mirror: the latest document of every id in every namespace, as versioned Parquet, and queries over it."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

MIRROR_SCHEMA = "namespace string, id string, document string, vector array<float>, distance_metric string, lsn long, seq long, deleted boolean"
MIRROR_COLUMNS = [c.split()[0] for c in MIRROR_SCHEMA.split(", ")]
#: Manifests (and what they use) that readers may still hold.
KEPT_VERSIONS = 10


def latest(actions: DataFrame) -> DataFrame:
    """The last action of every document by (lsn, seq), as mirror rows; deletes stay as marked rows.

    max_by combines on the map side, so an id with very many changes costs one row for each task."""
    return newest(as_rows(actions))


def as_rows(actions: DataFrame) -> DataFrame:
    """Upserts and deletes as mirror rows."""
    return actions.where(F.col("action").isin("upsert", "delete")).select("namespace", "id", "document", "vector", "distance_metric", "lsn", "seq", (F.col("action") == "delete").alias("deleted"))


def newest(rows: DataFrame) -> DataFrame:
    body = F.struct("document", "vector", "distance_metric", "lsn", "seq", "deleted")
    best = rows.groupBy("namespace", "id").agg(F.max_by(body, F.struct("lsn", "seq")).alias("_r"))
    return best.select("namespace", "id", "_r.*").select(*MIRROR_COLUMNS)


def visible(mirror: DataFrame) -> DataFrame:
    return mirror.where(~F.col("deleted")).drop("deleted")


def merge(mirror: DataFrame, actions: DataFrame) -> DataFrame:
    """The mirror after the actions. Older or repeated actions change nothing."""
    return newest(mirror.select(*MIRROR_COLUMNS).unionByName(latest(actions)))


def drop_markers(mirror: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Delete markers below every checkpoint can't be overtaken any more."""
    low = checkpoints.agg(F.min("lsn").alias("_low"))  # one row
    return mirror.crossJoin(F.broadcast(low)).where(~(F.col("deleted") & (F.col("lsn") < F.coalesce("_low", F.lit(-1))))).drop("_low")


def delete_namespace(mirror: DataFrame, namespace: str) -> DataFrame:
    return mirror.where(F.col("namespace") != namespace)


def list_namespaces(mirror: DataFrame, prefix: str = "", cursor: str | None = None, n: int = 100) -> DataFrame:
    rows = visible(mirror).select("namespace").distinct().where(F.col("namespace").startswith(prefix))
    if cursor is not None:
        rows = rows.where(F.col("namespace") > cursor)
    return rows.orderBy("namespace").limit(n)


def write_statistics(actions: DataFrame) -> DataFrame:
    of = lambda kind: F.count_if(F.col("action") == kind).alias({"upsert": "upserts", "delete": "deletes", "skip": "skips"}[kind])
    return actions.groupBy("namespace").agg(F.count_distinct("batch_id").alias("calls"), of("upsert"), of("delete"), of("skip"))


def read_text(spark: SparkSession, path: str) -> str:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = at.getFileSystem(spark._jsc.hadoopConfiguration()).open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file and put it in place by one rename; False if the place is taken."""
    folder, name = path.rsplit("/", 1)
    temporary, at = (spark._jvm.org.apache.hadoop.fs.Path(p) for p in (f"{folder}/.{name}.tmp", path))
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    out = fs.create(temporary, True)
    out.write(bytearray(text.encode()))
    out.close()
    return fs.rename(temporary, at)


class MirrorStore:
    """Versioned Parquet. A version rewrites only the touched buckets of (namespace, id); a manifest, put in place by one
    rename, lists each bucket's version. Applying a batch id a second time does nothing. Replays are numbered apart from
    batches (replay_id), so they never take a batch's id. Versions older than the last KEPT_VERSIONS manifests go."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path.rstrip("/"), buckets
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(self.path))

    def manifest(self) -> dict:
        """The newest complete manifest: version, batch_id, and the version of each bucket."""
        best = -1
        for status in self._fs.listStatus(self._path(self.path)):
            name = status.getPath().getName()
            if name.startswith("manifest-") and name.endswith(".json"):
                best = max(best, int(name[9:-5]))
        if best < 0:
            return {"version": 0, "batch_id": -1, "replay_id": 0, "buckets": {}}
        return self._load(best)

    def _load(self, version: int) -> dict:
        return json.loads(read_text(self.spark, f"{self.path}/manifest-{version}.json"))

    def _commit(self, manifest: dict) -> None:
        if not write_text(self.spark, f"{self.path}/manifest-{manifest['version']}.json", json.dumps(manifest)):
            raise RuntimeError("another writer committed this version")
        self._forget(manifest["version"] - KEPT_VERSIONS)

    def _forget(self, version: int) -> None:
        """Drop a manifest and those of its buckets that the next manifest doesn't use."""
        at = self._path(f"{self.path}/manifest-{version}.json")
        if version < 1 or not self._fs.exists(at):
            return
        old, after = self._load(version)["buckets"], self._load(version + 1)["buckets"]
        for bucket, v in old.items():
            if after.get(bucket) != v:
                self._fs.delete(self._path(f"{self.path}/v={v}/bucket={bucket}"), True)
        self._fs.delete(at, False)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("namespace", "id"), F.lit(self.buckets)).cast("int")

    def read(self, buckets: list[int] | None = None, markers: bool = False) -> DataFrame:
        held = {int(b): v for b, v in self.manifest()["buckets"].items() if buckets is None or int(b) in buckets}
        if not held:
            rows = self.spark.createDataFrame([], MIRROR_SCHEMA)
        else:
            rows = self.spark.read.schema(MIRROR_SCHEMA).parquet(*[f"{self.path}/v={v}/bucket={b}" for b, v in held.items()])
        return rows if markers else visible(rows)

    def apply(self, actions: DataFrame, batch_id: int) -> bool:
        """Merge a batch; False if it was applied before."""
        now = self.manifest()
        if batch_id <= now["batch_id"]:
            return False
        self._merge(actions, now, batch_id=batch_id)
        return True

    def apply_replay(self, actions: DataFrame) -> None:
        """Merge replayed actions. Doing it again changes nothing, as documents only give way to later positions."""
        now = self.manifest()
        self._merge(actions, now, replay_id=now["replay_id"] + 1)

    def _merge(self, actions: DataFrame, now: dict, **ids: int) -> None:
        fresh = as_rows(actions)
        # At most as many as there are buckets; only names and ids are read for it.
        touched = [r[0] for r in fresh.select(self._bucket().alias("bucket")).distinct().collect()]
        version = now["version"] + 1
        held = dict(now["buckets"])
        if touched:
            old = self.read(touched, markers=True)
            merged = newest(old.unionByName(fresh)).withColumn("bucket", self._bucket())
            merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/v={version}")
            held |= {str(b): version for b in touched}
        self._commit(now | {"version": version, "buckets": held} | ids)


# ---------------------------------------------------------------- queries over a namespace


def first_documents(mirror: DataFrame, namespace: str, k: int = 10, id_type: str = "string") -> DataFrame:
    """The first k documents by id; numeric ids in order of their numbers."""
    key = F.col("id").cast("decimal(20,0)") if id_type in ("uint", "int") else F.col("id")
    return mirror.where(F.col("namespace") == namespace).orderBy(key, "id").limit(k)


def rank_by_attribute(mirror: DataFrame, namespace: str, attribute: str, k: int, attributes: list[str], descending: bool = False, as_type: str = "string") -> DataFrame:
    """Top k by one attribute, with chosen attributes; documents without it come last, ties go to the smaller id."""
    value = lambda a: F.get_json_object("document", f"$.{a}")
    key = value(attribute).try_cast(as_type)
    rows = mirror.where(F.col("namespace") == namespace)
    return rows.orderBy(key.desc_nulls_last() if descending else key.asc_nulls_last(), "id").limit(k).select("id", *[value(a).alias(a) for a in attributes])


def distance(metric: str, a: Column, b: Column) -> Column:
    """cosine_distance or euclidean_squared of two vectors, in doubles."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    if metric == "cosine_distance":
        return F.lit(1.0) - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))
    if metric == "euclidean_squared":
        return F.aggregate(F.zip_with(a, b, lambda p, q: (p.cast("double") - q.cast("double")) * (p.cast("double") - q.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    raise ValueError(f"unknown metric {metric}")


#: Bytes of query vectors that are broadcast at once, and vectors and queries whose distances a task holds at once.
QUERY_BYTES, VECTOR_ROWS, QUERY_ROWS = 64 << 20, 2_048, 1_024


class Nearest:
    """The k nearest vectors of every query that a task has seen, by (distance, id)."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.q, self.k, self.metric = queries, k, metric
        self.square = (queries * queries).sum(axis=1)
        self.query, self.dist = np.zeros(0, np.int64), np.zeros(0)
        self.ids: np.ndarray | None = None
        self.worst = np.full(len(queries), np.inf)  # the k-th distance, once there is one

    def exact(self, x: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Distances row by row: equal vectors have equal ones, wherever they stand."""
        if self.metric == "euclidean_squared":
            return ((x - q) ** 2).sum(axis=1)
        with np.errstate(invalid="ignore", divide="ignore"):
            return 1.0 - (x * q).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (q * q).sum(axis=1))

    def about(self, x: np.ndarray, at: slice) -> tuple[np.ndarray, np.ndarray]:
        """Distances by a matrix product, and how far they may be off."""
        dot, square = x @ self.q[at].T, (x * x).sum(axis=1)[:, None]
        if self.metric == "euclidean_squared":
            far = square + self.square[at] - 2 * dot
            return far, 1e-9 * (square + self.square[at])
        with np.errstate(invalid="ignore", divide="ignore"):
            far = 1.0 - dot / np.sqrt(square * self.square[at])
        return far, np.full(far.shape, 1e-9)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        for begin in range(0, len(self.q), QUERY_ROWS):
            at = slice(begin, begin + QUERY_ROWS)
            far, off = self.about(x, at)
            far = np.where(np.isnan(far), np.inf, far)
            least = np.partition(far + off, self.k - 1, axis=0)[self.k - 1] if len(x) > self.k else np.inf
            row, query = np.nonzero(far - off <= np.minimum(self.worst[at], least))
            query += begin
            self.keep(query, self.exact(x[row], self.q[query]), ids[row])

    def keep(self, query: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
        query, dist = np.concatenate([self.query, query]), np.concatenate([self.dist, dist])
        ids = ids if self.ids is None else np.concatenate([self.ids, ids])
        order = np.lexsort((ids, dist, query))  # no distance (nan) comes last
        query, dist, ids = query[order], dist[order], ids[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        top = place < self.k
        self.query, self.dist, self.ids = query[top], dist[top], ids[top]
        full = self.query[place[top] == self.k - 1]
        far = self.dist[place[top] == self.k - 1]
        self.worst[full] = np.where(np.isnan(far), np.inf, far)


def vector_top_k(vectors: DataFrame, queries: DataFrame, k: int, metric: str, query_bytes: int | None = None) -> DataFrame:
    """Exact top k of each query (query_id, query) among vectors (id, vector); vectors or queries that are null, hold nulls or
    are of another length than the first query take no part, and those without a distance come last.

    Queries are counted and broadcast as a matrix of at most QUERY_BYTES; more are dealt by hash into passes of about so many,
    each of which scans the vectors once. A task multiplies blocks of vectors with the matrix and keeps k rows of each query;
    only those are shuffled."""
    if metric not in ("cosine_distance", "euclidean_squared"):
        raise ValueError(f"unknown metric {metric}")
    whole = lambda c: F.col(c).isNotNull() & F.forall(c, lambda x: x.isNotNull())
    asked, held = queries.select("query_id", "query").where(whole("query")), vectors.select("id", "vector").where(whole("vector"))
    out = f"query_id {queries.schema['query_id'].dataType.simpleString()}, id {vectors.schema['id'].dataType.simpleString()}, dist double"
    size = asked.agg(F.count("*").alias("n"), F.first(F.size("query")).alias("dim")).first()
    dim = size["dim"] or 0
    passes = max(1, -(-size["n"] * max(1, dim) * 8 // (QUERY_BYTES if query_bytes is None else query_bytes)))
    found = [_one_pass(held, asked.where((F.size("query") == dim) & (F.pmod(F.xxhash64("query_id", "query"), F.lit(passes)) == n)), k, metric, dim, out) for n in range(passes)]
    order = Window.partitionBy("query_id").orderBy("dist", "id")
    return reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")


def _one_pass(vectors: DataFrame, queries: DataFrame, k: int, metric: str, dim: int, out: str) -> DataFrame:
    spark = vectors.sparkSession
    rows = queries.collect()  # at most about QUERY_BYTES, see above
    names = [r["query_id"] for r in rows]
    shared = spark.sparkContext.broadcast(np.array([r["query"] for r in rows], np.float64).reshape(len(rows), dim))
    asked = spark.sparkContext.broadcast(names)
    kinds = to_arrow_schema(StructType.fromDDL(out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not len(shared.value):
            return
        best = Nearest(shared.value, k, metric)
        for batch in batches:
            for at in range(0, batch.num_rows, VECTOR_ROWS):
                part = batch.slice(at, VECTOR_ROWS)
                ids = part.column(0).to_numpy(zero_copy_only=False)
                ids = ids.astype(str) if ids.dtype == object else ids
                best.add(ids, part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, dim))
        if best.ids is not None:
            columns = [[asked.value[i] for i in best.query], best.ids.tolist(), best.dist]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)

    return vectors.where(F.size("vector") == dim).select("id", "vector").mapInArrow(run, out)
