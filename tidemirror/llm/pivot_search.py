"""Exact top-k search by inner product with a pivot-distance index.

With M the largest squared norm, a vector x gets one more coordinate sqrt(M - |x|^2) and a query gets 0 there. Then
``|q - x|^2 = |q|^2 + M - 2 q.x``: the highest inner products are the nearest points. Every vector is keyed by its nearest
pivot and its distance to it; a pivot's distances are cut into annuli, and an annulus into blocks of bounded size. A query
sorts the annuli by the highest score that the triangle inequality lets them hold and expands over them in waves, each some
times wider than the one before. After each wave its k-th score so far is its bound: annuli that can't reach it are closed,
and a query stops when the next annulus is closed. So the number of waves grows with the logarithm of the table.

Numbers of pivots and annuli grow with the table up to a bound. Both come from a bounded sample and only steer the work:
every vector is indexed, results are exact whatever they are, so recall is 1. How many rows are scored depends on the data:
vectors in clusters close most annuli, directions spread evenly over many dimensions close none.

Defined results: vectors that are null or hold null or non-finite components, and rows without id, take no part; shorter
vectors count as filled up with zeros; an id given several times is one query (of its smallest vector) and several
candidates, none of them its own; with fewer than k others all are returned; ties go to the smaller id; components so large
that a product could leave the range of a 64-bit integer are an error; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_sample, rows_of, stored, table

K = 10
SCALE = 1024
QUERY_EVERY = 100
#: Vectors that pivots and annuli are chosen from, and vectors of a block.
SAMPLE_ROWS, BLOCK_ROWS = 4_000, 4_096
MAX_PIVOTS, MAX_RINGS = 256, 64
#: Rows of an annulus, as long as there are fewer than MAX_RINGS.
RING_ROWS = 32
#: Rows that a query's first wave reaches, in k, and how many times wider each further wave is.
FIRST_WAVE, WIDER = 3, 16
QUERY_CHUNK = 256
#: Rows of an Arrow batch where a row is a block of vectors.
BLOCK_BATCH = 8


def integer_vector(v: Column, scale: int = SCALE) -> Column:
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def usable(v: Column) -> Column:
    big = F.lit(float("inf"))
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) != big))


@dataclass
class Geometry:
    """Pivots, annulus borders and the directory of annuli. Of bounded size, whatever the number of vectors."""

    dim: int
    most: float  # largest squared norm
    exact: bool  # products fit a double exactly
    pivots: np.ndarray  # p x (dim + 1)
    borders: list[np.ndarray]
    cells: dict[str, np.ndarray] | None = None

    def distances(self, x: np.ndarray, extra: np.ndarray) -> np.ndarray:
        square = (x * x).sum(axis=1) + extra**2
        p2 = (self.pivots**2).sum(axis=1)
        d2 = square[:, None] + p2 - 2 * (x @ self.pivots[:, :-1].T + extra[:, None] * self.pivots[:, -1])
        return np.sqrt(np.maximum(d2, 0))

    def place(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest pivot, annulus and distance of vectors."""
        d = self.distances(x, np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0)))
        pivot = d.argmin(axis=1)
        dist = d[np.arange(len(x)), pivot]
        ring = np.zeros(len(x), np.int64)
        for p in np.unique(pivot):
            own = pivot == p
            ring[own] = np.searchsorted(self.borders[p], dist[own], side="right")
        return pivot, ring, dist

    def reach(self, q: np.ndarray) -> np.ndarray:
        """The highest score that each annulus can hold for each query, by the triangle inequality."""
        d = self.distances(q, np.zeros(len(q)))
        # Every vector is nearest to its own pivot, so it is at least half as far as that pivot is farther than the nearest one.
        half = (d - d.min(axis=1, keepdims=True)) / 2
        half, d = half[:, self.cells["pivot"]], d[:, self.cells["pivot"]]
        low = np.maximum(half, np.maximum(d - self.cells["far"], self.cells["near"] - d))
        q2 = (q * q).sum(axis=1)[:, None]
        bound = (q2 + self.most - low**2) / 2
        return bound + 1e-6 * (q2 + self.most) + 1e-6  # more than rounding can take away, roots of tiny differences included


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows of doubles, filled up with zeros."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, np.int64)
    if (sizes == dim).all():
        return flat.reshape(len(column), dim)
    out = np.zeros((len(column), dim))
    rows = np.repeat(np.arange(len(column)), sizes)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def geometry(vectors: DataFrame, vec: str) -> Geometry | None:
    least = vectors.agg(F.count("*").alias("n"), F.max(F.size(vec)).alias("dim"), F.max(F.aggregate(vec, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("most")).first()
    if not least["n"]:
        return None
    n, dim, most = least["n"], max(1, least["dim"]), float(least["most"])
    if most >= 2.0**62:  # by Cauchy and Schwarz no inner product is larger than the largest squared norm
        raise ValueError("vectors too large: inner products may not fit 64 bits")
    rows = bounded_sample(vectors, "_id", SAMPLE_ROWS).orderBy("_id").select(vec).collect() if n > 1 else vectors.select(vec).collect()
    sample = np.zeros((max(1, len(rows)), dim))
    for i, r in enumerate(rows):
        sample[i, : len(r[0])] = r[0]
    full = np.hstack([sample, np.sqrt(np.maximum(most - (sample**2).sum(axis=1), 0))[:, None]])
    p = int(min(MAX_PIVOTS, max(4, n**0.5 / 2), len(full)))
    rings = int(min(MAX_RINGS, max(1, n // (p * RING_ROWS))))
    rng = np.random.default_rng(17)
    pivots = full[rng.choice(len(full), p, replace=False)]
    for _ in range(5):  # a few steps of k-means
        near = ((full**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * full @ pivots.T).argmin(axis=1)
        pivots = np.stack([full[near == i].mean(axis=0) if (near == i).any() else pivots[i] for i in range(p)])
    g = Geometry(dim, most, most < 2**52, pivots, [np.zeros(0)] * p)
    d = g.distances(full[:, :-1], full[:, -1])
    near = d.argmin(axis=1)
    g.borders = [np.unique(np.quantile(d[near == i, i], np.linspace(0, 1, rings + 1)[1:-1])) if (near == i).any() else np.zeros(0) for i in range(p)]
    return g


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    if len(score) > 4 * k:
        border = np.partition(score, len(score) - k)[len(score) - k]
        at = np.flatnonzero(score >= border)
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def wave_edge(seen: np.ndarray, wave: int, k: int) -> int:
    """How many annuli, in their order, come before a wave: those that hold the rows which earlier waves reach."""
    return 0 if wave == 0 else min(len(seen), int(np.searchsorted(seen, FIRST_WAVE * k * WIDER ** (wave - 1))) + 1)


def search(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int, vec: str = "_v", waves: list[dict] | None = None) -> DataFrame:
    """query_id, rank, vec_id, score for queries and vectors with the columns _id and _v. ``waves`` gets a line for each wave:
    pairs of chunks and blocks, and rows scored."""
    out_schema = "query_id long, rank int, vec_id long, score long"
    g = geometry(vectors, vec)
    if g is None:
        return spark.createDataFrame([], out_schema)
    shared = spark.sparkContext.broadcast(g)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        geo = shared.value
        for b in batches:
            if b.num_rows:
                pivot, ring, dist = geo.place(matrix(b.column(1), geo.dim))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(pivot.astype(np.int32)), pa.array(ring.astype(np.int32)), pa.array(dist)], ["_id", "_v", "pivot", "ring", "dist"])

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        geo = shared.value
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1), geo.dim)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(geo.distances(x, np.zeros(len(x))).argmin(axis=1).astype(np.int32))], ["_id", "_v", "pivot"])

    def visits(wave: int):
        """The blocks of a wave's open annuli, with the places of the queries (in their chunk) that ask for them. A chunk with
        open annuli beyond an empty wave names block -1, which there isn't."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            geo = shared.value
            c = geo.cells
            for b in batches:
                for r in range(b.num_rows):
                    held = b.column(1).slice(r, 1).flatten()
                    reach = geo.reach(matrix(held.field(1), geo.dim))
                    bounds = held.field(2).to_numpy(zero_copy_only=False)
                    rows, cells, later = [], [], False
                    for i in range(len(bounds)):
                        order = np.argsort(-reach[i], kind="stable")
                        seen = np.cumsum(c["n"][order])
                        start, end = wave_edge(seen, wave, k), wave_edge(seen, wave + 1, k)
                        open_ = int((reach[i] >= bounds[i]).sum())
                        at = order[start : min(end, open_)]
                        later = later or open_ > max(start, end)
                        rows.append(np.full(len(at), i))
                        cells.append(at)
                    rows, cells = np.concatenate(rows), np.concatenate(cells)
                    by_cell = np.argsort(cells, kind="stable")
                    rows, cells = rows[by_cell], cells[by_cell]
                    at, first = np.unique(cells, return_index=True)
                    asked = np.split(rows, first[1:]) if len(at) else []
                    out = [(int(c["pivot"][x]), int(c["ring"][x]), s, a.tolist(), int(c["n"][x]) * len(a) if s == 0 else 0) for x, a in zip(at, asked, strict=True) for s in range(int(c["subs"][x]))]
                    if not out and later:
                        out = [(-1, -1, -1, [], 0)]
                    if out:
                        pivot, ring, sub, places, n = zip(*out, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([b.column(0)[r].as_py()] * len(out), pa.int32()), pa.array(pivot, pa.int32()), pa.array(ring, pa.int32()), pa.array(sub, pa.int32()), pa.array(places, pa.list_(pa.int32())), pa.array(n, pa.int64())],
                            ["chunk", "pivot", "ring", "sub", "places", "n"],
                        )

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        geo = shared.value
        for b in batches:
            for r in range(b.num_rows):
                held, places, chunk = (b.column(i).slice(r, 1).flatten() for i in range(3))
                at = places.to_numpy()
                asked, bounds = chunk.field(0).to_numpy(zero_copy_only=False)[at], chunk.field(2).to_numpy(zero_copy_only=False)[at]
                ids = held.field(0).to_numpy(zero_copy_only=False)
                x, q = matrix(held.field(1), geo.dim), matrix(chunk.field(1), geo.dim)[at]
                if not geo.exact:
                    x, q = x.astype(np.int64), q.astype(np.int64)
                s = q @ x.T
                out = []
                for i, (query, bound) in enumerate(zip(asked, bounds, strict=True)):
                    ok = np.flatnonzero((ids != query) & (s[i] >= bound))
                    top = ok[best(s[i][ok], ids[ok], k)]
                    out.append((np.full(len(top), query), ids[top], s[i][top].astype(np.int64)))
                q_, v_, s_ = (np.concatenate(z) for z in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(q_, pa.int64()), pa.array(v_, pa.int64()), pa.array(s_, pa.int64())], ["query_id", "vec_id", "score"])

    ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    batch_rows = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    with Scratch() as scratch:
        # Written once: the directory and all waves read it.
        indexed = scratch.keep(vectors.select("_id", F.col(vec).alias("_v")).mapInArrow(index, "_id long, _v array<bigint>, pivot int, ring int, dist double"))
        # The directory has at most MAX_PIVOTS * MAX_RINGS rows.
        cells = indexed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("dist").alias("near"), F.max("dist").alias("far")).orderBy("pivot", "ring").toPandas()
        g.cells = {c: cells[c].to_numpy() for c in cells}
        g.cells["subs"] = -(-g.cells["n"] // BLOCK_ROWS)
        near = scratch.keep(queries.select("_id", F.col("_v")).mapInArrow(nearest, "_id long, _v array<bigint>, pivot int"))
        shared = spark.sparkContext.broadcast(g)
        subs = F.broadcast(spark.createDataFrame([(int(p), int(r), int(s)) for p, r, s in zip(g.cells["pivot"], g.cells["ring"], g.cells["subs"], strict=True)], "pivot int, ring int, subs int"))
        placed = indexed.join(subs, ["pivot", "ring"]).withColumn("sub", F.pmod(F.xxhash64("_id"), F.col("subs")).cast("int"))
        blocks = placed.groupBy("pivot", "ring", "sub").agg(F.collect_list(F.struct("_id", "_v")).alias("held"))
        # Queries of one pivot share the annuli they visit, so chunks are ranges of pivots; a crowded pivot gets chunks of its own.
        counts = {r["pivot"]: r["count"] for r in near.groupBy("pivot").count().collect()}  # at most MAX_PIVOTS rows
        ranges, chunk, filled = [], 0, 0
        for p in sorted(counts):
            if filled and filled + counts[p] > QUERY_CHUNK:
                chunk, filled = chunk + 1, 0
            parts = -(-counts[p] // QUERY_CHUNK)
            ranges.append((p, chunk, parts))
            chunk, filled = (chunk + parts, 0) if parts > 1 else (chunk, filled + counts[p])
        ranges = F.broadcast(spark.createDataFrame(ranges, "pivot int, base int, parts int"))
        queries = near.join(ranges, "pivot").withColumn("chunk", F.col("base") + F.pmod(F.xxhash64("_id"), F.col("parts")).cast("int")).select("_id", "_v", "chunk")
        top = None
        try:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BLOCK_BATCH))
            for wave in itertools.count():
                # Each query's k-th score so far bounds it.
                asked = queries.withColumn("bound", F.lit(float("-inf")))
                if top is not None:
                    bounds = top.df.where(F.col("rank") == k).select(F.col("query_id").alias("_id"), F.col("score").cast("double").alias("bound"))
                    asked = queries.join(bounds, "_id", "left").withColumn("bound", F.coalesce("bound", F.lit(float("-inf"))))
                chunks = scratch.keep(asked.groupBy("chunk").agg(F.collect_list(F.struct("_id", "_v", "bound")).alias("vectors")))
                wanted = scratch.keep(chunks.mapInArrow(visits(wave), "chunk int, pivot int, ring int, sub int, places array<int>, n long"))
                if waves is not None:
                    waves.append({"pairs": rows_of(wanted), "scored": wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]})
                if rows_of(wanted) == 0:
                    break
                pairs = wanted.join(chunks, "chunk").join(blocks, ["pivot", "ring", "sub"]).select("held", "places", "vectors")
                found = pairs.mapInArrow(score, "query_id long, vec_id long, score long")
                found = found if top is None else found.unionByName(top.df.drop("rank"))
                after = stored(found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k))
                if top is not None:
                    top.drop()
                top = after
                scratch.drop(chunks, wanted)
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch_rows)
    return spark.createDataFrame([], out_schema) if top is None else top.df.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("_id"), "embedding").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = rows.select("_id", integer_vector(F.col("embedding")).alias("_v"))
    queries = vectors.where(F.col("_id") % QUERY_EVERY == 0).groupBy("_id").agg(F.min("_v").alias("_v"))
    return search(spark, vectors, queries, K)


ORACLE_OP2 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.v, v.v)::BIGINT AS score FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 10
"""
