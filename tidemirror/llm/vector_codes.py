"""Vector compression by product codes, with nearest entries found by Orchard's search.

Components become integers floor(256 x); a vector of d components is cut into 16 parts, part p from component p*d//16 to
(p+1)*d//16 (equal parts where 16 divides d). Every part position has a codebook of up to 64 entries. A round assigns each
part to its nearest entry and replaces each entry by the rounded-down mean of its parts.

Orchard's search: for every entry the others are listed by their distance to it. A part starts at some entry (the one nearest
to all others) and walks down that entry's list; entries it met before are marked and passed over. When one is nearer it goes
on with that entry's list from its beginning, and it stops as soon as the list is beyond twice its current distance: by the
triangle inequality nothing further down can be nearer, or as near. All is in integers (a squared distance beyond four times
the current squared one ends the walk), so the result is exact, ties to the lower index. The walks of many vectors' parts are
made side by side in numpy. A codebook has a fixed size; only sums by entry leave a task, and the vectors themselves
are read again in each round instead of being kept.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do vectors of another length
than the first kept one (by vec_id; rows without vec_id come last and start no entry before others); of repeated vec_ids the
smaller vectors come first; with fewer than 64 vectors there are fewer entries; a vector with a component so large that
squared distances could leave 64 bits keeps its row, with null code and error, and takes no part in codebooks; empty vectors
have code 0 in every part; label_error sums over equal labels, those without a label together; a table without kept vectors
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import join_hot, stored, table
from .pivot_search import usable

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256


def scaled(flat: np.ndarray, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of integer components, and which rows are small enough for 64-bit distances."""
    x = np.floor(flat.astype(np.float64).reshape(-1, dim) * SCALE) if dim else np.zeros((len(flat), 0))
    fits = (np.abs(x) <= bound(dim)).all(axis=1)
    x[~fits] = 0
    return x.astype(np.int64), fits


def bound(dim: int) -> int:
    """The largest component (its absolute value) for which four times any squared distance stays below 2^62."""
    return int((2.0**60 / max(1, dim)) ** 0.5) // 2


def cuts(dim: int) -> list[int]:
    return [p * dim // PARTS for p in range(PARTS + 1)]


class Codebook:
    """The entries of one part, each with all others by distance."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        far = ((entries[:, None] - entries[None]) ** 2).sum(axis=2)
        self.order = np.argsort(far, axis=1, kind="stable").astype(np.int64)
        self.far = np.take_along_axis(far, self.order, axis=1)
        self.first = int(far.astype(np.float64).sum(axis=1).argmin()) if len(entries) else 0

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row and its squared distance, by Orchard's search."""
        n, k = len(x), len(self.entries)
        here = np.full(n, self.first)
        dist = ((x - self.entries[self.first]) ** 2).sum(axis=1)
        met = np.full(n, np.uint64(1) << np.uint64(self.first))
        at = np.zeros(n, np.int64)
        walking = np.arange(n)
        while len(walking):
            place = at[walking]
            own = here[walking]
            # Beyond twice the current distance, or at the end of the list.
            go = place < k
            go[go] = self.far[own[go], place[go]] <= 4 * dist[walking[go]]
            walking, own, place = walking[go], own[go], place[go]
            other = self.order[own, place]
            at[walking] = place + 1
            bit = np.uint64(1) << other.astype(np.uint64)
            new = (met[walking] & bit) == 0
            asked, other = walking[new], other[new]
            met[asked] |= bit[new]
            d = ((x[asked] - self.entries[other]) ** 2).sum(axis=1)
            nearer = (d < dist[asked]) | ((d == dist[asked]) & (other < here[asked]))
            asked, other = asked[nearer], other[nearer]
            dist[asked], here[asked], at[asked] = d[nearer], other, 0
        return here, dist


def books(entries: list[np.ndarray]) -> list[Codebook]:
    return [Codebook(e) for e in entries]


def first_entries(vectors: DataFrame) -> tuple[int, list[np.ndarray]] | None:
    """The length of vectors and each part's first entries, from the first vectors by id."""
    order = [F.col("vec_id").isNull(), "vec_id", "_v"]
    head = vectors.orderBy(*order).select("_v").limit(1).collect()
    if not head:
        return None
    dim = len(head[0][0])
    small = F.forall("_v", lambda x: F.abs(F.floor(x.cast("double") * SCALE)) <= bound(dim))
    rows = vectors.where((F.size("_v") == dim) & small).orderBy(*order).select("_v").limit(ENTRIES).collect()
    x, _ = scaled(np.array([v for r in rows for v in r[0]], np.float64), dim) if dim else (np.zeros((len(rows), 0), np.int64), None)
    at = cuts(dim)
    return dim, [x[:, a:b] for a, b in zip(at, at[1:], strict=False)]


def batches_of(batch: pa.RecordBatch, dim: int) -> tuple[np.ndarray, np.ndarray]:
    flat = batch.column(batch.schema.get_field_index("_v")).flatten().to_numpy(zero_copy_only=False)
    return scaled(flat, dim) if dim else (np.zeros((batch.num_rows, 0), np.int64), np.ones(batch.num_rows, bool))


def sums(vectors: DataFrame, dim: int, entries: list[np.ndarray]) -> list[np.ndarray]:
    """The entries after a round. Each task gives one row for an entry it has used."""
    shared = vectors.sparkSession.sparkContext.broadcast(entries)  # of fixed size
    at = cuts(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cbs = books(shared.value)
        count = np.zeros((PARTS, ENTRIES), np.int64)
        total = [np.zeros((ENTRIES, b - a), np.int64) for a, b in zip(at, at[1:], strict=False)]
        for batch in batches:
            x, fits = batches_of(batch, dim)
            x = x[fits]
            for p, cb in enumerate(cbs):
                if len(cb.entries) and len(x):
                    own = x[:, at[p] : at[p + 1]]
                    code, _ = cb.nearest(own)
                    count[p] += np.bincount(code, minlength=ENTRIES)
                    np.add.at(total[p], code, own)
        part, entry = np.nonzero(count)
        yield pa.RecordBatch.from_arrays(
            [pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), pa.array([total[p][e].tolist() for p, e in zip(part, entry, strict=True)], pa.list_(pa.int64()))], ["part", "entry", "n", "total"]
        )

    told = vectors.select("_v").mapInArrow(run, "part int, entry int, n long, total array<bigint>")
    wide = told.select("part", "entry", "n", F.posexplode_outer("total").alias("i", "x"))
    rows = wide.groupBy("part", "entry", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect()
    after = [e.copy() for e in entries]
    for r in rows:  # at most one for each component of an entry
        if r["i"] is not None:
            after[r["part"]][r["entry"], r["i"]] = int(r["x"]) // r["n"]
    return after


def encode(vectors: DataFrame, dim: int, entries: list[np.ndarray]) -> DataFrame:
    """vec_id, label, code (PARTS bytes in hex), error of every vector."""
    shared = vectors.sparkSession.sparkContext.broadcast(entries)
    at = cuts(dim)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cbs = books(shared.value)
        for batch in batches:
            x, fits = batches_of(batch, dim)
            codes, error = np.zeros((len(x), PARTS), np.uint8), np.zeros(len(x), np.int64)
            for p, cb in enumerate(cbs):
                if len(cb.entries) and len(x):
                    code, far = cb.nearest(x[:, at[p] : at[p + 1]])
                    codes[:, p], error = code, error + far
            text = [c.tobytes().hex() if ok else None for c, ok in zip(codes, fits, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(text, pa.string()), pa.array(error, mask=~fits)], ["vec_id", "label", "code", "error"])

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.select("vec_id", "label", "_v").mapInArrow(run, f"vec_id long, label {kind}, code string, error long")


def train(vectors: DataFrame, rounds: int = ROUNDS) -> tuple[int, list[np.ndarray]] | None:
    """The length of vectors and the codebooks after so many rounds, for vectors (vec_id, _v)."""
    start = first_entries(vectors)
    if start is None:
        return None
    dim, entries = start
    kept = vectors.where(F.size("_v") == dim)
    for _ in range(rounds):
        entries = sums(kept, dim, entries)
    return dim, entries


def decode(codes: DataFrame, entries: list[np.ndarray]) -> DataFrame:
    """vec_id and the vector (integers) that a code stands for; null without a code."""
    shared = codes.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if c is None else np.concatenate([e[i] for e, i in zip(shared.value, bytes.fromhex(c), strict=True)]).tolist() for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.list_(pa.int64()))], ["vec_id", "vector"])

    return codes.select("vec_id", "code").mapInArrow(run, "vec_id long, vector array<bigint>")


def digest(entries: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(v) for e in entries for row in e.tolist() for v in row).encode()).hexdigest()


def kept_vectors(df: DataFrame) -> DataFrame:
    return df.where(usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("_v"))


def compress(df: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for df (vec_id, label, embedding)."""
    vectors = kept_vectors(df)
    made = train(vectors)
    schema = "vec_id long, code string, error long, label_error long, codebooks_sha256 string"
    if made is None:
        return df.sparkSession.createDataFrame([], schema)
    dim, entries = made
    coded = stored(encode(vectors.where(F.size("_v") == dim), dim, entries)).df
    keyed = coded.withColumn("_key", F.struct(F.col("label").isNull().alias("none"), F.hash("label").alias("h"), F.coalesce(F.col("label").cast("string"), F.lit("")).alias("of"))).drop("label")
    each = keyed.groupBy("_key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum"), F.count("*").alias("_n"))
    joined = join_hot(keyed, each.drop("_n"), "_key", like=coded, counts=each.select("_key", "_n"))
    return joined.select("vec_id", "code", "error", F.col("_sum").try_cast("long").alias("label_error"), F.lit(digest(entries)).alias("codebooks_sha256"))


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compress(table(spark, sf_dir, "embeddings"))


def _oracle() -> str:
    def assigned(name: str, book: str) -> str:
        return f"""{name} AS (SELECT vec_id, part, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT p.vec_id, p.part, c.k, list_sum(list_transform(list_zip(p.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM p JOIN {book} c ON c.part = p.part) u GROUP BY 1, 2)"""

    def moved(name: str, book: str, places: str) -> str:
        return f"""{name}_s AS (SELECT a.part, a.k, i, CAST(floor(sum(p.x[i]) / count(*)) AS BIGINT) AS v FROM {places} a JOIN p ON p.vec_id = a.vec_id AND p.part = a.part, (SELECT unnest(range(1, 5)) AS i) n GROUP BY 1, 2, 3),
{name} AS (SELECT c.part, c.k, coalesce(list(s.v ORDER BY s.i) FILTER (s.v IS NOT NULL), any_value(c.x)) AS x FROM {book} c LEFT JOIN {name}_s s ON s.part = c.part AND s.k = c.k GROUP BY 1, 2)"""

    return f"""
WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS (SELECT vec_id, part, v[part * 4 + 1 : part * 4 + 4] AS x FROM e, (SELECT unnest(range(0, 16)) AS part) r),
h AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS k FROM e ORDER BY vec_id LIMIT 64),
c0 AS (SELECT p.part, h.k, p.x FROM h JOIN p ON p.vec_id = h.vec_id),
{assigned("a0", "c0")}, {moved("c1", "c0", "a0")}, {assigned("a1", "c1")}, {moved("c2", "c1", "a1")}, {assigned("a2", "c2")},
code AS (SELECT vec_id, string_agg(lpad(lower(to_hex(k)), 2, '0'), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a2 GROUP BY 1),
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, k)) AS codebooks_sha256 FROM c2)
SELECT code.vec_id, code, error, sum(error) OVER (PARTITION BY e.label)::BIGINT AS label_error, codebooks_sha256 FROM code JOIN e ON e.vec_id = code.vec_id, sha
"""


ORACLE_OP11 = _oracle()
