import hashlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tidemirror.llm import vector_codes as V

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string, _v string, _key int"


def plain(rows, dim):
    """Codes by comparing every part with every entry."""
    kept = [(i, v, lab) for i, v, lab in rows if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[int(np.floor(256 * float(np.float32(c)))) for c in v] for _, v, _ in kept], np.int64).reshape(len(kept), dim)
    if not kept:
        return []
    at = [p * dim // 16 for p in range(17)]
    books = [x[:64, a:b].copy() for a, b in zip(at, at[1:], strict=False)]

    def assign():
        far = [((x[:, None, at[p] : at[p + 1]] - books[p][None]) ** 2).sum(axis=2) for p in range(16)]
        return np.stack([f.argmin(axis=1) for f in far], axis=1), sum(f.min(axis=1) for f in far)

    for _ in range(2):
        codes, _ = assign()
        for p in range(16):
            for k in range(len(books[p])):
                own = x[codes[:, p] == k, at[p] : at[p + 1]]
                if len(own):
                    books[p][k] = own.sum(axis=0) // len(own)
    codes, error = assign()
    by = defaultdict(int)
    for (_, _, lab), e in zip(kept, error, strict=True):
        by[lab] += int(e)
    sha = hashlib.sha256(",".join(str(v) for b in books for r in b.tolist() for v in r).encode()).hexdigest()
    return [(i, "".join(f"{c:02x}" for c in code), int(e), by[lab], sha) for (i, _, lab), code, e in zip(kept, codes, error, strict=True)]


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], lab, "x", "y", "z", 1) for i, v, lab in rows], SCHEMA)


def compare(spark, sf_dir, rows, dim):
    got = V.op11_vector_codes(spark, sf_dir(embeddings=vectors(spark, rows))).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, plain(rows, dim)))
    return got


def test_codes_equal_plain_k_means(spark, sf_dir):
    rng = np.random.default_rng(4)
    rows = [(int(i), [float(np.float32(c)) for c in v], int(i) % 5 if i % 7 else None) for i, v in zip(rng.permutation(900), rng.normal(scale=0.2, size=(900, 64)), strict=True)]
    assert len(compare(spark, sf_dir, rows, 64)) == 900


def test_odd_rows(spark, sf_dir):
    rng = np.random.default_rng(5)
    v = lambda: [float(np.float32(c)) for c in rng.integers(-3, 4, 20) / 256]  # noqa: E731  # ties, and parts of 1 and 2 components
    same = v()
    rows = [(i, v(), 1) for i in range(80)] + [(i, same, None) for i in range(80, 90)] + [(5, v(), 2), (5, v(), 2), (None, v(), 2), (91, None, 1), (92, [], 1), (93, [1.0] * 19, 1), (94, [None] + same[1:], 1), (95, [float("nan")] + same[1:], 1), (96, [float("inf")] + same[1:], 1)]
    got = compare(spark, sf_dir, rows, 20)
    assert len(got) == 93


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, sf_dir, n):
    rows = [(i, [0.1 * i] * 32, 0) for i in range(n)] + [(9, None, 0)]
    assert len(compare(spark, sf_dir, rows, 32)) == n


def test_huge_components_keep_their_row(spark, sf_dir):
    rows = [(0, [3e37] + [0.0] * 15, 1)] + [(i, [0.01 * i] * 16, 1) for i in range(1, 70)]
    got = {r.vec_id: r for r in V.op11_vector_codes(spark, sf_dir(embeddings=vectors(spark, rows))).collect()}
    assert len(got) == 70 and (got[0].code, got[0].error) == (None, None)
    want = {r[0]: r for r in plain(rows[1:], 16)}
    assert all(tuple(got[i]) == want[i] for i in range(1, 70))


def test_orchard_search_is_exact_and_asks_fewer():
    rng = np.random.default_rng(6)
    for dim, scale in ((1, 4), (2, 9), (4, 60), (4, 1)):
        cb = V.Codebook(rng.integers(-scale, scale + 1, (64, dim)))
        x = rng.integers(-2 * scale, 2 * scale + 1, (3000, dim))
        far = ((x[:, None] - cb.entries[None]) ** 2).sum(axis=2)
        code, dist = cb.nearest(x)
        assert (code == far.argmin(axis=1)).all() and (dist == far.min(axis=1)).all()


def test_decoded_vectors_are_near(spark):
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(10, 64))
    df = vectors(spark, [(i, centres[i % 10] + rng.normal(scale=0.01, size=64), 0) for i in range(400)])
    kept = V.kept_vectors(df)
    dim, entries = V.train(kept)
    coded = V.encode(kept, dim, entries)
    back = V.decode(coded, entries).join(coded, "vec_id").join(df.select("vec_id", "embedding"), "vec_id")
    rows = back.collect()
    assert len(rows) == 400
    for r in rows:
        assert ((np.floor(256 * np.array(r.embedding, np.float64)) - np.array(r.vector)) ** 2).sum() == r.error
    assert back.agg(F.avg("error")).first()[0] < 64 * 16
