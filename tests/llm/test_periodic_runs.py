import hashlib
import random
import time
import zlib

import numpy as np
import pytest
from tidemirror.llm import periodic_runs as P


def brute(words):
    """All runs, by comparing the words with themselves moved by every period."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            found.append((i, j + q - i, q))
            i = j + 1
    out = []
    for s, size, q in found:
        if size >= max(12, 2 * q) and not any(all(words[k] == words[k + p] for k in range(s, s + size - p)) for p in range(1, q) if q % p == 0):
            out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def got(texts):
    return [[(int(s), int(e - s), int(q)) for s, e, q in zip(r.start, r.end, r.period, strict=True)] for r in P.text_runs(texts)]


def fibonacci(n):
    a, b = ["a"], ["a", "b"]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


def odd_words(rng):
    """Words in which many runs nest, touch and nearly meet."""
    kind = rng.randrange(6)
    n = rng.randrange(0, 260)
    if kind == 0:
        return [rng.choice("ab") for _ in range(n)]
    if kind == 1:
        return fibonacci(n)
    if kind == 2:  # squares of blocks of a small period: ababa ababa
        p, k = rng.randrange(1, 4), rng.randrange(3, 60)
        unit = [rng.choice("abc") for _ in range(p)]
        block = (unit * 80)[:k]
        return [rng.choice("abx") for _ in range(rng.randrange(4))] + block * rng.randrange(2, 5) + [rng.choice("abx") for _ in range(rng.randrange(4))] + block
    if kind == 3:
        block = [rng.choice("abcdefgh") for _ in range(rng.randrange(1, 90))]
        words = block * rng.randrange(2, 6) + block[: rng.randrange(0, len(block))]
        for _ in range(rng.randrange(3)):
            words[rng.randrange(len(words))] = "z"
        return words
    if kind == 4:
        parts = [odd_words(rng)[:90] for _ in range(3)]
        return parts[0] + parts[1] + parts[0] + parts[1] + parts[2] + parts[0]
    word = [rng.choice("ab") for _ in range(3)]
    for _ in range(5):  # each level repeats the one before and adds a letter
        word = word * rng.randrange(1, 3) + [rng.choice("abc")] * rng.randrange(0, 2)
    return word * 2


@pytest.mark.parametrize("seed", range(6))
def test_all_runs_are_found(seed):
    rng = random.Random(seed)
    texts = [odd_words(rng) for _ in range(150)]
    assert got([" ".join(t) for t in texts]) == [brute(t) for t in texts]


@pytest.mark.parametrize("q", [15, 16, 17, 31, 32, 33, 63, 64, 65, 127, 200])
def test_lengths_about_two_periods(q):
    rng = random.Random(q)
    block = [f"w{i}" for i in range(q)]
    texts = [["s"] + block + block[: q - 1] + ["e"], ["s"] + block * 2 + ["e"], block * 2, ["x", "y"] * (q // 2) + ["x"] + ["x", "y"] * (q // 2) + ["x"], block * 3 + [rng.choice("ab") for _ in range(40)] + block * 2]
    assert got([" ".join(t) for t in texts]) == [brute(t) for t in texts]
    assert got([" ".join(texts[1])]) == [[(1, 2 * q, q)]]


def test_runs_stay_in_their_text_and_white_space_is_ascii():
    a = "la " * 11
    assert got([a, a, "la " * 12, None, "", "x\xa0y " * 12]) == [[], [], [(0, 12, 1)], [], [], [(0, 12, 1)]]
    assert [r.collapsed() for r in P.text_runs([" a\tb\nc ", None, "la " * 12 + "end"])] == [b"a b c", b"", b"la end"]


def plain(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n = len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = brute(words)
    dropped = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (
        doc_id, len(runs), *(best or (None, None, None)), None if best is None else 1000 * best[1] // best[2],
        hashlib.sha256("".join(f"{s},{size},{q}\n" for s, size, q in runs).encode()).hexdigest(), hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in dropped)).hexdigest(),
    )


def test_query_equals_brute_force(spark, odd_documents, sf_dir):
    rng = random.Random(5)
    rows = [(100 + i, " ".join(odd_words(rng))) for i in range(60)] + [(400 + i, " ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 120)))) for i in range(80)]
    more = spark.createDataFrame(rows, "doc_id long, text string")
    docs = odd_documents.unionByName(more, allowMissingColumns=True)
    out = P.op13_periodic_runs(spark, sf_dir(documents=docs)).collect()
    want = [plain(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert sorted(map(str, map(tuple, out))) == sorted(map(str, want))
    assert any(zlib.crc32(str(r[0]).encode()) % 10 == 0 and r[1] for r in want)
    assert P.digests(docs.limit(0).select("doc_id", "text")).count() == 0


def test_collapse_gives_texts(spark):
    docs = spark.createDataFrame([(1, "so " + "round and " * 10 + "home"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: (r.text, r.n_runs) for r in P.collapse(docs).collect()} == {1: ("so round and home", 1), 2: ("", 0)}


def test_long_texts_take_time_in_proportion():
    rng = random.Random(3)
    block = [f"w{rng.randrange(9)}" for _ in range(40_000)]
    began = time.time()
    runs = got([" ".join(block * 3), "la " * 200_000, " ".join(fibonacci(100_000))])
    assert (0, 120_000, 40_000) in runs[0] and (0, 200_000, 1) in runs[1] and len(runs[2]) > 1000
    assert time.time() - began < 60


def test_windows_least():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 99, 50).astype(np.uint64)
    for size in range(1, 12):
        assert (P.window_least(x, size) == [x[i : i + size].min() for i in range(51 - size)]).all()
