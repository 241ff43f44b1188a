import itertools
import random
import re

import numpy as np
import pytest
from tidemirror.llm import common, minhash_join
from tidemirror.llm import minhash_join as J
from tidemirror.llm.jaccard_join import shingle_sets


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def expected(docs, k=3, percent=85):
    sets, parent = {d: shingles(t, k) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {d: (len(sets[d]), find(d), find(d) == d) for d in sets}


def found(spark, docs, **kw):
    rows = J.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), **kw).collect()
    assert len(rows) == len(docs)
    return {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows}


@pytest.fixture(scope="module")
def drifting():
    """Groups whose copies drift away from each other step by step, so that links chain and the first guess isn't enough."""
    rng = random.Random(8)
    docs = []
    for _ in range(6):
        words = [f"w{rng.randrange(500)}" for _ in range(rng.choice([40, 90, 200]))]
        for _ in range(14):
            docs.append((len(docs) + 1, " ".join(words)))
            for _ in range(max(1, len(words) // rng.choice([30, 45, 60]))):
                words[rng.randrange(len(words))] = f"v{rng.randrange(900)}"
    shared = [f"s{i}" for i in range(50)]  # a passage that many texts share
    docs += [(300 + i, " ".join([*shared, *(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(8, 70)))])) for i in range(40)]
    return [*docs, (900, None), (901, ""), (902, " \n"), (903, "a"), (904, "A"), (905, "a b"), (906, "a b"), (907, docs[0][1].upper())]


def test_components(spark, sf_dir, drifting):
    docs = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in drifting], "doc_id long, text string, node string, sig string, kept int")
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in J.op12_minhash_join(spark, sf_dir(documents=docs)).collect()}
    assert got == expected(drifting)


def test_small_pieces_and_hot_keys(spark, drifting, monkeypatch):
    for name, value in (("LIST_NODES", 3), ("GUESTS", 2), ("LIST_SHINGLES", 150), ("BIN_ROWS", 20)):
        monkeypatch.setattr(J, name, value)
    monkeypatch.setattr(common, "HOT_ROWS", 20)
    assert found(spark, drifting) == expected(drifting)
    assert found(spark, drifting, k=5, percent=80) == expected(drifting, 5, 80)


def test_lists_add_links_that_the_first_guess_misses(spark, drifting, monkeypatch):
    """The pairs of the lists are held against brute force without any first guess."""
    monkeypatch.setattr(minhash_join, "first_pairs", lambda shared, work: shared.sparkSession.createDataFrame([], "a long, b long"))
    assert found(spark, drifting) == expected(drifting)


def test_a_large_group_gives_few_links(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 30)
    base = [f"w{i}" for i in range(150)]
    docs = [(i, " ".join(base if i % 3 == 0 else [*base[: i % 140], f"q{i}", *base[i % 140 + 1 :]])) for i in range(200)]
    assert found(spark, docs) == expected(docs)
    seen = []
    real = J.verified
    monkeypatch.setattr(minhash_join, "verified", lambda pairs, *a: (seen.append(pairs.count()), real(pairs, *a))[1])
    found(spark, docs)
    assert 0 < seen[0] < 2 * len(docs)


def test_odd_rows(spark, odd_documents):
    got = J.near_duplicates(odd_documents).collect()
    assert len(got) == 13 and J.near_duplicates(odd_documents.limit(0)).count() == 0
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.component_id, r.kept))
    assert by[2] == [(1, False)] * 2 and by[9] == [(1, False)] and by[1] == [(1, True)] and by[None] == [(None, True)] and by[3] == [(3, True)]


def test_matches_estimate_similarity():
    rng = np.random.default_rng(2)
    shares = []
    for _ in range(60):
        a = rng.integers(0, 1 << 63, 1000, dtype=np.uint64)
        b = np.concatenate([a[:919], rng.integers(0, 1 << 63, 81, dtype=np.uint64)])  # similarity 0.85
        x, y = J.signatures([np.unique(a), np.unique(b)])
        shares.append((x == y).sum())
    assert min(shares) >= J.MATCHES and 0.82 < np.mean(shares) / J.COORDINATES < 0.88


def test_a_pair_that_matches_enough_shares_a_prefix_posting():
    rng = random.Random(1)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(40)) for _ in range(200)]
    texts += [t + " end" for t in texts[:100]]
    sets = next(shingle_sets(texts, 3))[1]
    sig = J.signatures(sets)
    counts = np.bincount(J.slots(J.postings(sig).ravel()), minlength=1 << J.SKETCH_BITS)
    keys, own = J.prefixes(sig, counts)
    for i in range(100):
        assert (sig[i] == sig[200 + i]).sum() < J.MATCHES or set(keys[i][own[i]]) & set(keys[200 + i][own[200 + i]])
