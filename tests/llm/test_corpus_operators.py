"""Vector search, passage removal, decontamination, Jaccard components: each against brute force; and the pipeline."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from tidemirror.llm import decontaminate, jaccard_join, pivot_search, suffix_dedup
from tidemirror.llm.common import components

# ---------------------------------------------------------------- op2


def test_top_k(spark, sf_dir):
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 8)]) for i in range(600)]
    rows += [(600, rows[5][1]), (700, rows[5][1]), (701, None), (702, [float("nan")] * 8), (703, [1.0, None]), (800, [float("inf")] * 8), (900, [0.5, -0.5]), (None, rows[1][1]), (100, rows[3][1])]
    got = pivot_search.op2_pivot_topk(spark, sf_dir(embeddings=spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, score int"))).collect()
    ok = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    queries = {}
    for i, v in ok:
        if i % 100 == 0:
            queries[i] = min(queries.get(i, v), v)
    want = set()
    for q, v in queries.items():
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), i) for i, w in ok if i != q)[:10]
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)


def test_top_k_of_few_and_none(spark, sf_dir):
    v = spark.createDataFrame([(0, [1.0, 2.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<float>")
    got = pivot_search.op2_pivot_topk(spark, sf_dir(embeddings=v)).collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 1, 3 * 1024 * 1024)]
    none = v.limit(0).withColumnRenamed("vec_id", "_id").withColumnRenamed("embedding", "_v")
    assert pivot_search.search(spark, none, none, 10).count() == 0


def _clusters(spark, groups=12, size=60, dim=8):
    rng = np.random.default_rng(4)
    middle = rng.normal(0, 400, (groups, dim))
    x = np.rint(middle[np.arange(groups * size) % groups] + rng.normal(0, 4, (groups * size, dim))).astype(int)
    x[500:560] = x[500]  # a crowded place, with ties
    return x, spark.createDataFrame([(i, [int(c) for c in v]) for i, v in enumerate(x)], "_id long, _v array<long>").repartition(3)


@pytest.mark.parametrize(("block", "chunk", "ring"), [(4096, 256, 32), (16, 3, 4)])
def test_annuli_close_and_results_stay_exact(spark, monkeypatch, block, chunk, ring):
    monkeypatch.setattr(pivot_search, "BLOCK_ROWS", block)
    monkeypatch.setattr(pivot_search, "QUERY_CHUNK", chunk)
    monkeypatch.setattr(pivot_search, "RING_ROWS", ring)
    x, v = _clusters(spark)
    waves = []
    got = pivot_search.search(spark, v, v.where("_id % 20 = 0"), 10, waves=waves).collect()
    asked = range(0, len(x), 20)
    want = set()
    for q in asked:
        s = x @ x[q]
        order = [i for i in np.lexsort((np.arange(len(x)), -s)) if i != q][:10]
        want |= {(q, n + 1, int(i), int(s[i])) for n, i in enumerate(order)}
    assert {(r.query_id, r["rank"], r.vec_id, r.score) for r in got} == want and len(got) == len(want)
    # Waves expand, the last one finds nothing open, and most rows are never scored.
    assert len(waves) >= 2 and waves[-1] == {"pairs": 0, "scored": 0}
    assert sum(w["scored"] for w in waves) < 0.6 * len(x) * len(asked)


def test_rings_and_crowded_pivots(spark, monkeypatch):
    monkeypatch.setattr(pivot_search, "RING_ROWS", 4)
    x, v = _clusters(spark)
    g = pivot_search.geometry(v, "_v")
    pivot, ring, dist = g.place(x.astype(float))
    assert len(g.pivots) > 4 and max(ring) > 1
    for p in set(pivot):  # annuli of a pivot are ranges of distance
        own = sorted(zip(dist[pivot == p], ring[pivot == p], strict=True))
        assert [r for _, r in own] == sorted(r for _, r in own)


def test_vectors_too_large_for_64_bits(spark):
    v = spark.createDataFrame([(0, [2**31, 1]), (100, [5, 2**31])], "_id long, _v array<long>")
    with pytest.raises(ValueError, match="64 bits"):
        pivot_search.search(spark, v, v.where("_id % 100 = 0"), 10)


# ---------------------------------------------------------------- op5


def _cover(docs, keep):
    count, first = collections.Counter(), {}
    for d, t in sorted(docs):
        b = (t or "").encode()
        for s in range(len(b) - 399):
            k = hashlib.md5(b[s : s + 400]).digest()
            count[k] += 1
            first.setdefault(k, (d, s))
    out = {}
    for d, t in docs:
        b = (t or "").encode()
        covered = bytearray(len(b))
        for s in range(len(b) - 399):
            k = hashlib.md5(b[s : s + 400]).digest()
            if count[k] > 1 and (keep == "none" or first[k] != (d, s)):
                covered[s : s + 400] = b"\1" * 400
        out[d] = (b, covered)
    return out


@pytest.fixture(scope="module")
def passages():
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(2, 9))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    shared, docs = [text(80) for _ in range(3)], []
    for i in range(90):
        t = text(rng.randint(0, 150))
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(shared)
            t += " " + p[rng.randint(0, 100) : len(p) - rng.randint(0, 60)] + " " + text(rng.randint(0, 60))
        if rng.random() < 0.2 and docs:
            s = rng.choice(docs)[1]
            j = rng.randint(0, len(s))
            t = s[:j] + "X" + s[j:]
        docs.append((i, t))
    return [*docs, (200, None), (201, ""), (202, "ab " * 600), (203, "ab " * 300), (204, docs[5][1])]


@pytest.mark.parametrize("most", [1000, 2])
def test_passages(spark, sf_dir, passages, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_RUNS", most)
    docs = spark.createDataFrame([(i, t, "x") for i, t in passages], "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in suffix_dedup.op5_suffix_dedup(spark, sf_dir(documents=docs)).collect()}
    for d, (b, covered) in _cover(passages, "none").items():
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        spans = sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
        assert (got[d].n_bytes, got[d].n_removed, got[d].n_spans, got[d].kept_sha256) == (len(b), sum(covered), spans, hashlib.sha256(kept).hexdigest()), d


def test_first_copies_stay(spark, passages):
    docs = spark.createDataFrame(passages, "doc_id long, text string")
    got = {r.doc_id: r.text for r in suffix_dedup.dedup_texts(docs, "first").collect()}
    for d, (b, covered) in _cover(passages, "first").items():
        kept = bytes(x for x, c in zip(b, covered, strict=True) if not c)
        # Whole characters stay: at most three bytes more at each end of a span.
        assert got[d] is None or len(kept) <= len(got[d].encode()) <= len(kept) + 6 * sum(1 for i in range(len(b)) if covered[i] and (i == 0 or not covered[i - 1]))
    assert got[200] is None and "�" not in "".join(t or "" for t in got.values())


def _word_cover(docs, words):
    """Words of later copies of runs of so many words."""
    first, out = {}, {}
    for d, t in sorted(docs, key=lambda x: x[0]):
        w = re.split("[ \t\n\v\f\r]+", (t or "").strip(" \t\n\v\f\r"))
        out[d] = w, bytearray(len(w))
        for s in range(len(w) - words + 1):
            if first.setdefault(tuple(w[s : s + words]), (d, s)) != (d, s):
                out[d][1][s : s + words] = b"\1" * words
    return out


@pytest.mark.parametrize("most", [1000, 2])
def test_passages_of_short_words(spark, most, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_RUNS", most)
    rng = random.Random(21)
    text = lambda n: " ".join(rng.choice("abcdefghé") + rng.choice("xyz") for _ in range(n))
    shared, short, long_ = text(51), text(50), text(90)
    docs = [(1, f"{text(30)} {shared} {text(20)}"), (2, f"{text(7)}\n\n{shared.replace(' ', '  ')} {text(40)}"), (3, f"{text(9)} {short} {text(9)}"), (4, f"{text(5)} {short} {text(8)}"), (5, shared), (6, None), (7, ""), (8, "a b " * 90)]
    docs += [(10 + i, f"{text(i)} {' '.join(long_.split()[i % 30 :][: 50 + i])} {text(i)}") for i in range(30)]
    got = {r.doc_id: r.text for r in suffix_dedup.dedup_texts(spark.createDataFrame(docs, "doc_id long, text string"), "first", words=51).collect()}
    for d, (w, covered) in _word_cover(docs, 51).items():
        assert (got[d] or "").split() == [x for x, c in zip(w, covered, strict=True) if not c and x], d
    assert shared in got[1] and len(got[2].split()) == 47 and got[3] == docs[2][1] and got[4] == docs[3][1] and got[5] == "" and got[6] is None


def test_pipeline_cuts_passages_of_51_short_words(spark):
    import corpus_pipeline as P

    rng = random.Random(22)
    text = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(n))
    shared = text(51)
    assert len(shared) < 400
    docs = spark.createDataFrame([(1, f"{text(60)} {shared}", "en", "s", 0), (2, f"{shared} {text(60)}", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in P.suffix_dedup_stage(spark, docs, "").collect()}
    assert shared in got[1].text and len(got[2].text.split()) == 60 and got[2].n_chars == len(got[2].text)


def test_factors_against_definition():
    rng = random.Random(2)
    for _ in range(60):
        text = "".join(rng.choice("ab") for _ in range(rng.randint(1, 14)))
        order = sorted(range(len(text)), key=lambda i: text[i:])
        common = lambda i, j: next((k for k in range(len(text)) if max(i, j) + k >= len(text) or text[i + k] != text[j + k]), len(text))
        lcp = [0] + [common(a, b) for a, b in zip(order, order[1:], strict=False)]
        before, after = suffix_dedup.factors(order, lcp)
        for n, i in enumerate(order):
            assert before[n] == max((common(i, j) for j in range(i)), default=0)
            assert after[n] == max((common(i, j) for j in range(i + 1, len(text))), default=0)


@pytest.mark.parametrize("step", [1, 8])
def test_suffix_order_and_match_lengths_against_definition(step):
    rng = random.Random(6)
    shape = suffix_dedup.Shape(window=4 * step, gram=2 * step, step=step)
    for _ in range(25):
        # Pieces share parts, and end where other pieces go on; zero bytes are symbols like others.
        pieces = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(4, 30))) for _ in range(rng.randint(1, 5))]
        pieces += [pieces[0][2:9] + b"a", pieces[0]] if len(pieces[0]) > 10 else []
        if step == 8:
            pieces = [b"".join(bytes([x]) * 8 for x in p) for p in pieces]
        counts = [len(p) // step - shape.places + 1 for p in pieces]
        words = [[p[i : i + step] for i in range(0, len(p), step)] for p in pieces]
        places = [(r, o) for r, n in enumerate(counts) for o in range(n)]

        def common(x, y):
            a, b = words[x[0]][x[1] :], words[y[0]][y[1] :]
            return next((i for i, (u, v) in enumerate(zip(a, b, strict=False)) if u != v), min(len(a), len(b)))

        run, offset, before, after = suffix_dedup.repeated_windows(pieces, counts, shape)
        assert list(zip(run.tolist(), offset.tolist(), strict=True)) == places
        for i, place in enumerate(places):
            for got, others in ((before[i], places[:i]), (after[i], places[i + 1 :])):
                want = max((common(place, other) for other in others), default=0)
                # A match of a window or more is found; its length is true up to twice the last doubling.
                assert (got >= shape.places) == (want >= shape.places) and got <= want and (got == want or want < shape.places or want >= 4)


def test_texts_without_repeats_and_odd_rows(spark, odd_documents):
    empty = odd_documents.limit(0)
    assert suffix_dedup.dedup_texts(empty).count() == 0
    kept = suffix_dedup.dedup_texts(odd_documents)
    assert kept.columns == odd_documents.columns and kept.count() == odd_documents.count()


# ---------------------------------------------------------------- op6


def test_decontamination(spark, sf_dir):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(2000)]
    item = [rng.choice(words) for _ in range(30)]
    changed = list(item)
    changed[5], changed[17], changed[26] = "zz", "zz", "zz"
    text = lambda n: [rng.choice(words) for _ in range(n)]
    docs = [
        (1, text(200)), (2, text(50) + item + text(50)), (3, text(50) + changed + text(9)), (4, item[:7] + text(40)), (5, [w.upper() + "," for w in item]), (6, text(3) + item[8:24] + text(30)), (7, []),
    ]
    d = spark.createDataFrame([(i, " ".join(w), 1) for i, w in docs] + [(8, None, 1), (2, " ".join(docs[1][1]), 1)], "doc_id long, text string, matches int")
    items = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, "too short"), (4, " ".join(item))], "item_id long, text string")
    folder = sf_dir(documents=d, benchmark=items)
    got = decontaminate.op6_spaced_seeds(spark, folder).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(i, j) for i in (2, 3, 5, 6) for j in (1, 4)} and len(got) == 8
    by = {(r.doc_id, r.item_id): r for r in got}
    assert (by[2, 1].start, by[2, 1].stop, by[2, 1].matches) == (50, 80, 30) and by[3, 1].matches == 27
    # Beyond the bound, by a join of all seeds.
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(d, items, bound=0).collect()} == {(r.doc_id, r.item_id) for r in got}
    assert sorted(r.doc_id for r in decontaminate.clean(d, items).collect()) == [1, 4, 7, 8]
    assert decontaminate.clean(d, items.limit(0)).count() == d.count()
    assert decontaminate.overlaps(d.limit(0), items).count() == 0


def test_best_similar_stretch_against_brute_force():
    rng = np.random.default_rng(3)
    for n in [0, 1, 2, 46] + [int(x) for x in rng.integers(1, 40, 400)]:
        equal = rng.random(n) < rng.choice([0.3, 0.6, 0.75, 0.85, 0.95])
        every = [(int(equal[a:b].sum()), a - b, -a) for a in range(n) for b in range(a + 1, n + 1) if equal[a:b].sum() * 5 >= (b - a) * 4]
        m, length, a = max(every, default=(0, 0, 0))
        assert decontaminate.stretch(equal) == ((-a, -a - length, m) if m else (0, 0, 0))


def test_failing_stretches_hide_no_passing_ones(spark):
    item = [f"w{i}" for i in range(46)]
    runs = [w if i % 17 < 12 else f"x{i}" for i, w in enumerate(item)]  # three runs of 12 equal words, 5 changed between
    sparse = [w if i % 9 not in (0, 4) else f"y{i}" for i, w in enumerate(item)]  # more matches, but under 0.8
    docs = [(1, runs), (2, runs[:12]), (3, sparse + ["z"] * 3 + item[5:25]), (4, [w if i % 3 else f"v{i}" for i, w in enumerate(item)])]
    frame = spark.createDataFrame([(i, " ".join(w)) for i, w in docs], "doc_id long, text string")
    got = {r.doc_id: (r.start, r.stop, r.matches) for r in decontaminate.overlaps(frame, spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()}
    want = {}
    for i, w in docs:
        every = []
        for d in range(-len(item) + 1, len(w)):
            lo, hi = max(0, d), min(len(w), d + len(item))
            same = [0, *itertools.accumulate(int(w[x].lower() == item[x - d]) for x in range(lo, hi))]
            every += [(m, a - b, -d, a + lo, b + lo) for a in range(hi - lo) for b in range(a + 1, hi - lo + 1) if (m := same[b] - same[a]) >= 12 and 5 * m >= 4 * (b - a)]
        if every:
            want[i] = max(every)[0]
    assert {i: m for i, (_, _, m) in got.items()} == want and {1, 2, 3} <= set(want) and 4 not in want


def test_overlaps_equal_brute_force_and_items_without_id_count(spark):
    rng = random.Random(77)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvwxyz") + rng.choice("xyz")
    items = [(i if i % 4 else None, [word() for _ in range(rng.randint(5, 40))]) for i in range(14)]
    docs = []
    for d in range(60):
        t = [word() for _ in range(rng.randint(0, 30))]
        for _ in range(rng.randint(0, 3)):
            w = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, len(w) // 4)):
                w[rng.randrange(len(w))] = word()
            t += w[rng.randint(0, 6) : len(w) - rng.randint(0, 6)] + [word() for _ in range(rng.randint(0, 9))]
        docs.append((d, t))
    want = set()
    for d, w in docs:
        for i, x in items:
            best = (0, 0.0)
            need = min(12, -(-4 * len(x) // 5))
            for g in range(-len(x) + 1, len(w)) if len(x) >= decontaminate.MIN_WORDS else []:
                lo, hi = max(0, g), min(len(w), g + len(x))
                same = [0, *itertools.accumulate(int(w[p] == x[p - g]) for p in range(lo, hi))]
                for a in range(hi - lo):
                    for b in range(a + 1, hi - lo + 1):
                        m = same[b] - same[a]
                        if m >= need and 5 * m >= 4 * (b - a):
                            best = max(best, (m, m / (b - a)))
            if best[0]:
                want.add((d, i, best[0], round(best[1], 9)))
    frame = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string")
    tests = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    for bound in (500_000, 0):
        assert {(r.doc_id, r.item_id, r.matches, round(r.similarity, 9)) for r in decontaminate.overlaps(frame, tests, bound=bound).collect()} == want
    assert any(i is None for _, i, _, _ in want)
    assert {r.doc_id for r in decontaminate.clean(frame, tests).collect()} == {d for d, _ in docs} - {d for d, _, _, _ in want}


def test_overlaps_are_verified_once(spark, monkeypatch, capsys):
    frame = spark.createDataFrame([(1, " ".join(f"word{i}" for i in range(30)))], "doc_id long, text string")
    keep, plans = decontaminate.stored, []

    def planned(df):
        df.explain()
        plans.append(capsys.readouterr().out)
        return keep(df)

    monkeypatch.setattr(decontaminate, "stored", planned)
    assert decontaminate.overlaps(frame, frame.withColumnRenamed("doc_id", "item_id")).count() == 1
    assert [p.count("ArrowEvalPython [") for p in plans] == [1]  # each one is a Python worker more for a task


def test_every_passing_overlap_holds_a_seed():
    masks, bits = [int(m, 2) for m in decontaminate.MASKS], max(map(len, decontaminate.MASKS)) - 1
    # Most matches of a row of n words without a seed, by its last words.
    most, top = {0: 0}, [0]
    for _ in range(45):
        after = {}
        for last, m in most.items():
            for equal in (0, 1):
                row = last << 1 | equal
                if not any(row & mask == mask for mask in masks):
                    key = row & ((1 << bits) - 1)
                    after[key] = max(after.get(key, 0), m + equal)
        most = after
        top.append(max(most.values()))
    for n in range(1, 46):
        for words in range(max(n, decontaminate.MIN_WORDS), 60):
            assert 5 * top[n] < 4 * n or top[n] < min(12, -(-4 * words // 5)), (n, words)
    # Longer rows are made of rows of 22 to 43 words, none of which is similar enough, so they aren't either.
    assert all(5 * top[n] < 4 * n for n in range(22, 44))


def test_short_and_changed_overlaps(spark):
    rng = random.Random(31)
    items = [[f"i{n}x{i}" for i in range(n)] for n in range(8, 21)]
    docs = []
    for item in items:
        n = len(item)
        for _ in range(12):
            # At most a fifth of the words of a passage that just passes is changed.
            need = min(12, -(-4 * n // 5))
            length = rng.randint(need, min(n, need * 5 // 4))
            at = rng.randint(0, n - length)
            passage = item[at : at + length]
            for place in rng.sample(range(length), length - need):
                passage[place] = f"z{len(docs)}"
            docs.append((len(docs), n, f"{rng.random()} q {' '.join(passage)} r"))
    frame = spark.createDataFrame([(d, t) for d, _, t in docs], "doc_id long, text string")
    tests = spark.createDataFrame([(len(i), " ".join(i)) for i in items], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.overlaps(frame, tests).collect()} == {(d, n) for d, n, _ in docs}


# ---------------------------------------------------------------- op7


def _shingles(text, k=4):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({i: i + 32 for i in range(65, 91)}))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else ({tuple(words)} if words else set())


def _components(docs, k=4, percent=85):
    sets, parent = {d: _shingles(t, k) for d, t in docs}, {d: d for d, _ in docs}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        i = len(sets[a] & sets[b])
        if i and 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {d: (len(sets[d]), find(d)) for d in sets}


@pytest.fixture(scope="module")
def near_copies():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(300)]
    docs = []
    for _ in range(22):
        base = [rng.choice(words) for _ in range(rng.choice([3, 6, 10, 30, 80, 200]))]
        for _ in range(rng.randint(1, 12)):
            b = list(base)
            for _ in range(rng.randint(0, max(1, len(b) // 40))):
                b[rng.randrange(len(b))] = rng.choice(words)
            docs.append((len(docs) + 1, " ".join(b) if rng.random() < 0.8 else "\n ".join(b).upper()))
    return [*docs, (900, None), (901, ""), (902, " \n"), (903, "a"), (904, "A"), (905, "a b")]


def test_jaccard_components(spark, sf_dir, near_copies):
    docs = spark.createDataFrame([(i, t, "x") for i, t in near_copies], "doc_id long, text string, node string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.op7_jaccard_rtree(spark, sf_dir(documents=docs)).collect()}
    assert got == _components(near_copies)


def test_jaccard_in_small_pieces(spark, near_copies, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 3)
    monkeypatch.setattr(jaccard_join, "GUESTS", 2)
    docs = spark.createDataFrame(near_copies, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(docs, 5, 80).collect()}
    assert got == _components(near_copies, 5, 80)


def test_tree_search_against_all_pairs():
    rng = np.random.default_rng(6)
    points = rng.poisson(3, (300, 32))
    points[150:] = points[:150] + rng.integers(0, 2, (150, 32)) * (rng.random((150, 32)) < 0.1)
    sizes = points.sum(axis=1)
    q, e = jaccard_join.CountTree(points, sizes).search(points, sizes, 85)
    want = {(a, b) for a in range(300) for b in range(300) if np.minimum(points[a], points[b]).sum() >= jaccard_join.needed(sizes[a], sizes[b], 85)}
    assert want <= set(zip(q.tolist(), e.tolist(), strict=True))


def test_one_of_each(spark, odd_documents):
    kept = jaccard_join.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    ids = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert 1 in ids and 2 not in ids and 9 not in ids and ids.count(6) == 1 and {3, 4, 5, 7, 8, 10, 11} <= set(ids)
    assert jaccard_join.one_of_each(odd_documents.limit(0)).count() == 0


def test_large_groups_of_near_copies(spark, monkeypatch):
    """One hub links a group; hot keys are dealt over tasks; small bins make many trees."""
    from tidemirror.llm import common

    monkeypatch.setattr(common, "HOT_ROWS", 20)
    monkeypatch.setattr(jaccard_join, "BIN_PAIRS", 7)
    rng = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    docs = [(i, " ".join(base if i % 3 == 0 else [*base[: i % 110], f"q{i}", *base[i % 110 + 1 :]])) for i in range(150)]
    docs += [(200 + i, " ".join(rng.choice(base) for _ in range(60))) for i in range(40)]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard_join.join_components(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == _components(docs)


def test_join_of_hot_keys(spark):
    from tidemirror.llm import common

    left = spark.createDataFrame([(1 if i < 900 else i, i) for i in range(1000)], "k long, v long")
    right = spark.createDataFrame([(i, i * 2) for i in range(0, 1000)], "k long, w long")
    got = common.join_hot(left, right, "k", rows=50)
    assert sorted(map(tuple, got.select("k", "v", "w").collect())) == sorted((1 if i < 900 else i, i, 2 if i < 900 else 2 * i) for i in range(1000))
    assert common.join_hot(left, right.where("k <> 1"), "k", "left", rows=50).where("w IS NULL").count() == 900


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 105), (105, 103), (200, 200)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(2, 41)} | {105: 100, 103: 100}


# ---------------------------------------------------------------- pipeline


def test_pipeline(spark, sf_dir, odd_documents):
    import corpus_pipeline as P

    rng = random.Random(12)
    text = lambda n: " ".join(rng.choice(["the", "of", "and", "with", "thing", "ering", "tion"]) + rng.choice(["a", "b", "c", "d"]) * rng.randint(1, 9) for _ in range(n))
    item, base, shared = text(40), text(120), text(120)
    rows = [(100, base), (101, base + " end"), (102, text(30) + " " + item), (103, text(90) + " " + shared), (104, text(90) + " " + shared), (105, text(60))]
    docs = odd_documents.select("doc_id", "text", "lang", "source", "n_chars").unionByName(spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long"))
    folder = sf_dir(documents=docs, benchmark=spark.createDataFrame([(1, item)], "item_id long, text string"))
    now, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in P.STAGES[:4]:
        now = spark.createDataFrame(stage(spark, now, folder).collect(), docs.schema)
        assert now.columns == P.COLUMNS
        seen[name] = {r.doc_id: r for r in now.collect()}
    assert 3 not in seen["language_id"] and 10 not in seen["language_id"] and 105 in seen["language_id"]
    assert 101 not in seen["near_duplicates"] and {100, 103, 104} <= set(seen["near_duplicates"])
    first, second = seen["suffix_dedup"][103], seen["suffix_dedup"][104]
    assert shared in first.text and shared not in second.text and second.n_chars == len(second.text)
    assert 102 not in seen["decontamination"] and {100, 103, 104, 105} <= set(seen["decontamination"])
    out = {r.doc_id: r.n_tokens for r in P.run(spark, folder).collect()}
    assert set(out) == set(seen["decontamination"]) and all(n > 0 for n in out.values())
    none = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, none, folder).count() == 0
