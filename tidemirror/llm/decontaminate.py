"""Benchmark decontamination by spaced seeds.

A seed hashes some of the words in a window and ignores the others, by a few fixed masks, so a changed word between its
chosen places doesn't hurt it. Seeds of all training texts are joined to the seeds of the test items; each shared seed
proposes an alignment (text, item, diagonal), and each alignment is verified word by word: of the stretches on that diagonal
that are similar enough, the one of most matches counts, and of all diagonals the best.

A text that holds no seed of any item drops out where it is read: a table of the items' seed hashes, broadcast if there are
no more than ``SEED_BOUND`` of them, tells. Beyond that bound every text's seeds are joined by a shuffle instead. The rows of
the items' seeds and the bytes of their words are held against bounds of their own before they are broadcast.

Defined results: null and empty texts and items share nothing; an item of fewer than ``MIN_WORDS`` words is too short to
tell and takes no part; items of equal texts are all reported, rows that share item_id and text are one item, as rows that
share doc_id and text are one document; null ids of either are kept and reported as null; an empty table gives no rows; other
columns are ignored. ``clean`` keeps repeated rows of clean documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, Scratch, as_bytes, blocks, mix, small, span_hashes, stored, table, text_batches, word_table, words_of

#: Places that count in a window. Every overlap that passes (of any length, for items of MIN_WORDS words or more) holds a seed
#: of one of them: no row of words without one has 7 equal words or more and is similar enough. A test goes through all rows.
MASKS = ("111011", "11111", "11010011")
MIN_WORDS = 8
#: A stretch must hold so many equal words (or ITEM_SHARE of a shorter item), and so large a share of them.
MIN_MATCH, ITEM_SHARE, MIN_SIMILARITY = 12, 0.8, 0.8
#: A stretch is similar enough where its matches, worth 1 each, pay for its substitutions at 4 each (0.2 and 0.8 in fifths).
MATCH, SUBSTITUTION = 1, -4
SEED_BOUND = 500_000
#: Bytes of the items' word hashes that may be broadcast.
BODY_BOUND = 1 << 26

OVERLAPS = "doc_id long, _rk long, item_id long, start int, stop int, matches int, item_words int, similarity double"

_WORD = word_table(bytes(range(0x30)) + bytes(range(0x3A, 0x61)) + bytes(range(0x7B, 0x80)))
_ODD = np.random.default_rng(424242).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def seeds(words: np.ndarray, owner: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each mask: the first words of its windows (within one text) and their hashes."""
    n = len(words)
    for number, mask in enumerate(MASKS):
        span = len(mask)
        if n < span:
            continue
        at = np.flatnonzero(owner[: n - span + 1] == owner[span - 1 :])
        h = np.full(n - span + 1, number + 1, np.uint64)
        for place, kept in enumerate(mask):
            if kept == "1":
                h += words[place : n - span + 1 + place] * _ODD[place]
        yield at, mix(h[at])


def tokenized(texts: list[str | None]) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks of texts: index of the first, their number, word hashes, and the text of each word."""
    lowered = as_bytes([t.lower() if isinstance(t, str) else None for t in texts])
    for first, group in blocks(lowered):
        buf, start, end, owner = words_of(group, _WORD)
        yield first, len(group), span_hashes(buf, start, end), owner


def item_seeds(items: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """Items with a key (_ik), their word hashes (as bytes) and seeds."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, n, words, owner in tokenized(list(batch["_t"])):
                at = np.searchsorted(owner, np.arange(n + 1))
                found = [[] for _ in range(n)]
                for places, hashes in seeds(words, owner):
                    for place, h in zip(places.tolist(), hashes.view(np.int64).tolist(), strict=True):
                        found[owner[place]].append((place - int(at[owner[place]]), h))
                yield pd.DataFrame({"item_id": batch["item_id"].iloc[first : first + n].astype("Int64").array, "_ik": batch["_ik"].iloc[first : first + n].array, "item": [words[at[i] : at[i + 1]].tobytes() for i in range(n)], "seeds": [[{"ipos": p, "seed": h} for p, h in f] for f in found]})

    key = F.col(item_id).cast("long")
    rows = items.select(key.alias("item_id"), F.xxhash64(key, F.col(text)).alias("_ik"), F.col(text).alias("_t")).dropDuplicates(["item_id", "_ik"])
    return rows.mapInPandas(run, "item_id long, _ik long, item binary, seeds array<struct<ipos:int,seed:bigint>>").where(F.length("item") >= 8 * MIN_WORDS)


def hit_texts(docs: DataFrame, known: np.ndarray | None) -> DataFrame:
    """Texts that hold a known seed (all texts, if known is None): word hashes and the places of their seeds."""
    spark = docs.sparkSession
    text_batches(spark)
    shared = None if known is None else spark.sparkContext.broadcast(np.sort(known))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        table_ = None if shared is None else shared.value
        if table_ is not None:
            flags = np.zeros(1 << 22, bool)
            flags[(table_ >> np.uint64(42)).astype(np.int64)] = True
        for batch in batches:
            for first, n, words, owner in tokenized(list(batch["text"])):
                places, hashes = [], []
                for at, h in seeds(words, owner):
                    if table_ is not None:
                        maybe = np.flatnonzero(flags[(h >> np.uint64(42)).astype(np.int64)])
                        slot = np.searchsorted(table_, h[maybe])
                        maybe = maybe[table_[np.minimum(slot, len(table_) - 1)] == h[maybe]]
                        at, h = at[maybe], h[maybe]
                    places.append(at)
                    hashes.append(h)
                if not places:
                    continue
                places, hashes = np.concatenate(places), np.concatenate(hashes).view(np.int64)
                whose = owner[places]
                order = np.argsort(whose, kind="stable")
                places, hashes, whose = places[order], hashes[order], whose[order]
                have = np.unique(whose)
                if not len(have):
                    continue
                lo, hi = np.searchsorted(whose, have), np.searchsorted(whose, have, side="right")
                at = np.searchsorted(owner, np.arange(n + 1))
                ids = batch[["doc_id", "_rk"]].iloc[first + have]
                yield pd.DataFrame(
                    {
                        "doc_id": ids["doc_id"].array, "_rk": ids["_rk"].array, "words": [words[at[i] : at[i + 1]].tobytes() for i in have],
                        "hits": [[{"pos": p, "seed": s} for p, s in zip((places[a:b] - at[i]).tolist(), hashes[a:b].tolist(), strict=True)] for i, a, b in zip(have, lo, hi, strict=True)],
                    }
                )

    return docs.mapInPandas(run, "doc_id long, _rk long, words binary, hits array<struct<pos:int,seed:bigint>>")


def stretch(equal: np.ndarray) -> tuple[int, int, int]:
    """(start, end, matches) of the stretch of most matches among those of MIN_SIMILARITY; of several the shortest, then first."""
    n = len(equal)
    total = np.concatenate(([0], np.cumsum(np.where(equal, MATCH, SUBSTITUTION))))
    matches = np.concatenate(([0], np.cumsum(equal)))
    # For each end the first start from which the sum isn't negative: where the least sum so far falls to the end's sum.
    start = np.searchsorted(-np.minimum.accumulate(total), -total)
    found = matches - matches[start]
    if not found.any():
        return 0, 0, 0
    end = np.flatnonzero(found == found.max())
    # Substitutions at a stretch's ends are left out.
    places = np.flatnonzero(equal)
    first, last = places[matches[start[end]]], places[matches[end] - 1] + 1
    best = int((last - first).argmin())
    return int(first[best]), int(last[best]), int(found.max())


def verify(words: pd.Series, item: pd.Series, diagonals: pd.Series) -> pd.DataFrame:
    out = []
    for w, i, ds in zip(words, item, diagonals, strict=True):
        w, i = np.frombuffer(w, np.uint64), np.frombuffer(i, np.uint64)
        best = (0, 0, 0, len(i), 0.0)
        for d in sorted(set(ds)):
            lo, hi = max(0, d), min(len(w), d + len(i))
            if hi > lo:
                a, b, m = stretch(w[lo:hi] == i[lo - d : hi - d])
                if m and (m, m / (b - a)) > (best[2], best[4]):
                    best = (lo + a, lo + b, m, len(i), m / (b - a))
        out.append(best)
    return pd.DataFrame(out, columns=["start", "stop", "matches", "item_words", "similarity"])


def overlaps(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", bound: int = SEED_BOUND) -> DataFrame:
    """doc_id, _rk, item_id, start, stop (words), matches, item_words, similarity of each verified overlap."""
    keyed = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(F.col(doc_id).cast("long"), F.col(text)).alias("_rk"), F.col(text).alias("text"))
    with Scratch() as work:
        tests = work.keep(item_seeds(items))
        test_seeds = tests.select("_ik", F.explode("seeds").alias("s")).select("_ik", "s.ipos", "s.seed")
        distinct = test_seeds.select("seed").distinct()
        known = None
        if distinct.count() <= bound:
            known = np.array([r[0] for r in distinct.collect()], np.int64).view(np.uint64)  # at most ``bound``
            if not len(known):
                return docs.sparkSession.createDataFrame([], OVERLAPS)
        texts = work.keep(hit_texts(keyed, known).dropDuplicates(["doc_id", "_rk"]))
        hits = texts.select("doc_id", "_rk", F.explode("hits").alias("h")).select("doc_id", "_rk", "h.pos", "h.seed")
        pairs = hits.join(small(test_seeds, min(bound, BROADCAST_ROWS)), "seed")
        aligned = pairs.groupBy("doc_id", "_rk", "_ik").agg(F.collect_set(F.col("pos") - F.col("ipos")).alias("diagonals"))
        bodies = tests.select("_ik", "item_id", "item")
        weight = tests.agg(F.coalesce(F.sum(F.length("item")), F.lit(0))).first()[0]
        same = F.col("a.doc_id").eqNullSafe(F.col("t.doc_id")) & (F.col("a._rk") == F.col("t._rk"))
        both = aligned.alias("a").join(texts.select("doc_id", "_rk", "words").alias("t"), same).select("a.doc_id", "a._rk", "_ik", "diagonals", "words")
        # Else the filter on its result would have Spark verify twice, with a second Python worker for each task.
        check = F.pandas_udf(verify, "start int, stop int, matches int, item_words int, similarity double").asNondeterministic()
        checked = both.join(small(bodies, bound) if weight <= BODY_BOUND else bodies, "_ik").withColumn("_v", check("words", "item", "diagonals"))
        enough: Column = F.col("matches") >= F.least(F.lit(MIN_MATCH), F.ceil(F.lit(ITEM_SHARE) * F.col("item_words")))
        return stored(checked.select("doc_id", "_rk", "item_id", "_v.*").where(enough & (F.col("similarity") >= MIN_SIMILARITY))).df


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that overlap no test item. Their texts are not shuffled unless very many documents go."""
    bad = small(stored(overlaps(docs, items, doc_id, text).select("doc_id", "_rk").distinct()).df).alias("b")
    key = F.col(doc_id).cast("long")
    # All columns travel in one struct, so none can clash with the operator's own.
    rows = docs.select(key.alias("doc_id"), F.xxhash64(key, F.col(text)).alias("_rk"), F.struct(*docs.columns).alias("_row")).alias("d")
    return rows.join(bad, F.col("d.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("d._rk") == F.col("b._rk")), "left_anti").select("_row.*")


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return overlaps(docs, items).drop("_rk")


#: All alignments of all texts and items with as many equal words as an overlap needs, without seeds; on each the stretches
#: between any two matches.
ORACLE_OP6 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS word, unnest(range(0, len(w))) AS p FROM d),
iw AS (SELECT item_id, len(w) AS n, least({MIN_MATCH}, ceil({ITEM_SHARE} * len(w))) AS need, unnest(w) AS word, unnest(range(0, len(w))) AS q FROM i WHERE len(w) >= {MIN_WORDS}),
m AS (SELECT doc_id, item_id, n, need, p - q AS diagonal, list(p ORDER BY p) AS ps FROM dw JOIN iw USING (word) GROUP BY ALL HAVING count(*) >= need),
s AS (SELECT doc_id, item_id, n, need, diagonal, ps[x] AS a, ps[y] + 1 AS z, y - x + 1 AS k FROM m, LATERAL (SELECT unnest(range(1, len(ps) + 1)) AS x) u, LATERAL (SELECT unnest(range(x, len(ps) + 1)) AS y) v
 WHERE y - x + 1 >= need AND 5 * (y - x + 1) >= 4 * (ps[y] + 1 - ps[x])),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY k DESC, z - a, diagonal, a) AS o FROM s)
SELECT doc_id, item_id, a::INTEGER AS start, z::INTEGER AS stop, k::INTEGER AS matches, n::INTEGER AS item_words, k / (z - a)::DOUBLE AS similarity FROM r WHERE o = 1
"""
