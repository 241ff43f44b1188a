"""Periodic runs of words, found with string synchronising sets.

A run is a maximal stretch of words of smallest period q (words q apart are equal) and at least max(12, 2q) words. Texts are
turned into word hashes in numpy, many texts at once, with a border of its own behind each, so that no run crosses texts.
Periods are taken in dyadic classes, small ones first:

* periods below 16 are read off by comparing the words with themselves, moved by q. Those stretches are also the highly
  periodic regions that the synchronising sets leave out;
* periods from 4t to 8t (t = 4, 8, 16, ...) come from a synchronising set of scale t: a window of t words has a hash; a
  position is selected if the least hash among the windows that start in the t + 1 places from it on, those of highly periodic
  windows (period t/3 or less) left out, is at its first or last place. Whether a position is selected depends on the next 2t
  words only, so a position and the one q words later in a run are selected alike, and their 2t words are equal. Selected
  positions with equal 2t words are t/3 apart at least, so each is paired with all that follow it in 8t words (some 24 at
  most), and each pair proposes its distance as a period;
* a run none of whose positions is selected has a first half of period t/3 or less, and its second half is another such
  region of the same period that touches it. Every border of two such regions proposes the distances by which their words
  agree.

A proposal is extended to both sides as far as words agree (longest common extensions by hashes and halving), and kept if it
is long enough and no part of its period is a period. All runs of a text are found; ``tests/llm/test_periodic_runs.py`` holds
them against brute force. Hashes have 64 bits; each run's period is checked word by word in the end.

Defined results: a null or empty text, and one without words, has no run and the collapsed text ''; the op13 query changes the
words of documents whose crc32 of the decimal doc_id is divisible by 10, rows without doc_id stay as they are; repeated rows
give repeated results; very long words and texts are taken whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .common import _powers, as_bytes, blocks, mix, span_hashes, table, text_batches, word_table, words_of

#: Runs have at least so many words; periods below SMALL are read off directly.
LEAST, SMALL = 12, 16
_WORD = word_table(b" \t\n\x0b\x0c\r")
_EDGE = np.uint64(0xA0761D6478BD642F)
_INF = np.uint64(0xFFFFFFFFFFFFFFFF)


class Hashes:
    """Hashes of any stretches of one row of words."""

    def __init__(self, w: np.ndarray):
        self.w, self.n = w, len(w)
        up, self.down = _powers(self.n + 1)
        self.sums = np.zeros(self.n + 1, np.uint64)
        np.cumsum(mix(w) * up[: self.n], out=self.sums[1:])

    def of(self, start: np.ndarray, size) -> np.ndarray:
        return (self.sums[start + size] - self.sums[start]) * self.down[start]

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree from i and from j > i on."""
        low, high = np.zeros(len(i), np.int64), self.n - j
        while len(i) and (low < high).any():
            mid = (low + high + 1) // 2
            same = self.of(i, mid) == self.of(j, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words agree before i and before j > i."""
        low, high = np.zeros(len(i), np.int64), i.copy()
        while len(i) and (low < high).any():
            mid = (low + high + 1) // 2
            same = self.of(i - mid, mid) == self.of(j - mid, mid)
            low, high = np.where(same, mid, low), np.where(same, high, mid - 1)
        return low


def stretches(same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches of true places."""
    edge = np.flatnonzero(np.diff(np.concatenate(([False], same, [False])).view(np.int8)))
    return edge[0::2], edge[1::2]


def primes_of(q: int) -> list[int]:
    out, p = [], 2
    while p * p <= q:
        if q % p == 0:
            out.append(p)
            while q % p == 0:
                q //= p
        p += 1
    return out + [q] if q > 1 else out


def primitive(h: Hashes, s: np.ndarray, e: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Whether q is the smallest period of each stretch [s, e) of period q and at least 2q words: else a part of q is one."""
    ok = np.ones(len(s), bool)
    for one in np.unique(q):
        own = np.flatnonzero(q == one)
        for p in primes_of(int(one)):
            part = int(one) // p
            ok[own] &= h.of(s[own], e[own] - s[own] - part) != h.of(s[own] + part, e[own] - s[own] - part)
    return ok


def small_runs(h: Hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of smallest period below SMALL and at least two periods, be they shorter than LEAST."""
    found = []
    for q in range(1, min(SMALL, h.n // 2 + 1)):
        s, e = stretches(h.w[q:] == h.w[:-q])
        keep = e - s >= q
        s, e = s[keep], e[keep] + q
        found.append((s, e, np.full(len(s), q)))
    s, e, q = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3
    ok = primitive(h, s, e, q)
    return s[ok], e[ok], q[ok]


def window_least(x: np.ndarray, size: int) -> np.ndarray:
    """The least of each ``size`` neighbouring values."""
    got, have = x, 1
    while have * 2 <= size:
        got, have = np.minimum(got[:-have], got[have:]), have * 2
    return got if have == size else np.minimum(got[: len(x) - size + 1], got[size - have :])


def selected(h: Hashes, end: int, t: int, regions: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
    """The synchronising set of scale t of the first ``end`` words."""
    ids = mix(h.of(np.arange(end - t + 1), t))
    s, e, q = regions
    deep = (3 * q <= t) & (e - s >= t) & (e <= end)
    marks = np.zeros(end - t + 2, np.int64)
    np.add.at(marks, s[deep], 1)
    np.add.at(marks, e[deep] - t + 1, -1)
    ids[np.cumsum(marks[:-1]) > 0] = _INF
    least = window_least(ids, t + 1)
    return np.flatnonzero((least != _INF) & ((least == ids[: len(least)]) | (least == ids[t:])))


def proposals(h: Hashes, end: int, t: int, regions: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) pairs of periods from 4t to 8t."""
    at = selected(h, end, t, regions)
    at = at[at + 2 * t <= end]
    context = h.of(at, 2 * t)
    order = np.lexsort((at, context))
    at, context = at[order], context[order]
    found = []
    lag, near = 1, np.arange(len(at))
    while len(near):
        near = near[near + lag < len(at)]
        near = near[(context[near + lag] == context[near]) & (at[near + lag] - at[near] < 8 * t)]
        far = at[near + lag] - at[near]
        found.append((at[near][far >= 4 * t], far[far >= 4 * t]))
        lag += 1
    # Borders of two touching regions of one period.
    s, e, p = regions
    deep = np.flatnonzero((3 * p <= t) & (e - s >= 4 * t) & (e <= end))
    deep = deep[np.lexsort((s[deep], p[deep]))]
    a, b = deep[:-1], deep[1:]
    meet = (p[a] == p[b]) & (s[b] <= e[a])
    a, b = a[meet], b[meet]
    most = np.minimum(np.minimum(e[a] - s[a], e[b] - s[b]), 8 * t - 1)
    times = np.maximum(most - 4 * t + 1, 0)
    which = np.repeat(np.arange(len(a)), times)
    q = 4 * t + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
    i = np.maximum(s[a][which], s[b][which] - q)
    size = p[a][which]
    fits = (i + size <= e[a][which]) & (i + q + size <= e[b][which])
    i, q, size = i[fits], q[fits], size[fits]
    same = h.of(i, size) == h.of(i + q, size)
    found.append((i[same], q[same]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def runs_of(w: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs, in order of start and period. w holds the texts' words one text behind the other, the
    longest first, and sizes how many words each has, its border included: no stretch crosses a border."""
    h = Hashes(w)
    s, e, q = small_runs(h)
    ends, t = np.cumsum(sizes), SMALL // 4
    while len(sizes) and 8 * t <= sizes[0]:
        end = int(ends[np.searchsorted(-sizes, -8 * t, side="right") - 1])  # texts that can hold two such periods
        i, far = proposals(h, end, t, (s, e, q))
        far, i = np.unique(np.stack([far, i]), axis=1) if len(i) else (far, i)
        more, back = h.ahead(i, i + far), h.behind(i, i + far)
        keep = more + back >= far
        new = np.unique(np.stack([i[keep] - back[keep], i[keep] + far[keep] + more[keep], far[keep]]), axis=1)
        ok = primitive(h, *new)
        s, e, q = (np.concatenate([x, y[ok]]) for x, y in zip((s, e, q), new, strict=True))
        t *= 2
    keep = e - s >= LEAST
    s, e, q = s[keep], e[keep], q[keep]
    order = np.lexsort((q, s))
    s, e, q = s[order], e[order], q[order]
    true = [bool((w[a : b - c] == w[a + c : b]).all()) for a, b, c in zip(s, e, q, strict=True)]
    return (s, e, q) if all(true) else (s[true], e[true], q[true])


def planted(doc_id: int, n: int) -> np.ndarray | None:
    """The places that a chosen document's words are taken from; None if it stays as it is."""
    h = zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    at = np.arange(n)
    return np.where(at < a, at, a + (at - a) % p)


class TextRuns:
    """The runs of one text and what is left of its words."""

    def __init__(self, words: list[bytes], s: np.ndarray, e: np.ndarray, q: np.ndarray):
        self.words, self.start, self.end, self.period = words, s, e, q

    def longest(self) -> tuple:
        if not len(self.start):
            return (None,) * 4
        size = self.end - self.start
        i = int(np.lexsort((self.period, self.start, -size))[0])
        return int(self.start[i]), int(size[i]), int(self.period[i]), int(1000 * size[i] // self.period[i])

    def lines(self) -> str:
        return "".join(f"{s},{e - s},{q}\n" for s, e, q in zip(self.start.tolist(), self.end.tolist(), self.period.tolist(), strict=True))

    def collapsed(self) -> bytes:
        """The words that no run contains after its first period."""
        marks = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(marks, self.start + self.period, 1)
        np.add.at(marks, self.end, -1)
        kept = np.cumsum(marks[:-1]) == 0
        return b" ".join(w for w, k in zip(self.words, kept, strict=True) if k)


def text_runs(texts: list[str | None], doc_ids: list[int | None] | None = None) -> Iterator[TextRuns]:
    """The runs of each text in its order; with ids, those of the texts as the op13 query changes them."""
    for first, group in blocks(as_bytes(texts)):
        buf, start, end, owner = words_of(group, _WORD)
        v = span_hashes(buf, start, end)
        at = np.searchsorted(owner, np.arange(len(group) + 1))
        picks, changed = [], []
        for i in range(len(group)):
            pick = None if doc_ids is None or doc_ids[first + i] is None else planted(doc_ids[first + i], int(at[i + 1] - at[i]))
            changed.append(pick is not None)
            picks.append(np.arange(at[i], at[i + 1]) if pick is None else at[i] + pick)
        sizes = np.array([len(p) + 1 for p in picks])
        order = np.argsort(-sizes, kind="stable")
        places = np.cumsum(sizes[order]) - sizes[order]
        w = np.empty(int(sizes.sum()), np.uint64)
        for place, i in zip(places, order, strict=True):
            w[place : place + len(picks[i])] = v[picks[i]]
            w[place + len(picks[i])] = mix(np.array([_EDGE + np.uint64(i)], np.uint64))[0]
        s, e, q = runs_of(w, sizes[order])
        cut = np.searchsorted(s, np.concatenate([places, [len(w)]]))
        place_of = {int(i): k for k, i in enumerate(order)}
        for i, text in enumerate(group):
            k = place_of[i]
            own = slice(cut[k], cut[k + 1])
            words = text.split()  # bytes: the same separators
            if changed[i]:
                words = [words[x] for x in picks[i] - at[i]]
            yield TextRuns(words, s[own] - places[k], e[own] - places[k], q[own])


def digests(docs: DataFrame, change: bool = False) -> DataFrame:
    """doc_id, the number of runs, the longest one, and digests of all runs and of the collapsed text, for docs (doc_id, text)."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["doc_id"].astype("Int64").tolist()
            ids = [None if i is pd.NA else i for i in ids]
            rows = [(i, len(r.start), *r.longest(), hashlib.sha256(r.lines().encode()).hexdigest(), hashlib.sha256(r.collapsed()).hexdigest()) for i, r in zip(ids, text_runs(list(batch["text"]), ids if change else None), strict=True)]
            out = pd.DataFrame(rows, columns=["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"])
            yield out.astype({c: "Int64" for c in ("doc_id", "start", "length", "period", "exponent_milli")})

    return docs.mapInPandas(run, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")


def collapse(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with the text's repeated periods taken out, its words joined by one blank, and the number of runs."""
    text_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = list(text_runs(list(batch["text"])))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "text": [r.collapsed().decode("utf-8", "replace") for r in found], "n_runs": [len(r.start) for r in found]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, text string, n_runs long")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents").select("doc_id", "text"), change=True)
