"""Removal of repeated passages by longest-previous-factor arrays.

A passage is a window of ``WINDOW`` bytes. Its suffixes are compared where they can be equal:

1. Every window has one anchor, the leftmost least hash of its 64-byte substrings, so equal windows have equal anchors at
   equal offsets. An anchor stands for the run of windows that have it. Windows whose anchor hash occurs once are unique.
2. Runs that are equal as a whole (same anchor hash, same bytes from the first window's start to the last one's end) are
   counted by hash: all their windows repeat, and only the first of them is looked at further.
3. Runs that share an anchor but differ are brought together. A group's text is put into suffix order (by prefix doubling),
   the ranks of the doublings give the common prefix of neighbours in that order, and the previous and next smaller places
   in it give each window's longest previous factor: its longest match with any earlier place. The same over falling places
   gives the longest match with a later one. A match of ``WINDOW`` or more covers as many bytes as it is long.
4. An anchor with too many different runs for one task is split: each run is cut, at offsets fixed from the anchor, into
   shorter runs, keyed by all the bytes their windows share, and these go through steps 2 and 3 anew, down to runs of one
   window, which have nothing left to differ in. So no group is ever larger than a task can hold, and none is capped.

Passages can also be counted in words (``words`` of ``dedup_texts``): each text is then written as one 8-byte hash a word, a
window is so many words whatever their lengths, and the same steps run with places counted in words. Blanks between words
don't matter there; a word is what blanks enclose, with its case and punctuation.

``keep="first"`` removes later copies and keeps the first (in order of doc_id, then place); ``keep="none"`` removes all.

Defined results: a null text is empty; texts shorter than a window are kept; matches never cross texts; repeated rows are
texts of their own, so they repeat each other; rows that share doc_id and text get the same answer, null ids are kept; an
empty table gives no rows; other columns are ignored. Long texts are read in pieces of bounded size.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _BYTE, BROADCAST_ROWS, Scratch, _powers, as_bytes, blocks, mix, rows_of, span_hashes, stored, table, text_batches, word_table, words_of

WINDOW, GRAM = 400, 64
#: Different runs of one anchor, and about as many of all anchors, that one task puts into suffix order.
GROUP_RUNS = 1_000
#: Windows of a run after the first, second and third split.
SPLITS = (24, 4, 1)
PIECE = 1 << 19
#: Bytes of runs that a task hands on at once.
FRAME_BYTES = 1 << 22
_POSITION = np.uint64((1 << 28) - 1)
_ROW = "h long, c1 long, c2 long, doc_id long, _rk long, at long"  # at: start * 1024 + windows


_BLANKS = word_table(b" \t\n\v\f\r")


@dataclass(frozen=True)
class Shape:
    """What windows are made of: bytes of a window and of the grams that anchor it; places are every ``step`` bytes."""

    window: int = WINDOW
    gram: int = GRAM
    step: int = 1

    @property
    def places(self) -> int:
        return self.window // self.step

    def read(self, values) -> list[bytes]:
        """Texts as the bytes that are compared: their own, or the hashes of their words."""
        texts = [v if isinstance(v, bytes) else b"" if v is None or v != v else v.encode("utf-8", "surrogatepass") for v in values]
        return texts if self.step == 1 else [h for h, _, _ in spelled(texts)]


def bytes_shape(window: int = WINDOW) -> Shape:
    # A run has at most window - gram + 1 windows, and fewer than 1,024 fit beside its place.
    if not 2 * 24 <= window < 1024:
        raise ValueError(f"a window of {window} bytes is not supported")
    return Shape(window, max(8, min(GRAM, window // 4)), 1)


def words_shape(words: int) -> Shape:
    if not 2 * 24 <= words < 1024:
        raise ValueError(f"a window of {words} words is not supported")
    return Shape(8 * words, 64, 8)


def spelled(texts: list[bytes]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
    """Of each text: its words' hashes as bytes, and where each word starts and ends."""
    for _, group in blocks(texts):
        buf, start, end, owner = words_of(group, _BLANKS)
        h = span_hashes(buf, start, end)
        at = np.searchsorted(owner, np.arange(len(group) + 1))
        begin = 0
        for i, text in enumerate(group):
            a, b = at[i], at[i + 1]
            yield h[a:b].tobytes(), start[a:b] - begin, end[a:b] - begin
            begin += len(text) + 1


def gram_hashes(buf: np.ndarray, shape: Shape = Shape()) -> np.ndarray:
    n = len(buf)
    up, down = _powers(n + 1)
    pre = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[buf] * up[:n], out=pre[1:])
    last = n - shape.gram + 1
    return mix((pre[shape.gram :: shape.step] - pre[: last : shape.step]) * down[: last : shape.step])


def runs(buf: np.ndarray, ends: np.ndarray, shape: Shape = Shape()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor, anchor hash) of each run, in places; ends: the place where each text of the buffer ends."""
    h = gram_hashes(buf, shape)
    key = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    width, need = 1, (shape.window - shape.gram) // shape.step + 1
    while width * 2 <= need:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    rest = need - width
    key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
    anchor = (key & _POSITION).astype(np.int64)  # of the window that starts here
    begins = np.concatenate(([0], ends[:-1]))
    inside = np.zeros(len(anchor) + 1, np.int64)
    has = ends - begins >= shape.places
    np.add.at(inside, begins[has], 1)
    np.add.at(inside, np.minimum(ends[has] - shape.places + 1, len(anchor)), -1)
    ok = np.cumsum(inside[:-1]) > 0
    new = ok.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    first = np.flatnonzero(new)
    count = np.add.reduceat(ok.astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
    return first, count, anchor[first], h[anchor[first]]


def _context(data: bytes) -> tuple[int, int]:
    return struct.unpack("<qq", hashlib.blake2b(data, digest_size=16).digest())


def all_runs(docs: DataFrame, shape: Shape = Shape()) -> DataFrame:
    """The runs of all texts, by anchor hash (h) and by all their bytes (c1, c2)."""
    step, places = shape.step, shape.places

    def rows(text: list[bytes], ids: pd.DataFrame, base: int) -> Iterator[tuple]:
        joined = b"".join(text)
        if len(joined) < shape.window:
            return
        ends = np.cumsum([len(t) // step for t in text])
        first, count, anchor, h = runs(np.frombuffer(joined, np.uint8), ends, shape)
        owner = np.searchsorted(ends, first, side="right")
        begin = np.concatenate(([0], ends[:-1]))
        doc, rk = ids["doc_id"].tolist(), ids["_rk"].tolist()
        for s, n, a, x, o, b in zip(first.tolist(), count.tolist(), anchor.tolist(), h.view(np.int64).tolist(), owner.tolist(), begin[owner].tolist(), strict=True):
            c1, c2 = _context(joined[s * step : (s + n - 1 + places) * step] + struct.pack("<q", a - s))
            yield x, c1, c2, doc[o], rk[o], (s - b + base) * 1024 + n

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _ROW.split(", ")]
        for batch in batches:
            texts = shape.read(batch["text"])
            ids = batch[["doc_id", "_rk"]].astype({"doc_id": "Int64"})
            for first, group in blocks(texts, PIECE):
                own = ids.iloc[first : first + len(group)]
                pieces = [(group, 0)] if len(group) > 1 else [([group[0][at : at + PIECE + shape.window - step]], at // step) for at in range(0, max(1, len(group[0])), PIECE)]
                for part, base in pieces:
                    found = list(rows(part, own, base))
                    if found:
                        yield pd.DataFrame(found, columns=names).astype({"doc_id": "Int64"})

    return docs.mapInPandas(run, _ROW)


def sub_rows(piece: bytes, h: int, start: int, n: int, size: int, shape: Shape = Shape()) -> list[tuple[int, int, int, int, bytes]]:
    """The runs that a run is split into: (h, c1, c2, at, bytes). Borders are where (place - anchor) is a multiple of size."""
    anchor, step = anchor_of(piece, shape), shape.step
    out = []
    s = 0
    while s < n:
        border = s - (s - anchor) % size  # where the full block would start
        stop = min(n, border + size)
        # All windows of a full block share these bytes; the key must be the same for cut-off blocks at a run's ends.
        core = piece[(border + size - 1) * step : (border + shape.places) * step]
        key = hashlib.blake2b(core + struct.pack("<qq", h, border - anchor), digest_size=8).digest()
        own = piece[s * step : (stop - 1 + shape.places) * step]
        c1, c2 = _context(own + struct.pack("<q", s - border))
        out.append((struct.unpack("<q", key)[0], c1, c2, (start + s) * 1024 + stop - s, own))
        s = stop
    return out


def anchor_of(piece: bytes, shape: Shape = Shape()) -> int:
    """The anchor of a run's windows (they share it), from the run's bytes."""
    h = gram_hashes(np.frombuffer(piece[: shape.window], np.uint8), shape)
    key = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    return int(key.min() & _POSITION)


# ---------------------------------------------------------------- suffix order in a group


#: Symbols in the first key of a suffix of bytes, 9 bits each (0 is the end).
PACKED = 7


def _ranked(key: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 1, and the highest."""
    order = np.argsort(key)
    in_order = key[order]
    new = np.ones(len(key), np.int64)
    new[1:] = in_order[1:] != in_order[:-1]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(rank[order[-1]])


@dataclass
class Suffixes:
    """The suffixes of several pieces: each ends with its piece. ``levels`` holds (h, rank of the first h symbols); the last h is
    a window or more, so suffixes that share less than that are in their order."""

    end: np.ndarray  # where the piece of a place ends
    first: np.ndarray  # packed symbols, or the symbols themselves
    packed: int
    levels: list[tuple[int, np.ndarray]]

    @classmethod
    def of(cls, pieces: list[bytes], shape: Shape) -> tuple[Suffixes, np.ndarray]:
        """The suffixes, and the place where each piece begins."""
        size = np.array([len(p) // shape.step for p in pieces])
        packed = PACKED if shape.step == 1 else 1
        begin = np.concatenate(([0], np.cumsum(size + packed - 1)[:-1]))
        total = int(begin[-1] + size[-1] + packed - 1)
        if shape.step == 1:
            pad = b"\0" * (packed - 1)
            symbols = np.frombuffer(pad.join(pieces) + pad, np.uint8).astype(np.int64) + 1
            inside = np.zeros(total + 1, np.int64)
            np.add.at(inside, begin, 1)
            np.add.at(inside, begin + size, -1)
            symbols *= np.cumsum(inside[:-1])  # 0 between pieces
            symbols = np.concatenate([symbols, np.zeros(packed, np.int64)])
            first = np.zeros(total, np.int64)
            for j in range(packed):
                first = (first << 9) | symbols[j : j + total]
        else:
            first = np.frombuffer(b"".join(pieces), np.int64)
        end = np.repeat(begin + size, size + packed - 1)
        rank, highest = _ranked(first)
        levels, h, left = [(packed, rank.astype(np.int32))], packed, end - np.arange(total)
        while h < shape.places and highest < total:
            # As many ranks as fit one key: three for places of up to 2 million, so that lengths triple.
            bits = highest.bit_length()
            times = max(2, min(63 // bits, -(-shape.places // h)))
            key = rank
            for j in range(1, times):
                rest = np.zeros(total, np.int64)
                rest[: total - j * h] = rank[j * h :]
                key = key << bits | np.where(left > j * h, rest, 0)
            rank, highest = _ranked(key)
            h *= times
            levels.append((h, rank.astype(np.int32)))
        return cls(end, first, packed, levels), begin

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, in symbols."""
        last = len(self.end) - 1
        got = np.zeros(len(a), np.int64)
        above = 2 * self.levels[-1][0]
        for h, rank in reversed(self.levels):
            for _ in range(above // h - 1):  # less than the level above is left
                got += h * (rank[np.minimum(a + got, last)] == rank[np.minimum(b + got, last)])
            above = h
        if self.packed > 1:
            differ = self.first[np.minimum(a + got, last)] ^ self.first[np.minimum(b + got, last)]
            for j in range(1, self.packed):
                got += differ < 1 << 9 * (self.packed - j)
        return np.minimum(got, np.minimum(self.end[a] - a, self.end[b] - b))


def _nearest_smaller(place: np.ndarray, lcp: np.ndarray, least: int) -> np.ndarray:
    """For each entry of a suffix order its common prefix with the nearest entry before it that has a smaller place (0, if there
    is none, or less than ``least`` in common). lcp[i]: common prefix of entries i - 1 and i."""
    linked = lcp >= least
    linked[:1] = False
    near, common = np.where(linked, np.arange(len(place)) - 1, -1), np.where(linked, lcp, 0)
    # All entries between an entry and its candidate have larger places, so the candidate's candidate is the next to try.
    todo = np.flatnonzero(linked)
    while len(todo):
        todo = todo[(near[todo] >= 0) & (place[near[todo]] > place[todo])]
        to = near[todo]
        common[todo] = np.minimum(common[todo], common[to])
        near[todo] = near[to]
    common[near < 0] = 0
    return common


def factors(position: np.ndarray, lcp: np.ndarray, least: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Longest previous and longest next factor of each entry of a suffix array, where they are ``least`` long (else 0).

    position: the text place of each entry, in suffix order; lcp[i]: common prefix of entries i - 1 and i. The longest match
    with a smaller place is with the previous or the next smaller place in suffix order; with a larger place likewise.
    """
    position, lcp = np.asarray(position, np.int64), np.asarray(lcp, np.int64)
    back = np.concatenate(([0], lcp[:0:-1]))
    return tuple(np.maximum(_nearest_smaller(p, lcp, least), _nearest_smaller(p[::-1], back, least)[::-1]) for p in (position, -position))


def repeated_windows(pieces: list[bytes], counts: list[int], shape: Shape = Shape()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(run, offset, longest match with an earlier, with a later place) of every window of some runs, given by their bytes and
    windows, in the order of the texts' places."""
    suffixes, begin = Suffixes.of(pieces, shape)
    n = np.array(counts)
    run = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(run)) - np.repeat(np.cumsum(n) - n, n)
    start = begin[run] + offset
    order = np.argsort(suffixes.levels[-1][1][start], kind="stable")
    at = start[order]
    lcp = np.concatenate(([0], suffixes.common(at[:-1], at[1:])))
    before, after = np.empty(len(run), np.int64), np.empty(len(run), np.int64)
    before[order], after[order] = factors(order, lcp, shape.places)  # windows are numbered by place
    return run, offset, before, after


# ---------------------------------------------------------------- the jobs


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}._rk") == F.col(f"{b}._rk"))


def repeated_spans(docs: DataFrame, keep: str = "first", shape: Shape = Shape()) -> DataFrame:
    """doc_id, _rk, start, end of repeated bytes (of words, if the shape is of words), for texts with the columns doc_id, _rk
    and text, as a stored table. Spans may overlap."""
    text_batches(docs.sparkSession)
    first_only = keep == "first"
    with Scratch() as work:
        rows, found = work.keep(all_runs(docs, shape)), []
        level = rows
        for depth in range(len(SPLITS) + 1):
            # Partial aggregation makes one row for each key and task, however hot a key is.
            place = [F.coalesce("doc_id", F.lit(-(2**63))).alias("order"), "_rk", "at", "doc_id"] + (["piece"] if depth else [])
            kinds = work.keep(rows.groupBy("h", "c1", "c2").agg(F.count("*").alias("n"), F.min(F.struct(*place)).alias("first")))
            found.append(work.keep(_copies(rows, kinds, first_only, shape)))
            differing = work.keep(_differing(kinds))
            work.drop(level, kinds)
            size = SPLITS[depth] if depth < len(SPLITS) else None
            if not rows_of(differing):
                break
            level = work.keep(_pieces_of_texts(docs, differing, size, shape) if not depth else _pieces_of_runs(differing, size, shape))
            work.drop(differing)
            found.append(work.keep(_in_suffix_order(level.where("bin IS NOT NULL"), first_only, shape)))
            rows = level.where("bin IS NULL").select("h", "c1", "c2", "doc_id", "_rk", "at", "piece")
            if rows.isEmpty():
                break
        out = found[0]
        for other in found[1:]:
            out = out.unionByName(other)
        return stored(out.distinct()).df


def _copies(rows: DataFrame, kinds: DataFrame, first_only: bool, shape: Shape) -> DataFrame:
    """Spans of runs that are equal as a whole to another run (to an earlier one)."""
    same = kinds.where("n > 1").select("h", "c1", "c2", "first.doc_id", "first._rk", "first.at").alias("k")
    copies = rows.select("h", "c1", "c2", "doc_id", "_rk", "at").alias("r").join(same, ["h", "c1", "c2"])
    if first_only:
        copies = copies.where(~(F.col("k.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("k._rk") == F.col("r._rk")) & (F.col("k.at") == F.col("r.at"))))
    start = F.floor(F.col("r.at") / 1024).cast("long")
    return copies.select("r.doc_id", "r._rk", start.alias("start"), (start + F.col("r.at") % 1024 + (shape.places - 1)).alias("end"))


def _differing(kinds: DataFrame) -> DataFrame:
    """The first run of each kind, where an anchor has several kinds."""
    anchors = kinds.groupBy("h").agg(F.count("*").alias("kinds")).where("kinds > 1")
    return kinds.join(anchors, "h").select("h", "kinds", "first.*")


_FETCHED = "bin long, h long, c1 long, c2 long, doc_id long, _rk long, at long, order long, piece binary"


def _placed(rows: Iterator[tuple], bins: int, size: int | None, most: int, shape: Shape) -> Iterator[pd.DataFrame]:
    """Runs (h, kinds, doc_id, _rk, at, order, bytes) as rows of their bin, or, of groups too large, split; in frames of about
    FRAME_BYTES."""

    def frame(out: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(out, columns=["bin", "h", "c1", "c2", "doc_id", "_rk", "at", "order", "piece"]).astype({c: "Int64" for c in ("bin", "c1", "c2", "doc_id", "order")})

    out: list[tuple] = []
    held = 0
    for h, kinds, doc, rk, at, order, piece in rows:
        if size is None or kinds <= most:
            out.append((h % bins, h, None, None, doc, rk, at, order, piece))
            held += len(piece)
        else:
            parts = sub_rows(piece, h, at // 1024, at % 1024, size, shape)
            out.extend((None, h_, c1, c2, doc, rk, at_, None, own) for h_, c1, c2, at_, own in parts)
            held += sum(len(own) for *_, own in parts)
        if held >= FRAME_BYTES:
            yield frame(out)
            out, held = [], 0
    if out:
        yield frame(out)


def _pieces_of_texts(docs: DataFrame, runs_: DataFrame, size: int | None, shape: Shape) -> DataFrame:
    bins, most = max(1, rows_of(runs_) // GROUP_RUNS), GROUP_RUNS
    listed = runs_.groupBy("doc_id", "_rk").agg(F.collect_list(F.struct("h", "kinds", "at", "order")).alias("runs"))
    both = docs.alias("d").join(listed.alias("l"), _same("d", "l")).select("d.doc_id", "d._rk", "text", "runs").dropDuplicates(["doc_id", "_rk"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = (
                (r["h"], r["kinds"], doc, rk, r["at"], r["order"], text[r["at"] // 1024 * shape.step : (r["at"] // 1024 + r["at"] % 1024 - 1 + shape.places) * shape.step])
                for doc, rk, text, own in zip(batch["doc_id"].astype("Int64"), batch["_rk"], shape.read(batch["text"]), batch["runs"], strict=True) for r in own
            )
            yield from _placed(rows, bins, size, most, shape)

    return both.mapInPandas(run, _FETCHED)


def _pieces_of_runs(runs_: DataFrame, size: int | None, shape: Shape) -> DataFrame:
    bins, most = max(1, rows_of(runs_) // GROUP_RUNS), GROUP_RUNS

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield from _placed(zip(batch["h"], batch["kinds"], batch["doc_id"].astype("Int64"), batch["_rk"], batch["at"], batch["order"], batch["piece"], strict=True), bins, size, most, shape)

    return runs_.select("h", "kinds", "doc_id", "_rk", "at", "order", "piece").mapInPandas(run, _FETCHED)


def _in_suffix_order(groups: DataFrame, first_only: bool, shape: Shape) -> DataFrame:
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["order", "_rk", "at"], kind="stable")
        at = pdf["at"].to_numpy()
        run_, offset, before, after = repeated_windows(list(pdf["piece"]), (at % 1024).tolist(), shape)
        longest = before if first_only else np.maximum(before, after)
        hit = np.flatnonzero(longest >= shape.places)
        start = at[run_[hit]] // 1024 + offset[hit]
        # Matches that overlap in one run make one span.
        end = start + longest[hit]
        new = np.flatnonzero(np.concatenate(([True], (run_[hit][1:] != run_[hit][:-1]) | (start[1:] > start[:-1] + 1)))) if len(hit) else np.zeros(0, np.int64)
        rows = pdf[["doc_id", "_rk"]].astype({"doc_id": "Int64"}).iloc[run_[hit][new]]
        return rows.assign(start=start[new], end=np.maximum.reduceat(end, new) if len(new) else end)

    return groups.groupBy("bin").applyInPandas(run, "doc_id long, _rk long, start long, end long")


def merged(spans: list, length: int) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, b in sorted((s["start"], s["end"]) for s in spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, min(b, length)) for a, b in out]


def with_spans(docs: DataFrame, keep: str, window: int = WINDOW, words: int | None = None) -> DataFrame:
    """Every row of docs (doc_id, _rk, text and others) with the list of its repeated spans: of bytes, and of words (worded)."""
    texts = docs.select("doc_id", "_rk", "text")
    found = repeated_spans(texts, keep, bytes_shape(window)).withColumn("worded", F.lit(False))
    if words is not None:
        found = found.unionByName(repeated_spans(texts, keep, words_shape(words)).withColumn("worded", F.lit(True)))
    listed = found.groupBy("doc_id", "_rk").agg(F.collect_list(F.struct("start", "end", "worded")).alias("spans"))
    if found.count() <= BROADCAST_ROWS:  # texts are shuffled for more spans only
        listed = F.broadcast(listed)
    return docs.alias("d").join(listed.alias("s"), _same("d", "s"), "left").select("d.*", "spans")


def keyed(df: DataFrame) -> DataFrame:
    return df.withColumn("_rk", F.xxhash64("doc_id", "text"))


def in_bytes(spans: list, text: bytes) -> list[dict]:
    """Spans of one text, those of words as the bytes from their first word to the end of their last."""
    if not any(s["worded"] for s in spans):
        return spans
    _, start, end = next(spelled([text]))
    return [{"start": int(start[s["start"]]), "end": int(end[s["end"] - 1])} if s["worded"] else s for s in spans]


def dedup_texts(df: DataFrame, keep: str = "first", window: int = WINDOW, words: int | None = None) -> DataFrame:
    """The same rows with repeated passages of ``window`` bytes or more, and of ``words`` words or more, cut out of text, at
    whole characters."""
    # All columns travel in one struct, so none can clash with the operator's own.
    both = with_spans(keyed(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.struct(*df.columns).alias("_row"))), keep, window, words)

    @F.pandas_udf("string")
    def kept(texts: pd.Series, spans: pd.Series) -> pd.Series:
        out = []
        for value, text, own in zip(texts, as_bytes(texts), spans, strict=True):
            if own is None:
                out.append(value)
                continue
            parts, at = [], 0
            for a, b in merged(in_bytes(own, text), len(text)):
                while a < b and a < len(text) and text[a] & 0xC0 == 0x80:
                    a += 1
                while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
                    b -= 1
                parts.append(text[at:a])
                at = b
            parts.append(text[at:])
            out.append(b"".join(parts).decode("utf-8", "replace"))
        return pd.Series(out, dtype=object)

    text_batches(df.sparkSession)
    cut_text = F.when(F.col("spans").isNull(), F.col("text")).otherwise(kept("text", "spans"))
    return both.select(*[cut_text.alias("text") if c == "text" else F.col(f"_row.`{c}`") for c in df.columns])


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digests of each text without its repeated bytes; n_kept and text are what is left (without halves of characters)."""
    docs = keyed(table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    both = with_spans(docs, "none")

    def digest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for text, own in zip(as_bytes(batch["text"]), batch["spans"], strict=True):
                spans = [] if own is None else merged(own, len(text))
                at, kept = 0, []
                for a, b in spans:
                    kept.append(text[at:a])
                    at = b
                kept.append(text[at:])
                left = b"".join(kept)
                out.append((len(text), len(text) - len(left), len(spans), hashlib.sha256(left).hexdigest(), len(left), "".join(k.decode("utf-8", "ignore") for k in kept)))
            frame = pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "text"])
            frame.insert(0, "doc_id", batch["doc_id"].array)
            yield frame

    return both.select("doc_id", "text", "spans").mapInPandas(digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, text string")


#: Every window of every text by its digest; covered bytes as islands, kept bytes as the gaps between them.
ORACLE_OP5 = f"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, md5(b[i : i + {WINDOW - 1}]) AS h FROM d, LATERAL (SELECT unnest(range(1, octet_length(b) - {WINDOW - 2})) AS i) u),
r AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM w) x WHERE n > 1),
g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {WINDOW} THEN 0 ELSE 1 END AS new FROM r),
s AS (SELECT doc_id, min(i) AS a, max(i) + {WINDOW} AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g) x GROUP BY doc_id, k),
o AS (SELECT doc_id, list(a ORDER BY a) AS a, list(z ORDER BY a) AS z FROM s GROUP BY doc_id),
p AS (SELECT doc_id, b, a, z, list_transform(range(0, coalesce(len(a), 0) + 1), lambda k: hex(b[CASE WHEN k = 0 THEN 1 ELSE z[k] END : CASE WHEN k = coalesce(len(a), 0) THEN octet_length(b) ELSE a[k + 1] - 1 END])) AS kept FROM d LEFT JOIN o USING (doc_id))
SELECT doc_id, octet_length(b) AS n_bytes, octet_length(b) - len(array_to_string(kept, '')) // 2 AS n_removed, coalesce(len(a), 0) AS n_spans, sha256(unhex(array_to_string(kept, ''))) AS kept_sha256, len(array_to_string(kept, '')) // 2 AS n_kept,
 decode(unhex(array_to_string(list_transform(kept, lambda h: regexp_replace(regexp_replace(h, '^([89AB][0-9A-F])+', ''), '^((?:[0-9A-F]{{2}})*?)(?:[CD][0-9A-F]|E[0-9A-F](?:[89AB][0-9A-F])?|F[0-9A-F](?:[89AB][0-9A-F]){{0,2}})$', '\\1')), ''))) AS text FROM p
"""
