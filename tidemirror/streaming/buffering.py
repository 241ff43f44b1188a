"""Transactions of a stream whose rows mix, held back by Spark's state store until their commit.

Rows are kept in sorted pieces of bounded size. A micro-batch only adds pieces, so each row is written to the state once, over
however many batches its transaction goes; a piece's number and first position are one small entry of a list. With the commit
the pieces are merged in order of position, each read when its first row is due: a transaction that came in order needs one
piece in memory at a time, however large it is.

A call to the state costs much more than a row. So transactions are dealt into buckets, each a key of the state: what begins
and ends in one micro-batch never reaches the state, and one call tells which transactions of a bucket are open.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

OUT = "xid long, seq long, payload string, ack_lsn long, commit_us long"
#: Rows of a piece, and pieces of one micro-batch that wait in memory before they go to the state.
PIECE_ROWS, PIECES = 1_000, 64
#: Keys of the state over which transactions are dealt (without a timeout), and the bucket of rows without an xid.
BUCKETS, NO_XID = 1_024, -1
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
Piece = tuple[list[int], list[str | None]]


def cut(rows: pd.DataFrame) -> Iterator[Piece]:
    """A frame's rows in sorted pieces."""
    rows = rows.sort_values("seq", kind="stable")
    for i in range(0, len(rows), PIECE_ROWS):
        part = rows.iloc[i : i + PIECE_ROWS]
        yield [int(s) for s in part["seq"]], [None if pd.isna(p) else p for p in part["payload"]]


def merged(starts: list[tuple[int, int]], piece) -> Iterator[tuple[int, str | None]]:
    """The rows of sorted pieces in order of position. ``starts`` names (first position, number) of each, ``piece`` reads one
    when its first row is due."""
    due, heads = sorted(starts, reverse=True), []
    while due or heads:
        if due and (not heads or due[-1][0] <= heads[0][0]):
            _, number = due.pop()
            seqs, payloads = piece(number)
            heapq.heappush(heads, (seqs[0], number, 0, seqs, payloads))
            continue
        seq, number, at, seqs, payloads = heads[0]
        yield seq, payloads[at]
        if at + 1 < len(seqs):
            heapq.heapreplace(heads, (seqs[at + 1], number, at + 1, seqs, payloads))
        else:
            heapq.heappop(heads)


class OpenTransactions(StatefulProcessor):
    """One transaction, with timers: the key is its xid."""

    def __init__(self, wait_ms: int | None):
        self.wait_ms = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.starts = handle.getListState("starts", "first long, number long")
        self.pieces = handle.getMapState("pieces", "number long", "seqs array<long>, payloads array<string>")
        self.commit = handle.getValueState("commit", "ack_lsn long, commit_us long")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts = [(int(r[0]), int(r[1])) for r in self.starts.get()]
        known = self.commit.get() if self.wait_ms is not None and self.commit.exists() else None
        fresh: dict[int, Piece] = {}
        written, mark = len(starts), None if known is None else (int(known[0]), int(known[1]))
        for frame in rows:
            ends = frame[frame["is_commit"]]
            if len(ends) and mark is None:
                mark = int(ends["ack_lsn"].iloc[0]), int(ends["commit_us"].iloc[0])
            for piece in cut(frame[~frame["is_commit"]]):
                fresh[len(starts)] = piece
                starts.append((piece[0][0], len(starts)))
                if len(fresh) == PIECES:
                    written = self.keep(starts, written, fresh)
        if mark is None:
            self.keep(starts, written, fresh)
        else:
            yield from self.delivered(key[0], starts, fresh, mark)
            self.starts.clear()
            self.pieces.clear()
            if self.wait_ms is not None:
                self.commit.update(mark)
        if self.wait_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def keep(self, starts: list[tuple[int, int]], written: int, fresh: dict[int, Piece]) -> int:
        """Write the pieces that are new; how many there are now."""
        for number, piece in fresh.items():
            self.pieces.updateValue((number,), piece)
        if written < len(starts):
            self.starts.appendList(starts[written:])
        fresh.clear()
        return len(starts)

    def delivered(self, xid: int, starts: list[tuple[int, int]], fresh: dict[int, Piece], mark: tuple[int, int]) -> Iterator[pd.DataFrame]:
        def piece(number: int) -> Piece:
            own = fresh.get(number)
            return tuple(self.pieces.getValue((number,))) if own is None else own

        def frame() -> pd.DataFrame:
            return pd.DataFrame({"xid": xid, "seq": seqs, "payload": payloads, "ack_lsn": mark[0], "commit_us": mark[1]})

        seqs, payloads = [], []
        for seq, payload in merged(starts, piece):
            seqs.append(seq)
            payloads.append(payload)
            if len(seqs) == PIECE_ROWS:
                yield frame()
                seqs, payloads = [], []
        if seqs:
            yield frame()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        for state in (self.starts, self.pieces, self.commit):
            state.clear()
        return iter(())

    def close(self) -> None:
        pass


class OpenBuckets(StatefulProcessor):
    """The transactions of a bucket. ``open`` holds the first positions of the stored pieces of each that is open."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getMapState("open", "xid long", "firsts array<long>")
        self.pieces = handle.getMapState("pieces", "xid long, number long", "seqs array<long>, payloads array<string>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts = {int(x[0]): [int(s) for s in v[0]] for x, v in self.open.iterator()}
        marks: dict[int, tuple[int, int]] = {}
        held, n = [], 0
        for frame in rows:
            if key[0] == NO_XID:
                frame = frame.assign(xid=0)
            ends = frame[frame["is_commit"]]
            for xid, ack, us in zip(ends["xid"].tolist(), ends["ack_lsn"].tolist(), ends["commit_us"].tolist(), strict=True):
                marks.setdefault(int(xid), (int(ack), int(us)))
            held.append(frame.loc[~frame["is_commit"], ["xid", "seq", "payload"]])
            n += len(held[-1])
            if n >= PIECES * PIECE_ROWS:
                self.keep(pd.concat(held), starts)
                held, n = [], 0
        if n:
            fresh = pd.concat(held)
            closed = fresh["xid"].isin(list(marks.keys() - starts.keys()))
            self.keep(fresh[~closed], starts)
            own = fresh[closed].sort_values(["xid", "seq"], kind="stable")
            for i in range(0, len(own), PIECE_ROWS):
                part = own.iloc[i : i + PIECE_ROWS]
                yield self.frame(key, part["xid"].tolist(), part["seq"].tolist(), part["payload"].tolist(), [marks[x] for x in part["xid"].tolist()])
        for xid in sorted(marks.keys() & starts.keys()):
            yield from self.stored(key, xid, starts[xid], marks[xid])
            for number in range(len(starts[xid])):
                self.pieces.removeKey((xid, number))
            self.open.removeKey((xid,))

    def keep(self, rows: pd.DataFrame, starts: dict[int, list[int]]) -> None:
        """Store rows as pieces of their transactions."""
        for xid, own in rows.groupby("xid", sort=False):
            firsts = starts.setdefault(int(xid), [])
            for piece in cut(own):
                self.pieces.updateValue((int(xid), len(firsts)), piece)
                firsts.append(piece[0][0])
            self.open.updateValue((int(xid),), (firsts,))

    def stored(self, key: tuple, xid: int, firsts: list[int], mark: tuple[int, int]) -> Iterator[pd.DataFrame]:
        seqs, payloads = [], []
        for seq, payload in merged([(s, i) for i, s in enumerate(firsts)], lambda number: tuple(self.pieces.getValue((xid, number)))):
            seqs.append(seq)
            payloads.append(payload)
            if len(seqs) == PIECE_ROWS:
                yield self.frame(key, [xid] * len(seqs), seqs, payloads, [mark] * len(seqs))
                seqs, payloads = [], []
        if seqs:
            yield self.frame(key, [xid] * len(seqs), seqs, payloads, [mark] * len(seqs))

    def frame(self, key: tuple, xids: list[int], seqs: list[int], payloads: list, marks: list[tuple[int, int]]) -> pd.DataFrame:
        xid = pd.array([None] * len(xids) if key[0] == NO_XID else xids, "Int64")
        return pd.DataFrame({"xid": xid, "seq": seqs, "payload": [None if pd.isna(p) else p for p in payloads], "ack_lsn": [m[0] for m in marks], "commit_us": [m[1] for m in marks]})

    def close(self) -> None:
        pass


def buffer_transactions(messages: DataFrame, timeout: str | None = None) -> DataFrame:
    """Rows (xid, seq, payload, is_commit, ack_lsn, commit_us) of a stream whose transactions mix, held back by xid until their
    commit and then given in order of seq. A transaction's state goes with its commit; rows must not come in a later
    micro-batch than their commit. Payloads may be null, a transaction without rows gives none, a second commit changes nothing.

    With a timeout, state is kept that long after the last row: late rows of a committed transaction pass at once in that time,
    and transactions that never commit are forgotten (under a continuous trigger only: Spark goes on making batches).
    """
    messages.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    # Nulls would make pandas read positions as floats.
    whole = {c: F.when(~F.col("is_commit"), F.coalesce(c, F.lit(0))).otherwise(F.col(c)).cast("long") for c in ("ack_lsn", "commit_us")}
    messages = messages.withColumns(whole)
    if timeout is None:
        bucket = F.when(F.col("xid").isNull(), NO_XID).otherwise(F.pmod(F.xxhash64("xid"), F.lit(BUCKETS)).cast("int"))
        return messages.withColumn("_bucket", bucket).groupBy("_bucket").transformWithStateInPandas(OpenBuckets(), OUT, "Append", "None")
    wait = int(pd.Timedelta(timeout).total_seconds() * 1000)
    return messages.groupBy("xid").transformWithStateInPandas(OpenTransactions(wait), OUT, "Append", "ProcessingTime")
