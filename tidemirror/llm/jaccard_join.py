"""N-gram Jaccard join with count-vector R-trees.

A text's set holds its distinct word shingles as 64-bit hashes; equal sets are one node. The hashes are put into groups, and
the group counts of a node are a point: two sets share at most the sum of their points' coordinate minima. A coarse point
(``COARSE`` groups) and a fine one (``FINE`` groups) are kept as one byte a group, with what exceeds a byte summed apart.

Nodes meet in blocks: a pair that reaches the threshold shares one of the rarest shingles of both (rarest first, as many
as may differ and one more; rarity comes from a count sketch of fixed size over all texts, which is the same order
everywhere). A block is a shingle. Then

1. to start with, each node is held against one other node: every block names its node of most blocks, and a node takes the
   one that most of its blocks name. So a group of near copies, however large, is linked by one comparison a member;
2. blocks whose nodes are one component by then are done. The nodes of all others go into R-trees over the coarse points, and
   each is searched for among the nodes of other components; a branch is left when the minima of its upper corner can't reach
   the overlap that is needed. Nodes that find no partner drop out, the others go into R-trees over the fine points, which
   give the candidate pairs: at first only the best-bounded one for each node and other component, and when those links have
   joined components, all that are still apart and untried. Large blocks are cut into pieces that meet each other, so none
   is capped, and no block's pairs inside a component are ever made.

Candidate pairs are verified on their sets; a node that many pairs name sends its set once for each lot of pairs. Links
join components; every text gets its component's smallest doc_id.

Defined results: a text that is null, empty or without a word has the empty set and is linked with nothing; with fewer
words than a shingle the whole sequence is the one shingle; rows with equal sets are one node, repeated rows therefore in
one component; rows without doc_id take part but name no component (null if a component has no id); an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Stored, as_bytes, blocks, forget, join_hot, mix, rows_of, small, span_hashes, stored, stored_components, table, text_batches, word_table, words_of

SHINGLE, PERCENT = 4, 85
COARSE, FINE = 32, 256
SKETCH_BITS, SKETCH_PARTS = 18, 16
#: Nodes of a block that are compared in one task; nodes of other components among them.
BLOCK_NODES, GUESTS = 512, 2_048
LEAF = 16
#: Rows of tree nodes, and pairs to verify, that one group of a task holds.
BIN_ROWS, BIN_PAIRS = 20_000, 1_000
#: Nodes whose repeated rows a task leaves out, remembered at once.
SEEN = 200_000
#: Pairs of points compared at once.
CHUNK = 1 << 11
_WORD = word_table(b" \t\n\x0b\x0c\r")
_ODD = np.random.default_rng(9090).integers(1, 1 << 62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: list[str | None], k: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """Index of the first text of a block, and each text's sorted distinct shingle hashes."""
    lowered = [t.lower() for t in as_bytes(texts)]  # bytes: A-Z only
    for first, group in blocks(lowered):
        buf, start, end, owner = words_of(group, _WORD)
        h = span_hashes(buf, start, end)
        at = np.searchsorted(owner, np.arange(len(group) + 1))
        n = max(0, len(h) - k + 1)
        s = np.zeros(n, np.uint64)
        for j in range(k):
            s += h[j : n + j] * _ODD[j]
        s = mix(s)
        out = []
        for i in range(len(group)):
            a, b = int(at[i]), int(at[i + 1])
            if b - a >= k:
                out.append(np.unique(s[a : b - k + 1]))
            elif b > a:
                out.append(mix((h[a:b] * _ODD[8 : 8 + b - a]).sum(keepdims=True) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
        yield first, out


def set_hash(s: np.ndarray) -> int:
    if not len(s):
        return 0
    return int(mix(mix(s * _ODD[20]).sum(keepdims=True, dtype=np.uint64) + np.uint64(len(s))).view(np.int64)[0])


def point(s: np.ndarray, groups: int) -> bytes:
    """Group counts, a byte each, and the sum of what exceeds a byte (8 bytes). Groups of fewer are sums of these."""
    counts = np.bincount((s & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    return np.minimum(counts, 255).astype(np.uint8).tobytes() + int(np.maximum(counts - 255, 0).sum()).to_bytes(8, "little")


def matrix(points) -> np.ndarray:
    """Points as rows of int32: the minima of two rows sum up to a bound on the overlap."""
    raw = np.frombuffer(b"".join(points), np.uint8).reshape(len(points), -1)
    out = np.empty((len(raw), raw.shape[1] - 7), np.int32)
    out[:, :-1] = raw[:, :-8]
    out[:, -1:] = np.ascontiguousarray(raw[:, -8:]).view(np.int64)
    return out


def shared_at_most(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.minimum(a, b).sum(axis=1)


def slots(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def needed(a, b, percent: int):
    """The least overlap of sets of a and b elements: 100 * overlap >= percent * union."""
    return -(-percent * (a + b) // (100 + percent))


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """A row for each text (n, node, coarse and fine point), and each task's part of the count sketch (part, counts)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        names = ["doc_id", "_rk", "n", "node", "coarse", "fine", "part", "counts"]
        for batch in batches:
            rows = []
            ids, keys = batch["doc_id"].astype("Int64").tolist(), batch["_rk"].tolist()
            for first, sets in shingle_sets(list(batch["text"]), k):
                sketch += np.bincount(slots(np.concatenate(sets)), minlength=1 << SKETCH_BITS)
                rows.extend((ids[first + i], keys[first + i], len(s), set_hash(s), point(s, COARSE), point(s, FINE), None, None) for i, s in enumerate(sets))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "part": "Int64"})
        size = (1 << SKETCH_BITS) // SKETCH_PARTS
        parts = [(None, None, None, None, None, None, i, sketch[i * size : (i + 1) * size].astype(np.int32).tobytes()) for i in range(SKETCH_PARTS)]
        yield pd.DataFrame(parts, columns=names).astype({c: "Int64" for c in (*names[:4], "part")})

    return docs.mapInPandas(run, "doc_id long, _rk long, n long, node long, coarse binary, fine binary, part long, counts binary")


def sketch_of(profile: DataFrame) -> np.ndarray:
    """The sum of all tasks' sketches. Of fixed size."""

    def add(kind: type):
        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(x, kind).astype(np.int64) for x in pdf["counts"])
            return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [total.tobytes()]})

        return run

    parts = profile.where("part IS NOT NULL").select("part", "counts", (F.rand(3) * 64).cast("int").alias("salt"))
    some = parts.groupBy("part", "salt").applyInPandas(add(np.int32), "part long, counts binary")
    rows = some.groupBy("part").applyInPandas(add(np.int64), "part long, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.int64) for r in sorted(rows, key=lambda r: r["part"])]) if rows else np.zeros(1 << SKETCH_BITS, np.int64)


def block_keys(docs: DataFrame, sketch: np.ndarray, k: int, percent: int) -> DataFrame:
    """(key, node) for the rarest shingles of every text. Repeated rows may be left out."""
    shared = docs.sparkSession.sparkContext.broadcast(sketch)  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, seen = shared.value, set()
        for batch in batches:
            keys, nodes, sizes = [], [], []
            for _, sets in shingle_sets(list(batch["text"]), k):
                for s in sets:
                    node = set_hash(s)
                    if len(s) and node not in seen:  # copies in one task give their keys once
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add(node)
                        # A partner shares at least this many, so one of the others and one more.
                        prefix = len(s) - -(-percent * len(s) // 100) + 1
                        rare = s[np.lexsort((s, counts[slots(s)]))[:prefix]] if prefix < len(s) else s
                        keys.append(rare.view(np.int64))
                        nodes.append(node)
                        sizes.append(len(rare))
            if keys:
                yield pd.DataFrame({"key": np.concatenate(keys), "node": np.repeat(np.array(nodes, np.int64), sizes)})

    return docs.mapInPandas(run, "key long, node long")


# ---------------------------------------------------------------- R-tree over points


class CountTree:
    """An R-tree over group counts, packed by halving along the widest coordinate. Boxes keep their upper corner and the
    smallest set size; the lower corner is of no use for an upper bound."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        self.order = self._pack(points)
        self.points, self.sizes = points[self.order], sizes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        upper, least = self.points, self.sizes
        while len(upper) > 1:
            at = np.arange(0, len(upper), LEAF)
            upper, least = np.maximum.reduceat(upper, at, axis=0), np.minimum.reduceat(least, at)
            self.levels.append((upper, least))

    @staticmethod
    def _pack(points: np.ndarray) -> np.ndarray:
        out, todo = [], [np.arange(len(points))]
        while todo:
            own = todo.pop()
            if len(own) <= LEAF:
                out.append(own)
                continue
            spread = points[own].max(axis=0) - points[own].min(axis=0)
            own = own[np.argsort(points[own, int(spread.argmax())], kind="stable")]
            half = len(own) // 2 // LEAF * LEAF or LEAF
            todo.extend((own[half:], own[:half]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, entry) pairs whose bound reaches the overlap they need."""
        q, node = np.arange(len(points)), np.zeros(len(points), np.int64)
        for upper, least in [*self.levels[::-1], (self.points, self.sizes)]:
            if not (len(upper) == 1 and upper is not self.points):  # the root needs no test
                node_ok = node < len(upper)
                q, node = q[node_ok], node[node_ok]
                keep = np.zeros(len(q), bool)
                for i in range(0, len(q), CHUNK):
                    a, b = q[i : i + CHUNK], node[i : i + CHUNK]
                    keep[i : i + CHUNK] = shared_at_most(points[a], upper[b]) >= needed(sizes[a], np.maximum(least[b], -(-percent * sizes[a] // 100)), percent)
                q, node = q[keep], node[keep]
            if upper is self.points:
                return q, self.order[node]
            node = (node[:, None] * LEAF + np.arange(LEAF)).ravel()
            q = np.repeat(q, LEAF)
        return q, node


# ---------------------------------------------------------------- comparisons


def bounded(pairs: DataFrame, points: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose fine points leave room for the overlap they need."""

    def room(pa: pd.Series, na: pd.Series, pb: pd.Series, nb: pd.Series) -> pd.Series:
        return pd.Series(shared_at_most(matrix(pa), matrix(pb)) >= needed(na.to_numpy(), nb.to_numpy(), percent) if len(pa) else np.zeros(0, bool))

    def of(c: str) -> DataFrame:
        return points.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("fine").alias(f"p{c}"))

    both = join_hot(pairs.join(of("a"), "a"), of("b"), "b", like=pairs)
    sizes = F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb")
    return both.where(sizes).where(F.pandas_udf(room, "boolean")("pa", "na", "pb", "nb")).select("a", "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the threshold. Pairs of one b share its set, in lots of about BIN_PAIRS pairs."""
    lots = max(1, rows_of(pairs) // BIN_PAIRS)
    dealt = pairs.withColumn("lot", F.pmod(F.xxhash64("a"), F.lit(lots)))
    left = dealt.join(sets.select(F.col("node").alias("a"), "s"), "a").withColumn("hub", F.lit(False))
    right = join_hot(dealt.select("b", "lot").distinct(), sets.select(F.col("node").alias("b"), "s"), "b").withColumn("a", F.col("b")).withColumn("hub", F.lit(True))
    together = left.unionByName(right).withColumn("bin", F.pmod(F.xxhash64("b", "lot"), F.lit(lots)))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        hub = pdf["hub"]
        held = {b: np.frombuffer(s, np.uint64) for b, s in zip(pdf["b"][hub], pdf["s"][hub], strict=True)}
        out = []
        for a, b, s in zip(pdf["a"][~hub], pdf["b"][~hub], pdf["s"][~hub], strict=True):
            x, y = np.frombuffer(s, np.uint64), held[b]
            if len(np.intersect1d(x, y, assume_unique=True)) >= needed(len(x), len(y), percent):
                out.append((a, b))
        return pd.DataFrame(out, columns=["a", "b"], dtype="int64")

    return together.groupBy("bin").applyInPandas(run, "a long, b long")


def fetch(docs: DataFrame, reps: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """(node, s): the sets of nodes, from the text of one of their rows each."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            nodes_ = batch["node"].tolist()
            out = []
            for first, sets in shingle_sets(list(batch["text"]), k):
                out.extend((nodes_[first + i], s.tobytes()) for i, s in enumerate(sets))
            yield pd.DataFrame(out, columns=["node", "s"])

    same = F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d._rk") == F.col("w._rk"))
    texts = docs.alias("d").join(small(nodes.join(reps.select("node", "doc_id", "_rk"), "node")).alias("w"), same).select("node", "text")
    return texts.mapInPandas(run, "node long, s binary").dropDuplicates(["node"])


def mixed_blocks(keys: DataFrame, labels: DataFrame) -> DataFrame:
    """key, node, label, and the block's numbers (m: nodes, main: largest component, g: nodes of others) in blocks that hold
    nodes of several components."""
    named = keys.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    kinds = named.groupBy("key", "label").agg(F.count("*").alias("c"))
    blocks_ = kinds.groupBy("key").agg(F.sum("c").alias("m"), F.count("*").alias("kinds"), F.max(F.struct("c", "label")).alias("top")).where("kinds > 1")
    return join_hot(named, blocks_.select("key", "m", F.col("top.label").alias("main"), (F.col("m") - F.col("top.c")).alias("g")), "key", like=keys)


def searched(mixed: DataFrame, points: DataFrame, percent: int, rows: int, pick: str) -> DataFrame:
    """R-trees over the points (node, n, p) of mixed blocks, each node searched for among nodes of other components. ``nodes``
    gives (key, node) with a partner; ``pairs`` gives (a, b), ``best`` only each node's best-bounded one in every other
    component."""
    pieces, lots = F.ceil(F.col("m") / BLOCK_NODES).cast("int"), F.ceil(F.col("g") / GUESTS).cast("int")
    h, guest = F.xxhash64("node"), F.col("label") != F.col("main")
    # Each node is at home in one piece, which is repeated for every lot of guests; guests visit every piece.
    home = F.transform(F.sequence(F.lit(0), lots - 1), lambda i: F.struct(F.pmod(h, pieces).cast("int").alias("piece"), i.alias("lot"), F.lit(False).alias("visits")))
    visit = F.transform(F.sequence(F.lit(0), pieces - 1), lambda i: F.struct(i.alias("piece"), F.pmod(h, lots).cast("int").alias("lot"), F.lit(True).alias("visits")))
    placed = mixed.join(points, "node").select("key", "node", "label", "n", "p", F.explode(F.when(guest, F.concat(home, visit)).otherwise(home)).alias("at")).select("key", "node", "label", "n", "p", "at.*")
    bins = max(1, rows // BIN_ROWS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["key", "piece", "lot", "visits"], kind="stable")
        points_ = matrix(pdf["p"])
        n, label, node, visits, key = (pdf[c].to_numpy() for c in ("n", "label", "node", "visits", "key"))
        place = pdf[["key", "piece", "lot"]].to_numpy()
        begin = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]).any(axis=1))))
        size = np.diff(np.concatenate((begin, [len(pdf)])))
        guests = np.add.reduceat(visits.astype(np.int64), begin)
        homes = size - guests
        # Trees of one leaf have no branch to leave: all their entries at once.
        leaf = homes <= LEAF
        times = np.where(leaf, guests, 0)
        q = np.repeat(begin + homes, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
        per = np.repeat(homes, times)
        e = np.repeat(np.repeat(begin, times), per) + np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        q = np.repeat(q, per)
        found = []
        for i in range(0, len(q), CHUNK):
            x, y = q[i : i + CHUNK], e[i : i + CHUNK]
            ok = shared_at_most(points_[x], points_[y]) >= needed(n[x], n[y], percent)
            found.append((x[ok], y[ok]))
        for at, h_, g in zip(begin[~leaf], homes[~leaf], guests[~leaf], strict=True):
            if g:
                i, j = CountTree(points_[at : at + h_], n[at : at + h_]).search(points_[at + h_ : at + h_ + g], n[at + h_ : at + h_ + g], percent)
                found.append((at + h_ + i, at + j))
        x, y = (np.concatenate(z) for z in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        other = label[x] != label[y]
        x, y = x[other], y[other]
        if pick == "nodes":
            at = np.unique(np.concatenate([x, y]))
            return pd.DataFrame({"key": key[at], "node": node[at]}).drop_duplicates()
        if pick == "best" and len(x):
            near = np.concatenate([shared_at_most(points_[x[i : i + CHUNK]], points_[y[i : i + CHUNK]]) for i in range(0, len(x), CHUNK)]) / (n[x] + n[y])
            order = np.lexsort((node[y], -near, label[y], x))
            x, y = x[order], y[order]
            top = np.concatenate(([True], (x[1:] != x[:-1]) | (label[y[1:]] != label[y[:-1]])))
            x, y = x[top], y[top]
        return pd.DataFrame({"a": np.maximum(node[x], node[y]), "b": np.minimum(node[x], node[y])}).drop_duplicates()

    out = "key long, node long" if pick == "nodes" else "a long, b long"
    return placed.withColumn("bin", F.pmod(F.xxhash64("key", "piece", "lot"), F.lit(bins))).groupBy("bin").applyInPandas(run, out).distinct()


def shared_keys(keys: DataFrame, work: Scratch) -> DataFrame:
    """(key, node), once each, of the keys that two different nodes have."""
    ends = work.keep(keys.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("_n")).where("lo <> hi").select("key", "_n"))
    return work.keep(join_hot(keys, ends.select("key"), "key", counts=ends).distinct())


def first_pairs(shared: DataFrame, work: Scratch) -> DataFrame:
    """(a, b): of every node, the node that most of its blocks name; a block names its node of most blocks."""
    busy = shared.groupBy("node").agg(F.count("*").alias("blocks"))
    weighed = shared.join(busy, "node")
    hubs = work.keep(weighed.groupBy("key").agg(F.max(F.struct("blocks", "node"))["node"].alias("hub")))
    votes = join_hot(shared, hubs, "key").where("node <> hub").groupBy("node", "hub").agg(F.count("*").alias("v"))
    return votes.groupBy("node").agg(F.max(F.struct("v", "hub"))["hub"].alias("b")).select(F.col("node").alias("a"), "b")


def named_rows(rows: DataFrame, reps: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, _rk, n_shingles, label, component_id of every row (doc_id, _rk, n, node), given the nodes' components."""
    named = reps.join(labels, "node", "left").select("node", F.coalesce("label", "node").alias("label"), "doc_id")
    ids = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    by_node = named.join(ids, "label").select("node", "label", "component_id")
    out = join_hot(rows, by_node, "node", "left")
    return out.select("doc_id", "_rk", F.col("n").alias("n_shingles"), "label", F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def labelled(df: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> Stored:
    """doc_id, _rk, n_shingles, label (a node of the component) and component_id of every row of df (doc_id, text)."""
    text_batches(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_rk", F.xxhash64("doc_id", "text"))
    with Scratch() as work:
        profile = work.keep(profiles(docs, k))
        rows = profile.where("part IS NULL").select("doc_id", "_rk", "n", "node")
        one = F.struct(F.col("doc_id").isNull().alias("_"), "doc_id", "_rk", "n", "coarse", "fine")
        reps = work.keep(profile.where("n > 0").groupBy("node").agg(F.min(one).alias("r")).select("node", "r.*").drop("_"))
        keys = work.keep(block_keys(docs, sketch_of(profile), k, percent))
        shared = shared_keys(keys, work)
        work.drop(keys)
        links, tried, labels = [], [], None

        def test(pairs: DataFrame) -> None:
            nonlocal labels
            nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
            sets = work.keep(fetch(docs, reps, nodes, k))
            links.append(work.keep(verified(pairs, sets, percent)))
            work.drop(sets)
            tried.append(pairs)
            known = links[0]
            for more in links[1:]:
                known = known.unionByName(more)
            after = stored_components(known)
            work.tables[id(after.df)] = after
            labels = after.df

        test(work.keep(bounded(first_pairs(shared, work), reps, percent)))
        coarse, fine = (reps.select("node", "n", F.col(c).alias("p")) for c in ("coarse", "fine"))
        mixed = work.keep(mixed_blocks(shared, labels))
        left = work.keep(searched(mixed, coarse, percent, rows_of(mixed), "nodes"))
        work.drop(mixed)
        for pick in ("best", "pairs"):
            pairs = searched(mixed_blocks(left, labels), fine, percent, rows_of(left), pick)
            for known in tried:
                pairs = pairs.join(known.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), ["a", "b"], "left_anti")
            pairs = work.keep(pairs)
            if rows_of(pairs):  # best ones may all be tried, others not
                test(pairs)
        return stored(named_rows(rows, reps, labels))


def join_components(df: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, _rk, n_shingles, component_id of every row of df (doc_id, text)."""
    return labelled(df, k, percent).df.drop("label")


def one_of_each(df: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """One row of each component: that of the smallest doc_id (no id comes last; of equal ids the smaller text hash); repeated
    rows of it once. Texts without a word all stay, repeated rows of them once. Only ids are shuffled, not texts."""
    found = labelled(df, k, percent)
    order = F.struct(F.col("doc_id").isNull().alias("_"), "doc_id", "_rk")
    ids = found.df.groupBy("doc_id", "_rk").agg(F.first("n_shingles").alias("n"), F.first("label").alias("label"), F.count("*").alias("times"))
    stay = ids.where("n > 0").groupBy("label").agg(F.min(order).alias("r")).select("label", F.col("r._rk").alias("_best"), F.col("r.doc_id").alias("_id"))
    # A component is a hot key where a third of all rows are copies, but what it is joined to is one row.
    judged = join_hot(ids.where("n > 0"), stay, "label", like=found.df.where("n_shingles > 0"))
    gone = judged.where(~(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_rk") == F.col("_best")))).select("doc_id", "_rk").withColumn("times", F.lit(0))
    kept = judged.where("times > 1").where(F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_rk") == F.col("_best"))).select("doc_id", "_rk").unionByName(ids.where("n = 0 AND times > 1").select("doc_id", "_rk")).withColumn("times", F.lit(2))
    marks = stored(gone.unionByName(kept)).df
    found.drop()
    # All columns travel in one struct, so none can clash with the operator's own.
    key = F.xxhash64(F.col("doc_id").cast("long"), F.col("text"))
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), key.alias("_rk"), F.struct(*df.columns).alias("_row")).alias("d")
    marked = rows.join(small(marks).alias("m"), F.col("d.doc_id").eqNullSafe(F.col("m.doc_id")) & (F.col("d._rk") == F.col("m._rk")), "left").select("d.*", "times")
    once = marked.where("times = 2").dropDuplicates(["doc_id", "_rk"])
    return marked.where("times IS NULL").unionByName(once).select("_row.*")


def op7_jaccard_rtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_components(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_shingles", "component_id")


ORACLE_OP7 = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w) u),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(node, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT ways.b, r.root FROM r JOIN ways ON ways.a = r.node)
SELECT r.node AS doc_id, coalesce(max(n.n), 0) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.node GROUP BY 1
"""
