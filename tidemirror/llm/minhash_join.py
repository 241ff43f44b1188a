"""MinHash near-dedup by an inverted join of signature coordinates.

A text's set holds its distinct word shingles; equal sets are one node. A node's signature has ``COORDINATES`` least hashes.
Sets of a similarity of 0.85 agree in more than ``MATCHES`` of 64 coordinates but for about 3 pairs in 10^10, so pairs with at
least that many matches are retained and then confirmed on their full sets.

Each node is posted under coordinate-value pairs. By prefix filtering 64 - MATCHES + 1 of them are enough: two nodes that match
in MATCHES coordinates share one of the rarest of both. Rarest first means in the order of a count sketch of fixed size over
all texts, which is the same everywhere, so lists that everything is in are skipped by all nodes that have rarer ones. Then

1. collisions are counted: every list names its node of most lists, and a node is held against the one node that most of its
   lists name, so a group of near copies, however large, is linked by one comparison a member;
2. lists whose nodes are one component by then are done. In the others all nodes of different components meet; long lists are
   cut into pieces that meet each other. Matches are counted over half of the coordinates first, and pairs that can't reach the
   threshold any more are skipped. A pair belongs to the list of its first common posting alone, so it is looked at once. Only
   the nodes that have such a pair go on, with their sets;
3. those pairs are confirmed where they meet, the most matches first, and pairs that earlier links have joined are passed over;
   so a task gives fewer links than it has nodes.

Links join components; every text gets its component's smallest doc_id.

Defined results: a text that is null, empty or without a word has the empty set and is linked with nothing; with fewer words
than a shingle the whole sequence is the one shingle; rows with equal sets are one node, repeated rows therefore in one
component; rows without doc_id take part but name no component (null if a component has no id; such a row is kept); rows that
share the component's id are all kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, Stored, join_hot, mix, rows_of, stored, stored_components, table, text_batches
from .jaccard_join import ORACLE_OP7, SKETCH_BITS, SKETCH_PARTS, fetch, first_pairs, mixed_blocks, named_rows, needed, set_hash, shared_keys, shingle_sets, sketch_of, slots, verified

SHINGLE, PERCENT = 3, 85
COORDINATES, MATCHES = 64, 34
PREFIX = COORDINATES - MATCHES + 1
#: Coordinates that are compared first.
HALF = COORDINATES // 2
#: Nodes of a list that are compared in one task, nodes of other components among them; rows that one group of a task holds.
LIST_NODES, GUESTS, BIN_ROWS = 1_024, 1_024, 10_000
#: Shingles of a list's sets that are compared in one task.
LIST_SHINGLES = 1 << 20
_RNG = np.random.default_rng(1212)
_XOR = _RNG.integers(0, 1 << 63, COORDINATES, dtype=np.uint64)
_MUL = _RNG.integers(1, 1 << 62, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = np.arange(COORDINATES, dtype=np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """A row of least hashes for each set; zeros for empty ones."""
    out = np.zeros((len(sets), COORDINATES), np.uint64)
    full = [i for i, s in enumerate(sets) if len(s)]
    if full:
        x = np.concatenate([sets[i] for i in full])
        sizes = np.array([len(sets[i]) for i in full])
        begin = np.cumsum(sizes) - sizes
        for c in range(COORDINATES):
            out[full, c] = np.minimum.reduceat((x ^ _XOR[c]) * _MUL[c], begin)
    return out


def matrix(rows) -> np.ndarray:
    """Signatures of 32 bits a coordinate, which match where the whole ones do."""
    return np.frombuffer(b"".join(rows), np.uint32).reshape(len(rows), COORDINATES)


def bits(first: np.ndarray) -> np.ndarray:
    return np.unpackbits(np.ascontiguousarray(first, np.int64)[:, None].view(np.uint8), axis=1, bitorder="little").astype(bool)


def postings(sig: np.ndarray) -> np.ndarray:
    """A key for each coordinate-value pair; its last bits are the coordinate."""
    return (mix(sig + (_PLACE + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(COORDINATES - 1)) | _PLACE


def prefixes(sig: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The keys of each row, and which are its rarest PREFIX ones."""
    keys = postings(sig)
    rare = np.lexsort((keys, counts[slots(keys)]), axis=1)[:, :PREFIX]
    own = np.zeros(keys.shape, bool)
    np.put_along_axis(own, rare, True, axis=1)
    return keys, own


def profiles(docs: DataFrame, k: int) -> DataFrame:
    """A row for each text (n, node, sig), and each task's part of the count sketch (part, counts)."""
    names = ["doc_id", "_rk", "n", "node", "sig", "part", "counts"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sketch = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            rows = []
            ids, keys = batch["doc_id"].astype("Int64").tolist(), batch["_rk"].tolist()
            for first, sets in shingle_sets(list(batch["text"]), k):
                sig = signatures(sets)
                full = np.array([len(s) > 0 for s in sets], bool)
                sketch += np.bincount(slots(postings(sig[full]).ravel()), minlength=1 << SKETCH_BITS)
                rows.extend((ids[first + i], keys[first + i], len(s), set_hash(s), sig[i].tobytes(), None, None) for i, s in enumerate(sets))
            yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64", "part": "Int64"})
        size = (1 << SKETCH_BITS) // SKETCH_PARTS
        parts = [(None, None, None, None, None, i, sketch[i * size : (i + 1) * size].astype(np.int32).tobytes()) for i in range(SKETCH_PARTS)]
        yield pd.DataFrame(parts, columns=names).astype({c: "Int64" for c in (*names[:4], "part")})

    return docs.mapInPandas(run, "doc_id long, _rk long, n long, node long, sig binary, part long, counts binary")


def posted(reps: DataFrame, sketch: np.ndarray) -> DataFrame:
    """node, n, short (the signature by 32 bits a coordinate), first (a bit for each of its rarest postings), keys (those)."""
    shared = reps.sparkSession.sparkContext.broadcast(sketch)  # of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                sig = np.frombuffer(b"".join(batch["sig"]), np.uint64).reshape(len(batch), COORDINATES)
                keys, own = prefixes(sig, shared.value)
                short = [s.tobytes() for s in (sig >> np.uint64(20)).astype(np.uint32)]
                first = np.packbits(own, axis=1, bitorder="little").view(np.int64)[:, 0]
                yield batch[["node", "n"]].assign(short=short, first=first, keys=list(keys[own].view(np.int64).reshape(len(batch), PREFIX)))

    return reps.select("node", "n", "sig").mapInPandas(run, "node long, n long, short binary, first long, keys array<bigint>")


def matching(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs (a, b) with enough matches."""

    def enough(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series((matrix(x) == matrix(y)).sum(axis=1) >= MATCHES if len(x) else np.zeros(0, bool))

    of = lambda c: nodes.select(F.col("node").alias(c), F.col("short").alias(f"s{c}"))
    both = join_hot(pairs.join(of("a"), "a"), of("b"), "b", like=pairs)
    return both.where(F.pandas_udf(enough, "boolean")("sa", "sb")).select("a", "b")


def met(key: int, sig: np.ndarray, own: np.ndarray, label: np.ndarray, homes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(guest, home, matches) of the pairs of a list that have enough matches, different labels, and their first common posting
    here. The first ``homes`` rows are at home, the others are guests."""
    place = key & (COORDINATES - 1)
    half = np.ascontiguousarray(sig[:, :HALF])
    found = []
    for g in range(homes, len(sig)):
        at = np.flatnonzero(label[:homes] != label[g])
        # What is left can bring COORDINATES - HALF more.
        at = at[(half[at] == half[g]).sum(axis=1) >= MATCHES - (COORDINATES - HALF)]
        same = sig[at] == sig[g]
        n = same.sum(axis=1)
        both = same & own[at] & own[g]
        keep = (n >= MATCHES) & (both.argmax(axis=1) == place) & both[:, place]
        found.append((np.full(int(keep.sum()), g), at[keep], n[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 3


def dealt(mixed: DataFrame, weight: str, home: int, guests: int) -> DataFrame:
    """Nodes of mixed lists in pieces and lots: each node is at home in one piece, which is repeated for every lot of guests;
    nodes outside of the list's main component visit every piece in their lot. Pieces and lots are of about ``home`` and
    ``guests`` in weight."""
    total = mixed.groupBy("key").agg(F.sum(weight).alias("_w"), F.sum(F.when(F.col("label") != F.col("main"), F.col(weight)).otherwise(0)).alias("_g"), F.count("*").alias("_n"))
    parts = join_hot(mixed, total.select("key", F.greatest(F.ceil(F.col("_w") / home), F.lit(1)).cast("int").alias("_pieces"), F.greatest(F.ceil(F.col("_g") / guests), F.lit(1)).cast("int").alias("_lots")), "key", like=mixed)
    h = F.xxhash64("node")
    stays = F.transform(F.sequence(F.lit(0), F.col("_lots") - 1), lambda i: F.struct(F.pmod(h, F.col("_pieces")).cast("int").alias("piece"), i.alias("lot"), F.lit(False).alias("visits")))
    visits = F.transform(F.sequence(F.lit(0), F.col("_pieces") - 1), lambda i: F.struct(i.alias("piece"), F.pmod(h, F.col("_lots")).cast("int").alias("lot"), F.lit(True).alias("visits")))
    return parts.select(*mixed.columns, F.explode(F.when(F.col("label") != F.col("main"), F.concat(stays, visits)).otherwise(stays)).alias("at")).select(*mixed.columns, "at.*")


def each_list(pdf: pd.DataFrame) -> Iterator[tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray]]:
    """The lists of a group: their rows (those at home first), and their pairs."""
    for (key, _, _), own in pdf.groupby(["key", "piece", "lot"], sort=False):
        homes = int((~own["visits"]).sum())
        if homes and homes < len(own):
            own = own.sort_values("visits", kind="stable")
            x, y, n = met(int(key), matrix(own["short"]), bits(own["first"].to_numpy()), own["label"].to_numpy(), homes)
            if len(x):
                yield own, x, y, n


def live(mixed: DataFrame, nodes: DataFrame) -> DataFrame:
    """(key, node) of the nodes that have a pair in a list."""
    placed = dealt(mixed.withColumn("one", F.lit(1)), "one", LIST_NODES, GUESTS).drop("one")
    bins = max(1, rows_of(mixed) // BIN_ROWS)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = [own[["key", "node"]].iloc[np.unique(np.concatenate([x, y]))] for own, x, y, _ in each_list(pdf)]
        return pd.concat(out).drop_duplicates() if out else pd.DataFrame({"key": [], "node": []}, dtype="int64")

    rows = placed.withColumn("bin", F.pmod(F.xxhash64("key", "piece", "lot"), F.lit(bins))).join(nodes.select("node", "short", "first"), "node")
    return rows.groupBy("bin").applyInPandas(run, "key long, node long").distinct()


def confirmed(mixed: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The links (a, b) that are needed to join what is near in the mixed lists."""
    weighed = mixed.join(nodes.select("node", "n", "short", "first"), "node")
    placed = dealt(weighed, "n", LIST_SHINGLES, LIST_SHINGLES)
    bins = max(1, (weighed.agg(F.sum("n")).first()[0] or 0) // LIST_SHINGLES)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        links = []
        for own, x, y, n in each_list(pdf):
            node, label, s = own["node"].to_numpy(), own["label"].to_numpy(), own["s"].to_numpy()
            root = {int(v): int(v) for v in label}

            def top(v: int, root: dict[int, int] = root) -> int:
                while root[v] != v:
                    root[v] = root[root[v]]
                    v = root[v]
                return v

            for i in np.lexsort((node[y], node[x], -n)):
                a, b = top(int(label[x[i]])), top(int(label[y[i]]))
                if a != b:
                    p, q = np.frombuffer(s[x[i]], np.uint64), np.frombuffer(s[y[i]], np.uint64)
                    if len(np.intersect1d(p, q, assume_unique=True)) >= needed(len(p), len(q), percent):
                        root[a] = b
                        links.append((node[x[i]], node[y[i]]))
        return pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    rows = placed.withColumn("bin", F.pmod(F.xxhash64("key", "piece", "lot"), F.lit(bins))).join(sets, "node")
    return rows.groupBy("bin").applyInPandas(run, "a long, b long")


def labelled(df: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> Stored:
    """doc_id, _rk, n_shingles, label (a node of the component) and component_id of every row of df (doc_id, text)."""
    text_batches(df.sparkSession)
    docs = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_rk", F.xxhash64("doc_id", "text"))
    with Scratch() as work:
        profile = work.keep(profiles(docs, k))
        rows = profile.where("part IS NULL").select("doc_id", "_rk", "n", "node")
        # Equal sets have equal signatures.
        one, sig = F.struct(F.col("doc_id").isNull().alias("_"), "doc_id", "_rk", "n"), F.min("sig").alias("sig")
        reps = work.keep(profile.where("n > 0").groupBy("node").agg(F.min(one).alias("r"), sig).select("node", "r.*", "sig").drop("_"))
        nodes = work.keep(posted(reps, sketch_of(profile)))
        keys = work.keep(nodes.select(F.explode("keys").alias("key"), "node"))
        shared = shared_keys(keys, work)
        work.drop(keys)
        pairs = work.keep(matching(first_pairs(shared, work), nodes))
        sets = work.keep(fetch(docs, reps, pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), k))
        links = work.keep(verified(pairs, sets, percent))
        work.drop(sets, pairs)

        def joined(found: DataFrame) -> DataFrame:
            after = stored_components(found)
            work.tables[id(after.df)] = after
            return after.df

        labels = joined(links)
        mixed = work.keep(mixed_blocks(shared, labels).select("key", "node", "label", "main"))
        work.drop(shared)
        left = work.keep(live(mixed, nodes))
        work.drop(mixed)
        if rows_of(left):
            again = work.keep(mixed_blocks(left, labels).select("key", "node", "label", "main"))
            sets = work.keep(fetch(docs, reps, left.select("node").distinct(), k))
            labels = joined(links.unionByName(work.keep(confirmed(again, nodes, sets, percent))))
            work.drop(sets, again)
        return stored(named_rows(rows, reps, labels))


def near_duplicates(df: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row of df (doc_id, text)."""
    found = labelled(df, k, percent).df
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


ORACLE_OP12 = "SELECT *, doc_id = component_id AS kept FROM (" + ORACLE_OP7.replace("len(w) >= 4", "len(w) >= 3").replace("len(w) - 2", "len(w) - 1").replace("w[i:i + 3]", "w[i:i + 2]") + ") c"
