"""Transactions and table layouts of a change log."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType

from tidemirror.functions.tables import SMALL_ROWS, join_few_keys

#: Positions of the log are joined to intervals by buckets of so many.
INTERVAL_BUCKET = 100_000
#: Tasks over which the rows of one relation are dealt to find their layouts.
LAYOUT_PARTS = 64
#: Characters of layouts (as JSON) that all tasks may get.
LAYOUT_CHARS = 64 << 20


def assemble(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """Row changes that carry xid, with ack_lsn and commit_us of their commit. Without a commit nothing is delivered."""
    return rows.drop("ack_lsn", "commit_us").join(commits.select("xid", "ack_lsn", "commit_us"), "xid")


def transactions(rows: DataFrame, commits: DataFrame) -> DataFrame:
    """One row for each committed transaction, empty ones too: xid, ack_lsn, commit_us, n_events."""
    counts = rows.groupBy("xid").agg(F.count("*").alias("n_events"))
    return commits.select("xid", "ack_lsn", "commit_us").join(counts, "xid", "left").withColumn("n_events", F.coalesce("n_events", F.lit(0)).cast("long"))


def assemble_stream(messages: DataFrame, segment: int = INTERVAL_BUCKET) -> DataFrame:
    """Row messages of a raw log (no xid of their own) with the transaction they stand in: the mark before a row is a begin, the
    one behind it a commit.

    The log is cut into segments of positions and each is put in order once; marks are filled forward and backward inside it.
    What a segment hands to the next ones (its first and last mark) is one row for each segment."""
    mark = F.when(F.col("tag").isin("begin", "commit"), F.struct("tag", "xid", "end_lsn", "commit_us"))
    cut_up = messages.withColumn("_s", F.floor(F.col("seq") / segment)).withColumn("_m", mark)
    before = lambda *order: Window.partitionBy("_s").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    filled = cut_up.withColumn("_prev", F.last("_m", True).over(before("seq"))).withColumn("_next", F.last("_m", True).over(before(F.desc("seq"))))
    rows = filled.where(F.col("tag").isin("insert", "update", "delete"))
    place = F.when(F.col("_m").isNotNull(), F.col("seq"))
    ends = cut_up.groupBy("_s").agg(F.min_by("_m", place).alias("_head"), F.max_by("_m", place).alias("_tail"))
    along = lambda *order: Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # noqa: E731  # one row for each segment
    carried = ends.select("_s", F.last("_tail", True).over(along("_s")).alias("_in"), F.last("_head", True).over(along(F.desc("_s"))).alias("_out"))
    placed = rows.join(carried, "_s").withColumn("_prev", F.coalesce("_prev", "_in")).withColumn("_next", F.coalesce("_next", "_out"))
    inside = placed.where((F.col("_prev.tag") == "begin") & (F.col("_next.tag") == "commit"))
    fields = {"xid": F.col("_prev.xid"), "ack_lsn": F.col("_next.end_lsn"), "commit_us": F.col("_next.commit_us")}
    return inside.withColumns(fields).drop("_s", "_m", "_prev", "_next", "_in", "_out", "lsn", "end_lsn")


def split_oversized(rows: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(rows of transactions with at most ``most`` events, report of the dropped ones: xid, n_events, most_events)."""
    sizes = rows.groupBy("xid").agg(F.count("*").alias("n_events"))
    large = sizes.where(F.col("n_events") > most).withColumn("most_events", F.lit(most).cast("long"))
    return rows.join(large.select("xid"), "xid", "left_anti"), large


def sub_batches(rows: DataFrame, size: int, order: list[str] | None = None, xid: str = "xid", segment: int = INTERVAL_BUCKET) -> DataFrame:
    """Number the chunks of each transaction: chunk_no changes every ``size`` events. Transactions of more than ``segment`` rows
    are numbered in segments of their first order column, a number, shifted by the rows of the segments before."""
    order = order or ["seq"]
    large = rows.groupBy(xid).agg(F.count("*").alias("_n")).where(F.col("_n") > segment).select(xid, F.lit(True).alias("_large"))
    placed = rows.join(large, xid, "left").withColumn("_seg", F.when(F.col("_large"), F.floor(F.col(order[0]) / segment)).otherwise(F.lit(0)))
    before = Window.partitionBy(xid).orderBy("_seg").rowsBetween(Window.unboundedPreceding, -1)
    base = placed.where("_large").groupBy(xid, "_seg").agg(F.count("*").alias("_n")).select(xid, "_seg", F.sum("_n").over(before).alias("_base"))
    at = F.row_number().over(Window.partitionBy(xid, "_seg").orderBy(*order)) - 1
    numbered = placed.withColumn("_at", at).join(base, [xid, "_seg"], "left")
    return numbered.withColumn("chunk_no", F.floor((F.col("_at") + F.coalesce("_base", F.lit(0))) / size).cast("long")).select(*rows.columns, "chunk_no")


def sub_batch_sizes(rows: DataFrame, commits: DataFrame, size: int, xid: str = "xid") -> DataFrame:
    """Chunks as they are handed out: full ones while a transaction is open, and what is left (maybe nothing) at its commit."""
    counts = commits.select(xid).join(rows.groupBy(xid).agg(F.count("*").alias("n")), xid, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    full = F.floor(F.col("n") / size)
    return counts.select(xid, F.explode(F.sequence(F.lit(0).cast("bigint"), full)).alias("chunk_no"), full.alias("_full"), "n").select(
        xid, "chunk_no", F.when(F.col("chunk_no") < F.col("_full"), F.lit(size)).otherwise(F.col("n") % size).cast("long").alias("n_events"), (F.col("chunk_no") == F.col("_full")).alias("at_commit")
    )


def with_relation(events: DataFrame, relations: DataFrame) -> DataFrame:
    """Each row with the latest layout of its relation at or before it; rows of unknown relations keep nulls.

    Layouts are counted. If they are few, all tasks get them and each row looks its own up: rows are neither shuffled nor put in
    order. Of more, the rows of one relation are dealt over LAYOUT_PARTS tasks,
    each of which gets that relation's layouts; there rows and layouts are put in order once, and layouts are filled forward.
    So the work grows with rows and layouts, not their product, and a much used table isn't on one task."""
    names = [c for c in relations.columns if c not in ("seq", "relation_id", *events.columns)]
    key = {c: events.schema[c].dataType for c in ("relation_id", "seq")}
    known = relations.where(F.col("relation_id").isNotNull() & F.col("seq").isNotNull()).select(*[F.col(c).cast(t).alias(c) for c, t in key.items()], F.struct(*names).alias("_layout"))
    if all(isinstance(t, (IntegerType, LongType)) for t in key.values()):
        size = known.limit(SMALL_ROWS + 1).agg(F.count("*").alias("n"), F.sum(F.length(F.to_json("_layout"))).alias("chars")).first()
        if size.n <= SMALL_ROWS and (size.chars or 0) <= LAYOUT_CHARS:
            return _looked_up(events, known, names)
    layout = known.select(F.explode(F.sequence(F.lit(0), F.lit(LAYOUT_PARTS - 1))).alias("_part"), "relation_id", "seq", "_layout", F.lit(False).alias("_event"))
    dealt = events.withColumns({"_part": F.pmod(F.xxhash64("seq"), F.lit(LAYOUT_PARTS)).cast("int"), "_event": F.lit(True)})
    # A layout at a row's own position holds for it (false comes before true).
    up_to = Window.partitionBy("relation_id", "_part").orderBy("seq", "_event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    filled = dealt.unionByName(layout, allowMissingColumns=True).withColumn("_known", F.last("_layout", True).over(up_to))
    return filled.where("_event").select(*events.columns, *[F.col("_known")[c].alias(c) for c in names])


def _looked_up(events: DataFrame, known: DataFrame, names: list[str]) -> DataFrame:
    """with_relation for few layouts: they go to all tasks, in order of relation and position."""
    table = known.toArrow().combine_chunks()
    relation, seq = (table[c].to_numpy().astype(np.int64) for c in ("relation_id", "seq"))
    order = np.lexsort((seq, relation))
    kept = pa.concat_arrays(table["_layout"].chunks) if table.num_rows else pa.array([], table.schema.field("_layout").type)
    shared = events.sparkSession.sparkContext.broadcast((relation[order], seq[order], kept.take(pa.array(order))))

    @F.arrow_udf(known.schema["_layout"].dataType)
    def latest(relation: pa.Array, seq: pa.Array) -> pa.Array:
        relations, places, layouts = shared.value
        # Arrow keeps long positions whole where there are nulls.
        of, at = (c.cast(pa.int64()).fill_null(0).to_numpy(zero_copy_only=False) for c in (relation, seq))
        told = relation.is_valid().to_numpy(zero_copy_only=False) & seq.is_valid().to_numpy(zero_copy_only=False)
        place, found = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        for r in np.unique(of[told]):
            first, end = np.searchsorted(relations, r, side="left"), np.searchsorted(relations, r, side="right")
            rows = np.flatnonzero(told & (of == r))
            place[rows] = first + np.searchsorted(places[first:end], at[rows], side="right") - 1
            found[rows] = place[rows] >= first
        return layouts.take(pa.array(place, mask=~found))

    filled = events.withColumn("_known", latest("relation_id", "seq"))
    return filled.select(*events.columns, *[F.col("_known")[c].alias(c) for c in names])


def schema_changes(relations: DataFrame, watched: DataFrame | None = None, row_events: DataFrame | None = None) -> DataFrame:
    """Layout messages that differ from the one before of the same relation: changed, breaking, unsafe.

    watched: (src_schema, src_table, columns); a table that isn't listed, or has an empty list, watches all its columns.
    row_events: (xid, relation_id, seq), with xid on the layout messages too: a change is unsafe if rows of its relation came
    before it in the same transaction.
    """
    before = F.lag("columns").over(Window.partitionBy("relation_id").orderBy("seq"))
    out = relations.withColumn("before", before).withColumn("changed", F.col("before").isNotNull() & (F.col("before") != F.col("columns")))
    if watched is not None:
        out = join_few_keys(out, watched.select("src_schema", "src_table", F.col("columns").alias("watched")), ["src_schema", "src_table"], "left")
    else:
        out = out.withColumn("watched", F.lit(None).cast("array<string>"))

    def of(columns: str, name: Column) -> Column:
        return F.filter(F.col(columns), lambda c: c["name"] == name)

    touched = F.exists("watched", lambda name: (F.size(of("before", name)) > 0) & (of("before", name) != of("columns", name)))
    everything = F.col("watched").isNull() | (F.size("watched") == 0)
    out = out.withColumn("breaking", F.col("changed") & F.when(everything, F.lit(True)).otherwise(F.coalesce(touched, F.lit(False))))
    if row_events is None:
        return out.withColumn("unsafe", F.col("breaking"))
    first = row_events.groupBy("xid", "relation_id").agg(F.min("seq").alias("_first"))
    out = out.join(first, ["xid", "relation_id"], "left")
    return out.withColumn("unsafe", F.col("breaking") | (F.col("changed") & F.coalesce(F.col("_first") < F.col("seq"), F.lit(False)))).drop("_first")


def watched_columns(configs: DataFrame) -> DataFrame:
    """The columns that configs need of each table; a config that takes all columns empties its table's list."""
    every = F.max(F.col("columns").isNull())
    names = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce("columns", F.array().cast("array<string>"))))))
    return configs.groupBy("src_schema", "src_table").agg(F.when(every, F.array().cast("array<string>")).otherwise(names).alias("columns"))
