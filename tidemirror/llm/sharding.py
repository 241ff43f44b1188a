"""Sharding by weighted rendezvous hashing, with DataFrame functions only.

Every record scores each shard by ``-weight / ln(u)``, u in (0, 1) from a hash of (record key, shard), and goes to the
highest score. A shard's scores don't depend on the other shards, so one more shard takes records only into itself, and a
shard's share of the records follows its weight. This is the law ``key``: the key and the shards decide, nothing else.

Slots number the rows of a shard from 0 without gaps, in the order of their columns, so they depend on the rows alone: not on
the table's size or its files. Equal rows are counted first; what is left is dealt by ranges of (shard, order), numbered inside
each range and shifted by the counts of the ranges before. So no task ever holds a whole shard, nor all rows of one key.

Defined results: a null key hashes as the word ``null``; a null text counts 0 bytes and has crc32 0 (that of the empty
text); repeated rows each get a slot; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import rows_of, stored, table

N_SHARDS = 40
#: Bytes a record takes besides its text.
OVERHEAD = 16
#: About so many rows are numbered by one task.
SLOT_ROWS = 20_000


def rendezvous(key: Column, weights: Sequence[float]) -> Column:
    """The shard of each key among len(weights) shards."""
    scores = []
    for shard, weight in enumerate(weights):
        digits = F.substring(F.md5(F.concat(key, F.lit(f":{shard}"))), 1, 12)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48)
        scores.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(-shard).alias("shard")))
    return (-F.greatest(*scores)["shard"]).cast("int")


def assign(df: DataFrame, key: str, shards: int, weights: Sequence[float] | None = None, text: str = "text") -> DataFrame:
    """The columns key, size, text_crc32, shard, grown_shard of every row."""
    weights = list(weights or [1.0] * shards)
    name = F.coalesce(F.col(key).cast("string"), F.lit("null"))
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    first = df.select(F.col(key), (F.length(body) + OVERHEAD).cast("long").alias("size"), F.crc32(body).alias("text_crc32"), rendezvous(name, weights).alias("shard"), name.alias("_name"))
    # One more shard: it wins a record or leaves it where it was.
    return first.withColumn("grown_shard", _grown(F.col("_name"), F.col("shard"), weights)).drop("_name")


def _score(key: Column, shard: Column, weight: Column) -> Column:
    digits = F.substring(F.md5(F.concat(key, F.lit(":"), shard.cast("string"))), 1, 12)
    return -weight / F.log((F.conv(digits, 16, 10).cast("double") + 0.5) / float(1 << 48))


def _grown(key: Column, shard: Column, weights: Sequence[float], weight: float = 1.0) -> Column:
    held = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), shard + 1)
    new = _score(key, F.lit(len(weights)), F.lit(float(weight)))
    return F.when(new > _score(key, shard, held), F.lit(len(weights))).otherwise(shard).cast("int")


def number_slots(df: DataFrame, shard: str, order: Sequence[str], task_rows: int | None = None) -> DataFrame:
    """Add slot: 0, 1, ... within each shard, in the given order (rows that agree in it, by their other columns)."""
    task_rows = SLOT_ROWS if task_rows is None else task_rows
    order = [*order, *[c for c in df.columns if c not in order]]
    each = stored(df.groupBy(*df.columns).agg(F.count("*").alias("_n")))
    parts = max(1, -(-rows_of(each.df) // task_rows))
    # Ranges of (shard, order) of about equal size; each is written once, so it stays as it is.
    ranged = stored(each.df.repartitionByRange(parts, shard, *order).withColumn("_part", F.spark_partition_id())).df
    each.drop()
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(shard, "_part").agg(F.sum("_n").alias("_m"))
    base = sums.select(shard, "_part", F.coalesce(F.sum("_m").over(before.partitionBy(shard).orderBy("_part")), F.lit(0)).alias("_base"))  # few rows
    within = F.coalesce(F.sum("_n").over(before.partitionBy(shard, "_part").orderBy(*order)), F.lit(0))
    placed = ranged.withColumn("_at", within).join(base, [shard, "_part"]).withColumn("_at", F.col("_at") + F.col("_base"))
    # Equal rows come back, those of very many copies in pieces dealt over tasks.
    few, many = placed.where(F.col("_n") <= task_rows), placed.where(F.col("_n") > task_rows)
    piece = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1, F.lit(task_rows).cast("long")))
    pieces = many.withColumn("_piece", piece).repartition(shard, "_at", "_piece")
    rows = few.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1))).unionByName(
        pieces.withColumn("_i", F.explode(F.sequence(F.col("_piece"), F.least(F.col("_piece") + task_rows, F.col("_n")) - 1))).drop("_piece")
    )
    return rows.select(*df.columns, (F.col("_at") + F.col("_i")).cast("long").alias("slot"))


def op8_rendezvous_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = number_slots(assign(docs, "doc_id", N_SHARDS), "shard", ["doc_id", "size", "text_crc32"])
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


#: With equal weights the highest score is the greatest hash; crc32 byte by byte over its table, which a recursion makes.
ORACLE_OP8 = f"""
WITH RECURSIVE poly(i, c, k) AS (SELECT i, i::BIGINT, 0 FROM range(256) t(i) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM poly WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM poly WHERE k = 8),
d AS (SELECT doc_id, coalesce(doc_id::VARCHAR, 'null') AS name, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, octet_length(b) + {OVERHEAD} AS size, list_max(list_transform(range(0, {N_SHARDS}), lambda i: {{'u': md5(name || ':' || i)[1:12], 's': -i}})) AS held, md5(name || ':{N_SHARDS}')[1:12] AS new,
 xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(b), '..'), lambda x: ('0x' || x)::BIGINT)), lambda a, x: xor(a >> 8, t[(xor(a, x) & 255) + 1])), 4294967295) AS text_crc32 FROM d, crc)
SELECT doc_id, size, text_crc32, 'key' AS law, (-held.s)::INTEGER AS shard, row_number() OVER (PARTITION BY held.s ORDER BY doc_id, size, text_crc32) - 1 AS slot,
 CASE WHEN new > held.u THEN {N_SHARDS} ELSE -held.s END::INTEGER AS grown_shard FROM s
"""
