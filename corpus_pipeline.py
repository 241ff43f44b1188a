"""The corpus pipeline: documents in, token digests of what is kept out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows as Parquet into the shared
folder and reads them again for the next one. All stages but the last return the columns of ``documents``.

1. language_id: documents whose language is rejected (no letter, or a calibrated score below the threshold) go.
2. near_duplicates: of each component of near-equal five-word shingle sets (similarity 0.8 or more) the document with the
   smallest doc_id stays.
3. suffix_dedup: later copies of passages of over 50 words, or of 400 bytes or more, are cut out of the texts; the first
   copy stays.
4. decontamination: documents that overlap a benchmark item go.
5. tokenize: texts are encoded and decoded; one row per document with its number of ids and digests.

Defined results: columns other than those of ``documents`` are left out, whatever their names; null and empty texts and texts
without a letter go in the first stage; rows without doc_id are documents like others, in 2. they give way to documents with
one; of repeated rows, and of rows that share a doc_id in one component, one stays in 2. (a tie of ids goes to the smaller
text hash); lang, source and n_chars may be null, n_chars is counted anew in 3. for texts that are not null; a text that is cut
to nothing stays as the empty text and has no ids; an empty table gives no rows.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemirror.llm import decontaminate, jaccard_join, langid, sp_codec, suffix_dedup
from tidemirror.llm.common import remove, shared_folder, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
SHINGLE_WORDS, SIMILARITY_PERCENT = 5, 80
#: The fewest words of a repeated passage.
PASSAGE_WORDS = 51


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(table(spark, sf_dir, "documents").select("doc_id", "text", "lang").where(~langid.held_out()))
    return langid.identify(docs.select(*COLUMNS), model).where(~F.col("rejected")).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs.select(*COLUMNS), SHINGLE_WORDS, SIMILARITY_PERCENT).select(*COLUMNS)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    kept = suffix_dedup.dedup_texts(docs.select(*COLUMNS), keep="first", words=PASSAGE_WORDS)
    return kept.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text")).cast("long")).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.clean(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sp_codec.digests(docs.select("doc_id", "text"))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontamination", decontamination),
    ("tokenize", tokenize),
]

#: Language models, suffix orders and tokenizers can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before is not None:
            remove(spark, before)  # a stage's input has served once its output stands
        before = f"{folder}/{name}"
    return docs
