"""License scan by diagonal voting, with DataFrame functions only.

All rolling word k-grams of all texts are joined by hash to the k-grams of known license templates (a fixed table, so it
may be broadcast). A hit at text position p and template position t votes for the diagonal p - t. Votes are summed by
(text, template, diagonal); a run of neighbouring diagonals is one candidate copy, which tolerates inserted and dropped
words; its span is kept if the distinct template positions it holds cover enough of the template. Short exact phrases are
templates too: one holds where all of its k-grams vote for one diagonal.

Defined results: a null or empty text has no words and no label; a text of fewer than k words has no hit; rows that share
doc_id and text are answered alike; null ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

K = 3
#: Share of a notice's k-grams that a span must hold.
MIN_COVER = 0.6
#: Diagonals up to so many words apart belong to one copy.
DIAGONAL_GAP = 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose every exact place counts, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Opening sentences of well-known public licenses and notices, which the method finds besides.
NOTICES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("cc0", "to the extent possible under law the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
]


def words(text: Column) -> Column:
    """Runs of ASCII digits, letters and non-ASCII characters, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), NOT_WORD), lambda w: w != "")


def template_grams(k: int = K) -> list[tuple[int, str, bool, int, int, str]]:
    """(template, label, exact, size, tpos, tgram): the k-grams of all templates. k is at most the words of the shortest phrase,
    which could not be found otherwise."""
    if not 1 <= k <= min(len(text.split()) for text, _ in PHRASES):
        raise ValueError(f"k-grams of {k} words miss a phrase")
    rows = [(i, label, True, text.split()) for i, (text, label) in enumerate(PHRASES)]
    rows += [(len(PHRASES) + i, label, False, text.split()) for i, (label, text) in enumerate(NOTICES)]
    return [(i, label, exact, len(w) - k + 1, p, " ".join(w[p : p + k])) for i, label, exact, w in rows for p in range(len(w) - k + 1)]


def templates(spark: SparkSession, k: int = K) -> DataFrame:
    return spark.createDataFrame(template_grams(k), "template int, label string, exact boolean, size int, tpos int, tgram string").withColumn("h", F.xxhash64("tgram"))


def scan(df: DataFrame, text: str = "text", doc_id: str = "doc_id", k: int = K) -> DataFrame:
    """Spans: doc_id, _rk, template, label, exact, first, last (word positions), votes, cover."""
    keyed = df.select(F.col(doc_id).alias("doc_id"), F.xxhash64(doc_id, text).alias("_rk"), words(F.col(text)).alias("w"))
    w = F.col("w")
    rolling = F.arrays_zip(*[(F.slice(w, i + 1, F.greatest(F.size(w), F.lit(1))) if i else w).alias(f"w{i}") for i in range(k)])
    grams = keyed.select("doc_id", "_rk", F.posexplode(rolling).alias("pos", "g")).select("doc_id", "_rk", "pos", F.concat_ws(" ", *[f"g.w{i}" for i in range(k)]).alias("gram"))
    grams = grams.withColumn("h", F.xxhash64("gram"))
    known = F.broadcast(templates(df.sparkSession, k))  # a fixed table of some 200 rows
    hits = grams.join(known, (grams.h == known.h) & (grams.gram == known.tgram)).drop("h", "gram", "tgram")
    votes = hits.groupBy("doc_id", "_rk", "template", "label", "exact", "size", (F.col("pos") - F.col("tpos")).alias("diagonal")).agg(
        F.count_distinct("tpos").alias("votes"), F.min("pos").alias("first"), F.max("pos").alias("last"), F.collect_set("tpos").alias("held")
    )
    by = ["doc_id", "_rk", "template"]
    order = Window.partitionBy(*by).orderBy("diagonal")
    apart = F.col("exact") | (F.col("diagonal") - F.lag("diagonal").over(order) > DIAGONAL_GAP)  # a phrase has no neighbours
    runs = votes.withColumn("_run", F.sum(F.coalesce(apart.cast("int"), F.lit(0))).over(order))
    merged = runs.groupBy(*by, "label", "exact", "size", "_run").agg(
        F.min("first").alias("first"), F.max("last").alias("last"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).cast("long").alias("votes")
    )
    merged = merged.withColumn("cover", F.col("votes") / F.col("size"))
    return merged.where(F.when(F.col("exact"), F.col("votes") == F.col("size")).otherwise(F.col("cover") >= MIN_COVER)).drop("size", "_run")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = scan(docs).groupBy("doc_id", "_rk").agg(
        F.count_if("exact").alias("n_base"),
        F.min(F.when(F.col("exact"), F.col("first"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("exact"), F.col("first"))).cast("long").alias("last_word"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label"))))).alias("base_labels"),
        F.concat_ws(",", F.array_sort(F.collect_set("label"))).alias("labels"),
        F.max("cover").alias("score"),
    )
    rows = docs.select("doc_id", F.xxhash64("doc_id", "text").alias("_rk"), F.size(words(F.col("text"))).cast("long").alias("n_words")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d._rk") == F.col("f._rk"))
    return rows.join(found.alias("f"), same, "left").select(
        "d.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


ORACLE_OP9 = f"""
WITH tpl(template, label, exact, size, tpos, tgram) AS (VALUES {", ".join(f"({i}, '{label}', {exact}, {size}, {p}, '{gram}')" for i, label, exact, size, p, gram in template_grams())}),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
g AS (SELECT doc_id, p - 1 AS pos, array_to_string(w[p : p + {K - 1}], ' ') AS gram FROM d, LATERAL (SELECT unnest(range(1, len(w) - {K - 2})) AS p) u),
v AS (SELECT doc_id, template, label, exact, size, pos - tpos AS diagonal, min(pos) AS f, max(pos) AS l, list(DISTINCT tpos) AS held FROM g JOIN tpl ON gram = tgram GROUP BY ALL),
a AS (SELECT *, CASE WHEN exact OR diagonal - lag(diagonal) OVER (PARTITION BY doc_id, template ORDER BY diagonal) > {DIAGONAL_GAP} THEN 1 ELSE 0 END AS apart FROM v),
n AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, template ORDER BY diagonal) AS run FROM a),
m AS (SELECT doc_id, template, label, exact, size, run, min(f) AS f, len(list_distinct(flatten(list(held)))) AS votes FROM n GROUP BY ALL),
k AS (SELECT *, votes / size::DOUBLE AS cover FROM m WHERE CASE WHEN exact THEN votes = size ELSE votes / size::DOUBLE >= {MIN_COVER} END),
o AS (SELECT doc_id, count(*) FILTER (exact) AS n_base, min(f) FILTER (exact) AS f, max(f) FILTER (exact) AS l, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact) AS base, string_agg(DISTINCT label, ',' ORDER BY label) AS every, max(cover) AS score FROM k GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, f AS first_word, l AS last_word, coalesce(base, '') AS base_labels, coalesce(every, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score FROM d LEFT JOIN o ON o.doc_id = d.doc_id
"""
