"""Language identification: averaged hashed subword embeddings with a linear softmax.

The lower-cased UTF-8 bytes of a text give subwords (all byte 3-grams and 4-grams), hashed into buckets; the buckets'
embeddings are averaged and a linear softmax gives the languages' probabilities. Embeddings and softmax are trained by
stochastic gradient descent in numpy on a bounded sample of labelled texts. A tenth of that sample is held back for
calibration: one temperature for the softmax, and the score below which a text is rejected (so that at most
``REJECT_SHARE`` of the held-back texts would be, and never above ``REJECT_MOST``).

Prediction uses the whole text: since averaging and softmax weights are both linear, each bucket's embedding is multiplied
with the weights once and the products are averaged, block by block for long texts.

Defined results: a null text, and one without a letter, is ``und`` with score 0 and is rejected; repeated rows are answered
alike; an empty table gives no rows; without any labelled row every text is ``und``; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, as_bytes, blocks, counted, forget, rows_of, small, table, text_batches

BUCKET_BITS = 15
DIM = 16
#: Labelled texts to learn from, at most about, and about so many characters in all; every language has its share of both.
SAMPLE_ROWS, SAMPLE_CHARS = 6_000, 24_000_000
EPOCHS, RATE = 4, 0.3
REJECT_SHARE, REJECT_MOST = 0.0005, 0.5
UNKNOWN = "und"
_PAD = b"    "
_WINDOW = 1 << 18


def subwords(buf: np.ndarray, bits: int = BUCKET_BITS) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the 3-gram and 4-gram that start at each byte (without the last three)."""
    b = buf.astype(np.uint32)
    three = b[:-3] | (b[1:-2] << np.uint32(8)) | (b[2:-1] << np.uint32(16))
    four = three | (b[3:] << np.uint32(24))
    shift = np.uint32(32 - bits)
    return (three * np.uint32(0x9E3779B1)) >> shift, (four * np.uint32(0x85EBCA77) + np.uint32(0x27D4EB2F)) >> shift


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # buckets x languages: embeddings times softmax weights, over the temperature
    bias: np.ndarray
    threshold: float = 0.0
    notes: dict = field(default_factory=dict)

    def probabilities(self, texts: list[bytes]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.langs)))
        count = np.zeros(len(texts))
        for first, group in blocks(texts):
            if len(group) == 1:
                pieces = [(first, [group[0][i : i + _WINDOW + 3]]) for i in range(0, max(1, len(group[0])), _WINDOW)]
            else:
                pieces = [(first, group)]
            for at, part in pieces:
                buf = np.frombuffer(_PAD + _PAD.join(part) + _PAD, np.uint8)
                lens = np.fromiter((len(t) + len(_PAD) for t in part), np.int64, len(part))
                starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
                n = int(lens.sum())  # grams that start in the pad before a text, or in the text, are its own
                three, four = subwords(buf)
                rows = self.weights[three[:n]] + self.weights[four[:n]]
                total[at : at + len(part)] += np.add.reduceat(rows, starts, axis=0)
                count[at : at + len(part)] += 2 * lens
        logit = total / np.maximum(count, 1)[:, None] + self.bias
        e = np.exp(logit - logit.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


class Bags:
    """Each text's buckets and their shares. They lie in a few large arrays, which the process gives back when they have served;
    many thousand small ones would stay in its heap."""

    TEXTS = 256

    def __init__(self, texts: list[str]) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for first in range(0, len(texts), self.TEXTS):
            found = [self._bag(t) for t in texts[first : first + self.TEXTS]]
            self.parts.append((np.cumsum([0, *(len(ids) for ids, _ in found)]), *map(np.concatenate, zip(*found, strict=True))))

    @staticmethod
    def _bag(text: str) -> tuple[np.ndarray, np.ndarray]:
        three, four = subwords(np.frombuffer(_PAD + as_bytes([text.lower()])[0] + _PAD, np.uint8))
        ids, n = np.unique(np.concatenate((three, four)), return_counts=True)
        return ids.astype(np.uint16), (n / n.sum()).astype(np.float32)  # BUCKET_BITS are fewer than 16

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        at, ids, shares = self.parts[i // self.TEXTS]
        a, b = at[i % self.TEXTS], at[i % self.TEXTS + 1]
        return ids[a:b].copy(), shares[a:b].copy()


def train(texts: list[str], labels: list[str], seed: int = 11) -> Model:
    """Stochastic gradient descent over texts, one at a time."""
    langs = sorted(set(labels))
    size = 1 << BUCKET_BITS
    if not langs:
        return Model([], np.zeros((size, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    y = np.array([langs.index(x) for x in labels])
    bags = Bags(texts)
    order = rng.permutation(len(texts))
    held, learn = order[: len(order) // 10], order[len(order) // 10 :]
    emb = rng.uniform(-0.5, 0.5, (size, DIM)).astype(np.float32)
    out = np.zeros((DIM, len(langs)), np.float32)
    bias = np.zeros(len(langs), np.float32)
    steps, step = EPOCHS * len(learn), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(learn):
            ids, w = bags[i]
            rate = RATE * (1 - step / steps)
            step += 1
            h = w @ emb[ids]
            z = h @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = out @ p
            out -= rate * np.outer(h, p)
            bias -= rate * p
            emb[ids] -= (rate * 20) * w[:, None] * back
    model = Model(langs, emb.astype(np.float64) @ out.astype(np.float64), bias.astype(np.float64))
    # Calibration on the held-back texts: the temperature of least log loss, then the rejection score.
    if len(held):
        scores = np.stack([(bags[i][1] @ model.weights[bags[i][0]]) + model.bias for i in held])

        def soft(t: float) -> np.ndarray:
            e = np.exp((scores - scores.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        loss = {t: -np.log(np.maximum(soft(t)[np.arange(len(held)), y[held]], 1e-9)).mean() for t in np.geomspace(0.2, 5, 25)}
        best = min(loss, key=loss.get)
        model.weights, model.bias = model.weights / best, model.bias / best
        p = soft(best)
        model.threshold = float(min(REJECT_MOST, np.quantile(p.max(axis=1), REJECT_SHARE)))
        model.notes = {"temperature": float(best), "held_back_accuracy": float((p.argmax(axis=1) == y[held]).mean())}
    model.weights = model.weights.astype(np.float32)
    return model


def lettered(text: str | None) -> bool:
    """Whether a text holds a letter (of the Unicode categories L*)."""
    return isinstance(text, str) and any(map(str.isalpha, text))


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Train on whole texts of a bounded sample of the rows with text and language. Each language gives up to an equal part of
    it, so that rare ones are learned at every size of the table."""
    rows = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(key, F.col(text).alias("_t"), F.col(lang).alias("_l"))
    with Scratch() as work:
        sizes = work.keep(rows.groupBy("_l").agg(F.count("*").alias("n"), F.sum(F.length("_t")).alias("c")))
        many = max(1, rows_of(sizes))
        share = F.least(F.lit(1.0), F.lit(SAMPLE_ROWS / many) / F.col("n"), F.lit(SAMPLE_CHARS / many) / F.greatest("c", F.lit(1)))
        parts = small(counted(sizes.select("_l", (share * 10_000_000).cast("long").alias("_share")), many))  # texts are not shuffled
        got = rows.join(parts, "_l").where(F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(10_000_000)) < F.col("_share")).select(key, "_t", "_l").toPandas()
    got = got[got["_t"].map(lettered).astype(bool)].sort_values([key, "_t"], kind="stable")
    return train(got["_t"].tolist(), got["_l"].tolist())


def identify(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row with lang_pred, score and rejected."""
    spark = df.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size: buckets times languages

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        forget()
        m = shared.value
        has = texts.map(lettered).to_numpy(bool)
        lang = np.full(len(texts), UNKNOWN, object)
        score = np.zeros(len(texts))
        if m.langs and has.any():
            p = m.probabilities(as_bytes([t.lower() for t in texts[has]]))
            lang[has] = np.array(m.langs, object)[p.argmax(axis=1)]
            score[has] = p.max(axis=1)
        return pd.DataFrame({"lang_pred": lang, "score": score, "rejected": (lang == UNKNOWN) | (score < m.threshold)})

    own = ("lang_pred", "score", "rejected")  # columns of these names are replaced
    return df.withColumn("_lid", predict(F.col(text))).select(*[c for c in df.columns if c not in own], *[f"_lid.{c}" for c in own])


def held_out(doc_id: str = "doc_id"):
    """Texts that are never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out())
    model = fit(docs.where(~F.col("held_out")))
    return identify(docs.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score", "rejected")
