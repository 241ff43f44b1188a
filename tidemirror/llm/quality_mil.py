"""Quality classifier: attention-based multiple-instance learning.

A document is a bag of passages of ``PASSAGE_WORDS`` words. Every passage is encoded (hashed byte 3-grams and a few shares
of character kinds and of repeated words, then one dense tanh layer); gated attention weighs the passages, and the weighted
sum is scored by a logistic unit. All layers are learned together from document labels, by Adam in numpy, on a bounded
sample of labelled documents. Long texts are encoded block by block; the attention is a running softmax, so memory doesn't
grow with the text.

Defined results: a null or empty text is one empty passage and gets that bag's score; repeated rows are answered alike; an
empty table gives no rows; without labels of both kinds every score is the labels' mean (0.5 without labels); other
columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import as_bytes, blocks, bounded_sample, span_hashes, table, text_batches, word_table, words_of

PASSAGE_WORDS = 64
BUCKETS = 1024
STATS = 10
HIDDEN, GATE = 24, 12
#: Labelled documents to learn from, at most about, and about so many characters in all. Their texts are taken whole.
SAMPLE_ROWS, SAMPLE_CHARS = 3_000, 12_000_000
EPOCHS, RATE, BATCH = 12, 0.004, 32
THRESHOLD = 0.3

_WORD = word_table(b" \t\n\r\x0b\x0c")
_KIND = np.zeros(256, np.int64)  # 0 other, 1 lower, 2 upper, 3 digit, 4 punctuation, 5 non-ASCII, 6 blank
_KIND[97:123], _KIND[65:91], _KIND[48:58], _KIND[128:] = 1, 2, 3, 5
_KIND[[33, 34, 35, 36, 37, 38, 39, 40, 41, 42, 43, 44, 45, 46, 47, 58, 59, 60, 61, 62, 63, 64, 91, 92, 93, 94, 95, 96, 123, 124, 125, 126]] = 4
_KIND[[32, 9, 10, 13]] = 6


def passages(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages, and the text each belongs to. Every text has at least one passage."""
    buf, start, end, owner = words_of(texts, _WORD)
    n_words = np.bincount(owner, minlength=len(texts))
    first = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    at = np.arange(len(owner)) - first[owner]
    per = np.maximum(1, -(-n_words // PASSAGE_WORDS))
    base = np.concatenate(([0], np.cumsum(per)))
    word_passage = base[owner] + at // PASSAGE_WORDS
    n = int(base[-1])
    x = np.zeros((n, BUCKETS + STATS), np.float32)
    whose = np.repeat(np.arange(len(texts)), per)
    # Passage of each byte: that of the text's last word that starts at or before it, else the text's first.
    text = np.repeat(np.arange(len(texts)), np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts)))
    byte_passage = base[text]
    if len(start):
        byte_word = np.cumsum(np.bincount(start, minlength=len(buf))) - 1
        byte_passage = np.maximum(byte_passage, np.where(byte_word < 0, 0, word_passage[np.maximum(byte_word, 0)]))
    b = buf.astype(np.uint32)
    gram = (((b[:-2] | (b[1:-1] << np.uint32(8)) | (b[2:] << np.uint32(16))) * np.uint32(0x9E3779B1)) >> np.uint32(22)).astype(np.int64)
    own = text[:-2] == text[2:]  # no gram reaches into the next text, so a score depends on its own text only
    counts = np.bincount((byte_passage[:-2] * BUCKETS + gram)[own], minlength=n * BUCKETS).reshape(n, BUCKETS)
    total = np.maximum(1, np.bincount(byte_passage, minlength=n))[:, None]
    x[:, :BUCKETS] = np.sqrt(counts / total) * 4
    kinds = np.bincount(byte_passage * 7 + _KIND[buf], minlength=n * 7).reshape(n, 7) / total
    x[:, BUCKETS : BUCKETS + 7] = kinds * 4
    words = np.maximum(1, np.bincount(word_passage, minlength=n))
    h = span_hashes(buf, start, end) ^ (word_passage.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    distinct = np.bincount(word_passage[np.unique(h, return_index=True)[1]], minlength=n)
    x[:, BUCKETS + 7] = 4 * distinct / words
    x[:, BUCKETS + 8] = np.bincount(word_passage, weights=end - start, minlength=n) / words / 4
    x[:, BUCKETS + 9] = np.log1p(words) / 2
    return x, whose


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


@dataclass
class Model:
    p: dict[str, np.ndarray] | None
    constant: float = 0.5

    def attend(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Encoded passages and their attention before the softmax."""
        p = self.p
        h = np.tanh(x @ p["W"] + p["b"])
        return h, (np.tanh(h @ p["V"]) * _sigmoid(h @ p["U"])) @ p["w"]

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.p is None:
            return np.full(len(texts), self.constant)
        top = np.full(len(texts), -np.inf)
        weight = np.zeros(len(texts))
        held = np.zeros((len(texts), HIDDEN))
        for first, group in blocks(texts):
            parts = [(first, group)] if len(group) > 1 else [(first, [piece]) for piece in _pieces(group[0])]
            for at, part in parts:
                x, whose = passages(part)
                h, a = self.attend(x)
                m = np.full(len(part), -np.inf)
                np.maximum.at(m, whose, a)
                own = slice(at, at + len(part))
                new = np.maximum(top[own], m)
                old = np.where(np.isinf(top[own]), 0, np.exp(np.minimum(0, top[own] - new)))
                e = np.exp(a - new[whose])
                weight[own] = weight[own] * old + np.bincount(whose, weights=e, minlength=len(part))
                z = np.zeros((len(part), HIDDEN))
                np.add.at(z, whose, e[:, None] * h)
                held[own] = held[own] * old[:, None] + z
                top[own] = new
        return _sigmoid(held / weight[:, None] @ self.p["c"] + self.p["d"][0])


def _pieces(text: bytes, size: int = 1 << 20) -> list[bytes]:
    """A long text in pieces that end at a blank where there is one."""
    out, at = [], 0
    while len(text) - at > size:
        end = text.rfind(b" ", at + size // 2, at + size)
        end = at + size if end < 0 else end
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def train(texts: list[bytes], labels: np.ndarray, seed: int = 5) -> Model:
    if not len(labels) or labels.min() == labels.max():
        return Model(None, float(labels.mean()) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    x, whose = zip(*[passages(g) for _, g in blocks(texts)], strict=True)
    n, off = [], 0
    for (at, _), w in zip(blocks(texts), whose, strict=True):
        n.append(w + at)
    x, whose = np.concatenate(x), np.concatenate(n)
    first = np.searchsorted(whose, np.arange(len(texts) + 1))
    s = x.shape[1]
    p = {"W": rng.normal(0, s**-0.5, (s, HIDDEN)), "b": np.zeros(HIDDEN), "V": rng.normal(0, 0.3, (HIDDEN, GATE)), "U": rng.normal(0, 0.3, (HIDDEN, GATE)), "w": rng.normal(0, 0.3, GATE), "c": rng.normal(0, 0.3, HIDDEN), "d": np.zeros(1)}
    p = {k: v.astype(np.float32) for k, v in p.items()}
    m1, m2, t = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for i in range(0, len(order), BATCH):
            docs = order[i : i + BATCH]
            idx = np.concatenate([np.arange(first[d], first[d + 1]) for d in docs])
            bag = np.repeat(np.arange(len(docs)), first[docs + 1] - first[docs])
            one = np.zeros((len(docs), len(idx)), np.float32)
            one[bag, np.arange(len(idx))] = 1
            xb = x[idx]
            h = np.tanh(xb @ p["W"] + p["b"])
            tv, su = np.tanh(h @ p["V"]), _sigmoid(h @ p["U"])
            a = (tv * su) @ p["w"]
            e = np.exp(a - a.max())
            alpha = e / (one @ e)[bag]
            z = one @ (alpha[:, None] * h)
            err = (_sigmoid(z @ p["c"] + p["d"][0]) - labels[docs]) / len(docs)
            dz = err[:, None] * p["c"]
            dalpha = (dz[bag] * h).sum(axis=1)
            da = alpha * (dalpha - (one @ (alpha * dalpha))[bag])
            dtv, dsu = da[:, None] * p["w"] * su * (1 - tv**2), da[:, None] * p["w"] * tv * su * (1 - su)
            dh = alpha[:, None] * dz[bag] + dtv @ p["V"].T + dsu @ p["U"].T
            dpre = dh * (1 - h**2)
            g = {"W": xb.T @ dpre + 1e-5 * p["W"], "b": dpre.sum(axis=0), "V": h.T @ dtv, "U": h.T @ dsu, "w": (tv * su).T @ da, "c": z.T @ err, "d": np.array([err.sum()])}
            t += 1
            for k in p:
                m1[k] = 0.9 * m1[k] + 0.1 * g[k]
                m2[k] = 0.999 * m2[k] + 0.001 * g[k] ** 2
                rate = RATE * (1 - 0.8 * epoch / EPOCHS)
                p[k] = (p[k] - rate * (m1[k] / (1 - 0.9**t)) / (np.sqrt(m2[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Model(p)


def fit(labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Train on whole texts of about SAMPLE_ROWS labelled rows."""
    rows = labelled.where(F.col(label).isNotNull()).select(key, F.coalesce(F.col(text), F.lit("")).alias("_t"), F.col(label).cast("double").alias("_y"))
    got = bounded_sample(rows, key, SAMPLE_ROWS, "_t", SAMPLE_CHARS).toPandas().sort_values([key, "_t"], kind="stable")
    return train(as_bytes(got["_t"]), got["_y"].to_numpy())


def score(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    spark = df.sparkSession
    text_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # of fixed size

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.scores(as_bytes(texts)))

    return df.withColumn(out, scores(F.col(text)))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def op3_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("held_out", held_out())
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("quality is not null")
    # Sample the labels first: their texts are then a small semi-join of the documents, not a join of all.
    learn = bounded_sample(labels.where(~held_out()), "doc_id", SAMPLE_ROWS)
    model = fit(docs.where(~F.col("held_out")).select("doc_id", "text").join(learn, "doc_id"))
    return score(docs, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
