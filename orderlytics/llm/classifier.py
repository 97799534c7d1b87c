"""Quality classifier over hashed word and character n-gram vectors.

Every word, every run of `GRAM` bytes and every word that repeats the one before
is a hashed feature with a learned vector; a document is the average of its features' vectors, and a
softmax layer over it gives the classes. Training is stochastic gradient
descent in numpy on a bounded sample: of the labelled training documents the
`TRAIN_DOCS` with the smallest hashed id, as far as their texts stay within
`TRAIN_BYTES`. The sample is what one task reads; it does not grow with the
corpus. Scoring reads every whole text: since averaging and the output layer are
linear, each feature's contribution to the log-odds is one number, so the model
that goes to the tasks is a table of `BUCKETS` numbers.

Empty and NULL texts score the bias alone. A NULL doc_id is never held out and
never learned from; NULL labels are left out. Without both labels every score is
the share of label 1 (0.5 without labels). Repeated rows are scored each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from orderlytics.llm.common import ROW, portions, text_of, wrapped
from orderlytics.llm.wordhash import words

BUCKETS = 1 << 18
GRAM = 4
DIM = 8
TRAIN_DOCS = 6000
TRAIN_BYTES = 48 << 20
EPOCHS = 8
RATE = 0.5
FOLDS = 5
THRESHOLD = 0.3


def fold(id: str) -> Column:
    return F.pmod(F.crc32(F.col(id).cast("string")), F.lit(FOLDS))


def _features(data: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all features, and the text of each. Words have the lower half, runs of bytes the upper."""
    found = words(data, texts, lower=False)
    half = np.uint64(BUCKETS // 2 - 1)
    word, of_word = (found.hashes & half).astype(np.int32), np.repeat(np.arange(len(texts) - 1), np.diff(found.first))
    # A word after itself: a word n-gram told by its form, as the words themselves have no end.
    echo = np.flatnonzero(found.hashes[1:] == found.hashes[:-1]) + 1
    echo = echo[of_word[echo] == of_word[echo - 1]]
    word, of_word = np.append(word, np.zeros(len(echo), np.int32)), np.append(of_word, of_word[echo])
    n = len(data) - GRAM + 1
    if n <= 0:
        return word, of_word
    key = data[:n].astype(np.uint32)
    for k in range(1, GRAM):
        key = (key << np.uint32(8)) | data[k : k + n]
    key = (key * np.uint32(0x9E3779B1)) >> np.uint32(32 - (BUCKETS // 2).bit_length() + 1)
    inside = np.ones(n, bool)
    for k in range(1, GRAM):
        cut = texts[1:-1] - k
        inside[cut[(cut >= 0) & (cut < n)]] = False
    at = np.flatnonzero(inside)
    gram = (key[at] + np.uint32(BUCKETS // 2)).astype(np.int32)
    return np.concatenate([word, gram]), np.concatenate([of_word, np.searchsorted(texts, at, "right") - 1])


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bags, labels, used = [], [], 0
    rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns))), key=lambda r: (r[0], r[1]))
    for _, text, label in rows:
        raw = np.frombuffer(text.encode(), np.uint8)
        used += len(raw)
        if used > TRAIN_BYTES and bags:
            break
        ids, _ = _features(raw, np.array([0, len(raw)]))
        ids, counts = np.unique(ids, return_counts=True)
        if len(ids):
            bags.append((ids, (counts / counts.sum()).astype(np.float32)))
            labels.append(label)
    if len(set(labels)) < 2:
        share = (np.mean(labels) if labels else 0.5).clip(0.01, 0.99) if labels else 0.5
        odds, bias = np.zeros(BUCKETS, np.float32), float(np.log(share / (1 - share)))
    else:
        dice = np.random.default_rng(7)
        vectors = dice.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
        out, offset = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
        steps, total = 0, EPOCHS * len(bags)
        for _ in range(EPOCHS):
            for i in dice.permutation(len(bags)):
                rate = RATE * (1 - steps / total)
                steps += 1
                ids, share = bags[i]
                mean = share @ vectors[ids]
                z = out @ mean + offset
                p = np.exp(z - z.max())
                p /= p.sum()
                p[labels[i]] -= 1
                back = p @ out
                out -= rate * np.outer(p, mean)
                offset -= rate * p
                # Features of a document share its gradient by their part of the average.
                vectors[ids] -= (rate * len(ids) ** 0.5) * np.outer(share, back)
        odds, bias = vectors @ (out[1] - out[0]), float(offset[1] - offset[0])
    yield pa.RecordBatch.from_arrays(
        [pa.array([odds.astype("<f4").tobytes()], pa.binary()), pa.array([bias])], ["odds", "bias"]
    )


def train(docs: DataFrame, labels: DataFrame, text: str = "text", label: str = "quality") -> tuple[np.ndarray, float]:
    """Contribution of each feature to the log-odds of label 1, and the bias."""
    known = labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & (fold("doc_id") != 0))
    known = known.select("doc_id", F.col(label).cast("int").alias("label"), F.xxhash64("doc_id").alias("place"))
    sample = known.orderBy("place", "doc_id", "label").limit(TRAIN_DOCS)
    texts = docs.select("doc_id", text_of(text).alias("body")).join(F.broadcast(sample), "doc_id")
    # Of several rows or labels of a doc_id the smallest counts, so that every run learns the same.
    one = F.min(F.struct("label", F.xxhash64("body").alias("text_hash"), "body")).alias("one")
    texts = texts.groupBy("doc_id", "place").agg(one).select("place", "one.body", "one.label")
    model = texts.repartition(1).mapInArrow(_learn, "odds binary, bias double").head()
    if model is None:  # no labelled document at all
        return np.zeros(BUCKETS, np.float32), 0.0
    return np.frombuffer(model.odds, "<f4"), model.bias


def _score(batches: Iterator[pa.RecordBatch], odds: np.ndarray, bias: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = []
        for first, last, data, texts in portions(batch.column("body")):
            ids, of = _features(data, texts)
            total = np.bincount(of, minlength=last - first)
            z = np.bincount(of, odds[ids], last - first) / np.maximum(total, 1) + bias
            scores.append(1 / (1 + np.exp(-np.clip(z, -30, 30))))
        score = np.concatenate(scores) if scores else np.zeros(0)
        yield pa.RecordBatch.from_arrays([batch.column(ROW), pa.array(score)], [ROW, "score"])


def scored(docs: DataFrame, odds: np.ndarray, bias: float, text: str = "text") -> DataFrame:
    """Rows (wrapped) with `score`, the probability of label 1, and `predicted`."""
    rows = docs.select(wrapped(docs), text_of(text).alias("body"))
    schema = T.StructType([rows.schema[ROW], T.StructField("score", T.DoubleType())])
    out = rows.mapInArrow(lambda it: _score(it, odds, bias), schema)
    return out.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
