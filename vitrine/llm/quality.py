"""Quality classifier: logistic regression over hashed word n-grams, trained by
follow-the-regularised-leader updates and scored as sparse dot products.

Rows are dealt to a fixed number of shards by hash.  Each shard runs the updates over
its rows in a fixed order; the weights are the mean of the shards'.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, functions as F

from vitrine.llm.common import WordHashes, id_and_text, mix, small_batches, small_or_shuffled

BITS = 18
TRAIN_ROWS = 20_000  # bound of the sample the model is fitted on
SHARDS = 4
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.01, 0.1
WORDS = regex.compile(r"\w+|[^\w\s]+")  # words, and runs of other signs
_ODD = np.uint64(0x9E3779B97F4A7C15)


def features(text: str, hashes: WordHashes, bits=BITS) -> tuple[np.ndarray, np.ndarray]:
    """(index, value): hashed words and word pairs of a whole text, values of unit length."""
    h = hashes.of(WORDS.findall(text))
    pairs = mix(h[:-1] * _ODD + h[1:]) if len(h) > 1 else h[:0]
    at, n = np.unique(np.r_[h, pairs] >> np.uint64(64 - bits), return_counts=True)
    value = np.log1p(n)
    norm = np.sqrt((value * value).sum())
    return at.astype(np.int64), value / norm if norm else value


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    bits: int


class Leader:
    """Follow-the-regularised-leader (proximal) for logistic loss; the last weight is the bias."""

    def __init__(self, bits, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2

    def weights(self, at):
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at, value, label, weight):
        at, value = np.r_[at, len(self.z) - 1], np.r_[value, 1.0]
        w = self.weights(at)
        g = (sigmoid((w * value).sum()) - label) * value * weight
        self.z[at] += g - (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha * w
        self.n[at] += g * g


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -50, 50)))


def _fit(bits, epochs):
    def run(key, pdf):
        hashes, leader = WordHashes(), Leader(bits)
        pdf = pdf.sort_values(["order", "text", "label"])  # the same on a retry
        rows = [(*features(t, hashes, bits), y) for t, y in zip(pdf["text"], pdf["label"])]
        # both labels weigh the same; a label that is absent weighs nothing
        share = np.bincount(pdf["label"], minlength=2) / len(pdf)
        weight = np.where(share > 0, 0.5 / np.maximum(share, 1e-9), 0)
        for _ in range(epochs):
            for at, value, y in rows:
                leader.learn(at, value, y, weight[y])
        w = leader.weights(np.arange(len(leader.z)))
        at = np.flatnonzero(w)
        return pd.DataFrame({"shard": int(key[0]), "at": at, "w": w[at]})
    return run


def sample(labels: DataFrame, train_rows=TRAIN_ROWS) -> DataFrame:
    """At most about ``train_rows`` of the rows (doc_id, label) that have both, by a hash of the id."""
    rows = labels.where("label is not null and doc_id is not null").select("doc_id", F.col("label").cast("int").alias("label"))
    rate = min(1.0, train_rows / max(1, rows.count()))
    return rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(rate * (1 << 30)))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", bits=BITS, train_rows=TRAIN_ROWS,
          epochs=EPOCHS) -> Model:
    """Fit on documents and their labels (doc_id, label), a bounded sample of them.

    Only the sample's texts are shuffled.  The driver gets at most 2**bits weights.
    Rows without a label or an id teach nothing; without any rows every score is 0.5.
    """
    small_batches(docs.sparkSession)
    some = small_or_shuffled(sample(labels, train_rows))
    order = F.xxhash64("doc_id")
    dealt = id_and_text(docs, id_col, text_col).join(some, "doc_id").select(
        order.alias("order"), "text", "label", F.pmod(order, F.lit(SHARDS)).alias("shard"))
    parts = dealt.groupBy("shard").applyInPandas(_fit(bits, epochs), "shard bigint, at bigint, w double").toArrow()
    weights = np.zeros((1 << bits) + 1)
    np.add.at(weights, parts["at"].to_numpy(), parts["w"].to_numpy())
    weights /= max(1, len(parts["shard"].unique()))
    return Model(weights[:-1].astype(np.float32), float(weights[-1]), bits)


def _score(shared):
    def run(batches):
        model, hashes = shared.value, WordHashes()
        for b in batches:
            out = []
            for text in b["text"].to_pylist():
                at, value = features(text, hashes, model.bits)
                out.append(sigmoid((model.weights[at] * value).sum() + model.bias))
            score = np.array(out, float)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score), pa.array((score >= 0.5).astype(np.int32))],
                                             names=["doc_id", "score", "predicted"])
    return run


def score(docs: DataFrame, model: Model, id_col="doc_id", text_col="text") -> DataFrame:
    """One row per document: doc_id, score (0 to 1, higher: label 1 likelier), predicted.

    Null and empty texts have no features and get the score of the bias.  Null ids and
    repeated rows are kept, extra columns ignored, an empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)  # 2**bits weights
    return id_and_text(docs, id_col, text_col).mapInArrow(_score(shared), "doc_id bigint, score double, predicted int")
